"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let_go, words_of

WORD_SLOTS = 1 << 16
#: Byte classes: 0 other symbol, 1 upper, 2 lower, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 other mark, 8 bar, 9 not ASCII.
CLASSES = np.zeros(256, np.uint8)
for _kind, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?", b"'\"()-!", b"|", bytes(range(128, 256))), 1):
    CLASSES[list(_chars)] = _kind
STATISTICS = 22


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure statistics of a text, finite for any text."""
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=10).astype(float)
    size, n = max(1.0, kinds.sum()), max(1, len(words))
    letters = max(1.0, kinds[1] + kinds[2] + kinds[9])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bars = sum(b"|" in x for x in lines)
    odd = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?!'\")")
    loud = sum(c for w, c in counts.items() if w.endswith(b"!"))
    upper = sum(c for w, c in counts.items() if w.isupper())
    return [
        *(kinds[[0, 3, 4, 5, 6, 7, 8, 9]] / size), kinds[1] / letters, np.log1p(len(words)), np.log1p(size), size / n, len(counts) / n,
        max(counts.values(), default=0) / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)) / 100,
        bars / max(1, len(lines)), odd / n, loud / n, upper / n, float(not words),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Slots and weights of the distinct words, of length one together, and the statistics."""
    words = words_of(text)
    counts = Counter(words)
    slots = np.fromiter((zlib.crc32(w.lower()) for w in counts), np.int64, len(counts)) % WORD_SLOTS
    x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    return slots, x, statistics((text or "").encode("utf-8", "surrogatepass"), words, counts)


@dataclass
class Model:
    """bias + linear + pairwise terms; the last slots are the standardised statistics and metadata."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.nan_to_num((stats - self.mean) / self.scale), -3, 3) / 2

    def score(self, slots: np.ndarray, x: np.ndarray, stats: Sequence[float]) -> float:
        """The probability of label 1; pairwise terms in linear time: half of squared sums less summed squares."""
        if not len(self.linear):
            return 0.5
        d = self.dense(np.asarray(stats, float))
        xs = np.concatenate([x, d])
        at = np.concatenate([slots, np.arange(WORD_SLOTS, WORD_SLOTS + len(d))])
        p = self.factors[at] * xs[:, None]
        z = self.bias + float(self.linear[at] @ xs) + 0.5 * float((p.sum(0) ** 2).sum() - (p * p).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, Sequence[float], int]], rank: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.05, penalty: float = 2e-5, steps: int = 280, seed: int = 1) -> Model:
    """AdaGrad on the logistic loss over (slots, weights, statistics, label), for ``steps`` batches at least; with no rows the model scores 0.5."""
    if not rows:
        return Model(0.0, np.empty(0), np.empty((0, rank)), np.empty(0), np.empty(0))
    stats, y = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    mean, scale = np.nanmean(stats, 0), np.nanstd(stats, 0)
    prior = min(max(y.mean(), 0.01), 0.99)
    slots_n = WORD_SLOTS + stats.shape[1]
    rng = np.random.default_rng(seed)
    m = Model(float(np.log(prior / (1 - prior))), np.zeros(slots_n), rng.normal(0, 0.03, (slots_n, rank)), np.nan_to_num(mean), np.where(np.nan_to_num(scale) > 1e-9, scale, 1.0))
    dense = m.dense(stats)
    tail = np.arange(WORD_SLOTS, slots_n)
    g_lin, g_fac, g_bias = np.full(slots_n, 1e-3), np.full((slots_n, rank), 1e-3), 1e-3
    for _ in range(max(epochs, steps // -(-len(rows) // batch))):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            at = np.concatenate([np.concatenate([rows[k][0], tail]) for k in some])
            xs = np.concatenate([np.concatenate([rows[k][1], dense[k]]) for k in some])
            size = np.array([len(rows[k][0]) + len(tail) for k in some])
            start, row = np.cumsum(size) - size, np.repeat(np.arange(len(some)), size)
            p = m.factors[at] * xs[:, None]
            total = np.add.reduceat(p, start)
            z = m.bias + np.add.reduceat(m.linear[at] * xs, start) + 0.5 * ((total**2).sum(1) - np.add.reduceat((p * p).sum(1), start))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            used, place = np.unique(at, return_inverse=True)
            gx = err[row] * xs
            grad = np.bincount(place, gx, len(used)) + penalty * m.linear[used]
            g_lin[used] += grad**2
            m.linear[used] -= rate * grad / np.sqrt(g_lin[used])
            pull = gx[:, None] * (total[row] - p)
            grad = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(rank)], 1) + penalty * m.factors[used]
            g_fac[used] += grad**2
            m.factors[used] -= rate * grad / np.sqrt(g_fac[used])
            g_bias += err.sum() ** 2
            m.bias -= rate * err.sum() / np.sqrt(g_bias)
    return m


def _extra(metadata: Sequence[str]) -> list[Column]:
    return [F.log1p(F.greatest(F.col(f"`{c}`").cast("double"), F.lit(0.0))) for c in metadata]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: Sequence[str] = (), sample: int = 6_000) -> Model:
    """A model from at most ``sample`` labelled documents, those with the least hash of their id (a bound, so fixed work at any size).

    The bound keeps what reaches the driver to features of ``sample`` documents at any input size. Null labels and ids
    take no part; of a document's repeated labels the majority counts, a tie as 1; of its repeated rows the one with
    the least hash of its text is taken, so that any partitioning gives the same model. Long texts are taken whole, in the task
    that has them; an empty table on either side gives the model that scores 0.5.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array(*_extra(metadata)).cast("array<double>").alias("extra"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "extra", "label")).alias("r")).select("id", "r.text", "r.extra", "r.label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            got = [features(t) for t in d["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(i) for i in d["id"]]), pa.array([s.astype("<u2").tobytes() for s, _, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x, _ in got], pa.binary()), pa.array([[*s, *(np.nan if v is None else v for v in e)] for (_, _, s), e in zip(got, d["extra"])], pa.list_(pa.float64())), pa.array(d["label"], pa.int32())],
                ["id", "slots", "weights", "stats", "label"],
            )

    got = rows.mapInArrow(run, "id string, slots binary, weights binary, stats array<double>, label int").toArrow().sort_by("id").to_pylist()
    return fit([(np.frombuffer(r["slots"], "<u2").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(float), r["stats"], r["label"]) for r in got])


def score(docs: DataFrame, model: Model, text_col: str = "text", metadata: Sequence[str] = (), score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the model's score (0 to 1) of each whole text; a column of that name is replaced.

    A null or blank text is scored by its statistics, a text of any length whole; rows with equal text and metadata have
    equal scores. An empty table gives no rows. The model is broadcast; its size depends on the slots alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != score_col]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score_col, T.DoubleType())])
    extra = F.array(*_extra(metadata)).cast("array<double>")
    given = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`"), extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m, n = model.value, len(names)
        for b in batches:
            scores = []
            for text, more in zip(b.column(n), b.column(n + 1).to_pylist()):
                slots, x, stats = features(text.as_py())
                scores.append(m.score(slots, x, [*stats, *(np.nan if v is None else v for v in more)]))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(scores, pa.float64())], [*names, score_col])

    return given.toDF(*(f"c{k}" for k in range(len(names) + 2))).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, metadata: Sequence[str] = ("n_chars",), sample: int = 6_000, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with score and predicted, from a model that has learnt only from labels of rows that are not held out.

    Columns of these names are replaced; metadata columns that ``docs`` lacks are left out. Every row stays, repeated ones and
    those with a null id or text too; a null id is never learnt from. An empty table gives no rows, no labels a score of 0.5;
    texts of any length are taken whole.
    """
    given = [c for c in metadata if c in docs.columns]
    model = train(docs, labels.where(~held_out()), metadata=given, sample=sample)
    return score(docs, model, metadata=given, score_col=score_col).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
