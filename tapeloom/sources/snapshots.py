"""Keyed tables whose rows are upserted in whole versions: readers see one version or the next, never a mixture."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "_commit"


@dataclass(frozen=True)
class Snapshots:
    """A table below ``path`` with one row per ``keys``: the one that is greatest by ``order``, else by its commit, the later.

    A commit writes its own rows only, as a new folder of Parquet files, and then a manifest that names all folders of its version. The
    manifest takes its name by a rename that fails if the name is taken, so a version appears at once, a writer that fails
    before leaves the table as it was, and of two writers at a time the second fails and may repeat. Repeated and
    reordered upserts give the same table if ``order`` has no ties; ties fall to the later commit, within one to the greatest row.
    Columns need types that can be compared. Whole numbers that a commit names as ``bits`` are merged by bit_or instead; manifests carry their names.

    Folders of like size are merged once there are over ``most`` of them, each row some log(commits) times in all. Folders and
    manifests of the last ``keep`` versions stay for readers that have begun; older ones are deleted.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    most: int = 4
    keep: int = 8

    @property
    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop.fs

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._file("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        fs, folder = self._fs(), self._file("manifests")
        return sorted(n for f in fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json")) if fs.exists(folder) else []

    def _load(self, name: str) -> dict:
        stream = self._fs().open(self._file(f"manifests/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> dict:
        """The newest manifest: number, schema, parts (name, rows) and the last batch of each stream."""
        names = self._manifests()
        return self._load(names[-1]) if names else {"number": 0, "schema": None, "parts": [], "batches": {}}

    def _publish(self, manifest: dict) -> None:
        """Makes a version the newest at once; fails if there is one of its number."""
        draft, name = self._file(f"manifests/.{uuid.uuid4().hex}"), self._file(f"manifests/{manifest['number']:012d}.json")
        out = self._fs().create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(draft, name, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _part(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{name}")
        return {"name": name, "rows": self.spark.read.parquet(f"{self.path}/parts/{name}").count()}

    def _rows(self, manifest: dict, parts: list[dict]) -> DataFrame:
        """Each key's winning row among these parts."""
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not parts:
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.schema(schema).parquet(*(f"{self.path}/parts/{p['name']}" for p in parts))
        bits = manifest.get("bits", [])
        rest = [c for c in schema.names if c not in (*self.keys, *self.order, COMMIT, *bits)]
        best = every.groupBy(*self.keys).agg(F.max(F.struct(*self.order, COMMIT, *rest)).alias("_best"), *(F.bit_or(c).alias(c) for c in bits))
        return best.select(*(c if c in self.keys or c in bits else F.col(f"_best.{c}").alias(c) for c in schema.names))

    def read(self) -> DataFrame | None:
        """The newest whole version; None before the first commit."""
        now = self.version()
        return self._rows(now, now["parts"]).drop(COMMIT) if now["number"] else None

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None, bits: tuple[str, ...] = ()) -> None:
        """Commits rows; a batch number of a stream that is committed already is left out. bits: columns that are merged by bit_or from now on."""
        now = self.version()
        if stream is not None and batch is not None and now["batches"].get(stream, -1) >= batch:
            return
        new = rows.withColumn(COMMIT, F.lit(now["number"] + 1).cast("long"))
        if now["schema"] is None:
            now["schema"] = new.schema.json()
        else:
            names = [f["name"] for f in json.loads(now["schema"])["fields"]]
            new = new.select(*names)
        part = self._part(new)
        batches = now["batches"] | ({stream: batch} if stream is not None and batch is not None else {})
        now = now | {"number": now["number"] + 1, "parts": [*now["parts"], *([part] if part["rows"] else [])], "batches": batches}
        now["bits"] = sorted({*now.get("bits", []), *bits})
        self._publish(now)
        self._merge(now)
        self._expire()

    def _merge(self, now: dict) -> None:
        parts = now["parts"]
        first, total = len(parts), 0
        while first and (first == len(parts) or parts[first - 1]["rows"] <= 2 * total):
            first -= 1
            total += parts[first]["rows"]
        if len(parts) - first > self.most:
            merged = self._part(self._rows(now, parts[first:]))
            self._publish(now | {"number": now["number"] + 1, "parts": [*parts[:first], merged]})

    def _expire(self) -> None:
        names = self._manifests()
        old, kept = names[: -self.keep], names[-self.keep :]
        if not old:
            return
        held = {p["name"] for n in kept for p in self._load(n)["parts"]}
        for name in old:
            for p in self._load(name)["parts"]:
                if p["name"] not in held:
                    self._fs().delete(self._file(f"parts/{p['name']}"), True)
            self._fs().delete(self._file(f"manifests/{name}"), False)
