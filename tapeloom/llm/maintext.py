"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?!(?:noscript|template|svg|iframe|object)\b(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*/>)(script|style|noscript|template|svg|iframe|object|textarea|title)\b(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^<>]*+>",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text, and names in class, id or role that mark such parts.
ASIDE = frozenset("nav footer aside form dialog menu head button select label datalist canvas audio video".split())
NAMES = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright dialog disqus disclaimer footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert overlay paywall".split())
OUTER_NAMES = frozenset("header".split())
#: Words that may stand beside these in a compound name; any other ("no-sidebar", "has-menu") makes it a name of its own.
BESIDE = frozenset("main top bottom left right site page primary secondary global mobile box block list section area container wrapper bar reader readers user users visitor visitors guest post posts article articles story stories slot unit zone item items info thread body text author count inline".split())
#: Names that a heading or section of an article may have as its id because they are its topic.
TOPICS = frozenset("ad ads advert adverts advertisement advertising banner consent cookie cookies copyright dialog disclaimer form gdpr login menu navigation newsletter notice notices promo promotion search share sharing social sponsor subscribe subscription tags alert overlay paywall".split())
#: Frequent function words.
STOP_WORDS = frozenset(
    "the of and to in is that it for was with as on be by are this from at or an not have which but they has had were all".split()
    + "der die das und ist nicht ein eine zu den von mit sich auf für des im dem auch als es an werden aus er hat dass sie nach bei".split()
    + "le la les de des du et est un une que qui dans pour pas sur au avec ce se en par plus ne son il sont ou aux cette".split()
    + "el los las del y que en un una por con para es se lo como más no su al o sus le ha este sí porque esta entre cuando".split()
)


#: Characters as wide as two, of scripts that need fewer of them.
WIDE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    zone: int  # 0 of the page, else the number of the article it is in
    heading: bool
    parts: list[str] = field(default_factory=list)
    para: bool = False  # a paragraph
    linked: int = 0
    text: str = ""
    kind: str = ""


def _names(value: str, names: frozenset) -> bool:
    """Whether a class, id or role has one of the names, alone or in a compound of such names and words beside them."""
    for whole in value.split():
        parts = set(re.findall("[a-z]+", whole))
        if parts & names and parts <= names | BESIDE:
            return True
    return False


def _marked(tag: str, attributes: str, in_article: bool, spare: int = 0) -> int:
    """Whether an element is a part that holds no main text (1) or is hidden (2)."""
    mark = int(tag in ASIDE and not (spare > 1 and tag == "form") or tag == "header" and not in_article)
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return mark
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape("".join(values)).lower()
        if name in ("class", "id", "role"):
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                continue  # a heading is judged by its text
            if name == "id" and tag == "section" and in_article and value.strip() in TOPICS:
                continue
            if spare < 2 and _names(value, NAMES if in_article else NAMES | OUTER_NAMES):
                mark = 1
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return mark


def blocks_of(html: str, spare: int = 0, parts: set[str] | None = None) -> list[Block]:
    """The page's text blocks in order, without those in parts that never hold main text.

    spare 1 keeps an article or main element inside such a part, 2 also forms and parts marked by name; hidden parts go.
    ``parts`` gets the tags of the elements left out; without any, spare changes nothing.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, in a marked part, article
    opened: Counter[str] = Counter()  # of the stack's tags, so that a stray end tag costs nothing
    block, link, article, at = None, False, 0, 0

    def take(raw: str) -> None:
        nonlocal block
        if raw and not (stack and stack[-1][1]):
            if block is None:
                if raw.isspace():
                    return
                block = Block(stack[-1][2] if stack else 0, any(t[0] in "h1h2h3h4h5h6" and len(t[0]) == 2 for t in stack[-2:]), para=bool(stack) and stack[-1][0] == "p")
                out.append(block)
            text = unescape(raw)
            block.parts.append(text)
            if link:
                block.linked += len("".join(text.split()))

    for m in TOKEN.finditer(html):
        take(html[at : m.start()])
        at = m.end()
        close, tag, attributes = m[2], m[3], m[4]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            take(" ")
            continue
        if tag == "a":
            link = not close
        if tag in BLOCKS:
            block, link = None, False
        if close:
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            opened[stack.pop()[0]] -= 1  # its end tag may be left out
        _, out_of_text, inside = stack[-1] if stack else ("", 0, 0)
        if tag in ("article", "main"):
            article += 1
            inside = inside or article
            out_of_text = 0 if spare and out_of_text == 1 else out_of_text
        marked = max(out_of_text, _marked(tag, attributes, bool(inside), spare))
        if marked and parts is not None:
            parts.add(tag)
        if marked or tag in BLOCKS:
            if tag in BLOCKS or not attributes.rstrip().endswith("/"):
                stack.append((tag, marked, inside))
                opened[tag] += 1
    take(html[at:])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def _nearest(blocks: list[tuple[int, str]]) -> list[tuple[int, str] | None]:
    """For each block the last decided one before it."""
    out, last = [], None
    for block in blocks:
        out.append(last)
        if block[1] in ("good", "bad"):
            last = block
    return out


def classify(blocks: list[Block], short: int = 70, long: int = 200, low: float = 0.2, high: float = 0.3, links: float = 0.3) -> list[Block]:
    """The blocks of the main text.

    First pass, by each block's length, link density and stop-word density: good, bad or not decided (near good, short). An
    article's paragraphs may hold links, but not be one short link. Where no block has a known language's stop words, length and
    links decide; wide characters count twice. Second
    pass: a block that is not decided takes the label of its nearest decided neighbours in its article, or on the page;
    where they differ the nearer one's, at equal distance the better one's for headings and near good blocks. An article
    whose blocks decide nothing is main text. If some article has main text, the rest of the page has none.
    """
    seen: list[tuple[Block, float, float, int]] = []
    for b in blocks:
        words = [w.strip(".,;:!?\"'()").lower() for w in b.text.split()]
        density = sum(w in STOP_WORDS for w in words) / len(words)
        size, linked = len(b.text) + len(WIDE.findall(b.text)), b.linked / max(1, len(b.text.replace(" ", "")))
        seen.append((b, density, linked, size))
    known = any(density >= high for _, density, linked, size in seen if linked <= links and size >= short)
    for b, density, linked, size in seen:
        if not known and not b.zone:
            density = high
        held = b.zone and (b.heading or b.para and (linked < 0.95 or size >= short))
        if linked > links and not held or not b.zone and "©" in b.text and size < long or b.linked and size < short and not b.zone:
            b.kind = "bad"
        elif size < short:
            b.kind = "short"
        elif density >= high and size >= long:
            b.kind = "good"
        elif density >= low or b.zone:
            b.kind = "near"
        else:
            b.kind = "bad"
    zones: dict[int, list[tuple[int, Block]]] = {}
    for k, b in enumerate(blocks):
        zones.setdefault(b.zone, []).append((k, b))
    for zone, own in zones.items():
        if not any(b.kind == "good" for _, b in own):
            # nothing is surely good: near good blocks are the text, or all of an article that is not links
            for _, b in own:
                if b.kind == "near" or zone and b.kind == "short":
                    b.kind = "good"
        first = [b.kind for _, b in own]
        after = _nearest([(k, kind) for (k, _), kind in zip(reversed(own), reversed(first))])[::-1]
        for (k, b), before, behind in zip(own, _nearest([(k, kind) for (k, _), kind in zip(own, first)]), after):
            if b.kind in ("good", "bad"):
                continue
            near = [(abs(i - k), kind == "bad", kind) for i, kind in (x for x in (before, behind) if x)]
            if zone or b.kind == "near" or b.heading and behind and behind[1] == "good":
                b.kind = "good" if not near or any(kind == "good" for *_, kind in near) else "bad"
            else:
                b.kind = min(near, key=lambda x: (x[0], not x[1]))[2] if near else "bad"
    good = [b for b in blocks if b.kind == "good"]
    return [b for b in good if b.zone] or good


def short_page(blocks: list[Block], links: float = 0.3) -> list[Block]:
    """The blocks of a page that has short ones only, without links and copyright lines."""
    return [b for b in blocks if b.linked <= links * len(b.text.replace(" ", "")) and "©" not in b.text]


def main_text(html: str | None) -> str:
    """The main text: its blocks joined by an empty line, character references decoded, white space inside a block one blank.

    Where no article has text, articles inside marked parts are looked at; where still nothing is main text, forms and parts
    marked by name are too. A page of nothing but short blocks keeps those that are no links.
    """
    parts: set[str] = set()
    blocks = blocks_of(html or "", 0, parts)
    good = classify(blocks)
    if parts and not any(b.zone for b in good):
        inner = classify(blocks_of(html or "", 1))
        good = inner if any(b.zone for b in inner) else good or classify(blocks_of(html or "", 2))
    return "\n\n".join(b.text for b in good or short_page(blocks))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page from its whole html; a null or blank page, or one without main text, has text ''.

    One narrow stage; a page's time is linear in its length. Repeated rows and null ids or urls stay as they are; other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    got = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return got.toDF(id_col, url_col, "text", "n_chars")
