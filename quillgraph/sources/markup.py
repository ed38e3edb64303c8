"""XML, HTML, JSON and SQLite sources."""

from __future__ import annotations

import html
import io
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.udf import lazy_udf


#: Rows that a parser's task holds at once.
ROWS = 2048


def parsed(docs: DataFrame, column: str, parse: Callable[[object], Iterator[dict]], schema: str) -> DataFrame:
    """The other columns of ``docs`` with each of the rows that ``parse`` gives for ``column``, and ``at``, their place from 0. Rows leave the
    task as they are found: it holds one document and ``ROWS`` rows, never all rows of a batch of documents. Nulls have none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [c for c in docs.columns if c != column]
    kind = docs.select(*keys, F.lit(0).alias("at"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")))).schema
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            place = batch.schema.get_field_index(column)
            for k in range(len(batch)):
                x = batch.column(place)[k].as_py()
                if x is None:
                    continue
                of = {c: batch.column(batch.schema.get_field_index(c))[k].as_py() for c in keys}
                for at, row in enumerate(parse(x)):
                    rows.append(of | {"at": at} | row)
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=out)

    return docs.mapInArrow(run, kind)


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of one tag, streamed by Spark's XML reader; attributes are columns that start with an underscore."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def witnesses(units: DataFrame) -> DataFrame:
    """(unit, reading, witness) of collation units: struct arrays of readings whose witnesses are one text."""
    r = units.select("unit", F.explode("readings").alias("r"))
    return r.select("unit", F.col("r.n").alias("reading"), F.explode(F.filter(F.split(F.trim("r.wit"), "\\s+"), lambda w: w != "")).alias("witness"))


def json_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; files that can't be parsed have all columns null and ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def ragged(doc_id: Column, nested: Column) -> Column:
    """Array of arrays of text as array of struct(doc_id, chapter, n, text), counted from 1; null texts are left out."""
    rows = F.flatten(F.transform(nested, lambda ch, i: F.transform(F.coalesce(ch, F.array().cast("array<string>")), lambda t, j: F.struct(doc_id.alias("doc_id"), (i + 1).alias("chapter"), (j + 1).alias("n"), t.alias("text")))))
    return F.filter(rows, lambda r: r["text"].isNotNull())


_SKIP = {"script", "style", "noscript", "template"}
_BREAK = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "main", "nav", "blockquote", "title", "body", "head", "html", "dd", "dt"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """A light tree: nodes are [tag, attributes, children]; text is a str child."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _BREAK and tag != "br":  # a block ends the paragraph that is open
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    del self.open[k:]
                    break
                if self.open[k][0] in _BREAK:
                    break
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def tree(markup: str) -> list:
    t = _Tree()
    t.feed(markup or "")
    t.close()
    return t.root


def _walk(node: list):
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n[2]) if not isinstance(c, str)]


def text_of(node: list) -> str:
    """Visible text with white space collapsed; blocks are set apart."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n[0] not in _SKIP:
            if n[0] in _BREAK:
                out.append(" ")
                todo.append(" ")
            todo += reversed(n[2])
    return " ".join("".join(out).split())


def main_node(root: list) -> list:
    """article, else main, else #content or .content, else the div with most paragraphs, else everything."""
    nodes = list(_walk(root))
    for want in (lambda n: n[0] == "article", lambda n: n[0] == "main", lambda n: n[1].get("id") == "content", lambda n: "content" in (n[1].get("class") or "").split()):
        if found := next((n for n in nodes if want(n)), None):
            return found
    divs = [(sum(1 for c in _walk(n) if c[0] == "p"), -k, n) for k, n in enumerate(nodes) if n[0] == "div"]
    return max(divs, key=lambda x: x[:2])[2] if divs and max(divs, key=lambda x: x[:2])[0] else root


@lazy_udf("string")
def html_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else text_of(tree(x)))


@lazy_udf("struct<text string, paragraphs array<string>, title string>")
def main_content(s: pd.Series) -> pd.DataFrame:
    """Text and paragraphs of the main part, and the page's title."""
    rows = []
    for x in s:
        if x is None:
            rows.append((None, None, None))
            continue
        root = tree(x)
        main = main_node(root)
        title = next((text_of(n) for n in _walk(root) if n[0] == "title"), None)
        rows.append((text_of(main), [t for n in _walk(main) if n[0] == "p" and (t := text_of(n))], title))
    return pd.DataFrame({"text": [r[0] for r in rows], "paragraphs": [r[1] for r in rows], "title": [r[2] for r in rows]})


SECTION = "number int, title string, text string"


def section_rows(x: str) -> Iterator[dict]:
    """Numbered parts of a page: a heading, and the paragraphs up to the next one.

    A number at the start of a heading (``Article 3``, ``Q. 12``, ``IV.``) is the part's; of equal numbers the first wins.
    """
    roman = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}

    def number(t: str) -> int | None:
        if m := re.match(r"^(?:\D{0,20}?\b)?(\d{1,4})\b", t):
            return int(m[1])
        if m := re.match(r"^(?:[A-Za-z]+\s+)?([IVXLC]+)[.:\s]", t + " "):
            v = [roman[c] for c in m[1]]
            return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))
        return None

    seen, title, body = set(), None, []

    def closed() -> Iterator[dict]:
        n = number(title) if title else None
        if title is not None and body and n not in seen:
            if n is not None:
                seen.add(n)
            yield {"number": n, "title": title, "text": "\n".join(body)}

    for n in _walk(main_node(tree(x))):
        if re.fullmatch(r"h[1-6]", n[0]):
            yield from closed()
            title, body = text_of(n), []
        elif n[0] == "p" and (t := text_of(n)):
            body.append(t)
    yield from closed()


@lazy_udf(f"array<struct<{SECTION}>>")
def sections(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else list(section_rows(x)))


def links(markup: Column) -> Column:
    """href values in order, each once; anchors and scripts are left out."""
    found = F.regexp_extract_all(markup, F.lit('(?i)<a\\s[^>]*?href="([^"]*)"'), 1)
    return F.array_distinct(F.filter(found, lambda h: (h != "") & ~h.startswith("#") & ~F.lower(h).startswith("javascript:")))


def absolute(base: Column, href: Column) -> Column:
    """``href`` against the page's URL: full URLs stay, paths get the host, others the page's folder."""
    host, folder = F.regexp_extract(base, "^(\\w+://[^/]+)", 1), F.regexp_extract(base, "^(\\w+://[^?#]*/)", 1)
    folder = F.when(folder.rlike("^\\w+://$") | (folder == ""), F.concat(host, F.lit("/"))).otherwise(folder)
    return F.when(href.rlike("^\\w+://"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def decode(content: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1."""
    for name in ("utf-8", "cp1252"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


@lazy_udf("string")
def decoded(s: pd.Series) -> pd.Series:
    """Bytes as text, by the first encoding that fits: UTF-8, Windows-1252, Latin-1."""
    return s.map(lambda x: None if x is None else decode(x))


@lazy_udf("string")
def unescaped(s: pd.Series) -> pd.Series:
    """Character references as the characters that they stand for."""
    return s.map(lambda x: None if x is None else html.unescape(x))


#: Entities and what they stand for in plain text; other entities are a space.
ENTITIES = {"mdash": " ", "ndash": " ", "aelig": "ae", "AElig": "Ae", "oelig": "oe", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def plain_entities(c: Column) -> Column:
    """Named entities by ``ENTITIES`` in that order, then all others, numbers too, as a space."""
    for name, by in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(by))
    return F.regexp_replace(c, "&(#\\d+|[a-zA-Z]+);", " ")


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _events(x: str | bytes):
    """(start or end, element) of a document, as it is read; who takes an element whole clears it."""
    import xml.etree.ElementTree as ET

    return ET.iterparse(io.BytesIO(x.encode() if isinstance(x, str) else x), events=("start", "end"))


WORD = "verse string, pos int, id string, lemma string, morph string, surface string, kind string"


def osis_rows(x: str | bytes) -> Iterator[dict]:
    """Words of an OSIS book, one after another: a written form and the read form in the note right after it are both rows (kind)."""
    for event, verse in _events(x):
        if event == "start" or _name(verse) != "verse":
            continue
        pos, before = 0, None
        for e in verse:
            tag = _name(e)
            if tag == "w":
                pos += 1
                before = e.get("type")
                yield {"verse": verse.get("osisID"), "pos": pos, "id": e.get("id"), "lemma": e.get("lemma"), "morph": e.get("morph"), "surface": "".join(e.itertext()), "kind": "ketiv" if before == "x-ketiv" else "word"}
            elif tag == "note" and before == "x-ketiv":
                for r in (w for w in e.iter() if _name(w) == "w"):
                    yield {"verse": verse.get("osisID"), "pos": pos, "id": r.get("id"), "lemma": r.get("lemma"), "morph": r.get("morph"), "surface": "".join(r.itertext()), "kind": "qere"}
                before = None
        verse.clear()


@lazy_udf(f"array<struct<{WORD}>>")
def osis_words(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else list(osis_rows(x)))


def _visible(e, without: tuple[str, ...]) -> str:
    """Text of an element; elements ``without`` are left out, their tails kept."""
    return "" if _name(e) in without else (e.text or "") + "".join(_visible(c, without) + (c.tail or "") for c in e)


TEI_SECTION = "path string, text string"


def tei_rows(x: str | bytes) -> Iterator[dict]:
    """Visible text of each innermost numbered TEI division, by its path of numbers; notes are left out, their tails kept."""
    path, inner = [], [False]  # numbers of the open divisions, and whether each has had one inside
    for event, e in _events(x):
        if not (_name(e).startswith("div") and e.get("n")):
            continue
        if event == "start":
            path.append(e.get("n"))
            inner[-1] = True
            inner.append(False)
        else:
            if not inner.pop():
                yield {"path": ".".join(path), "text": " ".join(_visible(e, ("note", "bibl", "figure")).split())}
            path.pop()
            e.clear()


@lazy_udf(f"array<struct<{TEI_SECTION}>>")
def tei_sections(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else list(tei_rows(x)))


MILESTONE_SECTION = "book string, section string, chapter string, part string, text string"


def milestone_rows(x: str | bytes) -> Iterator[dict]:
    """Section divisions of a TEI edition, with their book (null where there are no books), the chapter and part that
    milestones in them declare, and their visible text in NFC: notes and breaks are left out, their tails kept."""
    import unicodedata

    books, section = [None], None
    for event, e in _events(x):
        if section is not None:
            if event == "start" or e is not section:
                continue
            marks = {m.get("unit"): m.get("n") for m in e.iter() if _name(m) == "milestone"}
            said = _visible(e, ("note", "milestone", "pb", "lb"))
            yield {"book": books[-1], "section": e.get("n"), "chapter": marks.get("Whiston_chapter"), "part": marks.get("Whiston_section"), "text": unicodedata.normalize("NFC", " ".join(said.split()))}
            section = None
            e.clear()
            continue
        kind = e.get("subtype") if _name(e) == "div" else None
        if event == "end":
            books.pop()
        elif kind == "section" and e.get("n") is not None:
            section = e
        else:
            books.append((e.get("n") or "1") if kind == "book" else books[-1])


@lazy_udf(f"array<struct<{MILESTONE_SECTION}>>")
def milestone_sections(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else list(milestone_rows(x)))


def milestones(text: Column, pattern: str) -> Column:
    """Array of struct(n, text): what stands between a milestone (its number is group 1) and the next. The text is split once: split
    inside the function of a transform, it would be split again for every milestone."""
    marks, pieces = F.regexp_extract_all(text, F.lit(pattern), 1), F.split(text, pattern)
    zipped = F.zip_with(marks, F.slice(pieces, F.lit(2), F.size(pieces)), lambda n, t: F.struct(n.alias("n"), F.trim(t).alias("text")))
    return F.filter(zipped, lambda m: m["n"].isNotNull())
