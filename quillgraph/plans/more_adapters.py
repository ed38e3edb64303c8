"""Further adapters: tagged texts, annotation features, collations, and the historical works."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillgraph.functions import refs, strongs, text
from quillgraph.functions.udf import lazy_udf
from quillgraph.operators import graph, ordered
from quillgraph.plans.adapters import Tables, adapter, edges, verse_id
from quillgraph.plans.registry import stored
from quillgraph.sources import formats, markup, textfabric
from quillgraph.sources import text as lines


def feature(spark: SparkSession, path: str, name: str, count_blank: bool) -> DataFrame:
    """(node, value) of one Text-Fabric feature file in a folder."""
    r = lines.after_header(lines.lines(spark, f"{path}/{name}.tf"), F.trim("line") == "").where(~F.col("line").startswith("@"))
    return textfabric.node_feature(r, count_blank).select("node", "value")


@adapter
def etcbc_phono(spark: SparkSession, path: str) -> Tables:
    """A property for words that exist; attach it with ``graph.attach``, which never inserts."""
    f = feature(spark, path, "phono", True)
    return {"phono": f.select(F.concat(F.lit("bhsa:tf:"), F.col("node").cast("string")).alias("id"), F.col("value").alias("phono"))}


@adapter
def etcbc_parallels(spark: SparkSession, path: str) -> Tables:
    """``source<TAB>target<TAB>value`` or, for the same source, ``target<TAB>value``: similarity edges; pairs whose value
    is no number are quarantined."""
    r = lines.lines(spark, path).where((F.trim("line") != "") & ~F.col("line").startswith("@"))
    p = F.split("line", "\t")
    r = r.withColumn("n", F.size(p)).where("n IN (2, 3)").withColumn("own", F.when(F.col("n") == 3, F.trim(p[0])))
    r = ordered.scan(r, ["file"], "line_no", last={"source": F.col("own")}).where("source IS NOT NULL")
    r = r.select("source", F.trim(F.element_at(p, -2)).alias("target"), F.trim(F.element_at(p, -1)).try_cast("int").alias("v"))
    ident = lambda c: F.concat(F.lit("bhsa:tf:"), F.col(c))
    return {"PARALLEL_OF": edges(r.where("v IS NOT NULL"), ident("source"), ident("target"), "PARALLEL_OF", similarity=F.col("v") / 100), "quarantine": r.where("v IS NULL").select("source", "target")}


@adapter
def stepbible_ttesv(spark: SparkSession, path: str) -> Tables:
    """Verse segments ``$Book C:V<TAB>pos=<codes>...``: one token a verse, from its first good tag."""
    form = "^\\$(\\S+) (\\d+):(\\d+)"
    r = lines.matching(lines.lines(spark, path), form)
    tags = F.filter(F.slice(F.split("line", "\t"), F.lit(2), F.greatest(F.size(F.split("line", "\t")) - 1, F.lit(0))), lambda t: t.rlike("^\\d[\\d+-]*=<[^>]+>"))
    first = F.get(tags, F.lit(0))
    osis = F.concat_ws(".", *(F.regexp_extract("line", form, k) for k in (1, 2, 3)))
    r = r.withColumn("tag", first).where("tag IS NOT NULL").withColumn("osis", osis)
    at = F.regexp_extract("tag", "^(\\d+)", 1).cast("int")
    hebrew = F.array(*map(F.lit, [*dict.fromkeys(refs.BOOKS.values())][:39]))
    code = strongs.canonical(F.regexp_extract("tag", "<([^>+]+)", 1), F.when(F.array_contains(hebrew, F.substring_index("osis", ".", 1)), "hb").otherwise("gk"))["canonical"]
    n = r.select(F.concat(F.lit("ttesv:"), "osis", F.lit("#"), ordered.padded(at)).alias("id"), "osis", at.alias("pos"), code.alias("strong"), "file", "line_no")
    n = ordered.first_wins(n, ["id"], ["file", "line_no"]).drop("file", "line_no")
    return {"TaggedToken": n, "INSTANCE_OF": edges(n, F.col("id"), F.col("strong"), "INSTANCE_OF")}


@adapter
def stepbible_proper_nouns(spark: SparkSession, path: str, header: str = "^\\$=+ ", mark: str = "–", kinds: tuple[str, ...] = ("Named", "Greek", "Aramaic")) -> Tables:
    """Sections that a header opens; of their detail lines those of the given kinds are entries."""
    cut = lines.blocks(lines.lines(spark, path), F.col("line").rlike(header))
    d = cut.select("file", "block", F.regexp_replace("head", header, "").alias("pos"), F.posexplode("details").alias("at", "line")).where(F.col("line").startswith(f"{mark} "))
    p = F.split("line", "\t")
    g = lambda k: F.trim(F.coalesce(F.get(p, F.lit(k)), F.lit("")))
    kind = F.trim(F.substring(g(0), len(mark) + 1, 200))
    n = d.where(kind.isin(*kinds)).select(g(1).alias("proper_name_entry"), "pos", g(2).alias("strong"), F.filter(F.transform(F.split(g(3), ";"), lambda x: F.trim(x)), lambda x: x != "").alias("refs"), "file", "block", "at").where("proper_name_entry <> ''")
    n = ordered.first_wins(n, ["proper_name_entry"], ["file", "block", "at"])
    n = n.select("proper_name_entry", F.trim("pos").alias("pos"), strongs.canonical(F.substring_index("strong", "=", 1))["canonical"].alias("strong"), F.when(F.size("refs") > 0, F.size("refs")).alias("verse_count"), F.coalesce(F.get("refs", F.lit(0)), F.lit("")).alias("first_occurrence"))
    return {"ProperNoun": n, "NAMED_AT": edges(n.where("first_occurrence <> ''"), F.col("proper_name_entry"), verse_id(F.col("first_occurrence")), "NAMED_AT")}


#: Dialects by the start of a corpus's name.
DIALECTS = {"sahidic": "Sahidic", "sahidica": "Sahidic", "bohairic": "Bohairic"}


@adapter
def coptic_scriptorium(spark: SparkSession, path: str) -> Tables:
    """``corpus/.../doc.tt``: tokens counted from 0 within a document, over kept rows; ``<x>`` is a supplement."""
    r = lines.lines(spark, path, glob="*.tt")
    root = re.sub("^[a-z]+:/*", "/", path.rstrip("/"))
    rel = F.regexp_replace(F.substring_index("file", root, -1), "^/+", "")
    r = r.withColumn("corpus", F.substring_index(rel, "/", 1)).withColumn("doc_id", F.regexp_extract("file", "([^/]+)\\.tt$", 1))
    p = F.split("line", "\t")
    dialect = F.lit(None).cast("string")
    for start, name in DIALECTS.items():
        dialect = F.when(F.lower("corpus").startswith(start), name).otherwise(dialect)
    r = r.where((F.trim("line") != "") & ~F.col("line").startswith("#") & (F.size(p) >= 3)).withColumn("dialect", dialect).where("dialect IS NOT NULL")
    r = ordered.scan(r, ["file"], "line_no", counts={"token_pos": F.lit(True)}).withColumn("token_pos", (F.col("token_pos") - 1).cast("int"))
    form = F.trim(p[0])
    supplied = form.rlike("^<.*>$")
    n = r.select(F.concat_ws(":", F.lit("coptic-scriptorium"), "corpus", "doc_id", F.col("token_pos").cast("string")).alias("id"), F.when(supplied, F.expr("substring(trim(split(line, '\t')[0]), 2, length(trim(split(line, '\t')[0])) - 2)")).otherwise(form).alias("norm"), text.null_if_blank(p[1]).alias("lemma"), text.null_if_blank(p[2]).alias("pos"), text.null_if_blank(F.get(p, F.lit(3))).alias("verse_ref"), "dialect", supplied.alias("supplement"), "corpus", "doc_id", "token_pos")
    return {"CopticWord": n, "IN_VERSE": edges(n, F.col("id"), verse_id(F.col("verse_ref")), "IN_VERSE")}


def split_hand(siglum: Column) -> Column:
    """struct(base, hand): a last S, V or C after letters alone, or after anything with a digit, is a later hand, named C."""
    base = F.regexp_replace(siglum, "[SVC]$", "")
    later = siglum.rlike("[SVC]$") & (F.length(siglum) > 1) & (base.rlike("\\d") | base.rlike("(?U)^\\p{L}+$"))
    return F.struct(F.when(later, base).otherwise(siglum).alias("base"), F.when(later, F.lit("C")).alias("hand"))


def century_of(base: Column) -> Column:
    """The century that a siglum's kind and number stand for; the rules are tried in order."""
    n = F.regexp_replace(base, "\\D", "").try_cast("long")
    return (
        F.when(base.startswith("P"), 3).when(base.startswith("L"), 10).when(base == "Byz", 9).when(base.rlike("(?U)^\\p{L}+$"), 5)
        .when(base.startswith("0") & (F.length(base) > 1), 5).when(n < 100, 9).when(n < 1000, 11).otherwise(12)
    )


@adapter
def open_cbgm_3_john(spark: SparkSession, path: str, database: str | None = None) -> Tables:
    """Collation units of 3 John 1: readings, who attests them, and a lacuna for every other witness."""
    r = markup.xml_rows(spark, path, "app", "_n string, rdg array<struct<_n:string,_wit:string,_VALUE:string>>")
    form = "^(?:.*?K)?(\\d+)V(\\d+)U(.+)$"
    r = r.withColumns({"c": F.regexp_extract("_n", form, 1).try_cast("int"), "v": F.regexp_extract("_n", form, 2).try_cast("int")}).where("c = 1 AND v BETWEEN 1 AND 15")
    unit = F.concat(F.lit("3John.1."), F.col("v").cast("string"), F.lit("/"), F.regexp_extract("_n", form, 3))
    d = r.select(unit.alias("unit"), "v", F.explode("rdg").alias("r")).where(F.trim("r._n") != "")
    readings = d.select(F.concat_ws("-", "unit", F.trim("r._n")).alias("id"), "unit", "v", F.trim(F.coalesce("r._VALUE", F.lit(""))).alias("text"))
    att = d.select("unit", F.concat_ws("-", "unit", F.trim("r._n")).alias("reading"), F.explode(F.filter(F.split(F.trim(F.coalesce("r._wit", F.lit(""))), "\\s+"), lambda w: w != "")).alias("witness"))
    every = att.select("witness") if database is None else formats.sqlite_table(spark, database, "WITNESSES", ["WITNESS"]).select(F.col("WITNESS").alias("witness"))
    full = graph.completed(readings.select("unit"), every, att, F.lit("lac")).select("unit", "witness", F.when(F.col("reading") == "lac", F.concat(F.col("unit"), F.lit("-lac"))).otherwise(F.col("reading")).alias("reading"))
    hands = every.distinct().withColumn("h", split_hand(F.col("witness")))
    w = hands.select(F.col("witness").alias("id"), F.col("h.base").alias("base_siglum"), F.concat("h.base", F.coalesce("h.hand", F.lit(""))).alias("witness_siglum"), century_of(F.col("h.base")).alias("date_century"))
    corr = hands.where("h.hand IS NOT NULL").select(F.col("witness").alias("src_id"), F.col("h.base").alias("dst_id"), F.lit("CORRECTOR_OF").alias("rel_type"))
    return {"Witness": w, "VariantUnit": readings.select(F.col("unit").alias("id"), "v").distinct(), "Reading": readings.drop("v"), "READS_AT": edges(readings, F.col("id"), F.col("unit"), "READS_AT"), "ATTESTED_BY": edges(full, F.col("reading"), F.col("witness"), "ATTESTED_BY"), "CORRECTOR_OF": corr}


def chunks(df: DataFrame, work: str, licence: str) -> DataFrame:
    """(chunk_id, anchor_id, work_id, text, ...) from (anchor_id, text)."""
    return df.where(F.trim("text") != "").select(F.col("anchor_id").alias("chunk_id"), "anchor_id", F.lit(work).alias("work_id"), "text", F.lit(licence).alias("license"), F.lit(True).alias("redistribute"))


#: Lines of a page that are judged together: a page is cut only between such stretches, where nothing is open.
STRETCH = 1 << 12
#: Elements whose text isn't plain text.
WITHIN = "script|style|noscript|template|title|textarea|iframe|noembed|noframes|xmp"
#: What may be open at a line's end: what opens and what closes it. A number's mark is in round brackets, as references are.
OPENS = {"__note": ("\\{", "\\}"), "__round": ("\\(", "\\)"), "__tag": ("<[A-Za-z/!?]", ">"), "__comment": ("<!--", "-->"), "__element": (f"(?i:<(?:{WITHIN})\\b)", f"(?i:</(?:{WITHIN})\\b)")}


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows of ``n`` pieces, some pieces a task, as a task's texts go to Python together."""
    return df.repartition(max(1, -(-n // 16)), "file", "piece")


def in_pieces(rows: DataFrame, ends: str) -> DataFrame:
    """(file, piece, text) of lines (file, line_no, line), up to where ``ends`` is found: stretches of lines, cut where no note, bracket, tag,
    comment or element is open, so that each can be read by itself. Only a row a stretch is looked at in order."""
    rows = rows.withColumn("stretch", F.floor((F.col("line_no") - 1) / STRETCH))
    last = {n: F.nullif(F.regexp_extract("line", f"(?s)^.*({o}|{c})", 1), F.lit("")) for n, (o, c) in OPENS.items()}
    s = rows.withColumns(last).groupBy("file", "stretch").agg(F.min(F.when(F.col("line").rlike(ends), F.col("line_no"))).alias("end"), *(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in OPENS))
    w = W.partitionBy("file").orderBy("stretch")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    is_open = F.lit(False)
    for n, (o, _) in OPENS.items():
        is_open = is_open | F.coalesce(F.last(n, ignorenulls=True).over(so_far).rlike(f"^(?:{o})"), F.lit(False))
    s = s.select("file", "stretch", F.min("end").over(so_far).alias("end"), is_open.alias("open")).withColumn("cut", ~F.coalesce(F.lag("open").over(w), F.lit(False)))
    s = stored(s.select("file", "stretch", "end", F.max(F.when(F.col("cut"), F.col("stretch"))).over(so_far).alias("piece")), "stretches")
    kept = rows.join(F.broadcast(s), ["file", "stretch"]).where("end IS NULL OR line_no <= end")
    line = F.when(F.col("line_no") == F.col("end"), F.regexp_replace("line", f"(?s)({ends}).*$", "")).otherwise(F.col("line"))
    of = dealt(kept.select("file", "piece", "line_no", line.alias("line")), s.count()).groupBy("file", "piece").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return of.select("file", "piece", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


#: Numbers that no text counts up to.
MOST_NUMBER = (1 << 31) - 1


def _marks(x: str) -> tuple[list[tuple[str, int, int, int]], list[tuple[str, int, int, int]]]:
    """(prefix, number, begin, end) of marks ``(prefix.n)``, and of marks ``(n)``, whose prefix is empty."""
    found = (re.finditer(form, x) for form in (r"\(\s*(\d+)\s*\.\s*(\d+)\s*\)", r"\(\s*()(\d+)\s*\)"))
    return tuple([(str(int(m[1])) if m[1] else "", n, m.start(), m.end()) for m in form if (n := int(m[2])) < MOST_NUMBER] for form in found)


@lazy_udf("struct<dotted int, flat int, runs array<struct<dotted boolean, prefix string, lo int, hi int, due int>>>")
def mark_runs(s: pd.Series) -> pd.DataFrame:
    """How many marks of each kind a piece has, and how it moves the number that is due: from ``lo`` to ``hi`` to ``due``, others not."""

    def one(x):
        kinds, runs = _marks(x or ""), []
        for dotted, marks in zip((True, False), kinds):
            due: dict[tuple[str, int], int] = {}
            for prefix, n, *_ in reversed(marks):  # from the end, so that what is known is what comes next
                due[prefix, n] = due.get((prefix, n + 1), n + 1)
            for (prefix, n), d in sorted(due.items()):
                if runs and runs[-1] | {"lo": 0, "hi": 0} == {"dotted": dotted, "prefix": prefix, "lo": 0, "hi": 0, "due": d} and runs[-1]["hi"] == n - 1:
                    runs[-1]["hi"] = n
                else:
                    runs.append({"dotted": dotted, "prefix": prefix, "lo": n, "hi": n, "due": d})
        return len(kinds[0]), len(kinds[1]), runs

    rows = [one(x) for x in s]
    return pd.DataFrame({k: [r[i] for r in rows] for i, k in enumerate(("dotted", "flat", "runs"))})


def numbers_due(runs: DataFrame) -> DataFrame:
    """(file, piece, prefixes, numbers): the numbers that are due where a piece begins, of the prefixes that it has; 1 is left out. Runs pass
    in order, some a piece, and only the number of each prefix is kept."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, piece, due, before = None, None, {}, {}

        def said(rows):
            more = {p: n for p, n in before.items() if n != 1}
            if more:
                rows.append({"file": file, "piece": piece, "prefixes": list(more), "numbers": list(more.values())})

        for batch in batches:
            rows: list[dict] = []
            for r in batch.to_pylist():
                if (r["file"], r["piece"]) != (file, piece):
                    said(rows)
                    due = due if r["file"] == file else {}
                    file, piece, before = r["file"], r["piece"], {}
                n = before.setdefault(r["prefix"], due.get(r["prefix"], 1))
                if r["lo"] <= n <= r["hi"]:
                    due[r["prefix"]] = r["due"]
            yield pa.RecordBatch.from_pylist(rows, schema=out)
        rows = []
        said(rows)
        yield pa.RecordBatch.from_pylist(rows, schema=out)

    kind = runs.sparkSession.createDataFrame([], "file string, piece long, prefixes array<string>, numbers array<int>").schema
    out = to_arrow_schema(kind)
    return runs.select("file", "piece", "prefix", "lo", "hi", "due").repartition("file").sortWithinPartitions("file", "piece", "prefix", "lo").mapInArrow(walk, kind)


@lazy_udf("array<struct<prefix string, n int, text string, last boolean>>")
def marked_paragraphs(s: pd.Series, dotted: pd.Series, prefixes: pd.Series, numbers: pd.Series) -> pd.Series:
    """Paragraphs of a piece after marks ``(n)`` or ``(prefix.n)``: a mark counts only if its number is the next one of its prefix, and a
    paragraph goes on to the next mark that counts. What stands before the first one comes first, without a number."""

    def one(x, dotted, prefixes, numbers):
        due = {} if prefixes is None else dict(zip(prefixes, map(int, numbers)))
        taken = [(None, None, 0, 0)]
        for prefix, n, begin, end in _marks(x)[0 if dotted else 1]:
            if n == due.get(prefix, 1):
                taken.append((prefix, n, begin, end))
                due[prefix] = n + 1
        ends = [t[2] for t in taken[1:]] + [len(x)]
        return [{"prefix": p, "n": n, "text": " ".join(x[begin:end].split()), "last": k == len(taken) - 1} for k, ((p, n, _, begin), end) in enumerate(zip(taken, ends))]

    return pd.Series([one(*r) for r in zip(s, dotted, prefixes, numbers)])


def numbered_paragraphs(pieces: DataFrame, slug: str, suffixes: dict[int, str] | None = None) -> DataFrame:
    """(anchor_id, text) of pages in pieces (file, piece, text) cited by paragraph, or by two numbers, whichever marks a page has more of: the
    first is then a suffix of the slug, ``-n`` or as in ``suffixes``, so that an anchor ends with the paragraph's number.

    A piece needs to know only which numbers are due where it begins; a paragraph that goes on in further pieces is put together after."""
    pieces = dealt(pieces, pieces.count())
    said = stored(pieces.select("file", "piece", mark_runs("text").alias("m")), "marks")
    kind = said.groupBy("file").agg((F.sum("m.dotted") > F.sum("m.flat")).alias("dotted"))  # a row a file
    runs = said.select("file", "piece", F.explode("m.runs").alias("r")).select("file", "piece", "r.*").join(F.broadcast(kind), ["file", "dotted"], "left_semi")
    p = pieces.join(F.broadcast(kind), "file").join(F.broadcast(numbers_due(runs)), ["file", "piece"], "left")
    p = p.select("file", "piece", F.posexplode(marked_paragraphs("text", "dotted", "prefixes", "numbers")).alias("at", "x")).select("file", "piece", "at", "x.*")
    inner = p.where("at > 0 AND NOT last").select("prefix", "n", "text")
    edge = p.where("at = 0 OR last")
    owner = F.last(F.when(F.col("n").isNotNull(), F.struct("piece", "at")), ignorenulls=True).over(W.partitionBy("file").orderBy("piece", "at"))
    whole = edge.withColumn("owner", owner).where("owner IS NOT NULL").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("piece", "at", "prefix", "n", "text"))).alias("p"))
    text_ = F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != ""), " ")
    whole = whole.select(F.col("p")[0]["prefix"].alias("prefix"), F.col("p")[0]["n"].alias("n"), F.regexp_replace(text_, *CLOSE_UP).alias("text"))
    suffix = F.when(F.col("prefix") == "", "").otherwise(F.concat(F.lit("-"), F.col("prefix")))
    for n, shown in (suffixes or {}).items():
        suffix = F.when(F.col("prefix") == str(n), F.lit(shown)).otherwise(suffix)
    return inner.unionByName(whole).select(F.concat(F.lit(slug), suffix, F.lit("."), F.col("n").cast("string")).alias("anchor_id"), "text")


#: No space before a stop.
CLOSE_UP = ("\\s+([,.;:!?])", "$1")
#: Notes in braces, and references in round ones, go before tags do.
APPARATUS = [("(?s)<(script|style)\\b.*?</\\1>", " "), ("\\{[^}]*\\}", " "), ("\\(#[^)]*\\)", " ")]
#: Repairs after that, in the order in which they must run. Bytes F9 and F7 and two hyphens are damaged
#: dashes and a macron; a dash is shown as a comma.
REPAIRS = [("\u00f9", ", "), ("\u00f7", ""), ("--", ", "), ("(?U)\\s+", " "), CLOSE_UP, ("^ | $", "")]


@adapter
def philo(spark: SparkSession, path: str, slug: str = "philo", suffixes: dict[int, str] | None = None) -> Tables:
    """A Latin-1 page of one treatise, up to its closing links; its paragraphs are told by their numbers, one or two, alone. A long page is
    read in pieces."""
    pieces = in_pieces(lines.lines(spark, path, "ISO-8859-1"), "Go to the|Tables of Contents")
    page = stored(pieces.withColumn("text", text.replace_all(markup.html_text(text.replace_all(F.col("text"), APPARATUS)), REPAIRS)), "pieces")
    return {"HistoricalChunk": chunks(numbered_paragraphs(page, slug, suffixes), slug, "pd")}


@adapter
def pliny_melmoth(spark: SparkSession, path: str, book: str = "10") -> Tables:
    """``### LETTER Ep B.L`` text: what stands between a letter's mark and the next."""
    r = lines.blocks(lines.lines(spark, path), F.col("line").startswith("### LETTER"))
    form = "^### LETTER Ep (\\d+)\\.(\\d+)"
    n = r.where(F.regexp_extract("head", form, 1) == book).select(F.concat_ws(".", F.lit("pliny.epistulae"), F.lit(book), F.regexp_extract("head", form, 2)).alias("anchor_id"), text.collapse_space(F.array_join("details", " ")).alias("text"))
    return {"HistoricalChunk": chunks(n, "pliny.epistulae", "pd").withColumn("chunk_id", F.concat("chunk_id", F.lit(".en")))}


def verses_of(chapters: DataFrame, work: str, form: str = "(?<![\\w.])(\\d{1,3})\\. ") -> DataFrame:
    """(anchor_id, text) from (chapter, text): verses at ``N. `` marks; text before the first joins it, repeats get
    letters, a chapter without marks is verse 1."""
    marks, pieces = F.regexp_extract_all("text", F.lit(form), 1), F.split("text", form)
    rows = F.when(F.size(marks) == 0, F.array(F.struct(F.lit("1").alias("n"), F.col("text").alias("t")))).otherwise(
        F.transform(marks, lambda n, i: F.struct(n.alias("n"), F.when(i == 0, F.concat_ws(" ", F.nullif(F.trim(pieces[0]), F.lit("")), F.trim(pieces[1]))).otherwise(F.trim(F.get(pieces, i + 1))).alias("t")))
    )
    v = chapters.select("chapter", F.posexplode(rows).alias("at", "x")).select("chapter", "at", F.col("x.n").alias("n"), F.col("x.t").alias("text")).where("text <> ''")
    v = ordered.sub_letter(v, ["chapter"], "n", ["at"], "label")
    return v.select(F.concat_ws(".", F.lit(work), "chapter", "label").alias("anchor_id"), "text")


@adapter
def pseudepigrapha(spark: SparkSession, path: str, work: str = "enoch") -> Tables:
    """HTML chapters (a heading with its number, then verses)."""
    raw = spark.read.format("binaryFile").load(path).select(markup.decoded("content").alias("x"))
    s = raw.select(F.explode(markup.sections("x")).alias("s")).where("s.number IS NOT NULL").select(F.col("s.number").cast("string").alias("chapter"), text.collapse_space(F.col("s.text")).alias("text"))
    return {"HistoricalChunk": chunks(verses_of(s, work), work, "pd")}


@adapter
def roman_historians(spark: SparkSession, path: str, work: str = "tacitus.annals") -> Tables:
    """TEI with chapter milestones: text from one to the next, notes left out."""
    raw = spark.read.format("binaryFile").load(path).select(markup.decoded("content").alias("x"))
    body = F.regexp_replace(F.regexp_extract("x", "(?s)<body[^>]*>(.*)</body>", 1), "(?s)<note[^>]*>.*?</note>", "")
    m = raw.select(F.explode(markup.milestones(body, '<milestone[^>]*unit="chapter"[^>]*n="([^"]+)"[^>]*/>')).alias("m"))
    n = m.select(F.concat_ws(".", F.lit(work), "m.n").alias("anchor_id"), text.collapse_space(markup.plain_entities(F.regexp_replace("m.text", "<[^>]+>", " "))).alias("text"))
    return {"HistoricalChunk": chunks(n, work, "pd")}


@adapter
def etcbc_dss(spark: SparkSession, path: str) -> Tables:
    """Scroll lines from Text-Fabric: words belong to the line whose span of signs holds their first one."""
    types = textfabric.type_ranges(lines.after_header(lines.lines(spark, f"{path}/otype.tf"), F.trim("line") == ""))
    nodes = types.select("otype", F.explode(F.sequence("lo", "hi")).alias("node"))
    span = feature(spark, path, "oslots", False).select("node", textfabric.slots(F.col("value")).alias("s")).where(F.size("s") > 0).select("node", F.array_min("s").alias("lo"), F.array_max("s").alias("hi"))
    of = lambda kind: nodes.where(F.col("otype") == kind).select("node").join(span, "node")
    words = of("word").select(F.col("node").alias("word"), F.col("lo").alias("sign"))
    placed = ordered.contained(words, of("line").select(F.col("node").alias("line"), "lo", "hi"), "sign", "lo", "hi", 32)
    get = lambda name, alias: feature(spark, path, name, False).select(F.col("node").alias(alias), F.col("value").alias(name))
    w = placed.join(get("fulle", "word"), "word", "left").join(get("after", "word"), "word", "left").select("line", "word", F.coalesce("fulle", F.lit("")).alias("fulle"), "after")
    whole = ordered.joined_text(w, ["line"], "word", "fulle", "after").select("line", text.nfc("text").alias("text")).where("text IS NOT NULL")
    lang = ordered.majority(placed.join(get("lang", "word"), "word").select("line", "lang"), ["line"], "lang")
    d = whole.join(get("scroll", "line"), "line").join(get("fragment", "line"), "line").join(get("label", "line"), "line").join(lang, "line", "left")
    digits = F.col("fragment").rlike("^\\d+$")
    frag = F.regexp_replace(F.translate(F.regexp_replace("fragment", "^[fF]", ""), "+-", "pm"), "[^0-9A-Za-z]", "")
    part = F.when(digits, F.concat(F.lit("col"), ordered.padded(F.col("fragment").try_cast("int")))).when(frag != "", F.concat(F.lit("f"), frag))
    line = F.when(F.col("label").rlike("^\\d+$"), F.concat(F.lit("line"), ordered.padded(F.col("label").try_cast("int"))))
    anchor = F.when(part.isNotNull() & line.isNotNull(), F.concat_ws(".", text.slugify(F.col("scroll")), part, line))
    out = d.select(anchor.alias("anchor_id"), "text", F.when(F.col("lang") == "Aramaic", "arc").when(F.col("lang") == "Greek", "grc").otherwise("hbo").alias("language"), "line").where("anchor_id IS NOT NULL")
    out = ordered.first_wins(out, ["anchor_id"], ["line"])
    return {"HistoricalChunk": out.select(F.col("anchor_id").alias("chunk_id"), "anchor_id", F.lit("dss").alias("work_id"), "text", "language", F.lit("cc-by-nc-4.0").alias("license"), F.lit(False).alias("redistribute"))}


def creed(page: DataFrame, phrases: list[str], least: int = 200, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(``keep``, text, _violations) of pages that must be a creed's: no disambiguation page, a phrase of it, long enough."""
    from quillgraph import schemas

    t = page.select(*keep, markup.main_content("html")["text"].alias("text"))
    some = F.lit(False)
    for p in phrases:
        some = some | F.contains(F.lower("text"), F.lit(p.lower()))
    return schemas.validated(t, [("disambiguation", ~F.contains(F.lower("text"), F.lit("may refer to"))), ("phrase", some), ("length", F.length("text") >= least)])
