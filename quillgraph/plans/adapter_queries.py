"""Adapters as round trips: the driver's tables are written in a source's own format, the adapter reads the files, and the
SQL says from the tables what must come out. Results are (kind, key, value): a row for each node and edge.

Files go to the shared folder. A format that is read by lines is written as a folder of part files in order, which the readers
take for one source; a format that is read whole (a document of XML or JSON) is one file, as it is at its publisher.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.refs import BOOKS
from quillgraph.plans import adapters, more_adapters
from quillgraph.plans.registry import query, shared, table


def put(spark: SparkSession, rows: DataFrame, name: str, before: list[str] = (), after: list[str] = (), whole: bool = False, folder: str | None = None) -> str:
    """Write ``rows`` (at, line) as text in the order of ``at``, between fixed lines; gives the path. Part files are ranges of the
    order; with ``whole`` there is one."""
    folder = f"{folder or shared(spark, 'source')}/{name}"
    ends = spark.createDataFrame([(0, k, x) for k, x in enumerate(before)] + [(2, k, x) for k, x in enumerate(after)], "part int, at long, line string")
    every = ends.unionByName(rows.select(F.lit(1).alias("part"), F.col("at").cast("long").alias("at"), "line"))
    order = ["part", "at", "line"]
    dealt = every.coalesce(1) if whole else every.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("line").write.text(folder)
    return f"{folder}/part-*" if whole else folder


#: Positions in one document of a source that is a set of documents.
DOCUMENT = 1 << 14


def documents(spark: SparkSession, rows: DataFrame, name: str, before: str, after: str, step: int = 1) -> str:
    """Write ``rows`` (at, line) as a set of whole documents, one for each ``DOCUMENT`` positions, fewer so that it is whole steps, each between its own ``before`` and
    ``after``; gives the path. A part file of one long document is no document, and XML readers take only its first element."""
    folder = f"{shared(spark, 'source')}/{name}"
    inner = rows.select(F.floor(F.col("at") / (DOCUMENT - DOCUMENT % step)).alias("doc"), F.lit(1).alias("part"), F.col("at").cast("long").alias("at"), "line")
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(x).alias("line")) for k, x in ((0, before), (2, after))))).alias("e")
    every = inner.unionByName(inner.select("doc").distinct().select("doc", ends).select("doc", "e.*"))
    every.repartition("doc").sortWithinPartitions("doc", "part", "at", "line").select("doc", "line").write.partitionBy("doc").text(folder)
    return folder


def renamed(spark: SparkSession, path: str, target: str) -> str:
    """Move the one file that ``path`` stands for to ``target``, as some sources are told by their file's name."""
    jvm = spark.sparkContext._jvm
    p, conf = jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    fs = p.getFileSystem(conf)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(target).getParent())
    fs.rename(fs.globStatus(p)[0].getPath(), jvm.org.apache.hadoop.fs.Path(target))
    return target


def named(spark: SparkSession, folder: str, name: str) -> str:
    """Give the file of each document of ``documents`` the same name; gives the path of all."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(f"{folder}/doc=*/part-*")
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(files):
        fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f.getPath().getParent(), name))
    return f"{folder}/doc=*/{name}"


#: Suppliers in the place of nations, twenty to a region: sources of one file for each, whose number grows with the tables.
NATIONS = "nation AS (SELECT s_suppkey AS n_nationkey, s_name AS n_name, s_suppkey // 20 AS n_regionkey FROM supplier)"


def nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n_nationkey"), F.col("s_name").alias("n_name"), F.floor(F.col("s_suppkey") / 20).alias("n_regionkey"))


def flat(tables: dict[str, DataFrame], **value: tuple[str | Column, str | Column]) -> DataFrame:
    """(kind, key, value) of the named tables; edges are src_id and dst_id."""
    out = None
    for kind, df in tables.items():
        if kind in value or "src_id" in df.columns:
            k, v = value.get(kind, ("src_id", "dst_id"))
            col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
            rows = df.select(F.lit(kind).alias("kind"), col(k).alias("key"), col(v).alias("value"))
            out = rows if out is None else out.unionByName(rows)
    return out


def parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))


def lined(df: DataFrame, *cols: Column | str, sep: str = "\t") -> DataFrame:
    return df.select(F.col("k").alias("at"), F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit("")) if isinstance(c, Column) else F.lit(c) for c in cols)).alias("line"))


def columns(*names: str) -> list[Column]:
    """Columns of ``parts``; made in a query, as there is no session before."""
    return [F.col(c) for c in names]


P = "p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part)"


def code(letter: str, n: Column) -> Column:
    return F.concat(F.lit(letter), n.cast("string"))


@query("adapter_morphgnt", f"""WITH {P}, w AS (SELECT *, {adapters.GREEK_BOOKS}[1 + k % 27] || '.' || size || '.1' AS osis FROM p), a AS (SELECT *, osis || '.' || printf('%02d', row_number() OVER (PARTITION BY osis ORDER BY k)) AS wpos FROM w)
SELECT 'Word' AS kind, 'morphgnt:' || wpos AS key, brand || '/' || type AS value FROM a UNION ALL SELECT 'Verse', osis, string_agg(brand, ' ' ORDER BY k) FROM a GROUP BY osis UNION ALL SELECT 'IN_VERSE', 'morphgnt:' || wpos, 'verse:' || osis FROM a UNION ALL SELECT 'PARSE_OF', 'morphgnt:' || wpos, 'macula:' || wpos FROM a""")
def adapter_morphgnt(spark, sf_dir):
    K, BRAND, TYPE, SIZE = columns("k", "brand", "type", "size")
    bcv = F.concat(F.format_string("%02d", (K % 27 + 1).cast("int")), F.format_string("%02d", SIZE), F.lit("01"))
    t = adapters.morphgnt(spark, put(spark, lined(parts(spark, sf_dir), bcv, "N-", "----NSF-", BRAND, F.lower(BRAND), "norm", TYPE, sep=" "), "61-morphgnt", ["# no line of words"]))
    return flat(t, Word=("id", F.concat_ws("/", "surface", "lemma")), Verse=("osis", "text"))


def brief(spark, sf_dir, read, letter: str) -> DataFrame:
    K, NAME, BRAND, TYPE, SIZE = columns("k", "name", "brand", "type", "size")
    p = parts(spark, sf_dir)
    once = lined(p, code(letter, K), code(letter, K), code("", K), F.when(SIZE % 5 > 0, NAME), F.when(SIZE % 10 > 0, F.upper(NAME)), "N", F.when(SIZE % 7 > 0, TYPE), BRAND)
    again = lined(p.withColumn("k", K), code(letter, K), "x", code(letter, K), F.lit("later"), "y", "z", "w", "v").withColumn("at", F.col("at") + 10**9)
    t = read(spark, put(spark, once.unionByName(again), "brief", ["Some prose about it", "eStrong\tdStrong\tuStrong\tWord\tTr\tMorph\tGloss\tMeaning"]))
    node = next(iter(t.values()))
    word = "hebrew" if letter == "H" else "greek"
    return flat(t, **{next(iter(t)): ("strong_disambig", F.concat_ws("/", node["base_strong"], node[word], F.coalesce(node["english"], F.lit("-"))))})


def brief_sql(letter: str) -> str:
    return f"""WITH {P}, e AS (SELECT '{letter}' || k AS d, printf('{letter}%04d', k) AS b, CASE WHEN size % 5 > 0 THEN name WHEN size % 10 > 0 THEN upper(name) ELSE '{letter}' || k END AS w, CASE WHEN size % 7 > 0 THEN type ELSE '-' END AS g FROM p)
SELECT 'BriefLexEntry' AS kind, d AS key, b || '/' || w || '/' || g AS value FROM e UNION ALL SELECT 'LEX_FOR', d, b FROM e"""


@query("adapter_stepbible_tbesh", brief_sql("H"))
def adapter_stepbible_tbesh(spark, sf_dir):
    return brief(spark, sf_dir, adapters.stepbible_tbesh, "H")


@query("adapter_stepbible_tbesg", brief_sql("G"))
def adapter_stepbible_tbesg(spark, sf_dir):
    return brief(spark, sf_dir, adapters.stepbible_tbesg, "G")


@query("adapter_stepbible_tflsj", f"WITH {P} SELECT 'LsjEntry' AS kind, 'lsj:G' || k AS key, printf('G%04d', k) || '/' || replace(name, 'e', 'e') || '/' || CASE WHEN size % 3 > 0 THEN brand ELSE '-' END AS value FROM p UNION ALL SELECT 'LEX_FOR', 'lsj:G' || k, printf('G%04d', k) FROM p")
def adapter_stepbible_tflsj(spark, sf_dir):
    """Lemmas with an accent on each e, which the unaccented form loses."""
    K, NAME, BRAND, TYPE, SIZE = columns("k", "name", "brand", "type", "size")
    rows = lined(parts(spark, sf_dir), code("G", K), "d", "u", F.replace(NAME, F.lit("e"), F.lit("é")), "t", "N", TYPE, F.when(SIZE % 3 > 0, BRAND))
    t = adapters.stepbible_tflsj(spark, put(spark, rows, "lsj", ["prose", "eStrong\td\tu\tl\tt\tp\te\tx"]))
    return flat(t, LsjEntry=("id", F.concat_ws("/", "strong", "lemma_unaccented", F.coalesce("lsj_definition", F.lit("-")))))


@query("adapter_stepbible_morph_codes", f"WITH {P} SELECT 'MorphCode' AS kind, 'C' || k AS key, CASE size % 3 WHEN 0 THEN name || ';' || brand WHEN 1 THEN type || ' ' || name ELSE type || ' ' || name || ';' || brand END AS value FROM p")
def adapter_stepbible_morph_codes(spark, sf_dir):
    K, NAME, BRAND, TYPE, SIZE = columns("k", "name", "brand", "type", "size")
    p = parts(spark, sf_dir)
    head = p.select((K * 3).alias("at"), F.concat(F.lit("$ C"), K, F.when(SIZE % 3 > 0, F.concat(F.lit("\t"), TYPE)).otherwise("")).alias("line"))
    first = p.select((K * 3 + 1).alias("at"), F.concat(F.lit("  "), NAME).alias("line"))
    second = p.where("size % 3 <> 1").select((K * 3 + 2).alias("at"), F.concat(F.when(SIZE % 3 == 0, "OR ").otherwise("/ "), BRAND).alias("line"))
    t = adapters.stepbible_morph_codes(spark, put(spark, head.unionByName(first).unionByName(second), "codes", ["prose"]))
    return flat(t, MorphCode=("code", F.array_join("expansions", ";")))


@query("adapter_stepbible_tvtms", f"WITH {P}, r AS (SELECT *, 'tvtms:english:' || brand || ':hebrew:B.' || size || ':' || type AS b, row_number() OVER (PARTITION BY brand, size, type ORDER BY k) - 1 AS d FROM p) SELECT 'VersificationRule' AS kind, b || CASE WHEN d = 0 THEN '' ELSE '#' || d END AS key, name AS value FROM r")
def adapter_stepbible_tvtms(spark, sf_dir):
    NAME, BRAND, TYPE, SIZE = columns("name", "brand", "type", "size")
    t = adapters.stepbible_tvtms(spark, put(spark, lined(parts(spark, sf_dir), "english", BRAND, "hebrew", F.concat(F.lit("B."), SIZE), TYPE, NAME), "tvtms", ["# a comment", ""]))
    return flat(t, VersificationRule=("id", "note"))


@query("adapter_openbible", f"""WITH {P}, r AS (SELECT 'Gen.' || size || '.' || (k % 30) AS f, 'Exod.' || (k % 40) || '.1' AS t, k % 11 AS v, k FROM p WHERE k % 13 > 0), m AS (SELECT *, CASE WHEN size_ = 1 THEN 'Lev.9.9' ELSE f END AS fm FROM (SELECT *, CASE WHEN f = 'Gen.1.1' THEN 1 ELSE 0 END AS size_ FROM r))
SELECT 'OPENBIBLE_CROSS_REF' AS kind, 'verse:' || fm AS key, 'verse:' || t || '=' || v AS value FROM m WHERE k % 17 > 0 UNION ALL SELECT 'quarantine', 'bad', t || '=' || v FROM m WHERE k % 17 = 0""")
def adapter_openbible(spark, sf_dir):
    """Ranges count as their first verse; votes that are no number drop the row; one verse is mapped by a rule."""
    K, SIZE = columns("k", "size")
    rows = lined(parts(spark, sf_dir), F.when(K % 17 == 0, "bad").otherwise(F.concat(F.lit("Gen."), SIZE, F.lit("."), K % 30)), F.concat(F.lit("Exod."), K % 40, F.lit(".1-Exod."), K % 40, F.lit(".4")), F.when(K % 13 > 0, (K % 11).cast("string")).otherwise("many"))
    rules = spark.createDataFrame([(1, "Gen.1.1", "Lev.9.9"), (2, "Gen.1.1", "Lev.8.8")], "line_no int, from_ref string, to_ref string")
    t = adapters.openbible(spark, put(spark, rows, "openbible", ["From\tTo\tVotes"]), rules)
    return flat(t, OPENBIBLE_CROSS_REF=("src_id", F.concat_ws("=", "dst_id", F.col("votes").cast("string"))), quarantine=("from_osis", F.concat_ws("=", "to_osis", F.col("votes").cast("string"))))


#: Book keys in their order.
KEYS = [*dict.fromkeys(BOOKS.values())]


@query("adapter_tsk", f"""WITH {P}, r AS (SELECT k, {KEYS}[1 + k % 66] || '.' || size || '.' || (k % 9 + 1) AS f, k % 20 + 1 AS v, size FROM p WHERE k % 19 > 0), x AS (SELECT DISTINCT f, unnest(['John.' || size || '.' || v, 'John.' || size || '.' || (v + 1), 'Ps.3.' || v]) AS t FROM r)
SELECT 'CrossRef' AS kind, 'tsk:' || f || ':' || t AS key, f || '>' || t AS value FROM x UNION ALL SELECT 'CROSS_REF', 'tsk:' || f || ':' || t, 'verse:' || t FROM x""")
def adapter_tsk(spark, sf_dir):
    K, BRAND, SIZE = columns("k", "brand", "size")
    v = K % 20 + 1
    refs = F.concat(F.lit("John."), SIZE, F.lit("."), v, F.lit("-"), v + 1, F.lit(";Ps.3."), v, F.lit(",x"))
    rows = lined(parts(spark, sf_dir), F.when(K % 19 > 0, (K % 66 + 1).cast("string")).otherwise("?"), SIZE, K % 9 + 1, "1", BRAND, refs)
    return flat(adapters.tsk(spark, put(spark, rows, "tsk")), CrossRef=("id", F.concat_ws(">", "from_ref", "to_ref")))


@query("adapter_peshitta", f"WITH {P}, w AS (SELECT *, 'Matt.' || size || '.' || (k % 5) AS r, CASE WHEN k % 4 > 0 THEN k % 7 ELSE row_number() OVER (ORDER BY k) END AS a FROM p), o AS (SELECT r, a, arg_min(name || '/' || CASE WHEN size % 3 = 0 THEN '-' ELSE type END, k) AS v FROM w GROUP BY r, a) SELECT 'SyriacWord' AS kind, 'peshitta:' || r || ':' || a AS key, v AS value FROM o UNION ALL SELECT 'IN_VERSE', 'peshitta:' || r || ':' || a, 'verse:' || r FROM o")
def adapter_peshitta(spark, sf_dir):
    """Words without a place get that of their row; of equal ids the first stays."""
    K, NAME, BRAND, TYPE, SIZE = columns("k", "name", "brand", "type", "size")
    rows = lined(parts(spark, sf_dir), F.concat(F.lit("Matt."), SIZE, F.lit("."), K % 5), F.when(K % 4 > 0, (K % 7).cast("string")), NAME, BRAND, F.when(SIZE % 3 > 0, TYPE), "m")
    t = adapters.peshitta(spark, put(spark, rows, "peshitta", ["verse_ref\ttoken_pos\ttext\tlex\tgloss\tmorph"]))
    return flat(t, SyriacWord=("id", F.concat_ws("/", "text", F.coalesce("gloss", F.lit("-")))))


def tagged_sql(source: str, letter: str) -> str:
    return f"""WITH {P}, w AS (SELECT *, 'Gen.' || size || '.' || (k % 5) AS r, k % 20 AS a FROM p), o AS (SELECT r, a, arg_min(printf('{letter}%04d', k) || '/' || brand, k) AS v, arg_min(printf('{letter}%04d', k), k) AS s FROM w GROUP BY r, a), i AS (SELECT *, '{source}:' || r || '#' || printf('%02d', a) AS id FROM o)
SELECT 'TaggedToken' AS kind, id AS key, v AS value FROM i UNION ALL SELECT 'IN_VERSE', id, 'verse:' || r FROM i UNION ALL SELECT 'INSTANCE_OF', id, s FROM i"""


@query("adapter_stepbible_tagnt", tagged_sql("STEPBible-TAGNT", "G"))
def adapter_stepbible_tagnt(spark, sf_dir):
    K, NAME, BRAND, SIZE = columns("k", "name", "brand", "size")
    ref = F.concat(F.lit("Gen."), SIZE, F.lit("."), K % 5, F.lit("#"), F.format_string("%02d", (K % 20).cast("int")), F.lit("=NKO"))
    t = adapters.stepbible_tagnt(spark, put(spark, lined(parts(spark, sf_dir), ref, BRAND, NAME, F.concat(code("G", K), F.lit("=N-NSF"))), "tagnt", ["Word & Type\tGreek"]))
    return flat(t, TaggedToken=("id", F.concat_ws("/", "strong", "surface")))


@query("adapter_stepbible_tahot", tagged_sql("STEPBible-TAHOT", "H"))
def adapter_stepbible_tahot(spark, sf_dir):
    K, NAME, BRAND, SIZE = columns("k", "name", "brand", "size")
    ref = F.concat(F.lit("Gen."), SIZE, F.lit("."), K % 5, F.lit("#"), F.format_string("%02d", (K % 20).cast("int")), F.lit("=L"))
    strong = F.when(K % 2 == 0, F.concat(F.lit("H9003/{"), code("H", K), F.lit("}"))).otherwise(F.concat(code("H", K), F.lit("_A")))
    t = adapters.stepbible_tahot(spark, put(spark, lined(parts(spark, sf_dir), ref, BRAND, "t", NAME, strong, "HN"), "tahot", ["intro"]))
    return flat(t, TaggedToken=("id", F.concat_ws("/", "strong", "surface")))


@query("adapter_stepbible_ttesv", f"WITH {P}, w AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Gen' ELSE 'John' END || '.' || size || '.' || k AS r, k % 9 + 1 AS a, CASE WHEN k % 2 = 0 THEN 'H' ELSE 'G' END || printf('%04d', k + 1) AS s FROM p WHERE size % 6 > 0) SELECT 'TaggedToken' AS kind, 'ttesv:' || r || '#' || printf('%02d', a) AS key, s AS value FROM w UNION ALL SELECT 'INSTANCE_OF', 'ttesv:' || r || '#' || printf('%02d', a), s FROM w")
def adapter_stepbible_ttesv(spark, sf_dir):
    """A verse's first good tag counts; segments without one give no token."""
    K, SIZE = columns("k", "size")
    tag = F.when(SIZE % 6 > 0, F.concat(K % 9 + 1, F.lit("=<"), K + 1, F.lit("+7>")))
    rows = lined(parts(spark, sf_dir), F.concat(F.when(K % 2 == 0, "$Gen ").otherwise("$John "), SIZE, F.lit(":"), K), "no tag", tag, F.when(SIZE % 6 > 0, "99=<5>"))
    return flat(more_adapters.stepbible_ttesv(spark, put(spark, rows, "ttesv", ["prose"])), TaggedToken=("id", "strong"))


@query("adapter_stepbible_proper_nouns", f"""WITH {P} SELECT 'ProperNoun' AS kind, name || k AS key, type || '/' || printf('H%04d', k) || '/' || CASE WHEN size % 4 > 0 THEN '2' ELSE '-' END AS value FROM p WHERE k % 5 > 0 UNION ALL SELECT 'NAMED_AT', name || k, 'verse:Exod.' || size || '.1' FROM p WHERE k % 5 > 0 AND size % 4 > 0""")
def adapter_stepbible_proper_nouns(spark, sf_dir):
    K, NAME, TYPE, SIZE = columns("k", "name", "type", "size")
    p = parts(spark, sf_dir)
    head = p.select((K * 2).alias("at"), F.concat(F.lit("$=== "), TYPE).alias("line"))
    body = lined(p.withColumn("k", K), F.when(K % 5 > 0, "– Named").otherwise("– Other"), F.concat(NAME, K), F.concat(code("H", K), F.lit("=x")), F.when(SIZE % 4 > 0, F.concat(F.lit("Exod."), SIZE, F.lit(".1; Gen.1.1")))).withColumn("at", F.col("at") * 2 + 1)
    t = more_adapters.stepbible_proper_nouns(spark, put(spark, head.unionByName(body), "nouns", ["prose"]))
    return flat(t, ProperNoun=("proper_name_entry", F.concat_ws("/", "pos", "strong", F.coalesce(F.col("verse_count").cast("string"), F.lit("-")))))


@query("adapter_macula_greek", f"""WITH {P}, w AS (SELECT *, 'macula:n' || k AS id, printf('G%04d', size) AS s FROM p) SELECT 'Word' AS kind, id AS key, s || '/' || CASE WHEN size % 4 > 0 THEN type ELSE '-' END AS value FROM w UNION ALL SELECT 'GreekLemma', 'gk:' || s, min(name) FROM w GROUP BY s UNION ALL SELECT 'INSTANCE_OF', id, 'gk:' || s FROM w
 UNION ALL SELECT 'IN_DOMAIN', id, 'ln:' || size || '=' || (k % 90) FROM w UNION ALL SELECT 'IN_DOMAIN', id, 'ln:33=7' FROM w WHERE k % 2 = 0""")
def adapter_macula_greek(spark, sf_dir):
    K, NAME, TYPE, SIZE = columns("k", "name", "type", "size")
    rows = lined(parts(spark, sf_dir), F.concat(F.lit("n"), K), "r", NAME, NAME, SIZE, "N", F.when(SIZE % 4 > 0, TYPE).otherwise("n/a"), "d", F.concat(SIZE, F.lit("."), K % 90, F.lit("a bad"), F.when(K % 2 == 0, " 33:7").otherwise("")))
    t = adapters.macula_greek(spark, put(spark, rows, "macula", ["xml_id\tref\ttext\tlemma\tstrong\tmorph\tgloss\tdomain\tln"]))
    return flat(t, Word=("id", F.concat_ws("/", "strong", F.coalesce("gloss", F.lit("-")))), GreekLemma=("id", "lemma"), IN_DOMAIN=("src_id", F.concat_ws("=", "dst_id", F.col("subdomain_code").cast("string"))))


def element(tag: str, text: Column | str, **attributes: Column | str) -> Column:
    """An XML element; values are plain names and numbers of the tables."""
    c = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x)
    pairs = [F.concat(F.lit(f" {k}='"), c(v), F.lit("'")) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{tag}"), *pairs, F.lit(">"), c(text), F.lit(f"</{tag}>"))


@query("adapter_macula_hebrew", f"""WITH {P}, w AS (SELECT *, 'macula:' || k AS id, printf('H%04d', size) AS s, CASE WHEN k % 3 > 0 THEN printf('G%04d', k % 40 + 1) END AS g FROM p) SELECT 'MaculaToken' AS kind, id AS key, s || '/' || brand AS value FROM w UNION ALL SELECT 'Lemma', 'hb:' || s, min(name) FROM w GROUP BY s UNION ALL SELECT 'INSTANCE_OF', id, 'hb:' || s FROM w
 UNION ALL SELECT 'BRIDGES_LXX', 'hb:' || s, 'gk:' || g || '=' || arg_min(type, id) FROM w WHERE g IS NOT NULL GROUP BY s, g""")
def adapter_macula_hebrew(spark, sf_dir):
    K, NAME, BRAND, TYPE, SIZE = columns("k", "name", "brand", "type", "size")
    p = parts(spark, sf_dir)
    w = p.select(K.alias("at"), element("w", BRAND, ref="GEN 1:1!1", id=K, lemma=NAME, morph="m", gloss="g", strongnumberx=SIZE, greek=TYPE, greekstrong=F.when(K % 3 > 0, (K % 40 + 1).cast("string")).otherwise("")).alias("line"))
    t = adapters.macula_hebrew(spark, documents(spark, w, "hebrew", "<x>", "</x>"))
    return flat(t, MaculaToken=("id", F.concat_ws("/", "strong", "surface")), Lemma=("id", "lemma"), BRIDGES_LXX=("src_id", F.concat_ws("=", "dst_id", "greek")))


@query("adapter_oshb", f"""WITH {P}, v AS (SELECT *, 'Gen.' || size || '.' || k AS osis FROM p)
SELECT 'Verse' AS kind, osis AS key, 'br' || brand || CASE WHEN k % 4 = 0 THEN ' Q' || k ELSE ' ' || type END AS value FROM v UNION ALL SELECT 'Word', 'oshb:a' || k, printf('H%04d', k + 1) || '/br' || brand FROM v UNION ALL SELECT 'Word', 'oshb:b' || k, 'H0005/' || CASE WHEN k % 4 = 0 THEN 'K' || k ELSE type END FROM v
 UNION ALL SELECT 'Word', 'oshb:q' || k, 'H0006/Q' || k FROM v WHERE k % 4 = 0 UNION ALL SELECT 'IS_QERE_OF', 'oshb:q' || k, 'oshb:b' || k FROM v WHERE k % 4 = 0 UNION ALL SELECT 'Morpheme', 'oshb:a' || k || '.0', 'br' FROM v UNION ALL SELECT 'Morpheme', 'oshb:a' || k || '.1', brand FROM v
 UNION ALL SELECT 'Morpheme', 'oshb:b' || k || '.0', CASE WHEN k % 4 = 0 THEN 'K' || k ELSE type END FROM v UNION ALL SELECT 'Morpheme', 'oshb:q' || k || '.0', 'Q' || k FROM v WHERE k % 4 = 0""")
def adapter_oshb(spark, sf_dir):
    """Verses of two words; the second of one verse in four is written one way and read another."""
    K, BRAND, TYPE, SIZE = columns("k", "brand", "type", "size")
    a = element("w", F.concat(F.lit("br/"), BRAND), id=F.concat(F.lit("a"), K), lemma=F.concat(F.lit("b/"), K + 1), morph="HR")
    read = F.concat(element("w", F.concat(F.lit("K"), K), id=F.concat(F.lit("b"), K), lemma="5", type="x-ketiv"), F.lit("<note><rdg>"), element("w", F.concat(F.lit("Q"), K), id=F.concat(F.lit("q"), K), lemma="6"), F.lit("</rdg></note>"))
    b = F.when(K % 4 == 0, read).otherwise(element("w", TYPE, id=F.concat(F.lit("b"), K), lemma="5"))
    verses = parts(spark, sf_dir).select(K.alias("at"), element("verse", F.concat(a, b), osisID=F.concat(F.lit("Gen."), SIZE, F.lit("."), K)).alias("line"))
    t = adapters.oshb(spark, documents(spark, verses, "oshb", "<osis>", "</osis>"))
    keep = {k: t[k] for k in ("Verse", "Word", "Morpheme", "IS_QERE_OF")}
    return flat(keep, Verse=("osis", "text"), Word=("id", F.concat_ws("/", "strong", "surface")), Morpheme=("id", "form"))


@query("adapter_vulgate_clementine", f"WITH {P} SELECT 'VulgateVerse' AS kind, 'Gen.1.' || k AS key, name || ' et ' || type || '/' || brand || ' [x]' AS value FROM p")
def adapter_vulgate_clementine(spark, sf_dir):
    """Bracketed notes, one inside another, leave the text."""
    K, NAME, BRAND, TYPE = columns("k", "name", "brand", "type")
    said = F.concat(NAME, F.lit(" ["), BRAND, F.lit(" [x]]  et "), TYPE)
    t = adapters.vulgate_clementine(spark, documents(spark, parts(spark, sf_dir).select(K.alias("at"), element("verse", said, osis=F.concat(F.lit("Gen.1."), K), canon="OT").alias("line")), "vulgate", "<x>", "</x>"))
    return flat(t, VulgateVerse=("osis", F.concat_ws("/", "text_latin", F.array_join("transcription_notes", ";"))))


@query("adapter_theographic", f"""WITH {P} SELECT 'Entity' AS kind, 'e' || k AS key, type || '/' || name || '/' || CASE WHEN k % 5 > 0 THEN (size * 10 - 300)::VARCHAR ELSE '-' END AS value FROM p UNION ALL SELECT 'MENTIONS', 'e' || k, 'verse:Gen.' || size || '.1' FROM p
 UNION ALL SELECT 'Period', floor((size * 10 - 300) / 100)::INT::VARCHAR, count(DISTINCT size)::VARCHAR FROM p WHERE k % 5 > 0 GROUP BY 2""")
def adapter_theographic(spark, sf_dir):
    K, NAME, TYPE, SIZE = columns("k", "name", "type", "size")
    verse = F.concat(F.lit("Gen."), SIZE, F.lit(".1"))
    e = F.struct(F.concat(F.lit("e"), K).alias("id"), F.struct(TYPE.alias("entity_type"), NAME.alias("name"), F.array(verse, verse).alias("verses"), F.when(K % 5 > 0, F.concat(SIZE * 10 - 300, F.lit(".5"))).otherwise("unknown").alias("year")).alias("fields"))
    last = parts(spark, sf_dir).agg(F.max("k")).first()[0] or 0
    rows = parts(spark, sf_dir).select(K.alias("at"), F.concat(F.to_json(e), F.when(K < last, ",").otherwise("")).alias("line"))
    t = adapters.theographic(spark, put(spark, rows, "theographic", ["["], ["]"], whole=True))
    return flat(t, Entity=("entity_id", F.concat_ws("/", "label", "display_name", F.coalesce(F.col("year").cast("string"), F.lit("-")))), Period=("century", F.size("verses")))


def fabric(spark, sf_dir, files: dict[str, DataFrame]) -> str:
    folder = shared(spark, "fabric")
    for name, rows in files.items():
        put(spark, rows, f"{name}.tf", ["@node", "@of=the tables", ""], folder=folder)
    return folder


def one(spark, *said: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(said)), "at long, line string")


@query("adapter_bhsa", """WITH n AS (SELECT count(*) AS n FROM part) SELECT 'TFNode' AS kind, 'bhsa:tf:' || i AS key, CASE WHEN i <= 2 * n THEN 'word' ELSE 'phrase' END AS value FROM n, (SELECT unnest(range(1, (SELECT 3 * n + 1 FROM n))) AS i)
 UNION ALL SELECT 'CONTAINS_WORD', 'bhsa:tf:' || (2 * n + p_partkey + 1), 'bhsa:tf:' || (2 * p_partkey + j) FROM n, part, (VALUES (1), (2)) AS t(j)""")
def adapter_bhsa(spark, sf_dir):
    """Two words and a phrase over them for each part; the phrases' slots are bare values after the first."""
    K, = columns("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    n = p.count()
    slots = p.select(K.alias("at"), F.concat(F.when(K == 0, f"{2 * n + 1}\t").otherwise(""), 2 * K + 1, F.lit("-"), 2 * K + 2).alias("line"))
    t = adapters.bhsa(spark, fabric(spark, sf_dir, {"otype": one(spark, f"1-{2 * n}\tword", f"{2 * n + 1}-{3 * n}\tphrase"), "oslots": slots}))
    return flat(t, TFNode=("id", "otype"))


@query("adapter_etcbc_phono", f"WITH {P} SELECT 'phono' AS kind, 'bhsa:tf:' || (k + 10) AS key, CASE WHEN size % 4 > 0 THEN name ELSE '' END AS value FROM p WHERE size % 4 > 0 OR k = 0")
def adapter_etcbc_phono(spark, sf_dir):
    """Values of nodes in a row from 10 on; a blank line is a node without a value, a node that is named has at least an empty one."""
    K, NAME, SIZE = columns("k", "name", "size")
    rows = parts(spark, sf_dir).select(K.alias("at"), F.concat(F.when(K == 0, "10\t").otherwise(""), F.when(SIZE % 4 > 0, NAME).otherwise("")).alias("line"))
    return flat(more_adapters.etcbc_phono(spark, fabric(spark, sf_dir, {"phono": rows})), phono=("id", "phono"))


@query("adapter_etcbc_parallels", f"WITH {P}, r AS (SELECT *, max(CASE WHEN k % 3 = 0 THEN k END) OVER (ORDER BY k) AS s FROM p) SELECT 'PARALLEL_OF' AS kind, 'bhsa:tf:' || s AS key, 'bhsa:tf:' || size || '=' || round(k % 100 / 100.0::DOUBLE, 2) AS value FROM r WHERE k % 7 > 0 UNION ALL SELECT 'quarantine', s::VARCHAR, size::VARCHAR FROM r WHERE k % 7 = 0")
def adapter_etcbc_parallels(spark, sf_dir):
    K, SIZE = columns("k", "size")
    rows = parts(spark, sf_dir).select(K.alias("at"), F.concat_ws("\t", F.when(K % 3 == 0, K.cast("string")), SIZE.cast("string"), F.when(K % 7 > 0, (K % 100).cast("string")).otherwise("high")).alias("line"))
    t = more_adapters.etcbc_parallels(spark, put(spark, rows, "crossref", ["@edge"]))
    return flat(t, PARALLEL_OF=("src_id", F.concat_ws("=", "dst_id", F.round("similarity", 2).cast("string"))), quarantine=("source", "target"))


@query("adapter_coptic_scriptorium", f"""WITH {P}, w AS (SELECT *, 'sahidic.' || lower(type) AS c, row_number() OVER (PARTITION BY type ORDER BY k) - 1 AS a FROM p WHERE k % 4 > 0), i AS (SELECT *, 'coptic-scriptorium:' || c || ':doc:' || a AS id FROM w)
SELECT 'CopticWord' AS kind, id AS key, name || '/' || (size % 2 = 0) || '/' || CASE WHEN size % 3 > 0 THEN brand ELSE '-' END AS value FROM i UNION ALL SELECT 'IN_VERSE', id, 'verse:Mark.1.' || size FROM i""")
def adapter_coptic_scriptorium(spark, sf_dir):
    """A corpus for each type; rows of two columns count for nothing."""
    K, NAME, BRAND, SIZE = columns("k", "name", "brand", "size")
    folder, p = f"{shared(spark, 'coptic')}/corpora", parts(spark, sf_dir)
    for r in p.select("type").distinct().collect():  # a few kinds of parts
        form = F.when(SIZE % 2 == 0, F.concat(F.lit("<"), NAME, F.lit(">"))).otherwise(NAME)
        full = F.concat_ws("\t", form, F.when(SIZE % 3 > 0, BRAND).otherwise(""), F.lit("N"), F.concat(F.lit("Mark.1."), SIZE))
        rows = p.where(F.col("type") == r["type"]).select(K.alias("at"), F.when(K % 4 > 0, full).otherwise(F.concat_ws("\t", NAME, F.lit("two"))).alias("line"))
        renamed(spark, put(spark, rows, "tt", ["# comment"], whole=True), f"{folder}/sahidic.{r['type'].lower()}/doc.tt")
    t = more_adapters.coptic_scriptorium(spark, folder)
    return flat(t, CopticWord=("id", F.concat_ws("/", "norm", F.col("supplement").cast("string"), F.coalesce("lemma", F.lit("-")))))


@query("adapter_open_cbgm_3_john", f"""WITH {P}, u AS (SELECT *, '3John.1.' || (k % 15 + 1) || '/' || k AS unit, 'W' || (size % 6) AS a, CASE WHEN size % 2 = 0 THEN 'P' || (size % 9) ELSE (size * 40) || 'S' END AS b FROM p), w AS (SELECT DISTINCT unnest([a, b]) AS w FROM u)
SELECT 'VariantUnit' AS kind, unit AS key, (k % 15 + 1)::VARCHAR AS value FROM u UNION ALL SELECT 'Reading', unit || '-a', name FROM u UNION ALL SELECT 'Reading', unit || '-b', type FROM u UNION ALL SELECT 'READS_AT', unit || '-' || r, unit FROM u, (VALUES ('a'), ('b')) AS t(r)
 UNION ALL SELECT 'ATTESTED_BY', unit || '-' || CASE w WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'lac' END, w FROM u, w UNION ALL SELECT 'CORRECTOR_OF', w, left(w, length(w) - 1) FROM w WHERE w LIKE '%S'
 UNION ALL SELECT 'Witness', w, CASE WHEN w LIKE 'W%' THEN 9 WHEN w LIKE 'P%' THEN 3 WHEN regexp_extract(w, '[0-9]+')::INT < 100 THEN 9 WHEN regexp_extract(w, '[0-9]+')::INT < 1000 THEN 11 ELSE 12 END::VARCHAR FROM w""")
def adapter_open_cbgm_3_john(spark, sf_dir):
    """A unit for each part, two readings with a witness each; every other witness has a lacuna. Units of another chapter go."""
    K, NAME, TYPE, SIZE = columns("k", "name", "type", "size")
    a, b = F.concat(F.lit("W"), SIZE % 6), F.when(SIZE % 2 == 0, F.concat(F.lit("P"), SIZE % 9)).otherwise(F.concat(SIZE * 40, F.lit("S")))
    app = lambda n: element("app", F.concat(element("rdg", NAME, n="a", wit=a), element("rdg", TYPE, n="b", wit=b)), n=n)
    p = parts(spark, sf_dir)
    rows = p.select(K.alias("at"), app(F.concat(F.lit("B25K1V"), K % 15 + 1, F.lit("U"), K)).alias("line")).unionByName(p.where("k < 3").select(K.alias("at"), app(F.concat(F.lit("B25K2V1U"), K)).alias("line")))
    t = more_adapters.open_cbgm_3_john(spark, documents(spark, rows, "cbgm", "<t>", "</t>"))
    return flat(t, VariantUnit=("id", "v"), Reading=("id", "text"), Witness=("id", "date_century"))


@query("adapter_brethren_parsed", f"WITH {NATIONS}, n AS (SELECT *, 'slug-' || n_nationkey AS s FROM nation) SELECT 'CulturalChunk' AS kind, 'brethren-parsed.parsed.' || s || '.001' AS key, CASE WHEN n_nationkey % 3 > 0 THEN 'Title ' || n_name ELSE s END || '/2024/' || n_name AS value FROM n UNION ALL SELECT 'CulturalChunk', 'brethren-parsed.parsed.' || s || '.003', CASE WHEN n_nationkey % 3 > 0 THEN 'Title ' || n_name ELSE s END || '/2024/region ' || n_regionkey FROM n")
def adapter_brethren_parsed(spark, sf_dir):
    """A document for each nation, and a file that is none; a blank piece keeps its number."""
    piece = lambda c: F.struct(c.alias("content"))
    d = F.struct(F.concat(F.lit("slug-"), "n_nationkey").alias("doc_slug"), F.lit("2024-05").alias("source_mtime"), F.when(F.col("n_nationkey") % 3 > 0, F.struct(F.concat(F.lit("Title "), "n_name").alias("title"))).alias("session_metadata"), F.array(piece(F.concat(F.lit(" "), "n_name", F.lit(" "))), piece(F.lit(" ")), piece(F.concat(F.lit("region "), "n_regionkey"))).alias("chunks"))
    docs = nations(spark, sf_dir).select("n_nationkey", F.to_json(d).alias("line")).unionByName(spark.createDataFrame([(-1, "{oops")], "n_nationkey long, line string"))
    folder = shared(spark, "parsed")
    docs.repartitionByRange("n_nationkey").select("line").write.option("maxRecordsPerFile", 1).text(folder)
    return flat(adapters.brethren_parsed(spark, f"{folder}/part-*"), CulturalChunk=("chunk_id", F.concat_ws("/", "work_title", "date_written", "text")))


@query("adapter_sefaria_mishnah", f"WITH {NATIONS}, c AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ch FROM nation), w AS (SELECT 'mishnah.region_' || n_regionkey || '.' || ch AS a, n_name, n_nationkey FROM c) SELECT 'HistoricalChunk' AS kind, a || '.1' AS key, 'of ' || n_name AS value FROM w UNION ALL SELECT 'HistoricalChunk', a || '.3', n_nationkey::VARCHAR FROM w")
def adapter_sefaria_mishnah(spark, sf_dir):
    """A tractate for each region, a chapter for each of its nations; a blank piece keeps its number."""
    piece = F.array(F.concat(F.lit("of <b>"), "n_name", F.lit("</b>")), F.lit(" "), F.col("n_nationkey").cast("string"))
    r = nations(spark, sf_dir).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", piece.alias("t")))).alias("c"))  # a dimension
    docs = r.select("n_regionkey", F.to_json(F.struct(F.concat(F.lit("Mishnah Region "), "n_regionkey").alias("title"), F.transform("c", lambda x: x["t"]).alias("text"))).alias("line"))
    folder = shared(spark, "mishnah")
    docs.repartitionByRange(docs.count(), "n_regionkey").select("line").write.option("maxRecordsPerFile", 1).text(folder)
    return flat(adapters.sefaria_mishnah(spark, f"{folder}/part-*"), HistoricalChunk=("anchor_id", "text"))


@query("adapter_tei_history", f"WITH {P} SELECT 'HistoricalChunk' AS kind, 'work.' || size || '.' || k AS key, name || ' and ' || type AS value FROM p")
def adapter_tei_history(spark, sf_dir):
    """Divisions by size and key; notes are left out, what follows them stays."""
    K, NAME, TYPE, SIZE = columns("k", "name", "type", "size")
    div = element("div", element("div", F.concat(F.lit("<p>"), NAME, F.lit("<note>no</note> and "), TYPE, F.lit("</p>")), n=K), n=SIZE)
    path = named(spark, documents(spark, parts(spark, sf_dir).select(K.alias("at"), div.alias("line")), "tei", "<TEI>", "</TEI>"), "work.xml")
    return flat(adapters.tei_history(spark, path), HistoricalChunk=("anchor_id", "text"))


@query("adapter_josephus", f"""WITH {P}, s AS (SELECT *, max(CASE WHEN k % 10 = 0 THEN k END) OVER (ORDER BY k) AS ch FROM p) SELECT 'HistoricalChunk' AS kind, 'josephus.ant.18.' || k AS key, 'Ant 18.' || ch || CASE WHEN k % 2 = 0 THEN '.' || size ELSE '' END || ' (Whiston)/' || CASE WHEN k = 63 THEN name || ' was so.' ELSE name || ' [' || brand || '] was so.' END AS value FROM s WHERE k <> 64 UNION ALL SELECT 'quarantine', 'josephus.ant.18.64', ''""")
def adapter_josephus(spark, sf_dir):
    """Sections whose chapter is declared once in ten; one has a disputed clause, one lacks the clause that it should have."""
    K, NAME, BRAND, SIZE = columns("k", "name", "brand", "size")
    marks = F.concat(F.when(K % 10 == 0, element("milestone", "", unit="Whiston_chapter", n=K)).otherwise(""), F.when(K % 2 == 0, element("milestone", "", unit="Whiston_section", n=SIZE)).otherwise(""))
    sec = element("div", F.concat(F.lit("<p>"), marks, NAME, F.lit("<note>x</note> ["), BRAND, F.lit("] was so.</p>")), subtype="section", n=K)
    path = documents(spark, parts(spark, sf_dir).select(K.alias("at"), sec.alias("line")), "josephus", "<TEI><text><body><div><div subtype='book' n='18'>", "</div></div></body></text></TEI>", step=10)  # a file ends with a chapter
    t = adapters.josephus(spark, path, "ant", {"josephus.ant.18.63": ("disputed", r"\[[^\]]*\]"), "josephus.ant.18.64": ("lost", "nothing like it")})
    return flat(t, HistoricalChunk=("anchor_id", F.concat_ws("/", "anchor_alt_citation", "text_to_embed")), quarantine=("chunk_id", F.lit("")))


@query("adapter_philo", f"WITH {P} SELECT 'HistoricalChunk' AS kind, 'philo.de-x.' || (k + 1) AS key, name || ', ' || type || '. end' AS value FROM p")
def adapter_philo(spark, sf_dir):
    """Paragraphs in a row, with numbers out of turn, notes and damaged dashes between."""
    K, NAME, TYPE = columns("k", "name", "type")
    said = F.concat(F.lit("("), F.when(K % 3 == 0, " ").otherwise(""), K + 1, F.lit(") "), NAME, F.lit("--"), TYPE, F.lit(" {note} (#Ge 1:1). end"))
    path = put(spark, parts(spark, sf_dir).select(K.alias("at"), said.alias("line")), "philo", ["<html><body><p>title {**n}"], ["<p>Go to the Tables of Contents (9999) </body></html>"])
    return flat(more_adapters.philo(spark, path, "philo.de-x"), HistoricalChunk=("anchor_id", "text"))


@query("adapter_philo_two_numbers", f"WITH {P} SELECT 'HistoricalChunk' AS kind, 'philo.de-y' || CASE WHEN k % 2 = 0 THEN '-i' ELSE '-7' END || '.' || (k // 2 + 1) AS key, name || ', ' || type || CASE WHEN k % 5 = 0 THEN ' (9.9) more' ELSE '' END AS value FROM p")
def adapter_philo_two_numbers(spark, sf_dir):
    """A treatise cited by book and paragraph: two books in turn, and references in between that are no marks."""
    K, NAME, TYPE = columns("k", "name", "type")
    said = F.concat(F.lit("("), F.when(K % 2 == 0, "1").otherwise("7"), F.lit("."), F.floor(K / 2) + 1, F.lit(") "), NAME, F.lit("--"), TYPE, F.when(K % 5 == 0, " (9.9) more").otherwise(""))
    path = put(spark, parts(spark, sf_dir).select(K.alias("at"), said.alias("line")), "philo2", ["<html><body><p>title"], ["<p>Go to the Tables of Contents </body></html>"])
    return flat(more_adapters.philo(spark, path, "philo.de-y", {1: "-i"}), HistoricalChunk=("anchor_id", "text"))


@query("adapter_pliny_melmoth", f"WITH {P} SELECT 'HistoricalChunk' AS kind, 'pliny.epistulae.10.' || k || '.en' AS key, name || ' ' || type AS value FROM p WHERE k % 3 > 0")
def adapter_pliny_melmoth(spark, sf_dir):
    K, NAME, TYPE = columns("k", "name", "type")
    p = parts(spark, sf_dir)
    head = p.select((K * 3).alias("at"), F.concat(F.lit("### LETTER Ep "), F.when(K % 3 > 0, "10.").otherwise("9."), K).alias("line"))
    body = p.select((K * 3 + 1).alias("at"), NAME.alias("line")).unionByName(p.select((K * 3 + 2).alias("at"), F.concat(F.lit(" "), TYPE).alias("line")))
    return flat(more_adapters.pliny_melmoth(spark, put(spark, head.unionByName(body), "pliny", ["x"])), HistoricalChunk=("chunk_id", "text"))


@query("adapter_pseudepigrapha", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS v FROM nation) SELECT 'HistoricalChunk' AS kind, 'jubilees.' || (n_regionkey + 1) || '.' || v AS key, CASE WHEN v = 1 THEN 'lead ' ELSE '' END || 'text of ' || n_name AS value FROM c UNION ALL SELECT 'HistoricalChunk', 'jubilees.' || (n_regionkey + 1) || '.1b', 'again' FROM c WHERE v = 1")
def adapter_pseudepigrapha(spark, sf_dir):
    """A chapter for each region; what stands before its first verse joins it, a repeated number gets a letter."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("v"))  # a dimension
    verses = F.array_join(F.transform("v", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". text of "), x["n_name"])), " ")
    page = n.select(F.col("n_regionkey").alias("at"), F.concat(F.lit("<h2>Chapter "), F.col("n_regionkey") + 1, F.lit("</h2><p>lead "), verses, F.lit(" 1. again</p>")).alias("line"))
    return flat(more_adapters.pseudepigrapha(spark, put(spark, page, "enoch", whole=True), "jubilees"), HistoricalChunk=("anchor_id", "text"))


@query("adapter_roman_historians", f"WITH {P} SELECT 'HistoricalChunk' AS kind, 'tacitus.annals.15.' || k AS key, name || ' & ' || type AS value FROM p")
def adapter_roman_historians(spark, sf_dir):
    K, NAME, TYPE = columns("k", "name", "type")
    mark = F.concat(F.lit('<milestone unit="chapter" n="'), K, F.lit('"/>'), NAME, F.lit(" &amp;&mdash; <hi>"), TYPE, F.lit("</hi><note>n</note>"))
    path = put(spark, parts(spark, sf_dir).select(K.alias("at"), mark.alias("line")), "tacitus", ["<TEI><body><p>before"], ["</p></body></TEI>"], whole=True)
    return flat(more_adapters.roman_historians(spark, path, "tacitus.annals.15"), HistoricalChunk=("anchor_id", "text"))


@query("adapter_etcbc_dss", f"WITH {P} SELECT 'HistoricalChunk' AS kind, '1q' || size || '.f' || k || 'p.line' || printf('%02d', k % 40) AS key, type || ' ' || brand || '/' || CASE WHEN k % 3 = 0 THEN 'arc' ELSE 'hbo' END AS value FROM p")
def adapter_etcbc_dss(spark, sf_dir):
    """A line of two words for each part: its span of signs holds both."""
    K, BRAND, TYPE, SIZE = columns("k", "brand", "type", "size")
    p = parts(spark, sf_dir)
    n = p.count()
    line, word = lambda x: F.concat(2 * n + 1 + K, F.lit("\t"), x), lambda j, x: F.concat(3 * n + 1 + 2 * K + j, F.lit("\t"), x)
    lines = lambda x: p.select((2 * n + 1 + K).alias("at"), line(x).alias("line"))
    words = lambda a, b: p.select((3 * n + 1 + 2 * K).alias("at"), word(0, a).alias("line")).unionByName(p.select((3 * n + 2 + 2 * K).alias("at"), word(1, b).alias("line")))
    lang = F.when(K % 3 == 0, "Aramaic").otherwise("Hebrew")
    files = {
        "otype": one(spark, f"1-{2 * n}\tsign", f"{2 * n + 1}-{3 * n}\tline", f"{3 * n + 1}-{5 * n}\tword"),
        "oslots": lines(F.concat(2 * K + 1, F.lit("-"), 2 * K + 2)).unionByName(words((2 * K + 1).cast("string"), (2 * K + 2).cast("string"))),
        "fulle": words(TYPE, BRAND), "after": words(F.lit(" "), F.lit("")), "lang": words(lang, lang), "scroll": lines(F.concat(F.lit("1Q"), SIZE)), "fragment": lines(F.concat(F.lit("f"), K, F.lit("+"))), "label": lines((K % 40).cast("string")),
    }
    return flat(more_adapters.etcbc_dss(spark, fabric(spark, sf_dir, files)), HistoricalChunk=("anchor_id", F.concat_ws("/", "text", "language")))


# --- confessional works ----------------------------------------------------------------------------------------------

#: A paragraph of each part, long enough for all works.
SAID = "'Of ' || n_name || ' it is said that this is a paragraph with enough words in it to be kept by every work''s rule'"
def tag(name: str, *inside: Column | str, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), *(x if isinstance(x, Column) else F.lit(x) for x in inside), F.lit(f"</{name}>"))


#: What each work's anchors and texts are in SQL, from (n_regionkey r, place in region v).
EXPECTED = {
    "wcf": ("'WCF.' || (r + 1) || '.' || v", f"{SAID} || ' more'"),
    "wlc_catechism": ("'WLC.Q' || printf('%03d', v)", f"'Q. ' || v || '. Who? A. ' || {SAID}"),
    "wsc": ("'WSC.Q' || printf('%03d', v)", f"'Q. ' || v || '. Who? A. ' || {SAID}"),
    "heidelberg": ("'HC.Q' || printf('%03d', v)", f"'Q. ' || v || '. Who? A. ' || {SAID}"),
    "belgic": ("'Belgic.A' || printf('%02d', v)", SAID),
    "dort": ("'Dort.' || (r + 1) || '.A' || printf('%02d', v)", SAID),
    "lbc_1689": ("'1689.' || (r + 1) || '.' || v", SAID),
    "augsburg": ("'Augsburg.A' || printf('%02d', v)", SAID),
    "articles_39": ("'39A.A' || printf('%02d', v)", SAID),
    "bcp_1662": ("'BCP.Catechism.Q' || printf('%02d', v)", f"'Q. Who? A. ' || {SAID}"),
    "umc": ("'UMC.A' || printf('%02d', v)", SAID),
    "schleitheim": ("'Schleitheim.A' || v", SAID),
    "ag": ("'AG.A' || printf('%02d', v)", SAID),
    "vatican_ccc": ("'CCC.' || v", SAID),
    "vatican_dv": ("'DV.' || v", SAID),
}


def layout(work: str) -> tuple[Column, Column]:
    """How a work's pages open and show a part, as Columns of nations with their place ``v`` in the region."""
    said = F.concat(F.lit("Of "), "n_name", F.lit(" it is said that this is a paragraph with enough words in it to be kept by every work's rule"))
    n, chapter, none = F.col("v").cast("string"), F.col("n_regionkey") + 1, F.lit("")
    roman = F.get(F.array(*map(F.lit, ["0", "I", "II", "III", "IV", "V", "VI", "VII"])), F.col("v").cast("int"))
    ordinal = F.get(F.array(*map(F.lit, ["First", "Second", "Third", "Fourth", "Fifth"])), F.col("n_regionkey"))
    return {
        "wcf": (tag("h3", F.concat(F.lit("<a name='Chapter_"), chapter, F.lit("'></a>CHAPTER "), chapter, F.lit("<br><i>Title</i>"))), F.concat(tag("p", n, ". ", said), tag("p", "more"))),
        "wlc_catechism": (none, tag("p", "Q. ", n, ". <i>Who?</i><br/> A. ", said)),
        "wsc": (none, tag("p", "Q. ", n, ". Who? A. ", said)),
        "heidelberg": (none, F.concat(F.lit("Q &amp; A "), n, tag("p", "Q. Who?"), tag("p", "A. ", said), tag("p", "1 Gen. 1:1"))),
        "belgic": (none, F.concat(tag("h3", "Article ", n, ": Title"), tag("p", said))),
        "dort": (tag("h2", "The ", ordinal, " Main Point of Doctrine"), F.concat(tag("h3", "Article ", n, ": Title"), tag("p", said))),
        "lbc_1689": (tag("h3", "3. Of Things."), tag("p", n, ". ( a ) ", said, attributes=" class='close'")),
        "augsburg": (none, F.concat(tag("h2", "Article ", roman, ": Title"), tag("p", "too short"), tag("p", said))),
        "articles_39": (F.lit("<div class='mw-parser-output'>"), F.concat(tag("div", roman, ". Title.", attributes=" class='wst-center'"), tag("p", said))),
        "bcp_1662": (none, tag("p", "<em>Question.</em> Who? <em>Answer.</em> ", said)),
        "umc": (none, F.concat(tag("h4", "<a name='x'></a>Article ", roman, "&mdash;Title"), tag("p", said))),
        "schleitheim": (none, tag("p", roman, ". ", said)),
        "ag": (none, F.concat(tag("div", n, ". Title", attributes=" class='accordion'"), tag("p", said))),
        "vatican_ccc": (none, tag("p", n, " ", said)),
        "vatican_dv": (none, tag("p", n, ". ", said)),
    }[work]


CHAPTERED = {"wcf", "dort", "lbc_1689"}


def work_sql(work: str) -> str:
    anchor, said = EXPECTED[work]
    base = "SELECT n_name, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS v FROM nation"
    only = "" if work in CHAPTERED else " WHERE r = 0"  # of equal numbers the first page's part stays
    _, tradition, licence, _, _ = adapters.WORKS[work]
    return f"SELECT {anchor} AS anchor_id, '{tradition}' AS tradition, {said} AS text, {licence == 'public_domain'} AS redistribute FROM ({base}){only}"


def work_query(work: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillgraph.operators import ordered

        opening, part = layout(work)
        n = ordered.position(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], "v")
        one = n.select("n_regionkey", "v", opening.alias("opening"), part.alias("part"))
        pages = one.groupBy("n_regionkey", "opening").agg(F.sort_array(F.collect_list(F.struct("v", "part"))).alias("p"))  # a dimension
        pages = pages.select(F.concat(F.lit("http://host/1689/chapter"), F.col("n_regionkey") + 1, F.lit(".html")).alias("url"), F.concat(F.lit("<html><body><div>"), "opening", F.array_join(F.transform("p", lambda x: x["part"]), ""), F.lit("</div></body></html>")).alias("html"))
        return adapters.work_chunks(pages, work).select("anchor_id", "tradition", "text", "redistribute")

    run.__name__ = f"work_{work}"
    run.__doc__ = f"Parts of {work} from pages in its layout: one for each region, a part for each nation."
    return run


for _work in EXPECTED:
    query(f"work_{_work}", work_sql(_work))(work_query(_work))


@query("prayer_book", """WITH s AS (SELECT p_brand || '-' || p_size AS slug, p_size, string_agg('On ' || p_name || ' of ' || p_type, chr(10) || chr(10) ORDER BY p_partkey) AS said FROM part GROUP BY ALL)
SELECT 'BCP.' || slug AS anchor_id, CASE WHEN p_size % 2 = 0 THEN 'Heading ' || p_size ELSE 'named ' || p_size END AS title, CASE WHEN p_size % 2 = 0 THEN 'Heading ' || p_size || chr(10) || chr(10) ELSE '' END || said AS text FROM s
UNION ALL SELECT 'BCP.Catechism.Q' || printf('%02d', row_number() OVER (ORDER BY s_suppkey)), 'Who is ' || s_suppkey || '?', 'Q. Who is ' || s_suppkey || '? A. One of ' || s_nationkey || ', as it is said.' FROM supplier""")
def prayer_book(spark, sf_dir):
    """A section for each brand and size of parts, with or without a heading, and a catechism of the suppliers."""
    p = table(spark, sf_dir, "part").groupBy(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("slug"), "p_size").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("l"))
    said = F.array_join(F.transform("l", lambda x: F.concat(F.lit("<P class=x>On <i>"), x["p_name"], F.lit("</i>&#160;of <IMG src=a.png>"), x["p_type"], F.lit("<p>short"))), "")
    size = F.col("p_size").cast("string")
    html = F.concat(F.lit("<html><body>"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<h2>Heading "), size, F.lit("</h2>"))).otherwise(""), said, F.lit("</body></html>"))
    pages = p.select("slug", F.concat(F.lit("named "), size).alias("title"), F.concat(F.lit("http://h/"), "slug").alias("url"), html.alias("html"))
    s = table(spark, sf_dir, "supplier").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_nationkey"))).alias("l"))
    asked = F.array_join(F.transform("l", lambda x: F.concat(F.lit("<p><em>Question.</em> Who is "), x["s_suppkey"].cast("string"), F.lit("? <em>Answer.</em> One of "), x["s_nationkey"].cast("string"), F.lit(", as it is said."))), "")
    c = s.select(F.lit("catechism").alias("slug"), F.lit("Catechism").alias("title"), F.lit("http://h/c").alias("url"), F.concat(F.lit("<html><body>"), asked, F.lit("</body></html>")).alias("html"))
    return adapters.prayer_book(pages.unionByName(c)).select("anchor_id", "title", "text")


def pages_of(spark, sf_dir) -> DataFrame:
    """A page for each region: long paragraphs of its nations, short ones and links between them."""
    n = table(spark, sf_dir, "nation")
    body = F.concat(F.lit("<p>"), "n_name", F.repeat(F.lit(" word"), 200), F.lit("</p><p>short</p><p>Next chapter: "), F.repeat(F.lit("x"), 80), F.lit("</p>"))
    p = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", body.alias("b")))).alias("p"))  # a dimension
    return p.select("n_regionkey", F.concat(F.lit("<h1>Region "), "n_regionkey", F.lit("</h1>"), F.array_join(F.transform("p", lambda x: x["b"]), "")).alias("html"))


#: Five paragraphs of 201 words: with a target of 533 words, two fit and the third closes the chunk.
PACKED = "SELECT {} || printf('%03d', c) AS anchor_id, words FROM region, (VALUES (1, 402), (2, 402), (3, 201)) AS t(c, words)"


@query("volume_ccel", PACKED.format("'ANF.vol1.c' || r_regionkey || '.'"))
def volume_ccel(spark, sf_dir):
    """Pages of a volume packed into chunks: paragraphs under 60 characters and page furniture are left out."""
    p = pages_of(spark, sf_dir).select(F.lit("anf").alias("work_id"), F.concat(F.lit("c"), "n_regionkey").alias("chapter"), "html")
    return adapters.volume_pages(p, "ANF.vol1").select("anchor_id", "words")


@query("volume_stem_publishing", PACKED.format("'STEM.darby.w' || r_regionkey || '.'").replace("words FROM", "words::BIGINT AS words FROM"))
def volume_stem_publishing(spark, sf_dir):
    p = pages_of(spark, sf_dir).select(F.concat(F.lit("https://host/authors/darby/w"), "n_regionkey", F.lit(".html")).alias("url"), "html")
    index = p.select(F.lit("https://host/authors/darby/index.html").alias("url"), "html").limit(1)
    return adapters.stem_publishing(p.unionByName(index)).select("anchor_id", F.size(F.split("text", "\\s+")).cast("long").alias("words"))


@query("volume_oca_hopko", "SELECT 'OCA.faith.' || r_regionkey AS anchor_id, 'Region ' || r_regionkey AS title, false AS redistribute FROM region")
def volume_oca_hopko(spark, sf_dir):
    p = pages_of(spark, sf_dir).select(F.concat(F.lit("https://root/faith/"), "n_regionkey").alias("url"), "html")
    other = p.select(F.lit("https://elsewhere/faith").alias("url"), "html").limit(1)
    return adapters.oca_hopko(p.unionByName(other), "https://root").select("anchor_id", "title", "redistribute")


@query("creed_pages", f"WITH {NATIONS} SELECT n_nationkey, array_to_string(list_filter([CASE WHEN n_nationkey % 5 = 0 THEN 'disambiguation' END, CASE WHEN n_nationkey % 3 = 0 THEN 'phrase' END, CASE WHEN n_nationkey % 2 = 0 THEN 'length' END], lambda x: x IS NOT NULL), ',') AS violations FROM nation")
def creed_pages(spark, sf_dir):
    """Pages that must be a creed's: what keeps each from being one."""
    k = F.col("n_nationkey")
    page = F.concat(F.lit("<article><p>"), F.when(k % 5 == 0, "It may refer to more. ").otherwise(""), F.when(k % 3 > 0, "We believe in one. ").otherwise(""), F.repeat(F.lit("word "), 10), F.when(k % 2 > 0, F.repeat(F.lit("more "), 60)).otherwise(""), F.lit("</p></article>"))
    n = nations(spark, sf_dir).select("n_nationkey", page.alias("html"))
    return more_adapters.creed(n, ["we believe"], 200, ["n_nationkey"]).select("n_nationkey", F.array_join("_violations", ",").alias("violations"))


@query("store_chunks", "SELECT 'Work' AS kind, 'w' || (p_size % 4) AS key, max_by(CASE WHEN p_size % 2 = 0 THEN 'pd' ELSE 'CC-BY-NC-4.0' END, 'c' || p_partkey) AS value FROM part GROUP BY 2 UNION ALL SELECT 'Chunk', 'c' || p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'shown' END FROM part UNION ALL SELECT 'HAS_CHUNK', 'w' || (p_size % 4), 'c' || p_partkey FROM part")
def store_chunks(spark, sf_dir):
    """Works, chunks and their edges; what may not be shared in bulk shows what is embedded."""
    K, NAME, SIZE = columns("k", "name", "size")
    c = parts(spark, sf_dir).select(F.concat(F.lit("c"), K).alias("chunk_id"), F.concat(F.lit("w"), SIZE % 4).alias("work_id"), NAME.alias("text"), F.lit("shown").alias("text_to_embed"), F.when(SIZE % 2 == 0, "pd").otherwise("CC-BY-NC-4.0").alias("license"))
    return flat(adapters.to_store(c), Work=("work_id", "license"), Chunk=("chunk_id", "text"))
