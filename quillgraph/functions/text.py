"""Text functions as Column expressions; Python only where Spark has no builtin (Unicode normal forms, nesting)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.udf import lazy_udf

#: Unicode white space for Java's regex engine, as Python's ``str.split`` sees it.
SPACE = "(?U)\\s"


def words(c: Column) -> Column:
    """Words between Unicode white space; none for null or blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def slugify(c: Column) -> Column:
    """Lower-case runs of letters and digits joined by hyphens; ``unknown`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def null_if_blank(c: Column, *sentinels: str) -> Column:
    """Trimmed text; null where it is blank or one of the sentinels."""
    t = F.trim(c)
    return F.when((t != "") & ~t.isin(*sentinels) if sentinels else t != "", t)


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*(null_if_blank(c) for c in cs))


def semicolon_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def alternatives(c: Column) -> Column:
    """Parts between the first kind of separator present: `` OR ``, else `` / ``; else the whole."""
    return F.when(F.contains(c, F.lit(" OR ")), F.split(c, " OR ")).when(F.contains(c, F.lit(" / ")), F.split(c, " / ")).otherwise(F.array(c))


def first_sentence(c: Column) -> Column:
    return F.substring_index(c, ". ", 1)


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("..."))).otherwise(c)


def snippet(c: Column, source_words: Column, cap: int = 100, share: int = 100) -> Column:
    """The first words that a snippet may have: ``cap``, or one in ``share`` of the source's if that is known."""
    n = F.when(source_words > 0, F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(source_words / share).cast("int")))).otherwise(F.lit(cap))
    return F.array_join(F.slice(words(c), F.lit(1), n), " ")


def paraphrase(c: Column, cap: int = 30) -> Column:
    w = words(c)
    return F.when(F.size(w) > cap, F.concat(F.array_join(F.slice(w, 1, cap), " "), F.lit(" ..."))).otherwise(F.array_join(w, " "))


#: Words that never count when texts are matched by keyword.
STOPWORDS = "a an and are as at be by for from has have he in is it its of on or our she that the their them they this to was we were which who will with".split()


def keywords(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case runs of a-z and 0-9 of three or more characters that aren't stop words."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(runs, lambda t: (F.length(t) > 2) & ~t.isin(*stopwords))


def distinct_join(cs: list[Column], sep: str = " ") -> Column:
    """Parts that aren't blank, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(F.array(*cs), lambda x: x.isNotNull() & (F.trim(x) != ""))), sep)


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Regex replacements one after another, in the given order."""
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern, by)
    return c


def without_span(c: Column, pattern: str) -> Column:
    """struct(text_to_embed, ok): the text without a contested span; not ok if nothing was taken out."""
    out = collapse_space(F.regexp_replace(c, pattern, " "))
    return F.struct(out.alias("text_to_embed"), (out != collapse_space(c)).alias("ok"))


@lazy_udf("string")
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, trimmed; blank becomes null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip() or None)


@lazy_udf("string")
def without_accents(s: pd.Series) -> pd.Series:
    """Without combining marks U+0300 to U+036F, in NFC."""
    def one(x):
        return None if x is None else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if not 0x300 <= ord(c) <= 0x36F))

    return s.map(one)


@lazy_udf("struct<text string, notes array<string>>")
def without_brackets(s: pd.Series) -> pd.DataFrame:
    """Text outside square brackets of any depth, and the outermost bracketed notes."""
    def one(x):
        if x is None:
            return None, None
        out, note, notes, depth = [], [], [], 0
        for c in x:
            if c == "[":
                depth += 1
            if depth:
                note.append(c)
            elif c != "]":
                out.append(c)
            if c == "]" and depth:
                depth -= 1
                if not depth:
                    notes.append("".join(note)[1:-1].strip())
                    note = []
        return " ".join("".join(out).split()), notes

    got = [one(x) for x in s]
    return pd.DataFrame({"text": [a for a, _ in got], "notes": [b for _, b in got]})
