"""References: book, chapter and verse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Books with one name for people and one for keys, where the two differ; others keep their name. Fixed values.
BOOKS = {
    "Genesis": "Gen", "Exodus": "Exod", "Leviticus": "Lev", "Numbers": "Num", "Deuteronomy": "Deut", "Joshua": "Josh", "Judges": "Judg", "Ruth": "Ruth",
    "1 Samuel": "1Sam", "2 Samuel": "2Sam", "1 Kings": "1Kgs", "2 Kings": "2Kgs", "1 Chronicles": "1Chr", "2 Chronicles": "2Chr", "Ezra": "Ezra", "Nehemiah": "Neh",
    "Esther": "Esth", "Job": "Job", "Psalm": "Ps", "Psalms": "Ps", "Proverbs": "Prov", "Ecclesiastes": "Eccl", "Song of Solomon": "Song", "Isaiah": "Isa",
    "Jeremiah": "Jer", "Lamentations": "Lam", "Ezekiel": "Ezek", "Daniel": "Dan", "Hosea": "Hos", "Joel": "Joel", "Amos": "Amos", "Obadiah": "Obad", "Jonah": "Jonah",
    "Micah": "Mic", "Nahum": "Nah", "Habakkuk": "Hab", "Zephaniah": "Zeph", "Haggai": "Hag", "Zechariah": "Zech", "Malachi": "Mal", "Matthew": "Matt", "Mark": "Mark",
    "Luke": "Luke", "John": "John", "Acts": "Acts", "Romans": "Rom", "1 Corinthians": "1Cor", "2 Corinthians": "2Cor", "Galatians": "Gal", "Ephesians": "Eph",
    "Philippians": "Phil", "Colossians": "Col", "1 Thessalonians": "1Thess", "2 Thessalonians": "2Thess", "1 Timothy": "1Tim", "2 Timothy": "2Tim", "Titus": "Titus",
    "Philemon": "Phlm", "Hebrews": "Heb", "James": "Jas", "1 Peter": "1Pet", "2 Peter": "2Pet", "1 John": "1John", "2 John": "2John", "3 John": "3John", "Jude": "Jude",
    "Revelation": "Rev",
}
REF = "^[1-3]?[A-Za-z]+\\.[0-9]+\\.[0-9]+$"
MOST_SPAN = 1000


def book_key(name: Column) -> Column:
    """The key of a book's name; null if there is no such book."""
    pairs = [F.lit(x) for kv in BOOKS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), name)


def _span(lo: Column, hi: Column, most: int | None = None) -> Column:
    """lo to hi; none where hi is below lo (Spark's own ``sequence`` would count down) or the span is too long."""
    ok = (hi >= lo) if most is None else (hi >= lo) & (hi - lo <= most)
    return F.when(ok, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))


def to_keys(human: Column) -> Column:
    """``John 1:1-3`` as an array of verse keys; empty if the form or the book is unknown. Each part is taken once: what a lambda's body
    holds would be taken again for every use."""
    form = "^\\s*((?:[1-3] )?[A-Za-z ]+?)\\s+(\\d+):(\\d+)(?:-(\\d+))?\\s*$"
    part = lambda k: F.regexp_extract(human, form, k)
    found = F.struct(book_key(part(1)).alias("book"), part(2).alias("chapter"), part(3).try_cast("int").alias("lo"), F.when(part(4) != "", part(4).try_cast("int")).alias("hi"))  # a cast that fails costs more than all else here
    keys = lambda x: F.transform(_span(x["lo"], F.coalesce(x["hi"], x["lo"])), lambda v: F.concat_ws(".", x["book"], x["chapter"], v.cast("string")))
    return F.flatten(F.transform(F.array(found), lambda x: F.when(x["book"].isNotNull(), keys(x)).otherwise(F.array().cast("array<string>"))))


def expand(token: Column) -> Column:
    """``Gen.1.1-3,7`` and the like as an array of struct(book, chapter, verse).

    Pieces between commas are verses or ranges; a bad piece, a range that goes down or one of over 1,000 is left out.
    """
    t = F.trim(token)
    book, chapter, rest = (F.regexp_extract(t, "^([1-3]?[A-Za-z]+)\\.(\\d+)\\.(.+)$", k) for k in (1, 2, 3))

    def verses(piece: Column) -> Column:
        p = F.trim(piece)
        lo = F.regexp_extract(p, "^(\\d+)\\s*(?:-.*)?$", 1).try_cast("int")
        hi = F.when(F.contains(p, F.lit("-")), F.regexp_extract(p, "^\\d+\\s*-\\s*(\\d+)$", 1).try_cast("int")).otherwise(lo)
        return F.coalesce(_span(lo, hi, MOST_SPAN), F.array().cast("array<int>"))

    all_ = F.flatten(F.transform(F.split(rest, ","), verses))
    out = F.transform(all_, lambda v: F.struct(book.alias("book"), chapter.cast("int").alias("chapter"), v.alias("verse")))
    return F.when(book != "", out).otherwise(F.array().cast("array<struct<book:string,chapter:int,verse:int>>"))


def head(ref: Column) -> Column:
    """The first verse of a range."""
    return F.substring_index(ref, "-", 1)


def humanise(ref: Column) -> Column:
    """``John.1.3`` as ``John 1:3``; one and two parts as far as they go."""
    p = F.split(ref, "\\.")
    return F.when(F.size(p) >= 3, F.concat(p[0], F.lit(" "), p[1], F.lit(":"), p[2])).when(F.size(p) == 2, F.concat(p[0], F.lit(" "), p[1])).otherwise(ref)


def parts(ref: Column) -> Column:
    """struct(book, chapter, verse) of a key."""
    p = F.split(ref, "\\.")
    return F.struct(p[0].alias("book"), F.try_element_at(p, F.lit(2)).try_cast("int").alias("chapter"), F.try_element_at(p, F.lit(3)).try_cast("int").alias("verse"))


def is_ref(ref: Column) -> Column:
    return F.coalesce(ref.rlike(REF), F.lit(False))


def in_scope(refs: Column, book: str, chapter: int, lo: int, hi: int) -> Column:
    """Is any of ``refs`` in the given stretch of verses?"""
    def inside(r: Column) -> Column:
        p = parts(r)
        return (p["book"] == book) & (p["chapter"] == chapter) & p["verse"].between(lo, hi)

    return F.exists(refs, inside)
