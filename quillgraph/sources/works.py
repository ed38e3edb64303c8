"""Structure of confessional works: a page becomes blocks of text, and one machine cuts them into numbered parts by a rule.

A block is a run of text between block-level tags, with its tag, the classes around it and the anchor names in it. A
``Rule`` says which blocks open a part (a pattern with its number), which belong to the open part, which are left out, and
what chapters look like; works differ in their rule only.

Defined results: a null page has no parts; of equal numbers (in one chapter) the first wins; parts without text are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd

from quillgraph.functions.udf import lazy_udf
from quillgraph.sources import markup

ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ORDINALS = ["first", "second", "third", "fourth", "fifth"]


def numeral(s: str | None) -> int | None:
    """A number in digits, in Roman numerals or as an ordinal."""
    s = (s or "").strip()
    if s.isdigit():
        return int(s)
    if s.lower() in ORDINALS:
        return ORDINALS.index(s.lower()) + 1
    if s and set(s.upper()) <= set(ROMAN):
        v = [ROMAN[c] for c in s.upper()]
        return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))
    return None


@dataclass(frozen=True)
class Block:
    tag: str
    classes: frozenset[str]
    names: tuple[str, ...]
    text: str


def blocks(html: str) -> list[Block]:
    """The page's runs of text in document order; scripts and styles are left out."""
    out: list[Block] = []
    held: list[str] = []
    names: list[str] = []

    def close(tag: str, classes: frozenset[str]) -> None:
        text = " ".join("".join(held).split())
        if text or names:
            out.append(Block(tag, classes, tuple(names), text))
        held.clear()
        names.clear()

    # (node, tag and classes around it); a second visit, marked by None, ends a block
    todo: list[tuple] = [(markup.tree(html), "", frozenset())]
    while todo:
        node, tag, classes = todo.pop()
        if node is None:
            close(tag, classes)
        elif isinstance(node, str):
            held.append(node)
        elif node[0] not in markup._SKIP:
            if node[0] == "br":
                held.append(" ")
                continue
            own = classes | frozenset((node[1].get("class") or "").split())
            if node[1].get("id"):
                own |= {f"#{node[1]['id']}"}
            if node[0] == "a" and node[1].get("name"):
                names.append(node[1]["name"])
            if node[0] in markup._BREAK:
                close(tag, classes)
                todo.append((None, node[0], own))
                inside = node[0]
            else:
                inside = tag
            todo += [(c, inside, own) for c in reversed(node[2])]
    close("", frozenset())
    return out


@dataclass(frozen=True)
class Rule:
    """``opens``: pattern with group ``n`` and perhaps ``title`` and ``text``; ``chapter``: pattern with ``n`` and perhaps ``title``."""

    opens: str
    tags: tuple[str, ...] = ()  # blocks that may open a part; none given: any
    body: tuple[str, ...] = ("p",)
    within: str | None = None  # a class (or #id) that blocks must be in, where the page has it
    mark: str | None = None  # a class that opening blocks must have
    skip: str | None = None
    chapter: str | None = None
    heading: str | None = None  # pattern of a heading whose ``title`` is the page's
    lead: bool = False  # text after the opening pattern is text of the part
    drop: str | None = None
    least: int = 1
    span: tuple[int, int] = (1, 10**9)


def cut(found: list[Block], rule: Rule) -> list[dict]:
    """Parts (chapter, number, title, text) of a page's blocks."""
    opens, skip = re.compile(rule.opens, re.S), re.compile(rule.skip) if rule.skip else None
    chapters, heading = re.compile(rule.chapter, re.S | re.I) if rule.chapter else None, re.compile(rule.heading, re.S) if rule.heading else None
    if rule.within and any(rule.within in b.classes for b in found):
        found = [b for b in found if rule.within in b.classes]
    out: dict[tuple, dict] = {}
    chapter, title, now = None, None, None
    for b in found:
        if heading and b.tag[:1] == "h" and (m := heading.search(b.text)):
            title = m["title"].strip().rstrip(".")
            continue
        said = " ".join([*b.names, b.text])
        if chapters and (m := chapters.search(said)):
            chapter, now = numeral(m["n"]), None
            title = (m.groupdict().get("title") or "").strip() or None
            continue
        m = opens.match(b.text) if (not rule.tags or b.tag in rule.tags) and (not rule.mark or rule.mark in b.classes) else None
        n = numeral(m["n"]) if m else None
        if n is not None and rule.span[0] <= n <= rule.span[1]:
            parts = m.groupdict()
            first = (chapter, n) not in out
            now = {"chapter": chapter, "number": n, "title": (parts.get("title") or "").strip().rstrip(":").strip() or title, "text": []}
            if first:
                out[chapter, n] = now
            if rule.lead or parts.get("text"):
                now["text"].append((parts.get("text") or b.text[m.end() :]).strip())
        elif now is not None and b.tag in rule.body and not (rule.mark and rule.mark in b.classes) and not (skip and skip.search(b.text)):
            now["text"].append(b.text)
    done = []
    for part in out.values():
        text = " ".join(t for t in part["text"] if t)
        text = " ".join(re.sub(rule.drop, "", text).split()) if rule.drop else text
        if len(text) >= rule.least:
            done.append(part | {"text": text})
    return done


#: A paragraph of proof texts: a note's number, then a reference.
_PROOFS = r"^\s*\d+\s+[A-Z]"

#: The rules of the works' pages.
RULES = {
    "wcf": Rule(r"\s*(?P<n>\d+)\.\s+", tags=("p",), lead=True, chapter=r"Chapter_(?P<n>\d+)\s+(?:CHAPTER\s+[IVXLCDM\d]+\s*)?(?P<title>.*)"),
    "wlc_catechism": Rule(r"Q\.\s*(?P<n>\d+)\.\s*(?P<title>.+?)\s*A\.\s*(?P<text>.+)$", tags=("p",), body=()),
    "heidelberg": Rule(r"Q\s*&\s*A\s*(?P<n>\d+)\b", skip=_PROOFS),
    "belgic": Rule(r"Article\s+(?P<n>\d+):?\s*(?P<title>.{0,120})", tags=("", "div", "h1", "h2", "h3", "h4", "h5", "body", "article", "section", "main"), skip=_PROOFS),
    "dort": Rule(
        r"Article\s+(?P<n>\d+):?\s*(?P<title>.{0,120})", tags=("", "div", "h1", "h2", "h3", "h4", "h5", "body", "article", "section", "main"), skip=_PROOFS,
        chapter=r"^\s*(?:The\s+)?(?P<n>First|Second|Third|Fourth|Fifth)\s+(?:Main\s+Point\s+of\s+Doctrine|and\s+Fourth\s+Main\s+Points)",
    ),
    "lbc_1689": Rule(r"(?P<n>\d+)\.\s+", tags=("p",), mark="close", body=(), lead=True, heading=r"\.\s*(?P<title>.+)$", drop=r"\(\s*[a-z]\s*\)"),
    "articles_39": Rule(r"(?P<n>[IVX]+)\.\s+(?P<title>.+?)\.?$", tags=("div",), mark="wst-center", within="mw-parser-output", span=(1, 39)),
    "ag": Rule(r"(?P<n>\d+)\.\s+(?P<title>.+)", mark="accordion", span=(1, 16), body=("p", "div")),
    "umc": Rule(r"Article\s+(?P<n>[IVXLCDM]+)\s*[-–—]+\s*(?P<title>.+)", tags=("h4",), span=(1, 25)),
    "schleitheim": Rule(r"(?P<n>[IV]+)\.\s+(?=[A-Z])", lead=True, body=("p", "div", "body", "li", "td"), least=80, span=(1, 7)),
    "bcp_1662": Rule(r"\s*(?P<n>\d+)\.\s+", tags=("p",), lead=True),
    "augsburg": Rule(r"Article\s+(?P<n>[IVXLCDM]+|\d+)[.:]?\s*(?P<title>.*)", tags=("h1", "h2", "h3"), skip=r"^.{0,19}$"),
    "vatican_ccc": Rule(r"(?P<n>\d{1,4})\s+(?P<text>.+)$", tags=("p",), body=(), least=20, span=(1, 2865)),
    "vatican_dv": Rule(r"(?P<n>\d{1,3})\.\s+(?P<text>.+)$", tags=("p",), body=(), least=20, span=(1, 200)),
}
RULES["wsc"] = RULES["wlc_catechism"]


def parts(rule: str):
    """Column function: array<struct<chapter, number, title, text>> of an HTML column by a work's rule."""
    chosen = RULES[rule]

    @lazy_udf("array<struct<chapter int, number int, title string, text string>>")
    def column(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else cut(blocks(x), chosen))

    return column


_QUESTION = re.compile(r"Question\.\s*(.*?)\s*(?:Answer\.\s*(.*))?$", re.S)


@lazy_udf("array<struct<chapter int, number int, title string, text string>>")
def catechism(s: pd.Series) -> pd.Series:
    """Questions and answers marked by those words, in one block or in one after another, counted from 1."""

    def one(x):
        out, asked = [], None
        for b in blocks(x) if x is not None else []:
            m = _QUESTION.search(b.text)
            if m and m[2] is None:
                asked = m[1].strip()
                continue
            if m:
                said = (m[1].strip(), m[2].strip())
            elif asked is not None and b.text.startswith("Answer."):
                said = (asked, b.text.removeprefix("Answer.").strip())
                asked = None
            else:
                continue
            out.append({"chapter": None, "number": len(out) + 1, "title": said[0], "text": said[1]})
        return out

    return s.map(one)


@lazy_udf("struct<title string, text string>")
def prose_section(s: pd.Series) -> pd.DataFrame:
    """A prose page as one text: its first second-level heading, and the pieces that paragraph tags open, of eight characters or more."""
    rows = []
    for x in s:
        x = re.sub(r"(?i)<img[^>]*>|&#160;", " ", x or "")
        heading = next((b.text for b in blocks(x) if b.tag == "h2"), "")
        pieces = (" ".join(" ".join(b.text for b in blocks(p)).split()) for p in re.split(r"(?i)<p(?=[\s>])[^>]*>", x))
        rows.append((heading, "\n\n".join(p for p in pieces if len(p) >= 8)))
    return pd.DataFrame(rows, columns=["title", "text"])


#: What paragraphs of page furniture start with or hold. Fixed values.
NAVIGATION = ("next", "previous", "back to", "table of contents")


@lazy_udf("array<string>")
def volume_paragraphs(s: pd.Series) -> pd.Series:
    """Paragraphs of a volume's page: of 60 characters or more, and none that only leads elsewhere."""
    return s.map(lambda x: [b.text for b in blocks(x) if b.tag == "p" and len(b.text) >= 60 and not b.text.lower().startswith(NAVIGATION)] if x is not None else [])


@lazy_udf("struct<title string, text string>")
def article(s: pd.Series) -> pd.DataFrame:
    """An article page's title and paragraphs of 40 characters or more, without footers and sharing bars."""
    rows = []
    for x in s:
        found = blocks(x) if x is not None else []
        kept = [
            b.text for b in found
            if b.tag == "p" and len(b.text) >= 40 and not any("footer" in c.lower() for c in b.classes)
            and not b.text.startswith("Home /") and "All rights reserved" not in b.text and not ("Twitter" in b.text and "Facebook" in b.text)
        ]
        rows.append((next((b.text for b in found if b.tag == "h1"), ""), "\n\n".join(kept)))
    return pd.DataFrame(rows, columns=["title", "text"])
