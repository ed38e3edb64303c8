"""BPE encoding by tree concatenation, and decoding.

A long text is cut into leaves wherever they end, also inside words. A leaf's runs between white space are encoded on
their own; the two that touch its ends are encoded with the place of each id. Leaves are joined pairwise up a tree. The
tokenizer's patterns never match across white space and drop it, so where there is white space at a seam the ids just
follow one another. Elsewhere a join re-encodes a window of text around the seam, and doubles it until its first id is
the one that the left side has there and one of its last ids is one that the right side has there; only the ids between
are replaced. Ids that agree so are those of the whole: a row of BPE tokens is what the merges give if each pair of
neighbours is, and every pair then is one of the left side, the window or the right side. The agreeing ids keep
``margin`` characters from seam and window's end, so that no added token or contraction lies across. Where nothing
agrees, the window ends up as the whole run.

Leaves don't depend on each other, nor do the joins of one level: a task that has several cores (``spark.task.cpus``)
works on them in as many threads, as the library encodes outside of Python's lock.

Ids of runs inside leaves come from the tokenizers library and are kept in a bounded memo. All this
rests on what the tokenizer's file says of white space and words; a file that says otherwise is an error.

Defined results: a null text is the empty text (no ids, decoded ""); texts of any length are encoded whole; repeated
rows give repeated results; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

#: The normalizers that may come before, and the pre-tokenizers, of files under which pieces never match
#: across white space, which is dropped, and letters are lower-cased. Other files are refused.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"add_prefix_space": False, "use_regex": False}
#: Characters that Python's ``str.split`` takes for white space and the tokenizer doesn't.
_NO_SPACE = re.compile("[\x1c-\x1f]")
#: Units end at these in texts that have such characters.
_ASCII_SPACE = " \t\n\r\x0b\x0c"
_TO_SPACE = str.maketrans({c: " " for c in _ASCII_SPACE})
#: A Latin word with ASCII punctuation (no apostrophe) after it: the tokenizer's patterns split it there, and lower-case
#: the word.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Words and punctuation on which a tokenizer shows whether it does.
_PROBES = [("The", ","), ("the", "."), ("Élan", "!?"), ("STRASSE", ";"), ("über", "..."), ("Que", "$$$"), ("Ñandú", ":"), ("zqxv", "%%%"), ("internationally", ".,"), ("ß", "-)"), ("of", "")]
#: Characters that stand for the bytes of Latin-1 letters in byte-level vocabularies: those bytes are all printable there
#: but 0x80 to 0xA0 and 0xAD, which come after the first 33 from U+0100 on.
_SHIFTED = {b: chr(0x100 + 33 + k) for k, b in enumerate([*range(0x7F, 0xA1), 0xAD])}
_BYTES = {i: "".join(_SHIFTED.get(b, chr(b)) for b in chr(i).encode()) for i in range(0xC0, 0x100)}
LEAF_CHARS = 4096
WINDOW_CHARS = 64
#: Units in one generation of a worker's memo: some 35 MB.
MEMO_UNITS = 100_000


def drops_space(path: str) -> bool:
    """Whether a tokenizer's file has the parts under which its ids can be made run by run."""
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    before, cut, model = about.get("normalizer") or {}, about.get("pre_tokenizer") or {}, about.get("model") or {}
    steps, parts = before.get("normalizers") or [], cut.get("pretokenizers") or []
    spaces = [n for n in steps if n["type"] == "Replace"]
    return (
        [n["type"] for n in steps] == _NORMALIZERS and all(n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in spaces)
        and len(parts) == 2 and parts[0] == _SPLIT and parts[1]["type"] == "ByteLevel" and all(parts[1][k] == v for k, v in _BYTE_LEVEL.items())
        and model.get("type") == "BPE" and not model.get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"].isascii() or len(t["content"].split()) != 1 for t in about["added_tokens"])
    )


class UnitEncoder(dict):
    """Memo of units' ids: what it doesn't have, it asks the tokenizers library for.

    Bounded to two generations: ``turn`` makes a full memo the older one, and a unit that the older one has moves on
    without being encoded again. Forms of a word that differ in capitals and in the punctuation after it share the
    word's ids, where the tokenizer is seen to split and lower-case that way.
    """

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; tasks are the parallel part
        from tokenizers import Tokenizer

        if not drops_space(path):
            raise ValueError(f"{path}: not a tokenizer whose pieces end at white space and drop it; its ids can't be joined from runs")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: Further than an added token or a contraction looks.
        self.margin = max([len(t.content) for t in self.tok.get_added_tokens_decoder().values()], default=0) + 3
        self.model, self.memo_units, self.older, self.words = self.tok.model.tokenize, memo_units, {}, {}
        self.splits = all(self._whole(w + p) == self._word(w.lower()) + self._whole(p) for w, p in _PROBES)

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _word(self, low: str) -> list[int]:
        return [t.id for t in self.model(low if low.isascii() else low.translate(_BYTES))]

    def keep(self, ids: list[int]):
        """What a unit's ids are kept as."""
        return ids

    def plus(self, a, b):
        """What is kept for a unit of two others, one after another."""
        return a + b

    def turn(self) -> "UnitEncoder":
        """Between groups of texts: start a new generation if the memo is full."""
        if len(self) > self.memo_units:
            self.older = dict(self)
            self.clear()
        if len(self.words) > self.memo_units:
            self.words.clear()
        return self

    def forget(self) -> None:
        """At a task's end, where the worker's memory is worth more than the units that the next one would find."""
        self.clear()
        self.older = {}
        self.words.clear()

    def __missing__(self, unit: str):
        value = self.older.get(unit)
        if value is None:
            m = _WORD.fullmatch(unit) if self.splits else None
            if m is None:
                value = self.keep(self._whole(unit))
            else:
                word, after = m.groups()
                word, words = word.lower(), self.words
                value = words.get(word)
                if value is None:
                    value = words[word] = self.keep(self._word(word))
                if after:
                    tail = words.get(after)
                    if tail is None:
                        tail = words[after] = self.keep(self._whole(after))
                    value = self.plus(value, tail)
        self[unit] = value
        return value


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def split_units(text: str) -> list[str]:
    """Runs without white space."""
    return [u for u in text.translate(_TO_SPACE).split(" ") if u] if _NO_SPACE.search(text) else text.split()


class _Run:
    """Ids of a stretch of text without white space that touches a seam, and the characters that each covers."""

    __slots__ = ("lo", "hi", "ids", "starts", "ends")

    def __init__(self, lo: int, hi: int, ids: list[int], starts: list[int], ends: list[int]):
        self.lo, self.hi, self.ids, self.starts, self.ends = lo, hi, ids, starts, ends


def _run(text: str, lo: int, hi: int, known: UnitEncoder) -> _Run:
    got = known.tok.encode(text[lo:hi], add_special_tokens=False)
    spans = got.offsets
    return _Run(lo, hi, got.ids, [lo + a for a, _ in spans], [lo + b for _, b in spans])


def _cut(text: str, run: _Run, k: int) -> bool:
    """Whether text may be cut before the run's id ``k``: not inside a character, or what normalisation may compose."""
    c = text[run.starts[k]]
    return run.starts[k] >= run.ends[k - 1] and unicodedata.category(c)[0] != "M" and not "\u1160" <= c <= "\u11ff"


def _seam(text: str, left: _Run, right: _Run, known: UnitEncoder, width: int = WINDOW_CHARS) -> _Run:
    """Join two runs exactly: grow a window of text around the seam until the ids on both sides agree."""
    seam, margin = right.lo, known.margin
    width = max(width, 2 * margin)
    while True:
        i = bisect_right(left.starts, seam - width) - 1
        while i > 0 and not _cut(text, left, i):
            i -= 1
        j = bisect_left(right.starts, seam + width)
        while 0 < j < len(right.ids) and not _cut(text, right, j):
            j += 1
        from_start, to_end = i <= 0, j == 0 or j >= len(right.ids)
        w = _run(text, left.lo if from_start else left.starts[i], right.hi if to_end else right.starts[j], known)
        ok, head = True, i
        if from_start:
            head = 0
        else:
            ok = bool(w.ids) and (w.ids[0], w.starts[0], w.ends[0]) == (left.ids[i], left.starts[i], left.ends[i])
        upto, tail = len(w.ids), len(right.ids)
        if ok and not to_end:
            ok = False
            for k in range(len(w.ids) - 1, 0, -1):
                if w.starts[k] < seam + margin:
                    break
                if w.ends[k] > w.hi - margin or not _cut(text, w, k):
                    continue
                t = bisect_left(right.starts, w.starts[k])
                if 0 < t < j and (w.ids[k], w.starts[k], w.ends[k]) == (right.ids[t], right.starts[t], right.ends[t]) and _cut(text, right, t):
                    ok, upto, tail = True, k, t
                    break
        if ok:
            return _Run(left.lo, right.hi, *(a[:head] + b[:upto] + c[tail:] for a, b, c in ((left.ids, w.ids, right.ids), (left.starts, w.starts, right.starts), (left.ends, w.ends, right.ends))))
        width *= 2


class _Part:
    """A stretch of text: the runs at its two ends where text goes on without white space (one and the same if it has
    none), and what is kept for the runs between."""

    __slots__ = ("head", "inner", "tail")

    def __init__(self, head: _Run | None, inner: list, tail: _Run | None):
        self.head, self.inner, self.tail = head, inner, tail

    def close_left(self, known: UnitEncoder) -> None:
        """Before it is white space or nothing."""
        if self.head is not None and self.head is not self.tail:
            self.inner.insert(0, known.keep(self.head.ids))
        self.head = None

    def close_right(self, known: UnitEncoder) -> None:
        if self.tail is not None and self.tail is not self.head:
            self.inner.append(known.keep(self.tail.ids))
        self.tail = None


def _leaf(text: str, lo: int, hi: int, plain: bool, known: UnitEncoder) -> _Part:
    piece = text[lo:hi]
    units = piece.split() if plain else [u for u in piece.translate(_TO_SPACE).split(" ") if u]
    space = str.isspace if plain else _ASCII_SPACE.__contains__
    head = tail = None
    if units and not space(piece[0]):
        head = _run(text, lo, lo + len(units[0]), known)
    if units and not space(piece[-1]):
        tail = head if head is not None and len(units) == 1 else _run(text, hi - len(units[-1]), hi, known)
    inner = units[1 if head is not None else 0 : len(units) - 1 if tail is not None and tail is not head else None]
    return _Part(head, list(map(known.__getitem__, inner)), tail)


def _join(text: str, left: _Part, right: _Part, known: UnitEncoder) -> _Part:
    a, b = left.tail, right.head
    if a is None or b is None:
        left.close_right(known)
        right.close_left(known)
        left.inner += right.inner
        return _Part(left.head, left.inner, right.tail) if a is None or left.head is not a else _Part(a, right.inner, right.tail)
    run = _seam(text, a, b, known)
    whole_left, whole_right = left.head is a, right.tail is b
    inner = left.inner if whole_left or whole_right else [*left.inner, known.keep(run.ids)]
    inner += right.inner
    return _Part(run if whole_left else left.head, inner, run if whole_right else right.tail)


def tree(text: str, known: UnitEncoder, leaf_chars: int = LEAF_CHARS, threads: int | None = None) -> list:
    """What ``known`` keeps for the ids of the runs of ``text``, by leaves and a tree of joins."""
    if len(text) <= leaf_chars:
        return list(map(known.__getitem__, split_units(text)))
    plain = _NO_SPACE.search(text) is None
    if threads is None:
        threads = task.cpus() if (task := TaskContext.get()) else 1
    pool = ThreadPoolExecutor(threads) if threads > 1 else None
    each = pool.map if pool else map
    try:
        parts = list(each(lambda i: _leaf(text, i, min(i + leaf_chars, len(text)), plain, known), range(0, len(text), leaf_chars)))
        while len(parts) > 1:
            odd = [parts.pop()] if len(parts) % 2 else []
            parts = [*each(lambda a, b: _join(text, a, b, known), parts[::2], parts[1::2]), *odd]
    finally:
        if pool:
            pool.shutdown()
    last = parts[0]
    whole = [known.keep(last.head.ids)] if last.head is not None and last.head is last.tail else None
    if whole is None:
        last.close_left(known)
        last.close_right(known)
    return last.inner if whole is None else whole


def encode(text: str | None, path: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Ids of a whole text, as the tokenizers library gives them without special tokens."""
    known = encoder(path).turn()
    return [i for ids in tree(text or "", known, leaf_chars) for i in ids]


def decode(ids: list[int], path: str) -> str:
    """The text of ids as the tokenizers library decodes them (this vocabulary file has no decoder: token strings
    joined by one space; other files are decoded by the library)."""
    tok = encoder(path).tok
    if tok.decoder is not None:
        return tok.decode(list(ids), skip_special_tokens=False)
    return " ".join(t for t in map(tok.id_to_token, ids) if t is not None)


class _Digests(UnitEncoder):
    """Keeps, of each unit, the decimal text of its ids and its decoded text."""

    def __init__(self, path: str):
        super().__init__(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.decimal, self.token = [str(i) for i in range(size)], [self.tok.id_to_token(i) or "" for i in range(size)]

    def keep(self, ids: list[int]) -> tuple[str, str]:
        return " ".join([self.decimal[i] for i in ids]), " ".join([self.token[i] for i in ids])

    def plus(self, a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
        return f"{a[0]} {b[0]}", f"{a[1]} {b[1]}"


_digesters: dict[str, _Digests] = {}


def _joined(parts: list[str]) -> bytes:
    """Parts with one space between; parts that are empty leave no space."""
    out = " ".join(parts)
    return (out if "  " not in out and out[:1] != " " and out[-1:] != " " else " ".join(p for p in out.split(" ") if p)).encode()


def groups(texts: list[str | None], most_chars: int = 1 << 21) -> Iterator[list[str]]:
    """Consecutive texts, null as "", in groups of bounded size (one text may be larger)."""
    group, held = [], 0
    for t in texts:
        group.append(t or "")
        held += len(t or "")
        if held >= most_chars:
            yield group
            group, held = [], 0
    if group:
        yield group


def _round_trip(path: str, leaf_chars: int):
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _digesters.get(path) or _digesters.setdefault(path, _Digests(path))
        plain = d.tok.decoder is None
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for group in groups(batch.column("text").to_pylist()):
                d.turn()
                for t in group:
                    both = tree(t, d, leaf_chars)
                    said = _joined([x for x, _ in both])
                    decoded = _joined([x for _, x in both]) if plain else decode([int(i) for i in said.split()], path).encode()
                    out.append((said.count(b" ") + 1 if said else 0, sha(said), sha(decoded)))
            new = pa.table(list(zip(*out)) or [[], [], []], schema=schema).to_batches()
            for b in new or []:
                yield pa.RecordBatch.from_arrays([batch.column(0), *b.columns], names=["doc_id", *schema.names])
        d.forget()

    return common.trimmed(run)


def round_trip(docs: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 of each row of ``docs``."""
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _round_trip(tokenizer_path, leaf_chars), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _ids(path: str, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for group in groups(batch.column("text").to_pylist()):
                known = encoder(path).turn()
                ids += [[i for x in tree(t, known, leaf_chars) for i in x] for t in group]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_table(docs: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and its ids, array<int>."""
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_ids(tokenizer_path, leaf_chars), f"doc_id {kind}, ids array<int>")
