"""The training-data operators: brute force, exact round trips, held-out accuracy, and edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import bpe_tree, common, components, langid, line_dedup, lsi_decontam, phrases, repair, simhash_trie, suffix_dedup, token_count, toxicity_mil, warc, weak_quality

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns that clash with names used inside the operators.
CLASH = ("h", "x", "fp", "t", "d", "v", "score", "__t", "__w", "__digest", "c", "keys", "line", "first", "n_words", "item", "cosine")
TEXTS = [
    None, "", "  \n\t ", "Hello, world! It's a test.", "Hello, world! It's a test.", "naïve café — “quotes” <|endoftext|> x\x1cy z", "word " * 9000, "x" * 12_000,
    "one two three\none two three\n\nfour", "A b", "\n".join(f"line number {i} of many" for i in range(300)), "日本語のテキスト 😀 ́e", "a a a a a a", "#*$%&|<> " * 20,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], f"s{k}", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [(None, "no id here", "en", None, 3), (3, TEXTS[3], "en", "s", 1), (3, TEXTS[3], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.lit(1))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, str(r)))


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://b/ c\r\nd", "x"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1 " * 5000), (None, "n", "x"), (2, "http://b/ c\r\nd", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(9)).withColumn("id", F.lit(9))
    got = warc.archive_round_trip(spark, pages, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {(1, "revisit", 2): 1, (2, "response", None): 2, (3, "revisit", 4): 1, (4, "response", None): 1, (5, "response", None): 1, (None, "revisit", 2): 1}
    # the sidecar alone gives every record, and each member stands by itself
    for side in (tmp_path / "w" / "warc").glob("*.idx"):
        data = side.with_suffix("").read_bytes()
        for line in side.read_text().splitlines():
            offset, length, kind, name = line.split("\t")
            r = warc.read_record(data[int(offset) : int(offset) + int(length)])
            assert r["warc-type"] == kind and r["warc-record-id"] == name
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_warc_threshold_and_truncation(spark, tmp_path):
    pages = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abcdef"), (4, "", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(spark, pages, revisit_from=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    raw = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = raw.compress(warc.record("1", "u", random.Random(1).randbytes(10_000), 10_000, b"0" * 20, None)) + raw.flush()
    (tmp_path / "t.gz").write_bytes(data[:-2000])
    with pytest.raises(ValueError, match="truncated"):
        warc.normalise(f"file://{tmp_path}/t.gz", f"file://{tmp_path}/o.gz")


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs, empty, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    cache = str(tmp_path / "cache")
    got = by_id(token_count.token_counts(docs, PIECE_BPE, cache, limit=100).collect())
    for (i, t), r in zip(texts_of(docs), got):
        n = len(sp.encode(t or ""))
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) == (i, len((t or "").encode()), n, n > 100)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in TEXTS} | {"no id here"})  # each distinct text once
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("something new")))
    token_count.token_counts(more, PIECE_BPE, cache).count()
    assert spark.read.parquet(cache).count() == stored + 1  # only the miss was added
    other = token_count.TokenCountCache(spark, WORD_BPE, cache)
    assert other.stored().count() == 0  # another tokenizer's counts aren't taken
    assert token_count.token_counts(empty, PIECE_BPE).count() == 0


# --- 3 and 5 ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_id_files(spark, docs, empty, tok, tmp_path):
    got = repair.id_files(spark, docs, WORD_BPE, f"file://{tmp_path}/ids").orderBy("start").collect()
    start = 0
    for (i, t), r in zip(texts_of(docs), got):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert len(got) == docs.count()
    part = sorted((tmp_path / "ids").glob("*.rp"))[-1]
    reader = repair.Reader(f"file://{part}")
    names, ids, firsts = reader.shard(0)
    ends = [*firsts[1:], len(ids)]
    for k in range(len(names)):  # random access gives the same
        assert (reader.document(0, k) == ids[firsts[k] : ends[k]]).all()
    assert repair.id_files(spark, empty, WORD_BPE).count() == 0


def test_packed_ids_of_random_texts(tok):
    e = repair._Packed(WORD_BPE)
    rng = random.Random(6)
    for alphabet in ("abc DE  \t\n.,'!12éÉß-<|>_ \x1bøÿÀ'stmdrevl\x00\x7f\r\x0b\x0c", "aé\x1c日 ́.'"):
        for _ in range(600):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
            assert np.frombuffer(e.pack(t, 16), dtype="<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_repair_grammar():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(2, 9, 5000), np.tile([3, 4, 5, 6], 700), np.full(1001, 7), np.array([1, 1, 1]), np.array([5]), np.array([], dtype=np.int64)):
        symbols, rules = repair.compress(ids.astype(np.int64), 10, 1, min_count=4)
        size = repair.lengths(rules, 10)
        assert (repair.expand(symbols, rules, size, 10) == ids).all()
        assert not (rules == 1).any()  # the end id is in no rule
    assert len(repair.compress(np.tile([3, 4, 5, 6], 700), 10, 1)[0]) < 1000


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    ids = np.concatenate([np.tile(rng.integers(2, 500, 64), 40), rng.integers(2, 500, 400_000)])  # long repeats, and most slots are shared
    for most in (1 << 16, 900):
        symbols, rules = repair.compress(ids, 500, 1, most_symbols=most)
        assert (repair.expand(symbols, rules, repair.lengths(rules, 500), 500) == ids).all()
        pairs = Counter(zip(symbols[:-1:2].tolist(), symbols[1::2].tolist()))  # every other place: none overlap
        assert len(rules) == most - 500 or max(pairs.values()) < 16


def test_bpe_round_trip(spark, docs, empty, tok):
    for leaf in (64, 4096):
        got = by_id(bpe_tree.round_trip(docs, WORD_BPE, leaf).collect())
        for (i, t), r in zip(texts_of(docs), got):
            ids = tok.encode(t or "", add_special_tokens=False).ids
            back = tok.decode(ids, skip_special_tokens=False)
            assert (r["doc_id"], r["n_tokens"]) == (i, len(ids))
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe_tree.round_trip(empty, WORD_BPE).count() == 0


def test_bpe_trees_of_random_texts(tok):
    rng = random.Random(5)
    alphabet = "abc DE  \t\n.,'!12éÉß-<|>  \x1c\x1f́日😀İΣς"
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 90)))
        want = tok.encode(t, add_special_tokens=False).ids
        for leaf in (1, 3, 7):
            assert bpe_tree.encode(t, WORD_BPE, leaf) == want, repr(t)
        assert bpe_tree.decode(want, WORD_BPE) == tok.decode(want, skip_special_tokens=False)


def test_bpe_joins_inside_long_runs(tok):
    """A run without white space is never encoded whole where windows agree, and its ids are those of the whole."""

    class Seen:
        def __init__(self, of):
            self.of, self.longest = of, 0

        def __getattr__(self, name):
            return getattr(self.of, name)

        def encode(self, text, **how):
            self.longest = max(self.longest, len(text))
            return self.of.encode(text, **how)

    rng = random.Random(8)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin'.,!-s1É", "日本語のテキスト한국é́", "ab'<|endoftext|>"):
        t = "".join(rng.choice(alphabet) for _ in range(30_000)) + "<|endoftext|>" * 50
        e = bpe_tree.UnitEncoder(WORD_BPE)
        e.tok = Seen(e.tok)
        assert [i for ids in bpe_tree.tree(t, e, 500) for i in ids] == tok.encode(t, add_special_tokens=False).ids
        assert e.tok.longest < 4000
    for t in ("x" * 5000, "'" * 3001 + "s", "<|endoftext|>" * 300, "e" + "\u0301\u0323" * 900, "ab" * 2000 + " " + "''s" * 900):
        for leaf in (7, 100, 333):
            assert bpe_tree.encode(t, WORD_BPE, leaf) == tok.encode(t, add_special_tokens=False).ids


def test_bpe_halves_in_threads(tok):
    """A megabyte without white space, its leaves and joins in threads: windows stay small, ids are those of the whole."""
    rng = random.Random(14)
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz'.,") for _ in range(1_000_000))
    windows = []

    class Seen(bpe_tree.UnitEncoder):
        pass

    e, run = Seen(WORD_BPE), bpe_tree._run
    try:
        bpe_tree._run = lambda text, lo, hi, known: windows.append(hi - lo) or run(text, lo, hi, known)
        got = [i for ids in bpe_tree.tree(t, e, 4096, threads=4) for i in ids]
    finally:
        bpe_tree._run = run
    leaves = -(-len(t) // 4096)
    assert got == tok.encode(t, add_special_tokens=False).ids
    assert leaves - 1 <= sum(n < 4096 for n in windows) <= 4 * leaves and max(windows) <= 4096  # a window or a few at each join


def test_bpe_refuses_other_tokenizers(tmp_path):
    import json

    with open(WORD_BPE, encoding="utf-8") as f:
        about = json.load(f)
    about["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    (tmp_path / "keeps_space.json").write_text(json.dumps(about))
    with pytest.raises(ValueError, match="white space"):
        bpe_tree.encode("a b", str(tmp_path / "keeps_space.json"))


def test_shards_have_their_own_alphabet(tmp_path):
    """Symbols take 16 bits though the vocabulary leaves little room, and no frequent pair is left; wide ones where needed."""
    rng = np.random.default_rng(5)
    for used, words, n, width in ((300, 400, 120_000, 2), (60_000, 3_000, 400_000, 4)):
        vocab = 60_010
        phrases = [rng.integers(2, 2 + used, 6) for _ in range(words)]
        ids = np.concatenate([phrases[k] for k in rng.integers(0, words, n // 6)] + [np.arange(2, 2 + used), [1]])
        with open(tmp_path / "f.rp", "wb") as out:
            w = repair.Writer(out, vocab, 1)
            w.shard([7], ids, np.array([0]))
            w.close()
        r = repair.Reader(f"file://{tmp_path}/f.rp")
        s = r.about["shards"][0]
        assert s["symbol_bytes"] == width and (r.shard(0)[1] == ids).all() and (r.document(0, 0) == ids).all()
        symbols = r._arrays(s)[1]
        assert max(Counter(zip(symbols[:-1:2].tolist(), symbols[1::2].tolist())).values()) < 16


def test_bpe_memo_is_bounded(tok):
    e = bpe_tree.UnitEncoder(WORD_BPE, memo_units=50)
    for k in range(400):
        u = f"word{k % 90}x"
        assert e.turn()[u] == tok.encode(u, add_special_tokens=False).ids
        assert len(e) <= 51 and len(e.older) <= 51


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, sf_dir, sample, docs, empty):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = bench.collect()
    planted = []
    for k, b in enumerate(items[:10]):
        w = b["text"].split()
        para = [x.upper() for i, x in enumerate(w) if i % 9 != 4]  # a word in nine left out, capitals changed
        planted += [(90_000 + 2 * k, "Some other words first. " + " ".join(para) + " and after it."), (90_001 + 2 * k, b["text"])]
    more = sample.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in lsi_decontam.leaks(more, bench).collect()}
    exact = {(r["doc_id"], b["item_id"]) for r in more.collect() for b in items if r["text"] and b["text"] in r["text"]}
    assert exact <= got  # every exact copy
    assert {(90_000 + 2 * k, items[k]["item_id"]) for k in range(10)} <= got  # every paraphrase
    assert {d for d, _ in got} == {d for d, _ in exact} | {90_000 + 2 * k for k in range(10)}  # and no clean document
    kept = lsi_decontam.clean(more, bench)
    assert kept.count() == more.count() - len({d for d, _ in got})
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "hello world it's a test"), (3, "hello world it's a test")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in lsi_decontam.leaks(docs, odd).collect()} == {(d, i) for d in (3, 4) for i in (2, 3)}
    assert lsi_decontam.leaks(empty, odd).count() == 0 and lsi_decontam.leaks(docs, odd.limit(0)).count() == 0


def invented(rng, n, size=20_000):
    """``n`` words of a vocabulary with a few common and many rare ones."""
    return [f"w{int(size ** rng.random())}" for _ in range(n)]


def test_decontamination_with_thousands_of_items(spark):
    rng = random.Random(11)
    items = [invented(rng, 38) for _ in range(1800)]
    rows = [(k, " ".join(invented(rng, rng.randrange(0, 200)) + w + invented(rng, 60))) for k, w in enumerate(items)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in lsi_decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(k, k) for k in range(len(items))}


def test_decontamination_of_long_items_among_rare_words(spark):
    """Exact copies of long items, and of short ones in a corpus so large that other words have a large weight."""
    rng = random.Random(12)
    sizes = [20] * 30 + [150] * 10 + [300] * 10 + [500] * 10
    items = [invented(rng, n) for n in sizes]
    rows = [(k, " ".join(invented(rng, 100) + w + invented(rng, 100))) for k, w in enumerate(items)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in lsi_decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(k, k) for k in range(len(items))}
    terms = lsi_decontam.Terms([b"common", *(b"w%d" % k for k in range(8))])
    item, space = terms.numbers("common w1 w2 w3 w4 w5 w6 w7"), np.eye(terms.size)
    cosines = []
    for n in (10**4, 10**7):  # the item's words are as frequent in both; the others aren't in the benchmark
        idf = np.log(np.array([n, 2, *[20] * 8], dtype=float)) + 1
        idf[1:] = np.log([2, *[20] * 8]) + 1
        fitted = lsi_decontam.Space(np.arange(terms.size), idf, space, [(0, item)])
        index = lsi_decontam.Index(terms, idf, [(0, item)], [fitted])
        found = index.candidates([terms.numbers("x y z " * 4 + "common w1 w2 w3 w4 w5 w6 w7 " + "x y z " * 4)], 0.35)
        cosines.append(max(c for _, c in found.get((0, 0), [(0, 0.0)])))
    assert cosines[0] == cosines[1] > 0.9


def brute_leaks(texts, items):
    """(text, item) by the checks alone: longest common subsequence and answer, on the whole of each (short) text."""
    terms = lsi_decontam.Terms(sorted({w for t in items for w in lsi_decontam.words_of(t)}))
    docs, df = [terms.numbers(t) for t in texts], np.zeros(terms.size)
    for d in docs:
        df[sorted(set(d.tolist()))] += 1
    idf = np.log((len(texts) + 1) / (df + 1)) + 1
    out = set()
    for k, t in enumerate(items):
        item = terms.numbers(t)
        answer = lsi_decontam.answer_terms(item, idf)
        for j, d in enumerate(docs):
            held = len(answer & set(d.tolist())) / len(answer) >= lsi_decontam.MIN_ANSWER
            if held and lsi_decontam.common_subsequence(item, d) >= (len(item) if len(item) < lsi_decontam.SHORT else lsi_decontam.MIN_COMMON * len(item)):
                out.add((j, k))
    return out


def test_decontamination_recall(spark):
    """All that brute force accepts in texts of a few hundred words: words put between, replaced, left out, clauses moved."""
    rng = random.Random(21)
    items = [invented(rng, rng.choice([12, 24, 38, 59, 120])) for _ in range(60)]
    filler = lambda: invented(rng, 1, 400)[0]  # noqa: E731  words that items have as well
    forms = {
        "exact": lambda w: w,
        "one between": lambda w: [y for x in w for y in (x, filler())],
        "two between": lambda w: [y for x in w for y in (x, filler(), "new%d" % rng.randrange(10**6))],
        "replaced": lambda w: [x if rng.random() > 0.22 else filler() for x in w],
        "replaced, one between": lambda w: [y for x in w for y in (x if rng.random() > 0.15 else filler(), filler())],
        "left out": lambda w: [x for x in w if rng.random() > 0.2],
        "moved": lambda w: w[len(w) // 5 :] + w[: len(w) // 5],
    }
    texts, form = [], []
    for name, change in forms.items():
        for w in items:
            texts.append(" ".join(invented(rng, 50) + change(w) + invented(rng, 50)))
            form.append(name)
    texts += [" ".join(invented(rng, 300)) for _ in range(200)]
    bench = [" ".join(w) for w in items]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in lsi_decontam.leaks(docs, spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")).collect()}
    want = brute_leaks(texts, bench)
    assert got <= want
    for name in forms:
        mine = {(j, k) for j, k in want if j < len(form) and form[j] == name}
        assert len(mine) >= 25 and len(got & mine) >= 0.95 * len(mine), (name, len(mine), len(got & mine))


def test_clean_judges_each_row(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    schema = "doc_id long, text string, item long"
    rows = [(None, f"so {item} it was", 1), (None, "a clean text of its own", 2), (None, None, 3), (5, f"{item}", 4), (5, "another clean text", 5), (5, "", 6)]
    kept = lsi_decontam.clean(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["item"] for r in kept.collect()) == [2, 3, 5, 6] and kept.columns == ["doc_id", "text", "item"]


def test_blocks_of_items(spark, monkeypatch):
    rng = random.Random(22)
    items = [" ".join(invented(rng, 30)) for _ in range(40)]
    bench = spark.createDataFrame([*enumerate(items), (None, items[0]), (7, items[7])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate(items)], "doc_id long, text string")
    seen = lambda: sorted((r["doc_id"], r["item_id"] is None, r["item_id"] or 0) for r in lsi_decontam.leaks(docs, bench).collect())
    want = sorted([*((k, False, k) for k in range(40)), (0, True, 0), (7, False, 7)])
    assert seen() == want
    monkeypatch.setattr(lsi_decontam, "ITEMS_AT_ONCE", 10)
    assert seen() == want


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(0, 5) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y and x else max(row[j], row[j - 1])
        assert lsi_decontam.common_subsequence(np.array(a, dtype=int), np.array(b, dtype=int)) == row[-1]


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, empty):
    rng = random.Random(0)
    words = ["tree", "river", "stone", "cloud", "green", "walk", "blue", "house", "idle", "moss"]
    said = lambda: " ".join(rng.choice(words) for _ in range(8)) + "."
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        s = [said() for _ in range(rng.randrange(1, 9))]
        if bad:
            s[rng.randrange(len(s))] = f"you {rng.choice(['scumbag', 'moronic'])} {rng.choice(words)}."
        rows.append((k, " ".join(s)))
        labels.append((k, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    y = y.unionByName(spark.createDataFrame([(None, 1), (9999, None)], "doc_id long, toxic int"))
    got = toxicity_mil.classify(d, y).collect()
    truth, text = dict(labels), dict(rows)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    for r in got:
        if r["predicted"] and truth[r["doc_id"]] and r["worst_start"] is not None:
            assert "you " in text[r["doc_id"]][r["worst_start"] : r["worst_end"]]  # the offending sentence
    odd = toxicity_mil.classify(docs, y).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity_mil.classify(empty, y).count() == 0
    flat = toxicity_mil.classify(d, y.limit(0)).select("score").distinct().collect()
    assert len(flat) <= 9 and all(r["score"] < 0.3 for r in flat)  # nothing to learn from


def test_noisy_or_by_hand():
    m = toxicity_mil.Model({"bad": 2.0, "awfu*": 1.5, "awful": 0.5}, -3.0)
    text = "A bad thing. It is awfully awful! Nothing here.\nBad, bad day?"
    logits = [-3 + 2, -3 + 1.5 + 1.5 + 0.5, -3, -3 + 2]
    p = [1 / (1 + np.exp(-z)) for z in logits]
    score, place, worst = m.score([text, None, "  "])
    assert np.isclose(score[0], 1 - np.prod([1 - x for x in p])) and place[0] == 1 and np.isclose(worst[0], p[1])
    assert np.allclose(score[1:], 1 / (1 + np.exp(3)))
    index = {"bad": 0, "awful": 1, "awfu*": 2}
    assert toxicity_mil.bag(text, index) == (1, [1, 3, 1], [0, 1, 2, 2, 0])
    assert toxicity_mil.counted([(text, 1), ("bad", 0)])[0]["bad"] == 2


def test_toxic_word_at_the_end_of_a_long_text(spark):
    """Whole texts are learned from, and a document that counts as toxic has a span."""
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice("tree river stone cloud green walk".split()) for _ in range(n)) + ". "
    rows = [(k, "".join(said(9) for _ in range(1200)) + ("what a scumbag you are." if k % 4 == 0 else "")) for k in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity_mil.classify(d, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id long, toxic int")).collect()
    assert min(len(t) for _, t in rows) > 50_000 and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)
    assert all((r["worst_start"] is not None) == bool(r["predicted"]) for r in got)
    text = dict(rows)
    assert all("scumbag" in text[r["doc_id"]][r["worst_start"] : r["worst_end"]] for r in got if r["predicted"])


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=5):
    lines = sorted((d if d is not None else -1, k, x.strip()) for d, t in rows for k, x in enumerate((t or "").split("\n")) if x.split())
    first, near = {}, {}
    for d, k, x in lines:
        first.setdefault(x, (d, k))
    words = {x: x.split() for x in first}

    def within(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, q in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (p != q))
        return row[-1] <= 1

    long = [x for x in first if len(words[x]) >= least]
    for a in long:
        for b in long:
            if first[b] < first[a] and within(words[a], words[b]):
                near[a] = min(near.get(a, first[b]), first[b])
    return {(d, k, ("exact", *first[x]) if (d, k) != first[x] else ("near", *near[x]) if x in near else ("kept", None, None)) for d, k, x in lines}


def got_lines(df):
    n = lambda x: -1 if x is None else x
    return {(n(r["doc_id"]), r["line_no"], (r["kind"], None if r["kind"] == "kept" else n(r["of_doc_id"]), r["of_line_no"])) for r in df.collect()}


def test_line_duplicates(spark, docs, empty):
    rng = random.Random(4)
    rows = []
    for d in range(60):
        lines = []
        for _ in range(6):
            w = [rng.choice("ab") for _ in range(rng.randrange(0, 9))]
            lines.append(" ".join(w) + rng.choice(["", " ", "\t"]))
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_lines(line_dedup.line_duplicates(df)) == brute_lines(rows)
    small = [(i, t) for i, t in texts_of(docs) if len(t or "") < 10_000]
    assert got_lines(line_dedup.line_duplicates(docs.where("text IS NULL OR length(text) < 10000"))) == brute_lines(small)
    assert line_dedup.line_duplicates(empty).count() == 0
    cut = line_dedup.without_duplicates(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    kept = {r["doc_id"]: r for r in cut.collect()}
    assert kept[8]["text"] == "one two three\n\nfour" and kept[8]["n_chars"] == len(kept[8]["text"]) and kept[0]["text"] is None
    assert kept[10]["text"] == "line number 0 of many"  # the others differ from it by a word


def test_variants_share_a_key_if_and_only_if_near():
    rng = random.Random(9)
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randrange(5, 9))]
        b = list(a)
        kind = rng.randrange(4)
        i = rng.randrange(len(b))
        if kind == 0:
            b[i] = rng.choice("abcd")
        elif kind == 1:
            b.insert(i, rng.choice("abcd"))
        elif kind == 2 and len(b) > 5:
            del b[i]
        else:
            rng.shuffle(b)
        ka, kb = line_dedup.variants(a), line_dedup.variants(b)
        sa, sb = set(zip(ka[0].tolist(), ka[1].tolist())), set(zip(kb[0].tolist(), kb[1].tolist()))
        whole = {v for v, at in sa if at == -1} & {v for v, at in sb if at >= 0} | {v for v, at in sb if at == -1} & {v for v, at in sa if at >= 0}
        tied = bool({x for x in sa & sb if x[1] >= 0} | {(v,) for v in whole}) or a == b
        assert tied == line_dedup.within_one(a, b)
        if line_dedup.within_one(a, b):
            assert set(line_dedup.half_keys(a)) & set(line_dedup.half_keys(b))


def test_line_candidates_without_a_bit_table(spark):
    rng = random.Random(14)
    rows = [(d, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(8))) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_lines(line_dedup.line_duplicates(df, table_words=1)) == brute_lines(rows)  # 64 bits fill up at once


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_language(spark, sample, docs, empty):
    got = {r["doc_id"]: r for r in langid.predict(sample).collect()}
    rows = [(r["doc_id"], r["lang"], r["n_chars"]) for r in sample.collect()]
    held = [(i, lang) for i, lang, n in rows if got[i]["held_out"] and n > 40]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in held) and len(held) > 20
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    odd = {r["doc_id"]: r for r in langid.predict(docs).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[13]["lang_pred"] == "und" and odd[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und") for r in odd.values())
    assert langid.predict(empty).count() == 0
    assert langid.with_language(docs).columns == [*docs.columns, "__lang_pred", "__score", "__bits"]


def test_cross_parsing_is_greedy_longest_match():
    refs = {"a": "the cat sat on the mat and the cat ran", "b": "le chat est sur le tapis et le chien dort"}
    m = langid.Model(refs)
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice("the catsonmdrlpu ") for _ in range(rng.randrange(1, 80)))
        plain = langid._plain(t)
        if not plain:
            continue
        shown = plain + (" " if not t[-1].isalpha() and plain else "")
        rates, _ = m.rates([t])
        for k, lang in enumerate(m.langs):
            at = n = 0
            while at < len(shown):
                size = 1
                while at + size < len(shown) and shown[at : at + size + 1] in refs[lang]:
                    size += 1
                if shown[at] not in refs[lang]:
                    size = 0
                at += max(size, 1)
                n += 1
            # a character that the reference lacks ends a phrase by itself; the count may then be off by the last one
            assert abs(rates[0, k] * len(shown) / m.bits[k] - n) <= 1 + sum(c not in refs[lang] for c in shown)


def test_cross_parsing_counts_are_exact():
    """Phrases, by searching the reference text: a match goes on while it is somewhere in the reference."""
    refs = {"a": "the cat sat on the mat and the cat ran", "b": "".join(map(chr, range(0x4E00, 0x4E00 + 200))) * 2, "c": "le chat est sur le tapis et le chien dort"}
    m = langid.Model(refs)
    assert sorted(m.sparse) == [1]
    rng = random.Random(1)
    texts = ["".join(rng.choice("the catsonmdrlpuxz\u4e00\u4e01\u4e02\u4e05жé ") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    rates, letters = m.rates(texts)
    for t, rate, n_letters in zip(texts, rates, letters):
        shown = "".join(c if c.isalpha() else " " for c in t.lower())
        shown = " ".join(shown.split()) + (" " if shown.strip() and shown.endswith(" ") else "")
        assert n_letters == sum(c.isalpha() for c in t)
        for k, lang in enumerate(m.langs):
            phrases, match = 1, ""
            for c in shown:
                if match + c in refs[lang]:
                    match += c
                else:
                    phrases += 1
                    match = c if c in refs[lang] else ""
            if shown:
                assert round(rate[k] * len(shown) / m.bits[k], 6) == phrases, (t, lang)


def test_languages_with_disjoint_large_alphabets(spark):
    rng = random.Random(7)
    letters = {"one": [chr(0x4E00 + k) for k in range(1500)], "two": [chr(0x6000 + k) for k in range(1500)]}
    rows = [(k, "".join(rng.choice(letters[lang]) for _ in range(120)), lang) for k, lang in enumerate(["one", "two"] * 150)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got)


def test_references_come_from_all_over_the_texts(spark):
    texts = {"x": ["".join(chr(97 + k % 26) * 512 for k in range(j, j + 10)) for j in range(40)]}
    ref = langid.references(texts, chars=10 * 513)["x"]
    assert len(set(ref)) > 8
    long = spark.createDataFrame([(1, "a" * 100_000 + "b" * 100_000 + "c" * 100_000, "x")] * 3, "doc_id long, text string, lang string")
    (got,) = langid.sample(long, F.lit(True))["x"]
    assert set(got) == set("abc ") and len(got) <= 1.1 * langid.REFERENCE_CHARS


def test_languages_of_many_scripts():
    """Rarer scripts are told apart, also one of many letters, and a script that no reference has fits none."""
    rng = random.Random(2)
    alphabets = {"la": "abcdefghijklmnopqrstuvwxyz", "fr": "abcdefghijklmnopqrstuvwxyzéèêàçùôîœï", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω",
                 "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщью", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "ja": "".join(map(chr, range(0x5000, 0x5000 + 400)))}
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(120)] for k, a in alphabets.items()}
    said = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    m = langid.Model({k: said(k, 2000 if k in ("la", "fr") else 300) for k in vocab})
    texts = [(k, said(k, 12)) for k in vocab for _ in range(20)]
    langs, _, bits = m.predict([t for _, t in texts])
    assert langs == [k for k, _ in texts] and bits.max() < 6
    assert m.predict(["".join(map(chr, range(0x10A0, 0x10C0))) * 5])[2][0] > 6  # Georgian


# --- 9 ---------------------------------------------------------------------------------------------------------------


def brute_measures(t):
    space = " \t\n\x0b\x0c\r"
    words = "".join(" " if c in space else c for c in t or "").split(" ")
    words = [w for w in words if w]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, covered = Counter(tri), set()
    for i, g in enumerate(tri):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if x.strip(space)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def brute_em(votes):
    n = len(votes[0])
    (a0, b0, q), a, b = weak_quality.START, [weak_quality.START[0]] * n, [weak_quality.START[1]] * n

    def post(v):
        g, h = q, 1 - q
        for j, x in enumerate(v):
            if x is not None:
                g *= a[j] if x else 1 - a[j]
                h *= b[j] if x else 1 - b[j]
        return g / (g + h)

    k = weak_quality.PRIOR_VOTES
    for _ in range(weak_quality.ITERATIONS):
        p = [post(v) for v in votes]
        new_a = [(sum(x for v, x in zip(votes, p) if v[j] == 1) + k * a0) / (sum(x for v, x in zip(votes, p) if v[j] is not None) + k) for j in range(n)]
        new_b = [(sum(1 - x for v, x in zip(votes, p) if v[j] == 1) + k * b0) / (sum(1 - x for v, x in zip(votes, p) if v[j] is not None) + k) for j in range(n)]
        q, a, b = (sum(p) + 1) / (len(p) + 2), new_a, new_b
    return [post(v) for v in votes]


def test_quality(spark, sample, docs, empty):
    for df in (sample, docs):
        got = by_id(weak_quality.weak_quality(df).collect())
        for (i, t), r in zip(texts_of(df), got):
            m = brute_measures(t)
            assert (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (i, *m)
            assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r["kept"] and r["base_failed"])
    measured = weak_quality.measures(sample, ["doc_id"])
    votes = [tuple(r) for r in measured.orderBy("doc_id").select(*weak_quality.votes()).collect()]
    got = [r["quality"] for r in weak_quality.weak_quality(sample).orderBy("doc_id").collect()]
    assert np.allclose(got, brute_em(votes), atol=2e-6)
    assert weak_quality.weak_quality(empty).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------


def brute_components(values, budget=2):
    lab = list(range(len(values)))

    def find(i):
        while lab[i] != i:
            lab[i] = lab[lab[i]]
            i = lab[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= budget:
                lab[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for t in TEXTS:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert simhash_trie.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, sample, docs, empty):
    for df in (sample, docs):
        rows = df.select("doc_id", "text").collect()
        fp = [simhash_trie.fingerprint(r["text"]) for r in rows]
        of = brute_components(fp)
        least = {}
        for r, c in zip(rows, of):
            if r["doc_id"] is not None:
                least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
        want = Counter((r["doc_id"], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fp, of))
        assert Counter(map(tuple, simhash_trie.near_duplicates(df).collect())) == want
    assert simhash_trie.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("split", [50_000, 4])
def test_trie_join_on_dense_groups(spark, split):
    rng = np.random.default_rng(3)
    values = set()
    for b in rng.integers(0, 2**63, 25):
        for _ in range(30):
            v = int(b)
            for _ in range(rng.integers(0, 4)):
                v ^= 1 << int(rng.integers(0, 64))
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = components.components(simhash_trie.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, split))
    root = {r["node"]: r["root"] for r in found.collect()}
    groups = {}
    for s, c in zip(signed, brute_components(values)):
        groups.setdefault(c, []).append(s)
    for members in groups.values():
        assert {root.get(m, m) for m in members} == {min(members)}


def edited(rng, text, share):
    """``text`` with about ``share`` of its words replaced, left out or doubled."""
    out = []
    for w in text.split():
        kind = rng.random() / share if share else 9
        out += [] if kind < 0.3 else [w, w] if kind < 0.5 else [f"new{rng.randrange(10**6)}"] if kind < 1 else [w]
    return " ".join(out)


def shingle_set(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def test_wide_fingerprints_find_pairs_of_similarity_08(spark, sample):
    rng = random.Random(21)
    texts = [t for r in sample.where("text IS NOT NULL").orderBy("doc_id").collect() if 60 <= len((t := r["text"]).split()) <= 3000][:400]
    pairs = [(t, edited(rng, t, rng.choice([0.005, 0.01, 0.02, 0.03, 0.06]))) for t in texts]
    jaccard = [len(a & b) / len(a | b) for a, b in ((shingle_set(x), shingle_set(y)) for x, y in pairs)]
    rows = [(f"{k}-{side}", t) for k, pair in enumerate(pairs) for side, t in zip("ab", pair)]
    marked = simhash_trie.wide_fingerprints(spark.createDataFrame(rows, "doc_id string, text string"))
    own = {r["doc_id"]: bytes(r["fp"]) for r in marked.collect()}
    found = components.components(simhash_trie.similar_links(marked.groupBy("fp").agg(F.min("bands").alias("bands"))))
    root = {bytes(r["node"]): bytes(r["root"]) for r in found.collect()}
    of = {d: root.get(f, f) for d, f in own.items()}
    tied = [of[f"{k}-a"] == of[f"{k}-b"] for k in range(len(pairs))]
    near = [t for t, j in zip(tied, jaccard) if j >= 0.8]
    assert len(near) >= 50 and sum(near) >= 0.95 * len(near)
    assert not any(t for t, j in zip(tied, jaccard) if j < 0.55) and any(j < 0.55 for j in jaccard)
    # nothing else is tied that is not similar
    shingles = {d: shingle_set(t) for d, t in rows}
    groups = {}
    for d, r in of.items():
        groups.setdefault(r, []).append(d)
    for members in groups.values():
        for d in members[1:]:
            assert any(len(shingles[d] & shingles[e]) / len(shingles[d] | shingles[e]) >= 0.55 for e in members if e != d)


@pytest.mark.parametrize("split", [50_000, 300])
def test_wide_join_on_dense_groups(spark, split):
    rng = np.random.default_rng(5)
    values = set()
    for base in rng.integers(0, 2, (6, 256), dtype=np.uint8):
        for _ in range(150):
            v = base.copy()
            v[rng.choice(256, rng.integers(0, 45), replace=False)] ^= 1
            values.add(np.packbits(v).tobytes())
        for _ in range(20):  # a chain away from the base
            v = v.copy()
            v[rng.choice(256, 30, replace=False)] ^= 1
            values.add(np.packbits(v).tobytes())
    values = sorted(values)
    rows = spark.createDataFrame([(bytearray(v), [7]) for v in values], "fp binary, bands array<long>")
    found = components.components(simhash_trie.similar_links(rows, split_over=split))
    root = {bytes(r["node"]): bytes(r["root"]) for r in found.collect()}
    groups = {}
    for v, c in zip(values, brute_components([int.from_bytes(v, "big") for v in values], simhash_trie.WIDE_BUDGET)):
        groups.setdefault(c, []).append(v)
    assert len(groups) >= 6
    for members in groups.values():
        assert {root.get(m, m) for m in members} == {min(members)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_one_row_of_each_group(spark):
    a, b = "one two three four five six seven eight nine ten", "a wholly different text with other words in it today"
    rows = [(5, a, 1), (3, a, 2), (None, a, 3), (3, b, 4), (3, b, 5), (None, "x y", 6), (None, "x y", 7), (9, None, 8), (None, "", 9), (8, "  ", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item long").withColumn("fp", F.lit(1)).withColumn("least", F.lit(2))
    kept = simhash_trie.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"], r["item"]) for r in kept.collect() if r["doc_id"] is not None)
    assert [d for d, _ in got] == [3, 3, 8] and {i for _, i in got} & {4, 5} and {2, 10} < {i for _, i in got}
    assert len([1 for r in kept.collect() if r["doc_id"] is None]) == 1 and simhash_trie.one_of_each(df.limit(0)).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"  # as before


def test_heavy_keys_join_without_their_partition(spark):
    rows = spark.createDataFrame([(k, 7 if k % 3 else k) for k in range(3000)], "i long, k long")
    values = spark.createDataFrame([(k, f"v{k}") for k in range(0, 3000, 2)] + [(7, "v7")], "k long, v string")
    got = common.spread_join(rows, values, ["k"], values.where("k = 7"), ["i"])
    assert re.search(r"hashpartitioning\(__lh[^)]*, __k0", got._jdf.queryExecution().toString()) or "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert {(r["i"], r["k"], r["v"]) for r in got.collect()} == {(k, j, f"v{j}" if j == 7 or j % 2 == 0 else None) for k in range(3000) for j in [7 if k % 3 else k]}


def test_token_cache_shuffles_no_text_when_warm(spark, docs, tmp_path):
    cache = token_count.TokenCountCache(spark, WORD_BPE, str(tmp_path / "c"))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    for few in (0, 10**6):  # the first as if there were too many misses to broadcast
        token_count.FEW_MISSES, kept = few, token_count.FEW_MISSES
        try:
            more = docs.select("doc_id", F.concat_ws(" ", "text", F.lit(f"and {few}")).alias("text"))
            before = cache.stored().count()
            for df in (docs, more):
                got = by_id(cache.counts(df.select("doc_id", "text"), "text", ["doc_id"]).collect())
                assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts_of(df)]
            after = cache.stored().count()
            assert after > before
            cache.fill(docs.select("text"), "text")
            assert cache.stored().count() == after  # warm: nothing is encoded
        finally:
            token_count.FEW_MISSES = kept


# --- 11 --------------------------------------------------------------------------------------------------------------


def brute_collocations(rows, most=3, least=10, share=50, top=2000):
    """Phrases by plain counting, cut by cut."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inside = {}
    for p, a in found.items():
        w = p[1:]
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                q = (p[0], *w[i : i + k])
                inside[q] = max(inside.get(q, 0), a)
    out = {}
    for p, a in found.items():
        if 100 * inside.get(p, 0) >= share * a:
            continue
        score, _, left, right = min((10**6 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((g, k, p.decode(), -a, x, y, n[g], -s) for g, c in out.items() for k, (s, a, p, x, y) in enumerate(sorted(c)[:top], 1))


def found_collocations(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("most", "least", "share"), [(2, 2, 50), (3, 10, 50), (4, 3, 60), (5, 2, 100)])
def test_phrases_brute_force(spark, docs, empty, monkeypatch, most, least, share):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 5_000)  # many shards, texts in slices
    rng = random.Random(most)
    words = ["of", "Ünter", "THE", "x\x00y", "日本", "a", "b", "the"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "! "]) for _ in range(rng.randint(0, 400))), rng.choice(["en", "de", None])) for _ in range(60)]
    made = spark.createDataFrame(rows * 2, "text string, lang string").repartition(3)
    assert found_collocations(phrases.collocations(made, most, least, share)) == brute_collocations(rows * 2, most, least, share)
    plain = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    assert found_collocations(phrases.collocations(docs, most, least, share, top=3)) == brute_collocations(plain, most, least, share, top=3)
    assert phrases.collocations(empty, most, least).count() == 0


def test_phrases_whole_tables(spark, sample):
    got = found_collocations(phrases.collocations(sample))
    assert got and got == brute_collocations([(r["text"], r["lang"]) for r in sample.select("text", "lang").collect()])


def test_phrase_scores_are_exact(spark):
    big = 3 * 10**12  # products of 86 bits
    rows = [("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, n int, phrase string, f long")).first()
    assert (got["l"], got["r"], got["score"]) == (big, big - 1, 10**6 * (big - 2) ** 2 // (big * (big - 1)))


# --- 12 --------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, width=50):
    """Windows of every text against the least id that has them."""
    last = 2**63 - 1
    raw = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for p in range(len(b) - width + 1):
            first[b[p : p + width]] = min(i, first.get(b[p : p + width], last))
    out = []
    for (i, _), (k, b) in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < k:
                gone[p : p + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int))).reshape(-1, 2).tolist()
        out.append((i, len(b), spans, kept))
    return sorted(out, key=str)


def found_repeats(df):
    return sorted(((r["doc_id"], r["n_bytes"], [[s["start"], s["stop"]] for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=str)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "PART", 1_000)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 300)
    monkeypatch.setattr(suffix_dedup, "HASHES", 50)


def repeated_texts(n=80, seed=3):
    rng = random.Random(seed)
    said = ["".join(rng.choice("abcdefé \n") for _ in range(rng.randint(40, 120))) for _ in range(6)]
    hot = "the same words stand at the head of every single page we have " * 2
    rows = []
    for k in range(n):
        parts = ["".join(rng.choice("abcdefghijk ") for _ in range(rng.randint(0, 200))) for _ in range(3)]
        rows.append((rng.choice([k, k, k // 2, None]), hot * (k % 3 > 0) + parts[0] + rng.choice(said) + parts[1] + rng.choice(said)[rng.randint(0, 30) :] + rng.choice(["", "xy" * 60, "z" * 150]) + parts[2]))
    return rows + rows[:7] + [(200 + i, t) for i, (_, t) in enumerate(rows[:9])] + [(None, None), (5, ""), (6, "short"), (None, "short"), (300, hot * 40), (301, "q" * 4000)]


def test_suffix_dedup_brute_force(spark, docs, empty, small_shards):
    rows = repeated_texts()
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_repeats(suffix_dedup.repeats(made)) == brute_repeats(rows)
    assert found_repeats(suffix_dedup.repeats(made, width=33)) == brute_repeats(rows, 33)
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found_repeats(suffix_dedup.repeats(docs)) == brute_repeats(plain)
    assert suffix_dedup.repeats(empty).count() == 0
    few = spark.createDataFrame([(1, "nothing in common"), (2, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.digests(few).orderBy("doc_id").collect()] == [(1, 0, 0), (2, 0, 0)]


def test_suffix_dedup_straddling_windows(spark, small_shards):
    """One passage is most of the table: its windows fill whole ranges, and are compared across them."""
    rng = random.Random(1)
    rows = [(k, "x" * 300 + "".join(rng.choice("abc") for _ in range(20))) for k in range(120)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    plain = suffix_dedup.Splitters.__init__

    def noted(self, cuts, width):
        plain(self, cuts, width)
        seen.append((len(self.heavy), len(self.straddling)))

    suffix_dedup.Splitters.__init__ = noted
    try:
        assert found_repeats(suffix_dedup.repeats(made)) == brute_repeats(rows)
    finally:
        suffix_dedup.Splitters.__init__ = plain
    assert seen and seen[0][0] > 0 and seen[0][1] > 0


def test_suffix_dedup_whole_table(spark, sample):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(sample).collect()}
    want = brute_repeats([(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()])
    assert got == {i: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(kept).hexdigest()) for i, n, s, kept in want}


def test_equal_windows():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2, (400, 84), dtype=np.uint8)
    rows[100:200] = rows[:100]
    starts = rng.integers(0, 34, 400) + np.arange(400) * 84
    who, run = suffix_dedup.equal_windows(rows, starts, 50)
    groups = {}
    for k, s in enumerate(starts):
        groups.setdefault(rows.tobytes()[s : s + 50], []).append(k)
    want = sorted(g for g in groups.values() if len(g) > 1)
    got = {}
    for w, r in zip(who.tolist(), run.tolist(), strict=True):
        got.setdefault(r, []).append(w)
    assert sorted(sorted(g) for g in got.values()) == want


def test_line_dedup_tells_rows_without_an_id_apart(spark):
    same, own = "this one line is in all of the rows here", "but number {} is found in this row and in no other row of it all"
    rows = [(None, f"{same}\n{own.format(f'a{k} b{k} c{k}')}") for k in range(300)] + [(5, f"{same}\nfirst w1 w2 w3 w4 w5 of five"), (5, f"{same}\nanother x1 x2 x3 x4 x5 of five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__gone", F.lit(1)).withColumn("row", F.lit(2)).withColumn("__row", F.lit(3))
    kinds = Counter((r["doc_id"], r["line_no"], r["kind"]) for r in line_dedup.line_duplicates(docs).collect())
    assert kinds[None, 0, "kept"] == 1 and kinds[None, 0, "exact"] == 299 and kinds[5, 0, "exact"] == 2
    kept = line_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(same in t for t in texts) == 1 and len(texts) == 302 and all(t.count("\n") <= 1 and len(t) > 10 for t in texts)


def test_line_dedup_with_many_null_ids(spark):
    rows = spark.range(10_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('a line that all of the rows repeat\n', 'the row ', id, ' has words ', id * 7, ' and ', id * 13, ' too') AS text")
    plan = line_dedup.without_duplicates(rows)
    assert plan.where("text LIKE 'a line that%'").count() == 1 and plan.count() == 10_000


# --- the pipeline's near-dedup ------------------------------------------------------------------------------------------


def word_edits(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_dedup_ties_are_checked(spark):
    """Every row dropped is tied by links of 0.8 or more; pairs from 0.8 on are found; pairs below stay, however near."""
    rng = random.Random(4)
    pairs = []
    for _ in range(260):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 300))]
        pairs.append((" ".join(words), " ".join(word_edits(rng, words, rng.choice([0.01, 0.02, 0.03, 0.04, 0.05, 0.07])))))
    jaccard = [len(a & b) / len(a | b) for a, b in ((shingle_set(x), shingle_set(y)) for x, y in pairs)]
    docs = spark.createDataFrame([(2 * k + s, t) for k, pair in enumerate(pairs) for s, t in enumerate(pair)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_trie.one_of_each(docs).collect()}
    assert all(2 * k in kept for k in range(len(pairs)))
    tied = [2 * k + 1 not in kept for k in range(len(pairs))]
    near = [t for t, j in zip(tied, jaccard) if j >= 0.8]
    assert len(near) > 50 and sum(near) >= 0.95 * len(near)
    assert not any(t for t, j in zip(tied, jaccard) if j < 0.8) and sum(0.6 < j < 0.8 for j in jaccard) > 50


def test_near_dedup_of_a_dense_group(spark):
    """Two thousand near copies of one text, and texts that share half of it: one row is left of the copies, and all others."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    copies = [" ".join(word_edits(rng, base, 0.008)) for _ in range(2000)]
    others = [" ".join(base[:100] + [f"x{rng.randrange(10**6)}" for _ in range(100)]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_trie.one_of_each(docs).collect()}
    sets = [shingle_set(t) for t in copies]
    apart = [k for k in range(1, 2000) if k in kept]
    assert 0 in kept and all(2000 + k in kept for k in range(300))
    # of the copies that have one of 0.8 or more, hardly one stays
    near = [k for k in apart if max(len(sets[k] & s) / len(sets[k] | s) for i, s in enumerate(sets) if i != k) >= 0.8]
    assert len(near) <= 20 and len(apart) < 100, (len(near), len(apart))


def test_tied_fingerprints_of_a_large_group_in_bounded_time():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, 256, dtype=np.uint8)
    flips = rng.random((50_000, 256)) < rng.choice([0.02, 0.05, 0.12], (50_000, 1))
    fps = sorted({np.packbits(base ^ f).tobytes() for f in flips})
    n = len(fps)
    batch = pa.RecordBatch.from_pydict({"fp": pa.array(fps, pa.binary()), "band": pa.array(np.zeros(n, np.int64)), "low": pa.array(np.zeros(n, np.int32)), "high": pa.array(np.zeros(n, np.int32))})
    began = time.time()
    out = list(simhash_trie._similar_links(simhash_trie.WIDE_BUDGET)(iter([batch])))
    assert time.time() - began < 120 and sum(len(b) for b in out) > 0.9 * n


# --- 8: many languages --------------------------------------------------------------------------------------------------


def tongue(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return lambda k=n: " ".join(rng.choice(words) for _ in range(k))


def test_keyed_automata_give_the_same_rates():
    rng = random.Random(6)
    refs = {f"l{k}": tongue(rng, "abcdefghijklmnop"[k : k + 9], 300)() for k in range(5)} | {"zh": "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(900))}
    texts = [None, "", "!!", *(tongue(rng, "abcdefghijklmnopq", 200)() for _ in range(6)), *refs.values(), "x" * 5000, "一丁七 ab" * 300]
    plain, many = langid.Model(refs), langid.Model(refs, {lang: langid.keyed(r) for lang, r in refs.items()})
    assert (plain.rates(texts)[0] == many.rates(texts)[0]).all() and plain.predict(texts)[0] == many.predict(texts)[0]
    assert not many.dense and len(many.sparse) == 6 and many.sparse[0][1].dtype == np.int32


def test_two_hundred_languages_in_bounded_memory(spark):
    rng = random.Random(7)
    said = {f"l{k:03d}": tongue(rng, [chr(0x4E00 + k * 3 + j) for j in range(24)], 40) for k in range(200)}  # letters without case
    rows = [(100 * k + j, f(), lang) for k, (lang, f) in enumerate(said.items()) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 100 < 4, F.col("lang")))
    got = {r["doc_id"]: r["__lang_pred"] for r in langid.with_language(known).where("doc_id % 100 = 4").collect()}
    texts = {i: t for i, t, _ in rows if i % 100 == 4}
    full_tables = langid.Model(langid.references(langid.sample(known, F.lit(True))))
    assert full_tables.dense and got == dict(zip(texts, full_tables.predict(list(texts.values()))[0]))
    assert sum(got[i] == lang for i, _, lang in rows if i in got) >= 190
    # a reference of full length takes about half a megabyte, whatever its alphabet
    for letters in ("abcdefghijklmnopqrstuvwxyz", [chr(0x4E00 + j) for j in range(2000)]):
        ref = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(9000))[: langid.REFERENCE_CHARS]
        assert sum(a.nbytes for a in langid.keyed(ref)[1:]) < 700_000


# --- 7: more edits ------------------------------------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_variants_of_several_edits_are_exact():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(3, 7))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.35 and len(b) > 1:
                del b[rng.randrange(len(b))]
            elif kind < 0.7:
                b.insert(rng.randrange(len(b) + 1), rng.choice("abcd"))
            else:
                b[rng.randrange(len(b))] = rng.choice("abcd")
        for k in (1, 2, 3):
            near = plain_distance(a, b) <= k
            assert line_dedup.within(a, b, k) == near
            assert bool(line_dedup.multi_variants(a, k) & line_dedup.multi_variants(b, k)) == near
            if near and min(len(a), len(b)) >= k + 1:
                assert set(line_dedup.part_keys(a, k, k + 1)) & set(line_dedup.part_keys(b, k, k + 1))


@pytest.mark.parametrize("k", [1, 2])
def test_line_dedup_within_k_edits(spark, k):
    rng = random.Random(k)
    lines = [[f"w{rng.randrange(9)}" for _ in range(rng.randint(8, 13))] for _ in range(25)]
    said = []
    for _ in range(160):
        w = list(rng.choice(lines))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        said.append(" ".join(w))
    rows = [(d, "\n".join(said[8 * d : 8 * d + 8])) for d in range(20)]
    got = {(r["doc_id"], r["line_no"]): (r["kind"], r["of_doc_id"], r["of_line_no"]) for r in line_dedup.line_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), min_words=6, edits=k).collect()}
    first = {}
    for p in range(160):
        first.setdefault(said[p], (p // 8, p % 8))
    want = {}
    for p, line in enumerate(said):
        at = (p // 8, p % 8)
        near = min((f for other, f in first.items() if f < first[line] and plain_distance(line.split(), other.split()) <= k), default=None)
        want[at] = ("exact", *first[line]) if at != first[line] else ("near", *near) if near else ("kept", None, None)
    assert got == want and sum(v[0] == "near" for v in want.values()) > 10
