"""A shard of the phrase counter has a bound in memory, also where words are short."""

import tracemalloc

import pyarrow as pa

from quillgraph.llm import phrases


def test_short_words_keep_a_shard_small():
    text = "\n".join(" ".join("abcdefgh"[(k * j) % 8] for k in range(20)) for j in range(1 << 17))
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["en"])], names=["text", "lang"])
    tracemalloc.start()
    words = sum(sum(f for n, f in zip(b.column("n").to_pylist(), b.column("f").to_pylist()) if n == 0) for b in phrases._counter([1, 2])(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == 20 << 17
    assert peak < 120 << 20
