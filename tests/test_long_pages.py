"""A long page is read in pieces, with what reading it whole gives."""

import random

from quillgraph.plans import more_adapters as A
from quillgraph.sources import text as lines

#: ``@`` is a space or a line's end.
PARTS = ["word", ", stop", "-- dash", "{note@more} said", "(#Ge@1:1) .", "<b>bold@too</b>", "<i@title='a'@>it</i>", "<!-- gone@back -->", "<script>x(@)</script>", "<noscript>no@no</noscript>", "(9)", "(@3@)", "\u00f9", "& amp", "(", ")", "; &@ "]


def page(rng: random.Random, dotted: bool) -> str:
    out, due = ["<html><body><p>title"], {"1": 1, "2": 1}
    for _ in range(rng.randint(0, 60)):
        if rng.random() < 0.5:
            book = rng.choice("12" if dotted else "1")
            n = due[book] + (rng.choice([-1, 1, 2]) if rng.random() < 0.2 else 0)
            due[book] += n == due[book]
            out.append(f"({book}.{n})" if dotted else f"({n})")
        else:
            out.append(rng.choice(PARTS if rng.random() < 0.7 else PARTS[:3]))
        out.append(rng.choice(["\n", "\n", " ", "\r\n"]))
    return "".join(rng.choice("\n ") if c == "@" else c for c in "".join(out)) + rng.choice(["", "\nGo to the Tables of Contents (1) no\n(2) no"])


def test_pieces_give_what_the_whole_page_gives(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    for k in range(60):
        (tmp_path / f"p{k:02d}.html").write_bytes(page(rng, k % 3 == 0).encode("ISO-8859-1"))
    rows = lambda: sorted(map(tuple, A.philo(spark, str(tmp_path), "philo.x", {1: "-i"})["HistoricalChunk"].select("anchor_id", "text").collect()))
    whole = rows()
    monkeypatch.setattr(A, "STRETCH", 1)
    assert rows() == whole and len(whole) > 200


def test_a_long_page_is_cut(spark, tmp_path, monkeypatch):
    """No row holds a long page: its pieces have some lines each, and the bytes of Latin-1 are kept."""
    monkeypatch.setattr(A, "STRETCH", 10)
    (tmp_path / "p.html").write_bytes("\n".join(f"({n}) a{{note}} éù b" for n in range(1, 1001)).encode("ISO-8859-1"))
    pieces = [r["text"] for r in A.in_pieces(lines.lines(spark, str(tmp_path), "ISO-8859-1"), "Go to the").orderBy("piece").collect()]
    assert len(pieces) == 100 and max(x.count("\n") for x in pieces) == 9
    got = {r["anchor_id"]: r["text"] for r in A.philo(spark, str(tmp_path))["HistoricalChunk"].collect()}
    assert got == {f"philo.{n}": "a é, b" for n in range(1, 1001)}
