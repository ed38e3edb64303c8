"""The latent space is fitted on all passages of all documents."""

import numpy as np

from quillgraph.llm import common, lsi_decontam


def test_words_of_every_passage_count(spark):
    """A word in two passages of a hundred, neither first nor last, is a term; one in a single passage is none."""
    filler = [f"w{k}" for k in range(3200)]
    filler[100], filler[170], filler[1500] = "twice", "twice", "item"
    docs = spark.createDataFrame([(1, " ".join(filler))], "doc_id long, text string")
    common.prepare(spark)
    index = lsi_decontam.latent_space(docs, [(7, "item of words")])
    assert index.terms.context == [b"twice"]


def test_passes_over_numbers_give_the_product(spark):
    """The sketch is A'(A x) of all passages with a term, each of length one."""
    rng = np.random.default_rng(3)
    names = [f"t{k}" for k in range(30)]
    texts = [" ".join(rng.choice([*names, "other"], 150)) for _ in range(40)] + [None, "", "other"]
    terms = lsi_decontam.Terms([n.encode() for n in names])
    idf = np.concatenate([[0.0], rng.random(30) + 1])
    x = rng.standard_normal((31, 4))
    want = np.zeros((31, 4))
    for t in texts:
        for p in lsi_decontam._passages(terms.numbers(t)):
            if p.any():
                row = np.zeros(31)
                np.add.at(row, p, idf[p])
                row /= np.sqrt((idf[p] ** 2).sum())
                want += np.outer(row, row @ x)
    common.prepare(spark)
    held = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).mapInArrow(lsi_decontam._numbers(terms), "sizes binary, terms binary")
    got = held.mapInArrow(lsi_decontam._sketch(idf, [(np.arange(31), idf, x)]), "space int, block int, z binary").toArrow().to_pylist()
    assert len(got) == 1 and got[0]["block"] == 0
    z = np.frombuffer(got[0]["z"], "<f8").reshape(31, 4)
    assert np.allclose(z[1:], want[1:], rtol=1e-4, atol=1e-4)


def test_added_products_give_the_same_as_passes_over_numbers(spark):
    """A'A of all passages, added up once, gives A'(A x) of each space, also where a space lacks terms or a passage repeats them."""
    rng = np.random.default_rng(4)
    names = [f"t{k}" for k in range(100)]
    texts = [" ".join(rng.choice([*names, "other"], 150, p=np.r_[np.full(50, 0.015), np.full(50, 0.004), 0.05])) for _ in range(60)] + [None, "", "other", "t3 t3 t3 t5"]
    terms = lsi_decontam.Terms([n.encode() for n in names])
    idf = np.concatenate([[0.0], rng.random(100) + 1])
    some = np.zeros(101, dtype=np.int32)
    some[2::3] = np.arange(1, len(some[2::3]) + 1)
    bases = [(np.arange(101, dtype=np.int32), idf, rng.standard_normal((101, 5))), (some, idf[some > 0], rng.standard_normal((some.max() + 1, 3)))]
    common.prepare(spark)
    held = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).mapInArrow(lsi_decontam._numbers(terms), "sizes binary, terms binary")
    products = held.repartition(3).mapInArrow(lsi_decontam._products(idf), "block int, products binary").groupBy("block").applyInArrow(lsi_decontam._added, "block int, products binary")
    summed = []
    for rows, step in ((held, lsi_decontam._sketch(idf, bases)), (products, lsi_decontam._multiplied(bases))):
        zs = [np.zeros(x.shape) for _, _, x in bases]
        for r in rows.mapInArrow(step, "space int, block int, z binary").toArrow().to_pylist():
            part = np.frombuffer(r["z"], "<f8").reshape(-1, zs[r["space"]].shape[1])
            zs[r["space"]][r["block"] : r["block"] + len(part)] += part
        summed.append(zs)
    assert all(np.allclose(a, b, rtol=1e-4, atol=1e-4) and abs(a).max() > 1 for a, b in zip(*summed, strict=True))


def test_the_space_is_fitted_by_products_of_few_terms_and_by_numbers_of_many(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, " ".join(rng.choice([f"w{i}" for i in range(60)], 200))) for k in range(40)], "doc_id long, text string")
    items = [(k, " ".join(rng.choice([f"w{i}" for i in range(60)], 30))) for k in range(5)]
    common.prepare(spark)
    used, products = [], lsi_decontam._products
    monkeypatch.setattr(lsi_decontam, "_products", lambda *a: used.append(1) or products(*a))
    one = lsi_decontam.latent_space(docs, items)
    assert used == [1]  # once for all rounds
    monkeypatch.setattr(lsi_decontam, "PRODUCTS", 0)
    other = lsi_decontam.latent_space(docs, items)
    assert used == [1]
    for a, b in zip(one.spaces, other.spaces, strict=True):
        assert np.allclose(a.queries.T @ a.queries, b.queries.T @ b.queries, atol=1e-3)
