import os

import numpy as np
import pytest

from weftline.llm import mixing as M
from weftline.llm import packing as P
from weftline.llm.tokens import TOKENIZERS

needs_tokenizer = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizer files")


def test_hilbert_curve_is_continuous_and_complete():
    side, dims = 8, 3
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = P.hilbert_keys(grid, bits=3)
    assert sorted(keys) == list(range(side**dims))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(n), int(rng.integers(1 << 40))) for i, n in enumerate(rng.integers(1, 300, 3000))] + [(9000, 1000, 5), (9001, 512, 6), (9002, 256, 7)]
    sized = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, key bigint")
    windows = spark.createDataFrame([("s", 256), ("m", 512)], "window_name string, seq_len int")
    got = P.packed(sized, windows).toPandas()
    for name, cap in (("s", 256), ("m", 512)):
        g = got[got.window_name == name]
        fill = g.groupby("window_id").tokens.sum()
        assert fill.max() <= cap and (g.groupby("window_id").filled.first() == fill).all()
        assert g.groupby("doc_id").tokens.sum().to_dict() == {i: n for i, n, _ in rows}
        pieces = g.groupby("doc_id").size()
        assert all(pieces[i] == max(1, -(-n // cap)) for i, n, _ in rows)
        assert fill.sum() / (cap * len(fill)) > 0.97
    assert P.packed(sized.where("false"), windows).count() == 0


def test_permutations():
    for size in (1, 2, 7, 1000, 4097):
        out = M.permute(np.arange(size), size, 5)
        assert sorted(out) == list(range(size))
    assert (M.permute(np.arange(1000), 1000, 5) != M.permute(np.arange(1000), 1000, 6)).any()


def test_draws_are_multinomial_and_add_up():
    d = M.Draws([30_000, 15_000, 4_500, 500], 250, 3)
    drawn = np.array([d.drawn(k) for k in range(d.shards)])
    assert d.shards == 200 and (drawn.sum(axis=1) == 250).all()
    d.correct(drawn.sum(axis=0))
    counts = np.array([d.counts(k) for k in range(d.shards)])
    assert (counts.sum(axis=0) == d.slots).all() and (counts.sum(axis=1) == 250).all() and counts.min() >= 0
    assert 0 < len(d.corrected) < 10 and min(d.corrected) >= 190
    p = d.weights
    assert np.allclose(drawn.mean(axis=0), 250 * p, atol=4 * np.sqrt(250 * p * (1 - p) / 200))
    assert np.allclose(drawn.var(axis=0, ddof=1), 250 * p * (1 - p), rtol=0.45)  # a fifth of it is four deviations of a variance over 200 shards


@needs_tokenizer
def test_mixture(spark):
    rng = np.random.default_rng(1)
    docs = []
    for source, n in (("Big ", 400), ("big", 300), ("small", 30), ("none", 20), (None, 5)):
        docs += [(len(docs) + k, source, " ".join(f"word{x}" for x in rng.integers(0, 99, rng.integers(5, 200)))) for k in range(n)]
    docs += [(99990, "big", None), (99991, "big", "")]
    weights = spark.createDataFrame([("big", 3.0, 1, True), ("small", 1.0, 4, False), ("absent", 2.0, 4, True), ("none", 0.0, 9, True)], "source string, weight double, max_repeats int, respect_doc_boundaries boolean")
    m = M.Mixture(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), weights, M.MixRules(block=64, shard=16, parts=8))
    d = m.documents().toPandas()
    assert set(d.source) == {"big", "small"} and d.doc_id.is_unique
    assert d[d.source == "big"].uses.max() <= 1 and d[d.source == "small"].uses.max() <= 4
    s = m.shares().toPandas().set_index("source")
    assert abs(s.actual_share["big"] - 0.75) < 0.01 and s.tokens["absent"] == 0 and s.target_share["absent"] == 0
    slots = m.slots().select("shard", "slot", "source", "round", "block").distinct().toPandas()
    assert not slots.duplicated(["shard", "slot"]).any()
    assert all(n <= next(p["slots"] for p in m.plan if p["source"] == k) for k, n in slots.groupby("source").size().items())  # a block may begin no document
    assert abs(s.drawn_share["big"] - 0.75) < 0.1
    again = M.Mixture(spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(5), weights, M.MixRules(block=64, shard=16, parts=8)).documents().toPandas()
    assert d.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()


@needs_tokenizer
def test_nothing_to_mix_or_measure(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b", "")], "doc_id bigint, source string, text string")
    w = spark.createDataFrame([("a", 1.0, 1, True)], "source string, weight double, max_repeats int, respect_doc_boundaries boolean")
    m = M.Mixture(docs, w)
    assert m.documents().count() == 0 and m.slots().count() == 0 and m.shares().count() == 1
    assert P.measured(docs).count() == 0
