import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import schedules as L
from weftline.operators import mixing as M
from weftline.operators import runs as R
from weftline.operators import scores as S
from weftline.operators import tokenizer as K

METRICS = "run_id string, line_no bigint, step bigint, val_loss double"


def test_resumed_run(spark):
    m = spark.createDataFrame([("r", i, s, v) for i, (s, v) in enumerate([(0, 3.0), (5, 1.0), (10, None), (5, 1.0), (10, 2.0)])], METRICS)
    r = R.summary(m).first()
    assert (r["best"], r["best_step"], r["first"], r["final"], r["overfit_gap"]) == (1.0, 5, 3.0, 2.0, 1.0)


def test_drift_from_zero_is_infinite(spark):
    """A run whose first loss is 0, or -0, gives what floating point gives for the percentage, not an error."""
    runs = {"up": (0.0, 2.0), "down": (0.0, -2.0), "none": (0.0, 0.0), "minus": (-0.0, 2.0), "plain": (4.0, 5.0)}
    m = spark.createDataFrame([(r, i, i, v) for r, vs in runs.items() for i, v in enumerate(vs)], METRICS)
    got = {r["run_id"]: r["drift_percent"] for r in R.summary(m).select("run_id", F.round("drift_percent", 9).alias("drift_percent")).collect()}
    assert math.isnan(got.pop("none")) and got == {"up": math.inf, "down": -math.inf, "minus": -math.inf, "plain": 25.0}


def test_diverged_runs_leave_the_leaderboard(spark):
    m = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, math.nan), ("b", 0, 0, 2.0), ("c", 0, 0, math.inf), ("d", 0, 0, None)], METRICS)
    got = {r["run_id"]: (r["diverged"], r["best"], r["winner"]) for r in R.leaderboard(m, ["val_loss"]).collect()}
    assert got == {"a": (True, None, False), "b": (False, 2.0, True), "c": (True, None, False), "d": (False, None, False)}


def test_noise_floor_uses_population_deviation(spark):
    b = spark.createDataFrame([("x", 3.4968), ("x", 3.5042), ("x", 3.5119)], "config string, best double")
    r = R.noise_floor(b, "config").first()
    assert round(r["std"], 4) == 0.0062 and round(r["spread"], 4) == 0.0151
    d = spark.createDataFrame([(0.01,), (0.5,), (-0.5,)], "d double").select(R.verdict(F.col("d")).alias("v"))
    assert [r["v"] for r in d.collect()] == ["noise", "worse", "better"]


def test_plateau(spark):
    s = spark.createDataFrame([("r", k, v) for k, v in enumerate([10.0, 20.0, 20.5, 90.0])], "run_id string, k int, rate double")
    r = R.plateau(s).first()
    assert (r["tried"], r["sweet_spot"], r["rate"]) == (3, 2, 20.5)


def test_power_law_finds_its_own_parameters(spark):
    p = spark.createDataFrame([(float(n), 50 * n**-0.5 + 2.0) for n in (10, 100, 1000, 10000)], "n double, loss double")
    r = R.power_law(p).first()
    assert abs(r["alpha"] - 0.5) < 0.02 and abs(r["c"] - 2.0) < 0.02


def test_equal_rewards_count_as_wrong(spark):
    p = spark.createDataFrame([("x", -1.0, -2.0, -1.0, -2.0)], "k string, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    r = S.preference(p, "k").first()
    assert r["accuracy"] == 0.0 and abs(r["loss"] - math.log(2)) < 1e-12 and r["preferred"] == 1.0


def test_choice_ties_go_to_the_first(spark):
    s = spark.createDataFrame([(1, 0, -2.0), (1, 1, -1.0), (1, 2, -1.0)], "item_id bigint, choice int, score double")
    assert S.choose(s).first()["picked"] == 1


def test_stops(spark):
    g = spark.createDataFrame([(["a", "b", "#"],), (["a"] * 9,), ([],)], "tokens array<string>")
    r = S.stops(g, F.lit("#"), 4).first()
    assert (r["n"], round(r["stop_rate"], 6), r["mean_length"]) == (3, 0.333333, (2 + 4 + 4) / 3)


def test_aggregate_diversity_crosses_samples(spark):
    texts = [["a"], ["b", "a"], [], ["b"], ["a", "b", "a", "b"]]
    s = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, i int, tokens array<string>")
    flat = [w for t in texts for w in t]
    for n in (1, 2, 4):
        grams = [tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)]
        assert abs(S.diversity_of_groups(s, "g", "i", n).first()[1] - len(set(grams)) / len(grams)) < 1e-12


def test_diversity_of_groups_moves_no_samples(spark):
    """Samples never go through a sort, window or shuffle whole; groups without a name or without grams, orders without value and short ranges are right."""
    rng = random.Random(3)
    rows = [(rng.choice(["g", "h", None]), i, [rng.choice("abc") for _ in range(rng.choice([0, 1, 1, 2, 3, 9]))]) for i in range(60)] + [("h", None, list("cab")), ("empty", 1, []), ("one", 1, ["a"]), ("null", 1, None)]
    s = spark.createDataFrame(rows, "g string, i int, tokens array<string>").repartition(4)
    ranges = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for n in (1, 2, 3, 5):
            df = S.diversity_of_groups(s, "g", "i", n)
            got = {r[0]: r[1] for r in df.collect()}
            for g in {r[0] for r in rows}:
                flat = [w for _, _, t in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1])) for w in t or []]
                grams = [tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)]
                assert abs(got.pop(g) - (len(set(grams)) / len(grams) if grams else 0)) < 1e-12
            assert not got
            nodes, todo = [], [df._jdf.queryExecution().sparkPlan()]
            while todo:
                nodes.append(x := todo.pop())
                todo += [x.children().apply(k) for k in range(x.children().size())]
            assert not [x.nodeName() for x in nodes if x.nodeName() in ("Window", "Sort") and "tokens#" in x.output().mkString(",")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)


def test_source_without_pairs_has_no_diversity(spark, tmp_path):
    from weftline.plans.analysis import QUERIES

    docs = [(1, "a b a b", "Books"), (2, "one", "letters"), (3, None, "web"), (4, "b a", "books ")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["aggregate_diversity"](spark, str(tmp_path)).collect()] == [("books", 0.6)]


def test_schedules(spark):
    s = spark.createDataFrame([(k,) for k in (0, 9, 10, 55, 80, 100)], "s int")
    got = s.select(*(L.multiplier(F.col("s"), k, 10, 100).alias(k) for k in ("cosine", "constant", "wsd"))).collect()
    assert got[0]["cosine"] == 0.1 and got[1]["cosine"] == 1.0 and abs(got[3]["cosine"] - 0.55) < 1e-9 and got[5]["cosine"] == 0.1
    assert got[3]["constant"] == 1.0 and got[4]["wsd"] == 1.0 and got[5]["wsd"] == 0.1
    with pytest.raises(ValueError):
        L.multiplier(F.col("s"), "other", 1, 2)


def plain_bpe(chunks, merges):
    """The textbook trainer: counts of neighbouring pairs, ties by first occurrence."""
    seqs, out = [list(c.encode()) for c in chunks], []
    for k in range(merges):
        c = Counter(p for s in seqs for p in zip(s, s[1:]))
        if not c:
            break
        pair, n = c.most_common(1)[0]
        out.append((k, *pair, 256 + k, n))
        for s in seqs:
            i = 0
            while i < len(s) - 1:
                if (s[i], s[i + 1]) == pair:
                    s[i : i + 2] = [256 + k]
                i += 1
    return out, seqs


@pytest.mark.parametrize("texts", [["aaabdaaabac"], ["low lower lowest", "new newer é low"], ["aaaa aaa"], [""]])
def test_bpe_like_the_plain_trainer(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = K.chunks(docs, "whitespace")
    got = K.train(table, 6)
    want, _ = plain_bpe([c for t in texts for c in t.split(" ") if c], 6)
    assert got == want
    ids = K.encode_documents(docs, got, "none")
    assert [r["t"] for r in ids.select("doc_id", K.decode(F.col("ids"), got).alias("t")).orderBy("doc_id").collect()] == texts


TEXTS = ["low lower lowest newer wider new é", "aaaa aaa aabaab abab", "banana bandana ananas cabana", "the then there these other mother"]


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_bpe_to_the_end_like_the_plain_trainer(spark, in_one_task):
    """Several merges a job, or one task that keeps its counts: both give the plain trainer's merges until no pair is left."""
    table = K.chunks(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"), "whitespace")
    got = K.train(table, 1000, in_one_task=in_one_task)
    want, _ = plain_bpe([c for t in TEXTS for c in t.split(" ")], 1000)
    assert got == want and len(got) > 24


def test_compression_at_each_point(spark):
    chunks = [c for t in TEXTS for c in t.split(" ")]
    table = K.chunks(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"), "whitespace")
    got = {r["merges"]: (r["tokens"], r["bytes"]) for r in K.compression(table, K.train(table, 40), [0, 8, 24, 40]).collect()}
    assert got == {k: (sum(map(len, plain_bpe(chunks, k)[1])), sum(len(c.encode()) for c in chunks)) for k in (0, 8, 24, 40)}


def test_vocabulary_of_the_reference_size(spark, tmp_path):
    from weftline.plans import analysis as P

    words = " ".join("".join("abcdefghij"[int(x)] for x in str(7919 * i)) for i in range(1, 400))
    spark.createDataFrame([(1, "s", words)], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.QUERIES["bpe_merges"](spark, str(tmp_path)).count() > 280
    curve = {r["merges"]: r["bytes_per_token"] for r in P.QUERIES["bpe_compression"](spark, str(tmp_path)).collect()}
    assert sorted(curve) == [0, 244, 744, 1744, 2744, 3744, 5744, 7744] and curve[0] == 1.0 < curve[244] < curve[744]


def test_pieces_and_utilisation_are_of_tokens(spark, tmp_path):
    """Brute force with the plain trainer; a text of one word is a chunk, so each document is one."""
    from weftline.plans import analysis as P

    texts = ["internationality", "internationality", "nationalization", "standardization", "internally"]
    docs = [(i, "a" if i < 3 else "b", t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    heads = ["internationality", "standardization", "short"]
    spark.createDataFrame([("dictionary", {"word": w}) for w in heads], "seed_kind string, raw map<string, string>").write.parquet(f"{tmp_path}/seeds.parquet")
    merges, seqs = plain_bpe(texts, 7744)
    r = P.QUERIES["rare_word_pieces"](spark, str(tmp_path)).first()
    assert (r["words"], r["mean_pieces"]) == (2, (len(seqs[0]) + len(seqs[3])) / 2)
    got = {r["source"]: (r["used"], r["utilisation"]) for r in P.QUERIES["vocabulary_utilisation"](spark, str(tmp_path)).collect()}
    used = {"a": len({i for s in seqs[:3] for i in s}), "b": len({i for s in seqs[3:] for i in s})}
    assert got == {k: (n, round(n / (256 + len(merges)), 9)) for k, n in used.items()}


def test_merge_does_not_overlap_or_match_inside_ids(spark):
    df = spark.createDataFrame([("1;1;1;",), ("11;1;21;1;",), ("4;14;5;4;5;",)], "ids string")
    assert [r[0] for r in df.select(K.merged(F.col("ids"), 1, 1, 9)).collect()] == ["9;1;", "11;1;21;1;", "4;14;5;4;5;"]
    assert df.select(K.merged(F.col("ids"), 4, 5, 9)).collect()[2][0] == "4;14;5;9;"


def test_draws_depend_on_seed_and_step_only(spark):
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0)], "source string, weight double")
    few = {(r["step"], r["slot"]): r["source"] for r in M.draws(w, 50, 8, 5).collect()}
    many = {(r["step"], r["slot"]): r["source"] for r in M.draws(w, 300, 8, 5).repartition(7).collect()}
    assert few.items() <= many.items() and "c" not in many.values()
    assert 0.7 < sum(s == "a" for s in many.values()) / len(many) < 0.8
    assert few != {(r["step"], r["slot"]): r["source"] for r in M.draws(w, 50, 8, 6).collect()}


def test_windows_stay_within_documents(spark):
    w = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    spans = spark.createDataFrame([("a", 0, 7, 50), ("a", 1, 8, 40)], "source string, doc_no bigint, doc_id bigint, tokens bigint")
    got = M.windows(M.draws(w, 40, 2, 1), spans, 16, 1).collect()
    assert len(got) == 80 and all(0 <= r["start"] < {7: 50, 8: 40}[r["doc_id"]] - 16 for r in got)


def test_scores_of_the_whole_vector(spark, tmp_path):
    """The two largest numbers lie behind the first sixteen."""
    from weftline.plans import analysis as P

    v = [0.0] * 64
    v[40], v[63] = 2.0, 1.9
    spark.createDataFrame([(1, "a", v)], "vec_id bigint, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: P.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["position"] for r in run("gate_top2")} == {r["expert"] for r in run("gate_load")} == {40, 63}
    assert run("nucleus_sizes")[0]["kept"] == 2 and len(run("expert_load")) == 64


def test_tokenizer_is_saved_and_loaded(spark, tmp_path):
    import json

    import pytest
    from pyspark.sql import functions as F

    from weftline.operators import tokenizer as K

    docs = spark.createDataFrame([(1, "the cat the cat"), (2, ""), (3, "the é")], "doc_id bigint, text string")
    merges = K.train(K.chunks(docs), 6)
    K.save_tokenizer(spark, merges, str(tmp_path / "t"), ("<end>",))
    back, reserved = K.load_tokenizer(spark, str(tmp_path / "t"))
    assert back == merges and reserved == {"<end>": 256 + len(merges)}
    full = {r["doc_id"]: (r["ids"], r["start"]) for r in K.encode_with_starts(docs, back, reserved["<end>"]).collect()}
    assert full[1][1] == 0 and full[2] == ([reserved["<end>"]], len(full[1][0])) and full[3][1] == len(full[1][0]) + 1
    shown = spark.createDataFrame([(full[1][0],)], "ids array<int>").select(K.pieces(F.col("ids"), back, reserved)).first()[0]
    assert "".join(shown) == "the·cat·the·cat<end>"
    assert K.crossing(merges) == 0 and K.crossing([(0, 97, 32, 256, 1), (1, 256, 98, 257, 1)]) == 1
    body = json.loads("".join(p.read_text() for p in (tmp_path / "t").glob("part-*")))
    body["vocabulary"]["256"] = "00"
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "x.txt").write_text(json.dumps(body))
    with pytest.raises(ValueError, match="doesn't belong"):
        K.load_tokenizer(spark, str(tmp_path / "u"))
