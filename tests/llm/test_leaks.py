import random

from weftline.llm import leaks as L

ITEM = "the brokerage of a reciprocal usury, capitalised by wholesalers whenever the rudder becomes fiduciary"


def found(spark, texts, items=((1, ITEM),), limits=L.LeakLimits()):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    i = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in L.leak_spans(d, i, limits).collect()}


def test_cases(spark):
    w = ITEM.split()
    texts = [
        "x " + " ".join(w[:8]) + " y",
        " ".join(w[:7]),
        " ".join([*w[:5], "other", *w[6:12]]),  # one changed of twelve
        " ".join([*w[:5], *w[6:12]]),  # one left out
        " ".join([*w[:6], "new", *w[6:12]]),  # one added
        " ".join([*w[:5], "other", *w[6:11]]),  # eleven only
        " ".join(reversed(w)),
        "THE <b>brokerage</b> of\r\na reci-\nprocal USURY; capitalised by whole­salers",
        None,
        "",
        "word " * 5000 + " ".join(w[2:11]),
    ]
    assert found(spark, texts) == {(k, 1) for k in (0, 2, 3, 4, 7, 10)}


def test_no_items_and_shards(spark):
    assert found(spark, [ITEM], [(1, None), (2, "")]) == set()
    items = [(k, f"{ITEM} {k}") for k in range(5)]
    assert found(spark, [ITEM], items, L.LeakLimits(shard_words=20)) == {(0, k) for k in range(5)}


def test_against_brute_force(spark):
    for seed, vocab in ((2, "abcdefgh"), (3, "ab"), (4, "abc")):
        against_brute_force(spark, random.Random(seed), list(vocab))


def against_brute_force(spark, rng, vocab):
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 20)))) for k in range(12)]
    texts = []
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(10)]
        s = rng.choice(items)[1].split()
        a = rng.randrange(len(s))
        cut = s[a : a + rng.randint(4, 14)]
        for _ in range(rng.randrange(3)):
            if cut:
                k = rng.randrange(len(cut))
                cut[k : k + 1] = rng.choice([[], ["zz"], [cut[k], "zz"]])
        texts.append(" ".join([*t[:5], *cut, *t[5:]]))
    want = set()
    for n, t in enumerate(texts):
        d = t.split()
        for k, s in items:
            s = s.split()
            grams = {tuple(s[i : i + 8]) for i in range(len(s) - 7)}
            if any(tuple(d[i : i + 8]) in grams for i in range(len(d) - 7)):
                want.add((n, k))
            for i in range(len(s) - 11):
                x = s[i : i + 12]
                for j in range(len(d)):
                    for m in (11, 12, 13):
                        y = d[j : j + m]
                        if len(y) == m and (
                            (m == 12 and sum(p != q for p, q in zip(x, y)) <= 1)
                            or (m == 11 and any(x[:e] + x[e + 1 :] == y for e in range(12)))
                            or (m == 13 and any(y[:e] + y[e + 1 :] == x for e in range(13)))
                        ):
                            want.add((n, k))
    assert found(spark, texts, items) == want


def test_removal(spark):
    texts = [f"Before it. {ITEM}, and after <i>that</i> come some more words to keep the share of what is lost below one half.", ITEM, None, "", "nothing here"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    i = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "some more words to keep the share of what")], "item_id bigint, text string")
    for shard_words in (1000, 10):
        got = {r["doc_id"]: r for r in L.remove_leaks(d, i, L.LeakLimits(shard_words=shard_words, coverage=0.8)).collect()}
        assert got[0]["text"].startswith("Before it. , and after <i>that</i> come is lost") and got[0]["removed_words"] == 23 and not got[0]["dropped"]
        assert got[1]["dropped"] and got[1]["text"] is None
        assert [(got[k]["text"], got[k]["removed_words"], got[k]["dropped"]) for k in (2, 3, 4)] == [(None, 0, False), ("", 0, False), ("nothing here", 0, False)]
    plan = L.remove_leaks(d, i)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
