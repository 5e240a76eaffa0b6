import random

from weftline.llm import spans as S

PART = "".join(chr(97 + (k * k) % 23) for k in range(100))
RULES = S.SpanRules(min_chars=40, gram=12, group=2000)


def found(spark, texts, rules=RULES):
    return {(r[0], r[1]) for r in S.shared_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), rules).collect()}


def brute(texts, n):
    grams = [{t[i : i + n] for i in range(len(t) - n + 1)} if t else set() for t in texts]
    return {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if grams[a] & grams[b]}


def make(seed, alphabet, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 70))) for _ in range(12)]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice([rng.choice(pool), "".join(rng.choice(alphabet) for _ in range(30))])[rng.randrange(9) :] for _ in range(rng.randint(1, 5))))
    return out


def test_against_brute_force(spark):
    for seed, alphabet in ((1, "abcdefghij \né𝔸"), (2, "ab")):
        texts = [*make(seed, alphabet), None, "", "a" * 200, "a" * 39, "a" * 40]
        texts += texts[:3]  # exact copies
        assert found(spark, texts) == brute(texts, 40)


def test_split_groups_lose_nothing(spark):
    texts = make(3, "abcdef")
    texts += [texts[0] + str(k) * 50 for k in range(10)]
    want = brute(texts, 40)
    assert found(spark, texts) == found(spark, texts, S.SpanRules(min_chars=40, gram=12, group=2)) == want


def test_share(spark):
    a = PART
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    x, y = noise(50) + a + noise(30), a + noise(70)
    texts = [x, y, noise(300), None, "copy" * 20, "copy" * 20]
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in S.shared_share(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), RULES).collect()}
    assert got == {0: (180, 100), 1: (170, 100), 2: (300, 0), 3: (None, 0), 4: (80, 80), 5: (80, 80)}


def brute_share(texts, n):
    grams = [{t[i : i + n] for i in range(len(t) - n + 1)} if t else set() for t in texts]
    out = {}
    for k, t in enumerate(texts):
        hit = set()
        for i in range(len(t or "") - n + 1):
            if any(t[i : i + n] in g for j, g in enumerate(grams) if j != k):
                hit.update(range(i, i + n))
        out[k] = (None if t is None else len(t), len(hit))
    return out


def test_share_against_brute_force(spark):
    for seed, group in ((6, 2000), (6, 6), (6, 1)):
        texts = [*make(seed, "abcdef", 25), None, "a" * 50]
        texts += [texts[0][:60] + str(k) * 45 for k in range(6)] + texts[:2]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in S.shared_share(df, S.SpanRules(min_chars=40, gram=12, group=group)).collect()}
        assert got == brute_share(texts, 40)


def test_stretches(spark):
    texts = ["x" * 5 + PART + "y" * 30, "q" * 60, PART + "z" * 41, "q" * 60]
    got = {tuple(r) for r in S.shared_stretches(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), RULES).collect()}
    assert got == {(0, 5, len(PART)), (2, 0, len(PART)), (1, 0, 60), (3, 0, 60)}


def test_boilerplate_is_a_class(spark):
    """One notice in many documents, no two of them alike: rows in proportion to the documents, and the same as classes and as pairs."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    notice = word(150)
    texts = [word(50) + notice + word(50) for _ in range(3000)] + [word(250) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    links = S.shared_links(df, S.SpanRules(min_chars=40, gram=12, group=100))
    members = links.classes.groupBy("cls").count().collect()
    assert links.pairs.count() <= 3000 and any(r["count"] == 3000 for r in members)
    assert sum(r["count"] for r in members) <= 30 * 3000
    small = spark.createDataFrame(list(enumerate(texts[:120] + texts[3000:3010])), "doc_id bigint, text string")
    assert {tuple(r) for r in S.shared_pairs(small, S.SpanRules(min_chars=40, gram=12, group=20)).collect()} == {(a, b) for a in range(120) for b in range(a + 1, 120)}


def test_expanded_blocks(spark):
    members = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 7), (2, 99), (3, 5)], "cls bigint, doc_id bigint")
    got = [tuple(r) for r in S.expanded(members, 8).collect()]
    assert len(got) == len(set(got)) == 50 * 49 // 2 + 1 and (7, 99) in got


def test_empty(spark):
    assert found(spark, ["short"]) == set()
