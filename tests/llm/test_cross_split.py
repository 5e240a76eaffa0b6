import random

from weftline.llm import cross_split as c
from weftline.llm.writing import one_slip, plain_words, squash, word_distance

SCHEMA = "seed_key bigint, term string, text string, slug string, split string, extra string"
TEXT = "a kind of harbour found behind the chapel, ancient in shape, which a scholar inspected for its hollow"


def pairs(spark, rows, params=c.CrossSplit()):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {(r["seed_key_t"], r["seed_key_h"]) for r in c.overlaps(df, params).collect()}


def test_cases(spark):
    rows = [
        (1, "Harbrunlen (noun)", TEXT, "a", "train"),
        (2, "'HARBRÚN­LEN' (v.)", TEXT.upper() + " [Obs.]", "b", "val"),
        (3, "harburnlen", TEXT.replace("ancient", "old"), "b", "test"),  # swapped letters
        (4, "harbrunlen", "to carry or repair a frozen basket with the hedge of a cook, softly and with justice", "b", "val"),  # another sense
        (5, "otherword", TEXT, "b", "val"),
        (6, None, TEXT, "b", "val"),
        (7, "harbrunlen", None, "b", "val"),
        (8, "", "", "b", "val"),
        (9, "harbrunlen", TEXT, "a", "train"),  # a repeated row
        (10, "harbrunlen (noun)", "<i>" + TEXT.replace(" and ", " & ") + "</i>", "b", "val"),
    ]
    assert pairs(spark, rows) == {(t, h) for t in (1, 9) for h in (2, 3, 10)}


def test_empty(spark):
    assert pairs(spark, [(1, "a", "b", "s", "train")]) == set()


def made(rng, vocab, heads, n, lengths):
    rows = []
    for _ in range(n):
        head = heads(rng)
        text = [rng.choice(vocab) for _ in range(rng.randint(*lengths))]
        for _ in range(3):
            h, t = list(head), list(text)
            for _ in range(rng.randrange(2)):
                i = rng.randrange(len(h))
                h[i : i + 1] = rng.choice([[], [h[i], "z"], ["y"]])
            for _ in range(rng.randrange(5)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randrange(2)] = rng.choice([[], [rng.choice(vocab)]])
            rows.append((len(rows), "".join(h), " ".join(t), "s", rng.choice(["train", "val"])))
    return rows


def brute(rows, p):
    want = set()
    forms = [(r[0], r[4], squash(r[1]), plain_words(r[2])) for r in rows]
    for i, si, hi, wi in forms:
        for j, sj, hj, wj in forms:
            if si == "train" and sj == "val" and hi and hj and wi and wj and one_slip(hi, hj):
                most = p.allowed(min(len(wi), len(wj)))
                if word_distance(wi, wj, most) <= most:
                    want.add((i, j))
    return want


def test_against_brute_force(spark):
    """Nothing within the limits is lost, whatever the lengths and however many meet under one key."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    anything = lambda r: "".join(r.choice("abcde") for _ in range(r.randint(3, 12)))
    rows = made(rng, vocab, anything, 120, (1, 24))
    few = made(rng, vocab[:25], lambda r: r.choice(["harbour", "harbours", "garden"]), 60, (1, 14))
    rows += [(r[0] + len(rows), *r[1:]) for r in few]
    want = brute(rows, c.CrossSplit())
    assert len(want) > 100
    assert pairs(spark, rows) == want
    assert pairs(spark, rows, c.CrossSplit(hot=0)) == want


def test_keys_are_shared_within_the_limit():
    rng = random.Random(7)
    p = c.CrossSplit()
    for _ in range(4000):
        a = [rng.choice("pqrstuvwxyz") * rng.randint(1, 4) for _ in range(rng.randint(1, 20))]
        b = list(a)
        for _ in range(p.allowed(len(a))):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice([[], ["new"]])
        if b and p.allowed(min(len(a), len(b))) >= word_distance(a, b, 3):
            x, y = c.text_blocks([a, b])
            for size in (1, 2):
                assert c.text_keys(a, x, p.max_words, size) & c.text_keys(b, y, p.max_words, size)


def test_hot_headword_and_copies_stay_small(spark):
    """Many senses of one headword, and a group of copies, which are counted as one class and not expanded."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    rows = [(k, "harbour", " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 17))), f"f{k % 3}", "train" if k % 4 else "val") for k in range(10_000)]
    rows += [(20_000 + k, "harbour", TEXT, f"f{k % 3}", "train" if k % 4 else "val") for k in range(8000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {(r["slug_h"], r["slug_t"]): (r["pairs"], r["held_entries"], r["train_entries"]) for r in c.overlap_counts(df).collect()}
    assert sum(x[0] for x in got.values()) >= 2000 * 6000 and len(got) == 9
    base, classes = c._classes(df)
    assert classes.count() <= 10_002


def test_latest_build_counts(spark):
    m = spark.sql("select * from values ('a', ' Val ', timestamp'2025-01-02'), ('a', 'train', timestamp'2025-01-01'), ('b', null, timestamp'2025-01-01') as t(slug, split, built_at)")
    assert {(r["slug"], r["split"]) for r in c.current_files(m).collect()} == {("a", "val"), ("b", "train")}
