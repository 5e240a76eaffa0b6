import datetime as dt
import random

from weftline.llm import history as H

ROW = "row_id bigint, task string, instruction string, response string, meta struct<word: string, style: string>, ingested_at timestamp, extra string"
SPEC = "name string, dedup_key string, seed_term_field string"
REPLY = "The word {} stands for a kind of wall found in the upper valley, wooden in shape."


def row(i, word, style="formal", response=None, task="t", instruction="What is it?", minute=None):
    r = REPLY.format(word) if response is None else response
    return (i, task, instruction, r, (word, style), dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i if minute is None else minute), "x")


def specs(spark):
    return spark.createDataFrame([("t", "meta.word + style", "word"), ("u", "meta.word + instruction", "word")], SPEC)


def found(spark, rows, slices=1, **rules):
    df = spark.createDataFrame(rows, ROW)
    return {r["row_id"] for r in H.repeated_rows(df, specs(spark), slices, H.HistoryRules(buckets=2, **rules)).collect()}


ROWS = [
    row(1, "renmurdonlu"),
    row(2, "REN-murdónlu", "Formal", "something quite different"),  # same fields apart from writing
    row(3, "renmurdonli"),  # a slip, the same response
    row(4, "renmurdonli", response="A response of its own, about another thing."),  # same fields as 3
    row(5, "renmudronlu", response="An entirely other response to a similar word."),  # a slip, another response
    row(6, "renmurdonlu", "casual"),
    row(7, None),
    row(8, "renmurdonlu", None),
    row(9, "renmurdonlux", response=REPLY.format("renmurdonlux").replace("upper", "lower").replace("wall", "roof")),
    row(10, "tersol", task="u", instruction="Tell me of 'tersol' now."),
    row(11, "tersol", task="u", instruction="Tell me of 'tersal' now.", response=REPLY.format("tersol")),  # a slip in the quotation
    row(12, "tersol", task="u", instruction="Tell me of 'tersol' then.", response=None),
    row(13, "", task="u"),
    row(14, "renmurdonlu", minute=0),  # arrived first
]
WANT = {1, 2, 3, 4, 9, 11}


def test_cases_in_any_number_of_batches(spark):
    assert found(spark, ROWS) == WANT
    assert found(spark, ROWS, slices=3) == WANT


def test_hot_segments_lose_nothing(spark):
    for hot in (0, 1):
        for slices in (1, 3):
            assert found(spark, ROWS, slices=slices, hot=hot) == WANT


def test_large_batches_are_joined_by_sorting(spark):
    assert found(spark, ROWS, slices=2, held=0) == WANT


def test_reply_keys_meet_within_two_words():
    rng = random.Random(2)
    for _ in range(3000):
        a = [rng.choice("pqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(1, 16))]
        b = list(a)
        for _ in range(2):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice([[], ["new"]])
        assert not b or set(H.reply_keys(a, 6, 2)) & set(H.reply_keys(b, 6, 2))


def test_short_replies_of_one_segment_are_not_all_candidates():
    """Unrelated responses of few words share no key, as no part without words counts."""
    rng = random.Random(3)
    for n, most in ((5, 0), (8, 0), (9, 0.02), (17, 0.005)):
        keys = [set(H.reply_keys([f"w{rng.randrange(10**6)}" for _ in range(n)], 6, 2)) for _ in range(200)]
        share = sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i]) / (200 * 199 / 2)
        assert share <= most


def ids(df):
    return {r["row_id"] for r in df.collect()}


def test_index_is_opened_again_and_appending_twice_changes_nothing(spark, tmp_path):
    folder, sp = f"file://{tmp_path}/index", specs(spark)
    index = H.HistoryIndex(spark, H.HistoryRules(buckets=2), folder)
    first = index.prepare(spark.createDataFrame(ROWS[:1], ROW), sp)
    assert index.check(first).count() == 0
    assert index.append(first) and not index.append(first)
    second = index.prepare(spark.createDataFrame(ROWS[1:3], ROW), sp)
    assert ids(index.check(second)) == {2, 3}
    index.discard(second)
    index.close()
    again = H.HistoryIndex(spark, H.HistoryRules(buckets=7), folder)
    assert again.rules.buckets == 2
    assert not again.append(again.prepare(spark.createDataFrame(ROWS[:1], ROW), sp))
    second = again.prepare(spark.createDataFrame(ROWS[1:3], ROW), sp)
    assert ids(again.check(second)) == {2, 3}
    assert again.append(second)
    other = H.HistoryIndex(spark, folder=folder)
    third = other.prepare(spark.createDataFrame([row(50, "renmurdonli", response="quite another")], ROW), sp)
    assert ids(other.check(third)) == {50}
    assert other._part("keys", sorted(other.committed.values())).count() == 3  # one of them in either batch


def test_merged_parts_say_the_same(spark, tmp_path):
    folder, sp = f"file://{tmp_path}/index", specs(spark)
    index = H.HistoryIndex(spark, H.HistoryRules(buckets=2, hot=1), folder)
    first = None
    for part in (ROWS[:4], ROWS[4:9], ROWS[9:12]):
        batch = index.prepare(spark.createDataFrame(part, ROW), sp)
        first = first or batch
        assert index.append(batch)
    new = spark.createDataFrame([row(60, "renmurdonli"), row(61, "tersol", task="u", instruction="Tell me of 'tersol' now."), row(62, "unheard")], ROW)
    before = ids(index.check(index.prepare(new, sp)))
    index.refresh()
    assert index.compact() and not index.compact()
    assert len(set(index.committed.values())) == 1 and len(index.committed) == 3
    again = H.HistoryIndex(spark, folder=folder)
    assert ids(again.check(again.prepare(new, sp))) == before == {60, 61}
    assert not again.append(first)
    assert again.append(again.prepare(new, sp)) and again.compact() and len(again.committed) == 4
    assert ids(again.check(again.prepare(spark.createDataFrame([row(70, "unheard")], ROW), sp))) == {70}


def test_staged_batches_are_not_history(spark, tmp_path):
    folder, sp = f"file://{tmp_path}/index", specs(spark)
    index = H.HistoryIndex(spark, H.HistoryRules(buckets=2), folder)
    index.prepare(spark.createDataFrame(ROWS[:1], ROW), sp)
    assert ids(index.check(index.prepare(spark.createDataFrame(ROWS[1:2], ROW), sp))) == set()


def test_history_is_not_shuffled(spark, tmp_path):
    """No exchange above a scan of the index's tables in any join of the check; few candidates read their buckets only."""
    sp = specs(spark)
    index = H.HistoryIndex(spark, H.HistoryRules(buckets=16), f"file://{tmp_path}/index")
    index.append(index.prepare(spark.createDataFrame([row(k, f"{k * k:04d}wort{k:03d}") for k in range(200)], ROW), sp))
    batch = index.prepare(spark.createDataFrame([row(900, "0049wart007")], ROW), sp)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = H.materialise(index.candidates(batch), "pairs")
        for df in (index.candidates(batch), index.first_arrivals(batch), index.stored_texts(batch, pairs)):
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
            (join,) = [i for i, x in enumerate(plan) if "ShuffledHashJoin" in x]
            other = next(i for i in range(join + 2, len(plan)) if depth[i] == depth[join + 1])
            history = plan[join + 1 : other]
            assert [x.lstrip(" :+-").split(" ")[0] for x in history] == ["Project", "Filter", "FileScan"] and "Bucketed: true" in history[-1]
        text = index.stored_texts(batch, pairs)._jdf.queryExecution().executedPlan().toString()
        assert any(f"SelectedBucketsCount: {n} out of 16" in text for n in range(1, 9))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert ids(index.check(batch)) == {900}


def test_empty(spark):
    assert found(spark, [row(1, None)]) == set()
    assert H.repeated_rows(spark.createDataFrame([], ROW), specs(spark), 1).count() == 0


def test_null_responses(spark):
    rows = [(1, "t", "i", None, ("alphabet", "x"), dt.datetime(2025, 1, 1), "x"), (2, "t", "i", None, ("alphabat", "x"), dt.datetime(2025, 1, 2), "x"), (3, "t", "i", None, ("alphabet", "x"), dt.datetime(2025, 1, 3), "x")]
    assert found(spark, rows) == {3}
