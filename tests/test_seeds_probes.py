import pytest
from pyspark.sql import functions as F

from weftline.operators import factory as G
from weftline.operators import probes as P
from weftline.operators import seeds as D
from weftline.operators import tokenizer as K


def test_pack():
    assert list(D.pack(["aaa", "bb", "c", "dddddd", "e"], 6)) == ["aaa\n\nbb", "c\n\ndddddd", "e"]
    assert list(D.pack([], 6)) == []


def test_book_seeds(spark):
    books = spark.createDataFrame([("b", "one two\n \nthree\n\n\n\nfour", 1), ("n", None, 1), ("z", " \n\n ", 1), ("long", "x" * 50_000, 1)], "book string, text string, extra int")
    got = [(r["book"], r["chunk_no"], r["passage"]) for r in D.book_passages(books, 10).collect()]
    assert sorted(got)[:2] == [("b", 0, "one two\n\nthree"), ("b", 1, "four")] and len(got) == 3
    assert D.book_passages(books.where("false")).count() == 0


def test_pair_seeds_and_kinds(spark):
    rows = spark.createDataFrame([(" Ask ", "Say", "w"), (None, "Say", "w"), ("Ask", " ", "w"), ("Ask", "Say", None)], "instruction string, response string, word string")
    (r,) = D.seeds_of("sft_pairs", rows).collect()
    assert (r["term"], r["chosen"]) == ("w", "Say") and r["text"].startswith("Instruction: Ask\n") and r["id"].startswith("dpo-")
    assert D.seeds_of("dictionary", spark.createDataFrame([("harbour", "n.", "a place for ships")], "word string, part_of_speech string, definition string")).first()["term"] == "harbour (n.)"
    with pytest.raises(ValueError, match="unknown kind"):
        D.seeds_of("films", rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 9])
def test_distractors_are_others_and_different(spark, n):
    e = spark.createDataFrame([(k, f"text {k % n}") for k in range(2 * n)] + [(99, None)], "item_id bigint, definition string")
    by = {}
    for r in P.with_distractors(e, 1).collect():
        by.setdefault(r["item_id"], []).append(r)
    assert set(by) == set(range(2 * n))
    for i, rows in by.items():
        assert len(rows) == min(4, n) == len({r["definition"] for r in rows})
        assert [r["definition"] for r in rows if r["gold"]] == [f"text {i % n}"]
        assert sorted(r["choice"] for r in rows) == list(range(len(rows)))


def test_places(spark):
    spans = spark.createDataFrame([(1, 0, 10), (2, 10, 9000), (3, 9000, 9001), (4, 9001, 9001)], "doc_id bigint, start bigint, end bigint")
    got = {r["at"]: r["doc_id"] for r in P.documents_at(spark.createDataFrame([(x,) for x in (0, 9, 10, 8999, 9000, 9001)], "at bigint"), spans, 64).collect()}
    assert got == {0: 1, 9: 1, 10: 2, 8999: 2, 9000: 3}


def test_greedy_and_masked_sums(spark):
    steps = spark.createDataFrame([(1, 5, 5), (1, 6, 6), (2, 5, 5), (2, 6, 7), (3, None, 1)], "item_id bigint, best int, wanted int")
    assert {r["item_id"]: r["exact"] for r in P.greedy_match(steps).collect()} == {1: True, 2: False, 3: False}
    t = spark.createDataFrame([(1, -1.0, 4), (1, -2.0, None), (2, -3.0, None)], "s int, logprob double, target int")
    assert {r["s"]: (r["logprob"], r["tokens"]) for r in P.sequence_logprobs(t, ["s"]).collect()} == {1: (-1.0, 1), 2: (0.0, 0)}


def test_continuation_splits_the_whole(spark):
    df = spark.createDataFrame([("the ca", "t sat"), ("", "x"), ("x", "")], "a string, b string")
    head, rest = P.continuation(lambda c: K.pretokenized(c, "gpt2"), F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(head, rest).collect()] == [(["the", " ca"], [" sat"]), ([], ["x"]), (["x"], [])]


def test_validation_follows_the_task(spark):
    """Any path in the dedup key, the term by its own field, and the schema's own fields."""
    import datetime as dt

    row = "row_id bigint, task string, seed_id string, instruction string, response string, meta struct<word: string, style: string, topic: string>, ingested_at timestamp"
    spec = "name string, dedup_key string, seed_term_field string, fields array<string>, meta_fields array<string>, quality struct<min_response_chars: int, max_response_chars: int, min_instruction_chars: int, max_instruction_chars: int, require_lang: string, forbid_refusals: boolean, require_seed_term_in_response: boolean>"
    q = (1, 500, 1, 500, None, True, True)
    specs = spark.createDataFrame([("a", "seed_id + style", "topic", None, ["topic"], q), ("b", "meta.topic+nowhere", None, ["instruction", "response", "seed_id"], [], q)], spec)
    at = dt.datetime(2025, 1, 1)
    rows = [
        (1, "a", "s1", "ask", "of tea", ("w", "x", "tea"), at), (2, "a", "s2", "ask", "of tea", ("w", "x", "tea"), at), (3, "a", "S1 ", "ask", "tea", (None, "X", "tea"), at), (4, "a", "s4", "ask", "w", ("w", "x", "tea"), at),
        (5, "a", "s5", "ask", "tea", ("w", "x", None), at), (6, "b", None, "ask", "w", ("w", "x", "t"), at), (7, "b", "s", "ask", "w", None, at), (8, "b", "s", None, "w", None, at),
    ]
    checked = G.validated(spark.createDataFrame(rows, row), specs)
    got = {r["row_id"]: (r["signature"], r["reason_code"]) for r in G.dedup_valid(checked).collect()}
    assert got == {
        1: ("s1||x", None), 2: ("s2||x", None), 3: ("s1||x", "duplicate"), 4: ("s4||x", "grounding"), 5: ("s5||x", "missing_meta"),
        6: ("t||none", "missing_field"), 7: ("none||none", None), 8: ("none||none", "missing_field"),
    }
    assert {r["row_id"]: r["reason"] for r in checked.collect()}[6] == "missing field 'seed_id'"


def test_task_of_a_schema():
    t = G.Task.from_dict({"name": "t", "schema": {"instruction": "s", "response": "s", "meta": {"topic": "s"}}})
    assert (t.fields, t.meta_fields) == (("instruction", "response"), ("topic",))
