import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.operators import chat as H
from weftline.operators import factory as G

SPEC = "name string, dedup_key string, seed_term_field string, quality struct<min_response_chars: int, max_response_chars: int, min_instruction_chars: int, max_instruction_chars: int, require_lang: string, forbid_refusals: boolean, require_seed_term_in_response: boolean>"
ROW = "row_id bigint, task string, instruction string, response string, meta struct<word: string, style: string>, ingested_at timestamp"


def spec(spark):
    return spark.createDataFrame([("t", "meta.word + style", "word", (10, 50, 5, 30, "en", True, True))], SPEC)


def row(i, instruction="What is it?", response="The cat is an animal.", word="cat", style="formal"):
    return (i, "t", instruction, response, (word, style), dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i))


def codes(spark, *rows):
    out = G.validated(spark.createDataFrame(list(rows), ROW), spec(spark))
    return {r["row_id"]: r["reason_code"] for r in out.collect()}


def test_reasons_in_order(spark):
    got = codes(
        spark, row(0), row(1, instruction=None), row(2, response=None), row(3, word=""), row(4, style=None), row(5, instruction="Hm"), row(6, response="  cat  "),
        row(7, response="I cannot say what a cat is."), row(8, response="This is an animal at home."), row(9, response="Die Katze und der cat ist nicht da."), row(10, response="x" * 60),
    )
    assert got == {0: None, 1: "missing_field", 2: "missing_field", 3: "missing_meta", 4: "missing_meta", 5: "instruction_length", 6: "response_length", 7: "refusal", 8: "grounding", 9: "language", 10: "response_length"}


def test_missing_value_is_none_in_the_signature(spark):
    df = spark.createDataFrame([(None, "A "), (None, "a")], "x string, y string").select(G.signature([F.col("x"), F.col("y")]).alias("s"))
    assert {r["s"] for r in df.collect()} == {"none||a"}


def test_dedup_keeps_the_first_and_knows_history(spark):
    checked = G.validated(spark.createDataFrame([row(2), row(1), row(3, word="Cat "), row(4, word="dog", response="The dog is an animal.")], ROW), spec(spark))
    assert {r["row_id"]: r["reason_code"] for r in G.dedup_valid(checked).collect()} == {1: None, 2: "duplicate", 3: "duplicate", 4: None}
    old = spark.createDataFrame([("t", "dog||formal")], "task string, signature string")
    assert {r["row_id"] for r in G.dedup_valid(checked, old).where("reason_code = 'duplicate'").collect()} == {2, 3, 4}
    assert G.dedup_valid(checked.where("false")).count() == 0


@pytest.mark.parametrize(
    ("reply", "objects"),
    [
        ('[{"a": 1}]', 1),
        ('Sure:\n```json\n[{"a": 1}, 2, {"a": 3},]\n```\nBye', 2),
        ("[▁{“a”: 1}]", 1),
        ('{"a": 1}', 0),
        ("I'm sorry.", 0),
        ("] [", 0),
        (None, 0),
    ],
)
def test_replies(spark, reply, objects):
    got = G.parse_replies(spark.createDataFrame([("b", reply)], "batch_id string, reply string")).collect()
    assert sum(r["ok"] for r in got) == objects
    assert len(got) == max(1, objects)


def test_ledger_keeps_last_value_that_is_not_empty(spark):
    cols = "ledger_seq bigint, batch_id string, " + ", ".join(f"{c} string" for c in G.LEDGER)
    log = spark.createDataFrame([(1, "b", *["x"] * 10), (2, "b", "", None, *["y"] * 8)], cols)
    r = G.ledger_state(log).first()
    assert (r["task"], r["style"], r["backend"], r["invalid"]) == ("x", "x", "y", "y")


MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def test_render_and_mask_agree(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 2, "assistant", "Hello there."), (1, 1, "user", "Hi")], MESSAGES)
    r = H.render(m).first()
    assert (r["chat"], r["dropped_turns"]) == ("<|user|>Hi<|assistant|>Hello there.<|endoftext|>", 1)
    e = H.masked(m).first()
    assert e["tokens"] == ["<|user|>", "Hi", "<|assistant|>", "Hello", "there.", "<|endoftext|>"]
    assert e["mask"] == [0, 0, 0, 1, 1, 1]


def test_truncation_drops_what_has_nothing_to_learn(spark):
    m = spark.createDataFrame([(1, 0, "user", "a b c d"), (1, 1, "assistant", "e"), (2, 0, "user", "a"), (2, 1, "assistant", "b c")], MESSAGES)
    assert [r["conv_id"] for r in H.truncated(H.masked(m), 5).collect()] == [2]


def test_collate_pads_and_masks(spark):
    e = spark.createDataFrame([(0, ["u", "a", "b"], [0, 0, 1]), (0, ["u", "a", "b", "c"], [0, 1, 1, 1])], "batch_no bigint, tokens array<string>, mask array<int>")
    got = sorted((tuple(r["x"]), tuple(r["y"])) for r in H.collated(e, ["batch_no"], pad="_").collect())
    assert got == [(("u", "a", "_"), (None, "b", None)), (("u", "a", "b"), ("a", "b", "c"))]


def test_preference_pairs(spark):
    chosen = spark.createDataFrame([("s", 1, "i", "old", "w"), ("s", 2, "i", "Good", "w")], "seed_id string, line_no bigint, instruction string, response string, word string")
    rejected = spark.createDataFrame([(1, "s", " good ", "x"), (2, "s", "bad", None), (3, "z", "bad", "x")], "row_id bigint, seed_id string, response string, style string")
    kept, counts = H.preference_pairs(chosen, rejected)
    assert [(r["row_id"], r["chosen"], r["failure_mode"]) for r in kept.collect()] == [(2, "Good", "?")]
    assert {r["state"]: r["n"] for r in counts.collect()} == {"kept": 1, "identical": 1, "unmatched": 1}


def test_percentile_is_an_element(spark):
    r = H.element_percentile(spark.range(1, 101).withColumnRenamed("id", "x"), "x", [0.5, 0.99]).first()
    assert (r["p50"], r["p99"], r["largest"]) == (51, 100, 100)


def test_whole_queries_lose_no_tokens(spark, tmp_path):
    """One seed with five long rows and one pair of long sides: nothing behind the first 24, 48 or 64 words is lost."""
    from weftline.plans import factory as P

    at, long = dt.datetime(2025, 1, 1), " ".join(f"w{i}" for i in range(100))
    rows = [(i, "sft_dictionary_qa", "s", "Ask me", long, ("w", "x"), at) for i in range(4)] + [(9, "dpo_dictionary_pairs", "s", "Ask me", long + " more", ("w", "x"), at)]
    spark.createDataFrame(rows, "row_id bigint, task string, seed_id string, instruction string, response string, meta struct<word: string, style: string>, ingested_at timestamp").write.parquet(f"{tmp_path}/generated_rows.parquet")
    r = P.QUERIES["sft_examples"](spark, str(tmp_path)).first()
    assert (r["length"], r["supervised"]) == (5 * (2 + 100 + 3) + 1, 5 * 101 + 1)
    assert P.QUERIES["sft_batches"](spark, str(tmp_path)).first()["width"] == 5 * 105
    r = P.QUERIES["preference_examples"](spark, str(tmp_path)).first()
    assert (r["shared_prefix"], r["chosen_length"], r["rejected_length"]) == (4, 105, 106)


def test_replies_with_escapes_come_through(spark, tmp_path):
    from weftline.plans import factory as P

    asks = {1: r"C:\temp\new", 2: r"\frac{1}{2} and \alpha", 3: 'say "hi"\n\tnow', 4: None, 5: "\\", 6: "plain"}
    spark.createDataFrame(list(asks.items()), "row_id bigint, instruction string").write.parquet(f"{tmp_path}/generated_rows.parquet")
    got = {r["batch_id"]: (r["row_id"], r["instruction"], r["ok"]) for r in P.QUERIES["reply_parse"](spark, str(tmp_path)).collect()}
    assert got == {str(i): (None, None, False) if i == 5 else (i, a, True) for i, a in asks.items()}
