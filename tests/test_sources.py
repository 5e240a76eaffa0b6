import json

from weftline.sources import files as S
from weftline.streaming import inbox as I


def test_whole_files_and_records(spark, tmp_path):
    (tmp_path / "a.b.txt").write_bytes(b"one\n \t\ntwo\r\n\r\nthr\xff")
    (tmp_path / "c.md").write_text("x")
    t = S.texts(spark, str(tmp_path))
    assert [(r["name"]) for r in t.collect()] == ["a.b"]
    assert [r["text"] for r in S.records(t).orderBy("pos").collect()] == ["one", "two", "thr�"]


def test_metrics_keep_their_line(spark, tmp_path):
    run = tmp_path / "run1"
    run.mkdir()
    (run / "metrics.jsonl").write_text('{"step": 0, "val_loss": 1.5}\n\n{"step": 5, "train_loss": NaN, "other": 1}\n')
    got = S.metrics(spark, str(tmp_path / "*" / "metrics.jsonl")).orderBy("line_no").collect()
    assert [(r["run_id"], r["line_no"], r["step"], r["val_loss"]) for r in got] == [("run1", 0, 0, 1.5), ("run1", 2, 5, None)]
    assert got[1]["train_loss"] != got[1]["train_loss"]


def test_registry_and_ledger(spark, tmp_path):
    (tmp_path / "r.csv").write_text("run_id,date,phase,tier,params_M,baseline_run,variable_changed,tokens_trained_M,final_val_loss,final_ppl,wall_hours,wandb_url,verdict\nx,2025-01-02,4,s,9.7,-,-,98.3,3.5,33.1,2.5,-,ok\n")
    r = S.registry(spark, str(tmp_path / "r.csv")).first()
    assert (str(r["date"]), r["baseline_run"], r["params_M"]) == ("2025-01-02", None, 9.7)
    df = spark.createDataFrame([("b", "1"), ("a", "2")], "batch_id string, valid string")
    S.write_ledger(df, str(tmp_path / "l"))
    assert [r["batch_id"] for r in spark.read.option("header", True).csv(str(tmp_path / "l")).collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "x int, side string")
    S.write_split(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "side=val").exists()
    S.append_rows(df, str(tmp_path / "a"))
    S.append_rows(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 4
    S.write_tokens(spark.createDataFrame([("s", 1, [1, 2, 3, 4])], "source string, doc_id bigint, ids array<int>"), str(tmp_path / "t"))
    assert S.token_slice(spark.read.parquet(str(tmp_path / "t")), 1, 1, 2).first()["ids"] == [2, 3]


def test_archive(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        for n in ("best.pt", "latest.pt"):
            (tmp_path / run / n).write_bytes(b"12345")
    f = S.file_sizes(spark, str(tmp_path), "*.pt")
    keep = S.archive_list(f, spark.createDataFrame([("b",)], "run string"))
    assert keep.count() == 3 and keep.agg({"bytes": "sum"}).first()[0] == 15


def reply(*rows):
    return "```json\n" + json.dumps([{"seed_id": "s", "instruction": i, "response": r, "meta": {"word": w, "style": "x"}} for i, r, w in rows]) + "\n```"


def test_ingest_takes_each_file_once_and_dedups_across_batches(spark, tmp_path):
    from tests.test_factory import spec

    box, out = tmp_path / "in", str(tmp_path / "out")
    box.mkdir()
    (box / "b1.txt").write_text(reply(("What is it?", "The cat is an animal.", "cat"), ("What is it?", "no", "dog")))
    run = lambda cp: I.ingest(I.replies(spark, str(box)), spec(spark), "t", out, str(tmp_path / cp)).awaitTermination()
    run("cp")
    (box / "b2.txt").write_text(reply(("Tell me now?", "A cat is the animal.", "Cat")))
    (box / "b3.txt").write_text("nothing here")
    run("cp")
    assert spark.read.parquet(f"{out}/valid").count() == 1
    assert sorted(r["reason_code"] for r in spark.read.parquet(f"{out}/invalid").collect()) == ["duplicate", "response_length"]
    assert {(r["batch_id"], r["valid"], r["invalid"]) for r in spark.read.parquet(f"{out}/ledger").collect()} == {("b1", "1", "1"), ("b2", "0", "1"), ("b3", "0", "all")}


def test_failing_prompt_leaves_the_others(spark):
    def backend(p):
        if p == "bad":
            raise ValueError("no")
        return p.upper()

    got = {r["batch_id"]: (r["ok"], r["reply"], r["detail"]) for r in I.generate(spark.createDataFrame([("1", "x"), ("2", "bad")], "batch_id string, prompt string"), backend).collect()}
    assert got == {"1": (True, "X", None), "2": (False, None, "ValueError: no")}


def test_backends(spark):
    import pytest

    with pytest.raises(ValueError, match="unknown backend"):
        I.backend_of("nobody")
    prompt = "Write.\nStyle: formal\nItems (2):\n[s1] cat: an animal\n[s2] dog: another"
    r = I.generate(spark.createDataFrame([("b", prompt)], "batch_id string, prompt string"), I.backend_of("mock")).first()
    assert r["ok"] and [x["seed_id"] for x in json.loads(r["reply"])] == ["s1", "s2"]


def test_ordered_files_by_split(spark, tmp_path):
    for path, text in (("books/b.txt", "B"), ("books/a.txt", "A"), ("dict.txt", "D"), ("val/books/v.txt", "V"), ("other.txt", "O")):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = lambda split: [r["text"] for r in S.ordered_texts(spark, str(tmp_path), split, ["books", "absent"], ["dict.txt"]).orderBy("place").collect()]
    assert (got("train"), got("val"), got("test")) == (["A", "B", "D"], ["V"], [])


def test_texts_as_text_and_routing(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" Held Book", "books", "x\ny"), ("other", "books", "z"), ("other", "books", None)], "book string, category string, text string")
    S.write_texts(df.withColumn("split", S.split_of(F.col("book"), ["held book"])), str(tmp_path / "t"))
    read = lambda split: "".join(p.read_text() for p in (tmp_path / "t" / f"split={split}" / "category=books").glob("*.txt"))
    assert (read("val"), read("train")) == ("x\ny\n\n", "z\n\n")


def test_registry_takes_a_run_once(spark, tmp_path):
    runs = spark.createDataFrame([("a", 3.5), ("b", None)], "run_id string, final_val_loss double")
    path = str(tmp_path / "registry")
    assert S.append_registry(spark, runs.where("run_id = 'a'"), path) == 1
    assert S.append_registry(spark, runs, path) == 1 and S.append_registry(spark, runs, path) == 0
    assert {r["run_id"]: (r["final_val_loss"], r["verdict"]) for r in S.registry(spark, path).collect()} == {"a": (3.5, None), "b": (None, None)}


def test_tokens_are_added_once_and_verified(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftline.operators import tokenizer as K

    docs = spark.createDataFrame([(1, "s", "abc"), (2, "s", "xyz")], "doc_id bigint, source string, text string")
    ids = K.encode_documents(docs, []).join(docs.select("doc_id", "source"), "doc_id")
    path = str(tmp_path / "tokens")
    assert S.append_tokens(spark, ids.where("doc_id = 1"), path) == 1 and S.append_tokens(spark, ids, path) == 1 and S.append_tokens(spark, ids, path) == 0
    back = spark.read.parquet(path)
    assert back.count() == 2
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 2, "xxz").otherwise(F.col("text")))
    assert {r["doc_id"]: r["same"] for r in S.verify_slices(back, changed, lambda c: K.decode(c, []), 2).collect()} == {1: True, 2: False}


def test_documents_specs_and_tables(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": 1,\n "b": {"c": "x"}}')
    assert S.json_document(spark, str(tmp_path / "d.json")).first()["b"]["c"] == "x"
    long = spark.createDataFrame([("k", "x", 1), ("k", "y", 2), ("m", "x", 3)], "key string, name string, value int")
    assert {tuple(r) for r in S.long_to_wide(long, "key", "name", "value", ["x", "y"]).collect()} == {("k", 1, 2), ("m", 3, None)}
    try:
        import yaml  # noqa: F401
    except ImportError:
        return
    (tmp_path / "t.yaml").write_text("name: t\ntarget_count: 5\nstyle_axes: [a, b]\nquality: {min_response_chars: 3}\n")
    r = S.task_specs(spark, str(tmp_path)).first()
    assert (r["name"], r["style_axes"], r["quality"]["min_response_chars"]) == ("t", ["a", "b"], 3)


def test_streams(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text('{"run_id": "r", "step": 1}\n{"run_id": "r", "step": 1}\n{"run_id": "r", "step": 2}\n')
    first = I.first_seen(I.log_tail(spark, str(tmp_path / "logs")), ["run_id", "step"])
    first.writeStream.format("memory").queryName("first_steps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("first_steps").count() == 2
