from weftline.plans.suite import run_suite


def test_a_failing_query_leaves_the_others(spark, tmp_path):
    def bad(spark, d):
        raise ValueError(d)

    got = {r["name"]: r for r in run_suite(spark, "here", {"bad": bad, "good": lambda s, d: s.range(3)}, str(tmp_path)).collect()}
    assert got["bad"]["error"] == "ValueError: here" and got["bad"]["rows"] is None
    assert got["good"]["rows"] == 3 and got["good"]["error"] is None and spark.read.parquet(f"{tmp_path}/good").count() == 3
