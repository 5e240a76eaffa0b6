from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import corpus as C
from weftline.operators import dictionary as D

DOCS = "doc_id bigint, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_crlf_paragraphs_are_deduped_only_when_unified(spark):
    d = docs(spark, "A\r\n\r\na\r\n\r\nB")
    r = C.rebuild(C.dedup_paragraphs(C.clean(d))).first()
    assert (r["text"], r["kept"], r["dropped"]) == ("A\n\nB", 2, 1)
    assert C.dedup_paragraphs(C.clean(d, newline="preserve")).count() == 1


def test_blank_line_with_a_space_does_not_part(spark):
    assert C.paragraphs(docs(spark, "A\n \nB")).count() == 1


def test_nulls_and_blank_texts(spark):
    d = docs(spark, None, "", " \n\n ", "x")
    assert C.paragraphs(d).count() == 1
    assert [r["text"] for r in C.clean(d).orderBy("doc_id").collect()] == [None, "", "", "x"]
    assert C.paragraphs(docs(spark).where("false")).count() == 0


def test_dedup_again_changes_nothing(spark):
    once = C.rebuild(C.dedup_paragraphs(docs(spark, "a\n\nb\n\nA\n\nc\n\nb")))
    twice = C.rebuild(C.dedup_paragraphs(once.select("doc_id", "text")))
    assert once.first()["text"] == twice.first()["text"] == "a\n\nb\n\nc"


def test_words_split_at_unicode_blanks(spark):
    assert docs(spark, "a b c").select(X.n_words(F.col("text"))).first()[0] == 3


def test_running_sum_does_not_depend_on_ranges(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    got = [{(r["id"], r["s"]) for r in C.running_before(df, F.col("id"), ["id"], ["g"], "s", ranges=k).collect()} for k in (1, 7)]
    want = {(i, sum(j for j in range(i) if j % 3 == i % 3)) for i in range(100)}
    assert got[0] == got[1] == want


def test_cut_rounds_half_to_even(spark):
    for n, percent, train in ((10, 85, 8), (30, 95, 28), (10, 95, 10)):
        assert C.seeded_cut(spark.range(n).withColumnRenamed("id", "k"), ["k"], percent, 1).where("side = 'train'").count() == train


def test_holdouts_leak_or_not(spark):
    e = spark.createDataFrame([(i, "set" if i % 2 else f"w{i}") for i in range(40)], "entry_id bigint, word string")
    sides = {r["side"] for r in C.holdout_by_word(e, 0.5, 3).where("word = 'set'").collect()}
    assert sides == {"train", "val"}
    by_key = C.holdout_by_key(e, 0.5, 3)
    assert by_key.groupBy("word").agg(F.countDistinct("side").alias("n")).where("n > 1").count() == 0


def test_entries(spark):
    html = "<p><ent></ent><hw>Ab*a`</hw><pos>n.</pos><def>one <i>two</i></def><def> </def></p><p><ent>x</ent></p><p>none</p>"
    r = D.parse_entries(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id bigint, html string")).collect()
    assert [(x["word"], x["part_of_speech"], x["definitions"]) for x in r] == [("Aba", "n.", ["one two"])]


def test_real_words(spark):
    ws = ["aardvark", "first-class", "1", "10", "1-dodecanol", "1st-class", "ab"]
    d = spark.createDataFrame([(w,) for w in ws], "w string")
    assert [r["w"] for r in d.where(X.is_real_word(F.col("w"))).collect()] == ["aardvark", "first-class"]


def test_banners(spark):
    t = "x *** START OF THE PROJECT GUTENBERG EBOOK A ***\nbody\n*** END OF THIS PROJECT GUTENBERG EBOOK A *** y"
    assert docs(spark, t).select(X.strip_banners(F.col("text"))).first()[0] == "body"


def test_sentences(spark):
    got = docs(spark, "one two three four five six seven eight. Short one. And the last of them\nis a sentence of words!").select(X.sentences(F.col("text"))).first()[0]
    assert got == ["one two three four five six seven eight.", "And the last of them is a sentence of words!"]
