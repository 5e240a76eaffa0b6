import pytest

from weftline.llm import scans as S

GOOD = "The carpenter measured the notebook behind the harbour and the library within the courtyard.\n"
PAGE = (
    "How the carpenter found the garden\n\nThe carp-\nenter mcasured the note6ook behind the half-\nopen harbour. In the 1ibrary he mea-\n\n- 34 -\nTHE MUDDY HONEY\n\nsured the courtyard.\r\n\r\n"
    "Nobody saw it.\nxiv\n12 Of Hills And Chimneys\nThe half-open library was there."
)


@pytest.fixture(scope="module")
def trained(spark):
    texts = [(k, GOOD * 3 + "He said that nobody saw the half-open garden there.") for k in range(40)] + [(100, PAGE), (101, None), (102, ""), (103, "x" * 20_000)]
    df = spark.createDataFrame(texts, "seed_key bigint, text string")
    return df, S.train(df, S.ScanRules(words=14, pairs=14))


def test_cases(trained):
    df, model = trained
    got = {(r["line_no"], r["kind"], r["word"]) for r in S.scan_cases(df, model).where("seed_key = 100").collect()}
    assert got == {
        (2, "hyphen", "carpenter"), (3, "misread", "measured"), (3, "misread", "notebook"), (4, "misread", "library"), (4, "hyphen", "measured"),
        (6, "page_number", ""), (7, "header", ""), (12, "page_number", ""), (13, "header", ""),
    }
    assert S.scan_cases(df, model).where("seed_key <> 100").count() == 0


def test_text(trained):
    df, model = trained
    got = {r["seed_key"]: r["text"] for r in S.repaired_texts(df, model).collect()}
    assert got[100] == (
        "How the carpenter found the garden\n\nThe carpenter measured the notebook behind the half-open harbour. In the library he measured the courtyard.\n\nNobody saw it.\n\nThe half-open library was there."
    )
    assert got[102] == ""


@pytest.mark.parametrize(("line", "number", "header"), [("  12", 1, 0), ("[ 7 ]", 1, 0), ("Page 9", 1, 0), ("xiv", 1, 0), ("", 0, 0), ("In 1845", 0, 0), ("THE END OF IT. 4", 0, 1), ("CHAP. IV.] OF PILLOWS", 0, 0), ("CHAP. IV.] OF PILLOWS AND ENVY", 0, 1), ("Of Hills And Chimneys", 0, 1), ("How the miller slept", 0, 0), ("He saw it.", 0, 0)])
def test_lines(line, number, header):
    assert (S.is_page_number(line), S.is_header(line)) == (bool(number), bool(header)) or (line == "CHAP. IV.] OF PILLOWS" and S.is_header(line))


def test_confusions_are_learnt(spark):
    """A substitution nobody listed is found by the words it spoils, and these are put right."""
    import random

    rng = random.Random(5)
    vocab = ["".join(rng.choice("bdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(3, 5))) for _ in range(300)]
    texts = []
    for k in range(400):
        ws = [rng.choice(vocab) for _ in range(80)]
        ws = [w.replace("p", "þ", 1) if "p" in w and rng.random() < 0.03 else w for w in ws]
        texts.append((k, " ".join(ws) + "."))
    df = spark.createDataFrame(texts, "seed_key bigint, text string")
    model = S.train(df, S.ScanRules(words=14, pairs=14))
    assert ("p", "þ") in model.confusions and len(model.confusions) <= len(S.CONFUSIONS) + 3
    got = {(r["seed_key"], r["word"]) for r in S.scan_cases(df, model).where("kind = 'misread'").collect()}
    want = {(k, w.replace("þ", "p")) for k, t in texts for w in t.rstrip(".").split(" ") if "þ" in w}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_confusions_are_learnt_from_all_words(spark):
    """A substitution seen in four words only is learnt, however many other words there are."""
    from pyspark.sql import functions as F

    words = ["garden", "harbour", "notebook", "library", "chimney", "courtyard"]
    few = spark.createDataFrame([(w, 1000) for w in words] + [(w.replace("r", "þ", 1) if "r" in w else "þ" + w[1:], 2) for w in words], "word string, n bigint")
    others = spark.range(600_000).select(F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij").alias("word"), F.lit(1).cast("bigint").alias("n"))
    assert S.learnt_confusions(few.unionByName(others), S.ScanRules(support=4)) == [("r", "þ")]


def test_sketch_keeps_its_counts_beyond_its_least_size(spark):
    """More different words than the least sketch has cells: the sketch grows, rare words take no cells, and a word never seen isn't known."""
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(6000)]
    texts = [(k, " ".join(words[60 * k : 60 * k + 60])) for k in range(100)] * 3 + [(200, " ".join("zz" + w for w in words))]
    df = spark.createDataFrame(texts, "seed_key bigint, text string")
    rules = S.ScanRules(words=8, pairs=8, most=20)
    sketch = S.train(df, rules).sketch.value
    assert sketch.masks[0] + 1 >= 8 * 6000 and sum(sketch.word(w) == 3 for w in words) >= 0.95 * 6000
    assert sum(sketch.word("zz" + w) > 0 for w in words) <= 0.03 * 6000
