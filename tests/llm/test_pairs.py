import pytest

from weftline.llm import pairs as P

ROW = "row_id bigint, task string, instruction string, response string, meta struct<word: string>"
SPEC = "name string, quality struct<min_response_chars: int, require_lang: string, forbid_refusals: boolean>"
NOUNS = "wall roof garden bottle window kitchen ladder candle basket table".split()
ASK = ["What does '{}' mean?", "Could you define {} for me, please?", "Tell me about the history of the word {}."]


@pytest.fixture(scope="module")
def judged(spark):
    rows = []
    for k in range(400):
        w, n, m = f"zor{k}lin", NOUNS[k % 10], NOUNS[(k * 7 + 3) % 10]
        rows.append((k, "en", ASK[k % 3].format(w), f"The word {w} stands for a {n} that was found in the {m}. It is used with the {n} and the {m} of the house.", (w,)))
        rows.append((1000 + k, "any", ASK[k % 3].format(w), f"Das Wort {w} steht für die Tür und das Haus. Die Frau war in der Stadt, und das Kind war nicht da.", (w,)))
    extra = [
        ("empty", None), ("empty", "​  "), ("empty", "N/A"), ("empty", "Too short."), ("truncated", "The word zorlin stands for a wall that was found in the"),
        ("refusal", "I'm sorry, but I cannot help with that."), ("copy", "WHAT DOES 'ZORLIN' MEAN?"), ("language", "Das Wort zorlin steht für die Tür und das Haus. Die Frau war in der Stadt, und das Kind war nicht da."),
        (None, "Zorlin can mean:\n- a wall that was found in the garden\n- a roof of the house"), (None, 'The miller said "I cannot help you" and showed me a wall of the house; that is called zorlin.'),
        (None, "The word zorlin stands for a wall that was found in the garden. " * 400),
    ]
    rows += [(5000 + k, "en", "What does 'zorlin' mean?", r, ("zorlin",)) for k, (_, r) in enumerate(extra)]
    rows += [(6000, "any", "What does 'zorlin' mean?", "I'm sorry, but I cannot help with that.", ("zorlin",)), (6001, None, None, "A wall of the house was there.", None), (6002, "unknown", None, None, None)]
    specs = spark.createDataFrame([("en", (15, "en", True)), ("any", (15, None, False))], SPEC)
    got = {r["row_id"]: r["defect"] for r in P.broken_pairs(spark.createDataFrame(rows, ROW), specs).collect()}
    return got, extra


def test_cases(judged):
    got, extra = judged
    assert [got.get(5000 + k) for k in range(len(extra))] == [d for d, _ in extra]


def test_sound_rows_and_other_tasks(judged):
    got, _ = judged
    assert sum(k < 5000 for k in got) == 0
    assert got.get(6000) is None and got.get(6001) is None and got[6002] == "empty"


def test_viterbi_is_the_best_sequence():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    f = P.ClauseField({"a": 1, "b": 2, "c": 3}, rng.normal(size=(4, 5)), rng.normal(size=(5, 5)))
    rows = [[["a"], ["b", "c"], []], [["c"]], [["b"], ["a"], ["a", "c"], ["b"]]]
    for row, tags in zip(rows, f.tag(rows), strict=True):
        emit = [f.weights[[0, *(f.vocabulary[x] for x in c)]].sum(0) for c in row]
        score = lambda t: sum(e[k] for e, k in zip(emit, t)) + sum(f.moves[a, b] for a, b in zip(t, t[1:]))
        assert tuple(tags) == max(itertools.product(range(5), repeat=len(row)), key=score)


def test_held_out_accuracy():
    """Fitted on one half of made examples, right on the other."""
    rows = []
    for k in range(300):
        n, m = NOUNS[k % 10], NOUNS[(k * 3 + 1) % 10]
        rows.append({"instruction": ASK[k % 3].format(f"zor{k}"), "response": f"The word zor{k} stands for a {n} that was in the {m}. It is the {n} of the house.", "want": "en", "word": f"zor{k}"})
    xs, ys = P.make_examples(rows, 3)
    f = P.ClauseField.fit(xs[::2], ys[::2], 80)
    hits = [t == g for tags, gold in zip(f.tag(xs[1::2]), ys[1::2], strict=True) for t, g in zip(tags, gold, strict=True)]
    assert sum(hits) / len(hits) > 0.97


def made_rows(n=400):
    rows = []
    for k in range(n):
        a, b = NOUNS[k % 10], NOUNS[(k * 3 + 1) % 10]
        rows.append({"instruction": ASK[k % 3].format(f"zor{k}"), "response": f"The word zor{k} stands for a {a} that was in the {b}. It is the {a} of the house.", "want": "en", "word": f"zor{k}"})
    return rows


def test_refusals_in_wordings_never_seen():
    """Fitted without a third of the wordings, most of these are still told from answers."""
    hits = n = 0
    for part in range(3):
        seen = {"en": tuple(x for k, x in enumerate(P.REFUSALS["en"]) if k % 3 != part)}
        left = [x for k, x in enumerate(P.REFUSALS["en"]) if k % 3 == part]
        f = P.ClauseField.fit(*P.make_examples(made_rows(), 3, None, seen), 80)
        texts = [x.replace("{w}", "zor9999") for x in left]
        tagged = f.tag([P.features(t, P.words(ASK[0].format("zor9999")), "en")[0] for t in texts])
        hits += sum((t == P.REFUSAL).all() for t in tagged)
        n += len(left)
        sound = f.tag([P.features(r["response"].replace("zor", "mar"), P.words(r["instruction"]), "en")[0] for r in made_rows(50)])
        assert not any((t == P.REFUSAL).any() for t in sound)
    assert hits >= 0.7 * n


def test_language_without_function_words():
    import random

    rng = random.Random(1)
    kinds = {
        "en": ("the of and which was with".split(), "weather kitchen knowledge thought through window shepherd bright breath church".split()),
        "de": ("der und das nicht mit für".split(), "Wetter Küche Schlüssel Geschichte Nachbarschaft Fenster Schäfer zwischen Kirche Brötchen".split()),
        "fr": ("le et une dans pour avec".split(), "cuisine fenêtre rivière couturière bergère muraille chambre lointaine fatiguée prairie".split()),
    }
    train = [" ".join(rng.choice(f) + " " + rng.choice(w) for _ in range(8)) + "." for f, w in kinds.values() for _ in range(60)]
    model = P.Languages.fit(train)
    assert model.names == ["de", "en", "fr"]
    for lang, (_, ws) in kinds.items():
        texts = [" ".join(rng.sample(ws, 5)).capitalize() + "." for _ in range(20)]
        assert all(not any(v for v in P.language_scores(P.words(t)).values()) for t in texts[:1])
        assert all(m.startswith("gram:own") for m in model.marks(texts, [lang] * 20))
        assert all(m.startswith("gram:other") for m in model.marks(texts, ["en" if lang != "en" else "de"] * 20))
    assert model.marks(["", "x"], ["en", None])[1] is None and P.Languages.fit([]).marks(["x"], ["en"]) == [None]
