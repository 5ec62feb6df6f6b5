import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import language
from tests.llm.helpers import docs

SYLLABLES = {"aa": ["tion", "the", "er", "ing"], "bb": ["ção", "nho", "lh", "os"], "cc": ["sch", "ung", "ei", "ß"]}


def rows(n=400, seed=3):
    rng = random.Random(seed)
    made = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([2, 20, 200])))
        made.append((k, text, lang))
    return made


def test_held_out_accuracy_and_columns(spark):
    given = rows()
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", None), (None, "the tion ering", "aa"), (5, given[5][1], given[5][2]), (1003, "schung " * 20_000, None)]
    df = docs(spark, given + odd).withColumns({c: F.lit("x") for c in ("label", "draw", "score", "held_out")})
    found = language.report(df).collect()
    assert len(found) == len(given) + len(odd)
    by_id = {r["doc_id"]: r for r in found}
    held = [g for g in given if zlib.crc32(str(g[0]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in found if r["held_out"]} >= {g[0] for g in held}
    assert all(by_id[g[0]]["held_out"] for g in held)
    assert sum(by_id[g[0]]["lang_pred"] == g[2] for g in held) >= 0.97 * len(held)
    for doc in (1000, 1001, 1002):
        assert (by_id[doc]["lang_pred"], by_id[doc]["score"]) == ("und", 0.0)
    assert by_id[1003]["lang_pred"] == "cc"
    assert by_id[None]["lang_pred"] == "aa" and not by_id[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in found)


def test_number_letters_are_no_letters(spark):
    given = rows(60) + [(700, "½ ² Ⅷ ①"), (701, "12 ½"), (702, "漢字 ½")]
    found = {r["doc_id"]: r for r in language.report(docs(spark, given)).collect()}
    assert [(found[n]["lang_pred"], found[n]["score"]) for n in (700, 701)] == [("und", 0.0)] * 2
    assert found[702]["lang_pred"] != "und"


def test_scorer_is_the_plain_sum_over_ngrams(spark):
    given = rows(150)
    model = language.train(docs(spark, given))
    texts = [t for _, t, _ in given[:40]] + ["Schung ½ the", "ç"]
    labels, scores, _ = language.Scorer(model)(texts)
    for text, label, score in zip(texts, labels, scores):
        total, count = np.zeros(len(model.labels)), 0
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            marked = f"<{word}>"
            for n in range(1, language.GRAMS + 1):
                for at in range(len(marked) - n + 1):
                    h = 0
                    for k in range(n):
                        h = (h * 0x100000001B3 + ord(marked[at + k]) + k + 1) % 2**64
                    total += model.scores[(h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - language.BUCKET_BITS)]
                    count += 1
        z = (total / count + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert label == model.labels[int(p.argmax())] and abs(score - p.max()) < 1e-6


def test_a_rare_label_keeps_its_rows(spark):
    """With very many labels a global cut would drop rare ones: each keeps its own rows."""
    given = [(n, f"word{chr(97 + n % 26)} " * 3, f"l{n % 150:03d}") for n in range(1500)] + [(9000, "zzz zzz", "rare")]
    model = language.train(docs(spark, given), sample_rows=300)
    assert len(model.labels) == 151


def test_prediction_depends_on_the_text_only(spark):
    given = rows(120)
    model = language.train(docs(spark, given))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identified(docs(spark, given), model).collect()}
    shuffled = [(900 - d, t, None) for d, t, _ in given]
    b = {900 - r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identified(docs(spark, shuffled), model).collect()}
    assert a == b


def test_rejection_keeps_clean_documents(spark):
    given = rows(300) + [(2000, None), (2001, "12345"), (2002, "漢字仮名 漢字仮名")]
    df = docs(spark, given)
    kept = language.accepted(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {g[0] for g in given[:300]}
    assert 2000 not in ids and 2001 not in ids


def test_nothing_to_learn_from(spark):
    assert language.train(docs(spark, [(1, "text"), (2, None, "aa"), (None, "text", "aa")])) is None
    assert [r["lang_pred"] for r in language.report(docs(spark, [(1, "text")])).collect()] == ["und"]
    assert language.report(docs(spark, [])).count() == 0
    assert language.accepted(docs(spark, [])).count() == 0


def test_subwords_stay_inside_words():
    buckets, sizes = language.subwords(["ab", "c"])
    alone = [language.subwords([w])[0].tolist() for w in ("ab", "c")]
    assert sizes.tolist() == [4 + 3 + 2 + 1, 3 + 2 + 1]
    assert buckets.tolist() == alone[0] + alone[1]


def test_unseen_scripts_and_junk_are_rejected(spark):
    rng = random.Random(9)

    def made(letters, n):
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))

    odd = {(script, n): made(letters, n) for script, letters in (("greek", "αβγδεζηθικλμνξοπρστυφχψω"), ("han", "漢字仮名交文日本語書"), ("junk", "qxzvkwjy")) for n in (3, 20, 200)}
    given = rows(400)
    df = docs(spark, given + [(2000 + k, text) for k, text in enumerate(odd.values())])
    ids = {r["doc_id"] for r in language.accepted(df).collect()}
    assert ids == {g[0] for g in given}


def test_tail_lies_below_the_lowest_of_few_values():
    values = np.random.default_rng(1).exponential(size=(200, 300))
    # a share exp(x) of the negated values lies below x
    assert 0 < np.mean([np.exp(language.tail(-v)) for v in values]) <= language.LOSS
    assert np.mean([np.exp((-v).min()) for v in values]) > language.LOSS
    assert language.tail(np.array([0.0] * 50)) == 0 and language.tail(np.array([1.0])) == -np.inf
