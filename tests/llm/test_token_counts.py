import random

import pytest
from pyspark.sql import functions as F

from panelweave.llm import token_counts
from panelweave.llm.bpe import BytePairs
from panelweave.llm.queries import vocabulary_path
from tests.llm.helpers import corpus, docs

EDITS = "doc_id bigint, seq bigint, start bigint, length bigint, replacement string"
PIECES = ["a", "b", "'s", "'ll", " ", "  ", "\n", "é", "12", "<|endoftext|>", "<|endof", "text|>", "!", "|", ">", "<", "the", " of", "\t", "漢"]


@pytest.fixture(scope="module")
def pairs():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return BytePairs(f.read())


def count(pairs, text):
    return sum(pairs.counts(pairs.pretokens(text)))


def edited(text, start, length, new):
    start = max(0, min(start, len(text)))
    return text[:start] + new + text[start + max(0, length) :]


def test_edits_keep_text_and_count(pairs):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 5, 40, 600])))
        counted = token_counts.CountedText(text, pairs)
        for _ in range(rng.choice([1, 3, 12])):
            edit = rng.randint(-1, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 30]), "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 0, 1, 2, 4])))
            counted.replace(*edit)
            text = edited(text, *edit)
            assert (counted.text(), counted.tokens, counted.chars) == (text, count(pairs, text), len(text))


def test_many_edits_encode_little_and_stay_balanced(pairs):
    rng = random.Random(2)
    text = " ".join(f"word{n}" for n in range(4000))
    counted = token_counts.CountedText(text, pairs)
    for _ in range(600):
        edit = rng.randrange(len(text)), 3, "xy z"
        counted.replace(*edit)
        text = edited(text, *edit)
    assert counted.tokens == count(pairs, text)
    assert counted.encoded < 600 * 120
    assert token_counts._depth(counted.tree) < 60


def test_table(spark, pairs):
    rows = [(d, t) for d, t in corpus() if d != 7]
    rng = random.Random(3)
    edits = [(d, s, rng.randrange(300), rng.randrange(9), rng.choice(["", " new", "<|endoftext|>", None])) for d, _ in rows if d is not None for s in range(3)]
    edits += [(9999, 1, 0, 1, "x"), (None, 1, 0, 1, "x"), (1, None, None, None, "first "), (1, 5, 0, 0, "tie b"), (1, 5, 0, 0, "tie a")]
    rng.shuffle(edits)
    df = docs(spark, rows).withColumns({c: F.lit(5) for c in ("seq", "start", "body", "kind")})
    found = {r["doc_id"]: r for r in token_counts.recounted(df, spark.createDataFrame(edits, EDITS), vocabulary_path()).collect()}
    assert len(found) == len({d for d, _ in rows})
    for doc, text in rows:
        text = text or ""
        mine = sorted(((s or 0, a or 0, n or 0, new or "") for d, s, a, n, new in edits if d == doc and d is not None))
        after = text
        for _, a, n, new in mine:
            after = edited(after, a, n, new)
        r = found[doc]
        assert (r["n_edits"], r["tokens_before"], r["tokens_after"], r["chars_after"]) == (len(mine), count(pairs, text), count(pairs, after), len(after))


def test_repeated_keys_and_empty_tables(spark):
    rows = [(1, "b b"), (1, "a"), (1, "b b"), (2, None)]
    edits = spark.createDataFrame([(1, 1, 0, 0, "x ")], EDITS)
    found = sorted((r["doc_id"], r["n_edits"], r["chars_after"]) for r in token_counts.recounted(docs(spark, rows), edits, vocabulary_path()).collect())
    assert found == [(1, 0, 1), (1, 0, 3), (1, 1, 5), (2, 0, 0)]
    assert token_counts.report(docs(spark, []), vocabulary_path()).count() == 0
    assert token_counts.recounted(docs(spark, []), edits, vocabulary_path()).count() == 0
