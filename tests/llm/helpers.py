"""Fixture rows of the text operators: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators use inside, as extra columns of a table.
CLASHES = ["fp", "root", "gone", "version", "spans", "items", "n_words", "score", "rejected", "lang_pred", "place", "key", "lines", "rank", "token_ids"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def corpus(seed=3, size=40):
    """Texts with shared passages, near and exact copies, and the odd cases."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 80))
    made = []
    for n in range(size):
        text = words(rng, rng.choice([3, 30, 120, 260]))
        if n % 4 == 0:
            at = rng.randrange(len(text))
            text[at:at] = passage.split()[: rng.choice([49, 50, 51, 80])]
        made.append([n, " ".join(text)])
    made += [[size + k, made[k * 3][1]] for k in range(5)]
    made += [[size + 10 + k, made[4][1].replace("w1", "w2", k)] for k in range(6)]
    made += [[100, None], [101, ""], [102, " \t\n "], [103, "one"], [None, made[0][1]], [7, made[7][1]]]
    made += [[104, "w5 " * 4000], [105, "x" * 50_000]]
    return [tuple(m) for m in made]
