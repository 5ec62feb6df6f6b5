import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelweave.llm import lines
from tests.llm.helpers import docs, with_clashes


def expected(rows, run=3):
    cut = [[] if t is None else t.split("\n") for _, t in rows]
    first = {}
    for (doc, _), ls in zip(rows, cut):
        for i in range(len(ls) - run + 1):
            if doc is not None:
                w = tuple(ls[i : i + run])
                first[w] = min(first.get(w, (doc, i)), (doc, i))
    made = []
    for (doc, text), ls in zip(rows, cut):
        gone = set()
        for i in range(len(ls) - run + 1):
            if doc is not None and first[tuple(ls[i : i + run])] < (doc, i):
                gone |= set(range(i, i + run))
        kept = None if text is None else "\n".join(x for i, x in enumerate(ls) if i not in gone)
        made.append((doc, text, len(ls), len(gone), kept))
    return made


def fixture(seed=1):
    rng = random.Random(seed)
    pool = [f"line {n}" for n in range(30)] + ["", " ", "été"]
    shared = [rng.choice(pool) for _ in range(12)]
    rows = []
    for n in range(60):
        text = [rng.choice(pool) if rng.random() < 0.5 else f"own {n} {k}" for k in range(rng.choice([1, 2, 5, 14]))]
        if n % 3 == 0:
            at = rng.randrange(len(text))
            text[at:at] = shared[: rng.choice([2, 3, 4, 12])]
        rows.append((n, "\n".join(text)))
    rows += [(70, None), (71, ""), (72, "\n\n\n\n"), (73, "same\n" * 50), (None, rows[0][1]), (5, rows[5][1]), (80, rows[6][1]), (81, "x" * 50_000)]
    return rows


@pytest.mark.parametrize(("run", "gram"), [(3, 2), (3, 3), (2, 1), (5, 2), (1, 1)])
def test_equals_brute_force(spark, run, gram):
    rows = fixture()
    want = sorted(((d, n, g, None if k is None else hashlib.sha256(k.encode()).hexdigest()) for d, _, n, g, k in expected(rows, run)), key=repr)
    found = sorted((tuple(r) for r in lines.report(docs(spark, rows), run, gram, None).collect()), key=repr)
    assert found == want
    assert any(w[2] for w in want)


def test_text_and_columns(spark):
    rows = fixture(2)
    df = with_clashes(docs(spark, rows))
    made = lines.deduplicated(df)
    assert made.columns == df.columns
    found = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in made.collect()), key=repr)
    assert found == sorted(((d, k, None if k is None else len(k)) for d, _, _, _, k in expected(rows)), key=repr)


def test_several_texts_of_a_key(spark):
    rows = [(1, "a\nb\nc"), (1, "q\na\nb\nc"), (2, "a\nb\nc\nz")]
    found = sorted((r["doc_id"], r["text"]) for r in lines.deduplicated(docs(spark, rows)).collect())
    assert found == sorted((d, k) for d, _, _, _, k in expected(rows)) == [(1, "a\nb\nc"), (1, "q"), (2, "z")]


def test_empty_table_and_bad_parameters(spark):
    assert lines.report(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lines.repeated_lines(docs(spark, []), run=2, gram=3)


def test_winnowing_selects_in_every_window(spark):
    rng = random.Random(3)
    grams = [rng.randrange(5) for _ in range(40)]
    frame = spark.createDataFrame([(grams,)], "g array<bigint>")
    for width in (1, 2, 4):
        chosen = set(frame.select(lines._selected(F.col("g"), width)).first()[0])
        for i in range(len(grams) - width + 1):
            window = grams[i : i + width]
            assert i + max(j for j in range(width) if window[j] == min(window)) in chosen


def test_passages_of_few_lines(spark):
    rng = random.Random(5)
    passages = [" ".join(f"p{n} w{rng.randrange(99)}" for _ in range(k)) for n, k in enumerate((25, 30, 13, 24, 24))]
    tabs = "\t\x0b".join(f"t{k}" for k in range(50))
    rows = [(1, passages[0]), (2, "own\n" + passages[0]), (3, passages[0] + " x"), (4, f"{passages[2]}\n{passages[3]}"), (5, f"a\n{passages[2]}\n{passages[3]}\nb")]
    rows += [(6, f"{passages[4]}\nc"), (7, f"{passages[4]}\nd"), (8, f"{passages[1]}\n{passages[1]}"), (9, tabs), (10, f"{tabs}\ne"), (11, "short\nline"), (12, "short\nline")]
    rows += [(13, f"{passages[1]}\nshort\n{passages[0]}"), (None, passages[0]), (14, None), (15, ""), (2, "own\n" + passages[0]), (16, " " * 300), (17, " " * 300)]

    def left(words, run=3):
        places = {}
        for n, (doc, text) in enumerate(rows):
            ls = [] if doc is None or text is None else text.split("\n")
            for size in range(1, run + 1):
                for i in range(len(ls) - size + 1):
                    window = tuple(ls[i : i + size])
                    if size == run or sum(len(x.encode().split()) for x in window) >= words:
                        places.setdefault(window, []).append((doc, i, n))
        gone = {(n, i + k) for w, at in places.items() for d, i, n in at if (d, i) > min(at)[:2] for k in range(len(w))}
        return sorted(((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (n, i) not in gone)) for n, (d, t) in enumerate(rows)), key=repr)

    found = sorted(((r["doc_id"], r["text"]) for r in lines.deduplicated(docs(spark, rows)).collect()), key=repr)
    assert found == left(50)
    digests = sorted(((r["doc_id"], r["kept_sha256"]) for r in lines.report(docs(spark, rows)).collect()), key=repr)
    assert digests == sorted(((d, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for d, t in left(50)), key=repr)
    assert {(2, "own"), (5, "a\nb"), (7, f"{passages[4]}\nd"), (8, passages[1]), (10, "e"), (12, "short\nline"), (13, "short")} <= set(found)
    for words, run, gram in ((3, 3, 2), (40, 5, 2), (50, 1, 1)):
        found = sorted(((r["doc_id"], r["text"]) for r in lines.deduplicated(docs(spark, rows), run=run, gram=gram, words=words).collect()), key=repr)
        assert found == left(words, run)
    with pytest.raises(ValueError):
        lines.repeated_lines(docs(spark, []), words=0)


def test_no_python_worker(spark):
    plan = lines.report(docs(spark, fixture()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
