import hashlib
import random
import re

from pyspark.sql import functions as F

from panelweave.llm import decontamination as de
from tests.llm.helpers import corpus, docs, with_clashes, words

BENCHMARK = "item_id bigint, text string"


def cut(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def expected(rows, items):
    windows = {}
    for item, text in items:
        ws = cut(text)
        k = min(10, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            windows.setdefault(tuple(ws[i : i + k]), set()).add("null" if item is None else str(item))
    made = []
    for doc, text in rows:
        ws, hit, found = cut(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(ws) - k + 1):
                if owners := windows.get(tuple(ws[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= owners
        made.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(made, key=repr)


def fixture():
    rng = random.Random(5)
    rows = corpus()
    items = [(n, " ".join(words(rng, rng.choice([9, 10, 11, 30]), 6))) for n in range(12)]
    items += [(20, None), (21, ""), (22, "w1"), (23, "W2, w3!"), (24, rows[4][1]), (None, "w4 w4 w4"), (3, items[4][1]), (25, "été d'été 漢字"), (26, " ".join(items[0][1].split()[:10]))]
    rows += [(200 + n, "Lead in, " + t.upper().replace(" ", "; ") + " . out") for n, (_, t) in enumerate(items) if t]
    rows += [(300, "a " + " ".join(words(rng, 500, 6))), (301, "Été d'été 漢字!"), (302, "été D'été 漢字")]
    return rows, items


def result(df):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    rows, items = fixture()
    want = expected(rows, items)
    df = with_clashes(docs(spark, rows))
    assert result(de.report(df, spark.createDataFrame(items, BENCHMARK))) == want
    assert any(w[5] for w in want) and not all(w[5] for w in want)


def test_shards_give_the_same(spark):
    rows, items = fixture()
    benchmark = spark.createDataFrame(items, BENCHMARK)
    one, many = (de.contamination(docs(spark, rows), benchmark, keep=["doc_id"], shard_words=n) for n in (1000, 40))
    assert sorted(one.collect(), key=repr) == sorted(many.collect(), key=repr)


def test_spans_go_and_clean_texts_stay(spark):
    item = " ".join(f"q{n}" for n in range(14))
    rows = [(1, f"Before it. {item.upper()}! After, it."), (2, "q0 q1 q2 q3 q4 q5 q6 q7 q8 and no more"), (3, None), (4, item), (5, "")]
    df = with_clashes(docs(spark, rows))
    made = de.decontaminated(df, spark.createDataFrame([(1, item)], BENCHMARK))
    assert made.columns == df.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in made.collect()}
    want = {1: "Before it. ! After, it.", 2: rows[1][1], 3: None, 4: "", 5: ""}
    assert found == {d: (t, None if t is None else len(t)) for d, t in want.items()}


def test_empty_tables(spark):
    rows, items = fixture()
    nothing = spark.createDataFrame([], BENCHMARK)
    assert result(de.report(docs(spark, rows), nothing)) == expected(rows, [])
    assert de.report(docs(spark, []), spark.createDataFrame(items, BENCHMARK)).count() == 0


def covered_by_force(words, item, least, share):
    """Word numbers of the document inside matches of ``least`` words with the item, if these cover enough of it."""
    seen, here = set(), set()
    for i in range(len(words) - least + 1):
        for j in range(len(item) - least + 1):
            if words[i : i + least] == item[j : j + least]:
                seen |= set(range(j, j + least))
                here |= set(range(i, i + least))
    return here if item and len(seen) >= share * len(item) else set()


def test_coverage_finds_items_with_words_changed():
    rng = random.Random(5)
    items = [(f"i{n}", [f"v{rng.randrange(60)}".encode() for _ in range(rng.choice([14, 25, 40]))]) for n in range(12)]
    automaton = de.Automaton(items, 10, 0.8)
    plain = de.Automaton(items, 10)
    caught = 0
    for trial in range(60):
        text = [f"w{rng.randrange(500)}".encode() for _ in range(40)]
        copy = list(rng.choice(items)[1])
        for at in range(rng.randrange(3, 9), len(copy), 9):
            copy[at] = b"changed"
        text[20:20] = copy if trial % 3 else copy[: len(copy) // 2]
        found, names = set(), set()
        for a, b in automaton.matches(text, names):
            found |= set(range(a, b))
        expected, owners = set(), set()
        for a, b in plain.matches(text, owners):
            expected |= set(range(a, b))
        for name, item in items:
            if more := covered_by_force(text, item, de.LEAST, 0.8):
                expected |= more
                owners.add(name)
        assert (found, names) == (expected, owners)
        caught += bool(found) and not plain.matches(text, set())
    assert caught > 20


def test_changed_items_are_cut_and_clean_texts_stay(spark):
    item = [f"q{n}" for n in range(30)]
    changed = [w if n % 9 != 4 else "other" for n, w in enumerate(item)]
    df = docs(spark, [(1, "before " + " ".join(changed) + " after"), (2, "a clean text " + " ".join(item[3:9])), (3, None)])
    bench = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    texts = {r["doc_id"]: r["text"] for r in de.decontaminated(df, bench).collect()}
    assert texts[2] == "a clean text " + " ".join(item[3:9]) and texts[3] is None
    assert "q7" not in texts[1] and texts[1].startswith("before ") and texts[1].endswith(" after")
    whole = {r["doc_id"]: r["text"] for r in de.decontaminated(df, bench, coverage=None).collect()}
    assert whole[1] == "before " + " ".join(changed) + " after"
    named = de.contamination(df.withColumn("items", F.lit("own")), bench)
    assert named.columns[-3:] == ["n_words", "spans", "_items"] and named.first()["items"] == "own"
