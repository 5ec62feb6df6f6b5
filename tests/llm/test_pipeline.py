import hashlib
import os
import random

import pytest

import corpus_pipeline
from panelweave.llm import language
from panelweave.llm.bpe import BytePairs
from panelweave.llm.queries import ORACLE_SQL, QUERIES, vocabulary_path
from tests.llm.helpers import docs, with_clashes
from tests.llm.test_decontamination import cut, expected as contaminated
from tests.llm.test_lines import expected as lines_left
from tests.llm.test_simhash import expected as fingerprints


@pytest.fixture
def corpus_dir(spark, folder):
    rng = random.Random(8)
    vocabulary = {"en": ["the", "ing", "er"], "fr": ["eau", "ment", "que"]}
    item = [f"test{n}" for n in range(12)]
    rows = []
    for n in range(80):
        lang = rng.choice(["en", "fr"])
        text = "\n".join(" ".join("".join(rng.choices(vocabulary[lang], k=2)) + str(rng.randrange(40)) for _ in range(12)) for _ in range(rng.choice([1, 3, 8])))
        if n % 5 == 1:
            text += "\n" + "\n".join(f"shared the line {k}" for k in range(4))
        if n % 7 == 2:
            text += " " + " ".join(item).upper()
        rows.append((n, text, lang))
    rows += [(90 + k, rows[3 * k][1], rows[3 * k][2]) for k in range(6)] + [(200, None, "en"), (201, "", "fr"), (202, "123 !", "en"), (203, None, None)]
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, [(1, " ".join(item))]


def test_stages_equal_brute_force(spark, corpus_dir):
    folder, rows, items = corpus_dir
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    accepted = {r["doc_id"] for r in language.identified(frame, language.train(frame)).where("NOT rejected").collect()}
    kept = [(d, t) for d, t, _ in rows if d in accepted]
    assert len(kept) == len(rows) - 4
    kept = [(d, k) for d, _, _, _, k in lines_left(kept)]
    stays = {c for _, _, c in fingerprints(kept)}
    kept = [(d, t) for d, t in kept if d in stays]
    hit = {d: h for d, _, h, *_ in contaminated(kept, items)}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(found) == {d for d, _ in kept}
    with open(vocabulary_path(), encoding="utf-8") as f:
        pairs = BytePairs(f.read())
    assert any(hit.values())
    for doc, text in kept:
        if hit[doc]:
            at = text.index("TEST0")
            text = text[:at] + text[at + len(items[0][1]) :]
            assert not [w for w in cut(text) if w.startswith("test")]
        ids = pairs.encode([text])[0]
        assert found[doc]["ids_sha256"] == hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
        assert found[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_all_but_the_last_stage_return_the_columns(spark, corpus_dir):
    folder, _, _ = corpus_dir
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, frame, folder)
        assert made.columns == frame.columns, name
        assert [f.dataType for f in made.schema] == [f.dataType for f in frame.schema], name


def test_empty_tables_and_clashing_columns(spark, corpus_dir):
    folder, _, _ = corpus_dir
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), folder).count() == 0, name
    plain, clashing = frame.limit(30), with_clashes(frame.limit(30))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, clashing, folder)
        assert made.columns == clashing.columns, name
        assert made.where("fp <> 'own fp' OR items <> 'own items' OR score <> 'own score'").count() == 0
        assert sorted(map(tuple, made.select(plain.columns).collect()), key=repr) == sorted(map(tuple, stage(spark, plain, folder).collect()), key=repr), name


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_sql_gives_the_same(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(small, t)}.parquet')")
    found = QUERIES[name](spark, small)
    want = con.sql(ORACLE_SQL[name])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    assert sorted((tuple(r[c] for c in order) for r in found.collect()), key=repr) == sorted(want.project(", ".join(order)).fetchall(), key=repr)
