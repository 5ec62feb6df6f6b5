import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelweave.llm import merkle
from tests.llm.helpers import corpus, docs, with_clashes


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    doc_id, text, lang, source, n = row
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n is None else n + add, text)]
    return H(*shown)


def levels(nodes):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([H(*made[-1][at : at + 2]) for at in range(0, len(made[-1]), 2)])
    return made


def proof(tree, place):
    found = []
    for level in tree[:-1]:
        found.append((place & 1, level[place ^ 1] if place ^ 1 < len(level) else None))
        place >>= 1
    return found


def expected(rows):
    """Rows of the report by a plain tree in memory."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by_lang[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = levels([leaf(r) for r in by_lang[x]])
    upper = levels([trees[x][-1][0] for x in langs])
    root, made = upper[-1][0], []
    for at, x in enumerate(langs):
        for place, r in enumerate(by_lang[x]):
            path = proof(trees[x], place) + proof(upper, at)
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1) if bad else leaf(r)
            for side, other in path:
                node = H(node) if other is None else H(other, node) if side else H(node, other)
            made.append((r[0], leaf(r), trees[x][-1][0], root, H(*(o for _, o in path if o)), node, node == root))
    return sorted(made, key=repr)


def rows_of(n, seed=1, langs=("en", "de", "é", "", None)):
    rng = random.Random(seed)
    return [(k, f"text {k}" * rng.randrange(3), rng.choice(langs), rng.choice(["a", None]), rng.choice([k, None, 5])) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def test_report_is_the_plain_tree(spark):
    rows = rows_of(90) + [(None, None, None, None, None), (None, "x", "en", None, 3), (4, "again", "en", "a", 2), (4, "again", "en", "a", 2), (200, "long " * 9000, "de", "a", 1), (201, "ß", "one", "a", 1)]
    found = merkle.report(with_clashes(frame(spark, rows)))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)
    assert 0 < found.where("NOT verified").count() < 30


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 8, 9, 31, 33])
def test_small_blocks_of_many_rounds(spark, count):
    """Blocks of two levels: trees of several rounds, with short last runs on every level."""
    rows = rows_of(count, seed=count, langs=("en", None) if count > 4 else ("en",))
    df = frame(spark, rows)
    own = merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    made = df.select("doc_id", "lang", own.alias("leaf"), F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("other").cast("binary"), 256)).alias("changed"))
    found = merkle.versions(merkle.manifest(made, "lang", ["doc_id"], bits=2), "doc_id")
    plain = {r[0]: r for r in expected(rows)}
    for r in found.collect():
        doc, leaf_hex, subroot, root, digest, *_ = plain[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf_hex, subroot, root)
        assert H(*(s[1:] for s in r["siblings"])) == digest
        first = hashlib.sha256(b"other").hexdigest() if r["doc_id"] % 3 == 0 else r["leaf"]
        assert r["folded_root"] == merkle.folded(first, r["siblings"])
        assert (r["folded_root"] == root) == (r["doc_id"] % 3 != 0)


def test_versions_share_all_but_the_ancestors():
    leaves = [H(str(n)) for n in range(21)]
    tree = merkle.PersistentTree(leaves, 6)
    size, before = len(tree.digests), list(tree.digests)
    for place in (0, 7, 20):
        top = tree.version(place, H("new"))
        assert len(tree.digests) - size == 7 and tree.digests[:size] == before
        changed = [*leaves[:place], H("new"), *leaves[place + 1 :]]
        assert tree.digests[top] == merkle.PersistentTree(changed, 6).digests[-1]
        copied, shared = set(range(size, len(tree.digests))), set()
        for node in copied:
            shared |= {c for c in tree.children[node] if c < size}
        assert len(shared) <= 6
        tree.forget(size)
    assert tree.digests == before


def test_hot_group_is_spread_and_empty_table(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"), F.lit(None).cast("string").alias("changed"))
    tree = merkle.manifest(df, "lang", ["doc_id"], bits=6)
    sizes = {r["block"]: r["count"] for r in tree.leaves.groupBy("block").count().collect()}
    assert sizes == {n: 64 if n < 46 else 56 for n in range(47)}
    row = merkle.versions(tree, "doc_id").where("doc_id = 1234").first()
    plain = levels([H(str(n)) for n in range(3000)])
    assert row["folded_root"] == row["root"] == plain[-1][0]
    assert merkle.report(docs(spark, corpus()).limit(0)).count() == 0
