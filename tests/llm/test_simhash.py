import random

import numpy as np
import xxhash

from panelweave.llm import simhash
from tests.llm.helpers import corpus, docs, with_clashes


def plain_fingerprint(text):
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, radius=3):
    """{row number: smallest row number reachable}."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius and root[j] > root[i]:
                    root[j] = root[i]
                    changed = True
    return root


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = brute(fps)
    least = {}
    for (doc, _), r in zip(rows, root):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root)), key=repr)


def test_report_equals_brute_force(spark):
    rows = corpus() + [(300, None), (301, "ÀB C d"), (302, "Àb c D"), (None, None)]
    found = sorted((tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in simhash.report(docs(spark, rows)).collect()), key=repr)
    assert found == expected(rows)


def test_masks_cover_every_triple():
    rng = random.Random(1)
    for arrangement in (1, 2):
        masks = [m % (1 << 64) for m in simhash.masks(3, arrangement)]
        for _ in range(3000):
            bits = sum(1 << p for p in rng.sample(range(64), 3))
            assert any(not m & bits for m in masks)
    free = max(64 - (a | b).bit_count() for a in (m % (1 << 64) for m in simhash.masks(3, 1)) for b in (m % (1 << 64) for m in simhash.masks(3, 2)))
    assert free <= 19


def _linked_roots(spark, fps, bucket_rows):
    from panelweave.llm.components import components

    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint").repartition(3)
    found = {r["node"]: r["root"] for r in components(simhash.links(frame, bucket_rows=bucket_rows)).collect()}
    groups = {}
    for f in fps:
        signed = int(np.uint64(f).view(np.int64))
        groups.setdefault(found.get(signed, signed), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_large_buckets_are_dealt_again_without_loss(spark):
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = list({s ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(6))) for s in seeds for _ in range(60)})
    root = brute(fps)
    want = {}
    for f, r in zip(fps, root):
        want.setdefault(r, set()).add(f)
    want = {frozenset(g) for g in want.values()}
    assert _linked_roots(spark, fps, 20_000) == want
    assert _linked_roots(spark, fps, 3) == want


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    df = with_clashes(docs(spark, rows))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    groups = {}
    for doc, fp, component in expected(rows):
        groups.setdefault((fp, component) if component is None else component, []).append(doc)
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(found, key=repr) == sorted((c if not isinstance(c, tuple) else None for c in groups), key=repr)


def test_empty_table(spark):
    assert simhash.report(docs(spark, [])).count() == 0
    assert simhash.deduplicated(docs(spark, [])).count() == 0
