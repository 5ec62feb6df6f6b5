import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import bpe
from panelweave.llm.queries import vocabulary_path
from tests.llm.helpers import corpus, docs

tokenizers = pytest.importorskip("tokenizers")
HARD = [
    "", " ", "  \n\n x", "<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "<|endoftext", "it's we'll I'M 'd", "été 漢字かな 😀👩‍👩‍👧 ﷽", "\x00\x1c\x85 \u2028", "a" * 3000,
    "aaaa" * 30 + "!" * 200, "ᄀᄁ\u0301e\u0301", "1234567890 ½ ² Ⅷ", "\t\t if x:\r\n\treturn", " \u00a0 nbsp", "\ufeffbom", "ﬁ ſ K",
]


@pytest.fixture(scope="module")
def pairs():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return bpe.BytePairs(f.read())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def noise(seed=2, n=300):
    rng = random.Random(seed)
    letters = "aAbeEtThnoi ,.'!?\n\t0189-_<|>éßñ漢😀\u0301\u200d\xa0"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(n)]


def test_same_ids_and_texts_as_the_library(pairs, library):
    texts = HARD + noise() + [t or "" for _, t in corpus()]
    for text, ids in zip(texts, pairs.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert pairs.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_every_letter(pairs, library):
    text = [chr(c) + "x " + chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    ids = pairs.encode(text)
    for t, i in zip(text, ids):
        assert i.tolist() == library.encode(t, add_special_tokens=False).ids, hex(ord(t[0]))


def test_parts_of_characters_decode_like_the_library(pairs, library):
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(pairs.size) for _ in range(6)]
        assert pairs.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_proposals_that_fail_are_merged(pairs):
    words = ["".join(p).encode() for p in ("thtion", "anened", "erthh")] + [w.encode() for t in noise(9) for w in t.split()]
    assert pairs.words(words) == [pairs.merged(w) for w in words]
    assert any(pairs.proposed(w) != pairs.merged(w) for w in words)
    long = b"abracadabra" * 40
    assert pairs._merged_short([pairs.ids[long[i : i + 1]] for i in range(len(long))]) == pairs.merged(long)


def test_memory_is_bounded_without_change(pairs, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for text in noise(7, 40):
        assert pairs.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_report_and_columns(spark, library):
    rows = [(n, t) for n, t in enumerate(HARD)] + [(500, None), (None, "null key"), (3, HARD[3])]
    found = sorted((tuple(r) for r in bpe.report(docs(spark, rows), vocabulary_path()).collect()), key=repr)
    want = []
    for doc, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")
        want.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=repr)
    frame = docs(spark, rows).withColumn("place", F.lit(1))
    both = bpe.decoded(bpe.encoded(frame, vocabulary_path()), vocabulary_path())
    assert both.columns == [*frame.columns, "token_ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in both.collect())
    assert bpe.report(docs(spark, []), vocabulary_path()).count() == 0
