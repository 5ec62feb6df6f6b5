"""Token counts of edited documents without encoding them anew.

A document is a segment tree over its pre-tokens: leaves hold some neighbouring pre-tokens with their token counts, inner
nodes the sums of characters and tokens below. An edit replaces a span of characters. Only the pre-tokens
that it touches, and those close before it, are cut and encoded again; the cutting runs on until it meets an
old boundary behind the edit, from where on nothing can have changed. The touched leaves are replaced and the sums on
their paths updated.

Documents and edits stream through a task in the order (document, edit number): a task holds one
document's tree at a time and no list of edits, so a document may have any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelweave.llm.bpe import BytePairs, Vocabulary
from panelweave.llm.common import col, pieces

#: Pre-tokens in a leaf.
LEAF = 64


class Node:
    """Leaf (``parts``: pre-tokens, ``counts``) or inner node (``left``, ``right``) with sums."""

    __slots__ = ("parts", "counts", "left", "right", "chars", "tokens")

    def __init__(self, parts: list[str] | None, counts: list[int] | None, left: Node | None = None, right: Node | None = None):
        self.parts, self.counts, self.left, self.right = parts, counts, left, right
        self.sum()

    def sum(self) -> None:
        if self.parts is None:
            self.chars, self.tokens = self.left.chars + self.right.chars, self.left.tokens + self.right.tokens
        else:
            self.chars, self.tokens = sum(map(len, self.parts)), sum(self.counts)


def build(parts: list[str], counts: list[int]) -> Node:
    """A balanced tree over pre-tokens."""
    level = [Node(parts[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(parts), LEAF)] or [Node([], [])]
    while len(level) > 1:
        level = [Node(None, None, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _cut(node: Node, at: int) -> tuple[Node | None, Node | None]:
    """The tree before and from the character ``at``, which is a boundary of pre-tokens."""
    if at <= 0:
        return None, node
    if at >= node.chars:
        return node, None
    if node.parts is not None:
        n = 0
        while at > 0:
            at -= len(node.parts[n])
            n += 1
        return Node(node.parts[:n], node.counts[:n]), Node(node.parts[n:], node.counts[n:])
    if at <= node.left.chars:
        a, b = _cut(node.left, at)
        return a, _joined(b, node.right)
    a, b = _cut(node.right, at - node.left.chars)
    return _joined(node.left, a), b


def _joined(a: Node | None, b: Node | None) -> Node | None:
    if a is None or b is None:
        return a or b
    if a.parts is not None and b.parts is not None and len(a.parts) + len(b.parts) <= LEAF:
        return Node(a.parts + b.parts, a.counts + b.counts)
    return Node(None, None, a, b)


def _depth(node: Node) -> int:
    deepest, stack = 0, [(node, 1)]
    while stack:
        n, d = stack.pop()
        deepest = max(deepest, d)
        if n.parts is None:
            stack += [(n.left, d + 1), (n.right, d + 1)]
    return deepest


def _walk(node: Node, start: int) -> Iterator[tuple[int, str]]:
    """(place, pre-token) from the pre-token that holds the character ``start`` on."""
    stack = [(node, 0)]
    while stack:
        n, at = stack.pop()
        if at + n.chars <= start and n.chars:
            continue
        if n.parts is None:
            stack += [(n.right, at + n.left.chars), (n.left, at)]
            continue
        for part in n.parts:
            if at + len(part) > start:
                yield at, part
            at += len(part)


class CountedText:
    """A text with its token count, kept up to date under edits."""

    def __init__(self, text: str, pairs: BytePairs, parts: list[str] | None = None):
        self.pairs = pairs
        # a boundary depends on at most this many characters behind it: two for white space and
        # contractions, or the start of a special token
        self.context = 2 + max(map(len, pairs.special), default=0)
        parts = pairs.pretokens(text) if parts is None else parts
        self.tree = build(parts, pairs.counts(parts))
        self.edits = 0
        self.encoded = 0

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    @property
    def chars(self) -> int:
        return self.tree.chars

    def text(self) -> str:
        return "".join(part for _, part in _walk(self.tree, 0))

    def replace(self, start: int, length: int, new: str) -> None:
        """Replaces ``length`` characters from ``start``; both are clipped to the text."""
        start = max(0, min(start, self.chars))
        length = max(0, min(length, self.chars - start))
        if not length and not new:
            return
        # first pre-token that the edit can change
        first = next((at for at, _ in _walk(self.tree, max(0, start - self.context))), self.chars)
        old, bounds, size = [], [], 0
        behind = _walk(self.tree, first)
        for at, part in behind:
            old.append(part)
            size += len(part)
            bounds.append(first + size)
            if first + size >= start + length:
                break
        text = "".join(old)
        text = text[: start - first] + new + text[start - first + length :]
        shift = len(new) - length
        ends = {b + shift for b in bounds if b >= start + length}
        made, at, extra = [], 0, 64
        while True:
            # text behind the edit comes in growing pieces until an old boundary is met
            room = 0
            done = True
            for place, part in behind:
                text += part
                ends.add(place + len(part) + shift)
                room += len(part)
                if room >= extra:
                    done = False
                    break
            parts, stop = self._until(text, at, first, ends, start + len(new), done)
            made += parts
            at = stop
            if done or first + at in ends and first + at >= start + len(new) and parts:
                break
            extra *= 2
        left, rest = _cut(self.tree, first)
        _, right = _cut(rest, first + at - shift - (left.chars if left else 0)) if rest else (None, None)
        self.encoded += sum(map(len, made))
        self.tree = _joined(_joined(left, build(made, self.pairs.counts(made)) if made else None), right) or Node([], [])
        self.edits += 1
        if self.edits % 64 == 0 and _depth(self.tree) > 4 * max(1, (self.tree.chars // LEAF).bit_length()):
            pieces = [p for _, p in _walk(self.tree, 0)]
            self.tree = build(pieces, self.pairs.counts(pieces))

    def _until(self, text: str, at: int, first: int, ends: set[int], behind: int, last: bool) -> tuple[list[str], int]:
        """Pre-tokens of ``text`` from ``at`` on, up to an old boundary behind the edit, or as far as more text cannot change them."""
        safe = len(text) if last else len(text) - self.context
        made = []
        for part in self.pairs.pretokens(text[at:]):
            if at + len(part) > safe:
                break
            made.append(part)
            at += len(part)
            if first + at >= behind and first + at in ends:
                break
        return made, at


def recounted(
    docs: DataFrame, edits: DataFrame, path: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n_edits, tokens_before, tokens_after, chars_after, chars_encoded) per row of ``docs``.

    ``edits`` has the key and ``seq``, ``start``, ``length``, ``replacement``: characters from ``start`` (0 is the first) are
    replaced, in the order of ``seq`` (ties: start, length, replacement; null numbers are 0 and come first, a null
    replacement is empty), each on the result of those before it; spans are clipped to the text. A null
    or empty text has no tokens and can be edited. Edits of an unknown or null key are left out. Rows with equal
    keys are taken in turn, in the order of their texts, and the edits apply to the last of them.
    """
    vocabulary = Vocabulary(docs.sparkSession, path)
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    blank = F.lit(None).cast("bigint")
    bodies = docs.select(col(key).alias("key"), F.lit(0).alias("kind"), blank.alias("seq"), blank.alias("start"), blank.alias("length"), F.coalesce(col(text), F.lit("")).alias("body"))
    changes = edits.where(col(key).isNotNull()).select(
        col(key).alias("key"), F.lit(1).alias("kind"), number("seq").alias("seq"), number("start").alias("start"), number("length").alias("length"),
        F.coalesce("replacement", F.lit("")).alias("body"),
    )
    # rows without a key have no edits and need not meet
    spread = F.when(F.col("key").isNull(), F.xxhash64("body")).otherwise(F.lit(0))
    ordered = bodies.union(changes).repartition("key", spread).sortWithinPartitions("key", "kind", "seq", "start", "length", "body")

    def run(batches):
        pairs = vocabulary.load()
        made: list[list] = [[], [], [], [], [], []]
        held = None

        def closed():
            key, counted, before, n = held
            for column, value in zip(made, (key, n, before, counted.tokens, counted.chars, counted.encoded)):
                column.append(value)

        def flushed():
            nonlocal made
            out = [pa.array(made[0], key_type), *(pa.array(c, pa.int64()) for c in made[1:])]
            made = [[], [], [], [], [], []]
            return pa.RecordBatch.from_arrays(out, names=names)

        key_type = None
        for batch in batches:
            key_type = batch.column("key").type
            for part in pieces(batch, "body"):
                # the words of all texts at hand are encoded together, before any tree is built
                rows = part.to_pylist()
                cut = [pairs.pretokens(r["body"]) for r in rows]
                pairs.remember(w for words in cut for w in words)
                for row, words in zip(rows, cut):
                    key, kind, start, length, body = (row[c] for c in ("key", "kind", "start", "length", "body"))
                    if kind == 0:
                        if held:
                            closed()
                        counted = CountedText(body, pairs, words)
                        held = [key, counted, counted.tokens, 0]
                    elif held and held[0] == key:
                        held[1].replace(start, length, body)
                        held[3] += 1
                if len(made[0]) >= 1000:
                    yield flushed()
        if held:
            closed()
            yield flushed()

    names = ["key", "n_edits", "tokens_before", "tokens_after", "chars_after", "chars_encoded"]
    kind = docs.schema[key].dataType.simpleString()
    return ordered.mapInArrow(run, f"key {kind}, n_edits bigint, tokens_before bigint, tokens_after bigint, chars_after bigint, chars_encoded bigint").withColumnRenamed("key", key)


def derived_edits(docs: DataFrame, each: int = 4) -> DataFrame:
    """``each`` edits per document, made of hashes of its key: words of its own text are deleted, doubled or moved elsewhere."""
    size = F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("bigint")
    draw = lambda what: F.pmod(F.xxhash64(F.col("doc_id"), F.col("seq"), F.lit(what)), F.col("size"))
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", size.alias("size"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("seq"))
    length = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("length"), F.col("seq")), F.lit(24))
    taken = F.substring(F.coalesce("text", F.lit("")), (draw("from") + 1).cast("int"), F.pmod(F.xxhash64(F.col("seq"), F.lit("taken"), F.col("doc_id")), F.lit(32)).cast("int"))
    return rows.select("doc_id", "seq", draw("start").alias("start"), length.alias("length"), taken.alias("replacement"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """Counts of all documents under the edits that ``derived_edits`` gives them. Odd rows are treated as ``recounted`` says."""
    return recounted(docs.select("doc_id", "text"), derived_edits(docs.select("doc_id", "text")), path)
