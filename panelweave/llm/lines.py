"""Line dedup: later repeats of runs of lines are deleted.

Documents are ordered by key; a *window* is ``run`` consecutive lines of one document. A line goes if it
lies in a window whose lines also start at an earlier place: in a document with a smaller key, or
higher up in the same one. Windows are judged on the input, so all lines of a later repeated run of
``run`` lines or more go. (Where a run overlaps its own repeat, as one line written many times does, the
overlap goes too.) With ``words``, a window of fewer lines counts as well if it has that many words: a passage
written as one line or two is deleted where it stands later.

Winnowing: a fingerprint is the hash of ``gram`` lines; in every window the smallest one is selected (the
last among equals), so two places with the same window select the same fingerprint at the same offset.
A window of fewer lines is a fingerprint by itself. Only fingerprints are joined. Around the places of a repeated one the match is extended up and down: every window that
contains it is compared by a 128-bit digest of its lines with the earliest place of that window,
and windows that follow each other make a run of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.common import col, fresh, staged, with_length

RUN = 3
GRAM = 2
#: Words (runs of non-space characters) that make fewer lines than a run a passage.
PASSAGE_WORDS = 50

_WORD = r"[^\x20\x09-\x0D]+"


def _line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), F.xxhash64)


def _grams(hashes: Column, gram: int) -> Column:
    """Hash of each ``gram`` consecutive lines."""
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - gram + 1), lambda i: F.xxhash64(F.slice(hashes, i, gram)))


def _selected(grams: Column, width: int) -> Column:
    """Positions (from 0) of the winnowing fingerprints: in each ``width`` grams the last smallest."""

    def place(i: Column) -> Column:
        window = F.slice(grams, i, width)
        back = F.array_position(F.reverse(window), F.array_min(window))
        return (i - 1 + width - back).cast("int")

    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - width + 1), place))


def _code(at: Column, size: int | Column, run: int) -> Column:
    """A window's place and size in one number: sets of numbers are hashed, sets of structs compared pair by pair."""
    return at.cast("bigint") * (run + 1) + size


def _fingerprints(hashes: Column, grams: Column, counts: Column, run: int, gram: int, words: int | None) -> Column:
    """(code, fingerprint): the selected ones of windows of ``run`` lines, and each passage of fewer lines.

    ``hashes`` and ``grams`` must be columns: an expression would be evaluated anew for every entry.
    """

    def listed(size: int, places: Column, fingerprint) -> Column:
        found = F.transform(places, lambda p: F.struct(_code(p, size, run).alias("code"), fingerprint(p).alias("fingerprint")))
        return F.when(F.size(hashes) >= size, found).otherwise(F.array().cast("array<struct<code:bigint,fingerprint:bigint>>"))

    def passages(size: int) -> Column:
        def long_enough(p: Column) -> Column:
            window = F.slice(counts, p + 1, size)
            long = F.aggregate(window, F.lit(0), lambda a, n: a + n) >= words
            # lines that are passages one by one need no window of several
            return long if size == 1 else long & F.exists(window, lambda n: n < words)

        return F.filter(F.sequence(F.lit(0), F.size(hashes) - size), long_enough)

    made = [listed(run, _selected(grams, run - gram + 1), lambda p: F.element_at(grams, p + 1))]
    for size in range(1, run) if words else ():
        made.append(listed(size, passages(size), lambda p, size=size: F.xxhash64(F.slice(hashes, p + 1, size), F.lit(size))))
    return F.concat(*made)


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """(key, version, lines): positions (from 0, sorted) of the lines to delete, for documents that have any.

    ``version`` is the text's digest: rows with equal key and text are one document and lose the same
    lines. Rows with a null key or text have no place in the order; they lose nothing and cause nothing.
    """
    if not 1 <= gram <= run:
        raise ValueError("a fingerprint must not be longer than the run")
    if words is not None and words < 1:
        raise ValueError("a passage has a word at least")
    lines = F.split(F.col("text"), "\n", -1)
    rows = docs.select(col(key).alias("key"), col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    enough = F.size("lines") >= run
    if words:
        enough = enough | (F.regexp_count("text", F.lit(_WORD)) >= words)
    counts = F.transform("lines", lambda x: F.regexp_count(x, F.lit(_WORD))) if words else F.lit(None).cast("array<int>")
    long = rows.select("key", F.md5("text").alias("version"), "text", lines.alias("lines")).where(enough)
    # one 128-bit digest per line stands for the line from here on
    kept = staged(long.select("key", "version", F.transform("lines", lambda x: F.unhex(F.md5(x))).alias("lines"), counts.alias("counts")))
    hashes = kept.select("key", "version", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), "counts")
    grams = hashes.select("*", F.when(F.size("hashes") >= gram, _grams(F.col("hashes"), gram)).alias("grams"))
    picked = grams.select("key", "version", F.inline(_fingerprints(F.col("hashes"), F.col("grams"), F.col("counts"), run, gram, words)))
    often = picked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    hits = picked.join(often, "fingerprint", "left_semi").groupBy("key", "version").agg(F.collect_set("code").alias("hits"))
    step = F.lit(run + 1)

    # windows that contain a hit: the match is extended both ways from there
    def around(hit: Column) -> Column:
        start = F.greatest(hit - (run - gram) * step, F.lit(run).cast("bigint"))
        return F.when(hit % step == run, F.sequence(start, F.least(hit, _code(F.size("lines") - run, run, run)), step.cast("bigint"))).otherwise(F.array(hit))

    near = F.array_distinct(F.flatten(F.transform("hits", around)))
    size, at = (F.col("code") % step).cast("int"), F.floor(F.col("code") / step).cast("int")
    windows = staged(
        kept.join(hits, ["key", "version"])
        .select("key", "version", "lines", F.explode(near).alias("code"))
        .select("key", "version", "lines", size.alias("size"), at.alias("at"))
        .select(F.md5(F.array_join(F.transform(F.slice("lines", F.col("at") + 1, F.col("size")), F.hex), ",")).alias("window"), "key", "version", "size", "at")
        .distinct()
    )
    first = windows.groupBy("window").agg(F.min(F.struct("key", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(first, "window").where(F.struct("key", "at") > F.col("first"))
    gone = later.groupBy("key", "version").agg(F.collect_list(F.struct("at", "size")).alias("found"))
    covered = F.flatten(F.transform("found", lambda w: F.sequence(w["at"], w["at"] + w["size"] - 1)))
    return gone.select("key", "version", F.array_sort(F.array_distinct(covered)).alias("lines"))


def marked(docs: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, gram: int = GRAM, name: str = "gone", words: int | None = None) -> DataFrame:
    """``docs`` with the positions of the lines to delete in the column ``name``, null where there are none."""
    version, place = fresh(docs, "version", "place")
    gone = staged(repeated_lines(docs, text, key, run, gram, words)).select(
        F.col("key").alias(place), F.col("version").alias(version), F.col("lines").alias(name)
    )
    left = docs.withColumn(version, F.md5(col(text)))
    # one kind of join at every size: a small table of lines would be broadcast, a large one not
    return left.join(gone.hint("merge"), (left[f"`{key}`"] == gone[place]) & (left[version] == gone[version]), "left").select(
        *(left[f"`{c}`"] for c in docs.columns), gone[name]
    )


def deduplicated(
    docs: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, gram: int = GRAM, words: int | None = PASSAGE_WORDS
) -> DataFrame:
    """``docs`` with the later repeated runs and passages cut from the text, same columns; what is left is joined by line breaks.

    A document of which no line is left keeps an empty text. ``n_chars`` follows the text. Null texts and rows with a null key stay
    as they are; rows with equal key and text lose the same lines; an empty table gives an empty table.
    """
    (gone,) = fresh(docs, "gone")
    found = marked(docs, text, key, run, gram, gone, words)
    return with_length(found.withColumn(text, _without(col(text), col(gone))), text).select(*(col(c) for c in docs.columns))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines ``gone``; the text itself where that is null."""

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.transform(kept, lambda p: F.element_at(lines, p + 1))

    # the lambda's variable holds the lines of a text; the split itself would be made anew for every line
    cut = F.flatten(F.transform(F.array(F.split(text, "\n", -1)), left))
    return F.when(gone.isNull(), text).otherwise(F.array_join(cut, "\n"))


def report(docs: DataFrame, run: int = RUN, gram: int = GRAM, words: int | None = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the text that ``deduplicated`` leaves.

    A null text has no lines and a null digest; an empty one has one line. Odd rows are treated as ``deduplicated`` treats them.
    """
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("bigint")
    return marked(docs.select("doc_id", "text"), run=run, gram=gram, words=words).select(
        "doc_id",
        lines.alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.sha2(_without(F.col("text"), F.col("gone")), 256).alias("kept_sha256"),
    )
