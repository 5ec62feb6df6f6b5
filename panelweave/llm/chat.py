r"""Chat formatting: conversations as windows of whole turns with a loss mask, in DataFrame functions only.

A turn is written ``<s>[INST] role\ntext [/INST]</s>``. In texts and roles the backslash, ``<`` and ``[`` become
``\b``, ``\l`` and ``\k`` (and a line break in a role ``\n``), so no control string can occur in them and the
writing can be undone.

Prefix sums of turn tokens choose the windows: turns whose sum before them falls in the same step of half the
free budget form a span, and a turn longer than a step is a span of its own, so a span fits the
budget unless a single turn exceeds it. Each window holds the system turn, up to ``history_turns`` turns
before its span of at most ``history_tokens`` together, and the span. The mask covers the assistant texts
of the span; repeated ones are masked out, so every assistant text counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelweave.llm.common import col

OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>"
#: Escape of each character that control strings begin with; the backslash is first.
ESCAPES = {"\\": "\\b", "<": "\\l", "[": "\\k"}
BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 2
#: Tokens of a turn's marks.
MARKS = 6

#: A token is a run of ASCII letters, digits and underscores, or any other character but a space.
TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\x20\x09-\x0D]"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if role else text


def unescaped(text: Column, role: bool = False) -> Column:
    if role:
        text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    for plain, code in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, budget: int, history_tokens: int, history_turns: int) -> DataFrame:
    """One row per turn: place, span, whether it starts the span, and what the window repeats before it."""
    written = F.coalesce(col(text), F.lit(""))
    name = F.coalesce(col(role), F.lit(""))
    base = rows.select(
        col(conv).alias("conv"),
        col(turn).alias("turn"),
        name.alias("role"),
        F.char_length(escaped(name, True)).alias("head"),
        F.concat(escaped(name, True), F.lit("\n"), escaped(written)).alias("body"),
        (F.regexp_count(written, F.lit(TOKEN)) + MARKS).cast("bigint").alias("tokens"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    placed = base.withColumn("place", F.row_number().over(order)).withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    piece = F.struct("place", "role", "head", "body")
    lead = placed.withColumn("lead", F.first(F.when(F.col("system"), F.struct("tokens", piece.alias("piece")))).over(running))
    room = ((budget - history_tokens - F.coalesce(F.col("lead.tokens"), F.lit(0))) / 2).cast("bigint")
    step = F.greatest(room, F.lit(max(1, budget // 8)))
    own = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    summed = (
        lead.withColumn("step", step)
        .withColumn("before", F.sum(own).over(running) - own)
        .withColumn("large", F.col("tokens") > F.col("step"))
        .withColumn("larges", F.sum(F.when(F.col("large") & ~F.col("system"), 1).otherwise(0)).over(running))
        .withColumn("key", F.when(~F.col("system"), F.struct("larges", "large", F.floor(F.col("before") / F.col("step")).alias("part"))))
        .withColumn("last_key", F.lag("key").over(order))
        .withColumn("starts", ~F.col("system") & ~F.col("key").eqNullSafe(F.col("last_key")))
    )
    back = order.rowsBetween(-history_turns, -1)
    gathered = F.collect_list(F.when(~F.col("system"), F.struct("before", piece.alias("piece")))).over(back)
    spans = summed.withColumn("span", F.greatest(F.sum(F.col("starts").cast("int")).over(running), F.lit(1))).withColumn("gathered", gathered)
    history = F.transform(F.filter("gathered", lambda x: F.col("before") - x["before"] <= history_tokens), lambda x: x["piece"])
    repeats = F.when(
        F.col("starts") & (F.col("span") > 1),
        F.concat(F.when(F.col("lead").isNotNull(), F.array("lead.piece")).otherwise(F.array().cast("array<struct<place:int,role:string,head:int,body:string>>")), history),
    )
    return spans.select("conv", "span", "place", piece.alias("piece"), repeats.alias("repeats"))


def windows(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """(conv_id, window, n_repeated, formatted, loss): the windows of each conversation.

    ``n_repeated`` of the turns in ``formatted`` come first and belong to earlier windows or are the system turn
    again; ``loss`` holds the spans [start, end) of code points under the mask. A leading turn of the role
    ``system`` is the system turn. Null roles and texts are empty; turns with equal numbers follow by role and
    text, null numbers come first; rows with a null conversation form one. An empty table has no window.
    """
    turns = _turns(rows, conv, turn, role, text, budget, history_tokens, history_turns)
    gathered = turns.groupBy("conv", "span").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "repeats"))).alias("rows"))
    repeats = F.coalesce(F.flatten(F.transform("rows", lambda x: F.coalesce(x["repeats"], F.expr("slice(array(rows[0].piece), 1, 0)")))), F.array())
    parts = gathered.select("conv", "span", repeats.alias("repeats"), F.transform("rows", lambda x: x["piece"]).alias("own"))
    write = lambda x: F.concat(F.lit(OPEN), x["body"], F.lit(CLOSE))
    repeated = F.array_join(F.transform("repeats", write), "")
    made = parts.select("conv", "span", F.size("repeats").alias("n_repeated"), repeated.alias("repeated"), "own").withColumn("new", F.transform("own", write))
    spans = F.aggregate(
        F.arrays_zip("own", "new"),
        F.struct(F.char_length("repeated").alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans")),
        lambda done, x: F.struct(
            (done["at"] + F.char_length(x["new"])).alias("at"),
            F.when(
                x["own"]["role"] == "assistant",
                F.concat(
                    done["spans"],
                    F.array(
                        F.struct(
                            (done["at"] + len(OPEN) + 1 + x["own"]["head"]).alias("start"),
                            (done["at"] + F.char_length(x["new"]) - len(CLOSE)).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return made.select(
        F.col("conv").alias("conv_id"),
        F.col("span").alias("window"),
        "n_repeated",
        F.concat("repeated", F.array_join("new", "")).alias("formatted"),
        spans.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_text, chars): the new turns (role, text) of each window, and the text under the mask, unescaped."""
    pieces = F.split("formatted", r"\Q" + CLOSE + r"\E", -1)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def turn(x: Column) -> Column:
        body = F.substring(x, len(OPEN) + 1, F.char_length(x))
        head = F.substring_index(body, "\n", 1)
        return F.struct(
            unescaped(head, True).alias("role"), unescaped(F.substring(body, F.char_length(head) + 2, F.char_length(body))).alias("text")
        )

    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select(
        "conv_id", "window", F.transform(new, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.char_length("formatted").alias("chars")
    )


def report(conversations: DataFrame) -> DataFrame:
    """The digest per conversation, read back from the windows. Null texts, ties, repeated turns and empty tables are treated as ``windows`` says."""
    back = read_back(windows(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", F.struct("window", told.alias("turns"), "loss_text").alias("part"), F.size("turns").alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("parts", lambda p: p["loss_text"]), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parts", lambda p: p["turns"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
