"""Chat formatting in budgeted windows with a loss mask, in DataFrame functions alone.

The tokens of a conversation's turns are summed from its start. Turns whose sum
starts in the same stride form a window, so windows end where turns end. Each window
opens with the conversation's system turn and the last turns of the stride before,
as far as ``history`` reaches; both are there to be read, not learned. Only assistant
turns new to a window are under its loss mask, so each is learned once.

Sums run in two steps, within blocks of turn numbers and then over the blocks, so a
conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 128
BLOCK = 64
SYSTEM, ASSISTANT = "system", "assistant"
OPEN, CLOSE = "<|turn|>", "<|end|>"
# control strings of this and other common templates
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SPACE = r"\x20\x09-\x0D"
TOKEN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{SPACE}]"


def escaped(text: Column) -> Column:
    """Backslashes doubled and every control string broken by one; see ``unescaped``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for found in CONTROL:
        out = F.replace(out, F.lit(found), F.lit(found[0] + "\\" + found[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _role(role: Column) -> Column:
    # a role is one line; a line break inside is escaped like a control string
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def turn_tokens(text: Column) -> Column:
    """A word or a sign is a token; two stand for the marks."""
    return (F.regexp_count(text, F.lit(TOKEN)) + 2).cast("long")


def windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id, window, formatted, loss, n_turns, n_repeated, n_tokens``: one row per window.

    ``loss`` lists ``(start, end)`` of the texts to learn, in characters from 0.
    ``n_repeated`` turns at the head of a window were in an earlier one. New turns and
    history fill at most half of what the budget leaves each, so a window goes over
    ``budget`` only where a single turn is longer than its stride.

    Turns are in the order of turn number, then role, then text; null numbers come
    first. Null texts and roles are empty. A null conversation id is one conversation.
    The system turn is the first one if its role is ``system``.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    order = ["turn", "role", "text"]
    in_block = Window.partitionBy("conv_id", "block").orderBy(*order)
    rows = rows.select("*", F.row_number().over(in_block).alias("place"))
    first = (
        rows.groupBy("conv_id")
        .agg(F.min(F.struct("block", "place", "role", "text")).alias("first"))
        .select(
            F.col("conv_id").alias("c"),
            F.when(F.col("first.role") == SYSTEM, F.col("first.text")).alias("system"),
            F.col("first.block").alias("first_block"),
        )
    )
    joined = rows.join(first, rows.conv_id.eqNullSafe(first.c), "left")
    is_system = (
        F.col("system").isNotNull()
        & (F.col("block") == F.col("first_block"))
        & (F.col("place") == 1)
    )
    room = F.lit(budget) - F.coalesce(turn_tokens(F.col("system")), F.lit(0))
    stride = F.greatest(F.floor(room / 2) - history, F.lit(max(1, history)))
    sized = joined.select(
        "conv_id", "block", "place", "turn", "role", "text",
        is_system.alias("is_system"), stride.alias("stride"),
        F.when(is_system, 0).otherwise(turn_tokens(F.col("text"))).alias("tokens"),
    )
    so_far = in_block.rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("inside", F.coalesce(F.sum("tokens").over(so_far), F.lit(0)))
    blocks = sized.groupBy("conv_id", "block").agg(F.sum("tokens").alias("held"))
    before_block = (
        Window.partitionBy("conv_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("held").over(before_block), F.lit(0)).alias("base"),
    )
    placed = sized.join(
        blocks, sized.conv_id.eqNullSafe(blocks.c) & (sized.block == blocks.b)
    ).withColumn("before", F.col("base") + F.col("inside"))
    window = F.floor(F.col("before") / F.col("stride"))
    again = (
        ~F.col("is_system")
        & (F.col("before") >= (window + 1) * F.col("stride") - history)
        & (F.col("tokens") <= history)
    )
    # a turn's own window, and the next one if the turn is near enough to its start
    spread = placed.select(
        "*",
        F.explode(
            F.when(
                again,
                F.array(
                    F.struct(window.alias("window"), F.lit(True).alias("new")),
                    F.struct((window + 1).alias("window"), F.lit(False).alias("new")),
                ),
            ).otherwise(F.array(F.struct(window.alias("window"), F.lit(True).alias("new"))))
        ).alias("at"),
    )
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    pieces = spread.select(
        "conv_id", F.col("at.window").alias("window"),
        F.struct(
            "block", "place",
            F.col("at.new").alias("new"),
            F.concat(head, body, F.lit(CLOSE)).alias("piece"),
            F.length(head).alias("head"),
            F.length(body).alias("body"),
            (F.col("at.new") & (F.col("role") == ASSISTANT)).alias("learned"),
            "tokens",
        ).alias("turn"),
    )
    grouped = (
        pieces.groupBy("conv_id", "window")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .where(F.exists("turns", lambda t: t["new"]))
    )
    opened = grouped.join(
        first.where(F.col("system").isNotNull()), grouped.conv_id.eqNullSafe(F.col("c")), "left"
    )
    kept = F.col("system").isNotNull() & (F.col("window") > 0)
    lead = F.when(
        kept,
        F.concat(F.lit(OPEN), F.lit(SYSTEM), F.lit("\n"), escaped(F.col("system")), F.lit(CLOSE)),
    ).otherwise("")
    spans = F.aggregate(
        "turns",
        F.struct(
            F.length(lead).alias("at"),
            F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        ),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["learned"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + t["head"]).alias("start"),
                            (acc["at"] + t["head"] + t["body"]).alias("end"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    repeated = F.size(F.filter("turns", lambda t: ~t["new"]))
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    return opened.select(
        "conv_id", F.col("window").cast("long").alias("window"),
        F.concat(lead, F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias(
            "formatted"
        ),
        spans.alias("loss"),
        (F.size("turns") + kept.cast("int")).alias("n_turns"),
        (repeated + kept.cast("int")).alias("n_repeated"),
        (tokens + F.when(kept, turn_tokens(F.col("system"))).otherwise(0)).alias("n_tokens"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted window as ``(role, text)``, unescaped."""
    pattern = r"<\|turn\|>((?:[^\\\n]|\\[\s\S])*)\n([\s\S]*?)<\|end\|>"
    roles = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))
    return F.transform(
        F.arrays_zip(roles.alias("role"), texts.alias("text")),
        lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")),
    )


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(
            loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
        ),
        "",
    )


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say: turns once each, and the text to learn.

    ``conv_id, n_turns, turns, learned, formatted_chars``; ``turns`` is role, line
    break, text, line break of every turn. One value per conversation holds all its text.
    """
    new = F.slice(
        turns_of(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated")
    )
    rows = formatted_windows.select(
        "conv_id",
        F.struct(
            "window",
            (F.col("n_turns") - F.col("n_repeated")).alias("n"),
            F.array_join(
                F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
                "",
            ).alias("turns"),
            learned_text(F.col("formatted"), F.col("loss")).alias("learned"),
            F.length("formatted").alias("chars"),
        ).alias("w"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return whole.select(
        "conv_id",
        F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + w["n"]).alias("n_turns"),
        F.array_join(F.transform("ws", lambda w: w["turns"]), "").alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["learned"]), "").alias("learned"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + w["chars"]).alias(
            "formatted_chars"
        ),
    )
