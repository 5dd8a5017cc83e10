"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens place every turn on the line of its conversation. The line is cut into stretches of the
window's free budget; the turns inside a stretch are a window's new turns, and a turn across a border, or longer than
a stretch, is a window of its own. A window holds the system turn, then up to ``history`` tokens of the turns before
its first new one, then its new turns. Repeated turns are never under the loss mask, so each assistant text is a
target once. History shrinks to what the new turns leave, so a window exceeds the budget only where one turn does not
fit beside the system turn; it is kept whole, without history, and flagged.

Prefix sums are taken in blocks of 256 turn numbers, the placed turns are written once, and history is fetched by
position, so the turns of one huge conversation are spread like those of many. Order is by turn, then role, then text; null turns come first, null roles
and texts count as empty, repeated rows are turns of their own. A leading system turn is the system turn; other turns
with that role are ordinary. An empty table gives no windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.session import staged

# fixed values: strings that chat models treat as control, among them this template's own marks
CONTROL_RESTS = ("s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "|im_start|>", "|im_end|>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN_OVERHEAD = 4
BLOCK_BITS = 8


@dataclass(frozen=True)
class Budget:
    """Tokens per window, and of these at most ``history`` for repeated turns; ``least`` for new turns beside a long
    system turn, as far as it leaves them."""

    window: int = 1024
    history: int = 256
    least: int = 128


def _pattern(slashes: str) -> str:
    rests = "|".join("".join("\\" + c if not c.isalnum() else c for c in rest) for rest in CONTROL_RESTS)
    return rf"([<\[]){slashes}(?={rests})"


def escaped(text: Column) -> Column:
    """One more backslash after the first sign of every control string, escaped or not."""
    return F.regexp_replace(text, _pattern(r"(\\*)"), r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _pattern(r"\\(\\*)"), "$1$2")


def token_estimate(text: Column) -> Column:
    """Runs of letters and digits, and single other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def placed_turns(turns: DataFrame, budget: Budget, count: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """Every turn with its index and token position in the conversation, and the window that has it as a new turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", count(F.col("text")) + TURN_OVERHEAD).withColumn("block", F.shiftright("turn", BLOCK_BITS))
    blocks = rows.groupBy("conv", "block").agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"), F.min(F.struct("turn", "role", F.xxhash64("text"), "tokens")).alias("head"))
    conv = Window.partitionBy("conv").orderBy("block")
    earlier = conv.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("head").over(conv)
    offsets = blocks.select(
        F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.when(head["role"] == "system", head["tokens"]).otherwise(F.lit(0)).alias("system_tokens"),
    )
    joined = rows.join(offsets, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", F.xxhash64("text"))
    until = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("index", F.col("n") + F.row_number().over(inside) - 1).withColumn(
        "at", F.col("sum") + F.coalesce(F.sum("tokens").over(until), F.lit(0)) - F.col("system_tokens")
    )
    placed = placed.withColumn("is_system", (F.col("index") == 0) & (F.col("role") == "system"))
    left = F.lit(budget.window) - F.col("system_tokens")
    room = F.greatest(F.lit(1), F.least(left, F.greatest(F.lit(budget.least), left - budget.history)))
    low, high = F.floor(F.col("at") / room), F.floor((F.col("at") + F.col("tokens") - 1) / room)
    window = F.when(F.col("is_system"), F.lit(0)).when(low == high, low * 2).otherwise(low * 2 + 1)
    return placed.withColumn("window", window.cast("long")).select("conv", "window", "index", "at", "tokens", "role", "text", "is_system", "system_tokens")


def format_windows(turns: DataFrame, budget: Budget | None = None, count: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """(conv_id, window, context, turns, tokens, over_budget, text, loss) per window.

    ``context`` is the number of repeated turns at its start, ``turns`` that of new ones, and ``loss`` lists (start,
    length) in code points of the assistant texts to learn. Windows are in the order of ``window``, which has gaps.
    ``count`` gives the tokens of a text.
    """
    budget = budget or Budget()
    placed = staged(placed_turns(turns, budget, count), "turns")
    new = placed.where(~F.col("is_system")).drop("system_tokens")
    spare = F.lit(budget.window) - F.first("system_tokens") - F.sum("tokens")
    windows = placed.where(~F.col("is_system")).groupBy("conv", "window").agg(F.min("at").alias("start"), F.greatest(F.lit(0), F.least(F.lit(budget.history), spare)).alias("past"))
    bin_of = lambda c: F.floor(F.col(c) / budget.history)
    asked = windows.where((F.col("start") > 0) & (F.col("past") > 0)).select(
        F.col("conv").alias("c"), F.col("window").alias("w"), "start", "past", F.explode(F.array(bin_of("start") - 1, bin_of("start"))).alias("b")
    )
    near = new.drop("window", "is_system").withColumn("bin", bin_of("at")).join(
        asked, F.col("conv").eqNullSafe(F.col("c")) & (F.col("bin") == F.col("b")) & (F.col("at") < F.col("start")) & (F.col("at") >= F.col("start") - F.col("past"))
    )
    first = windows.groupBy("conv").agg(F.min("window").alias("first"))
    system = placed.where("is_system").select(F.col("conv").alias("c"), F.col("index"), "at", "tokens", "role", "text")
    # the system turn is new in the first window of its conversation, or in one of its own if there is no other turn
    listed = windows.select("conv", "window").join(first.withColumnRenamed("conv", "f"), F.col("conv").eqNullSafe(F.col("f"))).drop("f")
    carried = system.join(listed, F.col("c").eqNullSafe(F.col("conv")), "left").select(
        F.col("c").alias("conv"), F.coalesce("window", F.lit(0).cast("long")).alias("window"), "index", "tokens", "role", "text",
        (F.col("window").isNull() | (F.col("window") == F.col("first"))).alias("fresh"),
    )
    columns = ["conv", "window", "index", "tokens", "role", "text", "fresh"]
    everything = (
        new.withColumn("fresh", F.lit(True)).select(*columns)
        .union(near.select("conv", F.col("w").alias("window"), "index", "tokens", "role", "text", F.lit(False).alias("fresh")))
        .union(carried.select(*columns))
    )
    marked = everything.select(
        "conv", "window", F.struct("index", "fresh", "tokens", (F.col("role") == "assistant").alias("target"), F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body")).alias("t")
    )
    grouped = marked.groupBy("conv", "window").agg(F.array_sort(F.collect_list("t")).alias("list"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin, size = state["at"] + F.length(t["head"]), F.length(t["body"])
        span = F.struct(begin.alias("start"), size.alias("length"))
        spans = F.when(t["fresh"] & t["target"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begin + size + len(CLOSE)).alias("at"), spans.alias("spans"))

    tokens = F.aggregate("list", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    fresh = F.size(F.filter("list", lambda t: t["fresh"]))
    return grouped.select(
        F.col("conv").alias("conv_id"), "window", (F.size("list") - fresh).alias("context"), fresh.alias("turns"), tokens.alias("tokens"), (tokens > budget.window).alias("over_budget"),
        F.array_join(F.transform("list", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("text"), F.aggregate("list", start, step, lambda s: s["spans"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, turns, learned, formatted_chars) per conversation, parsed from the formatted texts alone.

    ``turns`` are the new turns (role, text) of all windows in order, ``learned`` the unescaped texts under the mask.
    This puts a conversation back together, so it is as long as the conversation.
    """
    pieces = F.split("text", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.col("context") + 1, F.size(pieces) - 1 - F.col("context"))

    def parse(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.url_decode(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)))
        return F.struct(role.alias("role"), unescaped(F.substring(piece, F.length(head) + 2, F.length(piece))).alias("text"))

    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    parts = windows.select(
        "conv_id", F.struct("window", F.transform(pieces, parse).alias("turns"), learned.alias("learned")).alias("part"), F.length("text").cast("long").alias("chars")
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.col("parts.turns")).alias("turns"), F.flatten(F.col("parts.learned")).alias("learned"), "formatted_chars")


def digests(windows: DataFrame) -> DataFrame:
    """Digest of each conversation's turns and of its learned text, read back from the windows."""
    back = read_back(windows)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
