"""Chat formatting in budgeted windows, with DataFrame functions alone.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns. Each window repeats the first system
turn and the last turns before its span, as far as the budget allows; only assistant turns of its own span are loss
targets, so each is learned exactly once. Prefix sums are taken per block of turns and then over the blocks, and a
window gathers a bounded number of tokens, so no task needs a whole conversation, however long.

Control strings inside texts and roles get a backslash behind their first character, one more than there already
are, which is undone on reading.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that must not appear in a text as such; those of the template come first.
CONTROLS = (START, BETWEEN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
#: A token, for budgets: a run of letters, a run of digits, or a run of other visible characters.
TOKEN = r"\p{L}+|\p{N}+|[^ \t\n\r\f\x0B\p{L}\p{N}]+"
TURN_OVERHEAD = 4


def _pattern(before_rest: str) -> str:
    """Matches ``before_rest`` between the first character of a control string and its rest, which may be preceded by
    backslashes."""
    by_first: dict[str, list[str]] = {}
    for control in CONTROLS:
        by_first.setdefault(control[0], []).append(re.escape(control[1:]).replace("/", r"\/"))
    return "|".join(rf"(?<=\{c}){before_rest}(?=\\*(?:{'|'.join(rests)}))" for c, rests in by_first.items())


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_pattern("")), F.lit(r"\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_pattern(r"\\")), F.lit(""))


def token_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(TOKEN)) + TURN_OVERHEAD).cast("long")


def positioned(conversations: DataFrame, block: int = 64) -> DataFrame:
    """Each turn with its tokens and ``start``, the tokens of all turns before it. Turns are ordered by number (null
    first), then role and text; null roles and texts are empty."""
    turns = conversations.select(
        "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long").alias("block"),
    ).withColumn("tokens", token_count(F.col("text")))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum")).select(
        F.col("conv_id").alias("block_conv"), F.col("block").alias("block_no"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    same = placed["conv_id"].eqNullSafe(blocks["block_conv"]) & (placed["block"] == blocks["block_no"])
    return placed.join(blocks, same).select("conv_id", "role", "text", "tokens", (F.col("before") + F.col("inside")).alias("start"))


def format_conversations(conversations: DataFrame, budget: int = 1024, target: str = "assistant") -> DataFrame:
    """One row per window: conv_id, first_token, turns, repeated, tokens, formatted, loss.

    A span holds the turns that start in the same cell of the prefix sum, three eighths of the budget wide; a turn
    longer than a cell is the last of its cell and a span of its own. History is at most a quarter of the budget, and
    what the span and the system turn leave. So a window exceeds the budget only where a turn of its span, or its
    system turn, is longer than a cell or a quarter; no text is cut. ``repeated`` is how many leading turns are copies (system turn, history); ``loss`` lists the (start, length)
    of the targets' texts in ``formatted``, in code points. Repeated rows are turns of their own; an empty table has
    no windows.
    """
    width, most = budget * 3 // 8, budget // 4
    turns = positioned(conversations).select(
        "conv_id", "start", "tokens",
        (F.col("role") == "system").alias("is_system"), (F.col("role") == target).alias("is_target"),
        escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"),
        F.floor(F.col("start") / width).cast("long").alias("cell"), (F.col("tokens") > width).alias("long"),
    )

    def window(cell: Column, long: Column, new: bool) -> Column:
        return F.struct(cell.alias("cell"), long.alias("long"), F.lit(new).alias("new"))

    cell, yes, no = F.col("cell"), F.lit(True), F.lit(False)
    near_next = F.col("start") + most >= (cell + 1) * width
    later = F.array(
        F.when(~F.col("long"), window(cell, yes, False)),
        F.when(near_next, window(cell + 1, no, False)),
        F.when(near_next, window(cell + 1, yes, False)),
    )
    windows = F.concat(F.array(window(cell, F.col("long"), True)), F.filter(later, lambda w: w.isNotNull()))
    spread = turns.withColumn("w", F.explode(windows)).groupBy("conv_id", F.col("w.cell").alias("cell"), F.col("w.long").alias("long"))
    row = F.struct("start", "tokens", "role", "text", "is_target", F.col("w.new").alias("new"))
    gathered = spread.agg(F.array_sort(F.collect_list(row)).alias("rows")).filter(F.exists("rows", lambda r: r["new"]))
    system = turns.filter("is_system").groupBy(F.col("conv_id").alias("system_conv")).agg(
        F.min(F.struct("start", "tokens", "role", "text", F.lit(False).alias("is_target"), F.lit(False).alias("new"))).alias("system")
    )
    joined = gathered.join(system, gathered["conv_id"].eqNullSafe(system["system_conv"]), "left").select(
        "conv_id", "rows", "system", F.expr("filter(rows, r -> r.new)").alias("span")
    )
    chosen = (
        joined.withColumn("first_token", F.expr("span[0].start"))
        .withColumn("span_tokens", F.expr("aggregate(span, 0L, (a, r) -> a + r.tokens)"))
        .withColumn("head", F.expr("if(system.start < first_token, array(system), slice(rows, 1, 0))"))
        .withColumn("room", F.expr(f"least({most}, {budget} - span_tokens - if(size(head) > 0, system.tokens, 0))"))
        .withColumn(
            "history",
            F.expr("filter(rows, r -> not r.new and r.start < first_token and r.start >= first_token - room "
                   "and not (size(head) > 0 and r.start = system.start))"),
        )
        .withColumn("all", F.expr("concat(head, history, span)"))
    )
    opening = f"length(r.role) + {len(START) + len(BETWEEN)}"
    whole = f"{opening} + length(r.text) + {len(END) + 1}"
    empty = "cast(array() as array<struct<start: int, length: int>>)"
    spans = (
        f"aggregate(all, struct(0 as at, {empty} as found), (a, r) -> struct(a.at + {whole} as at, "
        f"if(r.new and r.is_target, concat(a.found, array(struct(a.at + {opening} as start, length(r.text) as length))), "
        "a.found) as found), a -> a.found)"
    )
    return chosen.select(
        "conv_id", "first_token", F.size("all").alias("turns"), F.expr("size(head) + size(history)").alias("repeated"),
        F.expr("aggregate(all, 0L, (a, r) -> a + r.tokens)").alias("tokens"),
        F.array_join(F.transform("all", lambda r: F.concat(F.lit(START), r["role"], F.lit(BETWEEN), r["text"], F.lit(END + "\n"))), "").alias("formatted"),
        F.expr(spans).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What windows say: conv_id, first_token, formatted, own (role, text of the turns that are not repeated) and
    targets (the texts under the loss mask), unescaped."""
    ended = re.escape(END) + "\n"

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        return F.struct(
            unescaped(F.split_part(body, F.lit(BETWEEN), F.lit(1))).alias("role"),
            unescaped(F.split_part(body, F.lit(BETWEEN), F.lit(2))).alias("text"),
        )

    pieces = F.slice(F.split("formatted", ended), F.col("repeated") + 1, F.col("turns") - F.col("repeated"))
    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "first_token", "formatted", F.transform(pieces, turn).alias("own"), targets.alias("targets"))


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, from what the windows say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. A conversation's texts meet in one row here, as a digest over all of them needs."""
    said = read_back(windows).select(
        "conv_id", "first_token",
        F.size("own").alias("n"),
        F.array_join(F.transform("own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    one = said.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("first_token", "turns", "loss"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    whole = one.select(
        "conv_id", "n_turns", "formatted_chars",
        F.array_join("parts.turns", "").alias("turns"), F.array_join("parts.loss", "").alias("loss"),
    )
    return whole.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
