"""Chat formatting in budgeted windows, in DataFrame expressions only.

Prefix sums of turn tokens choose turn-aligned spans. A conversation's spans have room for `budget` tokens less those
of its system turn and of the repeated history, a quarter of the budget at least (`room`): turn i belongs to the cell
of a grid of `room` tokens in which its last token falls, and if the cell's turns together exceed the room, the one that
crosses into the cell from the left (no other can) has a span of its own. The sums are hierarchical: within blocks of
`BLOCK` turn numbers, then over the block totals, so that one long conversation is spread over many tasks.

Every span after the first starts with the conversation's first system turn, then repeats up to `history` turns just
before the span, as many as fit `history_tokens` and what the budget leaves beside the system and the own turns. So no
span exceeds the budget unless its only turn does with the system turn, or the system turn alone takes more than three
quarters of it less the history. Repeated turns are outside the loss mask, so each assistant text is a target once.

The template writes a turn as `<s>[role]\n` text `</s>`. In roles and texts `%`, `<` and `[`/`]` become `%25`,
`%3C`, `%5B` and `%5D`, which is reversible; control strings therefore never occur inside a text.

Edge cases: null text counts as empty, null role as the empty role, null turn sorts first (by a hash of role and text,
which spreads many of them); equal turns are ordered by role, then text; a null conversation id is a conversation of its
own; a turn longer than the room stands in a span of its own; an empty table gives an empty result; only the columns
named are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TOKENS, BLOCK, NULL_BLOCKS = 2048, 2, 512, 64, 1024


def escape(x: Column) -> Column:
    for a, b in (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("]", "%5D")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column) -> Column:
    for a, b in (("]", "%5D"), ("[", "%5B"), ("<", "%3C"), ("%", "%25")):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def token_estimate(text: Column) -> Column:
    """Four characters count as a token; every turn has one at least."""
    return F.greatest(F.ceil(F.length(text) / 4), F.lit(1)).cast("long")


def placed_turns(df: DataFrame, conv: str, turn: str, role: str, text: str, budget: int, history_tokens: int) -> DataFrame:
    """conv, r (row number), before and upto (token sums), system (tokens of the first system turn), span (cell, alone),
    role, text of every turn."""
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("n", token_estimate(F.col("text")))
    unnumbered = F.pmod(F.xxhash64("role", "text"), F.lit(NULL_BLOCKS)) - 2**40
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), unnumbered))
    inner = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"r0": F.row_number().over(inner.orderBy("turn", "role", "text")), "sum0": F.sum("n").over(inner)})
    first_system = F.min(F.when(F.col("role") == "system", F.struct("turn", "role", "text", "n")))
    totals = rows.groupBy("conv", "block").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), first_system["n"].alias("system"))
    outer = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earliest = F.min_by("system", F.when(F.col("system").isNotNull(), F.col("block"))).over(Window.partitionBy("conv"))
    totals = totals.select(
        F.col("conv").alias("conv_t"), F.col("block").alias("block_t"), F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("rows0"),
        F.coalesce(F.sum("tokens").over(outer), F.lit(0)).alias("tokens0"), F.coalesce(earliest, F.lit(0)).alias("system"),
    )
    on = F.col("conv").eqNullSafe(F.col("conv_t")) & (F.col("block") == F.col("block_t"))
    upto = F.col("sum0") + F.col("tokens0")
    room = F.greatest(F.lit(budget - history_tokens) - F.col("system"), F.lit(budget // 4), F.lit(1)).cast("long")
    placed = local.join(totals, on).select("conv", (F.col("r0") + F.col("rows0")).alias("r"), (upto - F.col("n")).alias("before"), upto.alias("upto"), "system", room.alias("room"), "role", "text")
    placed = placed.withColumn("cell", F.floor((F.col("upto") - 1) / F.col("room")))
    return placed.withColumn("crosses", F.col("before") < F.col("cell") * F.col("room"))


def with_spans(placed: DataFrame) -> DataFrame:
    """Adds span: 2 * cell, and one more for the cell's own turns where the one that crosses into it stands alone."""
    cells = placed.groupBy("conv", "cell").agg((F.max("upto") - F.min("before") > F.first("room")).alias("over"))
    cells = cells.where("over").select(F.col("conv").alias("conv_c"), F.col("cell").alias("cell_c"))
    on = F.col("conv").eqNullSafe(F.col("conv_c")) & (F.col("cell") == F.col("cell_c"))
    alone = F.col("cell_c").isNotNull() & ~F.col("crosses")
    return placed.join(cells, on, "left").select("conv", "r", "before", "upto", "system", (2 * F.col("cell") + alone.cast("long")).alias("span"), "role", "text")


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, target: str = "assistant") -> DataFrame:
    """One row per span: conv, span, formatted, loss (array of start, end), new_from (where its own turns begin), n_new,
    tokens (of all its turns, repeated ones too).

    Offsets are code points from 0. Only the texts of `target` turns among the span's own are under the mask."""
    turns = with_spans(placed_turns(df, conv, turn, role, text, budget, history_tokens))
    starts = turns.groupBy("conv", "span").agg(F.min("r").alias("first"), F.min("before").alias("at"), (F.max("upto") - F.min("before")).alias("own"), F.first("system").alias("system"))
    later = starts.where("first > 1")
    same_conv = F.col("conv").eqNullSafe(F.col("c"))
    system = turns.where("role = 'system'").groupBy(F.col("conv").alias("c")).agg(F.min_by(F.struct("r", "role", "text"), "r").alias("s"))
    kept = later.join(system, same_conv).where("s.r < first").select("conv", "span", F.lit(0).alias("kind"), F.col("s.r").alias("r"), F.col("s.role").alias("role"), F.col("s.text").alias("text"))
    room = F.least(F.lit(history_tokens), F.lit(budget) - F.col("system") - F.col("own"))
    wanted = later.select(F.col("conv").alias("c"), F.col("span").alias("span_of"), "at", room.alias("room"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("first") - history), F.col("first") - 1)).alias("r_of"))
    repeated = (
        turns.where("role <> 'system'")
        .join(wanted, same_conv & (F.col("r") == F.col("r_of")))
        .where(F.col("at") - F.col("before") <= F.col("room"))
        .select("conv", F.col("span_of").alias("span"), F.lit(1).alias("kind"), "r", "role", "text")
    )
    own = turns.select("conv", "span", F.lit(2).alias("kind"), "r", "role", "text")
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]\n"))
    body = escape(F.col("text"))
    pieces = own.unionByName(kept).unionByName(repeated).select(
        "conv", "span", "kind", "r", F.concat(head, body, F.lit("</s>")).alias("piece"), F.length(head).alias("head_n"), F.length(body).alias("body_n"), ((F.col("kind") == 2) & (F.col("role") == target)).alias("loss"), token_estimate(F.col("text")).alias("n")
    )
    upto = F.sum(F.length("piece")).over(Window.partitionBy("conv", "span").orderBy("kind", "r").rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("at", upto - F.length("piece"))
    start = F.col("at") + F.col("head_n")
    mask = F.when(F.col("loss"), F.struct(start.alias("start"), (start + F.col("body_n")).alias("end")))
    gathered = pieces.groupBy("conv", "span").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(mask)).alias("loss"),
        F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("new_from"),
        F.sum((F.col("kind") == 2).cast("long")).alias("n_new"),
        F.sum("n").alias("tokens"),
    )
    return gathered.select("conv", "span", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss", "new_from", "n_new", "tokens")


def read_turns(formatted: Column, new_from: Column) -> Column:
    """The span's own turns, read back: array of (role, text)."""
    own = F.expr("1").cast("int") + new_from.cast("int")
    parts = F.filter(F.split(F.substring(formatted, own, F.length(formatted)), "</s>", -1), lambda x: x != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, F.lit(5), F.length(p)), "]\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "]\n") + 2, F.length(p))).alias("text"),
        ),
    )


def read_targets(formatted: Column, loss: Column) -> Column:
    """All text under the span's loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chat_digest(spans: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the formatted spans."""
    turns = read_turns(F.col("formatted"), F.col("new_from"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = spans.select("conv", "span", F.size(turns).alias("n"), said.alias("said"), read_targets(F.col("formatted"), F.col("loss")).alias("target"), F.length("formatted").alias("chars"))
    one = rows.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("span", "said", "target"))).alias("x"), F.sum("chars").alias("formatted_chars"))
    target = F.array_join(F.transform("x", lambda s: s["target"]), "")
    return one.select(
        F.col("conv").alias(conv_id),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("x", lambda s: s["said"]), ""), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
