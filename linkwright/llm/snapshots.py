"""Operator 8, chat formatting: logged conversations that prefix longer ones are collapsed, the rest rendered.

Turns are hashed with their place in the conversation (the first is 1, whatever its number), and a
conversation's rolling hash after a place is the sum (modulo 2 ** 64, twice, under two seeds) of its
hashes so far; so prefixes are compared by (turns, sums) without gathering a conversation. For each
distinct prefix the longest conversation that has it, and the smallest id of that length with that
very end, are taken by a grouped maximum, combined before the shuffle. A conversation whose whole is
a prefix of a longer one, or equals one with a smaller id, is removed by an anti-join; the others are
rendered turn by turn.

Places and running sums come in two steps, over blocks of turns and within a block, so one very long
conversation is dealt over many tasks; rows of one turn number are summed before anything else, and a
first turn that very many share is one row after the partial aggregation. Texts move once, in the
anti-join, and not at all if what is removed is small enough for Spark to broadcast.

Defined cases: a repeated row (same conversation, turn, role and text) counts once; rows with a null
conversation id are one conversation; a null turn comes first; a null role is "unknown"
and a null text is empty; turns of one number share a place and stand there in order of role and
text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, TURN_END = "<|", "|>", "<|end|>"


def halves(column: str) -> list[Column]:
    """The two halves of a long, whose sums do not overflow."""
    return [F.col(column).bitwiseAND(0xFFFFFFFF).alias(f"{column}l"), F.shiftright(column, 32).alias(f"{column}h")]


def folded(low: str, high: str) -> Column:
    """Sums of halves as one number modulo 2 ** 64: the high half modulo 2 ** 32, then the low one."""
    top = (F.col(high) + F.shiftright(low, 32)).bitwiseAND(0xFFFFFFFF)
    return F.shiftleft(top, 32).bitwiseOR(F.col(low).bitwiseAND(0xFFFFFFFF))


def turns(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turn, n, r1, r2: for each turn number its distinct rows and two hashes of their set; no texts."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))
    parts = [F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))]
    slim = conversations.select(F.col(conv).alias("conv"), turn.alias("turn"), F.xxhash64(F.lit(1), *parts).alias("r1"), F.xxhash64(F.lit(2), *parts).alias("r2"))
    distinct = slim.groupBy("conv", "turn", "r1", "r2").agg(F.lit(1).alias("one"))
    sums = distinct.select("conv", "turn", *halves("r1"), *halves("r2")).groupBy("conv", "turn").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in ("r1l", "r1h", "r2l", "r2h")))
    return sums.select("conv", "turn", "n", folded("r1l", "r1h").alias("r1"), folded("r2l", "r2h").alias("r2"))


def running(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (conv, block, turn, ...) with the sums of the named columns up to each turn and over the conversation, name_all."""
    blocks = rows.groupBy("conv", "block").agg(*(F.sum(x).alias(x) for x in names))
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("conv_"), F.col("block").alias("block_"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_0") for x in names), *(F.sum(x).over(whole).alias(f"{x}_all") for x in names))
    inside = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", *(F.sum(x).over(inside).alias(f"{x}_1") for x in names))
    kept = [c for c in rows.columns if c not in names]
    both = run.join(blocks, run["conv"].eqNullSafe(F.col("conv_")) & (run["block"] == F.col("block_")))
    return both.select(*kept, *((F.col(f"{x}_0") + F.col(f"{x}_1")).alias(x) for x in names), *(f"{x}_all" for x in names))


def prefixes(rows: DataFrame, block_turns: int = 64) -> DataFrame:
    """conv, turn, n, s1, s2: turns so far and rolling hashes after each turn number, and n_all of the whole."""
    each = rows.withColumn("block", F.floor(F.col("turn") / block_turns)).withColumn("place", F.lit(1))
    placed = running(each, ["place"])
    hashed = placed.select("conv", "block", "turn", "n", *(F.xxhash64(F.lit(k), "place", "n", "r1", "r2").alias(f"h{k}") for k in (1, 2)))
    rolled = running(hashed.select("conv", "block", "turn", "n", *halves("h1"), *halves("h2")), ["n", "h1l", "h1h", "h2l", "h2h"])
    return rolled.select("conv", "turn", "n", folded("h1l", "h1h").alias("s1"), folded("h2l", "h2h").alias("s2"), "n_all")


def snapshots(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, n_all, maximal: for each conversation its turns, and whether no other one covers it.

    Of equal conversations the one with the smallest id is maximal; the null id comes after all.
    """
    rolled = prefixes(turns(conversations, conv))
    order = F.struct((-F.col("n_all")).alias("length"), F.col("conv").isNull().alias("nameless"), F.col("conv").alias("conv"))
    first = rolled.groupBy("n", "s1", "s2").agg(F.min(order).alias("first"))
    ends = rolled.where("n = n_all").select("conv", "n", "s1", "s2", "n_all")
    judged = ends.join(first, ["n", "s1", "s2"])
    return judged.select("conv", "n_all", ((F.col("first.length") == -F.col("n_all")) & F.col("first.conv").eqNullSafe(F.col("conv"))).alias("maximal"))


def render(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, rendered, trainable, in the template's form; one row a turn, any order.

    Marks of the template inside a text are broken up, and in a role each character of a mark and each
    line break becomes a low line, so neither can open a turn of its own.
    """
    role = F.coalesce("role", F.lit("unknown"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("< |"))
    rendered = F.concat(F.lit(OPEN), F.regexp_replace(role, r"[<|>\r\n]", "_"), F.lit(CLOSE + "\n"), text, F.lit(TURN_END + "\n"))
    return conversations.select(F.col(conv).alias(conv), "turn", role.alias("role"), rendered.alias("rendered"), (role == "assistant").alias("trainable"))


def collapse(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The distinct turns of the maximal conversations."""
    covered = snapshots(conversations, conv).where("not maximal").select(F.col("conv").alias("covered_"))
    rows = conversations.select(conv, "turn", "role", "text")
    left = rows.join(covered, rows[conv].eqNullSafe(covered["covered_"]), "left_anti")
    return left


def chat_rows(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Rendered turns of the maximal conversations, each distinct turn once."""
    return render(collapse(conversations, conv), conv).groupBy(conv, "turn", "role", "trainable", F.xxhash64("rendered").alias("h_")).agg(F.min("rendered").alias("rendered")).drop("h_")
