"""Chat formatting: logged snapshots that prefix a longer conversation go; what is left is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpoint, table

#: Marks around a turn (fixed values of the output format).
TURN = ("<|", "|>\n", "\n<|end|>\n")


#: Parts of a prefix hash, 60 bits each.
PARTS = 4


def turn_hash(place: Column, role: Column, text: Column) -> list[Column]:
    """The parts of the SHA-256 of a turn and its place; role and text with their lengths, so nulls and empty ones differ."""
    size = lambda c: F.coalesce(F.octet_length(c).cast("string"), F.lit("null"))
    digest = F.sha2(F.concat_ws("|", place.cast("string"), size(role), size(text), F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))), 256)
    return [F.conv(F.substring(digest, 16 * k + 1, 15), 16, 10).cast("long") for k in range(PARTS)]


def render(turns: Column) -> Column:
    head, mid, tail = TURN
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(head), F.coalesce(t["role"], F.lit("")), F.lit(mid), F.coalesce(t["text"], F.lit("")), F.lit(tail))), "")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_same (equal logs, itself included), rendered.

    Turns are ordered by turn, nulls first, then role and text, and repeated rows are separate turns. A conversation
    is dropped if its whole turn list is a strict prefix of another's, or equal to that of a smaller conv_id (null is
    the largest). Null roles and texts render empty but differ from empty ones. An empty table gives an empty one; other columns are not read.

    The hash of a prefix rolls along the turns: each turn's hash, with its place in it, is xored to that of the turns before, so a
    conversation costs in proportion to its turns however many they are. Equal conversations meet in a partial
    aggregate, and prefixes are made distinct before the anti-join, so no key of either join repeats. Only kept conversations are
    rendered; one is a single row then, whatever its length.
    """
    c = conversations.select(*(F.col(n).cast(t) for n, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = c.withColumn("place", F.row_number().over(along))
    hashes = turn_hash(F.col("place"), F.col("role"), F.col("text"))
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"h{k}" for k in range(PARTS)]
    parts = placed.select("conv_id", "place", *(h.alias(n) for h, n in zip(hashes, names)))
    after = F.lead("place").over(Window.partitionBy("conv_id").orderBy("place"))
    rolled = checkpoint(parts.select("conv_id", "place", *(F.bit_xor(n).over(upto).alias(n) for n in names), after.isNull().alias("whole")))
    order = F.struct(F.col("conv_id").isNull().alias("last"), F.col("conv_id"))
    winners = rolled.filter("whole").groupBy("place", *names).agg(F.min(order).alias("id"), F.count("*").alias("n_same"))
    prefixes = rolled.filter("not whole").select("place", *names).distinct()
    maximal = winners.join(prefixes, ["place", *names], "left_anti").select(F.col("id.conv_id").alias("kept_id"), F.col("place").cast("long").alias("n_turns"), "n_same")
    kept = c.join(maximal, c.conv_id.eqNullSafe(maximal.kept_id))
    turns = kept.groupBy("conv_id", "n_turns", "n_same").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", "n_turns", "n_same", render(F.col("turns")).alias("rendered"))


def op2_chat_format(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


OP2_SQL = """
with logged as (
  select conv_id, list(struct_pack(r := role, t := text) order by turn, role, text) as turns,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' order by turn, role, text) as rendered
  from conversations group by conv_id
), kept as (
  select min(conv_id) as conv_id, turns, any_value(rendered) as rendered, count(*) as n_same from logged group by turns
), prefixes as (
  select distinct turns[1:k] as turns from (select turns, unnest(range(1, len(turns))) as k from kept)
)
select conv_id, len(turns) as n_turns, n_same, rendered from kept anti join prefixes using (turns)
"""
