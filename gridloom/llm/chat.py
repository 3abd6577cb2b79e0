"""Multi-party perspective rotation: a dialogue rendered once for each participant, who is then the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle

#: Turns of a row, and turns before these that come along as context.
PART_TURNS, CONTEXT_TURNS = 256, 128


def escaped(text: Column) -> Column:
    """Text in which no mark of the format can stand: ``<|im_`` becomes ``&lt;|im_``."""
    return F.replace(text, F.lit("<|im_"), F.lit("&lt;|im_"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls replaced), n (from 0 on, in order of turn, role and text) and total, the conversation's number of turns.

    Turns are sorted globally, so that a conversation that holds a third of all of them
    lies in many partitions; only its counts by partition meet.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    ranged = settle(ranged.withColumn("range", F.shiftright("id", 33)), "turns")
    counts = ranged.groupBy("conv_id", "range").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "range", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("conv_id")).alias("total"))
    same = F.col("t.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("t.range") == F.col("c.range"))
    return ranged.alias("t").join(counts.alias("c"), same).select("t.conv_id", "t.turn", "t.role", "t.text", (F.col("t.id") - F.col("c.first") + F.col("c.before")).alias("n"), "c.total")


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS, context_turns: int = CONTEXT_TURNS) -> DataFrame:
    """Renders (conv_id, turn, role, text) for every participant (every role but system).

    Returns conv_id, speaker (the participant), part, n_turns, n_context, rendered,
    mask, n_masked. In ``rendered`` the participant's turns are the assistant's, others
    are named users, system turns stay; mask lists the half-open character ranges
    ``start-end`` on which to train: the speaker's texts with the mark that ends them,
    comma-joined; n_masked is their length. Marks inside texts and roles are escaped
    (see escaped) and line breaks in roles are spaces, so that no text can pose as
    another turn.

    A conversation of more than ``part_turns`` turns has several parts of so many turns
    each. Every later part begins with the ``context_turns`` turns before it, which the
    mask leaves out: every turn is trained on once, with what was said before. That
    bounds a row, whatever the length of a conversation.

    Null texts are empty, a null role is named unknown, a null turn counts as 0, a
    null conv_id is a conversation like others. Equal turn numbers are ordered by
    role and text, repeated rows all stay. Conversations without a participant and
    empty tables give no rows. Other columns are ignored.
    """
    if context_turns > part_turns:
        raise ValueError("more context than a part has turns")
    rows = numbered_turns(turns)
    speakers = rows.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    part = F.floor(F.col("n") / part_turns).cast("long")
    later = ((F.col("n") % part_turns) >= part_turns - context_turns) & ((part + 1) * part_turns < F.col("total"))
    parts = F.when(later, F.array(part, part + 1)).otherwise(F.array(part))
    turn = F.struct("n", (part == F.col("part")).alias("fresh"), "role", F.translate(escaped(F.col("role")), "\r\n", "  ").alias("name"), escaped(F.col("text")).alias("text"))
    packs = rows.withColumn("part", F.explode(parts)).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    both = packs.alias("b").join(speakers.alias("s"), F.col("b.conv_id").eqNullSafe(F.col("s.conv_id"))).select("b.conv_id", "s.speaker", "b.part", "b.turns")
    pieces = """transform(turns, t -> named_struct('own', t.fresh AND t.role = speaker,
        'head', concat('<|im_start|>', CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = speaker THEN 'assistant' ELSE concat('user name=', t.name) END, '\n'),
        'body', concat(t.text, '<|im_end|>')))"""
    both = both.withColumn("pieces", F.expr(pieces))
    ranges = """aggregate(pieces, named_struct('at', 0L, 'list', cast(array() AS array<string>), 'n', 0L), (acc, p) -> named_struct(
        'at', acc.at + char_length(p.head) + char_length(p.body) + 1,
        'list', CASE WHEN p.own THEN array_append(acc.list, concat(acc.at + char_length(p.head), '-', acc.at + char_length(p.head) + char_length(p.body))) ELSE acc.list END,
        'n', acc.n + CASE WHEN p.own THEN char_length(p.body) ELSE 0 END))"""
    both = both.withColumn("r", F.expr(ranges)).withColumn("new", F.expr("size(filter(turns, t -> t.fresh))").cast("long"))
    return both.select("conv_id", "speaker", "part", F.col("new").alias("n_turns"), (F.size("turns") - F.col("new")).cast("long").alias("n_context"), F.expr("array_join(transform(pieces, p -> concat(p.head, p.body, '\n')), '')").alias("rendered"), F.array_join("r.list", ",").alias("mask"), F.col("r.n").alias("n_masked"))


def op6_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH r AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM r),
m AS (
  SELECT *, n // {PART_TURNS} AS part, true AS fresh FROM o
  UNION ALL SELECT *, n // {PART_TURNS} + 1 AS part, false AS fresh FROM o WHERE n % {PART_TURNS} >= {PART_TURNS - CONTEXT_TURNS} AND (n // {PART_TURNS} + 1) * {PART_TURNS} < total),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
x AS (
  SELECT m.conv_id, s.speaker, m.part, m.n, m.fresh, m.fresh AND m.role = s.speaker AS own,
    '<|im_start|>' || CASE WHEN m.role = 'system' THEN 'system' WHEN m.role = s.speaker THEN 'assistant' ELSE 'user name=' || translate(replace(m.role, '<|im_', '&lt;|im_'), chr(13) || chr(10), '  ') END || chr(10) AS head,
    replace(m.text, '<|im_', '&lt;|im_') || '<|im_end|>' AS body
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
  FROM x)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, count(*) FILTER (fresh) AS n_turns, count(*) FILTER (NOT fresh) AS n_context, string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(pos AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY pos), '') AS mask,
  CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_masked
FROM y GROUP BY conv_id, speaker, part
"""
