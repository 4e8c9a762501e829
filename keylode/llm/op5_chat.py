"""Logged conversations: only maximal ones stay, rendered for training.

Chat logs hold snapshots: the same conversation again and again, each time some turns
longer.  A rolling fingerprint of every prefix of turns identifies snapshots: a
conversation whose whole fingerprint is a proper prefix of another, or equals that of
a conversation of smaller id, is dropped by an anti-join.  What is left is rendered.

Only DataFrame functions are used.  The fingerprint of a prefix is the exclusive-or of
a 128-bit digest (md5) of each turn with its place, role and text.  Places and rolling
fingerprints are built in two levels: turns are numbered within blocks of TURNS turn
values, and the blocks' totals are rolled up on their own, so a conversation of very
many turns is never one sorted group.

Turns are ordered by turn, then role, then text; null turns come first.  Null roles
render as "unknown", null texts as nothing; both differ from the empty string in
fingerprints.  Repeated rows are turns of their own.  Rows without a conversation id
are left out.  Other columns have no influence.  Rendered text comes in parts: turns of
one block, so that a part is bounded; short conversations have one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keylode.llm.work import Work, read

TURNS = 64


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, block, place (from 1), role, text, p1, p2: the fingerprint of the
    conversation up to and with this turn."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    block = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))).cast("long")
    rows = rows.withColumn("block", block)
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("place_in", F.row_number().over(within))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    placed = rows.join(before, ["conv_id", "block"]).withColumn("place", F.col("before") + F.col("place_in"))
    digest = F.md5(F.to_json(F.struct("place", "role", "text"), {"ignoreNullFields": "false"}))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    placed = placed.withColumn("h1", half(1)).withColumn("h2", half(17))
    running = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumn("r1", F.expr("bit_xor(h1)").over(running)).withColumn("r2", F.expr("bit_xor(h2)").over(running))
    totals = placed.groupBy("conv_id", "block").agg(F.expr("bit_xor(h1)").alias("t1"), F.expr("bit_xor(h2)").alias("t2"))
    zero = F.lit(0).cast("long")
    base = totals.select("conv_id", "block", *(F.coalesce(F.expr(f"bit_xor(t{k})").over(earlier), zero).alias(f"b{k}") for k in (1, 2)))
    out = rolled.join(base, ["conv_id", "block"])
    return out.select("conv_id", "block", "place", "role", "text", *(F.expr(f"r{k} ^ b{k}").alias(f"p{k}") for k in (1, 2)))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no longer one begins with, one
    for equal ones, and n_copies: how many equal ones there are."""
    size = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    marked = prefixes.select("conv_id", "place", "p1", "p2").join(size, "conv_id")
    whole = marked.where("place = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = marked.where("place < n_turns").select(F.col("place").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(prefixes: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, text: the turns of a block in ChatML form."""
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = prefixes.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "block", F.struct("place", said.alias("said")).alias("turn"))
    blocks = rows.groupBy("conv_id", "n_turns", "n_copies", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    numbers = Window.partitionBy("conv_id").orderBy("first")
    return blocks.select("conv_id", "n_turns", "n_copies", F.expr("turns[0].place").alias("first"), F.expr("concat_ws('', turns.said)").alias("text")).select(
        "conv_id", (F.row_number().over(numbers) - 1).cast("long").alias("part"), "n_turns", "n_copies", "text"
    )


def collapse(turns: DataFrame, work: Work | None = None) -> DataFrame:
    work = work or Work(turns.sparkSession, "chat")
    prefixes = work.table(numbered(turns), "prefixes")
    kept = work.table(maximal(prefixes), "kept")
    return rendered(prefixes, kept)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(read(spark, sf_dir, "conversations"))


SQL = """
with placed as (
    select conv_id, turn, role, text,
        row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place,
        coalesce(floor(turn / 64), -4611686018427387904) as block
    from conversations where conv_id is not null
),
rolled as (
    select *, md5(string_agg(md5(concat(coalesce('r' || role, 'n'), chr(1), coalesce('t' || text, 'n'))), ',') over (partition by conv_id order by place rows unbounded preceding)) as p
    from placed
),
size as (select conv_id, max(place) as n_turns from rolled group by 1),
whole as (
    select n_turns, p, min(conv_id) as conv_id, count(*) as n_copies
    from rolled join size using (conv_id) where place = n_turns group by 1, 2
),
kept as (
    select conv_id, n_turns, n_copies from whole
    where not exists (select 1 from rolled join size using (conv_id) where rolled.p = whole.p and place < size.n_turns)
),
blocks as (
    select conv_id, n_turns, n_copies, block, min(place) as first,
        string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by place) as text
    from rolled join kept using (conv_id) group by 1, 2, 3, 4
)
select conv_id, cast(row_number() over (partition by conv_id order by first) - 1 as bigint) as part, n_turns, n_copies, text from blocks
"""

QUERY, ORACLE = ("op5_chat", op5_chat), SQL
