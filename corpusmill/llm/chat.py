"""Perspective rotation of multi-party dialogues.

For each participant of a conversation the dialogue is rendered once with that
participant as the assistant, everyone else as a named user, and a loss mask
that covers exactly the participant's own turns. System turns stay system turns
in every rendering: they are context, never trained on and never a perspective.

A rendering comes in blocks of `block_turns` consecutive turns, so a conversation
of any length is never gathered into one row or task; the blocks 0..n_blocks-1 of
(conv_id, perspective) are the whole rendering. A mask counts from its block's
begin, which `block_start` places in the whole.

Turns are put in order by range of (conv_id, turn, role, text), so a conversation
that holds a third of all rows is many parts, and are numbered by part: running
counts within parts, sums of parts before them.

Defined cases: a null or empty text is an empty turn; a null role is the speaker
`unknown`; a null turn sorts first; equal turns are ordered by role, then text;
repeated rows are repeated turns; a conversation of system turns only has no
perspective and no rows; a null conv_id is a conversation of its own; control
markers inside a text and markers and control characters inside a role are broken
up so that content can't forge a turn; no rows give no rows. Only conv_id, turn,
role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, written

BLOCK_TURNS = 32
ASSISTANT, SYSTEM, END = "<|assistant|>\n", "<|system|>\n", "\n<|end|>\n"
#: Marks a range's turns are sorted among beyond (conv_id, turn, role, text), so that repeated rows are dealt too.
SALTS = 64


def spoken(role: Column) -> Column:
    """A role fit for a marker: no control characters, no marker's begin or end."""
    role = F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\p{Cc}\x{2028}\x{2029}]", " ")
    return F.translate(role, "<|>", "(/)")


def _user(role: Column) -> Column:
    return F.concat(F.lit("<|user name="), role, F.lit("|>\n"))


def _head(turn: Column, perspective: Column) -> Column:
    return F.when(turn["role"] == "system", F.lit(SYSTEM)).when(turn["role"] == perspective, F.lit(ASSISTANT)).otherwise(_user(turn["role"]))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, part, number (0.. within its conversation), role and text, in order of conversation."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        spoken(F.col("role")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
    )
    order = ["conv_id", "turn", "role", "text", "salt"]
    ranged = clean.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(ranged.select("conv_id", "role", "text", "at", F.shiftright("at", 33).alias("part")), "turns")
    sums = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = written(sums.select(F.col("conv_id").alias("_conv"), "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    rows = placed.join(small(starts), F.col("conv_id").eqNullSafe(F.col("_conv")) & (placed["part"] == starts["part"]))
    return rows.select("conv_id", placed["part"], (F.col("before") + F.col("at") - F.col("first")).alias("number"), "role", "text")


def block_starts(thin: DataFrame) -> DataFrame:
    """_conv, perspective, _block, block_start, n_blocks from conv_id, part, block, role, n, chars: what each role says in each block."""
    heads = F.when(F.col("role") == "system", F.lit(len(SYSTEM))).otherwise(F.length(_user(F.col("role"))))
    size = F.col("n") * (heads + len(END)) + F.col("chars")
    own = F.when(F.col("role") != "system", F.col("n") * (len(ASSISTANT) - heads)).otherwise(0)  # what a turn's head is shorter by in its own perspective
    thin = written(thin.select("conv_id", "part", "block", "role", size.alias("size"), own.alias("own")), "said")
    blocks = thin.groupBy("conv_id", "part", "block").agg(F.sum("size").alias("size"))
    cast = thin.filter("role <> 'system'").select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    each = blocks.join(small(written(cast, "cast")), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    theirs = thin.filter("role <> 'system'").select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.col("role").alias("_r"), "own")
    each = each.join(theirs, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")) & (F.col("perspective") == F.col("_r")), "left")
    each = written(each.select("conv_id", "perspective", "part", "block", (F.col("size") + F.coalesce("own", F.lit(0))).alias("size")), "sizes")
    parts = each.groupBy("conv_id", "perspective", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    key = Window.partitionBy("conv_id", "perspective")
    before = key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_r"), F.col("part").alias("_p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("n").over(key).alias("n_blocks"))
    running = Window.partitionBy("conv_id", "perspective", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("within", F.coalesce(F.sum("size").over(running), F.lit(0)))
    both = each.join(parts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_r")) & (F.col("part") == F.col("_p")))
    return both.select(F.col("conv_id").alias("_conv"), "perspective", F.col("block").alias("_block"), (F.col("before") + F.col("within")).alias("block_start"), "n_blocks")


def rotate(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, block, n_blocks, block_start, n_turns, n_trained, rendered, mask (array of start, end in the block's code points)."""
    rows = numbered(turns).withColumn("block", F.floor(F.col("number") / block_turns))
    blocks = rows.groupBy("conv_id", "block").agg(F.min("part").alias("part"), F.array_sort(F.collect_list(F.struct("number", "role", "text"))).alias("turns"))
    blocks = written(blocks, "blocks")
    said = blocks.select("conv_id", "part", "block", F.explode(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(t["text"]).alias("chars")))).alias("t"))
    thin = said.groupBy("conv_id", "part", "block", F.col("t.role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum("t.chars").alias("chars"))
    starts = block_starts(thin)
    both = blocks.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    parts = F.transform("turns", lambda t: F.struct(_head(t, F.col("perspective")).alias("head"), t["text"].alias("text"), (t["role"] == F.col("perspective")).alias("own")))
    both = both.withColumn("parts", parts).drop("turns")
    walk = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["text"]) + len(END)).alias("at"),
            F.when(p["own"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["text"])).alias("end"))))).otherwise(a["mask"]).alias("mask"),
        ),
        lambda a: a["mask"],
    )
    return both.select(
        "conv_id",
        "perspective",
        "block",
        "n_blocks",
        "block_start",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("rendered"),
        walk.alias("mask"),
    )


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.withColumn("mask", mask)


ORACLE = r"""
WITH clean AS (
  SELECT conv_id, turn, translate(regexp_replace(coalesce(role, 'unknown'), '[\x00-\x1F\x7F-\x{9F}\x{2028}\x{2029}]', ' ', 'g'), '<|>', '(/)') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
numbered AS (
  SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // 32)::BIGINT AS block FROM clean),
cast_ AS (SELECT DISTINCT conv_id, role AS perspective FROM clean WHERE role <> 'system'),
parts AS (
  SELECT t.conv_id, c.perspective, t.block, t.turn, t.role, t.text, t.role = c.perspective AS own,
         CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              WHEN t.role = c.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head
  FROM numbered t JOIN cast_ c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(text) + 9) OVER (
    PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM parts),
blocks AS (
  SELECT conv_id, perspective, block, count(*)::BIGINT AS n_turns, max(upto) AS size,
         count(*) FILTER (WHERE own)::BIGINT AS n_trained,
         string_agg(head || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
         coalesce(string_agg((upto - 9 - length(text))::VARCHAR || ':' || (upto - 9)::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, text)
                  FILTER (WHERE own), '') AS mask
  FROM placed GROUP BY conv_id, perspective, block)
SELECT conv_id, perspective, block, n_turns, n_trained, rendered, mask, count(*) OVER (PARTITION BY conv_id, perspective)::BIGINT AS n_blocks,
       coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start
FROM blocks
"""
