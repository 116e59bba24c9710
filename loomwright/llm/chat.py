"""Chat formatting of logged conversations, after the collapse of cumulative snapshots.

A service that logs a conversation after every turn leaves many that are prefixes of a longer one. Every turn
carries a rolling hash of the turns up to it; a conversation whose last hash is a hash within a longer one goes,
by an anti-join. Only DataFrame functions are used; hashes are combined before they are shuffled, so a first turn
that a third of all conversations share is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import columns_of


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn between the markers that the ChatML format uses."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of the conversations that are no prefix of a longer one.

    ``turns`` needs conv_id, turn, role and text; turns go by (turn, role, text), nulls first, so repeated rows are
    turns too. A null role or text counts as empty. Equal conversations leave the one with the smallest conv_id.
    Turns without a conv_id take no part; an empty table gives an empty one.
    """
    turns = columns_of(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conversation = Window.partitionBy("conv_id")
    ordered = conversation.orderBy("turn", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The place is part of what is hashed, so the running exclusive-or depends on the order of the turns.
    placed = turns.withColumn("place", F.row_number().over(ordered)).withColumn("n_turns", F.count("*").over(conversation))
    rolling = placed.withColumn("h1", F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far)).withColumn("h2", F.bit_xor(F.xxhash64("text", "place", "role", F.lit(1))).over(so_far))
    hashes = rolling.select("conv_id", "place", "n_turns", "h1", "h2")
    prefixes = hashes.where("place < n_turns").select("place", "h1", "h2").distinct()
    whole = hashes.where("place = n_turns").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    maximal = whole.join(prefixes, ["place", "h1", "h2"], "left_anti").select("conv_id")
    pieces = placed.join(maximal, "conv_id").select("conv_id", "place", rendered_turn(F.col("role"), F.col("text")).alias("piece"))
    told = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("turns"))
    return told.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.piece"), "").alias("rendered"))


FORMAT_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS told
  FROM t
), whole AS (SELECT place, told, min(conv_id) AS conv_id FROM p WHERE place = n_turns GROUP BY place, told)
SELECT conv_id, CAST(place AS BIGINT) AS n_turns, told AS rendered
FROM whole
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n_turns AND p.place = whole.place AND p.told = whole.told)
"""
