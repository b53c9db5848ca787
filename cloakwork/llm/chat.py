"""Multi-party chat formatting: each dialogue once for every participant, who speaks as the assistant.

Native DataFrame operations only. A dialogue is ordered by turn, role and text and may be of any
length: its messages are dealt out by range, offsets come from sums over each range and over the
ranges before it, and the rendering is assembled in parts of about ``part_chars`` characters, so no
task holds a whole dialogue.

Nulls: a null conv_id is a dialogue of its own, a null turn comes first, a null role is the speaker
``unknown``, a null text is empty. Repeated rows are messages each. Messages of ``system`` (a
parameter) are shown as such and have no rendering of their own; a dialogue of system messages only
has none. ``<|`` inside a text is shown as ``< |``, so no text can fake a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PART_CHARS = 65_536


def perspectives(conversations: DataFrame, system: str = "system", part_chars: int = PART_CHARS) -> DataFrame:
    """One row for each part of each rendering of ``conversations`` (conv_id, turn, role, text).

    conv_id, perspective (the role that speaks as assistant), part, first_turn and n_messages of the
    part, n_targets (messages of the perspective), start (its first character in the whole
    rendering), text, and mask: spans ``from-to`` of the whole rendering on which to train, comma-joined.
    """
    messages = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    # The number of the range is fixed by a written table; each later use sees the same one.
    dealt = materialise(
        messages.repartitionByRange("conv_id", "turn", "role", "text").withColumn("range", F.spark_partition_id()), "chat-ranges"
    )
    # As a named user a message is longer by its speaker's name; so each perspective has its own offsets.
    length = F.length("text")
    name = F.length("role")
    is_system = F.col("role") == system
    as_other = F.when(is_system, F.lit(len("<|system|>"))).otherwise(F.lit(len("<|user name=|>")) + name) + 1 + length + len("<|end|>\n")
    as_self = F.lit(len("<|assistant|>")) + 1 + length + len("<|end|>\n")
    sized = dealt.withColumns({"other_chars": as_other.cast("long"), "gain": (as_self - as_other).cast("long")})
    speakers = dealt.where(~is_system).select("conv_id", F.col("role").alias("perspective")).distinct()

    def before(order):
        return order.rowsBetween(Window.unboundedPreceding, -1)

    # Sums of each range before the message, whoever speaks, and of the speaker's own messages.
    in_range = Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")
    ranges = sized.groupBy("conv_id", "range").agg(F.sum("other_chars").alias("chars"))
    earlier = ranges.select(
        "conv_id", "range", F.coalesce(F.sum("chars").over(before(Window.partitionBy("conv_id").orderBy("range"))), F.lit(0)).alias("earlier")
    )
    placed = (
        sized.withColumn("at", F.coalesce(F.sum("other_chars").over(before(in_range)), F.lit(0)))
        .withColumn("number", F.row_number().over(in_range))
        .alias("m")
        .join(earlier.alias("e"), F.col("m.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("m.range") == F.col("e.range")))
        .select("m.*", "e.earlier")
    )
    each = (
        placed.alias("m")
        .join(speakers.alias("s"), F.col("m.conv_id").eqNullSafe(F.col("s.conv_id")))
        .select("m.*", "perspective", (F.col("role") == F.col("perspective")).alias("own"))
        .withColumn("own_gain", F.when(F.col("own"), F.col("gain")).otherwise(0))
    )
    gains = each.where("own").groupBy("conv_id", "perspective", "range").agg(F.sum("own_gain").alias("gain"))
    spans = (
        each.select("conv_id", "perspective", "range").distinct().alias("r")
        .join(
            gains.alias("g"),
            F.col("r.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("r.perspective") == F.col("g.perspective")) & (F.col("r.range") == F.col("g.range")),
            "left",
        )
        .select("r.*", F.coalesce("gain", F.lit(0)).alias("gain"))
        .withColumn("earlier_gain", F.coalesce(F.sum("gain").over(before(Window.partitionBy("conv_id", "perspective").orderBy("range"))), F.lit(0)))
    )
    in_view = Window.partitionBy("conv_id", "perspective", "range").orderBy("number")
    shifted = (
        each.withColumn("shift", F.coalesce(F.sum("own_gain").over(before(in_view)), F.lit(0)))
        .alias("m")
        .join(
            spans.alias("g"),
            F.col("m.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("m.perspective") == F.col("g.perspective")) & (F.col("m.range") == F.col("g.range")),
        )
        .select("m.*", (F.col("earlier") + F.col("at") + F.col("shift") + F.col("earlier_gain")).alias("start"))
    )
    head = (
        F.when(F.col("own"), F.lit("<|assistant|>"))
        .when(is_system, F.lit("<|system|>"))
        .otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>")))
    )
    shown = shifted.select(
        "conv_id", "perspective", "turn", "range", "number", "own", "start",
        F.concat(head, F.lit("\n"), F.col("text"), F.lit("<|end|>\n")).alias("shown"),
        F.when(F.col("own"), F.concat((F.col("start") + len("<|assistant|>\n")).cast("string"), F.lit("-"), (F.col("start") + len("<|assistant|>\n") + length + len("<|end|>")).cast("string"))).alias("span"),
        F.floor(F.col("start") / part_chars).cast("long").alias("part"),
    )
    message = F.struct("range", "number", "turn", "shown", "span")
    parts = shown.groupBy("conv_id", "perspective", "part").agg(
        F.array_sort(F.collect_list(message)).alias("messages"), F.count("*").alias("n_messages"), F.count("span").alias("n_targets"), F.min("start").alias("start")
    )
    return parts.select(
        "conv_id", "perspective", "part", F.col("messages")[0]["turn"].alias("first_turn"), "n_messages", "n_targets", "start",
        F.array_join(F.col("messages")["shown"], "").alias("text"),
        F.array_join(F.col("messages")["span"], ",").alias("mask"),
    )


#: The same rows, a window over whole dialogues in DuckDB.
ORACLE_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
    row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS number
  FROM conversations
), e AS (
  SELECT m.*, s.perspective, m.role = s.perspective AS own,
    CASE WHEN m.role = s.perspective THEN '<|assistant|>' WHEN m.role = 'system' THEN '<|system|>' ELSE '<|user name=' || m.role || '|>' END || chr(10) AS head
  FROM m JOIN (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system') s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e
)
SELECT conv_id, perspective, start // {PART_CHARS} AS part, arg_min(turn, number) AS first_turn, count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_targets, min(start) AS start,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY number) AS text,
  coalesce(string_agg(CASE WHEN own THEN (start + 14) || '-' || (start + 14 + length(text) + 7) END, ',' ORDER BY number), '') AS mask
FROM p GROUP BY conv_id, perspective, start // {PART_CHARS}
"""
