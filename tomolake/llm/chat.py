"""Chat formatting with every participant in turn as the assistant.

For each participant of a conversation the whole dialogue is rendered with that speaker's turns as assistant turns, to
be learned, and all others as named users, masked. The result has a row for each conversation, perspective and turn,
with the rendered segment and its place in the dialogue, so that no conversation has to fit one row or task: places
are running sums within blocks of turns, plus the sums of the blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
UNNAMED = "unnamed"


def escaped(text: Column) -> Column:
    """The text with a backslash put into each `<|`, so that it can't open or close a turn (and into `<\\`, so that it can be
    taken out again)."""
    return F.regexp_replace(text, r"<([|\\])", r"<\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\([|\\])", "<$1")


def name_of(speaker: Column) -> Column:
    """A speaker's name for a header: on one line, and without the end of one."""
    return escaped(F.regexp_replace(F.regexp_replace(speaker, r"[\r\n]", " "), r"\|>", "| >"))


def rotate_perspectives(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, seq, speaker, segment, learned, char_start, char_end, target_start, target_end.

    Turns are ordered by turn (null first), role and text; equal rows stay, one after another. segment is the header,
    the text and the end mark. Characters from target_start to target_end (text and end mark of the perspective's own
    turns) are learned; both are null for other turns. A null role is `unnamed`, a null text is empty. Marks within a text
    or a name are escaped. Rows without a conv_id belong to no conversation and are left out. Other columns are left out,
    whatever their names; an empty table gives no rows.
    """
    t = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "speaker", "text")
    t = t.withColumn("n", F.row_number().over(order))
    people = t.groupBy("conv_id", "speaker").count().select("conv_id", F.col("speaker").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name_of(F.col("speaker")), F.lit("|>\n")))
    s = t.join(people, "conv_id").withColumn("learned", own).withColumn("head", head)
    s = s.withColumn("segment", F.concat("head", escaped(F.col("text")), F.lit("<|end|>\n"))).withColumn("size", F.length("segment"))
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("ahead", F.sum("size").over(inside) - F.col("size"))
    blocks = s.groupBy("conv_id", "perspective", "block").agg(F.count("*").alias("rows"), F.sum("size").alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "perspective", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"))
    s = s.join(blocks, ["conv_id", "perspective", "block"])
    start = F.col("chars") + F.col("ahead")
    return s.select("conv_id", "perspective", (F.col("rows") + F.col("n")).alias("seq"), "speaker", "segment", "learned", start.alias("char_start"), (start + F.col("size")).alias("char_end"), F.when(F.col("learned"), start + F.length("head")).alias("target_start"), F.when(F.col("learned"), start + F.col("size")).alias("target_end"))


def dialogues(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text: the segments put together, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "segment")))
    return segments.groupBy("conv_id", "perspective").agg(F.concat_ws("", F.transform(parts, lambda p: p["segment"])).alias("text"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unnamed') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unnamed'), coalesce(text, '')) AS seq
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT t.*, p.speaker AS perspective, t.speaker = p.speaker AS learned,
         CASE WHEN t.speaker = p.speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || regexp_replace(regexp_replace(regexp_replace(t.speaker, '[\r\n]', ' ', 'g'), '\|>', '| >', 'g'), '<([|\\])', '<\\\1', 'g') || '|>' || chr(10) END AS head
  FROM t JOIN (SELECT DISTINCT conv_id, speaker FROM t) p ON t.conv_id = p.conv_id),
g AS (SELECT *, head || regexp_replace(text, '<([|\\])', '<\\\1', 'g') || '<|end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY seq) AS BIGINT) AS char_end FROM g)
SELECT conv_id, perspective, seq, speaker, segment, learned, char_end - length(segment) AS char_start, char_end,
       CASE WHEN learned THEN char_end - length(segment) + length(head) END AS target_start,
       CASE WHEN learned THEN char_end END AS target_end
FROM o
"""
