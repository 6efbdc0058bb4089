"""Chat formatting by perspective rotation.

For every participant of a dialogue the whole dialogue is rendered with that
speaker as the assistant and the others as named users, with masks over what
the assistant says.  Context roles (system) stay as they are and take no turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTEXT = ("system",)
#: The name of a speaker whose role is null; no other name holds a bare percent sign.
NOBODY = "%nobody"
# Characters that would end a name in a header, and how they are written there.
ESCAPES = {"%": "%25", " ": "_", "_": "%5F", "\t": "%09", "\n": "%0A", "\x0b": "%0B", "\f": "%0C", "\r": "%0D", "<": "%3C", ">": "%3E", "|": "%7C"}


def clean(text: Column) -> Column:
    """A text in which no marker of the template occurs."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", r"<\\|$1\\|>")


def named(role: Column) -> Column:
    """A speaker's name in a header; different roles, null among them, have different names."""
    out = F.replace(role, F.lit("%"), F.lit(ESCAPES["%"]))
    for old in [x for x in ESCAPES if x not in "% "]:
        out = F.replace(out, F.lit(old), F.lit(ESCAPES[old]))
    return F.coalesce(F.replace(out, F.lit(" "), F.lit(ESCAPES[" "])), F.lit(NOBODY))


def rotate(turns: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """One row for each dialogue and each participant: conv_id, perspective, n_turns, n_masked, rendered, mask.

    ``mask`` lists ``start:end`` code point spans of ``rendered`` that the
    assistant says, closing marker included; all else carries no loss.  Turns
    are in order of number, then role, then text; a null turn comes first.
    Null texts are empty turns, a null role is a participant of its own
    (``NOBODY``) and repeated rows are said twice.  Rows without a conv_id
    belong to no common dialogue: each is one of a single turn.  A dialogue of
    context alone has no participant; an empty table gives no rows.  Other
    columns are not read.  A row is as large as its dialogue.
    """
    own = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].cast("long").alias("turn"), turns["role"].alias("role"), turns["text"].alias("text"))
    own = own.withColumn("speaker", F.when(F.coalesce(F.lower("role").isin(*context), F.lit(False)), F.lit(None)).otherwise(named(F.col("role"))))
    said = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("text"), "speaker", clean(F.col("text")).alias("clean"))
    alone = own.where(F.col("conv_id").isNull()).select("conv_id", F.array(said).alias("said"))
    whole = own.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said")).unionByName(alone)
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("said", lambda s: s["speaker"]), lambda s: s.isNotNull())))
    each = whole.select("conv_id", "said", F.explode(speakers).alias("perspective"))

    def line(s: Column) -> Column:
        mine = F.coalesce(s["speaker"] == F.col("perspective"), F.lit(False))
        header = F.when(s["speaker"].isNull(), F.lower(s["role"])).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), s["speaker"]))
        return F.struct(mine.alias("mine"), F.concat(F.lit(OPEN), header, F.lit("\n")).alias("head"), F.concat(s["clean"], F.lit(CLOSE)).alias("body"))

    lines = each.select("conv_id", "perspective", F.transform("said", line).alias("lines"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        stop = start + F.length(x["body"])
        return F.struct((stop + 1).alias("at"), F.when(x["mine"], F.concat(acc["spans"], F.array(F.concat_ws(":", start, stop)))).otherwise(acc["spans"]).alias("spans"))

    return lines.select(
        "conv_id",
        "perspective",
        F.size("lines").cast("long").alias("n_turns"),
        F.size(F.filter("lines", lambda x: x["mine"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("lines", zero, step, lambda acc: acc["spans"]), ",").alias("mask"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(load(spark, sf_dir, "conversations"))


def _named_sql(column: str) -> str:
    out = f"replace({column}, '%', '{ESCAPES['%']}')"
    for old in [x for x in ESCAPES if x not in "% "]:
        out = f"replace({out}, chr({ord(old)}), '{ESCAPES[old]}')"
    return f"coalesce(replace({out}, ' ', '{ESCAPES[' ']}'), '{NOBODY}')"


OP1_SQL = f"""
WITH said AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), 'row ' || row_number() OVER ()) AS dialogue, conv_id, turn, role, text,
         CASE WHEN lower(role) IN ('system') THEN NULL ELSE {_named_sql('role')} END AS speaker,
         regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<\\\\|\\1\\\\|>', 'g') AS clean
  FROM conversations
), each AS (
  SELECT s.*, p.perspective, coalesce(s.speaker = p.perspective, false) AS mine
  FROM said s JOIN (SELECT DISTINCT dialogue, speaker AS perspective FROM said WHERE speaker IS NOT NULL) p USING (dialogue)
), lines AS (
  SELECT *, '{OPEN}' || CASE WHEN speaker IS NULL THEN lower(role) WHEN mine THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head,
         clean || '{CLOSE}' AS body
  FROM each
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY dialogue, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM lines
)
SELECT any_value(conv_id) AS conv_id, perspective, count(*) AS n_turns, count(*) FILTER (mine) AS n_masked,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered,
       string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY start) FILTER (mine) AS mask
FROM placed GROUP BY dialogue, perspective
"""
