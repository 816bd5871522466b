"""Preference formatting of paired conversations.

Of a chosen and a rejected conversation the longest common prefix of turns (role and text) is rendered once as prompt;
what follows is rendered as two completions, each with the spans that count for the loss: the texts of assistant turns
with their end marks, as start:end in code points of the completion.

Turns are ordered by turn, role and text; repeated rows count once; a null role or text is empty; rows with a null
conversation id and conversations without a partner give nothing; identical conversations give empty completions. An empty table
gives an empty one; texts of any length are kept whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The marks of a rendered turn.
START, END = "<|im_start|>", "<|im_end|>"

_RENDER = f"concat('{START}', t.role, '\\n', t.text, '{END}', '\\n')"
_SPANS = f"""
    array_join(aggregate(
        {{turns}},
        named_struct('at', 0, 'spans', cast(array() AS array<string>)),
        (acc, t) -> named_struct(
            'at', acc.at + char_length({_RENDER}),
            'spans', CASE WHEN t.role = 'assistant'
                THEN array_append(acc.spans, concat(acc.at + {len(START) + len('assistant') + 1}, ':', acc.at + {len(START) + len('assistant') + 1 + len(END)} + char_length(t.text)))
                ELSE acc.spans END),
        acc -> acc.spans), ',')"""


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (0 chosen, 1 rejected), conv_id, turn, role, text. One row a pair."""
    turns = turns.where("pair_id IS NOT NULL AND conv_id IS NOT NULL").select("pair_id", "side", "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.distinct().groupBy("pair_id").agg(
        *(F.min(F.when(F.col("side") == s, F.col("conv_id"))).alias(f"{n}_id") for s, n in enumerate(("chosen", "rejected"))),
        *(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text")))).alias(f"{n}_turns") for s, n in enumerate(("chosen", "rejected"))),
    )
    same = "zip_with(chosen_turns, rejected_turns, (a, b) -> coalesce(a.role = b.role AND a.text = b.text, false))"
    paired = sides.where("size(chosen_turns) > 0 AND size(rejected_turns) > 0").withColumn("first_other", F.expr(f"array_position({same}, false)"))
    cut = paired.withColumn("n_common_turns", F.expr("CASE WHEN first_other > 0 THEN first_other - 1 ELSE cast(size(chosen_turns) AS bigint) END"))
    rest = lambda n: f"slice({n}_turns, cast(n_common_turns AS int) + 1, size({n}_turns))"
    text = lambda turns: F.expr(f"array_join(transform({turns}, t -> {_RENDER}), '')")
    return cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common_turns",
        text("slice(chosen_turns, 1, cast(n_common_turns AS int))").alias("prompt"),
        *(x for n in ("chosen", "rejected") for x in (text(rest(n)).alias(n), F.expr(_SPANS.format(turns=rest(n))).alias(f"{n}_loss"))),
    )


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) of the whole table."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_pairs(turns.withColumn("pair_id", F.floor(F.col("conv_id") / 2)).withColumn("side", F.pmod(F.col("conv_id"), F.lit(2))))


OP10_SQL = f"""
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), n AS (
    SELECT *, cast(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           '{START}' || role || chr(10) || text || '{END}' || chr(10) AS shown
    FROM t
), both_sides AS (
    SELECT pair_id, min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id
    FROM n GROUP BY pair_id HAVING count(DISTINCT side) = 2
), other AS (
    SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.i, r.i)) AS first_other
    FROM (SELECT * FROM n WHERE side = 0) c FULL JOIN (SELECT * FROM n WHERE side = 1) r ON c.pair_id = r.pair_id AND c.i = r.i
    WHERE c.i IS NULL OR r.i IS NULL OR c.role <> r.role OR c.text <> r.text
    GROUP BY 1
), cut AS (
    SELECT n.*, coalesce(o.first_other - 1, max(n.i) OVER (PARTITION BY n.pair_id)) AS n_common
    FROM n JOIN both_sides USING (pair_id) LEFT JOIN other o USING (pair_id)
), placed AS (
    SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id ORDER BY i) - length(shown) + {len(START) + len('assistant') + 1} AS starts
    FROM cut WHERE i > n_common
), done AS (
    SELECT pair_id, side, string_agg(shown, '' ORDER BY i) AS text,
           coalesce(string_agg(cast(starts AS BIGINT) || ':' || cast(starts + length(text) + {len(END)} AS BIGINT), ',' ORDER BY i) FILTER (role = 'assistant'), '') AS loss
    FROM placed GROUP BY pair_id, side
), prompts AS (
    SELECT pair_id, max(n_common) AS n_common_turns, coalesce(string_agg(shown, '' ORDER BY i) FILTER (i <= n_common AND side = 0), '') AS prompt
    FROM cut GROUP BY pair_id
)
SELECT b.pair_id, b.chosen_id, b.rejected_id, cast(p.n_common_turns AS BIGINT) AS n_common_turns, p.prompt,
       coalesce(c.text, '') AS chosen, coalesce(c.loss, '') AS chosen_loss, coalesce(r.text, '') AS rejected, coalesce(r.loss, '') AS rejected_loss
FROM both_sides b JOIN prompts p USING (pair_id)
LEFT JOIN done c ON c.pair_id = b.pair_id AND c.side = 0
LEFT JOIN done r ON r.pair_id = b.pair_id AND r.side = 1
"""
