"""Chat formatting: conversations that are prefixes of longer ones collapse before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maximal_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Collapse cumulative snapshots and render what is left: conv_id, n_turns, n_copies, rendered.

    Each conversation's turns, in order, get a rolling hash: the hash of the previous one, the role and the text. The last
    names the conversation, the earlier ones its prefixes. Equal conversations collapse to their smallest id (n_copies says
    how many there were); an anti-join of distinct hashes then drops each that is a proper prefix of a longer one. Only
    hashes are joined; rendering reads the texts of what was kept.

    Rows that are equal in all four columns count once; turns that share a number follow role, then text, nulls first. A
    null role or text differs from an empty one and is rendered as empty; `<|` within a turn is rendered `< |`; rows with a null conversation id belong to no
    conversation and are left out; an empty table gives no rows; other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("t")).where("conv is not null")

    def shown(field: str) -> str:
        return f"coalesce(concat(length(x.{field}), ':', x.{field}), '-')"

    hashed = rows.select("conv", "t").groupBy("conv").agg(F.expr("array_sort(collect_set(t))").alias("ts"))
    step = f"sha2(concat(coalesce(try_element_at(acc, -1), ''), '|', {shown('role')}, '|', {shown('text')}), 256)"
    chains = hashed.select("conv", F.expr(f"aggregate(ts, cast(array() as array<string>), (acc, x) -> array_append(acc, {step}))").alias("chain"))
    fulls = chains.groupBy(F.element_at("chain", -1).alias("h")).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"), F.first(F.size("chain").cast("long")).alias("n_turns"))
    prefixes = chains.select(F.explode(F.expr("slice(chain, 1, size(chain) - 1)")).alias("h")).distinct()
    kept = fulls.join(prefixes, "h", "left_anti").select("conv", "n_copies", "n_turns")
    shut = lambda field: f"replace(coalesce(x.{field}, ''), '<|', '< |')"  # noqa: E731 - no turn can write the marks of another
    line = f"concat('<|im_start|>', {shut('role')}, '\\n', {shut('text')}, '<|im_end|>')"
    rendered = hashed.join(kept, "conv").select(F.col("conv").alias(conv_col), "n_turns", "n_copies", F.expr(f"array_join(transform(ts, x -> {line}), '\\n')").alias("rendered"))
    return rendered


#: The same on the raw rows, by comparing lists of turns instead of hashes.
MAXIMAL_SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, count(*) AS n_turns,
         list(coalesce(length(role)::VARCHAR || ':' || role, '-') || '|' || coalesce(length(text)::VARCHAR || ':' || text, '-') ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS parts,
         string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>', chr(10) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM turns GROUP BY conv_id),
kinds AS (SELECT parts, min(conv_id) AS conv_id, count(*) AS n_copies FROM convs GROUP BY parts),
prefixes AS (SELECT DISTINCT parts[1:k] AS parts FROM (SELECT parts, unnest(range(1, len(parts))) AS k FROM kinds))
SELECT k.conv_id, c.n_turns, k.n_copies, c.rendered
FROM kinds k JOIN convs c USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.parts = k.parts)
"""
