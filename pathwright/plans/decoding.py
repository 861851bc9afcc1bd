"""Sampled tokens, with vectors as the scores of a step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding
from ..operators import instances as I
from ..registry import query
from ..sources.fixtures import table

_STEPS = "SELECT CAST(floor(vec_id / 4) AS BIGINT) AS prompt_id, CAST(vec_id % 4 AS INT) AS step, {} AS scores FROM {} WHERE embedding IS NOT NULL"


@query(f"""WITH steps AS ({_STEPS.format("list_transform(embedding, lambda x: 8 * CAST(x AS DOUBLE))", "embeddings")}),
  one AS (SELECT prompt_id, step, i - 1 AS i, exp((scores[i] - list_max(scores)) / CAST(0.7 AS DOUBLE)) AS w FROM (SELECT *, unnest(range(1, len(scores) + 1)) AS i FROM steps)),
  run AS (SELECT *, sum(w) OVER (PARTITION BY prompt_id, step ORDER BY w DESC, i ROWS UNBOUNDED PRECEDING) AS reach, sum(w) OVER (PARTITION BY prompt_id, step) AS total FROM one),
  kept AS (SELECT prompt_id, step, min(reach) AS kept FROM run WHERE reach >= CAST(0.9 AS DOUBLE) * total GROUP BY prompt_id, step),
  drawn AS (SELECT *, (CAST({I.draw_sql("prompt_id", "CAST(step AS BIGINT) * 64 + sample", 0, decoding.GRAIN - 1)} AS DOUBLE) + 0.5) / {decoding.GRAIN} AS u FROM kept, (SELECT unnest([1, 2, 3]) AS sample))
  SELECT prompt_id, step, CAST(sample AS INT) AS sample, CAST(arg_min(i, reach) AS INT) AS token FROM drawn JOIN run USING (prompt_id, step) WHERE reach > u * kept GROUP BY prompt_id, step, sample""")
def sample_tokens(s, d):
    """Three samples a step at temperature 0.7 within a nucleus of 0.9."""
    steps = table(s, d, "embeddings").where("embedding IS NOT NULL").select(F.expr("CAST(floor(vec_id / 4) AS BIGINT)").alias("prompt_id"), (F.col("vec_id") % 4).cast("int").alias("step"), F.transform("embedding", lambda x: 8 * x.cast("double")).alias("scores"))
    return decoding.sample(steps, 0.7, 0.9, 3)
