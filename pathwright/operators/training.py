"""Packing of preference pairs into padded batches, and the weighted preference loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def tokens_of_pair(prompt: Column, chosen: Column, rejected: Column, max_prompt: int, max_response: int, eos: int) -> dict[str, Column]:
    """Arrays of ids cut to their limits; the two answers end in eos. A null array counts as empty."""
    cut = lambda c, n: F.slice(F.coalesce(c, F.array().cast("array<int>")), 1, n)
    end = F.array(F.lit(eos))
    return {"prompt_ids": cut(prompt, max_prompt), "chosen_ids": F.concat(cut(chosen, max_response), end), "rejected_ids": F.concat(cut(rejected, max_response), end)}


def pack(pairs: DataFrame, batch_size: int, pad: int, pos: str = "pos") -> DataFrame:
    """pairs (prompt_ids, chosen_ids, rejected_ids, and a position) with batch and, for `chosen` and `rejected`, input_ids, attention_mask
    and labels (the prompt and the padding are ignored), padded on the right to the longest of the batch. One shuffle, by batch."""
    length = F.size("prompt_ids") + F.greatest(F.size("chosen_ids"), F.size("rejected_ids"))
    df = pairs.withColumn("batch", F.floor(F.col(pos) / batch_size)).withColumn("_to", F.max(length).over(Window.partitionBy("batch")))
    for side in ("chosen", "rejected"):
        own, n = F.col(f"{side}_ids"), F.size("prompt_ids") + F.size(f"{side}_ids")
        fill = lambda value, n=n: F.array_repeat(F.lit(value), (F.col("_to") - n).cast("int"))
        df = df.withColumns(
            {
                f"{side}_input_ids": F.concat("prompt_ids", own, fill(pad)),
                f"{side}_attention_mask": F.concat(F.array_repeat(F.lit(1), n), fill(0)),
                f"{side}_labels": F.concat(F.array_repeat(F.lit(IGNORED), F.size("prompt_ids")), own, fill(IGNORED)),
            }
        )
    return df.drop("_to")


def mean_logp(logps: Column, labels: Column) -> Column:
    """Mean log-probability of the places whose label is not ignored; 0 if there is none."""
    kept = F.filter(F.zip_with(logps, labels, lambda p, y: F.when(y != IGNORED, p)), lambda x: x.isNotNull())
    return F.aggregate(kept, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(kept), F.lit(1))


def sequence_logp(logps: Column, labels: Column) -> Column:
    """Mean log-probability of a sequence: a place's log-probability belongs to the label of the next place."""
    n = F.size(labels)
    return mean_logp(F.slice(logps, F.lit(1), n - 1), F.slice(labels, F.lit(2), n - 1))


def preference_terms(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, weight: Column, beta: float) -> dict[str, Column]:
    """loss, margin, right of one pair of mean log-probabilities. The loss is the stable form of -weight * log sigmoid(logit); the margin has no reference term."""
    logit = beta * ((chosen - rejected) - (ref_chosen - ref_rejected))
    return {"loss": weight * (F.greatest(-logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))), "margin": chosen - rejected, "right": logit > 0}


def preference_loss(pairs: DataFrame, beta: float, *by: str) -> DataFrame:
    """Means over pairs (policy_chosen, policy_rejected, ref_chosen, ref_rejected: mean log-probabilities; weight): loss, reward_margin, preference_accuracy."""
    terms = preference_terms(*[F.col(c) for c in ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected", "weight")], beta)
    return pairs.groupBy(*by).agg(F.avg(terms["loss"]).alias("loss"), F.avg(terms["margin"]).alias("reward_margin"), F.avg(terms["right"].cast("double")).alias("preference_accuracy"))
