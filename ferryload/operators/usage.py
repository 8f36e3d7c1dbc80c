"""Usage, feedback and job logs."""

from __future__ import annotations

from decimal import Decimal
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryload.fixed_values import (
    CHARS_PER_TOKEN,
    CONFIDENCE_FLOOR,
    DEFAULT_PRICE,
    FALLBACK_RATE_LIMIT,
    PRICES_PER_1K,
    RECENT_ROWS,
    REPAIR_LIMIT,
    SLOW_PHASE_SECONDS,
)
from ferryload.operators.ordering import most_recent


def estimated_tokens(text: Column) -> Column:
    """L1: characters / 4, cut, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("bigint")


def token_price(model: Column, side: int) -> Column:
    """L1: price of one token (side 0 prompt, 1 completion); unknown models take the default.

    Prices are decimals, so sums of costs do not depend on the order of the rows.
    """
    def exact(per_thousand: float) -> Column:
        return F.lit(str(Decimal(str(per_thousand)) / 1000)).cast("decimal(12,8)")

    pairs = [x for name, prices in PRICES_PER_1K.items() for x in (F.lit(name), exact(prices[side]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), model), exact(DEFAULT_PRICE[side]))


def with_cost(calls: DataFrame) -> DataFrame:
    """L1: adds ``prompt_tokens, completion_tokens, cost`` to calls.

    ``calls`` has ``model, prompt_text, completion_text``; reported token counts, when the
    columns ``reported_prompt_tokens`` and ``reported_completion_tokens`` are there, win.
    """
    def tokens(side: str) -> Column:
        estimate = estimated_tokens(F.coalesce(f"{side}_text", F.lit("")))
        reported = f"reported_{side}_tokens"
        return F.coalesce(F.col(reported).cast("bigint"), estimate) if reported in calls.columns else estimate

    counted = calls.withColumn("prompt_tokens", tokens("prompt")).withColumn("completion_tokens", tokens("completion"))
    prompt, completion = (F.col(f"{side}_tokens").cast("decimal(18,0)") for side in ("prompt", "completion"))
    cost = prompt * token_price(F.col("model"), 0) + completion * token_price(F.col("model"), 1)
    return counted.withColumn("cost", cost)


def usage_summary(log: DataFrame, *keys: str) -> DataFrame:
    """L2, L3: calls, tokens and cost per key; by session, by purpose, by model or overall."""
    tokens = F.sum("prompt_tokens"), F.sum("completion_tokens")
    figures = [
        F.count("*").alias("calls"), tokens[0].alias("prompt_tokens"), tokens[1].alias("completion_tokens"),
        (tokens[0] + tokens[1]).alias("total_tokens"), F.round(F.sum("cost"), 6).cast("double").alias("cost_usd"),
    ]
    return log.groupBy(*keys).agg(*figures) if keys else log.agg(
        *figures, F.count_distinct("session_id").alias("unique_sessions")
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """L4: ratings and the share of positive ones (4 decimals, 0 when there are none)."""
    positive, total = F.count_if(F.col("rating") == 1), F.count("*")
    return feedback.agg(
        total.alias("total"), positive.alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"),
        F.coalesce(F.round(F.try_divide(positive, total), 4), F.lit(0.0)).alias("positive_rate"),
    )


def recent_feedback(feedback: DataFrame) -> DataFrame:
    """L4, O3: the newest 20 entries."""
    return most_recent(feedback, "created_at", ["id"], RECENT_ROWS)


def job_rates(jobs: DataFrame) -> DataFrame:
    """Fallback and failure rate per job, 0 for jobs without translations."""
    total = F.col("rule_based") + F.col("llm_fallback") + F.col("failed")
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0))
    return jobs.select(
        "*", total.alias("total_fields"), rate("llm_fallback").alias("fallback_rate"), rate("failed").alias("failure_rate")
    )


def job_alerts(jobs: DataFrame, phases: DataFrame) -> DataFrame:
    """One row per job and broken limit. A confidence of 0 means it was not measured."""
    rated, confidence = job_rates(jobs), F.col("confidence")

    def alert(kind: str, value: Column, broken: Column) -> Column:
        return F.when(broken, F.struct(F.lit(kind).alias("alert"), value.cast("double").alias("measured")))

    broken = F.array_compact(F.array(
        alert("high_fallback_rate", F.col("fallback_rate"), F.col("fallback_rate") > FALLBACK_RATE_LIMIT),
        alert("failed_translations", F.col("failed"), F.col("failed") > 0),
        alert("low_confidence", confidence, (confidence < CONFIDENCE_FLOOR) & (confidence > 0)),
        alert("many_repairs", F.col("repair_iterations"), F.col("repair_iterations") > REPAIR_LIMIT),
    ))
    of_jobs = rated.select("job_id", F.explode(broken).alias("a")).select("job_id", "a.alert", F.lit("").alias("detail"), "a.measured")
    seconds = F.col("duration_ms") / 1000
    slow = phases.where(seconds > SLOW_PHASE_SECONDS).select("job_id", F.lit("slow_phase").alias("alert"), F.col("phase").alias("detail"), seconds.cast("double").alias("measured"))
    return of_jobs.unionByName(slow)
