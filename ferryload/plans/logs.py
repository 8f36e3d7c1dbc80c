"""Queries for usage, feedback and job logs (L*). Conversations serve as model calls, labels and events as feedback and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryload.operators import usage
from ferryload.plans.tables import Tables


def _calls(t: Tables):
    models = F.array(*[F.lit(m) for m in ("openai/gpt-4o", "anthropic/claude-3-haiku", "unlisted/model")])
    question = F.col("role") != "assistant"
    return t.conversations.select(
        F.col("conv_id").alias("session_id"), F.element_at(models, (F.col("conv_id") % 3 + 1).cast("int")).alias("model"),
        F.col("role").alias("purpose"), F.when(question, F.col("text")).alias("prompt_text"), F.when(~question, F.col("text")).alias("completion_text"),
    )


def call_cost(t: Tables):
    return usage.with_cost(_calls(t)).groupBy("session_id", "model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").cast("double").alias("cost")
    )


def usage_by_session(t: Tables):
    return usage.usage_summary(usage.with_cost(_calls(t)), "session_id")


def usage_by_purpose(t: Tables):
    return usage.usage_summary(usage.with_cost(_calls(t)), "session_id", "purpose")


def usage_by_model(t: Tables):
    return usage.usage_summary(usage.with_cost(_calls(t)), "model")


def usage_overall(t: Tables):
    return usage.usage_summary(usage.with_cost(_calls(t)))


def _feedback(t: Tables):
    rating = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return t.events.select(F.col("event_id").alias("id"), rating.alias("rating"), F.col("ts").alias("created_at"), "user_id")


def feedback_rate(t: Tables):
    by_labels = t.labels.select(F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0).alias("rating"))
    named = lambda df, name: usage.feedback_summary(df).withColumn("log", F.lit(name))
    return named(_feedback(t), "events").unionByName(named(by_labels, "labels")).unionByName(named(by_labels.where("rating > 5"), "empty"))


def recent_feedback(t: Tables):
    return usage.recent_feedback(_feedback(t)).select("id", F.col("rating").cast("bigint").alias("rating"), "user_id")


def _jobs(t: Tables):
    kind = lambda *names: F.count_if(F.col("event_type").isin(*names))
    return t.events.groupBy(F.col("user_id").alias("job_id")).agg(
        kind("view", "click", "signup").alias("rule_based"), kind("purchase").alias("llm_fallback"), kind("error").alias("failed"),
        F.round(F.try_divide(F.avg("value"), F.max("value")), 6).alias("confidence"), F.count_if(F.col("value") > 100).alias("repair_iterations"),
    )


def _phases(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("phase")).agg(
        (F.max("value") * 200).alias("duration_ms")
    )


def job_rates(t: Tables):
    rated = usage.job_rates(_jobs(t))
    return rated.select("job_id", "total_fields", F.round("fallback_rate", 6).alias("fallback_rate"), F.round("failure_rate", 6).alias("failure_rate"))


def job_alerts(t: Tables):
    return usage.job_alerts(_jobs(t), _phases(t)).withColumn("measured", F.round("measured", 6))


QUERIES = {f.__name__: f for f in (
    call_cost, usage_by_session, usage_by_purpose, usage_by_model, usage_overall, feedback_rate, recent_feedback, job_rates, job_alerts,
)}

CALLS = """
calls AS (
  SELECT conv_id AS session_id, ['openai/gpt-4o', 'anthropic/claude-3-haiku', 'unlisted/model'][conv_id % 3 + 1] AS model, role AS purpose,
    CASE WHEN role <> 'assistant' THEN greatest(1, length(text) // 4) ELSE 1 END AS p, CASE WHEN role = 'assistant' THEN greatest(1, length(text) // 4) ELSE 1 END AS c
  FROM conversations),
priced AS (
  SELECT *, CAST(p AS DECIMAL(18,0)) * CAST(CASE model WHEN 'openai/gpt-4o' THEN 0.000005 WHEN 'anthropic/claude-3-haiku' THEN 0.00000025 ELSE 0.000002 END AS DECIMAL(12,8))
    + CAST(c AS DECIMAL(18,0)) * CAST(CASE model WHEN 'openai/gpt-4o' THEN 0.000015 WHEN 'anthropic/claude-3-haiku' THEN 0.00000125 ELSE 0.000006 END AS DECIMAL(12,8)) AS cost FROM calls)"""
FIGURES = """count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
  CAST(sum(p) + sum(c) AS BIGINT) AS total_tokens, CAST(round(sum(cost), 6) AS DOUBLE) AS cost_usd"""
JOBS = """
jobs AS (SELECT user_id AS job_id, count(*) FILTER (event_type IN ('view', 'click', 'signup')) AS r, count(*) FILTER (event_type = 'purchase') AS l,
  count(*) FILTER (event_type = 'error') AS f, count(*) AS n, round(avg(value) / max(value), 6) AS confidence, count(*) FILTER (value > 100) AS repairs FROM events GROUP BY 1),
phases AS (SELECT user_id AS job_id, event_type AS phase, max(value) * 200 AS ms FROM events GROUP BY ALL)"""

ORACLE = {
    "call_cost": f"""WITH {CALLS} SELECT session_id, model, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
      CAST(sum(cost) AS DOUBLE) AS cost FROM priced GROUP BY ALL""",
    "usage_by_session": f"WITH {CALLS} SELECT session_id, {FIGURES} FROM priced GROUP BY 1",
    "usage_by_purpose": f"WITH {CALLS} SELECT session_id, purpose, {FIGURES} FROM priced GROUP BY 1, 2",
    "usage_by_model": f"WITH {CALLS} SELECT model, {FIGURES} FROM priced GROUP BY 1",
    "usage_overall": f"WITH {CALLS} SELECT {FIGURES}, count(DISTINCT session_id) AS unique_sessions FROM priced",
    "feedback_rate": """
      WITH f AS (SELECT 'events' AS log, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS rating FROM events
        UNION ALL SELECT 'labels', CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END FROM labels)
      SELECT log, count(*) AS total, count(*) FILTER (rating = 1) AS positive, count(*) FILTER (rating = -1) AS negative,
        round(count(*) FILTER (rating = 1) / count(*), 4) AS positive_rate FROM f GROUP BY 1
      UNION ALL SELECT 'empty', 0, 0, 0, 0.0""",
    "recent_feedback": """
      SELECT event_id AS id, CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS BIGINT) AS rating, user_id
      FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""",
    "job_rates": f"WITH {JOBS} SELECT job_id, n AS total_fields, round(l / n, 6) AS fallback_rate, round(f / n, 6) AS failure_rate FROM jobs",
    "job_alerts": f"""
      WITH {JOBS}, a AS (
        SELECT job_id, 'high_fallback_rate' AS alert, '' AS detail, l / n AS measured FROM jobs WHERE l / n > 0.20
        UNION ALL SELECT job_id, 'failed_translations', '', f FROM jobs WHERE f > 0
        UNION ALL SELECT job_id, 'low_confidence', '', confidence FROM jobs WHERE confidence < 0.70 AND confidence > 0
        UNION ALL SELECT job_id, 'slow_phase', phase, ms / 1000 FROM phases WHERE ms / 1000 > 30
        UNION ALL SELECT job_id, 'many_repairs', '', repairs FROM jobs WHERE repairs > 3)
      SELECT job_id, alert, detail, round(CAST(measured AS DOUBLE), 6) AS measured FROM a""",
}
