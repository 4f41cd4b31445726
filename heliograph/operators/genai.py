"""Calls to language models, read from span attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import clocks, values

# Attribute keys that instrumentations use, most preferred first.
PROMPT_KEYS = (
    "gen_ai.prompt.0.content",
    "gen_ai.prompt",
    "gen_ai.request.prompt",
    "llm.prompts.0.content",
    "llm.prompt",
)
RESPONSE_KEYS = (
    "gen_ai.completion.0.content",
    "gen_ai.completion",
    "gen_ai.response",
    "llm.completions.0.content",
    "llm.completion",
    "llm.response",
)
MODEL_KEYS = ("gen_ai.request.model", "gen_ai.system", "llm.model")
NUMBER_KEYS = {
    "prompt_tokens": ("gen_ai.usage.input_tokens", "llm.usage.prompt_tokens"),
    "completion_tokens": ("gen_ai.usage.output_tokens", "llm.usage.completion_tokens"),
    "total_tokens": ("gen_ai.usage.total_tokens", "llm.usage.total_tokens"),
    "temperature": ("gen_ai.request.temperature", "llm.temperature"),
    "max_tokens": ("gen_ai.request.max_tokens", "llm.max_tokens"),
}
SESSION_MODEL_KEYS = ("gen_ai.request.model", "gen_ai.model")
SESSION_INPUT_KEYS = ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens")
SESSION_OUTPUT_KEYS = ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens")
AI_KEYS = ("gen_ai.system", "gen_ai.request.model", "gen_ai.usage.input_tokens")
TOOL_KEY = "agent.tool.name"


def calls(spans: DataFrame) -> DataFrame:
    """Every span with its model, tokens, settings, prompt and response, where it has them."""
    return spans.select(
        "trace_id",
        "span_id",
        "name",
        "start_ns",
        clocks.duration_seconds(F.col("start_ns"), F.col("end_ns")).alias("duration_seconds"),
        "service_name",
        values.first_attribute(spans, *MODEL_KEYS).alias("model"),
        *[values.first_number(spans, *keys).alias(name) for name, keys in NUMBER_KEYS.items()],
        values.first_attribute(spans, *PROMPT_KEYS).alias("prompt"),
        values.first_attribute(spans, *RESPONSE_KEYS).alias("response"),
    )


def ai_calls(spans: DataFrame, model: str | None = None, name_contains: str = "") -> DataFrame:
    """Calls that carry a model, a prompt, a response or a token total."""
    found = calls(spans).filter(
        F.coalesce("model", "prompt", "response").isNotNull() | (F.coalesce("total_tokens", F.lit(0.0)) != 0)
    )
    if model:
        found = found.filter(F.col("model") == model)
    if name_contains:
        found = found.filter(F.lower("name").contains(name_contains.lower()))
    return found


def models(spans: DataFrame) -> DataFrame:
    return ai_calls(spans).select("model").filter("model is not null").distinct()


def summary(spans: DataFrame) -> DataFrame:
    """Calls, tokens, average duration and models over all AI calls, as one row."""
    return ai_calls(spans).agg(
        F.count("*").alias("call_count"),
        *[_tokens(name) for name in ("total_tokens", "prompt_tokens", "completion_tokens")],
        F.round(F.coalesce(F.avg("duration_seconds"), F.lit(0.0)), 6).alias("avg_duration_seconds"),
        F.countDistinct("model").alias("model_count"),
    )


def _tokens(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0.0)).cast("bigint").alias(name)


def span_role(spans: DataFrame) -> Column:
    """``ai``, ``tool`` or ``other``; AI attributes win over a tool name."""
    is_ai = values.first_attribute(spans, *AI_KEYS).isNotNull()
    is_tool = F.lower("name").contains("tool") | values.first_attribute(spans, TOOL_KEY).isNotNull()
    return F.when(is_ai, "ai").when(is_tool, "tool").otherwise("other")


def sessions(spans: DataFrame) -> DataFrame:
    """Per trace: spans by role, token sums and the models used by its AI spans."""

    def tokens(keys: tuple[str, ...]) -> Column:
        return F.coalesce(F.regexp_extract(values.first_attribute(spans, *keys), r"^\s*(-?\d+)", 1).try_cast("bigint"), F.lit(0))

    roles = spans.select(
        "trace_id",
        span_role(spans).alias("role"),
        tokens(SESSION_INPUT_KEYS).alias("prompt"),
        tokens(SESSION_OUTPUT_KEYS).alias("completion"),
        values.first_attribute(spans, *SESSION_MODEL_KEYS).alias("model"),
    )

    def count(role: str) -> Column:
        return F.count(F.when(F.col("role") == role, 1)).alias(f"{role}_spans")

    is_ai = F.col("role") == "ai"
    # Counted per model first: a long trace reaches the final step as one row per model.
    by_model = roles.groupBy("trace_id", F.when(is_ai, F.col("model")).alias("model")).agg(
        count("ai"),
        count("tool"),
        count("other"),
        F.sum(F.when(is_ai, F.col("prompt")).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(is_ai, F.col("completion")).otherwise(0)).alias("completion_tokens"),
    )
    sums = [F.sum(c).alias(c) for c in by_model.columns if c not in ("trace_id", "model")]
    return (
        by_model.groupBy("trace_id")
        .agg(*sums, F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
        .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    )
