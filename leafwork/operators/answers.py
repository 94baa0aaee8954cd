"""Answers of a labelling service: text, end, error and usage of a response, read leniently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the members of a response that are read.
RESPONSE = (
    "promptFeedback struct<blockReason:string>, candidates array<struct<finishReason:string, content:struct<parts:array<struct<text:string, thought:boolean>>>>>, "
    "usageMetadata struct<promptTokenCount:bigint, candidatesTokenCount:bigint, thoughtsTokenCount:bigint, cost:double>"
)


def first_object(text: Column) -> Column:
    """A text from its first brace on, as answers may hold words before the JSON; null without one."""
    at = F.locate("{", text)
    return F.when(at > 0, F.substring(text, at, F.length(text)))


def read(df: DataFrame, json: str) -> DataFrame:
    """df with answer, finish, error, input, output and cost of the responses in column ``json``. What isn't JSON has the error
    "no candidates"; parts that are thoughts are left out."""
    r = F.from_json(json, RESPONSE)
    at = df.withColumn("__r", r)
    first = F.get(F.col("__r.candidates"), F.lit(0))
    parts = F.filter(F.coalesce(first["content"]["parts"], F.array().cast("array<struct<text:string,thought:boolean>>")), lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    blocked, finish = F.col("__r.promptFeedback.blockReason"), first["finishReason"]
    error = F.when(blocked.isNotNull(), F.concat(F.lit("blocked: "), blocked)).when(first.isNull(), "no candidates").when(~F.coalesce(finish, F.lit("STOP")).isin("STOP", "MAX_TOKENS"), F.concat(F.lit("finish "), finish))
    usage = lambda c: F.coalesce(F.col(f"__r.usageMetadata.{c}"), F.lit(0))
    text = F.when(blocked.isNull(), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise("")
    return at.withColumns({"answer": text, "finish": F.when(blocked.isNull(), finish), "error": error, "input": usage("promptTokenCount"), "output": usage("candidatesTokenCount") + usage("thoughtsTokenCount"), "cost": F.col("__r.usageMetadata.cost")}).drop("__r")
