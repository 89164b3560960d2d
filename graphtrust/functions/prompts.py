"""Labelling requests: prompt text of an edge and the request around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphtrust.functions.labels import INTENTS

#: What each intent means, in class order; our own wording, a parameter of prompt().
MEANINGS = (
    "gives context or prior knowledge", "uses or extends a method, tool or data set", "compares with results or measures",
    "takes support for a claim", "disagrees with or criticises", "is cited in passing, without need",
)
TASK = "Say why the first paper cites the second. Answer with JSON: {\"label\": one of the labels, \"confidence\": a number from 0 to 1}."


def prompt(citing_title: Column, citing_text: Column, cited_title: Column, cited_text: Column, task: str = TASK, meanings: tuple[str, ...] = MEANINGS) -> Column:
    """The text that asks for an edge's intent; nulls are empty and inner line breaks become spaces."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    labels = "\n".join(f"- {name}: {text}" for name, text in zip(INTENTS, meanings, strict=True))
    head = F.lit(f"{task}\n\nLabels:\n{labels}\n")
    return F.concat(head, F.lit("\nCiting title: "), flat(citing_title), F.lit("\nCiting abstract: "), flat(citing_text), F.lit("\nCited title: "), flat(cited_title), F.lit("\nCited abstract: "), flat(cited_text))


def request(custom_id: Column, text: Column, model: str, most_tokens: int = 64) -> Column:
    """One batch request as JSON."""
    body = F.struct(
        F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"),
        F.lit(0.0).alias("temperature"), F.lit(most_tokens).alias("max_tokens"),
    )
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
