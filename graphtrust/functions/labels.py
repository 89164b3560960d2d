"""Edge intents: names, trust weights, and parsing of labelled replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intents in class order with their trust weights.
INTENTS = ("Background", "Method", "Result/Comparison", "Support", "Contrast/Criticism", "Perfunctory/Ceremonial")
WEIGHTS = (0.2, 1.0, 0.7, 0.5, 0.3, 0.1)
#: Intents that count as shallow; what an edge without a label gets.
SHALLOW = ("Background", "Perfunctory/Ceremonial")
UNTYPED = {"intent": "Untyped", "weight": 1.0, "confidence": 0.0}


def intent_weight(label: Column) -> Column:
    """The trust weight of an intent; null for other names."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(INTENTS, WEIGHTS, strict=True) for x in pair]), label)


def name_of(number: Column, names: tuple[str, ...] = INTENTS) -> Column:
    """The name of a class number, from 0; null where there is none."""
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), (number + 1).cast("int"))


def is_shallow(label: Column) -> Column:
    return F.coalesce(label.isin(*SHALLOW), F.lit(False))


def normalise_label(text: Column) -> Column:
    """The intent equal to the trimmed text but for case, else the first one that the text contains, else null."""
    low = F.lower(F.trim(text))
    exact = F.coalesce(*[F.when(low == x.lower(), F.lit(x)) for x in INTENTS])
    held = F.coalesce(*[F.when(F.contains(low, F.lit(x.lower())), F.lit(x)) for x in INTENTS])
    return F.coalesce(exact, held)


def reply_content(response: Column) -> Column:
    """The first choice's message content of a batch response in JSON; null where it is missing."""
    return F.get_json_object(response, "$.response.body.choices[0].message.content")


def clamp(x: Column) -> Column:
    """To [0, 1]; NaN gives 1, null stays."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def audit(rows: DataFrame, least: int, names: tuple[str, ...] = INTENTS) -> DataFrame:
    """A row for each of names: its count among rows (label, confidence), 0 where absent, and share; whether it is missing, or has fewer than `least`.

    ready: no label is missing or weak. rows and confidence_*: of all rows, null confidences left out.
    """
    from graphtrust.functions.stats import fixed

    known = rows.sparkSession.createDataFrame([(x,) for x in names], "label string")
    counts = known.join(F.broadcast(rows.filter(F.col("label").isin(*names)).groupBy("label").agg(F.count("*").alias("n"))), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))  # a row for each name
    c = F.col("confidence")
    whole = rows.agg(F.count("*").alias("rows"), *[fixed(x).alias(f"confidence_{name}") for name, x in (("mean", F.avg(c)), ("median", F.median(c)), ("min", F.min(c)), ("max", F.max(c)))])
    least_seen = counts.agg((F.min("n") >= least).alias("ready"))
    n = F.col("n")
    out = counts.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(least_seen))  # one row each
    return out.select("label", "n", fixed(F.coalesce(F.try_divide(n, F.col("rows")), F.lit(0.0)), 4).alias("share"), (n == 0).alias("missing"), ((n > 0) & (n < least)).alias("underpowered"), "ready", "rows", *[f"confidence_{k}" for k in ("mean", "median", "min", "max")])


def parse_reply(content: Column) -> Column:
    """struct(label, confidence, error) of a reply {"label", "confidence"}."""
    doc = F.try_parse_json(content)
    raw = F.try_variant_get(doc, "$.label", "string")
    label = normalise_label(raw)
    error = (
        F.when(content.isNull(), "missing_message_content").when(doc.isNull(), "json_decode_error")
        .when(label.isNull(), F.concat(F.lit("unknown_label: "), F.coalesce(raw, F.lit(""))))
    )
    confidence = clamp(F.try_variant_get(doc, "$.confidence", "double"))
    return F.struct(label.alias("label"), F.when(label.isNotNull(), confidence).alias("confidence"), error.alias("error"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(line_no, edge_id, label, confidence, error) of responses (line_no, value), one JSON document each."""
    rows = responses.select("line_no", F.get_json_object("value", "$.custom_id").alias("edge_id"), parse_reply(reply_content(F.col("value"))).alias("r"))
    return rows.select("line_no", "edge_id", "r.*")


def joined_labels(responses: DataFrame, selected: DataFrame) -> DataFrame:
    """selected (edge_id, ...) with label and confidence of the responses that gave one; an edge with two replies stands twice, none parsed: no rows."""
    good = parse_responses(responses).filter("error is null").select("edge_id", "label", "confidence")
    return selected.join(good, "edge_id")
