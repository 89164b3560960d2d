"""The student: a hashed linear classifier of pair texts with class weights, fitted and applied by Spark."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtrust.functions.labels import INTENTS


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, class_weight): rows over classes times the class's rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("n"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("n") / (F.col("classes") * F.greatest("k", F.lit(1)))).alias("class_weight"))  # one row


def bounded(text: str, most: int) -> Column:
    """The first `most` words of a text, null as empty: what a student of bounded input reads."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\W+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, most), " ")


def fit_student(
    rows: DataFrame, text: str = "text", label: str = "label", names: tuple[str, ...] = INTENTS, features: int = 1 << 14, rounds: int = 30, least: int = 1, weighted: bool = True, decay: float = 1e-3, most_words: int = 256
) -> PipelineModel:
    """rows whose label is one of names; ValueError where a name among them has fewer than `least` rows or none has any.

    weighted: classes count alike; else rows do, as for the early student (three rounds on nine tenths of the rows).
    """
    known = rows.filter(F.col(label).isin(*names))
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}  # a row for each name
    if not counts or min(counts.values()) < least:
        raise ValueError(f"too few rows of a label: {counts}")
    code = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(label)) - 1
    ready = known.join(F.broadcast(class_weights(known, label)), label).select(bounded(text, most_words).alias("_text"), code.cast("double").alias("_code"), F.col("class_weight") if weighted else F.lit(1.0).alias("class_weight"))
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+"), HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
        LogisticRegression(featuresCol="_features", labelCol="_code", weightCol="class_weight", family="multinomial", maxIter=rounds, regParam=decay, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_best"),
    ]
    return Pipeline(stages=stages).fit(ready)


def infer(model: PipelineModel, rows: DataFrame, text: str = "text", names: tuple[str, ...] = INTENTS, most_words: int = 256) -> DataFrame:
    """rows with the most likely label and its probability as confidence."""
    scored = model.transform(rows.withColumn("_text", bounded(text, most_words)))
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_best").cast("int") + 1)
    return scored.select(*rows.columns, best.alias("student_label"), F.array_max(vector_to_array("_p")).alias("student_confidence"))


def macro_f1(judged: DataFrame, gold: str, said: str) -> float:
    """The mean F1 of the labels that are gold anywhere; a label never hit has 0."""
    cells = judged.groupBy(gold, said).agg(F.count("*").alias("n"))
    hit = cells.filter(F.col(gold) == F.col(said)).select(F.col(gold).alias("label"), F.col("n").alias("hit"))
    right = cells.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("support"))
    given = cells.groupBy(F.col(said).alias("label")).agg(F.sum("n").alias("given"))
    f1 = 2.0 * F.coalesce("hit", F.lit(0)) / (F.col("support") + F.coalesce("given", F.lit(0)))
    return right.join(hit, "label", "left").join(given, "label", "left").agg(F.coalesce(F.avg(f1), F.lit(0.0))).first()[0]


def fit_best(rows: DataFrame, valid: DataFrame, text: str = "text", label: str = "label", decays: tuple[float, ...] = (1e-4, 1e-3, 1e-2), **how) -> tuple[PipelineModel, float, float]:
    """(model, its decay, its macro F1 on valid): the student of largest macro F1 among several decays; ties go to the first."""
    found = []
    for decay in decays:
        model = fit_student(rows, text, label, decay=decay, **how)
        found.append((macro_f1(infer(model, valid, text), label, "student_label"), model, decay))
    score, model, decay = max(found, key=lambda f: f[0])
    return model, decay, score
