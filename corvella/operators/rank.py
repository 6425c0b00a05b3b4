"""Reordering scored rows of a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.operators.dense import ranked

def _all():
    return Window.partitionBy("qid")



def recency(df: DataFrame, weight: float, now: float, created: str = "created_at") -> DataFrame:
    """Scores blended with how new a row is among its query's rows; the oldest counts 0."""
    if weight <= 0:
        return df
    age = F.lit(float(now)) - F.col(created)
    most = F.max(age).over(_all())
    fresh = 1 - age / F.when(most == 0, 1.0).otherwise(most)
    return df.withColumn("score", (1 - weight) * F.col("score") + weight * fresh)


def amplitude_encode(df: DataFrame, score: str = "score", name: str = "amplitude") -> DataFrame:
    """Scores at norm 1 within their query; equal parts where all are 0."""
    size = F.sqrt(F.sum(F.col(score) * F.col(score)).over(_all()))
    return df.withColumn(name, F.when(size > 0, F.col(score) / size).otherwise(1 / F.sqrt(F.count(F.lit(1)).over(_all()))))


def amplitude_decode(df: DataFrame, norm: Column, amplitude: str = "amplitude", name: str = "score") -> DataFrame:
    return df.withColumn(name, F.col(amplitude) * norm)


def best_iterations(n: Column) -> Column:
    """How often to reflect among ``n`` rows."""
    return F.when(n <= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.pi() / (4 * F.asin(1 / F.sqrt(n)))))).cast("long")


def reflect(df: DataFrame, iterations: int | None = None, amplitude: str = "amplitude") -> DataFrame:
    """Amplitudes mirrored at their mean ``iterations`` times, best_iterations if None.

    Two mirrorings cancel, so an odd number is one and an even number none; a single row stays.
    """
    n = F.count(F.lit(1)).over(_all())
    times = F.lit(iterations) if iterations is not None else best_iterations(n)
    mirrored = 2 * F.avg(amplitude).over(_all()) - F.col(amplitude)
    return df.withColumn(amplitude, F.when((n > 1) & (times % 2 == 1), mirrored).otherwise(F.col(amplitude)))


def reflection_rerank(df: DataFrame, top_k: int = 10, iterations: int | None = None, window: int = 1000, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """The ``top_k`` rows of each query by reflected amplitude.

    Only the ``window`` rows of highest score take part.  Of the reflected rows the first ``max(top_k, ceil(sqrt(rows)))`` survive; ``scorer``
    then scores them by their text.
    """
    kept = ranked(df.drop("place"), window).withColumn("rows", F.count(F.lit(1)).over(_all()))
    turned = reflect(amplitude_encode(kept), iterations).drop("score", "place").withColumnRenamed("amplitude", "score")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    alive = turned.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= F.greatest(F.lit(top_k), F.ceil(F.sqrt("rows")))).drop("rows")
    if scorer is not None:
        alive = alive.withColumn("score", scorer(F.col("text")))
    return ranked(alive.drop("place"), top_k)


def overlap_score(query: Column, text: Column) -> Column:
    """The default cross scorer: the share of the query's distinct words that the text has."""
    from corvella.functions.text import tokens

    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def cross_rerank(df: DataFrame, queries: DataFrame, top_k: int | None = None, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """Rows rescored by query and document text together; a model fits in as a pandas UDF of both."""
    asked = queries.select("qid", F.col("text").alias("_asked"))
    out = df.join(asked, "qid").withColumn("score", scorer(F.col("_asked"), F.col("text"))).drop("_asked", "place")
    return ranked(out, top_k if top_k is not None else 2**31 - 1)
