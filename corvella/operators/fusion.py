"""Merging dense and sparse hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.operators.dense import ranked


def minmax(hits: DataFrame, name: str = "scaled") -> DataFrame:
    """Scores of each query scaled to 0 to 1; all 0 where they are equal."""
    w = Window.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn(name, (F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low))


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    d = minmax(dense, "dense").select("qid", "doc_id", "dense", F.col("place").alias("dense_place"))
    s = minmax(sparse, "sparse").select("qid", "doc_id", "sparse", F.col("place").alias("sparse_place"))
    return d.join(s, ["qid", "doc_id"], "full_outer")


def _order(df: DataFrame) -> DataFrame:
    """Places by score; ties by dense place, then sparse place."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("dense_place"), F.asc_nulls_last("sparse_place"), "doc_id")
    return df.select("qid", "doc_id", "score", F.row_number().over(w).cast("long").alias("place"))


def linear_fusion(dense: DataFrame, sparse: DataFrame, alpha: float) -> DataFrame:
    """``(qid, doc_id, score, place)``: ``alpha`` of the dense and the rest of the sparse score, both min-max scaled.

    A query without sparse hits takes its dense scores whole.  A document that one side misses has 0 there.
    """
    hits = F.count("sparse").over(Window.partitionBy("qid"))
    a = F.when(hits > 0, F.lit(float(alpha))).otherwise(F.lit(1.0))
    return _order(_both(dense, sparse).withColumn("score", a * F.coalesce("dense", F.lit(0.0)) + (1 - a) * F.coalesce("sparse", F.lit(0.0))))


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, k: int = 60) -> DataFrame:
    """``(qid, doc_id, score, place)`` by weighted reciprocal places."""
    one = lambda side: F.coalesce(1.0 / (k + F.col(f"{side}_place")), F.lit(0.0))
    return _order(_both(dense, sparse).withColumn("score", alpha * one("dense") + (1 - alpha) * one("sparse")))


__all__ = ["linear_fusion", "minmax", "ranked", "reciprocal_rank_fusion"]
