"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stars(pairs: DataFrame) -> DataFrame:
    """``(u, v)`` to ``(v, m)``, ``m`` the least of ``u`` and all its ``v``; only minima are aggregated, so a hub is no hot group."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    s = _stars(down)
    return (
        s.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(s.select("u", F.col("m").alias("v")))
        .where("u != v")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of all nodes with a link; a component is named by its least node.

    Rounds of large-star and small-star until the edges stay as they are, at most about the square of the
    logarithm of the nodes.  Each round is written to the checkpoint folder.  Null ends, loops and
    repeated links do not matter; no links give no rows.
    """
    from corvella.session import scratch_dir

    scratch_dir(links.sparkSession)
    edges = (
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u != v")
        .distinct()
        .checkpoint()
    )
    before = None
    while before != (now := _state(edges)):
        before = now
        if not now[0]:
            break
        edges = _small(_large(edges)).checkpoint()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
