"""Aggregates over a join of two skewed tables, without joining their rows (problem 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
_FIRST = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    group_left: Sequence[str] = (),
    group_right: Sequence[str] = (),
    measures: dict[str, tuple[str, str, str]] | None = None,
    rows: str = "rows",
    how: str = "inner",
) -> DataFrame:
    """``SELECT groups, measures FROM left JOIN right ON ... GROUP BY groups``, by eager aggregation.

    Both inputs are aggregated by their join and group columns first, where each task keeps one state a key, so a hot key
    is a few rows by the time it is shuffled.  The states are joined, counts multiplied (a sum of one side times the rows of the
    other), and rolled up.  ``measures`` maps names to ``(side, function, column)`` with side ``left`` or ``right`` and function ``sum``,
    ``count``, ``min`` or ``max``; ``rows`` names the number of joined rows.

    ``how`` is ``inner`` or ``left``; null keys match nothing.  Nulls in measured columns are skipped as in SQL.  A group column
    of the right keeps its name, so it must differ from those of the left.  Sums of integers are bigint.  With no groups an empty
    input gives no row.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    measures = measures or {}
    clash = set(group_left) & set(group_right)
    if clash:
        raise ValueError(f"group columns of both sides: {sorted(clash)}")

    def state(df: DataFrame, side: str, at: int, groups: Sequence[str]) -> DataFrame:
        keys = [df[pair[at]].alias(f"_k{i}") for i, pair in enumerate(on)]
        own = {n: m for n, m in measures.items() if m[0] == side}
        cols = [df[m[2]].alias(f"_v{n}") for n, m in own.items()]
        named = df.select(*keys, *[df[g].alias(f"_g{side}{g}") for g in groups], *cols)
        if how == "inner" or side == "right":
            named = named.dropna(subset=[f"_k{i}" for i in range(len(on))]) if on else named
        by = [f"_k{i}" for i in range(len(on))] + [f"_g{side}{g}" for g in groups]
        return named.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_n{side}"), *[_FIRST[m[1]](f"_v{n}").alias(f"_s{n}") for n, m in own.items()])

    keys = [f"_k{i}" for i in range(len(on))]
    joined = state(left, "left", 0, group_left).join(state(right, "right", 1, group_right), keys, how)
    other = {"left": F.coalesce("_nright", F.lit(1)), "right": F.col("_nleft")}
    out = [F.sum(F.col("_nleft") * F.coalesce("_nright", F.lit(1))).alias(rows)]
    for name, (side, fn, _) in measures.items():
        part = F.col(f"_s{name}")
        if fn in ("sum", "count"):
            part = part * other[side]
        value = _MERGE[fn](part)
        out.append((F.coalesce(value, F.lit(0)) if fn == "count" else value).alias(name))
    groups = [F.col(f"_gleft{g}").alias(g) for g in group_left] + [F.col(f"_gright{g}").alias(g) for g in group_right]
    return joined.groupBy(*groups).agg(*out)


def large_groups(docs: DataFrame, names: DataFrame, share: float, group: str = "namespace", name: str = "name") -> DataFrame:
    """``(group, rows)`` of the groups with at least ``share`` of all rows; null is no group.

    The names add nothing but themselves: a group that they miss counts as well, and repeated names count once.
    """
    per = eager_join_aggregate(docs, names.select(name).distinct(), [(group, name)], group_left=[group], how="left")
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return per.join(F.broadcast(total)).where(F.col(group).isNotNull() & (F.col("rows") >= share * F.col("total"))).select(group, "rows")
