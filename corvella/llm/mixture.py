"""Mixing sources to target shares of tokens by iterative proportional fitting (problem 7)."""

from __future__ import annotations

import base64
from contextlib import ExitStack
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.session import scratch, staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this tokenizer cuts text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: Fixed value: from this part of its limit on, a use stands at it.
AT_LIMIT = 1 - 1e-9


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, name: str = "tokens") -> DataFrame:
    """The columns of ``docs`` but for the text, and its number of tokens; 0 for null or empty texts.

    The vocabulary is a file of ranks as published, about 1 MB, sent to the workers once.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        import tiktoken

        pairs = (line.split() for line in ranks.value.splitlines() if line)
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*rest, name])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, text_col).mapInArrow(run, f"{kinds}, `{name}` bigint")


def rake(
    tokens: np.ndarray,
    cells: np.ndarray,
    targets: list[np.ndarray],
    most: np.ndarray,
    rounds: int = 100,
    tolerance: float = 1e-9,
) -> np.ndarray:
    """How often to use the records of each cell, so that every marginal meets its target.

    ``cells`` has a column for each dimension, ``targets`` the wanted tokens by dimension and level (the first is met
    last and exactly), ``most`` the largest use of a cell.  Where uses reach their limit, what they lack falls to
    the other cells of the same level.  A use that misses its limit by rounding stands at it, so the order of sums decides nothing.
    """
    use = np.ones(len(tokens))
    for _ in range(rounds):
        before = use.copy()
        for k in reversed(range(len(targets))):
            for _ in range(len(tokens) + 1 if k == 0 else 1):
                free = use < most * AT_LIMIT
                fixed = np.bincount(cells[:, k], np.where(free, 0, use * tokens), len(targets[k]))
                loose = np.bincount(cells[:, k], np.where(free, use * tokens, 0), len(targets[k]))
                want = np.maximum(targets[k] - fixed, 0)
                scale = np.divide(want, loose, out=np.ones_like(want), where=loose > 0)[cells[:, k]]
                scaled = np.where(free, use * scale, use)
                over = scaled > most
                use = np.minimum(scaled, most)
                if not over.any():
                    break
            # a level whose cells all stand at their limit but are wanted less comes down as a whole
            have = np.bincount(cells[:, k], use * tokens, len(targets[k]))
            down = np.where((have * AT_LIMIT > targets[k]) & (have > 0), targets[k] / np.where(have > 0, have, 1), 1.0)
            use = use * down[cells[:, k]]
        if np.abs(use - before).max(initial=0) < tolerance:
            break
    return use


def rake_frame(cells: DataFrame, sides: dict[str, DataFrame], rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """``rake`` for cells that are too many for the driver: ``(source, lang, topic, tokens, most, use)``, the same uses but for the order of sums.

    ``sides`` has ``(level, target)`` for each dimension, in the order in which they are met; the last is scaled until no use reaches its limit, as what
    its levels lack where uses do falls to the others.  What a round begins with is in the shared folder, and is deleted when the next is.
    """
    state, n = cells.withColumns({"use": F.lit(1.0), "_before": F.lit(1.0), "_over": F.lit(False)}), cells.count()
    *first, last = sides
    held = ExitStack()
    with ExitStack() as ended:
        ended.callback(lambda: held.close())

        def step(state: DataFrame, *dims: str) -> tuple[DataFrame, bool, float]:
            nonlocal held
            for dim in dims:
                state = _scaled(state, dim, sides[dim])
            now = ExitStack()
            state = now.enter_context(scratch(cells.sparkSession))(state, "raked")
            held.close()
            held = now
            over, moved = state.agg(F.max("_over"), F.max(F.abs(F.col("use") - F.col("_before")))).first()
            return state, bool(over), moved or 0.0

        for _ in range(rounds):
            state, over, moved = step(state.withColumn("_before", F.col("use")), *first, last)
            for _ in range(n):
                if not over:
                    break
                state, over, moved = step(state, last)
            if moved < tolerance:
                break
        return staged(state.drop("_before", "_over"), "raked")


def _scaled(state: DataFrame, dim: str, side: DataFrame) -> DataFrame:
    """One step of ``rake``: uses below their limit are scaled to the target of their level; ``_over`` tells which would pass the limit."""
    free = F.col("use") < F.col("most") * AT_LIMIT
    spent = F.col("use") * F.col("tokens")
    level = state.groupBy(F.col(dim).alias("_level")).agg(F.sum(F.when(free, spent).otherwise(0.0)).alias("_loose"), F.sum(F.when(free, 0.0).otherwise(spent)).alias("_fixed"))
    level = level.join(side, level["_level"].eqNullSafe(side["level"])).select("_level", "_loose", "_fixed", "target")
    raised = F.when(free & (F.col("_loose") > 0), F.col("use") * F.greatest(F.col("target") - F.col("_fixed"), F.lit(0.0)) / F.col("_loose")).otherwise(F.col("use"))
    # a level whose cells at their limit are wanted less comes down
    down = F.when((F.col("_fixed") > 0) & (F.col("_fixed") * AT_LIMIT > F.col("target")), F.col("target") / F.col("_fixed"))
    new = state.join(level, state[dim].eqNullSafe(level["_level"])).withColumns({"_raised": raised, "_lower": F.when(free, F.lit(1.0)).otherwise(F.coalesce(down, F.lit(1.0)))})
    return new.select("source", "lang", "topic", "tokens", "most", (F.least("most", "_raised") * F.col("_lower")).alias("use"), "_before", (F.col("_raised") > F.col("most")).alias("_over"))


def plan_mix(counted: DataFrame, targets: DataFrame, driver_cells: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """``(cells, report)`` of the mix of ``counted`` rows ``(source, lang, topic, tokens)``.

    The mix is as large as all of ``counted``.  Source marginals are the target shares, or all a source can give at
    ``max_repeats``; those of language and topic are their shares of the tokens of the sources in the mix.  Every language and topic is a level of its own,
    null too.  Up to ``driver_cells`` cells are raked on the driver (60 MB at that number), more by ``rake_frame``, which takes the same steps, so the number of cells decides only where they are raked.  A source ``misses`` its share if the raked
    cells give less.  Null sources or shares are left out, a null ``max_repeats`` is 1, of repeated sources the largest values hold.
    """
    spark = counted.sparkSession
    wanted = (
        targets.where("source is not null and target_share is not null")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    cells = counted.join(wanted.select("source", F.col("max_repeats").cast("double").alias("most")), "source").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.max("most").alias("most"))
    cells = staged(cells.where("tokens > 0"), "cells")
    n = cells.count()
    have = cells.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    goals = wanted.join(have, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("target_share") * total).alias("target_tokens")
    )
    goals = goals.withColumn("goal", F.least("target_tokens", F.col("tokens") * F.col("max_repeats")).cast("double"))
    size, reached = (r := cells.agg(F.sum("tokens")).first()[0] or 0), (goals.agg(F.sum("goal")).first()[0] or 0.0)
    sides = {c: cells.groupBy(F.col(c).alias("level")).agg((F.sum("tokens") / max(r, 1) * reached).alias("target")) for c in ("topic", "lang")}
    sides["source"] = goals.select(F.col("source").alias("level"), F.col("goal").alias("target"))
    if n > driver_cells:
        plan = rake_frame(cells, sides)
    else:
        table = cells.toArrow()
        place, aims = [], []
        for dim in ("source", "lang", "topic"):
            side = sides[dim].toArrow()
            order = {v: i for i, v in enumerate(side.column("level").to_pylist())}
            place.append([order[v] for v in table.column(dim).to_pylist()])
            aims.append(np.array(side.column("target").to_pylist(), float))
        tokens, most = (np.array(table.column(c).to_pylist(), float) for c in ("tokens", "most"))
        use = rake(tokens, np.array(place, int).reshape(3, -1).T, aims, most) if n and size else np.zeros(n)
        plan = spark.createDataFrame(table.append_column("use", pa.array(use, pa.float64())), "source string, lang string, topic string, tokens bigint, most double, use double")
    plan = plan.select("source", "lang", "topic", "tokens", F.col("use").alias("expected_uses"))
    planned = plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("expected_uses")).alias("planned_tokens"))
    report = goals.join(planned, "source", "left").select(
        "source",
        "target_share",
        F.col("max_repeats").cast("int").alias("max_repeats"),
        "tokens",
        "target_tokens",
        F.coalesce("planned_tokens", F.lit(0.0)).alias("planned_tokens"),
        (F.coalesce("planned_tokens", F.lit(0.0)) < F.col("target_tokens") * (1 - 1e-7)).alias("misses"),
    )
    return plan.drop("tokens"), report


def counted_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)``, written once: languages in lower case, ``und`` if null; the topic is ``type`` of the metadata."""
    return staged(
        token_counts(
            docs.select(
                "doc_id",
                "source",
                F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"),
                F.coalesce(F.get_json_object("metadata_json", "$.type"), F.lit("none")).alias("topic"),
                "text",
            ),
            vocabulary=vocabulary,
        ),
        "tokens",
    )


def _cuts(drawn: DataFrame, report: DataFrame, bins: int = 512) -> DataFrame:
    """``(source, cut)``: up to which ratio of luck and probability a source's documents are used once more.

    Tokens are summed by source and bin of the ratio, four times ``bins`` a source at most, and added up in the order of the bins.
    """
    slot = F.when(F.col("ratio") < 4, F.floor(F.col("ratio") * bins)).otherwise(F.lit(-1)).cast("int")
    per = drawn.groupBy("source", slot.alias("slot")).agg(F.sum(F.col("tokens") * F.col("whole")).alias("sure"), F.sum("tokens").alias("more"))
    none = report.select("source", F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("sure"), F.lit(0).cast("long").alias("more"))
    all_ = Window.partitionBy("source")
    reached = F.sum("sure").over(all_) + F.sum(F.when(F.col("slot") >= 0, F.col("more")).otherwise(0)).over(all_.orderBy("slot").rangeBetween(Window.unboundedPreceding, 0))
    steps = per.unionByName(none).select("source", (F.col("slot") + 1).alias("step"), reached.alias("reached")).join(report.select("source", "planned_tokens"), "source")
    best = F.min_by("step", F.struct(F.abs(F.col("reached") - F.col("planned_tokens")), "step"))
    return steps.groupBy("source").agg((best / bins).alias("cut"))


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)``: how often each document is used, and what each source was to give, could give and gives.

    A document of a cell with ``u`` expected uses is used ``floor(u)`` times, and once more with the rest as its probability,
    decided by a hash of its id and ``seed``; so never more than ``max_repeats`` times, and the same on every run.
    A source's probabilities are then all scaled by one factor, by which the tokens drawn come nearest to those planned.
    ``sample`` has ``(doc_id, source, tokens, uses)`` with ``uses > 0``.  ``reached_share`` is of the tokens of all documents.
    Documents of sources without a target are not used but count towards the size; null and empty texts have no
    tokens and are not used; an empty table reaches no share.
    """
    counted = counted_documents(docs, vocabulary)
    plan, report = plan_mix(counted, targets)
    report = staged(report, "report")
    luck = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(2**53))
    whole = F.floor("expected_uses").cast("long")
    part = F.col("expected_uses") - whole
    rows = counted.where("tokens > 0")
    same = rows["source"].eqNullSafe(plan["source"]) & rows["lang"].eqNullSafe(plan["lang"]) & rows["topic"].eqNullSafe(plan["topic"])
    drawn = rows.join(plan, same).select("doc_id", rows["source"], "tokens", whole.alias("whole"), F.when(part > 1e-9, luck / part).alias("ratio"))
    sample = (
        drawn.join(_cuts(drawn, report), "source", "left")
        .withColumn("uses", F.col("whole") + F.coalesce(F.col("ratio") < F.coalesce("cut", F.lit(1.0)), F.lit(False)).cast("long"))
        .where("uses > 0")
        .select("doc_id", "source", "tokens", "uses")
    )
    reached = sample.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached_tokens"))
    total = counted.agg(F.sum("tokens").alias("all_tokens"))
    full = (
        report.join(reached, "source", "left")
        .join(F.broadcast(total))
        .withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
        .withColumn("reached_share", F.col("reached_tokens") / F.expr("nullif(all_tokens, 0)"))
        .drop("all_tokens")
    )
    return sample, full
