"""Hybrid search for batches of queries."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.errors import AlphaError
from corvella.functions.text import seconds
from corvella.operators.dense import dense_topk, ranked
from corvella.operators.filters import filtered
from corvella.operators.fusion import linear_fusion
from corvella.operators.rank import cross_rerank, recency, reflection_rerank
from corvella.operators.sparse import SparseIndex, bm25_topk


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    top_k: int = 10,
    alpha: float = 0.5,
    namespace: str | None = None,
    filters: dict | None = None,
    recency_weight: float = 0.0,
    now: float = 0.0,
    rerank: bool = False,
    reflection: bool = False,
    prefilter: bool = False,
    dim: int = 64,
    index: SparseIndex | None = None,
    written: Callable[[Column], Column] | None = None,
    most_candidates: int = 1_000_000,
) -> DataFrame:
    """``(qid, doc_id, score, place, text, metadata_json, namespace, modality, created_at)`` for queries ``(qid, text, vector)``.

    Each side retrieves ``16 * top_k``, their linear fusion is cut to ``4 * top_k``, and only then do namespace and filters apply, so fewer
    than ``top_k`` rows may remain; with ``prefilter`` both reach the scan instead.  Then follow recency, the cross scorer, the
    reflection reranker, and the cut to ``top_k``.  Statistics are those of all documents searched; ``index`` brings them and the postings of ``docs`` if they
    are kept somewhere (``written`` gives a term as they hold it), and is not used with ``prefilter``.  The candidates go to the documents, not these to them, while they are at most ``most_candidates``.
    """
    if not 0 <= alpha <= 1 or math.isnan(alpha):
        raise AlphaError(alpha)
    base = docs
    if prefilter:
        base = base.where(F.col("namespace") == namespace) if namespace else base
        base = filtered(base, filters)
    wide = 16 * top_k
    asked = queries.select("qid", "text")
    sparse = bm25_topk(asked, base, wide) if index is None or prefilter else bm25_topk(asked, index, wide, written)
    fused = linear_fusion(dense_topk(queries.select("qid", "vector"), base, wide, dim), sparse, alpha)
    fused = fused.where(F.col("place") <= 4 * top_k).select("qid", "doc_id", "score")
    if queries.count() * 4 * top_k <= most_candidates:
        fused = F.broadcast(fused)
    rows = fused.join(base.select("doc_id", "text", "metadata_json", "namespace", "modality", seconds(F.col("created_at")).alias("created_at")), "doc_id")
    if not prefilter:
        rows = rows.where(F.col("namespace") == namespace) if namespace else rows
        rows = filtered(rows, filters)
    rows = recency(rows, recency_weight, now)
    if rerank:
        rows = cross_rerank(rows, queries, top_k)
    if reflection:
        rows = reflection_rerank(rows, top_k)
        rows = cross_rerank(rows, queries, top_k) if rerank else rows
    return ranked(rows.drop("place"), top_k)
