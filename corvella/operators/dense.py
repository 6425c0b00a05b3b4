"""Exact nearest documents by inner product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, k: int, by: str = "qid", score: str = "score", order: str = "doc_id", place: str = "place") -> DataFrame:
    """The ``k`` rows of highest score of each query, with their place from 1; scores that agree to nine digits tie and go by ``order``."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), order)
    return df.withColumn(place, F.row_number().over(w).cast("long")).where(F.col(place) <= k)


def dense_topk(queries: DataFrame, docs: DataFrame, k: int, dim: int = 64, block: int = 1024, most_bytes: int = 256_000_000) -> DataFrame:
    """``(qid, doc_id, score, place)`` of the ``k`` documents of highest inner product for each query ``(qid, vector)``.

    Vectors that are null, of another length or hold nulls take no part.  Each task multiplies its documents with blocks of the
    queries and passes on its own best ``k``, so what is shuffled is ``k`` rows a query and task; there are four tasks a core at most.  Query sets
    of which the vectors and best rows take above ``most_bytes`` in a task are cut into slices by their ids, each a pass over the documents.  ``k`` of 0 gives no rows.
    """
    spark = docs.sparkSession
    schema = "qid bigint, doc_id bigint, score double"
    if k <= 0:
        return spark.createDataFrame([], schema + ", place bigint")
    q = queries.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull())).select("qid", "vector")
    d = docs.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull())).select("doc_id", "embedding")
    d = d.coalesce(4 * spark.sparkContext.defaultParallelism)
    slices = q.count() * (dim * 8 + k * 64) // most_bytes + 1
    out = None
    for s in range(slices):
        part = q if slices == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == s)
        found = _pass(part, d, k, dim, block, schema)
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def _pass(q: DataFrame, d: DataFrame, k: int, dim: int, block: int, schema: str) -> DataFrame:
    table = q.toArrow()
    ids = np.asarray(table.column("qid").combine_chunks()) if table.num_rows else np.empty(0, np.int64)
    x = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, dim) if table.num_rows else np.empty((0, dim))
    known = d.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches):
        ids, x = known.value
        best_i, best_s = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for b in batches:
            docs = np.asarray(b.column(0)).astype(np.int64)
            v = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, dim)
            order = np.argsort(docs, kind="stable")
            docs, v = docs[order], v[order]
            if not len(docs) or not len(ids):
                continue
            new_i, new_s = [], []
            for a in range(0, len(ids), block):
                s = x[a : a + block] @ v.T
                i = np.concatenate([best_i[a : a + block], np.broadcast_to(docs, s.shape)], axis=1)
                s = np.concatenate([best_s[a : a + block], s], axis=1)
                top = np.lexsort((i, -s), axis=1)[:, :k]
                new_i.append(np.take_along_axis(i, top, axis=1))
                new_s.append(np.take_along_axis(s, top, axis=1))
            best_i, best_s = np.concatenate(new_i), np.concatenate(new_s)
        n = best_i.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(best_i.ravel(), pa.int64()), pa.array(best_s.ravel(), pa.float64())], names=["qid", "doc_id", "score"])

    return d.mapInArrow(run, schema)
