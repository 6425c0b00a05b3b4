"""Okapi BM25 as relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions.text import tokens
from corvella.operators.dense import ranked
from corvella.session import staged

#: The usual constants of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25


def doc_terms(docs: DataFrame) -> DataFrame:
    """``(doc_id, terms, dl)`` of every document, also of those without words."""
    return docs.select("doc_id", tokens(F.col("text")).alias("terms")).withColumn("dl", F.size("terms").cast("long"))


def postings(docs: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, dl)``."""
    t = doc_terms(docs).select("doc_id", "dl", F.explode("terms").alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")).select("doc_id", "term", "tf", "dl")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row ``(n, avgdl)``."""
    return doc_terms(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(docs: DataFrame) -> DataFrame:
    """``(term, df, idf)`` before the floor."""
    df = doc_terms(docs).select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return df.join(F.broadcast(n)).select("term", "df", idf.alias("idf"))


def floored(terms: DataFrame) -> DataFrame:
    """``(term, df, idf)`` where negative weights are ``EPSILON`` times the mean of all terms' weights."""
    mean = terms.agg(F.avg("idf").alias("mean_idf"))
    return terms.join(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(term, df, words)`` in one pass: of the null term, ``df`` is the number of documents and ``words`` that of all words."""
    t = doc_terms(docs).select("dl", F.explode(F.array_append(F.array_distinct("terms"), F.lit(None).cast("string"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("words"))


@dataclass
class SparseIndex:
    """What BM25 needs of a collection: ``postings`` ``(doc_id, term, tf, dl)``, ``terms`` ``(term, df)`` and three numbers.

    ``mean_idf`` is over all terms, negative weights included.  A store keeps all of it; ``indexed`` makes one for a table.
    """

    postings: DataFrame
    terms: DataFrame
    documents: int
    words: int
    mean_idf: float


def mean_idf(terms: DataFrame, documents: int) -> float:
    """The mean weight of all terms ``(term, df)`` before the floor."""
    return terms.agg(F.avg(F.log(documents - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0


def indexed(docs: DataFrame, wanted: DataFrame | None = None) -> SparseIndex:
    """An index of ``docs``; statistics are counted in one pass and written to the shared folder, so none of it is counted again.

    With ``wanted`` words ``(term)``, which must be few enough for every task, the words of a text are filtered to these as they come out of it.
    """
    words = staged(vocabulary(docs), "vocabulary")
    whole = words.where("term is null").first()
    terms = words.where("term is not null").select("term", "df")
    n = whole["df"] if whole else 0
    t = doc_terms(docs).select("doc_id", "dl", F.explode("terms").alias("term"))
    t = t if wanted is None else t.join(F.broadcast(wanted), "term", "left_semi")
    tf = t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    return SparseIndex(tf, terms, n, (whole["words"] or 0) if whole else 0, mean_idf(terms, n))


def _asked(queries: DataFrame, written: Callable[[Column], Column] | None) -> DataFrame:
    """``(qid, term, times)``, written to the shared folder."""
    asked = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    return staged(asked if written is None else asked.withColumn("term", written(F.col("term"))), "asked")


def _weighed(asked: DataFrame, index: SparseIndex, everywhere: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(qid, term, times, idf)`` of the asked words that the collection has."""
    df = F.col("df")
    idf = F.log(index.documents - df + 0.5) - F.log(df + 0.5)
    weights = index.terms.join(everywhere(asked.select("term").distinct()), "term", "left_semi").select("term", F.when(idf < 0, EPSILON * index.mean_idf).otherwise(idf).alias("idf"))
    return asked.join(weights, "term")


def _avgdl(index: SparseIndex) -> float:
    return index.words / index.documents if index.documents and index.words else 1.0


def bm25_scores(queries: DataFrame, docs: DataFrame | SparseIndex, most_asked: int = 1_000_000, written: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(qid, doc_id, score)`` of every document with a term of query ``(qid, text)``.

    A query's repeated words count repeatedly.  Statistics are those of all ``docs``.  The asked words go to every task
    while they are at most ``most_asked`` (about 50 MB), so of the postings only those of asked words are shuffled, once; beyond that they meet the postings in a shuffle.  Null texts are documents
    without words; an empty collection or query has no scores.  All scores are shuffled, up to one a query and document: for the best alone there is ``bm25_topk``.
    """
    asked = _asked(queries, written)
    few = asked.count() <= most_asked
    everywhere = F.broadcast if few else (lambda d: d)
    index = docs if isinstance(docs, SparseIndex) else indexed(docs, asked.select("term").distinct() if few else None)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / _avgdl(index)))
    return index.postings.join(everywhere(_weighed(asked, index, everywhere)), "term").groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def bm25_topk(queries: DataFrame, docs: DataFrame | SparseIndex, k: int, written: Callable[[Column], Column] | None = None, most_bytes: int = 256_000_000) -> DataFrame:
    """``(qid, doc_id, score, place)`` of the ``k`` best documents; only scores above 0 remain, taken after the cut.

    ``written`` gives a term as an index holds it.  Over a table, whose ``doc_id`` is a key, each task multiplies its documents with blocks of the queries and passes on its own best ``k``,
    so what is shuffled is ``k`` rows a query and task, of which there are two a core at most.  Query sets of which the words and best rows take above ``most_bytes`` in a task are cut
    into slices by their ids, each a pass over the documents.  Over an index, which has no documents but postings, all scores are shuffled.
    """
    if isinstance(docs, SparseIndex) or k <= 0:
        return ranked(bm25_scores(queries, docs, written=written), k).where("score > 0")
    asked, index = _asked(queries, written), indexed(docs)
    known = _weighed(asked, index, lambda d: d).select("qid", "term", (F.col("times") * F.col("idf")).alias("weight"))
    words, asking = asked.agg(F.count(F.lit(1)), F.count_distinct(F.struct("qid"))).first()
    slices = (words * 40 + asking * k * 48) // most_bytes + 1
    d = doc_terms(docs).select("doc_id", "terms").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    out = None
    for s in range(slices):
        found = _pass(known if slices == 1 else known.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == s), d, k, _avgdl(index))
        out = found if out is None else out.unionByName(found)
    return ranked(out, k).where("score > 0")


def _pass(known: DataFrame, d: DataFrame, k: int, avgdl: float, rows: int = 512, width: int = 4096, dense: int = 200, pairs: int = 1 << 20) -> DataFrame:
    """``(qid, doc_id, score)`` of each task's best ``k`` of scores above 0.

    Queries are taken by ``rows``, documents by ``width``.  Words that fill at least one in ``dense`` pairs of a query and a document are a product of matrices,
    rarer ones are added pair by pair, ``pairs`` at a time.
    """
    table = known.toArrow()
    ids = table.column("qid").combine_chunks().dictionary_encode("encode")
    terms = table.column("term").combine_chunks().dictionary_encode()
    q, t, w = np.asarray(ids.indices), np.asarray(terms.indices), np.asarray(table.column("weight").combine_chunks(), np.float64)
    order = np.lexsort((t, q))
    sent = d.sparkSession.sparkContext.broadcast((ids.dictionary, terms.dictionary, q[order].astype(np.int64), t[order].astype(np.int64), w[order]))

    def run(batches):
        ids, words, q, t, w = sent.value
        n, size = len(ids), len(words)
        often = np.bincount(t, minlength=size)
        bounds = np.searchsorted(q, np.arange(0, n + rows, rows))
        best = [Best(min(rows, n - a), k) for a in range(0, n, rows)]
        for b in batches:
            if not n or not b.num_rows:
                continue
            texts = b.column(1)
            length = np.asarray(pc.list_value_length(texts)).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), length)
            term = np.asarray(pc.fill_null(pc.index_in(texts.flatten(), value_set=words), -1)).astype(np.int64)
            doc, term = doc[term >= 0], term[term >= 0]
            # in the order of blocks of documents, words, documents
            key, tf = np.unique((doc // width * size + term) * width + doc % width, return_counts=True)
            place, at = key // width, key % width
            at_block = np.searchsorted(place, np.arange(-(-b.num_rows // width) + 1) * size)
            norm = K1 * (1 - B + B * length / avgdl)
            for c in range(0, b.num_rows, width):
                lo, hi = at_block[c // width], at_block[c // width + 1]
                if lo == hi:
                    continue
                wide = min(width, b.num_rows - c)
                dt, dd = place[lo:hi] - c // width * size, at[lo:hi]
                dw = tf[lo:hi] * (K1 + 1) / (tf[lo:hi] + norm[c + dd])
                have = np.bincount(dt, minlength=size)
                first = np.cumsum(have) - have
                full = np.flatnonzero(often * have * dense >= n * wide)
                column = np.full(size, -1)
                column[full] = np.arange(len(full))
                x = np.zeros((len(full), wide))
                inside = column[dt] >= 0
                x[column[dt[inside]], dd[inside]] = dw[inside]
                for i, mine in enumerate(best):
                    eq, et, ew = (v[bounds[i] : bounds[i + 1]] for v in (q, t, w))
                    eq = eq - i * rows
                    inside = column[et] >= 0
                    m = np.zeros((mine.rows, len(full)))
                    m[eq[inside], column[et[inside]]] = ew[inside]
                    scores = m @ x
                    rare = ~inside & (have[et] > 0)
                    eq, et, ew = eq[rare], et[rare], ew[rare]
                    upto = np.cumsum(have[et])
                    e = 0
                    while e < len(et):
                        done = upto[e - 1] if e else 0
                        f = max(e + 1, int(np.searchsorted(upto, done + pairs, "right")))
                        times = have[et[e:f]]
                        p = np.repeat(first[et[e:f]] - (upto[e:f] - times - done), times) + np.arange(upto[f - 1] - done)
                        scores += np.bincount(np.repeat(eq[e:f] * wide, times) + dd[p], np.repeat(ew[e:f], times) * dw[p], scores.size).reshape(scores.shape)
                        e = f
                    mine.add(scores, b.column(0).slice(c, wide))
        for i, mine in enumerate(best):
            row, doc, score = mine.result()
            if len(row):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + i * rows)), doc, pa.array(score, pa.float64())], names=["qid", "doc_id", "score"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("qid", known), ("doc_id", d)))
    return d.mapInArrow(run, f"{kinds}, score double")


class Best:
    """The ``k`` highest scores above 0 of each of ``rows`` queries, in the order of ``ranked``: to nine digits, then by id."""

    def __init__(self, rows: int, k: int):
        self.rows, self.k, self.least = rows, k, np.zeros(rows)
        self.held, self.waiting = [], 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of all queries and the documents ``ids``."""
        least, open_ = self.least.copy(), np.flatnonzero(self.least == 0)
        if len(open_) and scores.shape[1] > self.k:
            least[open_] = np.partition(scores[open_], -self.k, axis=1)[:, -self.k]
        row, at = np.nonzero(scores > np.maximum(least - 1e-9, 0)[:, None])
        self.held.append((row, ids.take(pa.array(at)), scores[row, at]))
        self.waiting += len(row)
        if self.waiting > self.rows * self.k:
            self._cut()

    def _cut(self) -> None:
        row, score = (np.concatenate([h[n] for h in self.held]) for n in (0, 2))
        ids = pa.concat_arrays([h[1] for h in self.held])
        by_id = np.asarray(pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)
        rounded = np.round(score, 9)
        order = np.lexsort((by_id, -rounded, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], np.arange(self.rows))[row[order]]
        last = order[place == self.k - 1]
        self.least[row[last]] = rounded[last]
        kept = order[place < self.k]
        self.held, self.waiting = [(row[kept], ids.take(pa.array(kept)), score[kept])], 0

    def result(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), pa.array([], pa.int64()), np.empty(0)
        self._cut()
        return self.held[0]
