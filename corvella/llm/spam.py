"""Pages of strung-together keywords, links or tags, by pointwise mutual information of neighbouring words (problem 8)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.neardup import classes
from corvella.session import staged, wide

_TOKEN = re.compile(
    r"(?:https?://|www\.)\S+|[\w-]+(?:\.[\w-]+)+/\S*|\]\([^)\s]*\)|</?[a-z][^<>]*>|[^\W\d_]+|\d+"
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stands for any link: a pair with it is no collocation.
_LINK = 1
_NUMBER = 2
#: Times the rate of a pair in other documents at which its recurrence is excessive: from five occurrences, and below. Prose of template sentences stays below both.
_OFTEN, _SELDOM = 30, 300


def _ids(text: str, seen: dict) -> np.ndarray:
    """64-bit ids of the words; numbers share one, links share one, other markup has none."""
    out = []
    for t in _TOKEN.findall(text.lower()):
        h = seen.get(t)
        if h is None:
            if len(seen) > 300_000:
                seen.clear()
            if t.startswith("<") and not t.startswith("<a "):
                h = 0
            elif t.isalpha():
                h = xxhash.xxh64_intdigest(t) | 4
            else:
                h = _NUMBER if t.isdigit() else _LINK
            seen[t] = h
        if h:
            out.append(h)
    return np.array(out, np.uint64)


def _pairs(ids: np.ndarray) -> np.ndarray:
    x = (ids[:-1] * _ODD) ^ (ids[:-1] >> np.uint64(31))
    x = (x + ids[1:]) * _ODD
    return (x ^ (x >> np.uint64(32))) & ~np.uint64(1)


def _words(ids: np.ndarray) -> np.ndarray:
    """Ids of words among the ids of pairs."""
    x = ids * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(first)
    return k[at], np.add.reduceat(counts[order], at) if len(at) else counts


def _split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys by part, and where each part begins."""
    p = ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    return order, np.searchsorted(p[order], np.arange(parts + 1))


def _join(column) -> bytes:
    return b"".join(column.to_pylist())


def _worded(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, words, counted)``: the packed ids of each text's words; one text of each class of copies is counted.

    Texts are near-copies where the Jaccard similarity of their sets of word pairs is 0.7 or more, directly or through others.
    """

    def run(batches):
        seen: dict = {}
        for b in batches:
            words, nodes, prints = [], [], []
            for t in b.column(2).to_pylist():
                x = _ids(t, seen)
                words.append(x.tobytes())
                nodes.append(xxhash.xxh64_intdigest(words[-1]) >> 1)
                prints.append(np.unique((_pairs(x) >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.binary()), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary())], names=["row", "doc_id", "words", "node", "prints"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = staged(rows.mapInArrow(run, "row bigint, doc_id bigint, words binary, node bigint, prints binary"), "words")
    parents = classes(rows.where("length(prints) > 0").select("node", "prints"), 0.7, 16, 4)
    firsts = rows.groupBy("node").agg(F.min("row").alias("row")).join(parents, "node", "left").where("component is null or component = node")
    counted = rows.select("row", "doc_id", "words").join(firsts.select("row", F.lit(True).alias("counted")), "row", "left")
    return staged(counted.select("doc_id", "words", F.coalesce("counted", F.lit(False)).alias("counted")), "counted")


def _common(rows: DataFrame, least: float, parts: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted ids of all words and pairs that occur ``least`` times or more, their counts in the counted texts, and the words of those."""

    def local(batches):
        for b in batches:
            ids = [np.frombuffer(w, np.uint64) for w in b.column(1).to_pylist()]
            one = np.repeat(np.asarray(b.column(2).to_pylist(), bool), [max(0, 2 * len(x) - 1) for x in ids])
            n = sum(len(x) for x, c in zip(ids, b.column(2).to_pylist()) if c)
            if not len(one):
                continue
            keys = np.concatenate([k for x in ids for k in (_pairs(x), _words(x))])
            k, c = _counted(keys, (one.astype(np.int64) << 32) + 1)
            order, cut = _split(k, parts)
            k, c = k[order], c[order]
            full = [i for i in range(parts) if cut[i] < cut[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([n if i == full[0] else 0 for i in full], pa.int64()),
                    pa.array([k[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
                    pa.array([c[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
                ],
                names=["part", "words", "ids", "counts"],
            )

    def whole(group):
        keys = np.frombuffer(_join(group.column("ids")), np.uint64)
        both = np.frombuffer(_join(group.column("counts")), np.uint64)
        k, c = _counted(keys, (both & np.uint64(0xFFFFFFFF)).astype(np.int64))
        keep = c >= least
        c = _counted(keys, (both >> np.uint64(32)).astype(np.int64))[1]
        return pa.table(
            {
                "words": pa.array([sum(group.column("words").to_pylist())], pa.int64()),
                "ids": pa.array([k[keep].tobytes()], pa.binary()),
                "counts": pa.array([c[keep].tobytes()], pa.binary()),
            }
        )

    got = (
        rows.mapInArrow(local, "part int, words bigint, ids binary, counts binary")
        .groupBy("part")
        .applyInArrow(whole, "words bigint, ids binary, counts binary")
        .collect()
    )
    ids = np.frombuffer(b"".join(r.ids for r in got), np.uint64)
    order = np.argsort(ids)
    return ids[order], np.frombuffer(b"".join(r.counts for r in got), np.int64)[order], sum(r.words for r in got)


def _found(ids: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts of the keys, -1 for those that are not among ids."""
    if not len(ids):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
    return np.where(ids[at] == keys, counts[at], -1)


def _gain(tf: np.ndarray, count: np.ndarray, base: np.ndarray, log_n: float) -> np.ndarray:
    """Each pair's mutual information by the other documents, discounted where they have it rarely; 0 where they have it not at all."""
    other = np.maximum(count - tf, 0).astype(np.float64)
    return tf * (np.log(np.maximum(other, 1)) - log_n - base) * (other / (other + 1))


def _limit(tf: np.ndarray, pairs: np.ndarray, total: int) -> np.ndarray:
    """The most occurrences in other documents at which a pair's recurrence in its own is still excessive."""
    return np.minimum(tf * np.maximum(total - pairs, 1) // (np.where(tf >= 5, _OFTEN, _SELDOM) * pairs), 2**32 - 1)


def _excess(tf: np.ndarray, count: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return tf * ((tf >= 3) & ((tf >= 0.05 * count) | (count - tf <= limit)))


def collocation_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 2.0**-18) -> DataFrame:
    """``(doc_id, pairs, mean_pmi, repeated)`` of each document with two words or more.

    ``mean_pmi`` is the mean over neighbouring words of their pointwise mutual information, counted in all other
    documents, discounted by ``c / (c + 1)`` for ``c`` occurrences; a pair that no other document has, or with a link in it, is 0.  ``repeated`` is the share of pairs that recur at least three times
    and are 300 times as frequent in the document as in the others (30 times from five occurrences), or make a twentieth of all occurrences of that pair.

    Counts cover one text of each class of copies and near-copies (word pairs of Jaccard similarity 0.7, also through others), and every
    document is scored against them.  Words and pairs above ``share`` of the corpus (at most ``12 / share`` by the definition of
    the bound in characters) are counted first and broadcast; rarer words weigh as ``share``, the smoothing of their probability; rarer pairs meet
    in parts by their hash, each document's once, so no pair is hot.  Null and empty texts have no row, repeated rows
    of an id are scored one by one, other columns are ignored.  The input must be stable when read again.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null and text is not null")
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    least = max(2.0, share * chars / 6)
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // 4_000_000)
    with wide(spark, chars, 20_000_000):
        rows = _worded(docs)
        ids, counts, total = _common(rows, least, parts)
    known = spark.sparkContext.broadcast((ids, counts))
    log_n = np.log(max(total, 1))

    def local(batches):
        ids, counts = known.value
        for b in batches:
            keys, bases, pair_counts = [], [], []
            for w in b.column(1).to_pylist():
                x = np.frombuffer(w, np.uint64)
                p = np.log(np.maximum(_found(ids, counts, _words(x)), least)) - log_n
                linked = x == _LINK
                k = _pairs(x)
                k[linked[:-1] | linked[1:]] = 0
                keys.append(k)
                bases.append(p[:-1] + p[1:])
                pair_counts.append(len(k))
            sizes = np.array(pair_counts, np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            key, base = np.concatenate(keys), np.concatenate(bases)
            real = key != 0
            doc, key, base = doc[real], key[real], base[real]
            order = np.lexsort((key, doc))
            doc, key, base = doc[order], key[order], base[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(first)
            tf = np.diff(np.append(at, len(key)))
            doc, key, base = doc[at], key[at], base[at]
            count = _found(ids, counts, key)
            hot = count >= 0
            n = len(sizes)
            limit = _limit(tf, sizes[doc], total)
            gain = np.bincount(doc[hot], _gain(tf[hot], count[hot], base[hot], log_n), n).astype(np.float32)
            over = np.bincount(doc[hot], _excess(tf[hot], count[hot], limit[hot]), n).astype(np.uint32)
            doc, key, base, tf, limit = doc[~hot], key[~hot], base[~hot], tf[~hot], limit[~hot] * (tf[~hot] >= 3)
            counted = np.asarray(b.column(2).to_pylist(), np.uint32) << np.uint32(31)
            order, cut = _split(key, parts)
            doc, key, base, tf = doc[order], key[order], base[order].astype(np.float16), tf[order].astype(np.uint32)
            limit = limit[order].astype(np.uint32)
            six = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :6]
            doc_ids = np.asarray(b.column(0)).astype(np.int64)
            batch = xxhash.xxh64_intdigest(doc_ids.tobytes()) >> 1
            home = int(batch % parts)
            full = [i for i in range(parts) if cut[i] < cut[i + 1]]
            span = [slice(cut[i], cut[i + 1]) for i in full]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([home, *full], pa.int32()),
                    pa.array([batch] * (1 + len(full)), pa.int64()),
                    pa.array([doc_ids.tobytes()] + [None] * len(full), pa.binary()),
                    pa.array([sizes.astype(np.int64).tobytes(), *((np.bincount(doc[s], minlength=n).astype(np.uint32) | counted).tobytes() for s in span)], pa.binary()),
                    pa.array([gain.tobytes(), *(six[s].tobytes() for s in span)], pa.binary()),
                    pa.array([over.tobytes(), *(tf[s].tobytes() for s in span)], pa.binary()),
                    pa.array([None, *(base[s].tobytes() for s in span)], pa.binary()),
                    pa.array([None, *(limit[s].tobytes() for s in span)], pa.binary()),
                ],
                names=["part", "batch", "ids", "sizes", "x", "y", "z", "most"],
            )

    def meet(group):
        rows = group.to_pylist()
        cold = [r for r in rows if r["ids"] is None]
        out = [[r["batch"], r["ids"], r["sizes"], r["x"], r["y"]] for r in rows if r["ids"] is not None]
        if cold:
            six = np.frombuffer(b"".join(r["x"] for r in cold), np.uint8).reshape(-1, 6)
            key = np.zeros((len(six), 8), np.uint8)
            key[:, :6] = six
            key = key.view(np.uint64).ravel()
            tf = np.frombuffer(b"".join(r["y"] for r in cold), np.uint32).astype(np.int64)
            base = np.frombuffer(b"".join(r["z"] for r in cold), np.float16).astype(np.float64)
            limit = np.frombuffer(b"".join(r["most"] for r in cold), np.uint32).astype(np.int64)
            heads = [np.frombuffer(r["sizes"], np.uint32) for r in cold]
            pers = [h & np.uint32(2**31 - 1) for h in heads]
            counted = np.concatenate([np.repeat(h >> np.uint32(31), p) for h, p in zip(heads, pers)])
            k, c = _counted(key, tf * counted)
            count = c[np.searchsorted(k, key)]
            gain, over = _gain(tf, count, base, log_n), _excess(tf, count, limit)
            at = 0
            for r, per in zip(cold, pers):
                m = int(per.sum())
                doc = np.repeat(np.arange(len(per)), per)
                out.append([r["batch"], None, None, np.bincount(doc, gain[at : at + m], len(per)).astype(np.float32).tobytes(), np.bincount(doc, over[at : at + m], len(per)).astype(np.uint32).tobytes()])
                at += m
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["batch", "ids", "sizes", "gain", "over"])

    def finish(group):
        rows = group.to_pylist()
        heads = [r for r in rows if r["ids"] is not None]
        gain = np.sum([np.frombuffer(r["gain"], np.float32) for r in rows], axis=0, dtype=np.float64)
        over = np.sum([np.frombuffer(r["over"], np.uint32) for r in rows], axis=0, dtype=np.int64)
        ids, sizes = np.frombuffer(heads[0]["ids"], np.int64), np.frombuffer(heads[0]["sizes"], np.int64)
        # batches of the same ids in the same order share a key: their sums are those of all, so each takes its part
        keep = np.tile(sizes > 0, len(heads))
        per = np.maximum(sizes, 1) * len(heads)
        col = lambda v: np.tile(v, len(heads))[keep]
        return pa.table({"doc_id": col(ids), "pairs": col(sizes), "mean_pmi": col(gain / per), "repeated": col(over / per)})

    packed = "part int, batch bigint, ids binary, sizes binary, x binary, y binary, z binary, most binary"
    scores = (
        rows.mapInArrow(local, packed)
        .groupBy("part")
        .applyInArrow(meet, "batch bigint, ids binary, sizes binary, gain binary, over binary")
        .groupBy("batch")
        .applyInArrow(finish, "doc_id bigint, pairs bigint, mean_pmi double, repeated double")
    )
    with wide(spark, chars, 20_000_000):
        return staged(scores, "scores")


def spam_pages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    spread: float = 7.0,
    floor: float = 0.25,
    ceiling: float = 0.65,
    repeats: float = 0.3,
    weight: float = 4.0,
) -> DataFrame:
    """The scores of ``collocation_scores`` with ``salad``, ``stuffed`` and ``spam``.

    ``salad`` marks incoherent texts: their mean mutual information lies ``spread`` times the distance from the
    corpus' lower quartile to its median below that median; the bound is held within ``floor`` and ``ceiling`` of the median, so
    neither a corpus with much spam nor one of great uniformity moves it away.  The median counts as ``weight`` more pairs of every text, so the few
    pairs of a short one decide nothing alone.  ``stuffed`` marks texts of which more than ``repeats`` are excessively repeated
    collocations, which finds spam that stands in the corpus several times.
    """
    scores = collocation_scores(docs, id_col, text_col)
    half, low = scores.agg(F.percentile_approx("mean_pmi", F.array(F.lit(0.5), F.lit(0.25)), 10_000)).first()[0] or (0.0, 0.0)
    bound = min(max(half - spread * (half - low), floor * half), ceiling * half)
    steadied = (F.col("mean_pmi") * F.col("pairs") + weight * half) / (F.col("pairs") + weight)
    return (
        scores.withColumn("salad", steadied < bound)
        .withColumn("stuffed", F.col("repeated") > repeats)
        .withColumn("spam", F.col("salad") | F.col("stuffed"))
    )
