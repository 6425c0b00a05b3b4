"""Near-duplicate documents: minima of many universal hashes, bands, verified signatures, components (problem 1)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.graphs import components
from corvella.session import staged, wide

_WORDS = re.compile(r"[^\W_]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_set(text: str | None, width: int, seen: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; empty below ``width`` words."""
    words = _WORDS.findall(text.lower()) if text else ()
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    ids = []
    for w in words:
        h = seen.get(w)
        if h is None:
            if len(seen) > 500_000:
                seen.clear()
            h = seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids.append(h)
    h = np.array(ids, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = (acc ^ h[k : k + n]) * np.uint64(_MIX[k % 3])
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def hash_family(size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of ``size`` multiply-shift hashes."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, size, np.uint64)


def minima(prints: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least 32-bit value of each hash over the fingerprints, taken in blocks of bounded size."""
    a, b = family
    x = prints.astype(np.uint64)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    step = max(1, 262_144 // len(a))
    for i in range(0, len(x), step):
        v = (x[i : i + step, None] * a + b) >> np.uint64(32)
        np.minimum(low, v.min(axis=0).astype(np.uint32), out=low)
    return low


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(doc_id, node, prints)``: node names the set of shingles, prints are its 32-bit fingerprints."""

    def run(batches):
        seen: dict = {}
        for b in batches:
            ids, nodes, prints = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingle_set(text, width, seen)
                if len(s) and key is not None:
                    ids.append(key)
                    nodes.append(xxhash.xxh64_intdigest(s.tobytes()) >> 1)
                    prints.append(np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "node", "prints"])

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, "doc_id bigint, node bigint, prints binary")


def _salted(node: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order of the nodes that differs from bucket to bucket."""
    v = (node.astype(np.uint64) ^ key) * np.uint64(_MIX[1])
    return v ^ (v >> np.uint64(31))


def _star(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each bucket its first node by the bucket's own order, and ``(bucket, first, other)`` of all others."""
    order = np.lexsort((_salted(node, key), key))
    k, v = key[order], node[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    centre = v[first][np.cumsum(first) - 1]
    rest = v != centre
    return k[first], v[first], np.stack([k.astype(np.int64)[rest], centre[rest], v[rest]], axis=1)


def candidate_links(prints: DataFrame, bands: int, rows: int, parts: int) -> DataFrame:
    """``(key, a, b)`` of nodes that share the bucket ``key`` of a band of ``rows`` minima, as stars.

    Every bucket links its nodes to one of them, picked by an order of its own: first in each batch, which
    passes on one node a bucket, then over all batches.  So a bucket of any size is linear, no task holds
    more than an entry a batch of it, and equal sets of shingles count once.
    """
    family = hash_family(bands * rows)

    def local(batches):
        for b in batches:
            node, at = np.unique(np.asarray(b.column(0)), return_index=True)
            if not len(node):
                continue
            packed = b.column(1)
            sig = np.stack([minima(np.frombuffer(packed[int(i)].as_py(), np.uint32), family) for i in at])
            key = np.zeros((len(node), bands), np.uint64)
            for r in range(rows):
                key = (key ^ sig[:, r::rows].astype(np.uint64)) * np.uint64(_MIX[r % 3])
                key ^= key >> np.uint64(31)
            key += np.arange(bands, dtype=np.uint64) * np.uint64(_MIX[2])
            k, v, links = _star(key.ravel(), np.repeat(node, bands))
            both = np.stack([k, v.astype(np.uint64)], axis=1)
            p, q = (k % np.uint64(parts)).astype(np.int64), links[:, 2] % parts
            by, lby = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
            both, links = both[by], links[lby]
            cut, lcut = np.searchsorted(p[by], np.arange(parts + 1)), np.searchsorted(q[lby], np.arange(parts + 1))
            full = [i for i in range(parts) if cut[i] < cut[i + 1] or lcut[i] < lcut[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([both[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
                    pa.array([links[lcut[i] : lcut[i + 1]].tobytes() for i in full], pa.binary()),
                ],
                names=["part", "entries", "links"],
            )

    def whole(group):
        both = np.frombuffer(b"".join(group.column("entries").to_pylist()), np.uint64).reshape(-1, 2)
        known = np.frombuffer(b"".join(group.column("links").to_pylist()), np.int64).reshape(-1, 3)
        links = np.concatenate([known, _star(both[:, 0], both[:, 1].astype(np.int64))[2]])
        return pa.table({n: pa.array(links[:, i], pa.int64()) for i, n in enumerate(("key", "a", "b"))})

    rows_of = prints.select("node", "prints").mapInArrow(local, "part int, entries binary, links binary")
    return rows_of.groupBy("part").applyInArrow(whole, "key bigint, a bigint, b bigint")


def verified(pairs: DataFrame, prints: DataFrame, threshold: float, checks: int = 128) -> DataFrame:
    """The pairs whose Jaccard similarity is at least ``threshold``.

    ``checks`` further minima estimate it first: pairs four standard errors below the threshold go, the others
    are compared by their fingerprints.
    """
    family = hash_family(checks, seed=2)
    least = threshold - 4 * (threshold * (1 - threshold) / checks) ** 0.5

    def run(batches):
        for b in batches:
            keep, sigs = [], {}
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                small, large = sorted((len(x), len(y)))
                if small < threshold * large:
                    continue
                sig = []
                for key, v in ((b.column(0)[i].as_py(), x), (b.column(1)[i].as_py(), y)):
                    if key not in sigs:
                        sigs[key] = minima(v, family)
                    sig.append(sigs[key])
                if (sig[0] == sig[1]).mean() < least:
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same >= threshold * (len(x) + len(y) - same):
                    keep.append(i)
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))

    sets = prints.groupBy("node").agg(F.first("prints").alias("prints"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("prints").alias("pa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("prints").alias("pb")), "b")
        .select("a", "b", "pa", "pb")
        .mapInArrow(run, "a bigint, b bigint")
    )


def _shared(x: list[np.ndarray], y: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many fingerprints each of ``x`` has in common with each of ``y``, by products of blocks of ``width`` fingerprints."""
    flat = [np.concatenate(v) for v in (x, y)]
    doc = [np.repeat(np.arange(len(v)), [len(p) for p in v]) for v in (x, y)]
    both = np.intersect1d(*flat)
    at = [np.searchsorted(both, f) for f in flat]
    real = [np.append(both, 0)[k] == f if len(both) else np.zeros(len(f), bool) for k, f in zip(at, flat)]
    at, doc = [k[r] for k, r in zip(at, real)], [d[r] for d, r in zip(doc, real)]
    out = np.zeros((len(x), len(y)), np.float64)
    for low in range(0, len(both), width):
        m = [np.zeros((len(v), min(width, len(both) - low)), np.float32) for v in (x, y)]
        for a, k, d in zip(m, at, doc):
            here = (k >= low) & (k < low + width)
            a[d[here], k[here] - low] = 1
        out += m[0] @ m[1].T
    return out


def blocked_links(members: DataFrame, prints: DataFrame, threshold: float, block: int = 512, counts: bool = False) -> DataFrame:
    """Every pair within a bucket of ``(key, node, comp, main)`` compared by fingerprints, in blocks of ``block`` nodes a side.

    Gives the links ``(a, b)`` between different ``comp``; nodes with ``main`` are known to be of one and are not compared with each other.
    With ``counts`` it gives ``(a, b)`` of each node ``a`` and how many others of its bucket are at the threshold, in parts to be added.
    """

    def run(group):
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        own, node, comp = (np.asarray(group.column(c)) for c in ("own", "node", "comp"))
        sets = [np.frombuffer(p, np.uint32) for p in group.column("prints").to_pylist()]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y = [sets[k] for k in left], [sets[k] for k in right]
        same = _shared(x, y)
        size = [np.array([len(p) for p in v], np.float64) for v in (x, y)]
        hit = same >= threshold * (size[0][:, None] + size[1][None, :] - same)
        if counts:
            hit &= node[left][:, None] != node[right][None, :]
            a, b = node[left], hit.sum(axis=1)
            if i != j:
                a, b = np.append(a, node[right]), np.append(b, hit.sum(axis=0))
        else:
            p, q = np.nonzero(hit & (comp[left][:, None] != comp[right][None, :]))
            a, b = node[left][p], node[right][q]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sizes = members.groupBy("key").agg(*(F.ceil(F.count_if(c) / block).cast("int").alias(n) for n, c in (("rest", ~F.col("main")), ("mains", F.col("main")))))
    own = F.when(F.col("main"), F.col("rest") + F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1))).cast("int")).otherwise(F.pmod(F.xxhash64("node"), F.greatest("rest", F.lit(1))).cast("int"))
    m = members.join(sizes, "key").where("rest > 0").withColumn("own", own)
    first = F.when(F.col("main"), F.array().cast("array<int>")).otherwise(F.sequence("own", F.col("rest") + F.col("mains") - 1))
    second = F.when(F.col("main"), F.sequence(F.lit(0), F.col("rest") - 1)).when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    spots = F.concat(F.transform(first, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))), F.transform(second, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    sets = prints.groupBy("node").agg(F.first("prints").alias("prints"))
    placed = m.select("key", "node", "comp", "own", F.explode(spots).alias("at")).join(sets, "node")
    return placed.select("key", "at.i", "at.j", "own", "node", "comp", "prints").groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def classes(prints: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """``(node, component)`` of the nodes of ``(node, prints)`` that are linked, directly or through others.

    The stars of the buckets link most; of each bucket whose nodes are not one component then, all pairs
    of different components are compared, so each two nodes of a bucket are linked or compared.
    """
    n = prints.count()
    with wide(prints.sparkSession, n):
        return _classes(prints, n, threshold, bands, rows)


def _classes(prints: DataFrame, n: int, threshold: float, bands: int, rows: int) -> DataFrame:
    parts = max(4 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * bands // 2_000_000))
    stars = staged(candidate_links(prints, bands, rows, parts), "stars")
    pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    parents = components(staged(verified(pairs, prints, threshold), "links"))
    ends = stars.select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    held = ends.join(parents, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    per = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    # two nodes were the star; a third may be linked to one of them unseen
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("n > 2 and comps > 1")
    open_ = staged(held.join(mixed.select("key", "most"), "key").select("key", "node", "comp", (F.col("comp") == F.col("most")).alias("main")), "open")
    more = staged(blocked_links(open_, prints, threshold).distinct(), "more")
    if more.isEmpty():
        return parents
    return components(parents.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """``(doc_id, group_id)`` of ``near_duplicates``, without counting links."""
    return _grouped(docs, id_col, text_col, width, threshold, bands, rows)[0].select("doc_id", "group_id")


def _grouped(docs, id_col, text_col, width, threshold, bands, rows):
    prints = staged(_fingerprints(docs, id_col, text_col, width), "prints")
    parents = classes(prints, threshold, bands, rows)
    with wide(docs.sparkSession, prints.count()):
        rooted = staged(
            prints.select("doc_id", "node").distinct().join(parents, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("root")),
            "rooted",
        )
    groups = rooted.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rooted.join(groups, "root").select("doc_id", "group_id", "node"), prints, parents


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 5,
) -> DataFrame:
    """One row a document that has near-duplicates: ``(doc_id, group_id, links)``.

    Words are runs of letters and digits of the lower-cased text.  Documents are linked when the Jaccard similarity
    of their sets of ``width``-word shingles is at least ``threshold``; a group joins all that are linked directly or
    through others and is named by its least document.  ``links`` counts the different texts of the group to which the
    document's text is linked, all pairs of the group compared (0 if only copies of the same shingles join it).  ``bands * rows`` universal hash minima fall
    into ``bands`` bands.  Null and empty texts, those of fewer than ``width`` words and null ids have no row;
    rows with the same id and text count once; an empty table gives no rows; other columns are ignored.
    """
    found, prints, parents = _grouped(docs, id_col, text_col, width, threshold, bands, rows)
    members = parents.select(F.col("component").alias("key"), "node", F.col("component").alias("comp"), F.lit(False).alias("main")).distinct()
    degree = blocked_links(members, prints, threshold, counts=True).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    return found.join(degree, "node", "left").select("doc_id", "group_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def group_pairs(groups: DataFrame, block: int = 512) -> DataFrame:
    """All pairs ``(doc_a, doc_b)`` within a group, ``doc_a < doc_b``, in blocks of about ``block`` documents a side."""
    sizes = groups.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    g = groups.join(sizes, "group_id").select("group_id", "doc_id", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("own"))
    left = g.select("group_id", F.col("doc_id").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = g.select("group_id", F.col("doc_id").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    return left.join(right, ["group_id", "i", "j"]).where("i < j or x < y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
