"""Most similar vectors by robust-pruned directed graphs, one a shard (problem 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.session import staged


def _largest(s: np.ndarray, m: int, width: int = 32) -> np.ndarray:
    """Columns of the ``m`` largest of each row, largest first; they lie in the ``m`` groups of columns with the largest maxima."""
    n, cols = s.shape
    groups = cols // width
    if groups > 2 * m:
        most = s[:, : groups * width].reshape(n, groups, width).max(axis=2)
        best = np.argpartition(-most, m - 1, axis=1)[:, :m]
        at = (best[:, :, None] * width + np.arange(width)).reshape(n, -1)
        if cols > groups * width:
            at = np.concatenate([at, np.broadcast_to(np.arange(groups * width, cols), (n, cols - groups * width))], axis=1)
        s = np.take_along_axis(s, at, axis=1)
    else:
        at = np.broadcast_to(np.arange(cols), s.shape)
    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
    return np.take_along_axis(at, top, axis=1)


class PrunedGraph:
    """A directed graph over unit vectors, built and searched in batches with NumPy.

    Vectors are inserted in random order.  A beam search on the graph so far, and the other vectors of the batch,
    propose neighbours; of these a vector keeps one if no kept one is ``alpha`` times nearer to it than the vector itself.
    Reverse edges are added and pruned alike.  A search starts at the nearest of a fixed set of entry nodes, by default half of
    the nodes (a product with a block of them costs a twentieth of a hop to as many), or at the node that is asked about, if it is one.
    """

    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 16, alpha: float = 1.2, entries: int | None = None, seed: int = 1):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.degree, self.beam, self.alpha2 = degree, beam, alpha * alpha
        self.wide = degree + degree // 2
        self.adj = np.full((n, self.wide), -1, np.int32)
        self.size = np.zeros(n, np.int32)
        self.rows = 256
        self.mark = np.zeros(self.rows * n, np.int16)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.entries = order[: entries or max(256, n // 2)]
        self._entry_x = self.x[self.entries]
        done = 0
        while done < n:
            batch = order[done : done + min(1024, max(64, done // 8))]
            self._insert(batch, done)
            done += len(batch)

    def _insert(self, batch: np.ndarray, done: int) -> None:
        x = self.x[batch]
        own = x @ x.T
        np.fill_diagonal(own, -2)
        m = min(12, len(batch) - 1)
        mates = np.argpartition(-own, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(batch), 0), int)
        ids, sims = batch[mates], np.take_along_axis(own, mates, axis=1)
        if done:
            found, near = self.search(x, self.beam, self.entries[:done])
            ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([near, sims], axis=1)
        if not ids.shape[1]:
            return
        kept = self._prune(ids, sims)
        self._store(batch, kept)
        src, col = np.nonzero(kept >= 0)
        self._reverse(kept[src, col], batch[src])

    def _store(self, nodes: np.ndarray, kept: np.ndarray) -> None:
        self.adj[nodes] = -1
        self.adj[nodes, : kept.shape[1]] = kept
        self.size[nodes] = (kept >= 0).sum(axis=1)

    def _prune(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Of each row's candidates at most ``degree``, nearest first; -1 fills the rest."""
        sims = np.where(ids >= 0, sims, -3)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        v = self.x[np.maximum(ids, 0)]
        between = self.alpha2 * (1 - np.matmul(v, v.transpose(0, 2, 1)))
        far = 1 - sims
        alive = ids >= 0
        kept = np.full((len(ids), self.degree), -1, np.int32)
        count = np.zeros(len(ids), np.int32)
        for j in range(ids.shape[1]):
            rows = np.flatnonzero(alive[:, j] & (count < self.degree))
            if not len(rows):
                continue
            kept[rows, count[rows]] = ids[rows, j]
            count[rows] += 1
            alive[rows] &= between[rows, j] > far[rows]
        return kept

    def _reverse(self, to: np.ndarray, node: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        to, node = to[order], node[order]
        hubs, first, more = np.unique(to, return_index=True, return_counts=True)
        nth = np.arange(len(to)) - np.repeat(first, more)
        slot = self.size[to] + nth
        fits = np.repeat(self.size[hubs] + more <= self.wide, more)
        self.adj[to[fits], slot[fits]] = node[fits]
        room = self.size[hubs] + more <= self.wide
        self.size[hubs[room]] += more[room]
        full = hubs[~room]
        if not len(full):
            return
        width = int(more[~room].max())
        at = np.full(len(self.size), -1, np.int32)
        at[full] = np.arange(len(full))
        extra = np.full((len(full), width), -1, np.int32)
        extra[at[to[~fits]], nth[~fits]] = node[~fits]
        for a in range(0, len(full), 256):
            f = full[a : a + 256]
            ids = np.concatenate([self.adj[f], extra[a : a + 256]], axis=1)
            sims = np.matmul(self.x[np.maximum(ids, 0)], self.x[f][:, :, None])[:, :, 0]
            if ids.shape[1] > 3 * self.degree:
                sims = np.where(ids >= 0, sims, -3)
                top = np.argpartition(-sims, 3 * self.degree, axis=1)[:, : 3 * self.degree]
                ids, sims = np.take_along_axis(ids, top, axis=1), np.take_along_axis(sims, top, axis=1)
            self._store(f, self._prune(ids, sims))

    def search(self, q: np.ndarray, beam: int, entries: np.ndarray | None = None, own: np.ndarray | None = None, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nodes found nearest to each query, and their similarities; -1 where fewer were found.

        ``own`` are the nodes that the queries are themselves, where their searches start.
        """
        entries = self.entries if entries is None else entries
        out_i, out_s = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -3, np.float32)
        for a in range(0, len(q), self.rows):
            z = a + self.rows
            out_i[a:z], out_s[a:z] = self._beam(q[a:z], beam, entries, None if own is None else own[a:z], expand)
        return out_i, out_s

    def _start(self, q, beam, entries, own):
        """Nodes and similarities at which the searches begin, best first."""
        if own is not None:
            return own[:, None], np.einsum("nd,nd->n", self.x[own], q)[:, None]
        s = q @ self._entry_x[: len(entries)].T
        top = _largest(s, min(beam, s.shape[1]))
        return entries[top], np.take_along_axis(s, top, axis=1)

    def _beam(self, q, beam, entries, own, expand):
        n, total = len(q), len(self.x)
        ids, sims, open_ = np.full((n, beam), -1, np.int32), np.full((n, beam), -3, np.float32), np.zeros((n, beam), bool)
        first, near = self._start(q, beam, entries, own)
        m = first.shape[1]
        ids[:, :m], sims[:, :m], open_[:, :m] = first, near, True
        mark, seen = self.mark, [(np.arange(n)[:, None] * total + first).ravel()]
        mark[seen[0]] = -1
        live = np.arange(n)
        while len(live):
            o = open_[live]
            row, col = np.nonzero(o & (np.cumsum(o, axis=1) <= expand))
            open_[live[row], col] = False
            adj = self.adj[ids[live[row], col]]
            who, node = np.repeat(live[row], adj.shape[1]), adj.ravel()
            ok = node >= 0
            who, node = who[ok], node[ok]
            at = who * total + node
            new = mark[at] == 0
            who, node, at = who[new], node[new], at[new]
            # of the same node met twice in this step, the last mark stays
            place = (np.arange(len(node)) - np.searchsorted(who, who) + 1).astype(np.int16)
            mark[at] = place
            new = mark[at] == place
            who, node, at = who[new], node[new], at[new]
            seen.append(at)
            sim = np.einsum("nd,nd->n", self.x[node], q[who])
            better = sim > sims[who, -1]
            who, node, sim = who[better], node[better], sim[better]
            rows, begin, more = np.unique(who, return_index=True, return_counts=True)
            if len(rows):
                width = int(more.max())
                slot = np.arange(len(who)) - np.repeat(begin, more)
                line = np.repeat(np.arange(len(rows)), more)
                fresh_i, fresh_s = np.full((len(rows), width), -1, np.int32), np.full((len(rows), width), -3, np.float32)
                fresh_i[line, slot], fresh_s[line, slot] = node, sim
                all_i, all_s = np.concatenate([ids[rows], fresh_i], axis=1), np.concatenate([sims[rows], fresh_s], axis=1)
                all_o = np.concatenate([open_[rows], fresh_i >= 0], axis=1)
                best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_s, best, axis=1), axis=1), axis=1)
                ids[rows], sims[rows], open_[rows] = (np.take_along_axis(v, best, axis=1) for v in (all_i, all_s, all_o))
            live = live[open_[live].any(axis=1)]
        mark[np.concatenate(seen)] = 0
        return ids, sims


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, vec, key)``: finite, non-zero vectors of length ``dim`` at norm 1 as bytes, and a hash of those."""

    def run(batches):
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            size = np.asarray(vectors.value_lengths().fill_null(-1))
            ok = (size == dim) & ~np.asarray(ids.is_null())
            at = pa.array(np.flatnonzero(ok))
            flat = vectors.take(at).flatten()
            x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
            big = np.abs(x).max(axis=1, initial=0)
            good = np.isfinite(x).all(axis=1) & (big > 0)
            x, big = x[good], big[good]
            x = x / big[:, None]
            x = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32) + np.float32(0)
            keys = [xxhash.xxh64_intdigest(v.tobytes()) - 2**63 for v in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(ids.take(at))[good], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(keys, pa.int64())],
                names=["id", "vec", "key"],
            )

    return df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v")).mapInArrow(run, "id bigint, vec binary, key bigint")


def _centres(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centres of at most ``cells`` cells by rounds of spherical k-means."""
    c = sample[np.random.default_rng(3).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c


def nearest_cells(x: np.ndarray, m: int, parents: np.ndarray, child: np.ndarray, begin: np.ndarray, flat: int = 4096) -> np.ndarray:
    """The ``m`` nearest cells of each row, nearest first.

    Of more than ``flat`` cells it looks only at the children (``begin`` is where each parent's begin) of the ``2 * m`` nearest parents, 8 at the least.
    """
    m = min(m, len(child))
    if len(child) <= flat:
        return _largest(x @ child.T, m)
    size = np.diff(begin)
    most = int(size.max())
    near = _largest(x @ parents.T, min(max(2 * m, 8), len(parents)))
    wide = near.shape[1] * most
    ids, sims = np.full((len(x), wide), -1, np.int64), np.full((len(x), wide), -3, np.float32)
    for p in np.unique(near):
        row, slot = np.nonzero(near == p)
        at = slot[:, None] * most + np.arange(size[p])
        ids[row[:, None], at] = np.arange(begin[p], begin[p + 1])
        sims[row[:, None], at] = x[row] @ child[begin[p] : begin[p + 1]].T
    return np.take_along_axis(ids, _largest(sims, m), axis=1)


def _tree(parents: np.ndarray, child: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(of, kind="stable")
    return parents, child[order], np.searchsorted(of[order], np.arange(len(parents) + 1))


def _stacked(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def cell_tree(reps: DataFrame, n: int, cells: int, dim: int, per_cell: int = 64, most_parents: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of ``nearest_cells``, of about ``cells`` cells over ``n`` rows ``(id, vec)``.

    At most ``most_parents`` centres are fitted on the driver, on a sample by a hash of the ids of ``per_cell`` rows for each (17 MB at the most for 64
    dimensions).  Cells of more than twice ``n / cells`` rows, be it that more are wanted or that vectors lie dense there, are split: their own sample, as many rows for each new
    centre, is fitted by one task a cell.  All centres come to the driver and are broadcast, one for each ``n / cells`` rows.
    """
    spark = reps.sparkSession
    if cells < 2:
        one = np.zeros((1, dim), np.float32)
        return _tree(one, one, np.zeros(1, np.int64))
    luck = F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 11) / F.lit(float(2**53))
    parents = min(cells, most_parents)
    some = reps.where(luck < parents * per_cell / n).select("vec").limit(2 * parents * per_cell).toArrow()
    fitted = _centres(_stacked(some.column("vec"), dim), parents) if some.num_rows else np.zeros((1, dim), np.float32)
    top = spark.sparkContext.broadcast(fitted)

    def homes(batches):
        for b in batches:
            home = (_stacked(b.column(0), dim) @ top.value.T).argmax(axis=1)
            cell, count = np.unique(home, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(count, pa.int64())], names=["cell", "n"])

    held = {r.cell: r.n for r in reps.select("vec").mapInArrow(homes, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    target = -(-n // cells)
    parts = {c: -(-v // target) for c, v in held.items() if v > 2 * target}
    keep = np.array([c for c in range(len(fitted)) if c not in parts], np.int64)
    if not parts:
        return _tree(fitted, fitted, np.arange(len(fitted)))

    def placed(batches):
        for b in batches:
            home = (_stacked(b.column(0), dim) @ top.value.T).argmax(axis=1)
            full = np.flatnonzero(np.isin(home, list(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(home[full], pa.int32()), b.column(0).take(pa.array(full))], names=["cell", "vec"])

    def split(group):
        cell = group.column("cell")[0].as_py()
        c = _centres(_stacked(group.column("vec"), dim), parts[cell])
        return pa.table({"cell": pa.array([cell] * len(c), pa.int32()), "centre": pa.array([v.tobytes() for v in c], pa.binary())})

    rows = reps.where(luck < per_cell / target).select("vec").mapInArrow(placed, "cell int, vec binary")
    more = rows.groupBy("cell").applyInArrow(split, "cell int, centre binary").toArrow()
    found = np.asarray(more.column("cell").combine_chunks()).astype(np.int64) if more.num_rows else np.empty(0, np.int64)
    # a full cell without a row in its sample stays whole
    lost = np.array(sorted(set(parts) - set(found.tolist())), np.int64)
    child = np.concatenate([fitted[keep], fitted[lost], _stacked(more.column("centre"), dim)])
    return _tree(fitted, child, np.concatenate([keep, lost, found]))


def similar_vectors(
    df: DataFrame,
    id_col: str = "doc_id",
    vector_col: str = "embedding",
    dim: int = 64,
    k: int = 5,
    query_every: int = 1,
    copies: int | None = None,
    shard_size: int = 32_768,
    degree: int = 16,
    beam: int = 16,
    each_shard: bool = False,
) -> DataFrame:
    """``(id, neighbour, similarity)``: the ``k`` other rows of highest cosine found for each query.

    Queries are the rows whose id is divisible by ``query_every``; all rows are indexed.  Null vectors and those of another
    length, all zero or not finite take no part, nor do null ids; an id must be unique.  Rows with the same vector form one class
    that enters the index once; a row's neighbours come from its own class first and of each class in the order of ids.

    A shard holds about ``shard_size`` vectors and one graph.  Up to that many rows there is one shard.  Beyond it every vector is indexed in the
    ``copies`` shards of its nearest centres, and asks there, starting from itself: two vectors meet if they share a shard.  None takes the root of the number of cells,
    6 at the most, which finds neighbours without any cluster structure too; near-copies meet with 2.
    With ``each_shard`` a vector is indexed once and every query asks each shard, which is exact but for the beam and meant for few queries.
    """
    spark = df.sparkSession
    vectors = staged(usable_vectors(df, id_col, vector_col, dim), "vectors")
    schema = "id bigint, neighbour bigint, similarity double"
    classes = staged(vectors.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    n, most = classes.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n:
        return spark.createDataFrame([], schema)
    twins = most > 1
    reps = vectors.select("id", "vec") if not twins else vectors.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "vec")
    asks = F.col("id") % query_every == 0
    if twins and query_every > 1:
        asked = vectors.where(asks).select("key").distinct().join(classes, "key").select(F.col("rep").alias("id"), F.lit(True).alias("asks"))
        reps = reps.join(asked, "id", "left").select("id", "vec", F.coalesce("asks", F.lit(False)).alias("asks"))
    else:
        reps = reps.select("id", "vec", asks.alias("asks"))
    if each_shard or n <= shard_size:
        copies = 1
        cells = -(-n // shard_size)
    elif copies:
        cells = -(-n * copies // shard_size)
    else:
        copies = next((m for m in range(2, 6) if m * m >= -(-n * m // shard_size)), 6)
        cells = -(-n * copies // shard_size)
    cells = max(cells, copies)
    tree = cell_tree(reps, n, cells, dim)
    cells = len(tree[1])
    known = spark.sparkContext.broadcast(tree)

    def route(batches):
        for b in batches:
            x = _stacked(b.column(1), dim)
            best = nearest_cells(x, copies, *known.value)
            asks = np.asarray(b.column(2).to_numpy(zero_copy_only=False)).astype(bool)
            for j in range(best.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(best[:, j], pa.int32()), pa.array(np.ones(len(x), bool)), b.column(2), b.column(0), b.column(1)], names=["shard", "held", "asks", "id", "vec"])
            if each_shard and cells > 1:
                at = np.flatnonzero(asks)
                for c in range(cells):
                    away = pa.array(at[best[at, 0] != c])
                    if len(away):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(away), c), pa.int32()), pa.array(np.zeros(len(away), bool)), b.column(2).take(away), b.column(0).take(away), b.column(1).take(away)], names=["shard", "held", "asks", "id", "vec"])

    def shard(group):
        x, ids = _stacked(group.column("vec"), dim), np.asarray(group.column("id"))
        held, asks = (np.asarray(group.column(c)).astype(bool) for c in ("held", "asks"))
        rows = np.flatnonzero(held)
        rows = rows[np.argsort(ids[rows])]
        out_i, out_n, out_s = [], [], []
        if len(rows) and asks.any():
            base, own = ids[rows], x[rows]
            graph = PrunedGraph(own, degree, beam)
            inside = np.flatnonzero(asks[rows])
            away = np.flatnonzero(asks & ~held)
            for at, q, node in ((rows[inside], own[inside], inside.astype(np.int32)), (away, x[away], None)):
                for a in range(0, len(at), 4096):
                    part = slice(a, a + 4096)
                    found, _ = graph.search(q[part], beam, own=None if node is None else node[part])
                    other = (found >= 0) & (base[np.maximum(found, 0)] != ids[at[part]][:, None])
                    exact = np.einsum("qkd,qd->qk", own[np.maximum(found, 0)].astype(np.float64), q[part].astype(np.float64))
                    exact = np.where(other, exact, -3)
                    best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                    hit = np.take_along_axis(other, best, axis=1)
                    r, _ = np.nonzero(hit)
                    out_i.append(ids[at[part]][r])
                    out_n.append(base[np.take_along_axis(found, best, axis=1)[hit]])
                    out_s.append(np.take_along_axis(exact, best, axis=1)[hit])
        cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        return pa.table({"id": cat(out_i, pa.int64()), "neighbour": cat(out_n, pa.int64()), "similarity": cat(out_s, pa.float64())})

    kept = reps.mapInArrow(route, "shard int, held boolean, asks boolean, id bigint, vec binary").repartition(3 * cells, "shard").groupBy("shard").applyInArrow(shard, schema)
    ranked = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    top = lambda d: d.withColumn("place", F.row_number().over(ranked)).where(f"place <= {k}").drop("place")
    if copies > 1:
        # the same neighbour from two shards; one exchange by id serves this and the ranks
        kept = kept.repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    kept = top(kept)
    if not twins:
        return kept
    # classes back to rows: of each class only the first k + 1 rows can be anyone's neighbours
    first = Window.partitionBy("key").orderBy("id")
    seats = staged(vectors.select("key", "id").withColumn("seat", F.row_number().over(first)).where(f"seat <= {k + 1}").select("key", F.col("id").alias("neighbour")), "seats")
    across = (
        kept.join(classes.select(F.col("rep").alias("id"), "key"), "id")
        .join(classes.select(F.col("rep").alias("neighbour"), F.col("key").alias("other")), "neighbour")
        .select("key", "other", "similarity")
        .unionByName(classes.where("n > 1").select("key", F.col("key").alias("other"), F.lit(1.0).alias("similarity")))
        .join(seats.select(F.col("key").alias("other"), "neighbour"), "other")
    )
    # and of what a class is near to, only the first k + 1 (one may be the row itself)
    by_class = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    across = across.withColumn("place", F.row_number().over(by_class)).where(f"place <= {k + 1}").select("key", "neighbour", "similarity")
    return top(vectors.where(asks).select("key", "id").join(across, "key").where("id != neighbour").select("id", "neighbour", "similarity"))


def similar_pairs(neighbours: DataFrame, least: float = 0.8) -> DataFrame:
    """Distinct ``(doc_a, doc_b)``, ``doc_a < doc_b``, of neighbours at least so similar."""
    return neighbours.where(F.col("similarity") >= least).select(F.least("id", "neighbour").alias("doc_a"), F.greatest("id", "neighbour").alias("doc_b")).distinct()
