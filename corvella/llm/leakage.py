"""Evaluation passages inside a corpus, by greedy string tiling over Karp-Rabin seeds (problem 6)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.session import staged

_WORDS = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15
#: Characters that are ignored wherever they stand.
_IGNORED = dict.fromkeys(map(ord, "\u00ad\u200b"))


def plain_words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, accents, soft hyphens and zero-width spaces; ß equals ss."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_IGNORED)) if not unicodedata.combining(c)).casefold()
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORDS.findall(text.lower())


def word_ids(words: list[str], seen: dict) -> np.ndarray:
    ids = []
    for w in words:
        h = seen.get(w)
        if h is None:
            if len(seen) > 500_000:
                seen.clear()
            h = seen[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    return np.array(ids, np.uint64)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of all runs of ``width`` words."""
    n = len(ids) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + ids[k : k + n]
    return out


class _Runs:
    """Karp-Rabin hashes of the runs of a text, of any length, and which of its words are still free."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.used = ids, np.zeros(len(ids), bool)
        step = np.full(len(ids), _BASE, np.uint64)
        step[:1] = 1
        self.sums = np.append(np.uint64(0), np.cumsum(ids * np.multiply.accumulate(step)))
        step[1:] = pow(_BASE, -1, 2**64)
        self.shift = np.multiply.accumulate(step)
        self.marked()

    def marked(self) -> None:
        self.taken = np.append(0, np.cumsum(self.used))

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the free runs of ``length`` words, the same for equal runs wherever they stand."""
        n = len(self.ids) - length + 1
        at = np.flatnonzero(self.taken[length:] == self.taken[:n])
        return at, (self.sums[at + length] - self.sums[at]) * self.shift[at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(doc start, item start, length)`` of non-overlapping matches of ``least`` words or more.

    Each round takes the longest match of unmarked words, ties by the item's and then the document's first word, and marks it.
    The greatest length of which a free run of both has the same Karp-Rabin hash is found by halving; its matches are compared
    word by word and marked in one pass, in which a document's run that is taken is never looked at again.  So a round is linear in both texts, however often
    they repeat a word, and there are no more rounds than different lengths, about the root of twice the item's words.
    """
    x, y = _Runs(doc), _Runs(item)
    found: list[tuple[int, int, int]] = []
    high = min(len(doc), len(item))
    low = max(1, least)

    def common(length: int) -> bool:
        a, b = x.of(length)[1], y.of(length)[1]
        return bool(len(a) and len(b) and np.isin(b, a).any())

    while high >= low and common(low):
        good, bad = low, high + 1
        # most longest matches are short or the whole item
        if common(high):
            good = high
        while good + 1 < bad and good != high:
            middle = min((good + bad) // 2, 2 * good)
            good, bad = (middle, bad) if common(middle) else (good, middle)
        (at, a), (to, b) = x.of(good), y.of(good)
        hits = np.isin(a, b)
        places: dict[int, list[int]] = {}
        for i, h in zip(at[hits].tolist()[::-1], a[hits].tolist()[::-1]):
            places.setdefault(h, []).append(i)
        for j, h in zip(to.tolist(), b.tolist()):
            if h not in places or y.used[j : j + good].any():
                continue
            free = places[h]
            while free and (x.used[free[-1]] or x.used[free[-1] + good - 1]):
                free.pop()
            if free and np.array_equal(doc[free[-1] : free[-1] + good], item[j : j + good]):
                i = free.pop()
                x.used[i : i + good] = y.used[j : j + good] = True
                found.append((i, j, good))
        x.marked()
        y.marked()
        high = good - 1
    return found


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    seed_words: int = 13,
    tile_words: int = 5,
    broadcast_bytes: int = 64_000_000,
) -> DataFrame:
    """``(doc_id, item_id, longest, item_words, tiles, coverage)`` of each document that shares a run of words with an item.

    Candidates share a run of ``seed_words`` words, or the whole item if that is shorter.  Their tiles of at least
    ``tile_words`` words (or the whole item) follow by greedy string tiling; ``longest`` is the longest, ``coverage`` the share
    of the item's words under tiles, in whatever order the document has them.

    The items go to every task while their texts are below ``broadcast_bytes``.  Beyond that only a bit map of their seeds goes there, at most as
    large; the seeds of the corpus that it lets through meet those of the items by their hashes, and the pairs meet their texts again.  The corpus is
    read twice then, whatever the size of the items.
    Null ids and texts without words have no row; repeated items give a row for each id; repeated documents give their
    rows again; other columns are ignored.
    """
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[doc_text].alias("text")).where("doc_id is not null and text is not null")
    e = items.select(items[item_id].cast("long").alias("item_id"), items[item_text].alias("text")).where("item_id is not null and text is not null").distinct()
    size = e.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(d, e, seed_words, tile_words, broadcast_bytes)
    return _against(d, [(r["item_id"], r["text"]) for r in e.toArrow().to_pylist()], seed_words, tile_words)


FOUND = "doc_id bigint, item_id bigint, longest bigint, item_words bigint, tiles bigint, coverage double"


def _row(key: int, item: int, doc: np.ndarray, w: np.ndarray, seed_words: int, tile_words: int) -> list[tuple]:
    t = tiles(doc, w, min(tile_words, len(w)))
    longest = max((k for _, _, k in t), default=0)
    return [(key, item, longest, len(w), len(t), sum(k for _, _, k in t) / len(w))] if longest >= min(seed_words, len(w)) else []


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    types = [pa.int64()] * 5 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "longest", "item_words", "tiles", "coverage"])


def _joined(d: DataFrame, e: DataFrame, seed_words: int, tile_words: int, most_bytes: int, slices: int = 64) -> DataFrame:
    """As ``_against``, by a join on the hashes of seeds."""
    spark = d.sparkSession
    per = 1 << (8 * max(1, min(most_bytes, 2**29) // slices)).bit_length() - 1
    schema = "id bigint, body bigint, width int, seed bigint"
    mixed = lambda h, width: h ^ np.uint64(width * 0x165667B19E3779F9 % 2**64)

    def seeds(widths, allowed):
        def run(batches):
            seen: dict = {}
            bits = allowed.value if allowed is not None else None
            for b in batches:
                out = [[], [], [], []]
                for key, text, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                    w = word_ids(plain_words(text), seen)
                    for width in [min(seed_words, len(w))] if widths is None else widths:
                        h = np.unique(mixed(rolling(w, width), width)) if width else w
                        if bits is not None:
                            at = (h % np.uint64(8 * len(bits))).astype(np.int64)
                            h = h[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
                        for col, v in zip(out, (np.full(len(h), key), np.full(len(h), body), np.full(len(h), width), h.astype(np.int64))):
                            col.append(v)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], names=["id", "body", "width", "seed"])

        return run

    def bit_map(group):
        at = np.asarray(group.column("at")) % per
        bits = np.zeros(per, np.uint8)
        bits[at] = 1
        return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    body = F.xxhash64("text").alias("body")
    asked = staged(e.select("item_id", "text", body).mapInArrow(seeds(None, None), schema), "seeds")
    widths = [r.width for r in asked.select("width").distinct().collect()]
    # as many bits as a power of two, so signed and unsigned hashes have the same place
    spots = asked.select(F.pmod("seed", F.lit(per * slices)).alias("at")).distinct().select(F.floor(F.col("at") / per).cast("int").alias("slice"), "at")
    got = {r["slice"]: r["bits"] for r in spots.groupBy("slice").applyInArrow(bit_map, "slice int, bits binary").toArrow().to_pylist()}
    bits = np.frombuffer(b"".join(got.get(i, bytes(per // 8)) for i in range(slices)), np.uint8)
    allowed = spark.sparkContext.broadcast(bits)
    held = d.select("doc_id", "text", body).mapInArrow(seeds(widths, allowed), schema)
    pairs = held.select(F.col("id").alias("doc_id"), "body", "width", "seed").join(asked.select(F.col("id").alias("item_id"), F.col("body").alias("item_body"), "width", "seed"), ["width", "seed"])
    pairs = pairs.select("doc_id", "body", "item_id", "item_body").distinct()
    both = pairs.join(d.select("doc_id", "text", body), ["doc_id", "body"]).join(e.select("item_id", F.col("text").alias("item_text"), body.alias("item_body")), ["item_id", "item_body"])

    def run(batches):
        seen: dict = {}
        for b in batches:
            rows = []
            for key, text, item, item_text in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows += _row(key, item, word_ids(plain_words(text), seen), word_ids(plain_words(item_text), seen), seed_words, tile_words)
            yield _found_batch(rows)

    return both.select("doc_id", "text", "item_id", "item_text").mapInArrow(run, FOUND)


def _against(docs: DataFrame, items: list[tuple[int, str]], seed_words: int, tile_words: int) -> DataFrame:
    seen: dict = {}
    bodies = [(i, word_ids(plain_words(t), seen)) for i, t in items]
    bodies = [(i, w) for i, w in bodies if len(w)]
    seeds: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for n, (_, w) in enumerate(bodies):
        width = min(seed_words, len(w))
        h = rolling(w, width)
        seeds.setdefault(width, []).append((h, np.full(len(h), n)))
    index = {}
    for width, parts in seeds.items():
        h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((n, h))
        index[width] = h[order], n[order]
    known = docs.sparkSession.sparkContext.broadcast((bodies, index))

    def run(batches):
        bodies, index = known.value
        seen: dict = {}
        for b in batches:
            ids = [word_ids(plain_words(t), seen) for t in b.column(1).to_pylist()]
            keys = b.column(0).to_pylist()
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint64)
            ends = np.cumsum([len(x) for x in ids])
            hits: set[tuple[int, int]] = set()
            for width, (h, n) in index.items():
                r = rolling(flat, width)
                if not len(r):
                    continue
                at = np.searchsorted(h, r)
                some = np.flatnonzero(h[np.minimum(at, len(h) - 1)] == r)
                owner = np.searchsorted(ends, some, side="right")
                inside = some + width <= ends[owner]
                for p, o in zip(some[inside].tolist(), owner[inside].tolist()):
                    k = at[p]
                    while k < len(h) and h[k] == r[p]:
                        hits.add((o, int(n[k])))
                        k += 1
            rows = []
            for o, n in sorted(hits):
                rows += _row(keys[o], bodies[n][0], ids[o], bodies[n][1], seed_words, tile_words)
            yield _found_batch(rows)

    return docs.mapInArrow(run, FOUND)
