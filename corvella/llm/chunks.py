"""Cutting oversized texts into overlapping pieces (problem 3)."""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from corvella.functions.chunking import cut_points

PIECES = (
    "piece_index bigint, char_start bigint, char_end bigint, text string, metadata string"
)
_WORD = re.compile(r"\d*[^\W\d_][^\W_]*")
_END = re.compile(r"\n\s*\n|\n|[.!?…]['\"”»)\]]*\s")


def _cohesion(bags: list[Counter], block: int) -> list[float]:
    """Of each gap between two sentences the cosine of the words of the ``block`` sentences before and after.

    A word weighs the more the fewer sentences of the text have it.
    """
    n = len(bags)
    held = Counter(w for b in bags for w in b)
    weighed = [{w: c * math.log(1 + n / held[w]) for w, c in b.items()} for b in bags]
    out = []
    for i in range(1, n):
        left, right = {}, {}
        for side, part in ((left, weighed[max(0, i - block) : i]), (right, weighed[i : i + block])):
            for sentence in part:
                for w, v in sentence.items():
                    side[w] = side.get(w, 0.0) + v
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        out.append(sum(v * right[w] for w, v in left.items() if w in right) / norm if norm else 0.0)
    return out


def _rises(sim: list[float]) -> list[float]:
    """How far the cohesion rises before each gap, to the last peak: one pass, as a gap shares the peak of the one before that is not lower."""
    out, peak, last = [], 0.0, -1.0
    for s in sim:
        peak = peak if last >= s else s
        out.append(peak - s)
        last = s
    return out


def valley_points(text: str, size: int, overlap: int, block: int = 4) -> list[tuple[int, int]]:
    """Pieces ``(start, end)`` cut at valleys of lexical cohesion.

    The text falls into sentences at line ends and sentence marks.  The depth of the gap between two is how far the cohesion of
    the ``block`` sentences on both sides rises to the nearest peaks before and after it.  Each piece ends at the deepest gap of the
    whole window of ``size`` characters behind the overlap, the later of equal ones, and at white space or at ``size`` where the
    window has no gap at all.  A piece starts ``overlap`` characters before the last one's end.  Work is linear in the text.
    """
    n = len(text)
    if not text.strip():
        return []
    ends = [m.end() for m in _END.finditer(text) if m.end() < n]
    sim = _cohesion([Counter(_WORD.findall(text[a:b].lower())) for a, b in zip([0, *ends], [*ends, n])], block)
    depth = [a + b for a, b in zip(_rises(sim), reversed(_rises(sim[::-1])))]
    out, start = [], 0
    while n > start + size:
        low, high = bisect_right(ends, start + overlap), bisect_right(ends, start + size)
        if low < high:
            end = ends[max(range(low, high), key=lambda k: (depth[k], k))]
        else:
            gap = max(text.rfind(mark, start + overlap + 1, start + size) for mark in (" ", "\n"))
            end = gap + 1 if gap >= 0 else start + size
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def segmentation_error(ends: list[int], true_ends: list[int], length: int) -> float:
    """Pk: the share of the pairs of places half a mean segment apart of which only one segmentation holds both in one segment."""
    k = max(1, round(length / (len(true_ends) + 1) / 2))
    ends, true_ends = sorted(ends), sorted(true_ends)
    split = lambda cuts, i: bisect_right(cuts, i + k) > bisect_right(cuts, i)
    return sum(split(ends, i) != split(true_ends, i) for i in range(length - k)) / max(1, length - k)


def _placed(metadata: str | None, start: int, end: int, index: int) -> str | None:
    """The record's metadata with positions of the piece; broken metadata stays as it is."""
    try:
        meta = json.loads(metadata) if metadata else {}
    except ValueError:
        return metadata
    if not isinstance(meta, dict):
        return metadata
    try:
        base = int(meta.get("char_start", 0))
    except (TypeError, ValueError):
        base = 0
    return json.dumps(meta | {"char_start": base + start, "char_end": base + end, "piece_index": index}, ensure_ascii=False)


def split_oversized(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    metadata_col: str | None = "metadata",
    size: int = 1000,
    overlap: int = 200,
    method: str = "valleys",
    only_oversized: bool = True,
) -> DataFrame:
    """Pieces of at most ``size`` characters: ``(id, piece_index, char_start, char_end, text, metadata)``.

    ``method="valleys"`` cuts at the deepest valley of lexical cohesion in each window,
    ``"separators"`` by the separator recurrence of the ingest chunker.  A text of ``size`` or
    fewer characters is left out if ``only_oversized``.  Null and blank texts give no pieces;
    repeated rows give their pieces again; other columns are ignored.  Each text is cut on its
    own, so there is no shuffle.  ``metadata`` positions are shifted by the record's own.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    if method not in ("valleys", "separators"):
        raise ValueError(f"unknown method {method}")
    cut = valley_points if method == "valleys" else cut_points
    with_meta = metadata_col is not None

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            metas = b.column(2).to_pylist() if with_meta else None
            for i, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if text is None or (only_oversized and len(text) <= size):
                    continue
                index = 0
                for a, z in cut(text, size, overlap):
                    piece = text[a:z].strip()
                    if not piece:
                        continue
                    meta = _placed(metas[i], a, z, index) if with_meta else None
                    for col, v in zip(out, (key, index, a, z, piece, meta)):
                        col.append(v)
                    index += 1
            types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[id_col, "piece_index", "char_start", "char_end", "text", "metadata"])

    cols = [df[id_col], df[text_col]] + ([df[metadata_col]] if with_meta else [])
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(*cols).mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")
