"""Text embedders as column functions; models plug in as pandas UDFs."""

from __future__ import annotations

import builtins
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.functions.text import IMAGES, SOUNDS, tokens


def _kept(name: str) -> dict:
    """A dictionary that lives as long as the Python worker: functions that are pickled by value have globals of their own in every task."""
    return builtins.__dict__.setdefault(f"_corvella_{name}", {})


@dataclass(frozen=True)
class Embedder:
    """A column function from texts, paths or bytes to vectors, and the length of these (None if only the model knows it)."""

    run: Callable[[Column], Column]
    dimension: int | None = None

    def __call__(self, values: Column) -> Column:
        return self.run(values)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """The default embedder: counts of the text's tokens by bucket, at norm 1; all zero without tokens.

    A token's bucket is the first 32 bits of its MD5 sum modulo ``dim``.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out, known = [], _kept("buckets")
        for words in texts:
            v = np.zeros(dim)
            for w in words:
                h = known.get(w)
                if h is None:
                    if len(known) > 500_000:
                        known.clear()
                    h = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                v[h % dim] += 1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed(tokens(text))


#: The embedder of a store that is given none.
HASHING = Embedder(hash_embedding, 64)


def model_embedding(name: str, load: Callable[[], Callable[[list], np.ndarray]], dimension: int | None = None, batch: int = 64) -> Embedder:
    """An embedder from a function that loads a model; each worker loads ``name`` once, in its first batch, and passes it ``batch`` inputs at a time.

    Inputs may be texts, paths or bytes, so the same serves images and sound.  Null inputs have no vector.  A model whose library is missing fails with
    the import's own error and the name of the model.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(values: pd.Series) -> pd.Series:
        model = loaded(name, load)
        out: list = [None] * len(values)
        real = [i for i, v in enumerate(values) if v is not None]
        for a in range(0, len(real), batch):
            part = real[a : a + batch]
            for i, v in zip(part, model([values.iloc[i] for i in part])):
                x = np.asarray(v, np.float32)
                n = float(np.linalg.norm(x))
                out[i] = (x / n if n else x).tolist()
        return pd.Series(out)

    return Embedder(embed, dimension)


def loaded(name: str, load: Callable):
    """The model of that name in this worker, loaded if it is not yet there."""
    models = _kept("models")
    if name not in models:
        try:
            models[name] = load()
        except ImportError as e:
            raise ImportError(f"model {name!r} needs a library that is not installed: {e}") from e
    return models[name]


def query_vector(spark: SparkSession, query: str, modality: str | None = None, text: Embedder = HASHING, image: Embedder | None = None, transcribe: Callable[[bytes], str] | None = None) -> list[float]:
    """The vector of one query that is a text, or the path of an image or a sound.

    The modality is told by the extension of a file that exists, else the query is a text.  A sound is transcribed and its text embedded.  A modality that
    is unknown or has no model is a ValueError.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(query) if query.strip() else None
    if modality is None:
        ext = query.rsplit(".", 1)[-1].lower() if "." in query else ""
        kind = "image" if ext in IMAGES else "audio" if ext in SOUNDS else "text"
        there = kind != "text" and file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)
        modality = kind if there else "text"
    if modality == "text":
        return spark.createDataFrame([(query,)], "q string").select(text(F.col("q"))).first()[0]
    if modality not in ("image", "audio") or (image if modality == "image" else transcribe) is None:
        raise ValueError(f"no model for modality {modality!r}")
    data = spark.read.format("binaryFile").load(query).select("content")
    if modality == "image":
        return data.select(image(F.col("content"))).first()[0]
    heard = F.pandas_udf(lambda s: s.map(transcribe), T.StringType())
    return data.select(text(heard("content"))).first()[0]
