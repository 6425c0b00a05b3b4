"""Files as texts and chunks."""

from __future__ import annotations

import html.parser
import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.errors import FileIngestError
from corvella.functions.chunking import cut_points
from corvella.functions.embed import Embedder, loaded
from corvella.functions.text import IMAGES, SOUNDS, extension

#: Extensions that have a reader.
SUPPORTED = (".docx", ".htm", ".html", ".md", ".pdf", ".txt")
_SKIPPED = ("script", "style", "nav", "footer", "header")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.inside = [], 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag in _SKIPPED

    def handle_endtag(self, tag):
        self.inside -= tag in _SKIPPED and self.inside > 0

    def handle_data(self, data):
        if not self.inside and data.strip():
            self.parts.append(data.strip())


def html_text(source: str) -> str:
    """Visible texts of a page joined by line ends; scripts, styles, navigation, headers and footers are left out."""
    p = _Text()
    p.feed(source)
    p.close()
    return "\n".join(p.parts)


def docx_text(data: bytes) -> str:
    """Paragraphs with text, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def html_to_text(page: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda s: None if s is None else html_text(s))

    return run(page)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, ext, content)`` of all files with a reader below ``path``; others are passed over."""
    return _listed(spark, path).where(F.col("ext").isin(*SUPPORTED))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", extension(F.col("path")).alias("ext"), "content")


def chunk_rows(key: str, text: str, size: int, overlap: int, page: int | None = None) -> list[tuple]:
    """``(source, page, chunk_index, char_start, char_end, text)`` of each chunk."""
    return [(key, page, i, a, z, text[a:z].strip()) for i, (a, z) in enumerate(cut_points(text, size, overlap))]


CHUNKS = "source string, page int, chunk_index bigint, char_start bigint, char_end bigint, text string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["source", "page", "chunk_index", "char_start", "char_end", "text"])


def chunk_files(files: DataFrame, size: int = 1000, overlap: int = 200, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Chunks of ``(path, ext, content)`` rows.

    Text is read as UTF-8 with replacement of what is not.  ``pdf`` gives a file's pages; blank ones have no chunks, pages count from 1.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, ext, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if ext == ".pdf":
                    if pdf is None:
                        raise FileIngestError(path, "no reader for PDF was given")
                    for n, page in enumerate(pdf(data), 1):
                        rows += chunk_rows(path, page, size, overlap, n)
                    continue
                text = docx_text(data) if ext == ".docx" else data.decode("utf-8", "replace")
                rows += chunk_rows(path, html_text(text) if ext in (".htm", ".html") else text, size, overlap)
            yield _batch(rows)

    return files.select("path", "ext", "content").mapInArrow(run, CHUNKS)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(id, chunk_index, char_start, char_end, text)`` of each document's chunks; null and blank texts have none."""

    def run(batches):
        for b in batches:
            rows = [(k, *r[2:]) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for r in chunk_rows("", t, size, overlap)]
            cols = list(zip(*rows)) or [()] * 5
            types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[id_col, "chunk_index", "char_start", "char_end", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index bigint, char_start bigint, char_end bigint, text string")


def _media(spark: SparkSession, path: str, kinds: tuple[str, ...], what: str) -> DataFrame:
    """``(path, ext, content)`` of the files below ``path`` of those extensions; a missing path, or a single file of another kind, is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isFile() and not path.lower().endswith(tuple(f".{k}" for k in kinds)):
        raise FileIngestError(path, f"not {what} of a known format: {', '.join(kinds)}")
    return _listed(spark, path).where(F.col("ext").isin(*(f".{k}" for k in kinds)))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return _media(spark, path, IMAGES, "an image")


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    return _media(spark, path, SOUNDS, "a sound")


def embedded(files: DataFrame, embed: Embedder) -> DataFrame:
    """``(path, embedding)`` of the contents, by a model that takes bytes, such as one of images."""
    return files.select("path", embed(F.col("content")).alias("embedding"))


def transcribed(files: DataFrame, transcribe: Callable[[list[bytes]], list[str]] | None = None, load: Callable[[], Callable[[list[bytes]], list[str]]] | None = None, name: str = "transcriber") -> DataFrame:
    """``(path, text)`` of sound files: by a function of a batch, or by the model ``name`` that ``load`` brings into a worker once."""

    @F.pandas_udf(T.StringType())
    def run(data: pd.Series) -> pd.Series:
        model = transcribe if load is None else loaded(name, load)
        return pd.Series(list(model(data.tolist())), dtype=object)

    return files.select("path", run("content").alias("text"))


def transcribed_and_embedded(files: DataFrame, embed: Embedder, **model) -> DataFrame:
    """``(path, text, embedding)`` of sound files."""
    return transcribed(files, **model).select("path", "text", embed(F.col("text")).alias("embedding"))


def file_digests(files: DataFrame) -> DataFrame:
    """``(path, sha256)`` of the contents."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))
