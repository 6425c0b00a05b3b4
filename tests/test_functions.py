import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella import errors
from corvella.functions import embed, text
from corvella.functions.chunking import cut_points
from corvella.sources import files
from corvella.sources.files import docx_text, html_text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("Ärzte-Team_7, x²!"))) == ["ärzte", "team_7", "x²"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_paths_and_labels(spark):
    assert one(spark, text.extension(F.lit("/a/b.C/Report.PDF"))) == ".pdf"
    assert one(spark, text.extension(F.lit("/a/.hidden"))) == ""
    assert one(spark, text.key_label(F.lit("abcdefghijk"))) == "abcdefgh..."
    assert one(spark, text.key_label(F.lit("abc"))) == "***"
    assert one(spark, text.key_label(F.lit(None).cast("string"))) == "local-admin"
    assert one(spark, text.stripped(F.lit("\t a b \n"))) == "a b"
    assert one(spark, text.modality(F.lit("x.JPG"), F.lit(True))) == "image"
    assert one(spark, text.modality(F.lit("x.jpg"), F.lit(False))) == "text"
    assert one(spark, text.remote_key("a/", F.lit("b"))) == "a/b"


def test_chunk_anchors():
    assert cut_points("x" * 800) == [(0, 1000)]
    assert cut_points("x" * 801) == [(0, 1000), (800, 1800)]
    assert cut_points("x" * 2500) == [(0, 1000), (800, 1800), (1600, 2600), (2400, 3400)]
    assert cut_points("ab\n\n" + "x" * 2000) == [(0, 4), (4, 1004), (804, 1804), (1604, 2604)]
    assert cut_points(" \n ") == []
    assert cut_points("x" * 30 + " " * 9 + "\n" + "y" * 60, 50, 10)[-1][1] >= 100


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n.!?", max_size=120), st.integers(5, 30), st.integers(0, 4))
def test_chunks_end_and_cover(s, size, overlap):
    pieces = cut_points(s, size, overlap)
    assert all(z - a <= size for a, z in pieces)
    covered = set()
    for a, z in pieces:
        covered.update(range(a, z))
    assert all(i in covered for i, c in enumerate(s) if not c.isspace())


def test_html_and_docx():
    import io
    import zipfile

    assert html_text("<title>T</title><nav>no</nav><p>a &amp; b</p><script>x</script><div> c </div>") == "T\na & b\nc"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:t>one</w:t></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>')
    assert docx_text(data.getvalue()) == "one\n\ntwo"


def test_hash_embedding(spark):
    v = one(spark, embed.hash_embedding(F.lit("a b a"), 16))
    assert len(v) == 16 and math.isclose(sum(x * x for x in v), 1, rel_tol=1e-5)
    assert set(one(spark, embed.hash_embedding(F.lit(""), 16))) == {0.0}


def test_models_are_loaded_once_a_worker_and_by_name(spark, tmp_path):
    def loader(value):
        def load():
            with open(f"{tmp_path}/loads-{value}", "a") as f:
                f.write("x")
            return lambda xs: [[value, float(len(x))] for x in xs]

        return load

    one, two = embed.model_embedding("one", loader(3.0), 2), embed.model_embedding("two", loader(0.0))
    d = spark.range(64).repartition(16).select(F.when(F.col("id") != 5, F.lit("abcd")).alias("t"))
    got = d.select(one(F.col("t")).alias("a"), two(F.col("t")).alias("b")).collect()
    assert one.dimension == 2 and embed.HASHING.dimension == 64
    assert sum(r.a is None for r in got) == 1 and all([round(x, 4) for x in r.a] == [0.6, 0.8] and r.b == [0.0, 1.0] for r in got if r.a)
    # 16 tasks, but no more loads than workers
    assert all(len((tmp_path / f"loads-{v}").read_text()) <= 8 for v in (3.0, 0.0))


def test_media_and_queries_of_any_kind(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"12345")
    (tmp_path / "b.wav").write_bytes(b"hello world")
    (tmp_path / "c.txt").write_text("no")
    image = embed.Embedder(F.pandas_udf(lambda s: s.map(lambda b: [float(len(b)), 0.0]), "array<float>"), 2)
    assert [r.embedding for r in files.embedded(files.read_images(spark, str(tmp_path)), image).collect()] == [[5.0, 0.0]]
    heard = files.transcribed_and_embedded(files.read_sounds(spark, str(tmp_path)), embed.HASHING, load=lambda: lambda xs: [x.decode() for x in xs]).first()
    assert heard.text == "hello world" and len(heard.embedding) == 64
    with pytest.raises(FileNotFoundError):
        files.read_sounds(spark, str(tmp_path / "none.wav"))
    with pytest.raises(errors.FileIngestError):
        files.read_sounds(spark, str(tmp_path / "c.txt"))
    told = lambda q, **o: list(embed.query_vector(spark, q, **o))
    assert told(str(tmp_path / "a.png"), image=image) == [5.0, 0.0]
    assert told(str(tmp_path / "b.wav"), transcribe=bytes.decode) == told("hello world") == list(heard.embedding)
    assert told("none.png") == told("none png")
    for q, o in ((str(tmp_path / "a.png"), {}), ("x", {"modality": "smell"})):
        with pytest.raises(ValueError):
            told(q, **o)


def test_digests_are_of_the_content(spark):
    d = spark.createDataFrame([("p", bytearray(b"abc"))], "path string, content binary")
    assert files.file_digests(d).first().sha256 == hashlib.sha256(b"abc").hexdigest()
