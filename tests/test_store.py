import io
import json
from pathlib import Path

import pytest

from corvella import errors
from corvella.operators.eager import eager_join_aggregate, large_groups
from corvella.operators.sparse import bm25_scores
from corvella.security import Access, AuditLog, checked_key
from corvella.session import scratch_dir
from corvella.sources.cloud import credentials, upload
from corvella.sources.store import Store, decrypted, encrypted
from corvella.streaming.live import add_stream, operation_counts


def test_store_round_trip(spark, tmp_path):
    s = Store(spark, str(tmp_path / "v"))
    with pytest.raises(errors.EmptyStoreError):
        s.search("x")
    s.add("insulin for diabetes", {"ward": "7"}, "ward", "d1")
    s.add_batch(["contract law", "insulin dose"], [{}, {"ward": "8"}], "default")
    assert s.count() == 3 and s.count("ward") == 1 and s.list_namespaces() == ["default", "ward"]
    with pytest.raises(ValueError):
        s.add("again", doc_id="d1")
    with pytest.raises(errors.UnknownNamespaceError):
        s.search("x", namespace="none")
    found = s.search("insulin", top_k=2).collect()
    assert found and "insulin" in found[0].text
    snap = s.snapshot(str(tmp_path / "snaps"))
    assert s.delete("d1") and not s.delete("d1") and s.count() == 2
    s.restore(snap)
    assert s.count() == 3 and len(s.snapshots(str(tmp_path / "snaps"))) == 1
    assert s.stats().first().namespace_counts == {"default": 2, "ward": 1}
    assert s.get("d1")["namespace"] == "ward" and s.page("default", 1, 1).count() == 1
    assert s.audit.read(operation="search").count() == 1
    s.protected = True
    with pytest.raises(errors.ProtectedError):
        s.delete("d1")
    reader = Store(spark, str(tmp_path / "v"), key="some-long-key")
    with pytest.raises(errors.DeniedError):
        reader.add("no")


def test_encryption(spark, tmp_path):
    path = tmp_path / "v"
    s = Store(spark, str(path), encryption_key="a long enough key")
    s.add("insulin for diabetes", {"ward": "seven"}, "ward", "d1")
    s.add("contract law for insulin", {}, "default", "d2")
    s.add("nothing here", {}, "default", "d3")
    raw = b"".join(f.read_bytes() for f in path.rglob("*") if f.is_file())
    assert b"insulin" not in raw and b"diabetes" not in raw and b"seven" not in raw
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(next(path.glob("documents-*"))))
    assert "insulin" not in str(stored.collect())
    assert stored.schema["embedding"].dataType.simpleString() == "string"
    again = Store(spark, str(path), encryption_key="a long enough key")
    assert again.get("d1")["text"] == "insulin for diabetes" and abs(sum(x * x for x in again.get("d1")["embedding"]) - 1) < 1e-6
    assert again.search("diabetes", top_k=1).first().doc_id == "d1" and again.stats().first().encrypted
    for key in (None, "another long key"):
        with pytest.raises(errors.KeyFormError):
            Store(spark, str(path), encryption_key=key)
    Store(spark, str(tmp_path / "plain"))
    with pytest.raises(errors.KeyFormError):
        Store(spark, str(tmp_path / "plain"), encryption_key="a long enough key")
    sums = upload(s, "file", "", str(tmp_path / "cloud")[1:]).collect()
    assert len(sums) > 5 and all(len(r.sha256) == 64 for r in sums)
    with pytest.raises(errors.StoreError):
        upload(Store(spark, str(tmp_path / "plain")), "file", "", "x")
    with pytest.raises(ValueError):
        upload(s, "ftp", "x")
    assert credentials("s3", {"fs.s3a.access.key": "a"}, {"AWS_SECRET_ACCESS_KEY": "b"}) == {"fs.s3a.access.key": "a", "fs.s3a.secret.key": "b"}


def test_versions_and_stored_postings(spark, tmp_path):
    path = tmp_path / "v"
    s = Store(spark, str(path))
    s.add_batch(["insulin dose", "insulin insulin pump", "contract law"])
    s.add("law of insulin", doc_id="d4")
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    s.delete("d4")
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items())

    def same(store):
        docs = store.documents.withColumnRenamed("doc_id", "name").withColumnRenamed("ord", "doc_id")
        q = spark.createDataFrame([(0, "insulin law pump")], "qid bigint, text string")
        kept, fresh = (sorted((r.doc_id, round(r.score, 9)) for r in bm25_scores(q, x).collect()) for x in (store.index(), docs))
        assert kept == fresh and kept

    same(s)
    s.compact()
    same(s)
    i = s.index()
    assert i.documents == 3 and i.words == 7
    # a writer that read an older version is told so
    old = s._manifest()
    s.add("one more")
    with pytest.raises(errors.ConflictError):
        s._publish(old)
    # a manifest that is not yet whole is passed over
    (path / "manifest-000000000099.json").write_text('{"version": 9')
    assert Store(spark, str(path)).count() == 4
    with pytest.raises(errors.DimensionError):
        s.add_all(spark.createDataFrame([("x", [1.0])], "text string, embedding array<float>"))
    assert not list(Path(scratch_dir(spark).removeprefix("file:")).glob("added-*"))
    out = io.StringIO()
    assert s.export_document(out) == 4 and json.loads(out.getvalue())["count"] == 4
    assert s.export(str(tmp_path / "dump"), "default") == 4 and s.all_documents("none").count() == 0


def test_ingest_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("sentence one. " * 100)
    (folder / "b.html").write_text("<p>hello</p>")
    (folder / "c.bin").write_text("no")
    s = Store(spark, str(tmp_path / "v"))
    assert s.ingest(str(folder)) > 2
    with pytest.raises(errors.FileIngestError):
        s.ingest(str(folder / "c.bin"))
    with pytest.raises(FileNotFoundError):
        s.ingest(str(folder / "none.txt"))
    before = s.count()
    spark.createDataFrame([("n1", "x"), ("n1", "x"), ("n2", None)], "doc_id string, text string").write.json(str(tmp_path / "live"))
    stream = spark.readStream.schema("doc_id string, text string").json(str(tmp_path / "live"))
    add_stream(s, stream, str(tmp_path / "cp")).awaitTermination()
    assert s.count() == before + 2
    events = spark.sql("select 1L audit_id, timestamp'2024-01-01 00:10:00' ts, 'Add' operation union all select 1L, timestamp'2024-01-01 00:10:00', 'Add' union all select 2L, timestamp'2024-01-01 01:10:00', 'add'")
    assert sorted(r.events for r in operation_counts(events).collect()) == [1, 1]


def test_security(spark, tmp_path):
    a = Access()
    a.register("k", "read-write")
    with pytest.raises(ValueError):
        a.register("k", "owner")
    assert Access("k", a.roles).allows("write") and not Access("zz").allows("write")
    with pytest.raises(ValueError):
        checked_key("short")
    log = AuditLog(spark, str(tmp_path / "a"))
    log.log("me", "add", metadata="{}")
    log.log("you", "delete")
    assert log.read(actor="me").count() == 1 and log.read(since=0).count() == 2
    d = spark.createDataFrame([("secret",)], "t string")
    assert decrypted(encrypted(d, ["t"], "longenough"), ["t"], "longenough").first().t == "secret"


def test_eager_aggregation(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "x"), (None, 4, "x"), ("c", 5, "x")], "k string, v int, g string")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("a", None), ("b", 7), (None, 9)], "k string, v int")
    m = {"l": ("left", "sum", "v"), "r": ("right", "sum", "v"), "n": ("right", "count", "v"), "top": ("right", "max", "v")}
    for how in ("inner", "left"):
        for groups in ([], ["g"], ["k"]):
            got = eager_join_aggregate(left, right, [("k", "k")], group_left=groups, measures=m, how=how)
            a, b = left.alias("a"), right.alias("b")
            from pyspark.sql import functions as F

            want = a.join(b, F.expr("a.k = b.k"), how).groupBy(*[F.col(f"a.{g}").alias(g) for g in groups]).agg(
                F.expr("count(*) rows"), F.expr("sum(a.v) l"), F.expr("sum(b.v) r"), F.expr("count(b.v) n"), F.expr("max(b.v) top")
            )
            key = lambda r: tuple(map(str, r))
            assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert eager_join_aggregate(left.limit(0), right, [("k", "k")], ["k"]).count() == 0
    docs = spark.createDataFrame([("a",)] * 8 + [("b",)] + [(None,)], "namespace string")
    names = spark.createDataFrame([("a",), ("a",)], "name string")
    assert [(r.namespace, r.rows) for r in large_groups(docs, names, 0.5).collect()] == [("a", 8)]
