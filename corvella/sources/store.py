"""The document store: Parquet folders that are written once, named by manifests."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.errors import AlphaError, ConflictError, DimensionError, EmptyStoreError, FileIngestError, KeyFormError, ProtectedError, UnknownNamespaceError
from corvella.functions.embed import Embedder, HASHING
from corvella.functions.text import snapshot_name, tokens
from corvella.operators.sparse import SparseIndex, mean_idf, postings
from corvella.plans.search import hybrid_search
from corvella.security import Access, AuditLog, checked_key
from corvella.session import scratch
from corvella.sources.files import SUPPORTED, chunk_files, read_files

DOCUMENTS = "doc_id string, ord bigint, text string, embedding array<float>, metadata_json string, namespace string, modality string, created_at double"
NAMESPACES = "name string, created_at double, metadata_json string"
POSTINGS = "doc_id bigint, term string, tf bigint, dl bigint, bucket int"
#: Columns that an encrypted store writes as bytes only its key can read, and the folders by which postings are found.
SECRET, BUCKETS = ("text", "embedding", "metadata_json"), 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def namespace_counts(namespaces: DataFrame, docs: DataFrame) -> DataFrame:
    """``(namespace, documents)`` of all namespaces, empty ones too."""
    per = docs.groupBy("namespace").agg(F.count(F.lit(1)).alias("documents"))
    joined = namespaces.select(F.col("name").alias("namespace")).distinct().join(per, "namespace", "left")
    return joined.select("namespace", F.coalesce("documents", F.lit(0)).alias("documents"))


def page(docs: DataFrame, namespace: str, limit: int = 1000, offset: int = 0) -> DataFrame:
    return docs.where(F.col("namespace") == namespace).orderBy("created_at", "doc_id").offset(offset).limit(limit)


def scan(docs: DataFrame, namespace: str | None = None) -> DataFrame:
    """All documents, or those of a namespace, the oldest first."""
    return (docs if namespace is None else docs.where(F.col("namespace") == namespace)).orderBy("created_at", "doc_id")


def by_id(docs: DataFrame, doc_id) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def counted(docs: DataFrame, namespace: str | None = None) -> DataFrame:
    return (docs if namespace is None else docs.where(F.col("namespace") == namespace)).agg(F.count(F.lit(1)).alias("n"))


def listed(namespaces: DataFrame) -> DataFrame:
    return namespaces.select("name").distinct().orderBy("name")


def batch_totals(rows: DataFrame) -> DataFrame:
    """``(count, chars)`` as the log keeps them of a batch."""
    return rows.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def exported(docs: DataFrame, namespace: str | None = None) -> DataFrame:
    """What leaves with an export: no vectors."""
    return scan(docs, namespace).select("doc_id", "text", "metadata_json", "namespace", "modality", "created_at")


def summary(namespaces: DataFrame, docs: DataFrame, dim: int) -> DataFrame:
    """One row: numbers of documents, of namespaces, of vectors of the right length and of texts with words, and documents by namespace."""
    per = namespace_counts(namespaces, docs).agg(F.sort_array(F.collect_list("namespace")).alias("namespaces"), F.map_from_entries(F.collect_list(F.struct("namespace", "documents"))).alias("namespace_counts"))
    held = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce(F.size("embedding") == dim, F.lit(False))).alias("index_vectors"), F.count("text").alias("bm25_documents"))
    return held.join(F.broadcast(per))


def duplicate_ids(new: DataFrame, docs: DataFrame) -> DataFrame:
    return new.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti")


class Store:
    """Documents with namespaces, search, snapshots and an audit log in a folder.

    A version is a manifest ``manifest-N.json`` that names the folders it consists of; folders never change.  A writer creates the next manifest
    only if nobody has, else ``ConflictError`` tells it to try again, and a reader passes over one that is not yet written in full: no state is
    half written, no two writers overwrite each other.  Adding writes the new documents, their postings and terms only; deleting writes the ids that are gone,
    and ``compact`` folds both into one folder.  ``embed`` is an ``Embedder``.

    With ``encryption_key`` the columns ``text``, ``embedding`` and ``metadata_json`` are written by AES-GCM under a key that PBKDF2 derives from it and the store's
    own salt, the words of postings as keyed hashes, and the log's metadata stays empty; ids, namespaces and counts are readable.  The wrong key, none, or one for a store without is ``KeyFormError``.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, roles: dict[str, str] | None = None, embed: Embedder = HASHING, encryption_key: str | None = None, protected: bool = False, audit: bool = True):
        self.spark, self.path, self.embed, self.protected = spark, path.rstrip("/"), embed, protected
        self.access = Access(key, roles)
        self.audit = AuditLog(spark, f"{self.path}/audit" if audit else None, private=encryption_key is not None)
        checked_key(encryption_key)
        m = self._manifest()
        if m is None:
            salt = secrets.token_hex(16) if encryption_key else None
            self._secret = _derived(encryption_key, salt)
            names = spark.createDataFrame([("default", time.time(), "{}")], NAMESPACES)
            self._publish({"version": 0, "documents": [], "postings": [], "terms": [], "deleted": [], "count": 0, "words": 0, "salt": salt, "check": _check(self._secret)}, namespaces=names)
        else:
            if (m["salt"] is None) != (encryption_key is None):
                raise KeyFormError("the store is encrypted" if m["salt"] else "the store is not encrypted")
            self._secret = _derived(encryption_key, m["salt"])
            if m["check"] != _check(self._secret):
                raise KeyFormError("not the key of this store")
        self._mean: tuple[int, float] = (-1, 0.0)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        """Nothing stays open."""

    def save(self) -> None:
        """Every change is written as it is made."""

    def __repr__(self) -> str:
        return f"Store({self.path!r}, documents={self.count()})"

    @property
    def is_encrypted(self) -> bool:
        return self._secret is not None

    @property
    def current_role(self) -> str:
        return self.access.role

    # --- manifests and folders ---
    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifest(self) -> dict | None:
        """The newest manifest that is complete."""
        fs, Path = self._fs()
        found = fs.globStatus(Path(f"{self.path}/manifest-*.json")) or []
        for p in sorted((s.getPath().toString() for s in found), reverse=True):
            stream = fs.open(Path(p))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                continue
            finally:
                stream.close()
        return None

    def _folder(self, what: str, df: DataFrame) -> str:
        name = f"{what}-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        by = {"documents": ["namespace"], "postings": ["bucket"]}.get(what)
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.path}/{name}")
        return name

    def _publish(self, base: dict, **replaced) -> None:
        """The manifest after ``base``, with tables that are written first; another writer's version of the same number is a conflict."""
        m = base | {k: self._folder(k, v) if isinstance(v, DataFrame) else v for k, v in replaced.items()} | {"version": base["version"] + 1}
        fs, Path = self._fs()
        try:
            out = fs.create(Path(f"{self.path}/manifest-{m['version']:012d}.json"), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise ConflictError(m["version"]) from e
            raise
        out.write(bytearray(json.dumps(m).encode()))
        out.close()

    def _sealed(self, df: DataFrame) -> DataFrame:
        """Secret columns as they are written."""
        if self._secret is None:
            return df
        shut = lambda c: F.base64(F.aes_encrypt(F.to_json(F.struct(F.col(c).alias("v"))), F.unhex(F.lit(self._secret))))
        return df.withColumns({c: shut(c) for c in SECRET})

    def _opened(self, df: DataFrame) -> DataFrame:
        if self._secret is None:
            return df
        kinds = {"embedding": "array<float>"}
        open_ = lambda c: F.from_json(F.aes_decrypt(F.unbase64(F.col(c)), F.unhex(F.lit(self._secret))).cast("string"), f"v {kinds.get(c, 'string')}")["v"]
        return df.withColumns({c: open_(c) for c in SECRET})

    def _written(self, term: Column) -> Column:
        """A term as postings hold it."""
        return term if self._secret is None else F.sha2(F.concat(F.lit(self._secret), term), 256)

    def _parquet(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # partition columns are known only by the folders' own root, so several are read one by one
        out = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders]
        names = [c.split()[0] for c in schema.split(", ")]
        whole = out[0].select(*names)
        for more in out[1:]:
            whole = whole.unionByName(more.select(*names))
        return whole

    def _gone(self, m: dict) -> DataFrame | None:
        return F.broadcast(self._parquet(m["deleted"], "ord bigint")) if m["deleted"] else None

    def _documents(self, m: dict) -> DataFrame:
        kinds = DOCUMENTS if self._secret is None else DOCUMENTS.replace("array<float>", "string")
        d, gone = self._opened(self._parquet(m["documents"], kinds)), self._gone(m)
        return d if gone is None else d.join(gone, "ord", "left_anti").select(*d.columns)

    @property
    def documents(self) -> DataFrame:
        return self._documents(self._manifest())

    @property
    def namespaces(self) -> DataFrame:
        return self.spark.read.schema(NAMESPACES).parquet(f"{self.path}/{self._manifest()['namespaces']}")

    def index(self, asked: DataFrame | None = None) -> SparseIndex:
        """The stored postings and statistics, keyed by ``ord``; of the words ``(term)`` of one query only, if given.

        ``terms`` has rows for each addition, to be added up; those of deleted documents are counted from their postings and taken off.  The
        number of documents and of words stand in the manifest, the mean weight is worked out once a version.
        """
        m = self._manifest()
        post, gone = self._parquet(m["postings"], POSTINGS), self._gone(m)
        terms = self._parquet(m["terms"], "term string, df bigint")
        if gone is not None:
            gone = gone.withColumnRenamed("ord", "doc_id")
            lost = post.join(gone, "doc_id", "left_semi")
            terms = terms.unionByName(lost.groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
        if self._mean[0] != m["version"]:
            every = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            self._mean = (m["version"], mean_idf(every, m["count"]))
        if asked is not None:
            words = [r.term for r in asked.select("term").distinct().collect()]
            buckets = [r[0] for r in asked.select(_bucket()).distinct().collect()]
            post = post.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))
            terms = terms.where(F.col("term").isin(words))
        terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        post = post if gone is None else post.join(gone, "doc_id", "left_anti")
        return SparseIndex(post.select("doc_id", "term", "tf", "dl"), terms, m["count"], m["words"], self._mean[1])

    # --- changes ---
    def add_all(self, rows: DataFrame) -> int:
        """Adds rows ``(doc_id?, text, metadata_json?, namespace?, modality?, embedding?)``; null or missing ids are drawn, ids twice are refused.

        Vectors that come with the rows must have the length of the embedder's, else ``DimensionError``; without them texts are embedded.
        """
        self.access.require("write")
        m = self._manifest()
        docs = self._documents(m)
        have = set(rows.columns)
        get = lambda c, default: F.coalesce(F.col(c).cast("string"), default) if c in have else default
        start = docs.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
        with scratch(self.spark) as staged:
            new = staged(
                rows.select(
                    get("doc_id", F.expr("uuid()")).alias("doc_id"),
                    (F.lit(start) + F.monotonically_increasing_id()).alias("ord"),
                    F.coalesce("text", F.lit("")).alias("text"),
                    (F.col("embedding").cast("array<float>") if "embedding" in have else self.embed(F.coalesce("text", F.lit("")))).alias("embedding"),
                    get("metadata_json", F.lit("{}")).alias("metadata_json"),
                    get("namespace", F.lit("default")).alias("namespace"),
                    get("modality", F.lit("text")).alias("modality"),
                    F.lit(time.time()).alias("created_at"),
                ),
                "added",
            )
            if "embedding" in have and self.embed.dimension:
                wrong = new.where(F.size("embedding") != self.embed.dimension).select(F.size("embedding")).first()
                if wrong:
                    raise DimensionError(wrong[0], self.embed.dimension)
            if not duplicate_ids(new, docs).isEmpty() or not new.groupBy("doc_id").count().where("count > 1").isEmpty():
                raise ValueError("ids that are there already")
            total = batch_totals(new).first()
            post = staged(postings(new.select(F.col("ord").alias("doc_id"), "text")).withColumn("term", self._written(F.col("term"))).withColumn("bucket", _bucket()), "postings")
            words = post.select("doc_id", "dl").distinct().agg(F.sum("dl")).first()[0] or 0
            fresh = new.select(F.col("namespace").alias("name")).distinct().join(self.namespaces.select("name"), "name", "left_anti")
            change = {
                "count": m["count"] + total["count"],
                "words": m["words"] + words,
                "documents": [*m["documents"], self._folder("documents", self._sealed(new))],
                "postings": [*m["postings"], self._folder("postings", post.repartition("bucket").sortWithinPartitions("bucket", "term"))],
                "terms": [*m["terms"], self._folder("terms", post.groupBy("term").agg(F.count(F.lit(1)).alias("df")))],
            }
            if not fresh.isEmpty():
                change["namespaces"] = self.namespaces.unionByName(fresh.select("name", F.lit(time.time()).alias("created_at"), F.lit("{}").alias("metadata_json")))
            self._publish(m, **change)
        self.audit.log(self.access.actor, "add", metadata=json.dumps({"count": total["count"], "chars": total["chars"]}))
        return total["count"]

    def add(self, text: str, metadata: dict | None = None, namespace: str = "default", doc_id: str | None = None) -> str:
        doc_id = doc_id or str(uuid.uuid4())
        self.add_all(self.spark.createDataFrame([(doc_id, text, json.dumps(metadata or {}), namespace)], "doc_id string, text string, metadata_json string, namespace string"))
        return doc_id

    def add_batch(self, texts: list[str], metadata: list[dict] | None = None, namespace: str = "default") -> list[str]:
        if metadata is not None and len(metadata) != len(texts):
            raise ValueError("as many metadata as texts are needed")
        if not texts:
            return []
        ids = [str(uuid.uuid4()) for _ in texts]
        rows = [(i, t, json.dumps(m), namespace) for i, t, m in zip(ids, texts, metadata or [{}] * len(texts))]
        self.add_all(self.spark.createDataFrame(rows, "doc_id string, text string, metadata_json string, namespace string"))
        return ids

    def ingest(self, path: str, namespace: str = "default", size: int = 1000, overlap: int = 200, pdf=None) -> int:
        """Chunks of all files below ``path``; a single file without a reader is an error, a missing path too."""
        fs, Path = self._fs()
        at = Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(path)
        if fs.getFileStatus(at).isFile() and not path.lower().endswith(SUPPORTED):
            raise FileIngestError(path, "no reader for this extension")
        chunks = chunk_files(read_files(self.spark, path), size, overlap, pdf)
        meta = F.to_json(F.struct("source", "chunk_index", "char_start", "char_end", "page"))
        return self.add_all(chunks.orderBy("source", "page", "chunk_index").select("text", meta.alias("metadata_json"), F.lit(namespace).alias("namespace")))

    def get(self, doc_id: str) -> dict | None:
        row = by_id(self.documents, doc_id).limit(1).collect()
        return row[0].asDict() if row else None

    def page(self, namespace: str, limit: int = 1000, offset: int = 0) -> DataFrame:
        return page(self.documents, namespace, limit, offset)

    def count(self, namespace: str | None = None) -> int:
        return counted(self.documents, namespace).first()[0]

    def all_documents(self, namespace: str | None = None) -> DataFrame:
        return scan(self.documents, namespace)

    def delete(self, doc_id: str) -> bool:
        self.access.require("delete")
        if self.protected:
            raise ProtectedError("deletion is turned off")
        m = self._manifest()
        row = by_id(self._documents(m), doc_id).select("ord", F.size(tokens(F.col("text"))).alias("words")).first()
        if row is None:
            return False
        self._publish(m, count=m["count"] - 1, words=m["words"] - row.words, deleted=[*m["deleted"], self._folder("deleted", self.spark.createDataFrame([(row.ord,)], "ord bigint").coalesce(1))])
        self.audit.log(self.access.actor, "delete", doc_id)
        return True

    def compact(self) -> None:
        """Folds all additions and deletions into one folder of each kind; older folders stay for readers until removed by hand."""
        self.access.require("write")
        m, i = self._manifest(), self.index()
        post = i.postings.withColumn("bucket", _bucket())
        self._publish(
            m,
            documents=[self._folder("documents", self._sealed(self._documents(m)))],
            postings=[self._folder("postings", post.repartition("bucket").sortWithinPartitions("bucket", "term"))],
            terms=[self._folder("terms", i.terms)],
            deleted=[],
        )

    def create_namespace(self, name: str) -> None:
        self.access.require("create_namespace")
        if name not in self.list_namespaces():
            row = self.spark.createDataFrame([(name, time.time(), "{}")], NAMESPACES)
            self._publish(self._manifest(), namespaces=self.namespaces.unionByName(row))
        self.audit.log(self.access.actor, "create_namespace", namespace=name)

    def list_namespaces(self) -> list[str]:
        return [r.name for r in listed(self.namespaces).collect()]

    def require_namespace(self, name: str) -> None:
        if self.namespaces.where(F.col("name") == name).isEmpty():
            raise UnknownNamespaceError(name, self.list_namespaces())

    def search(self, query: str, top_k: int = 10, alpha: float = 0.5, namespace: str | None = None, **options) -> DataFrame:
        """As ``hybrid_search`` for one text; checks permission, alpha, namespace and that there are documents, in this order."""
        self.access.require("read")
        if not 0 <= alpha <= 1:
            raise AlphaError(alpha)
        if namespace:
            self.require_namespace(namespace)
        docs = self.documents
        if docs.isEmpty():
            raise EmptyStoreError("no documents")
        # places by order of insertion: its number is the key within the search
        keyed = docs.withColumnRenamed("doc_id", "name").withColumnRenamed("ord", "doc_id")
        q = self.spark.createDataFrame([(0, query)], "qid bigint, text string")
        q = q.withColumn("vector", self.embed(F.col("text")))
        dim = options.pop("dim", self.embed.dimension or 64)
        asked = q.select(F.explode(tokens(F.col("text"))).alias("term")).select(self._written(F.col("term")).alias("term"))
        found = hybrid_search(q, keyed, top_k, alpha, namespace, dim=dim, index=self.index(asked), written=self._written, **{"now": time.time(), **options})
        self.audit.log(self.access.actor, "search", namespace=namespace, metadata=json.dumps({"query": query}))
        return found.join(keyed.select("doc_id", "name"), "doc_id").drop("qid", "doc_id").withColumnRenamed("name", "doc_id")

    def stats(self) -> DataFrame:
        """One row: ``summary``, and the path and switches of the store."""
        return summary(self.namespaces, self.documents, self.embed.dimension or 64).select(
            F.lit(self.path).alias("path"), "documents", "namespaces", "namespace_counts", F.lit(self.is_encrypted).alias("encrypted"), F.lit(self.protected).alias("deletion_protection"), "index_vectors", "bm25_documents"
        )

    def export(self, path: str, namespace: str | None = None) -> int:
        """JSON lines of the documents without vectors, in a folder; their number, which ``summary.json`` beside them holds with the store's name."""
        d = exported(self.documents, namespace)
        d.write.json(path)
        n = counted(self.documents, namespace).first()[0]
        fs, Path = self._fs()
        out = fs.create(Path(f"{path}/_summary.json"), True)
        out.write(bytearray(json.dumps({"vault": self.path, "count": n}).encode()))
        out.close()
        return n

    def export_document(self, out, namespace: str | None = None) -> int:
        """``{vault, documents, count}`` as one JSON text written to ``out``; rows pass through the driver one partition at a time."""
        out.write(f'{{"vault": {json.dumps(self.path)}, "documents": [')
        n = 0
        for row in exported(self.documents, namespace).toLocalIterator():
            d = row.asDict()
            try:
                d["metadata"] = json.loads(d.pop("metadata_json") or "{}")
            except ValueError:
                d["metadata"] = {}
            out.write((", " if n else "") + json.dumps(d, ensure_ascii=False))
            n += 1
        out.write(f'], "count": {n}}}')
        return n

    def _copied(self, target: str) -> None:
        """All folders of the newest version as they stand, sealed if the store is, and its manifest last."""
        m = self._manifest()
        fs, Path = self._fs()
        conf = self.spark._jsc.hadoopConfiguration()
        to = Path(target).getFileSystem(conf)
        for f in [*m["documents"], *m["postings"], *m["terms"], *m["deleted"], m["namespaces"]]:
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, Path(f"{self.path}/{f}"), to, Path(f"{target}/{f}"), False, True, conf)
        out = to.create(Path(f"{target}/manifest-{m['version']:012d}.json"), True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()

    def snapshot(self, folder: str) -> str:
        """A copy of the newest version, named by the time to the second."""
        self.access.require("backup")
        stem = self.path.rsplit("/", 1)[-1]
        name = self.spark.range(1).select(snapshot_name(stem, F.lit(time.time()).cast("timestamp"), "")).first()[0]
        target = f"{folder.rstrip('/')}/{name}"
        self._copied(target)
        return target

    def restore(self, snapshot: str) -> None:
        """The state of a snapshot of this store as its next version."""
        self.access.require("backup")
        old = Store.__new__(Store)
        old.spark, old.path, old._secret = self.spark, snapshot.rstrip("/"), self._secret
        m = old._manifest()
        if m is None:
            raise FileNotFoundError(snapshot)
        if m["check"] != _check(self._secret):
            raise KeyFormError("a snapshot under another key")
        fs, Path = self._fs()
        conf = self.spark._jsc.hadoopConfiguration()
        for f in [*m["documents"], *m["postings"], *m["terms"], *m["deleted"], m["namespaces"]]:
            if not fs.exists(Path(f"{self.path}/{f}")):
                src = Path(f"{old.path}/{f}")
                self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, fs, Path(f"{self.path}/{f}"), False, True, conf)
        self._publish(m | {"version": self._manifest()["version"]})

    def snapshots(self, folder: str) -> list[str]:
        """Newest first."""
        fs, Path = self._fs()
        stem = self.path.rsplit("/", 1)[-1]
        found = fs.globStatus(Path(f"{folder.rstrip('/')}/{stem}_*")) or []
        return sorted((s.getPath().toString() for s in found), reverse=True)


def _derived(key: str | None, salt: str | None) -> str | None:
    return hashlib.pbkdf2_hmac("sha256", key.encode(), bytes.fromhex(salt), 200_000).hex() if key else None


def _check(secret: str | None) -> str | None:
    """Tells keys apart and gives none of them away."""
    return hashlib.sha256(b"check" + bytes.fromhex(secret)).hexdigest() if secret else None


def encrypted(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Text columns as AES-encrypted bytes, by the SHA-256 of ``key``."""
    k = F.unhex(F.sha2(F.lit(checked_key(key)), 256))
    return df.withColumns({c: F.aes_encrypt(F.col(c), k) for c in columns})


def decrypted(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    k = F.unhex(F.sha2(F.lit(key), 256))
    return df.withColumns({c: F.aes_decrypt(F.col(c), k).cast("string") for c in columns})
