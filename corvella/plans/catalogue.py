"""The queries over the engine's own operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvella.functions import embed, text, vectors
from corvella.operators import dense, fusion, rank, sparse
from corvella.operators.eager import eager_join_aggregate, large_groups
from corvella.operators.filters import filtered
from corvella.plans.search import hybrid_search
from corvella.security import audit_events, key_roles, role_table
from corvella.session import scratch_dir
from corvella.sources import files, store
from corvella.streaming.live import operation_counts

#: The fixed queries; their vectors are those of ``embeddings`` with the same number.
ASKED = ((1, "wound sedation panel near the ward"), (2, "invoice export button workspace"), (3, "Klausel Rechnung Frist geprüft"))
NOW = 1_800_000_000.0


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def _docs(spark, d):
    return _read(spark, d, "documents")


def _asked(spark, d):
    q = spark.createDataFrame(ASKED, "qid bigint, text string")
    e = _read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("qid"), F.col("embedding").alias("vector"))
    return q.join(e, "qid", "left")


def _scores(df, *more):
    return df.select("qid", "doc_id", F.round("score", 6).alias("score"), *more)


def _dense(spark, d, k=160):
    return dense.dense_topk(_asked(spark, d).select("qid", "vector"), _docs(spark, d), k)


def _sparse(spark, d, k=160):
    return sparse.bm25_topk(_asked(spark, d), _docs(spark, d), k)


Q = {}
SQL = {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- parts of the SQL ---
_W = r"'[\p{L}\p{N}_]+'"
_V = ", ".join(f"({i}, '{t}')" for i, t in ASKED)
_TERMS = f"""q(qid, text) AS (VALUES {_V}),
terms AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {_W}) AS w FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM terms) GROUP BY doc_id, term),
cs AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM terms),
ts1 AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), cs),
ts AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM ts1) ELSE idf END AS idf FROM ts1)"""
_BM = f"""{_TERMS},
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM q) GROUP BY qid, term),
bs AS (SELECT qid, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN post USING (term) JOIN ts USING (term), cs GROUP BY qid, doc_id),
bp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS place FROM bs),
bm AS (SELECT * FROM bp WHERE place <= 160 AND score > 0)"""
_DN = """ds AS (SELECT q.qid, d.doc_id, list_inner_product(e.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM q JOIN embeddings e ON e.vec_id = q.qid, documents d WHERE len(d.embedding) = 64),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS place FROM ds) WHERE place <= 160)"""


def _mm(name, source, out):
    return f"""{name} AS (SELECT qid, doc_id, place, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END AS {out}
FROM {source} WINDOW w AS (PARTITION BY qid))"""


def _fused(alpha):
    return f"""{_BM}, {_DN}, {_mm("dm", "dn", "dense")}, {_mm("sm", "bm", "sparse")},
fj AS (SELECT coalesce(dm.qid, sm.qid) AS qid, coalesce(dm.doc_id, sm.doc_id) AS doc_id, dense, sparse, dm.place AS dp, sm.place AS sp FROM dm FULL OUTER JOIN sm ON dm.qid = sm.qid AND dm.doc_id = sm.doc_id),
fs AS (SELECT *, CASE WHEN count(sparse) OVER (PARTITION BY qid) > 0 THEN {alpha}::DOUBLE ELSE 1.0 END AS a FROM fj),
fc AS (SELECT qid, doc_id, dp, sp, a * coalesce(dense, 0) + (1 - a) * coalesce(sparse, 0) AS score FROM fs),
fu AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, dp ASC NULLS LAST, sp ASC NULLS LAST, doc_id) AS place FROM fc)"""


_JSON = "j AS (SELECT doc_id, namespace, created_at, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS m FROM documents)"
_NUM = "(CASE WHEN json_type(m, '$.year') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(m, '$.year')::DOUBLE END)"
_STR = "(CASE WHEN json_type(m, '$.status') = 'VARCHAR' THEN json_extract_string(m, '$.status') END)"


# --- text and statistics ---
@query(f"WITH {_TERMS} SELECT term, sum(tf)::BIGINT AS n FROM post GROUP BY term")
def tokenize_terms(spark, d):
    return sparse.postings(_docs(spark, d)).groupBy("term").agg(F.sum("tf").alias("n"))


@query(f"WITH {_TERMS} SELECT doc_id, term, tf FROM post")
def term_frequency(spark, d):
    return sparse.postings(_docs(spark, d)).select("doc_id", "term", "tf")


@query(f"WITH {_TERMS} SELECT doc_id, len(w)::BIGINT AS dl FROM terms")
def document_length(spark, d):
    return sparse.doc_terms(_docs(spark, d)).select("doc_id", "dl")


@query(f"WITH {_TERMS} SELECT n, round(avgdl, 6) AS avgdl FROM cs")
def corpus_statistics(spark, d):
    return sparse.corpus_stats(_docs(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM ts")
def bm25_idf(spark, d):
    return sparse.floored(sparse.term_stats(_docs(spark, d))).select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview, substr(text, 1, 500) AS shown FROM documents")
def strip_and_preview(spark, d):
    return _docs(spark, d).select("doc_id", text.stripped(F.col("text")).alias("text"), text.preview(F.col("text")).alias("preview"), F.substring("text", 1, 500).alias("shown"))


# --- retrieval ---
@query(f"WITH {_BM} SELECT qid, doc_id, round(score, 6) AS score, place FROM bm WHERE place <= 10")
def bm25_topk(spark, d):
    return _scores(_sparse(spark, d, 10), "place")


@query(
    f"""WITH {_BM.replace(f"q(qid, text) AS (VALUES {_V})", "q AS (SELECT item_id AS qid, text FROM eval_items)")}
SELECT qid, doc_id, round(score, 6) AS score, place FROM bm WHERE place <= 10"""
)
def bm25_topk_batch(spark, d):
    q = _read(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "text")
    return _scores(sparse.bm25_topk(q, _docs(spark, d), 10), "place")


@query(f"WITH q(qid, text) AS (VALUES {_V}), {_DN} SELECT qid, doc_id, round(score, 6) AS score, place FROM dn WHERE place <= 10")
def dense_topk(spark, d):
    return _scores(_dense(spark, d, 10), "place")


@query(f"WITH q AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 50 = 0), {_DN} SELECT qid, doc_id, round(score, 6) AS score, place FROM dn WHERE place <= 10")
def dense_topk_batch(spark, d):
    q = _read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return _scores(dense.dense_topk(q, _docs(spark, d), 10), "place")


@query("""WITH v AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents WHERE len(embedding) = 64), n AS (SELECT doc_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v)
SELECT doc_id, round(norm, 6) AS norm, round(CASE WHEN norm > 0 THEN e[1] / norm ELSE e[1] END, 6) AS first FROM n""")
def l2_normalize(spark, d):
    v = _docs(spark, d).where(vectors.fits(F.col("embedding"), 64))
    return v.select("doc_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.normalised(F.col("embedding"))[0], 6).alias("first"))


@query("SELECT (len(embedding) = 64) IS TRUE AS fits, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def vector_dimension_check(spark, d):
    return _docs(spark, d).groupBy(vectors.fits(F.col("embedding"), 64).alias("fits")).agg(F.count(F.lit(1)).alias("n"))


# --- fusion and search ---
@query(f"WITH q(qid, text) AS (VALUES {_V}), {_DN}, {_mm('dm', 'dn', 'dense')} SELECT qid, doc_id, round(dense, 6) AS scaled FROM dm")
def minmax_dense(spark, d):
    return fusion.minmax(_dense(spark, d)).select("qid", "doc_id", F.round("scaled", 6).alias("scaled"))


@query(f"WITH {_BM}, {_mm('sm', 'bm', 'sparse')} SELECT qid, doc_id, round(sparse, 6) AS scaled FROM sm")
def minmax_sparse(spark, d):
    return fusion.minmax(_sparse(spark, d)).select("qid", "doc_id", F.round("scaled", 6).alias("scaled"))


def _linear(alpha):
    def run(spark, d):
        return _scores(fusion.linear_fusion(_dense(spark, d), _sparse(spark, d), alpha))

    return run


for _name, _alpha in (("linear_fusion_a0", 0), ("linear_fusion_a05", 0.5), ("linear_fusion_a1", 1)):
    Q[_name] = _linear(_alpha)
    SQL[_name] = f"WITH {_fused(_alpha)} SELECT qid, doc_id, round(score, 6) AS score FROM fu"


@query(f"""WITH {_BM}, {_DN} SELECT coalesce(dn.qid, bm.qid) AS qid, coalesce(dn.doc_id, bm.doc_id) AS doc_id,
round(0.5 * coalesce(1.0 / (60 + dn.place), 0) + 0.5 * coalesce(1.0 / (60 + bm.place), 0), 6) AS score FROM dn FULL OUTER JOIN bm ON dn.qid = bm.qid AND dn.doc_id = bm.doc_id""")
def rrf_fusion(spark, d):
    return _scores(fusion.reciprocal_rank_fusion(_dense(spark, d), _sparse(spark, d)))


def _hybrid_sql(where="TRUE", alpha=0.5, score="score", extra=""):
    return f"""WITH {_fused(alpha)}, {_JSON},
h AS (SELECT fu.qid, fu.doc_id, fu.score, CASE WHEN created_at > 1e11 THEN created_at / 1000 ELSE created_at END AS t FROM fu JOIN j USING (doc_id) WHERE fu.place <= 40 AND {where}),
hs AS (SELECT qid, doc_id, {score} AS score FROM h)
SELECT qid, doc_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS place FROM hs) WHERE place <= 10"""


def _hybrid(**options):
    def run(spark, d):
        return _scores(hybrid_search(_asked(spark, d), _docs(spark, d), **options), "place")

    return run


_AGE = f"({NOW} - t)"
_RECENT = f"0.7 * score + 0.3 * (1 - {_AGE} / max({_AGE}) OVER (PARTITION BY qid))"
for _name, _options, _sql in (
    ("hybrid_search", {}, _hybrid_sql()),
    ("hybrid_search_a08", {"alpha": 0.8}, _hybrid_sql(alpha=0.8)),
    ("hybrid_search_namespace", {"namespace": "default"}, _hybrid_sql("namespace = 'default'")),
    ("hybrid_search_filtered", {"filters": {"year": {"gte": 2021}}}, _hybrid_sql(f"coalesce({_NUM} >= 2021, FALSE)")),
    ("hybrid_recency", {"recency_weight": 0.3, "now": NOW}, _hybrid_sql(score=_RECENT)),
    (
        "hybrid_prefilter",
        {"namespace": "default", "prefilter": True},
        _hybrid_sql().replace("FROM documents)", "FROM documents WHERE namespace = 'default')").replace("WHERE len(d.embedding) = 64", "WHERE d.namespace = 'default' AND len(d.embedding) = 64"),
    ),
):
    Q[_name], SQL[_name] = _hybrid(**_options), _sql
_OVERLAP = f"""(SELECT CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, regexp_extract_all(lower(coalesce(d.text, '')), {_W})))::DOUBLE / len(qw) ELSE 0.0 END
FROM documents d, (SELECT list_distinct(regexp_extract_all(lower(q.text), {_W})) AS qw FROM q WHERE q.qid = h.qid) WHERE d.doc_id = h.doc_id)"""
Q["hybrid_rerank"], SQL["hybrid_rerank"] = _hybrid(rerank=True), _hybrid_sql(score=_OVERLAP)
_MIRRORED = """hn AS (SELECT qid, doc_id, count(*) OVER (PARTITION BY qid) AS n, CASE WHEN sqrt(sum(score * score) OVER (PARTITION BY qid)) > 0 THEN score / sqrt(sum(score * score) OVER (PARTITION BY qid)) ELSE 1 / sqrt(count(*) OVER (PARTITION BY qid)) END AS a FROM h),
hs AS (SELECT qid, doc_id, CASE WHEN n > 1 AND greatest(1, floor(pi() / (4 * asin(1 / sqrt(n)))))::BIGINT % 2 = 1 THEN 2 * avg(a) OVER (PARTITION BY qid) - a ELSE a END AS score FROM hn)"""
Q["hybrid_reflection"], SQL["hybrid_reflection"] = _hybrid(reflection=True), _hybrid_sql().replace("hs AS (SELECT qid, doc_id, score AS score FROM h)", _MIRRORED)


def _all_asked(spark, d):
    """Every document whose id is divisible by 50 asks with its whole text, and the vector of that number."""
    q = _docs(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "text")
    return q.join(_read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("qid"), F.col("embedding").alias("vector")), "qid", "left")


def _over_all(sql):
    return sql.replace(f"q(qid, text) AS (VALUES {_V})", "q AS (SELECT doc_id AS qid, text FROM documents WHERE doc_id % 50 = 0)")


@query(_over_all(_hybrid_sql()))
def hybrid_search_batch(spark, d):
    return _scores(hybrid_search(_all_asked(spark, d), _docs(spark, d)), "place")


@query(_over_all(SQL["hybrid_rerank"]))
def hybrid_rerank_batch(spark, d):
    return _scores(hybrid_search(_all_asked(spark, d), _docs(spark, d), rerank=True), "place")


@query(_over_all(SQL["rrf_fusion"]))
def rrf_fusion_batch(spark, d):
    q = _all_asked(spark, d)
    found = dense.dense_topk(q.select("qid", "vector"), _docs(spark, d), 160), sparse.bm25_topk(q.select("qid", "text"), _docs(spark, d), 160)
    return _scores(fusion.reciprocal_rank_fusion(*found))


@query(f"WITH {_BM.replace(_V, '(1, ' + chr(39) + 'zzzqqq' + chr(39) + ')')}, {_DN}, {_mm('dm', 'dn', 'dense')} SELECT qid, doc_id, round(dense, 6) AS score FROM dm")
def hybrid_no_sparse_hits(spark, d):
    q = _asked(spark, d).where("qid = 1").withColumn("text", F.lit("zzzqqq"))
    docs = _docs(spark, d)
    return _scores(fusion.linear_fusion(dense.dense_topk(q.select("qid", "vector"), docs, 160), sparse.bm25_topk(q, docs, 160), 0.5))


# --- metadata predicates ---
def _filter(filters):
    return lambda spark, d: filtered(_docs(spark, d), filters).select("doc_id")


_HAS = "json_exists(m, '$.status')"
for _name, _filters, _where in (
    ("filter_eq", {"year": 2024}, f"{_NUM} = 2024"),
    ("filter_eq_text", {"status": "draft"}, f"{_STR} = 'draft'"),
    ("filter_eq_null", {"status": None}, "json_type(m, '$.status') = 'NULL'"),
    ("filter_gte", {"year": {"gte": 2024}}, f"{_NUM} >= 2024"),
    ("filter_lte", {"year": {"lte": 2021}}, f"{_NUM} <= 2021"),
    ("filter_gt_lt", {"year": {"gt": 2020, "lt": 2023}}, f"{_NUM} > 2020 AND {_NUM} < 2023"),
    ("filter_text_order", {"status": {"gte": "d"}}, f"{_STR} >= 'd'"),
    ("filter_in", {"status": {"in": ["draft", "open"]}}, f"{_STR} IN ('draft', 'open')"),
    ("filter_in_text", {"status": {"in": "draft or open"}}, f"contains('draft or open', {_STR})"),
    ("filter_not_in", {"status": {"not_in": ["draft", "open"]}}, f"{_HAS} AND coalesce({_STR} NOT IN ('draft', 'open'), TRUE)"),
    ("filter_ne", {"status": {"ne": "draft"}}, f"{_HAS} AND coalesce({_STR} <> 'draft', TRUE)"),
    ("filter_combined", {"year": {"gte": 2022}, "status": "open"}, f"{_NUM} >= 2022 AND {_STR} = 'open'"),
    ("filter_missing_key", {"no_such_key": 1}, "FALSE"),
    ("filter_exists", {"status": {}}, _HAS),
    ("filter_unknown_op", {"status": {"eq": "closed"}}, f"{_STR} = 'closed'"),
):
    Q[_name] = _filter(_filters)
    SQL[_name] = f"WITH {_JSON} SELECT doc_id FROM j WHERE {_where}"

# --- reranking ---
_AMP = f"""{_BM}, am AS (SELECT qid, doc_id, score, count(*) OVER w AS n, CASE WHEN sqrt(sum(score * score) OVER w) > 0 THEN score / sqrt(sum(score * score) OVER w) ELSE 1 / sqrt(count(*) OVER w) END AS a,
sqrt(sum(score * score) OVER w) AS norm FROM bm WHERE place <= %K% WINDOW w AS (PARTITION BY qid))"""


@query(f"WITH {_AMP.replace("%K%", str(40))} SELECT qid, doc_id, round(a, 6) AS amplitude FROM am")
def amplitude_encode(spark, d):
    return rank.amplitude_encode(_sparse(spark, d, 40)).select("qid", "doc_id", F.round("amplitude", 6).alias("amplitude"))


@query(f"WITH {_AMP.replace("%K%", str(40))} SELECT qid, doc_id, round(a * 2, 6) AS score FROM am")
def amplitude_decode(spark, d):
    return _scores(rank.amplitude_decode(rank.amplitude_encode(_sparse(spark, d, 40)).drop("score"), F.lit(2.0)))


@query("SELECT n::BIGINT AS n, CASE WHEN n <= 1 THEN 1 ELSE greatest(1, floor(pi() / (4 * asin(1 / sqrt(n)))))::BIGINT END AS iterations FROM range(1, 1001) t(n)")
def best_iterations(spark, d):
    return spark.range(1, 1001).select(F.col("id").alias("n"), rank.best_iterations(F.col("id")).alias("iterations"))


_MIRROR = "2 * avg(a) OVER (PARTITION BY qid) - a"


@query(f"WITH {_AMP.replace("%K%", str(20))} SELECT qid, doc_id, round(CASE WHEN n > 1 THEN {_MIRROR} ELSE a END, 6) AS amplitude FROM am")
def reflect_odd(spark, d):
    return rank.reflect(rank.amplitude_encode(_sparse(spark, d, 20)), 3).select("qid", "doc_id", F.round("amplitude", 6).alias("amplitude"))


@query(f"WITH {_AMP.replace("%K%", str(20))} SELECT qid, doc_id, round(a, 6) AS amplitude FROM am")
def reflect_even(spark, d):
    return rank.reflect(rank.amplitude_encode(_sparse(spark, d, 20)), 4).select("qid", "doc_id", F.round("amplitude", 6).alias("amplitude"))


def _reflected_sql(window, top):
    return f"""WITH {_AMP.replace("%K%", str(window))}, it AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE greatest(1, floor(pi() / (4 * asin(1 / sqrt(n)))))::BIGINT END AS k FROM am),
rf AS (SELECT qid, doc_id, CASE WHEN n > 1 AND k % 2 = 1 THEN {_MIRROR} ELSE a END AS score FROM it)
SELECT qid, doc_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS place FROM rf) WHERE place <= {top}"""


@query(_reflected_sql(160, 10))
def reflection_rerank(spark, d):
    return _scores(rank.reflection_rerank(_sparse(spark, d), 10), "place")


@query(_reflected_sql(20, 5))
def reflection_windowed(spark, d):
    return _scores(rank.reflection_rerank(_sparse(spark, d), 5, window=20), "place")


# --- storage ---
@query("SELECT count(*)::BIGINT AS n FROM documents")
def count_all(spark, d):
    return store.counted(_docs(spark, d))


@query("SELECT n.name AS namespace, count(d.doc_id)::BIGINT AS documents FROM vault_namespaces n LEFT JOIN documents d ON d.namespace = n.name GROUP BY n.name")
def namespace_counts(spark, d):
    return store.namespace_counts(_read(spark, d, "vault_namespaces"), _docs(spark, d))


@query("SELECT DISTINCT name FROM vault_namespaces")
def list_namespaces(spark, d):
    return store.listed(_read(spark, d, "vault_namespaces"))


@query("SELECT doc_id, text FROM documents WHERE namespace = 'default' ORDER BY created_at, doc_id LIMIT 20 OFFSET 10")
def namespace_page(spark, d):
    return store.page(_docs(spark, d), "default", 20, 10).select("doc_id", "text")


@query("SELECT doc_id, text, namespace FROM documents WHERE doc_id = 17")
def get_doc(spark, d):
    return store.by_id(_docs(spark, d), 17).select("doc_id", "text", "namespace")


@query("""SELECT count(*)::BIGINT AS documents, count(*) FILTER (len(embedding) = 64)::BIGINT AS index_vectors, count(text)::BIGINT AS bm25_documents,
(SELECT count(DISTINCT name) FROM vault_namespaces)::BIGINT AS namespaces FROM documents""")
def store_stats(spark, d):
    s = store.summary(_read(spark, d, "vault_namespaces"), _docs(spark, d), 64)
    return s.select("documents", "index_vectors", "bm25_documents", F.size("namespaces").cast("long").alias("namespaces"))


@query("""SELECT n.name AS namespace, count(d.doc_id)::BIGINT AS documents FROM vault_namespaces n LEFT JOIN documents d ON d.namespace = n.name GROUP BY n.name""")
def store_stats_by_namespace(spark, d):
    s = store.summary(_read(spark, d, "vault_namespaces"), _docs(spark, d), 64)
    return s.select(F.explode("namespace_counts").alias("namespace", "documents"))


@query("SELECT doc_id, created_at FROM documents WHERE namespace = 'default'")
def namespace_scan(spark, d):
    return store.scan(_docs(spark, d), "default").select("doc_id", "created_at")


def _opened(spark, d):
    """A store of all documents in the scratch folder."""
    s = store.Store(spark, f"{scratch_dir(spark)}/vault-{uuid.uuid4().hex}", audit=False)
    s.add_all(_docs(spark, d).select(F.col("doc_id").cast("string"), "text", "metadata_json", F.coalesce("namespace", F.lit("none")).alias("namespace")))
    return s


@query("""SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, coalesce(namespace, 'none') AS namespace, coalesce(metadata_json, '{}') AS metadata_json FROM documents WHERE doc_id <> 17""")
def store_insert_delete(spark, d):
    s = _opened(spark, d)
    s.delete("17")
    return s.documents.select("doc_id", "text", "namespace", "metadata_json")


@query(f"WITH {_BM} SELECT qid, round(score, 6) AS score, place FROM bm WHERE place <= 10")
def bm25_stored_index(spark, d):
    """By the postings and statistics that a store has written."""
    return _scores(sparse.bm25_topk(_asked(spark, d), _opened(spark, d).index(), 10), "place").drop("doc_id")


@query("SELECT doc_id, namespace FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM audit_log WHERE lower(operation) = 'delete' AND doc_id IS NOT NULL)")
def delete_docs(spark, d):
    gone = _read(spark, d, "audit_log").where("lower(operation) = 'delete' and doc_id is not null").select("doc_id").distinct()
    return store.without(_docs(spark, d), gone).select("doc_id", "namespace")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM audit_log WHERE lower(operation) = 'add')")
def insert_dup_check(spark, d):
    new = _read(spark, d, "audit_log").where("lower(operation) = 'add'").select("doc_id").distinct()
    return store.duplicate_ids(new, _docs(spark, d))


@query("SELECT doc_id, text, metadata_json, namespace, modality, created_at FROM documents")
def export_documents(spark, d):
    return store.exported(_docs(spark, d))


_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ENDS = ", ".join(f"nullif(length(regexp_extract(v, '(?s)^(.+)' || {m}, 1)), 0) + {n}" for m, n in (("chr(10) || chr(10)", 2), ("chr(10)", 1), (r"'\. '", 2), ("'! '", 2), (r"'\? '", 2)))


def chunk_sql(table, key, where="TRUE"):
    """The windows of the chunker over a table's texts: ``(key, chunk_index, char_start, char_end, text)``."""
    full = _BLANK.replace("[", "[^", 1)
    return rf"""WITH RECURSIVE t AS (SELECT {key}, text, length(text)::BIGINT AS n FROM {table} WHERE regexp_matches(text, '{full}') AND {where}),
w AS (SELECT {key}, text, n, 0::BIGINT AS a, -1::BIGINT AS f, 0::BIGINT AS i, []::BIGINT[] AS blanks, NULL::BIGINT AS z, NULL::VARCHAR AS piece FROM t UNION ALL
SELECT {key}, text, n, CASE WHEN NOT ok AND list_contains(blanks, a) THEN z WHEN z - 200 > CASE WHEN ok THEN a ELSE f END AND (ok OR f >= 0) THEN z - 200 ELSE z END, CASE WHEN ok THEN a ELSE f END, i + ok::BIGINT, CASE WHEN ok THEN [] ELSE list_append(blanks, a) END, z, CASE WHEN ok THEN s END
FROM (SELECT *, regexp_matches(s, '{full}') AS ok FROM (SELECT *, substr(text, a + 1, z - a) AS s FROM (SELECT *, CASE WHEN a + 1000 >= n THEN a + 1000 ELSE a + coalesce({_ENDS}, 1000) END AS z
FROM (SELECT {key}, text, n, a, f, i, blanks, substr(text, a + 1, 1000) AS v FROM w WHERE a < n)))))
SELECT {key}, i - 1 AS chunk_index, f AS char_start, z AS char_end, regexp_replace(piece, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS text FROM w WHERE piece IS NOT NULL"""


@query(chunk_sql("documents", "doc_id"))
def chunk_documents(spark, d):
    return files.chunk_documents(_docs(spark, d))


@query("SELECT count(*)::BIGINT AS chunks, sum(length(text))::BIGINT AS chars FROM ingest_chunks")
def ingest_totals(spark, d):
    return store.batch_totals(_read(spark, d, "ingest_chunks")).select(F.col("count").alias("chunks"), "chars")


@query()
def html_extract(spark, d):
    return _docs(spark, d).select("doc_id", files.html_to_text(F.col("text")).alias("text"))


_EXT = "lower(regexp_extract(file_path, '[^/.](\\.[^./\\\\]+)$', 1))"


@query(f"SELECT file_id, seen_at, {_EXT} AS suffix, {_EXT} IN ('.docx', '.htm', '.html', '.md', '.pdf', '.txt') AS supported FROM source_files")
def ext_routing(spark, d):
    ext = text.extension(F.col("file_path"))
    return _read(spark, d, "source_files").select("file_id", "seen_at", ext.alias("suffix"), ext.isin(*files.SUPPORTED).alias("supported"))


@query(f"SELECT file_id, seen_at, CASE WHEN n_chars IS NOT NULL AND {_EXT} IN ('.bmp', '.gif', '.jpeg', '.jpg', '.png', '.tiff', '.webp') THEN 'image' WHEN n_chars IS NOT NULL AND {_EXT} IN ('.flac', '.m4a', '.mp3', '.ogg', '.wav', '.webm') THEN 'audio' ELSE 'text' END AS modality FROM source_files")
def modality_detect(spark, d):
    return _read(spark, d, "source_files").select("file_id", "seen_at", text.modality(F.col("file_path"), F.col("n_chars").isNotNull()).alias("modality"))


@query("SELECT chunk_id, sha256(text) AS sha256 FROM ingest_chunks")
def file_digest(spark, d):
    """Of the contents of files, for which the chunks' texts stand."""
    f = _read(spark, d, "ingest_chunks").select(F.col("chunk_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return files.file_digests(f).withColumnRenamed("path", "chunk_id")


@query(f"""WITH {_TERMS}, b AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::BIGINT AS bucket, sum(tf) AS c FROM post GROUP BY 1, 2)
SELECT doc_id, bucket, round((c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS weight FROM b""")
def hash_embed(spark, d):
    v = _docs(spark, d).select("doc_id", embed.hash_embedding(F.col("text"), 64).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("bucket", "weight")).where("weight > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


# --- control ---
@query("SELECT r AS role, unnest(p) AS permission FROM (VALUES ('admin', ['read', 'write', 'delete', 'create_namespace', 'manage_keys', 'backup']), ('read-write', ['read', 'write', 'delete']), ('read-only', ['read'])) t(r, p)")
def role_permissions(spark, d):
    return role_table(spark)


@query("SELECT key_id, CASE WHEN lower(role_name) IN ('admin', 'read-write', 'read-only') THEN lower(role_name) ELSE 'read-only' END AS role FROM access_keys")
def resolved_roles(spark, d):
    return key_roles(_read(spark, d, "access_keys"))


@query("SELECT audit_id, CASE WHEN actor IS NULL OR actor = '' THEN 'local-admin' WHEN length(actor) <= 8 THEN '***' ELSE substr(actor, 1, 8) || '...' END AS label FROM audit_log")
def key_labels(spark, d):
    return _read(spark, d, "audit_log").select("audit_id", text.key_label(F.col("actor")).alias("label"))


@query("SELECT audit_id, actor FROM audit_log WHERE operation = 'search' AND ts >= TIMESTAMP '2024-06-01'")
def audit_read(spark, d):
    log = _read(spark, d, "audit_log").withColumn("timestamp", F.col("ts").cast("timestamp").cast("double"))
    return audit_events(log, since=1717200000.0, operation="search").select("audit_id", "actor")


@query("SELECT date_trunc('hour', ts) AS window_start, lower(operation) AS operation, count(*)::BIGINT AS events FROM (SELECT DISTINCT ON (audit_id) * FROM audit_log) GROUP BY 1, 2")
def audit_by_hour(spark, d):
    return operation_counts(_read(spark, d, "audit_log"))


# --- large groups ---
@query("SELECT namespace FROM documents WHERE namespace IS NOT NULL GROUP BY namespace HAVING count(*) >= 0.04 * (SELECT count(*) FROM documents)")
def p4_found(spark, d):
    return large_groups(_docs(spark, d), _read(spark, d, "vault_namespaces"), 0.04).select("namespace")


@query("""SELECT d.namespace, count(*)::BIGINT AS joined_rows, sum(n_chars)::BIGINT AS chars, count(n_chars)::BIGINT AS sized,
count(audit_id)::BIGINT AS operations, max(d.doc_id) AS last_doc, min(audit_id) AS first_audit FROM documents d JOIN audit_log a ON a.namespace = d.namespace GROUP BY d.namespace""")
def p4_activity(spark, d):
    """Joined rows, and sums over them, of each namespace's documents and operations."""
    return eager_join_aggregate(
        _docs(spark, d),
        _read(spark, d, "audit_log"),
        [("namespace", "namespace")],
        group_left=["namespace"],
        rows="joined_rows",
        measures={
            "chars": ("left", "sum", "n_chars"),
            "sized": ("left", "count", "n_chars"),
            "operations": ("right", "count", "audit_id"),
            "last_doc": ("left", "max", "doc_id"),
            "first_audit": ("right", "min", "audit_id"),
        },
    )


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
