import math

import pytest
from pyspark.sql import functions as F

from corvella.operators import dense, fusion, rank, sparse
from corvella.operators.filters import filtered
from corvella.plans.search import hybrid_search

CORPUS = ["the patient was given insulin for diabetes", "patient chart updated on ward", "law of contract renewal"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")


def okapi(texts, query):
    import re

    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    n, avg = len(words), sum(map(len, words)) / len(words)
    df = {t: sum(t in w for w in words) for w in words for t in w}
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in re.findall(r"\w+", query.lower())) for w in words]


@pytest.mark.parametrize("query", ["diabetes", "diabetes patient", "patient patient", "nothing here"])
def test_bm25_against_brute_force(spark, query):
    texts = [*CORPUS, None, ""]
    got = {r.doc_id: r.score for r in sparse.bm25_scores(asked(spark, query), docs(spark, texts)).collect()}
    for i, s in enumerate(okapi(texts, query)):
        assert math.isclose(got.get(i, 0), s, abs_tol=1e-9)


def test_bm25_empty(spark):
    assert sparse.bm25_topk(asked(spark, "a"), docs(spark, []), 5).count() == 0
    assert sparse.bm25_topk(asked(spark, ""), docs(spark, CORPUS), 5).count() == 0
    assert sparse.bm25_topk(asked(spark, "b"), docs(spark, ["a b", "c d"]), 5).count() == 0


def test_dense_ties_nulls_and_lengths(spark):
    rows = [(5, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (6, [1.0]), (7, [None, 1.0])]
    d = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid bigint, vector array<float>")
    got = [(r.qid, r.doc_id, r.place) for r in dense.dense_topk(q, d, 3, 2).orderBy("place").collect()]
    assert got == [(1, 2, 1), (1, 5, 2), (1, 3, 3)]
    assert dense.dense_topk(q, d, 0, 2).count() == 0
    assert dense.dense_topk(q, d.limit(0), 3, 2).count() == 0
    assert dense.dense_topk(q, d, 3, 2, most_bytes=1).count() == 3


def hits(spark, rows):
    return spark.createDataFrame([(1, i, float(s), p) for p, (i, s) in enumerate(rows, 1)], "qid bigint, doc_id bigint, score double, place bigint")


@pytest.mark.parametrize(
    ("alpha", "want"),
    [(0.0, {2: 1, 0: 0.5, 5: 0, 3: 0}), (0.5, {0: 0.75, 2: 0.75, 5: 0, 3: 0}), (0.7, {0: 0.85, 2: 0.65, 5: 0, 3: 0}), (1.0, {0: 1, 2: 0.5, 5: 0, 3: 0})],
)
def test_linear_fusion(spark, alpha, want):
    d, s = hits(spark, [(0, 0.9), (2, 0.7), (5, 0.5)]), hits(spark, [(2, 5), (0, 3), (3, 1)])
    got = {r.doc_id: r.score for r in fusion.linear_fusion(d, s, alpha).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())


def test_fusion_of_few(spark):
    d, none = hits(spark, [(0, 0.9), (2, 0.7), (5, 0.5)]), hits(spark, [])
    assert {r.doc_id: round(r.score, 6) for r in fusion.linear_fusion(d, none, 0.3).collect()} == {0: 1, 2: 0.5, 5: 0}
    assert {r.doc_id: r.score for r in fusion.linear_fusion(hits(spark, [(0, 0.8)]), none, 0.3).collect()} == {0: 0.0}
    got = {r.doc_id: round(r.score, 6) for r in fusion.reciprocal_rank_fusion(d, hits(spark, [(2, 5), (0, 3), (3, 1)]), 0.5).collect()}
    assert got == {0: 0.016261, 2: 0.016261, 5: 0.007937, 3: 0.007937}


def test_reranking(spark):
    h = hits(spark, [(1, 0.9), (2, 0.3), (3, 0.1), (4, 0.7)])
    got = [(r.doc_id, round(r.score, 6)) for r in rank.reflection_rerank(h, 4).orderBy("place").collect()]
    assert got == [(3, 0.760639), (2, 0.591608), (4, 0.253546), (1, 0.084515)]
    zero = hits(spark, [(1, 0.0), (2, 0.0)])
    assert [round(r.amplitude, 6) for r in rank.amplitude_encode(zero).collect()] == [0.707107] * 2


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({"year": 2024}, [1, 6]), ({"year": "2024"}, [2]), ({"year": {"gte": 2024}}, [1, 6]), ({"s": {"in": "xab"}}, [1]), ({"s": {"not_in": ["ab"]}}, [2]),
        ({"s": {"ne": "ab"}}, [2]), ({"s": None}, [2]), ({"flag": 1}, [1]), ({"flag": True}, [1]), ({"none": 1}, []), ({"s": {}}, [1, 2]), ({"year": {"eq": 2024}}, [1, 6]), ({}, [1, 2, 3, 4, 5, 6]),
    ],
)
def test_filters(spark, filters, want):
    rows = [(1, '{"year": 2024, "s": "ab", "flag": true}'), (2, '{"year": "2024", "s": null}'), (3, None), (4, '{"year": 20'), (5, "{}"), (6, '{"year": 2024.0}')]
    d = spark.createDataFrame(rows, "id int, metadata_json string")
    assert sorted(r.id for r in filtered(d, filters).collect()) == want


def test_hybrid_post_and_prefilter(spark):
    rows = [(i, f"word{i} common text", [1.0 - i / 100, i / 100], "{}", "a" if i < 50 else "b", "text", float(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, embedding array<float>, metadata_json string, namespace string, modality string, created_at double")
    q = spark.createDataFrame([(1, "common", [1.0, 0.0])], "qid bigint, text string, vector array<float>")
    assert hybrid_search(q, d, 2, 1.0, namespace="b", dim=2).count() == 0
    assert hybrid_search(q, d, 2, 1.0, namespace="b", dim=2, prefilter=True).count() == 2
    with pytest.raises(Exception, match="alpha"):
        hybrid_search(q, d, 2, float("nan"))


def shuffled(spark, df):
    """Rows of ``df``, and how many were shuffled for them."""
    sc = spark.sparkContext
    sc.setJobGroup(group := f"shuffled-{id(df)}", "")
    rows = df.collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setJobGroup("", "")
    return rows, sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_bm25_topk_shuffles_no_row_a_query_and_document(spark):
    texts = [f"ward w{i % 7} w{i % 5} w{i % 3} own{i}" for i in range(300)] + ["other"] * 400
    q = asked(spark, *texts[:300])
    rows, n = shuffled(spark, sparse.bm25_topk(q, docs(spark, texts).repartition(4), 3))
    assert len(rows) == 900 and n <= 4 * 900 + 5000
    for i in (0, 17, 299):
        best = sorted(((-round(s, 9), j) for j, s in enumerate(okapi(texts, texts[i]))))[:3]
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.place) if r.qid == i] == [j for _, j in best]


def test_bm25_topk_blocks_slices_and_ids_of_any_kind(spark):
    texts = [*(f"a b{i % 3} c{i % 4} c{i % 4} d{i // 2}" for i in range(40)), None, "", *["x"] * 60]
    q = spark.createDataFrame([("one", "a b1 c2 c2 d3"), ("two", "d7 zzz d7"), ("none", "zzz")], "qid string, text string")
    d = docs(spark, texts).selectExpr("lpad(doc_id, 3, '0') AS doc_id", "text")
    want = [(qid, f"{j:03}", p) for qid, t in (("one", "a b1 c2 c2 d3"), ("two", "d7 d7")) for p, (s, j) in enumerate(sorted((-round(s, 9), j) for j, s in enumerate(okapi(texts, t)))[:5], 1) if s < 0]
    for options in ({}, {"most_bytes": 100}):
        got = sparse.bm25_topk(q, d, 5, **options).collect()
        assert sorted((r.qid, r.doc_id, r.place) for r in got) == sorted(want)
    index = sparse.indexed(docs(spark, texts))
    known = sparse._weighed(sparse._asked(q, None), index, lambda x: x).selectExpr("qid", "term", "times * idf AS weight")
    for dense_share in (0, 10**9):
        found = sparse._pass(known, sparse.doc_terms(d).select("doc_id", "terms"), 5, sparse._avgdl(index), rows=1, width=3, dense=dense_share, pairs=2)
        assert sorted((r.qid, r.doc_id, r.place) for r in sparse.ranked(found, 5).collect()) == sorted(want)


def test_hybrid_search_of_all_documents_shuffles_no_row_a_query_and_document(spark):
    texts = [f"ward w{i % 7} own{i}" for i in range(300)]
    d = docs(spark, texts).selectExpr("*", "'{}' AS metadata_json", "'a' AS namespace", "'text' AS modality", "1.0D AS created_at", "array(1.0F, float(doc_id)) AS embedding").repartition(4)
    q = d.selectExpr("doc_id AS qid", "text", "CASE WHEN doc_id < 2 THEN embedding END AS vector")
    rows, n = shuffled(spark, hybrid_search(q, d, 1, 0.25, dim=2))
    assert n <= 45_000  # one for each query and document is 90,000
    assert [(r.qid, r.doc_id) for r in sorted(rows)] == [(i, i) for i in range(300)]


def test_reciprocal_ranks_of_all_documents_shuffle_no_row_a_query_and_document(spark):
    texts = [f"ward w{i % 7} own{i}" for i in range(300)]
    d = docs(spark, texts).withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double"))).repartition(4)
    q = d.selectExpr("doc_id AS qid", "text", "CASE WHEN doc_id = 7 THEN embedding END AS vector")
    found = dense.dense_topk(q.select("qid", "vector"), d, 4, 2), sparse.bm25_topk(q.select("qid", "text"), d, 4)
    rows, n = shuffled(spark, fusion.reciprocal_rank_fusion(*found))
    assert n <= 45_000  # one for each query and document is 90,000
    best = {r.qid: (r.doc_id, round(r.score, 9)) for r in rows if r.place == 1}
    assert best == {i: (299 if i == 7 else i, round(0.5 / 61, 9)) for i in range(300)}  # a tie of 299 and 7 goes to the dense side
    assert {r.doc_id for r in rows if r.qid == 7} >= {299, 298, 297, 296, 7}
