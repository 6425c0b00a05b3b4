"""The llm queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvella.llm import chunks, leakage, mixture, neardup, pii, spam, vamana
from corvella.plans.catalogue import chunk_sql
from corvella.session import staged


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_groups(spark, d):
    return neardup.near_duplicates(_read(spark, d, "documents"))


def p1_found(spark, d):
    return neardup.group_pairs(neardup.near_groups(_read(spark, d, "documents"), width=3, threshold=0.5, bands=64, rows=4))


def p2_found(spark, d):
    return pii.personal_items(_read(spark, d, "documents")).select("doc_id", "field", "kind", "start_pos")


def p2_redacted(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "text", "metadata_json")
    return pii.redacted(docs, key=b"corvella test key")


def p2_kept_words(spark, d):
    """By kind, how many stand-ins hold a word or number of their item: none."""
    items = staged(pii.personal_items(_read(spark, d, "documents")), "items")
    return pii.kept_words(items, pii.surrogates(items, b"corvella test key"))


def p3_found(spark, d):
    pieces = chunks.split_oversized(_read(spark, d, "ingest_chunks"), method="separators")
    return pieces.select("chunk_id", "piece_index", "char_start", "char_end")


def p3_valleys(spark, d):
    return chunks.split_oversized(_read(spark, d, "ingest_chunks"), method="valleys")


def p3_valley_cover(spark, d):
    """Of each record that is cut: where its pieces begin and end, and whether all are within the size and overlap as they should."""
    p = chunks.split_oversized(_read(spark, d, "ingest_chunks"), method="valleys")
    before = F.lag("char_end").over(Window.partitionBy("chunk_id").orderBy("char_start"))
    p = p.withColumn("gap", before - F.col("char_start"))
    right = F.every((F.col("char_end") - F.col("char_start") <= 1000) & (F.length("text") <= 1000) & (F.coalesce("gap", F.lit(200)) == 200))
    return p.groupBy("chunk_id").agg(F.min("char_start").alias("first_start"), F.max("char_end").alias("last_end"), right.alias("within"))


def p5_found(spark, d):
    return vamana.similar_pairs(vamana.similar_vectors(_read(spark, d, "documents")))


def p5_neighbours(spark, d):
    """The rows whose id is divisible by 50 against all shards, of whatever similarity."""
    found = vamana.similar_vectors(_read(spark, d, "documents"), query_every=50, each_shard=True, beam=64, shard_size=16_384)
    return found.select("id", "neighbour", F.round("similarity", 5).alias("similarity"))


def p6_found(spark, d):
    return leakage.leaked_items(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p6_coverage(spark, d):
    """Also passages that stand in pieces or another order: seeds and tiles of five words, coverage alone decides."""
    found = leakage.leaked_items(_read(spark, d, "documents"), _read(spark, d, "eval_items"), seed_words=5)
    return found.where("coverage >= 0.5")


def p6_whole(spark, d):
    """Items that stand in a document from their first to their last word."""
    found = leakage.leaked_items(_read(spark, d, "documents"), _read(spark, d, "eval_items"))
    return found.where("longest = item_words").select("doc_id", "item_id", "item_words").distinct()


def p7_found(spark, d):
    counted = mixture.counted_documents(_read(spark, d, "documents"))
    return mixture.plan_mix(counted, _read(spark, d, "mix_targets"))[1].where("misses").select("source")


def p7_sample(spark, d):
    return mixture.mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    return mixture.mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[1]


def p7_reached(spark, d):
    """Whether each source of the targets comes within one per cent, or 2,000 tokens, of what it was planned to give."""
    report = mixture.mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[1]
    return report.select("source", (F.abs(F.col("reached_tokens") - F.col("planned_tokens")) <= F.greatest(F.lit(2000.0), 0.01 * F.col("planned_tokens"))).alias("reached"))


def p8_found(spark, d):
    return spam.spam_pages(_read(spark, d, "documents")).where("spam").select("doc_id")


def p8_scores(spark, d):
    return spam.spam_pages(_read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_PLAIN = "regexp_extract_all(strip_accents(replace(lower(regexp_replace(text, '[\\x{00AD}\\x{200B}]', '', 'g')), 'ß', 'ss')), '[\\p{L}\\p{N}]+')"

SQL = {
    "p1_found": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 2 * c >= x.n + y.n - c),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT DISTINCT x AS doc_a, y AS doc_b FROM r WHERE x < y""",
    "p1_groups": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k, count(*) AS n FROM s GROUP BY doc_id), o AS (SELECT k, min(doc_id) AS o, any_value(n) AS n FROM k GROUP BY k),
t AS (SELECT o, g, n FROM o JOIN s ON s.doc_id = o.o), c AS (SELECT a.o AS a, b.o AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.o <> b.o GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE c >= 0.8 * (x + y - c)), r AS (SELECT o AS x, o AS y FROM o UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
m AS (SELECT x, min(y) AS root FROM r GROUP BY x), d AS (SELECT k.doc_id, m.root, coalesce(e.links, 0) AS links FROM k JOIN o USING (k) JOIN m ON m.x = o.o LEFT JOIN (SELECT a, count(*) AS links FROM l GROUP BY a) e ON e.a = o.o)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS group_id, links::BIGINT AS links FROM d QUALIFY count(*) OVER (PARTITION BY root) > 1""",
    "p2_kept_words": "SELECT unnest(['address', 'email', 'id_number', 'name', 'phone']) AS kind, 0::BIGINT AS kept",
    "p3_found": f"SELECT chunk_id, chunk_index AS piece_index, char_start, char_end FROM ({chunk_sql('ingest_chunks', 'chunk_id', 'length(text) > 1000')})",
    "p3_valley_cover": r"SELECT chunk_id, 0::BIGINT AS first_start, length(text)::BIGINT AS last_end, TRUE AS within FROM ingest_chunks WHERE length(text) > 1000 AND regexp_matches(text, '\S')",
    "p5_neighbours": """WITH v AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents WHERE len(embedding) = 64), u AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0),
t AS (SELECT a.doc_id AS id, b.doc_id AS neighbour, list_cosine_similarity(a.e, b.e) AS s FROM u a JOIN u b ON a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0)
SELECT id, neighbour, round(s, 5) AS similarity FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 6) DESC, neighbour) <= 5""",
    "p5_found": """WITH v AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents WHERE len(embedding) = 64), u AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0),
t AS (SELECT a.doc_id AS x, b.doc_id AS y, list_cosine_similarity(a.e, b.e) AS s FROM u a JOIN u b ON a.doc_id <> b.doc_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS p FROM t) WHERE p <= 5 AND s >= 0.8)
SELECT DISTINCT least(x, y) AS doc_a, greatest(x, y) AS doc_b FROM k""",
    "p6_found": f"""WITH i AS (SELECT item_id, {_PLAIN} AS w FROM eval_items), n AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
d AS (SELECT doc_id, {_PLAIN} AS w FROM documents WHERE text IS NOT NULL), m AS (SELECT DISTINCT n FROM n),
h AS (SELECT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, m))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (n, g)""",
    "p6_whole": f"""WITH i AS (SELECT item_id, {_PLAIN} AS w FROM eval_items), d AS (SELECT doc_id, ' ' || array_to_string({_PLAIN}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, item_id, len(w)::BIGINT AS item_words FROM d JOIN i ON len(w) > 0 AND contains(t, ' ' || array_to_string(w, ' ') || ' ')""",
    "p7_reached": "SELECT DISTINCT source, TRUE AS reached FROM mix_targets",
    "p7_found": """WITH t AS (SELECT source, sum(length(text)) AS c FROM documents GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN t USING (source) WHERE coalesce(c, 0) * max_repeats < target_share * (SELECT sum(c) FROM t)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
