"""Vector search and ranking over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import vectors as V
from ..operators import search as S
from .common import AS_OF, CUR, current

E = "embeddings"
QV = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
COS = "CASE WHEN list_inner_product(a, a) = 0 OR list_inner_product(b, b) = 0 THEN 0 ELSE greatest(-1.0, least(1.0, list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))))) END"


def cos(a: str, b: str) -> str:
    return f"greatest(-1.0, least(1.0, coalesce(list_inner_product({a}, {b}) / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0.0)))"


V1 = "CAST(embedding AS DOUBLE[])"


def _query(spark, sf):
    return S.vector_of(table(spark, sf, E), "vec_id", 0)


def vec_cosine_topk(spark, sf):
    d = S.top_k(table(spark, sf, E), _query(spark, sf), 10, key="vec_id", least=0.05)
    return d.select("vec_id", F.round("similarity", 6).alias("similarity"))


def vec_l2_topk(spark, sf):
    d = S.top_k(table(spark, sf, E), _query(spark, sf), 10, metric="l2", key="vec_id")
    return d.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


def vec_ip_topk(spark, sf):
    d = S.top_k(table(spark, sf, E), _query(spark, sf), 10, metric="inner_product", key="vec_id")
    return d.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


def vec_filtered_topk(spark, sf):
    d = S.top_k(table(spark, sf, E), _query(spark, sf), 10, key="vec_id", where=F.col("label") == 3, most=1.5)
    return d.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def vec_range(spark, sf):
    d = S.in_range(table(spark, sf, E), _query(spark, sf), 0.5, 0.9)
    return d.select("vec_id", F.round("distance", 6).alias("distance"))


def vec_similar_to_doc(spark, sf):
    d = S.similar_to(table(spark, sf, E), 7, 10, key="vec_id")
    return d.select("vec_id", F.round("similarity", 6).alias("similarity"))


def vec_batch_topk(spark, sf):
    d = table(spark, sf, E)
    out = S.batch_top_k(d.where("vec_id % 50 = 0"), d, 10, key="vec_id")
    return out.select("query", "key", "rank", F.round("similarity", 5).alias("similarity"))


def vec_pairwise_stats(spark, sf):
    """Similarities of the stated queries with all rows, as statistics for each query."""
    d = table(spark, sf, E)
    out = S.similarity_statistics(d.where("vec_id % 50 = 0"), d, key="vec_id")
    return out.select("query", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def _against(spark, sf, kernel, name):
    q = _query(spark, sf)
    return table(spark, sf, E).select("vec_id", F.round(kernel("embedding", q), 6).alias(name))


def vec_euclidean_sim(spark, sf):
    return _against(spark, sf, V.euclidean_similarity, "similarity")


def vec_manhattan_sim(spark, sf):
    q = _query(spark, sf)
    d = V.l1("embedding", q)
    return table(spark, sf, E).select("vec_id", F.round(V.manhattan_similarity("embedding", q), 6).alias("similarity"), F.round(d / F.size("embedding"), 6).alias("mean_difference"))


def vec_dot_sim(spark, sf):
    q = _query(spark, sf)
    d = V.dot("embedding", q)
    return table(spark, sf, E).select("vec_id", F.round(d, 6).alias("similarity"), F.round(1 - d, 6).alias("distance"), (F.abs(V.norm("embedding") - 1) <= 1e-4).alias("unit"))


def vec_weighted_cosine(spark, sf):
    return _against(spark, sf, lambda a, b: V.weighted_cosine(a, b, V.section_weights(len(b))), "similarity")


def vec_normalize(spark, sf):
    n = V.normalized("embedding")
    return table(spark, sf, E).select("vec_id", F.round(V.norm("embedding"), 5).alias("length"), F.round(n[0], 6).alias("first"), F.round(n[63], 6).alias("last"))


def vec_validate(spark, sf):
    d = table(spark, sf, "document_embeddings").withColumn("ok", V.well_formed("embedding", 64))
    return d.groupBy("model_name", "model_version").agg(F.count("*").alias("n"), F.count_if("ok").alias("usable"), F.count_if(~F.col("ok")).alias("unusable"))


def vec_stats(spark, sf):
    d = current(spark, sf, "id", "document_type", "embedding")
    return d.groupBy(F.lower(F.trim("document_type")).alias("document_type")).agg(
        F.count("*").alias("n"), F.count("embedding").alias("with_vector"), F.round(F.count("embedding") / F.count("*") * 100, 6).alias("coverage"))


def vec_consecutive_dist(spark, sf):
    from pyspark.sql import Window

    # neighbours in hash order within each label: a label is one task of the window
    d = table(spark, sf, E).select("vec_id", "embedding", "label", F.md5(F.col("vec_id").cast("string")).alias("h"))
    w = Window.partitionBy("label").orderBy("h")
    d = d.withColumn("nxt", F.lead("embedding").over(w)).where("nxt is not null")
    return d.select("vec_id", F.round(V.cosine("embedding", "nxt"), 6).alias("similarity"))


def vec_statistics(spark, sf):
    q = _query(spark, sf)
    d = table(spark, sf, E).select("label", V.cosine("embedding", q).alias("s"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return d.groupBy("label").agg(
        r(F.avg("s"), "mean"), r(F.percentile("s", 0.5), "median"), r(F.stddev_pop("s"), "std"), r(F.min("s"), "low"), r(F.max("s"), "high"),
        r(F.percentile("s", 0.25), "q25"), r(F.percentile("s", 0.75), "q75"), F.count("s").alias("n"))


def vec_index_advisor(spark, sf):
    d = table(spark, sf, E).groupBy("label").agg(F.count("*").alias("n"))
    d = d.unionByName(table(spark, sf, "document_embeddings").groupBy().agg(F.lit(-1).alias("label"), F.count("*").alias("n")))
    return d.select("label", "n", S.index_advice(F.col("n")).alias("a")).select("label", "n", "a.*")


def vec_clusters(spark, sf):
    return S.leader_clusters(table(spark, sf, E), 0.3, key="vec_id")


def vec_index_search(spark, sf):
    d = table(spark, sf, E)
    index = S.CellIndex(d, key="vec_id", lists=16)
    return index.search(d.where("vec_id % 50 = 0"), 10, probes=12).select("query", "key", "rank", F.round("similarity", 5).alias("similarity"))


def vec_index_recall(spark, sf):
    """Share of the true ten best that the cell index finds, for each stated query."""
    exact = vec_batch_topk(spark, sf).select("query", "key")
    found = vec_index_search(spark, sf).select("query", "key", F.lit(1).alias("hit"))
    return exact.join(found, ["query", "key"], "left").groupBy("query").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def set_jaccard(spark, sf):
    """Word-set similarity of the two page texts of a document."""
    d = current(spark, sf, "id", "pdf_extracted_text", "html_extracted_text").where("pdf_extracted_text is not null and html_extracted_text is not null")
    a, b = S.word_set(F.col("pdf_extracted_text")), S.word_set(F.col("html_extracted_text"))
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return d.select("id", F.round(F.when(any_ == 0, 1.0).otherwise(both / any_), 6).alias("jaccard"))


def _ranked(spark, sf):
    q = S.vector_of(current(spark, sf, "id", "embedding").where(F.size("embedding") == 64).orderBy("id").limit(1), "id", _first_id(spark, sf))
    d = current(spark, sf, "id", "document_type", "legal_domain", "published_at", "is_amendment", "affects_multiple_acts", "embedding").where(F.size("embedding") == 64)
    d = d.withColumn("document_type", F.lower(F.trim("document_type")))
    return d.withColumn("similarity", V.cosine("embedding", q)).drop("embedding")


def _first_id(spark, sf):
    return current(spark, sf, "id", "embedding").where(F.size("embedding") == 64).agg(F.min("id")).collect()[0][0]


def rank_temporal(spark, sf):
    d = S.rank_by(_ranked(spark, sf), "temporal", AS_OF)
    return d.select("id", F.round("score", 6).alias("score"))


def rank_type(spark, sf):
    return S.rank_by(_ranked(spark, sf), "type", AS_OF).select("id", F.round("score", 6).alias("score"))


def rank_domain(spark, sf):
    return S.rank_by(_ranked(spark, sf), "domain", AS_OF).select("id", F.round("score", 6).alias("score"))


def rank_composite(spark, sf):
    d = S.rank_composite(_ranked(spark, sf), AS_OF)
    return d.select("id", F.round("temporal", 6).alias("temporal"), "w_type", "w_domain", "w_amendment", F.round("composite", 6).alias("composite"))


def rank_explain(spark, sf):
    """The ten best of the composite rank with their factors."""
    d = S.explain_rank(S.rank_composite(_ranked(spark, sf), AS_OF))
    return d.orderBy(F.desc(F.round("composite", 9)), "id").limit(10).select("id", "explanation")


def search_ranked(spark, sf):
    """Flagship: candidates by similarity, ranked by all signals, the best twenty."""
    d = _ranked(spark, sf).where("similarity >= 0.1")
    d = d.orderBy(F.desc(F.round("similarity", 9)), "id").limit(80)
    d = S.rank_composite(d, AS_OF).orderBy(F.desc(F.round("composite", 9)), "id").limit(20)
    return d.select("id", "document_type", F.round("similarity", 6).alias("similarity"), F.round("composite", 6).alias("composite"))


QUERY_TEXT = "organ właściwy prowadzi rejestr opłaty"


def passages_topn(spark, sf):
    d = S.passages(current(spark, sf, "id", "content"), QUERY_TEXT)
    return d.select("id", "rank", F.round("score", 6).alias("score"), "passage")


def passage_relevance(spark, sf):
    d = S.passage_relevance(S.passages(current(spark, sf, "id", "content"), QUERY_TEXT), QUERY_TEXT)
    return d.select("id", F.round("relevance", 6).alias("relevance"))


QUERIES = {
    f.__name__: f
    for f in (
        vec_cosine_topk, vec_l2_topk, vec_ip_topk, vec_filtered_topk, vec_range, vec_similar_to_doc, vec_batch_topk, vec_pairwise_stats, vec_euclidean_sim,
        vec_manhattan_sim, vec_dot_sim, vec_weighted_cosine, vec_normalize, vec_validate, vec_stats, vec_consecutive_dist, vec_statistics, vec_index_advisor,
        vec_clusters, vec_index_search, vec_index_recall, set_jaccard, rank_temporal, rank_type, rank_domain, rank_composite, rank_explain, search_ranked,
        passages_topn, passage_relevance,
    )
}

IP = "list_inner_product"
BASE = f"b AS (SELECT vec_id, label, {V1} AS a, q FROM embeddings, {QV} z)"
DIST = "sqrt(list_sum(list_transform(list_zip(a, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
MAN = "list_sum(list_transform(list_zip(a, q), lambda x: abs(x[1] - x[2])))"
W = V.section_weights(64)
SCALED = lambda v: f"list_transform(list_zip({v}, {W!r}), lambda x: x[1] * x[2])"
CASES = lambda c, m: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {w}" for k, w in m.items()) + " ELSE 1.0 END"
PAIRS = f"p AS (SELECT l.vec_id AS query, r.vec_id AS key, {cos('l.e', 'r.e')} AS s FROM (SELECT vec_id, {V1} AS e FROM embeddings WHERE vec_id % 50 = 0) l, (SELECT vec_id, {V1} AS e FROM embeddings) r WHERE l.vec_id <> r.vec_id)"
AGE = f"CAST(floor(epoch(TIMESTAMP '{AS_OF}' - CAST(published_at AS TIMESTAMP)) / 86400) AS BIGINT)"
RANKED = f"""{CUR}, v AS (SELECT id, lower(trim(document_type)) AS document_type, legal_domain, published_at, is_amendment, affects_multiple_acts, {V1} AS a FROM cur WHERE len(embedding) = 64),
 q AS (SELECT a AS q FROM v WHERE id = (SELECT min(id) FROM v)),
 r AS (SELECT v.*, {cos('a', 'q')} AS similarity, {AGE} AS age FROM v, q),
 t AS (SELECT *, CASE WHEN age IS NULL THEN 0.5 WHEN age <= 30 THEN least(1.0, 1.5 * (1 - age / 30.0)) WHEN age > 365 THEN 0.1 ELSE greatest(0.1, 1 - (age - 30) / 335.0) END AS temporal,
   {CASES('document_type', S.TYPE_WEIGHTS)} AS w_type, {CASES('legal_domain', S.DOMAIN_WEIGHTS)} AS w_domain,
   CASE WHEN is_amendment AND affects_multiple_acts THEN 1.2 WHEN is_amendment THEN 1.1 ELSE 1.0 END AS w_amendment FROM r),
 c AS (SELECT *, greatest(0.0, least(1.0, (similarity * 0.8 + temporal * 0.2) * w_type * w_domain * w_amendment)) AS composite FROM t)"""

ORACLES = {
    "vec_cosine_topk": f"WITH {BASE}, s AS (SELECT vec_id, {cos('a', 'q')} AS s FROM b) SELECT vec_id, round(s, 6) AS similarity FROM s WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 10",
    "vec_l2_topk": f"WITH {BASE}, s AS (SELECT vec_id, {DIST} AS d FROM b) SELECT vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM s ORDER BY d, vec_id LIMIT 10",
    "vec_ip_topk": f"WITH {BASE}, s AS (SELECT vec_id, {IP}(a, q) AS d FROM b) SELECT vec_id, round(-d, 6) AS distance, round(d, 6) AS similarity FROM s ORDER BY d DESC, vec_id LIMIT 10",
    "vec_filtered_topk": f"WITH {BASE}, s AS (SELECT vec_id, label, 1 - {cos('a', 'q')} AS d FROM b WHERE label = 3) SELECT vec_id, label, round(d, 6) AS distance FROM s WHERE d <= 1.5 ORDER BY d, vec_id LIMIT 10",
    "vec_range": f"WITH {BASE}, s AS (SELECT vec_id, 1 - {cos('a', 'q')} AS d FROM b) SELECT vec_id, round(d, 6) AS distance FROM s WHERE d BETWEEN 0.5 AND 0.9",
    "vec_similar_to_doc": f"WITH b AS (SELECT vec_id, {V1} AS a, q FROM embeddings, (SELECT {V1} AS q FROM embeddings WHERE vec_id = 7) z WHERE vec_id <> 7), s AS (SELECT vec_id, {cos('a', 'q')} AS s FROM b) SELECT vec_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 10",
    "vec_batch_topk": f"WITH {PAIRS} SELECT query, key, CAST(rn AS INTEGER) AS rank, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, key) AS rn FROM p) x WHERE rn <= 10",
    "vec_pairwise_stats": f"WITH {PAIRS} SELECT query, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS low, round(max(s), 6) AS high FROM p GROUP BY query",
    "vec_euclidean_sim": f"WITH {BASE} SELECT vec_id, round(exp(-{DIST} / 64), 6) AS similarity FROM b",
    "vec_manhattan_sim": f"WITH {BASE}, m AS (SELECT vec_id, {MAN} AS d FROM b) SELECT vec_id, round(exp(-d / 128), 6) AS similarity, round(d / 64, 6) AS mean_difference FROM m",
    "vec_dot_sim": f"WITH {BASE} SELECT vec_id, round({IP}(a, q), 6) AS similarity, round(1 - {IP}(a, q), 6) AS distance, abs(sqrt({IP}(a, a)) - 1) <= 1e-4 AS unit FROM b",
    "vec_weighted_cosine": f"WITH {BASE}, w AS (SELECT vec_id, {SCALED('a')} AS a, {SCALED('q')} AS q FROM b) SELECT vec_id, round({cos('a', 'q')}, 6) AS similarity FROM w",
    "vec_normalize": f"WITH {BASE}, n AS (SELECT vec_id, a, sqrt({IP}(a, a)) AS l FROM b) SELECT vec_id, round(l, 5) AS length, round(a[1] / l, 6) AS first, round(a[64] / l, 6) AS last FROM n",
    "vec_validate": "WITH v AS (SELECT model_name, model_version, coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0, false) AS ok FROM document_embeddings) SELECT model_name, model_version, count(*) AS n, count(*) FILTER (WHERE ok) AS usable, count(*) FILTER (WHERE NOT ok) AS unusable FROM v GROUP BY 1, 2",
    "vec_stats": f"WITH {CUR} SELECT lower(trim(document_type)) AS document_type, count(*) AS n, count(embedding) AS with_vector, round(count(embedding) * 100.0 / count(*), 6) AS coverage FROM cur GROUP BY 1",
    "vec_consecutive_dist": f"WITH o AS (SELECT vec_id, {V1} AS a, lead({V1}) OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR))) AS b FROM embeddings) SELECT vec_id, round({cos('a', 'b')}, 6) AS similarity FROM o WHERE b IS NOT NULL",
    "vec_statistics": f"WITH {BASE}, s AS (SELECT label, {cos('a', 'q')} AS s FROM b) SELECT label, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS low, round(max(s), 6) AS high, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.75), 6) AS q75, count(s) AS n FROM s GROUP BY label",
    "vec_index_advisor": "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT -1, count(*) FROM document_embeddings), l AS (SELECT *, CASE WHEN n < 1000 THEN greatest(1, n // 10) WHEN n < 100000 THEN greatest(100, n // 1000) END AS lists FROM c) SELECT label, n, CASE WHEN n < 100000 THEN 'ivfflat' ELSE 'hnsw' END AS kind, CAST(lists AS INTEGER) AS lists, CAST(CASE WHEN lists IS NULL THEN 1 ELSE greatest(1, lists // 10) END AS INTEGER) AS probes FROM l",
    "set_jaccard": f"WITH {CUR}, w AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(pdf_extracted_text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(html_extracted_text), '\\s+'), lambda x: x <> '')) AS b FROM cur WHERE pdf_extracted_text IS NOT NULL AND html_extracted_text IS NOT NULL), c AS (SELECT id, len(list_intersect(a, b)) AS i, len(a) + len(b) - len(list_intersect(a, b)) AS u FROM w) SELECT id, round(CASE WHEN u = 0 THEN 1.0 ELSE i / CAST(u AS DOUBLE) END, 6) AS jaccard FROM c",
    "rank_temporal": f"WITH {RANKED} SELECT id, round(similarity * 0.8 + temporal * 0.2, 6) AS score FROM t",
    "rank_type": f"WITH {RANKED} SELECT id, round(similarity * w_type, 6) AS score FROM t",
    "rank_domain": f"WITH {RANKED} SELECT id, round(similarity * w_domain, 6) AS score FROM t",
    "rank_composite": f"WITH {RANKED} SELECT id, round(temporal, 6) AS temporal, CAST(w_type AS DOUBLE) AS w_type, CAST(w_domain AS DOUBLE) AS w_domain, CAST(w_amendment AS DOUBLE) AS w_amendment, round(composite, 6) AS composite FROM c",
    "search_ranked": f"WITH {RANKED}, k AS (SELECT * FROM c WHERE similarity >= 0.1 ORDER BY round(similarity, 9) DESC, id LIMIT 80) SELECT id, document_type, round(similarity, 6) AS similarity, round(composite, 6) AS composite FROM k ORDER BY round(composite, 9) DESC, id LIMIT 20",
}

_Q = sorted({w for w in QUERY_TEXT.lower().split()})
_SHARE = lambda c: f"len(list_intersect({_Q!r}, list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> '')))) / CAST({len(_Q)} AS DOUBLE)"
_STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+|[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+$', '', 'g')"
_AROUND = "array_to_string(list_slice(s, greatest(i, 1), greatest(i, 1) + 1 + CASE WHEN i > 0 THEN 1 ELSE 0 END), '. ')"
_PASSAGES = f"""{CUR}, s AS (SELECT id, list_transform(string_split(content, '.'), lambda x: {_STRIP('x')}) AS s FROM cur), e AS (SELECT id, s, i, s[i + 1] AS t FROM (SELECT id, s, unnest(range(0, len(s))) AS i FROM s) x),
 o AS (SELECT id, s, i, t, {_SHARE('t')} AS score FROM e WHERE length(t) >= 10), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i DESC, t DESC) AS rank FROM o WHERE score > 0),
 p AS (SELECT id, rank, score, {_STRIP(_AROUND)} AS p FROM r WHERE rank <= 3),
 g AS (SELECT id, rank, score, CASE WHEN length(p) > 200 THEN substring(p, 1, 200) || '...' ELSE p END AS passage FROM p)"""
ORACLES |= {
    "passages_topn": f"WITH {_PASSAGES} SELECT id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, passage FROM g",
    "passage_relevance": f"WITH {_PASSAGES} SELECT id, round(least(1.0, avg({_SHARE('passage')})), 6) AS relevance FROM g GROUP BY id",
}
