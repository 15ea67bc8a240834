"""Embeddings of text, and outcomes predicted from neighbours and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import text as T
from ..operators import embedding as E
from ..operators import prediction as P
from ..operators import search as S
from .common import CUR, current

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


IN = lambda ws: "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(ws)) + ")"
CONTEXTS = ", ".join(f"array_to_string(regexp_extract_all(lower(t), '{p}'), chr(10)) AS p_{k}" for k, (p, _) in E.TERM_PATTERNS.items())
FACTOR = " * ".join(f"CASE WHEN contains(p_{k}, token) THEN {w} ELSE 1.0 END" for k, (_, w) in E.TERM_PATTERNS.items())
TOKENS = f"""{CUR}, t AS (SELECT id, concat_ws(' ', title, content) AS t FROM cur), c AS (SELECT id, t, {CONTEXTS} FROM t), w AS (SELECT id, unnest(regexp_extract_all(lower(t), '[\\pL\\pN_]+')) AS token FROM c),
 k AS (SELECT id, token, count(*) AS n FROM w WHERE length(token) >= 2 AND (token NOT IN {IN(E.STOP_WORDS)} OR token IN {IN(E.LEGAL_WORDS)}) AND NOT (regexp_matches(token, '^\\d+$') AND length(token) < 4) GROUP BY 1, 2),
 r AS (SELECT id, token, n, n / CAST(sum(n) OVER (PARTITION BY id) AS DOUBLE) * ln(1 + 1 / (1.0 + n)) * CASE WHEN token IN {IN(E.LEGAL_WORDS)} THEN 1.5 ELSE 1.0 END * CASE WHEN length(token) > 6 THEN 1.2 ELSE 1.0 END * {FACTOR} AS raw FROM k JOIN c USING (id)),
 x AS (SELECT id, token, n, raw / sum(raw) OVER (PARTITION BY id) AS weight FROM r)"""


def _whole(spark, sf):
    """Title and content of the current documents as one text, as bags take it."""
    return current(spark, sf, "id", "title", "content").select("id", F.concat_ws(" ", "title", "content").alias("text"))


@query(f"WITH {TOKENS} SELECT id, token, n, round(weight, 6) AS weight FROM x")
def bag_weights(spark, sf):
    return E.token_weights(_whole(spark, sf), "id", "text").withColumn("weight", F.round("weight", 6))


@query(f"WITH {TOKENS} SELECT id, count(*) AS vocabulary, CAST(sum(n) AS BIGINT) AS tokens, round(max(weight), 6) AS heaviest FROM x GROUP BY 1")
def bag_tokens(spark, sf):
    w = E.token_weights(_whole(spark, sf), "id", "text")
    return w.groupBy("id").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("tokens"), F.round(F.max("weight"), 6).alias("heaviest"))


@query(f"WITH {TOKENS}, a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, token) AS r, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9), token) AS q FROM x) SELECT id, token, round(weight, 6) AS weight, CASE WHEN r <= 10 THEN 'top' ELSE 'bottom' END AS \"end\" FROM a WHERE r <= 10 OR q <= 5")
def token_importance(spark, sf):
    return E.token_importance(E.token_weights(_whole(spark, sf), "id", "text"), "id").withColumn("weight", F.round("weight", 6))


@query()
def text_vectors(spark, sf):
    d = E.encode(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")
    return d.select("doc_id", F.round(d.vector[0], 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query()
def bag_vectors(spark, sf):
    d = E.bag_vectors(_whole(spark, sf), "id", "text")
    return d.select("id", F.size("vector").alias("dimension"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query()
def section_vectors(spark, sf):
    s = E.sections(current(spark, sf, "id", "title", "content"), "id", "title", "content")
    d = E.mean_vector(E.encode(s, "text", "id", "weight"), "id", "vector", F.col("weight"))
    return d.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


@query()
def chunk_vectors(spark, sf):
    """Mean of the vectors of a text's chunks."""
    c = current(spark, sf, "id", "content").select("id", T.sentence_chunks("content").alias("all_")).select("id", F.explode("all_").alias("chunk"))
    d = E.mean_vector(E.encode(c, "chunk", "id"), "id")
    return d.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


@query()
def index_missing(spark, sf):
    """Vectors for current documents that have none."""
    d = current(spark, sf, "id", "title", "content", "embedding").where("embedding is null")
    return E.encode(d.withColumn("t", F.concat_ws("\n", "title", "content")), "t", "id").select("id", F.size("vector").alias("dimension"))


@query()
def search_text(spark, sf):
    """A text query against text vectors of the corpus: the ten best."""
    d = E.encode(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")
    q = E.HashEncoder().encode(["organ prowadzi rejestr opłaty portowej"])[0].tolist()
    return S.top_k(d, q, 10, vector="vector", key="doc_id", least=0.01).select("doc_id", F.round("similarity", 6).alias("similarity"))


COSINE = "greatest(-1.0, least(1.0, coalesce(list_inner_product(l.e, r.e) / nullif(sqrt(list_inner_product(l.e, l.e)) * sqrt(list_inner_product(r.e, r.e)), 0), 0.0)))"
KNN = f"""p AS (SELECT l.vec_id AS query, r.vec_id AS key, r.label / 10.0 AS y, {COSINE} AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) l, (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) r WHERE l.vec_id <> r.vec_id),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, key) AS rn FROM p) x WHERE rn <= 10),
 g AS (SELECT * FROM t WHERE s >= 0.2),
 m AS (SELECT query, sum(s * y) / sum(s) AS p, avg(s) AS ms, var_pop(y) AS v, count(*) AS n FROM g GROUP BY 1),
 k AS (SELECT q.query, coalesce(p, 0.5) AS prediction, CASE WHEN p IS NULL THEN 0.3 ELSE greatest(0.1, 0.8 * ms - least(0.3, v)) END AS confidence, coalesce(n, 0) AS neighbours FROM (SELECT DISTINCT query FROM p) q LEFT JOIN m ON m.query = q.query)"""


def _neighbours(spark, sf):
    d = table(spark, sf, "embeddings")
    best = S.batch_top_k(d.where("vec_id % 50 = 0"), d, 10, key="vec_id")
    y = d.select(F.col("vec_id").alias("key"), (F.col("label") / 10.0).alias("y"))
    return best.join(y, "key")


@query(f"WITH {KNN} SELECT query, round(prediction, 5) AS prediction, round(confidence, 5) AS confidence, neighbours FROM k")
def knn_predict(spark, sf):
    n = _neighbours(spark, sf)
    d = P.from_neighbours(n.where("similarity >= 0.2"), n)
    return d.select("query", F.round("prediction", 5).alias("prediction"), F.round("confidence", 5).alias("confidence"), "neighbours")


@query(f"WITH {KNN} SELECT query, CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS level FROM k")
def confidence_bands(spark, sf):
    n = _neighbours(spark, sf)
    d = P.from_neighbours(n.where("similarity >= 0.2"), n)
    return d.select("query", P.confidence_level(F.col("confidence")).alias("level"))


@query()
def knn_temporal(spark, sf):
    """Neighbours weighed by their age in days (the row number stands in for it)."""
    n = _neighbours(spark, sf)
    d = P.temporal(n, F.col("key") % 800, 0.1)
    return d.groupBy("query").agg(F.count("*").alias("n"), F.round(F.sum(F.col("similarity") * F.col("y") * (1 + F.col("b"))) / F.sum(F.col("similarity") * (1 + F.col("b"))), 5).alias("prediction"))


@query(f"WITH {CUR} SELECT id, CAST(length(content) AS DOUBLE) AS length, CAST(length(content) - length(regexp_replace(content, '[.!?]', '', 'g')) AS DOUBLE) AS stops, round((length(content) - length(regexp_replace(content, '[0-9]', '', 'g'))) / CAST(greatest(length(content), 1) AS DOUBLE), 6) AS digit_ratio, CASE WHEN regexp_matches(lower(content), '§\\s*\\d+') THEN 1.0e0 ELSE 0.0e0 END AS has_paragraphs FROM cur")
def features_text(spark, sf):
    f = P.text_features("content")
    return current(spark, sf, "id", "content").select("id", f["length"].alias("length"), f["stops"].alias("stops"), F.round(f["digit_ratio"], 6).alias("digit_ratio"), f["has_paragraphs"].alias("has_paragraphs"))


VOTES = f"""{CUR}, v AS (SELECT id, 'a' AS model, CASE WHEN is_amendment THEN 0.8 ELSE 0.2 END AS p, 0.5 AS weight FROM cur UNION ALL SELECT id, 'b', CASE WHEN affects_multiple_acts THEN 0.9 ELSE 0.3 END, 0.3 FROM cur UNION ALL SELECT id, 'c', CASE WHEN length(title) > 100 THEN 0.6 ELSE 0.4 END, 0.2 FROM cur)"""


def _votes(spark, sf):
    d = current(spark, sf, "id", "title", "is_amendment", "affects_multiple_acts")
    v = [("a", F.when(F.col("is_amendment"), 0.8).otherwise(0.2), 0.5), ("b", F.when(F.col("affects_multiple_acts"), 0.9).otherwise(0.3), 0.3), ("c", F.when(F.length("title") > 100, 0.6).otherwise(0.4), 0.2)]
    return d.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p"), F.lit(w).alias("weight")) for m, p, w in v])).alias("x")).select("id", "x.*")


@query(f"WITH {VOTES} SELECT id, round(sum(p * weight) / sum(weight), 6) AS prediction, round(greatest(0.0, 1 - var_pop(p)), 6) AS consensus FROM v GROUP BY id")
def vote_soft(spark, sf):
    return P.soft_vote(_votes(spark, sf), "id").select("id", F.round("prediction", 6).alias("prediction"), F.round("consensus", 6).alias("consensus"))


@query(f"WITH {VOTES}, c AS (SELECT id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS cls, sum(weight) AS w FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, cls) AS rn FROM c) SELECT id, cls AS prediction FROM r WHERE rn = 1")
def vote_hard(spark, sf):
    return P.hard_vote(_votes(spark, sf), "id").select("id", "prediction")


@query(f"WITH {VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(p - 0.5) DESC, model) AS rn FROM v) SELECT id, model, CAST(p AS DOUBLE) AS p FROM r WHERE rn = 1")
def best_voter(spark, sf):
    return P.best_voter(_votes(spark, sf), "id")


@query()
def classifier_accuracy(spark, sf):
    """Held-out accuracy of a classifier of amending texts by their features."""
    f = P.text_features("content")
    d = current(spark, sf, "id", "content", "is_amendment").select("id", F.coalesce(F.col("is_amendment").cast("double"), F.lit(0.0)).alias("label"), *[c.alias(n) for n, c in f.items()])
    d = d.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5)))
    out = P.evaluate(d.where("fold <> 0"), d.where("fold = 0"), "logistic", list(f))
    return spark.createDataFrame([(k, round(v, 4)) for k, v in sorted(out.items())], "metric string, value double")
