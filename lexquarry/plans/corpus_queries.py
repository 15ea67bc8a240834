"""Lookups, joins, aggregates, windows, changes and caches over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register, table
from ..sources import store
from .common import AS_OF, CUR, current, once

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


XREF = "(SELECT DISTINCT id, source_document_id, target_document_id, lower(trim(reference_type)) AS reference_type, similarity_score, created_at FROM cross_references)"
EMB = "(SELECT DISTINCT id, document_id, model_name, model_version, token_count, chunk_size, confidence_score, created_at FROM document_embeddings)"
AMD = "(SELECT DISTINCT * FROM amendments)"


def kind():
    return F.lower(F.trim("document_type"))


def refs(spark, sf):
    d = table(spark, sf, "cross_references")
    return d.select("id", "source_document_id", "target_document_id", F.lower(F.trim("reference_type")).alias("reference_type"), "similarity_score", "created_at").distinct()


@query(f"WITH {CUR} SELECT id, title FROM cur WHERE lower(trim(document_type)) = 'kodeks'")
def docs_by_type(spark, sf):
    return current(spark, sf, "id", "title", "document_type").where(kind() == "kodeks").select("id", "title")


@query(f"WITH {CUR} SELECT id, title, eli_identifier FROM cur WHERE id = (SELECT min(id) FROM legal_documents)")
def doc_lookup(spark, sf):
    first = table(spark, sf, "legal_documents").agg(F.min("id")).collect()[0][0]
    return current(spark, sf, "id", "title", "eli_identifier").where(F.col("id") == first).all()


@query(f"WITH {CUR} SELECT id, title FROM cur WHERE eli_identifier = (SELECT min(eli_identifier) FROM legal_documents)")
def doc_by_act_id(spark, sf):
    first = table(spark, sf, "legal_documents").agg(F.min("eli_identifier")).collect()[0][0]
    return current(spark, sf, "id", "title", "eli_identifier").where(F.col("eli_identifier") == first).select("id", "title")


@query(f"WITH {CUR} SELECT id, published_at FROM cur WHERE published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND TIMESTAMP '{AS_OF}'")
def docs_recent(spark, sf):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return current(spark, sf, "id", "published_at").where(F.col("published_at").between(at - F.expr("INTERVAL 365 DAYS"), at)).all()


@query("WITH k AS (SELECT CAST(x AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS pos FROM (VALUES (5, 0), (900000000, 1), (3, 2), (5, 3)) t(x, i)) SELECT k.pos, k.doc_id, d.n_chars FROM k LEFT JOIN documents d ON d.doc_id = k.doc_id")
def doc_batch_order(spark, sf):
    return store.in_order([5, 900_000_000, 3, 5], table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("pos", "doc_id", "n_chars")


@query(f"WITH {CUR} SELECT id, title FROM cur WHERE (contains(lower(title), 'opłat') OR contains(lower(content), 'opłaty z tytułu')) AND lower(trim(document_type)) = 'ustawa' ORDER BY id LIMIT 50 OFFSET 10")
def search_substring(spark, sf):
    """A page of a substring search: pages are the feature here."""
    d = current(spark, sf, "id", "title", "content", "document_type")
    hit = F.contains(F.lower("title"), F.lit("opłat")) | F.contains(F.lower("content"), F.lit("opłaty z tytułu"))
    return d.where(hit & (kind() == "ustawa")).select("id", "title").orderBy("id").offset(10).limit(50)


@query(f"WITH {CUR} SELECT count(*) AS total, count(*) > 60 AS has_more, 60 AS next_offset FROM cur WHERE contains(lower(title), 'opłat')")
def search_paging(spark, sf):
    d = current(spark, sf, "id", "title").where(F.contains(F.lower("title"), F.lit("opłat")))
    return d.agg(F.count("*").alias("total")).select("total", (F.col("total") > 60).alias("has_more"), F.lit(60).alias("next_offset"))


@query(f"WITH {CUR} SELECT id FROM cur WHERE embedding IS NULL AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 8760 HOUR")
def search_missing_embeddings(spark, sf):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return current(spark, sf, "id", "embedding", "created_at").where(F.col("embedding").isNull() & (F.col("created_at") >= at - F.expr("INTERVAL 8760 HOURS"))).select("id")


@query("SELECT document_type, count(*) AS n, count(*) FILTER (WHERE status = 'obowiązujący') AS in_force FROM act_registry GROUP BY 1")
def registry_in_force(spark, sf):
    return table(spark, sf, "act_registry").groupBy("document_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "obowiązujący").alias("in_force"))


@query(f"SELECT document_id, id, amendment_type FROM {AMD} a WHERE omnibus_bill_id = (SELECT min(omnibus_bill_id) FROM amendments)")
def amendments_of_bill(spark, sf):
    d = table(spark, sf, "amendments").distinct()
    first = d.agg(F.min("omnibus_bill_id")).collect()[0][0]
    return d.where(F.col("omnibus_bill_id") == first).select("document_id", "id", "amendment_type")


@query(f"SELECT omnibus_bill_id, count(DISTINCT document_id) AS acts, count(*) AS amendments, count(DISTINCT document_id) >= 3 AS omnibus, CASE WHEN count(*) >= 10 THEN 'very_high' WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS impact FROM {AMD} a WHERE omnibus_bill_id IS NOT NULL GROUP BY 1")
def omnibus_impact(spark, sf):
    d = table(spark, sf, "amendments").distinct().where("omnibus_bill_id is not null").groupBy("omnibus_bill_id")
    d = d.agg(F.count_distinct("document_id").alias("acts"), F.count("*").alias("amendments"))
    n = F.col("amendments")
    return d.withColumn("omnibus", F.col("acts") >= 3).withColumn("impact", F.when(n >= 10, "very_high").when(n >= 5, "high").when(n >= 3, "medium").otherwise("low"))


@query(f"WITH {CUR} SELECT a.id, a.affected_article, c.title FROM {AMD} a JOIN cur c ON c.id = a.document_id")
def fk_join(spark, sf):
    a = table(spark, sf, "amendments").distinct().select("id", "document_id", "affected_article")
    return a.join(current(spark, sf, "id", "title").withColumnRenamed("id", "document_id"), "document_id").select("id", "affected_article", "title")


@query(f"WITH {CUR}, t AS (SELECT id, title FROM cur UNION ALL SELECT id, title FROM act_registry) SELECT x.id, s.title AS source_title, t.title AS target_title FROM {XREF} x JOIN t s ON s.id = x.source_document_id LEFT JOIN t ON t.id = x.target_document_id")
def edge_ends(spark, sf):
    """Both ends of each reference by name; a target may be unknown."""
    names = current(spark, sf, "id", "title").unionByName(table(spark, sf, "act_registry").select("id", "title"))
    s = names.select(F.col("id").alias("source_document_id"), F.col("title").alias("source_title"))
    t = names.select(F.col("id").alias("target_document_id"), F.col("title").alias("target_title"))
    return refs(spark, sf).select("id", "source_document_id", "target_document_id").join(s, "source_document_id").join(t, "target_document_id", "left").select("id", "source_title", "target_title")


@query(f"WITH {CUR} SELECT DISTINCT x.id FROM {XREF} x WHERE x.target_document_id NOT IN (SELECT id FROM cur) AND x.target_document_id NOT IN (SELECT id FROM act_registry)")
def unknown_targets(spark, sf):
    known = current(spark, sf, "id").unionByName(table(spark, sf, "act_registry").select("id"))
    return store.new_rows(refs(spark, sf).select("id", "target_document_id"), known.withColumnRenamed("id", "target_document_id"), "target_document_id").select("id")


@query("SELECT DISTINCT eli_identifier FROM documents WHERE eli_identifier IS NOT NULL AND eli_identifier NOT IN (SELECT eli_identifier FROM legal_documents WHERE eli_identifier IS NOT NULL)")
def anti_new_docs(spark, sf):
    known = table(spark, sf, "legal_documents").select("eli_identifier").where("eli_identifier is not null")
    return store.new_rows(table(spark, sf, "documents").select("eli_identifier").where("eli_identifier is not null").distinct(), known, "eli_identifier")


@query(f"SELECT reference_type, count(*) AS n, count(DISTINCT source_document_id) AS sources, count(DISTINCT target_document_id) AS targets, round(avg(similarity_score), 6) AS mean_score FROM {XREF} x GROUP BY 1")
def edge_types(spark, sf):
    return refs(spark, sf).groupBy("reference_type").agg(F.count("*").alias("n"), F.count_distinct("source_document_id").alias("sources"), F.count_distinct("target_document_id").alias("targets"), F.round(F.avg("similarity_score"), 6).alias("mean_score"))


@query(f"SELECT source_document_id, count(*) AS outgoing FROM {XREF} x GROUP BY 1 HAVING count(*) >= 3")
def edge_hubs(spark, sf):
    return refs(spark, sf).groupBy("source_document_id").agg(F.count("*").alias("outgoing")).where("outgoing >= 3")


@query(f"WITH e AS (SELECT source_document_id AS a FROM {XREF} x UNION ALL SELECT target_document_id FROM {XREF} y), v AS (SELECT count(DISTINCT a) AS nodes FROM e), n AS (SELECT count(*) AS edges FROM {XREF} z) SELECT nodes, edges, round(edges / CAST(greatest(1, nodes * nodes) AS DOUBLE), 9) AS density FROM v, n")
def edge_network(spark, sf):
    ends = refs(spark, sf).select(F.explode(F.array("source_document_id", "target_document_id")).alias("a"))
    both = ends.agg(F.count_distinct("a").alias("nodes"), F.floor(F.count("*") / 2).alias("edges"))
    return both.select("nodes", "edges", F.round(F.col("edges") / F.greatest(F.lit(1), F.col("nodes") * F.col("nodes")), 9).alias("density"))


@query(f"WITH e AS (SELECT source_document_id AS a FROM {XREF} x UNION ALL SELECT target_document_id FROM {XREF} y) SELECT a AS node, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, node LIMIT 10")
def edge_top_nodes(spark, sf):
    e = refs(spark, sf)
    ends = e.select(F.col("source_document_id").alias("node")).unionByName(e.select(F.col("target_document_id").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(10)


@query(f"SELECT a.id AS first, b.id AS second FROM {XREF} a JOIN {XREF} b ON a.target_document_id = b.source_document_id")
def edge_chains(spark, sf):
    e = refs(spark, sf).select("id", "source_document_id", "target_document_id")
    a = e.select(F.col("id").alias("first"), F.col("target_document_id").alias("k"))
    return a.join(e.select(F.col("id").alias("second"), F.col("source_document_id").alias("k")), "k").select("first", "second")


@query(f"WITH {CUR} SELECT lower(trim(document_type)) AS document_type, count(*) AS n, count(embedding) AS with_vector, count(*) FILTER (WHERE is_amendment) AS amending, count(*) FILTER (WHERE affects_multiple_acts) AS several FROM cur GROUP BY 1")
def corpus_stats(spark, sf):
    d = current(spark, sf, "id", "document_type", "embedding", "is_amendment", "affects_multiple_acts")
    return d.groupBy(kind().alias("document_type")).agg(F.count("*").alias("n"), F.count("embedding").alias("with_vector"), F.count_if("is_amendment").alias("amending"), F.count_if("affects_multiple_acts").alias("several"))


@query(f"WITH {CUR} SELECT lower(trim(document_type)) AS document_type, strftime(published_at, '%Y-%m') AS month, count(*) AS n FROM cur WHERE published_at IS NOT NULL GROUP BY 1, 2")
def type_bucket_counts(spark, sf):
    d = current(spark, sf, "id", "document_type", "published_at").where("published_at is not null")
    return d.groupBy(kind().alias("document_type"), F.date_format("published_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(f"SELECT document_id, id, model_name FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id) AS rn FROM {EMB} e) x WHERE rn = 1")
def latest_version(spark, sf):
    return store.newest_version(table(spark, sf, "document_embeddings").select("id", "document_id", "model_name", "created_at"), "document_id", "created_at", "id").select("document_id", "id", "model_name")


@query(f"SELECT document_id, count(*) AS versions, min(created_at) AS first_at, max(created_at) AS last_at FROM {EMB} e GROUP BY 1")
def embedding_versions(spark, sf):
    d = once(spark, sf, "document_embeddings", "id", "document_id", "created_at")
    return d.groupBy("document_id").agg(F.count("*").alias("versions"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query(f"SELECT model_name, model_version, count(*) AS jobs, round(avg(token_count), 6) AS mean_tokens, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(confidence_score), 6) AS confidence FROM {EMB} e GROUP BY 1, 2")
def job_stats(spark, sf):
    d = once(spark, sf, "document_embeddings", "id", "model_name", "model_version", "token_count", "confidence_score")
    return d.groupBy("model_name", "model_version").agg(F.count("*").alias("jobs"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.sum("token_count").alias("tokens"), F.round(F.avg("confidence_score"), 6).alias("confidence"))


@query(f"WITH {CUR}, u AS (SELECT document_id, max(confidence_score) AS c FROM document_embeddings GROUP BY 1) SELECT c.id, coalesce(u.c, -1) AS score, CASE WHEN u.document_id IS NULL THEN c.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at FROM cur c LEFT JOIN u ON u.document_id = c.id")
def upsert_scores(spark, sf):
    base = current(spark, sf, "id", "updated_at").withColumn("score", F.lit(-1))
    new = table(spark, sf, "document_embeddings").select(F.col("document_id").alias("id"), F.col("confidence_score").alias("score"))
    return store.upsert(base, new, "id", ["score"], AS_OF).select("id", "score", "updated_at")


@query(f"WITH {CUR}, g AS (SELECT id FROM cur WHERE lower(trim(document_type)) = 'umowa') SELECT 'parent' AS kind, count(*) AS n FROM cur WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'child', count(*) FROM {AMD} a WHERE document_id NOT IN (SELECT id FROM g)")
def delete_cascade(spark, sf):
    docs = current(spark, sf, "id", "document_type")
    p, c = store.delete_cascade(docs, table(spark, sf, "amendments").distinct(), docs.where(kind() == "umowa"), "id", "document_id")
    return p.agg(F.count("*").alias("n")).select(F.lit("parent").alias("kind"), "n").unionByName(c.agg(F.count("*").alias("n")).select(F.lit("child").alias("kind"), "n"))


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3 GROUP BY 1")
def sql_passthrough(spark, sf):
    register(spark, sf, ("customer", "nation"))
    return store.sql(spark, "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = :region GROUP BY n_name", region=3)


@query("WITH o AS (SELECT user_id, event_type, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_type, count(*) AS n, count(nxt) AS followed, round(avg(epoch(nxt) - epoch(ts)), 3) AS mean_gap FROM o GROUP BY 1")
def segment_ends(spark, sf):
    """Each event lasts until the next of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf, "events").withColumn("nxt", F.lead("ts").over(w))
    gap = F.col("nxt").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.count("nxt").alias("followed"), F.round(F.avg(gap), 3).alias("mean_gap"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_occurrence(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_type", "event_id")


@query("SELECT l_shipdate AS day, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def batch_slices(spark, sf):
    """Rows in slices by day."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"WITH {CUR} SELECT 'legal' AS origin, count(*) AS n FROM cur UNION ALL SELECT 'processed', count(DISTINCT id) FROM processed_documents UNION ALL SELECT 'registry', count(*) FROM act_registry UNION ALL SELECT 'corpus', count(*) FROM documents")
def union_sources(spark, sf):
    """Heterogeneous sources in one document shape."""
    a = current(spark, sf, "id", "title", "content").withColumn("origin", F.lit("legal"))
    b = table(spark, sf, "processed_documents").select("id", "title", "content").dropDuplicates(["id"]).withColumn("origin", F.lit("processed"))
    c = table(spark, sf, "act_registry").select("id", "title").withColumn("origin", F.lit("registry"))
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")).withColumn("origin", F.lit("corpus"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).unionByName(d, allowMissingColumns=True)
    return u.groupBy("origin").agg(F.count("*").alias("n"))


@query("SELECT substring(k, 1, 2) AS shard, count(*) AS n FROM (SELECT sha256('events:' || 'type=' || event_type || '&user=' || CAST(user_id AS VARCHAR)) AS k FROM (SELECT DISTINCT event_type, user_id FROM events) d) x GROUP BY 1")
def cache_shards(spark, sf):
    d = table(spark, sf, "events").select("event_type", "user_id").distinct()
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    return d.select(store.shard(store.cache_key(F.lit("events"), params)).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"SELECT document_id, model_name, document_id || '/' || coalesce(model_name, '') || '/' || substring(sha256(coalesce(model_version, '')), 1, 16) AS stage_key FROM (SELECT *, row_number() OVER (PARTITION BY document_id, model_name, model_version ORDER BY created_at DESC) AS rn FROM {EMB} e) x WHERE rn = 1")
def stage_cache(spark, sf):
    d = once(spark, sf, "document_embeddings", "id", "document_id", "model_name", "model_version", "created_at")
    d = store.newest_version(d.withColumn("k", F.struct("document_id", "model_name", "model_version")), "k", "created_at", "id")
    return d.select("document_id", "model_name", store.stage_key(F.col("document_id"), F.coalesce("model_name", F.lit("")), F.col("model_version")).alias("stage_key"))


@query("WITH l AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS rn FROM events), m AS (SELECT max(ts) AS t FROM events) SELECT user_id, event_type, ts FROM l, m WHERE rn = 1 AND epoch(ts) + 86400 > epoch(t)")
def ttl_cache_state(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_type", "ts")
    at = d.agg(F.max("ts").cast("string")).collect()[0][0]
    return store.live_versions(d, ["user_id", "event_type"], "ts", 86400, at).select("user_id", "event_type", "ts")


@query("SELECT event_type, count(*) AS files, round(sum(value), 4) AS mb, round(count(*) FILTER (WHERE value > 50) * 100.0 / count(*), 2) AS hit_rate, CASE WHEN count(*) FILTER (WHERE value > 50) * 100.0 / count(*) >= 90 THEN 100 WHEN count(*) FILTER (WHERE value > 50) * 100.0 / count(*) >= 75 THEN 80 WHEN count(*) FILTER (WHERE value > 50) * 100.0 / count(*) >= 50 THEN 60 ELSE 30 END AS health FROM events GROUP BY 1")
def cache_health(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("files"), F.round(F.sum("value"), 4).alias("mb"), (F.count_if(F.col("value") > 50) * 100.0 / F.count("*")).alias("r"))
    r = F.col("r")
    return d.select("event_type", "files", "mb", F.round(r, 2).alias("hit_rate"), F.when(r >= 90, 100).when(r >= 75, 80).when(r >= 50, 60).otherwise(30).alias("health"))


@query("SELECT count(*) AS expired FROM (SELECT epoch(ts) AS s FROM events) e, (SELECT max(epoch(ts)) AS m FROM events) x WHERE s < m - 5 * 86400")
def cache_purge(spark, sf):
    d = table(spark, sf, "events").select("ts")
    m = d.agg(F.max("ts")).collect()[0][0]
    return d.where(F.unix_timestamp(F.col("ts").cast("timestamp")) + F.lit(0) < F.unix_timestamp(F.lit(str(m)).cast("timestamp")) - 5 * 86400).agg(F.count("*").alias("expired"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def calls_by_hour(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS calls FROM events")
def calls_last_hour(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-3600, 0)
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("calls"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT legal_domain, count(*) AS n, count(content) AS texts, round(avg(quality_score), 6) AS quality, round(quantile_cont(quality_score, 0.5), 6) AS median FROM (SELECT DISTINCT id, legal_domain, content, quality_score FROM processed_documents) p GROUP BY 1")
def ingestion_status(spark, sf):
    d = once(spark, sf, "processed_documents", "id", "legal_domain", "content", "quality_score")
    return d.groupBy("legal_domain").agg(F.count("*").alias("n"), F.count("content").alias("texts"), F.round(F.avg("quality_score"), 6).alias("quality"), F.round(F.percentile("quality_score", 0.5), 6).alias("median"))


@query("SELECT a.id AS a, b.id AS b FROM (SELECT DISTINCT id, document_id, created_at FROM amendments) a JOIN (SELECT DISTINCT id, document_id, created_at FROM amendments) b ON a.document_id = b.document_id AND a.id < b.id AND abs(epoch(a.created_at) - epoch(b.created_at)) <= 30 * 86400")
def band_pairs(spark, sf):
    """Amendments of one document within thirty days: a band join on day buckets."""
    d = once(spark, sf, "amendments", "id", "document_id", "created_at").withColumn("s", F.col("created_at").cast("timestamp").cast("double"))
    width = 30 * 86400
    a = d.select("document_id", F.col("id").alias("a"), F.col("s").alias("sa"), F.floor(F.col("s") / width).alias("k"))
    b = d.select("document_id", F.col("id").alias("b"), F.col("s").alias("sb"), F.explode(F.array(*[F.floor(F.col("s") / width) + i for i in (-1, 0, 1)])).alias("k"))
    return a.join(b, ["document_id", "k"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("sa") - F.col("sb")) <= width)).select("a", "b")
