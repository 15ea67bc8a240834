"""Search texts, registers, windows of tokens and the state of stores over the driver tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import text as T
from ..operators import language as L
from ..operators import prediction as P
from ..operators import understanding as U
from ..operators.search import stripped
from ..sources.landing import votes
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


Q = lambda s: "'" + s.replace("'", "''") + "'"
LIST = lambda ws: "[" + ", ".join(map(Q, ws)) + "]"
KINDS = "CASE " + " ".join(f"WHEN lower(trim(document_type)) IN ({', '.join(map(Q, ns))}) THEN {Q(k)}" for k, ns in U.TYPES.items()) + " END"


@query(f"SELECT document_type, {KINDS} AS standard, count(*) AS n FROM (SELECT document_type FROM legal_documents UNION ALL SELECT unnest({LIST([n.upper() + ' ' for ns in U.TYPES.values() for n in ns] + ['statute'])})) x GROUP BY ALL")
def type_standard(spark, sf):
    """Stored names of types, and all known names in capitals with a blank, as standard types."""
    names = [n.upper() + " " for ns in U.TYPES.values() for n in ns] + ["statute"]
    d = table(spark, sf, "legal_documents").select("document_type").unionByName(spark.createDataFrame([(n,) for n in names], "document_type string"))
    return d.groupBy("document_type", U.standard_type(F.col("document_type")).alias("standard")).agg(F.count("*").alias("n"))


@query(f"WITH {CUR} SELECT id, unnest(list_filter({LIST(U.TERMS)}, lambda t: contains(lower(title), t))) AS term FROM cur")
def query_terms(spark, sf):
    return current(spark, sf, "id", "title").select("id", U.terms_in(F.col("title")).alias("all_")).select("id", F.explode("all_").alias("term"))


_WORDS = "string_split(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), ' ')"
_EXPAND = " || ".join(
    [f"CASE WHEN contains(lower(title), {Q(t)}) THEN {LIST(ss)} ELSE [] END" for t, ss in L.SYNONYMS.items()]
    + [f"CASE WHEN list_contains({_WORDS}, {Q(f)}) THEN {LIST(s)} ELSE [] END || CASE WHEN list_has_any({_WORDS}, {LIST(s)}) THEN [{Q(f)}] ELSE [] END" for f, s in U.ABBREVIATIONS.items()]
)


@query(f"WITH {CUR} SELECT DISTINCT id, unnest({_EXPAND}) AS added FROM cur")
def query_expand(spark, sf):
    return current(spark, sf, "id", "title").select("id", U.expansions(F.col("title")).alias("all_")).select("id", F.explode("all_").alias("added"))


def _matches_sql(patterns: dict[str, str], column: str) -> str:
    parts = " UNION ALL ".join(f"SELECT id, {Q(k)} AS kind, regexp_extract_all(lower({column}), {Q(p)}) AS l FROM cur" for k, p in patterns.items())
    return f"WITH {CUR}, e AS ({parts}), m AS (SELECT id, kind, CAST(i - 1 AS INTEGER) AS n, l[i] AS found FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM e) y)"


_PART = lambda k, i: f"nullif(regexp_extract(found, {Q(U.REFERENCES[k])}, {i}), '')"


@query(
    f"{_matches_sql(U.REFERENCES, 'content')} SELECT id, kind, n, found, CASE kind WHEN 'article' THEN {_PART('article', 1)} WHEN 'paragraph' THEN {_PART('paragraph', 1)} END AS article, "
    f"CASE kind WHEN 'article' THEN {_PART('article', 2)} WHEN 'paragraph' THEN {_PART('paragraph', 2)} END AS section, CASE kind WHEN 'article' THEN {_PART('article', 3)} END AS point, CASE kind WHEN 'act_reference' THEN {_PART('act_reference', 1)} END AS day FROM m"
)
def query_references(spark, sf):
    d = current(spark, sf, "id", "content")
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.lower("content"), F.lit(p), F.lit(0)).alias("all")) for k, p in U.REFERENCES.items()])
    d = d.select("id", F.array_join(F.flatten(F.transform(every, lambda e: e["all"])), "\n").alias("found_"))  # only what was found moves
    return U.references(d, "id", "found_")


@query(f"{_matches_sql(U.TIMES, 'title')} SELECT id, kind, n, found FROM m")
def query_times(spark, sf):
    return U.matches(current(spark, sf, "id", "title").select("id", "title"), "id", "title", U.TIMES)


@query(f"WITH {CUR}, k AS (SELECT id, list_sort(list_distinct({' || '.join(f'regexp_extract_all(lower(content), {Q(p)})' for p in U.KEY_TERMS).replace('[\\p{L}\\p{N}_]', '[\\pL\\pN_]')})) AS k FROM cur) SELECT id, len(k) AS n, md5(array_to_string(k, '|')) AS digest FROM k")
def key_terms(spark, sf):
    d = current(spark, sf, "id", "content").select("id", U.key_terms(F.col("content")).alias("k"))
    return d.select("id", F.size("k").alias("n"), F.md5(F.encode(F.array_join("k", "|"), "UTF-8")).alias("digest"))


#: White space as Spark's (?U)\\s has it.
_WS = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\v]"
_SENT = lambda c: f"list_distinct(list_filter(list_transform(string_split({c}, '.'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: length(s) > 20))"
_WSET = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> ''))"


@query(f"""WITH {CUR}, a AS (SELECT id, unnest({_SENT('content')}) AS formal FROM cur),
 b AS (SELECT id AS amendment_id, document_id AS id, unnest({_SENT('amendment_text')}) AS plain FROM (SELECT DISTINCT id, document_id, amendment_text FROM amendments WHERE amendment_text IS NOT NULL) z),
 p AS (SELECT amendment_id, formal, plain, {_WSET('formal')} AS fw, {_WSET('plain')} AS pw FROM a JOIN b USING (id)),
 s AS (SELECT *, len(list_intersect(fw, pw)) / sqrt(CAST(len(fw) AS DOUBLE) * len(pw)) AS similarity FROM p)
 SELECT amendment_id, md5(formal) AS formal, md5(plain) AS plain, round(similarity, 6) AS similarity, round(least(0.8, similarity + 0.1), 6) AS confidence FROM s WHERE similarity >= 0.5""")
def register_semantic(spark, sf):
    """Sentences of a law and of the amendments that name it, alike by their words."""
    a = once(spark, sf, "amendments", "id", "document_id", "amendment_text").where("amendment_text is not null").select(F.col("id").alias("amendment_id"), F.col("document_id").alias("id"), "amendment_text")
    d = U.sentence_matches(current(spark, sf, "id", "content").select("id", "content"), a, "id", "amendment_id", "content", "amendment_text")
    md5 = lambda c: F.md5(F.encode(c, "UTF-8")).alias(c)
    return d.select("amendment_id", md5("formal"), md5("plain"), F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"))


DIRECT = [("a1", "niniejszy", "ten"), ("a2", "uchyla się", "znosi się")]
MEANING = [("a1", "f1", "p1", 0.75, 0.8), ("a1", "f2", "p2", 0.55, 0.65), ("a3", "f3", "p3", 0.625, 0.725)]
SHAPES = [("a2", "article_reference", 0.25, 0.85)]
_VALUES = lambda rows: ", ".join("(" + ", ".join(Q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
_ALL = f"""(SELECT a AS id, 'direct' AS kind, f AS formal, p AS plain, 0.5 AS similarity, 0.9 AS confidence FROM (VALUES {_VALUES(DIRECT)}) d(a, f, p)
 UNION ALL SELECT a, 'semantic', f, p, s, c FROM (VALUES {_VALUES(MEANING)}) m(a, f, p, s, c) UNION ALL SELECT a, 'structural', n, n, s, c FROM (VALUES {_VALUES(SHAPES)}) h(a, n, s, c))"""


def _fixture_matches(spark):
    a = spark.createDataFrame(DIRECT, "id string, formal_phrase string, plain_phrase string")
    b = spark.createDataFrame(MEANING, "id string, formal string, plain string, similarity double, confidence double")
    c = spark.createDataFrame(SHAPES, "id string, pattern string, similarity double, confidence double")
    return U.all_matches(a, b, c, "id")


@query(f"SELECT id, kind, formal, plain, CAST(similarity AS DOUBLE) AS similarity, CAST(confidence AS DOUBLE) AS confidence FROM {_ALL} x WHERE confidence >= 0.7")
def register_matches(spark, sf):
    """Direct, semantic and structural matches above a confidence, on fixed rows."""
    return _fixture_matches(spark)


@query(f"WITH r AS (SELECT * FROM (VALUES ('a1', 0.8), ('a2', 0.5), ('a4', 0.25)) v(id, score)), m AS (SELECT id, max(similarity) AS m, least(3, count(*)) AS n FROM {_ALL} x WHERE confidence >= 0.7 GROUP BY id) SELECT r.id, round(CAST(score * (1 + 0.1 * coalesce(m, 0)) AS DOUBLE), 9) AS score, CAST(coalesce(m, 0) AS DOUBLE) AS cross_score, coalesce(n, 0) AS matches FROM r LEFT JOIN m USING (id)")
def register_boost(spark, sf):
    """Results raised by their best match in the other register, on fixed rows."""
    r = spark.createDataFrame([("a1", 0.8), ("a2", 0.5), ("a4", 0.25)], "id string, score double")
    return U.boosted(r, _fixture_matches(spark), "id").withColumn("score", F.round("score", 9))


@query(f"WITH {CUR}, w AS (SELECT id, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS w FROM cur), s AS (SELECT id, w, unnest(range(0, CAST(greatest(1, ceil((len(w) - 50) / 350.0)) AS BIGINT))) AS n FROM w WHERE len(w) > 0) SELECT id, CAST(n AS INTEGER) AS n, len(w[n * 350 + 1 : n * 350 + 400]) AS tokens, md5(array_to_string(w[n * 350 + 1 : n * 350 + 400], ' ')) AS digest FROM s")
def chunk_tokens(spark, sf):
    """Windows of 400 tokens that overlap by 50."""
    d = current(spark, sf, "id", "content").select("id", T.token_chunks("content").alias("all_")).select("id", F.posexplode("all_").alias("n", "chunk"))
    return d.select("id", "n", F.size("chunk").alias("tokens"), F.md5(F.encode(F.array_join("chunk", " "), "UTF-8")).alias("digest"))


@query(f"WITH {CUR} SELECT id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS normal, md5(CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END) AS shown FROM cur")
def search_response(spark, sf):
    """A result as it is shown: the normal form of its title and the beginning of its content (the cut is the feature)."""
    shown = F.when(F.length("content") > 500, F.concat(F.substring("content", 1, 500), F.lit("..."))).otherwise(F.col("content"))
    return current(spark, sf, "id", "title", "content").select("id", F.lower(T.one_space(F.col("title"))).alias("normal"), F.md5(F.encode(shown, "UTF-8")).alias("shown"))


@query(f"WITH {CUR}, s AS (SELECT id, list_filter(list_transform(string_split(content, '.'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: s <> '') AS s FROM cur), x AS (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM s) SELECT id, CAST(i - 1 AS INTEGER) AS n, md5(concat_ws('. ', CASE WHEN i > 1 THEN s[i - 1] END, s[i], s[i + 1])) AS context FROM x")
def sentence_context(spark, sf):
    """Each sentence with the one before and the one after it."""
    d = current(spark, sf, "id", "content").select("id", F.filter(F.transform(F.split("content", r"\."), stripped), lambda s: s != "").alias("s"))
    around = F.transform("s", lambda x, i: F.array_join(F.slice(F.col("s"), F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), ". "))
    return d.select("id", F.posexplode(around).alias("n", "c")).select("id", "n", F.md5(F.encode("c", "UTF-8")).alias("context"))


@query(f"WITH {CUR} SELECT lower(trim(document_type)) AS document_type, count(*) AS n, count(*) FILTER (WHERE html_raw_content IS NOT NULL) AS html, count(*) FILTER (WHERE pdf_raw_content IS NOT NULL OR pdf_extracted_text IS NOT NULL) AS pdf, count(*) FILTER (WHERE html_raw_content IS NULL AND pdf_raw_content IS NULL AND pdf_extracted_text IS NULL) AS failed, count(DISTINCT preferred_source) AS sources FROM cur GROUP BY 1")
def extraction_summary(spark, sf):
    """Documents of each type by what was extracted of them."""
    d = current(spark, sf, "id", "document_type", "html_raw_content", "pdf_raw_content", "pdf_extracted_text", "preferred_source")
    pdf, html = F.col("pdf_raw_content").isNotNull() | F.col("pdf_extracted_text").isNotNull(), F.col("html_raw_content").isNotNull()
    d = d.select("id", F.lower(F.trim("document_type")).alias("document_type"), pdf.alias("p"), html.alias("h"), "preferred_source")
    return d.groupBy("document_type").agg(F.count("*").alias("n"), F.count_if("h").alias("html"), F.count_if("p").alias("pdf"), F.count_if(~F.col("h") & ~F.col("p")).alias("failed"), F.count_distinct("preferred_source").alias("sources"))


@query("SELECT id, CASE WHEN total = 0 THEN 0.0 ELSE round((yes + no + abstain) / CAST(total AS DOUBLE), 6) END AS participation, n AS deputies FROM (VALUES ('v1', 460, 200, 150, 10, 2), ('v2', 0, 0, 0, 0, 0), ('v3', 3, 1, 1, 1, 3)) v(id, total, yes, no, abstain, n)")
def voting_participation(spark, sf):
    """Turnout of votings, on fixed rows with their deputies' votes."""
    rows = [("v1", 10, 460, 200, 150, 10, [("1", "yes"), ("2", "no")]), ("v2", 10, 0, 0, 0, 0, []), ("v3", 10, 3, 1, 1, 1, [("1", "yes"), ("2", "no"), ("3", "abstain")])]
    d = spark.createDataFrame(rows, "id string, term int, totalVotes int, yesVotes int, noVotes int, abstainVotes int, deputyVotes array<struct<mp:string,vote:string>>")
    return votes(d).groupBy("id").agg(F.round(F.max("participation"), 6).alias("participation"), F.count("mp").alias("deputies"))


@query("SELECT name, accuracy >= 0.8 AND f1 >= 0.75 AND prec >= 0.7 AS good FROM (VALUES ('a', 0.81, 0.76, 0.7), ('b', 0.79, 0.9, 0.9), ('c', 0.9, 0.7, 0.9), ('d', 0.8, 0.75, 0.69)) v(name, accuracy, f1, prec)")
def model_gate(spark, sf):
    """Which models are good enough, on fixed rows."""
    d = spark.createDataFrame([("a", 0.81, 0.76, 0.7), ("b", 0.79, 0.9, 0.9), ("c", 0.9, 0.7, 0.9), ("d", 0.8, 0.75, 0.69)], "name string, accuracy double, f1 double, precision double")
    return d.select("name", P.good_enough(F.col("accuracy"), F.col("f1"), F.col("precision")).alias("good"))


@query("WITH a AS (SELECT DISTINCT id, document_id, omnibus_bill_id, affects_multiple_acts FROM amendments), b AS (SELECT max(omnibus_bill_id) AS bill FROM a) SELECT document_id, count(*) AS n, count(*) FILTER (WHERE omnibus_bill_id = bill OR affects_multiple_acts) AS marked FROM a, b GROUP BY document_id")
def amendments_by_document(spark, sf):
    """Amendments of each document; those of a named bill are marked in bulk as affecting several acts."""
    d = once(spark, sf, "amendments", "id", "document_id", "omnibus_bill_id", "affects_multiple_acts")
    bill = d.agg(F.max("omnibus_bill_id")).collect()[0][0]
    marked = F.when(F.col("omnibus_bill_id") == F.lit(bill), F.lit(True)).otherwise(F.col("affects_multiple_acts"))
    return d.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(marked).alias("marked"))


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE before < 3) AS accepted FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, ts) AS before FROM events) x GROUP BY user_id")
def window_limited(spark, sf):
    """Calls with fewer than three calls in the hour before them."""
    d = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, -1)
    return d.withColumn("before", F.count("*").over(w)).groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("before") < 3).alias("accepted"))


@query(f"""WITH q AS (SELECT user_id || '-' || event_type AS item, count(*) - 1 AS retry_count, max(ts) AS last FROM events GROUP BY 1),
 s AS (SELECT *, CASE WHEN retry_count >= 3 THEN 'failed' WHEN last < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 'expired' ELSE 'waiting' END AS state, row_number() OVER (ORDER BY last DESC, item) AS r FROM q)
 SELECT item, retry_count, CASE WHEN state = 'waiting' AND r > 1000 THEN 'refused' ELSE state END AS state FROM s""")
def retry_queue(spark, sf):
    """Failed items, each once with its retries: given up after three, expired after a day, refused beyond a thousand waiting."""
    d = table(spark, sf, "events").groupBy(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("item")).agg((F.count("*") - 1).alias("retry_count"), F.max("ts").alias("last"))
    old = F.col("last") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    state = F.when(F.col("retry_count") >= 3, "failed").when(old, "expired").otherwise("waiting")
    best = d.orderBy(F.desc("last"), "item").limit(1000).select("item", F.lit(True).alias("room"))  # the size of the queue
    d = d.withColumn("state", state).join(F.broadcast(best), "item", "left")
    return d.select("item", "retry_count", F.when((F.col("state") == "waiting") & F.col("room").isNull(), "refused").otherwise(F.col("state")).alias("state"))


def _features(spark, sf):
    f = P.text_features("content")
    d = current(spark, sf, "id", "content", "is_amendment").select("id", F.coalesce(F.col("is_amendment").cast("double"), F.lit(0.0)).alias("label"), *[c.alias(n) for n, c in f.items()])
    return d.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5)).cast("int")), list(f)


@query()
def classifier_folds(spark, sf):
    """Accuracy on each of five folds, by a model that has seen the other four."""
    d, names = _features(spark, sf)
    return P.cross_validated(d, "logistic", names).withColumn("accuracy", F.round("accuracy", 4))


@query()
def classifier_stacked(spark, sf):
    """Held-out accuracy of two models, of their blend and of a model stacked on them."""
    d, names = _features(spark, sf)
    return P.stacked(d, ["logistic", "forest"], names).withColumn("accuracy", F.round("accuracy", 4))
