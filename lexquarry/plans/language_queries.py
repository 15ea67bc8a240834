"""Spans, concepts, relations, registers and query understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import spans as S
from ..operators import language as L
from ..operators import relationships as R
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


def docs(spark, sf):
    return current(spark, sf, "id", "content")


COUNT = lambda t: f"CAST((length(t) - length(replace(t, '{t}', ''))) / {len(t)} AS INTEGER)"
HAS = lambda t: f"CAST(contains(t, '{t}') AS INTEGER)"
LOW = f"{CUR}, t AS (SELECT id, lower(content) AS t, content FROM cur)"
TERMS = sorted({t for ts, _ in L.FIELDS.values() for t in ts})
WORDS = "len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> ''))"


def _field(name):
    terms, contexts = L.FIELDS[name]
    multi = [f"0.5 * ({' * '.join(HAS(w) for w in t.split())})" for t in terms if " " in t]
    return f"SELECT id, '{name}' AS field, ({' + '.join([COUNT(t) for t in terms] + multi + [f'2.0 * {HAS(c)}' for c in contexts])}) / greatest(1.0, {WORDS} / 1000.0) AS score FROM t"


@query()
def entities(spark, sf):
    return L.entities(docs(spark, sf), "id", "content").select("id", "n", "type", "text", "start", "end")


@query()
def entity_counts(spark, sf):
    return L.entities(docs(spark, sf), "id", "content").groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("documents"))


@query()
def legal_segments(spark, sf):
    return S.segments(docs(spark, sf), "id", "content", L.STRUCTURE).select("id", "n", "type", "marker", F.length("content").alias("chars"))


@query()
def provisions(spark, sf):
    return S.segments(docs(spark, sf), "id", "content", L.PROVISIONS).select("id", "n", "type", "number", F.length("content").alias("chars"))


@query()
def concepts(spark, sf):
    return L.concepts(docs(spark, sf), "id", "content").select("id", "n", "type", "start", "end", F.round("confidence", 6).alias("confidence"))


@query()
def concept_relations(spark, sf):
    d = L.concept_relations(L.concepts(docs(spark, sf), "id", "content"), "id")
    return d.select("id", "n1", "n2", "relation", F.round("confidence", 6).alias("confidence"))


@query()
def concept_summary(spark, sf):
    """Best concept kinds of each text: up to five by confidence."""
    from pyspark.sql import Window

    d = L.concepts(docs(spark, sf), "id", "content").groupBy("id", "type").agg(F.max("confidence").alias("c"), F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc("c"), "type")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("id", "rank", "type", "n", F.round("c", 6).alias("confidence"))


@query()
def amendments_detect(spark, sf):
    return L.changes(docs(spark, sf), "id", "content")


@query()
def semantic_relations(spark, sf):
    d = L.relations(docs(spark, sf), "id", "content")
    return d.groupBy("id", "type").agg(F.count("*").alias("n"), F.min("start").alias("first_at"))


@query(f"WITH {LOW}, s AS ({' UNION ALL '.join(_field(n) for n in L.FIELDS)}) SELECT id, field, round(score, 6) AS score FROM s WHERE score > 0")
def field_scores(spark, sf):
    return L.field_scores(docs(spark, sf), "id", "content").select("id", "field", F.round("score", 6).alias("score"))


@query(f"WITH {LOW}, d AS (SELECT id, {WORDS} AS words, {' + '.join(COUNT(t) for t in TERMS)} AS hits, {' + '.join(HAS(t) for t in TERMS)} AS distinct_hits FROM t) SELECT id, words, hits, distinct_hits, round(hits / CAST(words AS DOUBLE), 6) AS density, round(distinct_hits / CAST(words AS DOUBLE), 6) AS unique_ratio FROM d")
def concept_density(spark, sf):
    d = L.concept_density(docs(spark, sf), "id", "content")
    return d.withColumn("density", F.round("density", 6)).withColumn("unique_ratio", F.round("unique_ratio", 6))


@query()
def definitions(spark, sf):
    return L.definitions(docs(spark, sf), "id", "content").select("id", "n", "term", "definition", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {LOW} SELECT id, " + ", ".join(f"{' + '.join(COUNT(t) for t in ts)} AS {k}" for k, ts in L.DISCOURSE.items()) + " FROM t")
def discourse_markers(spark, sf):
    return L.discourse(docs(spark, sf), "id", "content")


@query(f"WITH {LOW}, a AS (SELECT id, " + ", ".join(f"len(regexp_extract_all(t, '{p}')) AS {k}" for k, p in L.ARGUMENTS.items()) + " FROM t) SELECT id, premises, conclusions, counterarguments, justifications, premises + conclusions + counterarguments + justifications AS total, round(least(1.0, (premises + conclusions + counterarguments + justifications) / 20.0), 6) AS complexity FROM a")
def argument_structure(spark, sf):
    return L.arguments(docs(spark, sf), "id", "content").withColumn("complexity", F.round("complexity", 6))


@query()
def outline(spark, sf):
    return L.outline(docs(spark, sf), "id", "content")


def _pairs(spark, sf):
    """A law and the amendments that refer to it: formal against plain wording."""
    a = table(spark, sf, "amendments").distinct().where("amendment_text is not null").select(F.col("id").alias("amendment_id"), F.col("document_id").alias("id"), F.col("amendment_text").alias("plain"))
    return a.join(docs(spark, sf).withColumnRenamed("content", "formal"), "id").select("amendment_id", "formal", "plain")


_PHRASE = lambda c, ps: f"list_filter([{', '.join(repr(p) for p in dict.fromkeys(ps))}], lambda p: regexp_matches({c}, '(?i)(?:^|[^\\pL\\pN_])' || p || '(?:$|[^\\pL\\pN_])'))"
_PLAIN = [p for ps in L.REGISTER.values() for p in ps]
_PAIR = ", ".join(f"('{f}', '{p}')" for f, ps in L.REGISTER.items() for p in ps)


@query(f"""WITH {CUR}, f AS (SELECT id, unnest({_PHRASE('content', L.REGISTER)}) AS formal_phrase FROM cur),
 p AS (SELECT id AS amendment_id, document_id, unnest({_PHRASE('amendment_text', _PLAIN)}) AS plain_phrase FROM (SELECT DISTINCT id, document_id, amendment_text FROM amendments) z)
 SELECT amendment_id, formal_phrase, plain_phrase FROM f JOIN p ON p.document_id = f.id WHERE (formal_phrase, plain_phrase) IN ({_PAIR})""")
def register_direct(spark, sf):
    formal = docs(spark, sf).select("id", L.phrases_in(F.col("content"), list(L.REGISTER)).alias("phrases"))
    a = table(spark, sf, "amendments").select("id", "document_id", "amendment_text").distinct()
    plain = a.select(F.col("id").alias("amendment_id"), F.col("document_id").alias("id"), L.phrases_in(F.col("amendment_text"), _PLAIN).alias("phrases"))
    return L.register_direct(formal, plain, "id", "amendment_id")


_SHAPES = " UNION ALL ".join(
    f"SELECT amendment_id, '{n}' AS pattern, len(regexp_extract_all(f, '{a}')) AS formal_hits, len(regexp_extract_all(p, '{b}')) AS plain_hits, {c} AS confidence FROM q" for n, (a, b, c) in L.REGISTER_SHAPES.items()
)


@query(f"WITH {CUR}, q AS (SELECT a.id AS amendment_id, lower(c.content) AS f, lower(a.amendment_text) AS p FROM (SELECT DISTINCT id, document_id, amendment_text FROM amendments WHERE amendment_text IS NOT NULL) a JOIN cur c ON c.id = a.document_id), s AS ({_SHAPES}) SELECT amendment_id, pattern, formal_hits, plain_hits, round(CAST(least(0.9, formal_hits * plain_hits * 0.1) AS DOUBLE), 6) AS similarity, CAST(confidence AS DOUBLE) AS confidence FROM s WHERE formal_hits > 0 AND plain_hits > 0")
def register_structural(spark, sf):
    d = L.register_shapes(_pairs(spark, sf), "formal", "plain")
    return d.withColumn("similarity", F.round("similarity", 6))


_SHAPE_ROWS = [("s1", "Art. 5 stosuje się. Zabrania się palenia. Należy zgłosić.", "Artykuł 5 mówi, że nie można palić i trzeba zgłosić, trzeba pisać."), ("s2", "§ 3 ust. 1", "paragraf 3, paragraf drugi"), ("s3", "nic", "nic")]


@query("WITH q AS (SELECT amendment_id, lower(a) AS f, lower(b) AS p FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, a, b in _SHAPE_ROWS) + f") v(amendment_id, a, b)), s AS ({_SHAPES}) SELECT amendment_id, pattern, formal_hits, plain_hits, round(CAST(least(0.9, formal_hits * plain_hits * 0.1) AS DOUBLE), 6) AS similarity, CAST(confidence AS DOUBLE) AS confidence FROM s WHERE formal_hits > 0 AND plain_hits > 0")
def register_shapes(spark, sf):
    """Structural patterns of two registers on fixed rows, since the tables hold none."""
    d = L.register_shapes(spark.createDataFrame(_SHAPE_ROWS, "amendment_id string, formal string, plain string"), "formal", "plain")
    return d.withColumn("similarity", F.round("similarity", 6))


@query()
def query_understanding(spark, sf):
    """Every title as a search text."""
    d = L.query_plan(current(spark, sf, "id", "title"), "title")
    return d.select("id", "kind", F.array_join("terms", ",").alias("terms"), F.array_join("added", ",").alias("added"), F.array_join("articles", ",").alias("articles"), "year")


@query(f"SELECT kind, count(*) AS n FROM (WITH {CUR}, q AS (SELECT lower(title) AS q FROM cur) SELECT CASE WHEN regexp_matches(q, '\\bart\\.\\s*\\d+|§\\s*\\d+') THEN 'legal_reference' WHEN regexp_matches(q, '\\b(?:19|20)\\d{{2}}\\b') THEN 'temporal' WHEN " + " OR ".join(f"contains(q, '{t}')" for t in L.QUERY_PARLIAMENT) + " THEN 'cross_register' WHEN " + " OR ".join(f"contains(q, '{t}')" for t in L.QUERY_CONCEPTS) + " THEN 'concept' ELSE 'general' END AS kind FROM q) x GROUP BY kind")
def query_type(spark, sf):
    return L.query_plan(current(spark, sf, "id", "title"), "title").groupBy("kind").agg(F.count("*").alias("n"))


@query()
def relation_parties(spark, sf):
    d = R.parties(docs(spark, sf), "id", "content")
    return d.select("id", "n", "type", "name", "start", "end", F.array_join("modifiers", ",").alias("modifiers"), "time")


@query()
def relationships(spark, sf):
    d = R.relationships(docs(spark, sf), "id", "content")
    return d.select("id", "n", "type", "source_type", "target_type", "start", "end", F.round("confidence", 6).alias("confidence"))


@query()
def relation_network(spark, sf):
    return R.network(R.relationships(docs(spark, sf), "id", "content"))


@query()
def relation_insights(spark, sf):
    return R.insights(R.relationships(docs(spark, sf), "id", "content"), "id")


@query()
def text_analysis(spark, sf):
    """Complexity of a text from its concepts, their relations and its kinds of discourse markers."""
    d = docs(spark, sf)
    found = L.concepts(d, "id", "content")
    c = found.groupBy("id").agg(F.count("*").alias("concepts"))
    r = L.concept_relations(found, "id").groupBy("id").agg(F.count("*").alias("relations"))
    m = L.discourse(d, "id", "content")
    kinds = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in L.DISCOURSE), F.lit(0))
    out = m.select("id", kinds.alias("markers")).join(c, "id", "left").join(r, "id", "left").fillna(0)
    part = lambda col, n, w: w * F.least(F.lit(1.0), F.col(col) / n)
    return out.withColumn("complexity", F.round(part("concepts", 50, 0.4) + part("relations", 20, 0.4) + part("markers", 5, 0.2), 2))


@query()
def relation_hubs(spark, sf):
    return R.hubs(R.relationships(docs(spark, sf), "id", "content"))


@query()
def relation_density(spark, sf):
    return R.density(R.relationships(docs(spark, sf), "id", "content"), "id").withColumn("density", F.round("density", 6))
