"""Text operators over the current legal documents and the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import text as T
from .common import CUR, current


def _over(name, column="content", out="out"):
    """A query that applies one column function to every current content."""

    def query(spark, sf):
        return current(spark, sf, "id", column).select("id", F.md5(F.encode(name(F.col(column)), "UTF-8")).alias(out))

    return query


def text_stats(spark, sf):
    d = current(spark, sf, "id", "content")
    return d.select("id", F.length("content").alias("chars"), T.word_count("content").alias("words"), F.size(T.sentences("content")).alias("sentences"), F.size(T.paragraphs("content")).alias("paragraphs"))


def content_stats(spark, sf):
    d = current(spark, sf, "id", "content")
    low = F.lower("content")
    return d.select(
        "id", F.length("content").alias("chars"), T.word_count("content").alias("words"), (T.count_of("content", "\n\n") + 1).alias("paragraphs"),
        F.regexp_count(low, F.lit(r"art\.\s*\d+[a-z]?")).alias("articles"), F.regexp_count(low, F.lit(r"ust\.\s*\d+")).alias("sections"))


def text_words(spark, sf):
    d = current(spark, sf, "id", "content")
    return d.select("id", F.size(T.words("content")).alias("tokens"), F.md5(F.encode(F.array_join(T.words("content"), "|"), "UTF-8")).alias("digest"))


def text_sentences(spark, sf):
    return current(spark, sf, "id", "content").select("id", T.sentences("content").alias("all_")).select("id", F.posexplode("all_").alias("n", "sentence"))


def text_paragraphs(spark, sf):
    return current(spark, sf, "id", "content").select("id", T.paragraphs("content").alias("all_")).select("id", F.posexplode("all_").alias("n", "paragraph")).select("id", "n", F.md5(F.encode("paragraph", "UTF-8")).alias("digest"))


def linguistic_features(spark, sf):
    d = current(spark, sf, "id", "content").select("id", T.space_words("content").alias("t"))
    return d.select("id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.lit("UNKNOWN").alias("tag"))


def type_normalize(spark, sf):
    d = table(spark, sf, "legal_documents").groupBy(F.lower(F.trim("document_type")).alias("document_type")).agg(F.count("*").alias("n"))
    return d


def header_types(spark, sf):
    d = current(spark, sf, "id", "title", "content")
    return d.select("id", T.header_type(F.concat_ws("\n", "title", "content")).alias("header_type"), T.act_type("content").alias("act_type"))


def text_domain(spark, sf):
    d = current(spark, sf, "id", "content").select(T.domain("content").alias("domain"))
    return d.groupBy("domain").agg(F.count("*").alias("n"))


def text_title(spark, sf):
    return current(spark, sf, "id", "content").select("id", T.title_of("content").alias("title"))


def text_complexity(spark, sf):
    return current(spark, sf, "id", "content").select("id", T.complexity("content").alias("complexity"))


def content_hash(spark, sf):
    return current(spark, sf, "id", "content").select("id", T.content_hash("content").alias("hash"))


def dedup_exact(spark, sf):
    """Exact duplicates of the corpus by content hash: the first document and the number of copies."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", T.content_hash("text").alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def html_usable(spark, sf):
    d = current(spark, sf, "id", "content", "html_raw_content", "pdf_extracted_text")
    return d.select("id", T.usable_html("content").alias("html_ok"), T.usable_page_text("pdf_extracted_text").alias("page_ok"))


def quality_basic(spark, sf):
    return current(spark, sf, "id", "content").select("id", F.round(T.basic_quality("content"), 6).alias("quality"))


def _enhanced(spark, sf):
    d = current(spark, sf, "id", "title", "content", "document_type", "source_url", "eli_identifier", "published_at", "preferred_source")
    fields = ["title", "document_type", "preferred_source", "eli_identifier", F.col("published_at").cast("string"), "source_url"]
    d = d.withColumn("q", T.enhanced_quality("content", *fields)).withColumn("chars", F.length(F.trim("content"))).withColumn("n", T.sentence_number("content"))
    return d


def quality_enhanced(spark, sf):
    d = _enhanced(spark, sf)
    return d.select("id", F.round(T.length_score("content"), 6).alias("length_score"), F.round(T.language_score("content"), 6).alias("language_score"), F.round(T.structure_score("content"), 6).alias("structure_score"), F.round("q", 6).alias("quality"))


def quality_tier(spark, sf):
    d = _enhanced(spark, sf).withColumn("tier", T.quality_tier("chars", "n", "q"))
    return d.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("q"), 5).alias("mean_quality"))


def document_quality(spark, sf):
    d = current(spark, sf, "id", "title", "content", "eli_identifier")
    return d.select("id", F.round(T.document_quality("content", "title", "eli_identifier"), 6).alias("quality"))


def gate_errors(spark, sf):
    d = current(spark, sf, "id", "title", "content", "eli_identifier")
    d = d.withColumn("q", T.document_quality("content", "title", "eli_identifier")).withColumn("kind", T.act_type("content"))
    d = d.select("id", T.gate_errors("content", "title", "eli_identifier", "q", "kind").alias("errors"))
    return d.select("id", (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"))


def dual_source_pick(spark, sf):
    """Better of page text and content by quality; markup wins ties."""
    d = current(spark, sf, "id", "content", "pdf_extracted_text")
    html, page = T.basic_quality("content"), F.coalesce(T.basic_quality("pdf_extracted_text", "pdf"), F.lit(0.0))
    return d.select("id", F.round(html, 6).alias("html"), F.round(page, 6).alias("page"), F.when((html >= page) & (html > 0), "html").when(page > 0, "pdf").alias("picked"))


def page_text_quality(spark, sf):
    d = current(spark, sf, "id", "pdf_extracted_text").where("pdf_extracted_text is not null")
    t = F.col("pdf_extracted_text")
    return d.select("id", F.length(t).alias("chars"), T.word_count(t).alias("words"), F.size(F.split(t, "\n")).alias("lines"), t.rlike("[ąćęłńóśźż]").alias("polish"), F.round(F.least(F.lit(1.0), F.length(t) / 1000), 6).alias("quality"), (F.length(F.trim(t)) >= 50).alias("acceptable"))


def polish_ratio(spark, sf):
    return current(spark, sf, "id", "content").select("id", F.round(T.polish_ratio("content"), 6).alias("ratio"))


def embed_quality(spark, sf):
    return current(spark, sf, "id", "content").select("id", F.round(T.embedding_quality("content"), 6).alias("quality"))


def chunk_fixed(spark, sf):
    d = current(spark, sf, "id", "content").select("id", T.fixed_chunks("content").alias("all_")).select("id", F.posexplode("all_").alias("n", "chunk"))
    return d.select("id", "n", F.length("chunk").alias("chars"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


def chunk_sentence(spark, sf):
    d = current(spark, sf, "id", "content").select("id", T.sentence_chunks("content").alias("all_")).select("id", F.posexplode("all_").alias("n", "chunk"))
    return d.select("id", "n", F.length("chunk").alias("chars"))


def text_prepared(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(F.encode(T.prepared("text"), "UTF-8")).alias("digest"))


def act_ids(spark, sf):
    d = table(spark, sf, "act_registry").select("eli_id", T.valid_act_id("eli_id").alias("valid"), T.act_id("eli_id").alias("formatted"))
    return d


def registry_dates(spark, sf):
    """Polish dates in titles of the registry, as dates."""
    d = table(spark, sf, "act_registry").select("id", F.regexp_extract("title", r"(\d{1,2}\s+\p{L}+\s+\d{4})", 1).alias("found"))
    return d.select("id", "found", T.polish_date("found").alias("day"))


def amendment_flags(spark, sf):
    """Amendment markers, and texts that change several acts."""
    d = current(spark, sf, "id", "title", "content")
    t = F.lower(F.concat_ws("\n", "title", "content"))
    laws = F.array_distinct(F.regexp_extract_all(t, F.lit(r"ustawy?\s+z\s+dnia\s+(\d{1,2}\s+[\p{L}]+\s+\d{4})"), F.lit(1)))
    return d.select("id", t.rlike("nowelizacja|zmiana|uchylenie|dodanie|skreślenie").alias("amendment"), (t.rlike(r"ustawa\s+o\s+zmianie\s+.+?\s+oraz\s+.+") | (F.size(laws) > 1)).alias("several"), F.size(laws).alias("laws"))


def legal_refs(spark, sf):
    """References to articles with section, point and letter."""
    d = current(spark, sf, "id", "content")
    p = r"art\.\s*(\d+[a-z]?)(?:\s+ust\.\s*(\d+))?(?:\s+pkt\s*(\d+))?(?:\s+lit\.\s*([a-z]))?"
    d = d.select("id", F.regexp_extract_all(F.lower("content"), F.lit(p), F.lit(0)).alias("all_")).select("id", F.posexplode("all_").alias("n", "reference"))
    part = lambda i, name: F.nullif(F.regexp_extract("reference", p, i), F.lit("")).alias(name)
    return d.select("id", "n", "reference", part(1, "article"), part(2, "section"), part(3, "point"), part(4, "letter"))


def unique_refs(spark, sf):
    d = current(spark, sf, "id", "content")
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("content"), F.lit(r"art\.\s*\d+[a-z]?|§\s*\d+|ust\.\s*\d+|pkt\s*\d+"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", " ")))
    return d.select("id", found.alias("all_")).select("id", F.explode("all_").alias("reference"))


def affected_articles(spark, sf):
    """Articles named in amendments, shorter numbers first."""
    d = table(spark, sf, "amendments").select("id", "affected_article", "amendment_text").distinct()
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "affected_article", "amendment_text")), F.lit(r"art\.?\s*(\d+[a-z]?)"), F.lit(1)))
    sort = lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return d.select("id", F.array_join(F.array_sort(found, sort), ",").alias("articles"))


QUERIES = {
    f.__name__: f
    for f in (
        text_stats, content_stats, text_words, text_sentences, text_paragraphs, linguistic_features, type_normalize, header_types, text_domain, text_title,
        text_complexity, content_hash, dedup_exact, html_usable, quality_basic, quality_enhanced, quality_tier, document_quality, gate_errors, dual_source_pick,
        page_text_quality, polish_ratio, embed_quality, chunk_fixed, chunk_sentence, text_prepared, act_ids, registry_dates, amendment_flags, legal_refs, unique_refs,
        affected_articles,
    )
} | {
    "text_clean_format": _over(T.clean_formatting), "text_noise": _over(T.remove_noise), "text_tags": _over(T.strip_tags), "text_chars": _over(T.plain_characters),
    "text_numbers": _over(T.join_numbers), "text_whitespace": _over(T.one_space), "text_normalize": _over(T.normalize), "text_references": _over(T.normalize_references),
    "text_diacritics": _over(T.without_diacritics), "query_sanitize": _over(T.sanitized, "title"),
}

WS = "len(list_filter(string_split_regex({}, '\\s+'), lambda x: x <> ''))"
WORDS = WS.format("content")
LIKE = lambda col, ws: "(" + " OR ".join(f"contains({col}, '{w}')" for w in ws) + ")"
SUM = lambda col, ws: "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INTEGER)" for w in ws) + ")"
LEN = "CASE WHEN length(trim(content)) >= 2000 THEN 1.0 WHEN length(trim(content)) >= 1000 THEN 0.8 WHEN length(trim(content)) >= 500 THEN 0.6 WHEN length(trim(content)) >= 200 THEN 0.4 WHEN length(trim(content)) >= 50 THEN 0.2 ELSE 0.0 END"
RATIO = "CASE WHEN length(content) = 0 THEN 0.0 ELSE (length(content) - length(translate(lower(content), 'ąćęłńóśźż', ''))) / CAST(length(content) AS DOUBLE) END"
LANG = f"(least(1.0, ({RATIO}) * 50) + least(1.0, {SUM('lower(content)', T.LEGAL_TERMS)} * 0.2)) / 2"
STRUCT = f"""least(1.0, CASE WHEN regexp_matches(lower(content), '\\bart\\.\\s*\\d+|artykuł\\s+\\d+|art\\s+\\d+') THEN 0.3 ELSE 0.0 END + CASE WHEN regexp_matches(lower(content), '§\\s*\\d+|paragraf\\s+\\d+|ust\\.\\s*\\d+') THEN 0.2 ELSE 0.0 END
 + CASE WHEN regexp_matches(lower(content), 'rozdział\\s+[ivx\\d]+|część\\s+[ivx\\d]+') THEN 0.2 ELSE 0.0 END + CASE WHEN {SUM('lower(content)', T.STRUCTURE_WORDS)} >= 2 THEN 0.3 WHEN {SUM('lower(content)', T.STRUCTURE_WORDS)} = 1 THEN 0.15 ELSE 0.0 END)"""
META = "least(1.0, (" + " + ".join(f"CASE WHEN trim(coalesce(CAST({f} AS VARCHAR), '')) <> '' THEN 1 ELSE 0 END" for f in ("title", "document_type", "preferred_source", "eli_identifier", "published_at", "source_url")) + ") / 6.0)"
ERR = f"least(1.0, {SUM('lower(content)', T.ERROR_MARKS)} * 0.3 + CASE WHEN length(trim(content)) < 20 THEN 0.2 ELSE 0.0 END + CASE WHEN {WORDS} > 10 AND {WORDS} > 3 * len(list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> ''))) THEN 0.1 ELSE 0.0 END)"
ENH = f"greatest(0.0, least(1.0, ({LEN}) * 0.25 + ({LANG}) * 0.25 + ({STRUCT}) * 0.25 + ({META}) * 0.15 - ({ERR})))"
READ = lambda c: f"(length(trim({c})) >= 50 AND length(regexp_replace(trim({c}), '[^\\pL]', '', 'g')) >= 0.1 * length(trim({c})) AND len(list_filter(list_filter(string_split_regex(trim({c}), '\\s+'), lambda x: x <> ''), lambda x: length(x) BETWEEN 2 AND 50)) >= 0.5 * {WS.format('trim(' + c + ')')})"
BAD = ["404", "not found", "błąd", "niedostępn"]
BASIC = lambda c, n: f"least(1.0, (least(1.0, length(trim({c})) / {n}.0) * CASE WHEN {READ(c)} THEN 1.1 ELSE 0.5 END) * CASE WHEN {LIKE('lower(' + c + ')', BAD)} THEN 0.1 ELSE 1.0 END)"
DQ = f"""(CASE WHEN length(content) BETWEEN 100 AND 1000000 THEN 0.2 ELSE 0 END + CASE WHEN length(title) > 10 AND title <> 'Untitled Document' THEN 0.2 ELSE 0 END + CASE WHEN length(eli_identifier) > 0 THEN 0.2 ELSE 0 END
 + CASE WHEN regexp_matches(lower(content), 'art\\.\\s*\\d+[a-z]?') THEN 0.2 ELSE 0 END + CASE WHEN {LIKE('lower(content)', ['ustawa', 'kodeks', 'rozporządzenie'])} THEN 0.2 ELSE 0 END)"""
P = lambda p: p.replace("'", "''").replace("(?iU)", "(?i)")
ACT = "CASE " + " ".join(f"WHEN regexp_matches(content, '{P(p)}') THEN '{k}'" for k, p in T.ACT_PATTERNS.items()) + " WHEN contains(lower(content), 'konstytucja') THEN 'konstytucja' WHEN contains(lower(content), 'kodeks') THEN 'kodeks' WHEN contains(lower(content), 'rozporządzenie') THEN 'rozporządzenie' WHEN contains(lower(content), 'ustawa') THEN 'ustawa' ELSE 'unknown' END"
HEAD = "CASE " + " ".join(f"WHEN regexp_matches(lower(substring(concat_ws(chr(10), title, content), 1, 1000)), '{P(p)}') THEN '{k}'" for k, p in T.TYPE_PATTERNS.items()) + " END"
ONE = lambda expr, col="content": f"WITH {CUR} SELECT id, md5({expr}) AS out FROM cur"
RX = lambda e, *rules: reduce(lambda a, r: f"regexp_replace({a}, '{r[0]}', '{r[1]}', 'g')", rules, e)

REF = r"art\.\s*(\d+[a-z]?)(?:\s+ust\.\s*(\d+))?(?:\s+pkt\s*(\d+))?(?:\s+lit\.\s*([a-z]))?"

ORACLES = {
    "content_stats": f"WITH {CUR} SELECT id, length(content) AS chars, {WORDS} AS words, CAST((length(content) - length(replace(content, chr(10) || chr(10), ''))) / 2 AS INTEGER) + 1 AS paragraphs, len(regexp_extract_all(lower(content), 'art\\.\\s*\\d+[a-z]?')) AS articles, len(regexp_extract_all(lower(content), 'ust\\.\\s*\\d+')) AS sections FROM cur",
    "linguistic_features": f"WITH {CUR}, t AS (SELECT id, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS t FROM cur) SELECT id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, 'UNKNOWN' AS tag FROM t",
    "type_normalize": "SELECT lower(trim(document_type)) AS document_type, count(*) AS n FROM legal_documents GROUP BY 1",
    "header_types": f"WITH {CUR} SELECT id, {HEAD} AS header_type, {ACT} AS act_type FROM cur",
    "text_domain": f"WITH {CUR}, d AS (SELECT CASE " + " ".join(f"WHEN {LIKE('lower(content)', ws)} THEN '{k}'" for k, ws in T.DOMAIN_WORDS.items()) + " ELSE 'general' END AS domain FROM cur) SELECT domain, count(*) AS n FROM d GROUP BY 1",
    "text_title": f"WITH {CUR}, l AS (SELECT id, list_transform(string_split(content, chr(10)), lambda x: trim(x)) AS l FROM cur) SELECT id, substring(coalesce(list_filter(list_slice(l, 1, 10), lambda x: length(x) > 10 AND {LIKE('lower(x)', T.TITLE_WORDS)})[1], list_filter(l, lambda x: length(x) > 20)[1], 'Untitled Document'), 1, 500) AS title FROM l",
    "text_complexity": f"WITH {CUR}, c AS (SELECT id, lower(content) AS t FROM cur) SELECT id, CAST(floor(least(length(t) / 10000.0, 20.0) + least(2 * len(regexp_extract_all(t, 'art\\.\\s*\\d+')), 30) + least(len(regexp_extract_all(t, 'ust\\.\\s*\\d+|pkt\\s*\\d+|§\\s*\\d+')), 25) + least(3 * len(regexp_extract_all(t, 'postępowani|odpowiedzialnoś|zobowiąza|rozporządzeni')), 25)) AS INTEGER) AS complexity FROM c",
    "content_hash": f"WITH {CUR} SELECT id, sha256(regexp_replace(trim(lower(content)), '\\s+', ' ', 'g')) AS hash FROM cur",
    "dedup_exact": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'))",
    "html_usable": f"WITH {CUR} SELECT id, coalesce(length(trim(content)) >= 100 AND NOT {LIKE('lower(trim(content))', BAD)}, false) AS html_ok, coalesce({READ('pdf_extracted_text')}, false) AS page_ok FROM cur",
    "quality_basic": f"WITH {CUR} SELECT id, round({BASIC('content', 2000)}, 6) AS quality FROM cur",
    "quality_enhanced": f"WITH {CUR} SELECT id, round(CAST({LEN} AS DOUBLE), 6) AS length_score, round({LANG}, 6) AS language_score, round(CAST({STRUCT} AS DOUBLE), 6) AS structure_score, round({ENH}, 6) AS quality FROM cur",
    "document_quality": f"WITH {CUR} SELECT id, round(CAST({DQ} AS DOUBLE), 6) AS quality FROM cur",
    "dual_source_pick": f"WITH {CUR}, s AS (SELECT id, {BASIC('content', 2000)} AS html, coalesce({BASIC('pdf_extracted_text', 1000)}, 0.0) AS page FROM cur) SELECT id, round(html, 6) AS html, round(page, 6) AS page, CASE WHEN html >= page AND html > 0 THEN 'html' WHEN page > 0 THEN 'pdf' END AS picked FROM s",
    "page_text_quality": f"WITH {CUR} SELECT id, length(pdf_extracted_text) AS chars, {WS.format('pdf_extracted_text')} AS words, len(string_split(pdf_extracted_text, chr(10))) AS lines, regexp_matches(pdf_extracted_text, '[ąćęłńóśźż]') AS polish, round(least(1.0, length(pdf_extracted_text) / 1000.0), 6) AS quality, length(trim(pdf_extracted_text)) >= 50 AS acceptable FROM cur WHERE pdf_extracted_text IS NOT NULL",
    "polish_ratio": f"WITH {CUR} SELECT id, round({RATIO}, 6) AS ratio FROM cur",
    "chunk_fixed": f"WITH {CUR}, c AS (SELECT id, content, unnest(range(0, greatest(length(content), 1), 350)) AS s FROM cur) SELECT id, CAST(s // 350 AS INTEGER) AS n, length(substring(content, s + 1, 400)) AS chars, md5(substring(content, s + 1, 400)) AS digest FROM c",
    "text_prepared": "SELECT doc_id, md5(CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) < 10 THEN rpad(trim(regexp_replace(text, '\\s+', ' ', 'g')), 10, ' ') ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END) AS digest FROM documents WHERE text IS NOT NULL",
    "amendment_flags": f"WITH {CUR}, t AS (SELECT id, lower(concat_ws(chr(10), title, content)) AS t FROM cur), l AS (SELECT id, t, len(list_distinct(regexp_extract_all(t, 'ustawy?\\s+z\\s+dnia\\s+(\\d{{1,2}}\\s+[\\pL]+\\s+\\d{{4}})', 1))) AS laws FROM t) SELECT id, regexp_matches(t, 'nowelizacja|zmiana|uchylenie|dodanie|skreślenie') AS amendment, regexp_matches(t, 'ustawa\\s+o\\s+zmianie\\s+.+?\\s+oraz\\s+.+') OR laws > 1 AS several, laws FROM l",
    "unique_refs": f"WITH {CUR}, r AS (SELECT DISTINCT id, unnest(list_transform(regexp_extract_all(lower(content), 'art\\.\\s*\\d+[a-z]?|§\\s*\\d+|ust\\.\\s*\\d+|pkt\\s*\\d+'), lambda x: regexp_replace(x, '\\s+', ' ', 'g'))) AS reference FROM cur) SELECT id, reference FROM r",
    "text_chars": ONE("replace(translate(content, '“”‘’–—', '\"\"''''--'), '…', '...')"),
    "text_numbers": ONE(RX("content", (r"\b(\d+)\s*[-–—]\s*(\d+)\b", r"\1-\2"), (r"\b(\d{1,2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{4})\b", r"\1.\2.\3"))),
    "text_whitespace": ONE("trim(regexp_replace(regexp_replace(content, '[\\x{00A0}\\x{2000}-\\x{200B}\\x{2028}\\x{2029}]', ' ', 'g'), '\\s+', ' ', 'g'))"),
    "text_diacritics": ONE(f"translate(content, '{T.POLISH}', '{T.PLAIN}')"),
    "act_ids": "WITH t AS (SELECT eli_id, trim(eli_id) AS t FROM act_registry) SELECT eli_id, regexp_matches(t, '^(?:pl|PL)/|^[A-Z]{1,3}/\\d{4}/\\d+') AND length(t) >= 5 AND NOT regexp_matches(t, '[<>\"&\\t\\n]') AS valid, CASE WHEN regexp_matches(t, '^[A-Za-z]{2}/') THEN lower(substring(t, 1, 2)) || substring(regexp_replace(regexp_replace(t, '/+', '/', 'g'), '/+$', ''), 3) ELSE regexp_replace(regexp_replace(t, '/+', '/', 'g'), '/+$', '') END AS formatted FROM t",
    "text_paragraphs": f"WITH {CUR}, p AS (SELECT id, list_filter(list_transform(string_split_regex(content, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM cur) SELECT id, CAST(i - 1 AS INTEGER) AS n, md5(l[i]) AS digest FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM p) x",
    "text_words": f"WITH {CUR}, w AS (SELECT id, flatten(list_transform(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> ''), lambda x: CASE WHEN length(x) > 1 AND regexp_matches(x, '[!-/:-@\\[-`{{-~]$') THEN [substring(x, 1, length(x) - 1), right(x, 1)] ELSE [x] END)) AS w FROM cur) SELECT id, len(w) AS tokens, md5(array_to_string(w, '|')) AS digest FROM w",
    "gate_errors": f"""WITH {CUR}, q AS (SELECT *, {DQ} AS q, {ACT} AS kind FROM cur), e AS (SELECT id, concat_ws(',', CASE WHEN coalesce(trim(title) = '' OR title = 'Untitled Document', true) THEN 'title' END, CASE WHEN coalesce(length(content), 0) < 100 THEN 'too_short' END,
        CASE WHEN coalesce(length(content), 0) > 1000000 THEN 'too_long' END, CASE WHEN coalesce(trim(eli_identifier) = '', true) THEN 'identifier' END, CASE WHEN q < 0.5 THEN 'quality' END, CASE WHEN kind = 'unknown' THEN 'type' END,
        CASE WHEN NOT coalesce(regexp_matches(lower(content), 'art\\.\\s*\\d+[a-z]?'), false) THEN 'articles' END) AS errors FROM q) SELECT id, errors = '' AS valid, errors FROM e""",
    "legal_refs": f"WITH {CUR}, r AS (SELECT id, regexp_extract_all(lower(content), '{REF}') AS l FROM cur), x AS (SELECT id, CAST(i - 1 AS INTEGER) AS n, l[i] AS reference FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM r) y) SELECT id, n, reference, nullif(regexp_extract(reference, '{REF}', 1), '') AS article, nullif(regexp_extract(reference, '{REF}', 2), '') AS section, nullif(regexp_extract(reference, '{REF}', 3), '') AS point, nullif(regexp_extract(reference, '{REF}', 4), '') AS letter FROM x",
}

_SEVERAL = {
    "text_clean_format": ONE("regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '(?m)^[ \\t]+|[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')"),
    "text_tags": ONE(RX("content", ("(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""), ("<[^>]+>", ""), ("&nbsp;", " "), ("&amp;", "&"), (r"&[a-zA-Z]+;|&#\d+;", ""), (r"\x{00A0}", " "))),
    "text_noise": ONE(
        "array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace("
        + RX("x", (r"(?i)^\s*(?:strona\s+\d+\s*|str\.\s+\d+\s*|DZIENNIK\s+USTAW.*|Poz\.\s+\d+.*)$", ""), (r"\.{3,}", "..."), ("-{3,}", "---"), (r"([.!?])\s{2,}", r"\1 "))
        + ", '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"
    ),
    "text_normalize": ONE(
        "trim("
        + RX(
            "replace(translate(content, '“”‘’–—', '\"\"''''--'), '…', '...')", (r"\b(\d+)\s*[-–—]\s*(\d+)\b", r"\1-\2"), (r"\b(\d{1,2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{4})\b", r"\1.\2.\3"),
            (r"[\x{00A0}\x{2000}-\x{200B}\x{2028}\x{2029}]", " "), (r"\s+", " "),
        )
        + ")"
    ),
    "query_sanitize": ONE(
        "trim(substring("
        + RX(
            "trim(title)", (r"[\x00-\x08\x0e-\x1f\x7f-\x{9f}]", ""), (r"[\t\n\r\f\x0b]", " "), (r"\s+", " "),
            (r"(?i)'';\s*DROP\s+TABLE|'';\s*DELETE\s+FROM|'';\s*INSERT\s+INTO|'';\s*UPDATE\s+|UNION\s+SELECT|<script[^>]*>|javascript:|vbscript:|onload\s*=|onerror\s*=", ""),
        )
        + ", 1, 500))"
    ),
    "embed_quality": f"WITH {CUR}, m AS (SELECT id, content, length(content) AS n, {WORDS} AS w, length(regexp_replace(content, '\\s', '', 'g')) / CAST(greatest({WORDS}, 1) AS DOUBLE) AS mean FROM cur) SELECT id, round(CAST(least(1.0, CASE WHEN n > 1000 THEN 0.3 WHEN n > 500 THEN 0.2 WHEN n > 100 THEN 0.1 ELSE 0.0 END + CASE WHEN regexp_matches(content, '(?i)\\bart\\.\\s*\\d+') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(content, '§\\s*\\d+') THEN 0.1 ELSE 0.0 END + CASE WHEN regexp_matches(content, '(?i)oznacza|rozumie się|definicja') THEN 0.2 ELSE 0.0 END + CASE WHEN w > 10 AND mean BETWEEN 4 AND 8 THEN 0.2 ELSE 0.0 END) AS DOUBLE), 6) AS quality FROM m",
    "registry_dates": f"WITH f AS (SELECT id, regexp_extract(title, '(\\d{{1,2}}\\s+\\pL+\\s+\\d{{4}})', 1) AS found FROM act_registry), p AS (SELECT id, found, list_position([{', '.join(repr(m) for m in T.MONTHS)}], regexp_extract(lower(found), '^\\d{{1,2}}\\s+([\\pL]+)\\s+\\d{{4}}$', 1)) AS m FROM f) SELECT id, found, CASE WHEN m > 0 THEN TRY_CAST(concat(regexp_extract(found, '\\s(\\d{{4}})$', 1), '-', lpad(CAST(m AS VARCHAR), 2, '0'), '-', lpad(regexp_extract(found, '^(\\d{{1,2}})\\s', 1), 2, '0')) AS DATE) END AS day FROM p",
}
ORACLES |= _SEVERAL
# a stop before a capital, but after Art, art and §, told without looking back or ahead
_MARKED = "regexp_replace(replace(replace(replace(content, 'Art.', 'Art' || chr(1)), 'art.', 'art' || chr(1)), '§.', '§' || chr(1)), '\\.(\\s+[A-ZĄĆĘŁŃÓŚŹŻ])', chr(2) || '\\1', 'g')"
_BLANK = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\v]"  # as (?U)\\s
_SENTENCES = f"list_filter(list_transform(string_split_regex({_MARKED}, '\\x02|[!?]+'), lambda x: regexp_replace(replace(x, chr(1), '.'), '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '')"
_PARAGRAPHS = "list_filter(list_transform(string_split_regex(content, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
ORACLES |= {
    "text_sentences": f"WITH {CUR}, s AS (SELECT id, {_SENTENCES} AS s FROM cur) SELECT id, CAST(i - 1 AS INTEGER) AS n, s[i] AS sentence FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM s) x",
    "text_stats": f"WITH {CUR} SELECT id, length(content) AS chars, {WORDS} AS words, len({_SENTENCES}) AS sentences, len({_PARAGRAPHS}) AS paragraphs FROM cur",
}
ORACLES["affected_articles"] = (
    "WITH a AS (SELECT DISTINCT id, affected_article, amendment_text FROM amendments), l AS (SELECT id, list_distinct(regexp_extract_all(lower(concat_ws(' ', affected_article, amendment_text)), 'art\\.?\\s*(\\d+[a-z]?)', 1)) AS l FROM a) "
    "SELECT id, array_to_string(list_transform(list_sort(list_transform(l, lambda x: {'n': length(x), 'x': x})), lambda y: y.x), ',') AS articles FROM l"
)
