"""Search texts understood: terms of a dictionary, abbreviations both ways, references, times; and the match of two registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language import SYNONYMS
from .search import stripped, word_set

# The dictionary of legal terms, in groups.
TERMS = [
    "ustawa", "kodeks", "rozporządzenie", "konstytucja", "orzeczenie", "wyrok", "uchwała", "obwieszczenie", "artykuł", "paragraf", "ustęp", "punkt", "litera",
    "prawo", "przepis", "norma", "regulacja", "zobowiązanie", "odpowiedzialność", "sankcja", "kara", "grzywna", "postępowanie", "proces", "sprawa", "wniosek",
    "sąd", "trybunał", "prokuratura", "policja", "minister", "ministerstwo", "urząd", "gmina", "powiat", "województwo", "sejm", "senat",
    "nowelizacja", "zmiana", "uchylenie", "dodanie", "wejście w życie", "vacatio legis", "publikacja", "ogłoszenie", "promulgacja",
    "zgodnie z", "na podstawie", "w związku z", "z zastrzeżeniem", "nie dotyczy", "stosuje się",
]
# Abbreviations of terms.
ABBREVIATIONS = {
    "artykuł": ["art.", "art"], "paragraf": ["§", "par."], "ustęp": ["ust.", "ust"], "punkt": ["pkt", "pkt."], "ustawa": ["u.", "ust."], "rozporządzenie": ["rozp.", "rozp"],
}
# Patterns of references and of times in search texts.
REFERENCES = {
    "article": r"\bart\.\s*(\d+)(?:\s*ust\.\s*(\d+))?(?:\s*pkt\s*(\d+))?",
    "paragraph": r"§\s*(\d+)(?:\s*ust\.\s*(\d+))?",
    "act_reference": r"\bustaw[aąy]\s+z\s+dnia\s+(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})",
    "regulation": r"\brozporządzeni[aeu]\s+(\S+)",
}
TIMES = {
    "year": r"\b(?:19|20)\d{2}\b",
    "date_range": r"\bod\s+\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\s+do\s+\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}|\bpomiędzy\s+\d{4}\s*[ai]\s*\d{4}",
    "relative_time": r"\bw\s*ostatni[ch]*\s*\d+\s*(?:rok|lat|miesiąc|dni)|\bprzed\s*\d+\s*(?:rok|lat|miesiąc|dni)|\bpo\s*\d{4}",
}
# Patterns of key terms of a text.
KEY_TERMS = [
    r"art\.\s*\d+", r"§\s*\d+", r"ust\.\s*\d+", r"pkt\s*\d+", r"rozdział\s*[\p{L}\p{N}_]+", r"dział\s*[\p{L}\p{N}_]+",
    "należy", "powinien", "zobowiązany", "uprawniony", "zabrania się", "nie wolno", "dozwolone",
]
# Names of document types and the standard type of each.
TYPES = {
    "ustawa": ["act", "law", "ustawy", "ustaw", "ustawa"], "rozporządzenie": ["regulation", "rozporzadzenie", "rozporządzenie", "rozporządzeń"],
    "kodeks": ["code", "kodeks", "kodeksu", "kodeksy"], "konstytucja": ["constitution", "konstytucja", "konstytucji"],
    "dekret": ["decree", "dekret", "dekretu", "dekrety"], "uchwała": ["resolution", "uchwala", "uchwała", "uchwały"],
}


def standard_type(name: Column) -> Column:
    """The standard type of a name of a type, in any case and with blanks around it; null for other names."""
    n, out = F.lower(F.trim(name)), F.lit(None).cast("string")
    for kind, names in TYPES.items():
        out = F.when(n.isin(names), kind).otherwise(out)
    return out


def array_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def terms_in(query: Column) -> Column:
    """Terms of the dictionary that occur in a search text, in the order of the dictionary."""
    low = F.lower(query)
    return F.filter(array_of(TERMS), lambda t: F.contains(low, t))


def expansions(query: Column) -> Column:
    """Synonyms of the terms found, and for each word its abbreviations or what it abbreviates; sorted, each once."""
    low = F.lower(query)
    words = F.split(F.trim(F.regexp_replace(low, r"\s+", " ")), " ")
    none = F.array().cast("array<string>")
    parts = [F.when(F.contains(low, F.lit(t)), array_of(ss)).otherwise(none) for t, ss in SYNONYMS.items()]
    for full, short in ABBREVIATIONS.items():
        parts.append(F.when(F.array_contains(words, full), array_of(short)).otherwise(none))
        parts.append(F.when(F.arrays_overlap(words, array_of(short)), array_of([full])).otherwise(none))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def matches(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """``key, kind, n, found``: every match of each pattern, numbered within its kind."""
    low = F.lower(text)
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(low, F.lit(p), F.lit(0)).alias("all")) for k, p in patterns.items()])
    d = df.select(key, every.alias("e")).select(key, F.explode("e").alias("e")).select(key, "e.kind", F.posexplode("e.all").alias("n", "found"))
    return d


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """References with article, section and point, or the date of the act."""
    d = matches(df, key, text, REFERENCES)
    part = lambda kind, i: F.nullif(F.regexp_extract("found", REFERENCES[kind], i), F.lit(""))
    article = F.when(F.col("kind") == "article", part("article", 1)).when(F.col("kind") == "paragraph", part("paragraph", 1))
    section = F.when(F.col("kind") == "article", part("article", 2)).when(F.col("kind") == "paragraph", part("paragraph", 2))
    return d.select(key, "kind", "n", "found", article.alias("article"), section.alias("section"), F.when(F.col("kind") == "article", part("article", 3)).alias("point"), F.when(F.col("kind") == "act_reference", part("act_reference", 1)).alias("day"))


def key_terms(text: Column) -> Column:
    """The distinct key terms of a text, sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in KEY_TERMS]))))


def long_sentences(text: Column, least: int = 20) -> Column:
    """Sentences, cut at full stops, of more than ``least`` signs."""
    return F.filter(F.transform(F.split(text, r"\."), stripped), lambda s: F.length(s) > least)


def sentence_matches(formal: DataFrame, plain: DataFrame, key: str, plain_key: str, text: str, plain_text: str, least: float = 0.5) -> DataFrame:
    """Sentences of two registers about the same ``key`` whose word vectors have a cosine of ``least``: the match by meaning.

    The vector of a sentence has a 1 for each of its words. Sentences meet through a word they share, the rarest ones of the
    ``key`` not being told from others: pairs within a key are those of two texts, never of the whole collection. Equal
    sentences of a text count once.
    """
    a = formal.select(key, F.explode(F.array_distinct(long_sentences(F.col(text)))).alias("formal")).withColumn("fw", word_set(F.col("formal")))
    b = plain.select(key, plain_key, F.explode(F.array_distinct(long_sentences(F.col(plain_text)))).alias("plain")).withColumn("pw", word_set(F.col("plain")))
    both = F.size(F.array_intersect("fw", "pw"))
    sim = both / F.sqrt(F.size("fw").cast("double") * F.size("pw"))
    d = a.join(b, key).withColumn("similarity", sim).where(F.col("similarity") >= least)
    return d.select(plain_key, "formal", "plain", "similarity", F.least(F.lit(0.8), F.col("similarity") + 0.1).alias("confidence"))


def all_matches(direct: DataFrame, meaning: DataFrame, structural: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """The matches of all three kinds above a confidence: ``key, kind, formal, plain, similarity, confidence``."""
    x = direct.select(key, F.lit("direct").alias("kind"), F.col("formal_phrase").alias("formal"), F.col("plain_phrase").alias("plain"), F.lit(0.5).alias("similarity"), F.lit(0.9).alias("confidence"))
    y = meaning.select(key, F.lit("semantic").alias("kind"), "formal", "plain", "similarity", "confidence")
    z = structural.select(key, F.lit("structural").alias("kind"), F.col("pattern").alias("formal"), F.col("pattern").alias("plain"), "similarity", F.col("confidence").cast("double").alias("confidence"))
    return x.unionByName(y).unionByName(z).where(F.col("confidence") >= least)


def boosted(results: DataFrame, found: DataFrame, key: str, top: int = 3) -> DataFrame:
    """Scores raised by a tenth of the best match of a result, with its ``top`` best matches; 0 without a match."""
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "formal", "plain")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    best = best.groupBy(key).agg(F.max("similarity").alias("m"), F.count("*").alias("matches"))
    out = results.join(best, key, "left")
    m = F.coalesce("m", F.lit(0.0))
    return out.select(key, (F.col("score") * (1 + 0.1 * m)).alias("score"), m.alias("cross_score"), F.coalesce("matches", F.lit(0)).alias("matches"))
