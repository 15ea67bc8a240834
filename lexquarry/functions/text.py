"""Text cleaning, normalisation, tokens, statistics, typing and quality as column builders.

Patterns are Java ones with ``(?U)`` where letters beyond ASCII matter. All functions return null for a null text unless said
otherwise, and none leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, character variants, type names, patterns and word lists of the domain.
MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")
POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
PLAIN = "acelnoszzACELNOSZZ"
TYPE_PATTERNS = {
    "ustawa": r"ustawa\s+z\s+dnia\s+\d{1,2}\s+[\p{L}\p{N}_]+\s+\d{4}\s+r\.",
    "rozporządzenie": r"rozporządzenie\s+(?:ministra|rady\s+ministrów|prezesa\s+rady\s+ministrów)",
    "kodeks": r"kodeks\s+(?:cywilny|karny|postępowania\s+(?:cywilnego|karnego|administracyjnego))",
    "konstytucja": r"konstytucja\s+rzeczypospolitej\s+polskiej",
    "orzeczenie": r"(?:wyrok|postanowienie|orzeczenie)\s+(?:sądu|trybunału)",
    "uchwała": r"uchwała\s+(?:rady\s+ministrów|sejmu|senatu)",
}
ACT_PATTERNS = {
    "ustawa": r"(?i)ustawa\s+z\s+dnia\s+\d{1,2}\s+[\p{L}\p{N}_]+\s+\d{4}",
    "kodeks": r"(?i)kodeks\s+[\p{L}\p{N}_]+",
    "rozporządzenie": r"(?i)rozporządzenie\s+.+?\s+z\s+dnia\s+\d{1,2}\s+[\p{L}\p{N}_]+\s+\d{4}",
    "konstytucja": r"(?i)konstytucja\s+rzeczypospolitej\s+polskiej",
}
DOMAIN_WORDS = {
    "civil": ["cywilny", "własność", "umowa", "spadek", "rodzina"],
    "criminal": ["karny", "przestępstwo", "kara", "sąd karny"],
    "administrative": ["administracyjny", "urząd", "procedura administracyjna"],
    "commercial": ["handlowy", "spółka", "przedsiębiorstwo", "gospodarcz"],
    "labor": ["pracy", "pracownik", "pracodawca", "zatrudnienie"],
    "tax": ["podatkowy", "podatek", "vat", "pit"],
    "constitutional": ["konstytucyjny", "konstytucja", "podstawowe prawa"],
}
TITLE_WORDS = ["ustawa", "kodeks", "rozporządzenie", "konstytucja"]
LEGAL_TERMS = ["ustawa", "rozporządzenie", "konstytucja", "kodeks", "przepis", "prawo", "dziennik ustaw", "monitor polski"]
STRUCTURE_WORDS = ["określa", "stanowi", "wprowadza", "nowelizuje", "uchyla", "wchodzi w życie", "traci moc"]
ERROR_MARKS = ["404 not found", "page not found", "błąd", "error", "nie znaleziono", "strona niedostępna", "access denied", "unauthorized"]
REFERENCE_RULES = (
    (r"\bart\.\s*(\d+)", "art. $1"),
    (r"\bartykuł\s+(\d+)", "art. $1"),
    (r"§\s*(\d+)", "§ $1"),
    (r"\bpar\.\s*(\d+)", "§ $1"),
    (r"\bparagraf\s+(\d+)", "§ $1"),
    (r"\bpkt\s*(\d+)", "pkt $1"),
    (r"\bpunkt\s+(\d+)", "pkt $1"),
    (r"\brozd\.\s*(\d+)", "rozdz. $1"),
    (r"\brozdział\s+(\d+)", "rozdz. $1"),
    (r"\bu\.\s*z\.?", "ustawa z"),
    (r"\bk\.\s*c\.?", "kodeks cywilny"),
    (r"\bk\.\s*p\.\s*c\.?", "kodeks postępowania cywilnego"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace(c: Column | str, *rules: tuple[str, str]) -> Column:
    """Regular expression replacements one after the other."""
    out = col(c)
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by)
    return out


# cleaning


def clean_formatting(c) -> Column:
    """Runs of blank lines become one, runs of blanks one blank; lines and text are trimmed."""
    return F.regexp_replace(replace(c, (r"\n\s*\n", "\n\n"), (r"[ \t]+", " "), (r"(?md)^[ \t]+|[ \t]+$", "")), r"^\s+|\s+$", "")


def remove_noise(c) -> Column:
    """Drops page numbers, journal headers and positions; shortens dots, dashes and blanks after stops; drops empty lines."""
    line = lambda x: F.regexp_replace(
        F.regexp_replace(
            F.regexp_replace(F.regexp_replace(x, r"(?iU)^\s*(?:strona\s+\d+\s*|str\.\s+\d+\s*|DZIENNIK\s+USTAW.*|Poz\.\s+\d+.*)$", ""), r"\.{3,}", "..."), r"-{3,}", "---"
        ),
        r"([.!?])\s{2,}",
        "$1 ",
    )
    lines = F.transform(F.split(col(c), "\n"), lambda x: F.regexp_replace(line(x), r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_tags(c) -> Column:
    """Text of simple markup: tags and entities out, non-breaking blanks to blanks."""
    return replace(c, (r"(?is)<(script|style)[^>]*>.*?</\1>", ""), (r"<[^>]+>", ""), (r"&nbsp;", " "), (r"&amp;", "&"), (r"&[a-zA-Z]+;|&#\d+;", ""), (r"\u00A0", " "))


def plain_characters(c) -> Column:
    """Typographic quotation marks, dashes and ellipses as ASCII."""
    return F.replace(F.translate(col(c), "“”‘’–—", "\"\"''--"), F.lit("…"), F.lit("..."))


def join_numbers(c) -> Column:
    """Ranges and dates without inner blanks."""
    return replace(c, (r"\b(\d+)\s*[-–—]\s*(\d+)\b", "$1-$2"), (r"\b(\d{1,2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{4})\b", "$1.$2.$3"))


def one_space(c) -> Column:
    return F.trim(replace(c, (r"[\u00A0\u2000-\u200B\u2028\u2029]", " "), (r"\s+", " ")))


def without_diacritics(c) -> Column:
    return F.translate(col(c), POLISH, PLAIN)


def normalize(c, diacritics: bool = True) -> Column:
    """Characters, numbers and white space; letters stay composed unless ``diacritics`` is False."""
    out = plain_characters(c)
    return one_space(join_numbers(out if diacritics else without_diacritics(out)))


def normalize_references(c) -> Column:
    """References to articles, paragraphs, points, chapters and codes in one notation."""
    return replace(c, *[(f"(?iU){pattern}", by) for pattern, by in REFERENCE_RULES])


# tokens


def words(c) -> Column:
    """Words between white space, a last punctuation mark split off."""
    parts = F.filter(F.split(col(c), r"\s+"), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda x: F.when(x.rlike(r"[!-/:-@\[-`{-~]$") & (F.length(x) > 1), F.array(F.substring(x, F.lit(1), F.length(x) - 1), F.right(x, F.lit(1)))).otherwise(F.array(x))))


def space_words(c) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def word_count(c) -> Column:
    return F.size(space_words(c))


def sentences(c) -> Column:
    """Simple sentences: cut at a full stop before a capital unless after Art, art or §, and at exclamation and question marks."""
    parts = F.split(col(c), r"(?<!Art)(?<!art)(?<!§)\.(?=\s+[A-ZĄĆĘŁŃÓŚŹŻ])|[!?]+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def paragraphs(c) -> Column:
    return F.filter(F.transform(F.split(col(c), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def letter_words(c) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def count_of(c, term: str) -> Column:
    """Non-overlapping occurrences of ``term``."""
    t = col(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / len(term)).cast("int")


# typing


def first_match(c, patterns: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for name, p in reversed(list(patterns.items())):
        out = F.when(col(c).rlike(p), F.lit(name)).otherwise(out)
    return out


def header_type(c) -> Column:
    """Document type told from the first thousand characters."""
    return first_match(F.lower(F.substring(col(c), 1, 1000)), TYPE_PATTERNS)


def act_type(c) -> Column:
    """Document type told from phrases anywhere, then from bare words; ``unknown`` without any."""
    low = F.lower(col(c))
    bare = F.lit("unknown")
    for name in ("ustawa", "rozporządzenie", "kodeks", "konstytucja"):
        bare = F.when(F.contains(low, F.lit(name)), F.lit(name)).otherwise(bare)
    return F.coalesce(first_match(c, ACT_PATTERNS), bare)


def domain(c) -> Column:
    low = F.lower(col(c))
    out = F.lit("general")
    for name, ws in reversed(list(DOMAIN_WORDS.items())):
        out = F.when(any_of(low, ws), F.lit(name)).otherwise(out)
    return out


def any_of(low: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t))
    return hit


def number_of(low: Column, terms: list[str]) -> Column:
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def title_of(c) -> Column:
    """First of ten lines that names a type, else the first long line, else a placeholder; at most 500 characters."""
    lines = F.transform(F.split(col(c), "\n"), lambda x: F.trim(x))
    named = F.filter(F.slice(lines, 1, 10), lambda x: (F.length(x) > 10) & any_of(F.lower(x), TITLE_WORDS))
    long = F.filter(lines, lambda x: F.length(x) > 20)
    return F.substring(F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(long, F.lit(1)), F.lit("Untitled Document")), 1, 500)


def polish_date(c) -> Column:
    """'12 marca 2023' as a date; null if the month is unknown or the day does not exist."""
    t = F.lower(F.trim(col(c)))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(t, r"^\d{1,2}\s+([\p{L}]+)\s+\d{4}$", 1)).cast("int")
    day, year = F.regexp_extract(t, r"^(\d{1,2})\s", 1), F.regexp_extract(t, r"\s(\d{4})$", 1)
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def valid_act_id(c) -> Column:
    """Identifiers such as pl/act/2023/123 or DU/2023/123 without dangerous signs."""
    t = F.trim(col(c))
    shape = t.rlike(r"^(?:pl|PL)/|^[A-Z]{1,3}/\d{4}/\d+")
    return F.coalesce(shape & (F.length(t) >= 5) & ~t.rlike("[<>\"'&\\x00\\n\\r\\t]") & ~t.rlike(r"(?i)javascript:|vbscript:|onload\s*=|onerror\s*="), F.lit(False))


def act_id(c) -> Column:
    """Country in lower case, single slashes, none at the end."""
    t = F.regexp_replace(F.regexp_replace(F.trim(col(c)), "/+", "/"), "/+$", "")
    return F.when(t.rlike("^[A-Za-z]{2}/"), F.concat(F.lower(F.substring(t, 1, 2)), F.substring(t, F.lit(3), F.length(t)))).otherwise(t)


def sanitized(c) -> Column:
    """A query without control characters and injected statements, at most 500 characters."""
    t = replace(F.trim(col(c)), ("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f]", ""), (r"[\t\n\r\f\x0b]", " "), (r"\s+", " "))
    t = replace(t, (r"(?i)';\s*DROP\s+TABLE|';\s*DELETE\s+FROM|';\s*INSERT\s+INTO|';\s*UPDATE\s+|UNION\s+SELECT|<script[^>]*>|javascript:|vbscript:|onload\s*=|onerror\s*=", ""))
    return F.trim(F.substring(t, 1, 500))


# quality


def content_hash(c) -> Column:
    """Digest of the text in lower case with single blanks, for exact duplicates."""
    return F.sha2(F.regexp_replace(F.trim(F.lower(col(c))), r"\s+", " "), 256)


def usable_html(c, least: int = 100) -> Column:
    t = F.trim(col(c))
    return F.coalesce((F.length(t) >= least) & ~any_of(F.lower(t), ["404", "not found", "błąd", "niedostępn"]), F.lit(False))


def usable_page_text(c, least: int = 50) -> Column:
    """Long enough, a tenth letters, and half of its words of 2 to 50 signs."""
    t = F.trim(col(c))
    w = space_words(t)
    fit = F.size(F.filter(w, lambda x: F.length(x).between(2, 50)))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.coalesce((F.length(t) >= least) & (letters >= 0.1 * F.length(t)) & (fit >= 0.5 * F.size(w)), F.lit(False))


def length_score(c) -> Column:
    n = F.length(F.trim(col(c)))
    out = F.lit(0.0)
    for least, s in ((50, 0.2), (200, 0.4), (500, 0.6), (1000, 0.8), (2000, 1.0)):
        out = F.when(n >= least, F.lit(s)).otherwise(out)
    return out


def polish_ratio(c) -> Column:
    t = F.lower(col(c))
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise((F.length(t) - F.length(F.translate(t, "ąćęłńóśźż", ""))) / F.length(t))


def language_score(c) -> Column:
    t = F.lower(col(c))
    return (F.least(F.lit(1.0), polish_ratio(c) * 50) + F.least(F.lit(1.0), number_of(t, LEGAL_TERMS) * 0.2)) / 2


def structure_score(c) -> Column:
    t = F.lower(col(c))
    found = number_of(t, STRUCTURE_WORDS)
    s = F.when(t.rlike(r"(?U)\bart\.\s*\d+|artykuł\s+\d+|art\s+\d+"), 0.3).otherwise(0.0)
    s = s + F.when(t.rlike(r"§\s*\d+|paragraf\s+\d+|ust\.\s*\d+"), 0.2).otherwise(0.0)
    s = s + F.when(t.rlike(r"rozdział\s+[ivx\d]+|część\s+[ivx\d]+"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), s + F.when(found >= 2, 0.3).when(found == 1, 0.15).otherwise(0.0))


def error_penalty(c) -> Column:
    t = F.lower(col(c))
    w = space_words(t)
    p = number_of(t, ERROR_MARKS) * 0.3 + F.when(F.length(F.trim(t)) < 20, 0.2).otherwise(0.0)
    p = p + F.when((F.size(w) > 10) & (F.size(w) > 3 * F.size(F.array_distinct(w))), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), p)


def metadata_score(*fields: Column | str) -> Column:
    """Share of six descriptive fields that are filled."""
    filled = sum((F.coalesce((F.trim(col(f)) != "").cast("int"), F.lit(0)) for f in fields), F.lit(0))
    return F.least(F.lit(1.0), filled / 6)


def enhanced_quality(c, *fields: Column | str, source_bonus: float = 0.0) -> Column:
    q = length_score(c) * 0.25 + language_score(c) * 0.25 + structure_score(c) * 0.25 + metadata_score(*fields) * 0.15 + source_bonus * 0.1 - error_penalty(c)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))


def basic_quality(c, source: str = "html") -> Column:
    """Length against 2000 (markup) or 1000 (pages); a tenth on error pages."""
    n = F.length(F.trim(col(c)))
    q = F.least(F.lit(1.0), n / (2000 if source == "html" else 1000))
    q = F.when(usable_page_text(c), q * 1.1).otherwise(q * 0.5)
    return F.least(F.lit(1.0), F.when(any_of(F.lower(col(c)), ["404", "not found", "błąd", "niedostępn"]), q * 0.1).otherwise(q))


def document_quality(content, title, identifier, low: int = 100, high: int = 1_000_000) -> Column:
    """Five components of 0.2: length, title, identifier, articles, type words."""
    t, n = F.lower(col(content)), F.length(col(content))
    part = lambda p: F.when(p, 0.2).otherwise(0.0)
    return (
        part(n.between(low, high)) + part((F.length(col(title)) > 10) & (col(title) != "Untitled Document")) + part(F.length(col(identifier)) > 0)
        + part(t.rlike(r"art\.\s*\d+[a-z]?")) + part(any_of(t, ["ustawa", "kodeks", "rozporządzenie"]))
    )


def sentence_number(c) -> Column:
    """Sentences of more than ten signs, abbreviations taken out first."""
    t = F.regexp_replace(col(c), r"(?iU)\b(?:art|ust|pkt|lit|nr|ul|al|tel|fax)\.\s*", "")
    return F.size(F.filter(F.split(t, r"[.!?]+(?:\s|$)"), lambda x: F.length(F.trim(x)) > 10))


def quality_tier(chars, sentences_, score) -> Column:
    """high, medium, low, summary or insufficient."""
    c, s, q = col(chars), col(sentences_), col(score)
    return (
        F.when((c >= 500) & (s >= 10) & (q >= 0.7), "high").when((c >= 200) & (s >= 5) & (q >= 0.5), "medium")
        .when((c >= 50) & (s >= 2) & (q >= 0.3), "low").when((c >= 20) & (s >= 1) & (q >= 0.1), "summary").otherwise("insufficient")
    )


def gate_errors(content, title, identifier, quality, kind, low: int = 100, high: int = 1_000_000, least: float = 0.5) -> Column:
    """Names of the checks a document fails; empty for a valid one."""
    n = F.coalesce(F.length(col(content)), F.lit(0))
    checks = [
        (F.coalesce((F.trim(col(title)) == "") | (col(title) == "Untitled Document"), F.lit(True)), "title"),
        (n < low, "too_short"), (n > high, "too_long"), (F.coalesce(F.trim(col(identifier)) == "", F.lit(True)), "identifier"),
        (col(quality) < least, "quality"), (col(kind) == "unknown", "type"), (~F.coalesce(F.lower(col(content)).rlike(r"art\.\s*\d+[a-z]?"), F.lit(False)), "articles"),
    ]
    return F.array_compact(F.array(*[F.when(p, F.lit(name)) for p, name in checks]))


def complexity(c) -> Column:
    """0 to 100 from length, articles, references and difficult terms."""
    t = F.lower(col(c))
    articles, refs = F.regexp_count(t, F.lit(r"art\.\s*\d+")), F.regexp_count(t, F.lit(r"ust\.\s*\d+|pkt\s*\d+|§\s*\d+"))
    terms = F.regexp_count(t, F.lit("postępowani|odpowiedzialnoś|zobowiąza|rozporządzeni"))
    return F.floor(F.least(F.length(t) / 10000, F.lit(20.0)) + F.least(2 * articles, F.lit(30)) + F.least(refs, F.lit(25)) + F.least(3 * terms, F.lit(25))).cast("int")


def embedding_quality(c) -> Column:
    """How well a text suits embedding: length, articles, definitions, word length."""
    t = col(c)
    n, w = F.length(t), word_count(t)
    mean = F.length(F.regexp_replace(t, r"\s", "")) / F.greatest(w, F.lit(1))
    s = F.when(n > 1000, 0.3).when(n > 500, 0.2).when(n > 100, 0.1).otherwise(0.0)
    s = s + F.when(t.rlike(r"(?iU)\bart\.\s*\d+"), 0.2).otherwise(0.0) + F.when(t.rlike(r"§\s*\d+"), 0.1).otherwise(0.0)
    s = s + F.when(t.rlike(r"(?iU)oznacza|rozumie się|definicja"), 0.2).otherwise(0.0) + F.when((w > 10) & mean.between(4, 8), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), s)


def fixed_chunks(c, size: int = 400, overlap: int = 50) -> Column:
    """Pieces of ``size`` signs that share ``overlap`` signs."""
    t = col(c)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(t, i + 1, F.lit(size)))


def token_chunks(c, size: int = 400, overlap: int = 50) -> Column:
    """Windows of ``size`` words that overlap by ``overlap``; a text without words has none."""
    w, step = space_words(c), size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size(w) - overlap) / step)).cast("int")
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(w, i * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def sentence_chunks(c, size: int = 400) -> Column:
    """Sentences gathered greedily up to ``size`` signs; a longer sentence stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(". "), s))
        fits = (F.length(joined) <= size) | (acc["now"] == "")
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), s.alias("now")))

    return F.aggregate(sentences(c), start, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def prepared(c, least: int = 10) -> Column:
    """White space collapsed; short texts padded with blanks."""
    t = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(F.length(t) < least, F.rpad(t, least, " ")).otherwise(t)
