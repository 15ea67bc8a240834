"""Entities, legal concepts, relations, definitions, discourse and matching of registers, parametric in their lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T

# Patterns and word lists of Polish legal language.
STRUCTURE = {
    "article": [r"(?:art\.|artykuł)\s*(\d+)"], "paragraph": [r"§\s*(\d+)"], "point": [r"(?:pkt|punkt)\s*(\d+)"], "letter": [r"([a-z])\)"],
    "chapter": [r"(?:rozdz\.|rozdział)\s*(\d+|[IVX]+)"], "section": [r"(?:dział|sekcja)\s*(\d+|[IVX]+)"],
}
PROVISIONS = {
    "article": [r"(?:art\.|artykuł)\s*(\d+[a-z]?)"], "paragraph": [r"§\s*(\d+[a-z]?)"], "ustep": [r"(?<=\n)\s*(\d+)\.\s*"], "point": [r"(\d+)\)\s*"],
    "letter": [r"([a-z])\)\s*"], "chapter": [r"(?:rozdział|rozdz\.|rozd\.)\s*([IVX]+|\d+)"], "section": [r"(?:\bdział\b|sekcja)\s*([IVX]+|\d+)"], "title": [r"(?:tytuł)\s*([IVX]+|\d+)"],
}
ENTITIES = {
    "law_reference": [
        r"ustawa\s+z\s+dnia\s+\d{1,2}\s+\w+\s+\d{4}\s+r\.", r"rozporządzenie\s+(?:Ministra|Rady\s+Ministrów)\s+z\s+dnia\s+\d{1,2}\s+\w+\s+\d{4}\s+r\.",
        r"kodeks\s+(?:cywilny|karny|postępowania\s+(?:cywilnego|karnego))", r"konstytucja\s+rzeczypospolitej\s+polskiej",
    ],
    "article_reference": [r"art\.\s*\d+(?:\s*ust\.\s*\d+)?(?:\s*pkt\s*\d+)?", r"artykuł\s+\d+(?:\s+ustęp\s+\d+)?(?:\s+punkt\s+\d+)?"],
    "paragraph_reference": [r"§\s*\d+(?:\s*ust\.\s*\d+)?", r"paragraf\s+\d+(?:\s+ustęp\s+\d+)?"],
    "court_name": [
        r"sąd\s+najwyższy", r"trybunał\s+konstytucyjny", r"naczelny\s+sąd\s+administracyjny", r"wojewódzki\s+sąd\s+administracyjny",
        r"sąd\s+(?:rejonowy|okręgowy|apelacyjny)", r"sąd\s+\w+\s+w\s+\w+",
    ],
    "legal_person": [r"spółka\s+(?:z\s+ograniczoną\s+odpowiedzialnością|akcyjna)", r"(?:sp\.\s*z\s*o\.o\.|s\.a\.)", r"fundacja\s+\w+", r"stowarzyszenie\s+\w+"],
}
CONCEPTS = {
    "legal_definition": [
        r"(?:oznacza|znaczy|rozumie się|definiuje się jako)\s+(.+?)(?:\.|;)", r"(?:w rozumieniu niniejszej ustawy|w rozumieniu przepisów)\s+(.+?)(?:\.|;)",
        r"(?:przez|pod pojęciem)\s+(.+?)\s+(?:rozumie się|należy rozumieć)",
    ],
    "legal_principle": [
        r"(?:jest|stanowi)\s+(?:państwem|zasadą|podstawą)\s+(.+?)(?:\.|;)", r"(?:zasada|podstawa|reguła|norma)\s+(.+?)(?:\.|;)",
        r"(?:urzeczywistnia|realizuje|gwarantuje)\s+(?:zasady|podstawy)\s+(.+?)(?:\.|;)", r"(?:władza|zwierzchnictwo|suwerenność)\s+(.+?)(?:\.|;)",
    ],
    "obligation": [
        r"(?:jest obowiązany|ma obowiązek|powinien|zobowiązuje się)\s+(.+?)(?:\.|;)", r"(?:obowiązek|zobowiązanie)\s+(?:do\s+)?(.+?)(?:\.|;)",
        r"(?:należy|trzeba|konieczne jest)\s+(.+?)(?:\.|;)",
    ],
    "prohibition": [
        r"(?:zabrania się|nie wolno|nie można|zabronione jest)\s+(.+?)(?:\.|;)", r"(?:zakaz|prohibicja)\s+(.+?)(?:\.|;)",
        r"(?:nie ma prawa|nie jest uprawniony)\s+(.+?)(?:\.|;)",
    ],
    "right": [
        r"(?:ma prawo|jest uprawniony|przysługuje mu prawo)\s+(.+?)(?:\.|;)", r"(?:prawo do|uprawnienie do)\s+(.+?)(?:\.|;)", r"(?:może|wolno mu)\s+(.+?)(?:\.|;)",
    ],
    "penalty": [
        r"(?:podlega karze|karze się|grozi kara)\s+(.+?)(?:\.|;)", r"(?:kara|sankcja|grzywna)\s+(?:w wysokości\s+)?(.+?)(?:\.|;)",
        r"(?:zostanie ukarany|poniesie odpowiedzialność)\s+(.+?)(?:\.|;)",
    ],
    "condition": [
        r"(?:pod warunkiem|w przypadku gdy|jeżeli|gdy)\s+(.+?)(?:\.|;|,)", r"(?:warunek|przesłanka)\s+(.+?)(?:\.|;)",
        r"(?:wymaga się|konieczne jest spełnienie)\s+(.+?)(?:\.|;)",
    ],
    "exception": [
        r"(?:z wyjątkiem|nie dotyczy|nie ma zastosowania)\s+(.+?)(?:\.|;)", r"(?:wyjątek|odstępstwo)\s+(?:od\s+)?(.+?)(?:\.|;)", r"(?:za wyjątkiem|oprócz)\s+(.+?)(?:\.|;)",
    ],
}
CONTEXT_TERMS = [
    "postępowanie", "procedura", "tryb", "wniosek", "odwołanie", "skarga", "protest", "sprzeciw", "rozpoznanie", "rozstrzygnięcie", "sąd", "trybunał", "urząd",
    "minister", "wojewoda", "starosta", "komisja", "rada", "organ", "instytucja", "jednostka", "termin", "okres", "czas", "dzień", "miesiąc", "rok", "natychmiast",
    "niezwłocznie", "w terminie", "do dnia", "warunek", "przesłanka", "wymóg", "kryterium", "podstawa", "uzasadnienie", "powód", "okoliczność", "sytuacja",
]
AMENDING = {
    "addition": [r"(?:dodaje się|wprowadza się|dopisuje się)\s+(.+?)(?:\.|;)", r"(?:nowy|dodatkowy)\s+(?:artykuł|paragraf|punkt|ustęp)\s+(.+?)(?:\.|;)"],
    "modification": [
        r"(?:zmienia się|modyfikuje się)\s+(.+?)\s+(?:na|przez)\s+(.+?)(?:\.|;)", r"(?:w miejsce|zamiast)\s+(.+?)\s+(?:wstawia się|wprowadza się)\s+(.+?)(?:\.|;)",
        r"(?:zastępuje się)\s+(.+?)\s+(?:słowami|wyrazami|tekstem)\s+(.+?)(?:\.|;)",
    ],
    "deletion": [r"(?:usuwa się|skreśla się|uchyla się)\s+(.+?)(?:\.|;)", r"(?:traci moc|zostaje uchylony)\s+(.+?)(?:\.|;)"],
}
RELATION_RULES = [
    ("condition", "obligation", "conditional_obligation", 0.15), ("condition", "right", "conditional_right", 0.15), ("obligation", "penalty", "violation_penalty", 0.2),
    ("prohibition", "penalty", "violation_penalty", 0.2), ("legal_definition", "obligation", "definition_application", 0.1),
    ("exception", "obligation", "exception_to_rule", 0.0), ("exception", "prohibition", "exception_to_rule", 0.0),
]
SEMANTIC = {
    "causal": [
        r"(?:z powodu|na skutek|w wyniku|spowodowane przez)\s+(.+?)(?:\.|,|;)", r"(?:prowadzi do|skutkuje|powoduje|wynika z)\s+(.+?)(?:\.|,|;)",
        r"(?:przyczyna|skutek|następstwo)\s+(.+?)(?:\.|,|;)",
    ],
    "temporal": [
        r"(?:przed|po|podczas|w trakcie|w czasie)\s+(.+?)(?:\.|,|;)", r"(?:następnie|później|wcześniej|równocześnie)\s+(.+?)(?:\.|,|;)",
        r"(?:od momentu|do czasu|w okresie)\s+(.+?)(?:\.|,|;)",
    ],
    "modal": [
        r"(?:może|powinien|musi|jest obowiązany|ma prawo)\s+(.+?)(?:\.|,|;)", r"(?:wolno|można|należy|trzeba|konieczne jest)\s+(.+?)(?:\.|,|;)",
        r"(?:dopuszczalne|niedopuszczalne|zakazane|dozwolone)\s+(.+?)(?:\.|,|;)",
    ],
    "conditional": [r"(?:pod warunkiem|w przypadku|jeśli|gdy)\s+(.+?)(?:\.|,|;)", r"(?:o ile|chyba że|z wyjątkiem)\s+(.+?)(?:\.|,|;)"],
}
DEFINITIONS = {
    "definition": [
        r"(\w+(?:\s+\w+)*)\s+(?:oznacza|znaczy|to)\s+(.+?)(?:\.|;)", r"(?:przez|pod pojęciem)\s+(\w+(?:\s+\w+)*)\s+(?:rozumie się|należy rozumieć)\s+(.+?)(?:\.|;)",
        r"(\w+(?:\s+\w+)*)\s+(?:w rozumieniu|na potrzeby)\s+(?:niniejszej ustawy|niniejszego aktu|przepisów)\s+(?:to|oznacza)\s+(.+?)(?:\.|;)",
    ]
}
DISCOURSE = {
    "addition": ["ponadto", "dodatkowo", "również", "oraz", "a także"], "contrast": ["jednak", "natomiast", "ale", "lecz", "jednakże"],
    "consequence": ["w związku z tym", "w wyniku", "skutkiem", "dlatego"], "condition": ["jeżeli", "gdy", "w przypadku gdy", "pod warunkiem"],
    "exception": ["z wyjątkiem", "oprócz", "za wyjątkiem", "nie dotyczy"],
}
ARGUMENTS = {
    "premises": r"ponieważ|gdyż|bowiem|albowiem|z uwagi na to, że|mając na uwadze|uwzględniając|w związku z tym, że",
    "conclusions": r"dlatego|w związku z tym|stąd|zatem|wobec tego|z tego wynika|można stwierdzić|należy uznać",
    "counterarguments": r"jednak|jednakże|niemniej|mimo to|pomimo|z drugiej strony|natomiast|ale|lecz",
    "justifications": r"uzasadnienie|podstawa prawna|ratio legis|cel ustawy|zamierzenie prawodawcy",
}
FIELDS = {
    "civil_law": (["własność", "posiadanie", "użytkowanie", "spadek", "dziedziczenie", "umowa", "zobowiązanie", "szkoda", "odszkodowanie", "odpowiedzialność", "małżeństwo", "rozwód", "alimenty", "kuratela", "opieka"], ["kodeks cywilny", "prawo cywilne", "stosunki cywilnoprawne"]),
    "criminal_law": (["przestępstwo", "wykroczenie", "kara", "grzywna", "więzienie", "napaść", "kradzież", "oszustwo", "zabójstwo", "przemoc", "prokurator", "oskarżyciel", "podejrzany", "świadek"], ["kodeks karny", "prawo karne", "postępowanie karne"]),
    "administrative_law": (["organ administracji", "decyzja administracyjna", "postępowanie administracyjne", "odwołanie", "skarga", "samorząd", "gmina", "powiat", "województwo", "pozwolenie", "koncesja", "licencja", "rejestracja", "kontrola"], ["kodeks postępowania administracyjnego", "prawo administracyjne"]),
    "constitutional_law": (["konstytucja", "prawa podstawowe", "wolności obywatelskie", "sejm", "senat", "prezydent", "rada ministrów", "trybunał konstytucyjny", "demokracja", "suwerenność", "rozdział władz"], ["konstytucja", "ustrój", "system prawny"]),
    "tax_law": (["podatek", "składka", "opłata", "danina", "vat", "cit", "pit", "ordynacja podatkowa", "zobowiązanie podatkowe", "ulga podatkowa", "kontrola podatkowa", "interpretacja podatkowa"], ["prawo podatkowe", "ordynacja podatkowa", "fiskus"]),
    "labor_law": (["umowa o pracę", "stosunek pracy", "pracodawca", "pracownik", "wynagrodzenie", "urlop", "zwolnienie", "wypowiedzenie", "kodeks pracy", "czas pracy", "bezpieczeństwo pracy", "związki zawodowe"], ["kodeks pracy", "prawo pracy", "stosunki pracy"]),
}
REGISTER = {
    "niniejsza ustawa": ["ta ustawa", "obecna ustawa", "przedmiotowa ustawa"], "w rozumieniu niniejszej ustawy": ["według tej ustawy", "w tej ustawie"],
    "stosuje się przepisy": ["obowiązują przepisy", "mają zastosowanie przepisy"], "z zastrzeżeniem": ["oprócz przypadków", "z wyjątkiem"],
    "podlega karze": ["grozi kara", "można ukarać"], "organ właściwy": ["właściwy urząd", "odpowiedni organ"], "w terminie": ["do czasu", "w ciągu"],
    "zgodnie z": ["według", "na podstawie"], "w zakresie": ["jeśli chodzi o", "w sprawie"], "jednakże": ["ale", "jednak", "natomiast"],
    "mówimy o": ["dotyczy", "odnosi się do"], "chodzi o to": ["celem jest", "ma na celu"], "trzeba": ["należy", "powinien"], "można": ["ma prawo", "jest uprawniony"],
    "nie wolno": ["zabronione jest", "nie można"], "wszyscy": ["każdy", "osoby"], "każdy wie": ["powszechnie wiadomo", "oczywiste jest"],
}
REGISTER_SHAPES = {
    "article_reference": (r"art\.\s*(\d+)", r"artykuł[a-ząę]*\s*(\d+|pierwszy|drugi|trzeci)", 0.85),
    "paragraph_reference": (r"§\s*(\d+)", r"paragraf\s*(\d+|pierwszy|drugi|trzeci)", 0.85),
    "legal_obligation": (r"(należy|powinien|zobowiązany)", r"(trzeba|musi|powinien|ma obowiązek)", 0.75),
    "legal_prohibition": (r"(zabrania się|nie wolno|zabronione)", r"(nie można|nie wolno|zakaz)", 0.75),
}
SYNONYMS = {
    "ustawa": ["akt prawny", "prawo", "regulacja"], "kodeks": ["zbiór przepisów", "kodyfikacja"], "rozporządzenie": ["rozp.", "akt wykonawczy"],
    "artykuł": ["art.", "art", "przepis"], "paragraf": ["§", "par.", "paragraf"], "ustęp": ["ust.", "ustęp"], "punkt": ["pkt", "pkt.", "punkt"],
    "sąd": ["trybunał", "organ sądowy", "instancja"], "prawo": ["przepis", "norma", "regulacja"], "kara": ["sankcja", "grzywna", "penalizacja"],
}
QUERY_REFERENCE = r"(?iU)\bart\.\s*(\d+)(?:\s*ust\.\s*(\d+))?(?:\s*pkt\s*(\d+))?"
QUERY_TIME = r"(?iU)\b(?:19|20)\d{2}\b|\bw\s*roku\s*\d{4}\b|\bod\s+\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\s+do\s+|\bw\s*ostatni[ch]*\s*\d+\s*(?:rok|lat|miesiąc|dni)"
QUERY_PARLIAMENT = ["posiedzenie", "debata", "głosowanie", "komisja", "poseł", "senator", "marszałek", "interpelacja", "projekt ustawy", "nowelizacja", "wniosek"]
QUERY_CONCEPTS = ["odpowiedzialność", "prawo", "obowiązek", "uprawnienie", "procedura", "postępowanie", "orzekanie", "interpretacja"]


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """References, courts and legal persons without overlaps: ``key, n, type, pattern, text, start, end, groups``."""
    return S.exploded(df, key, S.keep_first(S.regex_spans(text, ENTITIES)))


def concepts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Legal concepts with a confidence; of overlapping ones the more confident stays (greedy by start)."""
    d = df.select(key, text, S.regex_spans(text, CONCEPTS).alias("s"))
    d = d.select(key, text, F.explode("s").alias("s")).select(key, text, "s.*", S.around(F.col(text), F.col("s.start"), F.col("s.end")).alias("context"))
    boost = F.when(F.col("type") == "legal_definition", 0.1).when(F.col("type").isin("obligation", "prohibition"), 0.05).when(F.col("type") == "penalty", 0.08).otherwise(0.0)
    c = 0.7 + 0.05 * T.number_of(F.lower("context"), CONTEXT_TERMS) + boost + F.when(F.length("text") > 20, 0.0).otherwise(-0.1)
    d = d.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    # greedy resolution inside each document; a document's concepts are bounded by its text
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])
    fields = ["type", "text", "start", "end", "confidence", "context"]
    g = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields)), order).alias("a"))
    empty = F.slice(F.col("a"), 1, 0)

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        free = last.isNull() | (s["start"] >= last["end"])
        return F.when(free, F.concat(acc, F.array(s))).when(s["confidence"] > last["confidence"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s))).otherwise(acc)

    return g.select(key, F.posexplode(F.aggregate("a", empty, add)).alias("n", "c")).select(key, "n", "c.*")


def concept_relations(found: DataFrame, key: str, width: int = 500) -> DataFrame:
    """Pairs of concepts of one document within ``width`` signs that a rule relates; a band join on buckets of ``width``."""
    rules = found.sparkSession.createDataFrame([(a, b, r, x) for a, b, r, x in RELATION_RULES] + [(b, a, r, x) for a, b, r, x in RELATION_RULES], "t1 string, t2 string, relation string, boost double")
    a = found.select(key, F.col("n").alias("n1"), F.col("type").alias("t1"), F.col("text").alias("source"), F.col("start").alias("s1"), F.col("confidence").alias("c1"), F.floor(F.col("start") / width).alias("k"))
    b = found.select(key, F.col("n").alias("n2"), F.col("type").alias("t2"), F.col("text").alias("target"), F.col("start").alias("s2"), F.col("confidence").alias("c2"), F.explode(F.array(*[F.floor(F.col("start") / width) + i for i in (-1, 0, 1)])).alias("k"))
    d = a.join(b, [key, "k"]).where((F.col("n1") < F.col("n2")) & (F.abs(F.col("s1") - F.col("s2")) <= width))
    d = d.join(F.broadcast(rules), ["t1", "t2"])
    c = 0.6 + (F.col("c1") + F.col("c2")) / 4 + F.col("boost") - F.least(F.lit(0.3), F.abs(F.col("s1") - F.col("s2")) / 1000)
    return d.select(key, "n1", "n2", "relation", "source", "target", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence"))


def changes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Additions, modifications (old and new wording) and deletions named in a text."""
    d = S.exploded(df, key, S.regex_spans(text, AMENDING))
    second = F.try_element_at("groups", F.lit(2))
    return d.select(key, "n", "type", F.when(second.isNotNull(), F.col("groups")[0]).alias("original"), F.coalesce(second, F.col("groups")[0]).alias("amended"))


def _hits(low: Column, terms: list[str]) -> Column:
    """Occurrences of all terms together. A loop over an array keeps the generated code small, whatever the lexicon."""
    one = lambda t: F.floor((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int")
    return F.aggregate(F.array(*[F.lit(t) for t in terms]), F.lit(0), lambda acc, t: acc + one(t))


def _present(low: Column, terms: list[str]) -> Column:
    """How many of the terms occur at all."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))) if terms else F.lit(0)


def _together(low: Column, terms: list[str]) -> Column:
    """How many terms of several words have all their words in the text."""
    several = [t for t in terms if " " in t]
    if not several:
        return F.lit(0)
    words = F.array(*[F.array(*[F.lit(w) for w in t.split()]) for t in several])
    return F.size(F.filter(words, lambda ws: F.forall(ws, lambda w: F.contains(low, w))))


def field_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """Score of each field of law in a text; fields without a hit are left out."""
    d = df.select(key, F.lower(text).alias("low"), F.greatest(F.lit(1.0), T.word_count(text) / 1000).alias("scale"))
    low = F.col("low")
    score = lambda terms, contexts: _hits(low, terms) + 0.5 * _together(low, terms) + 2.0 * _present(low, contexts)
    parts = [F.struct(F.lit(name).alias("field"), (score(*lexicon) / F.col("scale")).alias("score")) for name, lexicon in FIELDS.items()]
    return d.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.field", "x.score").where("score > 0")


def concept_density(df: DataFrame, key: str, text: str) -> DataFrame:
    terms = sorted({t for ts, _ in FIELDS.values() for t in ts})
    d = df.select(key, F.lower(text).alias("low"), T.word_count(text).alias("words"))
    d = d.select(key, "words", _hits(F.col("low"), terms).alias("hits"), _present(F.col("low"), terms).alias("distinct_hits"))
    share = lambda c: F.when(F.col("words") == 0, 0.0).otherwise(F.col(c) / F.col("words"))
    return d.withColumn("density", share("hits")).withColumn("unique_ratio", share("distinct_hits"))


def definitions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Defined terms with their definition and a confidence, the first of each term."""
    import re

    d = df.select(key, F.posexplode(S.regex_spans(text, DEFINITIONS, re.IGNORECASE | re.MULTILINE | re.DOTALL)).alias("n", "s"))
    d = d.select(key, "n", F.trim(F.col("s.groups")[0]).alias("term"), F.regexp_replace(F.trim(F.col("s.groups")[1]), r"\s+", " ").alias("definition"))
    n = T.word_count("definition")
    terms = [t for ts, _ in FIELDS.values() for t in ts]
    c = 0.7 + F.least(F.lit(0.2), n / 50) + F.least(F.lit(0.2), 0.05 * T.number_of(F.lower("definition"), terms)) - F.when((F.length("term") < 3) | (n < 3), 0.2).otherwise(0.0)
    d = d.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    w = Window.partitionBy(key, F.lower("term")).orderBy("n")
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def discourse(df: DataFrame, key: str, text: str) -> DataFrame:
    """Number of discourse markers of each kind."""
    low = F.lower(text)
    return df.select(key, *[sum((T.count_of(low, t) for t in ts), F.lit(0)).cast("int").alias(k) for k, ts in DISCOURSE.items()])


def arguments(df: DataFrame, key: str, text: str) -> DataFrame:
    """Argument markers of four classes, and their complexity."""
    low = F.lower(text)
    d = df.select(key, *[F.regexp_count(low, F.lit(p)).alias(k) for k, p in ARGUMENTS.items()])
    total = sum((F.col(k) for k in ARGUMENTS), F.lit(0))
    return d.withColumn("total", total).withColumn("complexity", F.least(F.lit(1.0), total / 20))


def relations(df: DataFrame, key: str, text: str) -> DataFrame:
    """Causal, temporal, modal and conditional phrases with their context."""
    d = df.select(key, text, S.regex_spans(text, SEMANTIC).alias("s")).select(key, text, F.posexplode("s").alias("n", "s"))
    return d.select(key, "n", "s.type", F.col("s.groups")[0].alias("content"), "s.start", "s.end", S.around(F.col(text), F.col("s.start"), F.col("s.end")).alias("context"))


def outline(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each line with the chapter, article, section and point it stands under, carried forward within the document."""
    d = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t")).where(F.trim("t") != "")
    got = lambda p: F.nullif(F.regexp_extract("t", p, 1), F.lit(""))
    d = d.withColumn("_c", got(r"(?iU)^\s*(?:rozdział|dział)\s+([IVXLC]+|\d+)")).withColumn("_a", got(r"(?iU)^\s*(?:art\.|§)\s*(\d+[a-z]?)\."))
    d = d.withColumn("_p", got(r"^\s*(?:(?:Art\.|§)\s*\d+[a-z]?\.\s*)?(\d+)\.\s")).withColumn("_q", got(r"^\s*(\d+)\)"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("chapter", F.last("_c", True).over(w)).withColumn("_an", F.count("_a").over(w)).withColumn("article", F.last("_a", True).over(w))
    v = Window.partitionBy(key, "_an").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("section", F.last("_p", True).over(v)).withColumn("point", F.last("_q", True).over(v))
    return d.select(key, "line", "chapter", "article", "section", "point", F.length("t").alias("chars"))


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """Those of a fixed list of phrases that stand in a text as whole words."""
    every = F.array(*[F.lit(p) for p in dict.fromkeys(phrases)])
    return F.filter(every, lambda p: F.regexp_like(text, F.concat(F.lit(r"(?iU)\b"), p, F.lit(r"\b"))))


def register_direct(formal: DataFrame, plain: DataFrame, key: str, plain_key: str) -> DataFrame:
    """Phrases of the formal text whose plain counterparts occur in the other text: one row for each such pair of phrases.

    ``formal``: ``key, phrases``, the formal phrases found in each text; ``plain``: ``plain_key, key, phrases``, the plain ones.
    The phrases of a text are searched once; only these are joined.
    """
    counterparts = F.create_map(*[x for f, ps in REGISTER.items() for x in (F.lit(f), F.array(*[F.lit(p) for p in ps]))])
    d = plain.select(plain_key, key, F.col("phrases").alias("ps")).join(formal.select(key, F.col("phrases").alias("fs")), key)
    d = d.select(plain_key, F.explode("fs").alias("formal_phrase"), "ps")
    return d.select(plain_key, "formal_phrase", F.explode(F.array_intersect(counterparts[F.col("formal_phrase")], "ps")).alias("plain_phrase"))


def register_shapes(df: DataFrame, formal: str, informal: str) -> DataFrame:
    """Structural patterns that occur on both sides."""
    parts = []
    for name, (a, b, c) in REGISTER_SHAPES.items():
        n, m = F.regexp_count(F.lower(formal), F.lit(a)), F.regexp_count(F.lower(informal), F.lit(b))
        parts.append(F.struct(F.lit(name).alias("pattern"), n.alias("formal_hits"), m.alias("plain_hits"), F.least(F.lit(0.9), n * m * 0.1).alias("similarity"), F.lit(c).alias("confidence")))
    cols = [c for c in df.columns if c not in (formal, informal)]
    return df.select(*cols, F.explode(F.array(*parts)).alias("x")).select(*cols, "x.*").where("formal_hits > 0 and plain_hits > 0")


def query_plan(df: DataFrame, query: str) -> DataFrame:
    """A search text understood: its normal form, kind, terms, references, years and added terms."""
    q = F.lower(T.one_space(F.col(query)))
    kind = (
        F.when(q.rlike(QUERY_REFERENCE) | q.rlike(r"§\s*\d+"), "legal_reference").when(q.rlike(QUERY_TIME), "temporal")
        .when(T.any_of(q, QUERY_PARLIAMENT), "cross_register").when(T.any_of(q, QUERY_CONCEPTS), "concept").otherwise("general")
    )
    terms = F.array_compact(F.array(*[F.when(F.contains(q, F.lit(t)), F.lit(t)) for t in SYNONYMS]))
    extra = F.array_distinct(F.flatten(F.array(*[F.when(F.contains(q, F.lit(t)), F.array(*[F.lit(s) for s in ss])).otherwise(F.array().cast("array<string>")) for t, ss in SYNONYMS.items()])))
    years = F.regexp_extract_all(q, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return df.withColumn("normal", q).withColumn("kind", kind).withColumn("terms", terms).withColumn("added", extra).withColumn("articles", F.regexp_extract_all(q, F.lit(r"art\.\s*(\d+)"), F.lit(1))).withColumn("year", F.try_element_at(years, F.lit(-1)).cast("int"))
