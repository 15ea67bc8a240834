"""Parties of legal relationships, the relationships between them, and the network they form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T

# Patterns of parties, verbs of relationships and accompanying words.
PARTIES = {
    "person": [
        r"(?:osoba|osoby)\s+(?:fizyczna|fizyczne|prawna|prawne)", r"(?:obywatel|obywatele)\s+(?:polski|polscy|polskich)", r"(?:podmiot|podmioty)\s+(?:gospodarczy|gospodarcze)",
        r"(?:przedsiębiorca|przedsiębiorcy)", r"(?:konsument|konsumenci)", r"(?:pracownik|pracownicy|pracodawca|pracodawcy)",
    ],
    "institution": [
        r"(?:sąd|sądy)\s+(?:rejonowy|okręgowy|apelacyjny|najwyższy)", r"(?:trybunał|trybunały)\s+(?:konstytucyjny|stanu|administracyjny)", r"(?:minister|ministra|ministerstwo)",
        r"(?:urząd|urzędy)\s+(?:gminy|miasta|powiatu|wojewódzki)", r"(?:rada|rady)\s+(?:gminy|miasta|powiatu|ministrów)", r"(?:komisja|komisje)\s+(?:europejska|nadzoru|kontroli)",
        r"(?:prokurator|prokuratura)", r"(?:policja|straż)\s+(?:miejska|pożarna|graniczna)",
    ],
    "legal_act": [
        r"(?:ustawa|ustawy)\s+(?:z dnia\s+\d+|\w+)", r"(?:rozporządzenie|rozporządzenia)\s+(?:ministra|rady ministrów)", r"(?:kodeks|kodeksy)\s+(?:cywilny|karny|pracy|postępowania)",
        r"(?:konstytucja|konstytucji)\s+(?:rzeczypospolitej polskiej)", r"(?:traktat|traktaty|konwencja|konwencje)",
        r"(?:dyrektywa|dyrektywy|rozporządzenie|rozporządzenia)\s+(?:unii europejskiej|ue)",
    ],
    "legal_concept": [
        r"(?:prawo|prawa)\s+(?:własności|autorskie|administracyjne|konstytucyjne)", r"(?:zobowiązanie|zobowiązania)\s+(?:umowne|pozaumowne)", r"(?:odpowiedzialność|odpowiedzialności)\s+(?:cywilna|karna|administracyjna)",
        r"(?:postępowanie|postępowania)\s+(?:cywilne|karne|administracyjne)", r"(?:orzeczenie|orzeczenia|wyrok|wyroki)", r"(?:umowa|umowy|kontrakt|kontrakty)",
        r"(?:decyzja|decyzje)\s+(?:administracyjna|administracyjne)",
    ],
    "temporal_entity": [
        r"(?:termin|terminy)\s+(?:płatności|wykonania|przedawnienia)", r"(?:okres|okresy)\s+(?:próbny|wypowiedzenia|ochronny)", r"(?:data|daty)\s+(?:wejścia w życie|uchylenia|zmiany)",
    ],
}
VERBS = {
    "defines": ["oznacza", "definiuje się jako", "to"], "modifies": ["zmienia", "modyfikuje", "nowelizuje"],
    "references": ["odnosi się do", "nawiązuje do", "powołuje się na", "o którym mowa w", "określony w", "wskazany w"], "supersedes": ["zastępuje", "uchyla", "znosi"],
    "implements": ["wykonuje", "realizuje", "wdraża"], "delegates": ["upoważnia", "deleguje", "przekazuje uprawnienia"],
    "requires": ["wymaga", "potrzebuje", "jest uzależnione od"], "prohibits": ["zabrania", "zakazuje", "nie pozwala na"], "permits": ["pozwala", "zezwala", "umożliwia"],
    "establishes": ["ustanawia", "tworzy", "powołuje"], "repeals": ["uchyla się", "traci moc", "zostaje zniesiony"], "extends": ["rozszerza", "poszerza", "wydłuża"],
    "limits": ["ogranicza", "zawęża", "limituje"], "conditional_on": ["pod warunkiem", "w zależności od", "uzależnione od"],
    "applies_to": ["dotyczy", "odnosi się do", "ma zastosowanie do"],
}
# What opens a phrase and what stands in its middle, for the second form of each kind.
FRAMES = {
    "defines": [("przez|pod pojęciem", "rozumie się|należy rozumieć")], "modifies": [("w|we", "wprowadza się zmiany|dokonuje się zmian")],
    "references": [("zgodnie z|na podstawie|w świetle", "")], "supersedes": [("w miejsce|zamiast", "wprowadza się|ustala się")], "implements": [("w wykonaniu|dla realizacji", "")],
    "delegates": [("uprawnienie do|kompetencja do", "przysługuje|należy do")], "requires": [("warunkiem|przesłanką", "jest|stanowi")], "prohibits": [("zakaz|prohibicja", "dotyczy|obejmuje")],
    "permits": [("możliwość|prawo do", "przysługuje|należy do")], "establishes": [("powstaje|tworzy się|ustanawia się", "w ramach|przez")], "repeals": [("uchyleniu|zniesieniu", "służy|dokonuje")],
    "extends": [("rozszerzenie|poszerzenie", "następuje przez|dokonuje się poprzez")], "limits": [("ograniczenie|zawężenie", "następuje przez|wynika z")],
    "conditional_on": [("jeżeli|gdy|w przypadku gdy", "to|wówczas")], "applies_to": [("zakres|zasięg", "obejmuje|dotyczy")],
}
BOOSTS = {"defines": 0.15, "modifies": 0.1, "references": 0.05, "supersedes": 0.12, "requires": 0.08}
MODIFIERS = ["bezwarunkowo", "warunkowo", "tymczasowo", "ostatecznie", "natychmiast", "niezwłocznie", "stopniowo", "częściowo", "całkowicie", "w pełni", "ograniczenie", "wyjątkowo"]
TEMPORAL = ["od dnia", "do dnia", "w dniu", "z dniem", "w terminie", "przed upływem", "po upływie", "w ciągu", "nie później niż", "nie wcześniej niż", "równocześnie", "jednocześnie"]
OPERATORS = ["zgodnie z", "na podstawie", "w związku z", "w świetle", "z zastrzeżeniem", "z wyłączeniem", "z wyjątkiem", "pod rygorem", "w granicach", "w zakresie"]


def parties(df: DataFrame, key: str, text: str) -> DataFrame:
    """Parties without overlaps (the longer stays), with the modifiers and the first time marker around them."""
    d = df.select(key, text, S.keep_longest(S.regex_spans(text, PARTIES, re.IGNORECASE)).alias("s")).select(key, text, F.posexplode("s").alias("n", "s"))
    near = F.lower(S.around(F.col(text), F.col("s.start"), F.col("s.end")))
    first = F.try_element_at(F.filter(F.array(*[F.lit(t) for t in TEMPORAL]), lambda t: F.contains(near, t)), F.lit(1))
    mods = F.filter(F.array(*[F.lit(t) for t in MODIFIERS]), lambda t: F.contains(near, t))
    return d.select(key, "n", "s.type", F.col("s.text").alias("name"), "s.start", "s.end", mods.alias("modifiers"), first.alias("time"))


def _relations(column: Column) -> Column:
    """All subject-verb-object phrases of a line: the verb is searched, its subject reaches back to the end of the one before."""
    compiled = {k: r"\s+(?:" + "|".join(map(re.escape, vs)) + r")\s+(.+?)(?:\.|;)" for k, vs in VERBS.items()}
    framed = {k: [rf"\b(?:{a})\s+([^.;]+?)\s+(?:{b})\s+([^.;]+)[.;]" if b else rf"\b(?:{a})\s+(\S+)\s+([^.;]+)[.;]" for a, b in fs] for k, fs in FRAMES.items()}

    @F.pandas_udf("array<struct<type:string,source:string,target:string,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules = [(k, re.compile(p, re.IGNORECASE)) for k, p in compiled.items()]
        frames = [(k, re.compile(p, re.IGNORECASE)) for k, ps in framed.items() for p in ps]

        def of(text: str | None) -> list[dict]:
            out, at = [], 0
            for line in (text or "").split("\n"):
                for kind, rule in rules:
                    done = 0
                    for m in rule.finditer(line):
                        source = line[done : m.start()].strip()
                        if source:
                            out.append({"type": kind, "source": source, "target": m.group(1).strip(), "start": at + done, "end": at + m.end()})
                        done = m.end()
                for kind, rule in frames:
                    for m in rule.finditer(line):
                        out.append({"type": kind, "source": m.group(1).strip(), "target": m.group(2).strip(), "start": at + m.start(), "end": at + m.end()})
                at += len(line) + 1
            return out

        for texts in batches:
            yield texts.map(of)

    return find(column)


def relationships(df: DataFrame, key: str, text: str, least: float = 0.3) -> DataFrame:
    """Relationships with the parties named in subject and object, else a general concept, and a confidence."""
    d = df.select(key, text, _relations(F.col(text)).alias("r")).select(key, text, F.posexplode("r").alias("n", "r")).select(key, text, "n", "r.*")
    kind = lambda c: T.first_match(F.lower(c), {k: "|".join(ps).replace(r"\w", r"[\p{L}\p{N}_]") for k, ps in PARTIES.items()}, "concept")
    d = d.withColumn("source_type", kind(F.col("source"))).withColumn("target_type", kind(F.col("target")))
    near = F.lower(S.around(F.col(text), F.col("start"), F.col("end"), 150))
    words = T.number_of(near, MODIFIERS) + T.number_of(near, TEMPORAL) + T.number_of(near, OPERATORS)
    both = (F.col("source_type") != "concept") & (F.col("target_type") != "concept")
    c = 0.6 + F.when(F.col("end") - F.col("start") > 30, 0.1).otherwise(0.0) + F.least(F.lit(0.2), 0.02 * words) + F.when(both, 0.1).otherwise(0.0)
    for name, b in BOOSTS.items():
        c = c + F.when(F.col("type") == name, b).otherwise(0.0)
    return d.withColumn("confidence", F.least(F.lit(1.0), c)).where(F.col("confidence") >= least).drop(text)


def network(found: DataFrame) -> DataFrame:
    """Number, mean confidence and share of typed parties of each kind of relationship."""
    typed = (F.col("source_type") != "concept") | (F.col("target_type") != "concept")
    return found.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(typed.cast("double")), 6).alias("typed"))


def insights(found: DataFrame, key: str, top: int = 5) -> DataFrame:
    """The kinds of relationship most frequent in each text."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), "type")
    d = found.groupBy(key, "type").agg(F.count("*").alias("n"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def hubs(found: DataFrame, top: int = 10) -> DataFrame:
    """The kinds of parties with most relationships, as subject and as object, and the share of all they take part in."""
    ends = found.select(F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_type").alias("party")), F.struct(F.lit("target").alias("side"), F.col("target_type").alias("party")))).alias("e"), "type")
    d = ends.groupBy("e.party").agg(F.count("*").alias("n"), F.count_if(F.col("e.side") == "source").alias("as_source"), F.count_distinct("type").alias("kinds"))
    return d.orderBy(F.desc("n"), "party").limit(top)


def density(found: DataFrame, key: str) -> DataFrame:
    """Distinct parties, relationships, and relationships for each possible pair of parties, of each text."""
    each = found.select(key, F.explode(F.array(F.lower("source"), F.lower("target"))).alias("party")).groupBy(key).agg(F.count_distinct("party").alias("parties"))
    d = found.groupBy(key).agg(F.count("*").alias("n")).join(each, key)
    pairs = F.col("parties") * (F.col("parties") - 1)
    return d.select(key, "parties", "n", F.when(pairs > 0, F.col("n") / pairs).otherwise(0.0).alias("density"))
