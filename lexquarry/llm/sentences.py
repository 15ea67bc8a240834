"""Problem 1: sentence units of texts in many languages and scripts.

A text is cut at blank lines into paragraphs. In a paragraph every place where a sentence could end is a candidate: a stop
with its closing marks, the opening of a bracketed remark after a stop, or, in Thai, a space. A semi-Markov dynamic program
then chooses whole spans between candidates. A span is scored from its last words (abbreviations that never or may end a
sentence, initials, ordinals), the opening words of the span that would follow it, whether quotations and brackets are
balanced inside it, and its length (a lone provision label or a lone date phrase is no sentence).

Defined results: null or blank text gives no unit; a text without stops is one unit for each paragraph; whatever its length a
text is processed whole; an unclosed quotation is treated as an ordinary character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import newest, table
from .encoding import SUSPECT_RE, repair

UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĲĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞȘŠŢȚŤŦŨŪŬŮŰŲŴŶŸŹŻŽΆΈ-ΏΑ-ΫЀ-ЯҐԱ-Ֆ"
UNCASED = "֐-ࣿऀ-෿฀-໿က-ჿሀ-፟ក-៿぀-ヿ㐀-鿿가-힯"
#: Stops; the Armenian, Ethiopic, Khmer and Burmese ones are full stops of their scripts.
STOPS = ".!?…。！？।॥؟｡۔։።፧៕။"
FULL = "。！？।॥؟｡۔։።፧៕။"
OPENERS = "„«“\"‘「『（\\(\\[〈《"
CLOSERS = "”»“\"’」』）\\)\\]〉》"

#: Abbreviations that are never the last word of a sentence when a name or number follows.
NEVER_FINAL = frozenset(
    """al art ust pkt lit poz str nr par zał sygn dz im ul pl al os hab prof dr dyr inż mgr woj pow gm godz np tj tzn tzw ww wg m.in gł ok
    dot zob por ob św ks gen płk red min oprac
    mr mrs ms dr prof no art para sec cf e.g i.e vs st co inc
    hr fr nr abs art bzw z.b ca vgl d.h v.h z b d h v
    m mm mme env n p ex cf
    ст ч п пп див напр бл ім вул р м проф д
    čl odst písm č např tzv ing mgr judr tj dr str
    sr sra srta dña ud uds ee uu pág núm aprox approx depto avda fig eq vol ed eds ver
    κ κα κος αρ σελ βλ π.χ δηλ ν
    د डॉ श्री नि""".split()
)
#: Abbreviations that may end a sentence or stand within one: the opening words decide.
MAYBE_FINAL = frozenset("r itp itd in nast etc usw apod atd rr ltd тощо р a.m p.m".split())
MONTHS = frozenset(
    """stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia
    januar februar märz april mai juni juli august september oktober november dezember
    ledna února března dubna května června července srpna září října listopadu prosince
    січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня""".split()
)
#: Opening words of a phrase that, ended by a year and "r.", has no verb yet.
DATE_OPENINGS = ("od dnia", "z dniem", "w dniu", "do dnia", "przed dniem", "po dniu", "dnia")

PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
CANDIDATE = re.compile(
    rf"[{STOPS}]+(?:[”»“’\"\)\]」』）]+|[\u00a0\u202f ]»)*[.!?…]*(?=\s+[{UPPER}{UNCASED}\d§¿¡{OPENERS}–—•-]|[{UPPER}{UNCASED}„«\(¿¡])"
)
THAI = re.compile(r"[ก-๛]")
THAI_GAP = re.compile(r"(?<=[฀-๿\d])\s+(?=[฀-๿])")
MARKS = re.compile("[„«“”»\"「」『』\\(\\)（）]")
LABEL = re.compile(
    rf"(?:(?:Art|Ст|Čl|§|Section|Artikel|Article|Abschnitt)\.?\s*\d+[a-z]*\.?\s+)?(?:§\s*\d+[a-z]*\.?\s+)?(?:\d+[a-z]*[.)]\s+|[a-z]\)\s+)?", re.I
)
LABEL_ONLY = re.compile(r"(?:(?:Art|Ст|Čl|§|st|ust|pkt)\.?\s*)*\d+[a-z]*[.)](?:\s*\d+[a-z]*[.)])*\s*", re.I)
SPACE = re.compile(r"[\s﻿​]*")

CUT, REFUSED, NEVER = 4.0, -12.0, -1e9
#: What a span loses that ends inside a quotation or bracket, and one that ends before a bracket going on in small letters.
UNBALANCED = -14.0
#: Spans up to so many signs are scored by their words; longer ones lose ``LENGTH`` for each further sign.
SHORT, LENGTH = 75, 0.0004
PAIRS = {"„": "”“\"", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）"}


def _nested(text: str) -> list[tuple[int, int, str]]:
    """Outermost balanced quotations and brackets of a paragraph, as (start, end, opening mark)."""
    found: list[tuple[int, int, str]] = []
    open_: list[tuple[str, int]] = []
    for m in MARKS.finditer(text):
        c, at = m.group(), m.start()
        if c == '"':
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] in '"„'), None)
            if k is None:
                open_.append((c, at))
                continue
        elif c in PAIRS or c == "“" and not any(o in "„“" for o, _ in open_):
            open_.append((c, at))
            continue
        else:
            k = next((k for k in range(len(open_) - 1, -1, -1) if c in PAIRS.get(open_[k][0], "”" if open_[k][0] == "“" else "")), None)
            if k is None:
                continue
        found.append((open_[k][1], at, open_[k][0]))
        del open_[k:]
    found.sort()
    outer: list[tuple[int, int, str]] = []
    for s, e, c in found:
        if not outer or s > outer[-1][1]:
            outer.append((s, e, c))
    return outer


def _closing(before: str, stop: str, nxt: str, rest: str, gap: bool) -> float:
    """Score of ending a sentence after ``before`` + ``stop`` when ``rest`` (first character ``nxt``) follows."""
    if nxt.islower():
        return REFUSED
    first = stop[0]
    core = stop.strip("”»“\"’)]」』） \xa0\n")
    closes = stop[-1] in "”»“\"’)]」』）"
    if closes and stop[-1] not in ")]）" and nxt.isalpha() and not nxt.isupper():
        return REFUSED  # a script without case goes on after the quotation
    if first in FULL:
        return CUT
    if before[-1:] in ("”", "»", "“", '"') and before[-2:-1] not in ("", " ", "\xa0", "\n"):
        return CUT
    if "!" in core or "?" in core or "؟" in core:
        return CUT
    if core in ("…", "..", "...", "…."):
        return CUT
    if before[-1:].isspace() or not before:
        raw = ""
    else:
        raw = before.rsplit(None, 1)[-1].lstrip("„«“\"「『([（").rstrip(".")
        if "'" in raw or "’" in raw:
            raw = re.split("['’]", raw)[-1]
        if "." in raw and raw.rpartition(".")[2][:1].isupper():
            raw = raw.rpartition(".")[2]  # a blank is missing before it
    word = raw.lower()
    if not word:
        return 1.0 if closes else -1.0
    if nxt.isdigit():
        t = rest[:24].split()
        if len(t) < 2 or t[1].rstrip(".,").lower() not in MONTHS:
            return REFUSED if word[-1].isdigit() or word in NEVER_FINAL or word in MAYBE_FINAL or not gap else 1.0
        return REFUSED if word in NEVER_FINAL else 3.0
    if word[-1].isdigit():
        head = rest.split(None, 1)[0].rstrip(".,").lower() if rest else ""
        return REFUSED if head in MONTHS else 2.0 if gap or closes else 1.0
    if closes:
        return CUT
    if len(word) == 1 and (raw[-1].isupper() or not gap):
        return REFUSED
    if word in MAYBE_FINAL:
        return 1.5 if word in ("r", "р") else 2.5
    if word in NEVER_FINAL:
        return REFUSED
    if not gap and len(word) < 2:
        return REFUSED
    if "." in word and word.replace(".", "").isalpha() and len(word) <= 5:
        return REFUSED
    return CUT


def _spans(p: str, thai: bool) -> list[int]:
    """Starts of the sentences of one paragraph (no blank line inside), relative to it; ``p`` begins with its first sign."""
    found = [m.span() for m in CANDIDATE.finditer(p)]
    if thai:
        found = sorted(found + [m.span() for m in THAI_GAP.finditer(p)])
    if not found:
        return [0]
    outer = _nested(p)
    n, k = len(p), 0
    label = LABEL.match(p).end()
    bounds, gain = [0], [0.0]
    for s, e in found:
        if s < label - 1 and e <= label:
            continue
        at = SPACE.match(p, e).end()
        if at >= n:
            continue
        while k < len(outer) and outer[k][1] < s:
            k += 1
        stop = p[s:e]
        score = _closing(p[max(0, s - 40) : s], stop, p[at], p[at : at + 40], at > e) if stop.strip() else 3.0
        if k < len(outer) and outer[k][0] < s and e <= outer[k][1]:
            score += UNBALANCED  # its closing mark comes later
        if p[at] in "(（" and not (p[at + 1 : at + 2].isupper() or not p[at + 1 : at + 2].isascii() and p[at + 1 : at + 2].isalpha()):
            score += UNBALANCED  # a bracket that belongs to the words before it
        bounds.append(at)
        gain.append(score)
    return choose(p, [*bounds, n], [*gain, 0.0])


def choose(p: str, bounds: list[int], gain: list[float]) -> list[int]:
    """Starts of the best sequence of spans between ``bounds``: semi-Markov dynamic programming over whole spans.

    ``best[j]`` is the best score of all ways to cut the text before boundary ``j``. Only spans within ``SHORT`` signs are scored
    by their words; a longer one by its length, in proportion, so that the best of all longer ones is kept in one running value
    and the time is linear in the length of the paragraph.
    """
    best, back = [0.0] + [NEVER] * (len(bounds) - 1), [0] * len(bounds)
    first, far, far_from = 0, NEVER, 0  # boundaries before ``first`` lie farther than a short span; ``far``: the best of them
    for j in range(1, len(bounds)):
        while bounds[j] - bounds[first] > SHORT:
            worth = best[first] + LENGTH * bounds[first]
            if worth > far:
                far, far_from = worth, first
            first += 1
        top, at = (far - LENGTH * (bounds[j] - SHORT), far_from) if far > NEVER else (NEVER, 0)
        for i in range(first, j):
            score = best[i] + _span(p, bounds[i], bounds[j])
            if score >= top:
                top, at = score, i
        best[j], back[j] = top + gain[j], at
    starts, j = [], len(bounds) - 1
    while j > 0:
        j = back[j]
        starts.append(bounds[j])
    return starts[::-1]


def _span(p: str, i: int, j: int) -> float:
    """Score of a short span itself: its opening words together with its closing words."""
    s = p[i:j].strip()
    m = LABEL_ONLY.match(s)
    if m and m.end() == len(s):
        return -8.0
    if s.endswith("r."):
        head = LABEL.match(s).end()
        if len(s) - head < 45 and s[head:].lower().startswith(DATE_OPENINGS):
            return -6.0
    return -0.5 if len(s) < 3 else 0.0


def sentence_starts(text: str | None) -> list[int]:
    """0-based code point positions at which the sentences of ``text`` begin."""
    if not text:
        return []
    if SUSPECT_RE.search(text):
        mended, origin, made = repair(text)  # garbled marks and letters hide the boundaries
        if made:
            return [origin[i] for i in _starts(mended)]
    return _starts(text)


def _starts(text: str) -> list[int]:
    out: list[int] = []
    at, n = SPACE.match(text).end(), len(text)
    thai = THAI.search(text) is not None
    while at < n:
        m = PARAGRAPH.search(text, at)
        end = m.start() if m else n
        p = text[at:end].rstrip()
        if p:
            out += [at + x for x in _spans(p, thai)] if len(p) > 1 else [at]
        at = SPACE.match(text, m.end()).end() if m else n
    return out


def _batches(column: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = [sentence_starts(t) for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(starts, pa.list_(pa.int32()))], [*keep, "starts"])

    return run


def with_sentence_starts(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``starts array<int>``, the sentence starts of ``column``; one row in, one row out."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, F.col(column).alias("__text")).mapInArrow(_batches("__text", list(keep)), f"{fields}, starts array<int>")


def sentence_table(legal: DataFrame, processed: DataFrame) -> DataFrame:
    """``tbl, id, start_pos``: each sentence of the current legal documents and of the processed documents."""
    a = newest(with_sentence_starts(legal, "content", "id", "updated_at"), "id", "updated_at", "starts")
    b = newest(with_sentence_starts(processed, "content", "id"), "id", None, "starts")
    both = a.select(F.lit("legal_documents").alias("tbl"), "id", "starts").unionByName(b.select(F.lit("processed_documents").alias("tbl"), "id", "starts"))
    return both.select("tbl", "id", F.explode("starts").alias("start_pos"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_table(table(spark, sf_dir, "legal_documents"), table(spark, sf_dir, "processed_documents"))


def sentences(df: DataFrame, column: str, key: str) -> DataFrame:
    """``key, n, sentence``: the sentences themselves, in order, without the white space between them."""
    d = df.select(F.col(key), F.col(column).alias("whole"))
    s = with_sentence_starts(d, "whole", key, "whole").where(F.size("starts") > 0)
    piece = F.expr(
        "transform(starts, (s, i) -> regexp_replace(substring(whole, s + 1, coalesce(try_element_at(starts, i + 2), length(whole)) - s), '\\\\s+$', ''))"
    )
    return s.select(key, F.posexplode(piece).alias("n", "sentence"))


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
