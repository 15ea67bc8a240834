"""Problem 4: text decoded with the wrong character encoding.

Round trips: what was read under a candidate legacy encoding is encoded with it again and strictly decoded as the intended
encoding; nested layers are undone one by one; a round trip is accepted when a garbling cost drops.

Two families are tried. (a) UTF-8 read as a single-byte encoding: every maximal multi-byte sequence is decoded on its own, so
that text garbled only in part is mended and correct signs beside it stay; layers are undone until none is left. (b) One
single-byte encoding read as another: the pair is chosen for the whole text by the summed drop of the cost of its distinct
words, and applied word by word. The cost of a word counts control signs, signs between letters, letters of no expected
alphabet, capitals after small letters, runs of accented letters and letters of two alphabets in one word. Words of a line whose
letters are all of one alphabet of ``ALPHABETS`` and in whose words no sign is out of place cost nothing: the line is sound,
whatever its language.

Defined results: null and empty text is sound. U+FFFD, control signs, or several question marks inside words, mark text whose
letters are lost; no round trip can bring these back, so the text is reported, with ``lost`` in ``repaired_fields``, and left.
Correct foreign words, units and signs are no case, since no round trip lowers their cost enough.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import newest, table

PL, CS = "ąćęłńóśźż", "áčďéěíňóřšťúůýž"
DE, FR = "äöüß", "àâæçéèêëîïôœùûüÿ"
UK = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя"
#: The letters beyond a to z, and the letters of other scripts, that languages are written with.
ALPHABETS = {
    "pl": PL, "cs": CS, "sk": "áäčďéíĺľňóôŕšťúýž", "de": DE, "fr": FR, "es": "áéíñóúü", "pt": "àáâãçéêíóôõúü", "it": "àèéìíîòóùú", "ro": "ăâîșțşţ",
    "hu": "áéíóöőúüű", "hr": "čćđšž", "tr": "âçğıîöşüİ", "sv": "åäöé", "da": "æøåé", "is": "áðéíóúýþæö", "fi": "äöå", "et": "äõöüšž",
    "lt": "ąčęėįšųūž", "lv": "āčēģīķļņšūž", "nl": "éëïóöüèê", "ca": "àçèéíïòóúü", "sq": "çë",
    "uk": UK, "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "be": "абвгдеёжзійклмнопрстуўфхцчшыьэюя", "bg": "абвгдежзийклмнопрстуфхцчшщъьюя",
    "sr": "абвгдђежзијклљмнњопрстћуфхцчџш", "mk": "абвгдѓежзѕијклљмнњопрстќуфхцчџш", "el": "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ",
}
LATIN = "".join(sorted(set(PL + CS + DE + FR.replace("æ", "").replace("ÿ", ""))))
SIGNS = "„”“«»–—…§°№’‘•€\u00a0\u2009\u202f\u2011\U0001f4ce→×−₂"
GOOD = "".join(sorted(set(LATIN + LATIN.upper().replace("SS", "") + UK + UK.upper() + SIGNS)))
#: Scripts without case are expected too; a garbled text never gets there by the round trips below.
OTHER = "֐-ࣿऀ-෿฀-໿ᄀ-ᇿ぀-ヿ㐀-鿿가-힯　-〿＀-￯"
_UP = "".join(sorted(c for c in set(LATIN.upper() + UK.upper() + "ĽĹŔ©") if ord(c) > 127))
#: Any garbled text holds a sign found by this. (Java scans so large a sign class many times slower than Python does.)
SUSPECT = rf"[^\x00-\x7f{GOOD}{OTHER}]|[a-zа-яєії{LATIN}][{_UP}]"
SUSPECT_RE = re.compile(SUSPECT)

#: Encodings under which UTF-8 was read.
READ_AS = ("cp1252", "cp1250", "latin_1", "iso8859_2", "cp1251", "mac_roman", "cp852", "cp437", "koi8_u", "cp866", "cp1253", "cp1254", "cp1257")
#: (written in, read as) for single-byte encodings.
SINGLE = tuple(
    (a, b)
    for a, bs in {
        "cp1250": ("cp1252", "latin_1", "iso8859_2", "cp852"),
        "iso8859_2": ("cp1252", "latin_1", "cp1250", "cp852"),
        "cp852": ("cp1250", "cp1252", "latin_1", "iso8859_2", "cp437"),
        "cp1251": ("cp1252", "latin_1", "cp1250", "koi8_u", "cp866", "iso8859_5"),
        "koi8_u": ("cp1251", "cp1252", "latin_1", "cp866", "iso8859_5"),
        "cp866": ("cp1251", "cp1252", "latin_1", "koi8_u", "cp437"),
        "iso8859_5": ("cp1251", "cp1252", "latin_1", "koi8_u"),
        "cp1253": ("cp1252", "latin_1", "cp1250", "cp1251"),
        "cp1254": ("cp1252", "latin_1", "cp1250"),
    }.items()
    for b in bs
)


def _table(encoding: str) -> dict[str, int]:
    """Byte of each sign under ``encoding``; undefined bytes read as control signs."""
    found: dict[str, int] = {}
    for b in range(128, 256):
        try:
            found[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            found.setdefault(chr(b), b)
    return found


def _sequences(encoding: str) -> tuple[re.Pattern[str], dict[str, int]]:
    t = _table(encoding)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in t.items() if lo <= b <= hi) + "]"
    cont = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF4)}{cont}{{3}})+"), t


MULTI = {e: _sequences(e) for e in READ_AS}
TABLES = {e: _table(e) for pair in SINGLE for e in pair}
DECODE = {e: {b: c for c, b in t.items() if not 0x80 <= ord(c) < 0xA0} for e, t in TABLES.items()}
GOODSET = frozenset(GOOD)
#: Letters and signs a decoded sequence may hold.
WRITTEN = GOODSET | frozenset("".join(a + a.upper() for a in ALPHABETS.values())) | frozenset("¿¡ªº±×÷µ¢£¥©®°·¼½¾²³¹ ÿŸßŒœ")
_ALPHABETS = [(a[0] > "\u036f", frozenset(a + a.upper())) for a in ALPHABETS.values()]
NESTED = frozenset("".join(c for e in ("cp1252", "cp1250", "latin_1", "iso8859_2") for c in _table(e)))
CYR = re.compile(r"[Ѐ-ӿ]")
OTHER_LETTER = re.compile(r"[\u0370-ӿ]")
GREEK = re.compile(r"[\u0370-\u03ff]")
WORD = re.compile(r"\S*[^\x00-\x7f\s]\S*")
SIGN_IN = re.compile(r"[^\W\d_]([^\x00-\x7f\w’‘–—…])(?=[^\W\d_])|[^\W\d_]([¹²³º¼½¾µ])(?=[^\W\d_])")
SIGN_EDGE = re.compile(r"(?<![^\W_])([¿¶±¹³¼¾£¥¯©®¦¤¬¡º˘ˇ¨´¸·])(?=[^\W\d_]{2})|[^\W\d_]([¿¶±¼¾£¥©®¦¤¬¡˘ˇ¨´¸])(?![\w])")
FOOT = re.compile(r"[a-zł]([¹²³])(?!\w)")
UPPER_IN = re.compile(rf"[a-z{LATIN}][{_UP}](?!\w*[A-Z]{{2}})|[а-яєіїґ][А-ЯЄІЇҐ]")
ACCENTED = re.compile("[À-ÖØ-ö]?[ß-öø-ÿ]{3,}")
PL_ONLY, CS_ONLY, DE_ONLY = re.compile("[ąćęłńśźżĄĆĘŁŃŚŹŻ]"), re.compile("[ďěňřšťůýžáíĎĚŇŘŠŤŮÝŽÁÍčČ]"), re.compile("[äöüßâàçèêëîïôœùû]")
CONTROL = re.compile("[\x80-\x9f�]")
#: Latin letters beside letters of another alphabet, within a word.
MIXED = re.compile("[A-Za-zÀ-ɏ][\u0370-ӿ]|[\u0370-ӿ][A-Za-zÀ-ɏ]")
#: Opening marks of Spanish not at the beginning of a word.
OPENING = re.compile(r"[^\W_][¿¡]|[¿¡](?![\s¿¡]*[^\W_])")
LINE = re.compile(r"[^\n.!?]+[\n.!?]*")


def misplaced(word: str) -> float:
    """The part of the cost of a word that no alphabet explains: signs and capitals where none belong."""
    c = 4.0 * len(CONTROL.findall(word)) + 3.0 * len(SIGN_IN.findall(word)) + 1.6 * len(SIGN_EDGE.findall(word)) + 0.2 * len(FOOT.findall(word))
    return c + 2.5 * len(UPPER_IN.findall(word))


def of_one_alphabet(text: str) -> bool:
    """Whether all letters of ``text`` beyond a to z belong to one language; those of a script of its own stand in words of that script."""
    letters = {x for x in text if x > "\x7f" and x.isalpha()}
    if not letters:
        return True
    return any(letters <= a and not (other and MIXED.search(text)) for other, a in _ALPHABETS)


def sound(line: str) -> bool:
    """Whether a line is written in one alphabet without a sign out of place; opening marks ¿ ¡ need their closing ones."""
    if "¿" in line or "¡" in line:
        if OPENING.search(line) or line.count("¿") > line.count("?") or line.count("¡") > line.count("!"):
            return False
        line = line.replace("¿", "").replace("¡", "")
    return not CONTROL.search(line) and of_one_alphabet(line) and not any(misplaced(m.group()) for m in WORD.finditer(line))


@lru_cache(200_000)
def cost(word: str) -> float:
    """Garbling cost of one word: 0 for a word of an expected alphabet."""
    c = misplaced(word) + 2.0 * sum(len(x) - 2 for x in ACCENTED.findall(word))
    c += 0.8 * sum(1 for x in word if x.isalpha() and ord(x) > 127 and x not in GOODSET and not "֐" <= x <= "鿿")
    kinds = (PL_ONLY.search(word) is not None) + (CS_ONLY.search(word) is not None) + (DE_ONLY.search(word) is not None)
    if kinds > 1:
        c += 1.5 * (kinds - 1)
    if MIXED.search(word):
        c += 1.5
    return c


@lru_cache(200_000)
def cost_after(word: str) -> float:
    """Cost of a mended word: next to nothing, too, if it is written in one alphabet of any language."""
    c = cost(word)
    return min(c, misplaced(word) + (0.0 if OTHER_LETTER.search(word) else 0.1)) if c > 0 and of_one_alphabet(word) else c


def _utf8(seq: str, t: dict[str, int], left: str, right: str) -> tuple[str, float] | None:
    """``seq`` decoded as UTF-8 with the worth of it, if all its signs are expected or may be a further layer of garbling."""
    try:
        new = bytes(t[c] for c in seq).decode("utf-8")
    except UnicodeDecodeError:
        return None
    good = sum(1 for c in new if c in WRITTEN)
    if good < len(new) and any(c not in WRITTEN and c not in NESTED and c != "\u00ad" for c in new):
        return None
    if CYR.search(new) and (left.isalpha() and ord(left) < 0x250 or right.isalpha() and ord(right) < 0x250):
        return None
    if GREEK.search(new) and (CYR.search(new) or CYR.search(left) or CYR.search(right)):
        return None
    if CYR.search(seq):  # sequences of Cyrillic or Greek letters may be sound words
        before = misplaced(seq) if of_one_alphabet(seq) else cost(seq)
        return new, before - cost_after(new) - 0.5 * (len(new) - good)
    return new, len(seq) - 1.5 * (len(new) - good)


def _apply(text: str, pos: list[int], spans: list[tuple[int, int, str]]) -> tuple[str, list[int]]:
    out, where, at = [], [], 0
    for s, e, new in spans:
        out.append(text[at:s])
        where += pos[at:s]
        out.append(new)
        where += [pos[min(e - 1, s + k * (e - s) // max(1, len(new)))] for k in range(len(new))]
        at = e
    out.append(text[at:])
    where += pos[at:]
    return "".join(out), where


def repair(text: str) -> tuple[str, list[int], list[str]]:
    """The mended text, for each of its signs the position in ``text`` it came from, and the round trips made."""
    pos, made = list(range(len(text))), []
    while True:  # every layer undone makes the text shorter
        best: list[tuple[int, int, str]] = []
        name, gain = "", 0.5
        for e, (pattern, t) in MULTI.items():
            spans, got = [], 0.0
            for m in pattern.finditer(text):
                i, f = m.span()
                new = _utf8(m.group(), t, text[i - 1 : i] if i else "", text[f : f + 1])
                if new is not None:
                    spans.append((i, f, new[0]))
                    got += new[1]
            if got > gain:
                best, name, gain = spans, e, got
        if not best:
            break
        text, pos = _apply(text, pos, best)
        made.append(f"utf_8<{name}")
    found = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    lines = [m.span() for m in LINE.finditer(text)]
    ends = [e for _, e in lines]
    at = {i: min(bisect_right(ends, i), len(ends) - 1) for i, _, _ in found} if ends else {}
    fine: dict[int, bool] = {}
    every = {w: c for w in {w for _, _, w in found} if (c := cost(w)) > 0}
    odd: dict[str, float] = {}  # without the words of sound lines: these do not tell, but are mended with the rest
    for i, _, w in found:
        if w in every and w not in odd:
            k = at.get(i, 0)
            if k not in fine:
                fine[k] = bool(lines) and sound(text[lines[k][0] : lines[k][1]])
            if not fine[k]:
                odd[w] = every[w]
    if sum(odd.values()) >= 2.5:
        pair, top = None, 0.0
        for a, b in SINGLE:
            total = 0.0
            for w, c in odd.items():
                x = _convert(w, a, b)
                total += c - cost_after(x) if x is not None else 0.0
            if total > top:
                pair, top = (a, b), total
        if top >= 2.5 and pair:
            new = {w: x for w in {w for _, _, w in found} if (x := _convert(w, *pair)) is not None and x != w}
            hurt = {w for w in every if w in new and cost_after(new[w]) < every[w]}
            bad = {at[i] for i, _, w in found if w in hurt}
            spans = [(i, f, new[w]) for i, f, w in found if w in hurt or w in new and w not in every and at[i] in bad and _swap(w, new[w])]
            if spans:
                text, pos = _apply(text, pos, spans)
                made.append(f"{pair[0]}<{pair[1]}")
    return text, pos, made


def _convert(word: str, written: str, read: str) -> str | None:
    """``word`` encoded as ``read`` and strictly decoded as ``written``."""
    t, d = TABLES[read], DECODE[written]
    try:
        return "".join(c if c < "\x80" else d[t[c]] for c in word)
    except KeyError:
        return None


def _swap(old: str, new: str) -> bool:
    """Of words equally plausible before and after, those are changed whose letters become Polish or Cyrillic."""
    return bool(PL_ONLY.search(new) or OTHER_LETTER.search(new)) and not PL_ONLY.search(old) and cost_after(new) == 0


#: Words with a question mark left where an encoding had no place for a letter. One may be a missing blank, several are not.
QUESTION = re.compile(r"(?<![^\s„«»“”\"'(\[.,;:])(?=[^\W\d_?]*\?[a-zß-öø-ÿąćęłńóśźżěřšťůďňžčа-яіїєґ])(?:[^\W\d_]|\?(?=[^\W\d_])){4,}(?![=&/@\w])")


def questioned(text: str) -> bool:
    """Whether letters were lost to question marks: three words with one inside, addresses and formulas apart."""
    if "?" not in text:
        return False
    return sum(len(re.findall(r"\w\?(?=\w)", m.group())) for m in QUESTION.finditer(text)) >= 3


def is_garbled(text: str | None) -> bool:
    if not text:
        return False
    if questioned(text):
        return True
    if not SUSPECT_RE.search(text):
        return False
    return "�" in text or CONTROL.search(text) is not None or bool(repair(text)[2])


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column("id"), b.column("updated_at")]
        cols += [pa.array([is_garbled(t) for t in b.column(c).to_pylist()], pa.bool_()) for c in ("title", "content")]
        yield pa.RecordBatch.from_arrays(cols, ["id", "updated_at", "title", "content"])


RESTORED = pa.struct([("restored", pa.string()), ("steps", pa.list_(pa.string())), ("lost", pa.bool_())])


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each state and field; without a result where the text is sound."""
    for b in batches:
        out: list[dict | None] = []
        for t in b.column("text").to_pylist():
            gone = t is not None and questioned(t)
            if t is None or not gone and not SUSPECT_RE.search(t):
                out.append(None)
                continue
            new, _, made = repair(t)
            lost = gone or "�" in new or CONTROL.search(new) is not None
            out.append({"restored": new, "steps": made, "lost": lost} if made or lost else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("field"), b.column("updated_at"), pa.array(out, RESTORED)], ["id", "field", "updated_at", "r"])


def garbled_fields(legal: DataFrame) -> DataFrame:
    """``id, field`` of the current legal documents whose title or content is garbled."""
    d = legal.select("id", "updated_at", "title", "content")
    schema = f"id string, updated_at {dict(legal.dtypes)['updated_at']}, title boolean, content boolean"
    flags = newest(d.mapInArrow(_flags, schema), "id", "updated_at", "title", "content")
    return flags.select("id", F.expr("stack(2, 'title', title, 'content', content) as (field, hit)")).where("hit").select("id", "field")


def repaired_fields(legal: DataFrame) -> DataFrame:
    """``id, field, restored, steps, lost``: the garbled fields of the current states, mended; ``lost`` where letters are gone for good.

    Only garbled texts are moved to find the current state.
    """
    both = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("title", "content")])
    d = legal.select("id", "updated_at", F.explode(both).alias("x")).select("id", "updated_at", "x.field", "x.text")
    out = d.mapInArrow(_mended, f"id string, field string, updated_at {dict(legal.dtypes)['updated_at']}, r struct<restored:string,steps:array<string>,lost:boolean>")
    kept = out.groupBy("id", "field").agg(F.max(F.struct("updated_at", "r")).alias("k"))
    return kept.where("k.r is not null").select("id", "field", "k.r.*")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_fields(table(spark, sf_dir, "legal_documents"))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_fields(table(spark, sf_dir, "legal_documents"))


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
ORACLES: dict[str, str] = {}
