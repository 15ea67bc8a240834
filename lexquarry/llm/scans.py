"""Problem 6: noise in text from scanned pages.

Three kinds of noise are found and mended. Furniture: page numbers are told by their form; running headers and footers by
repetition, of lines with a number at the edges of pages of the whole corpus, of any line at the edges of three or more pages of
a text, numbers masked and confusable signs set equal; running titles by the title of the document. A word divided at the
end of a line is joined if the corpus knows it joined rather than with a hyphen. A misread word is found by joining rare words
with frequent ones in SQL: the anagram hash of a word is the sum of the hashes of its signs, so that a confusion of signs
changes it by a fixed difference and "rare hash + difference = frequent hash" is an equi-join; of several corrections the most
frequent word wins. Besides the confusions of a list, letters with marks foreign to the language of the text are tried with other
marks and without. Counts of words cover the distinct texts of current rows:
a text counts once, however many documents, repeats and older states hold it.

Defined results: a document without page text gives no row; ``pdf_raw_content`` that is no UTF-8 is read with replacement signs;
lines are split at LF only and count from 1; a null title only leaves out the comparison with it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import newest, table
from ..session import cut
from .cut_texts import language

#: Signs and the letters they are misread for.
CONFUSED = {
    "0": "o", "1": "liI", "2": "z", "4": "a", "5": "s", "6": "b", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "liIł", "!": "il", "†": "t",
    "£": "e", "¢": "c", "¥": "y", "¦": "l", "§": "s", "vv": "w", "cl": "d", "rn": "m", "ri": "n", "ii": "u", "iii": "m", "rri": "m", "li": "h", "tn": "m",
}
HYPHENS = "-‐‑­¬⸗"
WORD = re.compile(r"(?:[^\W_]|[@$€|†£¢¦]|!(?=[^\W\d_]))+(?:[-‐‑](?:[^\W_]|[@$€|†£¢¦]|!(?=[^\W\d_]))+)*")
SIGNS = re.compile(r"[@$€|!†£¢¦\d]")
DIGRAPH = re.compile("vv|cl|rn|ri|ii|li|tn")
LETTER = re.compile(r"[^\W\d_]")
#: Letters with marks that the languages of the corpus write; every other marked letter in a text of the language is doubtful.
MARKED = {"pl": "ąćęłńóśźż", "en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "cs": "áčďéěíňóřšťúůýž"}
LATIN = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.isalpha() and c == c.lower()]
FOREIGN = {lang: re.compile("[" + "".join(c for c in LATIN if c not in own) + "]", re.IGNORECASE) for lang, own in [*MARKED.items(), ("", "")]}
#: Numbers of provisions with a letter, as in "Art. 2a", after their label.
NUMBERED = re.compile(r"^\d+[a-km-np-y]{1,2}$")
PROVISION = re.compile(r"(?:\b(?:art|ust|pkt|poz|nr|lit|par|abs|čl|odst|ст|ч|п)\.?|§)\s*$", re.I)
NUMBER = re.compile(r"^(?:\d+[lIOoSZBz|!]\d*|[lIOSZB|]\d+)$")
#: Numbers of pages with their misreadings.
N = r"(?=[lIOoSZBz|!@$g]{0,4}\d)[\dlIOoSZBz|!@$g]{1,5}"


def _fuzzy(text: str) -> str:
    """A pattern for ``text`` in which every letter may be misread."""
    back: dict[str, list[str]] = {}
    for wrong, rights in CONFUSED.items():
        for r in rights.lower():
            back.setdefault(r, []).append(wrong)
    out = []
    for c in text:
        if c == " ":
            out.append(r"\s+")
        else:
            out.append("(?:" + "|".join([re.escape(c), *map(re.escape, back.get(c.lower(), []))]) + ")")
    return "".join(out)


DASH = "[-–—]"
#: Lines that are a page number only, or one with the word for page.
PAGE_NUMBER = re.compile(
    rf"^\s*(?:{N}|\[{N}\]|{DASH}\s*{N}\s*{DASH}|{DASH}\s*{N}\s*/\s*{N}\s*{DASH}|{N}\s*/\s*{N}|[IVXLC]{{1,6}}"
    + rf"|(?:{_fuzzy('Strona')}|{_fuzzy('Seite')}|{_fuzzy('Page')}|{_fuzzy('Strana')})\s+{N}(?:\s+\S{{1,3}}\s+{N})?|{_fuzzy('str')}[.,]\s*{N})\s*$"
)
TITLE_NUMBER = re.compile(rf"^(\S.*?\S)\s{{3,}}{N}\s*$")


def _plain(s: str) -> str:
    return re.sub(r"\W+", "", s.lower().replace("0", "o").replace("1", "l"))


MASKED = re.compile(rf"(?<!\w)(?:{N}|[IVXLC]{{1,6}})(?!\w)")
DIGIT = re.compile(r"\d")
#: Signs and pairs that are misread for each other, as one.
SAME = [("iii", "m"), ("rri", "m"), ("rn", "m"), ("tn", "m"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("vv", "w")]
ONE = str.maketrans("0158624@9$€£¢¥|!l†", "oisbbzaagseecyiiit")


def template(line: str) -> int | None:
    """Fingerprint of a line with its numbers masked and confusable signs set equal; None without a number in digits beside a letter."""
    if not DIGIT.search(line):
        return None
    s = MASKED.sub("#", " ".join(line.split()))
    if "#" not in s or not LETTER.search(s):
        return None
    s = s.lower()
    for pair, one in SAME:
        s = s.replace(pair, one)
    return xxhash.xxh3_64_intdigest(s.translate(ONE).encode("utf-8", "surrogatepass")) >> 1


def page_edges(lines: list[str]) -> set[int]:
    """Indexes of the first and the last line of each page that are not blank; pages part at form feeds."""
    ends = [-1, *[i for i, line in enumerate(lines) if "\f" in line], len(lines)]
    out: set[int] = set()
    for a, b in zip(ends, ends[1:]):
        body = [i for i in range(a + 1, b) if lines[i].strip()]
        out.update(body[:1] + body[-1:])
    return out


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The templates of the lines of each text and whether they stand at the edge of a page, under the digest of the text."""
    for b in batches:
        digests, keys, edges = [], [], []
        for text, raw in zip(b.column("text").to_pylist(), b.column("raw").to_pylist()):
            text = raw.decode("utf-8", "replace") if text is None and raw is not None else text
            if text is None:
                continue
            lines = text.split("\n")
            at = page_edges(lines)
            got = [(k, i in at) for i, line in enumerate(lines) if (k := template(line)) is not None]
            digests.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            keys.append([k for k, _ in got])
            edges.append([e for _, e in got])
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(edges, pa.list_(pa.bool_()))], ["digest", "keys", "edges"])


#: Templates of running lines that go to all tasks, 8 bytes each; of more, each text gets its own by a join, with the same result.
SHARED = 1 << 22


class Sorted:
    """A set of whole numbers as a sorted array."""

    def __init__(self, values: np.ndarray):
        self.values = array("q", np.sort(values).astype(np.int64).tobytes())

    def __len__(self) -> int:
        return len(self.values)

    def __iter__(self) -> Iterator[int]:
        return iter(self.values)

    def __contains__(self, x: int | None) -> bool:
        i = len(self.values) if x is None else bisect_left(self.values, x)
        return i < len(self.values) and self.values[i] == x


def running_lines(texts: DataFrame, least: int = 5, share: float = 0.52) -> DataFrame:
    """``key`` of the templates of running headers and footers: at the edge of a page ``least`` times, and oftener there than in the body (``share``).

    ``texts``: the templates of each distinct text, as of ``_templates``.
    """
    each = texts.select(F.explode(F.arrays_zip("keys", "edges")).alias("x")).select(F.col("x.keys").alias("key"), "x.edges")
    sums = each.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("edges").cast("int")).alias("e"))
    return sums.where((F.col("e") >= least) & (F.col("e") >= share * F.col("n"))).select("key")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the digest of their text, as ``_templates`` has it."""
    for b in batches:
        digests = []
        for text, raw in zip(b.column("text").to_pylist(), b.column("raw").to_pylist()):
            text = raw.decode("utf-8", "replace") if text is None and raw is not None else text
            digests.append(None if text is None else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary())], [*b.schema.names, "digest"])


def scanned(pages: DataFrame) -> DataFrame:
    """The rows of ``_scan`` for ``pages``, with the running lines of the whole corpus."""
    texts = cut(pages.select("text", "raw").mapInArrow(_templates, "digest binary, keys array<bigint>, edges array<boolean>").dropDuplicates(["digest"]))
    running = cut(running_lines(texts))
    schema = COLUMNS.format(ord=dict(pages.dtypes)["ord"])
    if running.count() <= SHARED:
        known = pages.sparkSession.sparkContext.broadcast(Sorted(running.toArrow().column("key").to_numpy()))
        return pages.mapInArrow(_scan(known), schema)
    held = texts.select("digest", F.explode(F.array_distinct("keys")).alias("key")).join(running, "key").groupBy("digest").agg(F.collect_list("key").alias("running"))  # of one text
    fields = ", ".join(f"{n} {t}" for n, t in pages.dtypes)
    return pages.mapInArrow(_digests, f"{fields}, digest binary").join(held, "digest", "left").drop("digest").mapInArrow(_scan(None), schema)


def furniture(lines: list[str], title: str | None, running: Collection[int] = frozenset()) -> set[int]:
    """Indexes of the lines that are only a running header, a footer or a page number."""
    found: set[int] = set()
    head = _plain(title or "")
    short: list[int] = []
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or s == "\f":
            continue
        if PAGE_NUMBER.match(s) or running and template(s) in running:
            found.add(i)
            continue
        m = TITLE_NUMBER.match(s)
        body = m.group(1) if m else s
        if m and not re.search(r"\s{3,}", body) and LETTER.search(body):
            found.add(i)
        elif head:
            p = _plain(body)
            if len(p) >= 12 and len(p) < len(head) and _near_prefix(p, head):
                short.append(i)
    found |= _repeated(lines, found)
    # the shortened title stands alone on a line at the edge of a page
    for i in short:
        if _edge(lines, i, found):
            found.add(i)
    return found


def _repeated(lines: list[str], found: set[int]) -> set[int]:
    """The outermost lines of pages that stand, but for their digits, at the same edge of three pages and of half of all."""
    ends = [-1, *[i for i, line in enumerate(lines) if "\f" in line], len(lines)]
    if len(ends) < 4:
        return set()
    at: dict[tuple[int, str], list[int]] = {}
    for a, b in zip(ends, ends[1:]):
        body = [i for i in range(a + 1, b) if lines[i].strip() and i not in found]
        for edge, i in enumerate((body[0], body[-1]) if len(body) > 1 else ()):
            key = re.sub(r"\d+", "0", re.sub(r"\s+", " ", lines[i].strip().lower()))
            if LETTER.search(key):
                at.setdefault((edge, key), []).append(i)
    return {i for same in at.values() if len(same) >= 3 and 2 * len(same) >= len(ends) - 1 for i in same}


def _near_prefix(p: str, head: str) -> bool:
    if head.startswith(p):
        return True
    bad = sum(a != b for a, b in zip(p, head))
    return bad <= 2 and len(p) > 16


def _edge(lines: list[str], i: int, found: set[int]) -> bool:
    before = next((k for k in range(i - 1, -1, -1) if lines[k].strip(" \t\r")), None)
    return before is None or lines[before].strip() == "" or "\f" in lines[before] or before in found


def analyse(text: str, title: str | None, running: Collection[int] = frozenset()) -> tuple[list[int], list[tuple[int, str, str, str]], list[tuple[str, int, int, int]]]:
    """Furniture lines; divided words (line, first part, second part, mark); words (word, line, next line, length of the first part)."""
    lines = text.split("\n")
    out = furniture(lines, title, running)
    body = [i for i, line in enumerate(lines) if i not in out and line.strip()]
    divided: list[tuple[int, str, str, str]] = []
    words: list[tuple[str, int, int, int]] = []
    skip = 0
    for k, i in enumerate(body):
        line = lines[i]
        start, skip = skip, 0
        end = len(line)
        tail = line.rstrip()
        if len(tail) > 1 and tail[-1] in HYPHENS and LETTER.match(tail[-2]):
            cut_at = len(tail) - 1
            a = re.search(r"[^\s„«»“”\"()\[\],.;:]+$", tail[:cut_at])
            nxt = lines[body[k + 1]] if k + 1 < len(body) else ""
            b = re.match(r"[^\s„«»“”\"()\[\],.;:?!…]+|", nxt.lstrip()).group()
            if a and b and not b[:1].isupper() and LETTER.search(b):
                divided.append((i, a.group(), b, tail[-1]))
                first = a.group()
                words.append((first + b, i, body[k + 1], len(first)))
                end = a.start()
                skip = len(nxt) - len(nxt.lstrip()) + len(b)
            elif a and not b:
                divided.append((i, a.group(), "", tail[-1]))
        for m in WORD.finditer(line, start, end):
            if not (NUMBERED.match(m.group()) and PROVISION.search(line, 0, m.start())):
                words.append((m.group(), i, -1, 0))
    return sorted(out), divided, words


MIX = 0x9E3779B97F4A7C15


def sign_hash(c: str) -> int:
    x = (ord(c) + 1) * MIX & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 32) & 0xFFFFFFFFFFF


class Anagram(dict):
    def __missing__(self, c: str) -> int:
        self[c] = sign_hash(c)
        return self[c]


_HASHES = Anagram()


def anagram(word: str) -> int:
    return sum(map(_HASHES.__getitem__, word))


def _base(c: str) -> str:
    """The letter without its marks; strokes are no marks to Unicode."""
    return {"ł": "l", "đ": "d", "ø": "o", "ħ": "h", "ŧ": "t", "ƚ": "l", "ı": "i"}.get(c) or unicodedata.normalize("NFD", c)[0]


def marks() -> list[tuple[str, str]]:
    """(wrong, right): marked letters and the letters that differ from them by marks only, plain or written in some language."""
    rights: dict[str, list[str]] = {}
    for c in dict.fromkeys("abcdefghijklmnopqrstuvwxyz" + "".join(MARKED.values())):
        rights.setdefault(_base(c), []).append(c)
    return [(w, r) for w in LATIN for r in rights.get(_base(w), ()) if r != w]


def differences() -> list[tuple[str, str, int]]:
    """(wrong, right, difference of the anagram hashes), in lower case."""
    pairs = [(w, r) for w, rights in CONFUSED.items() for r in dict.fromkeys(rights.lower())] + marks()
    return [(w, r, anagram(r) - anagram(w)) for w, r in pairs]


def doubtful(word: str, foreign: re.Pattern = FOREIGN[""]) -> bool:
    """Whether a word could be a misreading: a sign or digit among letters, letters in a number, a pair that looks like one letter, or a letter with marks foreign to the language."""
    if SIGNS.search(word) and (LETTER.search(word) is not None or "|" in word or "!" in word):
        return True
    return not SIGNS.search(word) and DIGRAPH.search(word) is not None or not word.isascii() and foreign.search(word) is not None


COLUMNS = "kind string, id string, ord {ord}, line int, next int, cut int, word string, rest string, mark string, n bigint, h bigint"


def _scan(shared):
    """Rows of five kinds: d documents, f furniture, h divided words, s doubtful words, w the counts of the words of a text under its digest.

    ``shared``: the running lines of all texts; without it each row has those of its own text as ``running``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "ord", "line", "next", "cut", "word", "rest", "mark", "n", "h"]
        for b in batches:
            rows: list[tuple] = []
            ids, ords = b.column("id").to_pylist(), b.column("ord")
            at: list[int] = []
            lines_of = [shared.value] * len(ids) if shared else [frozenset(x or ()) for x in b.column("running").to_pylist()]
            for k, (doc, text, raw, title, running) in enumerate(zip(ids, b.column("text").to_pylist(), b.column("raw").to_pylist(), b.column("title").to_pylist(), lines_of)):
                if text is None and raw is not None:
                    text = raw.decode("utf-8", "replace")
                before = len(rows)
                rows.append(("d", doc, None, None, None, None, None, None, None, None))
                if text is not None:
                    lines, divided, words = analyse(text, title, running)
                    foreign = FOREIGN.get(language(text), FOREIGN[""])
                    rows += [("f", doc, i + 1, None, None, None, None, None, None, None) for i in lines]
                    rows += [("h", doc, i + 1, None, None, x.lower(), y.lower(), mark, None, None) for i, x, y, mark in divided]
                    counts: Counter[str] = Counter()
                    for w, i, j, c in words:
                        low = w.lower()
                        counts[low] += 1
                        if doubtful(w, foreign):
                            rows.append(("s", doc, i + 1, j + 1, c, low, w, None, None, None))
                    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                    rows.append(("w", doc, None, None, None, digest, "\n".join(f"{w} {n}" for w, n in sorted(counts.items())), None, None, None))
                at += [k] * (len(rows) - before)
            col = lambda i, t: pa.array([r[i] for r in rows], t)
            yield pa.RecordBatch.from_arrays(
                [col(0, pa.string()), col(1, pa.string()), ords.take(pa.array(at, pa.int32())), col(2, pa.int32()), col(3, pa.int32()), col(4, pa.int32()),
                 col(5, pa.string()), col(6, pa.string()), col(7, pa.string()), col(8, pa.int64()), col(9, pa.int64())], names,
            )

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a task, from the counts of its texts."""
    for b in batches:
        counts: Counter[str] = Counter()
        for text in b.column("rest").to_pylist():
            for row in text.split("\n") if text else ():
                w, _, n = row.rpartition(" ")
                counts[w] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array(list(map(anagram, counts)), pa.int64())], ["word", "n", "h"])


def scan_noise(legal: DataFrame, often: int = 4, ratio: int = 8) -> DataFrame:
    """``id, kind, line_no, wrong, right``: the noise of the current page texts; ``wrong`` and ``right`` of divided and misread words.

    A word is misread if a confusion of signs leads to a word at least ``often`` times in the corpus and ``ratio`` times as often.
    """
    pages = legal.select("id", F.col("updated_at").alias("ord"), "title", F.col("pdf_extracted_text").alias("text"), F.when(F.col("pdf_extracted_text").isNull(), F.col("pdf_raw_content")).alias("raw"))
    rows = cut(scanned(pages))
    current = rows.where("kind = 'd'").groupBy("id").agg(F.max("ord").alias("ord"))
    live = rows.where("kind <> 'd'").join(current, (rows["id"].eqNullSafe(current["id"])) & (rows["ord"].eqNullSafe(current["ord"]))).drop(current["id"]).drop(current["ord"])
    texts = live.where("kind = 'w'").groupBy("word").agg(F.min("rest").alias("rest"))  # titles may tell other furniture of equal texts
    live = live.where("kind <> 'w'").select("kind", "id", "line", "next", "cut", "word", "rest", "mark").distinct()
    words = cut(texts.select("rest").mapInArrow(_words, "word string, n bigint, h bigint").groupBy("word").agg(F.sum("n").alias("n"), F.first("h").alias("h")))
    spark = legal.sparkSession
    confusions = spark.createDataFrame(differences(), "wrong string, right string, diff bigint")  # a fixed table of some hundred rows
    doubt = live.where("kind = 's'").select("word").distinct().join(words, "word")
    signs = doubt.withColumn("wrong", F.explode(F.array_distinct(F.split("word", "")))).join(F.broadcast(confusions.where("length(wrong) = 1")), "wrong")
    pairs = doubt.join(F.broadcast(confusions.where("length(wrong) > 1")), F.expr("instr(word, wrong) > 0"))
    moved = signs.unionByName(pairs)
    moved = moved.select("word", F.col("n").alias("seldom"), "wrong", "right", (F.col("h") + F.col("diff")).alias("h"))
    known = words.where(F.col("n") >= often).select("h", F.col("word").alias("better"), F.col("n").alias("often"))
    match = moved.join(known, "h").where(F.col("often") >= ratio * F.col("seldom"))
    # the hashes of an anagram are equal too: the confusion must lead to the very word
    match = match.withColumn("at", F.expr("filter(sequence(1, length(word)), i -> substring(word, i, length(wrong)) = wrong and concat(substring(word, 1, i - 1), right, substring(word, i + length(wrong))) = better)"))
    match = match.where("size(at) > 0").withColumn("pos", F.col("at")[0])
    # a foreign letter is a misreading if most words with it have a correction; names and foreign words have none
    letters = sorted({w for w, _ in marks()})
    asked = signs.where(F.col("wrong").isin(letters)).groupBy("wrong").agg(F.count_distinct("word").alias("all"))
    mended = match.where(F.col("wrong").isin(letters)).groupBy("wrong").agg(F.count_distinct("word").alias("some"))
    told = mended.join(asked, "wrong").where((F.col("some") >= 2) & (2 * F.col("some") >= F.col("all"))).select("wrong")  # some hundred letters at most
    match = match.where(~F.col("wrong").isin(letters)).unionByName(match.join(F.broadcast(told), "wrong", "left_semi").select(*match.columns))
    best = match.groupBy("word").agg(F.max(F.struct("often", "better", "pos")).alias("x")).select("word", "x.better", "x.pos")
    seen = live.where("kind = 's'").join(best, "word", "left")
    certain = F.col("rest").rlike(r"(?U)\p{L}[@$€|†£¢¦]\p{L}|^[@$€†£¢¦]\p{L}{2}|\p{L}{2}[@$€†£¢¦]$|\p{L}!\p{L}{2}|\p{L}{2}[0-9]\p{Ll}{2}|^\p{Lu}[0-9]\p{Ll}{3}|^[0-9]\p{Ll}{5}") | F.col("rest").rlike(NUMBER.pattern)
    seen = seen.where(F.col("better").isNotNull() | certain)
    sign = F.regexp_instr("rest", F.lit(r"[@$€|†£¢¦!0-9]"))
    line = F.when((F.col("next") > 0) & (F.coalesce("pos", sign) > F.col("cut")), F.col("next")).otherwise(F.col("line"))
    misread = seen.select("id", F.lit("misread").alias("kind"), line.alias("line_no"), F.col("rest").alias("wrong"), F.col("better").alias("right"))
    # divided words: which of the two forms does the corpus know, and is the second part a word of its own
    split = live.where("kind = 'h'").select("id", "line", "word", "rest", "mark")
    forms = split.select("word", "rest").distinct()
    asked = forms.select("word", "rest", F.explode(F.array(
        F.struct(F.lit("j").alias("f"), F.concat("word", "rest").alias("w")), F.struct(F.lit("h").alias("f"), F.concat_ws("-", "word", "rest").alias("w")), F.struct(F.lit("r").alias("f"), F.col("rest").alias("w")))).alias("q")).select("word", "rest", "q.*")
    told = asked.join(words.select(F.col("word").alias("w"), "n"), "w", "left").groupBy("word", "rest").agg(*[F.coalesce(F.sum(F.when(F.col("f") == f, F.col("n"))), F.lit(0)).alias(f) for f in "jhr"])
    split = split.join(told, ["word", "rest"], "left")
    # the joined form was counted once for each of its own divisions; a compound keeps its hyphen if it is known with one
    own = (F.col("mark") != "-") | ((F.col("h") == 0) & ~((F.col("j") <= 1) & F.col("word").rlike("o$") & (F.col("r") > 3))) | (F.col("j") > 4 * F.col("h"))
    hyphen = split.where(own).select("id", F.lit("hyphen").alias("kind"), F.col("line").alias("line_no"), F.concat("word", "mark").alias("wrong"), F.concat("word", "rest").alias("right"))
    out = live.where("kind = 'f'").select("id", F.lit("furniture").alias("kind"), F.col("line").alias("line_no"), F.lit(None).cast("string").alias("wrong"), F.lit(None).cast("string").alias("right"))
    return out.unionByName(hyphen).unionByName(misread)


def mend(text: str, dropped: set[int], joined: set[int], fixes: dict[int, list[tuple[str, str]]]) -> str:
    """The continuous paragraphs of a page text, without its noise."""
    paragraphs, now, glue, ended = [], "", False, False
    for i, line in enumerate(text.split("\n"), 1):
        if i in dropped or line.strip() == "" and "\f" in line:
            continue
        s = line.strip()
        if not s:
            ended = True
            continue
        for wrong, right in fixes.get(i, ()):
            if right:
                s = s.replace(wrong, right[:1].upper() + right[1:] if wrong[:1].isupper() or wrong[:1] in "015$" and not now else right)
        if now and ended and not glue and (now[-1:] in ".!?…”»)\":;" or s[:1].isupper() or s[:1] in "§„(0123456789"):
            paragraphs.append(now)
            now = ""
        now = now + s if glue or not now else f"{now} {s}"
        glue = now[-1:] in HYPHENS
        if i in joined:
            now = now[:-1]
        ended = False
    return "\n\n".join([*paragraphs, now] if now else paragraphs)


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, raw, noise in zip(b.column("text").to_pylist(), b.column("raw").to_pylist(), b.column("noise").to_pylist()):
            text = raw.decode("utf-8", "replace") if text is None else text
            noise = noise or []
            fixes: dict[int, list[tuple[str, str]]] = {}
            for x in noise:
                if x["kind"] == "misread":
                    fixes.setdefault(x["line_no"], []).append((x["wrong"], x["right"]))
            out.append(mend(text, {x["line_no"] for x in noise if x["kind"] == "furniture"}, {x["line_no"] for x in noise if x["kind"] == "hyphen"}, fixes))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "paragraphs"])


def mended_texts(legal: DataFrame) -> DataFrame:
    """``id, paragraphs``: the page text of each current document as continuous paragraphs, divided by blank lines."""
    noise = scan_noise(legal).groupBy("id").agg(F.collect_list(F.struct("kind", "line_no", "wrong", "right")).alias("noise"))  # of one text only
    raw = F.when(F.col("pdf_extracted_text").isNull(), F.col("pdf_raw_content"))
    text = newest(legal.select("id", "updated_at", F.col("pdf_extracted_text").alias("text"), raw.alias("raw")), "id", "updated_at", "text", "raw")
    text = text.where("text is not null or raw is not null")
    return text.join(noise, "id", "left").select("id", "text", "raw", "noise").mapInArrow(_mend, "id string, paragraphs string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(table(spark, sf_dir, "legal_documents")).select("id", "kind", "line_no").distinct()


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mended_texts(table(spark, sf_dir, "legal_documents"))


QUERIES = {"p6_found": p6_found, "p6_text": p6_text}
ORACLES: dict[str, str] = {}
