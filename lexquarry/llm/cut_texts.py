"""Problem 9: texts cut off by field limits.

A character n-gram model is read backwards from the last sign of a value: its contexts are the last 2, 4, 6, 9, 13 and 18 signs
and, for a value that ends without a stop, the first 3, 6, 10, 16 and 24 signs of its last line. For every context that is asked
for, the corpus is counted exactly: how often it stands anywhere, at the end of a text, and before a stop. From short contexts
to long ones each order is smoothed by the one before, which gives the likelihood of the context under "the text ends here"
against "the text goes on here", as log-odds. A value is cut if its log-odds are below the threshold of its language and column.

The thresholds come from held-out cuts the operator makes itself: of every text the true end is set against a place chosen by
a hash. A mark of omission or a remnant of markup after the cut is taken off first, and what stands
before it is judged; an ellipsis in place of a full stop is judged by whether a stop is likely after the words before it. Stops
inside an open quotation or bracket are signs of their own, so that an end there is told from one outside by the model too.

Counts cover the distinct texts, trailing white space apart, and what the end of a text adds to its own counts is left out.
Defined results: null and blank texts, and texts of a mark of omission only, are no case; a repeated text is judged alike each
time; a language with few held-out texts gets the threshold of all.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..session import cut

#: Lengths of the contexts read backwards from a position, and how many of them a text is asked for that ends in a stop.
ORDERS = (2, 4, 6, 9, 13, 18)
AFTER_STOP = 3
#: Lengths of the beginnings of a last line.
HEADS = (3, 6, 10, 16, 24)
#: Weight of the shorter context in that of the longer one, in occurrences; and the least log-odds of the signs at an end.
WEIGHT, WEIGHT_HEAD, WEIGHT_STOP, FLOOR = 60.0, 2.0, 20.0, -4.0
#: Bits of the sieve that keeps contexts nobody asks for out of the shuffle: at least 16 for each context asked, between these powers of two.
SIEVE = (20, 27)
#: The fewest held-out texts of a language for a threshold of its own.
FEWEST = 1_000
#: Signs that end a sentence; a text that ends in one of them with its closing marks ends in a stop.
STOP = ".!?…。！？।؟"
ENDED = re.compile(rf"[{STOP}][”»“\"’)\]」』\s]*$")
#: Marks of omission and remnants of markup after a cut; an ellipsis set off by a blank or in brackets is one.
MARK = re.compile(
    r"(?:\s*\[\s*(?:\.{2,}|…|cut|ciąg dalszy|dalej|więcej|more)[^\]\n]*\]?|\s*\(\s*(?:więcej|more|czytaj|cd\.?|c\.d\.n\.?|\.{3}|…)[^)\n]*\)?|&[a-zA-Z#]+\d*;?|<[^>\n]*|\s*>>+|\s*»»|\{\{|(?:\.{2,}|…)\s*[\])]|=[0-9A-F]?|%[0-9A-F]?|\\u?[0-9a-f]{0,3}|�+|\s+(?:\.{3,}|…))\s*$"
)
ELLIPSIS = re.compile(r"(?:\.{3,}|…)\s*$")
QUOTES = re.compile(r"[„«「『(（\[”»」』)）\]“\"\n.!?…。！？।؟]")
OPENING = re.compile(r"[„«「『(（\[“\"]")
LETTERS = {
    "pl": "ąćęłńśźż", "cs": "ěřůťďň", "uk": "іїєґжщ", "de": "äöüß", "fr": "éèêàç", "zh": "的和应", "ja": "のはをに",
}


def language(text: str) -> str:
    """The language whose own letters are most frequent in ``text``."""
    best, most = "en", 0
    for lang, letters in LETTERS.items():
        n = sum(map(text.count, letters))
        if n > most + (lang == "fr"):
            best, most = lang, n
    return best


#: Signs whose contexts are counted at a time; bounds the memory of a task, not what is counted.
PORTION = 1_000_000
PAD = "\0" * max(ORDERS)
INSIDE = "\x01"
STOPS = np.array([ord(c) for c in STOP + INSIDE], np.uint64)
COUNTS = ("seen", "ends", "stops")
NONE = (0, 0, 0)
P = np.uint64(0x9E3779B97F4A7C15)
#: The lowest two bits of a fingerprint are left free for the kind of an occurrence.
KEPT = np.uint64(0xFFFFFFFFFFFFFFFC)
#: Keys of the empty contexts: of signs, and of lines that follow a line, or a blank line.
EMPTY, LINES = -1, (-2, -3)


def signs(text: str) -> str:
    """``text`` in small letters; stops within a quotation or bracket of a line are another sign."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals have small forms of two signs
        low = "".join(c.lower()[0] for c in text)
    if not OPENING.search(low):
        return low
    german, depth, straight = "„" in low, 0, False

    def told(m: re.Match) -> str:
        nonlocal depth, straight
        c = m.group()
        if c == "\n":
            depth, straight = 0, False
        elif c == '"':
            straight = not straight
        elif c in "„«「『(（[" or c == "“" and not german:
            depth += 1
        elif c in "”»」』)）]“":
            depth = max(0, depth - 1)
        elif depth or straight:
            return INSIDE
        return c

    return QUOTES.sub(told, low)


def codes_of(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c >= 48) & (c <= 57)] = 48
    return c


def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h + codes + np.uint64(1)) * P
    return h ^ (h >> np.uint64(29))


def contexts(tails: list[str]) -> list[list[int]]:
    """Fingerprints of the last signs of each of ``tails``, one for each order."""
    codes = codes_of("".join(PAD + t[-len(PAD) :] for t in tails))
    at = np.cumsum([len(PAD) + min(len(PAD), len(t)) for t in tails])
    h, out = np.full(len(at), 1, np.uint64), []
    for j in range(1, max(ORDERS) + 1):
        h = _step(h, codes[at - j])
        if j in ORDERS:
            out.append((h & KEPT).view(np.int64).tolist())
    return [list(x) for x in zip(*out)]


def _fingerprint(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) & ~3


DIGITS = re.compile(r"\d+")


def head(line: str, own: bool) -> list[int]:
    """Fingerprints of the beginnings of a line (one that stands on a paragraph of its own is another), shortest first."""
    h = DIGITS.sub("0", line.strip().lower())
    return [_fingerprint(f"{own:d}{h[:n]}") for n in HEADS]


def lines_of(text: str) -> list[tuple[str, bool]]:
    """The lines of ``text`` that are not blank, and whether a blank line or nothing is before them."""
    out, free = [], True
    for line in text.split("\n"):
        if line.strip():
            out.append((line, free))
            free = False
        else:
            free = True
    return out


class Case(NamedTuple):
    """What decides about an end: the contexts of its last signs and, where it has no stop, of the head of its line.

    ``kind``: "end", or "stop" for an ellipsis in place of a stop. ``own``: how much the end adds to its own counts (seen,
    ends, stops), and to those of the head.
    """

    kind: str
    lang: str
    tails: list[int]
    heads: list[int] | None
    free: bool
    own: tuple[int, int, int]
    own_head: tuple[int, int]


def stripped(text: str) -> tuple[str, bool]:
    """``text`` without white space at its end and without marks of omission, and whether there was one."""
    t = text.rstrip()
    m = MARK.search(t, max(0, t.rfind("\n")))
    return (t[: m.start()].rstrip(), True) if m else (t, False)


def ends_in_stop(text: str) -> bool:
    return ENDED.search(text, max(0, len(text.rstrip("”»“\"’)]」』 \t\r\n")) - 1)) is not None


def parts(text: str | None) -> tuple[str, str, str, bool, bool] | None:
    """``(kind, tail, last line, free, marked)`` of the end of a text; None where nothing can be cut."""
    t, marked = stripped(text or "")
    if not t:
        return None
    line, free = lines_of(t)[-1]
    m = ELLIPSIS.search(t, max(0, len(t.rstrip(" .…")) - 1))
    if m:
        t = t[: m.start()].rstrip()
        return ("stop", t, "", False, marked) if t and any(c.isalnum() for c in t) else None
    return ("end", t, "" if ends_in_stop(t) else line, free, marked)


def cases_of(texts: list[str | None], held: list[bool]) -> list[tuple[Case | None, list[tuple[Case, bool]]]]:
    """For each text the case of its end, and, for those to be held out, further cases with whether they are cuts."""
    wanted: list[tuple[int, bool | None, str, str, str, str, bool, tuple, tuple]] = []
    for i, (text, sample) in enumerate(zip(texts, held)):
        p = parts(text)
        if p is None:
            continue
        kind, tail, line, free, marked = p
        lang, whole = language(text), signs(text.rstrip())
        own = (1, 1, 0) if kind == "end" else (1, 0, 1)
        wanted.append((i, None, kind, lang, whole[: len(tail)], line, free, own, (1, 1)))
        if sample and not marked and kind == "end" and len(tail) > 40:
            wanted.append((i, False, kind, lang, whole[: len(tail)], line, free, own, (1, 1)))
            at = 20 + _fingerprint(text) % (len(tail) - 30)
            t = text[:at].rstrip()
            if t and not ends_in_stop(t):
                (made, open_) = lines_of(t)[-1]
                wanted.append((i, True, "end", lang, whole[: len(t)], made, open_, (1, 0, 0), (1, 0)))
                if t[-1].isalnum():
                    wanted.append((i, True, "stop", lang, whole[: len(t)], "", False, (1, 0, 0), (0, 0)))
            stop = whole.find(". ", at)
            if stop > 0 and whole[stop - 1].isalnum():
                wanted.append((i, False, "stop", lang, whole[:stop], "", False, (1, 0, 1), (0, 0)))
    out: list[tuple[Case | None, list[tuple[Case, bool]]]] = [(None, []) for _ in texts]
    for w, tails in zip(wanted, contexts([w[4] for w in wanted]) if wanted else ()):
        i, label, kind, lang, _, line, free, own, own_head = w
        heads = head(line, free) if line else None
        c = Case(kind, lang, tails if line or kind == "stop" else tails[:AFTER_STOP], heads, free, own, own_head)
        if label is None:
            out[i] = (c, out[i][1])
        else:
            out[i][1].append((c, label))
    return out


def _odds(q: float, base: float) -> float:
    q, base = (min(max(x, 1e-12), 1 - 1e-12) for x in (q, base))
    return math.log(q / (1 - q)) - math.log(base / (1 - base))


def log_odds(c: Case, model: dict[int, tuple[int, int, int]]) -> float:
    """Log-odds of the contexts of ``c`` under an end (or a stop) against going on; 0 without a model."""
    which = 1 if c.kind == "end" else 2
    total = model.get(EMPTY, NONE)
    q = base = total[which] / max(1, total[0])
    weight = WEIGHT if c.kind == "end" else WEIGHT_STOP
    for key in c.tails:
        n = model.get(key, NONE)
        q = (max(0, n[which] - c.own[which]) + weight * q) / (max(0, n[0] - c.own[0]) + weight)
    score = _odds(q, base)
    if c.kind == "stop":
        return score
    score = max(FLOOR, score)
    if c.heads is not None:
        lines = [model.get(k, NONE) for k in LINES]
        mean = sum(n[1] for n in lines) / max(1, sum(n[0] for n in lines))
        q = lines[c.free][1] / max(1, lines[c.free][0])
        for key in c.heads:
            n = model.get(key, NONE)
            q = (max(0, n[1] - c.own_head[1]) + WEIGHT_HEAD * q) / (max(0, n[0] - c.own_head[0]) + WEIGHT_HEAD)
        score += _odds(q, mean)
    return score


def _count(sieve):
    """Counts of the contexts of a portion of a task: anywhere, at the end of a text, before a stop; of heads: lines, last lines without a stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value
        mask = np.uint64(64 * len(words) - 1)
        known: dict[tuple[str, bool], list[int]] = {}

        def sifted(keys: np.ndarray) -> np.ndarray:
            place = (keys >> np.uint64(2)) & mask
            return words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0

        def heads(line: str, free: bool) -> list[int]:
            k = line[: 2 * max(HEADS)], free
            if k not in known:
                if len(known) > 200_000:
                    known.clear()
                known[k] = head(line, free)
            return known[k]

        def count(texts: list[str], first: list[int], last: list[int], lines: list[list[int]]) -> pa.RecordBatch:
            codes = codes_of("".join(PAD + t for t in texts) + PAD)
            at = np.flatnonzero(codes[:-1]) + 1
            h = np.full(len(at), 1, np.uint64)
            kind = (codes == 0).astype(np.uint64) + np.uint64(2) * np.isin(codes, STOPS)
            total = [len(at), int((kind[at] == 1).sum()), int((kind[at] == 2).sum())]
            marked = []
            for j in range(1, max(ORDERS) + 1):
                h = _step(h, codes[at - j])
                if j in ORDERS:  # whoever asks for a longer context asks for this one
                    ok = sifted(h)
                    h, at = h[ok], at[ok]
                    marked.append((h & KEPT) | kind[at])
            for flag, got in ((0, first), (1, last)):
                x = np.asarray(got, np.int64).view(np.uint64)
                marked.append(x[sifted(x)] | np.uint64(flag))
            x = np.sort(np.concatenate(marked))
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
            n, x = np.diff(np.append(at, len(x))), x[at]
            key, flag = (x & KEPT).view(np.int64), x & ~KEPT
            first_of = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(x) else np.empty(0, np.int64)
            sums = [np.add.reduceat(np.where(w, n, 0), first_of) if len(first_of) else first_of for w in (flag >= 0, flag == 1, flag == 2)]
            key = np.concatenate([key[first_of], [EMPTY, *LINES]])
            rest = [[total[0], lines[0][0], lines[1][0]], [total[1], lines[0][1], lines[1][1]], [total[2], 0, 0]]
            columns = [np.concatenate([c, r]) for c, r in zip(sums, rest)]
            return pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(c.astype(np.int64)) for c in columns]], ["key", *COUNTS])

        texts: list[str] = []
        first: list[int] = []
        last: list[int] = []
        lines = [[0, 0], [0, 0]]
        held = 0
        for b in batches:
            for text in b.column("text").to_pylist():
                p = parts(text)
                if p is None:
                    continue
                kind, tail, end, _, _ = p
                # the end of a marked text is the place of its cut, not an end by design: it is counted without its mark
                texts.append(signs(text)[: len(tail)] if kind == "end" else signs(text))
                held += len(text)
                rows = lines_of(text[: len(tail)] if kind == "end" else text)
                for k, (line, free) in enumerate(rows):
                    final = k == len(rows) - 1 and bool(end)
                    lines[free][0] += 1
                    lines[free][1] += final
                    (last if final else first).extend(dict.fromkeys(heads(line, free)))
                if held > PORTION:
                    yield count(texts, first, last, lines)
                    texts, first, last, lines, held = [], [], [], [[0, 0], [0, 0]], 0
        if texts:
            yield count(texts, first, last, lines)

    return run


def train(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``key`` and its exact counts over all ``text`` values, for every ``key`` of ``asked`` and the empty contexts."""
    bits = 1 << min(SIEVE[1], max(SIEVE[0], (16 * asked.count()).bit_length()))
    place = F.shiftright("key", 2).bitwiseAND(F.lit(bits - 1))
    set_bits = asked.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(key, 2) & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[set_bits.column("w").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    sieve = texts.sparkSession.sparkContext.broadcast(words)  # of bounded size; what it lets through in vain is dropped by the join
    schema = "key bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    rows = texts.where("text is not null").select("text").mapInArrow(_count(sieve), schema)
    sums = rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    fixed = texts.sparkSession.createDataFrame([(k,) for k in (EMPTY, *LINES)], "key bigint")
    return sums.join(asked.unionByName(fixed), "key", "left_semi")


def pack_case(c: Case, both: bool = False) -> tuple[int, str, list[int]]:
    """The number of a case, what it is without its contexts, as JSON, and its contexts; ``both``: the last signs are judged as a stop too."""
    keys = [*c.tails, *(c.heads or ())]
    rest = json.dumps([c.kind, c.lang, len(c.tails), c.heads is not None, c.free, c.own, c.own_head, both])
    return _fingerprint(f"{rest}{keys}"), rest, keys


def unpack_case(rest: str, keys: list[int]) -> tuple[Case, bool]:
    kind, lang, n, headed, free, own, own_head, both = json.loads(rest)
    return Case(kind, lang, keys[:n], keys[n:] if headed else None, free, tuple(own), tuple(own_head)), both


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The case of each text, further cases held out (with a label), and the contexts whose counts a case asks for."""
    seen: set[int] = set()
    for b in batches:
        at, labels, asks, first = [], [], [], []
        texts = b.column("text").to_pylist()
        for t in texts:  # most copies of a text are left out here, the others when texts are counted
            f = None if t is None else _fingerprint(t.rstrip())
            if len(seen) > 200_000:
                seen.clear()
            first.append(f is not None and f not in seen)
            seen.add(f)
        for i, (own, held) in enumerate(cases_of(texts, first)):
            own_ask = (None, None, None) if own is None else pack_case(own)
            at.append(i)
            labels.append(None)
            asks.append(own_ask)
            made = any(label and c.kind == "stop" for c, label in held)
            for c, label in held:
                if label and c.kind == "stop":  # stands at the place of the cut that is judged as an end
                    continue
                at.append(i)
                labels.append(label)
                asks.append((own_ask[0], None, None) if c == own else pack_case(c, made and label))
        i = pa.array(at, pa.int32())
        of = pa.array([None if label is None else _fingerprint(texts[k].rstrip()) for k, label in zip(at, labels)], pa.int64())
        columns = [pa.array(labels, pa.bool_()), of, *[pa.array([a[k] for a in asks], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.int64())))]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(i), b.column("source").take(i), *columns], ["doc_id", "source", "label", "of", "ask", "case", "keys"])


def _judge(empty: dict[int, tuple[int, int, int]]):
    """The log-odds of each case from its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asks, kinds, langs, scores = [], [], [], []
            for ask, rest, keys, counts in zip(*[b.column(c).to_pylist() for c in ("ask", "case", "keys", "counts")]):
                case, both = unpack_case(rest, keys)
                model = empty | {x["key"]: tuple(x[n] for n in COUNTS) for x in counts or ()}
                for c in (case, case._replace(kind="stop", heads=None)) if both else (case,):
                    asks.append(ask)
                    kinds.append(c.kind)
                    langs.append(c.lang)
                    scores.append(log_odds(c, model))
            yield pa.RecordBatch.from_arrays([pa.array(asks, pa.int64()), pa.array(kinds, pa.string()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["ask", "kind", "lang", "score"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a task under their digests, each the first time only."""
    seen: set[bytes] = set()
    for b in batches:
        keys, texts = [], []
        for text in b.column("text").to_pylist():
            text = text.rstrip()
            key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if len(seen) > 1_000_000:
                seen.clear()
            if key not in seen:
                seen.add(key)
                keys.append(key)
                texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["digest", "text"])


def distinct_texts(documents: DataFrame) -> DataFrame:
    """One row for each ``text``; copies are dropped before the shuffle, so that a hot text is no hot task."""
    once = documents.where("text is not null").select("text").mapInArrow(_once, "digest binary, text string")
    return once.dropDuplicates(["digest"]).select("text")


def threshold(wholes: dict[int, int], cuts: dict[int, int], rare: float = 0.3) -> float:
    """The log-odds (in quarters, as the keys) that part held-out cuts from true ends best; a cut weighs ``rare``.

    Of those that are next to equally good the one nearest to 0 is taken, where both hypotheses are equally likely.
    """
    n, m = max(1, sum(wholes.values())), max(1, sum(cuts.values()))
    costs = {}
    for t in range(-16, 17):
        wrong = sum(v for k, v in wholes.items() if k < t) / n
        missed = sum(v for k, v in cuts.items() if k >= t) / m
        costs[t] = round(wrong + rare * missed, 3)
    best = min(costs.values())
    return min((t for t, c in costs.items() if c <= best + 0.01), key=abs) / 4


def thresholds(held: DataFrame) -> dict[tuple[str, str], float]:
    """Threshold for each kind and language (``""``: all) from the scores of the held-out cases: ``kind, lang, label, score, n``."""
    rows = held.groupBy("kind", "lang", "label", F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) * 4).cast("int").alias("q")).agg(F.sum("n").alias("count")).collect()
    sums: dict[tuple[str, str], tuple[dict[int, int], dict[int, int]]] = {}
    for r in rows:
        for lang in (r["lang"], ""):
            side = sums.setdefault((r["kind"], lang), ({}, {}))[bool(r["label"])]
            side[r["q"]] = side.get(r["q"], 0) + r["count"]
    return {k: threshold(*v) for k, v in sums.items() if not k[1] or min(sum(v[0].values()), sum(v[1].values())) >= FEWEST}


def scored(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, source, ask`` of every document; ``ask, kind, lang, score`` of all cases; ``ask, label, n`` of those held out, with the number of texts."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, source string, label boolean, of bigint, ask bigint, case string, keys array<bigint>"
    rows = cut(documents.select("doc_id", "source", "text").mapInArrow(_cases, schema))
    asking = cut(rows.where("case is not null").select("ask", "case", "keys").dropDuplicates(["ask"]))  # copies ask the same
    held = rows.where("label is not null").select("ask", "label", "of").distinct().groupBy("ask", "label").agg(F.count("*").alias("n"))  # texts
    keyed = asking.select("ask", F.explode(F.array_distinct("keys")).alias("key"))
    counts = cut(train(distinct_texts(documents), cut(keyed.select("key").distinct())))
    empty = {r["key"]: tuple(r[c] for c in COUNTS) for r in counts.where(F.col("key").isin(EMPTY, *LINES)).collect()}  # three rows
    # a case leaves out its own occurrence: a context seen once, neither at an end nor before a stop, says as much as one never seen
    found = keyed.join(counts.where("seen > 1 or ends > 0 or stops > 0"), "key").groupBy("ask").agg(F.collect_list(F.struct("key", *COUNTS)).alias("counts"))  # some ten
    told = cut(asking.join(found, "ask", "left").mapInArrow(_judge(empty), "ask bigint, kind string, lang string, score double"))
    return rows.where("label is null").select("doc_id", "source", "ask"), told, held


def judged(documents: DataFrame) -> DataFrame:
    """``doc_id, source, cut`` of every document; ``documents``: ``doc_id, source, text``."""
    rows, told, held = scored(documents)
    bars = thresholds(told.join(held, "ask"))
    bar = F.lit(0.0)
    for (kind, lang), t in sorted(bars.items()):  # the general threshold of a kind first, those of languages over it
        bar = F.when((F.col("kind") == kind) & ((F.col("lang") == lang) if lang else F.lit(True)), F.lit(t)).otherwise(bar)
    marks = told.select("ask", (F.col("score") < bar).alias("cut")).distinct()
    return rows.join(marks, "ask", "left").select("doc_id", "source", F.coalesce("cut", F.lit(False)).alias("cut"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, values, cut, rate`` for each source (trimmed, in lower case)."""
    d = judged(table(spark, sf_dir, "documents")).withColumn("source", F.lower(F.trim("source")))
    out = d.groupBy("source").agg(F.count("*").alias("values"), F.sum(F.col("cut").cast("bigint")).alias("cut"))
    return out.withColumn("rate", F.round(F.col("cut") / F.col("values"), 6))


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates}
ORACLES: dict[str, str] = {}
