"""Encoders of text, bags of weighted tokens, sections and chunks to vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words without weight, legal terms that are always kept, and patterns whose words weigh more.
STOP_WORDS = [
    "i", "a", "o", "z", "w", "na", "do", "od", "po", "za", "ze", "we", "to", "ta", "te", "ty", "jest", "są", "był", "była", "było", "były", "będzie", "będą", "ma", "mają", "miał", "miała",
    "nie", "już", "tylko", "także", "również", "oraz", "albo", "lub", "ani", "czy", "że", "żeby", "gdy", "kiedy", "gdzie", "jak", "dlaczego", "dlatego", "ponieważ", "jednak", "lecz", "ale",
]
LEGAL_WORDS = [
    "ustawa", "rozporządzenie", "artykuł", "paragraf", "ustęp", "punkt", "konstytucja", "kodeks", "prawo", "minister", "rząd", "parlament", "sejm", "senat", "prezydent", "sąd", "trybunał", "prokuratura",
]
TERM_PATTERNS = {
    "act_reference": (r"\bustawa\s+z\s+dnia\s+[\p{L}\p{N}_\s]+", 2.5), "article": (r"\bart\.\s*\d+[a-z]?", 2.0), "paragraph": (r"§\s*\d+", 1.8), "section": (r"\bust\.\s*\d+", 1.5),
    "definition": (r"oznacza|rozumie się|należy przez to rozumieć", 2.2), "amendment": (r"zmienia się|uchyla się|dodaje się|skreśla się", 2.0),
    "legal_entity": (r"minister|rząd|parlament|sejm|senat|prezydent", 1.3), "legal_procedure": (r"procedura|postępowanie|proces|tryb", 1.4),
}
SECTION_WEIGHTS = {"title": 2.0, "article": 1.5, "definition": 1.8, "amendment": 1.3, "content": 1.0}


class Encoder(Protocol):
    """What a text encoder has to offer; one object is made for each task."""

    dimension: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEncoder:
    """Signed hashing of words to a fixed number of places: the same text gives the same vector everywhere, without a model."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[row, h % self.dimension] += 1.0 if h >> 63 else -1.0
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0)


def _encode(make, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for b in batches:
            texts = [t or "" for t in b.column("__text").to_pylist()]
            v = encoder.encode(texts)
            off = np.arange(0, v.size + 1, encoder.dimension, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.ListArray.from_arrays(off, v.ravel())], [*keep, "vector"])

    return run


def encode(df: DataFrame, text: str, *keep: str, make=HashEncoder) -> DataFrame:
    """The columns ``keep`` and ``vector``; long texts are one text, null and empty ones give a zero vector."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(_encode(make, list(keep)), f"{fields}, vector array<double>")


def mean_vector(df: DataFrame, key: str, vector: str = "vector", weight: Column | None = None) -> DataFrame:
    """Weighted mean of the vectors of each key, scaled to length one; sums are taken by place, before and after the shuffle."""
    w = weight if weight is not None else F.lit(1.0)
    d = df.select(key, F.posexplode(vector).alias("i", "x"), w.alias("w")).groupBy(key, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    d = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a"))
    v = F.transform("a", lambda s: s["x"])
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return d.select(key, F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)).alias("vector"))


def sections(df: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """``key, kind, text, weight``: title, up to five articles, three definitions, two amendments and the whole text."""
    c = F.col(content)
    many = lambda p, n, width, kind: F.transform(F.slice(F.regexp_extract_all(c, F.lit(p), F.lit(0)), 1, n), lambda x: F.struct(F.lit(kind).alias("kind"), F.substring(x, 1, width).alias("text")))
    one = lambda x, kind: F.array(F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    parts = F.concat(
        one(F.col(title), "title"), many(r"Art\. \d+[a-z]?\.[^\n]*", 5, 10_000, "article"), many(r"(?iU)[^.\n]*należy przez to rozumieć[^.\n]*", 3, 200, "definition"),
        many(r"(?iU)[^.\n]*(?:uchyla się|dodaje się)[^.\n]*", 2, 150, "amendment"), one(c, "content"),
    )
    weight = F.lit(None).cast("double")
    for k, w in SECTION_WEIGHTS.items():
        weight = F.when(F.col("kind") == k, F.lit(w)).otherwise(weight)
    return df.select(key, F.explode(parts).alias("s")).select(key, "s.*").where("text <> ''").withColumn("weight", weight)


def bag_tokens(column: Column | str) -> Column:
    """Words of two letters or more without stop words (legal terms stay) and without short numbers."""
    stop, legal = F.array(*[F.lit(w) for w in STOP_WORDS]), F.array(*[F.lit(w) for w in LEGAL_WORDS])
    ok = lambda w: (F.length(w) >= 2) & (~F.array_contains(stop, w) | F.array_contains(legal, w)) & ~(w.rlike(r"^\d+$") & (F.length(w) < 4))
    return F.filter(T.letter_words(column), ok)


def token_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, n, weight``: frequency times rarity in the text times legal weight, adding up to one for each text.

    A token weighs more for each pattern of which it stands in a match, if it is a legal term, and if it is long.
    """
    low = F.lower(text)
    found = [F.array_join(F.regexp_extract_all(low, F.lit(p), F.lit(0)), "\n").alias(f"p_{k}") for k, (p, _) in TERM_PATTERNS.items()]
    d = df.select(key, bag_tokens(text).alias("tokens"), *found).select(key, F.explode("tokens").alias("token"), *[f"p_{k}" for k in TERM_PATTERNS])
    legal = F.when(F.col("token").isin(*LEGAL_WORDS), 1.5).otherwise(1.0) * F.when(F.length("token") > 6, 1.2).otherwise(1.0)
    for k, (_, weight) in TERM_PATTERNS.items():
        legal = legal * F.when(F.contains(F.col(f"p_{k}"), F.col("token")), weight).otherwise(1.0)
    d = d.select(key, "token", legal.alias("legal")).groupBy(key, "token").agg(F.count("*").alias("n"), F.max("legal").alias("legal"))
    w = Window.partitionBy(key)
    d = d.withColumn("raw", F.col("n") / F.sum("n").over(w) * F.log(1 + 1 / (1 + F.col("n"))) * F.col("legal"))
    return d.select(key, "token", "n", (F.col("raw") / F.sum("raw").over(w)).alias("weight"))


def bag_coverage(text: Column | str) -> Column:
    """Share of the signs of a text that are in its weighted tokens."""
    t = T.col(text)
    kept = F.aggregate(bag_tokens(t), F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.length(t) > 0, F.least(F.lit(1.0), kept / F.length(t))).otherwise(0.0)


def token_importance(weights: DataFrame, key: str, top: int = 10, bottom: int = 5) -> DataFrame:
    """The heaviest and the lightest tokens of each text."""
    a = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "token")
    b = Window.partitionBy(key).orderBy(F.round("weight", 9), "token")
    d = weights.withColumn("r", F.row_number().over(a)).withColumn("q", F.row_number().over(b))
    return d.where((F.col("r") <= top) | (F.col("q") <= bottom)).select(key, "token", "weight", F.when(F.col("r") <= top, "top").otherwise("bottom").alias("end"))


#: Numbers of the token vectors that are held at a time; bounds the memory of a task, not what is summed.
PORTION = 1 << 22


def _portions(offsets: np.ndarray, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Stretches ``(row, start, end)`` of lists, in order, together up to ``most`` values at a time; longer lists are divided."""
    out, size = [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if out and size + b - a > most:
            yield out
            out, size = [], 0
        for start in range(a, b, most):
            end = min(b, start + most)
            if out and size + end - start > most:
                yield out
                out, size = [], 0
            out.append((row, start, end))
            size += end - start
    if out:
        yield out


def _bags(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        most = max(1, PORTION // encoder.dimension)
        for b in batches:
            bags = b.column("bag")
            offsets, values = bags.offsets.to_numpy(), bags.values
            tokens, weights = values.field("token"), values.field("weight").to_numpy(zero_copy_only=False)
            out = np.zeros((b.num_rows, encoder.dimension))
            for portion in _portions(offsets, most):
                first, last = portion[0][1], portion[-1][2]
                words = tokens.slice(first, last - first).dictionary_encode()
                at, known = words.indices.to_numpy(), encoder.encode(words.dictionary.to_pylist())
                for row, start, end in portion:
                    out[row] += weights[start:end] @ known[at[start - first : end - first]]
            n = np.sqrt((out * out).sum(axis=1, keepdims=True))
            np.divide(out, n, out=out, where=n > 0)
            off = np.arange(0, out.size + 1, encoder.dimension, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, out.ravel())], [b.schema.names[0], "vector"])

    return run


def bag_vectors(df: DataFrame, key: str, text: str, make=HashEncoder) -> DataFrame:
    """Weighted sum of token vectors, scaled to length one. The tokens of a text are brought together with their weights, and
    each distinct token of a portion of texts is encoded once; no vector of a token is moved."""
    bags = token_weights(df, key, text).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("bag"))  # of one text
    kind = dict(bags.dtypes)[key]
    return bags.select(key, "bag").mapInArrow(_bags(make), f"`{key}` {kind}, vector array<double>")
