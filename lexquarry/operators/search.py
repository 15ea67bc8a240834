"""Vector search: top-k, range, similar-to-row, batch, clusters, a cell index; and the ranking of what is found."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut

#: Vectors of a tile of a batch search: of the queries and of the rows searched.
QUERY_BLOCK, ROW_BLOCK = 2048, 8192


def top_k(df: DataFrame, query: Sequence[float], k: int, *, metric: str = "cosine", vector: str = "embedding", key: str = "id", where: Column | None = None, least: float | None = None, most: float | None = None, farthest: float | None = None) -> DataFrame:
    """The ``k`` nearest rows by ``metric`` with ``distance`` and ``similarity``; bounds on similarity or distance are optional.

    One map-side pass; the sort keeps k rows for each task. Null vectors never match; ties go to the smaller key.
    """
    d = df.where(F.col(vector).isNotNull())
    if where is not None:
        d = d.where(where)
    d = d.withColumn("distance", V.distance(vector, list(query), metric)).withColumn("similarity", V.score(F.col("distance"), metric))
    if least is not None:
        d = d.where(F.col("similarity") >= least)
    if most is not None:
        d = d.where(F.col("distance") <= most)
    if farthest is not None:
        d = d.where(F.col("distance") >= farthest)
    return d.orderBy(F.asc("distance"), key).limit(k)


def in_range(df: DataFrame, query: Sequence[float], low: float, high: float, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """All rows whose distance lies in [low, high]."""
    d = df.where(F.col(vector).isNotNull()).withColumn("distance", V.distance(vector, list(query), metric))
    return d.where(F.col("distance").between(low, high))


def vector_of(df: DataFrame, key: str, value, vector: str = "embedding") -> list[float] | None:
    """Point lookup of one row's vector; None if there is none."""
    row = df.where((F.col(key) == F.lit(value)) & F.col(vector).isNotNull()).select(vector).limit(1).collect()
    return [float(x) for x in row[0][0]] if row else None


def similar_to(df: DataFrame, value, k: int, *, key: str = "id", metric: str = "cosine", vector: str = "embedding", itself: bool = False) -> DataFrame:
    """The ``k`` rows nearest to the row ``value``, without itself unless wanted; no rows if it has no vector."""
    q = vector_of(df, key, value, vector)
    if q is None:
        return df.withColumn("distance", F.lit(None).cast("double")).withColumn("similarity", F.lit(None).cast("double")).where("false")
    return top_k(df, q, k, metric=metric, vector=vector, key=key, where=None if itself else F.col(key) != F.lit(value))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of length one; a vector of zeros stays so."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) if len(c) else np.zeros((0, 1))
    length = np.sqrt((m * m).sum(axis=1))
    return np.divide(m, length[:, None], out=np.zeros_like(m), where=length[:, None] > 0)


def _tiles(queries: DataFrame, df: DataFrame, key: str, vector: str) -> DataFrame:
    """``qi, di, asked, k, v``: the query vectors and the vectors of ``df`` in every pair of a block of queries and a block of rows.

    Blocks hold some ``QUERY_BLOCK`` queries and ``ROW_BLOCK`` rows; no vector passes the driver, and of a few queries none is
    copied but to the blocks of rows.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), V.as_vector(vector).alias("v"))
    data = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), V.as_vector(vector).alias("v"))
    nq, nd = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-data.count() // ROW_BLOCK))
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "k"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.select(own(nq, 1).alias("qi"), every(nd).alias("di"), F.lit(True).alias("asked"), "k", "v")
    b = data.select(every(nq).alias("qi"), own(nd, 2).alias("di"), F.lit(False).alias("asked"), "k", "v")
    return a.unionByName(b)


def _sides(t: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    asked = t.column("asked").to_numpy(zero_copy_only=False).astype(bool)
    q, d = t.take(pa.array(np.flatnonzero(asked))), t.take(pa.array(np.flatnonzero(~asked)))
    return q.column("k").combine_chunks(), _unit(q.column("v")), d.column("k").combine_chunks(), _unit(d.column("v"))


def _tile_best(k: int, itself: bool, kind: str):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, q, keys, d = _sides(t)
        n = len(keys)
        if not len(ids) or not n:
            return pa.table({"query": ids[:0], "key": ids[:0], "similarity": pa.array([], pa.float64())})
        sim = np.clip(q @ d.T, -1, 1)
        keep = min(n, k + (not itself))  # one more for the query itself
        top = np.argpartition(-sim, keep - 1, axis=1)[:, :keep] if keep < n else np.tile(np.arange(n), (len(ids), 1))
        # all that are equal to the last of the best stay, so that ties can be broken by key afterwards
        bar = np.take_along_axis(sim, top, axis=1).min(axis=1) - 1e-9
        i, j = np.nonzero(sim >= bar[:, None])
        return pa.table({"query": ids.take(pa.array(i)), "key": keys.take(pa.array(j)), "similarity": pa.array(sim[i, j])})

    return run


def batch_top_k(queries: DataFrame, df: DataFrame, k: int, *, key: str, vector: str = "embedding", itself: bool = False) -> DataFrame:
    """``query, key, similarity, rank``: the ``k`` most similar rows of ``df`` for each row of ``queries``, by block products.

    Every tile keeps its best for each query; these are merged by a window over the query.
    """
    kind = dict(df.dtypes)[key]
    found = _tiles(queries, df, key, vector).groupBy("qi", "di").applyInArrow(_tile_best(k, itself, kind), f"query {kind}, key {kind}, similarity double")
    if not itself:
        found = found.where("query <> key")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tile_sums(itself: bool):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, q, keys, d = _sides(t)
        if not len(ids) or not len(keys):
            return pa.table({"query": ids[:0], "n": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("total", "squares", "low", "high")}})
        sim = np.clip(q @ d.T, -1, 1)
        out = np.zeros_like(sim, bool) if itself else np.asarray(ids.to_numpy(zero_copy_only=False))[:, None] == np.asarray(keys.to_numpy(zero_copy_only=False))[None, :]
        n = (~out).sum(axis=1)
        some = np.flatnonzero(n)
        sim, out, n = sim[some], out[some], n[some]
        sums = {"total": np.where(out, 0, sim).sum(axis=1), "squares": np.where(out, 0, sim * sim).sum(axis=1), "low": np.where(out, 2, sim).min(axis=1), "high": np.where(out, -2, sim).max(axis=1)}
        return pa.table({"query": ids.take(pa.array(some)), "n": pa.array(n.astype(np.int64)), **{c: pa.array(x) for c, x in sums.items()}})

    return run


def similarity_statistics(queries: DataFrame, df: DataFrame, *, key: str, vector: str = "embedding", itself: bool = False) -> DataFrame:
    """``query, n, mean, std, low, high`` over the similarities of each query with all rows; summed inside the tiles, no pair is written."""
    kind = dict(df.dtypes)[key]
    sums = _tiles(queries, df, key, vector).groupBy("qi", "di").applyInArrow(_tile_sums(itself), f"query {kind}, n bigint, total double, squares double, low double, high double")
    out = sums.groupBy("query").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.select("query", "n", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - F.col("mean") * F.col("mean"))).alias("std"), "low", "high")


def leader_clusters(df: DataFrame, threshold: float, *, key: str, vector: str = "embedding", block: int = 2048) -> DataFrame:
    """``key, leader``: rows in key order; a row not yet taken leads and takes all later rows of at least that similarity.

    Worked off in blocks of rows by key: a block is compared with the leaders found so far, then within itself. The leaders
    so far go to all tasks; a block without leaders ends in one pass over the rest.
    """
    kind = dict(df.dtypes)[key]
    rest = cut(df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), V.as_vector(vector).alias("v")))
    done: list[DataFrame] = []
    while True:
        head = rest.orderBy("k").limit(block).toArrow()
        if not head.num_rows:
            break
        ids = head.column("k").to_numpy()
        m = head.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        length = np.sqrt((m * m).sum(axis=1))
        u = np.divide(m, length[:, None], out=np.zeros_like(m), where=length[:, None] > 0)
        sim, free, leaders = u @ u.T, np.ones(len(ids), bool), []
        for i in range(len(ids)):
            if free[i]:
                leaders.append(i)
                free[i:] &= ~(sim[i, i:] >= threshold)
                free[i] = False
        lead_ids, lead = ids[leaders], u[leaders]

        def take(batches, lead_ids=lead_ids, lead=lead):
            for b in batches:
                if b.num_rows:
                    x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    n = np.sqrt((x * x).sum(axis=1))
                    s = np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0) @ lead.T
                    keys = b.column("k").to_numpy()
                    hit = (s >= threshold) & (lead_ids[None, :] <= keys[:, None]) | (lead_ids[None, :] == keys[:, None])
                    first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
                    out = pa.array([None if f < 0 else lead_ids[f] for f in first.tolist()], b.column("k").type)
                    yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), out], ["k", "v", "leader"])

        marked = cut(rest.mapInArrow(take, f"k {kind}, v array<double>, leader {kind}"))
        done.append(marked.where("leader is not null").select(F.col("k").alias(key), "leader"))
        rest = marked.where("leader is null").select("k", "v")
    return reduce(DataFrame.unionAll, done) if done else df.select(key, F.lit(None).cast(kind).alias("leader")).where("false")


class CellIndex:
    """Inverted cells: every row lies in the cell of its nearest centre; a query looks into its ``probes`` nearest cells.

    Centres are the k-means means of a bounded sample (``sample`` rows at most) of the vectors; every row is indexed.
    """

    def __init__(self, df: DataFrame, *, key: str, vector: str = "embedding", lists: int = 16, sample: int = 20_000, seed: int = 7):
        self.key, self.vector = key, vector
        part = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).select(vector).toArrow()
        m = part.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
        u = m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
        rng = np.random.default_rng(seed)
        centres = u[rng.choice(len(u), min(lists, len(u)), replace=False)]
        for _ in range(10):
            near = (u @ centres.T).argmax(axis=1)
            centres = np.stack([u[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
            centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1)), 1e-300)[:, None]
        self.centres = centres
        kind = dict(df.dtypes)
        self.rows = df.where(F.col(vector).isNotNull()).select(key, V.as_vector(vector).alias(vector)).mapInArrow(self._cells(1), f"{key} {kind[key]}, {vector} array<double>, cell int")

    def _cells(self, n: int):
        centres, key, vector = self.centres, self.key, self.vector

        def run(batches):
            for b in batches:
                if b.num_rows:
                    m = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :n]
                    at = np.repeat(np.arange(b.num_rows), near.shape[1])
                    yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at)), b.column(vector).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], [key, vector, "cell"])

        return run

    def search(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """``query, key, similarity, rank``: exact similarities within the probed cells."""
        kind = dict(queries.dtypes)[self.key]
        asked = queries.where(F.col(self.vector).isNotNull()).select(self.key, V.as_vector(self.vector).alias(self.vector)).mapInArrow(self._cells(probes), f"{self.key} {kind}, {self.vector} array<double>, cell int")
        asked = asked.select(F.col(self.key).alias("query"), F.col(self.vector).alias("qv"), "cell")
        near = self.rows.join(asked, "cell").where(F.col("query") != F.col(self.key)).select("query", F.col(self.key).alias("key"), V.cosine("qv", self.vector).alias("similarity"))
        w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "key")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def index_advice(n: Column, recall: Column | None = None) -> Column:
    """Kind of index and its parameters for a number of vectors."""
    lists = F.when(n < 1000, F.greatest(F.lit(1), F.floor(n / 10))).when(n < 100_000, F.greatest(F.lit(100), F.floor(n / 1000)))
    kind = F.when(n < 100_000, "ivfflat").otherwise("hnsw")
    return F.struct(kind.alias("kind"), lists.cast("int").alias("lists"), F.greatest(F.lit(1), F.floor(lists / 10)).cast("int").alias("probes"))


# ranking

# Weights of types and of fields of law.
TYPE_WEIGHTS = {"ustawa": 1.2, "kodeks": 1.3, "rozporządzenie": 1.0, "dekret": 0.9, "uchwała": 0.8}
DOMAIN_WEIGHTS = {
    "prawo konstytucyjne": 1.3, "prawo cywilne": 1.2, "prawo karne": 1.2, "prawo administracyjne": 1.1, "prawo pracy": 1.0, "prawo podatkowe": 1.0,
}


def lookup(column: Column | str, weights: dict[str, float], default: float = 1.0) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("double")
    for name, w in reversed(list(weights.items())):
        out = F.when(c == name, F.lit(w)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def age_days(published: Column | str, as_of: str) -> Column:
    """Whole days since ``published``, rounded down."""
    p = F.col(published) if isinstance(published, str) else published
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(p.cast("timestamp"))
    return F.floor(seconds / 86400)


def temporal_score(published: Column | str, as_of: str) -> Column:
    """1 for recent texts, falling to 0.1 after a year; 0.5 without a date."""
    a = age_days(published, as_of)
    return (
        F.when(a.isNull(), F.lit(0.5))
        .when(a <= 30, F.least(F.lit(1.0), 1.5 * (1 - a / 30)))
        .when(a > 365, F.lit(0.1))
        .otherwise(F.greatest(F.lit(0.1), 1 - (a - 30) / 335))
    )


def amendment_factor(amendment: Column | str, several: Column | str) -> Column:
    a, s = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)) for c in (amendment, several))
    return F.when(a & s, 1.2).when(a, 1.1).otherwise(1.0)


def rank_composite(df: DataFrame, as_of: str, *, passage: Column | None = None, custom: dict[str, float] | None = None) -> DataFrame:
    """All factors of the composite rank as columns, and their product within [0, 1] as ``composite``.

    ``custom`` multiplies the weights of type, domain and time.
    """
    c = custom or {}
    d = df.withColumn("temporal", temporal_score("published_at", as_of) * c.get("temporal", 1.0))
    d = d.withColumn("w_type", lookup("document_type", TYPE_WEIGHTS) * c.get("type", 1.0)).withColumn("w_domain", lookup("legal_domain", DOMAIN_WEIGHTS) * c.get("domain", 1.0))
    d = d.withColumn("w_amendment", amendment_factor("is_amendment", "affects_multiple_acts"))
    d = d.withColumn("w_passage", 1 + 0.3 * (passage if passage is not None else F.lit(0.0)))
    product = (F.col("similarity") * 0.8 + F.col("temporal") * 0.2) * F.col("w_type") * F.col("w_domain") * F.col("w_amendment") * F.col("w_passage")
    return d.withColumn("composite", F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)))


def rank_by(df: DataFrame, strategy: str, as_of: str) -> DataFrame:
    """Adds ``score`` by strategy: similarity, temporal, type, domain or composite."""
    s = F.col("similarity")
    if strategy == "similarity":
        return df.withColumn("score", s)
    if strategy == "temporal":
        return df.withColumn("score", s * 0.8 + temporal_score("published_at", as_of) * 0.2)
    if strategy == "type":
        return df.withColumn("score", s * lookup("document_type", TYPE_WEIGHTS))
    if strategy == "domain":
        return df.withColumn("score", s * lookup("legal_domain", DOMAIN_WEIGHTS))
    if strategy == "composite":
        return rank_composite(df, as_of).withColumn("score", F.col("composite"))
    raise ValueError(f"unknown ranking {strategy!r}")


def explain_rank(df: DataFrame) -> DataFrame:
    """The factors of a composite rank as one ``explanation`` column."""
    names = ["similarity", "temporal", "w_type", "w_domain", "w_amendment", "w_passage"]
    return df.withColumn("explanation", F.to_json(F.struct(*[F.round(n, 4).alias(n) for n in names])))


# passages


def word_set(column: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(column), r"\s+"), lambda x: x != ""))


def overlap(query: str, column: Column) -> Column:
    """Share of the words of ``query`` that occur in the text."""
    q = sorted({w for w in query.lower().split() if w})
    return F.size(F.array_intersect(F.array(*[F.lit(x) for x in q]), word_set(column))) / F.lit(max(1, len(q)))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def passages(df: DataFrame, query: str, *, key: str = "id", text: str = "content", most: int = 3, length: int = 200) -> DataFrame:
    """``key, rank, score, passage``: the sentences that share most words with the query, each with its neighbours.

    Sentences end at full stops; those under 10 characters or without a shared word are left out; of equal ones later ones come first.
    """
    d = df.select(key, F.transform(F.split(text, r"\."), stripped).alias("s"))
    d = d.select(key, "s", F.posexplode("s").alias("i", "sentence")).where(F.length("sentence") >= 10)
    d = d.withColumn("score", overlap(query, F.col("sentence"))).where("score > 0")
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("i"), F.desc("sentence"))
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    around = stripped(F.array_join(F.expr("slice(s, greatest(i, 1), 2 + cast(i > 0 as int))"), ". "))
    passage = F.when(F.length(around) > length, F.concat(F.substring(around, 1, length), F.lit("..."))).otherwise(around)
    return d.select(key, "rank", "score", passage.alias("passage"))


def passage_relevance(found: DataFrame, query: str, *, key: str = "id") -> DataFrame:
    """Mean share of the query's words over the passages of a row, at most 1."""
    return found.groupBy(key).agg(F.least(F.lit(1.0), F.avg(overlap(query, F.col("passage")))).alias("relevance"))
