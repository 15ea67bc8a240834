"""Problem 2: the most similar vectors of every vector, as a block matrix join.

Every usable vector is scaled to length one and put into the ``copies`` nearest of a number of cells, whose pivots are a bounded sample
of the distinct vectors, nearly equal ones left out. A cell of more than ``SPLIT`` vectors is divided again around pivots of its own, each of its vectors going to the two nearest, and so on, so that the cells grow in number and not in size. Inside a cell, blocks of vectors are quantised to int8 and multiplied tile by tile; the integer products give
similarities with a proven quantisation error, so that a pair is left out only if its upper bound is below the threshold.
Surviving pairs are recomputed in float, and the best k of each vector of a tile are merged with those of its other tiles. The work for a vector is that of
its cells and does not grow with the collection but by a factor of two for each level of cells (one up to some 10^6 vectors, two to 10^9, three to 10^12); a cell with more rows than
a block is worked off as pairs of blocks in separate tasks, so that none is cut short. Two similar vectors meet if they share
one of their cells: of the pairs of similarity 0.9 of the largest test table 0.9997 do with one level and 0.9999 with two (see the README).

Exact copies of a vector are collapsed before the join and expanded afterwards: of a group of any size each member gets its k
first other members by id, so no work or result is quadratic in the size of a group.

Defined results: vectors that are null, of another length, all zero or with a non-finite value are ignored; a repeated id counts
once; ties are broken by the smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import newest, table
from ..session import cut

BLOCK = 4096
#: The float rounding of a product of two unit vectors of a few hundred values.
ROUNDING = 1e-5
#: Similarities from which two pivots would build the same cell; the later ones are for cells whose vectors are all alike.
NEARLY_EQUAL = (0.99, 0.999, 0.9999, 0.999999)
#: Pivots of one level, vectors that a cell is made for, and the number from which a cell is divided again.
FAN, TARGET, SPLIT = 1024, 800, 32_768
LEVELS = 6
#: Rows with the same cell that one task gets when the cell is divided.
PORTION = 50_000
#: Digests a task remembers to drop copies early; those it forgot are dropped later.
REMEMBER = 1_000_000


def _usable(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows whose vector has the right length and only finite values, not all zero."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dimension)
    x = column.take(pa.array(at)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return at[np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)]


def _unit(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of very long and very short vectors finite
    return raw, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(u: np.ndarray, pivots: np.ndarray, copies: int) -> np.ndarray:
    """Indexes of the ``copies`` nearest pivots of each row."""
    c = min(copies, len(pivots))
    return np.concatenate([np.argpartition(-(u[i : i + 8192] @ pivots.T), c - 1, axis=1)[:, :c] for i in range(0, len(u), 8192)])


def _encode(pivots: np.ndarray, copies: int, dimension: int):
    """A digest of group and vector for each row, and the cells of the first row with it in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            b = b.take(pa.array(_usable(b.column("vec"), dimension)))
            if not b.num_rows:
                continue
            raw, u = _unit(b.column("vec"), dimension)
            cells = nearest(u.astype(np.float32), pivots, copies)
            vec = [r.tobytes() for r in raw + np.float32(0)]  # -0.0 becomes 0.0
            keys = [hashlib.blake2b(r, digest_size=12, key=g.encode()[:64]).digest() for r, g in zip(vec, b.column("grp").to_pylist())]
            new = []
            if len(seen) > REMEMBER:
                seen.clear()
            for k in keys:
                new.append(k not in seen)
                seen.add(k)
            lists = [x if y else None for x, y in zip(cells.tolist(), new)]
            vec = [x if y else None for x, y in zip(vec, new)]
            yield pa.RecordBatch.from_arrays(
                [b.column("grp"), b.column("id"), pa.array(keys, pa.binary()), pa.array(vec, pa.binary()), pa.array(lists, pa.list_(pa.int32()))],
                ["grp", "id", "key", "vec", "cells"],
            )

    return run


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the scale of each and the length of what the code leaves out."""
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-7


def best_of_tile(u: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, similarity): the pairs of two blocks of rows that can be among the ``k`` best of the row."""
    q, scale, err = quantise(u)
    code = q.astype(np.float32)  # integer products of int8 codes are exact in float32: 127 * 127 * dimension stays below 2 ** 24
    xs, ys = [], []
    for s in range(0, len(at_a), BLOCK):
        a = at_a[s : s + BLOCK]
        sim = code[a] @ code[at_b].T
        sim *= scale[a].astype(np.float32)[:, None]
        sim *= scale[at_b].astype(np.float32)[None, :]
        # |<x,y> - <x',y'>| <= |x - x'| |y| + |x'| |y - y'|
        worst = (err[a][:, None] + (1 + err[a])[:, None] * err[at_b].max(initial=0.0) + ROUNDING).astype(np.float32)
        x, y = np.nonzero(sim + worst >= least)
        xs.append(a[x])
        ys.append(at_b[y])
    x, y = np.concatenate(xs), np.concatenate(ys)
    x, y = x[x != y], y[x != y]
    exact = np.concatenate([np.einsum("ij,ij->i", u[x[i : i + 65536]], u[y[i : i + 65536]]) for i in range(0, len(x), 65536)] or [np.empty(0)])
    x, y, exact = x[exact >= least], y[exact >= least], exact[exact >= least]
    if not np.array_equal(at_a, at_b):
        x, y, exact = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([exact, exact])
    order = np.lexsort((y, -exact, x))
    x, y, exact = x[order], y[order], exact[order]
    rank = np.arange(len(x)) - np.searchsorted(x, x)
    return x[rank < k], y[rank < k], exact[rank < k]


def _tiles(k: int, least: float, dimension: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        ti, tj = key[1].as_py(), key[2].as_py()
        keys = t.column("key").to_numpy()
        _, first = np.unique(keys, return_index=True)  # copies met by several tasks
        keys = keys[first]
        block = t.column("block").to_numpy()[first]
        raw = np.frombuffer(b"".join(t.column("vec").take(pa.array(first)).to_pylist()), np.float32).reshape(-1, dimension).astype(np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        u = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
        x, y, sim = best_of_tile(u, np.flatnonzero(block == ti), np.flatnonzero(block == tj), k, least)
        return pa.table({"a": pa.array(keys[x].tolist(), pa.binary()), "b": pa.array(keys[y].tolist(), pa.binary()), "sim": pa.array(sim, pa.float64())})

    return run


def _smallest(n: int, dimension: int):
    """The ``n`` distinct vectors of a task with the smallest digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, bytes] = {}
        bound = b"\xff" * 12
        for b in batches:
            column = b.column("vec").take(pa.array(_usable(b.column("vec"), dimension)))
            if not len(column):
                continue
            for r in _unit(column, dimension)[0] + np.float32(0):  # -0.0 becomes 0.0
                vec = r.tobytes()
                key = hashlib.blake2b(vec, digest_size=12).digest()
                if key <= bound:
                    kept[key] = vec
            if len(kept) > n:
                kept = {k: kept[k] for k in sorted(kept)[:n]}
                bound = next(reversed(kept))
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.binary())], ["key", "vec"])

    return run


def apart(u: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the unit vectors ``u`` that are not nearly equal to one taken before.

    Where that leaves less than half of those wanted, vectors closer to each other are taken too.
    """
    best = u[:0]
    for bar in NEARLY_EQUAL:
        taken = np.empty((most, u.shape[1]), u.dtype)
        n = 0
        for x in u:
            if n == most:
                break
            if not n or (taken[:n] @ x).max() < bar:
                taken[n] = x
                n += 1
        if n > len(best):
            best = taken[:n]
        if 2 * n >= most:
            break
    return best


def choose_pivots(vectors: DataFrame, cells: int, dimension: int) -> np.ndarray:
    """Unit vectors around which cells are built, from a bounded sample (four for a cell) of the distinct usable vectors.

    A vector enters the sample once, however many rows hold it: equal pivots would tie, and which of them a vector goes to would be chance.
    """
    n = 4 * cells
    sample = vectors.where(F.size("vec") == dimension).select("vec").mapInArrow(_smallest(n, dimension), "key binary, vec binary")
    got = sample.distinct().orderBy("key").limit(n).select("vec").toArrow().column("vec").to_pylist()
    if not got:
        return np.empty((0, dimension), np.float32)
    column = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(b"".join(got), np.float32)), dimension)
    return apart(_unit(column, dimension)[1].astype(np.float32), cells)


def cell_count(rows: int, fan: int = FAN) -> int:
    """Cells of the first level: about ``TARGET`` vectors for each, ``fan`` at most."""
    return max(8, min(fan, rows // TARGET))


def _unit_of(packed: list[bytes], dimension: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.float32).reshape(-1, dimension).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def divide(placed: DataFrame, size: int, fan: int, dimension: int, copies: int = 2) -> DataFrame:
    """``cell, key, vec`` with every cell of more than ``size`` rows divided around pivots of its own, level by level.

    The pivots of a cell are drawn from its distinct vectors by their digests (four for each), chosen in one task for each cell
    and sent only to the portions of that cell. A cell with fewer than four pivots (its vectors are equal but for rounding), or one
    still large after ``LEVELS``, stays as it is and is worked off as pairs of blocks.
    """
    done: list[DataFrame] = []
    for level in range(LEVELS + 1):
        sizes = placed.groupBy("cell").count().where(F.col("count") > size)
        sizes = cut(sizes.select("cell", F.greatest(F.lit(8), F.least(F.lit(fan), F.ceil(F.col("count") / (TARGET * 4)))).cast("int").alias("m"), F.ceil(F.col("count") / PORTION).cast("int").alias("parts"), "count"), fresh=True)
        if level == LEVELS or sizes.isEmpty():
            return reduce(DataFrame.unionByName, [*done, placed])
        done.append(cut(placed.join(sizes.select("cell"), "cell", "left_anti"), fresh=True))
        large = placed.join(sizes, "cell")
        bits = 1 << 40
        sample = large.where(F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(bits)) < F.lit(bits) * 4 * F.col("m") / F.col("count")).dropDuplicates(["cell", "key"])

        def choose(key: tuple, t: pa.Table) -> pa.Table:
            order = np.argsort(t.column("key").to_numpy(zero_copy_only=False))
            u = _unit_of(t.column("vec").take(pa.array(order)).to_pylist(), dimension)
            got = apart(u, t.column("m")[0].as_py())
            n = len(got) >= 4
            return pa.table({"cell": pa.array([key[0].as_py()] * n, pa.int64()), "pivots": pa.array([got.tobytes()] * n, pa.binary()), "parts": pa.array([t.column("parts")[0].as_py()] * n, pa.int32())})

        pivots = cut(sample.select("cell", "key", "vec", "m", "parts").groupBy("cell").applyInArrow(choose, "cell bigint, pivots binary, parts int"), fresh=True)
        able = pivots.select("cell")
        done.append(large.join(able, "cell", "left_anti").select("cell", "key", "vec"))
        rows = large.join(able, "cell", "left_semi").select("cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "vec")
        sent = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivots")

        def assign(key: tuple, t: pa.Table, p: pa.Table) -> pa.Table:
            own = np.frombuffer(p.column("pivots")[0].as_py(), np.float32).reshape(-1, dimension) if p.num_rows and t.num_rows else None
            if own is None:
                return pa.table({"cell": pa.array([], pa.int64()), "key": pa.array([], pa.binary()), "vec": pa.array([], pa.binary())})
            near = nearest(_unit_of(t.column("vec").to_pylist(), dimension), own, copies)
            at = pa.array(np.repeat(np.arange(t.num_rows), near.shape[1]))
            named = np.full(near.size, key[0].as_py(), np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + near.ravel().astype(np.uint64) + np.uint64(1)
            return pa.table({"cell": pa.array(named.view(np.int64)), "key": t.column("key").take(at), "vec": t.column("vec").take(at)})

        placed = cut(rows.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(assign, "cell bigint, key binary, vec binary").dropDuplicates(["cell", "key"]), fresh=True)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9, copies: int = 4, dimension: int = 64, fan: int = FAN, split: int = SPLIT) -> DataFrame:
    """``id_a, id_b``: pairs of one ``grp`` with a similarity of at least ``least``, one among the ``k`` best of the other.

    ``vectors``: ``grp string, id string, vec array<float>``, an id may be repeated with the same vector.
    """
    spark = vectors.sparkSession
    pivots = choose_pivots(vectors, cell_count(vectors.count(), fan), dimension)
    if not len(pivots):
        return spark.createDataFrame([], "id_a string, id_b string")
    coded = vectors.mapInArrow(_encode(pivots, copies, dimension), "grp string, id string, key binary, vec binary, cells array<int>").persist()
    place = F.xxhash64("grp", "cell")  # vectors of different groups never meet
    placed = coded.where("cells is not null").select("grp", "key", "vec", F.explode("cells").alias("cell")).select(place.alias("cell"), "key", "vec")
    placed = divide(placed, split, fan, dimension)
    sizes = cut(placed.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    if sizes.count() <= 100_000:  # only cells of several blocks, two numbers each; more are joined
        sizes = F.broadcast(sizes)
    placed = placed.join(sizes, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = placed.select("cell", "key", "vec", "block", other).withColumn("ti", F.least("block", "other")).withColumn("tj", F.greatest("block", "other"))
    near = tiles.drop("other").groupBy("cell", "ti", "tj").applyInArrow(_tiles(k, least, dimension), "a binary, b binary, sim double").distinct()
    best = near.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rn") <= k).drop("rn")
    # from vectors to ids: the first k + 1 ids of each vector; the limit is applied before the shuffle too, so a hot group stays small
    ids = coded.select("key", "id")
    firsts = ids.withColumn("rk", F.dense_rank().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rk") <= k + 1).distinct()
    firsts = cut(firsts.withColumn("n", F.count("*").over(Window.partitionBy("key"))))
    of_b = firsts.where(F.col("rk") <= k).select(F.col("key").alias("b"), F.col("id").alias("y"))
    reach = best.join(of_b, "b").withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "y"))).where(F.col("rn") <= k)
    of_a = firsts.where(F.col("n") <= k).select(F.col("key").alias("a"), F.col("id").alias("x"), "n")
    across = reach.join(of_a, "a").where(F.col("rn") <= k + 1 - F.col("n")).select("x", "y")
    many = firsts.where("n > 1")
    own = many.select("key", F.col("id").alias("y"), "rk").join(many.groupBy("key").agg(F.max("id").alias("last")), "key")
    within = ids.select("key", F.col("id").alias("x")).join(own, "key").where((F.col("x") != F.col("y")) & ((F.col("rk") <= k) | (F.col("x") <= F.col("last"))))
    out = across.unionByName(within.select("x", "y"))
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = newest(table(spark, sf_dir, "legal_documents").select("id", "updated_at", "embedding"), "id", "updated_at", "embedding")
    legal = legal.select(F.lit("").alias("grp"), "id", F.col("embedding").alias("vec"))
    model = F.concat_ws("|", F.coalesce("model_name", F.lit("\0")), F.coalesce("model_version", F.lit("\0")))
    rows = table(spark, sf_dir, "document_embeddings").select(model.alias("grp"), "id", F.col("embedding").alias("vec"))
    a = similar_pairs(legal).select(F.lit("legal_documents").alias("tbl"), "id_a", "id_b")
    return a.unionByName(similar_pairs(rows).select(F.lit("document_embeddings").alias("tbl"), "id_a", "id_b")).distinct()


def p2_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, values, usable, ids``: how many ids of each table have a vector of how many values, and whether it is usable."""
    legal = newest(table(spark, sf_dir, "legal_documents").select("id", "updated_at", "embedding"), "id", "updated_at", "embedding")
    rows = table(spark, sf_dir, "document_embeddings").select("id", "embedding").distinct()
    both = legal.select(F.lit("legal_documents").alias("tbl"), "id", "embedding").unionByName(rows.select(F.lit("document_embeddings").alias("tbl"), "id", "embedding"))
    n = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return both.select("tbl", n.alias("values"), F.coalesce((n == 64) & finite, F.lit(False)).alias("usable")).groupBy("tbl", "values", "usable").agg(F.count("*").alias("ids"))


QUERIES = {"p2_found": p2_found, "p2_usable": p2_usable}
ORACLES: dict[str, str] = {
    "p2_usable": """
        WITH cur AS (SELECT id, embedding FROM (
            SELECT id, embedding, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM legal_documents) x WHERE rn = 1),
        b AS (SELECT 'legal_documents' AS tbl, id, embedding FROM cur UNION ALL
              SELECT 'document_embeddings', id, any_value(embedding) FROM document_embeddings GROUP BY id)
        SELECT tbl, CAST(len(embedding) AS INTEGER) AS values, coalesce(len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable,
            count(*) AS ids FROM b GROUP BY ALL""",
}
