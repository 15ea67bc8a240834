"""Problem 5: near copies with small edits, insertions or moved passages.

A text is the set of its runs of consecutive words, kept as a sorted array of 64-bit hashes and as a bitmap of hashed bits.
Texts with the same set are one class. Classes meet in tiles: a tile holds classes of one size band that share a minimum of
their set under one of several random orders, or of two neighbouring bands. Inside a tile the bit counts of the bitmaps bound
the overlap of two sets from above, so that most pairs are dismissed by one matrix product of bits; the pairs that remain are
decided by the exact intersection of their sorted arrays, and only their arrays are ever moved.

Bands: sizes a and b with min / max below the threshold cannot reach it, so a class joins the band of its size and, as the
larger side, the band below. Minima: a pair of similarity s shares one of ``orders`` minima of ``rows`` orders with probability
1 - (1 - s ** rows) ** orders, for s = 0.7 and the defaults 0.9998. A tile with more than ``BLOCK`` classes is worked off as
pairs of blocks in separate tasks.

Defined results: a text with fewer words than a run holds has an empty set and no pair; null fields count as empty; repeated
rows count once; ids compare as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import newest, table
from ..session import cut

BITS = 1024
BLOCK = 2048
SPACES = str.maketrans("\t\r\n", "   ")
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hash of each word, remembered while the vocabulary of a task stays moderate."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str, width: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; words end at runs of space, tab, CR and LF."""
    w = [x for x in text.lower().translate(SPACES).split(" ") if x]
    if len(w) < width:
        return np.empty(0, np.uint64)
    h = words(w)
    n = len(h) - width + 1
    x = np.zeros(n, np.uint64)
    for k in range(width):
        x = (x ^ h[k : k + n]) * M1 + M2
    return np.unique(_mix(x))


def minima(s: np.ndarray, salts: np.ndarray, orders: int, rows: int) -> np.ndarray:
    """One key for each order: the mixed minima of ``rows`` random orders of the set."""
    m = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        m = np.minimum(m, (s[k : k + 4096, None] * salts[None, :]).min(axis=0))
    m = m.reshape(orders, rows)
    h = m[:, 0]
    for j in range(1, rows):
        h = _mix(h * M1 + m[:, j])
    return h >> np.uint64(1)


def _features(width: int, orders: int, rows: int):
    """One row with the set, its digest and its minima for each text."""
    salts = _mix(np.arange(1, orders * rows + 1, dtype=np.uint64) * M3) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            n, sets, keys, low = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, width, words)
                n.append(len(s))
                sets.append((s >> np.uint64(32)).astype(np.uint32).tobytes())
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                low.append(minima(s, salts, orders, rows).astype(np.int64) if len(s) else np.empty(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            cols = [b.column("id"), b.column("ord"), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(at, np.concatenate(low))], ["id", "ord", "n", "key", "hashes", "minima"])

    return run


def bitmaps(hashes: list[bytes]) -> np.ndarray:
    """Bits (0 or 1) of each set."""
    bits = np.zeros((len(hashes), BITS), np.uint8)
    for i, h in enumerate(hashes):
        bits[i, np.frombuffer(h, np.uint32) & np.uint32(BITS - 1)] = 1
    return bits


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = np.packbits(bitmaps(b.column("hashes").to_pylist()), axis=1)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array([x.tobytes() for x in packed], pa.binary())], ["key", "n", "bits"])


def tile_pairs(n: np.ndarray, bits: np.ndarray, upper: np.ndarray, block: np.ndarray, ti: int, tj: int, least: float) -> list[tuple[int, int]]:
    """Positions of the pairs of a tile (of blocks ``ti`` and ``tj``) whose bit counts allow the threshold."""
    ones = bits.sum(axis=1)
    at_a, at_b = np.flatnonzero(block == ti), np.flatnonzero(block == tj)
    out: list[tuple[int, int]] = []
    for s in range(0, len(at_a), BLOCK):
        a = at_a[s : s + BLOCK]
        shared = bits[a] @ bits[at_b].T
        # of n hashes at most n - (ones - shared) lie in both sets: every bit that is not shared holds one that does not
        most = np.minimum((n - ones)[a][:, None] + shared, (n - ones)[at_b][None, :] + shared)
        ok = most * (1 + least) + 1e-3 >= (n[a][:, None] + n[at_b][None, :]) * least
        ok &= (upper[a][:, None] + upper[at_b][None, :] < 2) & (at_a[s : s + BLOCK, None] != at_b[None, :])
        x, y = np.nonzero(ok)
        out += zip(a[x].tolist(), at_b[y].tolist())
    return out


def _tile_runs(least: float):
    """Works off tiles that arrive as runs of equal (o, m, band, ti, tj) in a sorted partition."""
    tile = ["o", "m", "band", "ti", "tj"]

    def pairs(t: pa.Table) -> pa.RecordBatch:
        k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in tile])
        cuts = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
        keys = t.column("key").to_pylist()
        n, upper, block = t.column("n").to_numpy().astype(np.float32), t.column("upper").to_numpy(), t.column("block").to_numpy()
        packed = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(keys), -1)
        out: set[tuple[bytes, bytes]] = set()
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if j - i > 1:
                bits = np.unpackbits(packed[i:j], axis=1).astype(np.float32)
                for x, y in tile_pairs(n[i:j], bits, upper[i:j], block[i:j], int(k[3, i]), int(k[4, i]), least):
                    x, y = keys[i + x], keys[i + y]
                    if x != y:
                        out.add((x, y) if x < y else (y, x))
        found = sorted(out)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.binary()), pa.array([p[1] for p in found], pa.binary())], ["ka", "kb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in tile])
            # all but the last run of the batch are complete; that one goes on with the next batch
            change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
            if kept:
                last = np.array([kept[-1].column(c)[kept[-1].num_rows - 1].as_py() for c in tile])
                if (last != k[:, 0]).any():
                    yield pairs(pa.Table.from_batches(kept))
                    kept = []
            if len(change):
                at = int(change[-1]) + 1
                yield pairs(pa.Table.from_batches([*kept, b.slice(0, at)]))
                kept = [b.slice(at)]
            else:
                kept.append(b)
        if kept:
            yield pairs(pa.Table.from_batches(kept))

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                c = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(c / (len(x) + len(y) - c))
            keep = pa.array([s >= least for s in sims], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("ka"), b.column("kb"), pa.array(sims, pa.float64())], ["ka", "kb", "sim"]).filter(keep)

    return run


def class_pairs(texts: DataFrame, width: int, least: float, orders: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``id, key`` of every text (the key of an empty set is null), and ``ka, kb, sim`` of the pairs of different classes.

    ``texts``: ``id string, ord, text string``; of several rows of an ``id`` the one with the greatest ``ord`` counts.
    """
    kind = dict(texts.dtypes)["ord"]
    made = texts.mapInArrow(_features(width, orders, rows), f"id string, ord {kind}, n int, key binary, hashes binary, minima array<bigint>")
    made = cut(made)
    ids = newest(made, "id", "ord", "n", "key").select("id", F.when(F.col("n") > 0, F.col("key")).alias("key"))
    live = ids.where("key is not null").select("key").distinct()
    # one row for each class; equal rows meet map-side already, so a class of any size moves once for each task
    classes = made.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("minima").alias("minima")).join(live, "key", "left_semi")
    narrow = classes.select("key", "n", F.posexplode("minima").alias("o", "m"))
    # bands of the ratio 1 / least: the partner of a class is in its band or in one beside it
    band = F.floor(F.log("n") / F.lit(float(np.log(1 / least))) + 1e-9).cast("int")
    places = F.explode(F.array(F.struct(band.alias("band"), F.lit(0).alias("upper")), F.struct((band - 1).alias("band"), F.lit(1).alias("upper"))))
    shared = narrow.groupBy("o", "m").count().where("count > 1").select("o", "m")
    placed = narrow.join(shared, ["o", "m"]).select("key", "o", "m", places.alias("p")).select("key", "o", "m", "p.*")
    placed = cut(placed)
    sizes = placed.groupBy("o", "m", "band").agg(F.count("*").alias("c"), F.min("upper").alias("lowest"))
    sizes = sizes.where("c > 1 and lowest = 0").select("o", "m", "band", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, ["o", "m", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    wanted = placed.select("key").distinct()
    sets = made.where("n > 0").select("key", "n", "hashes").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    sets = cut(sets)
    packed = sets.mapInArrow(_pack, "key binary, n int, bits binary")
    tiles = placed.join(packed, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("o", "m", "band", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "upper", "key", "n", "bits")
    tile = ["o", "m", "band", "ti", "tj"]
    found = tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_tile_runs(least), "ka binary, kb binary").distinct()
    left, right = sets.select(F.col("key").alias("ka"), F.col("hashes").alias("ha")), sets.select(F.col("key").alias("kb"), F.col("hashes").alias("hb"))
    pairs = found.join(left, "ka").join(right, "kb").select("ka", "kb", "ha", "hb")
    return ids, pairs.mapInArrow(_verify(least), "ka binary, kb binary, sim double")


def texts_of(legal: DataFrame) -> DataFrame:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    return legal.select("id", F.col("updated_at").alias("ord"), text.alias("text"))


#: Up to so many members a class of equal sets is written out pair by pair; a larger one as its members with the first of them.
EXPAND = 64


def similar_ids(texts: DataFrame, width: int = 3, least: float = 0.7, orders: int = 20, rows: int = 3) -> DataFrame:
    """``id_a, id_b``: the pairs of ids of similar sets, those of one class (the same set) included.

    A class of more than ``EXPAND`` members stands in the pairs with other classes for all of them by its smallest id, and its
    members are paired with that id, so that no group of copies is expanded quadratically and no link is lost.
    """
    ids, pairs = class_pairs(texts, width, least, orders, rows)
    ids = ids.where("key is not null")
    sizes = ids.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    ids = cut(ids.join(sizes, "key"))
    spread = ids.where((F.col("c") <= EXPAND) | (F.col("id") == F.col("rep"))).select("key", "id", "c")
    a, b = spread.select(F.col("key").alias("ka"), F.col("id").alias("x")), spread.select(F.col("key").alias("kb"), F.col("id").alias("y"))
    across = pairs.select("ka", "kb").join(a, "ka").join(b, "kb").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    few = spread.where(F.col("c").between(2, EXPAND))
    within = few.select("key", F.col("id").alias("id_a")).join(few.select("key", F.col("id").alias("id_b")), "key").where("id_a < id_b").select("id_a", "id_b")
    star = ids.where((F.col("c") > EXPAND) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    return across.unionByName(within).unionByName(star)


def groups(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, class_id, group_id, links``: the class of equal sets, the group of linked classes, and the links of the class.

    Groups are the connected components of the classes: labels are taken from the smallest neighbour and doubled along the chain
    of labels until none changes, some log2 of the longest chain of rounds. A text with an empty set is a class and a group of its own.
    """
    names = ids.where("key is not null").groupBy("key").agg(F.min("id").alias("class_id"))
    edges = pairs.join(names.select(F.col("key").alias("ka"), F.col("class_id").alias("a")), "ka").join(names.select(F.col("key").alias("kb"), F.col("class_id").alias("b")), "kb")
    edges = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(edges.groupBy("a").agg(F.count("*").alias("links"), F.least("a", F.min("b")).alias("g")))
    while True:
        far = edges.join(label.select(F.col("a").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("h"))
        jump = label.select(F.col("a").alias("g"), F.col("g").alias("j"))
        after = label.join(far, "a").join(jump, "g").select("a", "links", F.least("g", "h", "j").alias("g2"), (F.least("g", "h", "j") < F.col("g")).alias("moved"))
        after = cut(after, fresh=True)
        label = after.select("a", "links", F.col("g2").alias("g"))
        if after.where("moved").isEmpty():
            break
    out = ids.join(names, "key", "left").withColumn("class_id", F.coalesce("class_id", "id")).join(label.withColumnRenamed("a", "class_id"), "class_id", "left")
    return out.select("id", "class_id", F.coalesce("g", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_ids(texts_of(table(spark, sf_dir, "legal_documents")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at five words and 0.8, one row for each document."""
    ids, pairs = class_pairs(texts_of(table(spark, sf_dir, "legal_documents")), 5, 0.8, 20, 4)
    return groups(cut(ids), pairs)


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
ORACLES: dict[str, str] = {}
