"""Problem 8: a mix of sources whose token shares meet target shares.

The size of the mix is the greatest at which every source with records can give its share within its repeats, unless a size is
given. Within a source each record is due a number of uses in proportion to its weight (a text stored c times weighs 1 / c),
at most ``max_repeats``; the whole part of it is certain, the rest is its inclusion probability in a Pareto sample: records are
ranked by the odds of a hashed uniform number over the odds of their inclusion, and taken in that order until the tokens that
are due are reached. The rank is found without sorting a source in one task: odds fall into fixed bins, whose summed tokens
tell the bin of the boundary, and only that bin is sorted.

Defined results: null sources, unlisted sources and texts without tokens take no part; sources compare trimmed and in lower
case; a listed source without records gets a row with share 0, and its target is divided among the others in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table
from ..session import cut
from .tokens import with_tokens

BINS = 4096


def _due(sums: list[tuple[int, int]], need: float, cap: int) -> float:
    """The factor f with sum(min(cap, f / c) * tokens) = need over (c, tokens)."""
    low, high = 0.0, float(cap) * max(c for c, _ in sums)
    for _ in range(100):
        f = (low + high) / 2
        if sum(min(cap, f / c) * t for c, t in sums) < need:
            low = f
        else:
            high = f
    return high


#: Numbers of copies are exact below this; above they keep this many leading steps, so that their number stays bounded.
STEPS = 1000


def with_copies(d: DataFrame) -> DataFrame:
    """``d`` with ``c``, the number of rows of its ``digest``.

    Digests of more than a thousandth of all rows (a thousand of them at most) are broadcast, so that no text stored very often
    is one task of the join; texts stored once need no join partner at all.
    """
    equal = cut(d.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
    most = d.count() // 1000
    often, few = F.broadcast(equal.where(F.col("n") > most)), equal.where(F.col("n") <= most)
    rest = d.join(often, "digest", "left_anti").join(few, "digest", "left")
    out = rest.unionByName(d.join(often, "digest"))
    n = F.coalesce("n", F.lit(1))
    scale = F.pow(F.lit(10.0), F.floor(F.log10(n / STEPS)))
    return out.withColumn("c", F.when(n < STEPS, n).otherwise((F.floor(n / scale) * scale)).cast("bigint")).drop("n")


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """``doc_id, source, tokens, copies``: the records of the mix. ``sized``: ``doc_id, source, tokens, digest``.

    ``targets`` is the fixed table of sources; its rows are read on the driver, and so are the token sums for each source and
    number of equal texts, a table of listed sources times at most some ten thousand numbers of repeats (see ``STEPS``).
    """
    spark = sized.sparkSession
    rows = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").collect()
    want = {r.source: (r.target_share or 0.0, max(0, r.max_repeats or 0)) for r in rows if r.source}
    names = spark.createDataFrame([(s,) for s in want] or [("",)], "source string")
    d = sized.withColumn("source", F.lower(F.trim("source"))).where("tokens > 0").join(F.broadcast(names), "source", "left_semi")
    d = cut(d.select("doc_id", "source", "tokens", "digest"))  # texts are read and measured once
    d = cut(with_copies(d).select("doc_id", "source", "tokens", "c"))
    sums: dict[str, list[tuple[int, int]]] = {}
    for r in d.groupBy("source", "c").agg(F.sum("tokens").alias("t")).collect():
        sums.setdefault(r.source, []).append((r.c, r.t))
    able = {s: want[s] for s in sums if want[s][0] > 0 and want[s][1] > 0}
    whole = sum(share for share, _ in able.values())
    if not able:
        return d.select("doc_id", "source", "tokens", F.lit(0).alias("copies")).where("false")
    most = min(cap * sum(t for _, t in sums[s]) / (share / whole) for s, (share, cap) in able.items())
    size = most if total is None else min(total, most)
    plan = [(s, _due(sums[s], size * share / whole, cap), cap) for s, (share, cap) in able.items()]
    plans = F.broadcast(spark.createDataFrame(plan, "source string, factor double, cap int"))
    d = d.join(plans, "source").withColumn("due", F.least(F.col("cap").cast("double"), F.col("factor") / F.col("c")))
    d = d.withColumn("sure", F.floor(F.col("due") + 1e-9).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("due") - F.col("sure")))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    d = cut(d.withColumn("q", F.when(F.col("p") > 1e-9, odds)).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int")))
    bins = d.where("q is not null").groupBy("source", "bin").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("p")).alias("e"))
    w = Window.partitionBy("source")
    bins = bins.withColumn("need", F.sum("e").over(w)).withColumn("upto", F.sum("t").over(w.orderBy("bin")))
    edge = bins.where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("t") <= F.col("need"))).select("source", F.col("bin").alias("edge"), (F.col("need") - F.col("upto") + F.col("t")).alias("rest"))
    d = d.join(F.broadcast(edge), "source", "left")  # one row for each listed source
    below = d.withColumn("more", (F.col("q").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")))).cast("int")).where("bin is null or edge is null or bin <> edge")
    at = d.where("bin = edge").withColumn("cum", F.sum("tokens").over(Window.partitionBy("source").orderBy("q", "doc_id")))
    at = at.withColumn("more", (F.col("cum") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    cols = ["doc_id", "source", "tokens", (F.col("sure") + F.col("more")).alias("copies")]
    return below.select(*cols).unionByName(at.select(*cols)).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, records, tokens, actual_share, most_used`` of each listed source."""
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share")
    by = mixed.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_used"))
    out = t.join(by, "source", "left").fillna(0, ["records", "tokens", "most_used"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # of one row for each listed source
    return out.withColumn("actual_share", F.round(F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.md5("text").alias("digest"))
    return with_tokens(d, "text", "doc_id", "source", "digest")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "source_targets")
    return shares(mix(_sized(spark, sf_dir), targets), targets)


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
