"""Problem 7: filling containers of fixed capacity with texts.

A text above the capacity is cut into whole containers and a rest; everything else stays in one piece. Items are dealt to
blocks by a hash, so that each block has the sizes of the whole, and every block is packed by bin completion: around the
largest item left, the undominated fillings are enumerated (no swap of an item in it for a larger one left out fits), the best
first; a branch is left when its waste exceeds what the best solution so far allows. Best-fit decreasing is the first
solution. The containers of all blocks that are not well filled are emptied and packed once more in fewer blocks.

Defined results: a null text has no size and is not packed; an empty text takes no room; a capacity below 1 holds nothing and
gives no row; repeated texts are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..session import cut
from .tokens import with_tokens

BLOCK = 4000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; containers as lists of positions in ``sizes`` (sorted, largest first)."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i, s in enumerate(sizes):
        k = bisect_left(room, (s, -1))
        if k == len(room):
            bins.append([i])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            r, b = room.pop(k)
            bins[b].append(i)
            insort(room, (r - s, b))
    return bins


def fillings(values: list[int], count: dict[int, int], room: int, width: int = 3, nodes: int = 400) -> list[tuple[int, list[int]]]:
    """Up to ``width`` undominated fillings of ``room``, least waste first, as (waste, sizes). ``values`` is sorted, smallest first."""
    found: list[tuple[int, list[int]]] = []
    visited = 0
    sums = [0]
    for v in values:
        sums.append(sums[-1] + v * count[v])

    def undominated(chosen: list[int], waste: int) -> bool:
        if not waste:
            return True
        used: dict[int, int] = {}
        for c in chosen:
            used[c] = used.get(c, 0) + 1
        for c in used:  # a size left out that is larger by at most the waste would fit in its place
            k = bisect_right(values, c)
            while k < len(values) and values[k] - c <= waste:
                if count[values[k]] > used.get(values[k], 0):
                    return False
                k += 1
        k = bisect_right(values, waste)
        return all(count[v] <= used.get(v, 0) for v in values[max(0, k - 3) : k])  # nor does another item fit beside it

    def search(k: int, left: int, chosen: list[int], taken: int) -> bool:
        """Tries sizes ``values[:k]``; True once a filling without waste is known."""
        nonlocal visited
        visited += 1
        k = min(k, bisect_right(values, left))
        best = found[0][0] if found else left + 1
        if left - sums[k] >= best and found:
            return False
        if k == 0:
            if (not found or left < found[-1][0] or len(found) < width) and undominated(chosen, left):
                insort(found, (left, list(chosen)))
                del found[width:]
            return left == 0
        if visited > nodes and found:
            return True
        v = values[k - 1]
        most = min(count[v], left // v)
        for n in range(most, -1, -1):
            if search(k - 1, left - n * v, chosen + [v] * n, taken + n):
                return True
            if visited > nodes and found:
                return True
        return False

    # an exact fit by one or two items needs no search
    if room in count and count[room]:
        return [(0, [room])]
    k = bisect_right(values, room)
    search_from = values[max(0, k - 48) : k]
    if len(search_from) < k:  # of many sizes the largest and the smallest are enough to close gaps
        small = values[: min(24, k - 48)]
        keep, values = values, small + search_from
        sums = [0]
        for v in values:
            sums.append(sums[-1] + v * count[v])
        search(len(values), room, [], 0)
        values = keep
    else:
        search(k, room, [], 0)
    return found or [(room, [])]


def complete(sizes: list[int], capacity: int, budget: int = 400, width: int = 3, nodes: int = 400) -> list[list[int]]:
    """Bin completion of items of ``sizes`` (each at most ``capacity``); containers as lists of positions.

    The search ends when the least possible number of containers is reached, all branches are tried, or after ``budget``
    backtracks with the best found so far; ``width`` and ``nodes`` bound the fillings tried of one container.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ranked = [sizes[i] for i in order]
    first = best_fit(ranked, capacity)
    total, least = sum(ranked), -(-sum(ranked) // capacity)
    best = [[ranked[i] for i in b] for b in first]
    count: dict[int, int] = {}
    for s in ranked:
        if s:
            count[s] = count.get(s, 0) + 1
    values = sorted(count)
    if len(best) > least and values:
        spent = 0
        bins: list[list[int]] = []
        stack: list[tuple[list[int], list[tuple[int, list[int]]]]] = []
        waste = 0

        def take(items: list[int]) -> None:
            for s in items:
                count[s] -= 1
                if not count[s]:
                    values.pop(bisect_left(values, s))

        def give(items: list[int]) -> None:
            for s in items:
                if not count[s]:
                    insort(values, s)
                count[s] += 1

        forward = True
        while True:
            if forward:
                if not values:
                    if len(bins) < len(best):
                        best = [list(b) for b in bins]
                    if len(best) == least:
                        break
                    forward = False
                    continue
                top = values[-1]
                take([top])
                options = fillings(values, count, capacity - top, width, nodes)
                stack.append(([top], options[1:]))
                w, items = options[0]
            else:
                if not stack or spent >= budget:
                    break
                spent += 1
                head, options = stack.pop()
                old = bins.pop()
                give(old[1:])
                waste -= capacity - sum(old)
                if not options:
                    give(head)
                    continue
                w, items = options[0]
                stack.append((head, options[1:]))
                forward = True
            take(items)
            bins.append([*stack[-1][0], *items])
            waste += capacity - sum(bins[-1])
            if waste > (len(best) - 1) * capacity - total:  # even without further waste no better than the best
                forward = False
    places: dict[int, list[int]] = {}
    for i in order:
        places.setdefault(sizes[i], []).append(i)
    out = [[places[s].pop() for s in b if s] for b in best]
    rest = places.get(0, [])
    if rest:
        if out:
            out[-1] += rest
        else:
            out = [rest]
    return [b for b in out if b]


def _pack(budget: int, width: int, nodes: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        capacity = key[1].as_py()
        sizes = t.column("tokens").to_pylist()
        where, fill = [0] * len(sizes), [0] * len(sizes)
        bins = complete(sizes, capacity, budget, width, nodes)
        if "old" in t.schema.names:  # emptied containers: what they held stays together unless fewer are needed now
            old: dict[str, list[int]] = {}
            for i, o in enumerate(t.column("old").to_pylist()):
                old.setdefault(o, []).append(i)
            if len(old) <= len(bins):
                bins = list(old.values())
        for k, b in enumerate(bins):
            full = sum(sizes[i] for i in b)
            for i in b:
                where[i], fill[i] = k, full
        out = {c: t.column(c) for c in ("doc_id", "part", "tokens")}
        n = len(sizes)
        return pa.table({"capacity_name": pa.array([key[0].as_py()] * n), "capacity_tokens": pa.array([capacity] * n, pa.int64()), "block": pa.array([key[2].as_py()] * n, pa.int32()), **out, "bin": pa.array(where, pa.int32()), "fill": pa.array(fill, pa.int64())})

    return run


def pack(sized: DataFrame, capacities: DataFrame, good: float = 0.985, budget: int = 400, width: int = 3, nodes: int = 400) -> DataFrame:
    """``capacity_name, container, doc_id, part, tokens, fill``: every item in one container of each capacity.

    ``sized``: ``doc_id, tokens``. ``capacities`` is the fixed table of capacities. ``container`` is unique in its capacity.
    ``budget``, ``width`` and ``nodes`` bound the search in a block (see ``complete``): more of each costs time and saves
    containers where sizes leave gaps; no item is ever left out.
    """
    kind = dict(sized.dtypes)["doc_id"]
    sized = cut(sized.where("tokens is not null"))
    blocks = max(1, -(-sized.count() // BLOCK))
    caps = [(r.capacity_name, r.capacity_tokens) for r in capacities.where("capacity_tokens > 0").select("capacity_name", "capacity_tokens").distinct().collect()]  # the fixed table
    if not caps:
        return sized.selectExpr("'' as capacity_name", "'' as container", "doc_id", "0 as part", "tokens", "tokens as fill").where("false")
    each = F.array(*[F.struct(F.lit(n).alias("capacity_name"), F.lit(t).cast("bigint").alias("capacity_tokens")) for n, t in caps])
    items = sized.select("doc_id", "tokens", F.explode(each).alias("c")).select("doc_id", "tokens", "c.*")
    parts = F.expr("transform(sequence(0, cast(greatest(ceil(tokens / capacity_tokens), 1) - 1 as int)), p -> named_struct('part', p, 'tokens', least(capacity_tokens, tokens - p * capacity_tokens)))")
    items = items.select("capacity_name", "capacity_tokens", "doc_id", F.explode(parts).alias("p")).select("capacity_name", "capacity_tokens", "doc_id", "p.part", F.col("p.tokens").cast("bigint").alias("tokens"))
    whole = items.where("tokens = capacity_tokens").select("capacity_name", F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("container"), "doc_id", "part", "tokens", F.col("tokens").alias("fill"))
    loose = items.where("tokens < capacity_tokens").withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks)).cast("int"))
    schema = f"capacity_name string, capacity_tokens bigint, block int, doc_id {kind}, part int, tokens bigint, bin int, fill bigint"
    keys, search = ["capacity_name", "capacity_tokens", "block"], _pack(budget, width, nodes)
    packed = cut(loose.select(*keys, "doc_id", "part", "tokens").groupBy(*keys).applyInArrow(search, schema))
    kept = packed.where(F.col("fill") >= good * F.col("capacity_tokens"))
    again = packed.where(F.col("fill") < good * F.col("capacity_tokens"))
    share = max(1, blocks // 16)
    again = again.withColumn("old", F.concat_ws("-", "block", "bin")).withColumn("block", F.pmod(F.xxhash64("block"), F.lit(share)).cast("int"))
    again = again.select(*keys, "doc_id", "part", "tokens", "old")
    again = again.groupBy(*keys).applyInArrow(search, schema)
    name = lambda r: F.concat_ws("-", F.lit(r), "block", "bin").alias("container")
    cols = ["doc_id", "part", "tokens", "fill"]
    return whole.unionByName(kept.select("capacity_name", name("a"), *cols)).unionByName(again.select("capacity_name", name("b"), *cols))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_tokens(table(spark, sf_dir, "documents"), "text", "doc_id")
    return pack(sized, table(spark, sf_dir, "pack_capacities"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, share of room used and the least number of containers possible, for each capacity."""
    packed = p7_packed(spark, sf_dir)
    caps = table(spark, sf_dir, "pack_capacities").select("capacity_name", "capacity_tokens")
    bins = packed.groupBy("capacity_name", "container").agg(F.sum("tokens").alias("tokens")).groupBy("capacity_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    out = bins.join(F.broadcast(caps), "capacity_name")
    return out.select("capacity_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}
