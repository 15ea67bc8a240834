"""Problem 3: splitting oversized texts at natural boundaries, with an overlap between consecutive pieces.

Every place where a piece may end is a boundary: the end of a paragraph, of a sentence, of a word, and, inside runs of signs or
of blanks longer than a quarter of the limit, every sign. Each boundary is joined to its successor: the farthest paragraph end a
piece that starts ``overlap`` before it can reach, if that fills half the limit, else the farthest such sentence end, else the
farthest word end, else the limit itself. Squaring the successor table (pointer doubling) then yields all greedy cuts of all
texts of a batch at once: after k squarings every text has its first 2**k cuts.

Defined results: null, empty and short texts give no piece; ``max_chars`` null or below 1 is no limit; an overlap of the limit
or more leaves nothing to advance by and counts as one sign less than the limit; a text of one long run is cut at the limit.
Rows of ``document_embeddings`` hold no text, so of these only the sizes are compared (``oversized_chunks``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import newest, table
from .sentences import sentence_starts

KINDS = ("sign", "word", "sentence", "paragraph", "end")
BLANK_LINE = re.compile(r"\s*\n[^\S\n]*\n\s*")
BLANKS = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
PIECES = "array<struct<start_pos:int,end_pos:int,cut:string>>"


def _without_blanks(text: str, at: int) -> int:
    """``at``, moved back over the white space before it."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def boundaries(text: str, limit: int, overlap: int = 0) -> list[np.ndarray]:
    """Positions at which a piece may end, by level: sign, word, sentence, paragraph."""
    n = len(text)
    paragraph = np.array([m.start() for m in BLANK_LINE.finditer(text) if m.start()], np.int64)
    ends = [_without_blanks(text, s) for s in sentence_starts(text)[1:]]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(codes, BLANKS)
    word = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # runs of signs or of blanks that may not fit are cut anywhere
    edges = np.concatenate([[0], np.flatnonzero(blank[1:] != blank[:-1]) + 1, [n]])
    fits = min(limit // 4, (limit - overlap) // 2)
    runs = [np.arange(edges[k] + 1, edges[k + 1] + 1) for k in np.flatnonzero(np.diff(edges) > fits)]
    sign = np.concatenate(runs) if runs else np.empty(0, np.int64)
    return [sign[sign < n], word, np.array(ends, np.int64), paragraph]


def successors(levels: list[np.ndarray], n: int, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries (0 first, ``n`` last), the index of each one's successor, and the level of each successor."""
    nodes = np.unique(np.concatenate([[0], *levels, [n]]).astype(np.int64))
    start = np.maximum(nodes - overlap, 0)
    reach = start + limit
    out, kind = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes), np.int8)
    for level in (3, 2, 1, 0):
        ends = levels[level]
        if not len(ends):
            continue
        at = np.searchsorted(ends, reach, side="right") - 1
        to = np.where(at >= 0, ends[np.maximum(at, 0)], -1)
        least = np.maximum(nodes, start + limit // 2) if level else nodes
        take = (out < 0) & (to > least)
        out[take], kind[take] = to[take], level
    # no boundary of any kind within reach, as in a few words of just the wrong lengths: the next one on that is still within it
    none = out < 0
    out[none] = nodes[np.searchsorted(nodes, reach[none], side="right") - 1]
    last = n <= reach
    out[last], kind[last] = n, 4
    return nodes, np.searchsorted(nodes, out), kind


def split_batch(texts: list[str], limits: list[int], overlaps: list[int]) -> list[list[dict]]:
    """The pieces of each text; one successor table holds all boundaries of the batch.

    A text leaves the table of cuts as soon as it has all of its own, so that a long text does not widen the rows of short ones.
    """
    nodes, nxt, kinds, roots, ends, laps = [], [], [], [], [], []
    at = 0
    for text, limit, overlap in zip(texts, limits, overlaps):
        overlap = max(0, min(overlap, limit - 1))
        x, s, k = successors(boundaries(text, limit, overlap), len(text), limit, overlap)
        nodes.append(x)
        nxt.append(s + at)
        kinds.append(k)
        roots.append(at)
        at += len(x)
        ends.append(at - 1)
        laps.append(overlap)
    if not nodes:
        return []
    pos, jump, kind = np.concatenate(nodes), np.concatenate(nxt), np.concatenate(kinds)
    step, last = jump, np.array(ends)
    open_, cuts = np.arange(len(nodes)), np.array(roots)[:, None]
    paths: list[np.ndarray | None] = [None] * len(nodes)
    while len(open_):
        done = cuts[:, -1] == last[open_]
        for i, row in zip(open_[done].tolist(), cuts[done]):
            paths[i] = row[: int(np.argmax(row == row[-1])) + 1]
        open_, cuts = open_[~done], cuts[~done]
        cuts = np.concatenate([cuts, step[cuts]], axis=1)
        step = step[step]
    out = []
    for path, overlap in zip(paths, laps):
        starts = np.maximum(pos[path[:-1]] - overlap, 0)
        starts[:1] = 0
        out.append([{"start_pos": int(a), "end_pos": int(b), "cut": KINDS[int(c)]} for a, b, c in zip(starts, pos[path[1:]], kind[path[:-1]])])
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("cut", pa.string())]))
    for b in batches:
        texts = b.column("__text").to_pylist()
        long = [i for i, t in enumerate(texts) if t is not None]
        limits, overlaps = b.column("__limit").to_pylist(), b.column("__overlap").to_pylist()
        out: list[list[dict]] = [[] for _ in texts]
        for i, pieces in zip(long, split_batch([texts[i] for i in long], [limits[i] for i in long], [overlaps[i] or 0 for i in long])):
            out[i] = pieces
        keep = [n for n in b.schema.names if not n.startswith("__")]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(out, kind)], [*keep, "pieces"])


def with_limits(df: DataFrame, limits: DataFrame, type_column: str) -> DataFrame:
    """``df`` with ``__limit`` and ``__overlap`` of its type; ``*`` holds for null and unlisted types.

    ``limits`` is the fixed table of types: it is grouped to one row for a type and read on the driver; of several rows of a
    type the first by size counts.
    """
    one = limits.groupBy(F.lower(F.trim("document_type")).alias("t")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("x"))
    known = {r.t: r.x for r in one.collect() if r.t is not None}
    rest = known.pop("*", None)

    def of(field: str) -> Column:
        given = F.lit(rest[field] if rest is not None else None).cast("int")
        if not known:
            return given
        listed = F.create_map(*[x for t, r in known.items() for x in (F.lit(t), F.lit(r[field]).cast("int"))])
        kind = F.coalesce(F.lower(F.trim(type_column)), F.lit(""))
        return F.when(kind.isin(list(known)), F.try_element_at(listed, kind)).otherwise(given)

    return df.withColumns({"__limit": of("max_chars"), "__overlap": of("overlap_chars")})


def split_documents(legal: DataFrame, limits: DataFrame) -> DataFrame:
    """``id, pieces`` of every current document; ``pieces`` is empty where the content is within its limit."""
    d = with_limits(legal.select("id", "updated_at", "document_type", "content"), limits, "document_type")
    over = (F.col("__limit") > 0) & (F.length("content") > F.col("__limit"))
    d = d.select("id", "updated_at", F.when(over, F.col("content")).alias("__text"), "__limit", "__overlap")
    out = d.mapInArrow(_split, f"id string, updated_at {dict(legal.dtypes)['updated_at']}, pieces {PIECES}")
    return newest(out, "id", "updated_at", "pieces")


def oversized_chunks(embeddings: DataFrame) -> DataFrame:
    """``id, token_count, chunk_size, pieces``: embedding rows whose tokens are above their chunk size, and the chunks they need."""
    over = embeddings.where("chunk_size > 0 and token_count > chunk_size").select("id", "token_count", "chunk_size").distinct()
    return over.withColumn("pieces", F.expr("cast(ceil(token_count / chunk_size) as int)"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = split_documents(table(spark, sf_dir, "legal_documents"), table(spark, sf_dir, "split_limits")).where(F.size("pieces") > 0)
    rows = oversized_chunks(table(spark, sf_dir, "document_embeddings")).select("id").distinct()
    return docs.select(F.lit("legal_documents").alias("tbl"), "id").unionByName(rows.select(F.lit("document_embeddings").alias("tbl"), "id"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = split_documents(table(spark, sf_dir, "legal_documents"), table(spark, sf_dir, "split_limits"))
    return docs.select("id", F.posexplode("pieces").alias("piece", "x")).select("id", "piece", "x.*")


def p3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_chunks(table(spark, sf_dir, "document_embeddings"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_chunks": p3_chunks}
ORACLES = {
    "p3_found": """
        WITH cur AS (SELECT id, document_type, content FROM (
            SELECT id, document_type, content, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM legal_documents) x WHERE rn = 1)
        SELECT 'legal_documents' AS tbl, c.id AS id FROM cur c
        LEFT JOIN split_limits l ON l.document_type = lower(trim(c.document_type)) AND l.document_type <> '*'
        CROSS JOIN (SELECT max_chars AS rest FROM split_limits WHERE document_type = '*') r
        WHERE length(c.content) > coalesce(l.max_chars, r.rest)
        UNION ALL
        SELECT DISTINCT 'document_embeddings' AS tbl, id FROM document_embeddings WHERE chunk_size > 0 AND token_count > chunk_size""",
    "p3_chunks": """
        SELECT DISTINCT id, token_count, chunk_size, CAST(ceil(token_count / CAST(chunk_size AS DOUBLE)) AS INTEGER) AS pieces
        FROM document_embeddings WHERE chunk_size > 0 AND token_count > chunk_size""",
}
