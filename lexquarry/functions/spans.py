"""All matches of patterns with their places, and the resolution of overlaps.

Spark has no expression for the places of all matches, so one Arrow function yields, for each text, an array of spans
``(type, pattern, text, start, end, groups)``; everything after it is columns again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<type:string,pattern:int,text:string,start:int,end:int,groups:array<string>>"


def regex_spans(column: Column | str, patterns: Mapping[str, Sequence[str]], flags: int = re.IGNORECASE | re.MULTILINE) -> Column:
    """``array<span>`` of all matches, by type, then pattern, then place. Null text gives an empty array."""
    compiled = [(kind, i, p) for kind, ps in patterns.items() for i, p in enumerate(ps)]

    @F.pandas_udf(f"array<{SPAN}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules = [(kind, i, re.compile(p, flags)) for kind, i, p in compiled]
        for texts in batches:
            yield texts.map(
                lambda t: [] if not t else [
                    {"type": kind, "pattern": i, "text": m.group(), "start": m.start(), "end": m.end(), "groups": [g or "" for g in m.groups()]}
                    for kind, i, p in rules for m in p.finditer(t)
                ]
            )

    return find(F.col(column) if isinstance(column, str) else column)


def exploded(df: DataFrame, key: str, spans: Column) -> DataFrame:
    """``key, n`` and the fields of the span, one row each, in order of place."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    return df.select(key, F.posexplode(F.array_sort(spans, order)).alias("n", "s")).select(key, "n", "s.*")


def keep_first(spans: Column) -> Column:
    """Spans by start, longer first; one that overlaps a kept one is dropped."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    empty = F.array().cast(f"array<{SPAN}>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1))
    return F.aggregate(F.array_sort(spans, order), empty, lambda acc, s: F.when(s["start"] >= last(acc), F.concat(acc, F.array(s))).otherwise(acc))


def keep_longest(spans: Column) -> Column:
    """Spans by start; of two that overlap the longer stays, the earlier of equal ones."""
    order = lambda a, b: a["start"] - b["start"]
    empty = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        free = last.isNull() | (s["start"] >= last["end"])
        longer = (s["end"] - s["start"]) > (last["end"] - last["start"])
        return F.when(free, F.concat(acc, F.array(s))).when(longer, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s))).otherwise(acc)

    return F.aggregate(F.array_sort(spans, order), empty, add)


def around(text: Column, start: Column, end: Column, width: int = 100) -> Column:
    """The text of a span with ``width`` signs on both sides."""
    low = F.greatest(F.lit(0), start - width)
    return F.trim(F.substring(text, low + 1, F.least(F.length(text), end + width) - low))


def segments(df: DataFrame, key: str, text: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """``key, n, type, marker, number, content``: the text between each marker and the next; empty ones are left out."""
    from pyspark.sql import Window

    d = df.select(key, text, regex_spans(text, patterns, re.IGNORECASE).alias("s"))
    d = d.select(key, text, F.posexplode("s").alias("p", "s")).select(key, text, "p", "s.*")
    w = Window.partitionBy(key).orderBy("start", "p")
    d = d.withColumn("n", F.row_number().over(w)).withColumn("stop", F.coalesce(F.lead("start").over(w), F.length(text)))
    content = F.trim(F.regexp_replace(F.substring(F.col(text), F.col("end") + 1, F.greatest(F.lit(0), F.col("stop") - F.col("end"))), r"^\s+|\s+$", ""))
    return d.select(key, "n", "type", F.col("text").alias("marker") if text != "text" else "text", F.try_element_at("groups", F.lit(1)).alias("number"), content.alias("content")).where("content <> ''")
