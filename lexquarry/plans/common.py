"""What the named queries share: current rows in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import newest, table

#: The moment at which time-dependent queries are asked; no query reads the clock.
AS_OF = "2025-01-01 00:00:00"

CUR = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn_ FROM legal_documents) x_ WHERE rn_ = 1)"""


class Current:
    """The current row of each legal document, told after the work on its texts.

    Columns are computed and conditions evaluated over all stored states, map-side; only what is selected is then shuffled to
    find the state with the greatest ``updated_at``, so that texts move only where a query selects them.
    """

    def __init__(self, df: DataFrame, conditions: tuple = (), wanted: tuple = ()):
        self.df, self.conditions, self.wanted = df, conditions, wanted

    def withColumn(self, name: str, column: Column) -> Current:
        return self._with(self.df.withColumn(name, column), self.conditions)

    def where(self, condition: Column | str) -> Current:
        return self._with(self.df, (*self.conditions, F.expr(condition) if isinstance(condition, str) else condition))

    def _with(self, df: DataFrame, conditions: tuple) -> Current:
        return Current(df, conditions, self.wanted)

    def select(self, *columns: Column | str) -> DataFrame:
        if any("explode" in str(c) or "stack(" in str(c) for c in columns if not isinstance(c, str)):
            return self.all().select(*columns)  # many rows of one state
        flags = [f"cur__where{i}" for i in range(len(self.conditions))]
        made = self.df.select(F.col("id").alias("cur__id"), F.col("updated_at").alias("cur__at"), *[F.coalesce(c, F.lit(False)).alias(f) for f, c in zip(flags, self.conditions)], *columns)
        names = [n for n in made.columns if not n.startswith("cur__")]
        out = newest(made, "cur__id", "cur__at", *flags, *[n for n in names if n != "id"])
        for f in flags:
            out = out.where(f)
        return out.select(*[F.col("cur__id").alias("id") if n == "id" else F.col(n) for n in names])

    def all(self) -> DataFrame:
        return self.select(*[c for c in self.df.columns if c != "updated_at" or c in self.wanted])

    def __getitem__(self, name: str) -> Column:
        return F.col(name)

    def __getattr__(self, name: str):
        """Anything else is done on the current rows with all their columns."""
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.all(), name)


def current(spark: SparkSession, sf_dir: str, *columns: str) -> Current:
    """The current row of each legal document."""
    return Current(table(spark, sf_dir, "legal_documents").select("id", "updated_at", *[c for c in columns if c not in ("id", "updated_at")]), wanted=columns)


def once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Rows of a table without exact repeats."""
    return table(spark, sf_dir, name).select(*columns).distinct()
