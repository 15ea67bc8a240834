"""Outcomes predicted from similar rows and from text features; votes of several predictors; trained classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.9, "very_high").when(c >= 0.75, "high").when(c >= 0.6, "medium").when(c >= 0.4, "low").otherwise("very_low")


def boost(s: Column) -> Column:
    """What a similarity adds to confidence."""
    return F.when(s >= 0.95, 0.3).when(s >= 0.9, 0.2).when(s >= 0.85, 0.15).when(s >= 0.8, 0.1).otherwise(0.05)


def from_neighbours(neighbours: DataFrame, asked: DataFrame, key: str = "query") -> DataFrame:
    """Similarity-weighted mean of the outcomes ``y``; 0.5 with confidence 0.3 where a query has no neighbour."""
    d = neighbours.groupBy(key).agg((F.sum(F.col("similarity") * F.col("y")) / F.sum("similarity")).alias("p"), F.avg("similarity").alias("mean_s"), F.var_pop("y").alias("v"), F.count("*").alias("n"))
    d = asked.select(key).distinct().join(d, key, "left")
    c = F.greatest(F.lit(0.1), 0.8 * F.col("mean_s") - F.least(F.lit(0.3), F.col("v")))
    return d.select(key, F.coalesce("p", F.lit(0.5)).alias("prediction"), F.when(F.col("mean_s").isNull(), 0.3).otherwise(c).alias("confidence"), F.coalesce("n", F.lit(0)).alias("neighbours"))


def hybrid(a: DataFrame, b: DataFrame, key: str = "query", share: float = 0.7) -> DataFrame:
    """Two predictions mixed ``share`` to the rest."""
    x = a.select(key, F.col("prediction").alias("p1"), F.col("confidence").alias("c1"))
    y = b.select(key, F.col("prediction").alias("p2"), F.col("confidence").alias("c2"))
    mixed = lambda u, v: share * F.col(u) + (1 - share) * F.col(v)
    return x.join(y, key).select(key, mixed("p1", "p2").alias("prediction"), mixed("c1", "c2").alias("confidence"))


def temporal(neighbours: DataFrame, age: Column, least: float = 0.375) -> DataFrame:
    """Similarities of rows older than a year fade; faint ones are left out."""
    s = F.when(age > 365, F.col("similarity") * F.exp(-0.9 * age / 365)).otherwise(F.col("similarity"))
    b = boost(F.col("similarity")) * F.when(age > 365, 0.8).otherwise(1.0)
    return neighbours.withColumn("b", b).withColumn("similarity", s).where(F.col("similarity") >= least)


def text_features(column: Column | str) -> dict[str, Column]:
    """Numbers a classifier can use, by name."""
    t = T.col(column)
    n, w = F.length(t), F.greatest(T.word_count(t), F.lit(1))
    left = lambda p: F.length(F.regexp_replace(t, p, ""))
    low = F.lower(t)
    return {
        "length": n.cast("double"), "words": T.word_count(t).cast("double"), "stops": (n - left("[.!?]")).cast("double"),
        "mean_word": left(r"\s") / w, "digit_ratio": (n - left("[0-9]")) / F.greatest(n, F.lit(1)), "upper_ratio": (n - left("[A-ZĄĆĘŁŃÓŚŹŻ]")) / F.greatest(n, F.lit(1)),
        "has_articles": low.rlike(r"art\.\s*\d+").cast("double"), "has_paragraphs": low.rlike(r"§\s*\d+").cast("double"), "has_changes": low.rlike("uchyla się|dodaje się|zmienia się").cast("double"),
    }


def ordered(features: Column, names: list[str]) -> Column:
    """A map of features as an array in the order of ``names``, 0 for missing ones."""
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)) for n in names])


def soft_vote(votes: DataFrame, key: str) -> DataFrame:
    """Weighted mean of ``p`` and the agreement of the voters. ``votes``: key, model, p, weight."""
    d = votes.groupBy(key).agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("prediction"), F.greatest(F.lit(0.0), 1 - F.var_pop("p")).alias("consensus"), F.count("*").alias("n"))
    return d.withColumn("consensus", F.when(F.col("n") < 2, 1.0).otherwise(F.col("consensus")))


def hard_vote(votes: DataFrame, key: str) -> DataFrame:
    """Class (p at least 0.5) with the greatest weight; class 0 on a tie."""
    d = votes.groupBy(key, (F.col("p") >= 0.5).cast("int").alias("cls")).agg(F.sum("weight").alias("w"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("w", 9)), "cls")
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, F.col("cls").alias("prediction"), "w")


def best_voter(votes: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(F.abs(F.col("p") - 0.5)), "model")
    return votes.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "model", "p")


KERNELS = {"cosine": V.cosine, "euclidean": V.root_euclidean_similarity}


def good_enough(accuracy: Column, f1: Column, precision: Column) -> Column:
    """Whether a model is good enough to be used."""
    return (accuracy >= 0.8) & (f1 >= 0.75) & (precision >= 0.7)


def classifier(kind: str = "logistic", **params):
    """A pipeline of assembled, scaled features and a classifier: logistic, forest, boosted or linear_svc."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    made = {
        "logistic": lambda: LogisticRegression(maxIter=100, regParam=params.get("reg", 0.01), standardization=False),
        "forest": lambda: RandomForestClassifier(numTrees=params.get("trees", 100), minInstancesPerNode=2, seed=7),
        "boosted": lambda: GBTClassifier(maxIter=params.get("rounds", 100), stepSize=0.1, maxDepth=6, seed=7),
        "linear_svc": lambda: LinearSVC(maxIter=100, regParam=params.get("reg", 0.01)),
    }[kind]()
    assemble = VectorAssembler(inputCols=params["features"], outputCol="raw_features", handleInvalid="keep")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    return Pipeline(stages=[assemble, scale, made.setLabelCol(params.get("label", "label"))])


def evaluate(train: DataFrame, test: DataFrame, kind: str, features: list[str], label: str = "label") -> dict[str, float]:
    """Accuracy, precision, recall and F1 on rows the model has not seen."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    out = classifier(kind, features=features, label=label).fit(train).transform(test)
    return {m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(out) for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}


def _scored(model, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the class a model gives as ``name`` and how sure it is as ``name_p``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*df.columns, F.col("prediction").alias(name), p.alias(f"{name}_p"))


def cross_validated(df: DataFrame, kind: str, features: list[str], label: str = "label", fold: str = "fold", folds: int = 5) -> DataFrame:
    """``fold, n, accuracy``: each fold judged by a model trained on the others."""
    spark = df.sparkSession
    df = df.cache()
    out = []
    for k in range(folds):
        test = _scored(classifier(kind, features=features, label=label).fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k), "got")
        r = test.agg(F.count("*").alias("n"), F.avg((F.col("got") == F.col(label)).cast("double")).alias("a")).collect()[0]
        out.append((k, r.n, r.a))
    return spark.createDataFrame(out, "fold int, n bigint, accuracy double")


def stacked(df: DataFrame, kinds: list[str], features: list[str], label: str = "label", fold: str = "fold") -> DataFrame:
    """``model, accuracy`` on fold 0: each kind alone, their blend (mean probability) and a model stacked on them.

    The stacked model learns from what the others say about rows they have not seen: they are trained on folds 2 and above and
    speak about fold 1, which trains the upper model; fold 0 is seen by none.
    """
    base, middle, test = df.where(F.col(fold) > 1).cache(), df.where(F.col(fold) == 1), df.where(F.col(fold) == 0)
    for k in kinds:
        model = classifier(k, features=features, label=label).fit(base)
        middle, test = _scored(model, middle, k), _scored(model, test, k)
    names = [f"{k}_p" for k in kinds]
    test = _scored(classifier("logistic", features=names, label=label).fit(middle), test, "stacked")
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    right = lambda c: F.avg((c == F.col(label)).cast("double"))
    row = test.agg(*[right(F.col(k)).alias(k) for k in kinds], right((mean >= 0.5).cast("double")).alias("blend"), right(F.col("stacked")).alias("stacked")).collect()[0]
    return df.sparkSession.createDataFrame([(k, row[k]) for k in [*kinds, "blend", "stacked"]], "model string, accuracy double")


def save_model(model, path: str) -> None:
    """Writes a trained pipeline to a folder all executors share."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
