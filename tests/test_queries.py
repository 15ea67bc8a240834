"""Every core query runs; those with SQL agree with it."""

import pytest

from lexquarry import plans
from tests.oracle import connect, same

QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_bags_take_title_and_content(spark, tmp_path):
    import datetime
    import math
    import re
    from collections import Counter

    from lexquarry.operators import embedding as E
    from lexquarry.plans import model_queries as M

    docs = {"a": ("Ustawa o portach", "Organ prowadzi rejestr. Rejestr portowy 2024 i 12."), "b": ("Umowa", "Minister wydaje rozporządzenie, minister ogłasza.")}
    rows = [(i, t, c, datetime.datetime(2024, 1, 1)) for i, (t, c) in docs.items()]
    spark.createDataFrame(rows, "id string, title string, content string, updated_at timestamp_ntz").write.parquet(str(tmp_path / "legal_documents.parquet"))
    want = {}
    for i, (title, content) in docs.items():
        text = f"{title} {content}".lower()
        words = [w for w in re.findall(r"\w+", text) if len(w) >= 2 and (w not in E.STOP_WORDS or w in E.LEGAL_WORDS) and not (w.isdigit() and len(w) < 4)]
        n = Counter(words)
        near = {k: re.findall(p.replace(r"\p{L}\p{N}_", r"\w"), text) for k, (p, _) in E.TERM_PATTERNS.items()}
        factor = lambda w: math.prod(f for k, (_, f) in E.TERM_PATTERNS.items() if any(w in m for m in near[k]))  # noqa: B023, E731
        raw = {w: k / len(words) * math.log(1 + 1 / (1 + k)) * factor(w) * (1.5 if w in E.LEGAL_WORDS else 1) * (1.2 if len(w) > 6 else 1) for w, k in n.items()}
        want[i] = {w: (n[w], round(x / sum(raw.values()), 6)) for w, x in raw.items()}
    sf = str(tmp_path)
    got = {(r.id, r.token): (r.n, r.weight) for r in M.bag_weights(spark, sf).collect()}
    assert set(got) == {(i, w) for i in want for w in want[i]}
    assert all(abs(got[i, w][1] - want[i][w][1]) < 2e-6 and got[i, w][0] == want[i][w][0] for i, w in got)
    assert {r.id: (r.vocabulary, r.tokens) for r in M.bag_tokens(spark, sf).collect()} == {i: (len(x), sum(n for n, _ in x.values())) for i, x in want.items()}
    assert {(r.id, r.token) for r in M.token_importance(spark, sf).collect()} == set(got)
    assert {r.id: round(r.length, 4) for r in M.bag_vectors(spark, sf).collect()} == {"a": 1.0, "b": 1.0}
    for r in E.bag_vectors(M._whole(spark, sf), "id", "text").collect():
        v = sum(x * E.HashEncoder().encode([w])[0] for w, (_, x) in want[r.id].items())
        assert max(abs(v / math.sqrt(v @ v) - r.vector)) < 1e-4


def test_current_rows_are_told_after_the_work(spark, tmp_path):
    import datetime

    from pyspark.sql import functions as F

    from lexquarry.plans.common import current

    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("a", "old text", day(1)), ("a", "new", day(3)), ("a", "new", day(3)), ("b", None, day(2)), ("b", "gone", day(1)), ("c", "only", day(1))]
    spark.createDataFrame(rows, "id string, content string, updated_at timestamp_ntz").write.parquet(str(tmp_path / "legal_documents.parquet"))
    d = lambda: current(spark, str(tmp_path), "id", "content")
    assert sorted((r.id, r.n) for r in d().select("id", F.length("content").alias("n")).collect()) == [("a", 3), ("b", None), ("c", 4)]
    assert [r.id for r in d().where("content is not null").where(F.length("content") > 3).select("id").collect()] == ["c"]
    assert sorted(r.content for r in d().withColumn("x", F.lit(1)).where("x = 1 and content is not null").all().collect()) == ["new", "only"]
    assert sorted(r.w for r in d().select("id", F.explode(F.split("content", " ")).alias("w")).collect()) == ["new", "only"]
    assert d().count() == 3 and d().groupBy("id").count().count() == 3
    plan = d().select("id", F.length("content").alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert all("content" not in line for line in plan.splitlines() if "Exchange" in line)


def test_batches_of_several_tiles(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from lexquarry.operators import search as S

    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "ROW_BLOCK", 20)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 8))
    v[3] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None)]
    d = spark.createDataFrame(rows, "k bigint, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    s = u @ u.T
    got = S.batch_top_k(d.where("k % 3 = 0"), d, 4, key="k").collect()
    want = {(q, k) for q in range(0, 90, 3) for k in sorted((j for j in range(90) if j != q), key=lambda j: (-round(s[q, j], 9), j))[:4]}
    assert {(r["query"], r["key"]) for r in got} == want
    stats = {r["query"]: r for r in S.similarity_statistics(d.where("k % 3 = 0"), d, key="k").collect()}
    for q in range(0, 90, 3):
        x = np.delete(s[q], q)
        assert stats[q].n == 89 and abs(stats[q]["mean"] - x.mean()) < 1e-9 and abs(stats[q]["std"] - x.std()) < 1e-6 and abs(stats[q]["low"] - x.min()) < 1e-9
    assert S.batch_top_k(d.limit(0), d, 4, key="k").count() == 0 and S.batch_top_k(d, d.limit(0), 4, key="k").count() == 0
    assert S.batch_top_k(d.where("k = 1"), d, 2, key="k", itself=True).orderBy("rank").select(F.first("key")).collect()[0][0] == 1


def test_second_forms_of_relationships(spark):
    from lexquarry.operators import relationships as R

    text = "Przez umowę rozumie się zgodne oświadczenie stron. Warunkiem wypłaty jest wniosek strony; Prawo do odwołania przysługuje stronie."
    d = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "id string, content string")
    got = {(r.type, r.source, r.target) for r in R.relationships(d, "id", "content").collect()}
    assert {("defines", "umowę", "zgodne oświadczenie stron"), ("requires", "wypłaty", "wniosek strony"), ("permits", "odwołania", "stronie")} <= got
    assert R.density(R.relationships(d, "id", "content"), "id").collect()[0].n == len(got)


def test_models_of_folds_stacked_and_stored(spark, tmp_path):
    import random

    from lexquarry.operators import prediction as P

    rng = random.Random(1)
    rows = []
    for i in range(300):
        x, y = rng.random(), rng.random()
        rows.append((x, y, float(x + y > 1), i % 5))
    d = spark.createDataFrame(rows, "x double, y double, label double, fold int")
    folds = P.cross_validated(d, "logistic", ["x", "y"]).collect()
    assert [r.n for r in folds] == [60] * 5 and min(r.accuracy for r in folds) > 0.9
    got = {r.model: r.accuracy for r in P.stacked(d, ["logistic", "forest"], ["x", "y"]).collect()}
    assert set(got) == {"logistic", "forest", "blend", "stacked"} and min(got.values()) > 0.8
    m = P.classifier("logistic", features=["x", "y"]).fit(d)
    P.save_model(m, str(tmp_path / "m"))
    a, b = (x.transform(d).select("prediction").collect() for x in (m, P.load_model(str(tmp_path / "m"))))
    assert a == b


def test_local_checkpoints_are_refused_on_a_cluster():
    import pytest as p

    from lexquarry import session

    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

    fake = type("F", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d=None: d})()})()
    with p.raises(ValueError):
        session.checkpoint_dir(fake)


def test_bags_of_a_batch_are_not_held_as_objects(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lexquarry.operators import embedding as E

    rng = np.random.default_rng(5)
    words, sizes = [f"słowo{i}" for i in range(500)], np.array([*rng.integers(1, 300, 1500), 0, 450])
    picks = [rng.permutation(500)[:n] for n in sizes]
    flat, weights = np.concatenate(picks), rng.random(sizes.sum())
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    bag = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(words).take(pa.array(flat)), pa.array(weights)], ["token", "weight"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), bag], ["id", "bag"]).slice(3)

    def vectors():
        (out,) = E._bags(E.HashEncoder)(iter([batch]))
        return np.array(out.column("vector").to_pylist())

    tracemalloc.start()
    list(E._bags(E.HashEncoder)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # some 225,000 tokens
    known, got = E.HashEncoder().encode(words), vectors()
    for row, (a, b) in enumerate(zip(offsets[3:-1], offsets[4:])):
        v = weights[a:b] @ known[flat[a:b]]
        assert np.allclose(got[row], v / np.sqrt(v @ v) if b > a else v)
    monkeypatch.setattr(E, "PORTION", 64 * 100, raising=False)  # bags of more than 100 tokens are divided
    assert np.allclose(vectors(), got)
