"""Kernels, text functions, spans, stores and streams on small inputs with known answers."""

import datetime
import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexquarry.functions import spans as S
from lexquarry.functions import text as T
from lexquarry.functions import vectors as V
from lexquarry.operators import language as L
from lexquarry.operators import prediction as P
from lexquarry.operators import search
from lexquarry.sources import landing, store
from lexquarry.streaming import stateful as K


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def text(spark, s, f):
    return spark.createDataFrame([(s,)], "t string").select(f("t").alias("x")).collect()[0].x


def test_kernels(spark):
    a, b, z = [1.0, 2.0, 3.0], [2.0, 3.0, 4.0], [0.0, 0.0, 0.0]
    r = one(spark, V.cosine(a, b), V.cosine(a, z), V.l2(a, b), V.manhattan_similarity(a, b), V.euclidean_similarity(a, b), V.cosine(a, [-1.0, -2.0, -3.0]))
    assert r[0] == pytest.approx(0.9925833340) and r[1] == 0 and r[2] == pytest.approx(math.sqrt(3))
    assert r[3] == pytest.approx(0.6065306597) and r[4] == pytest.approx(0.5613839138) and r[5] == pytest.approx(-1)
    assert one(spark, V.normalized([3.0, 4.0]))[0] == [0.6, 0.8] and one(spark, V.normalized(z))[0] == z
    with pytest.raises(ValueError):
        V.similarity(a, b, "unknown")


@pytest.mark.parametrize("v, ok", [([0.1] * 3, True), ([0.1] * 2, False), ([0.1, float("nan"), 0.0], False), ([0.1, float("inf"), 0.0], False), (None, False)])
def test_well_formed(spark, v, ok):
    assert spark.createDataFrame([(v,)], "v array<double>").select(V.well_formed("v", 3)).collect()[0][0] is ok


@pytest.mark.parametrize(
    "given, wanted", [("art.123", "art. 123"), ("artykuł 45", "art. 45"), ("art.  67", "art. 67"), ("§123", "§ 123"), ("par.45", "§ 45"), ("paragraf 67", "§ 67")]
)
def test_references(spark, given, wanted):
    assert text(spark, given, T.normalize_references) == wanted


@pytest.mark.parametrize("given, wanted", [("10 - 20", "10-20"), ("15 . 03 . 2023", "15.03.2023")])
def test_numbers(spark, given, wanted):
    assert text(spark, given, T.join_numbers) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [("12 stycznia 2023", datetime.date(2023, 1, 12)), ("31 PAŹDZIERNIKA 2023", datetime.date(2023, 10, 31)), ("32 stycznia 2023", None), ("1 unknown 2023", None), ("2023-01-01", None), (None, None)],
)
def test_dates(spark, given, wanted):
    assert text(spark, given, T.polish_date) == wanted


@pytest.mark.parametrize("given, ok", [("pl/act/2023/123a", True), ("DU/2023/1", True), ("us/test/2023/1", False), ("pl/", False), ("pl/<script>", False), (None, False)])
def test_act_ids(spark, given, ok):
    assert text(spark, given, T.valid_act_id) is ok


def test_act_id_form(spark):
    assert text(spark, "PL//test///2023//1/", T.act_id) == "pl/test/2023/1"


def test_space_and_tags(spark):
    assert text(spark, " a  b \n c ", T.one_space) == "a b c"
    assert text(spark, "<p>a&nbsp;<b>b</b></p><script>x</script>", T.strip_tags) == "a b"
    assert text(spark, "a\n\n\n  b\t\tc  \n", T.clean_formatting) == "a\n\nb c"


@pytest.mark.parametrize("f", [T.clean_formatting, T.remove_noise, T.one_space, T.normalize, T.words, T.sentences, T.paragraphs, T.content_hash, T.title_of, T.complexity, T.fixed_chunks, T.sentence_chunks])
def test_null_and_empty(spark, f):
    d = spark.createDataFrame([(None,), ("",), (" ",)], "t string").select(f("t").alias("x"))
    assert d.count() == 3


def test_noise(spark):
    assert text(spark, "Strona 5\nTekst....  a\n\nPoz. 12 x\nDziennik Ustaw 5\nb", T.remove_noise) == "Tekst... a\nb"


@pytest.mark.parametrize("t, ok", [("A" * 150, True), ("krótki", False), ("", False), ("404 Not Found", False), ("Błąd - niedostępny", False)])
def test_usable(spark, t, ok):
    assert text(spark, t, T.usable_html) is ok


def test_chunks(spark):
    assert [len(x) for x in text(spark, "x" * 800, T.fixed_chunks)] == [400, 400, 100]
    long = "Zdanie pierwsze jest tutaj. " * 40
    assert all(len(x) <= 400 for x in text(spark, long, T.sentence_chunks))


def test_overlaps(spark):
    rows = [("a", 0, "", 0, 8), ("b", 0, "", 0, 14), ("c", 0, "", 20, 35)]
    d = spark.createDataFrame([([Row(type=t, pattern=p, text=x, start=s, end=e, groups=[]) for t, p, x, s, e in rows],)], f"s array<{S.SPAN}>")
    for keep in (S.keep_first, S.keep_longest):
        assert [(x.start, x.end) for x in d.select(keep(F.col("s")).alias("k")).collect()[0].k] == [(0, 14), (20, 35)]


def test_spans_and_concepts(spark):
    d = spark.createDataFrame([(1, "Art. 5. Kto narusza art. 7 ust. 2, podlega karze grzywny. Organ jest obowiązany prowadzić wykaz."), (2, None), (3, "")], "id int, t string")
    e = L.entities(d, "id", "t").collect()
    assert {(r.type, r.text) for r in e} >= {("article_reference", "Art. 5"), ("article_reference", "art. 7 ust. 2")}
    assert all(d.where("id = 1").collect()[0].t[r.start : r.end] == r.text for r in e)
    kinds = {r.type for r in L.concepts(d, "id", "t").collect()}
    assert kinds == {"penalty", "obligation"}


def test_top_k_and_batches(spark):
    v = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(30)] + [(99, None)], "id int, embedding array<double>")
    assert [r.id for r in search.top_k(v, [1.0, 0.0], 3).collect()] == [0, 1, 2]
    assert [r.id for r in search.similar_to(v, 10, 2).orderBy("distance", "id").collect()] == [9, 11]
    assert search.similar_to(v, 99, 2).count() == 0
    got = search.batch_top_k(v.where("id in (3, 7)"), v, 2, key="id").collect()
    assert {(r.query, r.key) for r in got} == {(3, 2), (3, 4), (7, 6), (7, 8)}


def test_leaders(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.9, 0.1])], "id int, embedding array<double>")
    for block in (2, 100):
        assert {(r.id, r.leader) for r in search.leader_clusters(v, 0.8, key="id", block=block).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2)}


def test_ranking(spark):
    at = "2025-01-01 00:00:00"
    rows = [(1, "ustawa", "prawo konstytucyjne", 10, True, True, 0.8), (2, "kodeks", "prawo cywilne", 500, False, False, 0.7), (3, "rozporządzenie", "prawo administracyjne", 100, False, False, 0.6), (4, None, None, None, None, None, 0.5)]
    d = spark.createDataFrame(rows, "id int, document_type string, legal_domain string, age int, is_amendment boolean, affects_multiple_acts boolean, similarity double")
    d = d.withColumn("published_at", F.expr(f"timestamp_ntz'{at}' - make_interval(0, 0, 0, age)"))
    got = {r.id: r for r in search.rank_composite(d, at).collect()}
    assert got[1].composite == 1.0 and got[2].composite == pytest.approx(0.9048) and got[3].composite == pytest.approx(0.7020298507)
    assert got[2].temporal == 0.1 and got[3].temporal == pytest.approx(0.7910447761) and got[4].temporal == 0.5


def test_stores(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id int, x string")
    assert {tuple(r) for r in store.upsert(base, new, "id", ["x"]).collect()} == {(1, "a"), (2, "d")}
    assert [r.x for r in store.in_order([2, 9, 1, 2], base, "id").collect()] == ["b", None, "a", "b"]
    with pytest.raises(ValueError):
        store.in_order(list(range(1001)), base, "id")
    kv = spark.createDataFrame([("abc", "1"), ("xyz", "2")], "key string, value string")
    store.write_sharded(kv, str(tmp_path / "kv"))
    assert store.read_sharded(spark, str(tmp_path / "kv"), "xyz").collect()[0].value == "2"
    k = store.cache_key(F.lit("e"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    j = store.cache_key(F.lit("e"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))
    assert one(spark, k == j)[0]


def test_landing(spark, tmp_path):
    good = {"id": 1, "term": 10, "date": "2024-01-02", "title": "x", "yesVotes": 200, "noVotes": 150, "abstainVotes": 50, "totalVotes": 460, "deputyVotes": [{"deputyId": 1, "deputyName": "n", "club": "c", "vote": "yes"}]}
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"id": 2, "totalVotes": 0}) + "\n")
    got = {r.id: r for r in landing.votes(landing.read_records(spark, str(tmp_path / "v"), "voting")).collect()}
    assert got[1].participation == pytest.approx(0.8695652174) and got[1].vote == "yes" and got[2].participation == 0
    landing.register(spark)
    (tmp_path / "p").mkdir()
    for i in range(3):
        (tmp_path / "p" / f"{i}.json").write_text(json.dumps({"items": [{"eli": f"DU/{i}", "title": "t"}, 5]}))
    pages = spark.read.format("paged_json").schema("eli string, title string").load(str(tmp_path / "p"))
    assert {r.eli for r in pages.collect()} == {"DU/0", "DU/1", "DU/2"}


def test_prediction(spark):
    n = spark.createDataFrame([(1, 0.9, 1.0), (1, 0.6, 0.0), (2, 0.8, 1.0)], "query int, similarity double, y double")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    got = {r.query: r for r in P.from_neighbours(n, asked).collect()}
    assert got[1].prediction == pytest.approx(0.6) and got[3].prediction == 0.5 and got[3].confidence == 0.3
    v = spark.createDataFrame([(1, "a", 0.9, 0.5), (1, "b", 0.1, 0.5)], "id int, model string, p double, weight double")
    assert P.soft_vote(v, "id").collect()[0].prediction == pytest.approx(0.5)
    assert P.hard_vote(v, "id").collect()[0].prediction == 0


def test_rate_limit_stream_equals_replay(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:01"), (3, "a", "2024-01-01 00:00:02"), (4, "a", "2024-01-01 01:00:00"), (5, "b", "2024-01-01 00:00:00")]
    d = spark.createDataFrame(rows, "event_id bigint, user string, t string").select("event_id", "user", F.col("t").cast("timestamp").alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    want = {(r.event_id, r.granted) for r in K.limited_batch(d, "user", 1, 3600.0).collect()}
    assert want == {(1, True), (2, False), (3, False), (4, True), (5, True)}
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    K.run_once(K.limited(stream, "user", 1, 3600.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.event_id, r.granted) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_ingest_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, "Ala  ma kota", "2024-01-01"), (2, "ala ma KOTA ", "2024-01-01"), (3, "inny", "2024-01-02")], "id int, text string, d string").select("id", "text", F.col("d").cast("timestamp").alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    K.run_once(K.ingest(stream, "text", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 == K.ingest(d, "text", "ts").count()


def test_steps(spark):
    s = K.Steps(("half", lambda d: d.where("id < 5")), ("one", lambda d: d.where("id = 1")))
    assert s.run(spark.range(10), measure=True).count() == 1 and s.counts == {"half": 5, "one": 1}


def test_relationships(spark):
    from lexquarry.operators import relationships as R

    d = spark.createDataFrame([(1, "Minister powołuje komisję nadzoru; ustawa zastępuje rozporządzenie ministra.\nNic."), (2, None)], "id int, t string")
    got = {(r.type, r.source, r.target, r.source_type) for r in R.relationships(d, "id", "t").collect()}
    assert ("establishes", "Minister", "komisję nadzoru", "institution") in got
    assert {r.type for r in R.parties(d, "id", "t").collect()} == {"institution", "legal_act"}
    assert all(0.6 <= r.confidence <= 1 for r in R.relationships(d, "id", "t").collect())
