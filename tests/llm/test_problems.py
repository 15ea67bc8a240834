"""The nine operators against brute force, round trips and small cases with known answers."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import cut_texts, encoding, mixing, near_copies, neighbours, packing, scans, sentences, splitting

LEGAL = "id string, title string, content string, document_type string, pdf_extracted_text string, pdf_raw_content binary, embedding array<float>, updated_at timestamp_ntz, starts int, key string, n int, tokens int"
T0, T1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)


def legal(spark, *rows):
    """Rows of (id, title, content) with optional further fields; clashing extra columns are always there."""
    full = []
    for r in rows:
        d = {"document_type": "ustawa", "pdf_extracted_text": None, "pdf_raw_content": None, "embedding": None, "updated_at": T0, "starts": 1, "key": "k", "n": 2, "tokens": 3}
        d |= {"id": r[0], "title": r[1], "content": r[2]} | (r[3] if len(r) > 3 else {})
        full.append(tuple(d[c.split()[0]] for c in LEGAL.split(", ")))
    return spark.createDataFrame(full, LEGAL)


def cut(text):
    s = sentences.sentence_starts(text)
    return [text[i:j].strip() for i, j in zip(s, [*s[1:], len(text)])]


# 1


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Art. 3. 5. Od dnia 14 lipca 2014 r. Prezes Urzędu prowadzi wykaz. 12 lutego 2017 r. komisja skończyła.", ["Art. 3. 5. Od dnia 14 lipca 2014 r. Prezes Urzędu prowadzi wykaz.", "12 lutego 2017 r. komisja skończyła."]),
        ("Marszałek rzekł: „Zamykam. Głosujemy.” i zarządził przerwę. (Oklaski.) Koniec.", ["Marszałek rzekł: „Zamykam. Głosujemy.” i zarządził przerwę.", "(Oklaski.)", "Koniec."]),
        ("Umowa zawiera:\n1) opis;\n2) termin. Zwolnić jednostki itp. Po rozpoznaniu umarza się.", ["Umowa zawiera:\n1) opis;\n2) termin.", "Zwolnić jednostki itp.", "Po rozpoznaniu umarza się."]),
        ("Rozdział 5\n\nPoseł D. R. Nowak wniósł o to. Kwota ok. 7.6 mln zł.Nie dotyczy to portu.", ["Rozdział 5", "Poseł D. R. Nowak wniósł o to.", "Kwota ok. 7.6 mln zł.", "Nie dotyczy to portu."]),
        ("Wiersz pierwszy\nbez końca. Drugi", ["Wiersz pierwszy\nbez końca.", "Drugi"]),
        ("Mr. Smith of Co. Ltd. left at 9 a.m. on Monday. He said: \"Go. Now.\" Then he ran.", ["Mr. Smith of Co. Ltd. left at 9 a.m. on Monday.", 'He said: "Go. Now."', "Then he ran."]),
        ("Am 9. Oktober 2001 trat sie in Kraft. Herr Dr. Ott kam, z. B. im Mai.", ["Am 9. Oktober 2001 trat sie in Kraft.", "Herr Dr. Ott kam, z. B. im Mai."]),
        ("主席宣布：“结束。现在表决。”随后中止了。政府是否审查？", ["主席宣布：“结束。现在表决。”随后中止了。", "政府是否审查？"]),
        ("यह है। क्या?", ["यह है।", "क्या?"]),
        ("Zwolnić jednostki oceny itp.\nOd dnia 26 sierpnia 2024 r. Prezes Urzędu prowadzi wykaz.", ["Zwolnić jednostki oceny itp.", "Od dnia 26 sierpnia 2024 r. Prezes Urzędu prowadzi wykaz."]),
        ("", []), ("  \n ", []), ("x", ["x"]), ("Bez kropki", ["Bez kropki"]),
    ],
)
def test_sentences(text, wanted):
    assert cut(text) == wanted


@pytest.mark.parametrize(
    "text, n",
    [
        ("El Sr. García llegó. ¿Cómo está usted? ¡Muy bien!", 3), ("Los EE. UU. son grandes. Otra frase.", 2), ("Ο κ. Παπαδόπουλος ήρθε. Η συνεδρίαση άρχισε. Τέλος.", 3),
        ("Բարև։ Ինչպես եք։ Լավ։", 3), ("ሰላም ነው። እንዴት ነህ። ደህና።", 3), ("Termin upływa dnia 23 marca 2010 r. Od dnia 19 czerwca 2022 r. Prezes Urzędu prowadzi wykaz.", 2),
        ("Rzekł: „Raz. Dwa. Trzy.” i wyszedł. Koniec (zob. str. 5. Uwaga.) tu.", 2),
    ],
)
def test_sentences_of_more_languages(text, n):
    assert len(cut(text)) == n


def test_sentences_of_a_long_paragraph_take_linear_time():
    # with doubtful boundaries only, no boundary closes the search
    short, long = (sentences.sentence_starts("Zapis z 2020. " * n) for n in (1000, 100_000))
    assert len(short) == 1000 and len(long) == 100_000


def best_spans(p, bounds, gain):
    """All ways to cut, by brute force."""
    best, top = None, None
    inner = range(1, len(bounds) - 1)
    for mask in range(1 << len(inner)):
        at = [0, *[k for k in inner if mask >> (k - 1) & 1], len(bounds) - 1]
        score = 0.0
        for i, j in zip(at, at[1:]):
            n = bounds[j] - bounds[i]
            score += gain[j] + (sentences._span(p, bounds[i], bounds[j]) if n <= sentences.SHORT else -sentences.LENGTH * (n - sentences.SHORT))
        if top is None or score > top + 1e-12:
            best, top = at, score
    return top


def test_choice_of_spans_is_the_best_one():
    rng = random.Random(4)
    for _ in range(60):
        p = "".join(rng.choice("ab .1r") for _ in range(400))
        bounds = [0, *sorted(rng.sample(range(1, 399), 8)), 400]
        gain = [0.0, *[rng.choice([-12.0, -1.0, 0.5, 1.5, 4.0]) for _ in range(8)], 0.0]
        starts = [*sentences.choose(p, bounds, gain), 400]
        score = sum(gain[bounds.index(j)] + (sentences._span(p, i, j) if j - i <= sentences.SHORT else -sentences.LENGTH * (j - i - sentences.SHORT)) for i, j in zip(starts, starts[1:]))
        assert abs(score - best_spans(p, bounds, gain)) < 1e-9


def test_sentences_partition_the_text():
    random.seed(1)
    for _ in range(200):
        t = "".join(random.choice("Ab. \n„”(!?)1 Żą") for _ in range(random.randrange(60)))
        s = sentences.sentence_starts(t)
        assert s == sorted(set(s)) and all(not t[i].isspace() for i in s)
        assert not t[: s[0]].strip() if s else not t.strip()


def test_sentence_table(spark):
    d = legal(spark, ("a", "t", "Stary. Tekst."), ("a", "t", "Nowy.", {"updated_at": T1}), ("b", "t", None), ("c", "t", "Długi. " * 20_000))
    p = spark.createDataFrame([("p", "Raz. Dwa."), ("p", "Raz. Dwa."), ("q", None)], "id string, content string")
    got = sentences.sentence_table(d, p).collect()
    assert {(r.tbl, r.id, r.start_pos) for r in got if r.id != "c"} == {("legal_documents", "a", 0), ("processed_documents", "p", 0), ("processed_documents", "p", 5)}
    assert sum(r.id == "c" for r in got) == 20_000 and len(got) == 20_003
    assert sentences.sentence_table(d.limit(0), p.limit(0)).count() == 0
    assert [r.sentence for r in sentences.sentences(p.where("id = 'p'").distinct(), "content", "id").orderBy("n").collect()] == ["Raz.", "Dwa."]


# 2


def brute(rows, k, least):
    ids = [r[1] for r in rows]
    u = np.array([r[2] for r in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        best = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least and rows[i][0] == rows[j][0]), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in best}
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    rows = []
    for c in range(60):
        for j in range(c % 8 + 1):
            rows.append((f"g{c % 2}", f"{c:03d}-{j}", (base[c] + rng.normal(size=64) * 0.12).astype(np.float32).tolist()))
    for j in range(9):  # equal vectors, more than are listed for each
        rows.append(("g0", f"same-{j}", base[0].astype(np.float32).tolist()))
    want = brute(rows, 5, 0.9)
    bad = [("g0", "null", None), ("g0", "zero", [0.0] * 64), ("g0", "short", [1.0] * 32), ("g0", "nan", [float("nan")] * 64), ("g0", "inf", [float("inf")] + [0.0] * 63)]
    d = spark.createDataFrame(rows + bad + rows[:20], "grp string, id string, vec array<float>")
    got = [(r.id_a, r.id_b) for r in neighbours.similar_pairs(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert neighbours.similar_pairs(d.limit(0)).count() == 0


def test_neighbours_beside_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "cell_count", lambda rows, fan: 2048)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=64)
    hot /= np.linalg.norm(hot)
    rows = [("", f"hot-{i:04d}", hot.astype(np.float32).tolist()) for i in range(1400)]
    rows += [("", f"far-{i:04d}", rng.normal(size=64).astype(np.float32).tolist()) for i in range(2500)]
    for i in range(150):  # pairs that are closer to each other than to the hot vector
        mid = hot + rng.normal(size=64) * 0.09
        rows += [("", f"near-{i:03d}-{j}", (mid + rng.normal(size=64) * 0.02).astype(np.float32).tolist()) for j in range(2)]
    d = spark.createDataFrame(rows, "grp string, id string, vec array<float>")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(d).collect()}
    want = {(f"near-{i:03d}-0", f"near-{i:03d}-1") for i in range(150)}
    assert len(want & got) >= 0.99 * len(want)
    pivots = neighbours.choose_pivots(d, 2048, 64)
    assert len(pivots) == 2048 and (np.triu(pivots @ pivots.T, 1) < neighbours.NEARLY_EQUAL[0]).all()


def test_nearly_equal_pivots_are_dropped():
    u = np.eye(4, dtype=np.float32)[[0, 0, 1, 1, 2]]
    assert neighbours.apart(u, 4).tolist() == np.eye(4)[[0, 1, 2]].tolist() and len(neighbours.apart(u, 2)) == 2
    v = np.float32([[1, 0], [0.9999, 0.01], [0.9996, 0.03], [0.999, 0.045]])
    assert len(neighbours.apart(v / np.linalg.norm(v, axis=1)[:, None], 4)) == 2


def test_cells_of_several_levels(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(1500, 64))
    rows = [("", f"{c:04d}-{j}", (base[c] + rng.normal(size=64) * 0.15).astype(np.float32).tolist()) for c in range(1500) for j in range(2)]
    rows += [("", f"hot-{j:04d}", base[0].astype(np.float32).tolist()) for j in range(800)]
    d = spark.createDataFrame(rows, "grp string, id string, vec array<float>").repartition(6)
    one = {tuple(r) for r in neighbours.similar_pairs(d).collect()}
    many = {tuple(r) for r in neighbours.similar_pairs(d, fan=8, split=300).collect()}
    assert len(one) > 2000 and len(many & one) >= 0.99 * len(one) and not many - one


def test_cells_do_not_grow_with_the_rows(spark):
    largest = []
    for n in (4000, 16000):
        rng = np.random.default_rng(n)
        rows = [(i % 4, i.to_bytes(12, "big"), rng.normal(size=16).astype(np.float32).tobytes()) for i in range(n)]
        placed = spark.createDataFrame(rows, "cell bigint, key binary, vec binary")
        out = neighbours.divide(placed, 600, 8, 16)
        assert out.select("key").distinct().count() == n
        largest.append(out.groupBy("cell").count().agg(F.max("count")).collect()[0][0])
    assert max(largest) <= 600
    same = spark.createDataFrame([(1, i.to_bytes(12, "big"), np.ones(16, np.float32).tobytes()) for i in range(900)], "cell bigint, key binary, vec binary")
    assert neighbours.divide(same, 600, 8, 16).count() == 900


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(300, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, scale, err = neighbours.quantise(u)
    near = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(near - u @ u.T) <= err[:, None] + (1 + err[:, None]) * err[None, :] + 1e-9).all()


def test_tiles_of_several_blocks(monkeypatch, spark):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(1)
    u = rng.normal(size=(40, 8)) + 2
    u /= np.linalg.norm(u, axis=1)[:, None]
    x, y, s = neighbours.best_of_tile(u, np.arange(40), np.arange(40), 40, 0.9)
    full = u @ u.T
    assert {(a, b) for a, b in zip(x, y)} == {(a, b) for a in range(40) for b in range(40) if a != b and full[a, b] >= 0.9}


# 3


@pytest.mark.parametrize("limit, overlap", [(50, 0), (50, 12), (50, 40), (50, 49), (7, 3), (1, 0)])
def test_pieces(limit, overlap):
    texts = ["Ala ma kota. Kot ma Alę.\n\nI tak dalej, i tak dalej. " * 9, "x" * 333, " " * 120 + "a", "żółć 😀 " * 40]
    for t, pieces in zip(texts, splitting.split_batch(texts, [limit] * 4, [overlap] * 4)):
        assert pieces[0]["start_pos"] == 0 and pieces[-1]["end_pos"] == len(t)
        assert all(0 < p["end_pos"] - p["start_pos"] <= limit for p in pieces)
        for a, b in zip(pieces, pieces[1:]):
            assert a["end_pos"] - b["start_pos"] == min(overlap, a["end_pos"]) and b["end_pos"] > a["end_pos"]


def test_long_and_short_texts_together():
    texts = ["Zdanie jest tu. " * 20_000, *["Krótki tekst. Jeszcze jeden." for _ in range(2000)]]
    got = splitting.split_batch(texts, [20] * 2001, [0] * 2001)
    assert len(got[0]) >= 20_000 and all(g == got[1] for g in got[1:]) and len(got[1]) == 2
    assert [p["end_pos"] for p in splitting.split_batch(texts[:1], [20], [0])[0]] == [p["end_pos"] for p in got[0]]


def test_pieces_like_greedy():
    t = "Zdanie jest tu. " * 60
    levels = splitting.boundaries(t, 100)
    nodes, nxt, _ = splitting.successors(levels, len(t), 100, 20)
    at, path = 0, []
    while nodes[at] < len(t):
        at = nxt[at]
        path.append(int(nodes[at]))
    assert [p["end_pos"] for p in splitting.split_batch([t], [100], [20])[0]] == path


def test_split_documents(spark):
    limits = spark.createDataFrame([("ustawa", 30, 5), ("*", 20, 0)], "document_type string, max_chars int, overlap_chars int")
    d = legal(
        spark, ("a", "t", "x y " * 10), ("b", "t", "z " * 12, {"document_type": None}), ("c", "t", "z " * 12), ("d", "t", None), ("e", "t", "x " * 30), ("e", "t", "x", {"updated_at": T1}),
        ("f", "t", "z " * 12, {"document_type": " USTAWA "}),
    )
    got = {r.id: len(r.pieces) for r in splitting.split_documents(d, limits).collect()}
    assert got == {"a": 2, "b": 2, "c": 0, "d": 0, "e": 0, "f": 0}
    e = spark.createDataFrame([("a", 10, 4), ("a", 10, 4), ("b", 10, 0), ("c", 10, None), ("d", None, 4), ("e", 4, 4)], "id string, token_count int, chunk_size int")
    assert [(r.id, r.pieces) for r in splitting.oversized_chunks(e).collect()] == [("a", 3)]


# 4

PHRASE = "Wysokość opłaty łącznej za źródło wynosi 5 zł, jeżeli właściwy organ stwierdzi „brak wpływu” na środowisko."
UKR = "Орган, який веде облік договору, відмовляє у видачі майна."


@pytest.mark.parametrize("read", ["cp1252", "cp1250", "latin_1", "iso8859_2", "mac_roman", "cp852"])
@pytest.mark.parametrize("phrase", [PHRASE, UKR])
def test_round_trip_of_utf8(phrase, read):
    garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in phrase.encode())
    assert encoding.is_garbled(garbled) and encoding.repair(garbled)[0] == phrase
    twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in garbled.encode()) if read == "cp1252" else None
    if twice:
        assert encoding.repair(twice)[0] == phrase
    mixed = f"{phrase} {garbled}"
    assert encoding.repair(mixed)[0] == f"{phrase} {phrase}"


@pytest.mark.parametrize("written, read", [("cp1250", "cp1252"), ("iso8859_2", "cp1250"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1252"), ("cp852", "cp1250")])
def test_round_trip_of_single_bytes(written, read):
    plain = PHRASE.replace("„", '"').replace("”", '"')
    garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in plain.encode(written))
    assert encoding.is_garbled(garbled) and encoding.repair(garbled)[0] == plain


def test_cyrillic_code_pages():
    for written, read in (("cp1251", "cp1252"), ("koi8_u", "cp1251")):
        garbled = UKR.encode(written).decode(read)
        assert encoding.repair(garbled)[0] == UKR


@pytest.mark.parametrize(
    "sound", [PHRASE, UKR, "Tolerancja wynosi ±26 cm³, tj. ±26,5% objętości³ według przypisu¹.", "Spółka Ångholm & Søn z Växfjärden", "São Brandão, ação nº 31", "Norma ÄÖÜ-8, µg/m³, £ i ¥", "L'évêque à Île d'Ärö 52³", "", "abc", "SYMBOLEM Ã60."]
)
def test_sound_text(sound):
    assert not encoding.is_garbled(sound) and encoding.repair(sound)[0] == sound


SOUND = {
    "ru": "Болгария объявил съезд. Россия, ё, ы, э. Подъезд этого дома объявлен рёбрами, съёмка.", "bg": "България обяви събор. Този път е дълъг.",
    "es": "¿Cómo está usted? ¡Muy bien! El señor Núñez vive en España, año tras año.", "pt": "A nação não está em São Paulo; informações são úteis.",
    "tr": "Şu anda yağmur yağıyor, çığlık atan kuşlar ağaçlarda.", "el": "Αυτή είναι μια χώρα στην Ευρώπη. Άλλη μία πρόταση εδώ.",
    "ro": "Această școală este în București, iar țăranii și învățătorii sunt mulțumiți.", "hu": "Árvíztűrő tükörfúrógép, őszi idő.",
}


@pytest.mark.parametrize("lang", sorted(SOUND))
def test_other_languages(lang):
    x = SOUND[lang]
    assert not encoding.is_garbled(x) and encoding.repair(x)[0] == x and sentences._starts(x) == sentences.sentence_starts(x)
    for read in ("cp1252", "cp1251"):
        g = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in x.encode())
        assert encoding.is_garbled(g) and encoding.repair(g)[0] == x


@pytest.mark.parametrize("lang, written, read", [("ru", "cp1251", "cp1252"), ("ru", "koi8_u", "cp1251"), ("bg", "cp1251", "cp1252"), ("hu", "cp1250", "cp1252"), ("tr", "cp1254", "cp1252"), ("el", "cp1253", "cp1252")])
def test_other_code_pages(lang, written, read):
    x = SOUND[lang]
    g = x.encode(written).decode(read)
    assert encoding.is_garbled(g) and encoding.repair(g)[0] == x


def test_question_marks_for_letters():
    assert encoding.questioned("kt?ry by? w?r?d nich pa?stwo") and not encoding.questioned("a=b&c?d=e x?y f?g") and not encoding.questioned("Co? Kto? Gdzie? http://x.pl/ab?cdef=g&hi?jklm=n")


def test_layers_are_all_undone():
    g = "zażółć gęślą jaźń"
    for _ in range(6):
        g = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in g.encode())
    assert encoding.repair(g)[0] == "zażółć gęślą jaźń"


def test_repaired_fields_are_current(spark):
    bad = "za\u00c5\u00bc\u00c3\u00b3\u00c5\u201a\u00c4\u2021 g\u00c4\u2122\u00c5\u203al\u00c4\u2026"
    d = legal(spark, ("a", "t", bad), ("a", "t", "sound", {"updated_at": T1}), ("b", "t", "sound"), ("b", "t", bad, {"updated_at": T1}), ("b", "t", bad, {"updated_at": T1}), ("c", None, None))
    got = [(r.id, r.field, r.restored, r.lost) for r in encoding.repaired_fields(d).collect()]
    assert got == [("b", "content", "zażółć gęślą", False)]


def test_garbled_fields(spark):
    bad = PHRASE.encode().decode("cp1250", "replace")
    d = legal(spark, ("a", PHRASE, "opÅ‚ata"), ("a", PHRASE, "opłata", {"updated_at": T1}), ("b", "zak³adu spo³ecznego", None), ("c", None, "ust�pienie"), ("d", "rolnej?nie", ""), ("f", "x", "rejst?íku zem?d?lského"), ("e", "x", bad))
    assert {(r.id, r.field) for r in encoding.garbled_fields(d).collect()} == {("b", "title"), ("c", "content"), ("e", "content"), ("f", "content")}
    fixed = {(r.id, r.field): r for r in encoding.repaired_fields(d).collect()}
    assert fixed["b", "title"].restored == "zakładu społecznego" and fixed["c", "content"].lost
    assert encoding.garbled_fields(d.limit(0)).count() == 0


# 5


def word_sets(text, width):
    w = [x for x in text.lower().replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_near_copies(spark):
    random.seed(5)
    vocabulary = [f"słowo{i}" for i in range(400)]
    texts = []
    for d in range(40):
        base = [random.choice(vocabulary) for _ in range(random.choice([4, 30, 120, 300]))]
        for v in range(random.choice([1, 1, 2, 3])):
            w = list(base)
            for _ in range(random.randrange(1 + len(w) // 25)):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            texts.append((f"{d:02d}-{v}", " ".join(w[:3]), " ".join(w[3:])))
    texts += [("copy-a", "Tytuł", "ten sam tekst w dwóch kopiach"), ("copy-b", "TYTUŁ", "ten  sam tekst\tw dwóch kopiach"), ("null", None, None), ("tiny", "a", "b")]
    sets = {i: word_sets(f"{a or ''}\n{b or ''}", 3) for i, a, b in texts}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    d = legal(spark, *texts, *texts[:5], ("00-0", "x", "stary stan tego tekstu jest inny", {"updated_at": datetime.datetime(2023, 1, 1)}))
    got = [(r.id_a, r.id_b) for r in near_copies.similar_ids(near_copies.texts_of(d)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert near_copies.similar_ids(near_copies.texts_of(d.limit(0))).count() == 0


def test_large_class_is_a_star(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "EXPAND", 3)
    d = legal(spark, *[(f"{i}", "ten sam tytuł", "i ta sama treść") for i in range(6)], ("9", "ten sam tytuł", "i ta sama treść z dodatkiem"))
    got = {(r.id_a, r.id_b) for r in near_copies.similar_ids(near_copies.texts_of(d), least=0.6).collect()}
    assert got == {("0", str(i)) for i in range(1, 6)} | {("0", "9")}


def test_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    base = [f"w{i}" for i in range(60)]
    rows = [(f"{k}", "t", " ".join(base[k : 50 + k])) for k in range(6)] + [("x", "t", "zupełnie inny tekst o czymś innym niż tamte"), ("y", "t", "zupełnie inny tekst o czymś innym niż tamte"), ("z", "t", None)]
    ids, pairs = near_copies.class_pairs(near_copies.texts_of(legal(spark, *rows)), 3, 0.7, 20, 3)
    got = {r.id: r for r in near_copies.groups(ids, pairs).collect()}
    assert {got[str(k)].group_id for k in range(6)} == {"0"} and got["y"].class_id == "x" and got["x"].links == 0 and got["3"].links == 5
    assert got["z"].class_id == got["z"].group_id == "z" and len(got) == 9


def test_groups_of_a_long_chain(spark):
    n = 3000  # a chain of classes, each linked to the next
    ids = spark.createDataFrame([(f"{i:05d}", f"{i:05d}".encode()) for i in range(n)], "id string, key binary")
    pairs = spark.createDataFrame([(f"{i:05d}".encode(), f"{i + 1:05d}".encode()) for i in range(n - 1)], "ka binary, kb binary")
    got = near_copies.groups(ids, pairs).collect()
    assert {r.group_id for r in got} == {"00000"} and len(got) == n


def test_bit_bound_is_never_too_low():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 4000, 300)).astype(np.uint32)
        b = np.unique(np.concatenate([rng.choice(a, 200), rng.integers(0, 4000, 100)])).astype(np.uint32)
        bits = near_copies.bitmaps([a.tobytes(), b.tobytes()]).astype(np.float32)
        n = np.array([len(a), len(b)], np.float32)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert near_copies.tile_pairs(n, bits, np.zeros(2), np.zeros(2), 0, 0, j - 1e-9)


# 6

PAGES = """Monitor Polski  – 12 –  Poz. 7
Koszty budowlanego zakładu pokrywa się ze środ-
ków rady gminy, a wykaz handlowo-
usługowego portu prowadzi organ wvłaściwy.
Strona 12
\f
Monitor Polski  – 13 –  P0z. 7
Organ budowlanego zakładu prowadzi bud0wlanego clane.
5trona 13"""


def test_scans(spark):
    filler = "\n".join(["budowlanego zakładu środków handlowo-usługowego portu dane organ właściwy"] * 12)
    d = legal(spark, ("a", "Tytuł", "", {"pdf_extracted_text": PAGES}), ("b", "t", "", {"pdf_raw_content": bytearray(filler.encode())}), ("c", None, None), ("d", "t", "", {"pdf_extracted_text": ""}),
              *[(f"p{k}", "t", "", {"pdf_extracted_text": f"Monitor Polski  – {k} –  Poz. 7\ntekst i dalej\n"}) for k in range(5)])
    got = {(r.kind, r.line_no): r for r in scans.scan_noise(d).where("id = 'a'").collect()}
    assert {k for k in got if k[0] == "furniture"} == {("furniture", i) for i in (1, 5, 7, 9)}
    assert {k for k in got if k[0] == "hyphen"} == {("hyphen", 2)}
    assert {k for k in got if k[0] == "misread"} == {("misread", 8)}
    out = {r.id: r.paragraphs for r in scans.mended_texts(d).collect()}
    assert "środków rady" in out["a"] and "handlowo-usługowego" in out["a"] and "Strona" not in out["a"] and "budowlanego dane" in out["a"] and out["d"] == ""
    assert scans.scan_noise(d.limit(0)).count() == 0


def test_copies_of_a_text_count_once(spark):
    filler = "\n".join(["budowlanego zakładu środków dane"] * 12)
    page = "Organ prowadzi clane od dziś."
    old = {"pdf_extracted_text": page + " Zmiana.", "updated_at": T0}
    copies = [(f"c{i:02d}", f"t {i}", "", {"pdf_extracted_text": page, "updated_at": T1}) for i in range(20)]
    d = legal(spark, *copies, copies[0], ("c00", "t 0", "", old), ("z", "t", "", {"pdf_extracted_text": filler}))
    got = {(r.id, r.wrong, r.right) for r in scans.scan_noise(d).where("kind = 'misread'").collect()}
    assert got == {(f"c{i:02d}", "clane", "dane") for i in range(20)}


def test_letters_misread_for_letters(spark):
    long = "organizacyjno" * 4
    filler = "\n".join([f"przeprowadza którym zażółcić ile {long}"] * 12)
    page = f"Organ pŕzeprowadza nabór, o\nktóŕym mowa w przepisach; {long.replace('g', '9', 1)}\nżądanie i façade, Île d’Ärö"
    d = legal(spark, ("a", "t", "", {"pdf_extracted_text": page}), ("b", "t", "", {"pdf_extracted_text": filler}))
    got = {(r.line_no, r.wrong, r.right) for r in scans.scan_noise(d).where("kind = 'misread'").collect()}
    assert got == {(1, "pŕzeprowadza", "przeprowadza"), (2, "któŕym", "którym"), (2, long.replace("g", "9", 1), long)}


def test_marked_letters_of_the_language_are_sound():
    assert not scans.doubtful("zażółć", scans.FOREIGN["pl"]) and not scans.doubtful("été", scans.FOREIGN["fr"])
    assert scans.doubtful("été", scans.FOREIGN["pl"]) and scans.doubtful("Ŕok", scans.FOREIGN["pl"])


def test_repeated_edge_lines_are_furniture():
    pages = [f"Biuletyn gminy, zeszyt {i}\nTreść strony {w} jest tu.\nDalej {w} idzie." for i, w in enumerate(["pierwsza", "druga", "trzecia"])]
    lines = "\n\f\n".join(pages).split("\n")
    assert scans.furniture(lines, None) == {0, 4, 8} and scans.furniture(lines[:7], None) == set()


def test_running_lines_of_the_corpus(spark):
    texts = [f"Acme Annual Report 2023 | page {7 + k}\nThe words of text {k} go on here\nand end here." for k in range(6)]
    d = legal(spark, *[(f"d{k}", None, "c", {"pdf_extracted_text": t}) for k, t in enumerate(texts)], ("x", None, "c", {"pdf_extracted_text": "Art. 5.\nTekst.\nArt. 6.\nTekst.\nArt. 7.\nTekst."}))
    got = {(r.id, r.line_no) for r in scans.scan_noise(d).where("kind = 'furniture'").collect()}
    assert got == {(f"d{k}", 1) for k in range(6)}


def test_running_lines_need_no_more_repeats_in_a_large_corpus(spark):
    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    text = F.concat(F.when(F.col("id") < 5, F.concat(F.lit("Acme Annual Report 2023 | page "), F.col("id") + 7, F.lit("\n"))).otherwise(""), F.lit("tekst "), word)
    d = spark.range(60_100).select(F.col("id").cast("string").alias("id"), F.lit(T0).alias("updated_at"), F.lit(None).cast("string").alias("title"), text.alias("pdf_extracted_text"), F.lit(None).cast("binary").alias("pdf_raw_content"))
    got = {(r.id, r.line_no) for r in scans.scan_noise(d).where("kind = 'furniture'").collect()}
    assert got == {(str(k), 1) for k in range(5)}


def test_running_lines_joined_to_their_texts_are_those_shared(spark, monkeypatch):
    texts = [f"Acme Annual Report 2023 | page {7 + k % 9}\nThe words of text {k} go on here\nand end here." for k in range(8)]
    more = [f"Tekst {k}.\nKoniec\nDruk nr {k}" for k in range(5)]
    rows = [(f"d{k}", None, "c", {"pdf_extracted_text": t} if k % 2 else {"pdf_raw_content": t.encode()}) for k, t in enumerate([*texts, *texts, *more])]
    d = legal(spark, *rows, ("x", None, "c", {"pdf_extracted_text": "Art. 5.\nTekst."}), ("y", None, "c"))
    noise = lambda: sorted(map(tuple, scans.scan_noise(d).select("id", "kind", "line_no").distinct().collect()))
    want = noise()
    assert {x for x in want if x[1] == "furniture"} == {(f"d{k}", "furniture", 1) for k in range(21)} | {(f"d{k}", "furniture", 3) for k in range(16, 21)}
    monkeypatch.setattr(scans, "SHARED", 0)
    assert noise() == want


def test_running_lines_of_one_text():
    lines = "Acme Annual Report 2023 | page 7\none\ntwo\n\f\nAcme Annual Report 2023 | page 8\nthree\nfour\n\f\nAcme Annual Report 2023 | page 9\nfive\nsix".split("\n")
    assert scans.furniture(lines, None) == {0, 4, 8}


def test_templates_set_misread_signs_equal():
    assert scans.template("DZIENNIK USTAW – 84 – Poz. 705") == scans.template("DZIENN!K U5TAW – 8S – P0z. 112") != scans.template("Druk nr 4")
    assert scans.template("bez liczby") is None and scans.template("– 12 –") is None


def test_numbers_of_provisions_are_sound():
    assert [w for w, *_ in scans.analyse("Art. 2a. Tekst 2a tu", None)[2]] == ["Art", "Tekst", "2a", "tu"]


def test_anagram_difference():
    for wrong, right, diff in scans.differences():
        assert scans.anagram("a" + right + "b") - scans.anagram("a" + wrong + "b") == diff


# 7


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion(seed):
    random.seed(seed)
    sizes = [random.choice([random.randrange(1, 100), random.randrange(1, 30), 100, 0]) for _ in range(random.choice([0, 1, 7, 60, 400]))]
    bins = packing.complete(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    order = sorted(sizes, reverse=True)
    assert len([b for b in bins if sum(sizes[i] for i in b)]) <= max(0, len(packing.best_fit([s for s in order if s], 100)))


def test_completion_beats_best_fit():
    sizes = [6, 5, 5, 4, 4, 3, 3] * 3  # best fit decreasing leaves room that completion fills
    assert len(packing.complete(sizes, 10)) == -(-sum(sizes) // 10)


def test_pack(spark):
    random.seed(2)
    rows = [(i, random.randrange(0, 90)) for i in range(300)] + [(900, 250), (901, 100), (902, None)]
    caps = spark.createDataFrame([("k", 100), ("null", 0)], "capacity_name string, capacity_tokens int")
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"), caps)
    by = got.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    assert {(r.doc_id, r.t) for r in by} == {(i, t) for i, t in rows if t is not None} and all(r.n == 1 for r in by if r.doc_id not in (900,))
    assert got.groupBy("container").agg(F.sum("tokens").alias("t")).where("t > 100").count() == 0
    n, total = got.select("container").distinct().count(), sum(t or 0 for _, t in rows)
    order = sorted((min(t, 100) for _, t in rows[:-3]), reverse=True)
    assert -(-total // 100) <= n <= len(packing.best_fit(order, 100)) + 4
    assert packing.pack(spark.createDataFrame(rows[:0], "doc_id bigint, tokens bigint"), caps).count() == 0


# 8


def test_mix(spark):
    random.seed(4)
    rows = [(i, random.choice(["A ", "a", "b", "c", None]), random.randrange(1, 60), f"{i % 900}") for i in range(2000)] + [(5000, "d", 5000, "d"), (5001, "a", None, None), (5002, "a", 0, "z")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, digest string")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("none", 0.1, 2), ("d", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, total=None).collect()
    assert {r.source for r in m} == {"a", "b", "d"} and len({r.doc_id for r in m}) == len(m)
    assert all(r.copies <= {"a": 3, "b": 2, "d": 1}[r.source] for r in m)
    t2 = spark.createDataFrame([("a", 0.6, 3), ("b", 0.4, 2), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in mixing.shares(mixing.mix(d, t2), t2).collect()}
    assert s["a"].actual_share == pytest.approx(0.6, abs=0.005) and s["b"].actual_share == pytest.approx(0.4, abs=0.005) and s["none"].tokens == 0
    assert mixing.mix(d.limit(0), t).count() == 0


def test_copies_in_many_rows(spark):
    rows = [(i, "a", 5, "hot" if i < 4000 else f"d{i // 2}") for i in range(6001)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, digest string")
    got = {r.doc_id: r.c for r in mixing.with_copies(d).collect()}
    assert len(got) == 6001 and got[0] == 4000 and got[4000] == 2 and got[6000] == 1


# 9


@pytest.fixture(scope="module")
def corpus():
    random.seed(6)
    nouns = ["portu", "lasu", "statku", "zakładu", "rejestru", "wykazu"]
    say = lambda: random.choice(["Organ prowadzi wykaz {} w terminie {} dni.", "Rada gminy może zwolnić od {} do {} jednostek.", "Koszty {} wynoszą {} zł."]).format(random.choice(nouns), random.randrange(99))
    out = []
    for _ in range(300):
        t = " ".join(say() for _ in range(random.randrange(2, 9)))
        out.append(t + random.choice(["", "", "\n\nMarszałek Sejmu", "\n\nZałączniki: 3"]))
    return out


def test_cut_texts(spark, corpus):
    cuts = [t[: random.Random(i).randrange(30, len(t) - 25)].rstrip() for i, t in enumerate(corpus[:60]) if len(t) > 80 and "\n" not in t]
    cuts = [c for c in cuts if c[-1] not in ".!?" and not c.endswith(" zł")]
    rows = [(i, "A ", t) for i, t in enumerate(corpus)] + [(1000 + i, "b", t) for i, t in enumerate(cuts)] + [(9000, "b", None), (9001, None, ""), (9002, "b", "  "), (9003, "b", "Organ prowadzi [...]"), (9004, "b", "Organ prowadzi wykaz&nbs")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    hit = {r.doc_id for r in cut_texts.judged(d).where("cut").collect()}
    assert {9003, 9004} <= hit and not hit & {9000, 9001, 9002}
    found = sum(1000 + i in hit for i in range(len(cuts)))
    assert found >= 0.95 * len(cuts) and sum(i in hit for i in range(len(corpus))) <= 6
    assert cut_texts.judged(d.limit(0)).count() == 0


def test_contexts_are_counted_exactly(spark):
    rng = random.Random(8)
    texts = list(dict.fromkeys("".join(rng.choice("abcdef .") for _ in range(2000)).strip() for _ in range(150)))
    ends = ["abc de", "fa.bcd", "cafe bad", "abcdefabcdefabcdefab"]
    asked = dict(zip(ends, cut_texts.contexts(ends)))
    d = spark.createDataFrame([(t,) for t in texts + ends], "text string").repartition(3)
    keys = spark.createDataFrame([(k,) for k in {k for x in asked.values() for k in x}], "key bigint")
    got = {r.key: (r.seen, r.ends, r.stops) for r in cut_texts.train(d, keys).collect()}
    every = [t for t in texts + ends if cut_texts.parts(t)[0] == "end"]
    assert len(every) == len(texts) + len(ends)
    total = sum(map(len, every))
    assert got[cut_texts.EMPTY] == (total, len(every), sum(t[1:].count(".") for t in every))
    for x, keys in asked.items():
        for n, key in zip(cut_texts.ORDERS, keys):
            want = [0, 0, 0]
            for t in every:
                t = "\0" * 18 + t
                for i in range(19, len(t) + 1):
                    if t[i - n : i] == ("\0" * n + x)[-n:]:
                        want[0] += 1
                        want[1] += i == len(t)
                        want[2] += t[i : i + 1] == "."
            assert got[key] == tuple(want)


def test_without_the_model_nothing_is_cut():
    (case, _), *_ = cut_texts.cases_of(["Rada gminy może zwolnić od portu.\n\nKwarantanna obej"], [False])
    assert cut_texts.log_odds(case, {}) == 0.0


def test_threshold_parts_cuts_from_ends():
    assert abs(cut_texts.threshold({-12: 6, 12: 94}, {-12: 100})) < 0.5  # a few true cuts among the ends do not matter
    assert -1 <= cut_texts.threshold({4: 50, 8: 50}, {-8: 50, -4: 50}) <= 1
    assert cut_texts.threshold({}, {}) == 0.0


@pytest.mark.parametrize("text, rest, marked", [("Organ pro [...]", "Organ pro", True), ("Organ pro…]", "Organ pro", True), ("a b&nbs", "a b", True), ("koniec.", "koniec.", False), ("i in…", "i in…", False), ("do …", "do", True), ("tekst <br", "tekst", True)])
def test_marks_of_omission(text, rest, marked):
    assert cut_texts.stripped(text) == (rest, marked)


def test_stops_in_quotations_are_other_signs():
    assert cut_texts.signs("Rzekł: „Raz. Dwa.” Koniec.") == "rzekł: „raz\x01 dwa\x01” koniec."
    assert cut_texts.signs('Er: "A. B." C.\nD.') == 'er: "a\x01 b\x01" c.\nd.' and len(cut_texts.signs("İİ.")) == 3


def test_copies_of_a_cut_text_are_cut(spark, corpus):
    copies = ["Rada gminy może zwolnić od portu.\n\nKwarantanna obej", "Organ prowadzi wykaz lasu.\n\nZwykłe przesłanki odmo"]
    rows = [(i, "a", t) for i, t in enumerate(corpus)] + [(1000 + 100 * j + i, "b", t + " " * (i % 2)) for j, t in enumerate(copies) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)
    hit = {r.doc_id for r in cut_texts.judged(d).where("cut").collect()}
    assert {r[0] for r in rows if r[0] >= 1000} <= hit and len([i for i in hit if i < 1000]) <= 6


def test_thresholds_come_from_every_text(spark, monkeypatch):
    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    text = F.concat(F.lit("Organ prowadzi wykaz "), word, F.lit(" w terminie. Koszty lasu "), word, F.lit(" wynoszą wiele."))
    d = spark.range(25_000).select((F.col("id") % 24_000).alias("doc_id"), F.lit("a").alias("source"), text.alias("text"))
    d = d.unionByName(d.where("doc_id < 500").repartition(3))  # copies count once
    got, inner = {}, cut_texts.thresholds

    def told(held):
        got.update({(r.kind, r.label): r.n for r in held.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()})
        return inner(held)

    monkeypatch.setattr(cut_texts, "thresholds", told)
    cut_texts.judged(d)
    made = [cut_texts.cases_of([t], [True])[0][1] for (t,) in d.select("text").distinct().collect()]
    want = {(kind, label): sum(c.kind == kind and x == label for cases in made for c, x in cases) for kind in ("end", "stop") for label in (False, True)}
    assert want["end", False] == 25_000 and got == {k: n for k, n in want.items() if n}
