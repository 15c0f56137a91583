"""Structured identifiers and known surfaces, against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from talkweave.operators import spans as S
from talkweave.operators import structured as X

# text, the turn before, what is to be found: label, surface, value, ambiguous
CASES = [
    ("mage NIC eka 953201456V, number eka 0771234567", "", [("NIC", "953201456V", "953201456V", False), ("PHONE", "0771234567", "0771234567", True)]),
    ("call me on +94 77 123 4567 now", "", [("PHONE", "+94 77 123 4567", "0771234567", False)]),
    ("account 123456", "", [("ACCOUNT", "123456", "123456", False)]),
    ("123456 only", "", []),
    ("paid 1234567890123 rupees", "", []),
    ("0112345678 extension 12", "", [("PHONE", "0112345678 extension 12", "0112345678", True)]),
    ("extension number 123 please", "", [("PHONE", "extension number 123", "123", True)]),
    ("bill LN1234NG56789 and CEB/KW/1234/567890.", "", [("ACCOUNT", "LN1234NG56789", "LN1234NG56789", False), ("ACCOUNT", "CEB/KW/1234/567890", "CEB/KW/1234/567890", False)]),
    ("D L G 1 2 3 4 ok", "", [("ACCOUNT", "D L G 1 2 3 4", "DLG1234", False)]),
    ("NIC 12345", "", []),
    ("write Nimal.P@Example.lk.", "", [("EMAIL", "Nimal.P@Example.lk", "nimal.p@example.lk", False)]),
    ("born on 12th of August 1995", "", [("DOB", "12th of August 1995", "1995-08-12", False)]),
    ("June 3rd 1990", "", [("DOB", "June 3rd 1990", "1990-06-03", True)]),
    ("June 3rd 2024", "", []),
    ("the payment of 12/08/1995", "", []),
    ("1995-08-12", "", [("DOB", "1995-08-12", "1995-08-12", True)]),
    ("උපන් දිනය 1995 අගෝස්තු 12 වැනිදා", "", [("DOB", "1995 අගෝස්තු 12 වැනිදා", "1995-08-12", False)]),
    ("the 17th", "your birthday?", [("DOB", "17th", "????-??-17", True)]),
    ("the 17th", "your amount?", []),
    ("199512345678", "ගිණුම් අංකය?", [("ACCOUNT", "199512345678", "199512345678", False)]),
    ("199512345678", "", [("NIC", "199512345678", "199512345678", False)]),
    ("well I really do think it was 199512345678", "your account?", [("NIC", "199512345678", "199512345678", False)]),
    ("0712345678 ට අමතන්න", "", [("PHONE", "0712345678", "0712345678", False)]),
    ("0714567890. Policy ok", "", [("PHONE", "0714567890", "0714567890", True)]),
    ("ip 123.456.78.90 there", "", [("ACCOUNT", "123.456.78.90", "1234567890", True)]),
    ("5 1234567/2 and 9876543210 5/3", "", [("ACCOUNT", "9876543210", "9876543210", True)]),
    ("zero seven seven one two three four five six seven", "", [("PHONE", "zero seven seven one two three four five six seven", "0771234567", True)]),
    ("username eka nimalp95, expiry 08/28", "", [("ACCOUNT", "nimalp95", "nimalp95", False), ("ACCOUNT", "08/28", "08/28", False)]),
    ("😀 0771234567", None, [("PHONE", "0771234567", "0771234567", True)]),
    ("", "", []), (None, None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    turns = spark.createDataFrame([(k, t, p) for k, (t, p, _) in enumerate(CASES)], "doc_id long, text string, preceding string")
    return X.identified(turns, 2025).collect()


@pytest.mark.parametrize("k", range(len(CASES)))
def test_identifiers_by_hand(found, k):
    text, _, want = CASES[k]
    mine = sorted((r for r in found if r["doc_id"] == k), key=lambda r: r["start"])
    assert [(r["label"], r["surface"], r["value"], r["ambiguous"]) for r in mine] == want
    assert all(text[r["start"] : r["end"]] == r["surface"] for r in mine)


def test_a_hotline_belongs_to_an_organisation(spark):
    turns = spark.createDataFrame([(1, "hotline number 0112345678", None), (2, "call 0112345678", None)], "doc_id long, text string, preceding string")
    assert {r["doc_id"]: r["role"] for r in X.identified(turns, 2025).collect()} == {1: "ORGANISATION", 2: "PRIVATE_INDIVIDUAL"}


def test_many_groups_of_digits(spark):
    turns = spark.createDataFrame([(1, "1 " * 30000, None), (2, "x" * 100000, None), (3, "a1" * 50000, None)], "doc_id long, text string, preceding string")
    assert [r["doc_id"] for r in X.identified(turns, 2025).select("doc_id").collect()] == [1]


def test_propagation_by_hand(spark):
    docs = [
        ("r", 1, "Nimal came, 0771234567 extension 12"), ("r", 2, "so Nimal and 0771234567 extension 12 or 0771234567"), ("r", 3, "Nimalka 10771234567 නිමල්ට"), ("r", 4, "නිමල් a Nimal Bank"),
        ("q", 5, "Nimal"), ("r", 6, ""), ("r", 7, None), ("r", 8, "(+94) a+b! a+b"), ("r", 9, "+94 a+b"),
    ]
    d = spark.createDataFrame(docs, "rid string, doc_id long, text string")
    rows = [("r", 1, "PERSON", "Nimal"), ("r", 1, "PHONE", "0771234567"), ("r", 1, "PHONE", "0771234567 extension 12"), ("r", 4, "PERSON", "නිමල්"), ("r", 4, "ORG", "Nimal Bank"), ("r", 8, "ACCOUNT", "a+b!")]
    text = {k: t for _, k, t in docs}
    f = spark.createDataFrame([(r, k, x, text[k].index(s), text[k].index(s) + len(s), s) for r, k, x, s in rows if s != "0771234567"], "rid string, doc_id long, label string, start int, end int, surface string")
    f = f.unionByName(spark.createDataFrame([("r", 2, "PHONE", 40, 50, "0771234567")], f.schema))
    got = {}
    for r in X.propagated(d, f, F.col("label") != "ORG").collect():
        assert text[r["doc_id"]][r["start"] : r["end"]] == r["surface"]
        got.setdefault(r["doc_id"], []).append((r["start"], r["surface"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(0, "Nimal"), (12, "0771234567 extension 12")], 2: [(3, "Nimal"), (13, "0771234567 extension 12"), (40, "0771234567")],
        3: [(20, "නිමල්")], 4: [(0, "නිමල්"), (8, "Nimal")], 8: [(6, "a+b!")],
    }


def test_known_places_against_brute_force(spark, sf_dir):
    import re

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("rid"), "doc_id", "text")
    f = S.detected(d, {"EMAIL": X.EMAIL, "WORD": r"\b[Tt]he [a-z]{4,}\b"}).join(d.select("doc_id", "rid"), "doc_id").where("doc_id < 40")
    known = {(r["rid"], r["surface"]) for r in f.collect()}
    want = set()
    for r in d.collect():
        for rid, s in known:
            if rid == r["rid"] and r["text"]:
                want |= {(r["doc_id"], m.start(), s) for m in re.finditer(rf"(?<![^\W_]){re.escape(s)}(?![^\W_])", r["text"])}
    got = {(r["doc_id"], r["start"], r["surface"]) for r in X.known_places(d, f).collect()}
    assert got == want and want


def test_a_search_is_resumed(spark, tmp_path):
    from talkweave.operators import evaluation as V

    scored = []

    def cost(settings):
        scored.extend(tuple(r) for r in settings.select("a", "b").collect())
        return settings.withColumn("cost", F.abs(F.col("a") - 3) + F.abs(F.col("b") - 7))

    stages = [lambda s: [{**s, "a": a} for a in (1, 2, 3, 4)], lambda s: [{**s, "b": b} for b in (5, 7, 9)]]
    path = str(tmp_path / "grid")
    V.staged_search(spark, path, {"a": 1, "b": 5}, stages[:1], cost)
    first = len(scored)
    out = V.staged_search(spark, path, {"a": 1, "b": 5}, stages, cost).orderBy("cost", "order").first()
    assert (out["a"], out["b"], out["cost"], first, len(scored), len(set(scored))) == (3, 7, 0, 4, 6, 6)


def test_live_and_batch_identities_agree(spark, sf_dir):
    from talkweave.operators import sequential as Q
    from talkweave.plans import registry

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("session"), F.col("vec_id").alias("seq"), "embedding")
    want = sorted(tuple(r) for r in Q.identities(e, "session", "seq", "embedding", 0.3).collect())
    assert sorted(tuple(r) for r in registry.queries()["X5_live_identities"](spark, sf_dir).collect()) == want and want


def test_finalised_by_hand(spark):
    from talkweave.streaming import live

    u = spark.createDataFrame([("s", 0, 9, "pause"), ("s", 10, 11, "pause"), ("s", 20, 29, "length")], "session string, start long, end long, reason string")
    got = [tuple(r) for r in live.finalised(u, 0.1, 0.5, 0.6, F.lit(0.25)).collect()]
    assert got == [("s", 0.0, 1.0, "pause", 0.85), ("s", 2.0, 3.0, "length", 0.25)]


def test_recordings_hold_no_identifier_they_hid(spark, sf_dir):
    from talkweave.plans import recordings, registry

    t = recordings.turns(spark, sf_dir)
    found = X.identified(t, recordings.YEAR).where("role <> 'ORGANISATION'").join(t.select("rid", "doc_id"), "doc_id")
    texts = {r["doc_id"]: r["redacted"] for r in registry.queries()["R2_recordings"](spark, sf_dir).collect()}
    assert len(texts) == t.count()
    hidden = [(r["doc_id"], r["surface"]) for r in found.collect()]
    assert hidden and not [x for x in hidden if len(x[1]) >= 10 and x[1] in texts[x[0]]]


def test_pairs_are_counted_as_if_formed(spark):
    import itertools
    import random

    from talkweave.operators import evaluation as V

    r = random.Random(4)
    rows = [(r.randrange(3), r.choice(["a", "b", None]), r.choice(["x", "y", "z", None])) for _ in range(60)] + [(9, None, None)]
    want = {}
    for rec in {x[0] for x in rows}:
        tp = fp = fn = 0
        for a, b in itertools.combinations([x for x in rows if x[0] == rec], 2):
            gold, pred = a[1] is not None and a[1] == b[1], a[2] is not None and a[2] == b[2]
            tp, fp, fn = tp + (gold and pred), fp + (pred and not gold), fn + (gold and not pred)
        want[rec] = (tp, fp, fn)
    df = spark.createDataFrame(rows, "rec int, gold string, pred string")
    assert {x["rec"]: (x["tp"], x["fp"], x["fn"]) for x in V.link_scores(df).collect()} == want
    assert V.link_scores(df.limit(0)).count() == 0


def test_thresholds_and_digits_at_the_edges(spark):
    from talkweave.functions import repairs as P
    from talkweave.operators import evaluation as V

    scored = spark.createDataFrame([(1.0, False), (2.0, True), (3.0, True), (None, True), (2.5, None)], "score double, label boolean")
    assert tuple(V.best_threshold(scored, [3.0, 1.5, 2.0, 1.0]).first()) == (1.5, 3)
    assert V.best_threshold(scored.limit(0), [3.0, 1.5]).first()["hits"] == 0
    rows = [("12345 a 6", 0.5), ("1 2 3 4", 0.0), ("", 1.0), (None, 1.0), ("99 9", None), ("  x  ", 1.0)]
    got = [x[0] for x in spark.createDataFrame(rows, "t string, s double").select(P.trimmed_digits(F.col("t"), F.col("s"))).collect()]
    assert got == ["12345 a", "1 2", "", None, "99", "x"]
    folds = spark.createDataFrame([("k", 0, "a"), ("k", 1, "b"), ("k", 1, "b"), ("m", 0, "a")], "key string, fold int, label string")
    assert sorted((x["key"], x["fold"], x["predicted"]) for x in V.out_of_fold(folds, "fold", "key", "label").collect() if x["predicted"]) == [("k", 0, "b"), ("k", 1, "a"), ("k", 1, "a")]
