"""Spoken numerals, loops, addresses, matching and mapping against hand-worked cases and brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkweave.functions import names as A
from talkweave.functions import numerals as D
from talkweave.operators import intervals as I
from talkweave.operators import repetition as L
from talkweave.operators import sequential as Q

GROUPS = st.lists(st.one_of(st.integers(0, 9), st.integers(10, 999)), min_size=1, max_size=7)


@settings(max_examples=300, deadline=None)
@given(GROUPS, st.booleans())
def test_said_numbers_come_back(groups, joined):
    digits, sizes = "".join(map(str, groups)), [len(str(g)) for g in groups]
    assert D.decode(D.encode(digits, sizes, joined=joined))[0] == digits
    assert D.decode(D.encode(digits, romanised=True))[0] == digits


def test_numerals_by_hand():
    assert D.encode("0775554433", [1, 1, 1, 3, 2, 2]) == "බිංදුවයි හතයි හතයි පන්සිය පනස් පහයි හතළිස් හතරයි තිස් තුන"
    assert D.decode("zero binduwai hathai") == ("07", True)  # said twice
    assert D.decode("binduwai binduwai") == ("00", False)
    assert D.decode("seven six") == ("76", False)
    assert D.decode("එක එකසිය විසිතුන") == ("1123", False)
    assert D.decode("hello") is None and D.decode("") is None and D.decode(None) is None
    for bad in (("12a", None), ("05", [2]), ("123", [1, 1]), ("", None)):
        with pytest.raises(ValueError):
            D.encode(*bad)


def test_runs_by_hand():
    text = "call me eka binduwai hathai hathai pahai ekai dekai thuna, eka thama ok"
    start, end, digits, _ = D.runs(text)[0]
    assert (text[start:end], digits) == ("binduwai hathai hathai pahai ekai dekai thuna", "0775123")
    text = "කෝල් බිංදුවයි හතයි හයයි පහයි හතරයි තුනයි දෙකයි එකසිය නමයට කරන්න"
    start, end, digits, _ = D.runs(text)[0]
    assert digits == "0765432109" and text[start:end].endswith("නමය")
    assert D.runs("deka") == [] and D.runs(None) == []


def test_phrase_loops_against_brute_force():
    r = random.Random(3)
    for _ in range(400):
        words = [r.choice("ab") for _ in range(r.randint(0, 30))]
        words += words[-2:] * r.randint(0, 12)
        want = None
        for k in range(1, 7):
            for i in range(len(words)):
                c = 1
                while words[i + c * k : i + (c + 1) * k] == words[i : i + k] and i + (c + 1) * k <= len(words):
                    c += 1
                if i + k <= len(words) and c > (10 if k == 1 else 5) and (want is None or c > want[0]):
                    want = (c, i, k)
        assert L.phrase_loop(words) == want, words


def test_loops_by_hand(spark):
    rows = [("thank you " * 12, 60.0, "thank you thank you"), ("a plain sentence", 5.0, "a plain sentence"), ("noooooooooooooo way", 5.0, "noo"), ("one two three four five six seven", 0.0, "one two three four five"), (None, None, ""), ("", 1.0, "")]
    df = spark.createDataFrame(rows, "text string, dur double, want string").select("want", L.truncated("text", "dur").alias("got"), L.reasons("text", "dur").alias("why"))
    got = df.collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert "2-word unit x12" in got[0]["why"] and got[1]["why"] == [] and "char loop" in got[2]["why"] and got[3]["why"] == ["too long for audio"] and got[4]["why"] == []


def test_addresses_in_words(spark):
    rows = [("අසූ අට පන්සල පාර", "88 Temple Road")]
    p = spark.createDataFrame(rows, "a string, b string").select("*", D.number_runs_of_any(F.lower("a")).alias("sa"), D.number_runs_of_any(F.lower("b")).alias("sb"))
    s = p.select(A.signature(F.col("a"), F.col("sa")).alias("a"), A.signature(F.col("b"), F.col("sb")).alias("b"))
    r = s.select("a", "b", A.same_address(F.col("a"), F.col("b")).alias("same")).first()
    assert r["a"]["numbers"] == ["88"] and r["b"]["numbers"] == ["88"] and r["same"]


def test_mapping_and_names(spark):
    rows = [("c", "r1", "h1", 5.0), ("c", "r1", "h2", 4.0), ("c", "r2", "h1", 4.5), ("c", "r2", "h2", 0.0)]
    pairs = I.greedy_mapping(spark.createDataFrame(rows, "clip string, ref string, hyp string, seconds double"))
    assert [(r["ref"], r["hyp"]) for r in pairs.collect()] == [("r1", "h1")]
    seg = "clip string, speaker string, start int"
    ref = spark.createDataFrame([("c", "r2", 0), ("c", "r1", 5)], seg)
    hyp = spark.createDataFrame([("c", "h2", 1), ("c", "h1", 6), ("c", "h3", 9)], seg)
    names = {r["speaker"]: r["name"] for r in I.friendly_names(ref, hyp, pairs).collect()}
    assert names == {"h1": "Speaker B", "h2": "Speaker C (extra)", "h3": "Speaker D (extra)"}


def test_matched_words(spark):
    df = spark.createDataFrame([("1", "the cat, sat down", "The cat has sat"), ("2", None, "x"), ("3", "- a", "a -")], "id string, ref string, hyp string")
    assert sorted(tuple(r) for r in Q.matched_words(df).collect()) == [("1", 0, 0), ("1", 1, 1), ("1", 2, 3), ("3", 0, 1)]


def test_bootstrap_of_equal_clips_has_no_width(spark):
    r = I.bootstrap(spark.createDataFrame([(i, 1, 4) for i in range(5)], "clip int, err long, total long"), "clip", 50).first()
    assert (r["draws"], r["low"], r["high"]) == (50, 0.25, 0.25)


def test_every_event_is_a_clip(spark, sf_dir):
    """Against brute force, and each event that lasts at most ten minutes is a token of its own clip."""
    from talkweave.plans import intervallic, registry

    rows = [(r["event_id"], r["clip"], r["start"], r["end"]) for r in intervallic.segments(spark, sf_dir).collect()]
    want = sorted((c, t, s - at, e - at) for c, day, at, _ in rows for t, d, s, e in rows if d == day and e > s and s >= at - 50_000 and e <= at + 600_050_000)
    got = sorted(tuple(r) for r in registry.queries()["M1_clip_tokens"](spark, sf_dir).select("clip_id", "token", "start", "end").collect())
    assert got == want and {i for i, _, s, e in rows if 0 < e - s <= 600_000_000} <= {c for c, *_ in got}


def test_char_error_of_whole_sources(spark, tmp_path):
    from talkweave.plans import registry

    rows = [(1, "en", "abcdefghijklmnopqrstuvwxyz"), (2, "fr", "web")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["cer"] for r in registry.queries()["W1_char_error"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.076923, 2: 0.666667}
