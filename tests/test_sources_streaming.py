"""Readers over small files, and live operators on streams against their batch results."""

import random

import pytest

from pyspark.sql import functions as F

from talkweave.operators import sequential as Q
from talkweave.sources import readers as R
from talkweave.streaming import live


def test_rttm_and_labels(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER c1 1 0.5 1.25 <NA> <NA> ann <NA> <NA>\nOTHER x\nSPEAKER c1 1 2 0 <NA> <NA> ann <NA> <NA>\nSPEAKER c1 1 x 1 <NA> <NA> bob\n")
    got = [tuple(r) for r in R.rttm(spark, str(tmp_path / "a.rttm")).collect()]
    assert got[0] == ("c1", "ann", 0.5, 1.75)
    R.write_rttm(spark.createDataFrame([("c1", "ann", 0.5, 1.75)], "clip string, speaker string, start double, end double"), str(tmp_path / "out"))
    assert [tuple(r) for r in R.rttm(spark, str(tmp_path / "out")).collect()] == [("c1", "ann", 0.5, 1.75)]
    (tmp_path / "b.uem").write_text("c1 1 0 10\nbad\nc1 1 5 5\n")
    assert [tuple(r) for r in R.uem(spark, str(tmp_path / "b.uem")).collect()] == [("c1", 0.0, 10.0)]
    (tmp_path / "clip7.txt").write_text("1.5\t0.5\tbob bc\n3 4\njunk\n\n")
    assert sorted(tuple(r) for r in R.label_track(spark, str(tmp_path / "clip7.txt")).collect()) == [("clip7", 0.5, 1.5, "bob bc"), ("clip7", 3.0, 4.0, "")]


def test_every_translation_shape(spark, tmp_path):
    unit = '{"utt_id": "u1", "clean_en": "hi", "clean_si": ""}'
    for name, text in (("r1", f"[{unit}]"), ("r2", f'{{"recording_id": "R2", "utterance_records": [{unit}]}}'), ("r3", f'{{"utterances": [{unit}]}}')):
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted(tuple(r) for r in R.translations(spark, str(tmp_path)).collect())
    assert got == [("R2", "u1", "hi", None), ("r1", "u1", "hi", None), ("r3", "u1", "hi", None)]


def test_inventory_and_private_sink(spark, tmp_path):
    for n in ("R1.en.json", "R1.si.json", "R2.en.json", "skip"):
        (tmp_path / n).write_text("x")
    rows = {r["id"]: r for r in R.inventory(spark, str(tmp_path), r"/(R\d+)\.(en|si)\.json$", ["en", "si"]).collect()}
    assert rows["R1"]["si"].endswith("R1.si.json") and rows["R2"]["si"] is None and len(rows) == 2
    df = spark.range(1)
    with pytest.raises(PermissionError):
        R.write_private(df, str(tmp_path / "open"), [str(tmp_path / "private")])
    with pytest.raises(PermissionError):
        R.write_private(df, str(tmp_path / "private/../open"), [str(tmp_path / "private")])
    R.write_private(df, str(tmp_path / "private/map"), [str(tmp_path / "private")])


def streamed(spark, df, folder, name, build, mode="append"):
    """Rows that a streaming query gives for df, fed in three files in order."""
    rows = df.collect()
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_sliding_totals_stream_equals_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").limit(300)
    want = {tuple(r)[:4] for r in live.sliding_totals(e).collect()}
    got = {r[:4] for r in streamed(spark, e, str(tmp_path), "sliding", live.sliding_totals, "complete")}
    assert got == want


def test_utterances_end_after_a_longer_pause_if_a_number_is_last(spark):
    rows = [("s", 0.0, "my"), ("s", 0.5, "number"), ("s", 0.9, "077"), ("s", 2.2, "123"), ("s", 4.0, "yes"), ("s", 5.0, "no")]
    df = spark.createDataFrame(rows, "speaker string, t double, token string").select("speaker", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "token")
    assert sorted(r["n_tokens"] for r in live.utterances(df).collect()) == [1, 1, 4]


def test_endpoints_on_a_stream(spark, tmp_path):
    r = random.Random(3)
    rows, p = [], 0.1
    for f in range(900):
        if r.random() < 0.03:
            p = 1.0 - p
        rows.append(("a", f, p))
    point = live.Endpointer(quiet=10, longest=120)
    want = [x for x in (point.feed(f, q) for _, f, q in rows) if x]
    df = spark.createDataFrame(rows, "session string, frame long, p double").coalesce(1)
    got = streamed(spark, df, str(tmp_path), "endpoints", lambda s: live.endpoints(s, idle_ms=None, quiet=10, longest=120))
    assert sorted(x[1:] for x in got) == sorted(want) and want
    assert all(b - a < 120 for a, b, _ in want)


def test_an_idle_session_ends(spark, tmp_path):
    import time

    df = spark.createDataFrame([("a", f, 1.0) for f in range(30)], "session string, frame long, p double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.endpoints(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), idle_ms=500).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 40
        while time.time() < until and not spark.table("idle").count():
            time.sleep(0.3)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("idle").collect()] == [("a", 0, 29, "end")]


def test_replay_ends_what_is_open(spark):
    df = spark.createDataFrame([("a", f, 1.0) for f in range(30)], "session string, frame long, p double")
    assert [tuple(r) for r in live.replayed_endpoints(df).collect()] == [("a", 0, 29, "end")]


def test_identities_on_a_stream(spark, tmp_path):
    r = random.Random(1)
    rows = [("s", k, [float(k % 3 == j) + 0.1 * r.random() for j in range(3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "session string, seq long, embedding array<double>").coalesce(1)
    want = sorted(tuple(x) for x in Q.identities(df, "session", "seq", "embedding", 0.7).collect())
    assert sorted(streamed(spark, df, str(tmp_path), "identities", lambda s: live.live_identities(s, 0.7, idle_ms=None))) == want
    assert {i for _, _, i in want} == {0, 1, 2} and all(i == k % 3 for _, k, i in want)


def test_sequences():
    assert Q.edit_counts("a b c".split(), "a x c d".split()) == (2, 1, 0, 1)
    assert Q.common_length("a b c d".split(), "b d".split()) == 2
    assert Q.phrase_run("a b a b a b c".split()) == (3, 2)
    assert Q.matched_items([["call", "bob"], ["pay"]], [["call", "bob", "now"], ["x"]]) == [(0, 0)]
    assert Q.clips([(0, 1), (2, 3), (20, 21), (22, 60)], 5, 30) == [0, 0, 1, 2]
    assert Q.split_at_pauses([0, 1, 5, 6], [1, 2, 6, 7], 3) == [0, 0, 1, 1]
    for text in ("", "x" * 3000, "One. Two. " * 300):
        w = Q.text_windows(text, 100)
        assert "".join(text[a:b] for a, b in w) == text and all(b - a <= 100 for a, b in w)


def test_name_clusters(spark):
    rows = [("r", 1, ["nimal", "perer"]), ("r", 2, ["nimal"]), ("r", 3, ["nimali"]), ("r", 4, ["sunil"]), ("q", 1, ["sunil"])]
    got = {(r["rid"], r["mention_id"]): r["cluster"] for r in Q.clustered(spark.createDataFrame(rows, "rid string, mention_id int, keys array<string>")).collect()}
    assert got["r", 1] == got["r", 2] and len({got["r", 1], got["r", 3], got["r", 4]}) == 3
