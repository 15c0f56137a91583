"""Invariants and hand-worked cases of the engine's own operators."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators import intervals as I
from talkweave.operators import spans as S


def test_normalizer(spark):
    rows = [("um mama bank-eka giya", "mama bank eka giya"), ("podi podi", "podi podi"), ("binduwai hathai", "0 7"), ("what ,, is ?", "what, is?")]
    df = spark.createDataFrame(rows, "raw string, clean string")
    assert [r[0] for r in df.select(T.normalized(F.col("raw")).alias("x")).collect()] == [b for _, b in rows]


def test_redaction_round_trip(spark):
    docs = spark.createDataFrame([(1, "write a@b.co or c@d.org, then a@b.co"), (2, "😀 1234567890123 x"), (3, "nothing"), (4, "")], "doc_id long, text string")
    found = S.resolved(S.detected(docs, {"EMAIL": r"[a-z]+@[a-z]+\.[a-z]+", "NUMBER": "[0-9]{13}"}), ["EMAIL", "NUMBER"])
    out = S.redacted(docs, found.join(S.numbered(found), ["surface", "label"])).cache()
    assert {r["doc_id"]: r["redacted"] for r in out.collect()} == {1: "write [EMAIL_1] or [EMAIL_2], then [EMAIL_1]", 2: "😀 [NUMBER_1] x", 3: "nothing", 4: ""}
    assert {r["doc_id"]: r["restored"] for r in S.restored(out).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_range_join_gives_each_pair_once(spark):
    rng = np.random.default_rng(1)
    a = [(int(k % 3), i, int(s), int(s + d)) for i, (k, s, d) in enumerate(zip(rng.integers(0, 9, 60), rng.integers(0, 300, 60), rng.integers(1, 90, 60)))]
    left = spark.createDataFrame(a, "k int, i int, start int, end int")
    right = left.select("k", F.col("i").alias("j"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    got = sorted((r["i"], r["j"]) for r in I.range_join(left, right, ["k"], 17).collect())
    want = sorted((x[1], y[1]) for x in a for y in a if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert got == want


def test_assignment_against_all_permutations(spark):
    rng = np.random.default_rng(2)
    rows = [(c, f"r{i}", f"h{j}", float(v)) for c in range(12) for i, j, v in ((i, j, rng.integers(0, 50)) for i in range(1 + c % 4) for j in range(1 + c % 3))]
    got = {r["clip"]: r["s"] for r in I.assignment(spark.createDataFrame(rows, "clip int, ref string, hyp string, seconds double")).groupBy("clip").agg(F.sum("seconds").alias("s")).collect()}
    for c in range(12):
        m = {(i, j): v for k, i, j, v in rows if k == c}
        refs, hyps = sorted({i for i, _ in m}), sorted({j for _, j in m})
        pad = hyps + [None] * len(refs)
        best = max(sum(m.get((i, j), 0) for i, j in zip(refs, p)) for p in itertools.permutations(pad, len(refs)))
        assert got.get(c, 0) == best


def test_difference_and_union(spark):
    a = spark.createDataFrame([("c", 0, 10), ("c", 5, 12), ("c", 20, 30)], "clip string, start int, end int")
    b = spark.createDataFrame([("c", 3, 6), ("c", 25, 40)], "clip string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in I.islands(a, ["clip"]).collect()) == [(0, 12), (20, 30)]
    assert sorted((r["start"], r["end"]) for r in I.difference(a, b, ["clip"]).collect()) == [(0, 3), (6, 12), (20, 25)]


def test_numbers_run_on_over_buckets(spark):
    rows = [(d, x, s, f"{x}{(d * 7 + s) % 40}") for d in range(60) for x in "AB" for s in (0, 9)]
    found = spark.createDataFrame(rows, "doc_id long, label string, start int, surface string")
    seen, want = {}, {}
    for d, x, s, w in sorted(rows):
        if w not in want:
            seen[x] = seen.get(x, 0) + 1
            want[w] = f"[{x}_{seen[x]}]"
    for df in (found, found.withColumn("doc_id", F.format_string("d%05d", "doc_id"))):
        for width in (1, 7, 1000):
            assert {r["surface"]: r["placeholder"] for r in S.numbered(df, width).collect()} == want
