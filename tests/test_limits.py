"""Joins of pairs against brute force, and what they shuffle in proportion to their input."""

import datetime
import random

import numpy as np
import pytest

from talkweave.operators import intervals, similarity


def shuffled(spark, run) -> int:
    """Bytes that a call's stages write to shuffles if no table is small enough to be broadcast."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return written() - before


def near_sets(seed: int, n: int) -> list[tuple[int, list[str]]]:
    """Sets of 3 to 120 words, some frequent; six of ten are changed copies of another."""
    r, rows = random.Random(seed), []
    for i in range(n):
        if rows and r.random() < 0.6:
            s = set(r.choice(rows)[1])
            for _ in range(r.randint(0, len(s) // 2)):
                if r.random() < 0.5:
                    s.discard(r.choice(sorted(s)))
                else:
                    s.add(f"w{r.randint(0, 60 if r.random() < 0.5 else 4000)}")
        else:
            s = {f"w{int(4000 * r.random() ** 4)}" for _ in range(r.choice([3, 8, 30, 120]))}
        rows.append((i * 7919 % 1009, sorted(s)))
    return rows


@pytest.mark.parametrize("least,block", [(0.5, 60), (0.5, 16384), (0.8, 60)])
def test_similar_sets_against_brute_force(spark, least, block):
    rows, classes = near_sets(4, 400), {}
    for i, s in rows:
        classes.setdefault(tuple(s), []).append(i)
    k = [(min(ids), set(s)) for s, ids in classes.items() if s]
    want = sorted((min(i, j), max(i, j), round(len(x & y) / len(x | y), 9)) for n, (i, x) in enumerate(k) for j, y in k[:n] if len(x & y) / len(x | y) >= least)
    df = spark.createDataFrame([*rows, (5000, []), (5001, None), (None, ["w1"])], "id long, set array<string>")
    assert want and sorted((r["a"], r["b"], round(r["jaccard"], 9)) for r in similarity.similar_sets(df, least, block).collect()) == want


def test_codes_that_collide_make_no_pair(spark, monkeypatch):
    """Equal codes of different tokens only add candidates: with four codes for all tokens nothing changes."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(near_sets(5, 120), "id long, set array<string>")
    want = sorted(map(tuple, similarity.similar_sets(df, 0.5).collect()))
    real = F.hash
    monkeypatch.setattr(F, "hash", lambda x: real(x) % 4)
    assert want and sorted(map(tuple, similarity.similar_sets(df, 0.5).collect())) == want


def test_similar_turns_shuffle_no_candidates(spark, tmp_path):
    """Turns that share many words and are not similar: what is shuffled stays below twice the text."""
    from talkweave.plans import registry

    r = random.Random(6)
    rows = [(i, 0, "user", " ".join(r.sample([f"word{k}" for k in range(400)], 60))) for i in range(1500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert shuffled(spark, lambda: registry.queries()["E12_similar_turns"](spark, str(tmp_path)).collect()) < 2 * sum(len(x[3]) for x in rows)


def events(spark, path: str, n: int, longest: float) -> None:
    """n events of one day, each of up to ``longest`` seconds."""
    r = random.Random(7)
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(seconds=r.randint(0, 60_000)), i % 7, r.choice(["view", "error"]), r.uniform(0, longest / 10)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")


def test_best_of_overlaps_against_brute_force():
    """Empty, reversed, equal and touching intervals too."""
    r = np.random.default_rng(1)
    for _ in range(1500):
        n, m, t = r.integers(0, 9), r.integers(0, 20), r.choice([6, 20, 1000])
        start, other_start, ids = r.integers(0, t, n), r.integers(0, t, m), r.permutation(m)
        end, other_end = start + r.integers(-2, t // 2, n), other_start + r.integers(-2, t // 2, m)
        got = intervals._best_of(start, end, other_start, other_end, ids)
        for i in range(n):
            met = [(max(start[i], other_start[j]) - min(end[i], other_end[j]), other_start[j], ids[j], j) for j in range(m) if start[i] < other_end[j] and other_start[j] < end[i]]
            assert got[i] == (min(met)[3] if met else -1)


def test_align_by_overlap_deals_long_events_few_times(spark, tmp_path):
    from talkweave.plans import registry

    events(spark, str(tmp_path), 3000, 20_000)
    assert shuffled(spark, lambda: registry.queries()["L7_align_by_overlap"](spark, str(tmp_path)).collect()) < 300 * 3000


def test_inside_join_against_brute_force(spark):
    r = np.random.default_rng(3)
    a = [(int(k), i, int(s), int(s + d)) for i, (k, s, d) in enumerate(zip(r.integers(0, 3, 80), r.integers(0, 300, 80), r.integers(-2, 40, 80)))]
    b = [(int(k), i, int(s), int(s + d)) for i, (k, s, d) in enumerate(zip(r.integers(0, 3, 60), r.integers(0, 300, 60), r.integers(0, 90, 60)))]
    left, right = spark.createDataFrame(a, "k int, i int, start int, end int"), spark.createDataFrame(b, "k int, j int, other_start int, other_end int")
    for width in (7, 50, 1000):
        got = sorted((x["i"], x["j"]) for x in intervals.inside_join(left, right, ["k"], width).collect())
        assert got == sorted((i, j) for k, i, s, e in a for q, j, t, f in b if k == q and t <= s <= e <= f)


def test_clip_tokens_deal_each_token_once(spark, tmp_path):
    """Tokens too long for any clip are not shuffled, the others once, however many buckets they touch."""
    from talkweave.plans import registry

    events(spark, str(tmp_path), 3000, 20_000)
    assert shuffled(spark, lambda: registry.queries()["M1_clip_tokens"](spark, str(tmp_path)).collect()) < 60 * 3000


def test_rows_of_clip_tokens_come_in_order(spark, tmp_path):
    """The clips of a token stand together by their time, so that copies take little room where they are written."""
    from itertools import groupby

    from talkweave.plans import registry

    events(spark, str(tmp_path), 3000, 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [(r["token"], r["start"]) for r in registry.queries()["M1_clip_tokens"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs = [(token, [s for _, s in rows]) for token, rows in groupby(got, lambda r: r[0])]
    assert len(runs) == len({token for token, _ in runs}) > 1000 and all(s == sorted(s, reverse=True) for _, s in runs)


def test_intersection_deals_events_few_times(spark, tmp_path):
    from talkweave.plans import registry

    events(spark, str(tmp_path), 3000, 5600)
    run = lambda: registry.queries()["I5_intersection"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert shuffled(spark, run) < 200 * 3000
