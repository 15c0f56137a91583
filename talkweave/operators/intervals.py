"""Interval algebra over DataFrames: union, difference, overlap, sweeps and speaker scoring.

Joins on overlap go through time buckets: both sides are dealt to the buckets they touch, joined
on the bucket, and a pair counts only in the first bucket that it shares, so the join is an
equi-join that spreads over the cluster and gives every pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.operators.ranks import ranked


def in_order(dealt: DataFrame, by: list[str], start: str) -> DataFrame:
    """dealt, hashed by the columns ``by`` and sorted by them, the start and all else. A sort-merge join
    keeps that order, so that in the rows of a join equal times and ids stand together and take little
    room. Spark leaves out a sort below a join unless a number that it cannot foresee is read above it.
    """
    rest = [c for c in dealt.columns if c not in (*by, start)]
    numbered = dealt.repartition(*by).sortWithinPartitions(*by, start, *rest).withColumn("n_", F.monotonically_increasing_id())
    return numbered.where("n_ >= 0").drop("n_")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of rows with equal keys whose [start, end) overlap.

    left has start and end, right has other_start and other_end; width: seconds of a bucket, about
    the length of a usual interval.
    """
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    a = left.withColumn("bucket_", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    b = right.withColumn("bucket_", F.explode(F.sequence(bucket(F.col("other_start")), bucket(F.col("other_end")))))
    meet = (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end"))
    first = F.col("bucket_") == F.greatest(bucket(F.col("start")), bucket(F.col("other_start")))
    return a.join(b, [*keys, "bucket_"]).where(meet & first).drop("bucket_")


def inside_join(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of rows with equal keys where [start, end] of left lies in [other_start, other_end] of right.

    A row of left meets all its partners in the bucket of its start, so only right is dealt to every
    bucket that it touches; a bucket several times as wide as right's intervals deals them little
    more than once.
    """
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    a = left.where(F.col("start") <= F.col("end")).withColumn("bucket_", bucket(F.col("start")))
    b = right.where(F.col("other_start") <= F.col("other_end")).withColumn("bucket_", F.explode(F.sequence(bucket(F.col("other_start")), bucket(F.col("other_end")))))
    by = [*keys, "bucket_"]
    return in_order(a, by, "start").join(in_order(b, by, "other_start"), by).where((F.col("other_start") <= F.col("start")) & (F.col("end") <= F.col("other_end"))).drop("bucket_")


def best_overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int, who: str) -> DataFrame:
    """id and ``who`` of the row of right that shares the longest time with each id of left, ties to
    the earlier start, then the smaller other_id; ids that meet no row go.

    left: keys, id, start, end; right: keys, other_id, other_start, other_end and who, times whole
    numbers. No pair is formed: in each bucket that a row touches, the best of the bucket is looked
    up in sorted orders, so the work is n log^2 n however many rows overlap. A bucket may be much
    wider than an interval, which then is rarely dealt twice.
    """
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    dealt = lambda a, b: F.explode(F.sequence(bucket(F.col(a)), bucket(F.col(b)))).alias("bucket_")
    a = left.select(*keys, dealt("start", "end"), "id", "start", "end", F.lit(None).cast(right.schema[who].dataType).alias(who), F.lit(True).alias("asks"))
    b = right.select(*keys, dealt("other_start", "other_end"), F.coalesce("other_id", F.lit((1 << 63) - 1)).alias("id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), who, F.lit(False).alias("asks"))
    kinds = {c: left.schema[c].dataType.simpleString() for c in keys} | {"id": left.schema["id"].dataType.simpleString()}

    def best(rows):
        import pyarrow as pa

        asks = rows["asks"].to_numpy()
        ask, offer = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks))
        start, end, other_start, other_end, other_id = (t[c].to_numpy() for t, c in ((ask, "start"), (ask, "end"), (offer, "start"), (offer, "end"), (offer, "id")))
        at = _best_of(start, end, other_start, other_end, other_id)
        met = at >= 0
        at = at[met]
        shared = _shared(start[met], end[met], other_start[at], other_end[at])
        return pa.table({"id": ask["id"].filter(pa.array(met)), "shared": pa.array(shared), "start": pa.array(other_start[at]), "other": pa.array(other_id[at]), who: offer[who].take(pa.array(at))})

    schema = f"id {kinds['id']}, shared long, start long, other long, `{who}` {right.schema[who].dataType.simpleString()}"
    found = a.unionByName(b).groupBy(*keys, "bucket_").applyInArrow(best, schema)
    return found.groupBy("id").agg(F.max_by(who, F.struct("shared", -F.col("start"), -F.col("other"))).alias(who))


def _shared(start, end, other_start, other_end):
    import numpy as np

    return np.minimum(end, other_end) - np.maximum(start, other_start)


def _best_of(start, end, other_start, other_end, other_id):
    """For each [start, end) the index of the other interval that shares most with it (ties: the
    earlier start, the smaller id), or -1 if it meets none.

    An interval that ends no sooner shares the more the earlier it starts; one that starts no later
    and ends sooner, the later it ends; one inside, all of its length. So there are three winners.
    """
    import numpy as np

    best, most = np.full(len(start), -1), np.zeros(len(start), np.int64)
    if not len(start) or not len(other_start):
        return best

    def offer(rows, at):
        meets = (start[rows] < other_end[at]) & (other_start[at] < end[rows])
        rows, at = rows[meets], at[meets]
        shared, old = _shared(start[rows], end[rows], other_start[at], other_end[at]), best[rows]
        earlier = (other_start[at] < other_start[old]) | ((other_start[at] == other_start[old]) & (other_id[at] < other_id[old]))
        wins = (old < 0) | (shared > most[rows]) | ((shared == most[rows]) & earlier)
        best[rows[wins]], most[rows[wins]] = at[wins], shared[wins]

    n, every = len(other_start), np.arange(len(start))
    by_start = np.lexsort((other_id, other_start))
    place = np.argsort(by_start)
    by_end = np.argsort(other_end, kind="stable")
    earliest = np.minimum.accumulate(place[by_end][::-1])[::-1]
    at = np.searchsorted(other_end[by_end], np.where(end > start, end, start + 1), "left")
    offer(every[at < n], by_start[earliest[at[at < n]]])

    late = np.lexsort((-other_id, -other_start, other_end))
    latest = np.maximum.accumulate(np.argsort(late)[by_start])
    at = np.searchsorted(other_start[by_start], start, "right")
    offer(every[at > 0], late[latest[at[at > 0] - 1]])

    part = every[(end > start) & ((best < 0) | (most < end - start))]
    low, high = np.minimum(other_start, other_end), np.maximum(other_start, other_end)
    by_low, long = np.argsort(low, kind="stable"), np.lexsort((other_id, other_start, other_start - other_end))
    rank, height = np.argsort(long)[by_low], np.argsort(np.argsort(high, kind="stable"), kind="stable")[by_low]
    first = np.searchsorted(low[by_low], start[part], "right")
    under = np.searchsorted(np.sort(high), end[part], "left")
    size = 1 << max(0, int(n - 1).bit_length())
    rank, height = (np.concatenate([x, np.full(size - n, size)]) for x in (rank, height))
    longest = np.full(len(part), size)
    k = 0
    while (1 << k) <= size and len(part):
        # blocks of 2^k in the order of low; the rest of the order from ``first`` is one block for each bit
        asks = np.flatnonzero((first < size) & ((first >> k) & 1 == 1)) if (1 << k) < size else np.flatnonzero(first == 0)
        if len(asks):
            block = np.arange(size) >> k
            key = block * (size + 1) + height
            order = np.argsort(key, kind="stable")
            least = np.minimum.accumulate(rank[order].reshape(-1, 1 << k), axis=1).ravel()
            mine = first[asks] >> k
            at = np.searchsorted(key[order], mine * (size + 1) + under[asks], "left")
            some = at > mine << k
            longest[asks[some]] = np.minimum(longest[asks[some]], least[at[some] - 1])
            first[asks] += 1 << k
        k += 1
    some = longest < n
    offer(part[some], long[longest[some]])
    return best


def islands(spans: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """Union of intervals per key; those at most ``gap`` apart become one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("reach_", F.max("end").over(before))
    marked = marked.withColumn("island_", F.sum(F.when(F.col("reach_").isNull() | (F.col("start") > F.col("reach_") + gap), 1).otherwise(0)).over(order))
    return marked.groupBy(*keys, "island_").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island_")


def merged_neighbours(spans: DataFrame, keys: list[str], who: str, gap: float) -> DataFrame:
    """Merge a segment into the one before it in time if both have one speaker and the gap is
    smaller than ``gap``; another speaker in between keeps them apart."""
    order = Window.partitionBy(*keys).orderBy("start", "end", who)
    new = (F.lag(who).over(order).isNull()) | (F.lag(who).over(order) != F.col(who)) | (F.col("start") - F.lag("end").over(order) >= gap)
    return spans.withColumn("run_", F.sum(new.cast("int")).over(order)).groupBy(*keys, who, "run_").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run_")


def sweep(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Slices between neighbouring borders with the number of intervals over each (active > 0)."""
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy(*keys, F.col("x.t").alias("start")).agg(F.sum("x.d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("start")
    out = steps.withColumn("end", F.lead("start").over(order)).withColumn("active", F.sum("d").over(order))
    return out.where("end is not null and active > 0").drop("d")


def difference(spans: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """What of the spans (a union per key) no hole covers."""
    both = spans.select(*keys, "start", "end", F.lit(1).alias("w")).unionByName(holes.select(*keys, "start", "end", F.lit(0).alias("w")))
    ends = both.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("x"), "w")
    steps = ends.groupBy(*keys, F.col("x.t").alias("start")).agg(F.sum(F.col("x.d") * F.col("w")).alias("a"), F.sum(F.col("x.d") * (1 - F.col("w"))).alias("b"))
    order = Window.partitionBy(*keys).orderBy("start")
    out = steps.withColumn("end", F.lead("start").over(order)).withColumn("in_", F.sum("a").over(order)).withColumn("out_", F.sum("b").over(order))
    return islands(out.where("end is not null and in_ > 0 and out_ = 0").select(*keys, "start", "end"), keys)


def renamed(spans: DataFrame, keys: list[str], who: str) -> DataFrame:
    """Speakers as spk01, spk02, ... by first appearance."""
    first = spans.groupBy(*keys, who).agg(F.min("start").alias("first_"))
    names = first.withColumn("name", F.format_string("spk%02d", F.row_number().over(Window.partitionBy(*keys).orderBy("first_", who)))).drop("first_")
    return spans.join(names, [*keys, who])


def assignment(cooccurrence: DataFrame, clip: str = "clip") -> DataFrame:
    """For each clip, the one-to-one mapping of hyp to ref of largest total seconds.

    cooccurrence: clip, ref, hyp, seconds; a clip's table has one row for each pair of speakers, so
    it is small, and an exact search over shortest augmenting paths runs on it.
    """
    kind = cooccurrence.schema[clip].dataType.simpleString()
    ref, hyp = (cooccurrence.schema[c].dataType.simpleString() for c in ("ref", "hyp"))

    def solve(pdf):
        import numpy as np
        import pandas as pd

        rows, cols = sorted(pdf["ref"].unique()), sorted(pdf["hyp"].unique())
        size = max(len(rows), len(cols))
        gain = np.zeros((size, size))
        for r, h, s in zip(pdf["ref"], pdf["hyp"], pdf["seconds"]):
            gain[rows.index(r), cols.index(h)] = s
        match = _best_matching(gain.max() - gain)
        found = [(pdf[clip].iloc[0], rows[i], cols[j], gain[i, j]) for i, j in enumerate(match) if i < len(rows) and j < len(cols) and gain[i, j] > 0]
        return pd.DataFrame(found, columns=[clip, "ref", "hyp", "seconds"])

    return cooccurrence.groupBy(clip).applyInPandas(solve, f"{clip} {kind}, ref {ref}, hyp {hyp}, seconds double")


def _best_matching(cost) -> list[int]:
    """Column of each row in a perfect matching of least cost: rows enter one at a time, each along
    the path of least reduced cost to a free column."""
    import numpy as np

    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for new in range(n):
        slack, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, base, col = new, 0.0, -1
        while True:
            through = base + cost[row] - row_price[row] - col_price
            better = ~done & (through < slack)
            slack[better], came[better] = through[better], col
            col = int(np.argmin(np.where(done, np.inf, slack)))
            base = slack[col]
            if owner[col] < 0:
                break
            done[col] = True
            row = owner[col]
        for c in np.flatnonzero(done):
            row_price[owner[c]] += base - slack[c]
            col_price[c] -= base - slack[c]
        row_price[new] += base
        while col >= 0:
            previous = came[col]
            owner[col] = owner[previous] if previous >= 0 else new
            col = previous
    out = [0] * n
    for c, r in enumerate(owner):
        out[r] = c
    return out


def greedy_mapping(cooccurrence: DataFrame, clip: str = "clip") -> DataFrame:
    """For each clip, pairs of ref and hyp by falling seconds (ties by ref, then hyp), each taken if
    both are still free. A clip's table has one row for each pair of speakers, so it is small."""
    kinds = ", ".join(f"{c} {cooccurrence.schema[c].dataType.simpleString()}" for c in (clip, "ref", "hyp", "seconds"))

    def pick(pdf):
        pdf = pdf[pdf["seconds"] > 0].sort_values(["seconds", "ref", "hyp"], ascending=[False, True, True])
        refs, hyps, kept = set(), set(), []
        for r, h in zip(pdf["ref"], pdf["hyp"]):
            free = r not in refs and h not in hyps
            kept.append(free)
            if free:
                refs.add(r)
                hyps.add(h)
        return pdf[kept][[clip, "ref", "hyp", "seconds"]]

    return cooccurrence.groupBy(clip).applyInPandas(pick, kinds)


def friendly_names(ref: DataFrame, hyp: DataFrame, mapping: DataFrame, clip: str = "clip") -> DataFrame:
    """clip, speaker, name for each speaker of hyp: the letter of the ref speaker that mapping (clip,
    ref, hyp) gives, by first appearance in ref, or a letter beyond those, marked as extra."""
    first = lambda df: df.groupBy(clip, "speaker").agg(F.min("start").alias("first_"))
    order = Window.partitionBy(clip).orderBy("first_", "speaker")
    letter = lambda n: F.concat(F.lit("Speaker "), F.char(n + 64))
    known = first(ref).withColumn("n_", F.row_number().over(order))
    named = known.select(clip, F.col("speaker").alias("ref"), letter(F.col("n_")).alias("name"))
    counts = known.groupBy(clip).agg(F.max("n_").alias("known_"))
    found = mapping.join(named, [clip, "ref"]).select(clip, F.col("hyp").alias("speaker"), "name")
    every = first(hyp).join(found, [clip, "speaker"], "left").join(counts, clip, "left")
    extra = F.coalesce("known_", F.lit(0)) + F.sum(F.col("name").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return every.select(clip, "speaker", F.coalesce("name", F.concat(letter(extra), F.lit(" (extra)"))).alias("name"))


def bootstrap(scores: DataFrame, clip: str, draws: int) -> DataFrame:
    """draws, low and high: the 2.5th and 97.5th percentile of the pooled rate err / total over draws
    of as many clips as there are, with replacement.

    scores: one row for each clip, with whole err and total. A linear congruential step picks the
    clips, so a draw is the same everywhere. Work is draws x clips, spread by draw.
    """
    n = scores.count()
    numbered = ranked(scores, [clip], "i_").withColumn("i_", F.col("i_") - 1)
    picks = scores.sparkSession.range(draws).select(F.col("id").alias("b_"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("k_"))
    step = ((F.col("b_") * 7919 + F.col("k_") * 104729 + 12345) * 1103515245) % 2147483648
    picked = picks.select("b_", (F.floor(step / 65536) % max(n, 1)).cast("int").alias("i_"))
    rates = picked.join(numbered, "i_").groupBy("b_").agg((F.sum("err") / F.sum("total")).alias("m_"))
    return rates.agg(F.count("*").alias("draws"), F.round(F.percentile("m_", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m_", F.lit(0.975)), 6).alias("high"))


def seconds(ts: Column) -> Column:
    """A timestamp as seconds since the epoch."""
    return F.unix_micros(ts) / F.lit(1e6)
