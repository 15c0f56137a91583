"""Speaker timelines: on these tables a day is a clip, an event's type its speaker, its time the
start and its value the length; times are whole microseconds, so both engines agree exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkweave.operators import intervals as I
from talkweave.operators.ranks import ranked
from talkweave.plans.registry import load, register

SECOND = 1_000_000


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference timeline: event_id, clip, speaker, start, end."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("clip"), F.col("event_type").alias("speaker"), start.alias("start"), (start + F.round(F.col("value") * 100).cast("long") * 100_000).alias("end"))


def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second timeline of the same clips: three speakers, five seconds late."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("clip"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("speaker"), (start + 5 * SECOND).alias("start"), (start + 5 * SECOND + F.round(F.col("value") * 100).cast("long") * 100_000).alias("end"))


SEG = """seg AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS clip, event_type AS speaker, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 100000 AS e FROM events),
hyp AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS clip, 'h' || (user_id % 3) AS speaker, epoch_us(ts) + 5000000 AS s, epoch_us(ts) + 5000000 + CAST(round(value * 100) AS BIGINT) * 100000 AS e FROM events)"""
ISLES = """m AS (SELECT *, max(e) OVER (PARTITION BY clip ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
isles AS (SELECT clip, min(s) AS s, max(e) AS e FROM k GROUP BY clip, island)"""


@register("I1_union", f"WITH {SEG}, {ISLES} SELECT clip, s AS \"start\", e AS \"end\" FROM isles")
def union(spark, sf_dir):
    return I.islands(segments(spark, sf_dir), ["clip"])


MERGE = """r AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker OR s - lag(e) OVER w >= 300000000 THEN 1 ELSE 0 END AS new FROM {src} WINDOW w AS (PARTITION BY clip ORDER BY s, e, speaker)),
q AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY s, e, speaker ROWS UNBOUNDED PRECEDING) AS run FROM r)"""


@register("I2_merge_close", f"WITH {SEG}, {MERGE.format(src='seg')} SELECT clip, speaker, min(s) AS \"start\", max(e) AS \"end\" FROM q GROUP BY clip, speaker, run")
def merge_close(spark, sf_dir):
    return I.merged_neighbours(segments(spark, sf_dir).select("clip", "speaker", "start", "end"), ["clip"], "speaker", 300 * SECOND)


@register("I3_drop_flicker", f"WITH {SEG}, f AS (SELECT * FROM seg WHERE e - s >= 10000000), {MERGE.format(src='f')} SELECT clip, speaker, min(s) AS \"start\", max(e) AS \"end\" FROM q GROUP BY clip, speaker, run")
def drop_flicker(spark, sf_dir):
    s = segments(spark, sf_dir).select("clip", "speaker", "start", "end").where(F.col("end") - F.col("start") >= 10 * SECOND)
    return I.merged_neighbours(s, ["clip"], "speaker", 300 * SECOND)


@register(
    "I4_difference",
    f"""WITH {SEG}, b AS (SELECT clip, s AS t FROM seg UNION SELECT clip, e FROM seg UNION SELECT clip, s FROM hyp UNION SELECT clip, e FROM hyp), sl AS (SELECT clip, t AS s, lead(t) OVER (PARTITION BY clip ORDER BY t) AS e FROM b)
        SELECT clip, CAST(sum(e - s) AS BIGINT) AS uncovered FROM sl WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM seg x WHERE x.clip = sl.clip AND x.s <= sl.s AND x.e >= sl.e) AND NOT EXISTS (SELECT 1 FROM hyp x WHERE x.clip = sl.clip AND x.s <= sl.s AND x.e >= sl.e) GROUP BY clip""",
)
def difference(spark, sf_dir):
    """Reference speech that the hypothesis does not cover, in each clip."""
    out = I.difference(segments(spark, sf_dir), hypothesis(spark, sf_dir), ["clip"])
    return out.groupBy("clip").agg(F.sum(F.col("end") - F.col("start")).alias("uncovered"))


def _other(df: DataFrame) -> DataFrame:
    return df.select("clip", F.col("event_id").alias("other_id"), F.col("speaker").alias("other_speaker"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))


@register("I5_intersection", f"WITH {SEG} SELECT a.clip, a.event_id, b.event_id AS other_id, greatest(a.s, b.s) AS \"start\", least(a.e, b.e) AS \"end\" FROM seg a JOIN hyp b ON a.clip = b.clip AND a.s < b.e AND b.s < a.e")
def intersection(spark, sf_dir):
    """The buckets are about three usual events wide, so that few are dealt twice."""
    pairs = I.range_join(segments(spark, sf_dir), _other(hypothesis(spark, sf_dir)), ["clip"], 1800 * SECOND)
    return pairs.select("clip", "event_id", "other_id", F.greatest("start", "other_start").alias("s_"), F.least("end", "other_end").alias("end")).withColumnRenamed("s_", "start")


@register("I6_speaker_overlap", f"WITH {SEG} SELECT a.clip, a.event_id, b.event_id AS other_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM seg a JOIN seg b ON a.clip = b.clip AND a.event_id < b.event_id AND a.speaker <> b.speaker AND a.s < b.e AND b.s < a.e")
def speaker_overlap(spark, sf_dir):
    s = segments(spark, sf_dir)
    pairs = I.range_join(s, _other(s), ["clip"], 200 * SECOND).where("event_id < other_id and speaker <> other_speaker")
    return pairs.select("clip", "event_id", "other_id", (F.least("end", "other_end") - F.greatest("start", "other_start")).alias("overlap"))


SWEEP = """ev AS (SELECT clip, s AS t, 1 AS d FROM seg UNION ALL SELECT clip, e, -1 FROM seg), st AS (SELECT clip, t, sum(d) AS d FROM ev GROUP BY clip, t),
sw AS (SELECT clip, t AS s, lead(t) OVER (PARTITION BY clip ORDER BY t) AS e, sum(d) OVER (PARTITION BY clip ORDER BY t) AS active FROM st)"""


@register("I7_concurrency", f"WITH {SEG}, {SWEEP} SELECT clip, CAST(active AS BIGINT) AS active, CAST(sum(e - s) AS BIGINT) AS time FROM sw WHERE e IS NOT NULL AND active > 0 GROUP BY clip, active")
def concurrency(spark, sf_dir):
    return I.sweep(segments(spark, sf_dir), ["clip"]).groupBy("clip", "active").agg(F.sum(F.col("end") - F.col("start")).alias("time"))


@register("I8_backchannels", f"WITH {SEG} SELECT event_id, EXISTS (SELECT 1 FROM seg b WHERE b.clip = a.clip AND b.speaker <> a.speaker AND b.s <= a.s AND b.e >= a.e) AS backchannel FROM seg a WHERE a.e - a.s <= 10000000")
def backchannels(spark, sf_dir):
    """Short segments: inside another speaker's segment (backchannel) or not (acknowledgment)."""
    s = segments(spark, sf_dir)
    short = s.where(F.col("end") - F.col("start") <= 10 * SECOND)
    inside = I.range_join(short, _other(s), ["clip"], 200 * SECOND).where("speaker <> other_speaker and other_start <= start and other_end >= end").select("event_id").distinct().withColumn("yes", F.lit(True))
    return short.join(inside, "event_id", "left").select("event_id", F.coalesce("yes", F.lit(False)).alias("backchannel"))


@register("I9_rename", f"WITH {SEG}, f AS (SELECT clip, speaker, row_number() OVER (PARTITION BY clip ORDER BY min(s), speaker) AS n FROM seg GROUP BY clip, speaker) SELECT event_id, printf('spk%02d', n) AS name FROM seg JOIN f USING (clip, speaker)")
def rename(spark, sf_dir):
    return I.renamed(segments(spark, sf_dir), ["clip"], "speaker").select("event_id", "name")


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = I.range_join(segments(spark, sf_dir), _other(hypothesis(spark, sf_dir)), ["clip"], 200 * SECOND)
    shared = (F.least("end", "other_end") - F.greatest("start", "other_start")) / SECOND
    return pairs.groupBy("clip", F.col("speaker").alias("ref"), F.col("other_speaker").alias("hyp")).agg(F.round(F.sum(shared), 6).alias("seconds"))


@register("I10_cooccurrence", f"WITH {SEG} SELECT a.clip, a.speaker AS ref, b.speaker AS hyp, round(sum((least(a.e, b.e) - greatest(a.s, b.s)) / 1000000.0), 6) AS seconds FROM seg a JOIN hyp b ON a.clip = b.clip AND a.s < b.e AND b.s < a.e GROUP BY ALL")
def cooccurrence_query(spark, sf_dir):
    return cooccurrence(spark, sf_dir)


BEST = """co AS (SELECT a.clip, a.speaker AS ref, b.speaker AS hyp, sum((least(a.e, b.e) - greatest(a.s, b.s)) / 1000000.0) AS v FROM seg a JOIN hyp b ON a.clip = b.clip AND a.s < b.e AND b.s < a.e GROUP BY ALL),
full_ AS (SELECT c.clip, r.ref, h.hyp, coalesce(co.v, 0) AS v FROM (SELECT DISTINCT clip FROM co) c, (SELECT DISTINCT speaker AS ref FROM seg) r, (SELECT DISTINCT speaker AS hyp FROM hyp) h LEFT JOIN co ON co.clip = c.clip AND co.ref = r.ref AND co.hyp = h.hyp),
tri AS (SELECT x.clip, x.v + y.v + z.v AS total FROM full_ x JOIN full_ y ON x.clip = y.clip AND y.hyp = 'h1' AND y.ref <> x.ref JOIN full_ z ON x.clip = z.clip AND z.hyp = 'h2' AND z.ref <> x.ref AND z.ref <> y.ref WHERE x.hyp = 'h0')"""


@register("I11_assignment", f"WITH {SEG}, {BEST} SELECT clip, round(max(total), 4) AS mapped_seconds FROM tri GROUP BY clip")
def assignment(spark, sf_dir):
    """Seconds on which the best one-to-one mapping of speakers agrees."""
    return I.assignment(cooccurrence(spark, sf_dir)).groupBy("clip").agg(F.round(F.sum("seconds"), 4).alias("mapped_seconds"))


@register("I15_turns", f"WITH {SEG} SELECT event_id, clip, speaker, e - s AS duration, EXISTS (SELECT 1 FROM seg b WHERE b.clip = a.clip AND b.speaker <> a.speaker AND b.s < a.e AND a.s < b.e) AS overlapped FROM seg a")
def turns(spark, sf_dir):
    s = segments(spark, sf_dir)
    hit = I.range_join(s, _other(s), ["clip"], 200 * SECOND).where("speaker <> other_speaker").select("event_id").distinct().withColumn("yes", F.lit(True))
    return s.join(hit, "event_id", "left").select("event_id", "clip", "speaker", (F.col("end") - F.col("start")).alias("duration"), F.coalesce("yes", F.lit(False)).alias("overlapped"))


@register("M5_talk_time", f"WITH {SEG}, t AS (SELECT clip, speaker, CAST(sum(e - s) AS BIGINT) AS time FROM seg GROUP BY clip, speaker) SELECT *, round(time / sum(time) OVER (PARTITION BY clip), 6) AS share FROM t")
def talk_time(spark, sf_dir):
    t = segments(spark, sf_dir).groupBy("clip", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("time"))
    return t.withColumn("share", F.round(F.col("time") / F.sum("time").over(Window.partitionBy("clip")), 6))


@register(
    "L7_align_by_overlap",
    f"WITH {SEG}, p AS (SELECT a.event_id, b.speaker AS aligned, row_number() OVER (PARTITION BY a.event_id ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, b.s, b.event_id) AS rn FROM seg a JOIN hyp b ON a.clip = b.clip AND a.s < b.e AND b.s < a.e) SELECT event_id, aligned FROM p WHERE rn = 1",
)
def align_by_overlap(spark, sf_dir):
    """For each segment the hypothesis segment of largest overlap, ties to the earlier one."""
    s = segments(spark, sf_dir).withColumnRenamed("event_id", "id")
    return I.best_overlaps(s, _other(hypothesis(spark, sf_dir)), ["clip"], 4 * 3600 * SECOND, "other_speaker").select(F.col("id").alias("event_id"), F.col("other_speaker").alias("aligned"))


@register("W7_speaker_at", f"WITH {SEG}, q AS (SELECT clip, min(s) + i * 3600000000 AS t FROM seg, range(0, 24) r(i) GROUP BY clip, i), n AS (SELECT q.clip, t, speaker, row_number() OVER (PARTITION BY q.clip, t ORDER BY greatest(s - t, t - e, 0), s, event_id) AS rn FROM q JOIN seg ON seg.clip = q.clip) SELECT clip, t, speaker FROM n WHERE rn = 1")
def speaker_at(spark, sf_dir):
    """The speaker at each full hour of a clip: of the segment that holds it, else the nearest."""
    s = segments(spark, sf_dir)
    q = s.groupBy("clip").agg(F.min("start").alias("first")).select("clip", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"), "first").select("clip", (F.col("first") + F.col("i").cast("long") * 3600 * SECOND).alias("t"))
    far = F.greatest(F.col("start") - F.col("t"), F.col("t") - F.col("end"), F.lit(0).cast("long"))
    return s.join(F.broadcast(q), "clip").groupBy("clip", "t").agg(F.min_by("speaker", F.struct(far, "start", "event_id")).alias("speaker"))


@register("I13_frames", f"WITH {SEG}, {ISLES}, h2 AS (SELECT DISTINCT clip, unnest(range(s // 60000000, e // 60000000 + 1)) AS frame FROM hyp), r2 AS (SELECT DISTINCT clip, unnest(range(s // 60000000, e // 60000000 + 1)) AS frame FROM seg) SELECT clip, count(*) FILTER (r2.frame IS NOT NULL AND h2.frame IS NOT NULL) AS both, count(*) FILTER (h2.frame IS NULL) AS missed, count(*) FILTER (r2.frame IS NULL) AS false_alarm FROM r2 FULL JOIN h2 USING (clip, frame) GROUP BY clip")
def frames(spark, sf_dir):
    """Minutes with speech in both timelines, only in the reference, only in the hypothesis."""
    cut = lambda df: df.select("clip", F.explode(F.sequence(F.expr("start div 60000000"), F.expr("`end` div 60000000"))).alias("frame")).distinct()
    r, h = cut(segments(spark, sf_dir)).withColumn("r", F.lit(1)), cut(hypothesis(spark, sf_dir)).withColumn("h", F.lit(1))
    return r.join(h, ["clip", "frame"], "full").groupBy("clip").agg(F.expr("count_if(r = 1 and h = 1) as both"), F.expr("count_if(h is null) as missed"), F.expr("count_if(r is null) as false_alarm"))


@register("I19_sessions", "WITH g AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000 THEN 0 ELSE 1 END AS new, event_id FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session")
def sessions(spark, sf_dir):
    """Events of a user at most two hours apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.when(t - F.lag(t).over(order) <= 7200 * SECOND, 0).otherwise(1)
    return load(spark, sf_dir, "events").withColumn("new", new).withColumn("session", F.sum("new").over(order)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("I21_fill", "SELECT event_id, user_id, coalesce(last_value(CASE WHEN value > 30 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(CASE WHEN value > 30 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM events")
def fill(spark, sf_dir):
    """Unsure values (30 or less) take the sure one before them, else the next."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sure = F.when(F.col("value") > 30, F.col("value"))
    before = F.last(sure, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(sure, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(before, after).alias("filled"))


@register("I22_split", "WITH c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, percent_rank() OVER (ORDER BY md5(CAST(conv_id AS VARCHAR))) AS p FROM c) SELECT conv_id, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'dev' ELSE 'test' END AS split FROM r")
def split(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = ranked(c.withColumn("digest", F.md5(F.col("conv_id").cast("string").cast("binary"))), ["digest"], "rn", F.rank())
    others = F.greatest(c.agg((F.count("*") - 1).alias("others")).scalar(), F.lit(1))
    return c.withColumn("p", (F.col("rn") - 1) / others).select("conv_id", F.expr("case when p < 0.8 then 'train' when p < 0.9 then 'dev' else 'test' end as split"))


@register("I23_inside", f"WITH {SEG}, {ISLES} SELECT h.clip, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM isles i WHERE i.clip = h.clip AND i.s <= (h.s + h.e) // 2 AND i.e > (h.s + h.e) // 2)) AS inside FROM hyp h GROUP BY h.clip")
def inside(spark, sf_dir):
    """Hypothesis segments whose middle lies in reference speech."""
    h = hypothesis(spark, sf_dir).withColumn("mid", F.expr("(start + `end`) div 2")).select("clip", "event_id", F.col("mid").alias("start"), (F.col("mid") + 1).alias("end"))
    isles = I.islands(segments(spark, sf_dir), ["clip"]).select("clip", F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    hit = I.range_join(h, isles, ["clip"], 600 * SECOND).select("event_id").distinct().withColumn("yes", F.lit(1))
    return h.join(hit, "event_id", "left").groupBy("clip").agg(F.count("*").alias("n"), F.count("yes").alias("inside"))


@register("I25_leave_one_out", "WITH k AS (SELECT event_type AS grp, user_id % 5 AS arm, sum(value) AS err, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT arm, sum(err) AS err, sum(n) AS n FROM k GROUP BY arm), o AS (SELECT k.grp, k.arm, (t.err - k.err) / (t.n - k.n) AS rest FROM k JOIN t USING (arm)) SELECT grp, arm FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rest, arm) AS rn FROM o) WHERE rn = 1")
def leave_one_out(spark, sf_dir):
    """For each held-out group the arm of least pooled error on the others."""
    k = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp"), (F.col("user_id") % 5).alias("arm")).agg(F.sum("value").alias("err"), F.count("*").alias("n"))
    w = Window.partitionBy("arm")
    rest = (F.sum("err").over(w) - F.col("err")) / (F.sum("n").over(w) - F.col("n"))
    return k.withColumn("rest", rest).groupBy("grp").agg(F.min_by("arm", F.struct("rest", "arm")).alias("arm"))


@register("I26_every_seed", "WITH r AS (SELECT event_type AS arm, user_id % 3 AS seed, avg(value) AS v FROM events GROUP BY ALL) SELECT a.arm, b.arm AS against, max(a.v) < min(b.v) AS every FROM r a JOIN r b ON a.arm <> b.arm GROUP BY a.arm, b.arm")
def every_seed(spark, sf_dir):
    """Whether every seed of one arm beats every seed of another."""
    r = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("v")).groupBy("arm").agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    a, b = r.select("arm", "hi"), r.select(F.col("arm").alias("against"), "lo")
    return a.join(F.broadcast(b), F.col("arm") != F.col("against")).select("arm", "against", (F.col("hi") < F.col("lo")).alias("every"))


@register("X4_sliding_windows", "WITH w AS (SELECT event_type, value, unnest([(epoch_us(ts) // 300000000) * 300000000, (epoch_us(ts) // 300000000) * 300000000 - 300000000]) AS w FROM events) SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def sliding(spark, sf_dir):
    """Ten-minute windows every five minutes."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "10 minutes", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("window_start"), "event_type", "n", "total")
