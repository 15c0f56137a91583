"""Scores and lookups in time: errors near switches, scores at several collars, the nearest known
speaker; and an inventory of files. Days are clips, minutes are frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.plans.intervallic import SEG, hypothesis, segments
from talkweave.plans.registry import load, register
from talkweave.session import scratch
from talkweave.sources.readers import inventory

MINUTE = 60_000_000
FRAMES = f"""{SEG}, r AS (SELECT DISTINCT clip, unnest(range(s // 60000000, e // 60000000 + 1)) AS frame FROM seg), h AS (SELECT DISTINCT clip, unnest(range(s // 60000000, e // 60000000 + 1)) AS frame FROM hyp),
f AS (SELECT clip, frame, r.frame IS NOT NULL AS ref, h.frame IS NOT NULL AS hyp FROM (SELECT clip, frame, frame AS rf FROM r) r FULL JOIN (SELECT clip, frame, frame AS hf FROM h) h USING (clip, frame))"""
FRAMES = FRAMES.replace("r.frame IS NOT NULL AS ref, h.frame IS NOT NULL AS hyp", "rf IS NOT NULL AS ref, hf IS NOT NULL AS hyp")


def frames(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """clip, frame, ref, hyp: for each minute in which either timeline has speech, which of them does."""
    cut = lambda df: df.select("clip", F.explode(F.sequence(F.expr(f"start div {MINUTE}"), F.expr(f"`end` div {MINUTE}"))).alias("frame"))
    both = cut(ref).withColumn("ref", F.lit(True)).withColumn("hyp", F.lit(False)).unionAll(cut(hyp).withColumn("ref", F.lit(False)).withColumn("hyp", F.lit(True)))
    return both.groupBy("clip", "frame").agg(F.bool_or("ref").alias("ref"), F.bool_or("hyp").alias("hyp"))


def around(marks: DataFrame, reach: int, name: str) -> DataFrame:
    """The frames within ``reach`` of a mark (clip, frame), each once, with ``name`` true."""
    return marks.select("clip", F.explode(F.sequence(F.col("frame") - reach, F.col("frame") + reach)).alias("frame")).distinct().withColumn(name, F.lit(True))


def near_and_far(scored: DataFrame, switches: DataFrame, changes: DataFrame, reach: int) -> DataFrame:
    """Frames and wrong frames (scored: clip, frame, wrong) near a language switch and far from all,
    for each clip; frames within reach of a speaker change are left out. Equi-joins on frames only."""
    left = scored.join(around(changes, reach, "change_"), ["clip", "frame"], "left_anti").join(around(switches, reach, "near_"), ["clip", "frame"], "left")
    near = F.coalesce("near_", F.lit(False))
    return left.groupBy("clip").agg(
        F.count_if(near).alias("near"), F.count_if(near & F.col("wrong")).alias("near_wrong"), F.count_if(~near).alias("far"), F.count_if(~near & F.col("wrong")).alias("far_wrong"),
    )


@register(
    "I17_switch_confusion",
    f"""WITH {FRAMES}, sw AS (SELECT DISTINCT clip, s // 60000000 AS frame FROM seg WHERE speaker = 'purchase'), ch AS (SELECT DISTINCT clip, s // 60000000 AS frame FROM hyp WHERE speaker = 'h0'),
    x AS (SELECT f.*, EXISTS (SELECT 1 FROM sw WHERE sw.clip = f.clip AND abs(sw.frame - f.frame) <= 1) AS near FROM f WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.clip = f.clip AND abs(ch.frame - f.frame) <= 1))
    SELECT clip, count(*) FILTER (near) AS near, count(*) FILTER (near AND ref <> hyp) AS near_wrong, count(*) FILTER (NOT near) AS far, count(*) FILTER (NOT near AND ref <> hyp) AS far_wrong FROM x GROUP BY clip""",
)
def switch_confusion(spark, sf_dir):
    """Purchases stand for switches and speaker h0 for changes of speaker."""
    ref, hyp = segments(spark, sf_dir), hypothesis(spark, sf_dir)
    at = lambda df: df.select("clip", F.expr(f"start div {MINUTE}").alias("frame"))
    scored = frames(ref, hyp).withColumn("wrong", F.col("ref") != F.col("hyp"))
    return near_and_far(scored, at(ref.where("speaker = 'purchase'")), at(hyp.where("speaker = 'h0'")), 1)


def at_collars(ref: DataFrame, hyp: DataFrame, collars: list[int]) -> DataFrame:
    """Frames that both timelines have, that hyp misses and that it has alone, for each clip and
    collar; frames within the collar of a bound of ref are not scored (a collar of 0 leaves none out)."""
    bounds = ref.select("clip", F.explode(F.array(F.expr(f"start div {MINUTE}"), F.expr(f"`end` div {MINUTE}"))).alias("frame")).distinct()
    wide = max(collars)
    off = F.explode(F.sequence(F.lit(-wide), F.lit(wide)))
    near = bounds.select("clip", "frame", off.alias("off")).select("clip", (F.col("frame") + F.col("off")).alias("frame"), F.abs("off").alias("off")).groupBy("clip", "frame").agg(F.min("off").alias("off"))
    f = frames(ref, hyp).join(near, ["clip", "frame"], "left").withColumn("collar", F.explode(F.array(*[F.lit(c) for c in collars])))
    f = f.where((F.col("collar") == 0) | F.col("off").isNull() | (F.col("off") > F.col("collar")))
    return f.groupBy("clip", "collar").agg(F.count_if(F.col("ref") & F.col("hyp")).alias("both"), F.count_if(F.col("ref") & ~F.col("hyp")).alias("missed"), F.count_if(~F.col("ref") & F.col("hyp")).alias("false_alarm"))


@register(
    "M6_two_collars",
    f"""WITH {FRAMES}, b AS (SELECT clip, s // 60000000 AS frame FROM seg UNION SELECT clip, e // 60000000 FROM seg), c AS (SELECT unnest([0, 1]) AS collar)
    SELECT f.clip, collar, count(*) FILTER (ref AND hyp) AS both, count(*) FILTER (ref AND NOT hyp) AS missed, count(*) FILTER (hyp AND NOT ref) AS false_alarm
    FROM f, c WHERE collar = 0 OR NOT EXISTS (SELECT 1 FROM b WHERE b.clip = f.clip AND abs(b.frame - f.frame) <= collar) GROUP BY f.clip, collar""",
)
def two_collars(spark, sf_dir):
    return at_collars(segments(spark, sf_dir), hypothesis(spark, sf_dir), [0, 1])


def nearest_known(df: DataFrame, group: str, time: str, order: str, speaker: str) -> DataFrame:
    """df with ``near_speaker``: the speaker itself where it is known, else that of the nearest row
    in time with a known one in the group (the earlier one of equally near), else null."""
    w = Window.partitionBy(group).orderBy(time, order)
    known = F.when(F.col(speaker).isNotNull(), F.struct(F.col(time).alias("t"), F.col(speaker).alias("who")))
    before, after = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumns({"before_": before, "after_": after})
    later = F.col("before_").isNull() | (F.col("after_.t") - F.col(time) < F.col(time) - F.col("before_.t"))
    return out.withColumn("near_speaker", F.when(F.col("after_").isNotNull() & later, F.col("after_.who")).otherwise(F.col("before_.who"))).drop("before_", "after_")


@register(
    "M17_nearest_known",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_type <> 'error' THEN event_type END AS who FROM events),
    n AS (SELECT a.event_id, a.user_id, b.who, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t - a.t), (b.t, b.event_id) > (a.t, a.event_id), CASE WHEN (b.t, b.event_id) > (a.t, a.event_id) THEN b.t ELSE -b.t END, CASE WHEN (b.t, b.event_id) > (a.t, a.event_id) THEN b.event_id ELSE -b.event_id END) AS rn
          FROM e a JOIN e b ON a.user_id = b.user_id AND b.who IS NOT NULL WHERE a.who IS NULL)
    SELECT e.event_id, e.user_id, coalesce(e.who, n.who) AS near_speaker FROM e LEFT JOIN n ON n.event_id = e.event_id AND n.rn = 1""",
)
def nearest_known_speaker(spark, sf_dir):
    """Errors have no known speaker; they take that of the user's nearest event that has one."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("who"))
    return nearest_known(e, "user_id", "t", "event_id", "who").select("event_id", "user_id", "near_speaker")


@register("S15_inventory", """SELECT CAST(user_id % 20 AS VARCHAR) AS id, bool_or(event_type = 'click') AS click, bool_or(event_type = 'purchase') AS purchase, bool_or(event_type = 'error' AND user_id % 20 < 15) AS error
    FROM events WHERE event_type IN ('click', 'purchase') OR event_type = 'error' AND user_id % 20 < 15 GROUP BY user_id % 20""")
def inventory_of_layers(spark, sf_dir):
    """Which layers of each recording have a file; the paths carry the id and the layer."""
    path = scratch(spark, "layers")
    e = load(spark, sf_dir, "events").where("event_type in ('click', 'purchase') or event_type = 'error' and user_id % 20 < 15")
    e.select((F.col("user_id") % 20).alias("recording"), F.col("event_type").alias("layer"), "event_id").repartition("recording", "layer").write.partitionBy("recording", "layer").json(path)
    layers = ["click", "purchase", "error"]
    found = inventory(spark, path, r"recording=(\d+)/layer=(\w+)/", layers)
    return found.select("id", *[F.col(x).isNotNull().alias(x) for x in layers])
