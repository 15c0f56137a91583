"""Readers and writers on files that the query writes first, and live operators replayed on a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.operators import sequential as Q
from talkweave.operators import spans as S
from talkweave.plans.registry import load, register
from talkweave.plans.relational import SPANS, spans
from talkweave.session import scratch
from talkweave.sources import readers as R
from talkweave.streaming import live


@register("S2_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark, sf_dir):
    path = scratch(spark, "jsonl")
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c.write.json(path)
    return R.jsonl(spark, path, "conv_id long, turn long, role string, text string")


@register("S11_rttm", "SELECT 'c' || (user_id % 5) AS clip, event_type AS speaker, round(event_id * CAST(1.5 AS DOUBLE), 3) AS \"start\", round(event_id * CAST(1.5 AS DOUBLE) + round(value, 1), 3) AS \"end\" FROM events WHERE round(value, 1) > 0")
def rttm(spark, sf_dir):
    """Segments written as RTTM lines come back; those without length don't."""
    path = scratch(spark, "rttm")
    start = F.col("event_id") * 1.5
    R.write_rttm(load(spark, sf_dir, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("clip"), F.col("event_type").alias("speaker"), start.alias("start"), (start + F.round("value", 1)).alias("end")), path)
    return R.rttm(spark, path).select("clip", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register("S12_label_tracks", "SELECT event_type AS label, CAST(event_id AS DOUBLE) AS \"start\", CAST(event_id + 2 AS DOUBLE) AS \"end\" FROM events")
def label_tracks(spark, sf_dir):
    """Lines with bounds in either order and either separator."""
    path = scratch(spark, "labels")
    odd = F.col("event_id") % 2 == 1
    a, b = F.col("event_id").cast("string"), (F.col("event_id") + 2).cast("string")
    sep = F.when(F.col("event_id") % 3 == 0, "\t").otherwise(" ")
    line = F.concat(F.when(odd, b).otherwise(a), sep, F.when(odd, a).otherwise(b), sep, F.col("event_type"))
    load(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return R.label_track(spark, path).select("label", "start", "end")


@register("S1_translations", "SELECT CAST(turn AS VARCHAR) AS utt_id, text AS clean_en FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def translations(spark, sf_dir):
    """The turns of one recording, written as one JSON document."""
    path = scratch(spark, "translations")
    c = load(spark, sf_dir, "conversations")
    one = c.join(F.broadcast(c.agg(F.min("conv_id").alias("conv_id"))), "conv_id")
    unit = F.struct(F.col("turn").cast("string").alias("utt_id"), F.col("text").alias("clean_en"))
    one.groupBy("conv_id").agg(F.array_sort(F.collect_list(unit)).alias("u")).select(F.to_json(F.struct(F.col("u").alias("utterances"))).alias("value")).write.text(path)
    return R.translations(spark, path).select("utt_id", "clean_en")


@register("S17_detections", f"WITH {SPANS} SELECT doc_id, label, CAST(s AS INTEGER) AS \"start\", CAST(s + n AS INTEGER) AS \"end\" FROM sp")
def shareable(spark, sf_dir):
    """The detections of the shareable output; the texts beside them hold placeholders."""
    path = scratch(spark, "shareable")
    found = spans(spark, sf_dir)
    kept = S.resolved(found, ["EMAIL", "IP", "ACCOUNT"])
    R.write_shareable(S.redacted(load(spark, sf_dir, "documents"), kept.join(S.numbered(kept), ["surface", "label"])), found, path)
    return spark.read.schema("doc_id long, label string, start int, end int").json(f"{path}/detections")


@register("S18_private_map", "SELECT doc_id, source FROM documents")
def private_map(spark, sf_dir):
    """What the guarded sink took."""
    root = scratch(spark, "private")
    R.write_private(load(spark, sf_dir, "documents").select("doc_id", "source"), f"{root}/map", [root])
    return spark.read.schema("doc_id long, source string").json(f"{root}/map")


SAID = (
    (1, "my username eka nimalp95. ok"), (2, "user ID: k.perera_7, yes"), (3, "postal code eka 10350"), (4, "zip 1035"), (5, "Expiry is 08/28;"), (6, "expiry 13/28"),
    (7, "mail me nimal dot perera nine five at example dot lk please"), (8, "😀 login kasun_1 and valid thru 11/2030"), (9, ""),
)


@register(
    "P8_anchored",
    """SELECT * FROM (VALUES (1, 'ACCOUNT', 16, 24, 'nimalp95'), (2, 'ACCOUNT', 9, 19, 'k.perera_7'), (3, 'ADDRESS', 16, 21, '10350'), (5, 'ACCOUNT', 10, 15, '08/28'),
    (7, 'EMAIL', 8, 52, 'nimal.perera95@example.lk'), (8, 'ACCOUNT', 8, 15, 'kasun_1'), (8, 'ACCOUNT', 31, 38, '11/2030')) v(doc_id, label, "start", "end", value)""",
)
def anchored(spark, sf_dir):
    return S.anchored(spark.createDataFrame(list(SAID), "doc_id int, text string")).drop("surface")


def voice_frames(spark, sf_dir):
    """Events as frames of a detector: a user's events in order of time, voiced if the value is 20 or more."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("session"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("frame"), F.when(F.col("value") >= 20, 1.0).otherwise(0.0).alias("p"))


@register("X1_endpoints")
def endpoints(spark, sf_dir):
    return live.replayed_endpoints(voice_frames(spark, sf_dir), quiet=3, longest=40, before=2, least=2)


@register("X6_replay")
def replay(spark, sf_dir):
    """How many identities online matching finds at each threshold."""
    e = load(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    found = [Q.identities(e, "label", "vec_id", "embedding", t).groupBy("label").agg(F.countDistinct("identity").alias("n")).select(F.lit(t).alias("least"), "label", "n") for t in (0.2, 0.3, 0.4)]
    return found[0].unionByName(found[1]).unionByName(found[2])
