"""Queries of operators that run in Python; SQL only where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import identifiers as N
from talkweave.functions import text as T
from talkweave.operators import sequential as Q
from talkweave.plans.registry import load, register


def _pairs(spark, sf_dir):
    """Each turn against the turn before, in its first 200 words."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return load(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.coalesce(before, F.lit("")).alias("ref"), F.col("text").alias("hyp"))


@register("W2_word_errors", "WITH p AS (SELECT conv_id || '/' || turn AS id, len(list_filter(regexp_split_to_array(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '\\s+'), lambda x: x <> '')) AS n FROM conversations) SELECT id, CAST(n AS INTEGER) AS reference FROM p")
def word_errors(spark, sf_dir):
    """The words that an alignment hits, substitutes or deletes are all the reference's words."""
    return Q.word_errors(_pairs(spark, sf_dir)).select("id", (F.col("hits") + F.col("subs") + F.col("dels")).alias("reference"))


@register("W9_rouge_l")
def rouge_l(spark, sf_dir):
    return Q.rouge_l(_pairs(spark, sf_dir))


@register("W10_action_items")
def action_items(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("id", F.split("hyp", r"[.!?]\s+").alias("pred"), F.split("ref", r"[.!?]\s+").alias("gold"))
    return Q.item_scores(p)


@register("T9_strip_diacritics", "SELECT doc_id, strip_accents(source || ' éèüñ Åß') AS plain FROM documents")
def strip_diacritics(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", Q.without_diacritics(F.concat("source", F.lit(" éèüñ Åß"))).alias("plain"))


ONCE = "regexp_replace(" * 27 + "{}" + "".join(f", '{c}+', '{c}', 'g')" for c in "abcdefghijklmnopqrstuvwxyzß")
FOLD = ONCE.format(r"replace(regexp_replace(lower({}), '([tdkgpbjcs])h', '\1', 'g'), 'w', 'v')")


@register("T10_fold", f"WITH w AS (SELECT DISTINCT regexp_replace(c_mktsegment || ' ' || c_name, '[0-9]', '', 'g') AS w FROM customer) SELECT w, {FOLD.format('w')} AS folded FROM w")
def fold(spark, sf_dir):
    w = F.regexp_replace(F.concat_ws(" ", "c_mktsegment", "c_name"), "[0-9]", "")
    return load(spark, sf_dir, "customer").select(w.alias("w")).distinct().select("w", T.folded(F.col("w")).alias("folded"))


SQUASH = r"trim(regexp_replace({}, '[\p{{P}}\p{{S}}\p{{C}}\s]+', ' ', 'g'))"


@register("T12_raw", f"SELECT conv_id, turn, {SQUASH.format('lower(text)')} AS plain FROM conversations")
def raw(spark, sf_dir):
    """Lower case without punctuation: scripts stay apart."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.squashed(F.lower("text")).alias("plain"))


@register("T12_scripted", f"SELECT conv_id, turn, {SQUASH.format(FOLD.format('strip_accents(lower(text))'))} AS plain FROM conversations")
def scripted(spark, sf_dir):
    """Both scripts as one folded Latin form."""
    latin = load(spark, sf_dir, "conversations").select("conv_id", "turn", Q.without_diacritics(F.lower(N.romanised(F.col("text")))).alias("t"))
    return latin.select("conv_id", "turn", T.squashed(T.folded(F.col("t"))).alias("plain"))


@register("T25_windows")
def windows(spark, sf_dir):
    return Q.windows(load(spark, sf_dir, "documents"))


@register("T27_compression")
def compression(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.round(Q.compression_ratio("text"), 6).alias("ratio"))


@register("T28_repetition")
def repetition(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", Q.repetition("text").alias("x")).select("doc_id", "x.repeats", "x.phrase")


@register("E3_name_clusters")
def name_clusters(spark, sf_dir):
    keys = F.transform(F.slice(T.words(F.lower("text")), 1, 2), T.phonetic_key)
    m = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rid"), F.col("turn").alias("mention_id"), F.filter(keys, lambda k: k != "").alias("keys"))
    return Q.clustered(m)


@register("E13_identities")
def identities(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return Q.identities(e.select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.3)


@register("I19_clips")
def clips(spark, sf_dir):
    """Events of a user as clips: pauses of at most two hours, clips of at most six."""
    s = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start")).withColumn("end", F.col("start") + 1)
    return Q.sessionised(s, "user_id", 7200.0, 21600.0)
