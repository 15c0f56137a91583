"""Scores, thresholds, staged searches and out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators import spans as S


def link_scores(mentions: DataFrame) -> DataFrame:
    """tp, fp, fn of pairs of mentions (rec, gold, pred) that one entity joins. Pairs are counted from
    the sizes of the groups and never formed; a mention without gold or pred joins nothing."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = mentions.groupBy("rec", "gold", "pred").agg(F.count("*").alias("n"))

    def same(*keys: str) -> Column:
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        return known

    both = cells.where(same("gold", "pred")).groupBy("rec").agg(F.sum(pairs("n")).alias("tp"))
    of = lambda key, name: cells.where(same(key)).groupBy("rec", key).agg(F.sum("n").alias("n")).groupBy("rec").agg(F.sum(pairs("n")).alias(name))
    out = cells.select("rec").distinct().join(both, "rec", "left").join(of("pred", "joined"), "rec", "left").join(of("gold", "true"), "rec", "left").na.fill(0)
    whole = lambda c, name: c.cast("long").alias(name)
    return out.select("rec", whole(F.col("tp"), "tp"), whole(F.col("joined") - F.col("tp"), "fp"), whole(F.col("true") - F.col("tp"), "fn"))


def best_threshold(scored: DataFrame, grid: list[float]) -> DataFrame:
    """th and hits of the threshold that most of (score, label) agree with, the lowest on a tie; one
    pass over the rows for the whole grid."""
    hits = scored.agg(*[F.count_if((F.col("score") >= t) == F.col("label")).alias(f"h{k}") for k, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.col(f"h{k}").alias("hits"), F.lit(-t).alias("low")) for k, t in enumerate(grid)])
    best = hits.select(F.array_max(rows).alias("x"))
    return best.select((-F.col("x.low")).alias("th"), F.col("x.hits").alias("hits"))


def recall_by_tag(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Strict recall by noise tag: a span (doc_id, label, start, end, tags) counts under each of its
    tags, and as clean without any."""
    key = ["doc_id", "label", "start", "end"]
    tags = F.when(F.size(F.coalesce("tags", F.array())) > 0, F.array_distinct("tags")).otherwise(F.array(F.lit("clean")))
    hit = gold.join(pred.select(*key).distinct().withColumn("hit_", F.lit(1)), key, "left")
    return hit.select(F.explode(tags).alias("tag"), F.coalesce("hit_", F.lit(0)).alias("hit")).groupBy("tag").agg(F.round(F.avg("hit"), 6).alias("recall"), F.count("*").alias("support"))


def training_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Spans (doc_id, label, start, end, surface) fit to train with: those whose offsets give their
    surface in the document's text, and of those that overlap the longest."""
    fit = rows.join(docs.select("doc_id", "text"), "doc_id").where(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("surface"))
    order = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("o"), "start", "end", "label", "surface")))
    return S.unoverlapped(fit.groupBy("doc_id").agg(order.alias("spans")), ["doc_id"], ["label", "start", "end", "surface"])


def out_of_fold(rows: DataFrame, fold: str, key: str, label: str) -> DataFrame:
    """rows with ``predicted``: the commonest label of a row's key in all folds but its own (the
    first by name on a tie), null for a key that only its own fold holds. Counts are kept by key, label
    and fold, so the folds cost one pass and no fold is a job of its own."""
    cells = rows.groupBy(key, fold, label).agg(F.count("*").alias("n"))
    total = cells.groupBy(key, label).agg(F.sum("n").alias("all"))
    folds = cells.select(key, fold).distinct()
    others = folds.join(total, key).join(cells, [key, fold, label], "left").select(key, fold, label, (F.col("all") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    best = others.groupBy(key, fold).agg(F.array_min(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))))["label"].alias("predicted"))
    return rows.join(best, [key, fold], "left")


def staged_search(spark: SparkSession, path: str, start: dict[str, float], stages: list[Callable[[dict], list[dict]]], cost: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All trials (order, the parameters, cost) of a coordinate search: each stage makes settings from
    the best one so far (the earliest on a tie), and ``cost`` scores its new ones together, from a
    table of settings. Trials are appended to ``path`` by stage; a search that is started again over
    the same table scores only what it lacks."""
    names = list(start)
    schema = "`order` int, " + ", ".join(f"{n} double" for n in names) + ", cost double"

    def known() -> list[dict]:
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            return []
        return [r.asDict() for r in spark.read.schema(schema).parquet(path).orderBy("order").collect()]  # as many as were tried

    tried = known()
    for make in [lambda _: [start], *stages]:
        seen = {tuple(t[n] for n in names) for t in tried}
        best = min(tried, key=lambda t: (t["cost"], t["order"]), default=None)
        settings = dict.fromkeys(tuple(float(s[n]) for n in names) for s in make({n: best[n] for n in names} if best else {}))
        new = [s for s in settings if s not in seen]
        if new:
            table = spark.createDataFrame([(len(tried) + k, *s) for k, s in enumerate(new)], "`order` int, " + ", ".join(f"{n} double" for n in names))
            cost(table).select("order", *names, F.col("cost").cast("double").alias("cost")).coalesce(1).write.mode("append").parquet(path)
            tried = known()
    return spark.read.schema(schema).parquet(path)
