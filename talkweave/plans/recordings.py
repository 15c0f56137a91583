"""Whole recordings: identifiers, propagation and redaction; repairs, files of splits, searches, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkweave.functions import repairs as P
from talkweave.operators import evaluation as V
from talkweave.operators import spans as S
from talkweave.operators import structured as X
from talkweave.plans.files import voice_frames
from talkweave.plans.registry import load, register
from talkweave.plans.relational import SPANS, spans
from talkweave.session import scratch
from talkweave.sources import readers as R
from talkweave.streaming import live

YEAR = 2025


def turns(spark, sf_dir):
    """rid, doc_id, text, preceding: all turns with the turn before, and all documents."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = load(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("conv"), "conv_id").alias("rid"), F.concat_ws("/", F.lit("conv"), "conv_id", "turn").alias("doc_id"), "text", before.alias("preceding"))
    d = load(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("doc"), "source").alias("rid"), F.concat_ws("/", F.lit("doc"), "doc_id").alias("doc_id"), "text", F.lit(None).cast("string").alias("preceding"))
    return c.unionByName(d)


@register("P1_identifiers")
def identifiers(spark, sf_dir):
    """Every structured identifier of all turns and documents."""
    return X.identified(turns(spark, sf_dir), YEAR)


@register("R2_recordings")
def recordings(spark, sf_dir):
    """Texts with placeholders for all identifiers, those found elsewhere in their recording included."""
    t = turns(spark, sf_dir)
    found = _written(spark, X.identified(t, YEAR).join(t.select("rid", "doc_id"), "doc_id"), "identifiers")
    all_ = _written(spark, X.propagated(t, found, F.col("role") != "ORGANISATION"), "propagated")
    named = all_.join(S.numbered(all_), ["surface", "label"])
    return S.redacted(t, named).select("doc_id", "redacted", F.size("replacements").alias("n"))


def _written(spark, df, name):
    """df by way of a table, so that what several plans read is computed once."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


LINES = "(VALUES (1, 'ට් රාන්ස්පෝට් එක'), (2, 'අවශ් යතාවය (වෛද් ය.'), (3, 'මෝටර් රථ'), (4, ''), (5, NULL), (6, 'නිවේදනයක් යවමුද අවශ් ය'))"


@register("T6_conjuncts", f"SELECT id, fixed FROM {LINES} v(id, t) LEFT JOIN (VALUES (1, 'ට්‍රාන්ස්පෝට් එක'), (2, 'අවශ්‍යතාවය (වෛද්‍ය.'), (3, 'මෝටර් රථ'), (4, ''), (6, 'නිවේදනයක් යවමුද අවශ්‍ය')) w(id, fixed) USING (id)")
def conjuncts(spark, sf_dir):
    lines = spark.sql(f"SELECT * FROM {LINES} AS v(id, text)")
    gold = spark.createDataFrame([("අවශ්‍යතාවය, ය",), ("වෛද්‍ය",), (None,)], "text string")
    return P.rejoined(lines, P.conjunct_starts(gold)).select("id", F.col("text").alias("fixed"))


@register("T30_trim_digits", r"""WITH p AS (SELECT doc_id, text, CAST(floor(6.0 * (length(text) / 150.0) + 2) AS INTEGER) AS n, regexp_split_to_array(text, '[0-9]') AS g, regexp_extract_all(text, '[0-9]') AS d FROM documents)
    SELECT doc_id, CASE WHEN text = '' THEN '' ELSE trim(regexp_replace(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= least(n, len(d)) THEN d[i] ELSE '' END), ''), '[ \t\n\r\f\v]+', ' ', 'g')) END AS trimmed FROM p""")
def trim_digits(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", P.trimmed_digits(F.col("text"), F.length("text") / 150.0).alias("trimmed"))


@register("S8_split", f"WITH {SPANS} SELECT 'all' AS rid, d.doc_id, length(text) AS n_chars, coalesce(n, 0) AS n_spans FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sp GROUP BY doc_id) x USING (doc_id)")
def split_files(spark, sf_dir):
    """A split written as files of recordings comes back: texts with their spans."""
    path = scratch(spark, "split")
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    d.write.json(f"{path}/all.docs.jsonl")
    spans(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "label", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "surface").write.json(f"{path}/all.pii.jsonl")
    docs, rows = R.recordings(spark, path)
    n = rows.groupBy("rid", "doc_id").agg(F.count("*").alias("n"))
    return docs.join(n, ["rid", "doc_id"], "left").select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_chars"), F.coalesce("n", F.lit(0)).alias("n_spans"))


@register("S23_staged", "SELECT CAST(turn AS VARCHAR) AS utt_id, 'c2' AS layer, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) UNION ALL SELECT CAST(turn AS VARCHAR), 'c1', upper(text) FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def staged(spark, sf_dir):
    """One recording's files from two loose folders; other recordings' files there are left."""
    path = scratch(spark, "staged")
    c = load(spark, sf_dir, "conversations")
    for layer, text in (("c2", F.col("text")), ("c1", F.upper("text"))):
        for rid, keep in (("R1", F.min), ("R2", F.max)):
            one = c.join(F.broadcast(c.agg(keep("conv_id").alias("conv_id"))), "conv_id").select(F.col("turn").cast("string").alias("utt_id"), text.alias("text"))
            one.write.json(f"{path}/{layer}/{rid}.turns.json")
    return R.staged(spark, "R1", {k: f"{path}/{k}" for k in ("c1", "c2")}, "utt_id string, text string")


@register("V4_training_spans", """WITH s AS (SELECT * FROM (VALUES (1, 0, 5, 'hello', 'hello world'), (1, 0, 11, 'hello world', 'hello world'), (2, 3, 6, 'xyz', 'abcdef'), (3, 1, 3, 'bc', 'abcd')) AS t(doc_id, s, e, surface, txt)), v AS (SELECT * FROM s WHERE substring(txt, s + 1, e - s) = surface)
    SELECT a.doc_id, a.s AS start, a.e AS "end" FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE a.doc_id = b.doc_id AND b.s < a.e AND a.s < b.e AND b.e - b.s > a.e - a.s)""")
def training_spans(spark, sf_dir):
    rows = [(1, 0, 5, "hello", "X"), (1, 0, 11, "hello world", "X"), (2, 3, 6, "xyz", "X"), (3, 1, 3, "bc", "X")]
    docs = spark.createDataFrame([(1, "hello world"), (2, "abcdef"), (3, "abcd")], "doc_id int, text string")
    return V.training_spans(docs, spark.createDataFrame(rows, "doc_id int, start int, end int, surface string, label string")).select("doc_id", "start", "end")


@register("E9_link_scores", """WITH m AS (SELECT c_nationkey AS rec, c_custkey AS id, c_mktsegment AS gold, CASE WHEN c_custkey % 9 = 0 THEN 'X' ELSE c_mktsegment END AS pred FROM customer)
    SELECT a.rec, count(CASE WHEN a.gold = b.gold AND a.pred = b.pred AND a.id < b.id THEN 1 END) AS tp, count(CASE WHEN a.gold <> b.gold AND a.pred = b.pred AND a.id < b.id THEN 1 END) AS fp, count(CASE WHEN a.gold = b.gold AND a.pred <> b.pred AND a.id < b.id THEN 1 END) AS fn
    FROM m a JOIN m b ON a.rec = b.rec GROUP BY a.rec""")
def link_scores(spark, sf_dir):
    pred = F.when(F.col("c_custkey") % 9 == 0, "X").otherwise(F.col("c_mktsegment"))
    return V.link_scores(load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("rec"), F.col("c_mktsegment").alias("gold"), pred.alias("pred")))


@register("E10_threshold_grid", """WITH g AS (SELECT * FROM (VALUES (5), (10), (20), (40), (80)) AS t(th)), s AS (SELECT th, count(CASE WHEN (value >= th) = (event_type IN ('purchase', 'error')) THEN 1 END) AS hits FROM events CROSS JOIN g GROUP BY th),
    r AS (SELECT th, hits, row_number() OVER (ORDER BY hits DESC, th) AS place FROM s) SELECT th, hits FROM r WHERE place = 1""")
def threshold_grid(spark, sf_dir):
    return V.best_threshold(load(spark, sf_dir, "events").select(F.col("value").alias("score"), F.col("event_type").isin("purchase", "error").alias("label")), [5, 10, 20, 40, 80])


@register("W14_recall_by_tag", f"""WITH {SPANS}, g AS (SELECT *, CASE WHEN n > 18 THEN 'long' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'third' END AS b FROM sp), x AS (SELECT doc_id, label, s, n, a AS tag FROM g WHERE a IS NOT NULL UNION ALL SELECT doc_id, label, s, n, b FROM g WHERE b IS NOT NULL UNION ALL SELECT doc_id, label, s, n, 'clean' FROM g WHERE a IS NULL AND b IS NULL)
    SELECT tag, round(avg(CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS support FROM x GROUP BY tag""")
def recall_by_tag(spark, sf_dir):
    """Recall of a weaker detector on long spans, on every third document's, and on the others."""
    g = spans(spark, sf_dir)
    tags = F.array_compact(F.array(F.when(F.col("end") - F.col("start") > 18, "long"), F.when(F.col("doc_id") % 3 == 0, "third")))
    return V.recall_by_tag(g.withColumn("tags", tags), g.where("doc_id % 7 <> 0").withColumn("end", F.col("end") - (F.col("doc_id") % 5 == 0).cast("int")))


@register("M10_subsample", """WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY (conv_id * 7919) % 10007, conv_id) AS place FROM (SELECT DISTINCT conv_id FROM conversations) c), x AS (SELECT c.* FROM conversations c JOIN r ON c.conv_id = r.conv_id WHERE place <= 20)
    SELECT conv_id, turn, text, false AS twin FROM x UNION ALL SELECT conv_id, turn, lower(text), true FROM x WHERE role = 'user'""")
def subsample(spark, sf_dir):
    """The feature is a sample: twenty whole recordings by a hash, and a changed twin of each user's turn."""
    c = load(spark, sf_dir, "conversations")
    chosen = c.select("conv_id").distinct().orderBy(F.col("conv_id") * 7919 % 10007, "conv_id").limit(20)
    x = c.join(F.broadcast(chosen), "conv_id")
    twins = x.where("role = 'user'").select("conv_id", "turn", F.lower("text").alias("text"), F.lit(True).alias("twin"))
    return x.select("conv_id", "turn", "text", F.lit(False).alias("twin")).unionByName(twins)


_WORDS = r"SELECT lang AS label, lower(w) AS word FROM (SELECT lang, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM documents)"


@register("M13_hybrid", rf"""WITH w AS (SELECT word, min(k).label AS label FROM (SELECT word, struct_pack(n := -count(*), label := label) AS k FROM ({_WORDS}) GROUP BY word, label) GROUP BY word),
    x AS (SELECT word, label, right(word, 3) AS key, CAST(('0x' || substring(md5(word), 1, 4)) AS INTEGER) % 5 AS fold FROM w WHERE NOT regexp_matches(word, '^[0-9]+$')),
    c AS (SELECT a.word, b.label, count(*) AS n FROM x a JOIN x b ON a.key = b.key AND a.fold <> b.fold GROUP BY a.word, b.label),
    p AS (SELECT word, min(struct_pack(n := -n, label := label)).label AS predicted FROM c GROUP BY word)
    SELECT w.word, w.label, CASE WHEN regexp_matches(w.word, '^[0-9]+$') THEN 'NUM' ELSE p.predicted END AS predicted FROM w LEFT JOIN p USING (word)""")
def hybrid_prediction(spark, sf_dir):
    """Languages of words in cross-validation: a rule where the script decides, else the commonest
    language of words in other folds with the same three last letters."""
    from talkweave.functions import text as T

    d = load(spark, sf_dir, "documents").select("lang", F.explode(T.words(F.lower("text"))).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    w = d.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("label"))
    w = w.withColumns({"key": F.right("word", F.lit(3)), "fold": F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("int") % 5, "rule": F.when(F.col("word").rlike("^[0-9]+$"), "NUM")})
    model = V.out_of_fold(w.where("rule is null").select("word", "key", "fold", "label"), "fold", "key", "label").select("word", "predicted")
    return w.join(model, "word", "left").select("word", "label", F.coalesce("rule", "predicted").alias("predicted"))


@register("I24_staged_search", """WITH e AS (SELECT value, event_type IN ('purchase', 'error') AS y FROM events), t(th) AS (VALUES (20.0), (5.0), (10.0), (40.0), (80.0)), w(up) AS (VALUES (1000.0), (60.0), (100.0), (200.0)),
    a AS (SELECT th, count(*) FILTER ((value >= th AND value < 1000.0) <> y) AS cost FROM e, t GROUP BY th), b AS (SELECT th FROM a ORDER BY cost, th <> 20.0, th LIMIT 1),
    c AS (SELECT b.th, up, count(*) FILTER ((value >= b.th AND value < up) <> y) AS cost FROM e, w, b GROUP BY b.th, up)
    SELECT CAST(th AS DOUBLE) AS th, CAST(1000.0 AS DOUBLE) AS up, CAST(cost AS DOUBLE) AS cost FROM a UNION SELECT CAST(th AS DOUBLE), CAST(up AS DOUBLE), CAST(cost AS DOUBLE) FROM c""")
def staged_search(spark, sf_dir):
    """Two bounds on a value, searched one after the other; every stage is one pass over the events."""
    e = load(spark, sf_dir, "events").select("value", F.col("event_type").isin("purchase", "error").alias("y"))

    def cost(settings):
        wrong = ((F.col("value") >= F.col("th")) & (F.col("value") < F.col("up"))) != F.col("y")
        return e.crossJoin(F.broadcast(settings)).groupBy("order", "th", "up").agg(F.count_if(wrong).alias("cost"))  # settings are a handful

    stages = [lambda b: [{**b, "th": t} for t in (5, 10, 20, 40, 80)], lambda b: [{**b, "up": u} for u in (60, 100, 200)]]
    return V.staged_search(spark, scratch(spark, "grid"), {"th": 20.0, "up": 1000.0}, stages, cost).select("th", "up", "cost")


def _streamed(spark, sf_dir, table, transform, name):
    """What a stream over a table's file gives to a file sink until it has read all."""
    path = scratch(spark, name)
    source = f"{sf_dir}/{table}.parquet"
    stream = transform(spark.readStream.schema(load(spark, sf_dir, table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir if not _is_folder(spark, source) else source))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _is_folder(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@register("X7_exactly_once", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def exactly_once(spark, sf_dir):
    """Events that come twice, each kept once: keys within the watermark, then a sink that commits by batch."""
    return _streamed(spark, sf_dir, "events", lambda s: live.once(s.unionByName(s).withColumn("ts", F.col("ts").cast("timestamp"))).select("event_id", "event_type", F.round("value", 6).alias("value")), "once")


@register("X5_live_identities")
def live_identities(spark, sf_dir):
    """Identities of a stream of vectors; the same as the batch operator gives."""
    return _streamed(spark, sf_dir, "embeddings", lambda s: live.live_identities(s.select(F.col("label").cast("string").alias("session"), F.col("vec_id").alias("seq"), "embedding"), 0.3, idle_ms=None), "identities")


@register("M19_finalised")
def finalised(spark, sf_dir):
    """Utterances long enough to be decoded, and how long after the speech their text is out."""
    found = live.replayed_endpoints(voice_frames(spark, sf_dir), quiet=3, longest=40, before=2, least=2)
    return live.finalised(found, frame_s=0.032, least_s=0.2, silence_s=0.096, decode_s=F.lit(0.0))
