"""Spans, redaction, linking, scoring, validation, sources and helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators import similarity as J
from talkweave.operators import spans as S
from talkweave.operators.ranks import ranked
from talkweave.plans.registry import load, register
from talkweave.plans.textual import TOKENS, conversation_tokens

EMAIL, IP, LONG = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9]{13,19}"


def _duck_spans(pattern: str, label: str, src: str = "documents") -> str:
    return f"""SELECT doc_id, '{label}' AS label, CAST(sum(length(gaps[i])) OVER w + coalesce(sum(length(hits[i])) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s,
        length(hits[i]) AS n, hits[i] AS surface FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM {src}))
        WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


SPANS = f"sp AS ({_duck_spans(EMAIL, 'EMAIL')} UNION ALL {_duck_spans(IP, 'IP')} UNION ALL {_duck_spans(LONG, 'ACCOUNT')})"


def spans(spark, sf_dir):
    """doc_id, label, start, end, surface of emails, addresses and long numbers."""
    return S.detected(load(spark, sf_dir, "documents"), {"EMAIL": EMAIL, "IP": IP, "ACCOUNT": LONG})


@register("P1_detect", f"WITH {SPANS} SELECT doc_id, label, s AS start, s + n AS \"end\", surface FROM sp")
def detect(spark, sf_dir):
    return spans(spark, sf_dir)


@register("P2_email", f"SELECT doc_id, s AS start, s + n AS \"end\", surface FROM ({_duck_spans(EMAIL, 'EMAIL')})")
def email(spark, sf_dir):
    return S.detected(load(spark, sf_dir, "documents"), {"EMAIL": EMAIL}).drop("label")


@register("P3_digit_runs", f"SELECT doc_id, s AS start, s + n AS \"end\", surface FROM ({_duck_spans('[0-9]+(?:[ -][0-9]+)*', 'N')})")
def digit_runs(spark, sf_dir):
    return S.detected(load(spark, sf_dir, "documents"), {"N": "[0-9]+(?:[ -][0-9]+)*"}).drop("label")


@register("P9_resolve_overlaps")
def resolve_overlaps(spark, sf_dir):
    """Longest spans first; of those that overlap only the first stays."""
    wide = S.detected(load(spark, sf_dir, "documents"), {"EMAIL": EMAIL, "IP": IP, "ACCOUNT": LONG, "NUMBER": "[0-9][0-9 .-]+[0-9]"})
    return S.resolved(wide, ["EMAIL", "IP", "ACCOUNT", "NUMBER"])


ENT = """ent AS (SELECT surface, label, min(struct_pack(d := doc_id, s := s)) AS f FROM sp GROUP BY surface, label),
num AS (SELECT surface, label, '[' || label || '_' || row_number() OVER (PARTITION BY label ORDER BY f, surface) || ']' AS placeholder FROM ent)"""


@register("R1_placeholders", f"WITH {SPANS}, {ENT} SELECT * FROM num")
def placeholders(spark, sf_dir):
    return S.numbered(spans(spark, sf_dir))


def _redaction(spark, sf_dir):
    docs, found = load(spark, sf_dir, "documents"), S.resolved(spans(spark, sf_dir), ["EMAIL", "IP", "ACCOUNT"])
    return docs, S.redacted(docs, found.join(S.numbered(found), ["surface", "label"]))


@register("R2_redact")
def redact(spark, sf_dir):
    return _redaction(spark, sf_dir)[1].select("doc_id", "redacted", F.size("replacements").alias("n"))


@register("R3_restore", "SELECT doc_id, true AS exact FROM documents")
def restore(spark, sf_dir):
    """Whether what is restored from the map equals the text."""
    docs, out = _redaction(spark, sf_dir)
    return docs.select("doc_id", "text").join(S.restored(out), "doc_id").select("doc_id", (F.col("text") == F.col("restored")).alias("exact"))


@register("R4_leaks", "SELECT CAST(0 AS BIGINT) AS leaks")
def leaks(spark, sf_dir):
    """Replaced surfaces of six characters or more that their redacted text still holds anywhere,
    whether or not a pattern finds them there."""
    _, out = _redaction(spark, sf_dir)
    left = F.filter("replacements", lambda x: (F.length(x["original"]) >= 6) & F.contains("redacted", x["original"]))
    return out.agg(F.sum(F.size(left)).cast("long").alias("leaks"))


@register("R5_summary", f"WITH {SPANS} SELECT label, count(*) AS mentions, count(DISTINCT surface) AS entities FROM sp GROUP BY label")
def redaction_summary(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("label").agg(F.count("*").alias("mentions"), F.countDistinct("surface").alias("entities"))


@register("E4_exact_links", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS entity FROM customer")
def exact_links(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    ids = c.select("c_mktsegment").distinct().withColumn("entity", F.row_number().over(Window.orderBy("c_mktsegment")))  # the few distinct keys only
    return c.join(F.broadcast(ids), "c_mktsegment").select("c_custkey", "entity")


@register("E8_entity_key", f"WITH {SPANS} SELECT DISTINCT label, CASE WHEN label = 'EMAIL' THEN lower(surface) WHEN label = 'ACCOUNT' THEN regexp_replace(surface, '[^0-9]', '', 'g') ELSE surface END AS key FROM sp")
def entity_key(spark, sf_dir):
    key = F.when(F.col("label") == "EMAIL", F.lower("surface")).when(F.col("label") == "ACCOUNT", F.regexp_replace("surface", "[^0-9]", "")).otherwise(F.col("surface"))
    return spans(spark, sf_dir).select("label", key.alias("key")).distinct()


_SETS = r"w AS (SELECT conv_id * 1000 + turn AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS ws FROM conversations WHERE text IS NOT NULL), k AS (SELECT ws, min(id) AS id FROM w GROUP BY ws)"


def turn_sets(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_distinct(T.words(F.lower("text"))).alias("set"))


@register("E12_similar_turns", f"WITH {_SETS}, d AS (SELECT id, unnest(ws) AS w FROM k), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM d a JOIN d b ON a.w = b.w AND a.id < b.id GROUP BY ALL) SELECT a, b, round(c / (len(x.ws) + len(y.ws) - c), 6) AS jaccard FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE c / (len(x.ws) + len(y.ws) - c) >= 0.5")
def similar_turns(spark, sf_dir):
    """Pairs of different token sets of Jaccard similarity 0.5 or more, each by the first turn that has
    it; E12_turn_classes says which turns share a set."""
    return J.similar_sets(turn_sets(spark, sf_dir), 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@register("E12_turn_classes", f"WITH {_SETS} SELECT w.id, k.id AS class_id FROM w JOIN k ON w.ws = k.ws")
def turn_classes(spark, sf_dir):
    return S.set_classes(turn_sets(spark, sf_dir)).select("id", "class_id")


@register("W1_char_error", "SELECT a.doc_id, round(levenshtein(substring(a.source, 1, 20), substring(a.lang || a.source, 1, 20)) / length(a.source), 6) AS cer FROM documents a")
def char_error(spark, sf_dir):
    """The SQL compares 20 characters at most, which holds every source of the given tables whole."""
    return load(spark, sf_dir, "documents").select("doc_id", F.round(F.levenshtein("source", F.concat("lang", "source")) / F.length("source"), 6).alias("cer"))


@register("W3_micro_macro", "SELECT lang, source, count(*) AS n, round(sum(n_chars) / sum(length(text)), 6) AS micro, round(avg(n_chars / length(text)), 6) AS macro FROM documents GROUP BY GROUPING SETS ((lang), (lang, source), ())")
def micro_macro(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("len", F.length("text"))
    return d.groupingSets([["lang"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"), F.round(F.sum("n_chars") / F.sum("len"), 6).alias("micro"), F.round(F.avg(F.col("n_chars") / F.col("len")), 6).alias("macro")).select("lang", "source", "n", "micro", "macro")


@register("W4_ordered_text", "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id")
def ordered_text(spark, sf_dir):
    x = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(x, lambda r: r["event_type"]), " ").alias("seq"))


@register("W6_error_quantiles", "SELECT event_type, round(median(value), 4) AS med, round(quantile_cont(value, 0.9), 4) AS p90, round(avg(CAST(value <= 50 AS INTEGER)), 6) AS within_50 FROM events GROUP BY event_type")
def error_quantiles(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 4).alias("med"), F.round(F.percentile("value", F.lit(0.9)), 4).alias("p90"), F.round(F.avg((F.col("value") <= 50).cast("int")), 6).alias("within_50"))


@register("W8_bleu_counts", rf"WITH {TOKENS}, b AS (SELECT conv_id, turn, token || ' ' || lead(token) OVER (PARTITION BY conv_id, turn ORDER BY tok_id) AS g FROM tokens), c AS (SELECT conv_id, turn, g, count(*) AS n FROM b WHERE g IS NOT NULL GROUP BY ALL) SELECT h.conv_id, h.turn, CAST(sum(least(h.n, coalesce(r.n, 0))) AS BIGINT) AS clipped, CAST(sum(h.n) AS BIGINT) AS total FROM c h LEFT JOIN c r ON r.conv_id = h.conv_id AND r.turn = h.turn - 1 AND r.g = h.g GROUP BY h.conv_id, h.turn")
def bleu_counts(spark, sf_dir):
    """Bigrams of a turn that the turn before has, clipped, against all."""
    t = conversation_tokens(spark, sf_dir).withColumn("g", F.concat_ws(" ", "token", F.lead("token").over(Window.partitionBy("conv_id", "turn").orderBy("tok_id"))))
    last = F.lead("token").over(Window.partitionBy("conv_id", "turn").orderBy("tok_id")).isNull()
    c = t.withColumn("last", last).where("not last").groupBy("conv_id", "turn", "g").agg(F.count("*").alias("n"))
    r = c.select("conv_id", (F.col("turn") + 1).alias("turn"), "g", F.col("n").alias("m"))
    return c.join(r, ["conv_id", "turn", "g"], "left").groupBy("conv_id", "turn").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("clipped"), F.sum("n").alias("total"))


@register("W12_span_scores", f"""WITH {SPANS}, g AS (SELECT doc_id, label, s, s + n AS e FROM sp), p AS (SELECT doc_id, label, s, s + n - CAST(doc_id % 5 = 0 AS INTEGER) AS e FROM sp WHERE doc_id % 7 <> 0),
    j AS (SELECT coalesce(g.label, p.label) AS label, g.s IS NOT NULL AS in_g, p.s IS NOT NULL AS in_p FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.label = p.label AND g.s = p.s AND g.e = p.e)
    SELECT label, count(*) FILTER (in_g AND in_p) AS tp, count(*) FILTER (in_p AND NOT in_g) AS fp, count(*) FILTER (in_g AND NOT in_p) AS fn FROM j GROUP BY GROUPING SETS ((label), ())""")
def span_scores(spark, sf_dir):
    """Strict span scores of a weaker detector, by label and in all."""
    gold = spans(spark, sf_dir).select("doc_id", "label", "start", "end")
    pred = gold.where("doc_id % 7 <> 0").withColumn("end", F.col("end") - (F.col("doc_id") % 5 == 0).cast("int"))
    return S.scores(gold, pred)


@register("W13_error_kinds", f"""WITH {SPANS}, g AS (SELECT doc_id, label, s, s + n AS e FROM sp), p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'OTHER' ELSE label END AS label, s, s + n - CAST(doc_id % 5 = 0 AS INTEGER) AS e FROM sp WHERE doc_id % 7 <> 0)
    SELECT g.doc_id, g.label, g.s AS start, CASE WHEN coalesce(bool_or(p.s = g.s AND p.e = g.e AND p.label = g.label), false) THEN 'correct' WHEN coalesce(bool_or(p.s = g.s AND p.e = g.e), false) THEN 'label' WHEN coalesce(bool_or(p.label = g.label), false) THEN 'boundary' WHEN count(p.s) > 0 THEN 'both' ELSE 'missed' END AS kind
    FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND p.s < g.e AND g.s < p.e GROUP BY g.doc_id, g.label, g.s, g.e""")
def error_kinds(spark, sf_dir):
    g = spans(spark, sf_dir).select("doc_id", "label", "start", "end")
    p = g.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("pd"), F.when(F.col("doc_id") % 11 == 0, "OTHER").otherwise(F.col("label")).alias("pl"), F.col("start").alias("ps"), (F.col("end") - (F.col("doc_id") % 5 == 0).cast("int")).alias("pe"))
    j = g.join(p, (F.col("doc_id") == F.col("pd")) & (F.col("ps") < F.col("end")) & (F.col("start") < F.col("pe")), "left")
    return j.groupBy("doc_id", "label", "start", "end").agg(F.expr("case when coalesce(bool_or(ps = start and pe = `end` and pl = label), false) then 'correct' when coalesce(bool_or(ps = start and pe = `end`), false) then 'label' when coalesce(bool_or(pl = label), false) then 'boundary' when count(ps) > 0 then 'both' else 'missed' end as kind")).drop("end")


@register("V1_span_checks", f"WITH {SPANS}, x AS (SELECT doc_id, s, s + n AS e, surface, lead(s) OVER (PARTITION BY doc_id ORDER BY s, n) AS nxt FROM sp) SELECT count(*) AS n, count(*) FILTER (nxt < e) AS overlaps, count(*) FILTER (surface <> trim(surface)) AS edges, CAST(0 AS BIGINT) AS offsets FROM x")
def span_checks(spark, sf_dir):
    s = spans(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    nxt = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start", "end"))
    s = s.withColumn("nxt", nxt).withColumn("wrong", F.expr("substring(text, start + 1, `end` - start) <> surface"))
    return s.agg(F.count("*").alias("n"), F.expr("count_if(nxt < `end`) as overlaps"), F.expr("count_if(surface <> trim(surface)) as edges"), F.expr("count_if(wrong) as offsets"))


@register("V2_stream_checks", f"WITH {TOKENS}, x AS (SELECT *, lag(tok_id) OVER (PARTITION BY conv_id, turn ORDER BY tok_id) AS b FROM tokens) SELECT conv_id, count(*) AS n, count(*) FILTER (coalesce(b, -1) + 1 <> tok_id) AS gaps, count(*) FILTER (token = '') AS blank FROM x GROUP BY conv_id")
def stream_checks(spark, sf_dir):
    b = F.lag("tok_id").over(Window.partitionBy("conv_id", "turn").orderBy("tok_id"))
    return conversation_tokens(spark, sf_dir).withColumn("b", b).groupBy("conv_id").agg(F.count("*").alias("n"), F.expr("count_if(coalesce(b, -1) + 1 <> tok_id) as gaps"), F.expr("count_if(token = '') as blank"))


@register("S3_all_texts", "SELECT 'conv/' || conv_id || '/' || turn AS doc_id, text FROM conversations UNION ALL SELECT 'doc/' || doc_id, text FROM documents UNION ALL SELECT 'bench/' || item_id, text FROM benchmark")
def all_texts(spark, sf_dir):
    a = load(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("conv"), "conv_id", "turn").alias("doc_id"), "text")
    b = load(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("doc"), "doc_id").alias("doc_id"), "text")
    return a.unionByName(b).unionByName(load(spark, sf_dir, "benchmark").select(F.concat_ws("/", F.lit("bench"), "item_id").alias("doc_id"), "text"))


@register("S5_shared_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def shared_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").intersect(load(spark, sf_dir, "labels").select("doc_id"))


@register("S6_pairs", "SELECT d.doc_id, nullif(d.lang, 'en') AS lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def pairs(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "quality")


@register("S9_complete", "SELECT source FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source HAVING avg(CAST(l.doc_id IS NOT NULL AS INTEGER)) >= 0.4")
def complete(spark, sf_dir):
    j = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    return j.groupBy("source").agg(F.avg(F.coalesce("has", F.lit(0))).alias("share")).where("share >= 0.4").select("source")


@register("S10_excluded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def excluded(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@register("S14_manifest", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.n_chars, -1) AS n_chars, coalesce(l.quality, 1) AS quality, d.n_chars IS DISTINCT FROM l.quality AS changed FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def manifest(spark, sf_dir):
    d, l = load(spark, sf_dir, "documents").select("doc_id", "n_chars"), load(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(l, "doc_id", "full")
    return j.select("doc_id", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"), F.coalesce("quality", F.lit(1)).alias("quality"), (~F.col("n_chars").eqNullSafe(F.col("quality"))).alias("changed"))


@register("S16_checksum", "SELECT doc_id, sha256(text) AS digest FROM documents")
def checksum(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@register("S20_pasted", r"""WITH p AS (SELECT 'S1: hello' || chr(10) || 'plain' || chr(10) || 'S2:  there: x' AS t), l AS (SELECT unnest(str_split(t, chr(10))) AS line, unnest(range(0, 3)) AS pos FROM p)
    SELECT CAST(pos AS INTEGER) AS pos, coalesce(nullif(regexp_extract(line, '^(\w+):', 1), ''), 'S1') AS speaker, trim(regexp_replace(line, '^\w+:', '')) AS said FROM l""")
def pasted(spark, sf_dir):
    t = spark.createDataFrame([("S1: hello\nplain\nS2:  there: x",)], "t string")
    return t.select(F.posexplode(F.split("t", "\n")).alias("pos", "line")).select("pos", F.coalesce(F.nullif(F.regexp_extract("line", r"^(\w+):", 1), F.lit("")), F.lit("S1")).alias("speaker"), F.trim(F.regexp_replace("line", r"^\w+:", "")).alias("said"))


@register("S21_split_counts", "SELECT CASE conv_id % 10 WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split, count(DISTINCT conv_id) AS convs, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY 1")
def split_counts(spark, sf_dir):
    s = F.when(F.col("conv_id") % 10 == 8, "dev").when(F.col("conv_id") % 10 == 9, "test").otherwise("train")
    return load(spark, sf_dir, "conversations").groupBy(s.alias("split")).agg(F.countDistinct("conv_id").alias("convs"), F.count("*").alias("turns"), F.expr("count_if(role = 'user') as user_turns"))


@register("M2_speakers", "SELECT conv_id, count(DISTINCT role) AS speakers FROM conversations GROUP BY conv_id")
def speakers(spark, sf_dir):
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("speakers"))


@register("M7_run_ranking", "WITH r AS (SELECT user_id, ts, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, min(value) AS best, round(avg(d), 6) AS mean_step, rank() OVER (ORDER BY min(value)) AS place FROM r GROUP BY user_id")
def run_ranking(spark, sf_dir):
    d = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = load(spark, sf_dir, "events").withColumn("d", d).groupBy("user_id").agg(F.min("value").alias("best"), F.round(F.avg("d"), 6).alias("mean_step"))
    return ranked(g, ["best"], "place", F.rank())


@register("M9_dev_fold", "SELECT conv_id FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS rn FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE rn % 5 <> 0")
def dev_fold(spark, sf_dir):
    """Conversations but every fifth, which are held out."""
    c = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ranked(c, ["conv_id"], "rn").where("rn % 5 <> 0").select("conv_id")


@register("M14_totals", "SELECT event_type, round(sum(value) / count(*), 6) AS rate, count(*) FILTER (value > 200) AS timeouts FROM events GROUP BY event_type")
def totals(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.count("*"), 6).alias("rate"), F.expr("count_if(value > 200) as timeouts"))
