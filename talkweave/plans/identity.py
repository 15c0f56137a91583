"""Queries of names, identifiers, context and hybrid detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import identifiers as N
from talkweave.functions import text as T
from talkweave.operators import spans as S
from talkweave.operators import structured as X
from talkweave.plans.registry import load, register
from talkweave.plans.relational import EMAIL, IP, LONG, SPANS, spans

SINHALA = "(VALUES (1, 'නිමල් පෙරේරා'), (2, 'ශ්‍රී ලංකා abc'), (3, 'අම්මා'), (4, ''), (5, 'සිංහ 12'))"


def _duck_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


@register(
    "T8_romanise",
    f"""WITH c AS (SELECT id, str_split(regexp_replace(t, '[\\x{{200C}}\\x{{200D}}]', '', 'g'), '') AS cs FROM {SINHALA} v(id, t))
    SELECT id, coalesce(array_to_string(list_transform(range(1, len(cs) + 1), lambda i: coalesce(map_extract_value({_duck_map({**N.CONSONANTS, **N.VOWELS, **N.SIGNS, **N.NASAL, **N.BREATH, N.SILENT: ''})}, cs[i]), cs[i])
        || CASE WHEN contains('{''.join(N.CONSONANTS)}', cs[i]) AND cs[i] <> '' AND (i = len(cs) OR NOT contains('{''.join(N.SIGNS)}{N.SILENT}', cs[i + 1])) THEN 'a' ELSE '' END), ''), '') AS latin FROM c""",
)
def romanise(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {SINHALA} AS v(id, t)").select("id", N.romanised(F.col("t")).alias("latin"))


@register("T15_skeleton", "SELECT DISTINCT n_name, regexp_replace(lower(n_name), '[aeiouy]', '', 'g') AS skeleton FROM nation")
def skeletons(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_name", T.skeleton(F.lower("n_name")).alias("skeleton")).distinct()


NAMES = "(VALUES (1, 'Dr. Nimal de Silva'), (2, 'Mrs Perera'), (3, 'Nimali'), (4, 'Sunil 12'), (5, 'van'))"


@register("T16_name_tokens", rf"""SELECT id, array_to_string(list_filter(regexp_extract_all(lower(t), '[^\s.,;:!?()/-]+'), lambda x: NOT list_contains({[*N.TITLES, *N.PARTICLES]!r}, x) AND NOT regexp_matches(x, '^[0-9]+$')), ' ') AS tokens FROM {NAMES} v(id, t)""")
def name_tokens(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {NAMES} AS v(id, t)").select("id", F.array_join(N.name_tokens(F.col("t")), " ").alias("tokens"))


SAID = "(VALUES (1, 'n-i-m-a-l dot p-e-r-e-r-a nine five at example dot l-k'), (2, 'bob at x dot org'), (3, 'a,  b'))"


@register("T19_written_email", rf"""SELECT id, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda w: w <> ''), lambda w: coalesce(map_extract_value({_duck_map(N.SPOKEN)}, trim(w, ',')),
    CASE WHEN regexp_matches(trim(w, ','), '^[\p{{L}}\p{{N}}_](-[\p{{L}}\p{{N}}_])+$') THEN replace(trim(w, ','), '-', '') END, trim(w, ','))), '') AS email FROM {SAID} v(id, t)""")
def written_email(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {SAID} AS v(id, t)").select("id", N.written_email(F.col("t")).alias("email"))


@register("T23_summary", """SELECT 1 AS id, 'They met.' AS summary, 'call Bob/Ann/null;pay//' AS items UNION ALL SELECT 2, 'No actions.', ''""")
def summary(spark, sf_dir):
    rows = [(1, "SUMMARY: They met. ACTIONS:\n- call Bob | Ann | none\nx\n - pay"), (2, "SUMMARY: No actions.")]
    p = spark.createDataFrame(rows, "id int, t string").select("id", N.parsed_summary(F.col("t")).alias("p"))
    item = lambda x: F.concat(x["intent"], F.lit("/"), F.coalesce(x["owner"], F.lit("")), F.lit("/"), F.when(x["intent"] == "call Bob", F.coalesce(x["deadline"], F.lit("null"))).otherwise(F.coalesce(x["deadline"], F.lit(""))))
    return p.select("id", "p.summary", F.array_join(F.transform("p.items", item), ";").alias("items"))


@register("T7_copy_numbers", "SELECT * FROM (VALUES (1, 'pay 12 on 5'), (2, 'pay 12'), (3, 'none')) v(id, fixed)")
def copy_numbers(spark, sf_dir):
    rows = [(1, "12 and 5", "pay 21 on 7"), (2, "1 2 3", "pay 12"), (3, "4", "none")]
    return spark.createDataFrame(rows, "id int, a string, b string").select("id", N.copied_numbers(F.col("a"), F.col("b")).alias("fixed"))


@register(
    "E1_token_similarity",
    r"""WITH k AS (SELECT * FROM (VALUES ('nimal'), ('nimali'), ('perer'), ('pirer'), ('sunil'), ('sunel'), ('kmr'), ('')) v(k)), p AS (SELECT a.k AS a, b.k AS b, regexp_replace(a.k, '[aeiouy]', '', 'g') AS sa, regexp_replace(b.k, '[aeiouy]', '', 'g') AS sb FROM k a, k b)
    SELECT a, b, round(CASE WHEN a || 'i' = b OR b || 'i' = a THEN 0.5 ELSE greatest(CASE WHEN a = '' OR b = '' THEN 0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END,
        CASE WHEN least(length(sa), length(sb)) >= 3 THEN 1 - levenshtein(sa, sb) / greatest(length(sa), length(sb)) ELSE 0 END) END, 6) AS similarity FROM p""",
)
def token_similarity(spark, sf_dir):
    k = spark.createDataFrame([(x,) for x in ("nimal", "nimali", "perer", "pirer", "sunil", "sunel", "kmr", "")], "a string")
    p = k.crossJoin(k.withColumnRenamed("a", "b"))
    return p.select("a", "b", F.round(N.key_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def _duck_context(text: str, start: str) -> str:
    left = f"regexp_extract(substring({text}, greatest(1, {start} - 49), least(50, {start})), '[^0-9]*$')"
    ends = {c: f"length(regexp_extract({left}, '(?is)^.*(?:{p})'))" for c, p in N.CONTEXT.items()}
    last = f"greatest({', '.join(ends.values())})"
    return f"CASE WHEN {last} = 0 THEN NULL " + " ".join(f"WHEN {e} = {last} THEN '{c}'" for c, e in ends.items()) + " END"


SPOKEN = "(VALUES (1, 'my NIC is 953201456V and phone number 0771234567', 46), (2, 'identity card 12', 14), (3, 'pay rs 500 by call 077', 19), (4, 'nothing 5', 8), (5, 'account no 1 then 2', 18))"


@register("P6_context", f"SELECT id, {_duck_context('t', 's')} AS context FROM {SPOKEN} v(id, t, s)")
def keyword_context(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {SPOKEN} AS v(id, t, s)").select("id", N.context(F.col("t"), F.col("s")).alias("context"))


DATES = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}(?:st|nd|rd|th) of (?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATED = "(VALUES (1, 'born 1990-08-22, moved 3/12/2001'), (2, 'on the 17th of August we'), (3, 'no date'))"


@register("P5_dates", f"SELECT id, array_to_string(regexp_extract_all(t, '{DATES}'), '|') AS dates FROM {DATED} v(id, t)")
def dates(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {DATED} AS v(id, t)").select("id", F.array_join(F.regexp_extract_all("t", F.lit(DATES), F.lit(0)), "|").alias("dates"))


@register("P4_references", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z]{2,4}[-/]?[0-9]{3,}')) AS INTEGER) AS n FROM documents")
def references(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Z]{2,4}[-/]?[0-9]{3,}")).alias("n"))


@register("P10_hybrid", f"""WITH {SPANS}, m AS (SELECT doc_id, s + 3 AS s, s + n + 6 AS e FROM sp WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, 5 FROM documents WHERE doc_id % 50 = 0)
    SELECT doc_id, s AS start, 'rule' AS source FROM sp UNION ALL SELECT doc_id, s, 'model' FROM m WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = m.doc_id AND sp.s < m.e AND m.s < sp.s + sp.n)""")
def hybrid(spark, sf_dir):
    """Rules win; a model's span stays only where it meets none of theirs."""
    r = spans(spark, sf_dir).select("doc_id", "start", "end")
    m = r.where("doc_id % 2 = 0").select("doc_id", (F.col("start") + 3).alias("start"), (F.col("end") + 6).alias("end"))
    m = m.unionByName(load(spark, sf_dir, "documents").where("doc_id % 50 = 0").select("doc_id", F.lit(0).alias("start"), F.lit(5).alias("end")))
    rules = r.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
    free = m.join(rules, (F.col("doc_id") == F.col("d")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_anti")
    return r.select("doc_id", "start", F.lit("rule").alias("source")).unionByName(free.select("doc_id", "start", F.lit("model").alias("source")))


@register("P15_propagate", rf"WITH {SPANS}, k AS (SELECT DISTINCT d.source AS rid, surface FROM sp JOIN documents d USING (doc_id)) SELECT d.doc_id, k.surface FROM documents d JOIN k ON d.source = k.rid AND contains(d.text, k.surface) AND regexp_matches(d.text, '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(k.surface) || '($|[^\p{{L}}\p{{N}}])')")
def propagate(spark, sf_dir):
    """Documents of a source that hold a surface known in that source, outside longer words and numbers."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("rid"), "doc_id", "text")
    known = spans(spark, sf_dir).join(d.select("rid", "doc_id"), "doc_id")
    return X.known_places(d, known).select("doc_id", "surface").distinct()


@register("P12_mapped_labels", f"WITH {SPANS}, m AS (SELECT * FROM (VALUES ('EMAIL', 'CONTACT'), ('ACCOUNT', 'NUMBER')) v(label, target)) SELECT doc_id, s AS start, target FROM sp JOIN m USING (label)")
def mapped_labels(spark, sf_dir):
    m = spark.createDataFrame([("EMAIL", "CONTACT"), ("ACCOUNT", "NUMBER")], "label string, target string")
    return S.detected(load(spark, sf_dir, "documents"), {"EMAIL": EMAIL, "IP": IP, "ACCOUNT": LONG}).join(F.broadcast(m), "label").select("doc_id", "start", "target")


@register("L2_language_model")
def language_model(spark, sf_dir):
    """A classifier of words by letter n-grams: each word's language and what the model says."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF

    w = load(spark, sf_dir, "documents").where("lang in ('en', 'fr')").select("lang", F.explode(T.words(F.lower("text"))).alias("word")).where(F.length("word") > 2)
    w = w.groupBy("word").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count("*").alias("n")).select("word", (F.col("en") * 2 >= F.col("n")).cast("double").alias("label"), T.grams(F.col("word")).alias("grams"))
    x = HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << 14).transform(w)
    model = NaiveBayes().fit(x.where(F.crc32("word") % 5 != 0))
    return model.transform(x.where(F.crc32("word") % 5 == 0)).select("word", "label", "prediction")


@register("E11_role_model")
def role_model(spark, sf_dir):
    """Roles of users from weighted features of their events."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    u = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.max_by("event_type", "value").alias("top"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("share"))
    u = u.withColumn("label", (F.col("share") > 0.2).cast("double")).withColumn("w", F.when(F.col("label") == 1, 2.0).otherwise(1.0))
    x = FeatureHasher(inputCols=["n", "mean", "top"], outputCol="features", numFeatures=64).transform(u)
    return LogisticRegression(weightCol="w", maxIter=20).fit(x).transform(x).select("user_id", "label", "prediction")
