"""Queries of spoken numerals, loops, names across scripts, addresses, matching and mapping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkweave.functions import names as A
from talkweave.functions import numerals as D
from talkweave.functions import text as T
from talkweave.operators import intervals as I
from talkweave.operators import repetition as L
from talkweave.operators import sequential as Q
from talkweave.operators import spans as S
from talkweave.plans.intervallic import SECOND, SEG, hypothesis, segments
from talkweave.plans.registry import load, register

PHONE = "'07' || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0')"
SAY = "array_to_string(list_transform(str_split({}, ''), lambda d: list_extract(" + repr([D.LATIN[n].split()[0] for n in range(10)]) + ", CAST(d AS INTEGER) + 1)), 'i ')"


def phones(spark, sf_dir):
    """A ten-digit number for each customer."""
    return load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("07"), F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0")).alias("digits"))


@register("T32_say_digits", f"SELECT c_custkey, {SAY.format(PHONE)} AS said FROM customer")
def say_digits(spark, sf_dir):
    return phones(spark, sf_dir).select("c_custkey", D.said_digits(F.col("digits")).alias("said"))


@register("T31_read_numerals", f"SELECT c_custkey, {PHONE} AS digits FROM customer")
def read_numerals(spark, sf_dir):
    """Numbers that were said come back."""
    return phones(spark, sf_dir).select("c_custkey", D.decoded(D.said_digits(F.col("digits"))).alias("x")).select("c_custkey", "x.digits")


@register("T33_number_runs", f"WITH p AS (SELECT c_custkey, c_name || ' said, ' AS before, {SAY.format(PHONE)} AS said, {PHONE} AS digits FROM customer) SELECT c_custkey, CAST(length(before) AS INTEGER) AS \"start\", CAST(length(before || said) AS INTEGER) AS \"end\", digits FROM p")
def number_runs(spark, sf_dir):
    p = phones(spark, sf_dir).join(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    text = F.concat("c_name", F.lit(" said, "), D.said_digits(F.col("digits")), F.lit(". Thanks"))
    return p.select("c_custkey", F.inline(D.number_runs(text))).drop("doubtful")


def decode_seconds():
    """A length in seconds that goes with a text: fifteen letters a second, at most a minute."""
    return F.least(F.col("n_chars") / 15.0, F.lit(60.0))


@register("T29_loops")
def loops(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", L.reasons("text", decode_seconds()).alias("reasons"))
    return d.select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


@register("T29_cut_loops")
def cut_loops(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", L.truncated("text", F.length("text") / 15.0).alias("text"))


@register("T29_too_long", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 10 * least(n_chars / 15.0, 60) + 5 AS too_long FROM documents")
def too_long(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", L.too_long(F.col("text"), decode_seconds()).alias("too_long"))


@register("F3_span_script", "SELECT * FROM (VALUES (1, 'LATIN'), (2, 'SINHALA'), (3, 'SINHALA'), (4, 'LATIN')) v(id, script)")
def span_scripts(spark, sf_dir):
    rows = [(1, "Nimal", "transcript"), (2, "නිමල්", "transcript"), (3, "077123", "clean_si"), (4, "077123", "summary")]
    return spark.createDataFrame(rows, "id int, surface string, kind string").select("id", A.span_script(F.col("surface"), F.col("kind")).alias("script"))


@register("F5_romanised", "SELECT conv_id, turn, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > 0 AS romanised FROM conversations")
def romanised(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", A.is_romanised(F.col("text")).alias("romanised"))


@register("F11_read_out", r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[ ,.][0-9]+)+') AS spans FROM documents), s AS (SELECT doc_id, unnest(spans) AS span FROM p),
    t AS (SELECT doc_id, span, list_filter(regexp_split_to_array(replace(span, ',', ' '), '\s+'), lambda x: x <> '') AS ts, str_split(span, '.') AS gs FROM s)
    SELECT doc_id, span, len(ts) >= 7 AND len(list_filter(ts, lambda x: regexp_matches(x, '^[0-9]{2,}$'))) = 0 AS read_out, len(gs) = 3 AND len(list_filter(gs, lambda g: length(g) = 4)) > 0 AS like_date FROM t""")
def read_out(spark, sf_dir):
    s = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[ ,.][0-9]+)+"), F.lit(0))).alias("span"))
    return s.select("doc_id", "span", A.read_out(F.col("span")).alias("read_out"), A.like_date(F.col("span")).alias("like_date"))


@register("T17_variants", "SELECT * FROM (VALUES (1, 'නිමල්ට නිමල්'), (2, 'කවීනුයි කවීනු කවීන්'), (3, 'Nimal'), (4, 'ගෙ')) v(id, forms)")
def name_variants(spark, sf_dir):
    rows = [(1, "නිමල්ට"), (2, "කවීනුයි"), (3, "Nimal"), (4, "ගෙ")]
    return spark.createDataFrame(rows, "id int, t string").select("id", F.array_join(A.variants(F.col("t")), " ").alias("forms"))


@register("T26_sentence_parts", "SELECT * FROM (VALUES (1, 'Nimal|Perera came'), (2, 'Dr. Nimal'), (3, 'Ann|Mr. Bob|Cy')) v(id, parts)")
def sentence_parts(spark, sf_dir):
    rows = [(1, "Nimal. Perera came"), (2, "Dr. Nimal"), (3, "Ann. Mr. Bob. Cy")]
    return spark.createDataFrame(rows, "id int, t string").select("id", F.array_join(A.sentence_parts(F.col("t")), "|").alias("parts"))


@register("P14_trim_names", "SELECT * FROM (VALUES (1, 9, 'Dilshan'), (2, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR)), (3, 0, 'Kamala aunty'), (4, NULL, NULL), (5, 0, 'Ann')) v(id, skip, name)")
def trim_names(spark, sf_dir):
    rows = [(1, "Sthuthi, Dilshan"), (2, "Hari thanks"), (3, "Kamala aunty"), (4, "Sir"), (5, "Ann, thank you")]
    x = spark.createDataFrame(rows, "id int, t string").select("id", A.trimmed_name(F.col("t")).alias("x"))
    return x.select("id", "x.skip", "x.name")


@register("E2_mention_similarity", "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false), (5, false), (6, true)) v(id, same)")
def mention_similarity(spark, sf_dir):
    rows = [(1, "Mr. Perera", "Nimal Perera"), (2, "Kasun", "කසුන්ට"), (3, "Kamal Perera", "Nimal Perera"), (4, "Nimal", "Nimali"), (5, "", "Nimal"), (6, "Nimal", "නිමල් පෙරේරා")]
    p = spark.createDataFrame(rows, "id int, a string, b string").select("id", A.mention_keys(F.col("a")).alias("a"), A.mention_keys(F.col("b")).alias("b"))
    return p.select("id", (A.mention_similarity(F.col("a"), F.col("b")) >= 0.775).alias("same"))


@register("E5_addresses", "SELECT * FROM (VALUES (1, true, true), (2, false, false), (3, false, true), (4, true, false), (5, true, true), (6, false, false)) v(id, same, part)")
def addresses(spark, sf_dir):
    rows = [(1, "No. 82/1, Temple Road", "82/1 පන්සල පාර, Nugegoda"), (2, "12 Galle Road", "14 Galle Road"), (3, "Nugegoda", "No. 82/1, Wijerama Road, Nugegoda"), (4, "No. 23", "No. 23, Temple Road"), (5, "Colombo 07", "කොළඹ 7"), (6, "", "")]
    p = spark.createDataFrame(rows, "id int, a string, b string")
    p = p.select("*", D.number_runs_of_any(F.lower("a")).alias("said_a"), D.number_runs_of_any(F.lower("b")).alias("said_b"))
    s = p.select("id", *[A.signature(F.col(c), F.col(f"said_{c}")).alias(c) for c in ("a", "b")])
    return s.select("id", A.same_address(F.col("a"), F.col("b")).alias("same"), A.part_of(F.col("a"), F.col("b")).alias("part"))


@register("E7_address_links", "SELECT * FROM (VALUES ('a', 1, 0), ('a', 2, 0), ('a', 3, 1), ('a', 4, 2), ('b', 1, 0), ('b', 2, 0)) v(rid, mention_id, cluster)")
def address_links(spark, sf_dir):
    """A shortened mention that fits two addresses stays apart."""
    rows = [("a", 1, "No. 82/1, Temple Road, Colombo 7"), ("a", 2, "82/1 පන්සල පාර, Colombo 7"), ("a", 3, "14 Lake Road, Colombo 7"), ("a", 4, "Colombo 7"), ("b", 1, "No. 5, Wijerama Road, Nugegoda"), ("b", 2, "Nugegoda")]
    m = load(spark, sf_dir, "nation").sparkSession.createDataFrame(rows, "rid string, mention_id int, t string").withColumn("said", D.number_runs_of_any(F.lower("t")))
    return Q.address_clusters(m.select("rid", "mention_id", A.signature(F.col("t"), F.col("said")).alias("sig")))


@register("P16_propagate_names", "SELECT * FROM (VALUES (2, 0, 12, 'නිමල් පෙරේරා'), (3, 6, 11, 'nimal')) v(doc_id, \"start\", \"end\", surface)")
def propagate_names(spark, sf_dir):
    """A name that was found once, in other documents of the recording: the other script, a case ending, small letters."""
    docs = [("r", 1, "I am Nimal Perera.", False), ("r", 2, "නිමල් පෙරේරාට කතා කළා", False), ("r", 3, "hello nimal", True), ("r", 4, "hello nimal", False), ("q", 5, "Nimal Perera", True)]
    d = load(spark, sf_dir, "nation").sparkSession.createDataFrame(docs, "rid string, doc_id int, text string, lower_case boolean")
    return S.propagated_names(d, spark.createDataFrame([("r", 1, 5, 17, "Nimal Perera")], "rid string, doc_id int, start int, end int, surface string"))


@register("W5_matched_words")
def matched_words(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = load(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), before.alias("ref"), F.col("text").alias("hyp"))
    return Q.matched_words(p)


def cooccurrence(spark, sf_dir):
    other = hypothesis(spark, sf_dir).select("clip", F.col("speaker").alias("hyp"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    both = I.range_join(segments(spark, sf_dir), other, ["clip"], 600 * SECOND)
    shared = F.least("end", "other_end") - F.greatest("start", "other_start")
    return both.groupBy("clip", F.col("speaker").alias("ref"), "hyp").agg(F.sum(shared).alias("seconds"))


@register("I12_greedy_mapping")
def greedy_mapping(spark, sf_dir):
    return I.greedy_mapping(cooccurrence(spark, sf_dir).withColumn("seconds", F.col("seconds").cast("double")))


@register("I16_friendly_names")
def friendly_names(spark, sf_dir):
    pairs = I.assignment(cooccurrence(spark, sf_dir).withColumn("seconds", F.col("seconds").cast("double")))
    return I.friendly_names(segments(spark, sf_dir), hypothesis(spark, sf_dir), pairs)


@register("I20_split_at_pauses")
def split_at_pauses(spark, sf_dir):
    """Events of a user in parts of at most six hours, cut at the longest pauses."""
    s = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), I.seconds(F.col("ts").cast("timestamp")).alias("start")).withColumn("end", F.col("start") + 1)
    return Q.parts(s, "user_id", 21600.0)


@register("M20_support", f"""WITH {SEG}, m AS (SELECT *, max(e) OVER (PARTITION BY clip, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
    k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 250000 THEN 1 ELSE 0 END) OVER (PARTITION BY clip, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT clip, speaker, min(s) AS "start", max(e) AS "end" FROM k GROUP BY clip, speaker, island""")
def support(spark, sf_dir):
    return I.islands(segments(spark, sf_dir), ["clip", "speaker"], SECOND // 4)


def tokens_inside(tokens, clips):
    """Tokens inside a clip of ten minutes, give or take a twentieth of a second, by the clip's own time."""
    edge = SECOND // 20
    c = clips.select("clip", F.col("event_id").alias("clip_id"), (F.col("start") - edge).alias("other_start"), (F.col("start") + 600 * SECOND + edge).alias("other_end"))
    short = tokens.where((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") <= 600 * SECOND + 2 * edge))
    inside = I.inside_join(short.select("clip", "event_id", "start", "end"), c, ["clip"], 1800 * SECOND)
    began = F.col("other_start") + edge
    return inside.select("clip_id", F.col("event_id").alias("token"), (F.col("start") - began).alias("start"), (F.col("end") - began).alias("end"))


@register("M1_clip_tokens", f"""WITH {SEG}, c AS (SELECT event_id AS clip_id, clip, s, s + 600000000 AS e FROM seg)
    SELECT c.clip_id, t.event_id AS token, t.s - c.s AS "start", t.e - c.s AS "end" FROM seg t JOIN c ON t.clip = c.clip AND t.s >= c.s - 50000 AND t.e <= c.e + 50000 WHERE t.e > t.s""")
def clip_tokens(spark, sf_dir):
    """The tokens of every event's clip."""
    s = segments(spark, sf_dir)
    return tokens_inside(s, s)


@register("L10_leave_one_out", """WITH t AS (SELECT user_id, round(avg(value), 6) AS v FROM events GROUP BY user_id)
    SELECT t.user_id, t.v > (SELECT max(b.v) FROM t b WHERE b.user_id <> t.user_id) * 0.8 AS recalled FROM t""")
def leave_one_out(spark, sf_dir):
    """Whether a user exceeds four fifths of the largest of all others: the two largest say it for everyone."""
    t = load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    top = t.orderBy(F.desc("v"), "user_id").limit(2).agg(F.max_by("user_id", F.struct("v", -F.col("user_id"))).alias("first"), F.max("v").alias("most"), F.min("v").alias("next"), F.count("*").alias("n"))
    rest = F.when(F.col("n") > 1, F.when(F.col("user_id") == F.col("first"), F.col("next")).otherwise(F.col("most")))
    return t.join(F.broadcast(top)).select("user_id", (F.col("v") > rest * 0.8).alias("recalled"))


DRAWS = 1000


@register("I18_bootstrap", f"""WITH c AS (SELECT clip, row_number() OVER (ORDER BY clip) - 1 AS i, err, total FROM (SELECT strftime(ts, '%Y-%m-%d') AS clip, sum(CASE WHEN event_type = 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS err, sum(CAST(round(value * 100) AS BIGINT)) AS total FROM events GROUP BY 1) x),
    d AS (SELECT b, (((b * 7919 + k * 104729 + 12345) * 1103515245) % 2147483648) // 65536 % (SELECT count(*) FROM c) AS i FROM range({DRAWS}) r(b), (SELECT i AS k FROM c) y),
    r AS (SELECT b, CAST(sum(err) AS DOUBLE) / CAST(sum(total) AS DOUBLE) AS m FROM d JOIN c USING (i) GROUP BY b)
    SELECT count(*) AS draws, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM r""")
def bootstrap(spark, sf_dir):
    return I.bootstrap(
        load(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("clip")).agg(
            F.sum(F.when(F.col("event_type") == "error", F.round(F.col("value") * 100).cast("long")).otherwise(0)).alias("err"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")
        ), "clip", DRAWS,
    )
