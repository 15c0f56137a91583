"""Text scalars, token language, code switching and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkweave.operators.ranks import ranked
from talkweave.functions import text as T
from talkweave.plans.registry import load, register


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token: conv_id, turn, tok_id, token."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.words(F.col("text"))).alias("tok_id", "token"))


TOKENS = r"""
tokens AS (
  SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS tok_id, ws[i] AS token
  FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws FROM conversations)))
"""

#: A token's language on these tables: frequent in the English documents or not; numbers apart.
ENGLISH = 1e-4
FREQ = rf"""
english AS (
  SELECT word, count(*) / (sum(count(*)) OVER ()) AS freq
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents WHERE lang = 'en') GROUP BY word),
tagged AS (
  SELECT t.*, freq, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'OTHER' WHEN freq >= {ENGLISH} THEN 'EN' ELSE 'SI' END AS lang
  FROM tokens t LEFT JOIN english e ON lower(t.token) = e.word)
"""


def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(T.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("word", (F.col("n") / F.col("total")).alias("freq"))


def tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with their language label."""
    tokens = conversation_tokens(spark, sf_dir).withColumn("word", F.lower("token"))
    lang = F.when(F.col("token").rlike("^[0-9]+$"), "OTHER").when(F.col("freq") >= ENGLISH, "EN").otherwise("SI")
    return tokens.join(word_frequencies(spark, sf_dir), "word", "left").withColumn("lang", lang)


def labelled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with their language label alone. Fewer than 1 / ENGLISH words can be that frequent, so
    they are broadcast and the tokens stay where they are."""
    frequent = word_frequencies(spark, sf_dir).where(F.col("freq") >= ENGLISH).select("word", F.lit(True).alias("english"))
    tokens = conversation_tokens(spark, sf_dir).withColumn("word", F.lower("token")).join(F.broadcast(frequent), "word", "left")
    lang = F.when(F.col("token").rlike("^[0-9]+$"), "OTHER").when(F.col("english"), "EN").otherwise("SI")
    return tokens.withColumn("lang", lang).drop("english")


@register("L8_token_stream", f"WITH {TOKENS} SELECT * FROM tokens")
def token_stream(spark, sf_dir):
    return conversation_tokens(spark, sf_dir)


@register(
    "L1_rule_language",
    f"""WITH {TOKENS}, {FREQ} SELECT conv_id, turn, tok_id, token, lang,
        round(CASE WHEN lang = 'OTHER' THEN 0.5 WHEN lang = 'EN' THEN 0.5 + 0.45 * least(1, greatest(0, log10(freq / {ENGLISH}) / 2))
              WHEN freq IS NULL THEN 0.9 ELSE 0.5 + 0.4 * least(1, greatest(0, log10({ENGLISH} / freq) / 2)) END, 4) AS confidence FROM tagged""",
)
def rule_language(spark, sf_dir):
    above, below = F.log10(F.col("freq") / ENGLISH) / 2, F.log10(ENGLISH / F.col("freq")) / 2
    scaled = lambda x, top: 0.5 + (top - 0.5) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    sure = F.when(F.col("lang") == "OTHER", 0.5).when(F.col("lang") == "EN", scaled(above, 0.95)).when(F.col("freq").isNull(), 0.9).otherwise(scaled(below, 0.9))
    return tagged_tokens(spark, sf_dir).select("conv_id", "turn", "tok_id", "token", "lang", F.round(sure, 4).alias("confidence"))


def switched(tokens: DataFrame) -> DataFrame:
    """switch: the language differs from that of the token before, within a turn."""
    before = F.lag("lang").over(Window.partitionBy("conv_id", "turn").orderBy("tok_id"))
    return tokens.withColumn("switch", F.coalesce(before != F.col("lang"), F.lit(False)))


SWITCH = "switched AS (SELECT *, coalesce(lag(lang) OVER (PARTITION BY conv_id, turn ORDER BY tok_id) <> lang, false) AS switch FROM tagged)"


@register("L3_switches", f"WITH {TOKENS}, {FREQ}, {SWITCH} SELECT conv_id, turn, tok_id, lang, switch FROM switched")
def switches(spark, sf_dir):
    return switched(labelled_tokens(spark, sf_dir)).select("conv_id", "turn", "tok_id", "lang", "switch")


@register(
    "L5_code_mixing",
    f"""WITH {TOKENS}, {FREQ}, {SWITCH}, c AS (SELECT conv_id, lang, count(*) AS n, count(*) FILTER (switch) AS s FROM switched GROUP BY conv_id, lang)
        SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(s) AS BIGINT) AS n_switches, round(100.0 * (sum(n) - max(n)) / sum(n), 2) AS cmi FROM c GROUP BY conv_id""",
)
def code_mixing(spark, sf_dir):
    counts = switched(labelled_tokens(spark, sf_dir)).groupBy("conv_id", "lang").agg(F.count("*").alias("n"), F.count_if("switch").alias("s"))
    total = F.sum("n")
    return counts.groupBy("conv_id").agg(total.alias("n_tokens"), F.sum("s").alias("n_switches"), F.round(100.0 * (total - F.max("n")) / total, 2).alias("cmi"))


CMI = f"""{TOKENS}, {FREQ}, m AS (SELECT conv_id, turn, round(100.0 * (sum(n) - max(n)) / sum(n), 2) AS cmi FROM
          (SELECT conv_id, turn, lang, count(*) AS n FROM tagged GROUP BY ALL) GROUP BY conv_id, turn)"""


@register(
    "L6_mixing_summary",
    f"WITH {CMI} SELECT count(*) AS n, round(avg(cmi), 4) AS mean_cmi, round(median(cmi), 4) AS median_cmi, round(stddev_samp(cmi), 4) AS sd_cmi, round(avg(CAST(cmi = 0 AS INTEGER)), 4) AS monolingual, round(avg(CAST(cmi > 25 AS INTEGER)), 4) AS mixed FROM m",
)
def mixing_summary(spark, sf_dir):
    counts = labelled_tokens(spark, sf_dir).groupBy("conv_id", "turn", "lang").agg(F.count("*").alias("n"))
    cmi = counts.groupBy("conv_id", "turn").agg(F.round(100.0 * (F.sum("n") - F.max("n")) / F.sum("n"), 2).alias("cmi"))
    r = lambda c, name: F.round(c, 4).alias(name)
    return cmi.agg(
        F.count("*").alias("n"), r(F.avg("cmi"), "mean_cmi"), r(F.percentile("cmi", F.lit(0.5)), "median_cmi"), r(F.stddev_samp("cmi"), "sd_cmi"),
        r(F.avg((F.col("cmi") == 0).cast("int")), "monolingual"), r(F.avg((F.col("cmi") > 25).cast("int")), "mixed"),
    )


@register(
    "L4_switch_scores",
    f"""WITH {TOKENS}, {FREQ}, g AS (SELECT *, coalesce(lag(lang) OVER (PARTITION BY conv_id, turn ORDER BY tok_id) <> lang, false) AS gold,
         coalesce(lag(length(token) > 4) OVER (PARTITION BY conv_id, turn ORDER BY tok_id) <> (length(token) > 4), false) AS pred FROM tagged),
        k AS (SELECT count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (gold AND NOT pred) AS fn FROM g)
        SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS p, round(tp / (tp + fn), 4) AS r, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1 FROM k""",
)
def switch_scores(spark, sf_dir):
    """The switches of a length-based tagger against those of the language tagger."""
    order = Window.partitionBy("conv_id", "turn").orderBy("tok_id")
    long = F.length("token") > 4
    t = switched(labelled_tokens(spark, sf_dir)).withColumn("pred", F.coalesce(F.lag(long).over(order) != long, F.lit(False)))
    k = t.agg(F.count_if(F.expr("switch and pred")).alias("tp"), F.count_if(F.expr("pred and not switch")).alias("fp"), F.count_if(F.expr("switch and not pred")).alias("fn"))
    return k.select("tp", "fp", "fn", F.expr("round(tp / (tp + fp), 4) as p"), F.expr("round(tp / (tp + fn), 4) as r"), F.expr("round(2.0d * tp / (2 * tp + fp + fn), 4) as f1"))


@register(
    "L11_class_scores",
    f"""WITH {TOKENS}, {FREQ}, g AS (SELECT lang AS gold, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'OTHER' WHEN length(token) <= 4 THEN 'EN' ELSE 'SI' END AS pred FROM tagged),
        l AS (SELECT DISTINCT gold AS label FROM g)
        SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn,
        round(2.0 * count(*) FILTER (gold = label AND pred = label) / (count(*) FILTER (gold = label) + count(*) FILTER (pred = label)), 4) AS f1
        FROM l, g GROUP BY label""",
)
def class_scores(spark, sf_dir):
    pred = F.when(F.col("token").rlike("^[0-9]+$"), "OTHER").when(F.length("token") <= 4, "EN").otherwise("SI")
    confusion = labelled_tokens(spark, sf_dir).groupBy(F.col("lang").alias("gold"), pred.alias("pred")).agg(F.count("*").alias("n"))
    sides = confusion.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(True).alias("is_gold")), F.struct(F.col("pred").alias("label"), F.lit(False).alias("is_gold")))).alias("x"), F.expr("gold = pred as same"), "n")
    out = sides.groupBy("x.label").agg(F.expr("sum(if(x.is_gold and same, n, 0)) as tp"), F.expr("sum(if(not x.is_gold and not same, n, 0)) as fp"), F.expr("sum(if(x.is_gold and not same, n, 0)) as fn"), F.expr("count_if(x.is_gold) as g"))
    return out.where("g > 0").select("label", "tp", "fp", "fn", F.expr("round(2.0d * tp / (2 * tp + fp + fn), 4) as f1"))


@register(
    "L12_balanced_folds",
    """WITH n AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id), r AS (SELECT *, row_number() OVER (ORDER BY turns DESC, conv_id) - 1 AS rn FROM n)
       SELECT conv_id, turns, CASE WHEN (rn // 5) % 2 = 0 THEN rn % 5 ELSE 4 - rn % 5 END AS fold FROM r""",
)
def balanced_folds(spark, sf_dir):
    """Conversations dealt to five folds, largest first, to and fro."""
    n = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    out = ranked(n, [F.desc("turns"), "conv_id"], "rn").withColumn("rn", F.col("rn") - 1)
    return out.select("conv_id", "turns", F.expr("if((rn div 5) % 2 = 0, rn % 5, 4 - rn % 5) as fold"))


NGRAMS = r"""w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents WHERE lang IN ('en', 'fr')),
    p AS (SELECT lang, '^' || word || '$' AS p FROM w), g AS (SELECT lang, substring(p, i, 3) AS gram FROM (SELECT lang, p, unnest(range(1, length(p) - 1)) AS i FROM p))"""


@register("L9_ngram_model", f"WITH {NGRAMS} SELECT lang, gram, count(*) AS n, round(ln((count(*) + 1.0) / (sum(count(*)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))), 6) AS logp FROM g GROUP BY lang, gram")
def ngram_model(spark, sf_dir):
    """Trigram counts of two languages with add-one log probabilities."""
    w = load(spark, sf_dir, "documents").where("lang in ('en', 'fr')").select("lang", F.explode(T.words(F.lower("text"))).alias("word"))
    w = w.groupBy("lang", "word").agg(F.count("*").alias("times"))  # words recur, so their trigrams are cut once
    counts = w.select("lang", "times", F.explode(T.grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("times").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("vocabulary"))
    return counts.join(F.broadcast(totals), "lang").select("lang", "gram", "n", F.round(F.log((F.col("n") + 1.0) / (F.col("total") + F.col("vocabulary"))), 6).alias("logp"))


@register(
    "L14_label_audit",
    f"""WITH {TOKENS}, {FREQ}, c AS (SELECT conv_id, count(*) AS n_tokens, count(*) FILTER (lang = 'SI') AS si, count(*) FILTER (lang = 'EN') AS en, count(*) FILTER (lang = 'OTHER') AS other FROM tagged GROUP BY conv_id)
        SELECT *, round(greatest(si, en, other) / n_tokens, 4) AS top_share, array_to_string(list_filter([CASE WHEN greatest(si, en, other) / n_tokens > 0.9 THEN 'bulk' END, CASE WHEN other > 0 THEN 'numbers' END, CASE WHEN n_tokens < 50 THEN 'short' END], lambda x: x IS NOT NULL), ';') AS issues FROM c""",
)
def label_audit(spark, sf_dir):
    c = labelled_tokens(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n_tokens"), *[F.count_if(F.col("lang") == k).alias(k.lower()) for k in ("SI", "EN", "OTHER")])
    top = F.greatest("si", "en", "other") / F.col("n_tokens")
    issues = F.array_compact(F.array(F.when(top > 0.9, "bulk"), F.when(F.col("other") > 0, "numbers"), F.when(F.col("n_tokens") < 50, "short")))
    return c.select("*", F.round(top, 4).alias("top_share"), F.array_join(issues, ";").alias("issues"))


@register(
    "L15_key_collapse",
    r"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM conversations), k AS (SELECT word, regexp_replace(word, '[aeiouy]', '', 'g') AS skeleton FROM w)
        SELECT skeleton, count(*) AS forms, array_to_string(list_sort(list(word)), '|') AS members FROM k GROUP BY skeleton HAVING count(*) > 1""",
)
def key_collapse(spark, sf_dir):
    """Words that one consonant skeleton merges."""
    w = load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    k = w.groupBy(T.skeleton(F.col("word")).alias("skeleton")).agg(F.count("*").alias("forms"), F.array_join(F.array_sort(F.collect_list("word")), "|").alias("members"))
    return k.where("forms > 1")


@register(
    "L16_relabel_draft",
    f"WITH {TOKENS}, {FREQ} SELECT conv_id, turn, tok_id, token, lang AS draft, (lang <> CASE WHEN length(token) <= 4 THEN 'EN' ELSE 'SI' END OR coalesce(freq, 0) < {ENGLISH} * 10) AS review FROM tagged",
)
def relabel_draft(spark, sf_dir):
    old = F.when(F.length("token") <= 4, "EN").otherwise("SI")
    return tagged_tokens(spark, sf_dir).select("conv_id", "turn", "tok_id", "token", F.col("lang").alias("draft"), ((F.col("lang") != old) | (F.coalesce("freq", F.lit(0.0)) < ENGLISH * 10)).alias("review"))


# -- scalars, on utterances and inline cases --

CASES = """(VALUES (1, 'um mama bank-eka giya uh , one'), (2, 'binduwai ekai hathara  mokadda!!'), (3, 'namaඅද hello'), (4, ' ,a ,, b ?! er'), (5, ''), (6, 'Onee ONNEDA wala-wala car-ekata'))"""
SWAP = "regexp_replace({}, '(?i)(^|[^A-Za-z])({})([^A-Za-z]|$)', '\\1{}\\3', 'g')"


def cases(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {CASES} AS t(id, text)")


@register("T3_tidy", rf"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+([,.?!])', '\1', 'g'), '([,.?!]){{2,}}', '\1', 'g'), '\s+', ' ', 'g'), ' ,') AS tidy FROM {CASES} t(id, text)")
def tidy(spark, sf_dir):
    return cases(spark).select("id", T.tidy(F.col("text")).alias("tidy"))


@register("T2_fillers", f"SELECT id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND NOT list_contains({list(T.FILLERS)!r}, lower(trim(w, ',.?!')))), ' ') AS kept FROM {CASES} t(id, text)")
def fillers(spark, sf_dir):
    return cases(spark).select("id", T.without_fillers(F.col("text")).alias("kept"))


@register("T1_split_mixed", rf"SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b([A-Za-z]+)-({'|'.join(T.CLITICS)})\b', '\1 \2', 'g'), '([A-Za-z])([\x{{0D80}}-\x{{0DFF}}])', '\1 \2', 'g'), '([\x{{0D80}}-\x{{0DFF}}\x{{200D}}])([A-Za-z])', '\1 \2', 'g') AS split FROM {CASES} t(id, text)")
def split_mixed(spark, sf_dir):
    return cases(spark).select("id", T.split_mixed(F.col("text")).alias("split"))


@register(
    "T4_spoken_digits",
    f"SELECT id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda w: coalesce(map_extract_value(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in {**T.SPOKEN_DIGITS, **T.SPELLING}.items())}}}, lower(w)), w)), '') AS prepared FROM {CASES} t(id, text)",
)
def spoken_digits(spark, sf_dir):
    return cases(spark).select("id", T.prepared(F.col("text")).alias("prepared"))


@register("T5_normalize")
def normalize(spark, sf_dir):
    """The whole normaliser over every utterance."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalized(F.col("text")).alias("clean"))


@register("T11_squash", r"SELECT doc_id, trim(regexp_replace(text, '[\p{P}\p{S}\p{C}\s]+', ' ', 'g')) AS squashed FROM documents")
def squash(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.squashed(F.col("text")).alias("squashed"))


@register("T13_mask", r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '\p{Nd}', '9', 'g'), '[\x{0D80}-\x{0DFF}]', 'ස', 'g'), '[A-Za-z]', 'x', 'g') AS masked FROM conversations")
def mask(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.masked(F.col("text")).alias("masked"))


def _collapse(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


def _replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


NAMES = "w AS (SELECT DISTINCT lower(c_name) AS name FROM customer UNION SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM conversations)"


@register(
    "T14_phonetic_key",
    f"""WITH {NAMES}, a AS (SELECT name, {_collapse(_replaced("regexp_replace(regexp_replace(name, '[^a-z]', '', 'g'), '(ee|ey)$', 'i')", (("nd", "d"), ("mb", "b"), *T.REWRITES)))} AS k FROM w)
        SELECT name, CASE WHEN length(k) > 3 THEN regexp_replace(regexp_replace(k, 'y$', 'i'), '[aeou]+$', '') ELSE k END AS key FROM a""",
)
def phonetic_keys(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"))
    b = load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("name"))
    return a.union(b).distinct().select("name", T.phonetic_key(F.col("name")).alias("key"))


@register("T18_edit_ratio", "SELECT a.r_name AS a, b.n_name AS b, round(1 - levenshtein(a.r_name, b.n_name) / greatest(length(a.r_name), length(b.n_name)), 6) AS ratio FROM region a, nation b")
def edit_ratio(spark, sf_dir):
    a, b = load(spark, sf_dir, "region").select(F.col("r_name").alias("a")), load(spark, sf_dir, "nation").select(F.col("n_name").alias("b"))
    return b.crossJoin(F.broadcast(a)).select("a", "b", F.round(T.ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@register(
    "T20_shape",
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM conversations)
        SELECT token, array_to_string(list_filter([CASE WHEN regexp_matches(token, '^\p{L}+$') AND upper(token) = token AND length(token) > 1 THEN '#allcaps' END, CASE WHEN regexp_matches(token, '^\p{Lu}\p{Ll}') THEN '#cap' END,
        CASE WHEN regexp_matches(token, '\d') THEN '#hasdigit' END, CASE WHEN length(token) <= 2 THEN '#short' END, CASE WHEN length(token) >= 10 THEN '#long' END], lambda x: x IS NOT NULL), ' ') AS shape FROM w""",
)
def shapes(spark, sf_dir):
    w = load(spark, sf_dir, "conversations").select(F.explode(T.words(F.col("text"))).alias("token")).distinct()
    return w.select("token", F.array_join(T.shape(F.col("token")), " ").alias("shape"))


@register("T21_ngrams", rf"WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'))) AS word FROM conversations) SELECT word, array_to_string(list_transform(range(1, length(word) + 1), lambda i: substring('^' || word || '$', i, 3)), '|') AS grams FROM w")
def ngrams(spark, sf_dir):
    w = load(spark, sf_dir, "conversations").select(F.explode(T.words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return w.select("word", F.array_join(T.grams(F.col("word")), "|").alias("grams"))


@register("T22_transcript", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


@register("T24_sentences", r"SELECT doc_id, CAST(len(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS INTEGER) AS n_sentences FROM documents")
def sentences(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", r"(?<=[.!?])\s+")).alias("n_sentences"))


@register("T30_digit_rate", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]')) AS INTEGER) AS digits, len(regexp_extract_all(text, '[0-9]')) > 6 * (length(text) / 15.0) + 2 AS too_many FROM documents")
def digit_rate(spark, sf_dir):
    digits = F.regexp_count("text", F.lit("[0-9]"))
    return load(spark, sf_dir, "documents").select("doc_id", digits.alias("digits"), (digits > 6 * (F.length("text") / 15.0) + 2).alias("too_many"))


@register("F2_token_script", rf"WITH {TOKENS} SELECT DISTINCT token, CASE WHEN regexp_matches(token, '[\x{{0D80}}-\x{{0DFF}}]') THEN 'sinhala' WHEN regexp_matches(token, '[\x{{0B80}}-\x{{0BFF}}]') THEN 'tamil' WHEN regexp_matches(token, '^[\d.,:]+$') THEN 'numeric' ELSE 'latin' END AS script FROM tokens")
def token_scripts(spark, sf_dir):
    return conversation_tokens(spark, sf_dir).select("token", T.token_script(F.col("token")).alias("script")).distinct()


@register("F4_script_bucket", r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) >= 0.95 * len(regexp_extract_all(text, '\p{L}')) THEN 'latin' WHEN len(regexp_extract_all(text, '[A-Za-z]')) <= 0.05 * len(regexp_extract_all(text, '\p{L}')) THEN 'other' ELSE 'mixed' END AS bucket FROM documents")
def script_bucket(spark, sf_dir):
    ascii_, letters = F.regexp_count("text", F.lit("[A-Za-z]")), F.regexp_count("text", F.lit(r"\p{L}"))
    d = load(spark, sf_dir, "documents").select("doc_id", ascii_.alias("a"), letters.alias("l"))
    return d.select("doc_id", F.expr("case when a >= 0.95 * l then 'latin' when a <= 0.05 * l then 'other' else 'mixed' end as bucket"))


@register("F7_candidates", rf"WITH {TOKENS} SELECT conv_id, count(*) AS n FROM tokens WHERE regexp_matches(token, '^\p{{L}}{{3,}}$') GROUP BY conv_id")
def candidates(spark, sf_dir):
    return conversation_tokens(spark, sf_dir).where(F.col("token").rlike(r"^\p{L}{3,}$")).groupBy("conv_id").agg(F.count("*").alias("n"))


@register("F9_languages", f"WITH {TOKENS}, {FREQ} SELECT conv_id, array_to_string(list_sort(list(DISTINCT lang)), '+') AS languages FROM tagged WHERE lang <> 'OTHER' GROUP BY conv_id")
def languages(spark, sf_dir):
    return labelled_tokens(spark, sf_dir).where("lang <> 'OTHER'").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("lang")), "+").alias("languages"))


DIGITS = "(VALUES ('901234567', NULL), ('199912345678', NULL), ('0771234567', 'PHONE'), ('94771234567', NULL), ('123456', 'ACCOUNT'), ('12345678901', 'AMOUNT'), ('123456789012345', NULL), ('07712345678', NULL), ('1234', NULL), ('9912345678', 'NIC'), ('905001234', NULL), ('200136612345', 'ACCOUNT'))"


@register(
    "P7_digit_class",
    f"""SELECT d, c, CASE WHEN c = 'AMOUNT' THEN NULL WHEN c = 'NIC' AND length(d) BETWEEN 9 AND 14 AND d[1] <> '0' THEN 'NIC' WHEN c = 'ACCOUNT' AND length(d) >= 6 THEN 'ACCOUNT'
        WHEN regexp_matches(d, '^94[1-9][0-9]{{8}}$|^0[1-9][0-9]{{8}}$|^0[1-9][0-9]{{9}}$') THEN 'PHONE'
        WHEN length(d) = 12 AND CAST(d[1:4] AS INTEGER) BETWEEN 1900 AND 2025 AND (CAST(d[5:7] AS INTEGER) BETWEEN 1 AND 366 OR CAST(d[5:7] AS INTEGER) BETWEEN 501 AND 866) THEN 'NIC'
        WHEN length(d) = 9 AND (CAST(d[3:5] AS INTEGER) BETWEEN 1 AND 366 OR CAST(d[3:5] AS INTEGER) BETWEEN 501 AND 866) THEN 'NIC' WHEN length(d) BETWEEN 10 AND 18 THEN 'ACCOUNT' END AS label FROM {DIGITS} t(d, c)""",
)
def digit_classes(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {DIGITS} AS t(d, c)").select("d", "c", T.digit_class(F.col("d"), F.col("c"), 2025).alias("label"))


@register("P13_preceding_turn", "SELECT conv_id, turn, lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS preceding FROM conversations")
def preceding(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn")).alias("preceding"))
