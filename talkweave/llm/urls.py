"""URL filters: fixed rules first, then association rules that FP-growth mines from labelled URLs.

The mined rules are token combinations with a minimum support that imply "block" with a minimum
confidence; a rule is dropped if one with fewer tokens does as well. Tokens are not capped: what
cannot change which URLs a rule matches is taken out before the growth. The rules match by an inverted
index: a rule stands under its rarest token, and only URLs with that token are compared with it.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import written

#: (rule, verdict), rule being host and path; of those that fit a URL the longest decides.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: The labelled table: words that mark a URL as unwanted wherever they stand in its host, by kind.
SEEDS = {
    "gambling": "bet bets betting bingo casino casinos gamble gambling jackpot lotto poker roulette slots wager",
    "medicine": "cialis meds pharma pills pharmacy steroids viagra",
    "adult": "adult camgirls erotic escort escorts hentai nude porn sex sexy xxx",
    "spam": "freebies giveaway replica scam sexting spam spammer spamming traffic warez",
    "advertising": "ad ads adserver adsrv adtech banners clickbait doubleclick popads popunder track tracker trackers tracking",
    "fraud": "crack cracked keygen loans malware payday phish phishing torrent torrents",
}
SUPPORT, CONFIDENCE = 0.001, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fits(rule: str) -> Column:
    """Whether a rule fits the columns host and path."""
    name, _, begin = rule.partition("/")
    return ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + begin)


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls with host, path, rule and ruled_ (the rule's verdict), both null where no rule fits."""
    out = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule = F.when(fits(text), text) if rule is None else rule.when(fits(text), text)
        verdict = F.when(fits(text), said) if verdict is None else verdict.when(fits(text), said)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "ruled_": none if verdict is None else verdict})


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: all labels of its host, all words of a host that has hyphens, the
    first folder of the path, all other parts of the path, and the names of all query parameters;
    digits in the path as 0."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    words = F.filter(F.split("host", r"[.-]"), lambda x: x != "")
    first = F.regexp_replace(F.regexp_extract("path", r"^/([^/]+)/", 1), "[0-9]+", "0")
    parts = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1), F.lit(""))
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tag = lambda kind, array: F.transform(array, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(
        F.concat(
            tag("host:", labels),
            tag("word:", F.when(F.instr("host", "-") > 0, words).otherwise(F.array().cast("array<string>"))),
            F.when(first != "", F.array(F.concat(F.lit("path:"), first))).otherwise(F.array().cast("array<string>")),
            tag("part:", F.filter(parts, lambda x, i: (i > 0) | (first == ""))),
            tag("query:", names),
        )
    )


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (rule_id, needs, confidence, support) from labelled (tokens, label), label block or allow.

    Rules are as many as the support allows, however many URLs there are. A token that is a rule
    alone is in no longer one, and of tokens that occur in the same rows the rules name the least:
    neither changes which of these rows the rules match, and long URLs do not multiply the rules.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, needs array<string>, confidence double, support double")
    baskets = labelled.where(F.size("tokens") > 0).select("tokens", "label")
    n = baskets.count()
    if not n:
        return empty
    # a token below the support among the blocked is in no rule
    rows = baskets.select(F.explode("tokens").alias("token"), (F.col("label") == "block").cast("int").alias("block_"), F.xxhash64(F.array_sort("tokens")).cast("decimal(20,0)").alias("row_"))
    known = rows.groupBy("token").agg(F.count("*").alias("n_"), F.sum("block_").alias("block_"), F.sum("row_").alias("rows_")).where(F.col("block_") >= ceil(support * n))
    known = written(known.withColumn("confidence", F.col("block_") / F.col("n_")), "url-tokens")
    alone = known.where(F.col("confidence") >= confidence).select(F.array("token").alias("needs"), "confidence", (F.col("block_") / n).alias("support"))
    same = known.where(F.col("confidence") < confidence).groupBy("n_", "block_", "rows_").agg(F.min("token").alias("token"))
    used = F.broadcast(same.agg(F.collect_list("token").alias("used_")))
    baskets = baskets.crossJoin(used).select(F.concat(F.array_intersect("tokens", "used_"), F.array(F.concat(F.lit("="), "label"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    block = found.where((F.col("consequent")[0] == "=block") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    rules = block.select(F.array_sort("antecedent").alias("needs"), "confidence", "support").unionAll(alone)
    rules = written(rules.select(F.monotonically_increasing_id().alias("rule_id"), "*"), "url-rules")
    # a rule goes if leaving out one token gives a rule that is as sure
    less = rules.select("rule_id", "confidence", F.explode("needs").alias("gone"), "needs").where(F.size("needs") > 1)
    less = less.select("rule_id", "confidence", F.array_remove("needs", F.col("gone")).alias("inner"))
    spare = less.join(rules.select(F.col("needs").alias("inner"), F.col("confidence").alias("sure")), "inner").where("sure >= confidence").select("rule_id").distinct()
    return rules.join(spare, "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The ids (uid_) of urls (uid_, tokens) that hold all tokens of any rule."""
    count = rules.select(F.explode("needs").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    index = rules.select("rule_id", "needs", F.explode("needs").alias("token")).join(count, "token")
    index = index.groupBy("rule_id").agg(F.min(F.struct("uses", "token", "needs")).alias("x")).select("x.token", "x.needs")
    index = index.groupBy("token").agg(F.collect_list("needs").alias("all_needs"))  # what one token has is bounded by the support
    posted = urls.select("uid_", "tokens", F.explode("tokens").alias("token"))
    hit = posted.join(index, "token").where(F.exists("all_needs", lambda needs: F.size(F.array_except(needs, F.col("tokens"))) == 0))
    return hit.select("uid_").distinct()


def labelled(base: DataFrame, seeds=SEEDS, hosts: DataFrame | None = None) -> DataFrame:
    """base (host, ruled_, ...) with a column label: the fixed rule's verdict, else that of the table
    hosts (host, label; block wins where a host has both), else block for a host with a seed word,
    else allow."""
    words = sorted({w for group in (seeds.values() if isinstance(seeds, dict) else seeds) for w in group.split()})
    seeded = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    told = F.lit(None).cast("string")
    if hosts is not None:
        base = base.join(hosts.groupBy("host").agg(F.max("label").alias("told_")), "host", "left")
        told = F.col("told_")
    return base.withColumn("label", F.coalesce("ruled_", told, F.when(seeded, "block"), F.lit("allow"))).drop("told_")


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, support: float = SUPPORT, confidence: float = CONFIDENCE, hosts: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages.

    labelled() says what the rules are mined from. What no rule fits is blocked if a mined rule
    matches and allowed otherwise. Null urls, and those without "://", have an empty host and path, no tokens and are
    allowed. Rows that repeat get a row each; page_id may be null; further columns are not read; an
    empty table gives no rows.
    """
    base = ruled(pages.select("page_id", "url"), rules).withColumn("tokens", F.array_sort(tokens(F.col("url"))))
    base = written(base.select("page_id", "host", "path", "rule", "ruled_", "tokens"), "urls")
    open_ = base.where("rule is null").select(F.col("tokens").alias("uid_"), "tokens").distinct()  # URLs of the same tokens are looked up once
    hits = matched(open_, mined(labelled(base, seeds, hosts), support, confidence)).select(F.col("uid_").alias("tokens"), F.lit(True).alias("hit_"))
    verdict = F.coalesce("ruled_", F.when(F.col("hit_"), "block"), F.lit("allow"))
    return base.join(hits, "tokens", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
