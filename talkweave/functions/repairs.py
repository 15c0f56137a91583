"""Repairs of decoded and translated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The joiner of a conjunct, its silent mark, its second letters, and marks around a word.
JOINER, SILENT, SECOND, MARKS = "‍", "්", "රය", ".,?!:;\"'()"
#: Digits that can be said in a second, and how many more may stand.
DIGITS_PER_SECOND, EXTRA_DIGITS = 6.0, 2


def trimmed_digits(text: Column, seconds: Column) -> Column:
    """text without the digits beyond what its seconds can hold, the first ones stay; white space is
    one space each and none at the ends. Null text gives null, null seconds count as none."""
    room = F.floor(F.coalesce(seconds, F.lit(0.0)) * DIGITS_PER_SECOND + EXTRA_DIGITS).cast("int")
    gaps = F.slice(F.split(text, "[0-9]", -1), F.lit(1), room)
    head = F.aggregate(gaps, F.lit(0), lambda n, g: n + F.length(g)) + room
    cut = F.concat(F.substring(text, F.lit(1), head), F.regexp_replace(F.substring(text, head + 1, F.length(text)), "[0-9]", ""))
    kept = F.when(F.regexp_count(text, F.lit("[0-9]")) > room, cut).otherwise(text)
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def conjunct_starts(gold: DataFrame) -> DataFrame:
    """start: the beginnings of words, up to the letter after a joiner, in the texts of ``gold``."""
    words = gold.select(F.explode(F.split("text", r"\s+")).alias("w")).select(F.regexp_replace("w", r"^[.,?!:;\"'()]+|[.,?!:;\"'()]+$", "").alias("w")).where(F.contains("w", F.lit(SILENT + JOINER)))
    parts = F.split("w", JOINER, -1)
    at = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), JOINER), F.lit(JOINER), F.substring(F.element_at(parts, k + 1), 1, 1)))
    return words.select(F.explode(at).alias("start")).where(F.col("start").rlike(f"{SILENT}{JOINER}.$")).distinct()


def rejoined(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """docs with conjuncts in ``text`` that a space broke put together: always after a lone letter
    with its silent mark, else where ``starts`` has a word that begins so. A text's own candidates are
    joined to the vocabulary, which may be of any size. Null and empty texts stay as they are.
    """
    columns = docs.columns
    lone = F.regexp_replace("text", f"(^|\\s)([ක-ෆ]{SILENT}) ([{SECOND}])", f"$1$2{JOINER}$3")
    d = docs.withColumn("text", lone)
    parts = F.split("text", " ", -1)

    def key(a: Column, b: Column) -> Column:
        left = F.regexp_replace(F.regexp_extract(a, r"\S*$", 0), r"^[.,?!:;\"'()]+", "")
        return F.when(a.endswith(SILENT) & b.rlike(f"^[{SECOND}]"), F.concat(left, F.lit(JOINER), F.substring(b, 1, 1)))

    pairs = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: key(a, F.coalesce(b, F.lit(""))))
    has = d.select("text", F.explode(F.array_compact(pairs)).alias("start")).distinct().join(starts, "start", "left_semi").groupBy("text").agg(F.collect_set("start").alias("known_"))

    def step(acc, x):
        k = key(acc["last"], x)
        join = ~acc["done"] & k.isNotNull() & F.array_contains("known_", k)
        return F.struct(
            F.concat(acc["out"], F.array(F.when(join, F.lit(JOINER)).otherwise(F.lit(" ")), x)).alias("out"),
            x.alias("last"), (join & ~x.rlike(r"\s")).alias("done"),
        )

    zero = F.struct(F.array(parts[0]).alias("out"), parts[0].alias("last"), F.lit(False).alias("done"))
    fixed = F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), zero, step)["out"], "")
    return d.join(has, "text", "left").withColumn("text", F.when(F.col("known_").isNotNull(), fixed).otherwise(F.col("text"))).select(*columns)
