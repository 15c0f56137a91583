"""Seeded recordings with known spans, for tests of detection, redaction and scoring at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import numerals as D
from talkweave.plans.registry import load, register
from talkweave.session import ship

FIRST = "Nimal Kasun Amara Dilshan Sunil Kamala Ruwan Tharindu".split()
LAST = "Perera Silva Fernando Bandara Jayasuriya".split()
MONTHS = "January February March April May June July August September October November December".split()
#: Texts in which {0}, {1}, ... stand for spans.
TEMPLATES = (
    ("My name is {0} and my number is {1}.", ("PERSON", "PHONE")),
    ("NIC eka {0}, born on {1}.", ("NIC", "DOB")),
    ("Call {0} on {1}, account {2}", ("PERSON", "PHONE", "ACCOUNT")),
    ("The bill was 4500 rupees.", ()),
)


def _mix(k: int, n: int, ident="id"):
    """A number below n for each recording, slot k: a linear congruential step, so it is the same in any engine."""
    return F.floor(((F.col(ident) * 7919 + (k + 1) * 104729) * 1103515245 + 12345) % 2147483648 / 65536) % n


def _pick(values, k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_mix(k, len(values)) + 1).cast("int"))


def birth_nic(year, day, female, serial):
    """A twelve-digit number that holds the year, the day of the year (500 more for women) and a serial."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad((day + F.when(female, 500).otherwise(0)).cast("string"), 3, "0"), F.lpad(serial.cast("string"), 5, "0"))


def slots(k: int) -> dict:
    """One column for each label of slot k."""
    day = F.date_add(F.lit("1960-01-01").cast("date"), _mix(11, 15000).cast("int"))
    leap_day = F.dayofyear(F.make_date(F.lit(2000), F.month(day), F.dayofmonth(day)))
    mobile = F.concat(F.lit("07"), F.lpad((_mix(k + 20, 30000) * 3001 % 100000000).cast("string"), 8, "0"))
    return {
        "PERSON": F.concat_ws(" ", _pick(FIRST, k + 30), _pick(LAST, k + 40)),
        "PHONE": F.when(_mix(k + 50, 3) == 0, D.said_digits(mobile)).otherwise(mobile),
        "NIC": birth_nic(F.year(day), leap_day, _mix(12, 2) == 1, _mix(13, 32768)),
        "DOB": F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day)), F.year(day).cast("string")),
        "ACCOUNT": F.concat(F.lit("8"), F.lpad((_mix(k + 60, 30000) * 70001 % 1000000000).cast("string"), 9, "0")),
    }


def recordings(spark: SparkSession, n: int) -> DataFrame:
    """id, text, spans (label, start, end, surface) of n recordings; half-open code-point offsets."""
    import re

    ship(spark)
    kind = "array<struct<label:string,start:int,end:int,surface:string>>"
    out = None
    for which, (template, labels) in enumerate(TEMPLATES):
        pieces = re.split(r"\{[0-9]+\}", template)
        text, spans = F.lit(pieces[0]), []
        for k, label in enumerate(labels):
            surface = slots(k)[label]
            spans.append(F.struct(F.lit(label).alias("label"), F.length(text).alias("start"), (F.length(text) + F.length(surface)).alias("end"), surface.alias("surface")))
            text = F.concat(text, surface, F.lit(pieces[k + 1]))
        made = F.struct(text.alias("text"), (F.array(*spans) if spans else F.array()).cast(kind).alias("spans"))
        out = F.when(F.col("id") % len(TEMPLATES) == which, made) if out is None else out.when(F.col("id") % len(TEMPLATES) == which, made)
    return spark.range(n).select("id", out.alias("x")).select("id", "x.text", "x.spans")


@register("G1_recordings", """WITH r AS (SELECT range AS id FROM range(2000)) SELECT id, CAST([2, 2, 3, 0][id % 4 + 1] AS INTEGER) AS spans, CAST([2, 2, 3, 0][id % 4 + 1] AS INTEGER) AS true_offsets FROM r""")
def generated(spark, sf_dir):
    """Spans of each recording, and those whose offsets give their surface."""
    right = F.filter("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["surface"])
    return recordings(spark, 2000).select("id", F.size("spans").alias("spans"), F.size(right).alias("true_offsets"))


NUMBER = "CAST(floor(((c_custkey * 7919 + {} * 104729) * 1103515245 + 12345) % 2147483648 / 65536) % {} AS BIGINT)"


@register("G2_identifiers", f"""WITH d AS (SELECT c_custkey, CAST(DATE '1960-01-01' + CAST({NUMBER.format(12, 15000)} AS INTEGER) AS DATE) AS day, {NUMBER.format(13, 2)} = 1 AS female, {NUMBER.format(14, 32768)} AS serial FROM customer)
    SELECT c_custkey, lpad(CAST(year(day) AS VARCHAR), 4, '0') || lpad(CAST(dayofyear(make_date(2000, month(day), day(day))) + CASE WHEN female THEN 500 ELSE 0 END AS VARCHAR), 3, '0') || lpad(CAST(serial AS VARCHAR), 5, '0') AS nic FROM d""")
def identifiers(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.select(F.col("id").alias("c_custkey"), slots(0)["NIC"].alias("nic"))
