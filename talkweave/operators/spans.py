"""Text spans: detection with code-point offsets, overlap resolution, redaction and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FOUND = "array<struct<label:string,start:int,end:int,surface:string>>"


def places(text: Column, label: str, pattern: str | Column) -> Column:
    """An array of a pattern's matches in ``text``: label, start, end, surface. Offsets are running
    lengths of the gaps between matches and of the matches; no text, no match."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        found = F.struct(F.lit(label).alias("label"), start.alias("start"), end.alias("end"), x["hit"].alias("surface"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        parts = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out")), step)["out"]

    # an array of one, so that the matches are looked for once
    hits = F.array(F.regexp_extract_all(text, pattern, F.lit(0)))
    return F.transform(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(F.array().cast(FOUND)))[0]


def detected(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """All matches of each label's pattern: doc_id, label, start, end (half-open), surface. A text is
    read once for all labels and nothing is shuffled."""
    found = docs.select("doc_id", F.explode(F.concat(*[places(F.col("text"), k, p) for k, p in patterns.items()])).alias("x"))
    return found.select("doc_id", "x.label", "x.start", "x.end", "x.surface")


# Cues before a keyword-anchored identifier; the identifier is the last group, at the end.
_LINK = r"(?:\s+(?:eka|ekata|is|was|එක)|\s*:)?\s+"
ANCHORED = (
    ("ACCOUNT", rf"(?i)\b(?:user\s?name|user\s?id|login(?:\s?id)?){_LINK}([A-Za-z][\w.]{{2,}}\d[\w.]*|[A-Za-z]*[._]\w+)"),
    ("ADDRESS", rf"(?i)\b(?:postal\s?code|post\s?code|zip(?:\s?code)?){_LINK}(\d{{5}})\b"),
    ("ACCOUNT", rf"(?i)\b(?:expiry|expiration|expires|exp\.?|valid\s+(?:thru|till|until))(?:\s+date)?{_LINK}((?:0[1-9]|1[0-2])\s?/\s?\d{{2}}(?:\d{{2}})?)\b"),
)
# An address that is spelled out.
_SPELLED = r"(?:[a-z0-9](?:-[a-z0-9])+|[a-z0-9]+)"
_SPOKEN_PART = rf"{_SPELLED}(?:\s+(?:zero|one|two|three|four|five|six|seven|eight|nine)\b)*"
SPOKEN_EMAIL = rf"(?i)\b{_SPOKEN_PART}(?:\s+(?:dot|underscore|dash)\s+{_SPOKEN_PART})*\s+at\s+{_SPELLED}(?:\s+dot\s+{_SPELLED})*\s+dot\s+(?:com|lk|net|org|edu|gov|io|co|uk|c-o-m|l-k|n-e-t|o-r-g)\b"


def anchored(docs: DataFrame) -> DataFrame:
    """Identifiers after a cue word, and spelled-out addresses: doc_id, label, start, end, surface,
    value. Marks at an identifier's end are no part of it."""
    from talkweave.functions.identifiers import written_email

    cues = {str(k): pattern for k, (_, pattern) in enumerate(ANCHORED)}
    found = detected(docs, {**cues, "EMAIL": SPOKEN_EMAIL})
    group, label = F.col("surface"), F.lit("EMAIL")
    for k, (name, pattern) in enumerate(ANCHORED):
        mine = F.col("label") == str(k)
        group = F.when(mine, F.regexp_extract("surface", pattern, 1)).otherwise(group)
        label = F.when(mine, name).otherwise(label)
    out = found.select("doc_id", label.alias("label"), (F.col("end") - F.length(group)).alias("start"), F.regexp_replace(group, "[.,;:]+$", "").alias("surface"))
    value = F.when(F.col("label") == "EMAIL", written_email(F.col("surface"))).otherwise(F.lower("surface"))
    return out.select("doc_id", "label", "start", (F.col("start") + F.length("surface")).alias("end"), "surface", value.alias("value"))


def propagated_names(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Names of each recording wherever they come again, in either script or with a case ending:
    doc_id, start, end, surface.

    docs: rid, doc_id, text, lower_case (whether names may begin with a small letter); found: rid,
    doc_id, start, end, surface of known persons, whose own places give no row. A recording's keys,
    an array as small as its names, meet its tokens in one join; neighbouring tokens become one span.
    """
    from talkweave.functions import identifiers as N
    from talkweave.functions import names as A
    from talkweave.functions import text as T

    token = F.explode(N.name_tokens(F.col("surface")))
    keys = found.select("rid", token.alias("t")).select("rid", A.name_key(F.col("t")).alias("key")).where("length(key) >= 4").groupBy("rid").agg(F.collect_set("key").alias("keys"))
    words = detected(docs, {"WORD": r"[^\s.,;:!?()\[\]\"'’‘/]+"}).join(docs.select("doc_id", "rid", "text", "lower_case"), "doc_id").join(keys, "rid")
    words = words.where(F.col("lower_case") | ~F.col("surface").rlike(r"^\p{Ll}"))
    known = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("known"))
    words = words.join(known, "doc_id", "left").where(F.col("known").isNull() | ~F.exists("known", lambda k: (k["start"] < F.col("end")) & (F.col("start") < k["end"])))

    def close(a, b):
        whole, bones = T.ratio(a, b), (T.skeleton(a), T.skeleton(b))
        return (whole >= 0.9) | ((bones[0] == bones[1]) & (F.length(bones[0]) >= 4) & (whole >= 0.6))

    def fits(form):
        key = A.name_key(form)
        return (F.length(key) >= 4) & F.exists("keys", lambda k: close(key, k))

    longest = F.array_max(F.transform(F.filter(A.variants(F.lower("surface")), fits), F.length))
    hits = words.withColumn("n_", longest).where("n_ is not null").select("doc_id", "text", "start", (F.col("start") + F.col("n_")).alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start")
    before = F.lag("end").over(order)
    between = F.substring(F.col("text"), before + 1, F.col("start") - before)
    hits = hits.withColumn("new_", (before.isNull() | (F.trim(between) != "")).cast("int")).withColumn("run_", F.sum("new_").over(order))
    spans = hits.groupBy("doc_id", "run_").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("text").alias("text"))
    return spans.select("doc_id", "start", "end", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("surface"))


def unoverlapped(grouped: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and columns of each of ``spans``, in their order, that overlaps none kept before it."""
    kind = grouped.schema["spans"].dataType.simpleString()
    kept = F.aggregate("spans", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(*keys, F.explode(kept).alias("x")).select(*keys, *[f"x.{c}" for c in columns])


def resolved(found: DataFrame, priority: list[str], carried: list[str] | None = None) -> DataFrame:
    """Spans that stay if the longest go first (then by label priority, then the earliest) and
    each that overlaps one before it is dropped; ``carried`` columns go along."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("label"))
    columns = ["label", "start", "end", "surface", *(carried or [])]
    spans = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("o"), rank.alias("r"), "start", "end", "label", "surface", *(carried or []))))
    return unoverlapped(found.groupBy("doc_id").agg(spans.alias("spans")), ["doc_id"], columns)


def numbered(found: DataFrame, width: int = 1 << 16) -> DataFrame:
    """surface, label, placeholder: entities numbered per label by first appearance.

    A label may hold any number of entities, so no task sees all of one: entities are ranked within
    buckets of ``width`` neighbouring documents, and a running sum over one row per label and bucket
    gives what comes before each bucket. Where doc_id is no whole number, the ranks come from
    range-sorted partitions, less the label's first.
    """
    from pyspark.sql.types import IntegralType

    from talkweave.operators.ranks import ranked as globally

    first = found.groupBy("surface", "label").agg(F.min(F.struct("doc_id", "start")).alias("f"))
    if isinstance(found.schema["doc_id"].dataType, IntegralType):
        first = first.withColumn("bucket_", F.floor(F.col("f.doc_id") / width))
        sizes = first.groupBy("label", "bucket_").agg(F.count("*").alias("n_"))
        before = F.sum("n_").over(Window.partitionBy("label").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sizes.select("label", F.col("bucket_"), F.coalesce(before, F.lit(0)).alias("before_"))
        ranked = first.withColumn("rank_", F.row_number().over(Window.partitionBy("label", "bucket_").orderBy("f", "surface"))).join(offsets, ["label", "bucket_"])
        n = F.col("before_") + F.col("rank_")
    else:
        ranked = globally(first, ["label", "f", "surface"], "rank_")
        ranked = ranked.join(ranked.groupBy("label").agg(F.min("rank_").alias("least_")), "label")  # a row per label
        n = F.col("rank_") - F.col("least_") + 1
    return ranked.select("surface", "label", F.concat(F.lit("["), "label", F.lit("_"), n.cast("string"), F.lit("]")).alias("placeholder"))


def redacted(docs: DataFrame, named: DataFrame) -> DataFrame:
    """docs with redacted (placeholders for spans) and replacements, the private map: placeholder,
    place in the redacted text, original. Spans of a document must not overlap."""
    spans = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder", "surface"))).alias("spans"))
    kind = "array<struct<placeholder:string,start:int,original:string>>"

    def step(acc, x):
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        start = acc["length"] + F.length(gap)
        return F.struct(
            x["end"].alias("at"),
            (start + F.length(x["placeholder"])).alias("length"),
            F.concat(acc["parts"], F.array(gap, x["placeholder"])).alias("parts"),
            F.concat(acc["map"], F.array(F.struct(x["placeholder"].alias("placeholder"), start.alias("start"), x["surface"].alias("original")))).alias("map"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("parts"), F.array().cast(kind).alias("map"))
    out = docs.join(spans, "doc_id", "left").withColumn("done", F.aggregate("spans", zero, step))
    text = F.concat(F.array_join("done.parts", ""), F.substring("text", F.col("done.at") + 1, F.length("text")))
    return out.select("doc_id", F.coalesce(text, "text").alias("redacted"), F.coalesce("done.map", F.array().cast(kind)).alias("replacements"))


def restored(out: DataFrame) -> DataFrame:
    """doc_id and restored: the text before redaction, from the map alone."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate("replacements", zero, lambda acc, x: F.struct((x["start"] + F.length(x["placeholder"])).alias("at"), F.concat(acc["parts"], F.array(F.substring(F.col("redacted"), acc["at"] + 1, x["start"] - acc["at"]), x["original"])).alias("parts")))
    d = out.withColumn("d", done)
    return d.select("doc_id", F.concat(F.array_join("d.parts", ""), F.substring("redacted", F.col("d.at") + 1, F.length("redacted"))).alias("restored"))


def scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Strict matches by label and in all (label null): tp, fp, fn."""
    key = ["doc_id", "label", "start", "end"]
    j = gold.withColumn("g", F.lit(1)).join(pred.withColumn("p", F.lit(1)), key, "full")
    return j.groupingSets([["label"], []], "label").agg(F.expr("count_if(g = 1 and p = 1) as tp"), F.expr("count_if(p = 1 and g is null) as fp"), F.expr("count_if(g = 1 and p is null) as fn"))


def set_classes(sets: DataFrame) -> DataFrame:
    """id, class_id (the smallest id with the same tokens), tokens; rows without a set go."""
    s = sets.where(F.col("set").isNotNull()).select("id", F.array_sort("set").alias("set"))
    return s.join(s.groupBy("set").agg(F.min("id").alias("class_id")), "set").select("id", "class_id", F.col("set").alias("tokens"))
