"""Readers and writers of the data model's files; schemas are explicit everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(col="_metadata.file_path"):
    return F.regexp_extract(F.col(col), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """clip, speaker, start, end of SPEAKER lines with eight fields or more and a positive length."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("f[0] = 'SPEAKER' and size(f) >= 8")
    out = f.select(F.col("f")[1].alias("clip"), F.col("f")[7].alias("speaker"), F.expr("try_cast(f[3] as double)").alias("start"), F.expr("try_cast(f[4] as double)").alias("dur"))
    return out.where("dur > 0").select("clip", "speaker", "start", (F.col("start") + F.col("dur")).alias("end"))


def uem(spark: SparkSession, path: str) -> DataFrame:
    """clip, start, end of scored regions."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 4")
    return f.select(F.col("f")[0].alias("clip"), F.expr("try_cast(f[2] as double)").alias("start"), F.expr("try_cast(f[3] as double)").alias("end")).where("`end` > start")


def label_track(spark: SparkSession, path: str) -> DataFrame:
    """clip, start, end, label of start-end-text lines, by tab or space; bounds are put in order and
    lines without two numbers go."""
    m = r"^\s*(-?[0-9.]+)[\t ]+(-?[0-9.]+)(?:[\t ]+(.*?))?\s*$"
    f = spark.read.text(path).select("value", _name().alias("clip"))
    f = f.select("clip", F.expr(f"try_cast(regexp_extract(value, r'{m}', 1) as double)").alias("a"), F.expr(f"try_cast(regexp_extract(value, r'{m}', 2) as double)").alias("b"), F.regexp_extract("value", m, 3).alias("label"))
    return f.where("a is not null and b is not null").select("clip", F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), "label")


def write_rttm(segments: DataFrame, path: str) -> None:
    """clip, speaker, start, end as RTTM lines."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "clip", "start", F.col("end") - F.col("start"), "speaker")
    segments.select(line.alias("value")).write.text(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema; blank lines give no row."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


UTTERANCE = "struct<utt_id:string,clean_en:string,clean_si:string>"


def translations(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, utt_id, clean_en, clean_si from whole-file JSON of any of three shapes: a bare
    list, utterance_records, or utterances."""
    raw = spark.read.option("wholetext", True).text(path).select("value", _name().alias("file"))
    as_list = F.from_json("value", f"array<{UTTERANCE}>")
    as_object = F.from_json("value", f"struct<recording_id:string,utterance_records:array<{UTTERANCE}>,utterances:array<{UTTERANCE}>>")
    both = raw.select("file", F.when(F.ltrim("value").startswith("["), as_list).alias("l"), F.when(F.ltrim("value").startswith("{"), as_object).alias("o"))
    rows = both.select(F.coalesce("o.recording_id", "file").alias("recording_id"), F.explode(F.coalesce("l", "o.utterance_records", "o.utterances")).alias("u"))
    return rows.select("recording_id", "u.utt_id", F.nullif("u.clean_en", F.lit("")).alias("clean_en"), F.nullif("u.clean_si", F.lit("")).alias("clean_si"))


def recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A split's texts (rid, doc_id, text) and spans (rid, doc_id, label, start, end, surface) from
    its files <rid>.docs.jsonl and <rid>.pii.jsonl, which may be folders of parts."""
    rid = lambda kind: F.regexp_extract("_metadata.file_path", rf"([^/]+)\.{kind}\.jsonl", 1).alias("rid")
    docs = spark.read.schema("doc_id string, text string").json(f"{path}/*.docs.jsonl").select(rid("docs"), "doc_id", "text")
    spans = spark.read.schema("doc_id string, label string, start_char int, end_char int, surface string").json(f"{path}/*.pii.jsonl")
    return docs, spans.select(rid("pii"), "doc_id", "label", F.col("start_char").alias("start"), F.col("end_char").alias("end"), "surface")


def staged(spark: SparkSession, rid: str, folders: dict[str, str], schema: str) -> DataFrame:
    """One recording's JSON lines from loose folders, one for each layer, with the layer's name."""
    found = [spark.read.schema(schema).json(f"{path}/{rid}.*.json").withColumn("layer", F.lit(layer)) for layer, path in folders.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def inventory(spark: SparkSession, path: str, pattern: str, layers: list[str]) -> DataFrame:
    """One row for each id that the pattern finds in file names, a column of paths per layer (the
    pattern's groups are id and layer)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    f = f.select("path", F.regexp_extract("path", pattern, 1).alias("id"), F.regexp_extract("path", pattern, 2).alias("layer")).where("id <> ''")
    return f.groupBy("id").pivot("layer", layers).agg(F.min("path"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))


def write_private(df: DataFrame, path: str, allowed: list[str]) -> None:
    """Write JSON below one of the allowed folders only; used for the re-identification map."""
    if ".." in path.split("/") or not any(path == a or path.startswith(a.rstrip("/") + "/") for a in allowed):
        raise PermissionError(f"{path} is not in a folder for private data")
    df.write.json(path)


def write_shareable(redacted: DataFrame, found: DataFrame, path: str) -> None:
    """Two JSON outputs that may leave: the redacted texts, and where what was found, without its text."""
    redacted.select("doc_id", "redacted").write.json(f"{path}/redacted")
    found.select("doc_id", "label", "start", "end").write.json(f"{path}/detections")
