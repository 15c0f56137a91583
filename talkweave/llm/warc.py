"""WARC records in ZIP archives: a WARC member and an index member, both stored.

Every record is a gzip member of its own, so the index can name its byte range. Reading goes
through the central directory (with ZIP64), the index member and ranges of the WARC member;
nothing is extracted, and the tasks that read are cut by bytes.
"""

from __future__ import annotations

import json
import zlib
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm.archives import Archive, Writing
from talkweave.llm.common import new_folder, ship, written

LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 4 << 20


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with payload_digest, payload_bytes and refers_to.

    Of payloads that are equal and have ``least`` bytes or more, that with the largest page_id is
    kept and the others refer to it. A null html is an empty payload. Rows that repeat the largest
    page_id are all kept; a null page_id refers to the largest known one, if there is any.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html").withColumns({"payload_digest": F.sha1(html.cast("binary")), "payload_bytes": F.octet_length(html).cast("long")})
    shared = keyed.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("target_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    return keyed.join(shared, "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("target_")), F.col("target_"))).drop("target_")


def record(page_id, url, html, digest, size, refers) -> bytes:
    """One WARC record."""
    payload = b"" if refers is not None else (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in url))
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of pages to archives below ``folder``; a table of the archives' URIs."""
    ship(pages.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        out, made = Writing(folder, task.partitionId(), task.taskAttemptId()), []
        archive = member = None
        index: list[bytes] = []
        at = 0

        def close():
            nonlocal archive, member, at
            member.close()
            with archive.open(INDEX, "w", force_zip64=True) as f:
                f.writelines(index)
            made.append(f"{folder}/{out.finish(archive)}")
            archive, member, at = None, None, 0
            index.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if archive is None:
                    archive = out.begin()
                    member = archive.open(WARC, "w", force_zip64=True)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(*row)) + packer.flush()
                index.append(json.dumps({"offset": at, "length": len(data)}).encode() + b"\n")
                member.write(data)
                at += len(data)
                if at >= archive_bytes:
                    close()
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    return written(with_revisits(pages, least).select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to").mapInArrow(run, "archive string"), "warc-archives")


def ranges(archive: str, range_bytes: int = RANGE_BYTES) -> list[tuple[int, list[int]]]:
    """Byte ranges of an archive's WARC member: (begin, lengths of the records in it)."""
    with Archive(archive) as zipped:
        members = {m.name: m for m in zipped.members()}
        warc = zipped.begins(members[WARC])
        begin, size = zipped.begins(members[INDEX]), members[INDEX].size
        out: list[tuple[int, list[int]]] = []
        rest, done = b"", 0
        while done < size:
            part = zipped.at(begin + done, min(1 << 20, size - done))
            done += len(part)
            *lines, rest = (rest + part).split(b"\n")
            for line in lines:
                entry = json.loads(line)
                if not out or sum_ >= range_bytes or out[-1][0] + sum_ != warc + entry["offset"]:
                    out.append((warc + entry["offset"], []))
                    sum_ = 0
                out[-1][1].append(entry["length"])
                sum_ += entry["length"]
    return out


def parsed(raw: bytes) -> dict:
    """The header fields of a record by name, its type, and its payload (None for a revisit)."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    if payload is not None and sha1(payload).hexdigest() != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not fit its digest")
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and len(s) > len("<urn:page:>") else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(fields["WARC-Payload-Length"]), "payload": payload,
    }


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives whose URIs are in column archive, checked against their digests.

    payloads: whether to return the payload (null for a revisit) beside the other fields.
    """
    ship(spark)
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads

    def plan(batches):
        import pandas as pd

        for b in batches:
            for archive in b["archive"]:
                found = ranges(archive, range_bytes)
                yield pd.DataFrame({"archive": [archive] * len(found), "begin": [x for x, _ in found], "lengths": [x for _, x in found]})

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for archive, begin, lengths in zip(b["archive"], b["begin"], b["lengths"]):
                with Archive(archive) as zipped:
                    raw = zipped.at(int(begin), int(sum(lengths)))
                rows, at = [], 0
                for n in lengths:
                    rows.append(parsed(zlib.decompress(raw[at : at + int(n)], 31)))
                    at += int(n)
                out = pd.DataFrame({k: [r[k] for r in rows] for k in names})
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    planned = archives.repartition(parts).mapInPandas(plan, "archive string, begin long, lengths array<long>")
    return planned.repartition(parts).mapInPandas(run, schema)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages to archives below the shared folder and read all records back, without payloads.

    Null urls have no target header; an empty table makes no archive and gives no rows; further
    columns are not stored.
    """
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, new_folder(spark, "warc"), least), payloads=False)
