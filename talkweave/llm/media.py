"""Media columns: payloads as lossless images in archives, read by a data source of Spark.

The payload of a document is stored as an 8-bit grey image 64 samples wide. The data source plans
byte ranges over the archives that a committed table names; the task of a range reads the archive's directory,
takes the members that begin in its range, and reads each by its own offset, again on its own
where a read fails. Batches go to Spark through Arrow and are bounded by bytes.
"""

from __future__ import annotations

import struct
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from talkweave.llm.archives import Archive, Writing
from talkweave.llm.common import new_folder, open_fs, ship, written

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20


def padded(payload: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of the width."""
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image(samples: bytes, level: int = 6) -> bytes:
    """A PNG of 8-bit grey samples, 64 to a row."""
    rows = len(samples) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), "u1")  # filter 0 before each row
    lines[:, 1:] = np.frombuffer(samples, "u1").reshape(rows, WIDTH)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def samples(png: bytes) -> bytes:
    """The samples of an image that image() has made; damage raises ValueError."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, width, rows = 8, [], 0, 0
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), "u1").reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("a row has a filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Whole-number statistics of the samples: rows, mean, variance, horizontal and vertical
    differences (thousandths), distinct values and entropy (hundredths of a bit)."""
    x = np.frombuffer(payload, "u1").astype("int64").reshape(-1, WIDTH)
    n = x.size
    total, squares = int(x.sum()), int((x * x).sum())
    across, down = int(np.abs(np.diff(x, axis=1)).sum()), int(np.abs(np.diff(x, axis=0)).sum())
    counts = np.bincount(x.ravel(), minlength=256)
    p = counts[counts > 0] / n
    entropy = round(float(-(p * np.log2(p)).sum()), 2)
    return f"rows={len(x)};mean={total * 1000 // n};var={(squares * n - total * total) * 1000 // (n * n)};dx={across * 1000 // n};dy={down * 1000 // n};values={len(p)};entropy={entropy + 0.0:.2f}"


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Store every whole text (null: empty) in archives below ``folder``; a table of the archives."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        out, made, archive, size, k = Writing(folder, task.partitionId(), task.taskAttemptId()), [], None, 0, 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if archive is None:
                    archive, size = out.begin(), 0
                raw = (text.as_py() or "").encode("utf-8", "replace")
                png = image(padded(raw))
                archive.writestr(f"{k}/{'' if key is None else key}/{len(raw)}.png", png)
                k, size = k + 1, size + len(png)
                if size >= archive_bytes:
                    made.append(f"{folder}/{out.finish(archive)}")
                    archive = None
        if archive is not None:
            made.append(f"{folder}/{out.finish(archive)}")
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    return written(docs.select(id_col, text_col).mapInArrow(run, "archive string"), "media-archives")


def pa_schema():
    import pyarrow as pa

    return pa.schema([("archive", pa.string())])


class Range(InputPartition):
    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.table = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.derived = str(options.get("payload", "true")).lower() == "false"

    def partitions(self):
        """Ranges of each archive that the table names; only names and sizes are read here."""
        import pyarrow.dataset as ds

        fs, path = open_fs(self.table)
        named = ds.dataset(path, filesystem=fs, format="parquet", schema=pa_schema()).to_table()["archive"].to_pylist()
        out = []
        for archive in sorted(named):
            fs, path = open_fs(archive)
            n = fs.get_file_info(path).size
            if n is None:
                raise FileNotFoundError(archive)
            out += [Range(archive, a, min(n, a + self.range_bytes)) for a in range(0, n, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if not partition.archive:
            return
        rows: list[tuple] = []
        size = 0
        with Archive(partition.archive) as zipped:
            for m in zipped.members():
                if not partition.begin <= m.header < partition.end:
                    continue
                _, key, length = m.name.removesuffix(".png").split("/")
                error = png = raw = None
                for _ in range(2):  # each member on its own: a damaged read doesn't touch the others
                    try:
                        png = zipped.at(zipped.begins(m), m.size)
                        if zlib.crc32(png) != m.crc:
                            raise ValueError("the member does not fit its checksum")
                        raw = samples(png)
                        error = None
                        break
                    except (OSError, ValueError, zlib.error) as e:
                        error, png, raw = f"{type(e).__name__}: {e}", None, None
                rows.append(self.row(int(key) if key else None, int(length), png, raw, error))
                size += len(raw or b"") + len(png or b"")
                if size >= BATCH_BYTES:
                    yield self.packed(pa, rows)
                    rows, size = [], 0
        if rows:
            yield self.packed(pa, rows)

    def row(self, key, length, png, raw, error):
        if not self.derived:
            return key, length, png, raw, error
        if raw is None:
            return key, length, None, None, None, None, None, None, error
        return key, length, len(raw), sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(png), sha256(png).hexdigest(), feature(raw), error

    def packed(self, pa, rows):
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [x.split() for x in (DERIVED if self.derived else STORED).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


STORED = "doc_id long, n_bytes long, media binary, payload binary, error string"
DERIVED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


class MediaArchives(DataSource):
    """spark.read.format("media_archives") with the path of a table of archives: payload "true"
    gives the stored and the decoded bytes of each member, "false" only what is computed from them.
    What else lies beside the archives, such as those of lost attempts, is not read. A member that
    can't be read in any try gives a row with its error, and the others are not touched by it."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self):
        return DERIVED if str(self.options.get("payload", "true")).lower() == "false" else STORED

    def reader(self, schema):
        return MediaReader(self.options)


def read_media(spark: SparkSession, archives: DataFrame, payload: bool = True, **options) -> DataFrame:
    """The members of the archives in a table that write_media() has returned."""
    ship(spark)
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("path", archives._talkweave_path).option("payload", str(payload).lower()).options(**options).load()


def round_trip(docs: DataFrame) -> DataFrame:
    """Store all documents as media below the shared folder and read them back with their features.

    A null doc_id stays null; rows that repeat are stored each; a null text is an empty payload;
    an empty table gives no rows. Any member that can't be read stops the query.
    """
    spark = docs.sparkSession
    out = read_media(spark, write_media(docs, new_folder(spark, "media")), payload=False)
    whole = F.when(F.col("error").isNull(), F.col("doc_id")).otherwise(F.raise_error(F.col("error")).cast("long"))
    return out.select(whole.alias("doc_id"), *[c for c in out.columns if c not in ("doc_id", "error")])
