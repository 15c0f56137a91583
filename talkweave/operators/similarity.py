"""Exact similarity join of token sets, block against block.

Sets are packed once, ordered by size, into blocks of 32-bit token codes that lie in the shared
folder; a task reads one block and the blocks that sizes allow it to meet. No token and no
candidate is shuffled, so what goes to disk is in proportion to the sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.session import scratch

BLOCK = 16384  # sets of a block, about
BUCKETS = 1 << 17  # of token codes, for the order from the rarest
SAMPLE = 20_000  # sets whose tokens are counted for that order; any order gives the same pairs
BITS = 512  # of a set's signature
PAIRS = 1 << 20  # candidates held at once
FEW = 200_000  # ids that may be broadcast


def similar_sets(sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a < b) of classes of equal token arrays (see spans.set_classes) with Jaccard similarity
    ``least`` or more; members of a class are never paired with one another.

    sets: id (long) and set, an array of distinct tokens. Two sets that similar share a code among
    the first of each, counted from the rarest; those pairs are held against sizes, positions and
    signatures, then against all codes, and those that are left against the tokens themselves.
    """
    spark = sets.sparkSession
    sets = sets.where(F.col("id").isNotNull())
    rows = sets.count()
    every = max(1, -(-rows // SAMPLE))
    sample = sets.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    code = F.explode(F.transform("set", lambda x: F.pmod(F.hash(x), F.lit(BUCKETS)))).alias("bucket")
    counts = sample.select(code).groupBy("bucket").agg(F.count("*").alias("n")).toPandas()

    digest = F.unhex(F.sha2(F.array_join(F.sort_array("set"), " "), 256)).alias("digest")
    coded = sets.where(F.size("set") > 0).select(digest, "id", F.transform("set", lambda x: F.hash(x)).alias("codes"))
    distinct = coded.groupBy("digest").agg(F.min(F.struct("id", "codes")).alias("x")).select("x.id", F.size("x.codes").alias("n"), "x.codes")
    parts = max(8, -(-rows // block))
    path = scratch(spark, "similar-blocks")
    distinct.repartitionByRange(parts, "n", "id").mapInArrow(_packing(counts["bucket"].to_numpy(), counts["n"].to_numpy(), block), "lo int, hi int, ids binary, sizes binary, codes binary, bits binary").write.option("compression", "none").parquet(path)
    blocks = spark.read.parquet(path).select("lo", "hi", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).toPandas()
    blocks = spark.createDataFrame([(i, *map(int, x[:2]), x[2], int(x[3])) for i, x in enumerate(sorted(blocks.itertuples(index=False, name=None)))], "i int, lo int, hi int, file string, row long")
    a, b = blocks.select("i", "hi", F.col("file").alias("file_a"), F.col("row").alias("row_a")), blocks.select(F.col("i").alias("j"), "lo", F.col("file").alias("file_b"), F.col("row").alias("row_b"))
    meet = a.join(F.broadcast(b), (F.col("i") <= F.col("j")) & (F.col("hi") >= F.col("lo") * least)).select("file_a", "row_a", "file_b", "row_b")
    found = scratch(spark, "similar-pairs")
    tasks = meet.repartition(max(1, min(parts * (parts + 1) // 2, 4096)))
    tasks.mapInArrow(_joining(least), "a long, b long").write.parquet(found)
    _remove(spark, path)

    pairs = spark.read.parquet(found)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.count() <= FEW
    near = sets.where(F.col("set").isNotNull()).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    a, b = near.select(F.col("id").alias("a"), F.col("set").alias("set_a")), near.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    out = pairs.join(a, "a").join(b, "b").withColumn("shared", shared)
    return out.select("a", "b", (F.col("shared") / (F.size("set_a") + F.size("set_b") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= least)


def _remove(spark, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _packing(buckets, counts, block: int):
    """Rows of id, n, codes to rows of one block each; codes of a set from the rarest."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        often = np.zeros(BUCKETS, np.int64)
        often[buckets] = counts
        held = pa.Table.from_batches(list(batches), None) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        held = held.combine_chunks()
        size_of = held["n"].to_numpy()
        order = np.argsort(size_of, kind="stable")
        for at in range(0, len(order), 2 * block):
            part = held.take(pa.array(order[at : at + 2 * block]))
            sizes = part["n"].to_numpy().astype(np.int32)
            codes = part["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = (often[codes & np.uint32(BUCKETS - 1)] << 32) | codes
            codes = codes[np.lexsort((rank, owner))]
            bit = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
            odd = (np.bincount(owner * BITS + bit, minlength=len(sizes) * BITS) & 1).astype(np.uint8)
            row = [sizes.min(), sizes.max(), part["id"].to_numpy().astype(np.int64).tobytes(), sizes.tobytes(), codes.tobytes(), np.packbits(odd).tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["lo", "hi", "ids", "sizes", "codes", "bits"])

    return pack


def _joining(least: float):
    """Rows of two blocks to pairs of ids."""

    def join(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def read(uri, row):
            store, path = fs.FileSystem.from_uri(uri)
            return _unpacked(pq.read_table(path, filesystem=store).slice(row, 1).to_pylist()[0])

        for batch in batches:
            for r in batch.to_pylist():
                a = read(r["file_a"], r["row_a"])
                same = (r["file_a"], r["row_a"]) == (r["file_b"], r["row_b"])
                b = a if same else read(r["file_b"], r["row_b"])
                for x, y in _met(a, b, same, least):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return join


def _unpacked(row: dict) -> dict:
    import numpy as np

    sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
    bits = np.frombuffer(row["bits"], np.uint8).reshape(len(sizes), BITS // 8).view(np.uint64)
    return {"id": np.frombuffer(row["ids"], np.int64), "n": sizes, "first": np.cumsum(sizes) - sizes, "codes": np.frombuffer(row["codes"], np.uint32), "bits": bits}


def _overlap(n, m, least: float):
    """The fewest tokens that sets of n and m share if they are similar enough."""
    import numpy as np

    return np.ceil(least / (1 + least) * (n + m) - 1e-9).astype(np.int64)


def _heads(x: dict, other: dict, least: float):
    """Set, position and code of what can be the first shared code with a set of the other block."""
    import numpy as np

    smallest = np.maximum(np.ceil(least * x["n"] - 1e-9).astype(np.int64), other["n"].min())
    take = np.clip(x["n"] - _overlap(x["n"], smallest, least) + 1, 0, x["n"])
    owner = np.repeat(np.arange(len(take)), take)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take)
    return owner, place, x["codes"][x["first"][owner] + place]


def _met(a: dict, b: dict, same: bool, least: float):
    """Ids of similar sets, the smaller id first, as two arrays at a time; each pair once."""
    import numpy as np

    own_a, at_a, code_a = _heads(a, b, least)
    own_b, at_b, code_b = (own_a, at_a, code_a) if same else _heads(b, a, least)
    order = np.argsort(code_b, kind="stable")
    own_b, at_b, code_b = own_b[order], at_b[order], code_b[order]
    if not same:
        shared = np.isin(code_a, code_b)
        own_a, at_a, code_a = own_a[shared], at_a[shared], code_a[shared]
    left, right = np.searchsorted(code_b, code_a, "left"), np.searchsorted(code_b, code_a, "right")
    many = right - left
    total = np.cumsum(many)
    left_a, left_b = a["n"][own_a] - at_a, b["n"][own_b] - at_b
    kept, begin = [], 0
    while begin < len(many):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        x = np.repeat(np.arange(begin, end), many[begin:end])
        y = np.arange(len(x)) - np.repeat(total[begin:end] - many[begin:end] - done, many[begin:end]) + np.repeat(left[begin:end], many[begin:end])
        begin = end
        sx, sy = own_a[x], own_b[y]
        n, m = a["n"][sx], b["n"][sy]
        need = _overlap(n, m, least)
        ok = np.minimum(left_a[x], left_b[y]) >= need
        ok &= np.minimum(n, m) >= need
        if same:
            ok &= sx < sy
        sx, sy, slack = sx[ok], sy[ok], (n + m - 2 * need)[ok]
        differ = np.bitwise_count(a["bits"][sx] ^ b["bits"][sy]).sum(1, dtype=np.int64)
        kept.append(np.unique((sx * len(b["n"]) + sy)[differ <= slack]))
        if sum(map(len, kept)) > PAIRS:
            kept = [np.unique(np.concatenate(kept))]
    keys = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    sx, sy = keys // len(b["n"]), keys % len(b["n"])
    step = max(1, PAIRS // int(max(a["n"].max(), 1)))
    for at in range(0, len(keys), step):
        x, y = sx[at : at + step], sy[at : at + step]
        ok = _shared(a, x, b, y) >= _overlap(a["n"][x], b["n"][y], least)
        i, j = a["id"][x[ok]], b["id"][y[ok]]
        if len(i):
            yield np.minimum(i, j), np.maximum(i, j)


def _shared(a: dict, x, b: dict, y):
    """For each pair of sets, how many codes of the first are among those of the second."""
    import numpy as np

    def keyed(s, rows):
        n = s["n"][rows]
        pair = np.repeat(np.arange(len(rows)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s["first"][rows], n)
        return (pair << 32) | s["codes"][place]

    first, second = keyed(a, x), np.sort(keyed(b, y))
    hit = second[np.minimum(np.searchsorted(second, first), len(second) - 1)] == first
    return np.bincount(first[hit] >> 32, minlength=len(x))
