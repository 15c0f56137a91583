"""Best-fit packing of token sequences, in bulk-synchronous rounds.

A token count is at most the capacity, so documents and gaps fall into at most that many
classes, and a class stands for all its members however many there are. The documents are
range-sorted by length; a round takes the longest class that is left, sweeps the sorted gap
classes for the smallest that still holds it, hands out documents to those gaps in the order of
their ranks (no two can meet in one place), updates the gaps and goes on. What a round decides
is one interval of ranks against one interval of sequences. The rounds therefore work on a table
whose size depends on the capacity alone, and every document then finds its place from its own
rank, in parallel. The packing is exactly best-fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.bpe import encode_each
from talkweave.llm.common import dropped, ship, written

CAPACITY = 2048
SEPARATOR = 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every document's tokens and the separator, cut into pieces only where they exceed the capacity."""
    tail = np.array([SEPARATOR], "<u4").tobytes()

    def derive(key, ids, _):
        ids += tail
        step = 4 * capacity
        return [(key, k, k * capacity, len(part) // 4, zlib.crc32(part)) for k, part in enumerate(ids[i : i + step] for i in range(0, len(ids), step))]

    return encode_each(docs, derive, "doc_id long, piece int, start long, length long, ids_crc32 long", path)


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over classes of equal length.

    Returns runs (length, first rank, ranks, first sequence, documents for each sequence, offset
    of the first) and the number of sequences.
    """
    gaps: dict[int, list[list[int]]] = {}
    order: list[int] = []
    runs, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append([first, n])

    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer than one sequence takes
                runs.append((length, rank, left, first + full, left, capacity - gap))
                put(gap - left * length, first + full, 1)
                put(gap, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
            else:
                put(gap, first + full, n - full)
    return runs, opened


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Give each row of items, by its column length (1 to capacity), a sequence_id and an offset.

    Rows of one length are told apart by ``order`` and then arbitrarily, so rows that repeat are
    packed each. An empty table gives an empty table. Null ids take part like any other.
    """
    spark = items.sparkSession
    ship(spark)
    columns = items.columns

    def ranked(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            lengths = b["length"].to_numpy()
            starts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]]) if len(b) else np.array([], int)
            local = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
            if len(b):
                if lengths[0] == last:
                    local[: (starts[1] if len(starts) > 1 else len(b))] += seen
                last, seen = lengths[-1], int(local[-1]) + 1
            yield pd.DataFrame({**{c: b[c] for c in columns}, "part_": np.full(len(b), part, "int64"), "local_": local.astype("int64")})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col("length").desc(), *order]
    sorted_ = written(items.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInPandas(ranked, f"{kinds}, part_ long, local_ long"), "packing-sorted")
    # at most one row for each length and each border between partitions
    found = sorted_.groupBy("length", "part_").agg(F.count("*").alias("n")).collect()
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in sorted(found, key=lambda r: (r["length"], r["part_"])):
        before[r["length"], r["part_"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    plan, _ = rounds(counts, capacity)
    by_length: dict[int, np.ndarray] = {}
    for run in plan:
        by_length.setdefault(run[0], []).append(run[1:])
    shared = spark.sparkContext.broadcast((before, {k: np.array(v, "int64") for k, v in by_length.items()}))

    def placed(batches):
        offsets, table = shared.value
        for b in batches:
            lengths = b["length"].to_numpy()
            sequence, offset = np.zeros(len(b), "int64"), np.zeros(len(b), "int64")
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                part = b["part_"].to_numpy()[rows]
                starts = {p: offsets[int(length), int(p)] for p in np.unique(part)}
                rank = b["local_"].to_numpy()[rows] + np.array([starts[p] for p in part], "int64")
                runs = table[int(length)]
                run = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
                within = rank - run[:, 0]
                sequence[rows] = run[:, 2] + within // run[:, 3]
                offset[rows] = run[:, 4] + within % run[:, 3] * length
            out = b[columns].copy()
            out["sequence_id"], out["offset"] = sequence, offset
            yield out

    return sorted_.mapInPandas(placed, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack documents; one row per piece.

    A null or empty text is the separator alone; a null doc_id is kept; repeated rows are packed
    each; further columns are not read.
    """
    cut = written(pieces(docs, capacity, path), "packing-pieces")
    out = pack(cut, capacity)
    dropped(cut)  # the sorted copy has all of it
    return out
