"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised
residuals, asymmetric distance tables, and exact reranking.

A vector lies in the list of its nearest centroid and keeps a byte for each part of its residual.
A query visits the lists whose centroids promise most; there its table of inner products with
every code word gives a sum for each vector. Only codes and ids travel to that step. The best
candidates of all lists together are then joined with their vectors and ranked again exactly.

How far a sum may be off is known for each vector (the length of what its code leaves out), and how
far a list's vectors lie from its centroid too. So every list and every vector that may hold one of
the nearest is visited and ranked again besides, whatever the vectors are like. What codes of the
whole table leave out of a vector, it keeps in whole steps of its own size; they tell apart what
the sums cannot, such as the members of a tight cluster, before vectors are joined. Of copies of one
vector only as many are compared as one result can hold.

Lists are filled into units of a bounded size (a long list into several), and queries into blocks,
so no unit of work grows with the largest list. Queries with equal vectors are searched as one, and
the bounded result is handed out to their rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm.common import ship, written

NEAREST = 20
#: Vectors that centroids and code books are fitted on, at most (those first by a hash of their
#: id). There are as many lists as the root of the table's size, but one for eight of these at most.
SAMPLE = 8192
PARTS = 32
#: The share of all lists that a query visits in any case.
SHARE = 0.75
#: Candidates that are ranked again in any case, for each query; None ranks every vector exactly.
RERANK = 120
#: Vectors that one unit takes at most, on average, and queries that are compared with them at once.
UNIT = 65_536
BLOCK = 256
#: The width from which units are smaller.
WIDE = 64


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, empty or zero, and whose components are all
    finite."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))


def k_means(x: np.ndarray, k: int, steps: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].astype("f4")
    for _ in range(steps):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        sums = np.zeros_like(centres, dtype="f8")
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype("f4")
    return centres


class Index:
    """Coarse centroids and, for each part of a residual, a code book."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS):
        width = sample.shape[1]
        self.centres = k_means(sample, lists)
        near = self.nearest(sample)
        residual = sample - self.centres[near]
        self.cuts = np.linspace(0, width, min(parts, width) + 1).astype(int)
        self.books = [k_means(residual[:, a:b], 256, 6) for a, b in zip(self.cuts, self.cuts[1:])]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1), axis=1)

    def decoded(self, codes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """What codes and lists say of vectors."""
        out = self.centres[near].astype("f8")
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            out[:, a:b] += self.books[m][codes[:, m]]
        return out

    def filed(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector: codes, what they leave out in steps, the step, and how far
        an inner product with a vector of length 1 may be off by the codes and with the steps."""
        codes, width = self.codes(x.astype("f4"), near), x.shape[1]
        coarse = self.decoded(codes, near)
        rest = x - coarse
        step = np.abs(rest).max(axis=1) / 32767
        steps = np.rint(rest / np.where(step > 0, step, 1)[:, None]).astype("<i2")
        # sums are off by their rounding too
        size = np.linalg.norm(self.centres[near].astype("f8"), axis=1)
        size = size + np.linalg.norm(coarse - self.centres[near], axis=1) + np.linalg.norm(x, axis=1)
        off = np.linalg.norm(rest, axis=1) + (width + 64) * 1.2e-7 * size
        less = np.linalg.norm(rest - step[:, None] * steps, axis=1) + (width + 64) * 4.5e-16 * size
        return np.concatenate([codes, steps.view("u1"), np.stack([step, off, less], axis=1).astype("<f8").view("u1")], axis=1)

    def split(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The five parts of filed()."""
        a, b = len(self.books), len(self.books) + 2 * int(self.cuts[-1])
        step, off, less = np.ascontiguousarray(kept[:, b : b + 24]).view("<f8").T
        return kept[:, :a], np.ascontiguousarray(kept[:, a:b]).view("<i2"), step, off, less

    def codes(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        residual = x - self.centres[near]
        out = np.zeros((len(x), len(self.books)), "u1")
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            book = self.books[m]
            out[:, m] = np.argmax(residual[:, a:b] @ book.T - 0.5 * (book**2).sum(axis=1), axis=1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, its inner product with every code word: (queries, parts, 256)."""
        out = np.zeros((len(q), len(self.books), 256), "f4")
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            out[:, m, : len(self.books[m])] = q[:, a:b] @ self.books[m].T
        return out


def best(near: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest values, ties to the earlier place."""
    if len(near) <= n:
        return np.flatnonzero(near > -np.inf)
    least = np.partition(near, len(near) - n)[len(near) - n]
    if least == -np.inf:
        return np.flatnonzero(near > -np.inf)
    over = np.flatnonzero(near > least)
    return np.concatenate([over, np.flatnonzero(near == least)[: n - len(over)]])


def at_least(low: np.ndarray, n: int) -> float:
    """The nth largest value, -inf if there are fewer."""
    return float(np.partition(low, len(low) - n)[len(low) - n]) if len(low) >= n else -math.inf


def unit_length(q: np.ndarray) -> np.ndarray:
    q = q.astype("f8") / np.abs(q).max(axis=1, keepdims=True)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def units(sizes: dict[int, int], unit: int = UNIT) -> dict[int, tuple[int, int]]:
    """For each list, its first unit and in how many it is cut; short lists share a unit."""
    out, at, room = {}, -1, 0
    for k in sorted(sizes):
        if sizes[k] > unit:
            n = -(-sizes[k] // unit)
            out[k], at, room = (at + 1, n), at + n, 0
            continue
        if sizes[k] > room:
            at, room = at + 1, unit
        out[k], room = (at, 1), room - sizes[k]
    return out


def search(vectors: DataFrame, queries: DataFrame | None = None, nearest: int = NEAREST, share: float = SHARE, rerank: int | None = RERANK, sample: int = SAMPLE, lists: int | None = None, parts: int = PARTS) -> DataFrame:
    """Each query's nearest vectors: query_id, rank from 1, vec_id, score.

    By default the rows whose vec_id is divisible by 20 are the queries, each against every row but
    itself; rows that repeat are queries and candidates each, so an id may then be its own
    neighbour. queries from another table have the columns of vectors and meet every row. Ties go
    to the smaller vec_id. Rows that usable() leaves out take no part. Vectors are compared with
    those of the same length only. share and rerank are the least that is visited and ranked again;
    what else may be among the nearest is as well, so the result is that of rerank None, which
    scores every vector exactly. An empty table gives no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = queries is None
    good = usable(vectors).withColumn("asked_", F.col("vec_id") % 20 == 0 if own else F.lit(False))
    if not own:
        good = good.unionByName(usable(queries).withColumn("asked_", F.lit(True)))
    rows = written(good.withColumn("row_", F.monotonically_increasing_id()), "vectors")
    lengths = [r["n"] for r in rows.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    found = [_search(rows.where(F.size("embedding") == n), own, nearest, share, rerank, sample, lists, parts) for n in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, found)


def _search(rows: DataFrame, own: bool, nearest: int, share: float, rerank: int | None, sample: int, lists: int | None, parts: int) -> DataFrame:
    """search() over vectors of one length, with row_, asked_; own: queries are candidates too."""
    spark = rows.sparkSession
    candidates = rows if own else rows.where("not asked_")
    # queries with equal vectors are one; q_ stands for all of them
    asked = rows.where("asked_").select("vec_id", "row_", "embedding")
    questions = written(asked.groupBy("embedding").agg(F.min("row_").alias("q_")), "questions")
    n, n_asked = candidates.count(), questions.count()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # all vectors are compared in units of their largest component, queries at length 1: order stays, nothing overflows
    top = candidates.agg(F.max(F.array_max(F.transform("embedding", F.abs))).cast("double")).first()[0]
    picked = candidates.orderBy(F.xxhash64("vec_id"), "vec_id", "row_").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    seen = (picked.flatten().to_numpy(zero_copy_only=False).astype("f8") / top).astype("f4").reshape(len(picked), -1)
    width = seen.shape[1]
    index = Index(seen, lists or max(1, min(len(picked) // 8, math.isqrt(n))), parts)
    lists, exactly = len(index.centres), rerank is None
    wanted = nearest + 1 if exactly else max(rerank, nearest) + 1
    shared = spark.sparkContext.broadcast((index, seen))

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def assign(batches):
        import hashlib

        import pyarrow as pa

        index, _ = shared.value
        for b in batches:
            if len(b):
                x = matrix(b.column(2)).astype("<f8")
                scaled = x / top
                near = index.nearest(scaled.astype("f4"))
                kept = [c.tobytes() for c in (x if exactly else index.filed(scaled, near))]
                same = [hashlib.blake2b(c.tobytes(), digest_size=16).digest() for c in x + 0.0]
                far = np.linalg.norm(scaled - index.centres[near], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(kept, pa.binary()), pa.array(same, pa.binary()), pa.array(far)], names=["vec_id", "row_", "list_", "kept_", "same_", "far_"])

    filed = written(candidates.select("vec_id", "row_", "embedding").mapInArrow(assign, "vec_id long, row_ long, list_ int, kept_ binary, same_ binary, far_ double"), "codes")
    sizes, reach = {}, np.zeros(lists)
    for r in filed.groupBy("list_").agg(F.count("*").alias("n"), F.max("far_").alias("far")).collect():  # one row for each list
        sizes[r["list_"]], reach[r["list_"]] = r["n"], r["far"] + 1e-5 * (1 + r["far"])
    place = units(sizes) if width <= WIDE else units(sizes, max(1, UNIT * WIDE // width))
    held = np.array([k in place for k in range(lists)])
    probes = lists if exactly else max(1, math.ceil(share * lists))
    if sum(sorted([sizes.get(k, 0) for k in range(lists)])[:probes]) < nearest + 1:
        probes = lists
    blocks = -(-n_asked // BLOCK)
    blocks = min(blocks, max(64, -(-blocks // 8)))  # codes travel once for each block

    def visited(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which lists (rows) queries of length 1 (columns) visit, and what their nearest reach at least."""
        index, seen = shared.value
        promise = q.astype("f4") @ index.centres.T
        asks = np.zeros(promise.shape, bool)
        np.put_along_axis(asks, np.argsort(-promise, axis=1, kind="stable")[:, :probes], True, axis=1)
        off = (width + 64) * 1.2e-7 * np.linalg.norm(seen.astype("f8"), axis=1)
        least = np.array([at_least(row - off, nearest + 1) for row in q.astype("f4") @ seen.T])
        size = np.linalg.norm(index.centres.astype("f8"), axis=1)
        asks |= promise + reach + (width + 64) * 1.2e-7 * size >= least[:, None]
        return (asks & held).T, least

    def probe(batches):
        import pyarrow as pa

        for b in batches:
            if len(b):
                asks, _ = visited(unit_length(matrix(b.column(0))))
                to = [sorted({u for k in np.flatnonzero(row) for u in range(place[k][0], sum(place[k]))}) for row in asks.T]
                at = np.repeat(np.arange(len(b)), [len(t) for t in to])
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), b.column(0).take(pa.array(at)), pa.array([u for t in to for u in t], pa.int32())], names=["q_", "query", "unit_"])

    first = F.create_map(*[F.lit(x) for k, (u, _) in place.items() for x in (k, u)])
    cut = F.create_map(*[F.lit(x) for k, (_, c) in place.items() for x in (k, c)])
    unit = (first[F.col("list_")] + F.pmod(F.xxhash64("row_"), cut[F.col("list_")])).cast("int")
    left = filed.select("vec_id", "row_", "list_", "kept_", "same_", unit.alias("unit_"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block_"))
    kind = rows.schema["embedding"].dataType.simpleString()
    right = questions.mapInArrow(probe, f"q_ long, query {kind}, unit_ int").withColumn("block_", F.pmod(F.xxhash64("q_"), F.lit(blocks)).cast("int"))

    def exact_sums(list_, kept, q, asks):
        """For each query its best members, with their sums; nothing is off."""
        kept = kept.view("<f8")
        near = np.full((len(list_), len(q)), -np.inf)
        for k in np.unique(list_):
            here, who = np.flatnonzero(list_ == k), np.flatnonzero(asks[k])
            if len(who):
                near[np.ix_(here, who)] = sum(kept[here, d, None] * q[None, who, d] for d in range(q.shape[1]))
        for row in np.ascontiguousarray(near.T):
            at = best(row, wanted)
            yield at, row[at], np.zeros(len(at))

    def sums(list_, parts_, q, asks, least):
        """For each query the members that may be among its nearest and the best besides: their places,
        sums, and how far these may be off."""
        index, _ = shared.value
        codes, steps, step, off, less = parts_
        near = np.full((len(q), len(list_)), -np.inf, "f4")
        coarse = index.centres @ q.astype("f4").T
        tables = np.ascontiguousarray(index.tables(q.astype("f4")).transpose(1, 2, 0))
        for a in range(0, len(list_), 1024):
            lists_ = list_[a : a + 1024]
            asked_ = asks[lists_]
            who = np.flatnonzero(asked_.any(axis=0))
            if not len(who):
                continue
            some = tables if len(who) == len(q) else tables[:, :, who]
            total = coarse[lists_][:, who]
            for table_, code in zip(some, codes[a : a + 1024].T):
                total += np.take(table_, code, axis=0)
            total[~asked_[:, who]] = -np.inf
            near[who, a : a + 1024] = total.T
        chosen = []
        for row, most in zip(near, least):
            at = np.flatnonzero(row + off >= max(most, at_least(row - off, nearest + 1)))
            chosen.append(np.union1d(at[row[at] > -np.inf], best(row, wanted)))
        some = np.unique(np.concatenate(chosen))
        full = index.decoded(codes[some], list_[some]) + step[some, None] * steps[some]
        for one, at, most in zip(q, chosen, least):
            fine = full[np.searchsorted(some, at)] @ one
            may = np.flatnonzero(fine + less[at] >= max(most, at_least(fine - less[at], nearest + 1)))
            on = np.union1d(may, best(fine, wanted))
            yield at[on], fine[on], less[at[on]]

    def score(members, questions_):
        import pandas as pd

        if not len(members) or not len(questions_):
            return pd.DataFrame({"q_": np.zeros(0, "i8"), "vec_id": np.zeros(0, "i8"), "row_": np.zeros(0, "i8"), "near": np.zeros(0), "off": np.zeros(0)})
        members = members.sort_values(["vec_id", "row_"])
        members = members[members.groupby("same_").cumcount() <= nearest]
        ids, at, list_ = (members[c].to_numpy() for c in ("vec_id", "row_", "list_"))
        kept = np.frombuffer(b"".join(members["kept_"]), "u1").reshape(len(ids), -1)
        parts_ = None if exactly else shared.value[0].split(kept)
        out = []
        for a in range(0, len(questions_), BLOCK):
            some = questions_.iloc[a : a + BLOCK]
            raw = np.stack(some["query"].to_numpy()).astype("f8")
            q = unit_length(raw)
            asks, least = visited(q)
            for q_, (on, near, off) in zip(some["q_"], exact_sums(list_, kept, raw, asks) if exactly else sums(list_, parts_, q, asks, least)):
                out.append(pd.DataFrame({"q_": q_, "vec_id": ids[on], "row_": at[on], "near": near, "off": off}))
        return pd.concat(out)

    by = ["unit_", "block_"]
    scored = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(score, "q_ long, vec_id long, row_ long, near double, off double")
    if max(sum(p) for p in place.values()) > 1:  # more than one unit
        mine = Window.partitionBy("q_")
        scored = scored.withColumns({"low_": F.col("near") - F.col("off"), "at_": F.row_number().over(mine.orderBy(F.col("near").desc(), "vec_id", "row_"))})
        scored = scored.withColumn("n_", F.row_number().over(mine.orderBy(F.col("low_").desc())))
        scored = scored.withColumn("most_", F.max(F.when(F.col("n_") == nearest + 1, F.col("low_"))).over(mine))
        scored = scored.where((F.col("at_") <= wanted) | F.col("most_").isNull() | (F.col("near") + F.col("off") >= F.col("most_")))
    pairs = scored.select("q_", "vec_id", "row_").join(questions.select("q_", F.col("embedding").alias("query")), "q_").join(candidates.select("row_", "embedding"), "row_").select("q_", "vec_id", "row_", "query", "embedding")

    def ranked(batches):
        import pyarrow as pa

        for b in batches:
            if len(b):
                q, x = matrix(b.column(3)), matrix(b.column(4))
                total = np.zeros(len(q))
                for d in range(q.shape[1]):  # components are added in their order, in double precision
                    total += q[:, d].astype("f8") * x[:, d].astype("f8")
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(total)], names=["q_", "vec_id", "row_", "score"])

    exact = pairs.mapInArrow(ranked, "q_ long, vec_id long, row_ long, score double")
    first_ = Window.partitionBy("q_").orderBy(F.col("score").desc(), "vec_id", "row_")
    exact = exact.withColumn("at_", F.row_number().over(first_)).where(F.col("at_") <= nearest + 1)
    tops = exact.groupBy("q_").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "row_"))).alias("top"))
    members = asked.join(questions, "embedding").select(F.col("vec_id").alias("query_id"), F.col("row_").alias("own_"), "q_").join(tops, "q_")
    others = F.slice(F.filter("top", lambda x: x["row_"] != F.col("own_")), 1, nearest) if own else F.slice("top", 1, nearest)
    out = members.select("query_id", F.posexplode(others).alias("at_", "x"))
    return out.select("query_id", (F.col("at_") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))
