"""SimHash fingerprints and all links between them by the generalised pigeonhole principle.

Cut the 64 bits into m groups and give group i a threshold t_i of at least -1 (-1: left out) with
sum(t_i) = t - m + 1. Two fingerprints within t bits then differ by at most t_i bits in some
group i: else the differences add up to at least sum(t_i + 1) = t + 1. Correlated bits go into
one group, so that groups differ in how selective they are, and a dynamic programme gives the
selective groups the larger thresholds, by the candidate counts that the bits' joint
distribution over all fingerprints leads one to expect.

A row goes to one bucket for each way to blank t_i of a group's bits. Buckets beyond a fixed
size are cut into blocks, and every pair of blocks is a unit of its own, so a unit has a bounded
size and no pair is lost. A unit verifies its pairs as bit arrays and gives out a star for each
connected part, never all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import dropped, shielded, ship, written

BITS = 64
DISTANCE = 4
SHINGLE = 4
#: Rows of a bucket that one unit takes from each of its two blocks at most, on average.
BLOCK = 1024
#: What a probe row costs against the verification of a pair.
PROBE_COST = 150.0
#: Copies of a component's id that its members are spread over.
SALTS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    starts, ends = starts.tolist(), ends.tolist()
    ones = np.zeros(BITS, "int64")
    for at in range(0, len(starts), 8192):
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + 8192], ends[at : at + 8192])], "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int32")
    bits = (2 * ones > len(starts)).astype("u1")
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None, name: str = "fp_") -> DataFrame:
    """The columns ``keep`` (by default doc_id) and the text's fingerprint as a long named ``name``.

    A null, empty or white text has fingerprint 0.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    ship(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*keep, name])

    return docs.select(*keep, F.col("text").alias("text_")).mapInArrow(run, schema)


def joint_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set; [i, i] counts bit i alone. Over all rows."""

    def run(batches):
        import pandas as pd

        total = np.zeros((BITS, BITS), "int64")
        for b in batches:
            for at in range(0, len(b), 50_000):
                part = b["fp_"].to_numpy("int64")[at : at + 50_000]
                bits = np.unpackbits(part.astype("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f8")
                total += (bits.T @ bits).astype("int64")
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j]})

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp_").mapInPandas(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return out


def bit_groups(joint: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Cut the bits into m groups of nearly equal size, correlated bits together."""
    p = np.diag(joint) / n
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    near = np.abs(joint / n - np.outer(p, p)) / spread
    np.fill_diagonal(near, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [max(sorted(left), key=lambda i: near[i, sorted(left)].max())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda i: near[i, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def distances(joint: np.ndarray, n: int, group: list[int]) -> np.ndarray:
    """Chance that two independent fingerprints differ in k of the group's bits. Neighbours in the
    group count by their joint distribution, the pairs as independent."""
    out = np.ones(1)
    for a in range(0, len(group), 2):
        pair = group[a : a + 2]
        if len(pair) == 1:
            p = joint[pair[0], pair[0]] / n
            step = np.array([p * p + (1 - p) ** 2, 2 * p * (1 - p)])
        else:
            i, j = pair
            q11 = joint[i, j] / n
            q10, q01 = joint[i, i] / n - q11, joint[j, j] / n - q11
            q00 = 1 - q11 - q10 - q01
            both = 2 * (q11 * q00 + q10 * q01)
            none = q11**2 + q10**2 + q01**2 + q00**2
            step = np.array([none, max(0.0, 1 - none - both), both])
        out = np.convolve(out, step)
    return out


def thresholds(joint: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The groups and thresholds of least expected cost, as (bits, threshold); -1 is left out.

    For each number of groups a dynamic programme shares out distance - m + 1 among them.
    """
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, distance + 2):
        groups = bit_groups(joint, n, m)
        target = distance - m + 1
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            chance, w = distances(joint, n, group), len(group)

            def cost(t: int) -> float:
                if t < 0:
                    return 0.0
                ways = [1, w, w * (w - 1) // 2, w * (w - 1) * (w - 2) // 6][t]
                # a pair that differs in d <= t bits meets in each bucket that blanks those d and t - d others
                met = sum(chance[d] * [1, w - d, (w - d) * (w - d - 1) / 2, (w - d) * (w - d - 1) * (w - d - 2) / 6][t - d] for d in range(min(t, len(chance) - 1) + 1))
                return PROBE_COST * n * ways + n * n / 2 * met

            after: dict[int, tuple[float, list[int]]] = {}
            for used, (c, chosen) in states.items():
                for t in range(-1, 4):
                    got = (c + cost(t), [*chosen, t])
                    if used + t not in after or got[0] < after[used + t][0]:
                        after[used + t] = got
            states = after
        if target in states and states[target][0] < best[0]:
            best = (states[target][0], list(zip(groups, states[target][1])))
    return best[1]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """One mask for each group and each way to blank its threshold's number of bits, as signed longs."""
    from itertools import combinations

    out = []
    for bits, t in plan:
        if t >= 0:
            whole = sum(1 << b for b in bits)
            out += [whole & ~sum(1 << b for b in gone) for gone in combinations(bits, t)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def stars(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints: each member of a connected part, but the least, with the least."""
    values = np.unique(values)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    np.fill_diagonal(near, False)
    linked = np.flatnonzero(near.any(axis=1))
    if not len(linked):
        return values[:0], values[:0]
    near, values = near[np.ix_(linked, linked)], values[linked]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(values)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    rest = label != np.arange(len(values))
    return values[rest], values[label[rest]]


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), a > b, that connect exactly what links within ``distance`` bits connect.

    fps: distinct fingerprints in column fp_.
    """
    n = fps.count()
    plan = thresholds(joint_counts(fps), max(n, 1), distance)
    chosen = F.array(*[F.lit(x).cast("long") for x in masks(plan)])
    probes = fps.select("fp_", F.posexplode(chosen).alias("mask_", "bits_")).select("fp_", "mask_", F.col("fp_").bitwiseAND(F.col("bits_")).alias("key_"))
    # at most one row for every `block` probes
    large = probes.groupBy("mask_", "key_").agg(F.count("*").alias("n_")).where(F.col("n_") > block).select("mask_", "key_", F.ceil(F.col("n_") / block).cast("int").alias("blocks_"))
    own = F.pmod(F.xxhash64("fp_"), F.col("blocks_")).cast("int")
    cells = (
        probes.join(large, ["mask_", "key_"], "left")
        .withColumn("blocks_", F.coalesce("blocks_", F.lit(1)))
        .withColumn("own_", own)
        .withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
        .select("mask_", "key_", F.least("own_", "other_").alias("i_"), F.greatest("own_", "other_").alias("j_"), "fp_")
    )
    unit = ["mask_", "key_", "i_", "j_"]

    def run(batches):
        import pandas as pd

        kept: list[tuple] = []
        current: tuple | None = None

        def flush(found):
            values = np.concatenate([v for v in kept]) if len(kept) > 1 else kept[0]
            if len(values) > 1:
                a, b = stars(values, distance)
                if len(a):
                    found.append((a, b))

        for b in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            if len(b):
                cols = [b[c].to_numpy() for c in unit]
                values = b["fp_"].to_numpy("int64").view("uint64")
                new = np.zeros(len(b), bool)
                for c in cols:
                    new[1:] |= c[1:] != c[:-1]
                starts = [0, *np.flatnonzero(new).tolist(), len(b)]
                for s, e in zip(starts, starts[1:]):
                    key = tuple(c[s] for c in cols)
                    if key != current:
                        if kept:
                            flush(found)
                        kept, current = [], key
                    kept.append(values[s:e])
            if found:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in found]).view("int64"), "b": np.concatenate([y for _, y in found]).view("int64")})
        found = []
        if kept:
            flush(found)
        for a, b in found:
            yield pd.DataFrame({"a": a.view("int64"), "b": b.view("int64")})

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, *unit).sortWithinPartitions(*unit).mapInPandas(run, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: (node, root) for every node of an
    edge but the roots themselves, root being the least node. Each round is a written table."""

    def sign(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = written(edges, "edges")
    state = sign(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, written(after, "edges")
        dropped(before)
        last, state = state, sign(now)
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clusters(prints: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of prints (fp_, best_): each distinct fp_ with its least best_ as least_; those of components
    of two or more with their root_; and each such root_ with the least of all as component_."""
    fps = written(prints.groupBy("fp_").agg(F.min("best_").alias("least_")), "fingerprints")
    found = components(links(fps.select("fp_"), distance))
    roots = found.select(F.col("root").alias("fp_"), F.col("root").alias("root_")).distinct()
    members = found.select(F.col("node").alias("fp_"), F.col("root").alias("root_")).unionAll(roots).join(fps, "fp_")
    return fps, members, members.groupBy("root_").agg(F.min("least_").alias("component_"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits) and component_id.

    Null and empty texts have fingerprint zero and link like any other; rows that repeat or share
    a doc_id give a row each; a component without any doc_id has a null component_id.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    fps, members, whole = clusters(prints.select("fp_", F.col("doc_id").alias("best_")), distance)
    # a root may have any number of members, so they are spread over copies of what they look up
    spread = whole.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = members.withColumn("salt_", F.pmod(F.xxhash64("fp_"), F.lit(SALTS)).cast("int")).join(spread, ["root_", "salt_"]).select("fp_", "component_")
    ids = fps.join(named, "fp_", "left").select("fp_", F.coalesce("component_", "least_").alias("component_id"))
    return prints.join(ids, "fp_").select("doc_id", F.lpad(F.lower(F.hex("fp_")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs of which one stays for each component: that with the least doc_id (an
    arbitrary one of them where rows share it)."""
    docs, back = shielded(docs, ("doc_id", "text"))
    marked = written(fingerprints(docs, shingle, keep=docs.columns).withColumn("row_", F.monotonically_increasing_id()), "marked")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_")
    fps, members, whole = clusters(marked.select("fp_", best.alias("best_")), distance)
    winners = fps.join(members, "fp_", "left_anti").select("least_.row_").unionAll(whole.select("component_.row_"))
    return back(marked.join(winners, "row_", "left_semi"))
