"""Text quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins, and cyclic boosting visits the features in turn: each visit fits
a shallow tree to the gradient over the bins and adds its leaves, shrunk, to that feature's
lookup table. The strongest pairs of features then get two-dimensional tables in the same way.
A score is a sum of table entries, added up for a whole batch at once.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations, islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import shielded, ship

#: At most so many labelled rows are learnt from (those first by a hash of their id).
SAMPLE = 20_000
THRESHOLD = 0.7
BINS = 32
#: Frequent function words of the corpus' four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for was on are with as be this by at from "
    "le la les de des et un une que qui pour dans est pas sur au du "
    "der die das und ist von zu mit den dem ein eine nicht auf für sich es "
    "el los las y en con por se su al para una del lo".split()
)
FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "stops", "marks",
    "unique_words", "top_word", "repeats", "function_words", "log_lines", "line_repeats", "line_words", "pipes", "plain_words",
)

_CLASS = np.zeros(256, "int64")
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CLASS[_c] = 1
for _c in b"0123456789":
    _CLASS[_c] = 2
for _c in b"#$%&*@^~+=<>/\\{}[]_`":
    _CLASS[_c] = 3
for _c in b".,;:":
    _CLASS[_c] = 4
for _c in b"!?\"'()-":
    _CLASS[_c] = 5
_CLASS[ord("|")] = 6


def features(text: str | None) -> list[float]:
    """The features of one whole text; an empty text has zeros."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), "u1")
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    kinds = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=7) / max(1, len(raw))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    distinct_lines = len(set(lines))
    return [
        np.log1p(len(text)), np.log1p(n), len(raw) / n, float(max(map(len, seen))), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        len(seen) / n, max(seen.values()) / n, sum(map(eq, words, islice(words, 1, None))) / n, sum(seen[w] for w in FUNCTION_WORDS if w in seen) / n,
        np.log1p(len(lines)), 1 - distinct_lines / max(1, len(lines)), n / max(1, len(lines)), kinds[6], sum(c for w, c in seen.items() if w[-1].isalpha()) / n,
    ]


class Additive:
    """Lookup tables over bins of single features and of pairs."""

    def __init__(self, edges, base, tables, pairs):
        self.edges, self.base, self.tables, self.pairs = edges, base, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        raw = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            raw += t[b[:, k]]
        for (i, j), t in self.pairs.items():
            raw += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-raw))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """The best place to cut bins in two, and its gain."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = -1
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Leaf values over the bins, of a tree of depth two."""
    out = np.zeros(len(g))
    _, at = _cut(g, h, ridge, least)
    for part in [slice(0, at), slice(at, None)] if at else [slice(None)]:
        _, inner = _cut(g[part], h[part], ridge, least)
        start = part.start or 0
        for s in [slice(start, start + inner), slice(start + inner, part.stop)] if inner else [part]:
            out[s] = g[s].sum() / (h[s].sum() + ridge)
    return out


def _surface(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts the first feature once and the second on each side."""
    best = (0.0, np.zeros(g.shape))
    base = g.sum() ** 2 / (h.sum() + ridge)
    for at in range(1, g.shape[0]):
        out, gain = np.zeros(g.shape), -base
        for part in (slice(0, at), slice(at, None)):
            gp, hp = g[part].sum(axis=0), h[part].sum(axis=0)
            _, inner = _cut(gp, hp, ridge, least)
            for s in [slice(0, inner), slice(inner, None)] if inner else [slice(None)]:
                a, b = gp[s].sum(), hp[s].sum()
                out[part, s] = a / (b + ridge)
                gain += a * a / (b + ridge)
        if gain > best[0] + 1e-12:
            best = (gain, out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 160, pair_rounds: int = 40, pairs: int = 5, rate: float = 0.1, ridge: float = 1.0, least: float = 2.0) -> Additive:
    """Boost the model on features x and labels y (0 or 1). Without labels of both kinds every
    score is their mean (0.5 without any)."""
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Additive([np.zeros(0)] * width, float(np.log(p / (1 - p))), [np.zeros(1)] * width, {})
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for k in range(width)]
    base = float(np.log(y.mean() / (1 - y.mean())))
    model = Additive(edges, base, [np.zeros(len(e) + 1) for e in edges], {})
    b = model.bins(x)
    raw = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            g, h = slopes()
            size = len(model.tables[k])
            leaf = rate * _tree(np.bincount(b[:, k], g, size), np.bincount(b[:, k], h, size), ridge, least)
            model.tables[k] += leaf
            raw += leaf[b[:, k]]
    used = sorted(range(width), key=lambda k: -np.std(model.tables[k][b[:, k]]))[:8]

    def grid(i, j):
        g, h = slopes()
        shape = (len(model.tables[i]), len(model.tables[j]))
        flat = b[:, i] * shape[1] + b[:, j]
        return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)

    chosen = sorted(combinations(sorted(used), 2), key=lambda p: -_surface(*grid(*p), ridge, least)[0])[:pairs]
    for i, j in chosen:
        model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(pair_rounds):
        for i, j in chosen:
            leaf = rate * _surface(*grid(i, j), ridge, least)[1]
            model.pairs[i, j] += leaf
            raw += leaf[b[:, i], b[:, j]]
    return model


def _remainder(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Additive:
    """Fit on at most ``sample`` labelled texts that are not held out. Rows without a label or an id are left out;
    rows with the same id, label and features count once, however often they repeat."""
    ship(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").where(_remainder() != 2).select("doc_id", F.col("quality").cast("int").alias("quality_"))
    known = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality_").limit(sample)

    def run(batches):
        import pandas as pd

        for b in batches:
            x = np.array([features(t) for t in b["text_"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality_": b["quality_"], "x_": list(x)})

    # the sample has a fixed bound, so it is sent to the texts and not the other way round
    rows = docs.select("doc_id", F.col(text_col).alias("text_")).join(F.broadcast(known), "doc_id").mapInPandas(run, "doc_id long, quality_ int, x_ array<double>")
    rows = rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality_", "x_").limit(sample).collect()  # an id may have any number of texts
    rows = sorted((r["doc_id"], r["quality_"], r["x_"]) for r in rows)
    return fit(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def scored(docs: DataFrame, model: Additive, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (by default doc_id) and the score of each whole text, null texts as empty."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    ship(spark)
    keep = ["doc_id"] if keep is None else keep
    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.score(x), pa.float64())], names=[*keep, name])

    return docs.select(*keep, F.col("text").alias("text_")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    A null doc_id is not held out. Empty and null texts are scored like others. Rows that repeat
    get a row each.
    """
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns."""
    docs, back = shielded(docs, ("doc_id", "text"))
    return back(scored(docs, train(docs, labels), docs.columns, "score_").where(F.col("score_") >= threshold))
