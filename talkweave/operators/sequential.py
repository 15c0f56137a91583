"""Operators whose meaning is sequential: they run in Python, on one bounded group or row at a time."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions, insertions of a least-cost word alignment; of alignments of
    equal cost that with most hits."""
    row = [(j, 0, 0, 0, j) for j in range(len(hyp) + 1)]  # cost, -hits, S, D, I
    for i, r in enumerate(ref, 1):
        new = [(i, 0, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            c, n, s, d, k = row[j - 1]
            diagonal = (c, n - 1, s, d, k) if r == h else (c + 1, n, s + 1, d, k)
            c, n, s, d, k = row[j]
            up = (c + 1, n, s, d + 1, k)
            c, n, s, d, k = new[j - 1]
            new.append(min(diagonal, up, (c + 1, n, s, d, k + 1)))
        row = new
    _, n, s, d, k = row[-1]
    return -n, s, d, k


def word_errors(pairs: DataFrame) -> DataFrame:
    """hits, subs, dels, ins and wer of each (id, ref, hyp); an empty reference has wer null where
    the hypothesis is empty too, and 1 otherwise."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for key, ref, hyp in zip(b["id"], b["ref"], b["hyp"]):
                r, h = (ref or "").split(), (hyp or "").split()
                n, s, d, i = edit_counts(r, h)
                out.append((key, n, s, d, i, (s + d + i) / len(r) if r else (1.0 if h else None)))
            yield pd.DataFrame(out, columns=["id", "hits", "subs", "dels", "ins", "wer"])

    return pairs.select("id", "ref", "hyp").mapInPandas(run, "id string, hits int, subs int, dels int, ins int, wer double")


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(pairs: DataFrame) -> DataFrame:
    """F1 of the longest common word subsequence of each (id, ref, hyp); 0 where either is empty."""

    @F.pandas_udf(DoubleType())
    def f1(ref, hyp):
        import pandas as pd

        out = []
        for r, h in zip(ref, hyp):
            r, h = (r or "").lower().split(), (h or "").lower().split()
            out.append(2 * common_length(r, h) / (len(r) + len(h)) if r and h else 0.0)
        return pd.Series(out)

    return pairs.select("id", f1("ref", "hyp").alias("rouge_l"))


def matched_items(pred: list[list[str]], gold: list[list[str]], least: float = 0.5) -> list[tuple[int, int]]:
    """One-to-one pairs of word lists, best word overlap (F1) first and ``least`` or more."""

    def f1(a, b):
        a, b = set(a), set(b)
        return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0

    ranked = sorted(((-f1(p, g), i, j) for i, p in enumerate(pred) for j, g in enumerate(gold)), key=lambda x: x)
    used_i, used_j, out = set(), set(), []
    for score, i, j in ranked:
        if -score >= least and i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j))
    return out


def item_scores(items: DataFrame) -> DataFrame:
    """matched, predicted and gold counts of each (id, pred array, gold array) of short texts."""

    def run(batches):
        import pandas as pd

        words = lambda x: re.findall(r"\w+", x.lower())
        for b in batches:
            rows = [(k, len(matched_items([words(x) for x in p], [words(x) for x in g])), len(p), len(g)) for k, p, g in zip(b["id"], b["pred"], b["gold"])]
            yield pd.DataFrame(rows, columns=["id", "matched", "predicted", "gold"])

    return items.select("id", "pred", "gold").mapInPandas(run, "id string, matched int, predicted int, gold int")


def phrase_run(words: list[str], longest: int = 6) -> tuple[int, int]:
    """Most repetitions in a row of a phrase of up to ``longest`` words, and the phrase's length."""
    best = (1, 1) if words else (0, 0)
    for k in range(1, longest + 1):
        same = 0
        for i in range(k, len(words)):
            same = same + 1 if words[i] == words[i - k] else 0
            if same // k + 1 > best[0]:
                best = (same // k + 1, k)
    return best


@F.pandas_udf(DoubleType())
def compression_ratio(text):
    """UTF-8 bytes against their zlib bytes; 0 for an empty text."""
    return text.fillna("").map(lambda t: len(t.encode()) / len(zlib.compress(t.encode())) if t else 0.0)


@F.pandas_udf(StructType([StructField("repeats", IntegerType()), StructField("phrase", IntegerType())]))
def repetition(text):
    import pandas as pd

    return pd.DataFrame([phrase_run((t or "").lower().split()) for t in text], columns=["repeats", "phrase"])


@F.pandas_udf(StringType())
def without_diacritics(text):
    """Base letters without combining marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def text_windows(text: str, size: int = 1200) -> list[tuple[int, int]]:
    """(start, end) of windows of at most ``size`` letters that cover the text, cut after sentences
    where one ends inside, else at white space, else anywhere."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            part = text[at:end]
            ends = [m.end() for m in re.finditer(r"[.!?]\s+", part)] or [m.end() for m in re.finditer(r"\s+", part)]
            end = at + (ends[-1] if ends else size)
        out.append((at, end))
        at = end
    return out


def windows(docs: DataFrame, size: int = 1200) -> DataFrame:
    """doc_id, start, end of every text's windows."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(k, s, e) for k, t in zip(b["doc_id"], b["text"]) for s, e in text_windows(t or "", size)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int")


def clips(spans: list[tuple[float, float]], gap: float, longest: float) -> list[int]:
    """A clip number for each span in order of time: a clip goes on while the pause is at most
    ``gap`` and the clip at most ``longest`` long."""
    out, number, begin, last = [], -1, 0.0, -math.inf
    for s, e in spans:
        if s - last > gap or e - begin > longest:
            number, begin = number + 1, s
        out.append(number)
        last = max(last, e) if out and s - last <= gap else e
    return out


def sessionised(spans: DataFrame, key: str, gap: float, longest: float) -> DataFrame:
    """Rows (key, id, start, end) with the number of their clip."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema)

    def run(pdf):
        pdf = pdf.sort_values(["start", "end", "id"]).reset_index(drop=True)
        pdf["clip"] = clips(list(zip(pdf["start"], pdf["end"])), gap, longest)
        return pdf

    return spans.groupBy(key).applyInPandas(run, f"{kind}, clip int")


def split_at_pauses(starts: list[float], ends: list[float], longest: float) -> list[int]:
    """Part numbers of tokens: a stretch that is too long is cut at its largest pause, again and
    again; of equal pauses the first."""
    cuts, stack = set(), [(0, len(starts))]
    while stack:
        a, b = stack.pop()
        if b - a < 2 or ends[b - 1] - starts[a] <= longest:
            continue
        at = max(range(a + 1, b), key=lambda i: (starts[i] - ends[i - 1], -i))
        cuts.add(at)
        stack += [(a, at), (at, b)]
    out, part = [], 0
    for i in range(len(starts)):
        part += i in cuts
        out.append(part)
    return out


def parts(tokens: DataFrame, key: str, longest: float) -> DataFrame:
    """Rows (key, id, start, end) with the number of their part by split_at_pauses."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)

    def run(pdf):
        pdf = pdf.sort_values(["start", "end", "id"]).reset_index(drop=True)
        pdf["part"] = split_at_pauses(pdf["start"].tolist(), pdf["end"].tolist(), longest)
        return pdf

    return tokens.groupBy(key).applyInPandas(run, f"{kind}, part int")


def matched_words(pairs: DataFrame) -> DataFrame:
    """id, ref_word, hyp_word: places (from 0) of the words that the longest matching blocks of each
    (id, ref, hyp) pair up, in lower case and without marks around them; words of marks alone are alike."""

    def run(batches):
        from difflib import SequenceMatcher

        import pandas as pd

        for b in batches:
            out = []
            for key, ref, hyp in zip(b["id"], b["ref"], b["hyp"]):
                r, h = ([re.sub(r"^\W+|\W+$", "", w.lower()) for w in (t or "").split()] for t in (ref, hyp))
                for block in SequenceMatcher(None, r, h, autojunk=False).get_matching_blocks():
                    out += [(key, block.a + k, block.b + k) for k in range(block.size)]
            yield pd.DataFrame(out, columns=["id", "ref_word", "hyp_word"])

    return pairs.select("id", "ref", "hyp").mapInPandas(run, "id string, ref_word int, hyp_word int")


class Centroids:
    """Online matching: a vector joins the nearest running mean if its cosine is ``least`` or more,
    else it begins a new identity."""

    def __init__(self, least: float, sums=None, counts=None):
        self.least, self.sums, self.counts = least, sums or [], counts or []

    def match(self, vector) -> int:
        import numpy as np

        v = np.asarray(vector, float)
        norm = np.linalg.norm(v)
        v = v / norm if norm else v
        best, score = -1, self.least
        for k, s in enumerate(self.sums):
            c = float(np.dot(v, s) / (np.linalg.norm(s) or 1.0))
            if c >= score and (best < 0 or c > score):
                best, score = k, c
        if best < 0:
            self.sums.append(v)
            self.counts.append(1)
            return len(self.sums) - 1
        self.sums[best] = self.sums[best] + v
        self.counts[best] += 1
        return best


def identities(vectors: DataFrame, key: str, order: str, vector: str, least: float) -> DataFrame:
    """(key, order, identity) of vectors that come in order, for each key on its own."""

    def run(pdf):
        import pandas as pd

        c = Centroids(least)
        pdf = pdf.sort_values(order)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "identity": [c.match(v) for v in pdf[vector]]})

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (key, order)}
    return vectors.select(key, order, vector).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, identity int")


def key_ratio(a: str, b: str) -> float:
    """1 - edit distance over the longer length; 0 where either is empty."""
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b))


def key_likeness(a: str, b: str) -> float:
    """identifiers.key_similarity in Python."""
    if a + "i" == b or b + "i" == a:  # a man's and a woman's name
        return 0.5
    bones = re.sub("[aeiouy]", "", a), re.sub("[aeiouy]", "", b)
    return max(key_ratio(a, b), key_ratio(*bones) if min(map(len, bones)) >= 3 else 0.0)


def address_clusters(mentions: DataFrame, least: float = 0.8) -> DataFrame:
    """Cluster of each address mention (rid, mention_id, sig: names.signature).

    Fuller addresses go first, then by id. A mention joins the first cluster with the same address,
    else the only one with an address that it shortens, else begins one. A group is the address
    mentions of one recording.
    """

    def found(keys, others):
        return [any(key_likeness(k, o) >= least for o in others) for k in keys]

    def same(a, b):
        short, long = sorted((a[1], b[1]), key=len)
        if a[0] != b[0] or not (short or (a[0] and long)):
            return False
        hits = found(short, long)
        return not short or (any(hits) if a[0] else all(hits))

    def part(a, b):
        return bool(a[1]) and a[0] <= b[0] and len(a[1]) <= len(b[1]) and all(found(a[1], b[1]))

    def run(pdf):
        import pandas as pd

        rows = [(m, (frozenset(s["numbers"]), list(s["places"]))) for m, s in zip(pdf["mention_id"], pdf["sig"])]
        groups, out = [], []
        for m, sig in sorted(rows, key=lambda r: (-len(r[1][0]) - len(r[1][1]), r[0])):
            fits = [k for k, g in enumerate(groups) if any(same(sig, x) for x in g)][:1]
            if not fits:
                parts_of = [k for k, g in enumerate(groups) if any(part(sig, x) for x in g)]
                fits = parts_of if len(parts_of) == 1 else []
            if not fits:
                groups.append([])
                fits = [len(groups) - 1]
            if sig not in groups[fits[0]]:
                groups[fits[0]].append(sig)
            out.append((pdf["rid"].iloc[0], m, fits[0]))
        return pd.DataFrame(out, columns=["rid", "mention_id", "cluster"])

    kinds = {c: mentions.schema[c].dataType.simpleString() for c in ("rid", "mention_id")}
    return mentions.groupBy("rid").applyInPandas(run, f"rid {kinds['rid']}, mention_id {kinds['mention_id']}, cluster int")


def clustered(mentions: DataFrame, least: float = 0.775) -> DataFrame:
    """Cluster of each mention (rid, mention_id, keys: phonetic keys of its name tokens).

    Mentions with more tokens go first, then by id; each joins the cluster whose best member is
    most similar if that is ``least`` or more (ties to the earliest), else begins one. Similarity
    is the least over the shorter name's tokens of their best match in the longer one.
    """

    def mention(a, b):
        short, long = sorted((list(a), list(b)), key=len)
        return min((max(key_likeness(x, y) for y in long) for x in short), default=0.0)

    def run(pdf):
        import pandas as pd

        rows = sorted(zip(pdf["mention_id"], pdf["keys"]), key=lambda r: (-len(r[1]), r[0]))
        groups, out = [], []
        for key, keys in rows:
            scores = [max(mention(keys, k) for k in g) for g in groups]
            best = max(range(len(groups)), key=lambda k: (scores[k], -k), default=-1)
            if best < 0 or scores[best] < least:
                groups.append([])
                best = len(groups) - 1
            if list(keys) not in groups[best]:
                groups[best].append(list(keys))
            out.append((pdf["rid"].iloc[0], key, best))
        return pd.DataFrame(out, columns=["rid", "mention_id", "cluster"])

    kinds = {c: mentions.schema[c].dataType.simpleString() for c in ("rid", "mention_id")}
    return mentions.groupBy("rid").applyInPandas(run, f"rid {kinds['rid']}, mention_id {kinds['mention_id']}, cluster int")
