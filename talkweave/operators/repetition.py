"""Loops in decoded text: why a text looks like one, and where to cut it."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The largest that ordinary speech shows.
MOST_COMPRESSION = 3.0
MOST_WORDS, MOST_PHRASES, LONGEST_PHRASE = 10, 5, 6
WORDS_PER_SECOND, EXTRA_WORDS = 10.0, 5
LETTER_LOOP = re.compile(r"(.{1,8}?)\1{8,}")
MARKS = ".,?!;:"


def compression(text: str) -> float:
    raw = text.encode("utf-8", "replace")
    return len(raw) / len(zlib.compress(raw))


def phrase_loop(words: list[str]) -> tuple[int, int, int] | None:
    """(copies, start, length) of the phrase with most copies in a row beyond what speech shows; of
    equal ones the shortest, then the first."""
    words = [w.strip(MARKS).lower() for w in words]
    best = None
    for k in range(1, LONGEST_PHRASE + 1):
        limit, run = (MOST_WORDS if k == 1 else MOST_PHRASES), 0
        for i in range(k, len(words)):
            run = run + 1 if words[i] == words[i - k] else 0
            copies = run // k + 1
            if run % k == 0 and copies > limit and (best is None or copies > best[0]):
                best = (copies, i - run - k + 1, k)
    return best


def room(seconds: float | None) -> float:
    return WORDS_PER_SECOND * (seconds or 0.0) + EXTRA_WORDS


def loop_reasons(text: str | None, seconds: float | None) -> list[str]:
    text = text or ""
    loop = phrase_loop(text.split())
    found = [
        "compression" if compression(text) > MOST_COMPRESSION else None,
        f"{loop[2]}-word unit x{loop[0]}" if loop else None,
        "char loop" if LETTER_LOOP.search(text) else None,
        "too long for audio" if len(text.split()) > room(seconds) else None,
    ]
    return [x for x in found if x]


def without_loop(text: str | None, seconds: float | None) -> str:
    """The text up to its loop and two copies of it, at most as long as the seconds allow, and shorter
    while it still compresses too well."""
    text = text or ""
    if m := LETTER_LOOP.search(text):
        text = text[: m.start()] + 2 * m[1]
    words = text.split()
    if loop := phrase_loop(words):
        words = words[: loop[1] + 2 * loop[2]]
    words = words[: int(room(seconds))]
    while words and compression(" ".join(words)) > MOST_COMPRESSION:
        words.pop()
    return " ".join(words)


@F.pandas_udf(ArrayType(StringType()))
def reasons(text, seconds):
    import pandas as pd

    return pd.Series([loop_reasons(t, None if s != s else s) for t, s in zip(text, seconds)])


@F.pandas_udf(StringType())
def truncated(text, seconds):
    import pandas as pd

    return pd.Series([without_loop(t, None if s != s else s) for t, s in zip(text, seconds)])


def too_long(text: Column, seconds: Column) -> Column:
    """The one reason that needs no Python: more words than fit into the seconds."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) > WORDS_PER_SECOND * F.coalesce(seconds, F.lit(0.0)) + EXTRA_WORDS
