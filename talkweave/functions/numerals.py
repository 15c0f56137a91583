"""Numbers said in words, in two languages and two scripts: reading, saying and finding them.

A word may hold several parts ("ninety-one" is one word) and may carry an ending that closes a
spoken group. Groups add up while their parts do not grow: 500, 50, 5 is 555, and 1, 100 is 1 and 100.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# Words of each number. The first stands alone, the last of a ten goes before units.
SINHALA = {
    0: "බිංදුව බින්දුව ශුන්‍ය බිංදු", 1: "එක", 2: "දෙක", 3: "තුන", 4: "හතර", 5: "පහ", 6: "හය", 7: "හත", 8: "අට", 9: "නවය නමය",
    10: "දහය", 11: "එකොළහ", 12: "දොළහ", 13: "දහතුන", 14: "දාහතර", 15: "පහළොව", 16: "දහසය", 17: "දහහත", 18: "දහඅට", 19: "දහනවය දහනමය",
    20: "විස්ස විසි", 30: "තිහ තිස්", 40: "හතළිහ හතළිස්", 50: "පනහ පනස්", 60: "හැට", 70: "හැත්තෑව හැත්තෑ", 80: "අසූව අසූ", 90: "අනූව අනූ",
    100: "එකසිය සියය සිය", 200: "දෙසිය", 300: "තුන්සිය", 400: "හාරසිය", 500: "පන්සිය", 600: "හයසිය", 700: "හත්සිය", 800: "අටසිය", 900: "නවසිය",
    1000: "එක්දාස් දහස දාස්", 2000: "දෙදහස දෙදාස්",
}
LATIN = {
    0: "binduwa bindu sunya shunya", 1: "eka ek", 2: "deka de", 3: "thuna tuna thun", 4: "hathara hatara hathare", 5: "paha pas", 6: "haya hay",
    7: "hatha hata hath", 8: "ata atta att", 9: "namaya navaya nawaya nava",
    10: "dahaya", 11: "ekolaha", 12: "dolaha", 13: "dahathuna", 14: "dahahatara", 15: "pahalova pahaloha", 16: "dahasaya", 17: "dahahatha", 18: "dahaata", 19: "dahanavaya dahanamaya",
    20: "vissa visi wissa wisi", 30: "thiha this tis tiha", 40: "hathaliha hathalis hatalis", 50: "panaha panas", 60: "haeta heta haetta",
    70: "haeththaewa haeththae heththawa heththa", 80: "asuwa asu", 90: "anuwa anu",
    100: "ekasiya siyaya siya", 200: "desiya", 300: "thunsiya", 400: "harasiya", 500: "pansiya", 600: "hayasiya", 700: "hathsiya", 800: "atasiya", 900: "navasiya",
    1000: "ekdas dahasa das", 2000: "dedahasa dedas",
}
ENGLISH = "zero one two three four five six seven eight nine".split()
# Endings that close a group, the ending of the last word, words that are often
# something else, the word that is also an article, and marks around words.
CLOSING = {True: ("යි",), False: ("yi", "ai", "i")}
CASE_ENDING = "ට"
DOUBTFUL = ("hata", "hath", "asu", "anu", "de", "ek")
ARTICLES = ("එක", "eka")
INNER_MARKS, EDGE_MARKS = ",.‘’'\"", ",.‘’'\"?!;:"

_IN_SINHALA = re.compile(r"[඀-෿]")


def _values(table: dict[int, str]) -> dict[str, int]:
    return {w: n for n, ws in table.items() for w in ws.split()}


def _reader(values: dict[str, int]) -> tuple[dict[str, int], re.Pattern, re.Pattern]:
    """The values, a pattern of one part (the longest that fits, never a shorter one), and one of a whole word."""
    part = "|".join(map(re.escape, sorted(values, key=lambda w: (-len(w), w))))
    return values, re.compile(part), re.compile(f"(?>{part})++")


_READERS = {True: _reader(_values(SINHALA)), False: _reader(_values(LATIN) | {w: n for n, w in enumerate(ENGLISH)})}


class Reading(NamedTuple):
    """What one word says: its parts, whether it ends a group, whether it may be something else."""

    parts: tuple[int, ...]
    closes: bool
    doubtful: bool
    english: bool


def parts(stem: str, sinhala: bool) -> tuple[int, ...] | None:
    values, part, whole = _READERS[sinhala]
    return tuple(values[m] for m in part.findall(stem)) if whole.fullmatch(stem) else None


def read_word(token: str) -> Reading | None:
    """The reading of a word, or None: without its closing ending if that leaves a number, else as it
    is, else without a case ending."""
    word = token.strip().strip(INNER_MARKS)
    sinhala = bool(_IN_SINHALA.search(word))
    word = word if sinhala else word.lower()
    stems = [(word.removesuffix(x), True) for x in CLOSING[sinhala] if word != x and word.endswith(x)] + [(word, False)]
    if sinhala and word.endswith(CASE_ENDING):
        stems.append((word.removesuffix(CASE_ENDING), True))
    for stem, ended in stems:
        if found := parts(stem, sinhala):
            english = stem in ENGLISH
            return Reading(found, ended or english, not sinhala and stem.startswith(DOUBTFUL), token.strip(EDGE_MARKS).lower() in ENGLISH)
    return None


def decode(phrase: str | None) -> tuple[str, bool] | None:
    """(digits, doubtful) of a phrase of number words only, else None.

    A digit in English that is said again in the other language counts once, and makes the result doubtful.
    """
    read = [read_word(w) for w in (phrase or "").split()]
    if not read or None in read:
        return None
    sums: list[int] = []
    last: int | None = None  # the part before, while its group is open
    doubtful, said = False, None
    for r in read:
        doubtful |= r.doubtful
        if said is not None and not r.english and r.parts == (said,):
            said, doubtful = None, True
            continue
        said = r.parts[0] if r.english else None
        for p in r.parts:
            if last is None or p > last:
                sums.append(0)
            sums[-1] += p
            last = p
        if r.closes:
            last = None
    return "".join(map(str, sums)), doubtful


def spoken_group(number: int, joined: bool) -> list[str]:
    """The words of 0 to 999, tens and units as one word if ``joined``."""
    alone, before = (lambda n: SINHALA[n].split()[0]), (lambda n: SINHALA[n].split()[-1])
    if number == 0:
        return [alone(0)]
    rest = number % 100
    out = [alone(number - rest)] if number > rest else []
    if 0 < rest < 20 or rest and rest % 10 == 0:
        out.append(alone(rest))
    elif rest:
        pair = [before(rest - rest % 10), alone(rest % 10)]
        out += ["".join(pair)] if joined else pair
    return out


def encode(digits: str, groups: list[int] | None = None, romanised: bool = False, joined: bool = False) -> str:
    """How a digit string is said: every group but the last gets a closing ending.

    groups: lengths of the groups (1 to 3 digits that do not begin with 0, unless alone); by default single digits.
    """
    sizes = groups or [1] * len(digits)
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    if not digits.isdecimal() or ends[-1:] != [len(digits)] or not all(1 <= n <= 3 for n in sizes):
        raise ValueError(f"{sizes} does not cut {digits!r}")
    if romanised and max(sizes) > 1:
        raise ValueError("Latin speech is digit by digit")
    said = []
    for end, size in zip(ends, sizes):
        group = digits[end - size : end]
        if size > 1 and group[0] == "0":
            raise ValueError(f"{group!r} begins with 0")
        words = [LATIN[int(group)].split()[0]] if romanised else spoken_group(int(group), joined)
        said.append(" ".join(words))
    return (CLOSING[not romanised][-1] + " ").join(said)


def case_ending(token: str) -> int:
    """Length of the case ending that follows a number word."""
    word = token.strip(EDGE_MARKS)
    bare = word.removesuffix(CASE_ENDING)
    return len(word) - len(bare) if bare != word and parts(word, True) is None and read_word(bare) else 0


def runs(text: str | None, least: int = 6) -> list[tuple[int, int, str, bool]]:
    """(start, end, digits, doubtful) of the longest stretches of number words that give ``least``
    digits or more; articles before a number and after its pause, marks and case endings are no part."""
    tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", text or "")]
    stretches: list[list[tuple[int, int, str]]] = [[]]
    for t in tokens:
        if read_word(t[2]):
            stretches[-1].append(t)
        elif stretches[-1]:
            stretches.append([])
    article = lambda t: t[2].strip(INNER_MARKS).lower() in ARTICLES
    out = []
    for s in filter(None, stretches):
        while len(s) > 1 and article(s[0]):
            s = s[1:]
        while len(s) > 1 and article(s[-1]) and s[-2][2].endswith(","):
            s = s[:-1]
        first, last = s[0], s[-1]
        start = first[1] - len(first[2].lstrip(EDGE_MARKS))
        end = last[0] + len(last[2].rstrip(EDGE_MARKS)) - case_ending(last[2])
        said = decode(text[start:end])
        if said and len(said[0]) >= least:
            out.append((start, end, *said))
    return out


_SAID = [StructField("digits", StringType()), StructField("doubtful", BooleanType())]


@F.pandas_udf(StructType(_SAID))
def decoded(phrase):
    import pandas as pd

    return pd.DataFrame([decode(p) or (None, None) for p in phrase], columns=["digits", "doubtful"])


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), *_SAID])))
def number_runs(text):
    import pandas as pd

    return pd.Series([[dict(zip(("start", "end", "digits", "doubtful"), r)) for r in runs(t)] for t in text])


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), *_SAID])))
def number_runs_of_any(text):
    """number_runs of one digit or more."""
    import pandas as pd

    return pd.Series([[dict(zip(("start", "end", "digits", "doubtful"), r)) for r in runs(t, 1)] for t in text])


def said_digits(digits: Column) -> Column:
    """A digit string as Latin speech, digit by digit; stays in the JVM."""
    words = F.array(*[F.lit(LATIN[n].split()[0]) for n in range(10)])
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda d: F.element_at(words, d.cast("int") + 1)), "i ")
