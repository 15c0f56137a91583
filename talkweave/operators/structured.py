"""Structured identifiers of a turn or document (numbers, references, dates, addresses of mail) with
the words around them, and known surfaces found again across a recording.

Candidates come out of one pass over each text; what leaves that pass is a row per candidate with
the few characters around it, so no text is shuffled and everything but spoken numbers stays in
the JVM. Texts that are null or empty give no row.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions import identifiers as N
from talkweave.functions import names as A
from talkweave.functions import numerals as D
from talkweave.functions import text as T
from talkweave.operators import spans as S

W = r"\p{L}\p{N}_"
EDGE = rf"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))"

# Patterns of identifiers.
EMAIL = rf"(?<![{W}.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}"
DOTTED = rf"(?<![{W}.])[0-9]{{1,4}}(?:\.[0-9]{{1,4}}){{2,}}(?![{W}]|\.[0-9])"
REFERENCE = rf"(?<![{W}/\-])[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)*(?![{W}/\-])|(?<![{W}/\-])[0-9][A-Z0-9]*[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)+(?![{W}/\-])"
PREFIX = rf"(?<![{W}])(?:[A-Z](?: [A-Z]){{1,4}}|[A-Z]{{1,6}}) $"
NO_PREFIX = ("NIC", "ID", "NO", "TP", "PIN", "OTP", "LKR", "RS", "I", "A", "OK", "SMS", "ATM", "DOB")
EXTENSION_AFTER = r"(?i)^(?:(?:,)? (?:extension|ext\.?)(?: number| no\.?)? [0-9]{1,5}(?![0-9])|(?:,)? අභ්‍යන්තර අංකය? [0-9]{1,5}(?![0-9]))"
EXTENSION = rf"(?i)(?<![{W}])(?:extension|ext\.?)(?: number| no\.?)? [0-9]{{1,5}}(?![0-9])|අභ්‍යන්තර අංකය? [0-9]{{1,5}}(?![0-9])"
HOTLINE = rf"(?i){EDGE}hotline{EDGE}|ක්ෂණික"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS_SI = ("ජනවාරි", "පෙබරවාරි", "මාර්තු", "අප්‍රේල්", "මැයි", "ජූනි", "ජූලි", "අගෝස්තු", "සැප්තැම්බර්", "ඔක්තෝබර්", "නොවැම්බර්", "දෙසැම්බර්")
PRIORITY = ["EMAIL", "DOB", "NIC", "PHONE", "ACCOUNT", "ADDRESS"]
LEFT, RIGHT, DATE_LEFT, ANSWER_WORDS, LEAST_AGE = 50, 25, 80, 3, 15

_RUN = rf"(?<![{W}/.\-+])\+?[0-9]++(?:[ \-][0-9]++)*+(?: ?[VvXx](?![{W}/\-]|[.,][0-9]))?"
_NOT_AFTER = rf"^(?:[{W}/\-]|[.,][0-9])"
_DAY, _YEAR = r"([0-9]{1,2})(?:st|nd|rd|th)?", "((?:19|20)[0-9]{2})"
_EN, _SI, _SI_DAY = f"({'|'.join(MONTHS)}|sept)", f"({'|'.join(MONTHS_SI)})", "(?: ?(?:වැනිදා|වෙනිදා))?"
# a date's pattern, and which of its groups are day, month and year
DATES = {
    "DATE0": (rf"(?i){EDGE}{_DAY}(?: of)? {_EN}{EDGE}(?:,? {_YEAR}{EDGE})?", (1, 2, 3)),
    "DATE1": (rf"(?i){EDGE}{_EN} {_DAY}{EDGE}(?:,? {_YEAR}{EDGE})?", (2, 1, 3)),
    "DATE2": (rf"(?i){EDGE}{_YEAR} {_EN} {_DAY}{EDGE}", (3, 2, 1)),
    "DATE3": (rf"{EDGE}([0-9]{{1,2}})[/.\-]([0-9]{{1,2}})[/.\-]{_YEAR}{EDGE}", (1, 2, 3)),
    "DATE4": (rf"{EDGE}{_YEAR}[/.\-]([0-9]{{1,2}})[/.\-]([0-9]{{1,2}}){EDGE}", (3, 2, 1)),
    "DATE5": (rf"(?i){_YEAR} {_SI} {_DAY}{_SI_DAY}", (3, 2, 1)),
    "DATE6": (rf"(?i){_SI} {_DAY}{_SI_DAY}(?:,? {_YEAR}{EDGE})?", (2, 1, 3)),
}
ORDINAL = rf"(?i){EDGE}[0-9]{{1,2}}(?:st|nd|rd|th){EDGE}"
_MONTH = {**{m: k for k, m in enumerate(MONTHS, 1)}, **{m: k for k, m in enumerate(MONTHS_SI, 1)}, "sept": 9}
_SENTENCE = r"(?U)[.?!](?:\s|$)"


def _java(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def nearest(left: Column) -> Column:
    """The class of the keyword that ends last in ``left``, the longest of those that end there."""
    hits = []
    for k, (name, p) in enumerate(N.CONTEXT.items()):
        m = lambda g: F.length(F.regexp_extract(left, f"(?is)^.*({_java(p)})", g))  # noqa: B023, E731
        hits.append(F.struct(m(0).alias("end"), m(1).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")))
    return F.array_max(F.filter(F.array(*hits), lambda x: x["end"] > 0))["name"]


def first(right: Column) -> Column:
    """The class of the keyword that begins first in ``right``, the longest of those that begin there."""
    hits = []
    for k, (name, p) in enumerate(N.CONTEXT.items()):
        m = lambda g: F.length(F.regexp_extract(right, f"(?is)^(.*?)({_java(p)})", g))  # noqa: B023, E731
        hits.append(F.struct(m(1).alias("start"), (-m(2)).alias("n"), F.lit(k).alias("k"), F.lit(name).alias("name")))
    return F.array_min(F.filter(F.array(*hits), lambda x: x["n"] < 0))["name"]


def context(left: Column, right: Column, others: Column, preceding: Column, window: int) -> Column:
    """What the words around a candidate say it is: the last keyword before it and after the digit
    before it; else the first one after it in its sentence; else, for an answer of few other words,
    the last one of the turn before (never an amount)."""
    near = F.right(left, F.lit(window))
    after = F.split(F.regexp_extract(F.substring(right, 1, RIGHT), r"^\P{Nd}*", 0), _SENTENCE, -1)[0]
    carried = nearest(F.right(preceding, F.lit(window)))
    answer = (F.length(preceding) > 0) & ~near.rlike(r"\p{Nd}") & (others <= ANSWER_WORDS)
    return F.coalesce(nearest(F.regexp_extract(near, r"\P{Nd}*$", 0)), first(after), F.when(answer, F.nullif(carried, F.lit("AMOUNT"))))


def _candidates(text: Column, preceding: Column) -> Column:
    """label (of the pattern), start, end, span, said (digits of number words), left, right, others."""
    runs = F.transform(S.places(text, "RUN", _RUN), lambda x: x.withField("surface", F.when(
        ~x["surface"].rlike("[VvXx]$") & F.substring(text, x["end"] + 1, F.lit(2)).rlike(_NOT_AFTER), F.regexp_extract(x["surface"], "^(.*) [^ ]*$", 1),
    ).otherwise(x["surface"])))
    runs = F.filter(runs, lambda x: x["surface"].rlike("[0-9]"))
    runs = F.transform(runs, lambda x: x.withField("end", x["start"] + F.length(x["surface"])))
    said = F.transform(F.filter(D.number_runs_of_any(text), lambda x: F.length(x["digits"]) >= 4), lambda x: F.struct(
        F.when(x["doubtful"], "SAID?").otherwise("SAID").alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["digits"].alias("surface"),
    ))
    # most texts hold no digit, at sign or spelled-out dot, and are spared the patterns that need one
    numeric = {"DOTTED": DOTTED, "REF": REFERENCE, "EXT": EXTENSION, "ORDINAL": ORDINAL, **{k: p for k, (p, _) in DATES.items()}}
    cues = {f"CUE{k}": p for k, (_, p) in enumerate(S.ANCHORED)}

    def where(holds: Column, *arrays: Column) -> Column:
        return F.when(holds, F.concat(*arrays)).otherwise(F.array().cast(S.FOUND))

    found = F.concat(
        said,
        where(text.rlike("[0-9]"), runs, *[S.places(text, k, p) for k, p in numeric.items()]),
        where(F.contains(text, F.lit("@")), S.places(text, "EMAIL", EMAIL)),
        where(text.rlike(r"(?i)\sdot\s"), S.places(text, "SPELLED", S.SPOKEN_EMAIL)),
        *[S.places(text, k, p) for k, p in cues.items()],
    )
    size = lambda t: F.size(F.filter(F.split(t, r"(?U)\s+", -1), lambda w: w != ""))

    def around(x):
        before = F.element_at(F.split(F.substring(text, F.lit(1), x["start"]), _SENTENCE, -1), -1)
        after = F.split(F.substring(text, x["end"] + 1, F.length(text)), _SENTENCE, -1)[0]
        return F.struct(
            x["label"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("span"), x["surface"].alias("said"),
            F.substring(text, F.greatest(F.lit(1), x["start"] - (DATE_LEFT - 1)), F.least(F.lit(DATE_LEFT), x["start"])).alias("left"),
            F.substring(text, x["end"] + 1, F.lit(48)).alias("right"),
            F.when(F.length(preceding) > 0, size(before) + size(after)).otherwise(F.lit(ANSWER_WORDS + 1)).alias("others"),
        )

    return F.transform(found, around)


def _out(label, start, end, surface, value, role="PRIVATE_INDIVIDUAL", ambiguous=False) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*[col(v).alias(k) for k, v in {"label": label, "start": start, "end": end, "surface": surface, "value": value, "role": role, "ambiguous": ambiguous}.items()])


def _numeric(year: int) -> Column:
    """What a number is, by its digits, its letter and the words around it; null: nothing."""
    d, letter, c, n = F.col("digits"), F.col("letter"), F.coalesce("near", F.lit("")), F.length("digits")
    span, start, end, doubtful = F.col("span"), F.col("start"), F.col("end"), F.col("kind") == "SAID?"
    nic_like = (c == "NIC") & n.between(9, 14) & ~d.startswith("0")
    kind, phone = T.digit_class(d, F.col("near"), year), T.local_phone(d)
    extra = F.regexp_extract("right", EXTENSION_AFTER, 0)
    role = F.when(F.right(F.col("left"), F.lit(LEFT)).rlike(HOTLINE), "ORGANISATION").otherwise("PRIVATE_INDIVIDUAL")
    sure_nic = F.when(nic_like, n.isin(9, 12)).otherwise(T.is_new_nic(d, year) & (c == ""))
    sure_phone = phone.isNotNull() & (c != "")
    private = F.lit("PRIVATE_INDIVIDUAL")
    plain = (
        F.when(kind == "NIC", _out("NIC", start, end, span, d, private, ~sure_nic | doubtful))
        .when(kind == "PHONE", _out("PHONE", start, end + F.length(extra), F.concat(span, extra), F.coalesce(phone, d), role, ~sure_phone | doubtful))
        .when(kind == "ACCOUNT", _out("ACCOUNT", start, end, span, d, private, (c == "") | doubtful))
        .when((c != "AMOUNT") & (n >= 7) & A.read_out(span), _out("ACCOUNT", start, end, span, d, private, F.lit(True)))
    )
    lettered = F.when((n == 9) | nic_like, _out("NIC", start, end, span, F.concat(d, letter), private, ~((n == 9) & T.is_old_nic(d)) | doubtful))
    prefixed = _out("ACCOUNT", start - F.length("prefix"), end, F.concat("prefix", span), F.concat(F.replace(F.col("prefix"), F.lit(" "), F.lit("")), d), private, doubtful)
    read = F.when((c != "AMOUNT") & (n >= 7) & A.read_out(span), _out("ACCOUNT", start, end, span, d, private, F.lit(True)))
    return F.when((F.col("prefix") != "") & (n >= 4), prefixed).when(n < 6, None).when(letter != "", F.coalesce(lettered, read)).otherwise(plain)


def _date(year: int) -> Column:
    """A birth date, by the words around it or, for a whole date without any, by the age it gives."""
    span, born = F.col("span"), F.col("near_date")
    months = F.create_map(*[F.lit(x) for kv in _MONTH.items() for x in kv])
    out = F.when((F.col("kind") == "ORDINAL") & (born == "DOB"), _out("DOB", F.col("start"), F.col("end"), span, F.concat(F.lit("????-??-"), F.lpad(F.regexp_extract(span, "[0-9]+", 0), 2, "0")), F.lit("PRIVATE_INDIVIDUAL"), F.lit(True)))
    for name, (pattern, (gd, gm, gy)) in DATES.items():
        day, y = F.regexp_extract(span, pattern, gd).try_cast("int"), F.regexp_extract(span, pattern, gy)
        m = F.regexp_extract(span, pattern, gm)
        month, whole = F.coalesce(m.try_cast("int"), F.element_at(months, F.lower(m))), y.try_cast("int")
        valid = month.between(1, 12) & day.between(1, 31) & (whole.isNull() | whole.between(1900, year))
        is_dob = (born == "DOB") | (whole.isNotNull() & (born != "AMOUNT") & (whole <= year - LEAST_AGE))
        value = F.concat(F.coalesce(F.nullif(y, F.lit("")), F.lit("????")), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))
        out = out.when((F.col("kind") == name) & valid & is_dob, _out("DOB", F.col("start"), F.col("end"), span, value, F.lit("PRIVATE_INDIVIDUAL"), born != "DOB"))
    return out


def _worded(kind: Column, span: Column) -> Column:
    """Mail addresses, references, extensions and what a cue word announces."""
    start, end, private = F.col("start"), F.col("end"), F.lit("PRIVATE_INDIVIDUAL")
    out = F.when(kind == "EMAIL", _out("EMAIL", start, end, span, F.lower(span), private, F.lit(False)))
    out = out.when(kind == "SPELLED", _out("EMAIL", start, end, span, N.written_email(span), private, F.lit(True)))
    reference = (F.regexp_count(span, F.lit("[0-9]")) >= 4) & ~F.substring(span, 1, 3).isin(*NO_PREFIX)
    out = out.when((kind == "REF") & reference, _out("ACCOUNT", start, end, span, span, private, F.lit(False)))
    out = out.when(kind == "EXT", _out("PHONE", start, end, span, F.regexp_replace(span, "[^0-9]", ""), F.lit("ORGANISATION_REP"), F.lit(True)))
    for k, (label, pattern) in enumerate(S.ANCHORED):
        group = F.regexp_extract(span, pattern, 1)
        bare = F.regexp_replace(group, "[.,;:]+$", "")
        at = end - F.length(group)
        out = out.when(kind == f"CUE{k}", _out(label, at, at + F.length(bare), bare, F.lower(bare), private, F.lit(False)))
    return out


def identified(turns: DataFrame, year: int | None = None) -> DataFrame:
    """All structured identifiers: doc_id, label, start, end (code points, half-open), surface, value,
    role, ambiguous. Where candidates overlap the longest stays.

    turns: doc_id, text, preceding (the text of the turn before, context of short answers; may be
    null). year: the year that dates and ages are judged by, by default this one.
    """
    year = year or datetime.date.today().year
    x = turns.select("doc_id", "preceding", F.explode(_candidates(F.col("text"), F.coalesce("preceding", F.lit("")))).alias("x")).select("doc_id", "preceding", "x.*")
    around = [F.col(c) for c in ("left", "right", "others")] + [F.coalesce("preceding", F.lit(""))]
    x = x.withColumns({
        "digits": F.regexp_replace(F.when(F.col("kind").startswith("SAID"), F.col("said")).otherwise(F.col("span")), "[^0-9]", ""),
        "letter": F.when(F.col("kind") == "RUN", F.upper(F.regexp_extract("span", "[VvXx]$", 0))).otherwise(F.lit("")),
        "prefix": F.regexp_extract(F.right(F.col("left"), F.lit(12)), PREFIX, 0),
        "near": context(*around, LEFT),
        "near_date": F.coalesce(context(*around, DATE_LEFT), F.lit("")),
    })
    x = x.withColumn("prefix", F.when(F.replace(F.col("prefix"), F.lit(" "), F.lit("")).isin(*NO_PREFIX), "").otherwise(F.col("prefix")))
    dotted = (F.col("kind") == "DOTTED") & (F.length("digits") >= 8) & ~A.like_date(F.col("span"))
    kind = F.col("kind")
    found = F.when(kind.isin("RUN", "SAID", "SAID?") | dotted, _numeric(year)).when(kind.startswith("DATE") | (kind == "ORDINAL"), _date(year)).otherwise(_worded(kind, F.col("span")))
    rows = x.select("doc_id", found.alias("f")).where("f is not null").select("doc_id", "f.*")
    return S.resolved(rows, PRIORITY, ["value", "role", "ambiguous"])


def known_places(docs: DataFrame, found: DataFrame, least: int = 3) -> DataFrame:
    """Where surfaces known in a recording stand in any of its documents, outside longer words and
    numbers (a Sinhala case ending may follow): rid, doc_id, label, start, end, surface.

    docs: rid, doc_id, text; found: rid, label, surface. A document meets only the surfaces whose
    first run of letters and digits is one of its own runs, so nothing is tried against all texts.
    """
    endings = "|".join(A.CASE_ENDINGS)
    runs = F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))
    stems = F.transform(runs, lambda w: F.regexp_replace(w, f"(?<=.)(?:{endings})$", ""))
    has = docs.select("rid", "doc_id", "text", F.explode(F.array_distinct(F.concat(runs, stems))).alias("run_")).select("rid", "doc_id", "run_")
    known = found.where(F.length(F.trim("surface")) >= least).select("rid", "label", "surface", F.regexp_extract("surface", T.WORD, 0).alias("run_")).where("run_ <> ''").distinct()
    met = has.join(known, ["rid", "run_"]).drop("run_").join(docs.select("rid", "doc_id", "text"), ["rid", "doc_id"])
    quoted = F.regexp_replace("surface", r"([^\p{L}\p{N}\p{M}\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(rf"(?=$|[^\p{{L}}\p{{N}}]|(?:{endings})(?![\p{{L}}\p{{N}}]))"))
    at = met.select("rid", "doc_id", "label", F.explode(S.places(F.col("text"), "", pattern)).alias("x"))
    return at.select("rid", "doc_id", "label", "x.start", "x.end", "x.surface")


def propagated(docs: DataFrame, found: DataFrame, redact: Column) -> DataFrame:
    """found (rid, doc_id, label, start, end, surface) and every other place of its surfaces to be
    redacted, longest first; a place that ``redact`` would keep visible yields to one it wouldn't."""
    f = found.select("rid", "doc_id", "label", "start", "end", "surface", F.coalesce(redact, F.lit(False)).alias("hide_"))
    more = known_places(docs, f.where("hide_").select("rid", "label", "surface")).withColumn("turn_", F.lit(1))
    rows = f.withColumn("turn_", F.when(F.col("hide_"), 0).otherwise(2)).drop("hide_").unionByName(more.select("rid", "doc_id", "label", "start", "end", "surface", "turn_"))
    spans = F.array_sort(F.collect_set(F.struct("turn_", (F.col("start") - F.col("end")).alias("o_"), "start", "end", "label", "surface")))
    grouped = rows.groupBy("rid", "doc_id").agg(spans.alias("spans"))
    return S.unoverlapped(grouped, ["rid", "doc_id"], ["label", "start", "end", "surface"])
