"""Names and identifiers: transliteration, name tokens, keyword context, spelled-out addresses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions import text as T

# Latin readings of Sinhala letters.
CONSONANTS = {
    "ක": "k", "ඛ": "kh", "ග": "g", "ඝ": "gh", "ඞ": "ng", "ඟ": "ng", "ච": "ch", "ඡ": "ch", "ජ": "j", "ඣ": "jh", "ඤ": "gn", "ඥ": "gn", "ඦ": "nj",
    "ට": "t", "ඨ": "th", "ඩ": "d", "ඪ": "dh", "ණ": "n", "ඬ": "nd", "ත": "th", "ථ": "th", "ද": "d", "ධ": "dh", "න": "n", "ඳ": "nd",
    "ප": "p", "ඵ": "ph", "බ": "b", "භ": "bh", "ම": "m", "ඹ": "mb", "ය": "y", "ර": "r", "ල": "l", "ව": "w", "ශ": "sh", "ෂ": "sh", "ස": "s", "හ": "h", "ළ": "l", "ෆ": "f",
}
VOWELS = {"අ": "a", "ආ": "aa", "ඇ": "ae", "ඈ": "aee", "ඉ": "i", "ඊ": "ii", "උ": "u", "ඌ": "uu", "ඍ": "ru", "ඎ": "ruu", "එ": "e", "ඒ": "ee", "ඓ": "ai", "ඔ": "o", "ඕ": "oo", "ඖ": "au"}
SIGNS = {"ා": "aa", "ැ": "ae", "ෑ": "aee", "ි": "i", "ී": "ii", "ු": "u", "ූ": "uu", "ෘ": "ru", "ෲ": "ruu", "ෙ": "e", "ේ": "ee", "ෛ": "ai", "ො": "o", "ෝ": "oo", "ෞ": "au", "ෟ": "lu"}
SILENT, NASAL, BREATH = "්", {"ං": "ng"}, {"ඃ": "h"}
# Titles and particles that are no part of a name.
TITLES = (
    "mr", "mrs", "ms", "miss", "dr", "rev", "prof", "sir", "madam", "mahattaya", "mahaththaya", "nona", "mea", "maya", "aiya", "akka", "nangi", "malli",
    "මහත්මයා", "මහතා", "මහත්මිය", "මිය", "මෙනවිය", "මිස්", "මිසිස්", "මිස්ටර්", "ඩොක්ටර්", "සර්", "මැඩම්", "අයියා", "අක්කා", "නංගි", "මල්ලි",
    "doctor", "professor", "eng", "engineer", "hon", "ආචාර්ය", "මහාචාර්ය", "වෛද්‍ය", "ඉංජිනේරු", "ගරු", "ප්‍රොෆෙසර්",
)
PARTICLES = ("de", "da", "di", "du", "la", "le", "van", "von", "ද", "ඩි", "ඩී")
# Keywords that say what a number is, in order of priority.
CONTEXT = {
    "NIC": r"\bnic\b|\bid (?:number|no\.?|eka|එක)|\bidentity(?: card)?\b|හැඳුනුම්පත්|හැඳුනුම්",
    "ACCOUNT": r"\baccount\b|\bacc\.? ?no\b|\bcard\b|\breference\b|\bref\b|\bpolicy\b|\bcustomer (?:id|number)\b|\bbill\b|ගිණුම්|ගිණුම"
    r"|\bepf\b|\betf\b|\bemployee (?:id|number|no)\b|\bengine\b|\bchassis\b|\blicen[cs]e\b|\bpassport\b|\bcertificate\b|\bmembership\b|\bregistration\b|\binvoice\b|\btin\b",
    "PHONE": r"\bphone\b|\bmobile\b|\bcontact\b|\bcall\b|\btel\b|\bwhatsapp\b|\bhotline\b|දුරකථන|ඇමතුම්|කෝල්|අමතන්න",
    "DOB": r"\bbirth|\bborn\b|\bdob\b|\bbirthday\b|උපන්",
    "AMOUNT": r"\brs\b\.?|\brupees\b|\brupiyal\b|රුපියල්|\blkr\b|\bamount\b|\bpaid\b|\bpayment\b|\bgewwa\b|ගෙව්වා|\bdebit\b|\bcredit\b|\btransaction\b",
}
SPOKEN = {"dot": ".", "at": "@", "underscore": "_", "dash": "-", "hyphen": "-"} | {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])


def romanised(text: Column) -> Column:
    """Sinhala letters by their Latin readings; a bare consonant sounds with a, other text stays."""
    out = F.regexp_replace(text, "[‌‍]", "")
    out = F.regexp_replace(out, f"([{''.join(CONSONANTS)}])(?![{''.join(SIGNS)}{SILENT}])", "$1a")
    table = _map({**CONSONANTS, **VOWELS, **SIGNS, **NASAL, **BREATH, SILENT: ""})
    return F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def name_tokens(surface: Column) -> Column:
    """Lower-case tokens of a name without titles, particles and numbers."""
    tokens = F.regexp_extract_all(F.lower(surface), F.lit(r"[^\s.,;:!?()\[\]\"'’‘/-]+"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(*TITLES, *PARTICLES) & ~t.rlike("^[0-9]+$"))


def key_similarity(a: Column, b: Column) -> Column:
    """Edit ratio of two phonetic keys or, if longer than two letters, of their skeletons; one half
    for a man's and a woman's form of one name."""
    sa, sb = T.skeleton(a), T.skeleton(b)
    bones = F.when(F.least(F.length(sa), F.length(sb)) >= 3, T.ratio(sa, sb)).otherwise(F.lit(0.0))
    return F.when((F.concat(a, F.lit("i")) == b) | (F.concat(b, F.lit("i")) == a), F.lit(0.5)).otherwise(F.greatest(T.ratio(a, b), bones))


def context(text: Column, start: Column, window: int = 50) -> Column:
    """The class of the last keyword before code point ``start``, after the last digit before it."""
    left = F.substring(text, F.greatest(F.lit(1), start - (window - 1)), F.least(F.lit(window), start))
    left = F.regexp_extract(left, "[^0-9]*$", 0)
    ends = {c: F.length(F.regexp_extract(left, f"(?is)^.*(?:{p})", 0)) for c, p in CONTEXT.items()}
    last = F.greatest(*ends.values())
    out = F.when(last == 0, None)
    for c, e in ends.items():
        out = out.when(e == last, c)
    return out


def written_email(spoken: Column) -> Column:
    """An address that was spelled out."""
    word = lambda w: F.coalesce(F.element_at(_map(SPOKEN), w), F.when(w.rlike(r"^[\p{L}\p{N}_](-[\p{L}\p{N}_])+$"), F.replace(w, F.lit("-"), F.lit(""))), w)
    words = F.filter(F.split(F.lower(spoken), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: word(F.trim(w, F.lit(",")))), "")


def parsed_summary(text: Column) -> Column:
    """(summary, items of intent, owner, deadline) of "SUMMARY: ... ACTIONS: - a | b | c" lines."""
    none = lambda v: F.when(~F.lower(v).isin("", "none"), v)
    lines = F.filter(F.transform(F.split(F.regexp_extract(text, r"(?s)ACTIONS:(.*)$", 1), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("-"))

    def item(line):
        p = F.transform(F.split(F.concat(F.substring(line, 2, 1_000_000), F.lit("||")), r"\|"), lambda x: F.trim(x))
        return F.struct(p[0].alias("intent"), none(p[1]).alias("owner"), none(p[2]).alias("deadline"))

    return F.struct(F.trim(F.replace(F.substring_index(text, "ACTIONS:", 1), F.lit("SUMMARY:"), F.lit(""))).alias("summary"), F.transform(lines, item).alias("items"))


def copied_numbers(source: Column, output: Column) -> Column:
    """output with its numbers replaced, in order, by the source's where both have as many."""
    a, b = F.regexp_extract_all(source, F.lit("[0-9]+"), F.lit(0)), F.regexp_extract_all(output, F.lit("[0-9]+"), F.lit(0))
    gaps = F.split(output, "[0-9]+", -1)
    whole = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(a)), a, lambda g, n: F.concat(g, n)), ""), F.element_at(gaps, -1))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), whole).otherwise(output)
