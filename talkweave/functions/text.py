"""Text scalars as column functions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fillers, clitics, spoken digits and spellings of the normaliser.
FILLERS = ("uh", "uhh", "um", "umm", "hmm", "hm", "mm", "er", "erm", "ah", "aah", "eh", "ehh", "අ")
CLITICS = ("eka", "ekak", "eke", "ekata", "eken", "ekka", "ekath", "wala", "walata", "walin", "wage")
SPOKEN_DIGITS = {
    "binduwai": "0", "binduwayi": "0", "ekai": "1", "ekayi": "1", "dekai": "2", "dekayi": "2",
    "thunai": "3", "thunayi": "3", "tunai": "3", "hatharai": "4", "hatarai": "4", "hathara": "4",
    "pahai": "5", "pahayi": "5", "hayai": "6", "hayayi": "6", "hathai": "7", "hatai": "7",
    "hathayi": "7", "atai": "8", "atayi": "8", "namayai": "9", "nawayai": "9", "namayayi": "9",
}
SPELLING = {"onne": "one", "onee": "one", "oney": "one", "onneda": "oneda", "mokadda": "mokada"}
# Spellings that the phonetic key treats alike, in order.
REWRITES = (
    ("ph", "p"), ("f", "p"), ("v", "w"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("th", "t"),
    ("dh", "d"), ("kh", "k"), ("gh", "g"), ("bh", "b"), ("jh", "j"), ("sh", "s"), ("ae", "e"),
)
WORD = r"[\p{L}\p{N}]+"
SINHALA, TAMIL = r"[඀-෿]", r"[஀-௿]"


def words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def split_mixed(text: Column) -> Column:
    """A space before a hyphenated clitic and between Latin and Sinhala letters."""
    out = F.regexp_replace(text, rf"(?i)\b([A-Za-z]+)-({'|'.join(CLITICS)})\b", "$1 $2")
    out = F.regexp_replace(out, r"([A-Za-z])([඀-෿])", "$1 $2")
    return F.regexp_replace(out, r"([඀-෿‍])([A-Za-z])", "$1 $2")


def without_fillers(text: Column) -> Column:
    """Words but fillers, joined by single spaces."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~F.lower(F.trim(w, F.lit(",.?!"))).isin(*FILLERS))
    return F.array_join(parts, " ")


def tidy(text: Column) -> Column:
    """No space before marks, the last of a run of marks alone, single spaces, bare ends."""
    out = F.regexp_replace(text, r"\s+([,.?!])", "$1")
    out = F.regexp_replace(out, r"([,.?!]){2,}", "$1")
    return F.trim(F.regexp_replace(out, r"\s+", " "), F.lit(" ,"))


def swapped(text: Column, table: dict[str, str]) -> Column:
    """Every Latin word that the table knows (in any case), by its replacement."""
    out = text
    by_new: dict[str, list[str]] = {}
    for old, new in table.items():
        by_new.setdefault(new, []).append(old)
    for new, old in by_new.items():
        out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z])(?:{'|'.join(sorted(old, key=len, reverse=True))})(?![A-Za-z])", new)
    return out


def prepared(text: Column) -> Column:
    return swapped(swapped(text, SPOKEN_DIGITS), SPELLING)


def normalized(text: Column) -> Column:
    return tidy(without_fillers(split_mixed(prepared(text))))


def folded(text: Column) -> Column:
    """Lower case, digraphs with h as their first letter, w as v, and doubled letters (never digits) as one."""
    out = F.regexp_replace(F.lower(text), "([tdkgpbjcs])h", "$1")
    return F.regexp_replace(F.replace(out, F.lit("w"), F.lit("v")), r"(\p{L})\1+", "$1")


def squashed(text: Column) -> Column:
    """Runs of punctuation, symbols, controls and white space as one space."""
    return F.trim(F.regexp_replace(text, r"[\p{P}\p{S}\p{C}\s]+", " "))


def masked(text: Column) -> Column:
    """Digits as 9, Sinhala letters as one of them, other letters as x."""
    out = F.regexp_replace(text, r"\p{Nd}", "9")
    return F.regexp_replace(F.regexp_replace(out, r"[඀-෿]", "ස"), r"[A-Za-z]", "x")


def phonetic_key(token: Column) -> Column:
    """One key for spellings of a Latin-script name that sound alike."""
    out = F.regexp_replace(F.lower(token), "[^a-z]", "")
    out = F.regexp_replace(out, "(ee|ey)$", "i")
    for a, b in (("nd", "d"), ("mb", "b"), *REWRITES):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"(.)\1+", "$1")
    trimmed = F.regexp_replace(F.regexp_replace(out, "y$", "i"), "[aeou]+$", "")
    return F.when(F.length(out) > 3, trimmed).otherwise(out)


def skeleton(key: Column) -> Column:
    return F.regexp_replace(key, "[aeiouy]", "")


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 where either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def token_script(token: Column) -> Column:
    """sinhala, tamil, numeric or latin, the first that fits."""
    return F.when(token.rlike(SINHALA), "sinhala").when(token.rlike(TAMIL), "tamil").when(token.rlike(r"^[\d.,:]+$"), "numeric").otherwise("latin")


def shape(token: Column) -> Column:
    """Orthographic features of a token, in a fixed order."""
    letters = token.rlike(r"^\p{L}+$")
    return F.array_compact(
        F.array(
            F.when(letters & (F.upper(token) == token) & (F.length(token) > 1), "#allcaps"),
            F.when(token.rlike(r"^\p{Lu}\p{Ll}"), "#cap"),
            F.when(token.rlike(r"\d"), "#hasdigit"),
            F.when(F.length(token) <= 2, "#short"),
            F.when(F.length(token) >= 10, "#long"),
        )
    )


def grams(word: Column, n: int = 3) -> Column:
    """Letter n-grams of a word between ^ and $; none where it is too short."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    last = F.length(padded) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def cleaned(value: Column) -> Column:
    """Null for values that say nothing."""
    return F.when(~F.lower(F.trim(value)).isin("", "n/a", "none", "null"), F.trim(value))


# Lengths and prefixes of identifiers.
def valid_day(day: Column) -> Column:
    return day.between(1, 366) | day.between(501, 866)


def is_old_nic(digits: Column) -> Column:
    return (F.length(digits) == 9) & valid_day(F.substring(digits, 3, 3).try_cast("int"))


def is_new_nic(digits: Column, year: int) -> Column:
    return (F.length(digits) == 12) & F.substring(digits, 1, 4).try_cast("int").between(1900, year) & valid_day(F.substring(digits, 5, 3).try_cast("int"))


def local_phone(digits: Column) -> Column:
    """A phone number in local form, or null."""
    abroad = (F.length(digits) == 11) & digits.startswith("94") & (F.substring(digits, 3, 1) != "0")
    local = digits.rlike("^0[1-9][0-9]{8}$")
    return F.when(abroad, F.concat(F.lit("0"), F.substring(digits, 3, 9))).when(local, digits)


def digit_class(digits: Column, context: Column, year: int) -> Column:
    """NIC, PHONE, ACCOUNT or null for a run of digits without a letter, by its length and the
    context (NIC, PHONE, ACCOUNT, AMOUNT or null)."""
    n, c = F.length(digits), F.coalesce(context, F.lit(""))
    return (
        F.when(c == "AMOUNT", None)
        .when((c == "NIC") & n.between(9, 14) & ~digits.startswith("0"), "NIC")
        .when((c == "ACCOUNT") & (n >= 6), "ACCOUNT")
        .when(local_phone(digits).isNotNull() | digits.rlike("^0[1-9][0-9]{9}$"), "PHONE")
        .when(is_new_nic(digits, year) | is_old_nic(digits), "NIC")
        .when(n.between(10, 18), "ACCOUNT")
    )
