"""Names and addresses across scripts: case endings, mention similarity, address signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkweave.functions import identifiers as N
from talkweave.functions import text as T

# Case endings of names, longest first.
CASE_ENDINGS = ("ගෙන්ම", "ගෙන්", "ගෙන", "ටත්", "ගේ", "ගෙ", "ට", "ත්", "ව", "ද", "යි", "ලා")
# Words before a full stop that ends no sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "rev", "st", "no")
# Everyday words that are no names, and forms of address.
NOT_NAMES = (
    "sthuthiy", "sthuthi", "isthuthi", "istuti", "stuti", "thanks", "thank", "you", "ayubowan", "ayubovan", "hello", "hi", "hari", "ow", "owu", "naha", "nehe", "nae", "ehenam",
    "aiyo", "ane", "prashnayak", "prashne", "kamak", "hondai", "mama", "oya", "api", "eya", "sinhalen", "sinhala", "demalen", "demala", "ingreesi", "ingrisi", "english", "englishen",
    "ස්තූතියි", "ස්තුතියි", "ආයුබෝවන්", "හරි", "ඔව්", "නැහැ", "සිංහලෙන්", "ඉංග්‍රීසියෙන්", "දෙමළෙන්",
)
ADDRESS_TERMS = ("sir", "madam", "miss", "aunty", "uncle", "aiya", "akka", "malli", "nangi")
# Words of any address, and place words with their translations.
GENERIC = (
    "no", "number", "num", "road", "rd", "street", "st", "lane", "ln", "avenue", "ave", "mawatha", "mw", "mawathe", "place", "pl", "junction", "jn", "cross", "terrace",
    "gardens", "garden", "estate", "watta", "para", "pare", "district", "province", "sri", "lanka", "postal", "code", "house", "flat", "apartment", "floor", "unit", "the", "of",
    "slash", "dr", "doctor", "rev", "sir", "de", "da",
    "පාර", "පාරේ", "වීදිය", "පටුමග", "මාවත", "මාවතේ", "අංක", "අංකය", "නොම්බර", "නම්බර්", "පෙදෙස", "හන්දිය", "ගම", "වත්ත", "නිවස", "ගෙදර", "ලංකාව", "ශ්‍රී",
    "ලේන්", "ලේන්එක", "රෝඩ්", "රෝඩ්එක", "ස්ට්‍රීට්", "ඇවනියු", "ප්ලේස්", "ජන්ෂන්", "නම්බර", "ස්ලෑෂ්", "ආචාර්ය", "වෛද්‍ය", "ද",
)
PLACES = {
    "පන්සල": "temple", "පන්සල්": "temple", "විහාර": "vihara", "පල්ලිය": "church", "කෝවිල": "kovil", "පල්ලි": "mosque", "දුම්රියපොළ": "station", "ස්ටේෂන්": "station",
    "වැව": "lake", "වැව්": "lake", "රෝහල": "hospital", "රෝහල්": "hospital", "පාසල": "school", "පාසල්": "school", "වෙළඳපොළ": "market", "ප්‍රධාන": "main",
    "නව": "new", "පැරණි": "old", "මල්": "flower", "කඳු": "hill", "මුහුද": "sea", "මහනුවර": "kandy", "ගාල්ල": "galle", "යාපනය": "jaffna", "මීගමුව": "negombo",
    "හලාවත": "chilaw", "ත්‍රිකුණාමලය": "trincomalee", "මඩකලපුව": "batticaloa", "කොළඹ": "colombo", "ශ්‍රී ජයවර්ධනපුර": "kotte", "කෝට්ටේ": "kotte", "මහනුවරට": "kandy", "ගාල්ලේ": "galle",
    "ශාලාව": "hall", "ශාලා": "hall", "විශ්වවිද්‍යාලය": "university", "කර්මාන්තපුරය": "industrial", "කර්මාන්ත": "industrial", "කාර්යාලය": "office",
    "pansala": "temple", "palliya": "church", "kovila": "kovil", "wewa": "lake",
}
SAME_PLACE = 0.8
_BETWEEN = r"[\s,.;:!?()]+"


def name_key(token: Column) -> Column:
    """The phonetic key of a name in either script."""
    return T.phonetic_key(N.romanised(token))


def variants(token: Column) -> Column:
    """The token and, for a Sinhala one, what is left without a case ending of at most all but two letters."""
    stem = lambda e: F.when(token.endswith(e) & (F.length(token) > len(e) + 1), F.substring(token, F.lit(1), F.length(token) - len(e)))
    stems = F.array_compact(F.array(*[stem(e) for e in CASE_ENDINGS]))
    linked = F.transform(F.filter(stems, lambda s: s.endswith("ු")), lambda s: F.concat(F.substring(s, F.lit(1), F.length(s) - 1), F.lit("්")))
    return F.when(token.rlike(T.SINHALA), F.array_distinct(F.concat(F.array(token), stems, linked))).otherwise(F.array(token))


def mention_keys(surface: Column) -> Column:
    """For each name token of a mention, the keys of its forms."""
    return F.transform(N.name_tokens(surface), lambda t: F.transform(variants(t), name_key))


def mention_similarity(a: Column, b: Column) -> Column:
    """The worst of the shorter mention's tokens by its best partner in the longer one; a and b are
    arrays of mention_keys. 0 where either is empty."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    token = lambda x, y: F.array_max(F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: N.key_similarity(p, q)))))
    best = F.transform(short, lambda x: F.array_max(F.transform(long, lambda y: token(x, y))))
    return F.coalesce(F.array_min(best), F.lit(0.0))


def sentence_parts(name: Column) -> Column:
    """A name span cut at full stops but those after an abbreviation; empty parts go."""
    return F.filter(F.split(name, rf"(?i)(?<!(?:^|\s)(?:{'|'.join(ABBREVIATIONS)}))\. "), lambda p: p != "")


def trimmed_name(surface: Column) -> Column:
    """(skip, name): the code points before the name and the name without everyday words at its
    edges; null where nothing is left or only forms of address are."""
    word = f"(?iu:{'|'.join(NOT_NAMES)})"
    front = F.length(F.regexp_extract(surface, rf"^[\s,.;:!?()]*(?:{word}(?:{_BETWEEN}|$))*", 0))
    rest = F.substring(surface, front + 1, F.length(surface))
    name = F.regexp_replace(rest, rf"(?:(?:^|{_BETWEEN}){word})*[\s,.;:!?()]*$", "")
    empty = (name == "") | name.rlike(rf"^(?iu:{'|'.join(ADDRESS_TERMS)})(?:{_BETWEEN}(?iu:{'|'.join(ADDRESS_TERMS)}))*$")
    return F.when(~empty, F.struct(front.alias("skip"), name.alias("name")))


def address_key(token: Column) -> Column:
    """The phonetic key of a place word; c before a, o and u sounds as k."""
    return name_key(F.regexp_replace(F.lower(token), "c(?=[aou])", "k"))


def signature(surface: Column, spoken: Column | None = None) -> Column:
    """(numbers, places) of an address: its number groups without ordinal endings and leading zeros
    and the keys of its place words. spoken: numerals.number_runs of the lower-cased surface."""
    text = F.lower(surface)
    group = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:(?:st|nd|rd|th)|[a-z](?![a-z]))?)"), F.lit(1))
    bare = lambda g: F.regexp_replace(F.regexp_replace(g, "(st|nd|rd|th)$", ""), "^0+(?=[0-9])", "")
    numbers, used = F.transform(group, bare), F.array().cast("array<string>")
    if spoken is not None:
        phrase = lambda r: F.substring(text, r["start"] + 1, r["end"] - r["start"])
        said = F.filter(spoken, lambda r: phrase(r).contains(" ") | phrase(r).rlike(r"[^\x00-\x7F]"))
        numbers = F.concat(numbers, F.transform(said, lambda r: F.regexp_replace(r["digits"], "^0+(?=[0-9])", "")))
        used = F.flatten(F.transform(said, lambda r: F.split(phrase(r), r"\s+")))
    tokens = F.filter(F.regexp_extract_all(text, F.lit(r"[^\s,.;:()\[\]/'\"]+"), F.lit(0)), lambda t: ~t.isin(*GENERIC) & ~t.rlike(r"\p{Nd}") & ~F.array_contains(used, t))
    places = F.transform(tokens, lambda t: address_key(F.coalesce(F.element_at(N._map(PLACES), t), t)))
    return F.struct(F.array_sort(F.array_distinct(numbers)).alias("numbers"), F.filter(places, lambda k: F.length(k) >= 3).alias("places"))


def _found(key: Column, keys: Column) -> Column:
    return F.exists(keys, lambda k: N.key_similarity(key, k) >= SAME_PLACE)


def same_address(a: Column, b: Column) -> Column:
    """Whether two signatures name one address: equal numbers and, with a number, one common place or
    a side without places; without a number every place of the shorter one."""
    pa, pb = a["places"], b["places"]
    short, long = F.when(F.size(pa) <= F.size(pb), pa).otherwise(pb), F.when(F.size(pa) <= F.size(pb), pb).otherwise(pa)
    numbered = F.size(a["numbers"]) > 0
    both = F.when(numbered, F.exists(short, lambda k: _found(k, long))).otherwise(F.forall(short, lambda k: _found(k, long)))
    return (a["numbers"] == b["numbers"]) & F.when(F.size(short) == 0, numbered & (F.size(long) > 0)).otherwise(both)


def part_of(a: Column, b: Column) -> Column:
    """Whether a is a shortened mention of b: it names a place, and b has all its numbers and places."""
    pa, pb = a["places"], b["places"]
    return (F.size(pa) > 0) & (F.size(pa) <= F.size(pb)) & (F.size(F.array_except(a["numbers"], b["numbers"])) == 0) & F.forall(pa, lambda k: _found(k, pb))


def span_script(surface: Column, kind: Column) -> Column:
    """SINHALA for a span with such a letter; a span without letters goes by its document's kind."""
    return F.when(surface.rlike(T.SINHALA) | (kind == "clean_si"), "SINHALA").otherwise("LATIN")


def is_romanised(text: Column) -> Column:
    """Fewer Sinhala letters than Latin ones."""
    return F.regexp_count(text, F.lit(T.SINHALA)) < F.regexp_count(text, F.lit("[A-Za-z]"))


def read_out(span: Column) -> Column:
    """Seven tokens or more, each a single digit or no number."""
    tokens = F.filter(F.split(F.replace(span, F.lit(","), F.lit(" ")), r"\s+"), lambda t: t != "")
    return (F.size(tokens) >= 7) & F.forall(tokens, lambda t: ~t.rlike("^[0-9]{2,}$"))


def like_date(token: Column) -> Column:
    """Three dotted groups, one of them of four digits."""
    groups = F.split(token, r"\.")
    return (F.size(groups) == 3) & F.exists(groups, lambda g: F.length(g) == 4)
