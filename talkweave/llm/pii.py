"""Personal data in text: fixed rules, and weak supervision for the spans that rules leave open.

Four kinds have a fixed definition and always stay. Beyond them, wide patterns propose candidate
spans, and seven labelers (shape, gazetteer, words before, words after, variety, surroundings and
checksum) vote for, against or not at all. Only how often each pattern of votes occurs matters to
expectation-maximisation, so the table it works on is bounded by the number of patterns, whatever
the corpus; it estimates how reliable each labeler is and how likely each pattern is personal data.

A logistic span classifier is then trained on those likelihoods. It does not see the votes, but
features of the span and its context: length, digits, distinct characters, the word before, the
characters next to it, the place in the line. It decides each candidate. What it learns from is
one row for each kind and combination of features, which is bounded as well.

The path over the corpus consists of DataFrame functions only. A pattern never tries twice to
match from inside a run that it has failed on, and repeats are possessive, so the time is linear
in the text and no text is too long for the matcher's stack.
"""

from __future__ import annotations

from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import shielded, written

LOCAL = r"[A-Za-z0-9._%+-]"
#: The kinds with a fixed definition, in the order of results.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur in it; cheap to look for.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: First names that are frequent in the corpus' four languages.
NAMES = (
    "Adam Alan Albert Alejandro Alexander Alice Amelia Ana Andrea Andreas Anna Anne Antoine Antonio Barbara Bernard Brian Camille Carla Carlos Carmen Caroline Charles Charlotte "
    "Christian Christine Claire Claudia Daniel David Diana Diego Dieter Edward Elena Elisabeth Elizabeth Emily Emma Eric Eva Felix Fernando Francisco Franz Friedrich George Gerhard "
    "Hans Heinrich Helen Helga Henri Isabel Isabelle Jack Jacques James Jan Jane Javier Jean Jennifer John Jonas Jorge Joseph Juan Julia Jürgen Karl Katharina Klaus Laura Linda Louis "
    "Lucas Luis Manuel Marc Maria Marie Mark Martin Mary Matthias Michael Michel Miguel Monika Nicolas Olivia Pablo Patricia Paul Pedro Peter Philippe Pierre Rafael Richard Robert Sabine "
    "Sarah Sofia Sophie Stefan Susan Sylvie Thomas Ursula Victor Werner William Wolfgang"
).replace(" ", "|")
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Doña"
WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++"
#: Kinds of candidates, in the order of results, and the patterns that propose them.
EXTRA = {
    "account": r"(?<![0-9A-Za-z])[0-9]{10,19}+(?![0-9A-Za-z])",
    "local": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:{TITLES})\.?\x20{WORD}(?:\x20{WORD})?+|(?:{NAMES})\x20{WORD})",
    "secret": r"(?i)(?<![a-z])(?:token|secret|password|api[_-]?key)\x20?[=:]\x20?\"?[a-z0-9_-]{16,}+\"?",
}
LABELERS = ("shape", "gazetteer", "before", "after", "variety", "surroundings", "checksum")
#: What EM starts from, and is held near: how often a labeler votes for, against and not at all on
#: personal data, and on other spans.
RATES = (
    ((0.5, 0.1, 0.4), (0.3, 0.2, 0.5)),
    ((0.5, 0.1, 0.4), (0.3, 0.2, 0.5)),
    ((0.6, 0.02, 0.38), (0.01, 0.5, 0.49)),
    ((0.2, 0.01, 0.79), (0.01, 0.2, 0.79)),
    ((0.8, 0.05, 0.15), (0.6, 0.25, 0.15)),
    ((0.8, 0.05, 0.15), (0.6, 0.25, 0.15)),
    ((0.6, 0.05, 0.35), (0.2, 0.5, 0.3)),
)
#: Words that speak for personal data next to a number or name, and against.
FOR_WORDS = (
    "account|acct|iban|card|konto|kontonummer|compte|cuenta|call|phone|tel|tél|téléphone|telefon|telefonnummer|teléfono|mobile|móvil|handy|fax|contact|kontakt|contacto|token|secret|password|passwort|contraseña|"
    "key|clé|schlüssel|clave|name|nom|nombre|patient|paciente|signed|customer|kunde|client|cliente|passport|ausweis|pasaporte|ssn|dear|from|by"
)
AGAINST_WORDS = (
    "version|page|seite|página|isbn|ean|order|bestellung|commande|pedido|item|artikel|article|artículo|serial|série|serie|sku|section|line|ligne|zeile|línea|build|ticket|invoice|rechnung|facture|factura|"
    "tracking|street|avenue|college|hospital|prize|theorem"
)
GAP = r"[^0-9\p{L}]{0,12}"
NUMBER = rf"(?:(?:no|nr|num|number|nummer|número){GAP})?$"
FOR, AGAINST = rf"(?i)(?<!\p{{L}})(?:{FOR_WORDS}){GAP}{NUMBER}", rf"(?i)(?<!\p{{L}})(?:{AGAINST_WORDS}){GAP}{NUMBER}"
AFTER_FOR = r"(?i)^[^0-9\p{L}]{0,4}(?:exp|expires|valid|ext|extension|holder|owner|said|says|wrote|born|lives|works|called|dit|sagte|dijo)(?!\p{L})"
AFTER_AGAINST = rf"(?i)^[^0-9\p{{L}}]{{0,4}}(?:{AGAINST_WORDS}|units|bytes|items|times|rows|km|kg|ms|eur|usd)(?!\p{{L}})"
#: First digits of payment card ranges; area codes; frequent first names; hex digits of a key.
GAZETTEER = {"account": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", "local": r"^\(?[2-9]", "name": rf"(?<!\p{{L}})(?:{NAMES})(?!\p{{L}})", "secret": r"(?i)[=:]\x20?\"?[0-9a-f]{32,}"}
SHAPE = {"account": r"^[0-9]{16}$", "local": r"^(?:\([0-9]{3}\)\x20?[0-9]{3}[\x20.-]|[0-9]{3}([\x20.-])[0-9]{3}\1)[0-9]{4}$", "name": rf"\x20{WORD}\x20{WORD}$", "secret": r"[=:]\x20?\"[^\"]*\"$"}
SPAN = "array<struct<kind:string,s:int,e:int,h:string>>"


def found(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern from left to right: kind, start and end in code points, text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc, x):
            s = acc["at"] + F.length(x["g"])
            e = s + F.length(x["h"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["h"].alias("h")))).alias("out"))

        return F.aggregate(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))), start, step)["out"]

    placed = F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, place(h)).otherwise(F.array().cast(SPAN)))[0]
    need = NEEDS.get(kind)
    return F.when(F.instr(text, need) > 0, placed).otherwise(F.array().cast(SPAN)) if need else placed


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid(kind: str, h: Column) -> Column:
    """Whether a match of a base kind counts."""
    if kind == "ip":
        return ~h.rlike(r"(?:^|\.)0*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[1-9][0-9]{3,})(?:\.|$)")
    if kind == "card":
        return F.length(_digits(h)).between(13, 19) & F.call_function("luhn_check", _digits(h))
    if kind == "phone":
        return F.length(_digits(h)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, BASE[kind], kind), lambda x: valid(kind, x["h"]))


def votes(text: Column, kind: str, x: Column) -> Column:
    """One letter for each labeler: p for, n against, o no vote."""
    h = x["h"]
    before, after, around = _context(text, x)
    one = lambda yes, no=None: F.when(yes, "p").when(no, "n").otherwise("o") if no is not None else F.when(yes, "p").otherwise("n")
    kinds_of_letters = F.size(F.array_distinct(F.split(h, "")))
    digits = _digits(h)
    checked = {
        # what passes the checksum of cards is a base span already
        "account": F.when(F.length(digits) >= 13, "n").otherwise("o"),
        "local": one(digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[01]|^[0-9]{3}[01]")),
        "name": one(h.rlike(rf"^(?:{TITLES})"), F.lit(False)),
        "secret": one(h.rlike("[0-9]") & h.rlike("(?i)[a-z][^a-z]*[a-z]"), F.lit(False)),
    }
    return F.concat(
        one(h.rlike(SHAPE[kind]), None if kind == "local" else F.lit(False)),
        one(h.rlike(GAZETTEER[kind]), None if kind in ("local", "secret") else F.lit(False)),
        one(before.rlike(FOR), before.rlike(AGAINST)),
        one(after.rlike(AFTER_FOR), after.rlike(AFTER_AGAINST)),
        one(kinds_of_letters >= (F.lit(5) if kind in ("account", "local") else F.lit(8)), kinds_of_letters <= 3),
        one(around.rlike(r"^[\x20\n(\"][\x20\n.,;:!?)|]?$"), around.rlike(r"[#$%&@/\\_=]")),
        checked[kind],
    )


def _context(text: Column, x: Column) -> tuple[Column, Column, Column]:
    """Up to 32 characters before a span and after it, and its two neighbours (a space for none before)."""
    before = F.substring(text, F.greatest(F.lit(1), x["s"] - 31), F.least(F.lit(32), x["s"]))
    around = F.concat(F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise(" "), F.substring(text, x["e"] + 1, F.lit(1)))
    return before, F.substring(text, x["e"] + 1, F.lit(32)), around


#: What the span classifier sees, and the values of each.
FEATURES = {"length": 5, "digits": 3, "distinct": 3, "word_before": 5, "next": 4, "word_after": 3, "line_start": 2}


def traits(text: Column, x: Column) -> Column:
    """The features of a span and its context, a digit each: at most as many combinations as FEATURES allow."""
    h = x["h"]
    before, after, around = _context(text, x)
    size, distinct, digits = F.length(h), F.size(F.array_distinct(F.split(h, ""))), F.length(_digits(h))
    cut = lambda c, *at: F.aggregate(F.array(*[F.lit(v) for v in at]), F.lit(0), lambda n, v: n + (c >= v).cast("int"))
    last = F.regexp_extract(before, rf"([0-9\p{{L}}]++){GAP}$", 1)
    neighbour = F.substring(around, 2, 1)
    return F.concat(
        cut(size, 12, 15, 18, 30).cast("string"),
        F.when(digits == 0, "0").when(digits == size, "2").otherwise("1"),
        cut(distinct, 5, 9).cast("string"),
        F.when(last == "", "0").when(before.rlike(FOR), "1").when(before.rlike(AGAINST), "2").when(last.rlike("^[0-9]"), "3").otherwise("4"),
        F.when(neighbour == "", "0").when(neighbour.rlike(r"\s"), "1").when(neighbour.rlike("[.,;:!?)]"), "2").otherwise("3"),
        F.when(after.rlike(AFTER_FOR), "1").when(after.rlike(AFTER_AGAINST), "2").otherwise("0"),
        (before == "").cast("int").cast("string"),
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans of each base kind, and more_ (candidates that meet no base span and no
    earlier candidate: kind, s, e, votes, traits)."""
    out = docs.withColumn("whole_", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("whole_")
    out = out.withColumns({f"base_{k}_": base_spans(text, k) for k in BASE} | {f"wide_{k}_": found(text, EXTRA[k], k) for k in EXTRA})
    taken = F.concat(*[F.col(f"base_{k}_") for k in BASE])

    def voted(k: str) -> Column:
        return F.transform(F.col(f"wide_{k}_"), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), votes(text, k, x).alias("votes"), traits(text, x).alias("traits")))

    more = F.concat(*[voted(k) for k in EXTRA])
    kind = "array<struct<kind:string,s:int,e:int,votes:string,traits:string>>"
    free = F.aggregate(
        more,
        F.array().cast(kind),
        lambda acc, x: F.when(F.exists(taken, lambda t: (t["s"] < x["e"]) & (x["s"] < t["e"])) | F.exists(acc, lambda t: (t["s"] < x["e"]) & (x["s"] < t["e"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    out = out.withColumn("more_", F.when(F.size(more) > 0, free).otherwise(F.array().cast(kind)))
    return out.drop("whole_", *[f"wide_{k}_" for k in EXTRA])


def reliabilities(counts: dict[tuple[str, str], int], steps: int = 60, held: float = 1.0) -> dict[tuple[str, str], float]:
    """How likely each (kind, votes) is personal data, by expectation-maximisation over the counts.

    Labelers err independently given the truth, each at a rate of its own for each kind. The rates
    start from RATES, which weigh as much as ``held`` of the spans (ten at least): that fixes which
    of the two classes is personal data.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in {k for k, _ in counts}:
        rows = {v: n for (k, v), n in counts.items() if k == kind}
        total = sum(rows.values())
        labelers = range(min(map(len, rows)))
        start = [{truth: dict(zip("pno", r)) for truth, r in zip((True, False), RATES[j])} for j in labelers]
        rate, prior, weight = start, 0.5, max(10.0, held * total)
        belief: dict[str, float] = {}
        for _ in range(steps):
            for v in rows:
                a, b = log(prior), log(1 - prior)
                for j in labelers:
                    a, b = a + log(rate[j][True][v[j]]), b + log(rate[j][False][v[j]])
                belief[v] = 1 / (1 + exp(min(700, max(-700, b - a))))
            prior = min(0.99, max(0.01, (sum(n * belief[v] for v, n in rows.items()) + weight / 2) / (total + weight)))
            rate = []
            for j in labelers:
                seen = {truth: {x: weight * c for x, c in start[j][truth].items()} for truth in (True, False)}
                for v, n in rows.items():
                    seen[True][v[j]] += n * belief[v]
                    seen[False][v[j]] += n * (1 - belief[v])
                rate.append({truth: {x: c / sum(r.values()) for x, c in r.items()} for truth, r in seen.items()})
        out |= {(kind, v): p for v, p in belief.items()}
    return out


def classifier(rows: list[tuple[str, str, float, int]], steps: int = 300, ridge: float = 1e-3):
    """A logistic regression on spans (kind, traits, summed likelihood, count): each kind has a weight,
    and one for each value of each feature. Returns how likely (kind, traits) is."""
    names = lambda k, t: [k, *(f"{k}{j}{x}" for j, x in enumerate(t))]
    columns = {c: i for i, c in enumerate(sorted({c for k, t, _, _ in rows for c in names(k, t)}))}
    x = np.zeros((len(rows), len(columns)))
    for i, (k, t, _, _) in enumerate(rows):
        x[i, [columns[c] for c in names(k, t)]] = 1
    n = np.array([r[3] for r in rows], float)
    target = np.array([r[2] for r in rows]) / np.maximum(n, 1)
    w = np.zeros(len(columns))
    share = n / max(n.sum(), 1)
    for _ in range(steps):  # Newton steps; the ridge keeps them finite
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (share * (target - p)) - ridge * w)
        w += step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return lambda k, t: 1 / (1 + exp(-sum(w[columns[c]] for c in names(k, t) if c in columns)))


def accepted(counts: dict[tuple[str, str], int], spans=None) -> list[tuple[str, str]]:
    """What the method takes for personal data: the (kind, votes) whose likelihood is over a half or,
    with ``spans`` (a function from likelihoods to rows for the classifier), the (kind, traits) that
    the trained classifier takes."""
    belief = reliabilities(counts)
    if spans is None:
        return sorted(k for k, p in belief.items() if p > 0.5)
    rows = spans(belief)
    likely = classifier(rows) if rows else None
    return sorted((k, t) for k, t, _, _ in rows if likely(k, t) > 0.5)


def decided(with_candidates: DataFrame) -> list[tuple[str, str]]:
    """The (kind, traits) that count as personal data, learnt from the candidates of all rows."""
    found = with_candidates.select(F.explode("more_").alias("x")).select("x.kind", "x.votes", "x.traits")
    # at most 4 x 3^7 and then 4 x 5400 rows, whatever the corpus
    counts = {(r["kind"], r["votes"]): r["count"] for r in found.groupBy("kind", "votes").count().collect()}

    def spans(belief: dict[tuple[str, str], float]) -> list[tuple[str, str, float, int]]:
        said = with_candidates.sparkSession.createDataFrame([(k, v, p) for (k, v), p in belief.items()], "kind string, votes string, belief double") if belief else None
        if said is None:
            return []
        rows = found.groupBy("kind", "votes", "traits").count().join(F.broadcast(said), ["kind", "votes"])
        rows = rows.groupBy("kind", "traits").agg(F.sum(F.col("belief") * F.col("count")).alias("belief"), F.sum("count").alias("n")).collect()
        return sorted((r["kind"], r["traits"], r["belief"], r["n"]) for r in rows)

    return accepted(counts, spans)


def kept_spans(chosen: list[tuple[str, str]]) -> Column:
    """All spans (kind, s, e): base ones, then accepted candidates, in the order of results."""
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    yes = F.array(*[F.lit(k + t) for k, t in chosen]) if chosen else F.array().cast("array<string>")

    def taken(k: str) -> Column:
        return plain(F.filter(F.col("more_"), lambda x: (x["kind"] == k) & F.array_contains(yes, F.concat(x["kind"], x["traits"]))))

    return F.concat(*[plain(F.col(f"base_{k}_")) for k in BASE], *[taken(k) for k in EXTRA])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def annotate(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest and all spans, for each row of docs.

    Null and empty texts have no spans; rows that repeat get a row each; a null doc_id stays null;
    further columns are not read.
    """
    seen = written(candidates(docs.select("doc_id", "text")).drop("text"), "pii-candidates")
    base = F.concat(*[F.col(f"base_{k}_") for k in BASE])
    return seen.select("doc_id", *[F.size(f"base_{k}_").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(kept_spans(decided(seen))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, and n_chars brought up to date.

    Overlapping spans are replaced as one, by the kind that begins first.
    """
    docs, back = shielded(docs, ("text", "n_chars"))
    seen = written(candidates(docs), "pii-candidates")
    spans = F.array_sort(F.transform(kept_spans(decided(seen)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    text = F.coalesce("text", F.lit(""))
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))).alias("out"))
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    out = seen.withColumn("spans_", spans).withColumn("text", F.when(F.size("spans_") > 0, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(out)
