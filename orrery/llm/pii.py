"""Personal data and secrets by weak supervision, in DataFrame functions only.

Patterns give candidate spans. Four labelers vote on each (for, against, abstain): its structure, a gazetteer
(top-level domains, calling and area codes, issuer and country prefixes, prefixes and lengths of secrets), the words
around it, and its boundaries. Candidates are counted by kind and votes; expectation-maximisation over these counts
estimates each labeler's reliability and the chance that a candidate is personal data. With these chances as soft labels
a logistic span classifier is trained on votes and shapes. Base spans (valid emails, addresses, cards and phones) always
stay; of the looser patterns' candidates, those that the classifier accepts and that touch no base span are added.

Fitting works on the table of counts, which has at most kinds x 3^4 x shapes rows, whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, blank
from orrery.llm.quality import bind

_LOCAL = "[A-Za-z0-9._%+-]"
#: Java patterns of the base kinds. Possessive runs and the looks behind only stop fruitless restarts inside a run;
#: they match what the plain patterns match, in linear time and without recursion.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, whose candidates only the classifier can accept.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[(\[](?:dot|DOT)[)\]]|\.) ?[A-Za-z0-9-]{1,63}+)++",
    "phone": r"(?<![0-9+(])(?<![0-9][ .-])(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
#: A cheap test that a text may hold a match at all.
MAY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": "+"}

#: Gazetteers (fixed values).
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "nl", "ch", "at", "be", "pl", "se", "jp", "cn", "in", "br", "mx", "au"]
CALLING = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421", "971", "972"]
COUNTRIES = ["AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
#: Beginnings of access keys, and lengths of keys and digests in hexadecimal digits.
SECRETS = ["ghp_", "gho_", "glpat-", "sk_live_", "sk_test_", "sk-", "AKIA", "AIza", "xoxa-", "xoxb-", "xoxp-", "eyJ", "npm_", "hf_"]
HEX = [32, 40, 64]
#: Words before a span that speak for a kind, and words that speak against any; secrets have their own.
CUES = {"email": "mail|contact|write|correo|courriel|an:", "ip": "ip|host|server|address|addr", "card": "card|visa|pay|credit|karte|tarjeta|carte", "phone": "phone|tel|call|fax|mobile|anruf|llama", "ssn": "ssn|social|security", "iban": "iban|account|konto|cuenta|compte", "secret": "token|key|secret|passw|pwd|bearer|auth|credential"}
AGAINST = "version|release|isbn|issn|section|chapter|page|license|figure|table|rfc"
AGAINST_SECRET = "commit|revision|checksum|digest|sha[0-9-]*|md5|etag|uuid|href|url|file"


def _running(steps: Column, total, start) -> Column:
    """For each step its start if all lie end to end. Long arrays are taken in pieces of 256, so appending stays cheap."""

    def plain(items: Column, size, at) -> Column:
        zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("o"))
        return F.aggregate(items, zero, lambda acc, e: F.struct((acc["p"] + size(e)).alias("p"), F.concat(acc["o"], F.array(acc["p"] + at(e))).alias("o")), lambda acc: acc["o"])

    def in_pieces(pieces: Column) -> Column:
        sums = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda acc, e: acc + total(e)))
        bases = plain(sums, lambda e: e, lambda e: F.lit(0))
        return F.flatten(F.zip_with(pieces, bases, lambda p, b: F.transform(plain(p, total, start), lambda x: x + b)))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 256).cast("int")), lambda c: F.slice(steps, c * 256 + 1, 256))
    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(bind(pieces, in_pieces))


_HIT = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def matches(text: Column, pattern: str, may: Column) -> Column:
    """All matches from left to right: start, end (code points), text, up to 24 characters before, one after."""

    def placed(v: Column) -> Column:
        steps = F.transform(v["hits"], lambda h, i: F.struct(F.length(F.get(v["gaps"], i)).alias("gap"), F.length(h).alias("size")))

        def named(s: Column) -> Column:
            starts = _running(s, lambda e: e["gap"] + e["size"], lambda e: e["gap"])
            return F.zip_with(
                F.transform(v["hits"], lambda h, i: F.struct(h.alias("hit"), i.alias("i"))),
                starts,
                lambda h, at: F.struct(at.alias("start"), (at + F.length(h["hit"])).alias("end"), h["hit"].alias("hit"), F.right(F.get(v["gaps"], h["i"]), F.lit(24)).alias("before"), F.left(F.get(v["gaps"], h["i"] + 1), F.lit(1)).alias("after")),
            )

        return bind(steps, named)

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(may, bind(both, placed)).otherwise(F.array().cast(_HIT))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    """The base checks."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(hit, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))
    n = F.length(_digits(hit))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(hit))
    return n.between(9, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return F.coalesce((v.when(no, -1) if no is not None else v).otherwise(0), F.lit(0))


def _gazetteer(kind: str, hit: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.regexp_extract(hit, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS))
    if kind == "ip":
        return _vote(~hit.rlike(r"^0*(0|10|127|169\.0*254|192\.0*168|22[4-9]|2[3-5][0-9])\."), F.lit(True))
    if kind == "card":
        return _vote(_digits(hit).rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), F.lit(True))
    if kind == "phone":
        d = _digits(hit)
        known = F.substring(d, 1, 1).isin(CALLING) | F.substring(d, 1, 2).isin(CALLING) | F.substring(d, 1, 3).isin(CALLING)
        # without a calling code: a trunk prefix, or an area code as in North America
        return F.when(hit.startswith("+"), _vote(known, F.lit(True))).otherwise(_vote(d.rlike("^(0[1-9]|[2-9][0-8][0-9])"), F.lit(True)))
    if kind == "ssn":
        return _vote(~hit.rlike("^(000|666|9)|-00-|-0000$"), F.lit(True))
    if kind == "secret":
        return _vote(hit.rlike("^(" + "|".join(SECRETS) + ")") | (hit.rlike("^([0-9a-f]+|[0-9A-F]+)$") & F.length(hit).isin(HEX)))
    return _vote(F.substring(hit, 1, 2).isin(COUNTRIES), F.lit(True))


def _structure(kind: str, hit: Column, base: bool, ok: Column) -> Column:
    if base:
        return _vote(ok, F.lit(True))
    if kind == "email":
        return _vote(hit.rlike("[A-Za-z]{2,24}$"), F.lit(True))
    if kind == "phone":
        return _vote(F.length(_digits(hit)).between(9, 11), F.lit(True))
    if kind == "ssn":
        return _vote(~(_digits(hit).rlike("^(.)\\1+$") | (hit == "123-45-6789")), F.lit(True))
    if kind == "secret":
        # letters and digits in turn, and not one word with a number in it
        turns = F.size(F.split(hit, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"))
        return _vote((turns >= 6) & hit.rlike("[A-Za-z]"), F.lit(True))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.instr(F.lit(letters), c) + 9))
    mod = F.aggregate(value, F.lit(0), lambda acc, x: F.when(x > 9, acc * 100 + x).otherwise(acc * 10 + x) % 97)
    return _vote(mod == 1, F.lit(True))


def _boundary(kind: str, m: Column) -> Column:
    """Blanks, quotes and brackets around speak for a span; letters, digits and paths against it."""
    before, after = m["before"], m["after"]
    if kind == "secret":
        return _vote(before.rlike("[\"'=:] ?$") | after.rlike("^[\"']"), before.rlike("[/#.&?]$") | after.rlike("^[/.]"))
    inside = before.rlike("[A-Za-z0-9_/=-]$") | after.rlike("^[A-Za-z0-9_/=-]")
    free = before.rlike("(^|[ \t\n\"'(<\\[:])$") & after.rlike("^($|[ \t\n\"')>\\].,;:!?])")
    return _vote(free & ~inside, inside)


def _candidate(kind: str, base: bool):
    def of(m: Column) -> Column:
        hit = m["hit"]
        ok = valid(kind, hit) if base else F.lit(False)
        context, against = F.lower(m["before"]), AGAINST_SECRET if kind == "secret" else AGAINST
        size = F.length(hit)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            ok.alias("base"),
            F.lit(not base).alias("loose"),
            _structure(kind, hit, base, ok).cast("int").alias("v0"),
            _gazetteer(kind, hit).cast("int").alias("v1"),
            _vote(context.rlike(rf"\b({CUES[kind]})"), context.rlike(rf"\b({against})")).cast("int").alias("v2"),
            _boundary(kind, m).cast("int").alias("v3"),
            F.when(size < 12, 0).when(size < 20, 1).otherwise(2).alias("shape"),
        )

    return of


def candidates(text: Column) -> Column:
    """Every candidate of a text, base kinds first, from left to right within a pattern."""
    text = blank(text)
    parts = []
    for kind, pattern in BASE.items():
        may = text.contains(MAY[kind]) if kind in ("email", "phone") else text.rlike(MAY[kind])
        parts.append(F.transform(matches(text, pattern, may), _candidate(kind, True)))
    quick = {"email": text.rlike(r"[(\[](at|AT)[)\]]"), "phone": text.rlike("[0-9][ .-][0-9]{3}"), "ssn": text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), "iban": text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), "secret": text.rlike("[0-9]") & text.rlike("[A-Za-z0-9_-]{20}")}
    for kind, pattern in LOOSE.items():
        parts.append(F.transform(matches(text, pattern, quick[kind]), _candidate(kind, False)))
    return F.concat(*parts)


VOTES = ["v0", "v1", "v2", "v3"]


def vote_counts(found: DataFrame) -> DataFrame:
    """(c: candidates) -> counts by kind, votes and shape."""
    c = found.select(F.explode("c").alias("c")).select("c.*")
    return c.groupBy("kind", *VOTES, "shape").agg(F.count("*").alias("n"))


@dataclass
class Model:
    """reliability[kind][labeler]: chance of each vote (-1, 0, 1) given personal data and given none; weights of the
    span classifier."""

    prior: dict[int, float]
    reliability: dict[int, list[tuple[dict[int, float], dict[int, float]]]]
    weights: dict[str, float]


def _names(kind: int, votes: tuple[int, ...], shape: int) -> list[str]:
    return ["bias", f"kind={kind}", f"shape={shape}", *(f"{v}={x}" for v, x in zip(VOTES, votes, strict=True) if x)]


def fit(rows: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 40, steps: int = 400) -> Model:
    """rows: (kind, votes, shape, count), a bounded number. Starts from the labelers' majority; pseudo-counts keep
    every chance off 0 and 1. No rows give a model that accepts nothing."""
    prior, reliability, soft = {}, {}, {}
    for kind in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == kind]
        chance = {r: 1 / (1 + math.exp(-1.5 * sum(r[1]))) for r in own}
        for _ in range(rounds):
            total = sum(r[3] for r in own)
            p = (sum(chance[r] * r[3] for r in own) + 1) / (total + 2)
            tables = []
            for k in range(len(VOTES)):
                # prior beliefs: a labeler is right rather than wrong, and may abstain in either case
                yes, no = {-1: 1.0, 0: 2.0, 1: 3.0}, {-1: 3.0, 0: 2.0, 1: 1.0}
                for r in own:
                    yes[r[1][k]] += chance[r] * r[3]
                    no[r[1][k]] += (1 - chance[r]) * r[3]
                tables.append(({v: x / sum(yes.values()) for v, x in yes.items()}, {v: x / sum(no.values()) for v, x in no.items()}))
            for r in own:
                score = math.log(p / (1 - p)) + sum(math.log(t[0][v] / t[1][v]) for t, v in zip(tables, r[1], strict=True))
                chance[r] = 1 / (1 + math.exp(-max(-30, min(30, score))))
        prior[kind], reliability[kind] = p, tables
        soft |= chance
    weights: dict[str, float] = {}
    scale = {r: math.log1p(r[3]) for r in rows}  # common patterns count more, but none drowns the others
    whole = sum(scale.values()) or 1.0
    for _ in range(steps):
        slope: dict[str, float] = {}
        for r in rows:
            names = _names(*r[:3])
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weights.get(x, 0.0) for x in names)))))
            for x in names:
                slope[x] = slope.get(x, 0.0) + (soft[r] - p) * scale[r] / whole
        for x, g in slope.items():
            weights[x] = weights.get(x, 0.0) + 2.0 * (g - 0.001 * weights.get(x, 0.0))
    return Model(prior, reliability, weights or {"bias": -1.0})


def score(c: Column, model: Model) -> Column:
    """The classifier's chance that candidate c is personal data."""
    w = model.weights
    z = F.lit(w.get("bias", 0.0))
    for kind in range(len(KINDS)):
        z = z + F.when(c["kind"] == kind, w.get(f"kind={kind}", 0.0)).otherwise(0.0)
    for shape in range(3):
        z = z + F.when(c["shape"] == shape, w.get(f"shape={shape}", 0.0)).otherwise(0.0)
    for v in VOTES:
        z = z + F.when(c[v] == 1, w.get(f"{v}=1", 0.0)).when(c[v] == -1, w.get(f"{v}=-1", 0.0)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, Model]:
    """docs (doc_id, text) -> (doc_id, spans), a row per row, and the model. A span has kind, start, end (code points,
    end exclusive), base and score; spans are in order of kind and start.

    Null and empty texts have none; repeated rows count each in the estimates; an empty table gives an empty one; other
    columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    found = ws.save(docs.select("doc_id", candidates(F.col("text")).alias("c")), "candidates")
    # one row for each kind, votes and shape there are: bounded by these, not by the corpus
    rows = [(r["kind"], tuple(r[v] for v in VOTES), r["shape"], r["n"]) for r in vote_counts(found).collect()]
    model = fit(sorted(rows))
    base = F.filter("c", lambda c: c["base"])
    loose = F.filter("c", lambda c: c["loose"])

    def spans(b: Column) -> Column:
        free = F.filter(loose, lambda c: (score(c, model) >= threshold) & ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])))
        return F.array_sort(F.transform(F.concat(b, free), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), score(c, model).alias("score"))))

    return found.select("doc_id", bind(base, spans).alias("spans")), model


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, a row per row of docs; nulls, repeated rows and empty tables as in find. n_added counts spans that
    the method adds."""
    found, _ = find(docs)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(BASE))]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), added)
