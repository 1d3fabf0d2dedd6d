"""Personal data (operator 5): patterns propose spans, checksums confirm, context adjusts scores.

Only DataFrame functions.  Positions come from splitting a text by the same pattern that
extracted the matches: a match starts after all earlier matches and all pieces before it.
Patterns scan in linear time on any text: a match can only start where a run of its first class
starts or where the match before ended (``\\G``), which is where the plain pattern would match,
and all loops are possessive, so no text makes the matcher recurse or backtrack over long runs.

Edge cases: a null or empty text has no spans; overlapping spans of different kinds are all
reported; further columns of the input pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
_LABEL = "[A-Za-z0-9-]++"


@dataclass(frozen=True)
class Kind:
    """pattern: linear-time form; hint: a literal that every match holds ('' if none); base: score
    of a confirmed span; context: words nearby that raise it."""

    name: str
    pattern: str
    hint: str
    base: float
    context: str


KINDS = [
    Kind("email", rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@{_LABEL}(?:\.{_LABEL})++", "@",
         0.9, "mail|e-mail|email|contact|write|reach|kontakt|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6,
         "ip|host|server|address|login|adresse|dirección"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[ -]?+[0-9])++", "", 0.7,
         "card|visa|mastercard|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7,
         "call|phone|tel|mobile|fax|telefon|téléphone|teléfono"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
         r"(?![A-Za-z0-9])", "", 0.8,
         "iban|bank|account|konto|compte|cuenta|bic"),
]
BASE = ["email", "ip", "card", "phone"]
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.1


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + _luhn_digit(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return total % 10 == 0


def _luhn_digit(d: Column, twice: Column) -> Column:
    return F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)


def mod97(iban: Column) -> Column:
    """Remainder of an account number (country and check digits moved to the end, letters as
    10 to 35) modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step)


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind in ("card", "phone"):
        digits = F.regexp_replace(found, "[^0-9]", "")
        low, high = (13, 19) if kind == "card" else (9, 15)
        fits = F.length(digits).between(low, high)
        return F.when(fits, luhn(digits)).otherwise(F.lit(False)) if kind == "card" else fits
    if kind == "iban":
        return mod97(F.regexp_replace(found, " ", "")) == 1
    return F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed spans of one kind, by start."""
    # the last piece has no match after it: zip_with gives it a null
    pieces = F.zip_with(
        F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    nothing = F.struct(F.lit(0).alias("at"),
                       F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def place(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        out = F.when(_confirmed(kind.name, p["match"]), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.when(p["match"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), out.alias("out")))

    placed = F.aggregate(pieces, nothing, place, lambda acc: acc["out"])

    def scored(s: Column) -> Column:
        near = F.lower(F.concat_ws(
            " ", F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS + 1, F.lit(1)),
                             F.least(s["start"], F.lit(CONTEXT_CHARS))),
            F.substring(text, s["end"] + 1, F.lit(CONTEXT_CHARS))))
        bonus = F.when(near.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{kind.context})(?![\p{{L}}\p{{N}}])"),
                       CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"),
                        s["end"].alias("end"), (F.lit(kind.base) + bonus).alias("score"))

    return F.transform(placed, scored)


_NONE = "array<struct<kind:string,start:int,end:int,score:double>>"


_PROBES = {
    "ip": r"[0-9]\.[0-9]",
    "card": "[0-9](?:[ -]?[0-9]){12}",
    "phone": r"\+[0-9]",
    "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
}


def span_columns(df: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """``df`` with one column ``<prefix><kind>`` for each kind: its spans as an array of (kind,
    start, end, score), positions in code points, end exclusive."""
    t = F.coalesce(F.col(text), F.lit(""))
    cols = {}
    for kind in KINDS:  # a text is scanned only if it holds what every match holds
        may = t.contains(kind.hint) if kind.hint else F.lit(True)
        if kind.name in _PROBES:
            may = may & t.rlike(_PROBES[kind.name])
        cols[prefix + kind.name] = F.when(may, _spans(t, kind)).otherwise(F.array().cast(_NONE))
    return df.withColumns(cols)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """``df`` with every span of at least ``min_score`` replaced by its kind in brackets;
    overlapping spans become one, named after the first."""
    tmp = "__pii_"
    names = [tmp + k.name for k in KINDS]
    found = span_columns(df, text, tmp)
    every = F.array_sort(
        F.filter(F.concat(*names), lambda s: s["score"] >= min_score),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .otherwise(b["end"] - a["end"]))
    found = found.withColumn(tmp, every)
    t = F.col(text)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]),
                        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(F.col(tmp), nothing, cut, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substr(t, acc["at"] + 1)))
    return found.withColumn(text, F.when(F.size(tmp) > 0, done).otherwise(t)).drop(tmp, *names)
