"""Personal data by proposals, checksums and context (operator 9), in DataFrame functions alone.

Regular expressions propose spans, validators (Luhn, mod 97, value ranges) confirm them, and context words nearby
raise or lower a score. Positions come from cutting a text at the matches: a match starts after the pieces and
matches before it. A pattern with an unbounded loop only begins where no match could have begun earlier (an address
not within a run of digits: none can begin there that could not begin at its start), so long runs of any character take
linear time; the loops are possessive, so that Java walks them without a stack frame for each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, with the characters that decide where one can begin.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Characters of an IBAN by country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{'|'.join(c for c in IBAN_SIZES if IBAN_SIZES[c] == n)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_SIZES.values()))) + r")(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|carte|tarjeta|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "local_phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|insurance)\b",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "ssn")
#: Characters before a match, and after it, in which context words count.
NEARBY = 40
BLOCK = 64


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right doubled, less 9 above 9; the sum is a multiple of 10."""
    back = F.reverse(number)
    odd, even = (F.split(F.regexp_replace(back, p, "$1"), "") for p in ("(.).?", ".(.?)"))
    plain = F.aggregate(odd, F.lit(0), lambda s, d: s + F.when(d == "", 0).otherwise(d.cast("int")))
    doubled = F.aggregate(even, F.lit(0), lambda s, d: s + F.when(d == "", 0).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return (plain + doubled) % 10 == 0


def mod97(iban: Column) -> Column:
    """The first four characters moved to the end and letters read as 10 to 35, the number modulo 97 is 1."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def valid(kind: str, found: Column) -> Column:
    size = F.length(digits(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.nullif(F.substring(F.ltrim(p, F.lit("0")), 1, 3), F.lit("")), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return size.between(16, 19) & luhn(digits(found))
    if kind == "phone":
        return size.between(8, 15)
    if kind == "iban":
        return mod97(found)
    if kind == "ssn":
        return ~F.substring(found, 1, 3).isin("000", "666") & ~found.startswith("9") & (F.substring(found, 5, 2) != "00") & (F.substring(found, 8, 4) != "0000")
    return F.lit(True)


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "local_phone": LOCAL_PHONE, "ssn": SSN}
#: What a confirmed match scores before its context does; a match of ADDED counts from KEEP on.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "local_phone": 0.3, "ssn": 0.3}
BOOST, KEEP = 0.35, 0.5


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, for a lambda computes what it names from outside at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nearby(parts: Column, i: Column) -> Column:
    """The NEARBY characters before and after match i, whatever other matches lie there.

    A match has two characters or more, so NEARBY / 2 neighbours reach far enough.
    """
    reach = NEARBY // 2
    joined = lambda low, high, piece: F.when(low <= high, F.array_join(F.transform(F.sequence(low, F.greatest(low, high)), lambda j: piece(F.get(parts, j))), "")).otherwise(F.lit(""))
    before = joined(F.greatest(i - reach, F.lit(0)), i - 1, lambda p: F.concat(F.right(p["gap"], F.lit(NEARBY)), p["hit"]))
    own = F.right(F.get(parts, i)["gap"], F.lit(NEARBY))
    after = joined(i + 1, F.least(i + reach, F.size(parts) - 1), lambda p: F.concat(F.left(p["gap"], F.lit(NEARBY)), F.coalesce(p["hit"], F.lit(""))))
    return F.concat(F.right(F.concat(before, own), F.lit(NEARBY)), F.lit("\n"), F.left(after, F.lit(NEARBY)))


def matches(text: Column, kind: str) -> Column:
    """Structs (kind, start, end, score) of the confirmed matches in a text, by start; offsets count code points.

    The positions before each block of BLOCK matches are summed first, so many matches in one text stay cheap; context
    is looked at for valid matches alone.
    """
    pattern = PATTERNS[kind]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind_of = "array<struct<kind:string,start:int,end:int,score:double>>"

    def over_parts(parts: Column) -> Column:
        steps = F.transform(parts, lambda p, i: F.struct(F.length(p["gap"]).alias("gap"), F.coalesce(F.length(p["hit"]), F.lit(0)).alias("size"), p["hit"].alias("hit"), i.alias("i")))
        blocks = bind(steps, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(BLOCK)), lambda i: F.slice(s, i + 1, BLOCK)))

        def within(state: Column, p: Column) -> Column:
            start = state["at"] + p["gap"]
            end = start + p["size"]
            scored = F.lit(SCORE[kind]) + F.when(nearby(parts, p["i"]).rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
            row = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.least(scored, F.lit(1.0)).alias("score")))
            good = p["hit"].isNotNull() & valid(kind, p["hit"]) & ((scored >= KEEP) if kind in ADDED else F.lit(True))
            return F.struct(end.alias("at"), F.when(good, F.concat(state["rows"], row)).otherwise(state["rows"]).alias("rows"))

        def over(state: Column, block: Column) -> Column:
            done = F.aggregate(block, F.struct(state["at"].alias("at"), F.array().cast(kind_of).alias("rows")), within)
            return F.struct(done["at"].alias("at"), F.concat(state["blocks"], F.array(done["rows"])).alias("blocks"))

        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_of}>").alias("blocks")), over)["blocks"])

    return bind(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), over_parts)


#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]"), "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), "local_phone": lambda t: t.rlike("[0-9]{3}"), "ssn": lambda t: t.rlike("[0-9]{3}-[0-9]{2}-")}


def find(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """All columns and an array of structs (kind, start, end, score, base) by kind, as listed, then start.

    base marks the four base kinds; the others are added spans, kept if context lifts their score to KEEP. Kinds are
    looked for apart: one place may stand under several, the base kind first. A null text has no spans; a column
    named as spans is replaced. The work is one projection: no shuffle, no Python, and each row for itself.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    each = {k: F.when(NEEDS[k](t), matches(t, k)).otherwise(none) for k in (*BASE, *ADDED)}
    with_base = lambda c, b: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), F.lit(b).alias("base")))
    return docs.withColumn(spans, F.concat(*[with_base(each[k], k in BASE) for k in each]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The frame with every span in text replaced by its kind in angle brackets; a null text stays null.

    Where spans overlap the earliest, then the longest, gives the replacement, and what the others add to it goes too.
    """
    held = "__spans"
    found = find(docs, text, held)
    ordered = F.array_sort(F.transform(F.col(held), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    blocks = bind(ordered, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(s, i + 1, BLOCK)))

    def cut(state: Column, s: Column) -> Column:  # at: where rest begins
        end = -s["back"]
        gap = F.greatest(s["start"] - state["at"], F.lit(0))
        piece = F.concat(F.left(state["rest"], gap), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        further = F.greatest(end - state["at"], F.lit(0))
        parts = F.when(s["start"] >= state["at"], F.concat(state["parts"], F.array(piece))).otherwise(state["parts"])
        return F.struct((state["at"] + further).alias("at"), F.when(further > 0, F.substr(state["rest"], further + 1, F.lit(1 << 30))).otherwise(state["rest"]).alias("rest"), parts.alias("parts"))

    def over(state: Column, block: Column) -> Column:
        """A block's own stretch of text first, so that its spans don't each walk through all that is left."""
        reach = F.greatest(F.array_max(F.transform(block, lambda s: -s["back"])) - state["at"], F.lit(0))
        none = F.array().cast("array<string>")
        done = F.aggregate(block, F.struct(state["at"].alias("at"), F.left(state["rest"], reach).alias("rest"), none.alias("parts")), cut)
        return F.struct((state["at"] + reach).alias("at"), F.substr(state["rest"], reach + 1, F.lit(1 << 30)).alias("rest"), F.concat(state["parts"], F.array(F.array_join(done["parts"], ""))).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.col(text).alias("rest"), F.array().cast("array<string>").alias("parts"))
    clean = bind(F.aggregate(blocks, start, over), lambda d: F.concat(F.array_join(d["parts"], ""), d["rest"]))
    return found.withColumn(text, F.when(F.size(held) > 0, clean).otherwise(F.col(text))).drop(held)
