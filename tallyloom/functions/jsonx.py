"""JSON and model-output text (JS1 to JS9).

Strict parsers are read two ways: a pattern that only well-formed text of the usual shape matches says which rows
from_json reads, as it then reads them as Python would; the others, which it would be too lenient with, go to Python in an
Arrow UDF, which gets nulls in the place of the rest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.schemas import SCORES
from tallyloom.workers import ship

PARSED = "struct<aspects:array<struct<term:string,category:string,polarity:string>>,parse_success:boolean>"
SCORED = f"struct<{','.join(f'{s}:int' for s in SCORES)},explanation:string>"
#: Patterns of aspects in text that is not JSON.
FULL_ASPECT = r'"term":\s*"([^"]+)".*?"category":\s*"([^"]+)".*?"polarity":\s*"([^"]+)"'
PLAIN_ASPECT = r"""term["']?\s*[:=]\s*["']?([^"']+)["']?.*?polarity["']?\s*[:=]\s*["']?(positive|negative|neutral)"""


def quoted(c: Column) -> Column:
    """A string as JSON text, with control characters as Python writes them."""
    text = F.to_json(F.array(c))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def aspects_json(aspects: Column, indent: int = 4) -> Column:
    """{"aspects": [...]} as Python's json.dumps lays it out; null fields are left out."""
    pad = [" " * indent * k for k in (1, 2, 3)]
    field = lambda a, k: F.when(a[k].isNotNull(), F.concat(F.lit(f'{pad[2]}"{k}": '), quoted(a[k])))
    one = lambda a: F.concat(F.lit(pad[1] + "{\n"), F.concat_ws(",\n", *[field(a, k) for k in ("term", "category", "polarity")]), F.lit(f"\n{pad[1]}}}"))
    body = F.concat(F.lit(f'{{\n{pad[0]}"aspects": [\n'), F.array_join(F.transform(aspects, one), ",\n"), F.lit(f"\n{pad[0]}]\n}}"))
    return F.when(F.coalesce(F.size(aspects), F.lit(0)) > 0, body).otherwise(F.lit(f'{{\n{pad[0]}"aspects": []\n}}'))


def as_text(value) -> str | None:
    """A string, or what is written of another value; half a surrogate pair, which no column holds, becomes U+FFFD."""
    text = value if value is None or isinstance(value, str) else str(value)
    return text if text is None or text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def aspect_rows(value) -> list[dict]:
    """Aspects of parsed JSON: other than objects are left out, other than strings written as text."""
    return [{k: as_text(a.get(k)) for k in ("term", "category", "polarity")} for a in value if isinstance(a, dict)] if isinstance(value, list) else []


def loose_aspects(text: str) -> list[dict]:
    """What both patterns find, the second after the first, so an aspect may come twice."""
    full = re.findall(FULL_ASPECT, text, re.IGNORECASE | re.DOTALL)
    plain = re.findall(PLAIN_ASPECT, text, re.IGNORECASE | re.DOTALL)
    rows = [{"term": t.strip(), "category": c.strip(), "polarity": p.strip().lower()} for t, c, p in full]
    return rows + [{"term": t.strip(), "category": None, "polarity": p.strip().lower()} for t, p in plain]


def read_output(text: str | None) -> dict:
    """JSON between the first and last brace if it parses, whatever it holds; else what loose_aspects finds."""
    clean = (text or "").strip().replace("<|im_end|>", "").strip()
    a, b = clean.find("{"), clean.rfind("}")
    if 0 <= a < b:
        try:
            held = json.loads(clean[a : b + 1])
            return {"aspects": aspect_rows(held.get("aspects")), "parse_success": True}
        except (ValueError, RecursionError):
            pass
    rows = loose_aspects(clean)
    return {"aspects": rows, "parse_success": bool(rows)}


def whole_scores(text: str) -> dict | None:
    """Scores of a JSON object that has them all, cut to 1 to 5; None if it isn't one or a score is no number."""
    try:
        held = json.loads(text)
        if not isinstance(held, dict) or any(k not in held for k in SCORES):
            return None
        return {k: min(5, max(1, int(held[k]))) for k in SCORES} | {"explanation": as_text(held.get("explanation"))}
    except (ValueError, TypeError, OverflowError, RecursionError):
        return None


#: The fence around JSON, the flat object in prose, a digit after a key, the explanation.
FENCE, FLAT = (r"^```(?:json)?\s*", r"\s*```$"), r"\{[^{}]*\}"
KEY, SAID = r'"{}"\s*:\s*(\d)', r'"explanation"\s*:\s*"([^"]*)"'


def read_judgement(text: str | None) -> dict | None:
    """The whole text without its fence, else the first flat object, else a digit after each key; None without them."""
    clean = re.sub(FENCE[1], "", re.sub(FENCE[0], "", (text or "").strip()))
    flat = re.search(FLAT, clean)
    found = whole_scores(clean) or (whole_scores(flat[0]) if flat else None)
    if found:
        return found
    hits = {k: re.search(KEY.format(k), clean, re.IGNORECASE) for k in SCORES}
    if not all(hits.values()):
        return None
    said = re.search(SAID, clean)
    return {k: min(5, max(1, int(m[1]))) for k, m in hits.items()} | {"explanation": said[1] if said else ""}


def read_gold(text: str | None) -> dict:
    """JSON between the first and last brace, strictly: its aspects, or none."""
    a, b = (text or "").find("{"), (text or "").rfind("}")
    try:
        held = json.loads(text[a : b + 1]) if 0 <= a < b else {}
        return {"aspects": aspect_rows(held.get("aspects")), "parse_success": bool(held)}
    except (ValueError, RecursionError):
        return {"aspects": [], "parse_success": False}


def read_aspects(text: str | None) -> dict:
    """Aspects that a JSON list spells out, strictly; none where the text is no JSON."""
    try:
        return {"aspects": aspect_rows(json.loads(text or ""))}
    except (ValueError, RecursionError):
        return {"aspects": []}


def vectorised(f: Callable, kind: str, fields: tuple[str, ...]) -> Callable[[Column], Column]:
    """f, which gives a dict or None, over a column in Arrow batches; a null gives nulls."""

    def apply(c: Column) -> Column:
        ship(SparkSession.active())

        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.DataFrame:
            rows = [(f(t) or {}) if isinstance(t, str) else {} for t in texts]
            return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in fields})

        return run(c)

    return apply


#: JSON's white space, and a string whose escapes Java and Python read alike: no surrogates, no control characters.
GAP = r"[ \t\n\r]*+"
PLAIN = r'[^"\\\x00-\x1f]*+'
STRING = rf'"{PLAIN}(?:\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{{4}}){PLAIN})*+"'


def listed(one: str) -> str:
    """A pattern of one or more, with commas."""
    return f"{one}(?:{GAP},{GAP}{one})*+"


def held_as(pairs: str) -> str:
    """A pattern of an object of some pairs."""
    return rf"\{{{GAP}{listed(f'(?:{pairs})')}{GAP}\}}"


ASPECT_FIELD = rf'"(?:term|category|polarity)"{GAP}:{GAP}(?:{STRING}|null)'
#: Objects with aspects alone, of known keys whose values are strings or null.
ASPECTS_TEXT = rf'^\{{{GAP}"aspects"{GAP}:{GAP}\[{GAP}(?:{listed(held_as(ASPECT_FIELD))}{GAP})?\]{GAP}\}}$'
LIST_TEXT = rf"^{GAP}\[{GAP}(?:{listed(held_as(ASPECT_FIELD))}{GAP})?\]{GAP}$"
SCORE_FIELD = rf'"(?:{"|".join(SCORES)})"{GAP}:{GAP}[1-5]|"explanation"{GAP}:{GAP}(?:{STRING}|null)'
SCORES_TEXT = rf"^(?:```(?:json)?\s*+)?+({held_as(SCORE_FIELD)})(?:\s*+```)?+$"
ASPECT_ROWS = "array<struct<term:string,category:string,polarity:string>>"


def in_braces(c: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def two_ways(c: Column, usual: Column, native: Column, strict: Callable[[Column], Column], none: Column) -> Column:
    """native where usual says so, none for nulls, strict for the others alone."""
    usual = F.coalesce(usual, F.lit(False))
    return F.when(c.isNull(), none).when(usual, native).otherwise(strict(F.when(~usual, c)))


def parsed_aspects(c: Column, strict: Callable[[Column], Column]) -> Column:
    body = in_braces(c)
    found = lambda rows, done: F.struct(rows.alias("aspects"), F.lit(done).alias("parse_success"))
    native = found(F.from_json(body, f"aspects {ASPECT_ROWS}")["aspects"], True)
    return two_ways(c, body.rlike(ASPECTS_TEXT), native, strict, found(F.array().cast(ASPECT_ROWS), False))


def parse_output(c: Column) -> Column:
    """struct of aspects and parse_success, as read_output has them."""
    marked = F.replace(c, F.lit("<|im_end|>"), F.lit(""))
    return parsed_aspects(marked, strict_output)


def parse_gold(c: Column) -> Column:
    """struct of aspects and parse_success, as read_gold has them."""
    return parsed_aspects(c, strict_gold)


strict_output = vectorised(read_output, PARSED, ("aspects", "parse_success"))
strict_gold = vectorised(read_gold, PARSED, ("aspects", "parse_success"))
LISTED = f"struct<aspects:{ASPECT_ROWS}>"


def parse_aspects(c: Column) -> Column:
    """The aspects of a column that holds them as JSON text."""
    strict = lambda rest: vectorised(read_aspects, LISTED, ("aspects",))(rest)["aspects"]
    return two_ways(c, c.rlike(LIST_TEXT), F.from_json(c, ASPECT_ROWS), strict, F.array().cast(ASPECT_ROWS))


def parse_judgement(c: Column) -> Column:
    """struct of scores, null where there is no judgement; scores are cut to 1 to 5."""
    text = strip(c)
    native = F.from_json(F.regexp_extract(text, SCORES_TEXT, 1), SCORED)
    usual = text.rlike(SCORES_TEXT)
    for s in SCORES:
        usual = usual & text.contains(f'"{s}"')
    held = two_ways(c, usual, native, vectorised(read_judgement, SCORED, (*SCORES, "explanation")), F.lit(None).cast(SCORED))
    return F.when(held["overall"].isNotNull(), held)


def python_repr(aspects: Column) -> Column:
    """The text of Python's repr of {"aspects": [...]}; null fields are left out."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([repr({"aspects": [{k: v for k, v in a.items() if v is not None} for a in (r if r is not None else [])]}) for r in rows])

    return run(aspects)


def lenient_output(c: Column) -> Column:
    """The native reading of well-formed output; it also takes some text that the strict parser rejects."""
    body = F.regexp_extract(F.replace(strip(c), F.lit("<|im_end|>"), F.lit("")), r"(?s)\{.*\}", 0)
    held = F.from_json(body, f"aspects {ASPECT_ROWS}")
    return F.struct(F.coalesce(held["aspects"], F.array().cast(ASPECT_ROWS)).alias("aspects"), held.isNotNull().alias("parse_success"))


def lenient_scores(c: Column) -> Column:
    """The digit after each key, natively; null unless all keys have one."""
    got = {k: F.regexp_extract(c, f"(?i){KEY.format(k)}", 1) for k in SCORES}
    cut = {k: F.greatest(F.lit(1), F.least(F.lit(5), F.try_to_number(v, F.lit("9")).cast("int"))) for k, v in got.items()}
    full = F.lit(True)
    for v in got.values():
        full = full & (v != "")
    said = F.regexp_extract(c, SAID, 1)
    return F.when(full, F.struct(*[cut[k].alias(k) for k in SCORES], said.alias("explanation")))
