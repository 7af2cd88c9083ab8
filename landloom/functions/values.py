"""Numbers: parsing dirty text, types, tolerance and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landloom.functions.text import _c, clean_string, is_null_token

# Unit words that stand beside a number, currency symbols, tolerances and conversion factors.
UNIT_WORDS = ("square metres", "square meters", "square feet", "hectares", "hectare", "sq. ft.", "sq ft", "sq.m.", "sq m", "acres", "acre", "guntha", "cents", "cent", "rs.", "rs", "inr", "ha", "ac")
CURRENCIES = "₹$€£¥"
AREA_EPSILON, RELATIVE_EPSILON = 0.005, 1e-9
PER_ACRE = {"hectare": 0.40468564224, "square_metre": 4046.8564224, "square_foot": 43560.0, "square_yard": 4840.0, "guntha": 40.0, "cent": 100.0, "square_kilometre": 1 / 247.10538146716533}
REGIONAL_UNITS = ("bigha", "katha", "biswa")

_PLAIN = "[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?"
_SHAPE = f"^{_PLAIN}$"
_DATE = "^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?$"
#: Characters that a figure and what may stand beside it consist of; a text with another one, or without a digit, holds no figure.
_MAYBE = f"(?i)^[0-9eE+\\-.,()% \\r\\n\\u0085\\u2028\\u2029{CURRENCIES}{''.join(sorted({c for w in UNIT_WORDS for c in w if c.isalpha()}))}]++\\z"
#: Stands at the begin of a figure that was in brackets; taken out of the text before.
_MARK = "\x01"


def _words() -> str:
    return "|".join(w.replace(".", "\\.") for w in sorted(UNIT_WORDS, key=len, reverse=True))


def _cleaned(s: Column | str, cleaned: bool) -> Column:
    return _c(s) if cleaned else clean_string(s)


def shaped_number(s: Column) -> Column:
    """A double if the text has the plain shape of a finite number."""
    n = F.regexp_extract(s, f"^({_PLAIN})$", 1).try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def parse_measure(s: Column | str, cleaned: bool = False) -> Column:
    """A figure from text: brackets negate; currency, grouping commas, one per cent sign and one unit word an end are dropped.

    ``cleaned``: the text has been through ``clean_string``. Each step reads the one before it once, so the expression stays small.
    """
    if not cleaned:  # the cleaned text is bound once
        return F.get(F.transform(F.array(clean_string(s)), lambda c: parse_measure(c, cleaned=True)), F.lit(0))
    own = _c(s)
    c = F.translate(F.lower(F.when(~is_null_token(own), own)), _MARK, "?")
    x = F.regexp_replace(c, "^\\( *(.*?) *\\)$", _MARK + "$1")
    x = F.regexp_replace(F.regexp_replace(x, f"[{CURRENCIES}]", ""), "(?<=\\d),(?=\\d)", "")
    x = F.regexp_replace(x, f"^({_MARK}?) *(.*?) *%$", "$1$2")
    x = F.regexp_replace(x, f"^({_MARK}?)(?:{_words()})?", "$1")
    x = F.regexp_replace(x, f"^({_MARK}?) *(.*?) *$", "$1$2")
    x = F.regexp_replace(x, f" *(?:{_words()}) *$", "")
    n = F.regexp_extract(x, f"^{_MARK}?({_PLAIN})$", 1).try_cast("double")
    n = n * F.when(F.regexp_like(c, F.lit("^\\(.*\\)$")), -1.0).otherwise(1.0)
    plain = F.regexp_like(own, F.lit(_SHAPE))  # nothing stands beside the figure: one cast
    x = F.when(plain, own.try_cast("double")).when(F.regexp_like(own, F.lit(_MAYBE)) & F.regexp_like(own, F.lit("[0-9]")), n)
    return F.get(F.filter(F.array(x), lambda y: F.abs(y) < float("inf")), F.lit(0))


def cell_type(s: Column | str, cleaned: bool = False) -> Column:
    """Type of a text cell: number, boolean, date (ISO) or string; null for none."""
    c = _cleaned(s, cleaned)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.regexp_like(c, F.lit(_SHAPE)), "number")
        .when(F.lower(c).isin("true", "false"), "boolean")
        .when(F.regexp_like(c, F.lit(_DATE)), "date")
        .otherwise("string")
    )


def distinct_key(s: Column | str, cleaned: bool = False, kind: Column | str | None = None) -> Column:
    """A cell tagged by its type (``kind``, if that is known), so that the number 1 and the text 1 differ."""
    c = _cleaned(s, cleaned)
    t = cell_type(c, cleaned=True) if kind is None else _c(kind)
    return F.when(t == "number", F.concat(F.lit("n:"), shaped_number(c).cast("string"))).when(t == "boolean", F.concat(F.lit("b:"), F.lower(c))).when(t == "date", F.concat(F.lit("d:"), c)).when(t.isNotNull(), F.concat(F.lit("s:"), c))


def area_equals(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & ~F.isnan(a) & ~F.isnan(b)
    near = F.abs(a - b) <= F.greatest(F.lit(AREA_EPSILON), F.lit(RELATIVE_EPSILON) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(finite & near, F.lit(False))


def from_acres(acres: Column | str, unit: str) -> Column:
    if unit in REGIONAL_UNITS:
        raise ValueError(f"{unit} differs from region to region")
    return _c(acres) * F.lit(PER_ACRE[unit])


def to_acres(area: Column | str, unit: str) -> Column:
    if unit in REGIONAL_UNITS:
        raise ValueError(f"{unit} differs from region to region")
    return _c(area) / F.lit(PER_ACRE[unit])


def bin_index(value: Column | str, edges: Column | str) -> Column:
    """Class of a value among ascending edges [e0, ..., ek]: half open, the last closed; -1 outside or without a finite value."""
    v, e = _c(value), _c(edges)
    inside = (F.size(e) > 1) & (v >= F.element_at(e, 1)) & (v <= F.element_at(e, -1)) & ~F.isnan(v)
    at = F.size(F.filter(e, lambda x: v >= x)) - 1
    return F.when(F.coalesce(inside, F.lit(False)), F.least(at, F.size(e) - 2)).otherwise(F.lit(-1))
