"""Text scalars as native column expressions. Null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode spaces and zero-width characters, null tokens, non-names, reserved device names.
SPACES = "\\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000\\uFEFF\\u200B-\\u200D"
WHITE = " \\t\\n\\x0B\\f\\r\\u2028\\u2029"
NULL_TOKENS = ("", "-", "--", "---", "na", "n/a", "n.a.", "n.a", "nil", "none", "null", "nan", "#n/a", "#value!", "#ref!", "#div/0!", "tbd", "not applicable", "not available")
NO_PLACES = ("na", "n a", "nil", "none", "null", "nan", "tbd", "unknown")
PLACE_PUNCTUATION = ".,;:'’`\"“”()\\[\\]{}\\\\/|!?*#_\\-"
DEVICES = "con|prn|aux|nul|com[1-9]|lpt[1-9]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _squeeze(c: Column) -> Column:
    c = F.regexp_replace(c, f"[{WHITE}]{{2,}}", " ")
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def _is_clean(c: Column) -> Column:
    """Whether a text stays as it is: printable ASCII without spaces at its ends or in runs, not empty. One match, where cleaning takes four."""
    return F.regexp_like(c, F.lit("\\A[!-~](?:[ -~]*+(?<! ))?+\\z")) & ~F.contains(c, F.lit("  "))


def _cleaned(c: Column, keep: Callable[[Column], Column]) -> Column:
    """A text cleaned and kept where ``keep`` says so, else null. The cleaned text is bound once: an expression that repeats it grows past what the JVM compiles."""
    x = F.regexp_replace(F.regexp_replace(c, f"[{SPACES}]", " "), "[\\r\\n\\t]+", " ")
    return F.when(_is_clean(c), F.when(keep(c), c)).otherwise(F.get(F.transform(F.array(_squeeze(x)), lambda y: F.when(keep(y), y)), F.lit(0)))


def clean_string(s: Column | str) -> Column:
    """Unicode spaces and line breaks to spaces, runs collapsed, trimmed; empty gives null."""
    return _cleaned(_c(s).cast("string"), lambda c: c != "")


def has_text(s: Column | str) -> Column:
    """Whether ``clean_string`` gives a text, in one match."""
    return F.coalesce(F.regexp_like(_c(s), F.lit(f"[^{SPACES}{WHITE}]")), F.lit(False))


def header_key(s: Column | str) -> Column:
    """A header's key: cleaned, lower case, punctuation stripped from the end and (except a slash) the start."""
    c = F.regexp_replace(F.lower(clean_string(s)), f"[{WHITE}:;,.\\-_/|*#]+$", "")
    return F.nullif(F.regexp_replace(c, f"^[{WHITE}:;,.\\-_|*#]+", ""), F.lit(""))


def positional_key(i: Column | str) -> Column:
    return F.concat(F.lit("__col_"), _c(i).cast("string"))


def suffix_key(key: Column | str, n: Column | str) -> Column:
    return F.concat(_c(key), F.lit("__"), _c(n).cast("string"))


def is_null_token(s: Column | str) -> Column:
    c, heads = _c(s), sorted({h for t in NULL_TOKENS for h in (t[:1], t[:1].upper())})
    return F.substring(c, 1, 1).isin(*heads) & F.lower(c).isin(*NULL_TOKENS)  # few texts begin as a token does


def clean_cell(s: Column | str) -> Column:
    """A cleaned text cell; null tokens give null."""
    return _cleaned(_c(s).cast("string"), lambda c: ~is_null_token(c))


def clean_number(n: Column | str) -> Column:
    """A numeric cell; not-a-number and infinities give null."""
    c = _c(n).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def place_key(s: Column | str) -> Column:
    """A place name's key: ampersand spelt out, punctuation removed, collapsed, lower case. May be empty."""
    c = F.regexp_replace(F.regexp_replace(_c(s), f"[{SPACES}]", " "), "[\\r\\n\\t]+", " ")
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), f"[{PLACE_PUNCTUATION}]", "")
    return F.lower(_squeeze(c))


def is_place_name(s: Column | str) -> Column:
    k = place_key(s)
    return F.coalesce((k != "") & ~k.isin(*NO_PLACES), F.lit(False))


def filename_stem(s: Column | str) -> Column:
    """Base name after the last slash, without .kmz or .kml."""
    return F.regexp_replace(F.element_at(F.split(_c(s), "/"), -1), "(?i)\\.(kmz|kml)$", "")


def match_key(s: Column | str) -> Column:
    """What file and site names are matched by."""
    return F.coalesce(header_key(s), F.lit(""))


def contains_phrase(hay: Column | str, needle: Column | str) -> Column:
    """Whether the needle stands in the hay between word boundaries; an empty needle never does."""
    n = _c(needle)
    escaped = F.regexp_replace(n, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    return F.coalesce((n != "") & F.regexp_like(_c(hay), F.concat(F.lit("\\b"), escaped, F.lit("\\b"))), F.lit(False))


def site_key(state: Column | str, district: Column | str, site: Column | str) -> Column:
    """state|district|site by their keys, empty parts kept; null without a site."""
    part = lambda x: F.coalesce(header_key(x), F.lit(""))
    return F.when(header_key(site).isNotNull(), F.concat_ws("|", part(state), part(district), part(site)))


def site_label(site: Column | str, source_row: Column | str) -> Column:
    return F.coalesce(clean_string(site), F.concat(F.lit("Row "), _c(source_row).cast("string")))


def safe_filename(s: Column | str) -> Column:
    """A label as a file name on any system, of 120 characters at most."""
    c = F.regexp_replace(_c(s), '[<>:"/\\\\|?*\\x00-\\x1F]', " ")
    c = F.regexp_replace(F.trim(F.regexp_replace(c, "\\s+", " ")), "[. ]+$", "")
    c = F.when(c == "", "boundary").when(F.regexp_like(c, F.lit(f"(?i)^({DEVICES})$")), F.concat(c, F.lit("_"))).otherwise(c)
    return F.substring(c, 1, 120)


def file_ext(s: Column | str) -> Column:
    return F.when(F.lower(_c(s)).endswith(".kml"), ".kml").otherwise(".kmz")


def content_hash(b: Column | str) -> Column:
    return F.sha2(_c(b).cast("binary"), 256)
