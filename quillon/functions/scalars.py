"""Scalar functions on strings, numbers and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the two truth values.
TRUE_WORDS = ("true", "1", "t", "y", "yes", "Y", "Yes", "YES")
FALSE_WORDS = ("false", "0", "f", "n", "N", "No", "no", "NO")
_INT, _FLOAT = r"^\s*[+-]?\d+(_\d+)*\s*$", r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def split_ids(q: Column) -> Column:
    """Ids separated by white space, ``|``, ``,`` or ``+``; a quoted phrase is one id.

    An opening quote without a closing one is an error.
    """
    pieces = F.regexp_extract_all(q, F.lit(r"\"[^\"]*\"|'[^']*'|[^\s|,+\"']+|[\"']"), F.lit(0))
    ids = F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, r"^([\"'])(.*)\1$", "$2")))
    bad = F.exists(pieces, lambda x: x.isin("'", '"'))
    return F.when(bad, F.raise_error(F.lit("No closing quotation"))).otherwise(F.filter(ids, lambda x: x != ""))


def substring_between(s: Column, start: str = "", end: str = "", include: bool = False) -> Column:
    """What stands between two markers; empty if either is absent."""
    at = F.instr(s, start) if start else F.lit(1)
    rest = F.substring(s, at + len(start), F.length(s))
    stop = F.instr(rest, end) if end else F.length(rest) + 1
    inner = F.substring(rest, F.lit(1), stop - 1)
    whole = F.concat(F.lit(start), inner, F.lit(end)) if include else inner
    return F.when((at == 0) | (stop == 0), F.lit("")).otherwise(whole)


def to_int(s: Column) -> Column:
    """The integer that the string spells, else null; see ``unconverted``."""
    return F.when(s.rlike(_INT), F.regexp_replace(F.trim(s), "_", "").try_cast("bigint"))


def to_float(s: Column) -> Column:
    return F.when(s.rlike(_FLOAT), F.trim(s).try_cast("double"))


def to_number(s: Column) -> Column:
    """Integer if it is one, else float, both as double; null if neither."""
    return F.coalesce(to_int(s).cast("double"), to_float(s))


def unconverted(s: Column, converted: Column) -> Column:
    """The original string where conversion failed: conversions keep what they cannot read."""
    return F.when(converted.isNull(), s)


def to_boolean(s: Column, true_words=TRUE_WORDS, false_words=FALSE_WORDS) -> Column:
    return F.when(s.isin(*true_words), True).when(s.isin(*false_words), False)


def truthy(x: Column) -> Column:
    """Truth of a number: not zero; null is false."""
    return F.coalesce(x != 0, F.lit(False))


def option_to_bool(s: Column) -> Column:
    """A request option: a number is true above zero, else a few words are."""
    return F.coalesce(to_float(s) > 0, F.lower(s).isin("1", "true", "yes", "y", "t"))


def option_to_int(s: Column, strict: bool = False) -> Column:
    return to_int(s) if strict else F.coalesce(to_int(s), to_float(s).try_cast("bigint"))


def is_int(s: Column) -> Column:
    return to_int(s).isNotNull()


def id_strip(s: Column) -> Column:
    return F.transform(F.split(s, r"\|"), lambda x: F.trim(x))


def list_split(s: Column, sep: str) -> Column:
    """The parts of a field that holds the separator, else the field alone."""
    quoted = "\\Q" + sep + "\\E"
    bare = F.regexp_replace(F.rtrim(s), f"({quoted})+$", "")
    return F.when(F.contains(s, F.lit(sep)), F.split(bare, quoted)).otherwise(F.array(s))


def newer(a: Column, b: Column, fmt: str = "yyyyMMdd") -> Column:
    """Whether date a is before date b."""
    return F.to_date(a, fmt) < F.to_date(b, fmt)


def size_text(n: Column, suffix: str = "B") -> Column:
    """Bytes with a binary unit and one decimal."""
    out, units = None, ("", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi")
    for i, unit in reversed(list(enumerate(units))):
        text = F.format_string(f"%.1f{unit}{suffix}", n.cast("double") / 1024.0**i)
        out = text if out is None else F.when(F.abs(n) < 1024.0 ** (i + 1), text).otherwise(out)
    return out


def iso_utc(ts: Column) -> Column:
    """ISO time; a time without a zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.when(s >= 3600, F.format_string("%dh:%dm:%ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).when(s >= 60, F.format_string("%dm:%ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def glob_to_regex(pattern: str) -> str:
    """``*``, ``?`` and ``[...]`` as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and ord(c) < 128 and c not in " _" else c
        i += 1
    return f"^{out}$"


def matches_glob(value: Column, pattern: str) -> Column:
    """Case-sensitive wildcard match of a value's text; null never matches."""
    return F.coalesce(value.cast("string").rlike(glob_to_regex(pattern)), F.lit(False))


def number_text(n: Column, sign: bool = False) -> Column:
    """Thousands with commas, a sign if asked for, N.A for null."""
    text = F.format_number(F.abs(n) if sign else n, 0)
    signed = F.concat(F.when(n < 0, "-").otherwise("+"), text) if sign else text
    return F.coalesce(signed, F.lit("N.A"))


def digest(content: Column) -> Column:
    """The MD5 of a text or of bytes, as hexadecimal digits."""
    return F.md5(content)
