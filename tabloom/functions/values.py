"""Typed values from text and text from typed values, as native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, ustrip

TRUE, FALSE = ("true", "yes", "1", "y", "t"), ("false", "no", "0", "n", "f")
#: How dates are read, in this order, as (shape, pattern).
DATE_INPUTS = (
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "yyyy-M-d H:m:s"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z?", "yyyy-M-d'T'H:m:s['Z']"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}", "yyyy-M-d H:m"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}", "yyyy-M-d'T'H:m"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"\d{4}-\d{1,2}", "yyyy-M"), (r"\d{4}", "yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}", "d/M/yyyy H:m:s"), (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}", "d/M/yyyy H:m"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}", "M/d/yyyy H:m:s"), (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}", "M/d/yyyy H:m"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"), (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
)
DATE_TOKENS = (("YYYY", "yyyy"), ("DD", "dd"), ("A", "a"), ("T", "'T'"), ("Z", "'Z'"))


@dataclass(frozen=True)
class NumberFormat:
    """What a pattern such as `#,###.##`, `#.###,##`, `+#`, `(#)` or `#%` says."""

    thousands: str
    decimal: str
    places: int
    sign: bool
    percent: bool
    parens: bool

    @classmethod
    def of(cls, pattern: str | None) -> NumberFormat:
        pattern = pattern or "#,###.##"
        core = pattern.strip("+(%)")
        marks = [c for c in core if c in ",."]
        tail = len(core) - 1 - max(core.rfind(","), core.rfind(".")) if marks else 0
        if len(set(marks)) == 2:
            decimal = marks[-1]
            thousands = "," if decimal == "." else "."
        elif marks:
            thousands, decimal = ("", marks[-1]) if tail <= 2 else (marks[-1], "")
        else:
            thousands, decimal = "", ""
        return cls(thousands, decimal, tail if decimal else 0, pattern.startswith("+"), pattern.endswith("%"), pattern.startswith("(") and pattern.endswith(")"))


def coerce_number(x: Column | str, kind: str = "float", pattern: str | None = None) -> Column:
    """long (truncated) or double from text with currency, percent, separators or parentheses; else null."""
    f = NumberFormat.of(pattern) if pattern and any(c in pattern for c in ",.") else NumberFormat(",", ".", 2, False, False, False)
    s = F.regexp_replace(F.regexp_replace(ustrip(x), r"(?U)[\s$€£¥]", ""), "%+$", "")
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    if f.thousands:
        s = F.translate(s, f.thousands, "")
    if f.decimal == ",":
        s = F.translate(s, ",", ".")
    number = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s).try_cast("double")
    return number if kind == "float" else F.when(F.abs(number) < 9.2e18, number).cast("long")


def coerce_bool(x: Column | str) -> Column:
    s = F.lower(ustrip(x))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def coerce_text(x: Column | str) -> Column:
    return F.nullif(ustrip(x), F.lit(""))


def coerce(x: Column | str, kind: str, pattern: str | None = None) -> Column:
    return coerce_number(x, kind, pattern) if kind in ("int", "float") else coerce_bool(x) if kind == "bool" else coerce_text(x)


def format_number(x: Column | str, pattern: str) -> Column:
    """Text of a number by a pattern; decimals are rounded half-even, as binary fractions print; nan, inf and -inf for what isn't finite."""
    f = NumberFormat.of(pattern)
    size = F.abs(col(x))
    if f.places:
        digits = F.format_string(f"%.{f.places}f", F.bround(size.cast("decimal(38,10)"), f.places).cast("double"))
    else:
        digits = F.bround(size.cast("decimal(38,10)"), 0).cast("decimal(38,0)").cast("string")
    whole, part = F.substring_index(digits, ".", 1), F.substring_index(digits, ".", -1)
    if f.thousands:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", f.thousands)
    out = F.concat(whole, F.lit(f.decimal), part) if f.places else whole
    less = F.concat(F.lit("("), out, F.lit(")")) if f.parens else F.concat(F.lit("-"), out)
    out = F.when(col(x) < 0, less).otherwise(F.concat(F.lit("+"), out) if f.sign else out)
    out = F.concat(out, F.lit("%")) if f.percent else out
    # what is no finite number prints as such, in one spelling
    x = col(x).cast("double")
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(out)


def parse_date(x: Column | str) -> Column:
    """A timestamp by the first input shape that fits, day before month; null if none does."""
    s = ustrip(x)
    return F.coalesce(*[F.when(s.rlike(f"^{shape}$"), F.try_to_timestamp(s, F.lit(p))) for shape, p in DATE_INPUTS])


def format_date(x: Column | str, pattern: str) -> Column:
    """Reformatted if it reads as a date, else as it was (trimmed); null for an empty text."""
    for a, b in DATE_TOKENS:
        pattern = pattern.replace(a, b)
    return F.coalesce(F.date_format(parse_date(x), pattern), coerce_text(x))


def title_case(x: Column | str) -> Column:
    """Every run of letters begins with a capital."""
    runs = F.regexp_extract_all(col(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def case_words(x: Column | str) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(col(x), "[-_]", " "), "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, r"(?U)\s+"), lambda w: w != "")


def format_text(x: Column | str, mode: str) -> Column:
    """One of the eleven case modes; others leave the text as it is."""
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    words = case_words(x)
    joined = {"snake_case": ("_", F.lower), "SCREAMING_SNAKE_CASE": ("_", F.upper), "kebab-case": ("-", F.lower), "SCREAMING-KEBAB-CASE": ("-", F.upper), "PascalCase": ("", cap)}
    if mode in joined:
        sep, f = joined[mode]
        return F.array_join(F.transform(words, f), sep)
    if mode == "camelCase":
        rest = F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), cap), "")
        return F.when(F.size(words) == 0, col(x)).otherwise(F.concat(F.lower(F.get(words, F.lit(0))), rest))
    plain = {"uppercase": F.upper, "lowercase": F.lower, "titlecase": title_case, "capitalize": cap, "trim": ustrip}
    return plain[mode](col(x)) if mode in plain else col(x)
