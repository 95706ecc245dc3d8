"""Text cleaning as Column expressions (no Python UDFs).

Python's ``\\s`` is Unicode-aware; Java's is not unless ``(?U)`` is given, so
the whitespace patterns carry that flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens treated as missing after whitespace collapse + lower.
NULL_LIKE_VALUES = ["", "nan", "none", "null", "na", "n/a"]

# Free-text gender -> canonical gender (default "Other").
GENDER_MAP = {
    "male": "Male",
    "m": "Male",
    "female": "Female",
    "f": "Female",
    "other": "Other",
    "non-binary": "Other",
    "non binary": "Other",
    "unknown": "Other",
    "prefer not to say": "Other",
}

# Gender codes used by the model features.
GENDER_CODES = {"Female": 0, "Male": 1, "Other": 2}

SYMPTOM_MARKS = ",;|"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    return F.trim(F.regexp_replace(_col(c).cast("string"), r"(?U)\s+", " "))


def none_of(c: Column, values: list[str]) -> Column:
    """The text, or NULL where it is one of ``values``.  It names ``c`` once: in a CASE, ``c`` would stand in the
    condition and in the branch and be computed for both, and nested ones double from level to level."""
    return F.try_element_at(F.array_except(F.array(c), F.array(*[F.lit(v) for v in values])), F.lit(1))


def normalize_text(c, lowercase: bool = False) -> Column:
    """Collapse whitespace, trim, null-like tokens -> NULL, optional lower."""
    t = collapse_ws(c)
    return none_of(F.lower(t), NULL_LIKE_VALUES) if lowercase else F.when(~F.lower(t).isin(NULL_LIKE_VALUES), t)


def non_null(*items: Column) -> Column:
    """The items that are not null, in order, equal ones once.  ``array_compact`` is a lambda, which Spark
    interprets with all expressions below it; this stays in generated code."""
    return F.array_except(F.array(*items), F.array(F.lit(None)))


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def standardize_gender(c) -> Column:
    """Canonical gender, default Other."""
    return F.coalesce(F.try_element_at(_literal_map(GENDER_MAP), normalize_text(c, True)), F.lit("Other"))


def gender_code(gender) -> Column:
    """Female 0, Male 1, else 2."""
    g = _col(gender)
    return F.when(g == "Female", 0).when(g == "Male", 1).otherwise(2).cast("int")


def _between(space: str, marks: str) -> str:
    """Pattern of what parts two texts of a list: marks with the blanks around them.  Blanks are tried
    from where their run begins only, so long runs without a mark stay linear."""
    return f"(?:(?<![{space}])[{space}]+)?[{marks}][{space}{marks}]*"


def split_bare(bare: Column, pattern: str) -> Column:
    """Split a text that neither begins nor ends with a separator; empty text: no parts."""
    return F.array_remove(F.split(bare, pattern), "")


def split_trim(text: Column, marks: str = SYMPTOM_MARKS) -> Column:
    """Split at runs of ``marks``, trim parts, drop empty parts (order kept).

    One pattern takes marks and the blanks around them together: a lambda over the
    parts is interpreted, with all expressions below it, and keeps its stage out of generated code.
    """
    return split_bare(F.btrim(text, F.lit(" " + marks)), _between(" ", marks))


def symptom_parts(c) -> Column:
    """Lower-cased, whitespace-normalised symptom parts of free text (may repeat)."""
    return split_trim(normalize_text(c, True))


def standardize_symptoms(c) -> Column:
    """Order-keeping distinct parts joined by ', '; nothing -> 'unknown'."""
    joined = F.array_join(F.array_distinct(symptom_parts(c)), ", ")
    return F.coalesce(none_of(joined, [""]), F.lit("unknown"))


def standardize_symptom_list(c) -> Column:
    """Same for an array input; every element normalised on its own."""
    arr = F.array_distinct(F.filter(F.transform(_col(c), lambda x: normalize_text(x, True)), lambda x: x.isNotNull()))
    return F.when(F.size(arr) > 0, F.array_join(arr, ", ")).otherwise(F.lit("unknown"))


def count_symptoms(standardized) -> Column:
    """Count of a standardised symptom string; 'unknown' -> 0."""
    s = _col(standardized)
    return F.when(s == "unknown", 0).otherwise(F.size(F.split(s, ", "))).cast("int")


def split_symptoms(c) -> Column:
    """standardised text -> array; null / '' / 'unknown' -> []."""
    t = none_of(F.lower(F.trim(_col(c))), ["", "unknown"])
    return F.coalesce(split_trim(t), F.array().cast("array<string>"))


def safe_name(c) -> Column:
    """lower, spaces -> _, other runs -> _, strip leading/trailing _."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), " ", "_"), "[^a-z0-9_]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def symptom_tokens(c) -> Column:
    """Q2: split on , ; | newline, collapse whitespace, lower, drop empty."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), "(?U)" + _between("\\s", ",;|\\n"), ",")
    return split_bare(F.lower(F.btrim(collapse_ws(text), F.lit(" ,"))), ",")


# The whitespace Python's str.strip() removes (Latin-1 part).
STRIP_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (Latin-1 whitespace) as a native BTRIM, no regex."""
    return F.btrim(_col(c), F.lit(STRIP_CHARS))


STRIP_CLASS = "".join(f"\\x{ord(x):02x}" for x in STRIP_CHARS)


def quick_parts(text: Column) -> Column:
    """Q1: split on , ; | newline, strip, drop empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(STRIP_CHARS + ",;|"))
    return split_bare(bare, _between(STRIP_CLASS, ",;|\\n"))


def quick_tokens(c) -> Column:
    """Q1 + lower: tokens used by the keyword scan (split, strip, lower)."""
    return quick_parts(F.lower(_col(c)))
