"""Text and JSON helpers as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fenced block, the JSON array of objects, and the cut mark.
FENCED_BLOCK = r"(?s)```[A-Za-z]*[ \t\r]*\n(.*?)```"
JSON_ARRAY = r"(?s)\[\s*\{.*?\}\s*\]"
ELLIPSIS = "…"

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# Possessive and unrolled, so that long strings need no stack.
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_JSON_TOKEN = _JSON_STRING + r'|[,:]|[^",:]++'
_NUMBER_KIND = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def strip(text: Column) -> Column:
    """Without leading and trailing white space, Unicode spaces included."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def shorten(text: Column, limit: int = 100) -> Column:
    """White space collapsed, cut to `limit` characters with an ellipsis as the last one."""
    flat = strip(F.regexp_replace(text, _SPACE, " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 1), F.lit(ELLIPSIS))
    )


def parse_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    The text is parsed as the only element of an array, which also rejects trailing characters.
    """
    elements = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    return F.when(F.size(elements) == 1, F.get(elements, 0))


def member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind_of(value: Column) -> Column:
    """Schema text of a VARIANT: OBJECT<...>, ARRAY<...>, STRING, BIGINT, VOID, ..."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(value), F.lit("OBJECT")), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(value), F.lit("ARRAY")), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(kind_of(value) == "STRING", F.lit(False))


def is_null_or_string(value: Column) -> Column:
    return F.coalesce(kind_of(value).isin("STRING", "VOID"), F.lit(True))


def number(value: Column, kind: str = "double") -> Column:
    """The value if it is a JSON number (no text, no boolean), else NULL."""
    return F.when(
        kind_of(value).rlike(_NUMBER_KIND),
        F.try_variant_get(value, "$", "double").cast(kind),
    )


def entries(value: Column) -> Column:
    """MAP<STRING, VARIANT> of an object, NULL for anything else."""
    return F.when(is_object(value), F.try_variant_get(value, "$", "map<string,variant>"))


def elements(value: Column) -> Column:
    """ARRAY<VARIANT> of an array, NULL for anything else."""
    return F.when(is_array(value), F.try_variant_get(value, "$", "array<variant>"))


def as_text(value: Column) -> Column:
    """Unquoted text of a VARIANT scalar."""
    return F.try_variant_get(value, "$", "string")


def truthy(value: Column) -> Column:
    """False for missing, null, false, zero and empty values."""
    empty = F.to_json(value).isin("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")
    return F.coalesce(~empty, F.lit(False))


def spaced_json(compact: Column) -> Column:
    """Compact JSON with a space after every comma and colon outside strings."""
    tokens = F.regexp_extract_all(compact, F.lit(_JSON_TOKEN), F.lit(0))
    return F.array_join(
        F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), ""
    )


def spaced_json_length(compact: Column) -> Column:
    """Length of `spaced_json` without building it."""
    outside = F.regexp_replace(compact, _JSON_STRING, "")
    return F.length(compact) + F.length(F.regexp_replace(outside, "[^,:]", ""))


def whole_word(text: Column, word: str) -> Column:
    """`word` occurs in `text` with word boundaries on both sides."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in word)
    return text.rlike(rf"(?U)\b{quoted}\b")


def contains_any(text: Column, words) -> Column:
    """Case-insensitive: any of the words is part of the text."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def quoted(text: Column) -> Column:
    """The text in quotes, with backslash, tab and line ends escaped.

    Apostrophes stand between double quotes, unless the text has those too. Other characters stay as they are.
    """
    out = text
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    escaped = F.replace(out, F.lit("'"), F.lit("\\'"))
    return F.when(single & ~double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))
