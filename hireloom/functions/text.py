"""Text functions as Column expressions: normal forms, keys, requirement rules.

Regular expressions follow ECMAScript's rules where those differ from Java's: a
word boundary knows ASCII words only, and white space includes the no-break space
and the byte order mark. Unicode NFKC is ICU's, called as a SQL function, so no
Python runs for any of this.
"""

from __future__ import annotations

import unicodedata

from collections.abc import Callable
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t\n\x0B\f\r    -     　﻿"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


_HELD: dict[tuple[str, str], Any] = {}


def held(key: str, build: Callable[[], Any]) -> Any:
    """What build() returns, made once a session and key: columns that name their inputs can
    stand in any plan, and building thousands of them takes seconds."""
    context = SparkContext._active_spark_context
    known = (context.applicationId if context else "", key)
    if known not in _HELD:
        if len(_HELD) >= 256:
            _HELD.clear()
        _HELD[known] = build()
    return _HELD[known]


def js(pattern: str, flags: str = "iu") -> str:
    """An ECMAScript pattern as a Java one: \\b, \\s and \\d by its rules."""
    out = pattern.replace(r"\b", _EDGE).replace(r"\d", "[0-9]")
    parts, inside = [], False
    k = 0
    while k < len(out):
        two = out[k : k + 2]
        if two == r"\s":
            parts.append(SPACE if inside else f"[{SPACE}]")
            k += 2
            continue
        if two[0] == "\\":
            parts.append(two)
            k += 2
            continue
        inside = (inside or two[0] == "[") and two[0] != "]"
        parts.append(two[0])
        k += 1
    return f"(?{flags})" * bool(flags) + "".join(parts)


def matches(text: Column, pattern: str, flags: str = "iu") -> Column:
    return F.coalesce(text.rlike(js(pattern, flags)), F.lit(False))


def first_match(text: Column, pattern: str, group: int = 0, flags: str = "iu") -> Column:
    """The group of the first match; null where nothing, or nothing in the group, matches."""
    return F.nullif(F.regexp_extract(text, js(pattern, flags), group), F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 0, flags: str = "iu") -> Column:
    return F.regexp_extract_all(text, F.lit(js(pattern, flags)), F.lit(group))


def replace_all(text: Column, pattern: str, by: str, flags: str = "iu") -> Column:
    return F.regexp_replace(text, js(pattern, flags), by)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(text: Column) -> Column:
    """Unicode NFKC; null stays null. ASCII text is its own normal form."""
    full = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(True))
    return let(text, lambda x: F.when(x.isNotNull(), F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(full(x))))


def clean(text: Column) -> Column:
    """NFKC, white space runs to one blank, none at the ends."""
    return F.btrim(F.regexp_replace(nfkc(text), f"[{SPACE}]+", " "))


def comparison_key(text: Column) -> Column:
    """clean, lower case, punctuation and symbols to blanks."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(clean(text)), r"[\p{P}\p{S}]+", " "), f"[{SPACE}]+", " "))


def key_of(value: str) -> str:
    """comparison_key of a setting, on the driver."""
    text = " ".join(unicodedata.normalize("NFKC", value).lower().split())
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in text).split())


def company_key(text: Column, suffixes: list[str]) -> Column:
    """comparison_key less legal suffixes, in their order, each once."""
    key = comparison_key(text)
    for suffix in suffixes:
        key = F.regexp_replace(key, rf" \Q{key_of(suffix)}\E$", "")
    return key


def company_key_of(value: str, suffixes: list[str]) -> str:
    key = key_of(value)
    for suffix in suffixes:
        key = key.removesuffix(f" {key_of(suffix)}")
    return key


def presence(text: Column) -> Column:
    return let(text, lambda x: F.when(x != "", x))


def metadata_string(metadata: str, key: str, most: int = 2000) -> Column:
    """A cleaned string of a JSON object; null if it is absent, empty or no string."""
    value = F.expr(f"try_variant_get(try_parse_json({metadata}), '$.{key}', 'variant')")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return presence(clean(F.left(text, F.lit(most))))


def requirement_level(text: Column) -> Column:
    """text is named three times: bind it first."""
    return (
        F.when(matches(text, r"\b(?:preferred|nice to have|desirable|bonus)\b"), "PREFERRED")
        .when(matches(text, r"\boptional\b"), "OPTIONAL")
        .when(matches(text, r"\b(?:required|must|minimum|need to|proficiency|fluent|native)\b"), "REQUIRED")
        .otherwise("UNKNOWN")
    )


def unique_by(items: Column, key) -> Column:
    """The first item of each key, in order."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


# -- HTML to text

#: The named character references that are decoded.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}


def html_to_text(html: Column) -> Column:
    """Text of markup: no scripts or styles, a line a block, references decoded once,
    after the tags are gone; null if nothing is left."""
    text = F.regexp_replace(html, r"(?iu)<script\b[^>]*>[\s\S]*?</script>", " ")
    text = F.regexp_replace(text, r"(?iu)<style\b[^>]*>[\s\S]*?</style>", " ")
    text = F.regexp_replace(text, rf"(?iu)<[{SPACE}]*br[{SPACE}]*/?[{SPACE}]*>", "\n")
    text = F.regexp_replace(text, rf"(?iu)</(?:div|li|p|section|h[1-6])[{SPACE}]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    lines = F.transform(F.split(decode_entities(text), r"\r?\n"), clean)
    return presence(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def decode_entities(text: Column) -> Column:
    """Numeric and named references; an unknown name or no code point becomes a blank."""
    return let(text, _decoded)


def _decoded(text: Column) -> Column:
    pattern = r"(?i)&(#x[0-9a-f]+|#[0-9]+|[a-z]+);"
    gaps = F.split(text, pattern, -1)
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)
    table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(name: Column) -> Column:
        bare = F.regexp_replace(name, "^#x?0*(?=[0-9a-f])", "")  # 20 digits are more than any code point has
        digits = F.when(name.startswith("#x"), F.conv(F.substring(bare, 1, 20), 16, 10)).otherwise(F.substring(bare, 1, 20))
        code = F.when(name.startswith("#"), digits.try_cast("bigint"))
        # a code point as UTF-32 bytes
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = (code >= 0) & (code <= 0x10FFFF) & ~((code >= 0xD800) & (code <= 0xDFFF))
        return F.coalesce(F.when(valid, char), F.try_element_at(table, name), F.lit(" "))

    joined = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(names, F.slice(gaps, F.lit(2), F.size(names)), lambda n, g: F.concat(decoded(n), g)), ""))
    return F.when(text.rlike(pattern), joined).otherwise(text)
