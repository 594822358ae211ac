"""Native Column functions for text (cleaning, language test, links, rules).

Everything here returns a ``Column`` built from JVM-side Spark functions, so
it stays inside whole-stage codegen; no Python runs per row.  Python's
``re`` treats ``\\s``, ``\\w`` and ``\\b`` as Unicode classes, so the Java
patterns carry ``(?U)`` or an explicit whitespace class to match it.
"""

from __future__ import annotations

import html
import json
from functools import lru_cache
from html.entities import html5

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from supportlake import fixed

# The characters Python's ``str.isspace`` (and so ``re``'s ``\s``) accepts.
PY_WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_REGEX_META = set(r"\.^$|?*+()[]{}")


def regex_escape(literal: str) -> str:
    """Escape a literal for both Java regex and RE2."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in literal)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_regex(pattern: str) -> str:
    """Rewrite a Python ``re`` pattern so Java evaluates it the same way."""
    return "(?U)" + pattern.replace(r"\s", PY_WHITESPACE)


def not_null_text(c: Column | str) -> Column:
    """Non-string / missing text counts as the empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def py_strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")


# A character reference: a decimal or hexadecimal number or a name, the
# semicolon optional (the HTML5 rules, single pass).
ENTITY_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[str, list[str], str]:
    """(names as JSON, names that need no semicolon, odd numbers as JSON), from
    the standard library's tables."""
    odd = {str(n): html.unescape(f"&#{n};") for n in [*range(0x00, 0x20), *range(0x7F, 0xA0)]}
    odd = {n: t for n, t in odd.items() if t != chr(int(n))}
    legacy = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return json.dumps(html5), legacy, json.dumps(odd)


def _decode_number(body: Column) -> Column:
    digits = F.rtrim(body, F.lit(";"))
    is_hex = digits.rlike("^#[xX]")
    hexed = F.ltrim(F.substring(digits, 3, 1 << 20), F.lit("0"))
    # seven digits and more are beyond the last code point in either base
    dec = F.ltrim(F.substring(digits, 2, 1 << 20), F.lit("0"))
    number = F.when(is_hex, F.when(F.length(hexed) > 6, F.lit(0x110000)).otherwise(F.conv(F.concat(F.lit("0"), hexed), 16, 10).cast("int"))
                    ).otherwise(F.when(F.length(dec) > 7, F.lit(0x110000)).otherwise(F.concat(F.lit("0"), dec).cast("int")))
    _, _, odd = _entity_tables()
    low = F.try_element_at(F.from_json(F.lit(odd), "map<string,string>"), number.cast("string"))
    beyond = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    # code points that are not characters vanish
    none = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(low.isNotNull(), low).when(beyond, F.lit("\ufffd")).when(none, F.lit("")).otherwise(char)


def _decode_name(body: Column) -> Column:
    names, legacy, _ = _entity_tables()
    table = F.from_json(F.lit(names), "map<string,string>")
    start = F.get(F.filter(F.array(*[F.lit(n) for n in legacy]), lambda n: F.startswith(body, n)), F.lit(0))
    return F.coalesce(
        F.try_element_at(table, body),
        F.concat(F.try_element_at(table, start), F.substr(body, F.length(start) + 1)),
        F.concat(F.lit("&"), body))


def decode_entities(c: Column | str) -> Column:
    """Every HTML character reference, natively and in one pass (``&amp;lt;``
    becomes ``&lt;``): the text between references and the decoded references
    are zipped together.  Texts without an ampersand are not touched."""
    t = _col(c)
    between = F.split(t, ENTITY_PATTERN, -1)
    found = F.regexp_extract_all(t, F.lit(ENTITY_PATTERN), 0)

    def decode(e: Column) -> Column:
        body = F.substring(e, 2, 1 << 20)
        return F.when(F.startswith(body, F.lit("#")), _decode_number(body)).otherwise(_decode_name(body))

    joined = F.zip_with(between, found, lambda x, e: F.concat(x, F.coalesce(decode(e), F.lit(""))))
    return F.when(F.contains(t, F.lit("&")), F.array_join(joined, "")).otherwise(t)


def collapse_whitespace(c: Column | str) -> Column:
    # after the collapse only single spaces remain, so trim() is enough
    return F.trim(F.regexp_replace(_col(c), PY_WHITESPACE + "+", " "))


def strip_signature(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), py_regex(fixed.SIGNATURE_PATTERN), "")


def strip_mentions(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), fixed.MENTION_PATTERN, "")


def clean_text(c: Column | str, is_brand_reply: bool | Column = False) -> Column:
    """Entities -> U+FFFD -> (signature, brand replies only) -> mentions -> spaces."""
    t = decode_entities(not_null_text(c))
    t = F.replace(t, F.lit(fixed.REPLACEMENT_CHAR), F.lit(fixed.REPLACEMENT_CHAR_SUB))
    if isinstance(is_brand_reply, Column):
        t = F.when(is_brand_reply, strip_signature(t)).otherwise(t)
    elif is_brand_reply:
        t = strip_signature(t)
    return collapse_whitespace(strip_mentions(t))


def ascii_ratio(c: Column | str) -> Column:
    t = not_null_text(c)
    n_ascii = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    return n_ascii / F.greatest(F.length(t), F.lit(1))


def stopword_hits(c: Column | str, stopwords: Sequence[str] = fixed.ENGLISH_STOPWORDS) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(not_null_text(c)), F.lit("[a-zA-Z]+"), 0))
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in stopwords])))


def is_english(c: Column | str, min_stopwords: int = fixed.ENGLISH_MIN_STOPWORDS) -> Column:
    t = not_null_text(c)
    return (
        (F.length(py_strip(t)) >= fixed.ENGLISH_MIN_LENGTH)
        & (ascii_ratio(t) >= fixed.ENGLISH_MIN_ASCII_RATIO)
        & (stopword_hits(t) >= min_stopwords)
    )


def extract_links(c: Column | str) -> Column:
    return F.regexp_extract_all(not_null_text(c), F.lit(py_regex(fixed.URL_PATTERN)), 0)


def links_to_string(links: Column | str) -> Column:
    return F.array_join(_col(links), ";")


def links_from_string(c: Column | str) -> Column:
    return F.filter(F.split(not_null_text(c), ";"), lambda x: F.trim(x) != "")


def dm_flag(c: Column | str) -> Column:
    return not_null_text(c).rlike(py_regex(fixed.DM_PATTERN))


def link_flag(c: Column | str) -> Column:
    return not_null_text(c).rlike(fixed.LINK_PATTERN)


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(not_null_text(c), PY_WHITESPACE + "+"), lambda w: w != ""))


def keyword_count(lower_text: Column, keyword: str) -> Column:
    """Whole-word occurrences of ``keyword`` in already lower-cased text.

    The cheap ``instr`` guard skips the regex for the (usual) rows that do
    not even contain the keyword as a substring.
    """
    pattern = r"(?U)\b" + regex_escape(keyword) + r"\b"
    return F.when(F.instr(lower_text, keyword) > 0, F.regexp_count(lower_text, F.lit(pattern))).otherwise(F.lit(0))


def contains_any(lower_text: Column, words: Sequence[str]) -> Column:
    """Plain substring test, no word boundaries (``sue`` hits ``issue``)."""
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(lower_text, w) > 0)
    return out


def first_word_match(lower_text: Column, words: Sequence[str]) -> Column:
    """First keyword, in list order, found as a whole word; null if none."""
    return F.coalesce(*[
        F.when(lower_text.rlike(r"(?U)\b" + regex_escape(w) + r"\b"), F.lit(w)) for w in words
    ])


def fmt2(c: Column | str) -> Column:
    """``f"{x:.2f}"``: ``format_number`` rounds the binary value half-even like Python."""
    return F.format_number(_col(c).cast("double"), 2)


def truncate_ellipsis(c: Column | str, n: int) -> Column:
    t = _col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def title_label(c: Column | str) -> Column:
    """``brand_consistency`` -> ``Brand Consistency``."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def fill_template(template: str, **values: Column) -> Column:
    """Concatenate a ``{name}`` template with Column values (no Python per row)."""
    parts: list[Column] = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(values[piece[1:-1]])
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def materialize(df, **cols: Column):
    """Add columns behind a Generate (``inline`` of a one-element array).

    Catalyst inlines a projected expression into every consumer; for large
    expressions read many times (keyword counts, labels) that multiplies the
    work and the generated code.  Generator output is a real attribute, so
    consumers read the value instead of recomputing it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
