"""Text functions as Column expressions."""

from __future__ import annotations

import html.entities
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

#: Letters, digits and the underscore of every script. Marks end a token.
TOKEN = r"([\p{L}\p{N}_]+)"

#: A reference to a character, by number or name; some old names go without a semicolon.
REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32}+;?)"
OLD_NAMES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True))
# Digits of Devanagari.
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def collapse(text: Column) -> Column:
    """White space runs become one space; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"(?U)\s+", " ")), F.lit(""))


def _numbered(reference: Column) -> Column:
    """The character of &#10; or &#xa;. Numbers that are no characters become U+FFFD, controls go, and 128 to 159 are
    read as Windows-1252, as browsers do."""
    hexed = F.rlike(reference, F.lit("^&#[xX]"))
    digits = F.ltrim(F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+)", 1), F.lit("0"))
    n = F.when(F.length(digits) > 9, F.lit(1 << 40)).when(hexed, F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
    n = F.coalesce(n, F.lit(0).cast("long"))
    western = [F.lit(bytes([i]).decode("cp1252", "ignore") or chr(i)) for i in range(128, 160)]
    control = n.between(1, 8) | n.isin(11, 127) | n.between(14, 31) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(bad, F.lit("\ufffd")).when(n.between(128, 159), F.get(F.array(*western), (n - 128).cast("int"))).when(n == 13, F.lit("\r")).when(control, F.lit("")).otherwise(char)


def unescape(text: Column) -> Column:
    """References to characters resolved, in one pass, so that nothing is resolved twice: all names of HTML 5, numbers
    in both forms, and names without a semicolon where HTML still knows them, as the beginning of a word too."""
    names = F.str_to_map(F.lit("\x01".join(f"&{n}\x02{c}" for n, c in html.entities.html5.items())), F.lit("\x01"), F.lit("\x02"))

    def resolved(x: Column) -> Column:
        old = F.regexp_extract(x, f"^&(?:{OLD_NAMES})", 0)
        begun = F.when(old != "", F.concat(F.element_at(names, old), F.substr(x, F.length(old) + 1)))
        named = F.coalesce(F.element_at(names, x), begun, x)
        return F.when(F.rlike(x, F.lit("^&#[0-9xX]")), _numbered(x)).when(F.startswith(x, F.lit("&")) & (F.length(x) > 1), named).otherwise(x)

    pieces = F.regexp_extract_all(text, F.lit(rf"{REFERENCE}|[^&]++|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, resolved), "")).otherwise(text)


def _deepest(text: Column, begin: str, end: str) -> Column:
    """How deep pairs of signs are nested: a count over the signs alone."""
    signs = F.regexp_extract_all(text, F.lit(rf"\Q{begin}\E|\Q{end}\E"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x == begin, s["now"] + 1).otherwise(F.greatest(s["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(signs, start, step, lambda s: s["most"])


def _without_nested(text: Column, begin: str, end: str, pattern: str, by: str) -> Column:
    """text with all pairs of signs replaced, the innermost first: as many passes as pairs are nested."""
    rounds = F.slice(F.sequence(F.lit(0), _deepest(text, begin, end)), F.lit(2), _deepest(text, begin, end))
    return F.aggregate(rounds, text, lambda x, _: F.regexp_replace(x, pattern, by))


def wikitext(text: Column) -> Column:
    """Plain text of wiki markup: comments, references and templates go, whatever they hold; a link leaves what follows
    its last bar; runs of two or more quotes, tags and entities as in HTML."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)<ref\b[^<>]*+(?<=/)>", ""), r"(?is)<ref\b[^<>]*+>.*?</ref\s*>", "")
    bare = _without_nested(bare, "{{", "}}", r"(?s)\{\{(?!\{)(?:(?!\{\{|\}\}).)*+\}\}", "")
    bare = _without_nested(bare, "[[", "]]", r"(?s)\[\[(?!\[)(?:(?:(?!\[\[|\]\]|\|).)*+\|)*+((?:(?!\[\[|\]\]|\|).)*+)\]\]", "$1")
    return collapse(unescape(F.regexp_replace(F.regexp_replace(bare, "'{2,}", ""), r"<[^<>]++>", " ")))


def listed(text: Column, entities: Mapping[str, str]) -> Column:
    """Only these references resolved, as they are written, ampersands last: "&amp" in a text that was cut stays."""
    for name, char in sorted(entities.items(), key=lambda e: e[1] == "&"):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_tags(html: Column, entities: Mapping[str, str] | None = None) -> Column:
    """Text of an HTML fragment: scripts and styles go with their content, other tags become spaces. References are
    resolved as HTML 5 does, or only those of `entities`."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|sup)[^>]*>.*?</(script|style|sup)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    return collapse(unescape(bare) if entities is None else listed(bare, entities))


def blocks(html: Column, tag: str) -> Column:
    """Contents of all <tag> elements, scripts and styles removed first."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_extract_all(bare, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "), ""))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


# The number that closes a verse, between single or double dandas, and signs that editions set freely.
VERSE_END = r"(?U)।{1,2}\s*\d+\.\d+\s*।{0,2}"
CLOSING = "॥\\s*[०-९]+\\s*॥"
FREE_SIGNS = r"(?U)[\s।॥\-\u200C\u200D]"


def verse(text: Column) -> Column:
    """A verse on one line; its number at the end becomes a double danda."""
    return collapse(F.regexp_replace(text, VERSE_END, " ॥"))


def compare_key(text: Column) -> Column:
    """What two editions of a Devanagari text must share: no closing number, dandas, hyphens, spaces or joiners."""
    return F.regexp_replace(F.regexp_replace(text, CLOSING, ""), FREE_SIGNS, "")


def retrieval_text(*fields: Column) -> Column:
    """Distinct non-blank fields, in order, two spaces between them."""
    return F.concat_ws("  ", F.array_distinct(F.filter(F.array(*[F.trim(f) for f in fields]), lambda x: x.isNotNull() & (x != ""))))


def filename(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", ""), F.lit("")), F.lit("anon"))
