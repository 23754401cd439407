"""Text cleaning: entities, markup, slugs, folding, truncation, contacts."""
from __future__ import annotations

import re
import unicodedata
from functools import partial, reduce

from pyspark.sql import Column, functions as F

from .patterns import SPACE, WORD_EDGE, let


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decomposition rule."""
    marked, plain = [], []
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(cp):
            marked.append(chr(cp))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[\x{0300}-\x{036F}]", ""), _MARKED, _PLAIN)


def squeeze(c: Column) -> Column:
    """Collapse every white space run to one blank and trim."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def _code_point(n: Column) -> Column:
    ok = n.between(1, 0x10FFFF)
    return F.when(n.between(1, 0x7F), F.char(n)).when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def _decode_numbers(c: Column, pattern: str, number) -> Column:
    """Replace each numeric reference by its character: text pieces interleaved with decoded marks."""
    def decoded(t: Column) -> Column:
        pieces = F.split(t, pattern.replace("(", "(?:"))
        marks = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda d: _code_point(number(d)))
        joined = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), marks), pieces, lambda m, p: F.concat(m, p)), "")
        return F.when(F.rlike(t, F.lit(pattern)), joined).otherwise(t)

    return let(c, decoded)


def decode_entities(c: Column) -> Column:
    """Named, hexadecimal and decimal character references; the ampersand comes last. Texts without an ampersand are left as they are."""
    def named(out: Column) -> Column:
        some = F.rlike(out, F.lit("(?i)&(?:nbsp|lt|gt|quot|apos|#0*39);"))
        by_name = out
        for pattern, char in [("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
                              ("(?i)&quot;", '"'), ("(?i)&#0*39;|&apos;", "'")]:
            by_name = F.regexp_replace(by_name, pattern, char)
        return F.when(some, by_name).otherwise(out)

    def decoded(out: Column) -> Column:
        # quotes, of which JSON in an attribute is full, as a literal: a quote is part of no reference, so the order is of no account
        out = let(F.replace(out, F.lit("&#34;"), F.lit('"')), named)
        out = _decode_numbers(out, "&#[xX]([0-9a-fA-F]+);", lambda d: F.conv(d, 16, 10).try_cast("long"))
        out = _decode_numbers(out, "&#([0-9]+);", lambda d: d.try_cast("long"))
        return F.regexp_replace(out, "(?i)&amp;", "&")

    return let(F.coalesce(c, F.lit("")), lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def strip_html(c: Column) -> Column:
    """Readable prose of a page: script and style bodies dropped, tags to blanks, entities decoded."""
    text = F.coalesce(c, F.lit(""))
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return squeeze(decode_entities(F.regexp_replace(text, "<[^>]+>", " ")))


def slugify_title(c: Column) -> Column:
    """Title to slug: accents and punctuation dropped, blanks to hyphens; edge hyphens are kept."""
    base = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9\s]", ""), r"\s+", "-")


def fold(c: Column) -> Column:
    """Lower case with every run of other than letters and numbers as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def first_segment_fold(c: Column) -> Column:
    """Fold of the text before the first comma (the primary city of a location)."""
    return fold(F.substring_index(F.coalesce(c, F.lit("")), ",", 1))


def cut_with_ellipsis(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def cut_at_word(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, drop the broken last word and end with an ellipsis sign."""
    flat = squeeze(c)
    head = F.regexp_replace(F.substring(flat, 1, limit), rf"{SPACE}+\S*\z", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(head, F.lit("\u2026")))


# Signs that document parsers mis-read, and their ASCII spellings, applied in this order.
ASCII_SIGNS = [
    ("em-dash", r"\x{2014}", "-"),
    ("en-dash", r"\x{2013}", "-"),
    ("smart-double-quote", r"[\x{201C}-\x{201F}]", '"'),
    ("smart-single-quote", r"[\x{2018}-\x{201B}]", "'"),
    ("ellipsis", r"\x{2026}", "..."),
    ("zero-width", r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]", ""),
    ("nbsp", r"\x{00A0}", " "),
    ("right-arrow", SPACE + r"*\x{2192}" + SPACE + "*", " to "),
    ("left-arrow", SPACE + r"*\x{2190}" + SPACE + "*", " from "),
    ("vert-arrow", SPACE + r"*[\x{2191}\x{2193}]" + SPACE + "*", " "),
    ("middot", SPACE + r"*\x{00B7}" + SPACE + "*", " | "),
    ("bullet", SPACE + r"*\x{2022}" + SPACE + "*", " | "),
    ("euro", r"\x{20AC}", "EUR "),
    ("pound", r"\x{00A3}", "GBP "),
]
# A script or style element, or any tag: left as it is. Everything between is body text.
_KEPT = r"(?is)(<(script|style)\b[^>]*>.*?</\2>|<[^>]*>)"


def _characters(pattern: str) -> str:
    """The signs that a pattern of :data:`ASCII_SIGNS` is made of."""
    body = pattern.replace(SPACE, "")
    spans = re.findall(r"\\x\{([0-9A-F]{4})\}(?:-\\x\{([0-9A-F]{4})\})?", body)
    return "".join(chr(cp) for first, last in spans for cp in range(int(first, 16), int(last or first, 16) + 1))


_ANY_SIGN = "[" + "".join(re.findall(r"\\x\{[0-9A-F]{4}\}(?:-\\x\{[0-9A-F]{4}\})?", "".join(p.replace(SPACE, "") for _, p, _ in ASCII_SIGNS))) + "]"


def ascii_signs(c: Column) -> Column:
    """Each sign is replaced as a literal; only those that take the blanks around them need a pattern, and only where they stand."""
    out = c
    for _, pattern, plain in ASCII_SIGNS:
        if SPACE in pattern:
            # no replacement brings in a sign, so the text as it came tells which patterns may fit
            some = reduce(lambda a, b: a | b, [F.contains(c, F.lit(sign)) for sign in _characters(pattern)])
            out = let(out, partial(lambda some, p, by, t: F.when(some, F.regexp_replace(t, p, by)).otherwise(t), some, pattern, plain))
        else:
            for sign in _characters(pattern):
                out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.when(F.rlike(c, F.lit(_ANY_SIGN)), out).otherwise(c)


def _body_pieces(html: Column) -> Column:
    return F.split(html, _KEPT)


def ascii_html(html: Column) -> Column:
    """Body text of a page made ASCII-safe; tags, scripts and styles stay untouched. A text without a sign < has none of them."""
    def cleaned(page: Column) -> Column:
        kept = F.regexp_extract_all(page, F.lit(_KEPT), F.lit(1))
        parts = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), kept), _body_pieces(page), lambda k, t: F.concat(k, ascii_signs(t))), "")
        return F.when(F.contains(page, F.lit("<")), parts).otherwise(ascii_signs(page))

    return let(html, cleaned)


def _occurrences(t: Column, signs: str) -> Column:
    """How often any of ``signs`` stands in a text, by the bytes that it loses without them."""
    return reduce(lambda a, b: a + b, [((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(x), F.lit("")))) / F.lit(len(x.encode()))).cast("int") for x in signs])


def ascii_sign_counts(html: Column) -> Column:
    """array<struct<sign,n>> of replacements made by :func:`ascii_html`, signs in application order.

    No replacement brings in a later sign, so each is counted on the text as it came.
    """
    body = let(html, lambda page: F.when(F.contains(page, F.lit("<")), F.array_join(_body_pieces(page), "\n")).otherwise(page))
    return let(body, lambda t: F.array(*[F.struct(F.lit(name).alias("sign"), _occurrences(t, _characters(p)).alias("n")) for name, p, _ in ASCII_SIGNS]))


EMAIL = r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"
_LEAD = r"(?:Emailed|emailed|contact[:\s]+|to\s+)"
_PERSON = r"([A-Za-z][A-Za-z]+ ?[A-Za-z]?[A-Za-z]*)"


def contacts(notes: Column) -> Column:
    """array<struct<email,name>>: every address, with the person named right before its first use."""
    mails = F.regexp_extract_all(F.coalesce(notes, F.lit("")), F.lit(f"({EMAIL})"), F.lit(1))
    lead = r"(?i)" + _LEAD + _PERSON + r"\s*(?:at|@|\z)"

    def entry(mail: Column) -> Column:
        before = F.call_function("substring_index", notes, mail, F.lit(1))
        name = F.trim(F.regexp_extract(before, lead, 1))
        return F.struct(mail.alias("email"), F.when(name != "", name).alias("name"))

    return F.transform(mails, entry)


def address_city(c: Column) -> Column:
    """'Team in City, Region' to 'City, Region': only the part before the first comma is touched."""
    text = F.trim(F.coalesce(c, F.lit("")))
    head = F.substring_index(text, ",", 1)
    tail = F.substring(text, F.length(head) + 1, F.length(text))
    city = F.trim(F.regexp_extract(head, r"(?i)^(?:.*\s)?in\s+(\S.*)$", 1))
    return F.when(city != "", F.concat(city, tail)).otherwise(text)


def place_string(locality: Column, region: Column, country: Column) -> Column:
    parts = F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in (locality, region, country)])
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), ", ")


def clean_list(items: Column) -> Column:
    """Trimmed entries of a list; NULL and blank ones are left out."""
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def whole_word(word: str) -> str:
    return WORD_EDGE + word + WORD_EDGE
