"""Text as Column expressions: decoding, folding, escaping, detecting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.formats import layout


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def one_space(text: Column) -> Column:
    """Runs of any white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def half_width(text: Column) -> Column:
    """Full-width ASCII as plain ASCII."""
    return F.translate(text, WIDE, NARROW)


def without_ligatures(text: Column) -> Column:
    for a, b in layout.LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Private signs around raised and lowered parts of a line, until it is whole.
SCRIPTS = layout.SCRIPTS


def without_scripts(text: Column) -> Column:
    """Text without the marks of raised and lowered parts."""
    return F.translate(text, SCRIPTS, "")


def cell(text: Column) -> Column:
    """Text for a Markdown table's cell: plain forms, no marks, pipes escaped, line ends as breaks."""
    return F.replace(F.replace(half_width(without_scripts(text)), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def html_cell(text: Column) -> Column:
    """Text for an HTML table's cell, in plain forms and without marks."""
    text = half_width(without_scripts(text))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def html_title(html: Column) -> Column:
    """The title of a page, null where it has none or a blank one."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def without_blocks(html: Column) -> Column:
    """A page without its scripts and styles."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", "")


def dehyphenated(text: Column) -> Column:
    """Words broken over blocks of a text, joined where a letter stands before the hyphen and the next block begins in lower case.

    A word that has another hyphen is a compound and keeps this one.
    """
    cut = "-\n\n"

    def join(done: Column, part: Column) -> Column:
        broken = done.rlike(r"[\p{L}\p{Nl}]$") & part.rlike(r"^\p{Ll}")
        return F.concat(done, F.when(~broken, cut).when(done.rlike(r"-[^\s\p{Z}]*$"), "-").otherwise(""), part)

    parts = F.split(text, cut)
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), join)


def escaped(text: Column) -> Column:
    """Text that Markdown shows as it is."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(layout.escaped, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def heading_mark(size: Column, bold: Column, body: Column) -> Column:
    """The Markdown mark of a line by its type size."""
    ratio = size / body
    return F.when(ratio >= 2, "# ").when(ratio >= 1.4, "## ").when((ratio >= 1.1) & bold, "### ").otherwise("")


def is_chrome(text: Column) -> Column:
    """Whether a line looks like a page's furniture rather than its text; null and empty lines do not.

    Addresses, banners, page numbers, volumes and running authors tell by themselves, citations by a year beside
    a range of pages, a volume and page, or pages in line; the last ones only in short lines.
    """
    plain = F.regexp_replace(without_scripts(text), f"^{layout.ORNAMENT}|{layout.ORNAMENT}$", "")
    low, size = F.lower(plain), F.octet_length(plain)
    ranges = F.exists(F.regexp_extract_all(plain, F.lit(f"({layout.RANGE})"), F.lit(1)), lambda r: ~r.rlike(layout.DATE_RANGE))
    cited = low.rlike(layout.YEAR) & (ranges | plain.rlike(layout.CITED)) | plain.rlike(layout.AFTER_YEAR)
    found = (
        low.rlike(f"{layout.LINKED}|{layout.BANNER}|{layout.FOLIO}|{layout.VOLUME}")
        | (size.between(2, 7) & low.rlike(layout.ROMAN))
        | ((size <= 80) & low.contains("et al"))
        | ((size <= 120) & cited)
        | ((size <= 30) & plain.rlike(layout.DATE_LINE))
    )
    return F.coalesce(found & (plain != ""), F.lit(False))


def is_folio(text: Column) -> Column:
    """Whether a line is a page's number and nothing else, in figures or roman."""
    plain = F.trim(text)
    return F.coalesce(plain.rlike("^[0-9]{1,4}$") | (F.octet_length(plain).between(1, 7) & F.lower(plain).rlike(layout.ROMAN)), F.lit(False))


def masked_run(text: Column) -> Column:
    """Paths of temporary folders of a run without what differs between runs."""
    return F.regexp_replace(text, r"tmp[-_][0-9A-Za-z]+", "TMP")
