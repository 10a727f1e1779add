"""Text functions: markup to text, names, labels and evidence."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that set a space before what follows their opening tag.
SPACED = ("br", "li", "p")

_INSIDE = r"""(?:"[^"]*"|'[^']*'|[^"'>])*>"""
# What is no text: comments, declarations, and tags; script and style hold text that is not decoded.
_MARK = re.compile(rf"<!--.*?-->|<(?P<raw>script|style)\b{_INSIDE}(?P<held>.*?)</(?P=raw)\s*>|<[!?][^>]*>|<(?P<open>[a-z][^\s/>]*){_INSIDE}|</[a-z]{_INSIDE}", re.S | re.I)


def plain_text(markup: str | None) -> str | None:
    """The text of markup: a space where br, li or p opens, nothing for other tags, references decoded, white space made single. Null stays null."""
    if markup is None:
        return None
    found, at = [], 0
    for mark in _MARK.finditer(markup):
        found.append(unescape(markup[at : mark.start()]))
        found.append(mark["held"] or (" " if (mark["open"] or "").lower() in SPACED else ""))
        at = mark.end()
    found.append(unescape(markup[at:]))
    return " ".join("".join(found).split())


def html_text(markup: Column) -> Column:
    """``plain_text`` of a column."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(plain_text, na_action="ignore")

    return F.pandas_udf(run, "string")(markup)


def stripped(c: Column) -> Column:
    """A text without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def normalize_name(c: Column) -> Column:
    """A name in compatibility form, case-folded, white space made single.

    Plain ASCII stays in the JVM; only other names are sent to Python.
    """

    def folded(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC").str.casefold().str.split().str.join(" ")

    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    here = F.trim(F.regexp_replace(F.lower(c), r"[\s\x0B\x1c-\x1f]+", " "))
    return F.when(ascii_, here).otherwise(F.pandas_udf(folded, "string")(F.when(~ascii_, c)))


def title_label(c: Column) -> Column:
    """snake_case as Title Case words."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def source_text(title: Column, text: Column) -> Column:
    """What quotes are looked up in: the trimmed title, a line break, the text."""
    return F.concat_ws("\n", stripped(title), text)


def repair_quote(quote: Column, source: Column) -> Column:
    """The source's own spelling of a quote found exactly once ignoring case; else the quote as it is.

    Places are counted without overlap. An empty quote is left alone.
    """
    literal = F.concat(F.lit(r"(?iu)\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    found = F.regexp_extract_all(source, literal, F.lit(0))
    return F.when((F.length(quote) > 0) & (F.size(found) == 1), F.element_at(found, 1)).otherwise(quote)


def release_links(html: Column, ref: Column) -> Column:
    """Refs of other releases linked in markup, upper case, each once, sorted."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)[?&]refNo=([0-9]{2}PR[0-9]+)"), F.lit(1))
    return F.array_sort(F.array_remove(F.array_distinct(F.transform(found, F.upper)), ref))


def entity_id(kind: Column, name: Column, ref: Column, local: Column, norm: Column) -> Column:
    """One id per kind and name for named entities; others keep an id of their release."""
    named = kind.isin("person", "organization", "fund", "instrument") & name.rlike(r"^\p{Lu}")
    digest = F.substring(F.sha2(F.concat(kind, F.lit("\0"), norm), 256), 1, 16)
    return F.when(named, F.concat(F.lit("entity:"), kind, F.lit(":"), digest)).otherwise(F.concat(F.lit("mention:"), ref, F.lit(":"), local))
