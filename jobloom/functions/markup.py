"""Markup in text fields to plain text.

Tags become spaces, entities their characters, runs of white space one space. What differs is how
often the field was encoded, and so the order of these steps. Entities have no built-in function; they
go through an Arrow batch, and only where a text has any."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else html.unescape(t))


def unescape(text: Column) -> Column:
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def _without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", " ")


def encoded_once(text: Column) -> Column:
    """Of markup whose text is escaped: tags first, so that an escaped bracket is no tag."""
    return one_line(unescape(_without_tags(text)))


def encoded_twice(text: Column) -> Column:
    """Of markup that is itself escaped."""
    return encoded_once(unescape(text))


def encoded_somehow(text: Column) -> Column:
    """Of plain text or of markup that is escaped once, in its text or as a whole."""
    return one_line(_without_tags(unescape(_without_tags(text))))
