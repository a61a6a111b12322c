"""Text of pages: folding, dominant script, title segments, and hosts of blacklist lines."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What separates the segments of a title, and the form of a host name in a list.
TITLE_SEPARATOR = "\\s+[-|\u2013\u2014:\u00b7\u00bb]+\\s+|\\s*\\|\\s*"
HOST_FORM = r"^(?=.{1,253}$)[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$"


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Compatibility form, case folded, without white space at the ends; a null is empty."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t or "").casefold().strip())


def script_of(text: str | None) -> str | None:
    """The script that most letters of a text have, the first by name on ties; None without letters."""
    counts: Counter = Counter()
    for char, n in Counter(text or "").items():  # each character is looked up once, however long the text
        if char.isalpha():
            counts[unicodedata.name(char, "?").split()[0]] += n
    return min(counts, key=lambda name: (-counts[name], name), default=None)


@F.pandas_udf(T.StringType())
def dominant_script(texts: pd.Series) -> pd.Series:
    return texts.map(script_of)


def title_segments(title: Column) -> Column:
    """The parts of a folded title between its separators."""
    return F.filter(F.split(F.coalesce(title, F.lit("")), TITLE_SEPARATOR), lambda x: x != "")


def title_core(title: Column, boilerplate: Column) -> Column:
    """A title without the segments that the whole site repeats."""
    return F.array_join(F.filter(title_segments(title), lambda x: ~F.array_contains(boilerplate, x)), " ")


def listed_host(line: Column) -> Column:
    """The host or address that a line of a blacklist names, null for what is neither. Lines may be URLs."""
    text = F.regexp_replace(F.lower(F.trim(line)), "^.*?://", "")
    place = F.regexp_extract(text, "^([^/?]*)", 1)
    name = F.when(F.length(F.regexp_replace(place, "[^:]", "")) == 1, F.regexp_extract(place, "^([^:]*)", 1)).otherwise(place)
    bare = F.regexp_replace(name, r"^\.+|\.+$", "")
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(bare.rlike(rf"^{octet}(\.{octet}){{3}}$") | bare.rlike(HOST_FORM) | bare.rlike("^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:]*$"), bare)
