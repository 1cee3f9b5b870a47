"""Markup and whitespace."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007" \
        "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim white space of any kind; `trim` alone takes only the blank."""
    return F.btrim(c, F.lit(WHITE))


def strip_tags(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITE}]+", " ")


def unescape_basic(c: Column) -> Column:
    """The five predefined entities. `&amp;` goes last so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@F.pandas_udf(T.StringType())
def _unescape_full(s: pd.Series) -> pd.Series:
    return s.astype(object).map(html.unescape, na_action="ignore")


def unescape_all(c: Column) -> Column:
    """Every named and numeric entity; the table lives in Python, so this one goes over Arrow."""
    return _unescape_full(c)


def html_text(c: Column, unescape=unescape_all) -> Column:
    """Entities decoded, markup dropped, white space runs made one blank."""
    return F.trim(collapse(strip_tags(unescape(F.coalesce(c, F.lit(""))))))
