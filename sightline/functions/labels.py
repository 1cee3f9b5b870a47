"""Short texts shown with a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs, score bands and their lights.
CURRENCY = {"GBP": "£", "USD": "$", "EUR": "€"}
HIGH, MID = 7, 5
DOTS = {"hi": "🟢", "mid": "🟡", "lo": "🔴", "": "⚪"}


def escape_html(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "").when(score >= HIGH, "hi").when(score >= MID, "mid").otherwise("lo")


def score_dot(score: Column) -> Column:
    band = score_band(score)
    dot = F.when(band == "", DOTS[""])
    for key in ("hi", "mid", "lo"):
        dot = dot.when(band == key, DOTS[key])
    return dot


def _whole(c: Column) -> Column:
    return F.bround(c).cast("bigint").cast("string")


def salary_label(lo: Column, hi: Column, currency: Column) -> Column:
    """`£40k–£50k`, `£40k`, `≤£50k`, `£40k+` or nothing; zero is missing, halves go to even."""
    sign = F.when(currency == "USD", CURRENCY["USD"]).when(currency == "EUR", CURRENCY["EUR"])
    sign = sign.otherwise(CURRENCY["GBP"])

    def k(n: Column) -> Column:
        return F.concat(sign, _whole(n / 1000), F.lit("k"))

    has_lo, has_hi = F.coalesce(lo, F.lit(0.0)) != 0, F.coalesce(hi, F.lit(0.0)) != 0
    return (
        F.when(has_lo & has_hi & (lo == hi), k(lo))
        .when(has_lo & has_hi, F.concat(k(lo), F.lit("–"), k(hi)))
        .when(has_hi, F.concat(F.lit("≤"), k(hi)))
        .when(has_lo, F.concat(k(lo), F.lit("+")))
        .otherwise("")
    )


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def location_chip(locations: Column, location: Column) -> Column:
    """First city, else the raw text, else a dash; ` +n` for the cities not shown."""
    n = F.coalesce(F.size(locations), F.lit(0))
    first = F.coalesce(_given(F.try_element_at(locations, F.lit(1))), _given(location), F.lit("—"))
    extra = F.when(n > 1, F.concat(F.lit(" +"), (n - 1).cast("string"))).otherwise("")
    return F.concat(first, extra)


def location_list(locations: Column, location: Column) -> Column:
    """All cities joined, else the raw text, else `N/A`."""
    joined = F.when(F.size(locations) > 0, F.array_join(locations, ", "))
    return F.coalesce(joined, _given(location), F.lit("N/A"))


def _seconds(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1_000_000.0)


def age_label(ts: Column, as_of: Column) -> Column:
    """Age in minutes, hours or days, halves up; nothing for a missing time."""
    s = _seconds(ts, as_of)

    def part(seconds: int, unit: str, least: int | None = None) -> Column:
        n = F.floor(s / seconds + 0.5)
        if least is not None:
            n = F.greatest(F.lit(least), n)
        return F.concat(n.cast("string"), F.lit(unit))

    return (
        F.when(ts.isNull(), "").when(s < 3600, part(60, "m ago", 1))
        .when(s < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))
    )


def is_fresh(ts: Column, as_of: Column) -> Column:
    return F.coalesce(_seconds(ts, as_of) < 86400, F.lit(False))


def card_text(j, index: Column | None = None) -> Column:
    """One listing as a marked-up card. `j(name)` gives the column of that name."""
    score = j("score")
    number = F.lit("") if index is None else F.concat(F.lit("<b>"), index.cast("string"), F.lit(".</b> "))
    badge = F.when(score.isNull(), "").otherwise(F.concat(F.lit("<b>"), _whole(score), F.lit("/10</b> ")))
    meta = F.concat_ws(
        " · ",
        _given(escape_html(j("company"))),
        _given(escape_html(location_list(j("locations"), j("location")))),
        _given(salary_label(j("salary_min"), j("salary_max"), j("currency"))),
        _given(escape_html(j("source"))),
    )
    reason = j("eval_reason")
    note = F.when(F.coalesce(reason, F.lit("")) == "", "").otherwise(
        F.concat(F.lit("\n   ✨ "), escape_html(reason)))
    return F.concat(
        number, score_dot(score), F.lit(" "), badge,
        F.lit('<a href="'), escape_html(j("url")), F.lit('">'), escape_html(j("title")),
        F.lit("</a>\n   <i>"), meta, F.lit("</i>"), note,
    )
