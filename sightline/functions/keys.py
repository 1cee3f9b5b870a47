"""URLs, normalised names and the two hashes that identify a vacancy and a generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Query keys that never help a link resolve (fixed values). Any key with prefix `utm_` goes too.
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gh_src", "source", "ref", "referrer",
)

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
# A query of `key=value` pairs that need no re-encoding, and its tracking pairs.
_PAIR = "[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*"
_PLAIN = rf"^[^?#]*\?{_PAIR}(?:&{_PAIR})*(?:#|\z)"
_TRACKING = rf"(?i)(?:^|&)(?:utm_[^=&]*|{'|'.join(TRACKING_KEYS)})=[^&]*"


def _trimmed(url: Column) -> Column:
    return F.translate(strip(F.coalesce(url, F.lit(""))), "\t\r\n", "")


def _scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, f"^({_SCHEME})?", 1))


def _rest(u: Column) -> Column:
    """Host and path."""
    return F.regexp_extract(u, f"^(?:{_SCHEME})?([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Without query, fragment and trailing slashes; the two slashes before a host are not a path."""
    u = _trimmed(url)
    return F.concat(_scheme(u), F.regexp_replace(_rest(u), r"(?<=[^/])/+\z|^/\z", ""))


def _decode(c: Column) -> Column:
    # A percent sign that starts no escape stands for itself.
    c = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    # Java's encoder keeps `*` and escapes `~`; query strings are stored the other way round.
    c = F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A"))
    return F.replace(c, F.lit("%7E"), F.lit("~"))


def _any_query(query: Column) -> Column:
    """Decode every pair, drop tracking ones, encode again."""
    def pair(p: Column) -> Column:
        cut = F.instr(p, "=")
        return F.struct(
            _decode(F.when(cut > 0, F.substring_index(p, "=", 1)).otherwise(p)).alias("k"),
            F.when(cut > 0, _decode(p.substr(cut + 1, F.length(p)))).otherwise("").alias("v"),
        )

    def useful(p: Column) -> Column:
        key = F.lower(p["k"])
        return ~key.isin(*TRACKING_KEYS) & ~key.startswith("utm_")

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    return F.array_join(F.transform(
        F.filter(pairs, useful), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def clean_url(url: Column) -> Column:
    """The link to keep: fragment and tracking keys dropped, other query pairs in order."""
    u = _trimmed(url)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = (
        F.when(~F.contains(u, F.lit("?")), "")
        .when(u.rlike(_PLAIN), F.ltrim(F.regexp_replace(query, _TRACKING, ""), F.lit("&")))
        .otherwise(_any_query(query))
    )
    tail = F.coalesce(F.concat(F.lit("?"), F.nullif(kept, F.lit(""))), F.lit(""))
    return F.concat(_scheme(u), _rest(u), tail)


def host_tenant(host: Column, name: Column | None = None) -> Column:
    """A given name, else the first label of the host."""
    label = F.split_part(host, F.lit("."), F.lit(1))
    return label if name is None else F.coalesce(F.nullif(name, F.lit("")), label)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def norm_company(c: Column) -> Column:
    """Lower case letters, digits and single blanks. Tabs vanish rather than separate."""
    return _squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", ""))


def norm_role(c: Column) -> Column:
    """As `norm_company`, but brackets separate words and `/` stays."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), "()", "  ")
    return _squeeze(F.regexp_replace(low, "[^a-z0-9 /]", ""))


def vacancy_text(company: Column, title: Column) -> Column:
    """`company|role`, or null when either side has nothing left to compare."""
    # `nullif` evaluates its argument once; a `when` over both sides would normalise twice.
    none = F.lit("")
    return F.concat(F.nullif(norm_company(company), none), F.lit("|"), F.nullif(norm_role(title), none))


def vacancy_key(company: Column, title: Column, url: Column) -> Column:
    """16 hex digits that are equal for all postings of one vacancy, in any place or source."""
    return F.substring(F.sha1(F.coalesce(vacancy_text(company, title), canonical_url(url))), 1, 16)


def job_id(vkey: Column, first_seen: Column) -> Column:
    """Row id of one generation: hash of the key and its first-seen UTC time in ISO form."""
    micros = F.date_format(first_seen, "SSSSSS")
    stamp = F.concat(
        F.date_format(first_seen, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )
    return F.substring(F.sha1(F.concat(vkey, F.lit("|"), stamp)), 1, 16)
