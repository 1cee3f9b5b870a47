"""What goes to a scorer and what comes back from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Dollars per million tokens (input, output) and how cache traffic is billed.
PRICES = {
    "claude-haiku-4-5": (1.0, 5.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-opus-4-8": (5.0, 25.0),
}
CACHE_READ, CACHE_WRITE = 0.1, 1.25

# What marks an error that ends a run.
AUTH_CLASSES = ("AuthenticationError", "PermissionDeniedError")
AUTH_PHRASES = (
    "not logged in", "please run /login", "invalid x-api-key", "invalid api key",
    "authentication", "oauth", "not authenticated",
)
BUDGET_CLASSES = ("RateLimitError", "OverloadedError")
BUDGET_PHRASES = (
    "credit balance", "billing", "quota", "insufficient", "429",
    "usage limit", "rate limit", "limit reached",
)

# The longest description and error text the reference hands on; its parity queries pass them.
PROMPT_CHARS, ERROR_CHARS = 6000, 300

# The wording of a prompt.
NO_PLACE, NO_TEXT = "unspecified", "(no description captured for this source)"
ASK = 'Return ONLY JSON: {"score": <integer 0-10 fit>, "reason": "<one line>"}.'

# Our token columns and the names a reply gives them.
USAGE_FIELDS = {
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_read_tokens": "cache_read_input_tokens",
    "cache_write_tokens": "cache_creation_input_tokens",
}


def build_prompt(j, max_chars: int | None = None) -> Column:
    """The text a scorer gets for one listing. `j(name)` gives the column of that name.

    max_chars: the description is cut to so many characters; None hands on the whole text.
    """
    text = strip(F.coalesce(j("description"), F.lit("")))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    places = F.coalesce(
        F.when(F.size(j("locations")) > 0, F.nullif(F.array_join(j("locations"), ", "), F.lit(""))),
        F.nullif(j("location"), F.lit("")),
        F.lit(NO_PLACE),
    )
    return F.concat(
        F.lit("Company: "), F.coalesce(j("company"), F.lit("None")),
        F.lit("\nTitle: "), F.coalesce(j("title"), F.lit("None")),
        F.lit("\nLocation(s): "), places,
        F.lit("\n<job_description>\n"),
        F.when(text == "", NO_TEXT).otherwise(text),
        F.lit(f"\n</job_description>\n{ASK}"),
    )


def parse_reply(reply: Column) -> Column:
    """struct(score, reason): JSON, or the widest {...} span; null unless both fields are sound."""
    span = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    data = F.coalesce(F.try_parse_json(reply), F.try_parse_json(span))
    score = F.try_variant_get(data, "$.score", "double")
    kind = F.schema_of_variant(F.try_variant_get(data, "$.reason", "variant"))
    sound = (score == F.floor(score)) & (kind == "STRING")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))
    return F.when(sound, F.struct(
        clamped.alias("score"), F.try_variant_get(data, "$.reason", "string").alias("reason")))


def reply_envelope(envelope: Column, label: str = "scorer", max_error_chars: int | None = None) -> Column:
    """struct(result, error, four token counts, cost_usd) of a JSON reply envelope.

    max_error_chars: an error text is cut to so many characters; None keeps it whole.
    """
    env = F.try_parse_json(envelope)
    subtype = F.try_variant_get(env, "$.subtype", "string")
    # A flag counts when it is JSON-true, a non-zero number or a non-empty text.
    flag = F.coalesce(
        F.try_variant_get(env, "$.is_error", "boolean"),
        F.try_variant_get(env, "$.is_error", "string") != "", F.lit(False))
    failed = flag | (F.coalesce(subtype, F.lit("success")) != "success")
    result = F.try_variant_get(env, "$.result", "string")

    def message(text: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), text if max_error_chars is None else F.substring(text, 1, max_error_chars))

    said = F.nullif(strip(F.coalesce(envelope, F.lit(""))), F.lit(""))
    error = (
        F.when(env.isNull(), message(F.coalesce(said, F.lit("no output"))))
        .when(failed, message(F.coalesce(F.nullif(result, F.lit("")), F.lit("unknown error"))))
    )
    return F.struct(
        F.when(error.isNull(), F.coalesce(result, F.lit(""))).alias("result"), error.alias("error"),
        *[F.coalesce(F.try_variant_get(env, f"$.usage.{key}", "bigint"), F.lit(0)).alias(name)
          for name, key in USAGE_FIELDS.items()],
        F.try_variant_get(env, "$.total_cost_usd", "double").alias("cost_usd"),
    )


def token_cost(model: Column, tokens, prices: dict[str, tuple[float, float]] = PRICES) -> Column:
    """Estimated dollars of one call; a model without a price costs nothing."""
    billed_in = (tokens("input_tokens") + tokens("cache_read_tokens") * CACHE_READ
                 + tokens("cache_write_tokens") * CACHE_WRITE)
    cost = F.when(model.isNull(), 0.0)
    for name, (price_in, price_out) in prices.items():
        cost = cost.when(
            model == name,
            billed_in / 1e6 * price_in + tokens("output_tokens") / 1e6 * price_out)
    return cost.otherwise(0.0)


def error_class(kind: Column, message: Column) -> Column:
    """`auth`, `budget` or `other`; an auth sign outranks a budget sign. Null without an error."""
    low = F.lower(F.coalesce(message, F.lit("")))

    def says(phrases) -> Column:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        return hit

    named = F.coalesce(kind, F.lit(""))
    return (
        F.when(kind.isNull() & message.isNull(), F.lit(None).cast("string"))
        .when(named.isin(*AUTH_CLASSES) | says(AUTH_PHRASES), "auth")
        .when(named.isin(*BUDGET_CLASSES) | says(BUDGET_PHRASES), "budget")
        .otherwise("other")
    )
