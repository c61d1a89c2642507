"""Settings arithmetic on columns: numbers with defaults and floors, timeouts, intervals, reviewer choice, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TIMEOUT_MS, LOCAL_TIMEOUT_MS, LEAST_TIMEOUT_MS = 15_000, 30_000, 1_000
# Reviewers in order of precedence, with the setting that turns each on.
REVIEWERS = (("gemini-2.5-flash", "gemini_key"), ("deepseek-v3", "deepseek_key"), ("ollama-gemma-3-4b", "ollama_host"))
LOCAL_REVIEWER, DISABLED = "ollama-gemma-3-4b", "disabled"


def leading_integer(text: Column) -> Column:
    """The integer that a text begins with, after white space; null if none. What a long can't hold is its nearest value."""
    digits = F.nullif(F.regexp_extract(text, "^\\s*([+-]?[0-9]+)", 1), F.lit(""))
    edge = F.when(digits.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(digits.isNotNull(), F.coalesce(digits.try_cast("long"), edge))


def number_setting(text: Column, default: int, floor: int | None = None) -> Column:
    """A number setting: 0, nothing and no number give the default, and the floor holds for all."""
    value = F.coalesce(F.nullif(leading_integer(text), F.lit(0).cast("long")), F.lit(default).cast("long"))
    return value if floor is None else F.greatest(F.lit(floor).cast("long"), value)


def reviewer(**settings: Column) -> Column:
    """The first reviewer whose setting isn't blank."""
    pairs = [(name, settings[key]) for name, key in REVIEWERS if key in settings]
    return reduce(lambda rest, p: F.when(F.trim(p[1]) != "", F.lit(p[0])).otherwise(rest), reversed(pairs), F.lit(DISABLED))


def outer_timeout_ms(name: Column, text: Column) -> Column:
    """How long a review may take in all; a local reviewer has more time."""
    given = leading_integer(text)
    base = F.when(given > 0, given).otherwise(F.lit(DEFAULT_TIMEOUT_MS).cast("long"))
    return F.when(name == LOCAL_REVIEWER, F.greatest(F.lit(LOCAL_TIMEOUT_MS).cast("long"), base)).otherwise(base)


def inner_timeout_ms(name: Column, text: Column) -> Column:
    """What a reviewer's own request may take; null leaves it to the reviewer. The setting only raises a local one's."""
    given = F.when(F.coalesce(text, F.lit("")) != "", number_setting(text, DEFAULT_TIMEOUT_MS, LEAST_TIMEOUT_MS))
    return F.when(name == LOCAL_REVIEWER, F.greatest(F.lit(LOCAL_TIMEOUT_MS).cast("long"), given)).otherwise(given)


def enabled(text: Column) -> Column:
    """Scans run unless the switch says exactly false."""
    return F.coalesce(text, F.lit("")) != "false"


def interval_text(ms: Column) -> Column:
    """Milliseconds as whole seconds in words, halves rounded up."""
    return F.concat(F.floor(ms / 1000 + 0.5).cast("long").cast("string"), F.lit(" seconds"))


def worker_id(host: Column, pid: Column, token: Column, prefix: Column | None = None) -> Column:
    """[prefix-]host:pid:token."""
    base = F.concat_ws(":", F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown-host")), pid.cast("string"), token)
    return base if prefix is None else F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("-"), base)).otherwise(base)


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def iso_instant(at: Column) -> Column:
    """UTC with milliseconds; the session's time zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def count_or_zero(text: Column) -> Column:
    """A number given as text; what isn't a finite number counts as 0."""
    value = F.expr("1").cast("double") * text.try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
