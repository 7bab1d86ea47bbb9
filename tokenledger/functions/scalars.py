"""Column functions: identifiers, model ids, fingerprints, calendar buckets, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of identifiers and times, and the names of what is unknown.
MESSAGE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
TOOL_NAME = r"^[A-Za-z][A-Za-z0-9_.-]{0,127}$"
MODEL_ID = r"^[A-Za-z0-9][A-Za-z0-9._:\[\]-]{0,127}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
UNKNOWN_MODEL, UNKNOWN_PROJECT, UNKNOWN_DATE = "<unknown>", "<unknown-project>", "<unknown-date>"

#: Fixed values, in the order they are taken off: context marker, region, vendor, revision, date.
MODEL_DECORATION = (r"\[1m\]$", r"^(us|eu|apac|us-gov)\.", r"^anthropic\.", r"-v\d+:\d+$", r"-\d{8}$")


def canonical_model(model: Column) -> Column:
    """Lower case without context marker, region and vendor prefix, revision and date suffix; '' for null."""
    m = F.lower(F.coalesce(model, F.lit("")))
    for pattern in MODEL_DECORATION:
        m = F.regexp_replace(m, pattern, "")
    return m


def model_key(model: Column) -> Column:
    m = canonical_model(model)
    return F.when(m == "", UNKNOWN_MODEL).otherwise(m)


def project_key(project: Column) -> Column:
    return F.coalesce(F.nullif(project, F.lit("")), F.lit(UNKNOWN_PROJECT))


def day_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(UNKNOWN_DATE))


def fingerprint(value: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), value), 256), 1, 12)


def if_matches(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(pattern), value)


def iso_timestamp(value: Column) -> Column:
    return F.when(value.rlike(ISO_TIME), F.try_to_timestamp(value))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is made once however often body names it (a plain column expression is made anew at each place)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def usd(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """Null, not zero, where there is nothing to divide by."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))
