"""Derived views of a record's front matter: lifecycle, trust, staleness, description, intensity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIFECYCLE = ("draft", "stable", "deprecated")
INTENSITY = ("on", "ongoing", "simmering", "sleeping")


def _plain(value: Column) -> Column:
    return F.lower(F.trim(value))


def lifecycle(status: Column, draft: Column) -> Column:
    """struct(status, known): a status outside the set reads as stable and isn't known, unless it is an intensity."""
    s = _plain(status)
    listed = F.coalesce(s.isin(*LIFECYCLE), F.lit(False))
    is_draft = F.coalesce(_plain(draft).isin("true", "yes"), F.lit(False))
    empty = s.isNull() | (s == "") | s.isin(*INTENSITY)
    return F.when(listed, F.struct(s.alias("status"), F.lit(True).alias("known"))).when(is_draft, F.struct(F.lit("draft").alias("status"), F.lit(True).alias("known"))).otherwise(
        F.struct(F.lit("stable").alias("status"), empty.alias("known")))


def intensity(value: Column, status: Column) -> Column:
    """A given intensity, `true` being what YAML makes of an unquoted `on`; else a status that is one."""
    v, s = F.trim(value), _plain(status)
    return F.when(F.lower(v) == "true", "on").when(v != "", v).when(s == "true", "on").when(s.isin(*INTENSITY), s).otherwise("")


def trust(verified_by: Column) -> Column:
    """From the `by` of each verification event."""
    named = F.filter(verified_by, lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.size(named) <= 0, "unverified").when(F.exists(named, lambda x: F.startswith(x, F.lit("human:"))), "human-reviewed").otherwise("machine-confirmed")


def description(text: Column, legacy: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.nullif(F.trim(legacy), F.lit("")), F.lit(""))


def instant(value: Column) -> Column:
    """An ISO instant or day as a timestamp; anything else is null."""
    v = F.trim(value)
    return F.coalesce(F.try_to_timestamp(v), F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")))


def stale(after: Column, legacy: Column, now: Column) -> Column:
    moment = F.coalesce(instant(after), instant(legacy))
    return F.coalesce(now >= moment, F.lit(False))
