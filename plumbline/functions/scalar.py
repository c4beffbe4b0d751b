"""Column expressions that analyses share.  All are built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE = 90 * 86_400


def rounded(x: Column, digits: int = 1) -> Column:
    """Half away from zero in binary, for non-negative numbers; the built-in round works on decimal text."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def decay(ts: Column, as_of: int | Column, half_life: int = HALF_LIFE) -> Column:
    """A weight that halves with every half-life before ``as_of`` seconds."""
    return F.exp(-(F.lit(as_of) - ts) * (math.log(2) / half_life))


def steady_sum(n: Column, x: Column) -> Column:
    """The sum of ``n`` times ``x``, for x from 0 to 1, which no order of rows changes: whole numbers of 2^-30 and of 2^-60 are added (up to 2^33 in all)."""
    high = F.floor(x * 2**30)
    low = F.floor((x * 2**30 - high) * 2**30)
    return F.sum(n * high) / 2**30 + F.sum(n * low) / 2**60


def epoch(ts: Column) -> Column:
    """Seconds of a time column, with or without a zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def trend(recent: Column, older: Column, n: Column, low: Column, high: Column) -> Column:
    """Whether activity leans to the later half of its time: over 1.5 or under 0.67 to one, strictly."""
    ratio = F.when(older == 0, F.lit(math.inf)).otherwise(recent / F.when(older != 0, older))
    return F.when((n < 2) | (low == high), "stable").when(ratio > 1.5, "accelerating").when(ratio < 0.67, "cooling").otherwise("stable")


def exceeded(cyclomatic: Column, cognitive: Column, most_cyclomatic: int, most_cognitive: int) -> Column:
    a, b = cyclomatic > most_cyclomatic, cognitive > most_cognitive
    return F.when(a & b, "both").when(a, "cyclomatic").when(b, "cognitive")


def severity(cyclomatic: Column, cognitive: Column) -> Column:
    """The worse of two bands."""
    level = F.greatest(F.when(cyclomatic >= 50, 2).when(cyclomatic >= 30, 1).otherwise(0), F.when(cognitive >= 40, 2).when(cognitive >= 25, 1).otherwise(0))
    return F.when(level == 2, "critical").when(level == 1, "high").otherwise("medium")


def severity_rank(name: Column) -> Column:
    return F.when(name == "critical", 2).when(name == "high", 1).otherwise(0)


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 30, "medium").otherwise("low")


def efficiency_band(x: Column) -> Column:
    return F.when(x >= 40, "high").when(x >= 20, "medium").otherwise("low")


def relative(path: Column, base: str) -> Column:
    """The path below ``base``, unchanged if it isn't below it."""
    head = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_path(path: Column) -> Column:
    """Whether a project-relative path lies in a test folder."""
    return F.contains(F.concat(F.lit("/"), path), F.lit("/test/"))


def line_count(text: Column) -> Column:
    """Lines by line feeds; one after the last feed counts."""
    return F.size(F.split(text, "\n", -1))


def topic_key(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), " _", "--")


def counted(n: Column, noun: str) -> Column:
    """A number and its noun, with an s from two on."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n > 1, "s").otherwise(""))


def option_entries(text: Column) -> Column:
    """The entries of a comma-separated option, trimmed and in small letters."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def valid_ref(text: Column) -> Column:
    return text.rlike(r"^(?!-)[A-Za-z0-9._/@{}~^ \-]+\z")
