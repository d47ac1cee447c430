"""Deadlines, late penalties, marks and test outcomes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grace of a test run's exit codes: fixed meanings.
EXIT_CODES = {0: "ok", 124: "timeout", 125: "infrastructure_error", 137: "out_of_memory"}


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def status_at(now: Column, start: Column, deadline: Column) -> Column:
    return F.when(now < start, "upcoming").when(now > deadline, "closed").otherwise("open")


def accept_until(deadline: Column, grace_minutes: Column, late_until: Column) -> Column:
    """The end of the grace period, or the late date if that is later; a null late date counts for nothing."""
    grace = deadline + F.make_dt_interval(mins=grace_minutes)
    return F.greatest(grace, late_until)


def lateness(at: Column, deadline: Column, grace_minutes: Column, unit: Column, rate: Column, cap: Column) -> dict[str, Column]:
    """late_seconds (from the deadline; null inside the grace period), percent and marks (one of them 0): rate for each day begun since
    the end of the grace period, at most cap."""
    after = seconds(at) - seconds(deadline)
    over = after - 60 * grace_minutes
    late, days = over > 0, F.ceil(over / 86400)
    loss = F.round(F.greatest(F.lit(0.0), F.least(days * rate, cap)), 2)
    return {
        "late_seconds": F.when(late, after),
        "percent": F.when(late & (unit == "percent"), F.least(loss, F.lit(100.0))).otherwise(F.lit(0.0)),
        "marks": F.when(late & (unit == "marks"), loss).otherwise(F.lit(0.0)),
    }


def final_mark(raw: Column, percent: Column, marks: Column) -> Column:
    """The raw mark less the penalty, at least 0, two digits; untouched without a penalty, null without a mark."""
    taken = F.floor(F.greatest(raw * (1 - percent / 100) - marks, F.lit(0.0)) * 100 + 0.5) / 100
    return F.when(raw.isNull() | ((percent == 0) & (marks == 0)), raw).otherwise(taken)


def exit_status(code: Column) -> Column:
    out = F.when(code.isNull(), "skipped")
    for number, name in EXIT_CODES.items():
        out = out.when(code == number, name)
    return out.otherwise("error")


def check_score(most: Column, met: Column, partly: Column, total: Column) -> Column:
    """most * (met + partly / 2) / total, within 0 and most."""
    return F.round(F.greatest(F.lit(0.0), F.least(most, most * (met + partly / 2) / F.greatest(total, F.lit(1)))), 2)


def seconds_left(end: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), seconds(end) - seconds(now))


def clock(total_seconds: Column) -> Column:
    """m:ss."""
    return F.format_string("%d:%02d", F.floor(total_seconds / 60), total_seconds % 60)
