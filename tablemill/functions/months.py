"""Month labels such as ``MAR_2026`` and codes such as ``0326``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.errors import SpecError


def month_label(day: Column) -> Column:
    """Label of a date's own month, as ``MON_YYYY``."""
    return F.upper(F.date_format(day, "MMM_yyyy"))


def previous_month_label(day: Column) -> Column:
    """Label of the month before a date."""
    return month_label(F.add_months(day.cast("date"), -1))


def month_start(label: Column) -> Column:
    """First day of the month a label names; null when the text is not a label."""
    text = F.trim(label)
    return F.when(
        text.rlike(r"^[A-Za-z]{3}_\d{4}$"), F.try_to_timestamp(text, F.lit("MMM_yyyy")).cast("date")
    )


def month_code(label: Column) -> Column:
    """``MMYY`` code of a label."""
    return F.date_format(month_start(label), "MMyy")


def label_before(label: Column) -> Column:
    """Label of the month before the one a label names."""
    return previous_month_label(month_start(label))


def parse_month(text: str) -> dt.date | None:
    """First day of the month written as ``MAR_2026`` or ``0326``; None if it is neither."""
    for layout in ("%b_%Y", "%m%y"):
        try:
            return dt.datetime.strptime(text.strip(), layout).date()
        except ValueError:
            continue
    return None


def label_of_previous(day: dt.date) -> str:
    """Driver-side label of the month before ``day``."""
    last = day.replace(day=1) - dt.timedelta(days=1)
    return last.strftime("%b_%Y").upper()


def monthly_name(name: str, month: str | None) -> str:
    """Name of a monthly master object; other names pass through unchanged."""
    name = name.strip()
    lowered = name.lower()
    if lowered != "master" and not lowered.startswith("master_"):
        return name
    first = parse_month(month or "")
    if first is None:
        raise SpecError("A master object needs a month such as MAR_2026 or 0326.")
    return f"Master_{first:%m%y}"
