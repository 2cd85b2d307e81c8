"""Date / time column functions (DAT-*). Timestamps stay TIMESTAMP_NTZ, so
month and weekday never depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpulse import constants as K

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(col) -> Column:
    """DAT-1: ISO dates and times (blank or ``T`` between them, fractions and
    a zone allowed) as written, anything else null.

    Text goes straight to TIMESTAMP_NTZ, so no session zone shifts it; a zone
    in the text is dropped. Typed timestamps keep their local time.
    """
    return F.trim(_c(col).cast("string")).try_cast("timestamp_ntz")


def season(month_col) -> Column:
    """DAT-6: academic season name for a month number (null stays null)."""
    m = _c(month_col)
    expr = None
    for month, name in K.SEASON_OF_MONTH.items():
        expr = F.when(m == month, name) if expr is None else expr.when(m == month, name)
    return expr


def season_ordinal(season_col) -> Column:
    s = _c(season_col)
    expr = None
    for i, name in enumerate(K.SEASON_ORDER):
        expr = F.when(s == name, i) if expr is None else expr.when(s == name, i)
    return expr


def weekday_name(ts_col) -> Column:
    """DAT-4: English weekday name, e.g. ``Monday``."""
    return F.date_format(_c(ts_col), "EEEE")


def weekday_num(ts_col) -> Column:
    """DAT-5: Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts_col))


def month_start(year_col, month_col) -> Column:
    """DAT-3: first day of the month."""
    return F.make_date(_c(year_col), _c(month_col), F.lit(1))


def period_label(month_col) -> Column:
    """STR-16: zero-padded month, ``01`` .. ``12``."""
    return F.lpad(_c(month_col).cast("string"), 2, "0")


def month_label_fr(month_col) -> Column:
    """DAT-7: French month label."""
    m = _c(month_col)
    expr = None
    for i, name in enumerate(K.MONTH_LABELS_FR, start=1):
        expr = F.when(m == i, name) if expr is None else expr.when(m == i, name)
    return expr
