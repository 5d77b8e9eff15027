"""Rolling date windows. Computed on the driver and passed as literals, so plans never read the clock."""

from __future__ import annotations

import calendar
from datetime import date


def rolling_window(reference: date, years: int) -> tuple[date, date]:
    """The ``years`` years up to and including ``reference``; 29 February goes back to 28 February."""
    if isinstance(years, bool) or not isinstance(years, int) or years < 1:
        raise ValueError("years must be a whole number of at least 1")
    first = reference.year - years
    if first < 1:
        raise ValueError("the window would begin before year 1")
    return date(first, reference.month, min(reference.day, calendar.monthrange(first, reference.month)[1])), reference
