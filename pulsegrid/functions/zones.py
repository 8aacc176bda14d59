"""Offset intervals of time zones on the local clock, from the installed time zone database."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

FIRST_YEAR, LAST_YEAR = 1970, 2060
MICROS = 1_000_000


def _micros(moment: datetime) -> int:
    return int((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * MICROS


@lru_cache(maxsize=1024)
def utc_intervals(name: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> list[tuple[int, int, int, str]]:
    """(from, to, offset, abbreviation) in microseconds of UTC, in order and without holes."""
    zone = ZoneInfo(name)
    at = lambda t: (t.astimezone(zone).utcoffset(), t.astimezone(zone).tzname())
    begin, end = datetime(first_year, 1, 1, tzinfo=timezone.utc), datetime(last_year + 1, 1, 1, tzinfo=timezone.utc)
    out, since, now = [], begin, at(begin)
    step, t = timedelta(days=7), begin
    while t < end:
        ahead = min(t + step, end)
        if at(ahead) != now:
            low, high = t, ahead
            while high - low > timedelta(seconds=1):
                middle = low + timedelta(seconds=int((high - low).total_seconds()) // 2)
                low, high = (middle, high) if at(middle) == now else (low, middle)
            out.append((_micros(since), _micros(high), int(now[0].total_seconds()) * MICROS, now[1]))
            since, now = high, at(high)
            t = high
        else:
            t = ahead
    out.append((_micros(since), _micros(end), int(now[0].total_seconds()) * MICROS, now[1]))
    return out


def local_intervals(names: list[str], first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> list[tuple[str, int, int, int, int, int | None, str]]:
    """Rows (zone, local year, local from, local to, offset, other offset, kind), exploded by local year.

    kind ``one``: the clock reads these times once. ``two``: twice; there is a row for each offset, which names the other.
    ``none``: never, in the gap of a clock set forward; the offset is that before the gap. Times of a zone fall in one row, or
    in two rows of kind ``two``. The number of rows is bounded by the years and the transitions of the zone database.
    """
    rows = []
    for name in names:
        spans = utc_intervals(name, first_year, last_year)
        pieces: list[tuple[int, int, int, int | None, str]] = []
        for k, (start, stop, offset, _) in enumerate(spans):
            low, high = start + offset, stop + offset
            if k:
                before = spans[k - 1][2]
                if before > offset:  # set back: the first part is read twice
                    pieces.append((low, start + before, offset, before, "two"))
                    pieces.append((low, start + before, before, offset, "two"))
                    low = start + before
                elif before < offset:
                    pieces.append((start + before, low, before, None, "none"))
            if k + 1 < len(spans) and spans[k + 1][2] < offset:
                high = stop + spans[k + 1][2]
            if low < high:
                pieces.append((low, high, offset, None, "one"))
        for low, high, offset, other, kind in pieces:
            years = range((datetime(1970, 1, 1) + timedelta(microseconds=low)).year, (datetime(1970, 1, 1) + timedelta(microseconds=high - 1)).year + 1)
            rows += [(name, year, low, high, offset, other, kind) for year in years]
    return rows


def abbreviation_offsets(names: list[str]) -> dict[str, int]:
    """``zone|ABBREVIATION`` to its offset in microseconds; the latest meaning counts."""
    return {f"{name}|{short.upper()}": offset for name in names for _, _, offset, short in utc_intervals(name) if short[0].isalpha()}
