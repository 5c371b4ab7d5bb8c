"""Dates: fiscal labels, layout-tolerant parsing, range and window arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlake.functions.text import _col, collapse_spaces, let, strip, trimmed

DEFAULT_LOOKBACK = 20
WINDOW_DAYS = 31

# Accepted date layouts as (shape, pattern). The shape keeps the parser from
# raising on text of another layout, which would cost far more than the regular expression.
D, DD, MON, MONTH = r"\d{1,2}", r"\d{2}", r"[A-Za-z]{3}", r"[A-Za-z]{3,9}"
ISO_DAY = (rf"\d{{4}}-{DD}-{DD}", "yyyy-MM-dd")
SLASH_DAY = (rf"{D}/{DD}/\d{{4}}", "d/MM/yyyy")
SLASH_ANY = (rf"{D}/{D}/\d{{4}}", "d/M/yyyy")
SLASH_STRICT = (rf"{DD}/{DD}/\d{{4}}", "dd/MM/yyyy")
DASH_DAY = (rf"{D}-{DD}-\d{{4}}", "d-MM-yyyy")
SPACE_MON = (rf"{D} {MON} \d{{4}}", "d MMM yyyy")
SPACE_MONTH = (rf"{D} {MONTH} \d{{4}}", "d MMMM yyyy")
DASH_MON = (rf"{D}-{MON}-\d{{4}}", "d-MMM-yyyy")
DASH_MON_SHORT = (rf"{D}-{MON}-{DD}", "d-MMM-yy")
MON_FIRST = (rf"{MON} {D} \d{{4}}", "MMM d yyyy")
MONTH_FIRST = (rf"{MONTH} {D} \d{{4}}", "MMMM d yyyy")

# Every text that a cast reads as a finite number; casting other texts raises an error inside, which costs far more than the test.
NUMBER = (
    r"[\x00-\x20]*[+-]?(?:[0-9.]+(?:[eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F.]+[pP][+-]?[0-9]+)[fFdD]?[\x00-\x20]*"
)

# Seconds of 1899-12-30, day zero of spreadsheet serials.
SERIAL_EPOCH = -2209161600

RFC3339 = rf"\d{{4}}-{DD}-{DD}T{DD}:{DD}:{DD}(?:\.\d+)?(?:Z|[+-]{DD}:{DD})"
CATALOGUE_TIME = rf"\d{{4}}-{DD}-{DD}T{DD}:{DD}:{DD}(?:\.\d+)?"


def financial_year(c: Column | str) -> Column:
    """July-start label such as 2024-25."""
    start = F.year(F.add_months(_col(c), -6))
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def month_label(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec "


def _timestamp_of(t: Column, pattern: str) -> Column:
    """A text that has the shape of the pattern as a timestamp, NULL for a day that does not exist.

    Days in three parts are put together from their parts, which takes a fraction of the time of a formatter.
    """
    mark = next((m for m in "/- " if pattern.count(m) == 2), None)
    parts = pattern.split(mark) if mark else []
    place = {part[0]: (k, part) for k, part in enumerate(parts)}
    if set(place) != {"d", "M", "y"} or place["y"][1] != "yyyy" or place["M"][1] == "MMMM":
        return F.try_to_timestamp(t, F.lit(pattern))
    day, month, year = (F.split_part(t, F.lit(mark), F.lit(place[c][0] + 1)) for c in "dMy")
    if place["M"][1] == "MMM":
        at = F.instr(F.lit(_MONTHS), F.concat(F.lower(month), F.lit(" ")))
        number = F.when(at % 4 == 1, (at + 3) / 4).cast("int")
    else:
        number = month.try_cast("int")
    zero = F.lit(0)
    return F.try_make_timestamp(year.try_cast("int"), number, day.try_cast("int"), zero, zero, zero)


def _parse(text: Column, layouts: list[tuple[str, str]]) -> Column:
    def first_fit(t: Column) -> Column:
        tries = []
        for shape, pattern in layouts:
            parsed = _timestamp_of(t, pattern)
            if pattern.endswith("-yy"):
                # Two-digit years from 69 on belong to the last century.
                parsed = F.when(F.year(parsed) >= 2069, parsed - F.expr("INTERVAL '100' YEAR")).otherwise(parsed)
            tries.append(F.when(t.rlike(f"^{shape}$"), parsed))
        return F.coalesce(*tries)

    return let(text, first_fit)


def parse_rfc3339(c: Column | str) -> Column:
    text = _col(c)
    return F.when(text.rlike(f"^{RFC3339}$"), text.try_cast("timestamp"))


def parse_date_nsw(c: Column | str) -> Column:
    return _parse(let(_col(c), trimmed), [DASH_MON, DASH_MON_SHORT])


def parse_date_vic(c: Column | str) -> Column:
    return _parse(let(_col(c), trimmed), [SPACE_MON, SPACE_MONTH])


def parse_date_sa(c: Column | str) -> Column:
    text = F.regexp_replace(collapse_spaces(c), r"\bSept\b", "Sep")
    return _parse(text, [SLASH_ANY, ISO_DAY, SPACE_MON, SPACE_MONTH, DASH_MON])


def parse_date_wa(c: Column | str) -> Column:
    return _parse(let(_col(c), trimmed), [ISO_DAY, SLASH_STRICT])


def parse_date_qld(c: Column | str) -> Column:
    """Spreadsheet serials, then text layouts with an optional midnight suffix."""
    layouts = [ISO_DAY, SLASH_DAY, DASH_DAY, SPACE_MON, DASH_MON, MON_FIRST, MONTH_FIRST]

    def parse(text: Column) -> Column:
        serial = F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double"))
        hours = F.floor(serial * 24).cast("long")
        from_serial = F.timestamp_seconds(F.lit(SERIAL_EPOCH) + hours * 3600)
        # The text is stripped, so nothing but a midnight can be cut off its end.
        midnight = F.regexp_replace(text, r"(?U)\s*(?:00:00:00)?\s*(?:00:00)?$", "")
        day = F.when(text.endswith("00:00"), midnight).otherwise(text)
        return F.when((serial >= 20000) & (serial <= 80000), from_serial).otherwise(
            let(day, lambda d: F.coalesce(parse_rfc3339(d), _parse(d, layouts)))
        )

    return let(strip(c), parse)


def parse_catalogue_time(c: Column | str) -> Column:
    text = strip(c)
    local = F.when(text.rlike(f"^{CATALOGUE_TIME}$"), text.try_cast("timestamp"))
    return F.coalesce(parse_rfc3339(text), local, _parse(text, [ISO_DAY]))


def parse_user_date(c: Column | str) -> Column:
    """RFC 3339 or a plain day; NULL for blank and for anything else (see ``is_bad_user_date``)."""
    text = _col(c)
    return F.coalesce(parse_rfc3339(text), _parse(text, [ISO_DAY]))


def is_bad_user_date(c: Column | str) -> Column:
    text = F.coalesce(_col(c), F.lit(""))
    return (strip(text) != "") & parse_user_date(text).isNull()


def contract_period(c: Column | str) -> Column:
    """struct(start, end) of a "<day> to <day>" text."""
    parts = F.split(strip(c), " to ")
    ok = F.size(parts) == 2
    return F.struct(
        F.when(ok, parse_date_nsw(F.get(parts, F.lit(0)))).alias("start"),
        F.when(ok, parse_date_nsw(F.get(parts, F.lit(1)))).alias("end"),
    )


def years_before(day: Column, years: Column | int) -> Column:
    """Same day of an earlier year; 29 February becomes 1 March."""
    years = F.lit(years) if isinstance(years, int) else years
    first = F.make_date(F.year(day) - years, F.month(day), F.lit(1))
    return F.date_add(first, F.dayofmonth(day) - 1)


def resolve_range(start: Column, end: Column, now: Column, lookback: Column | int | None = None) -> Column:
    """struct(start, end) of days: defaults filled in from ``now`` and the lookback, order fixed."""
    years = F.lit(lookback) if lookback is None or isinstance(lookback, int) else lookback
    years = F.coalesce(F.when(years > 0, years), F.lit(DEFAULT_LOOKBACK)).cast("int")
    last = F.coalesce(end, now).cast("date")
    first = F.coalesce(start.cast("date"), years_before(last, years))
    return F.struct(F.least(first, last).alias("start"), F.greatest(first, last).alias("end"))


def day_windows(start: Column, end: Column, days: int = WINDOW_DAYS) -> Column:
    """array<struct(start, end)> of fixed-length windows; each end is the next start."""
    start, end = start.cast("date"), end.cast("date")
    span = F.datediff(end, start)
    steps = F.sequence(F.lit(0), F.greatest(span - 1, F.lit(0)), F.lit(days))
    return F.when(
        span > 0,
        F.transform(
            steps,
            lambda n: F.struct(
                F.date_add(start, n).alias("start"),
                F.least(F.date_add(start, n + days), end).alias("end"),
            ),
        ),
    ).otherwise(F.array(F.struct(start.alias("start"), end.alias("end"))))


def month_windows(start: Column, end: Column) -> Column:
    """array<struct(start, end)> of calendar months clipped to the range, both ends inclusive."""
    start, end = start.cast("date"), end.cast("date")
    first = F.trunc(start, "MM")
    steps = F.sequence(first, F.greatest(end, first), F.expr("INTERVAL 1 MONTH"))
    return F.when(
        end > start,
        F.transform(
            steps,
            lambda m: F.struct(
                F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end")
            ),
        ),
    ).otherwise(F.array(F.struct(start.alias("start"), end.alias("end"))))


def local_day(ts: Column | str, zone: str = "Australia/Sydney") -> Column:
    """struct(day, expires): the local calendar day and the instant of the next local midnight."""
    local = F.from_utc_timestamp(_col(ts), zone)
    day = F.to_date(local)
    midnight = F.date_add(day, 1).cast("timestamp")
    return F.struct(day.alias("day"), F.to_utc_timestamp(midnight, zone).alias("expires"))
