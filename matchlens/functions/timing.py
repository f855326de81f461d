"""Time in whole microseconds since match start, and its windows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

# Window lengths (seconds) offered to users; any positive length works.
WINDOW_CHOICES = (15, 30, 45, 60, 90, 120)
DEFAULT_WINDOW = 60


def to_micros(seconds) -> int:
    """A driver-side length in seconds as whole microseconds."""
    return round(seconds * MICROS)


def window_micros(window_s) -> int:
    width = to_micros(window_s)
    if width <= 0:
        raise ValueError(f"window must be positive: {window_s!r}")
    return width


def interval_micros(interval: Column) -> Column:
    """A DAY-TIME interval as microseconds, exactly and whatever the session time zone."""
    seconds = F.extract(F.lit("SECOND"), interval)
    return (
        (
            (
                F.extract(F.lit("DAY"), interval).cast("bigint") * 24
                + F.extract(F.lit("HOUR"), interval)
            )
            * 60
            + F.extract(F.lit("MINUTE"), interval)
        )
        * (60 * MICROS)
        + (seconds * MICROS).cast("bigint")
    )


def int_div(value: Column, divisor: int) -> Column:
    """Integer division of non-negative BIGINTs, exact where ``/`` would round."""
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def ceil_div(value: Column, divisor: int) -> Column:
    return int_div(value + F.lit(divisor - 1).cast("bigint"), divisor)


def window_start(bin_: Column, window_s) -> Column:
    """Start of window number ``bin_``: BIGINT for whole-second windows, else DOUBLE."""
    if window_s == int(window_s):
        return bin_ * F.lit(int(window_s)).cast("bigint")
    return bin_ * F.lit(float(window_micros(window_s))) / float(MICROS)
