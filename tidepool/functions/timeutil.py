"""Session-time-zone independent time expressions.

Driver tables store ``timestamp`` without zone (NTZ, UTC wall clock).  These
helpers turn NTZ values and literal times into instants by arithmetic on
NTZ values, so results do not depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_epoch_micros(col: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (read as UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c.cast("timestamp_ntz"))


def ntz_to_instant(col: str | Column) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) to TIMESTAMP without the session zone."""
    return F.timestamp_micros(ntz_epoch_micros(col))


def literal_epoch_micros(wall_clock_utc: str) -> Column:
    """Epoch microseconds of a literal UTC wall-clock time ``YYYY-MM-DD HH:MM:SS``."""
    return ntz_epoch_micros(F.expr(f"TIMESTAMP_NTZ'{wall_clock_utc}'"))


def utc_wall_clock(epoch_seconds: int | Column) -> Column:
    """A TIMESTAMP_NTZ holding the UTC wall clock of epoch seconds (for formatting)."""
    secs = F.lit(epoch_seconds) if isinstance(epoch_seconds, int) else epoch_seconds
    return F.timestamp_add("SECOND", secs, F.expr(_EPOCH))
