"""Time and retention arithmetic on epoch milliseconds. The clock is always an argument."""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.errors import ValidationError
from engram.schemas import DAY_MS, FORGET_GRACE_DAYS, TTL_DAYS


def ttl_ms(importance: Column) -> Column:
    """Time to live by importance; null outside 1..5."""
    table = F.create_map(*(x for k, d in sorted(TTL_DAYS.items()) for x in (F.lit(k), F.lit(d * DAY_MS).cast("long"))))
    return F.try_element_at(table, importance.cast("int"))


def ttl_ms_for(importance: int) -> int:
    if isinstance(importance, bool) or importance not in TTL_DAYS:
        raise ValidationError(f"importance must be in 1..5, got {importance!r}")
    return TTL_DAYS[importance] * DAY_MS


def expires_at(importance: Column, now_ms: Column | int) -> Column:
    return _ms(now_ms) + ttl_ms(importance)


def clamped_expiry(expires: Column, now_ms: Column | int) -> Column:
    """A forgotten record's expiry: the grace period's end, if that comes first."""
    return F.least(expires, _ms(now_ms) + F.lit(FORGET_GRACE_DAYS * DAY_MS))


def timeline_day(ms: Column, tz: str = "UTC") -> Column:
    """Diary day in ``tz``; the session's zone must be UTC."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), tz), "yyyy-MM-dd")


def timeline_day_for(ms: int, tz: str = "UTC") -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).astimezone(ZoneInfo(tz)).strftime("%Y-%m-%d")


def iso(ms: int | None, tz: str = "UTC") -> str | None:
    """ISO 8601 with offset; a fraction only where there is one."""
    return None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).astimezone(ZoneInfo(tz)).isoformat()


def iso_column(ms: Column, tz: str = "UTC") -> Column:
    """``iso``, native; the session's zone must be UTC."""
    ts = F.from_utc_timestamp(F.timestamp_millis(ms), tz)
    ahead = F.floor((F.unix_millis(ts) - ms) / 60_000)  # minutes
    offset = F.concat(F.when(ahead < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(ahead) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(ahead) % 60).cast("string"), 2, "0"))
    fraction = F.when(F.pmod(ms, F.lit(1000)) == 0, F.lit("")).otherwise(F.date_format(ts, ".SSS000"))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, offset)


def _ms(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x)).cast("long")
