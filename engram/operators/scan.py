"""Live scans, filters, listings and projections."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.errors import ValidationError
from engram.functions.clock import iso_column
from engram.functions.text import recent_line
from engram.schemas import AUDIT_DEFAULT, AUDIT_MAX, DAY_MS, PREVIEW, RECENT_DEFAULT, RECENT_MAX

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Filters:
    """Optional narrowing of a live scan; bounds are inclusive."""

    topic: str | None = None
    catalog: str | None = None
    since_ms: int | None = None
    until_ms: int | None = None
    timeline_day: str | None = None
    min_importance: int | None = None

    def __post_init__(self) -> None:
        for name in ("topic", "catalog"):
            value = getattr(self, name)
            if value is not None and not value.strip():
                raise ValidationError(f"{name} must not be blank")
        if self.since_ms is not None and self.until_ms is not None and self.since_ms > self.until_ms:
            raise ValidationError("since must not be after until")
        if self.timeline_day is not None and not _DAY.fullmatch(self.timeline_day):
            raise ValidationError("timeline_day must be YYYY-MM-DD")
        if self.min_importance is not None and (isinstance(self.min_importance, bool) or not 1 <= self.min_importance <= 5):
            raise ValidationError("min_importance must be in 1..5")

    @classmethod
    def of(cls, *, now_ms: int, days: int | None = None, **rest: object) -> Filters:
        """``days`` counts back from now."""
        if days is None:
            return cls(**rest)
        if isinstance(days, bool) or not isinstance(days, int) or days < 1:
            raise ValidationError("days must be a positive integer")
        return cls(since_ms=now_ms - days * DAY_MS, **rest)

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.topic is not None:
            out &= F.col("topic") == self.topic
        if self.catalog is not None:
            out &= F.col("catalog") == self.catalog
        if self.since_ms is not None:
            out &= F.col("created_at_ms") >= self.since_ms
        if self.until_ms is not None:
            out &= F.col("created_at_ms") <= self.until_ms
        if self.timeline_day is not None:
            out &= F.col("timeline_day") == self.timeline_day
        if self.min_importance is not None:
            out &= F.col("importance") >= self.min_importance
        return out


def is_live(now_ms: int) -> Column:
    """Not deleted, and expiring after now (expiring now is dead)."""
    return F.col("deleted_at_ms").isNull() & (F.col("expires_at_ms") > now_ms)


def live(memories: DataFrame, *, now_ms: int, brain_id: str | None = None, filters: Filters | None = None) -> DataFrame:
    """The rows that a reader may see. ``brain_id`` is left out only where queries carry it."""
    where = is_live(now_ms)
    if brain_id is not None:
        where = (F.col("brain_id") == brain_id) & where
    return memories.where(where & (filters or Filters()).predicate())


def limit_in(value: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValidationError(f"limit must be in 1..{most}")
    return value


def get(memories: DataFrame, memory_id: str, *, brain_id: str, now_ms: int) -> DataFrame:
    """At most one row; unknown, expired, deleted and foreign ids are alike."""
    return live(memories, now_ms=now_ms, brain_id=brain_id).where(F.col("memory_id") == memory_id).limit(1)


def get_many(memories: DataFrame, keys: DataFrame, *, now_ms: int) -> DataFrame:
    """Live rows of the keys (brain_id, memory_id)."""
    return live(memories, now_ms=now_ms).join(keys.select("brain_id", "memory_id"), ["brain_id", "memory_id"], "left_semi")


def recent(memories: DataFrame, *, brain_id: str, now_ms: int, limit: int = RECENT_DEFAULT, filters: Filters | None = None) -> DataFrame:
    """Newest first, ties by id; filters come before the limit."""
    return live(memories, now_ms=now_ms, brain_id=brain_id, filters=filters).orderBy(F.desc("created_at_ms"), "memory_id").limit(limit_in(limit, RECENT_MAX))


def preview(memories: DataFrame) -> DataFrame:
    """What lists show: never the content, only whether there is any."""
    return memories.withColumn("has_content", F.length("content") > 0).select(*PREVIEW)


def detail(memories: DataFrame, *, tz: str = "UTC") -> DataFrame:
    """All of a record; times are ISO 8601 in ``tz``."""
    times = ("created_at_ms", "updated_at_ms", "expires_at_ms", "period_start_ms", "period_end_ms")
    return memories.select(
        *(c for c in PREVIEW if c != "has_content"),
        (F.length("content") > 0).alias("has_content"),
        "content",
        "agent_id",
        "metadata",
        *(iso_column(F.col(c), tz).alias(c.removesuffix("_ms")) for c in times),
    )


def lines(memories: DataFrame) -> DataFrame:
    return memories.select("memory_id", recent_line(F.col("timeline_day"), F.col("catalog"), F.col("topic"), F.col("summary")).alias("line"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def audit_day(events: DataFrame, day: str, *, brain_id: str, limit: int = AUDIT_DEFAULT) -> DataFrame:
    """A brain's events of a day, newest first."""
    if not _DAY.fullmatch(day):
        raise ValidationError("day must be YYYY-MM-DD")
    return events.where((F.col("brain_id") == brain_id) & (F.col("timeline_day") == day)).orderBy(F.desc("event_at_ms"), F.desc("event_id")).limit(limit_in(limit, AUDIT_MAX))
