"""Dates in metadata fields and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stem

# Label, pattern, whether it has a time; in order of precedence. Groups: year, month, day, hour, minute, second.
NAME_PATTERNS = (
    ("filename:whatsapp", "(?i)^(?:IMG|VID)-(\\d{4})(\\d{2})(\\d{2})-WA\\d+$", False),
    ("filename:signal", "(?i)^signal-(\\d{4})-(\\d{2})-(\\d{2})-(\\d{2})-(\\d{2})-(\\d{2})", True),
    ("filename:telegram", "(?i)^photo_(\\d{4})-(\\d{2})-(\\d{2})_(\\d{2})-(\\d{2})-(\\d{2})", True),
    ("filename:pixel", "(?i)^PXL_(\\d{4})(\\d{2})(\\d{2})_(\\d{2})(\\d{2})(\\d{2})", True),
    ("filename:screenshot", "(?i)^Screenshot[_-](\\d{4})-?(\\d{2})-?(\\d{2})[-_](\\d{2})-?(\\d{2})-?(\\d{2})", True),
    ("filename:android", "(?i)^(?:IMG|VID|MVIMG)?_?(\\d{4})-?(\\d{2})-?(\\d{2})[_-](\\d{2})-?(\\d{2})-?(\\d{2})", True),
    ("filename:date-only", "(?:^|[^0-9])((?:19|20)\\d{2})[-_]?(0[1-9]|1[0-2])[-_]?(0[1-9]|[12]\\d|3[01])(?:$|[^0-9])", False),
)


def strict_timestamp(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """A timestamp without zone; null unless every part is in its range (second 60 and year 0 are not)."""
    fine = (y >= 1) & s.between(0, 59)
    return F.when(fine, F.try_make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(16,6)")))


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def name_date(name: Column) -> Column:
    """struct(ts, label) of the first pattern that gives a valid date; dates alone are at noon; null if none.

    Each pattern runs once: it leaves a mark and the fourteen digits of a time, or the name as it was.
    """
    s, found = stem(name), []
    for label, pattern, timed in NAME_PATTERNS:
        flags, _, rest = pattern.rpartition("(?i)")
        digits = "$1$2$3$4$5$6" if timed else "$1$2$3120000"
        found.append(F.struct(F.regexp_replace(s, f"(?s{'i' if flags or pattern.startswith('(?i)') else ''})^{'' if rest.startswith('^') else '.*?'}{rest}.*$", f"\u0001{digits}").alias("x"), F.lit(label).alias("label")))

    def parsed(p: Column) -> Column:
        part = lambda at, n: F.substring(p["x"], at + 2, n).try_cast("int")
        ts = strict_timestamp(part(0, 4), part(4, 2), part(6, 2), part(8, 2), part(10, 2), part(12, 2))
        return F.struct(F.when(p["x"].startswith("\u0001"), ts).alias("ts"), p["label"].alias("label"))

    return F.get(F.filter(F.transform(F.array(*found), parsed), lambda p: p["ts"].isNotNull()), F.lit(0))


def exif_datetime(original: Column, created: Column) -> Column:
    """Minute resolution; seconds and zone are dropped. A second field counts only where the first is null or empty."""
    text = F.coalesce(F.nullif(original, F.lit("")), created)
    clean = F.replace(F.replace(text, F.lit("-"), F.lit(":")), F.lit("T"), F.lit(" "))
    pattern = "^\\s*(\\d+)\\s*:\\s*(\\d+)\\s*:\\s*(\\d+)\\s+(\\d+)(?:\\s[^:]*)?:\\s*(\\d+)\\s*(?:[.+:].*)?$"
    parts = [_int(clean, pattern, k) for k in range(1, 6)]
    return F.when(F.length(text) >= 10, strict_timestamp(*parts, F.lit(0)))


def exif_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy:MM:dd HH:mm:ss")


def from_sources(name: Column, mtime: Column, sources: list[str]) -> Column:
    """struct(ts, label) of the first source that has a date; sources are filename and mtime."""
    if unknown := set(sources) - {"filename", "mtime"}:
        raise ValueError(f"unknown date sources: {sorted(unknown)}")
    made = {"filename": name_date(name), "mtime": F.when(mtime.isNotNull(), F.struct(mtime.cast("timestamp_ntz").alias("ts"), F.lit("mtime").alias("label")))}
    return F.coalesce(*[made[s] for s in sources])


def micros(ts: Column, zoneless: bool = True) -> Column:
    """Microseconds from a fixed origin. Of a time without zone, those of a calendar in which every day has 24 hours; the
    session's zone plays no part."""
    if not zoneless:
        return F.unix_micros(ts)
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
    return day + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECONDS"), ts) * 1_000_000).cast("long")
