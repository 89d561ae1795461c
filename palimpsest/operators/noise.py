"""Noise in a feed: changes that only a clock, a counter or a tracker made. Rows never go, they get a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What moves by itself on pages. No look-around, so that any SQL engine can run them.
RELATIVE = r"(?i)\b(just now|[0-9]+ (second|minute|hour|day|week|month|year)s? ago|yesterday|today)\b"
COUNTER = r"(?i)\b[0-9][0-9,.]*[km]? (views?|likes?|comments?|shares?|followers?|downloads?|visitors?|online|people viewing)\b"
COPYRIGHT = r"(?i)(©|\(c\)|copyright)"
FRESH = r"(?i)(last updated|last modified|updated on|page generated|as of)"
MOMENT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
CLOCK = r"\b[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\b"
CONSENT = r"(?i)(we use cookies|accept all cookies|cookie preferences|manage cookies|your privacy choices)"


def _same_without(old: Column, new: Column, pattern: str) -> Column:
    strip = lambda c: F.regexp_replace(c, pattern, "")
    return old.rlike(pattern) & new.rlike(pattern) & (strip(old) == strip(new))


def reason(old: Column, new: Column, kind: Column) -> Column:
    """The first rule that holds, or null."""
    both, one = kind == "modified", F.coalesce(old, new)
    year = lambda c: F.regexp_replace(c, "[0-9]{4}", "")
    moment = lambda c: F.regexp_replace(c, MOMENT, "")
    words = F.size(F.split(F.trim(one), r"\s+"))
    return (
        F.when(both & _same_without(old, new, RELATIVE), "relative_time").when(both & _same_without(old, new, COUNTER), "counter")
        .when(both & old.rlike(COPYRIGHT) & new.rlike(COPYRIGHT) & (year(old) == year(new)), "copyright_year").when(both & old.rlike(FRESH) & new.rlike(FRESH) & (moment(old) == moment(new)), "freshness")
        .when(both & _same_without(old, new, CLOCK), "clock").when(~both & (words <= 25) & one.rlike(CONSENT), "consent")
    )
