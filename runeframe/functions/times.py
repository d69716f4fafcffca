"""Time stamps as the archive spells them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed spellings of one minute in the exports; slashed dates are month first.
TS_FORMATS = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy h:mm a")
MINUTE = "yyyy-MM-dd HH:mm"


def parse_minute(ts: Column) -> Column:
    """TIMESTAMP of a spelled time cut to the minute; NULL for null, blank or impossible times."""
    text = F.trim(ts)
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TS_FORMATS))
    return F.date_trunc("minute", parsed)


def spell_minute(moment: Column) -> Column:
    return F.date_format(moment, MINUTE)
