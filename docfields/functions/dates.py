"""Date text to dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Year 0000 is no year; a blank may stand for the leading zero of a day.
_YEAR = "(?!0000)[0-9]{4}"
_PART = "(?:[0-9]{1,2}| [1-9])"
_DATE = rf"^(?:{_YEAR}-[0-9]{{1,2}}-{_PART}|{_PART}/[0-9]{{1,2}}/{_YEAR}|[0-9]{{1,2}}/{_PART}/{_YEAR})\z"


def normalize_date(value: Column) -> Column:
    """Date of a text in ISO, else day/month/year, else month/day/year order; NULL if none fits."""
    text = F.replace(F.when(value.rlike(_DATE), value), F.lit("- "), F.lit("-"))
    day_first = F.regexp_replace(text, "^ ?([0-9]+)/([0-9]+)/([0-9]+)", "$3-$2-$1")
    month_first = F.regexp_replace(text, "^([0-9]+)/ ?([0-9]+)/([0-9]+)", "$3-$1-$2")
    return F.coalesce(day_first.try_cast("date"), month_first.try_cast("date"))
