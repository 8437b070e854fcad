"""Scalar features of a bid request, as built-in column expressions.

Every function maps columns to a column; none starts a job or needs a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-part code for each range of hours, and for no hour at all.
DAY_PARTS = ((0, 5, 0.0), (6, 11, 1.0), (12, 16, 3.0), (17, 23, 4.0))
NO_DAY_PART = 5.0

# Ad sizes (as array text) under the code of their bucket.
SIZE_BUCKETS = {
    0.0: [
        "[288, 162]", "[291, 164]", "[300, 169]", "[306, 172]", "[328, 185]", "[343, 193]",
        "[358, 201]", "[380, 214]", "[569, 320]", "[600, 350]", "[640, 360]", "[1280, 720]",
    ],
    1.0: ["[320, 480]"],
    2.0: ["[300, 250]", "[320, 50]", "[320, 250]", "[325, 183]"],
    3.0: ["[480, 320]", "[610, 390]"],
    4.0: ["[500, 300]"],
    5.0: ["[768, 1024]"],
}
NO_SIZE_BUCKET = 6.0

# Operating-system families, in order of precedence.
OS_FAMILIES = ("android", "ios", "windows")


def located_code(city: Column) -> Column:
    return F.when(city.isNull(), 1.0).otherwise(2.0)


def located_name(city: Column) -> Column:
    return F.when(city.isNull(), "not located").otherwise("located")


def app_or_site_code(kind: Column) -> Column:
    """1.0 for ``site``; 2.0 for everything else, null included."""
    return F.when(kind.eqNullSafe("site"), 1.0).otherwise(2.0)


def label_double(label: Column) -> Column:
    return label.cast("double")


def label_int(label: Column) -> Column:
    return label.cast("int")


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


def os_family(os: Column) -> Column:
    """The first family named anywhere in ``os``; null and the rest: other."""
    family = F.lit("other")
    for name in reversed(OS_FAMILIES):
        family = F.when(contains_ignoring_case(os, name), name).otherwise(family)
    return family


def event_time(epoch_seconds: Column, zone: str = "UTC") -> Column:
    """Wall-clock time in ``zone``, whatever zone the session is in."""
    start = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    utc = start + F.make_dt_interval(secs=epoch_seconds)
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def event_date(time: Column) -> Column:
    return F.substring(time.cast("string"), 1, 10)


def event_clock(time: Column) -> Column:
    return F.substring(time.cast("string"), 12, 8)


def event_hour(epoch_seconds: Column, zone: str = "UTC") -> Column:
    if zone == "UTC":
        return F.floor(F.pmod(epoch_seconds, F.lit(86400)) / 3600).cast("int")
    return F.hour(event_time(epoch_seconds, zone))


def day_part(hour: Column) -> Column:
    code = F.lit(NO_DAY_PART)
    for first, last, value in reversed(DAY_PARTS):
        code = F.when(hour.between(first, last), value).otherwise(code)
    return code


def size_text(size: Column) -> Column:
    """``[w, h]``, the text form of the array."""
    return size.cast("string")


def size_bucket(text: Column) -> Column:
    code = F.lit(NO_SIZE_BUCKET)
    for value, sizes in SIZE_BUCKETS.items():
        code = F.when(text.isin(sizes), value).otherwise(code)
    return code


def predicted_click(prediction: Column) -> Column:
    """True for class 1, false for anything else."""
    return prediction.eqNullSafe(1.0)


def class_text(label: Column) -> Column:
    """The class as an ANOVA group name; null without a class."""
    return F.when(label == 1.0, "true").when(label.isNotNull(), "false")


def square(value: Column) -> Column:
    return value * value


def squared_deviation(value: Column, centre: Column) -> Column:
    return square(value - centre)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is zero."""
    return part / F.nullif(whole, F.lit(0.0))
