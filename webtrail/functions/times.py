"""Times. An instant is whole seconds UTC; NULL means "could not be read".

Local time is always the instant plus the offset written in that very log line,
never a session zone or a zone name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clf_time(stamp: Column) -> Column:
    """``dd/Mon/yyyy:HH:MM:SS +zzzz`` as struct(epoch, tz); NULL if unreadable.

    The clock fields are plain arithmetic, so an hour of 24 or a leap second keeps
    its request dated.
    """
    day = F.try_to_date(F.substring(stamp, 1, 11), "dd/MMM/yyyy")
    hour = F.substring(stamp, 13, 2).try_cast("int")
    minute = F.substring(stamp, 16, 2).try_cast("int")
    second = F.substring(stamp, 19, 2).try_cast("int")
    zone = F.trim(F.substr(stamp, F.lit(22)))
    sign = F.substring(zone, 1, 1)
    east = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, -2, 2).try_cast("int") * 60
    shaped = (F.length(zone) == 5) | ((F.length(zone) == 6) & (F.substring(zone, 4, 1) == ":"))
    offset = F.when(shaped & (sign == "+"), east).when(shaped & (sign == "-"), -east).when(zone == "Z", F.lit(0))
    epoch = (F.unix_date(day).cast("long") * 86400 + hour * 3600 + minute * 60 + second - offset)
    return F.when(epoch.isNotNull(), F.struct(epoch.alias("epoch"), offset.cast("int").alias("tz")))


def local_seconds(epoch: Column, tz: Column) -> Column:
    return epoch + F.coalesce(tz, F.lit(0))


def local_day(epoch: Column, tz: Column) -> Column:
    """Local calendar day, NULL for an undated request."""
    return F.date_from_unix_date(F.floor(local_seconds(epoch, tz) / 86400).cast("int"))


def local_hour(epoch: Column, tz: Column) -> Column:
    """Local hour as a count of hours since 1970."""
    return F.floor(local_seconds(epoch, tz) / 3600).cast("long")


def log_reading(epoch: Column, tz: Column, mode: str = "log", clock_offset: int = 0) -> Column:
    """The instant in the frame that is shown: log-local or UTC, plus the analyst's
    correction of that clock. The only place a time is shifted."""
    shift = F.lit(0) if mode == "utc" else F.coalesce(tz, F.lit(0))
    return epoch + shift + F.lit(clock_offset)


def offset_label(tz: Column) -> Column:
    seconds = F.coalesce(tz, F.lit(0))
    minutes = F.floor(F.abs(seconds) / 60).cast("int")
    label = F.format_string(
        "UTC%s%02d:%02d",
        F.when(seconds < 0, "-").otherwise("+"),
        F.floor(minutes / 60).cast("int"),
        (minutes % 60).cast("int"),
    )
    return F.when(seconds == 0, "UTC").otherwise(label)


def render(value: Column, tz: Column, mode: str = "log") -> Column:
    """A time with the zone it is in; ``—`` when there is none."""
    stamp = F.date_format(F.timestamp_seconds(value), "yyyy-MM-dd HH:mm:ss")
    zone = F.lit("UTC") if mode == "utc" else offset_label(tz)
    return F.when(F.coalesce(value, F.lit(0)) == 0, "—").otherwise(F.concat_ws(" ", stamp, zone))


def naive_seconds(text: Column) -> Column:
    """Zone-less stamp text as seconds, read as it stands."""
    raw = F.substring(F.translate(F.trim(text), "T", " "), 1, 19)
    stamp = F.coalesce(
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm")),
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")),
    )
    return F.unix_seconds(stamp)


# How export tools write a date (English and German).
EXPORT_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
    "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy",
    "MMM dd, yyyy 'at' hh:mm a", "MMM dd, yyyy 'at' HH:mm",
    "dd. MMM yyyy 'um' HH:mm", "dd MMM yyyy 'at' hh:mm a",
)


def export_seconds(text: Column) -> Column:
    """The date in a database export's header as naive seconds."""
    raw = F.trim(text)
    return F.coalesce(*[F.unix_seconds(F.try_to_timestamp(raw, F.lit(f)))
                        for f in EXPORT_DATE_FORMATS])


def error_log_seconds(stamp: Column) -> Column:
    """Apache or Nginx error-log time as naive seconds. The weekday is dropped:
    the date parser does not read it, and it says nothing the date does not."""
    nginx = F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("yyyy/MM/dd HH:mm:ss"))
    plain = F.regexp_replace(F.regexp_replace(stamp, r"^\w{3} ", ""), r"(:\d{2})\.\d+ ", "$1 ")
    apache = F.try_to_timestamp(F.regexp_replace(plain, r" +", " "), F.lit("MMM d HH:mm:ss yyyy"))
    return F.unix_seconds(F.when(stamp.contains("/"), nginx).otherwise(apache))


def span_words(seconds: Column) -> Column:
    """``3 s``, ``47 min``, ``8 h``, ``23 d``: one unit, the biggest that fits."""
    whole = seconds.cast("long")
    return (
        F.when(whole < 90, F.concat(whole.cast("string"), F.lit(" s")))
        .when(whole < 5400, F.concat(F.floor(whole / 60).cast("string"), F.lit(" min")))
        .when(whole < 172800, F.concat(F.bround(whole / 3600, 0).cast("long").cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.bround(whole / 86400, 0).cast("long").cast("string"), F.lit(" d")))
    )


def three_digits(rate: Column) -> Column:
    """A rate below 100 with three significant digits and no trailing zeros."""
    rounded = F.lit(None).cast("double")
    for floor_value, digits in ((0.0, 6), (0.001, 5), (0.01, 4), (0.1, 3), (1.0, 2), (10.0, 1)):
        rounded = F.when(rate >= floor_value, F.bround(rate, digits)).otherwise(rounded)
    text = F.format_string("%.6f", rounded)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def login_rate(posts: Column, first: Column, last: Column) -> Column:
    """``over 23 d (0.2/h) ``, ``within one second `` or nothing without times."""
    span = last - first
    rate = posts / (span / 3600)
    shown = F.when(rate >= 100, F.format_number(F.bround(rate, 0).cast("long"), 0)).otherwise(three_digits(rate))
    return (
        F.when(first.isNull() | last.isNull(), F.lit(""))
        .when(span <= 0, F.lit("within one second "))
        .otherwise(F.concat(F.lit("over "), span_words(span), F.lit(" ("), shown, F.lit("/h) ")))
    )
