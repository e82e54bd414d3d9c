"""Zone-free timestamp expressions (TIMESTAMP_NTZ throughout)."""

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F


def ntz(text: str) -> Column:
    """Literal timestamp without zone; a plain date means its midnight."""
    return F.lit(text).cast("timestamp_ntz")


def epoch_ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds as a naive UTC timestamp, whatever the session zone is."""
    return F.timestamp_add("MILLISECOND", ms, ntz("1970-01-01"))


def ts_to_epoch_ms(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", ntz("1970-01-01"), ts)


def epoch_ms(text: str) -> int:
    """Driver-side epoch milliseconds of an ISO date or timestamp (naive UTC)."""
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


PLAIN_DATE = r"^\d{4}-\d{2}-\d{2}$"


def plain_date(text: Column) -> Column:
    """The date of a YYYY-MM-DD text; null for anything else, a time of day included."""
    return F.when(text.rlike(PLAIN_DATE), text.try_cast("date"))


def is_plain_date(text: str) -> bool:
    """The same rule on the driver."""
    try:
        return datetime.strptime(text, "%Y-%m-%d").strftime("%Y-%m-%d") == text
    except ValueError:
        return False


def bad_dates(start: Column, end: Column) -> Column:
    """True if both ends are given and one of them is no plain date."""
    given = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
    return given & (plain_date(start).isNull() | plain_date(end).isNull())


def is_midnight(ts: Column) -> Column:
    return ts == F.date_trunc("DAY", ts).cast("timestamp_ntz")
