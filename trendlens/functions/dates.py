"""Date-string Column functions.

Publication dates stay ISO-8601 strings ('YYYY-MM-DDThh:mm:ssZ'); bounds are
compared as strings, exactly as the reference's database predicates did, so
'2001-11-01T..' <= '2001-11' is false and month bounds act half-open.
"""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_digits(pub_date) -> Column:
    """'2001-09-11T00:00:00Z' -> '20010911'."""
    return F.regexp_replace(F.split(_col(pub_date), "T").getItem(0), "-", "")


def date_string(y, m, d) -> Column:
    """(y, m, d) ints -> 'yyyymmdd' (no validity check)."""
    return F.format_string("%d%02d%02d", _col(y), _col(m), _col(d))


def date_parts(s) -> tuple[Column, Column, Column]:
    """'yyyymmdd' -> (year, month, day) ints."""
    c = _col(s)
    return (F.substring(c, 1, 4).cast("int"), F.substring(c, 5, 2).cast("int"),
            F.substring(c, 7, 1 << 20).cast("int"))


def month_key(pub_date) -> Column:
    return F.substring(_col(pub_date), 1, 7)


def day_key(pub_date) -> Column:
    return F.substring(_col(pub_date), 1, 10)


def day_bounds(pub_date, first: str, last: str) -> Column:
    """Days first..last ('yyyymmdd', both included) as bounds on the ISO string."""
    since = datetime.strptime(first, "%Y%m%d").date().isoformat()
    until = (datetime.strptime(last, "%Y%m%d").date() + timedelta(days=1)).isoformat()
    return (_col(pub_date) >= since) & (_col(pub_date) < until)


def month_start(month) -> Column:
    """'YYYY-MM' -> date of the first day."""
    return F.to_date(F.concat(_col(month), F.lit("-01")))


def next_month(month) -> Column:
    """'YYYY-MM' -> following 'YYYY-MM'."""
    return F.date_format(F.add_months(month_start(month), 1), "yyyy-MM")


def shift_back_weeks(month_date, interval: int) -> Column:
    """Month-end label moved back 2*interval weeks (pandas Week offset)."""
    return F.date_sub(F.last_day(_col(month_date)), 14 * interval)


def _check_months(start: str, end: str, extra: int) -> None:
    if len(start) != 7 or len(end) != 7:
        raise ValueError("months are 'YYYY-MM' strings")
    sy, sm = int(start[:4]), int(start[5:])
    ey, em = int(end[:4]), int(end[5:])
    if (ey * 12 + em) + extra < sy * 12 + sm:
        raise ValueError(f"month range {start}..{end} is empty")


def month_sequence_col(start, end, extra: int = 1) -> Column:
    """array<string> of months start..end plus ``extra`` trailing months."""
    seq = F.sequence(month_start(start), F.add_months(month_start(end), extra),
                     F.expr("interval 1 month"))
    return F.transform(seq, lambda d: F.date_format(d, "yyyy-MM"))


def month_sequence(df: DataFrame, start: str, end: str, extra: int = 1) -> DataFrame:
    """One row per month start..end (+extra) for each row of ``df`` (a dimension,
    e.g. the topics table), columns of ``df`` kept. The spine is generated, not
    joined, so it costs one explode per dimension row."""
    _check_months(start, end, extra)
    return df.select("*", F.explode(month_sequence_col(F.lit(start), F.lit(end), extra))
                     .alias("month"))


def normalise_vector(v) -> Column:
    """v / sum(v) for an array<double>; nulls where the sum is zero."""
    c = _col(v)
    total = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(c, lambda x: F.try_divide(x, total))


def weights_sum(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x)
