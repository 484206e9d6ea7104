"""Column expressions.  All of them are built-in Spark columns, no UDFs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the characters that a JavaScript trim() removes.
JS_BLANKS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# Texts that JavaScript's Number() reads, and the radix of each form.
JS_NUMBERS = {
    10: r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)",
    16: r"0[xX]0*([1-9a-fA-F][0-9a-fA-F]*)",
    8: r"0[oO]0*([1-7][0-7]*)",
    2: r"0[bB]0*(1[01]*)",
}
PLAIN_POSITIVE = r"\+?0*([1-9]\d{0,17})(?:\.0*)?"


def moment(as_of: str | datetime | Column, like: DataFrame | None = None, column: str = "updated_at") -> Column:
    """``as_of`` as a timestamp column, of the type ``like[column]`` has, if given.

    Text such as ``'1998-06-15 00:00:00'`` is read without a time zone, so the
    result does not depend on the Python process' zone.
    """
    if isinstance(as_of, Column):
        value = as_of
    elif isinstance(as_of, datetime):
        value = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f"))
    else:
        value = F.lit(as_of)
    value = value.cast("timestamp_ntz")
    if like is not None and column in like.columns:
        value = value.cast(like.schema[column].dataType)
    return value


def touch(df: DataFrame, changed: Column, as_of) -> Column:
    """New ``updated_at``: ``as_of`` on rows that changed, the old value elsewhere."""
    now = moment(as_of, df)
    if "updated_at" not in df.columns:
        return F.when(changed, now)
    return F.when(changed, now).otherwise(F.col("updated_at"))


def epoch_micros(df: DataFrame, column: str) -> Column:
    """A timestamp as microseconds, in order.

    One without time zone is taken apart by the calendar: a cast to an instant would
    follow the session's zone, where daylight saving turns an hour's order round.
    """
    value = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_micros(value)
    seconds = F.unix_date(value.cast("date")) * F.lit(86_400).cast("bigint") + F.hour(value) * 3600 + F.minute(value) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("bigint")


def is_true(column: str | Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(_col(column), F.lit(False))


def not_false(column: str | Column) -> Column:
    """NULL counts as true."""
    return F.coalesce(_col(column), F.lit(True))


def lower_or_empty(column: str | Column) -> Column:
    return F.lower(F.coalesce(_col(column), F.lit("")))


def positive(column: str | Column) -> Column:
    """``coalesce(x, 0) > 0``: never NULL."""
    return F.coalesce(_col(column), F.lit(0)) > 0


def js_trim(column: str | Column) -> Column:
    """Trim all whitespace at both ends (SQL trim removes spaces only)."""
    return F.regexp_replace(_col(column), f"^[{JS_BLANKS}]+|[{JS_BLANKS}]+$", "")


def _whole(column: Column, pattern: str) -> Column:
    """The group of ``pattern`` if it is all of the text but blanks around it, else empty text."""
    return F.regexp_extract(column, f"^[{JS_BLANKS}]*{pattern}[{JS_BLANKS}]*$", 1)


def js_positive_id(column: str | Column) -> Column:
    """Text id to bigint; NULL unless ``Number(text)`` is an integer above zero.

    Nearly all ids are plain digits, which a cast reads; the patterns are tried only on
    the rest, and give empty text, which is no number, where they do not fit.  Each form names the text
    once: Spark pastes it in for each mention, and the JVM only compiles small code.
    """
    text = _col(column)
    # as decimal text, 1.5e1 is 15.000…: whole if only zeros follow the point
    decimal = _whole(text, JS_NUMBERS[10]).try_cast("decimal(38,18)").cast("string")
    forms = [_whole(decimal, PLAIN_POSITIVE)] + [F.conv(_whole(text, JS_NUMBERS[radix]), radix, 10) for radix in (16, 8, 2)]
    plain = text.try_cast("bigint")
    return F.when(plain > 0, plain).otherwise(F.coalesce(*[f.try_cast("bigint") for f in forms]))


def js_round_cents(amount: str | Column) -> Column:
    """``Math.round(amount * 100)``: binary floating point, halves go up."""
    return F.floor(_col(amount).cast("double") * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def blur(coordinate: str | Column) -> Column:
    """Coordinate rounded to two decimals, halves away from zero, as double.

    The rounding is done on a decimal: rounding a double first would move
    values such as 0.125 the other way.
    """
    return F.round(_col(coordinate).cast("decimal(20,12)"), 2).cast("double")


def empty_to_null(column: str | Column) -> Column:
    return F.nullif(_col(column), F.lit(""))


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
