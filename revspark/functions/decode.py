"""Scalar decoders: ids, numbers, flags, languages, score labels and times."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from revspark.functions import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_u64(c) -> Column:
    """Decimal string -> unsigned 64-bit id as DECIMAL(20,0); NULL when not a number.

    Ids above 2^63-1 do not fit BIGINT, so the full range is kept as a decimal.
    """
    s = F.trim(_col(c).cast("string"))
    v = s.try_cast("decimal(20,0)")
    return F.when(s.rlike(r"^[0-9]{1,20}$") & (v <= F.lit(U64_MAX).cast("decimal(20,0)")), v)


U64_MAX = "18446744073709551615"


def to_id(c) -> Column:
    """Decimal string -> BIGINT id; NULL when not a number or out of range."""
    return F.when(F.trim(_col(c).cast("string")).rlike(r"^[0-9]+$"),
                  F.trim(_col(c).cast("string")).try_cast("bigint"))


def to_double_or_zero(c) -> Column:
    """String or number -> double; anything unparsable is 0.0, never an error."""
    return F.coalesce(_col(c).cast("string").try_cast("double"), F.lit(0.0))


def int_to_bool(c) -> Column:
    """Integer success flag -> boolean; only 1 is true."""
    return F.coalesce(_col(c) == 1, F.lit(False))


# alias -> canonical name, accepting canonical name, short code and native name.
def _language_aliases():
    pairs = {}
    for name, code, native in K.LANGUAGES:
        pairs.setdefault(name, name)
        pairs.setdefault(code, name)
        if name != "all":
            pairs.setdefault(native, name)
    for alias, name in K.LANGUAGE_EXTRA_ALIASES:
        pairs.setdefault(alias, name)
    return pairs


LANGUAGE_ALIASES = _language_aliases()


def normalize_language(c) -> Column:
    """Any accepted spelling -> canonical language name; NULL when unknown (case-sensitive)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGE_ALIASES.items())])
    return F.try_element_at(m, _col(c))


def language_dim(spark):
    """The 30-row language dimension ``(language, code, native_name)``."""
    return spark.createDataFrame(K.LANGUAGES, "language string, code string, native_name string")


def review_score_ordinal(c) -> Column:
    """Score label -> ordinal 1..9; NULL for an unknown label."""
    m = F.create_map(*[F.lit(x) for pair in
                       ((lab, i + 1) for i, lab in enumerate(K.SCORE_LABELS)) for x in pair])
    return F.try_element_at(m, _col(c)).cast("tinyint")


def review_score_label(c) -> Column:
    """Ordinal 1..9 -> score label; NULL out of range."""
    arr = F.array(*[F.lit(x) for x in K.SCORE_LABELS])
    o = _col(c).cast("int")
    return F.when((o >= 1) & (o <= 9), F.element_at(arr, o))


def unix_to_timestamp(c) -> Column:
    return F.timestamp_seconds(_col(c))


def unix_seconds_of(c) -> Column:
    """TIMESTAMP_NTZ (wall clock read as UTC) -> whole Unix seconds.

    Built from the date and clock fields, so the result does not depend on the
    session time zone (a cast to TIMESTAMP would).
    """
    col = _col(c)
    return (F.unix_date(F.to_date(col)).cast("bigint") * 86400 + F.hour(col) * 3600
            + F.minute(col) * 60 + F.second(col))


def days_since(ts_seconds, as_of_seconds) -> Column:
    """Whole days from ``ts`` to ``as_of``, truncated toward zero.

    A negative result (``ts`` in the future by a day or more) raises at run time.
    """
    diff = F.lit(as_of_seconds) - _col(ts_seconds) if not isinstance(as_of_seconds, Column) \
        else as_of_seconds - _col(ts_seconds)
    days = (diff / F.lit(86400)).cast("bigint")
    return F.when(days < 0, F.raise_error(F.lit("days_since: time lies in the future"))) \
        .otherwise(days)
