"""Review request parameters as DataFrame filters, ordering and keyset paging.

A request's parameters become a predicate pushed into the scan (language,
sentiment, purchase origin, day range) and an ordered top-k (page size). The
cursor is keyset paging: the sort value and id of the last row served, so the
next page is a filter plus a top-k -- no offset scan and no global sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.functions import constants as K
from revspark.functions.decode import LANGUAGE_ALIASES

ORDER_COLUMNS = {"recent": "timestamp_created", "updated": "timestamp_updated",
                 "all": "weighted_vote_score"}
REVIEW_TYPES = ("all", "positive", "negative")
PURCHASE_TYPES = ("all", "steam", "non_steam")


@dataclass(frozen=True)
class Cursor:
    """Position after the last row served: its sort value and its id."""

    value: float | int
    id: int


@dataclass(frozen=True)
class ReviewQuery:
    """Validated request parameters.

    ``order``: "recent" (creation time), "updated" (update time) or "all"
    (helpfulness score). ``day_range`` keeps reviews created within that many
    days before ``as_of`` (Unix seconds) and is legal only with order "all"; a
    cursor is illegal with order "all" unless ``unchecked``.
    """

    appid: str | None = None
    language: str = "all"
    review_type: str = "all"
    purchase_type: str = "all"
    order: str = "recent"
    day_range: int | None = None
    as_of: int | None = None
    per_page: int = K.PAGE_SIZE_DEFAULT
    cursor: Cursor | None = None
    unchecked: bool = False

    def __post_init__(self):
        if self.order not in ORDER_COLUMNS:
            raise ValueError(f"order must be one of {sorted(ORDER_COLUMNS)}, got {self.order!r}")
        if self.review_type not in REVIEW_TYPES:
            raise ValueError(f"review_type must be one of {REVIEW_TYPES}, got {self.review_type!r}")
        if self.purchase_type not in PURCHASE_TYPES:
            raise ValueError(f"purchase_type must be one of {PURCHASE_TYPES}")
        if self.language not in LANGUAGE_ALIASES:
            raise ValueError(f"unknown language {self.language!r}")
        if self.day_range is not None:
            if self.order != "all":
                raise ValueError("day_range is only legal with order 'all'")
            if self.day_range < 0:
                raise ValueError("day_range must not be negative")
            if self.as_of is None:
                raise ValueError("day_range needs as_of (Unix seconds)")
        if self.cursor is not None and self.order == "all" and not self.unchecked:
            raise ValueError("a cursor is not legal with order 'all'")
        if self.per_page < 1:
            raise ValueError("per_page must be positive")

    @property
    def page_size(self) -> int:
        return min(self.per_page, K.PAGE_SIZE_MAX)

    @property
    def canonical_language(self) -> str:
        return LANGUAGE_ALIASES[self.language]

    def predicate(self):
        """Row filter of the request (None when it keeps every row)."""
        conds = []
        if self.appid is not None:
            conds.append(F.col("appid") == F.lit(self.appid))
        if self.canonical_language != "all":
            conds.append(F.col("language") == F.lit(self.canonical_language))
        if self.review_type == "positive":
            conds.append(F.col("voted_up"))
        elif self.review_type == "negative":
            conds.append(~F.col("voted_up"))
        if self.purchase_type == "steam":
            conds.append(F.col("steam_purchase"))
        elif self.purchase_type == "non_steam":
            conds.append(~F.col("steam_purchase"))
        if self.day_range is not None:
            conds.append(F.col("timestamp_created") >= F.lit(self.as_of - self.day_range * 86400))
        if not conds:
            return None
        out = conds[0]
        for c in conds[1:]:
            out = out & c
        return out

    def apply(self, reviews: DataFrame) -> DataFrame:
        """Filtered, unordered rows of the request."""
        pred = self.predicate()
        return reviews if pred is None else reviews.filter(pred)


def page(reviews: DataFrame, q: ReviewQuery, id_col: str = "recommendation_id") -> DataFrame:
    """One page of the request: filter, keyset cursor, newest/best first, top-k.

    Ties on the sort value are broken by id (descending) and rows without one come
    last, so pages never overlap and never skip rows.
    """
    key = ORDER_COLUMNS[q.order]
    df = q.apply(reviews)
    if q.cursor is not None:
        v, i = F.lit(q.cursor.value), F.lit(q.cursor.id)
        if q.cursor.value is None:
            df = df.filter(F.col(key).isNull() & (F.col(id_col) < i))
        else:
            df = df.filter(F.col(key).isNull() | (F.col(key) < v) | ((F.col(key) == v) & (F.col(id_col) < i)))
    return df.orderBy(F.desc_nulls_last(key), F.desc(id_col)).limit(q.page_size)


def next_cursor(page_df: DataFrame, q: ReviewQuery, id_col: str = "recommendation_id") -> Cursor | None:
    """Cursor after a served page (reads at most one row); None when the page is empty."""
    key = ORDER_COLUMNS[q.order]
    last = (page_df.select(key, id_col).orderBy(F.asc_nulls_first(key), F.asc(id_col)).limit(1).collect())
    if not last:
        return None
    return Cursor(last[0][0], last[0][1])


def first_pages(reviews: DataFrame, q: ReviewQuery, n_pages: int) -> DataFrame:
    """The first ``n_pages`` pages of a request as one top-k (``n_pages * page_size`` rows)."""
    if n_pages < 1:
        raise ValueError("n_pages must be positive")
    key = ORDER_COLUMNS[q.order]
    return q.apply(reviews).orderBy(F.desc_nulls_last(key), F.desc("recommendation_id")) \
        .limit(n_pages * q.page_size)
