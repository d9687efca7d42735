"""Request legality and keyset paging (FIXTURES F13)."""

import pytest

from revspark.operators import query as QY


def test_legality_f13():
    QY.ReviewQuery(order="recent")
    QY.ReviewQuery(order="updated", cursor=QY.Cursor(1, 1))
    QY.ReviewQuery(order="all", day_range=3, as_of=10)
    with pytest.raises(ValueError):
        QY.ReviewQuery(order="recent", day_range=3, as_of=10)
    with pytest.raises(ValueError):
        QY.ReviewQuery(order="all", cursor=QY.Cursor(1, 1))
    QY.ReviewQuery(order="all", cursor=QY.Cursor(1, 1), unchecked=True)
    with pytest.raises(ValueError):
        QY.ReviewQuery(language="klingon")
    assert QY.ReviewQuery(per_page=500).page_size == 100


def test_paging_covers_all_rows_once(spark):
    rows = [(i, i // 3, "english", True, True) for i in range(50)]
    df = spark.createDataFrame(
        rows, "recommendation_id long, timestamp_created long, language string, voted_up boolean,"
              " steam_purchase boolean")
    q = QY.ReviewQuery(order="recent", per_page=7)
    seen = []
    while True:
        page = QY.page(df, q).collect()
        if not page:
            break
        seen += [r.recommendation_id for r in page]
        cur = QY.Cursor(page[-1].timestamp_created, page[-1].recommendation_id)
        q = QY.ReviewQuery(order="recent", per_page=7, cursor=cur)
    expect = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    assert seen == expect


def test_pages_reach_rows_without_sort_value(spark):
    from revspark.operators import query as Q
    df = spark.createDataFrame([(i, None if i % 2 else 100 - i, "english") for i in range(11)],
                               "recommendation_id long, timestamp_created long, language string")
    seen, cursor = [], None
    while True:
        q = Q.ReviewQuery(order="recent", per_page=3, cursor=cursor)
        rows = Q.page(df, q)
        if not rows.count():
            break
        seen += [r.recommendation_id for r in rows.collect()]
        cursor = Q.next_cursor(rows, q)
    assert seen == [0, 2, 4, 6, 8, 10, 9, 7, 5, 3, 1]
