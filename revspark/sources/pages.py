"""Product pages -> title dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.functions.text import element_text


def extract_titles(pages: DataFrame, class_name: str, tag: str = "div",
                   id_col: str = "page_id") -> DataFrame:
    """``(appid, title)`` from ``(page_id, url, html)``.

    The title is the text of the first ``<tag>`` that has the class; "NA" when the
    page has none. One pass over the pages, no shuffle.
    """
    return pages.select(F.col(id_col).cast("string").alias("appid"),
                        element_text("html", class_name, tag).alias("title"))
