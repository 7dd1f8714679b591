"""Recognised lines to pages: reading order, visual rows, headings, confidence, engine routing.

Lines: page_id, line_no, text, confidence, bbox array<array<double>> (corner points; null or short where unknown).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

ORDERED = "page_id long, place int, line_no long, text string, row int"


def _page(lines: pd.DataFrame) -> pd.DataFrame:
    lines = lines.sort_values("line_no", kind="stable").reset_index(drop=True)
    boxes = lines["bbox"].tolist()
    out = pd.DataFrame({"page_id": lines["page_id"], "place": 0, "line_no": lines["line_no"], "text": lines["text"], "row": 0})
    if any(b is None or len(b) < 4 for b in boxes):  # without boxes the given order stands
        return out.assign(place=range(len(out)), row=range(len(out)))
    y = np.array([[p[1] for p in b] for b in map(list, boxes)], dtype=object)
    low, high = np.array([min(v) for v in y], float), np.array([max(v) for v in y], float)
    left, middle, mean = np.array([min(p[0] for p in b) for b in boxes], float), (low + high) / 2, np.array([np.mean(list(v)) for v in y], float)
    reach = max(float(np.median(np.maximum(high - low, 1.0))) * 0.6, 10.0)
    rows: list[list[int]] = []
    for i in np.argsort(middle, kind="stable").tolist():
        home = next((r for r in rows if abs(middle[i] - middle[r].mean()) < reach), None)
        rows.append([i]) if home is None else home.append(i)
    order = [i for r in rows for i in sorted(r, key=lambda i: left[i])]
    out = out.iloc[order].assign(place=range(len(order)))
    # a visual row ends where a line's centre leaves the reach of the row's first line
    number, first, marks = -1, None, []
    for i in order:
        if first is None or abs(mean[i] - first) >= reach:
            number, first = number + 1, mean[i]
        marks.append(number)
    return out.assign(row=marks)


def reading_order(lines: DataFrame) -> DataFrame:
    """ORDERED: top to bottom by rows, left to right within one. A page's lines are one group: bounded by the page."""
    return lines.groupBy("page_id").applyInPandas(_page, ORDERED)


def row_texts(ordered: DataFrame) -> DataFrame:
    """Each visual row's lines with a column gap between them."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "   ")
    return ordered.groupBy("page_id", "row").agg(joined.alias("text"))


def is_heading(text: Column) -> Column:
    """One short line, in capitals or of four words at most."""
    t = F.trim(text)
    words = F.size(F.split(t, r"\s+"))
    return (F.length(t) > 3) & (F.length(t) < 60) & ~t.contains("\n") & ((t == F.upper(t)) | (words <= 4))


def headings(blocks: DataFrame) -> DataFrame:
    """doc_id, page, block, text, level: the first heading of page 1 is level 1, all others 2. blocks: doc_id, page, block, text."""
    found = blocks.where(is_heading(F.col("text")))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")) == 1
    return found.select("*", F.when(first & (F.col("page") == 1), 1).otherwise(2).alias("level"))


def document_confidence(lines: DataFrame) -> DataFrame:
    """Per document: the mean of page means over 0, 0.85 without any. lines: doc_id, page, confidence."""
    pages = lines.groupBy("doc_id", "page").agg(F.avg(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))).alias("c"))
    return pages.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("c") > 0, F.col("c"))), F.lit(0.85)), 4).alias("confidence"))


def engine(kind: Column, pages: Column, mean_chars: Column, has_tables: Column) -> Column:
    """The engine for a document: images and scans to OCR, short digital ones with tables to layout analysis, else plain text."""
    scanned = mean_chars < 30
    return F.when((kind == "image") | scanned, "ocr").when(has_tables & (pages <= 50), "layout").otherwise("text")


def page_parts(pages: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, part, first_page, last_page of runs of `size` pages. pages: doc_id, page from 1."""
    return pages.groupBy("doc_id", F.ceil(F.col("page") / size).alias("part")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def manifest_check(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """archive_id, name, state: ok, missing or changed. manifest: archive_id, name, sha256; stored: archive_id, name, content."""
    hashed = stored.select("archive_id", "name", F.sha2("content", 256).alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "changed").otherwise("ok")
    return manifest.join(hashed, ["archive_id", "name"], "left").select("archive_id", "name", state.alias("state"))
