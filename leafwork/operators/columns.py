"""Columns and rows of a page by greedy grouping, which depends on the order of visits: one page is one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def column_numbers(boxes: list[tuple[int, int, int, int]]) -> list[int]:
    """Column of each box, 0 the rightmost. Boxes are placed by width, widest first; each goes to the oldest column whose extent
    shares more than half of the narrower of the two, and widens it, or opens one."""
    if not boxes:
        return []
    xs = np.array(boxes)[:, [0, 2]]
    low, high = np.empty(len(xs), xs.dtype), np.empty(len(xs), xs.dtype)
    n, member = 0, np.zeros(len(xs), int)
    for i in np.argsort(xs[:, 0] - xs[:, 1], kind="stable"):
        left, right = xs[i]
        shared = np.minimum(high[:n], right) - np.maximum(low[:n], left)
        fits = np.flatnonzero(2 * shared > np.minimum(high[:n] - low[:n], right - left))
        c = fits[0] if len(fits) else n
        if c == n:
            low[c], high[c], n = left, right, n + 1
        low[c], high[c], member[i] = min(low[c], left), max(high[c], right), c
    place = np.empty(n, int)
    place[np.argsort(-high[:n], kind="stable")] = np.arange(n)
    return place[member].tolist()


def row_numbers(boxes: list[tuple[int, int, int, int]], tolerance: float = 0.5) -> list[int]:
    """Row of each box from the top: a box joins the row whose first box's middle is within ``tolerance`` of the taller."""
    rows: list[tuple[float, int]] = []
    member = [0] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1], -boxes[i][2])):
        middle, high = (boxes[i][1] + boxes[i][3]) / 2, boxes[i][3] - boxes[i][1]
        for r, (m, h) in enumerate(rows):
            if abs(middle - m) <= tolerance * max(h, high):
                member[i] = r
                break
        else:
            member[i] = len(rows)
            rows.append((middle, high))
    return member


def reading_order(lines: DataFrame, right_to_left: bool = True) -> DataFrame:
    """book_id, page_no, row_no, col, pos: columns from the right (all one column unless ``right_to_left``), lines from the
    top. Lines with a null corner are left out."""

    def order(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x0", "y0", "x1", "y1"]).sort_values("row_no", kind="stable")
        boxes = list(zip(pdf.x0.astype(int), pdf.y0.astype(int), pdf.x1.astype(int), pdf.y1.astype(int)))
        pdf = pdf.assign(col=column_numbers(boxes) if right_to_left else 0).sort_values(["col", "y0", "row_no"], kind="stable")
        return pdf.assign(pos=range(len(pdf)))[["book_id", "page_no", "row_no", "col", "pos"]]

    return lines.select("book_id", "page_no", "row_no", "x0", "y0", "x1", "y1").groupBy("book_id", "page_no").applyInPandas(order, "book_id string, page_no int, row_no int, col int, pos int")
