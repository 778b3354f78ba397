"""Header rows and header columns of sheets, from melted cells (file_id, sheet, row, col, value, bold)."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

#: Cells that count as empty, and how much of a sheet is looked at.
EMPTY = ("", "...", ". . .", "--", "N/A")
COUNT_ROWS, HEADER_ROWS = 25, 15


def is_number(value: str) -> bool:
    """Short, a formula, a percentage or digits."""
    letters = sum(c.isalpha() for c in value)
    return len(value) <= 2 or value.startswith("=") or "%" in value and letters < 4 or value.replace(".", "", 1).lstrip("+-").isdigit()


def mode(values: list[int]) -> int:
    """The most frequent value, the greatest of equals."""
    return max(Counter(values).items(), key=lambda kv: (kv[1], kv[0]))[0]


def header_rows(rows: list[list[str]], bold: list[bool]) -> list[int]:
    """Places of the header rows: the first row of simple tables; else the rows down to where the table's body begins."""
    empty = [sum(v in EMPTY for v in r) for r in rows[:COUNT_ROWS]]
    if not empty:
        return []
    width = len(rows[0])
    ratio = [(sum(is_number(v) for v in r if v not in EMPTY) / max(1, sum(v not in EMPTY for v in r))) for r in rows[:HEADER_ROWS]]
    first = empty[:3]
    if len(set(first)) == 1 and empty[0] < width - 1 or len(set(empty)) == 1 or empty[0] == 0 or empty[0] == mode(empty):
        return [0]
    start = next((k for k, n in enumerate(empty) if n < width - 1), 0)
    runs = [k for k in range(start, len(empty) - 2) if empty[k] == empty[k + 1] == empty[k + 2]]
    body = runs[0] if runs else len(empty) - 1
    fullest = min((k for k in range(start, len(ratio)) if ratio[k] < 0.5), key=lambda k: (empty[k], k), default=None)
    if fullest is None:
        fullest = max((k for k, b in enumerate(bold[:HEADER_ROWS]) if b), default=start)
    out = []
    for k in range(start, min(min(body, fullest) + 1, len(ratio) - 1) + 1):
        if ratio[k] > 0.7:
            break
        if ratio[k] < 0.5:
            out.append(k)
    return out


def header_column(rows: list[list[str]]) -> list[str]:
    """The first column that isn't empty, where it holds short words."""
    for column in zip(*rows, strict=True):
        values = [v for v in column if v not in EMPTY]
        if values:
            numbers = sum(is_number(v) for v in values) / len(values)
            return values if numbers < 0.1 and max(map(len, values)) < 70 else []
    return []


def units(cells: DataFrame) -> DataFrame:
    """item_id and unit, the header cells of each file's sheets. A task holds one sheet; sheets of one row give nothing."""

    def sheet(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.assign(value=pdf.value.fillna("").str.strip()).pivot_table(index="row", columns="col", values="value", aggfunc="first").fillna("")
        bold = pdf.groupby("row").bold.any().reindex(grid.index).fillna(False).tolist()
        full = [bool((grid[c] != "").any()) for c in grid.columns]
        width = full.index(False) if False in full else len(full)
        rows = [r[:width] for r in grid.values.tolist()]
        if len(rows) < 2 or not width:
            return pd.DataFrame({"item_id": [], "unit": []}, dtype=object)
        found = {v for k in header_rows(rows, bold) for v in rows[k]} | set(header_column(rows))
        names = sorted(map(str, found - set(EMPTY)))
        return pd.DataFrame({"item_id": [str(pdf.file_id.iloc[0])] * len(names), "unit": names}, dtype=object)

    return cells.select("file_id", "sheet", "row", "col", "value", "bold").groupBy("file_id", "sheet").applyInPandas(sheet, "item_id string, unit string").distinct()
