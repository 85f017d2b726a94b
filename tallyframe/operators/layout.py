"""Page layout: tokens to lines, columns and cells; lines to rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins of the page's width, and the kernel that smooths their counts: a Gaussian cut at four sigma.
BINS, SIGMA = 120, 1.5
RADIUS = int(4 * SIGMA + 0.5)
#: Peaks: shares of the line count tried as least height until there are enough, the least height of all, and
#: the least distance in bins.
PEAK_SHARES, PEAK_COUNT, PEAK_FLOOR, PEAK_DISTANCE = (0.08, 0.05, 0.03), 3, 2.0, 4
MIN_TOKENS = 5
#: A line starts anew when a token is this far from the line's first one.
PDF_TOLERANCE, OCR_TOLERANCE = 0.005, 0.008


def cluster_lines(tokens: DataFrame, page: str = "doc_id", token: str = "token", tolerance: float = PDF_TOLERANCE) -> DataFrame:
    """``tokens`` with line_index: a token joins the line while it is near the line's first token.

    The anchor moves only when a line ends, which no window expresses; the fold walks a page's sorted tokens
    inside ``aggregate``, so it stays in the JVM, with one exchange and no join.
    """
    rest = [c for c in tokens.columns if c not in (page, "y0", "x0", token)]
    whole = F.array_sort(F.collect_list(F.struct("y0", "x0", token, *rest)))

    def step(acc: Column, t: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(t["y0"] - acc["anchor"]) > tolerance)
        line = acc["line"] + new.cast("int")
        return F.struct(F.when(new, t["y0"]).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(line)).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("out"))
    pages = tokens.groupBy(page).agg(whole.alias("t")).withColumn("lines", F.aggregate("t", start, step, lambda acc: acc["out"]))
    rows = pages.select(page, F.explode(F.arrays_zip("t", "lines")).alias("x"))
    return rows.select(page, "x.t.*", F.col("x.lines").alias("line_index"))


def build_boxes(tokens: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """One row per line or cell: its text by x, bounding box, mean confidence and token count."""
    words = F.array_sort(F.collect_list(F.struct(F.col("x0"), F.col(token), F.col("text"))))
    return tokens.groupBy(*keys).agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.round(F.avg("confidence"), 6).alias("confidence"),
        F.count("*").alias("n_tokens"),
    )


def bin_of(x: Column) -> Column:
    return F.least(F.floor(x * BINS), F.lit(BINS - 1)).cast("int")


def column_histogram(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    """Tokens per bin of the page's width by their left edge; the last bin holds 1.0."""
    inside = tokens.where((F.col("x0") >= 0) & (F.col("x0") <= 1))
    return inside.withColumn("bin", bin_of(F.col("x0"))).groupBy(page, "bin").agg(F.count("*").alias("n"))


def kernel() -> np.ndarray:
    x = np.arange(-RADIUS, RADIUS + 1)
    k = np.exp(-0.5 * (x / SIGMA) ** 2)
    return k / k.sum()


def peaks(height: np.ndarray, least: float, distance: int) -> list[int]:
    """Local maxima, the middle of level ones, of ``least`` height; of two that are too close the higher stays."""
    found, i, n = [], 1, len(height)
    while i < n - 1:
        if height[i - 1] < height[i]:
            j = i
            while j < n - 1 and height[j + 1] == height[i]:
                j += 1
            if j < n - 1 and height[j + 1] < height[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if height[p] >= least]
    keep = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda p: (height[p], p), reverse=True):
        if keep[p]:
            for q in found:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    return [p for p in found if keep[p]]


def column_edges(counts: np.ndarray, n_lines: int) -> list[tuple[float, float]]:
    """Columns (start, end) from a histogram of left edges."""
    padded = np.concatenate([counts[:RADIUS][::-1], counts, counts[-RADIUS:][::-1]]).astype(float)
    smooth = np.convolve(padded, kernel(), "valid")
    found: list[int] = []
    for share in PEAK_SHARES:
        found = peaks(smooth, max(n_lines * share, PEAK_FLOOR), PEAK_DISTANCE)
        if len(found) >= PEAK_COUNT:
            break
    if not found:
        return [(0.0, 1.0)]
    at = [p / BINS for p in found]
    ends = [(a + b) / 2 for a, b in zip(at, at[1:], strict=False)] + [1.0]
    return [(0.0 if i == 0 else a - 0.01, e) for i, (a, e) in enumerate(zip(at, ends, strict=True))]


def detect_columns(tokens: DataFrame, page: str = "doc_id", line: str = "line_index") -> DataFrame:
    """Columns (page, column_index, x_start, x_end) of each page with enough tokens.

    Only the bins of a page's tokens reach Python.
    """
    inside = (F.col("x0") >= 0) & (F.col("x0") <= 1)
    packed = tokens.groupBy(page).agg(F.collect_list(F.when(inside, bin_of(F.col("x0")))).alias("bins"), F.size(F.collect_set(line)).alias("n_lines"), F.count("*").alias("n_tokens"))
    packed = packed.where(F.col("n_tokens") >= MIN_TOKENS)
    kind = dict(tokens.dtypes)[page]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, bins, n in zip(batch[page], batch["bins"], batch["n_lines"], strict=True):
                counts = np.bincount(np.asarray(bins, np.int64), minlength=BINS)
                out += [(p, i, round(a, 6), round(e, 6)) for i, (a, e) in enumerate(column_edges(counts, n))]
            yield pd.DataFrame(out, columns=[page, "column_index", "x_start", "x_end"])

    return packed.select(page, "bins", "n_lines").mapInPandas(run, f"{page} {kind}, column_index int, x_start double, x_end double")


def assign_columns(tokens: DataFrame, columns: DataFrame, page: str = "doc_id") -> DataFrame:
    """``tokens`` with column_index: the first column that holds the token's middle, else the nearest centre."""
    packed = columns.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("column_index", "x_start", "x_end"))).alias("columns__"))
    middle = (F.col("x0") + F.col("x1")) / 2
    holding = F.try_element_at(F.filter("columns__", lambda c: (middle >= c["x_start"]) & (middle <= c["x_end"])), F.lit(1))["column_index"]
    nearest = F.array_min(F.transform("columns__", lambda c: F.struct(F.abs((c["x_start"] + c["x_end"]) / 2 - middle).alias("d"), c["column_index"].alias("i"))))["i"]
    return tokens.join(packed, page).withColumn("column_index", F.coalesce(holding, nearest)).drop("columns__")


def reconstruct_rows(lines: DataFrame, doc: str = "doc_id", line: str = "line", kind: str = "kind") -> DataFrame:
    """``lines`` in rows, with row_index and is_marker; lines of no row are dropped.

    A marker (M) is a row of its own, a date (D) opens a row, amounts (A) and texts (T) join the open row; a text
    too far below the line before closes it.
    """
    w = Window.partitionBy(doc).orderBy(line)
    gap, height = F.col("y0") - F.lag("y1").over(w), F.lag(F.col("y1") - F.col("y0")).over(w)
    lines = lines.withColumns({"gap__": gap, "height__": height})
    far = F.when(F.col("height__") > 0, F.col("gap__") > 1.8 * F.col("height__")).otherwise(F.col("gap__") >= 0.02)
    opens = F.col(kind).isin("M", "D") | ((F.col(kind) == "T") & F.coalesce(far, F.lit(False)))
    lines = lines.withColumn("group__", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(doc, "group__").orderBy(line)
    lines = lines.withColumns({"opener__": F.first(kind).over(inside), "n__": F.row_number().over(inside)})
    kept = ((F.col("opener__") == "D") | ((F.col("opener__") == "M") & (F.col("n__") == 1))) & (F.col("group__") > 0)
    rows = lines.where(kept).withColumn("row_index", (F.dense_rank().over(Window.partitionBy(doc).orderBy("group__")) - 1).cast("int"))
    return rows.withColumn("is_marker", F.col("opener__") == "M").drop("gap__", "height__", "group__", "opener__", "n__")


def first_cells(cells: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first cell of each column of a row; later ones of the column are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return cells.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def forward_filled(rows: DataFrame, partition: list[str], order: list[str], value: str, empty: Column, out: str) -> DataFrame:
    """``out``: ``value``, or the last one before where ``empty`` holds."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.when(empty, F.last(value, ignorenulls=True).over(w)).otherwise(F.col(value)))


def has_text_layer(words: DataFrame, page: list[str], order: str, text: str = "text") -> DataFrame:
    """Pages with words enough, of whose first fifty over three tenths hold a letter."""
    w = Window.partitionBy(*page).orderBy(order)
    ranked = words.withColumn("n__", F.row_number().over(w))
    share = F.avg(F.when(F.col("n__") <= 50, F.col(text).rlike(r"\p{L}").cast("int")))
    out = ranked.groupBy(*page).agg(F.count("*").alias("n_words"), F.round(share, 6).alias("letter_share"))
    return out.withColumn("has_text", (F.col("n_words") >= 10) & (F.col("letter_share") > 0.3)).withColumn("path", F.when(F.col("has_text"), "PDF_TEXT").otherwise("OCR"))
