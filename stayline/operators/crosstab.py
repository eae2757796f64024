"""Cross-tabs with margins, shares and pivots of means.

Always counted first and folded afterwards: margins, shares and wide layouts
are built from the small table of cell counts, never from the rows.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALL = "All"


def cell_counts(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """Rows per combination; rows with a missing key are left out."""
    keys = [row, *columns]
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


ROW_TOTAL, COLUMN_TOTAL = "__all_rows", "__all_columns"


def _with_margins(cells: DataFrame, row: str, columns: Sequence[str], fixed: Sequence[str] = ()) -> DataFrame:
    """Cell counts with both margins. Whether a row is a margin is carried as a number of its own, so a label that reads
    like one stays apart; margins get their label last. `fixed` columns are kept in every margin."""
    levels = F.array(*[F.struct(F.lit(r).alias(ROW_TOTAL), F.lit(c).alias(COLUMN_TOTAL)) for r in (0, 1) for c in (0, 1)])
    at = cells.withColumn("__level", F.explode(levels)).select(*cells.columns, "__level.*")
    folded = at.withColumns(
        {row: F.when(F.col(ROW_TOTAL) == 0, F.col(row).cast("string"))}
        | {c: F.when(F.col(COLUMN_TOTAL) == 0, F.col(c).cast("string")) for c in columns}
    )
    sums = folded.groupBy(*fixed, row, *columns, ROW_TOTAL, COLUMN_TOTAL).agg(F.sum("n").alias("n"))
    margin = {row: F.when(F.col(ROW_TOTAL) == 1, ALL).otherwise(F.col(row))}
    margin |= {c: F.when(F.col(COLUMN_TOTAL) == 1, F.lit(ALL if i == 0 else "")).otherwise(F.col(c)) for i, c in enumerate(columns)}
    return sums.withColumns(margin)


def crosstab(df: DataFrame, row: str, columns: Sequence[str] | str, keep_levels: bool = False) -> DataFrame:
    """Counts in long form with margins labelled All.

    With several columns the column margin spans their combinations. Every cell
    is expanded to its four margin levels after counting, not each input row.
    `keep_levels` adds the two marks that tell margins from cells.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    table = _with_margins(cell_counts(df, row, columns), row, columns)
    marks = [ROW_TOTAL, COLUMN_TOTAL] if keep_levels else []
    return table.select(row, *columns, "n", *marks)


def crosstab_each(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """Cross-tabs of one key with several others in one pass over the rows: (characteristic, row, label, n).

    The rows are counted once per combination of all keys; that table is folded for each column.
    """
    cells = df.where(F.col(row).isNotNull()).groupBy(row, *columns).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(c).alias("characteristic"), F.col(c).cast("string").alias("label")) for c in columns])
    long = cells.select(row, "n", F.explode(each).alias("of")).select(row, "n", "of.*").where(F.col("label").isNotNull())
    table = _with_margins(long, row, ["label"], ["characteristic"])
    return table.select("characteristic", row, "label", "n")


def with_share(table: DataFrame, row: str, columns: Sequence[str] | str) -> DataFrame:
    """Each cell's share of its column total; the All row has share 1.

    Where a label may read like a margin, give a table that keeps its levels.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    columns += [c for c in (COLUMN_TOTAL,) if c in table.columns]
    largest = F.max("n").over(Window.partitionBy(*columns))  # a column's total is its largest count
    return table.withColumn("share", F.col("n") / largest)


def wide(table: DataFrame, row: str, column: str, labels: Sequence[str], value: str = "n", fill=0) -> DataFrame:
    """Long to wide with known column labels; empty cells are filled."""
    out = table.groupBy(row).pivot(column, list(labels)).agg(F.first(value))
    return out if fill is None else out.na.fill(fill, list(labels))


def pivot_means(
    df: DataFrame, value: str, index: Sequence[str], column: str, labels: Sequence[str] | None
) -> DataFrame:
    """Mean of a value by index rows and label columns; empty cells are NULL.

    `labels` names every label of the column; None has Spark find them.
    """
    kept = df.dropna(subset=[*index, column])
    pivoted = kept.groupBy(*index).pivot(column, None if labels is None else list(labels))
    return pivoted.agg(F.avg(value))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
