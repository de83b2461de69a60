"""Results with a fixed order: a global position column, from range partitions and their offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.ranks import row_index


def with_position(df: DataFrame, order: list[tuple[str, str]], name: str = "position") -> DataFrame:
    """Adds ``name``, the 1-based place of each row by ``order``, pairs of column and "asc" or "desc".

    Nulls come last in either direction. Ties are broken by the remaining columns, ascending, so only rows
    that agree in every column may change places. The order holds across partitions without a sort in one task:
    each task sorts one range and adds the number of rows before it.
    """
    for _, way in order:
        if way not in ("asc", "desc"):
            raise ValueError(f"direction must be asc or desc, not {way}")
    named = {c for c, _ in order}
    keys = [F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last() for c, way in order]
    keys += [F.col(c).asc_nulls_last() for c in df.columns if c not in named]
    return row_index(df, keys).withColumn(name, F.col("idx") + 1).drop("idx")
