"""Any DataFrame with an id and a text as a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.analyze import title


def corpus_from_table(df: DataFrame, id_col: str, text_col: str, path_col: str | None = None, modified_col: str | None = None) -> DataFrame:
    """(doc_id, path, title, content, modified_time, error); null texts count as empty, rows without an id are left out."""
    key = F.col(id_col)
    path = F.col(path_col) if path_col else key.cast("string")
    modified = F.lit(0).cast("long")
    if modified_col:
        zoneless = df.schema[modified_col].dataType.typeName() == "timestamp_ntz"
        modified = (F.col(modified_col).cast("timestamp") if zoneless else F.col(modified_col)).cast("long")
    rows = df.where(key.isNotNull())
    return rows.select(
        key.alias("doc_id"),
        path.alias("path"),
        title(F.col(text_col), key.cast("string")).alias("title"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
        modified.alias("modified_time"),
        F.lit(None).cast("string").alias("error"),
    )
