"""Named tables, SQL passthrough and the text COPY sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Driver:
    """Session-scoped façade: opens tables, runs SQL, and forgets what it registered.

    Use it as a context manager; leaving it unpersists frames and drops temporary views.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._views: list[str] = []
        self._kept: list[DataFrame] = []

    def __enter__(self) -> Driver:
        return self

    def __exit__(self, *_) -> None:
        self.clean_up()

    def load_table(self, name: str) -> DataFrame:
        """An existing table by catalog name, or a parquet path; ``LookupError`` if absent."""
        if "/" in name or name.endswith(".parquet"):
            if "://" not in name and not os.path.exists(name):
                raise LookupError(f"there is no table {name}")
            return self.spark.read.parquet(name)
        if not self.spark.catalog.tableExists(name):
            raise LookupError(f"there is no table {name}")
        return self.spark.table(name)

    def load_file(self, path: str, **dialect) -> DelimitedFile:  # noqa: F821
        from .delimited import DelimitedFile

        return DelimitedFile(self.spark, path, **dialect)

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        self._views.append(name)
        return df

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    def exec_sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def get_count(self, text: str) -> int:
        """Column ``count`` of the first row as an integer; 0 without a row."""
        row = self.spark.sql(text).first()
        return 0 if row is None or row["count"] is None else int(row["count"])

    def load_extension(self, name: str) -> None:
        from ..functions.scalar import load_extension

        load_extension(self.spark, name)

    def clean_up(self) -> None:
        for df in self._kept:
            df.unpersist()
        for name in self._views:
            self.spark.catalog.dropTempView(name)
        self._kept, self._views = [], []


def copy_text(df: DataFrame) -> DataFrame:
    """Rows in the text COPY form: columns joined by tabs, NULL and a lone backslash as ``\\N``,
    timestamps as ``yyyy-MM-dd HH:mm:ss``; tabs, line breaks and backslashes escaped."""
    parts = []
    for f in df.schema:
        value = F.col("`" + f.name.replace("`", "``") + "`")
        if f.dataType.typeName().startswith("timestamp"):
            text = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        else:
            text = F.nullif(value.cast("string"), F.lit("\\"))
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(a), F.lit(b))
        parts.append(F.coalesce(text, F.lit("\\N")))
    return df.select(F.concat_ws("\t", *parts).alias("value"))


def write_table(df: DataFrame, path: str, truncate: bool = False, form: str = "parquet") -> None:
    """Append to a table folder, or replace it with ``truncate``.  ``form`` may be ``text`` for
    the COPY form."""
    out = copy_text(df) if form == "text" else df
    out.write.mode("overwrite" if truncate else "append").format(form).save(path)
