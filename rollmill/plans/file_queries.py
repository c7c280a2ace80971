"""Queries of the delimited-file family, with their SQL.

Parts are written as delimited text to the shared folder, each file with its own header: some
quoted, with line breaks or quotes inside, some with stray quotes, surplus or missing fields, some
equal to the header.  The queries read them back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs import FileAudit
from ..session import ensure_checkpoint_dir
from ..sources.catalog import Driver
from ..sources.delimited import DelimitedFile
from .tables import table

HEADER = "key,^name^,brand"


def write_lines(lines: DataFrame, header: str) -> str:
    """``lines`` (one text column) as text files in the shared folder, each below its header."""
    path = f"{ensure_checkpoint_dir(lines.sparkSession)}/lines-{uuid.uuid4()}"

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [header]})
        yield from batches

    lines.toDF("value").mapInPandas(headed, "value string").write.text(path)
    return path


def _parts(spark: SparkSession, folder: str, malformed: bool, d: str = ",", q: str = "^", header: str = HEADER) -> str:
    """Parts as delimited lines by the remainder of their key: quoted (0), with a line break (6),
    equal to the header (7), and if ``malformed`` a stray quote (1), a field too many (2) or too few (3)."""
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 8
    quoted = lambda text: F.concat(F.lit(q), text, F.lit(q))
    line = F.when(kind == 0, F.concat_ws(d, key, quoted(F.concat("p_name", F.lit(f"{d} {q}{q}new{q}{q}"))), "p_brand"))
    line = line.when(kind == 6, F.concat_ws(d, key, quoted(F.concat("p_name", F.lit(f"\n{q}{q}two{q}{q}{d}"))), quoted(F.col("p_brand"))))
    line = line.when(kind == 7, F.lit(header))
    if malformed:
        line = line.when(kind == 1, F.concat_ws(d, key, F.concat("p_name", F.lit(q)), "p_brand")).when(kind == 2, F.concat_ws(d, key, "p_name", "p_brand", F.lit(""))).when(kind == 3, F.concat_ws(d, key, "p_name"))
    return write_lines(table(spark, folder, "part").select(line.otherwise(F.concat_ws(d, key, "p_name", "p_brand"))), header)


def file_load(spark: SparkSession, folder: str) -> DataFrame:
    """A file's columns as text, through the driver."""
    with Driver(spark) as driver:
        return driver.load_file(_parts(spark, folder, False)).load()


def file_convert(spark: SparkSession, folder: str) -> DataFrame:
    """Columns converted row by row: by a function of the row, by an expression, a literal, and as they are."""
    file = Driver(spark).load_file(_parts(spark, folder, False))
    file = file.map_column("label", convert=lambda row: F.concat_ws("/", row["brand"], row["key"])).map_column("letters", convert=F.length("name")).map_column("origin", convert="file").map_column("brand", "brand")
    return file.load()


def file_headers(spark: SparkSession, folder: str) -> DataFrame:
    names = DelimitedFile(spark, _parts(spark, folder, True)).headers
    return spark.createDataFrame(list(enumerate(names, 1)), "position long, name string")


def file_dialect(spark: SparkSession, folder: str) -> DataFrame:
    """Another delimiter and quote, and a quote in the header."""
    return DelimitedFile(spark, _parts(spark, folder, False, "|", "'", "key|'na''me'|brand"), "|", "'").load().withColumnRenamed("na'me", "name")


def file_scrub(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes and numbers of brands deleted from every line before it is read."""
    lines = table(spark, folder, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit("^"), "p_name", F.lit("^")), F.concat("p_brand", F.lit("^"))))
    return DelimitedFile(spark, write_lines(lines, HEADER)).remove_expression(r"\^|#[0-9]+").load()


def file_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of legal quoting with no more fields than the header; short ones padded with NULL."""
    return DelimitedFile(spark, _parts(spark, folder, True)).remove_malformed_rows().load()


def file_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """The records left out, as they stand in the file."""
    return DelimitedFile(spark, _parts(spark, folder, True)).remove_malformed_rows().rejected().select(F.col("value").alias("record"))


def file_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a file's report: rows, malformed rows, uniqueness of its key, coverage."""
    lines = FileAudit(DelimitedFile(spark, _parts(spark, folder, True)), "key").perform().split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "position long, line string")


def load_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table by its name in the session, and one by its path."""
    with Driver(spark) as driver:
        driver.register("suppliers_in", table(spark, folder, "supplier"))
        named = driver.load_table("suppliers_in").select(F.lit("name").alias("opened_by"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
        return named.unionByName(driver.load_table(f"{folder}/nation.parquet").select(F.lit("path").alias("opened_by"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (file_load, file_convert, file_headers, file_dialect, file_scrub, file_clean, file_malformed, file_audit, load_table)}


def _rows(d: str = ",", q: str = "^", name: str = "name") -> str:
    """The loaded rows of the well-formed file."""
    return f"""SELECT CASE k WHEN 7 THEN 'key' ELSE CAST(p_partkey AS VARCHAR) END AS "key",
        CASE k WHEN 0 THEN p_name || '{d} {q}new{q}' WHEN 6 THEN p_name || chr(10) || '{q}two{q}{d}' WHEN 7 THEN '{name}' ELSE p_name END AS name,
        CASE k WHEN 7 THEN 'brand' ELSE p_brand END AS brand, k, p_partkey FROM (SELECT *, p_partkey % 8 k FROM part)"""


def oracle_sql() -> dict[str, str]:
    clean = f"""SELECT "key", name, CASE k WHEN 3 THEN NULL ELSE brand END AS brand FROM ({_rows()}) WHERE k NOT IN (1, 2)"""
    share = lambda n: f"""'{n}: ' || count({n}) || ' (' || printf('%.1f', 100.0 * count({n}) / count(*)) || ' %)'"""
    return {
        "file_load": f'SELECT "key", name, brand FROM ({_rows()})',
        "file_convert": f"""SELECT brand || '/' || "key" AS label, length(name) AS letters, 'file' AS origin, brand FROM ({_rows()})""",
        "file_headers": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'key'), (2, 'name'), (3, 'brand')) v(position, name)",
        "file_dialect": f"""SELECT "key", name, brand FROM ({_rows('|', "''", "na''me")})""",
        "file_scrub": "SELECT CAST(p_partkey AS VARCHAR) AS \"key\", p_name AS name, regexp_replace(p_brand, '#[0-9]+', '', 'g') AS brand FROM part",
        "file_clean": clean,
        "file_malformed": "SELECT CASE p_partkey % 8 WHEN 1 THEN p_partkey || ',' || p_name || '^,' || p_brand ELSE p_partkey || ',' || p_name || ',' || p_brand || ',' END AS record FROM part WHERE p_partkey % 8 IN (1, 2)",
        "file_audit": f"""WITH c AS ({clean}), g AS (SELECT max(n) m FROM (SELECT count(*) n FROM c GROUP BY "key"))
            SELECT CAST(1 AS BIGINT) AS position, 'rows: ' || count(*) AS line FROM c UNION ALL SELECT 2, 'malformed rows: ' || count(*) FILTER (p_partkey % 8 IN (1, 2)) FROM part
            UNION ALL SELECT 3, CASE WHEN m > 1 THEN 'DUPLICATES (NOT UNIQUE), largest group ' || m ELSE 'UNIQUE KEY' END FROM g
            UNION ALL SELECT 4, {share('key')} FROM c UNION ALL SELECT 5, {share('name')} FROM c UNION ALL SELECT 6, {share('brand')} FROM c""",
        "load_table": "SELECT 'name' AS opened_by, s_suppkey AS id, s_name AS text FROM supplier UNION ALL SELECT 'path', n_nationkey, n_name FROM nation",
    }
