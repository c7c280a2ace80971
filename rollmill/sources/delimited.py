"""Delimited text files: dialect, scrubbing, malformed rows, typed conversion.

Lines are read as text; scrubbing and the grammar test of malformed rows are column expressions,
and the surviving records are parsed by Spark's CSV parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Stands for NULL in the parser, so that an empty quoted field stays an empty text.
_NULL = "\u0001"


@dataclass(frozen=True)
class DelimitedFile:
    """A delimited file, or a folder of files with one header.

    ``delimiter`` is ``,`` and ``quote`` is ``^`` unless set; the encoding is Latin-1 unless
    set.  A record may hold line breaks inside quotes; with ``multi_line=False`` every line is a
    record.  The first record of each file is its header, wherever else the same text stands; a
    file whose header differs from the first file's raises when it is read.  Empty lines between
    records are skipped.
    """

    spark: SparkSession
    path: str
    delimiter: str = ","
    quote: str = "^"
    encoding: str = "ISO-8859-1"
    multi_line: bool = True
    scrubs: tuple[str, ...] = ()
    drop_malformed: bool = False
    maps: tuple[tuple[str, str | None, Any], ...] = field(default=())

    def remove_expression(self, regex: str) -> DelimitedFile:
        """Delete every match of ``regex`` from each line, the header's too."""
        return replace(self, scrubs=(*self.scrubs, regex))

    def remove_malformed_rows(self) -> DelimitedFile:
        """Leave out lines of illegal quoting or with more fields than the header."""
        return replace(self, drop_malformed=True)

    def map_column(self, name: str, source: str | None = None, convert: Callable | Column | Any = None) -> DelimitedFile:
        """A converted column.  ``convert`` is a Column, a function of the row's columns (given
        as a dict of Columns) that returns a Column, or any other value, which is a literal;
        without it the column is ``source`` as it is."""
        return replace(self, maps=(*self.maps, (name, source, convert)))

    def _scrubbed(self, value: Column) -> Column:
        for regex in self.scrubs:
            value = F.regexp_replace(value, regex, "")
        return value

    def _lines(self, header: str | None = None, raw: bool = False) -> DataFrame:
        """Lines as ``value``; below each file's header if that is given; as they are if ``raw``."""
        # One column and separators that no line has: the CSV source decodes any charset by lines.
        reader = self.spark.read.option("sep", "\u0000").option("quote", "\u0000").option("encoding", self.encoding).option("lineSep", "\n")
        name = "value"
        if header is not None:
            # Spark drops the first line of each file, and holds it against the name of the only column.
            name, reader = header, reader.option("header", True).option("enforceSchema", False)
        lines = reader.schema(T.StructType([T.StructField(name, T.StringType())])).csv(self.path).toDF("value")
        return lines if raw else lines.select(self._scrubbed(F.regexp_replace("value", r"\r\z", "")).alias("value"))

    def _first_line(self) -> str:
        """The first line, with its carriage return if it has one."""
        row = self._lines(raw=True).where("trim(value) NOT IN ('', '\r')").first()
        if row is None:
            raise ValueError(f"{self.path} has no header row")
        return row["value"]

    def header_line(self) -> str:
        """The header, scrubbed."""
        line = self._first_line().removesuffix("\r")
        return self.spark.range(1).select(self._scrubbed(F.lit(line))).first()[0] if self.scrubs else line

    @property
    def headers(self) -> list[str]:
        """The header's names, verbatim but for their quotes."""
        line = self.header_line()
        return split_record(line, self.delimiter, self.quote) or line.split(self.delimiter)

    def records(self) -> DataFrame:
        """The records below the headers as ``value``, as they stand in the files.

        Only files in which some quote stays open at the end of a line pay for putting lines
        together; others are read line by line, without a shuffle.
        """
        lines = self._lines(self._first_line()).where("value <> ''")
        if not self.multi_line or lines.where(_left_open(F.col("value"), self.delimiter, self.quote)).isEmpty():
            return lines
        return self._joined()

    def _joined(self) -> DataFrame:
        """Records over several lines.

        A line leads from outside or inside a quote to outside or inside one, so a line is one of
        four functions of two states.  They compose in any grouping: first the lines of a block of
        the file, in parallel, then the few blocks of each file; a record that crosses blocks gets
        the number of the record it began as.
        """
        if re.match("utf.?(16|32)", self.encoding, re.I):
            raise ValueError(f"records over several lines are not read in {self.encoding}; convert the file or set multi_line=False")
        d, q = self.delimiter, self.quote
        text = self.spark.read.option("lineSep", "\n").text(self.path)
        value = F.col("value") if self.encoding.upper().replace("-", "") == "UTF8" else F.decode(F.col("value").cast("binary"), self.encoding)
        lines = text.select(self._scrubbed(value).alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        lines = lines.withColumn("value", F.regexp_replace("raw", r"\r\z", ""))
        order = Window.partitionBy("file", "block").orderBy("at")
        lines = lines.withColumn("line", F.row_number().over(order)).where("NOT (block = 0 AND line = 1)")
        lines = lines.withColumn("o", _left_open(F.col("value"), d, q)).withColumn("i", _still_open(F.col("value"), d, q))
        fixed, swaps = F.when(F.col("o") == F.col("i"), F.col("o")), F.when(F.col("o") & ~F.col("i"), 1).otherwise(0)

        def run(df: DataFrame, window, fixed: Column, swaps: Column) -> DataFrame:
            """``c``: the last fixed state so far, NULL if none; ``s``: whether an odd number of swaps followed."""
            df = df.withColumn("_n", F.sum(swaps).over(window)).withColumn("c", F.last(fixed, True).over(window))
            since = F.last(F.when(fixed.isNotNull(), F.col("_n")), True).over(window)
            return df.withColumn("s", (F.col("_n") - F.coalesce(since, F.lit(0))) % 2 == 1).drop("_n")

        state = lambda c, s, start: F.coalesce(c, start) != s
        lines = run(lines, order, fixed, swaps)
        blocks = lines.groupBy("file", "block").agg(F.max_by(F.struct("c", "s"), "line").alias("e"))
        along = Window.partitionBy("file").orderBy("block")
        blocks = run(blocks, along, F.when(F.col("e.c").isNotNull(), F.col("e.c") != F.col("e.s")), F.when(F.col("e.c").isNull() & F.col("e.s"), 1).otherwise(0))
        blocks = blocks.withColumn("begin", F.lag(state(F.col("c"), F.col("s"), F.lit(False)), 1, False).over(along)).select("file", "block", "begin")
        lines = lines.join(blocks, ["file", "block"]).withColumn("after", state(F.col("c"), F.col("s"), F.col("begin")))
        lines = lines.withColumn("before", F.coalesce(F.lag("after").over(order), "begin")).withColumn("n", F.sum((~F.col("before")).cast("int")).over(order))
        starts = lines.groupBy("file", "block").agg(F.max("n").alias("m"))
        starts = starts.select("file", "block", F.coalesce(F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        lines = lines.join(starts, ["file", "block"]).withColumn("record", F.col("base") + F.col("n"))
        whole = lines.where("NOT before AND NOT after AND value <> ''").select("value")
        parts = lines.where("before OR after").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "raw"))).alias("l"))
        return whole.unionByName(parts.select(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["raw"]), "\n"), r"\r\z", "").alias("value")))

    def split(self) -> tuple[DataFrame, DataFrame]:
        """The records below the header that fit the grammar, and those that don't (``value``)."""
        body = self.records()
        fits = fits_grammar(F.col("value"), self.delimiter, self.quote, len(self.headers))
        return body.where(fits), body.where(~fits)

    def rejected(self) -> DataFrame:
        return self.split()[1]

    def malformed_count(self) -> int:
        """Exact number of rejected records."""
        return self.rejected().count()

    def raw(self) -> DataFrame:
        """All columns as text.  Unquoted empty fields are NULL, quoted empty ones ''.  Short
        rows are padded with NULL once malformed rows are left out; otherwise a row of the
        wrong width raises when read."""
        schema = T.StructType([T.StructField(n, T.StringType()) for n in self.headers])
        options = {"sep": self.delimiter, "quote": self.quote, "escape": self.quote, "nullValue": _NULL, "emptyValue": "", "maxCharsPerColumn": "-1"}
        mode = "PERMISSIVE" if self.drop_malformed else "FAILFAST"
        body = self.split()[0] if self.drop_malformed else self.records()
        return body.select(F.from_csv("value", _ddl(schema), {**options, "mode": mode}).alias("r")).select("r.*")

    def load(self) -> DataFrame:
        """The file's table: all text columns, or the mapped columns if any are declared."""
        raw = self.raw()
        if not self.maps:
            return raw
        row = {c: F.col("`" + c.replace("`", "``") + "`") for c in raw.columns}
        out = []
        for name, source, convert in self.maps:
            if isinstance(convert, Column):
                value = convert
            elif callable(convert):
                value = convert(row)
            elif convert is not None:
                value = F.lit(convert)
            elif source is not None:
                value = row[source]
            else:
                raise ValueError(f"column {name!r} has neither a source nor a converter")
            out.append(value.alias(name))
        return raw.select(*out)


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` STRING" for f in schema)


def record_grammar(delimiter: str, quote: str, width: int) -> str:
    """Pattern of a record of up to ``width`` fields: each wholly quoted with inner
    quotes doubled, or free of quotes.  Possessive, so that no line makes it backtrack."""
    d, one = re.escape(delimiter), _field(delimiter, quote)
    return f"^{one}(?:{d}{one}){{0,{max(width - 1, 0)}}}\\z"


def _field(delimiter: str, quote: str) -> str:
    d, q = re.escape(delimiter), re.escape(quote)
    return f"(?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}|[^{q}{d}\\r\\n]*+)"


def _left_open(column: Column, delimiter: str, quote: str) -> Column:
    """Whether a line that begins a record ends inside a quoted field."""
    d, q = re.escape(delimiter), re.escape(quote)
    return column.rlike(rf"\A(?:{_field(delimiter, quote)}{d})*+{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+\z")


def _still_open(column: Column, delimiter: str, quote: str) -> Column:
    """Whether a line that begins inside a quoted field ends inside one."""
    d, q = re.escape(delimiter), re.escape(quote)
    inside = rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    return column.rlike(rf"\A{inside}(?:{q}{d}(?:{_field(delimiter, quote)}{d})*+{q}{inside})?\z")


def fits_grammar(column: Column, delimiter: str, quote: str, width: int) -> Column:
    """Whether a record has legal quoting and no more than ``width`` fields; NULL for
    NULL.  An empty line is a record of one empty field."""
    return column.rlike(record_grammar(delimiter, quote, width))


def split_record(raw: str, delimiter: str, quote: str) -> list[str] | None:
    """The fields of one record, or None if a field is neither wholly quoted with inner quotes
    doubled nor free of quotes and line breaks."""
    fields, at, n = [], 0, len(raw)
    while True:
        if raw.startswith(quote, at):
            end, parts = at + 1, []
            while True:
                close = raw.find(quote, end)
                if close < 0:
                    return None
                parts.append(raw[end:close])
                if raw.startswith(quote, close + 1):
                    parts.append(quote)
                    end = close + 2
                    continue
                break
            fields.append("".join(parts))
            at = close + 1
            if at < n and not raw.startswith(delimiter, at):
                return None
        else:
            end = raw.find(delimiter, at)
            end = n if end < 0 else end
            text = raw[at:end]
            if quote in text or "\n" in text or "\r" in text:
                return None
            fields.append(text)
            at = end
        if at >= n:
            return fields
        at += len(delimiter)

