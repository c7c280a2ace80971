import pytest
from pyspark.sql import functions as F

from rollmill.functions.scalar import date_or_null, email_valid, election_name, load_extension
from rollmill.jobs import DedupJob, DedupPlan, FileAudit, ImportJob, MergePlan
from rollmill.operators import audit
from rollmill.operators.geo import prepare_for_geocoding
from rollmill.operators.match import match
from rollmill.operators.shape import copy_column, map_column_from, shape
from rollmill.sources.catalog import Driver, copy_text, write_table
from rollmill.sources.delimited import DelimitedFile, split_record
from rollmill.spec import MatchSpec, MergeSpec, TableSpec, template


def test_columns_constraints_groups(spark, rows):
    t = spark.createDataFrame([("a b", 1), ("a b", 5), (None, 7)], "`my col` string, n int")
    spec = TableSpec().map_column("k", "my col").map_column("s", "n", expr="sum($S)").constrain("n", "$S < 7").group_records_by("`my col`")
    assert rows(shape(t, spec)) == [("a b", 6)]
    assert spec.mapped_column_names == ["k", "s"] and spec.add_column("z").column_names == ["k", "s", "z"]
    assert shape(t, TableSpec(default_type="int").add_column("z").map_column("n", "n")).dtypes == [("z", "int"), ("n", "int")]
    with pytest.raises(ValueError):
        TableSpec().map_column("x")
    with pytest.raises(ValueError):
        template("$S + 1")


def test_copied_schema(spark):
    like = spark.createDataFrame([], "a long, b string, c date")
    got = shape(spark.createDataFrame([(1,)], "x int"), TableSpec().map_column("a", "x", "int").copy_schema_from(like))
    assert got.dtypes == like.dtypes and tuple(got.first()) == (1, None, None)


def test_column_copy_keeps_unmatched_and_writes_matched_nulls(spark, rows):
    t = spark.createDataFrame([(1, "old"), (2, "old"), (None, "old")], "k int, v string")
    s = spark.createDataFrame([(1, None), (2, "b"), (2, "a"), (None, "z")], "k int, v string")
    assert rows(copy_column(t, s, "v", "k")) == [(None, "old"), (1, None), (2, "a")]
    assert rows(map_column_from(t, s.withColumnRenamed("k", "j"), [("j", "k")], "v", expr="concat($T, $S)")) == [(None, "old"), (1, None), (2, "olda")]


FILES = {
    "extra": ("h1,h2,h3\nd1,d2,d3\nd1,d2,d3,d4\n", ",", "^", [("d1", "d2", "d3")], 1),
    "stray": ("h1,h2,h3\nd1,d2,d3\nd^1,d2,d3\nd4,d5,d6\n", ",", "^", [("d1", "d2", "d3"), ("d4", "d5", "d6")], 1),
    "quoted": ("'h1','h2','h3'\n'data, 1','','data '' 3'", ",", "'", [("data, 1", "", "data ' 3")], 0),
    "short": ("h1,h2,h3\na,b\n\n,,\n", ",", "^", [("a", "b", None), (None, None, None)], 0),
    "pipe": ("h1|h2\n^x|y^|z\nq^|r\n", "|", "^", [("x|y", "z")], 1),
}


@pytest.mark.parametrize("name", FILES)
def test_malformed_rows(spark, tmp_path, rows, name):
    text, d, q, want, bad = FILES[name]
    path = tmp_path / "f.txt"
    path.write_bytes(text.encode("latin-1"))
    f = DelimitedFile(spark, str(path), d, q).remove_malformed_rows()
    assert sorted(map(tuple, f.load().collect()), key=str) == sorted(want, key=str)
    assert f.malformed_count() == bad and f.headers[0] == "h1"


def test_scrub_encoding_and_maps(spark, tmp_path, rows):
    path = tmp_path / "f.txt"
    path.write_bytes("^a b^,^n^\n^é^,1\n".encode("latin-1"))
    f = DelimitedFile(spark, str(path)).remove_expression(r"\^")
    assert f.headers == ["a b", "n"] and rows(f.load()) == [("é", "1")]
    mapped = f.map_column("x", "a b").map_column("y", convert=lambda r: F.upper(r["a b"])).map_column("z", "n", "literal")
    assert rows(mapped.load()) == [("é", "É", "literal")]


def test_rows_that_equal_the_header_stay(spark, tmp_path, rows):
    for n in ("one", "two"):
        (tmp_path / f"{n}.csv").write_bytes(b"a,b\r\n1,2\r\na,b\r\n3,4\r\n" if n == "one" else b"a,b\r\n5,6\r\n")
    f = DelimitedFile(spark, str(tmp_path))
    assert f.headers == ["a", "b"] and rows(f.load()) == [("1", "2"), ("3", "4"), ("5", "6"), ("a", "b")]
    assert f.remove_malformed_rows().malformed_count() == 0
    (tmp_path / "two.csv").write_bytes(b"b,a\r\n5,6\r\n")
    with pytest.raises(Exception):
        DelimitedFile(spark, str(tmp_path)).load().collect()


def test_wide_encodings(spark, tmp_path, rows):
    path = tmp_path / "f.csv"
    path.write_bytes("a,b\r\n\u00e9,^x,y^\r\na,b\r\n".encode("utf-16-le"))
    f = DelimitedFile(spark, str(path), encoding="UTF-16LE", multi_line=False)
    assert f.headers == ["a", "b"]
    path.write_text("a,b\n1,^x\ny^\n")
    with pytest.raises(ValueError):
        DelimitedFile(spark, str(path), encoding="UTF-16LE")._joined()


BROKEN = 'h1,h2\r\n1,^two\nlines^\r\n^a\r\n\r\nb^,^c,\nd^^\ne^\r\n2,x^stray\r\n3,plain\r\n\r\n^k^,^m\nn^o\r\n4,end\r\n'


@pytest.mark.parametrize("block", [None, 8])
def test_line_breaks_inside_quotes(spark, tmp_path, rows, block):
    (tmp_path / "f.csv").write_bytes(BROKEN.encode("latin-1"))
    (tmp_path / "g.csv").write_bytes(b"h1,h2\r\n9,^\xe9\n!^\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        f = DelimitedFile(spark, str(tmp_path)).remove_malformed_rows()
        want = [("1", "two\nlines"), ("3", "plain"), ("4", "end"), ("9", "\u00e9\n!"), ("a\r\n\r\nb", "c,\nd^\ne")]
        assert rows(f.load()) == want
        assert rows(f.rejected()) == [("2,x^stray",), ("^k^,^m\nn^o",)]
        scrubbed = DelimitedFile(spark, str(tmp_path / "f.csv")).remove_expression("lain|stra").remove_malformed_rows()
        assert ("3", "p") in rows(scrubbed.load()) and rows(scrubbed.rejected())[0] == ("2,x^y",)
        lines = DelimitedFile(spark, str(tmp_path / "f.csv"), multi_line=False).remove_malformed_rows()
        assert rows(lines.load()) == [("3", "plain"), ("4", "end")] and lines.malformed_count() == 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_wrong_width_raises_without_cleaning(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        DelimitedFile(spark, str(path)).load().collect()


def test_split_record():
    assert split_record("^x,1^,b,", ",", "^") == ["x,1", "b", ""]
    assert split_record("^x^^y^", ",", "^") == ["x^y"] and split_record("", ",", "^") == [""]
    for bad in ("d^1,x", "^x^y,b", "^open,b", "a\nb,c", " ^x^,b"):
        assert split_record(bad, ",", "^") is None


def test_functions(spark, rows):
    t = spark.createDataFrame([(1, "2012-01-02"), (2, "2012-02-30"), (3, "xx"), (4, ""), (5, None), (6, "1/2/2012"), (7, "20120102"), (8, "2012")], "i int, x string")
    for name in ("date_or_null", "election_name", "email_valid"):
        load_extension(spark, name)
    got = rows(t.select("i", date_or_null(F.col("x")).cast("string"), F.expr("CAST(date_or_null(x) AS STRING)")))
    assert [r[1:] for r in got] == [("2012-01-02",) * 2, *[(None, None)] * 4, *[("2012-01-02",) * 2] * 2, (None, None)]
    mails = spark.createDataFrame([(None,), ("",), ("a@b.co",), ("a@b.co.uk",), ("a@b.c",), ("ab.com",), ("a b@c.com",), ("a@b.com\n",)], "x string")
    assert [tuple(r) for r in mails.select(email_valid(F.col("x")), F.expr("email_valid(x)")).collect()] == [(True, True)] * 4 + [(False, False)] * 4
    e = spark.createDataFrame([("2012-11-06", "GE"), ("2012-11-06", "XX"), ("2012-11-06", None)], "d string, t string")
    assert [r[0] for r in e.select(election_name(F.col("d"), F.col("t"))).collect()] == ["2012_general", "2012_xx", None]
    with pytest.raises(NameError):
        load_extension(spark, "nope")


def test_audits_of_small_and_empty_tables(spark, rows):
    t = spark.createDataFrame([("a", " "), ("a", "x"), (None, None)], "k string, v string")
    assert rows(audit.coverage(t)) == [("k", 2, 3, 2 / 3), ("v", 1, 3, 1 / 3)]
    assert rows(audit.key_uniqueness(t, "k")) == [(1, 2)]
    assert [tuple(r) for r in audit.distribution(t, "k", 1).collect()] == [("a", 2)]
    assert rows(audit.coverage(t.limit(0)), "fraction") == [(None,), (None,)]
    assert rows(audit.key_uniqueness(t.limit(0), "k")) == [(0, 0)]
    assert set(audit.table_audit(t.withColumn("party", F.lit("x")))) == {"total", "coverage", "distributions"}


def test_geocoding(spark, rows):
    t = spark.createDataFrame([(1, "x", None, 2), (2, "", 0, 3), (3, "y", 5, 7), (4, None, 0, None)], "i int, residential_address1 string, residential_lat int, residential_lng int")
    assert rows(prepare_for_geocoding(t), "i", "needs_geocoding", "location_geometry") == [(1, True, None), (2, False, "POINT(3 0)"), (3, False, "POINT(7 5)"), (4, False, None)]
    bare = prepare_for_geocoding(t.select("i", "residential_address1"))
    assert "residential_lat" in bare.columns and rows(bare, "location_geometry") == [(None,)] * 4


def test_driver_and_sinks(spark, tmp_path, rows):
    with Driver(spark) as d:
        d.register("tmp_seven", spark.range(7))
        assert d.get_count("SELECT count(*) AS count FROM tmp_seven") == 7
        assert d.get_count("SELECT id AS count FROM tmp_seven WHERE id > 99") == 0
        with pytest.raises(LookupError):
            d.load_table("no_such_table")
    assert not spark.catalog.tableExists("tmp_seven")
    t = spark.createDataFrame([(None, "\\", "a\tb\n")], "a string, b string, c string")
    assert copy_text(t).first()[0] == "\\N\t\\N\ta\\tb\\n"
    out = str(tmp_path / "t")
    write_table(spark.range(3), out)
    write_table(spark.range(2), out)
    assert spark.read.parquet(out).count() == 5
    write_table(spark.range(2), out, truncate=True)
    assert Driver(spark).load_table(out).count() == 2


def test_jobs(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    s = spark.createDataFrame([(8, "a"), (9, "c")], "id long, k string")
    done = []
    job = ImportJob(spark, lambda d: [MergePlan(s, t, MatchSpec("id", "id").exact("k"), MergeSpec().preserve("id"))])
    assert job.perform(lambda r: done.append(r.target.count())) == 1 and done == [3]
    assert "group 0: 1 (50.0 %)" in job.perform_audit()[0]
    dup = t.unionByName(s.selectExpr("id", "'a' k"))
    dedup = DedupJob(spark, lambda d: [DedupPlan(dup, MatchSpec("id", "id").exact("k"))])
    assert dedup.perform(lambda r: done.append(r.target.count())) == 1 and done[-1] == 2
    assert "reflexive matches: 0" in dedup.perform_audit()[0]
    with pytest.raises(NotImplementedError):
        ImportJob(spark).perform(print)
    path = tmp_path / "f.txt"
    path.write_text("id,v\n1,x\n1,\n2,y,z\n")
    report = FileAudit(DelimitedFile(spark, str(path)), "id").perform()
    assert "rows: 2" in report and "malformed rows: 1" in report and "NOT UNIQUE" in report


def test_stream_upsert(spark, tmp_path, rows):
    from rollmill.streaming.upsert import upsert_stream

    src, tgt = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1)], "id long, k string, v int").write.parquet(f"{tgt}-x")
    spark.createDataFrame([(8, "a", 5), (9, "c", 6)], "id long, k string, v int").write.parquet(src)
    state = {"at": f"{tgt}-x"}

    def write(df, epoch):
        df.write.mode("overwrite").parquet(f"{tgt}-{epoch}")
        state["at"] = f"{tgt}-{epoch}"

    stream = spark.readStream.schema("id long, k string, v int").parquet(src)
    q = upsert_stream(stream, lambda: spark.read.parquet(state["at"]), write, MatchSpec("id", "id").exact("k"), MergeSpec().preserve("id")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(state["at"])) == [(1, "a", 5), (9, "c", 6)]


def test_links_of_matched_rows_are_unique(spark):
    t = spark.range(50).selectExpr("id", "CAST(id % 5 AS STRING) k")
    got = match(t, t, MatchSpec("id", "id").exact("k").exact("k"))
    assert got.count() == 50
