import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollmill.functions.canonical import coded, dated, squeezed
from rollmill.operators.history import bitemporal_ledger, known_at, reports, versions
from rollmill.operators.quality import contact_checks, departing, drift, profile
from rollmill.operators.snapshot import snapshot_diff
from rollmill.sources.rejects import load_with_rejects, rejects, typed_rows

UPD = "update_id long, g string, e date, r timestamp, a string, party string"
DAY, AT = dt.date(2021, 1, 1), dt.datetime(2021, 1, 1, 12)


def _day(n):
    return DAY + dt.timedelta(days=n)


def _at(n):
    return AT + dt.timedelta(hours=n)


def _reports(df):
    return reports(df, "g", "e", "r", {"a": squeezed(F.col("a")), "party": coded(F.col("party"))}, "update_id")


def _brute(updates):
    """The ledger by replaying every report on a plain list of intervals."""
    by = defaultdict(dict)
    for u, g, e, r, a, p in updates:
        for name, value in (("a", a), ("party", p)):
            if g and e and value and value.strip():
                v = " ".join(value.split()).upper()
                v = {"DEMOCRATIC": "DEM"}.get(v, v) if name == "party" else v
                old = by[g, name].get((r, e))
                if old is None or (u, v) > old:
                    by[g, name][r, e] = (u, v)
    out = set()
    for (g, name), reps in by.items():
        live = []  # [value, from, to, since]
        for (r, e), (_, v) in sorted(reps.items()):
            same = [x for x in live if x[1] == e]
            if same:
                if same[0][0] == v:
                    continue
                x = same[0]
                live.remove(x)
                out.add((g, name, *x, r))
                live.append([v, e, x[2], r])
                continue
            hit = [x for x in live if x[1] < e and (x[2] is None or e < x[2])]
            later = [x[1] for x in live if x[1] > e]
            end = min(later) if later else None
            if hit:
                x = hit[0]
                live.remove(x)
                if x[3] != r:
                    out.add((g, name, *x, r))
                live.append([x[0], x[1], e, r])
            live.append([v, e, end, r])
        out |= {(g, name, *x, None) for x in live}
    return {(g, n, v, f, t, s, u) for g, n, v, f, t, s, u in out if s != u}


@pytest.mark.parametrize("hot", [100_000, 4])
def test_ledger_equals_replay(spark, hot):
    rng = random.Random(5)
    data = [(i, rng.choice(("g1", "g2", "hot", "hot", "hot")), _day(rng.randrange(12)), _at(rng.randrange(60)), rng.choice(("1 Elm St", "1  elm st ", "2 Oak", None, " ")), rng.choice(("DEM", "Democratic", "REP", None))) for i in range(160)]
    data += [data[3], (900, None, _day(1), _at(1), "x", "REP"), (901, "g1", None, _at(1), "x", "REP"), (902, "g3", _day(1), _at(1), None, "")]
    got = bitemporal_ledger(_reports(spark.createDataFrame(data, UPD)), hot_rows=hot)
    assert {tuple(r) for r in got.collect()} == _brute(data)


def test_late_report_splits_and_versions(spark, rows):
    data = [(1, "g", _day(0), _at(0), "A", "DEM"), (2, "g", _day(9), _at(9), "C", None), (3, "g", _day(4), _at(20), "B", None), (3, "g", _day(4), _at(20), "B", None), (4, "g", _day(6), _at(21), "b ", "democratic")]
    ledger = bitemporal_ledger(_reports(spark.createDataFrame(data, UPD)))
    now = versions(known_at(ledger), ["a", "party"])
    assert rows(now, "valid_from", "valid_to", "a", "party") == [(_day(0), _day(4), "A", "DEM"), (_day(4), _day(9), "B", "DEM"), (_day(9), None, "C", "DEM")]
    then = versions(known_at(ledger, F.lit(_at(10))), ["a", "party"])
    assert rows(then, "valid_from", "a") == [(_day(0), "A"), (_day(9), "C")]
    assert bitemporal_ledger(_reports(spark.createDataFrame([], UPD))).count() == 0


def test_missing_and_extreme_times(spark):
    data = [(1, "g", _day(0), None, "A", None), (2, "g", dt.date(1500, 1, 1), dt.datetime(3000, 1, 1), "x" * 20_000, None)]
    got = bitemporal_ledger(_reports(spark.createDataFrame(data, UPD).withColumn("entity", F.lit("clash")).withColumn("eff", F.lit(1))))
    assert got.count() == 2


SNAP = "d date, l timestamp, c string, id string, party string, reg string, extra string"


def _diff(df):
    return snapshot_diff(df, "d", {"county": squeezed(F.col("c")), "fid": squeezed(F.col("id"))}, {"party": coded(F.col("party")), "reg": dated(F.col("reg"))}, "l")


def test_snapshot_changes(spark, rows):
    one = [(_day(0), _at(0), "C1", i, p, r, "") for i, p, r in (("a", "DEM", "2020-01-02"), ("b", "REP", None), ("c", "IND", "x"), (" d", "GRN", "1/2/2020"))]
    two = [(_day(9), _at(t), c, i, p, r, "") for t, c, i, p, r in ((1, "C1", "A ", "Democratic", "01/02/2020"), (1, "C1", "b", "REP", "20200101"), (1, "C1", "b", "REP", "20200101"), (0, "C1", "d", "REP", None), (2, "C1", "d", "grn", "2020-01-02 00:00:00"), (1, "C2", "c", "IND", "x"), (1, "C1", None, "x", "y"), (1, "C1", " ", "x", "y"))]
    got = _diff(spark.createDataFrame(one + two, SNAP).withColumn("_hash", F.lit(1)).withColumn("snapshot", F.lit("clash")))
    assert rows(got, "county", "fid", "change_kind") == [("C1", "B", "changed"), ("C1", "C", "removed"), ("C2", "C", "added")]
    assert _diff(spark.createDataFrame(one, SNAP)).count() == 0 and _diff(spark.createDataFrame([], SNAP)).count() == 0


def test_null_and_shifted_values_hash_apart(spark, rows):
    one = [(_day(0), _at(0), "C", "a", "X", None, ""), (_day(0), _at(0), "C", "b", None, None, "")]
    two = [(_day(1), _at(0), "C", "a", None, "X", ""), (_day(1), None, "C", "b", "", " ", "")]
    assert rows(_diff(spark.createDataFrame(one + two, SNAP)), "fid", "change_kind") == [("A", "changed")]


CSV = [
    (1, 1, "^name^,born_at,age,residential_lat", None),
    (1, 2, "ann,2000-02-29,5,1.5", None),
    (1, 3, "^a,^^b^,,,", None),
    (1, 4, "ann,2001-02-29,5,1", "invalid_value"),
    (1, 5, "x,,5", "column_count"),
    (1, 6, "x,,5,1,", "column_count"),
    (1, 7, "^open,2000-01-01,5,1", "quoting"),
    (1, 8, "fine,2000-01-01,5,1", None),
    (1, 9, "s^tray,a,b,c,d,e", "quoting"),
    (1, 10, "^a^b,2000-01-01,5,1", "quoting"),
    (1, 11, "^line\nbreak^,,,", None),
    (1, 12, "line\nbreak,,,", "quoting"),
    (1, 13, "", "skip"),
    (1, 14, None, "skip"),
    (1, 15, "x,,^^,90", None),
    (1, 16, "x,,^-1^,", "invalid_value"),
    (1, 17, "x,,,-90.01", "invalid_value"),
    (1, 18, "last,,,^", "quoting"),
    (2, 1, "a|is_perm_absentee", None),
    (2, 2, "'it''s|'|t", None),
    (2, 3, "x|TRUE", "invalid_value"),
    (2, 4, "y" * 300_000 + "|f", None),
    (3, 2, "no,header", "column_count"),
]


@pytest.mark.parametrize("chunk", [5_000, 2])
def test_rejects(spark, rows, chunk):
    records = spark.createDataFrame([(f, n, raw, "x") for f, n, raw, _ in CSV], "file_id long, row_no int, raw string, header string")
    files = spark.createDataFrame([(1, None, None), (2, "|", "'")], "file_id long, delimiter string, quote string")
    got = load_with_rejects(records, files, chunk_records=chunk)
    want = sorted((f, n, why) for f, n, _, why in CSV if why not in (None, "skip"))
    assert rows(rejects(got)) == want
    good = typed_rows(got, ["name", "born_at", "age", "residential_lat", "is_perm_absentee", "a"])
    kept = {(r["file_id"], r["row_no"]): r for r in good.collect()}
    assert sorted(kept) == sorted((f, n) for f, n, _, why in CSV if why is None and n > 1)
    assert kept[1, 3]["name"] == "a,^b" and kept[1, 2]["born_at"] == dt.date(2000, 2, 29) and kept[1, 11]["name"] == "line\nbreak" and kept[2, 2]["a"] == "it's|" and kept[2, 2]["is_perm_absentee"] is True
    assert load_with_rejects(records.limit(0), files).count() == 0 and load_with_rejects(records, files.limit(0)).count() == len([1 for f, n, raw, _ in CSV if n > 1 and raw])


def test_many_open_quotes_stay_with_their_record(spark):
    from rollmill.sources.rejects import load_chunk

    rng = random.Random(2)
    raws = [rng.choice(("a,b", "^a,b", "a^,b", "^a^,b", "a,^b", "^x,y^,z", "a,b,c")) for _ in range(400)]
    got = load_chunk("h,k", list(range(400)), raws, ",", "^", {})
    why = {"a,b": None, "^a,b": "quoting", "a^,b": "quoting", "^a^,b": None, "a,^b": "quoting", "^x,y^,z": None, "a,b,c": "column_count"}
    assert [g[1] for g in got] == [why[r] for r in raws]


def test_reader_decides(monkeypatch):
    from rollmill.sources import rejects as module

    asked, split = [], module.split_record
    monkeypatch.setattr(module, "split_record", lambda raw, *dialect: asked.append(raw) or split(raw, *dialect))
    raws = ["a,b", "a", "a,b,c", "^a,b", "c", "a^,b", "x,y,z,w", "^q^x,b"]
    got = module.load_chunk("h,k", list(range(8)), raws, ",", "^", {})
    assert [g[1] for g in got] == [None, "column_count", "column_count", "quoting", "column_count", "quoting", "column_count", "quoting"]
    # The grammar is asked only where the reader loaded a field that holds the quote.
    assert asked == ["h,k", "a^,b"]
    # Fields and reasons are the reader's: without it nothing loads, with another verdict another comes out.
    monkeypatch.setattr(module, "_read", lambda files, names, *rest: ({}, {}))
    assert {g[1] for g in module.load_chunk("h,k", [0], ["a,b"], ",", "^", {})} == {"quoting"}
    monkeypatch.setattr(module, "_read", lambda files, names, *rest: ({0: ("A", "B", False)}, {1: "column_count"}))
    assert module.load_chunk("h,k", [0, 1], ["a,b", "c,d"], ",", "^", {}) == [(0, None, ["h", "k"], ["A", "B"]), (1, "column_count", None, None)]


def _loads(spark, odd):
    rng = random.Random(1)
    data = []
    for load in range(1, 9):
        for i in range(150):
            phone = rng.choice((None, "", f"({rng.choice((201, 217, 304))}) 555-{rng.randrange(10000):04d}", "call back"))
            email = None if load == 3 and odd else rng.choice((None, f"a{i}@x.com", f"b{i}@y.org"))
            gender = rng.choice("mf") if not (load == 5 and odd) else rng.choice(("1", "2"))
            born = f"{rng.randrange(1930, 2003)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}" if not (load == 7 and odd) else "1950-01-01"
            data.append((1, load, phone, email, gender, born))
    data += [(2, 21, None, None, None, None), (2, 22, "x", "x", "x", "x")]
    return spark.createDataFrame(data, "feed_id int, load_id int, phone string, email string, gender string, born_at string").withColumn("n", F.lit(1)).withColumn("value", F.lit("clash"))


def test_departing_loads(spark, rows):
    found = departing(drift(_loads(spark, True), contact_checks(), "feed_id", "load_id"))
    assert rows(found, "load", "column_name") == [(3, "email"), (5, "gender"), (7, "born_at")]
    assert departing(drift(_loads(spark, False), contact_checks(), "feed_id", "load_id")).count() == 0
    empty = _loads(spark, False).limit(0)
    assert departing(drift(empty, contact_checks(), "feed_id", "load_id")).count() == 0 and profile(empty, contact_checks(), "feed_id", "load_id").count() == 0


@pytest.mark.parametrize("values, times", [(1, 24), (10, 15), (30, 5)])
def test_repeated_values_depart(spark, rows, values, times):
    # Well-formed numbers of the usual area code and shape; only their repetition is unusual.
    data = [(1, load, f"201-555-{i % values if load == 4 and i < values * times else load * 200 + i:04d}", None, None, None) for load in range(1, 9) for i in range(150)]
    df = spark.createDataFrame(data, "feed_id int, load_id int, phone string, email string, gender string, born_at string")
    assert rows(departing(drift(df, contact_checks(), "feed_id", "load_id")), "load", "column_name", "facet") == [(4, "phone", "value")]
    few = df.where("load_id <> 4").withColumn("phone", F.when(F.expr("load_id <> 2 OR phone LIKE '%0'"), F.col("phone")))
    assert departing(drift(few, contact_checks(), "feed_id", "load_id")).where("facet = 'value'").count() == 0


def test_profile_counts(spark):
    t = spark.createDataFrame([(1, 1, p, None, "F", "2000-02-30") for p in ("201-555-0100", "201-555-0100", "", None, "x")], "feed_id int, load_id int, phone string, email string, gender string, born_at string")
    got = {r["column_name"]: r for r in profile(t, contact_checks(), "feed_id", "load_id").collect()}
    p = got["phone"]
    assert (p["n_rows"], p["n_null"], p["n_blank"], p["n_ill"], p["n_distinct"], p["top_n"], p["top_value"]) == (5, 1, 1, 1, 2, 2, "201-555-0100")
    assert got["email"]["n_distinct"] == 0 and got["email"]["min_value"] is None and got["born_at"]["n_ill"] == 5 and got["gender"]["n_ill"] == 0
