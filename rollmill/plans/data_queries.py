"""Queries of the general data problems over the voter tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import PARTY_CODES, coded, dated, squeezed
from ..operators.history import bitemporal_ledger, known_at, reports, versions
from ..operators.quality import contact_checks, departing, drift, profile
from ..operators.snapshot import snapshot_diff
from ..sources.rejects import load_with_rejects, rejects, typed_rows
from .tables import table

HISTORY_FIELDS = ("residential_address1", "party", "reg_status")

#: Columns of the loaded voter files, in the order of the result.
FILE_COLUMNS = ["county_file_id", "first_name", "last_name", "gender", "born_at", "age", "party", "registered_at", "is_perm_absentee", "email", "residential_address1", "residential_zip5", "residential_lat", "notes"]


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"residential_address1": squeezed(F.col("residential_address1")), "party": coded(F.col("party")), "reg_status": squeezed(F.col("reg_status"))}
    return reports(table(spark, folder, "voter_updates"), "nbec_guid", "effective_on", "received_at", fields, "update_id")


def p1_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ledger, dates and times as text."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    ledger = bitemporal_ledger(_reports(spark, folder))
    return ledger.select(F.col("entity").alias("nbec_guid"), "field_name", "value", day("valid_from"), day("valid_to"), moment("recorded_from"), moment("recorded_to"))


def _versions(ledger: DataFrame) -> DataFrame:
    out = versions(ledger, HISTORY_FIELDS)
    return out.select(F.col("entity").alias("nbec_guid"), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), *HISTORY_FIELDS)


def p1_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of every voter as known now."""
    return _versions(known_at(bitemporal_ledger(_reports(spark, folder))))


def p1_as_known(spark: SparkSession, folder: str) -> DataFrame:
    """Every version as it was known at the end of 2022."""
    return _versions(known_at(bitemporal_ledger(_reports(spark, folder)), F.lit("2022-12-31 23:59:59").cast("timestamp")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_versions(spark, folder).select("nbec_guid", "valid_from")


def p4_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every change between consecutive snapshots with the values before and after."""
    keys = {"county_code": squeezed(F.col("county_code")), "county_file_id": squeezed(F.col("county_file_id"))}
    compared = {"party": coded(F.col("party")), "registered_at": dated(F.col("registered_at"))}
    out = snapshot_diff(table(spark, folder, "voter_snapshots"), "snapshot_date", keys, compared, "loaded_at")
    return out.withColumnRenamed("snapshot", "snapshot_date").withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_changes(spark, folder).select("snapshot_date", "county_code", "county_file_id", "change_kind")


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    return load_with_rejects(table(spark, folder, "csv_rows"), table(spark, folder, "csv_files"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects(_loaded(spark, folder))


def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The loadable records as typed columns."""
    return typed_rows(_loaded(spark, folder), FILE_COLUMNS).drop("other")


def p7_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = profile(table(spark, folder, "voter_loads"), contact_checks(), "feed_id", "load_id")
    return out.withColumnsRenamed({"feed": "feed_id", "load": "load_id"})


def _drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift(table(spark, folder, "voter_loads"), contact_checks(), "feed_id", "load_id")


def p7_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Stability index and chi-square of each column of each load against its feed."""
    out = _drift(spark, folder)
    return out.select(F.col("feed").alias("feed_id"), F.col("load").alias("load_id"), "column_name", "facet", F.round("psi", 6).alias("psi"), F.round("chi_square", 4).alias("chi_square"), "cells", "n_values")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return departing(_drift(spark, folder)).select(F.col("load").alias("load_id"), "column_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_versions, p1_as_known, p1_ledger, p4_found, p4_changes, p6_found, p6_loaded, p7_found, p7_profile, p7_drift)}


_SQUEEZE = r"nullif(upper(trim(regexp_replace({0}, '[\s ]+', ' ', 'g'))), '')"


def _sq(c: str) -> str:
    return _SQUEEZE.format(c)


def _party(c: str) -> str:
    return f"CASE {_sq(c)} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PARTY_CODES.items()) + f" ELSE {_sq(c)} END"


_P1_REPORTS = f"""
raw AS (SELECT trim(nbec_guid) g, effective_on e, received_at r, update_id u, {_sq('residential_address1')} a, {_party('party')} p, {_sq('reg_status')} s
        FROM voter_updates WHERE trim(nbec_guid) <> '' AND effective_on IS NOT NULL),
long AS (SELECT g, e, r, u, 'residential_address1' f, a v FROM raw WHERE a IS NOT NULL UNION ALL
         SELECT g, e, r, u, 'party', p FROM raw WHERE p IS NOT NULL UNION ALL SELECT g, e, r, u, 'reg_status', s FROM raw WHERE s IS NOT NULL),
rep AS (SELECT g, f, e, r, v FROM (SELECT *, row_number() OVER (PARTITION BY g, f, e, r ORDER BY u DESC, v DESC) k FROM long) WHERE k = 1)"""


def _versions_sql(known: str = "true") -> str:
    return f"""WITH {_P1_REPORTS},
cur AS (SELECT g, f, e, v FROM (SELECT *, row_number() OVER (PARTITION BY g, f, e ORDER BY r DESC) k FROM rep WHERE {known}) WHERE k = 1),
chg AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY g, f ORDER BY e) b FROM cur) WHERE b IS NULL OR b <> v),
wide AS (SELECT g, e, max(CASE WHEN f = 'residential_address1' THEN v END) a, max(CASE WHEN f = 'party' THEN v END) p, max(CASE WHEN f = 'reg_status' THEN v END) s FROM chg GROUP BY g, e)
SELECT g AS nbec_guid, strftime(e, '%Y-%m-%d') AS valid_from, strftime(lead(e) OVER w, '%Y-%m-%d') AS valid_to,
       last_value(a IGNORE NULLS) OVER w AS residential_address1, last_value(p IGNORE NULLS) OVER w AS party, last_value(s IGNORE NULLS) OVER w AS reg_status
FROM wide WINDOW w AS (PARTITION BY g ORDER BY e)"""


_P1_LEDGER = f"""WITH {_P1_REPORTS},
d AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY g, f, e ORDER BY r) b FROM rep) WHERE b IS NULL OR b <> v),
x AS (SELECT *, lead(r) OVER (PARTITION BY g, f, e ORDER BY r) gone FROM d),
cuts AS (SELECT a.g, a.f, a.e, a.v, a.r since, a.gone, a.r c FROM x a UNION
         SELECT a.g, a.f, a.e, a.v, a.r, a.gone, min(b.r) FROM x a JOIN x b ON a.g = b.g AND a.f = b.f AND b.e > a.e
         WHERE b.r > a.r AND (a.gone IS NULL OR b.r < a.gone) GROUP BY a.g, a.f, a.e, a.v, a.r, a.gone, b.e),
ends AS (SELECT k.g, k.f, k.e, k.v, k.gone, k.c, min(b.e) upto FROM cuts k LEFT JOIN x b ON b.g = k.g AND b.f = k.f AND b.e > k.e AND b.r <= k.c GROUP BY ALL),
runs AS (SELECT g, f, e, v, gone, upto, min(c) c FROM ends GROUP BY ALL)
SELECT g AS nbec_guid, f AS field_name, v AS value, strftime(e, '%Y-%m-%d') AS valid_from, strftime(upto, '%Y-%m-%d') AS valid_to,
       strftime(c, '%Y-%m-%d %H:%M:%S') AS recorded_from, strftime(coalesce(lead(c) OVER (PARTITION BY g, f, e, gone ORDER BY c), gone), '%Y-%m-%d %H:%M:%S') AS recorded_to FROM runs"""

_DATE = (
    r"coalesce(strftime(coalesce(CASE WHEN regexp_matches({0}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}([ T].*)?$') THEN try_strptime(regexp_extract({0}, '^[0-9-]+'), '%Y-%m-%d') END, "
    r"CASE WHEN regexp_matches({0}, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN try_strptime({0}, '%m/%d/%Y') END, CASE WHEN regexp_matches({0}, '^\d{{8}}$') THEN try_strptime({0}, '%Y%m%d') END), '%Y-%m-%d'), {0})"
).format(_sq("registered_at"))

_P4 = f"""WITH c AS (SELECT snapshot_date d, {_sq('county_code')} cc, {_sq('county_file_id')} id, loaded_at l, {_party('party')} p, {_DATE} r FROM voter_snapshots),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, cc, id ORDER BY l DESC, p, r) n FROM c WHERE d IS NOT NULL AND cc IS NOT NULL AND id IS NOT NULL) WHERE n = 1),
days AS (SELECT d, lead(d) OVER (ORDER BY d) nx, lag(d) OVER (ORDER BY d) pv FROM (SELECT DISTINCT snapshot_date d FROM voter_snapshots WHERE snapshot_date IS NOT NULL)),
a AS (SELECT nx d, cc, id, p, r FROM k JOIN days USING (d) WHERE nx IS NOT NULL),
b AS (SELECT d, cc, id, p, r FROM k JOIN days USING (d) WHERE pv IS NOT NULL),
j AS (SELECT coalesce(a.d, b.d) d, coalesce(a.cc, b.cc) cc, coalesce(a.id, b.id) id, a.p ap, b.p bp, a.r ar, b.r br,
      CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.p IS DISTINCT FROM b.p OR a.r IS DISTINCT FROM b.r THEN 'changed' END kind
      FROM a FULL JOIN b ON a.d = b.d AND a.cc = b.cc AND a.id = b.id)
SELECT strftime(d, '%Y-%m-%d') AS snapshot_date, cc AS county_code, id AS county_file_id, @more kind AS change_kind FROM j WHERE kind IS NOT NULL"""

_P7_STATE = r"""CASE WHEN v IS NULL THEN 'null' WHEN trim(v) = '' THEN 'blank' WHEN CASE column_name
 WHEN 'phone' THEN regexp_full_match(trim(v), '(\+?1[-. ]?)?(\(\d{3}\) ?|\d{3}[-. ]?)\d{3}[-. ]?\d{4}')
 WHEN 'email' THEN regexp_full_match(trim(v), '[^@\s]+@[^@\s]+\.[A-Za-z]{2,}')
 WHEN 'gender' THEN lower(trim(v)) IN ('f', 'm', 'x', 'u', 'female', 'male', 'unknown', 'nonbinary')
 ELSE coalesce(CASE WHEN regexp_full_match(trim(v), '\d{4}-\d{2}-\d{2}') THEN try_strptime(trim(v), '%Y-%m-%d') END,
   CASE WHEN regexp_full_match(trim(v), '\d{1,2}/\d{1,2}/\d{4}') THEN try_strptime(trim(v), '%m/%d/%Y') END,
   CASE WHEN regexp_full_match(trim(v), '\d{8}') THEN try_strptime(trim(v), '%Y%m%d') END) IS NOT NULL END THEN 'ok' ELSE 'ill' END"""

_P7_PROFILE = f"""WITH u AS (SELECT feed_id, load_id, 'phone' column_name, phone v FROM voter_loads UNION ALL SELECT feed_id, load_id, 'email', email FROM voter_loads UNION ALL
 SELECT feed_id, load_id, 'gender', gender FROM voter_loads UNION ALL SELECT feed_id, load_id, 'born_at', born_at FROM voter_loads),
c AS (SELECT feed_id, load_id, column_name, v, count(*) n, {_P7_STATE} st FROM u GROUP BY ALL)
SELECT feed_id, load_id, column_name, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (st = 'null'), 0) AS BIGINT) AS n_null,
 CAST(coalesce(sum(n) FILTER (st = 'blank'), 0) AS BIGINT) AS n_blank, CAST(coalesce(sum(n) FILTER (st = 'ill'), 0) AS BIGINT) AS n_ill,
 count(*) FILTER (st IN ('ok', 'ill')) AS n_distinct, min(v) FILTER (st IN ('ok', 'ill')) AS min_value, max(v) FILTER (st IN ('ok', 'ill')) AS max_value,
 CAST(min(length(v)) FILTER (st IN ('ok', 'ill')) AS INT) AS min_length, CAST(max(length(v)) FILTER (st IN ('ok', 'ill')) AS INT) AS max_length,
 max(n) FILTER (st IN ('ok', 'ill')) AS top_n, max({{'n': n, 'v': v}}) FILTER (st IN ('ok', 'ill')).v AS top_value
FROM c GROUP BY feed_id, load_id, column_name"""


#: The grammar of records as one pattern per file; quoted fields become a sign, so that the
#: delimiters left are those between fields.
_P6 = r"""WITH f AS (SELECT file_id, coalesce(delimiter, ',') d, coalesce(quote, '^') q FROM csv_files),
x AS (SELECT c.file_id, c.row_no, c.raw, f.d, f.q, regexp_escape(f.d) ed, regexp_escape(f.q) eq FROM csv_rows c JOIN f USING (file_id) WHERE length(c.raw) > 0),
p AS (SELECT *, '(?:' || eq || '(?:[^' || eq || ']|' || eq || eq || ')*' || eq || '|[^' || eq || ed || '\r\n]*)' one FROM x),
y AS (SELECT file_id, row_no, d, q, regexp_full_match(raw, one || '(?:' || ed || one || ')*') fits,
  string_split(regexp_replace(raw, '(^|' || ed || ')' || eq || '(?:[^' || eq || ']|' || eq || eq || ')*' || eq, '\1' || chr(2), 'g'), d) parts,
  regexp_extract_all(raw, '(?:^|' || ed || ')' || eq || '((?:[^' || eq || ']|' || eq || eq || ')*)' || eq, 1) quoted FROM p),
z AS (SELECT file_id, row_no, fits, list_transform(parts, lambda v, i: CASE WHEN v = chr(2) THEN replace(quoted[len(list_filter(parts[1:i], lambda w: w = chr(2)))], q || q, q) ELSE v END) fields FROM y),
h AS (SELECT file_id, fields AS names FROM z WHERE row_no = 1),
b AS (SELECT z.*, h.names FROM z JOIN h USING (file_id) WHERE row_no > 1),
v AS (SELECT file_id, row_no, unnest(names) k, unnest(fields) v FROM b WHERE fits AND len(fields) = len(names)),
bad AS (SELECT DISTINCT file_id, row_no FROM v WHERE v <> '' AND NOT CASE
  WHEN k IN ('born_at', 'registered_at') THEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v AS DATE) IS NOT NULL
  WHEN k = 'age' THEN regexp_full_match(v, '[0-9]+') WHEN k = 'is_perm_absentee' THEN v IN ('t', 'f', 'true', 'false')
  WHEN k = 'residential_zip5' THEN regexp_full_match(v, '[0-9]{5}')
  WHEN k = 'residential_lat' THEN regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?') AND abs(try_cast(v AS DOUBLE)) <= 90 ELSE true END)"""

_P6_FOUND = _P6 + r"""
SELECT b.file_id, b.row_no, CASE WHEN NOT fits THEN 'quoting' WHEN len(fields) <> len(names) THEN 'column_count' ELSE 'invalid_value' END AS reason
FROM b LEFT JOIN bad ON b.file_id = bad.file_id AND b.row_no = bad.row_no WHERE NOT fits OR len(fields) <> len(names) OR bad.row_no IS NOT NULL"""

_P6_LOADED = (
    _P6
    + "\nSELECT b.file_id, b.row_no, "
    + ", ".join(
        (
            "TRY_CAST({0} AS {1}) AS {2}" if t != "BOOLEAN" else "CASE WHEN {0} IN ('t', 'true') THEN true WHEN {0} IN ('f', 'false') THEN false END AS {2}"
        ).format(f"nullif(fields[list_position(names, '{c}')], '')", t, c)
        for c, t in ((c, {"born_at": "DATE", "registered_at": "DATE", "age": "INT", "is_perm_absentee": "BOOLEAN", "residential_lat": "DECIMAL(38,18)"}.get(c, "VARCHAR")) for c in FILE_COLUMNS)
    )
    + " FROM b LEFT JOIN bad ON b.file_id = bad.file_id AND b.row_no = bad.row_no WHERE fits AND len(fields) = len(names) AND bad.row_no IS NULL"
)

_P7_BORN = r"coalesce(CASE WHEN regexp_full_match(trim(v), '\d{4}-\d{2}-\d{2}') THEN try_strptime(trim(v), '%Y-%m-%d') END, CASE WHEN regexp_full_match(trim(v), '\d{1,2}/\d{1,2}/\d{4}') THEN try_strptime(trim(v), '%m/%d/%Y') END, CASE WHEN regexp_full_match(trim(v), '\d{8}') THEN try_strptime(trim(v), '%Y%m%d') END)"

_P7_FOUND = rf"""WITH u AS (SELECT feed_id f, load_id l, 'phone' column_name, phone v FROM voter_loads UNION ALL SELECT feed_id, load_id, 'email', email FROM voter_loads UNION ALL
 SELECT feed_id, load_id, 'gender', gender FROM voter_loads UNION ALL SELECT feed_id, load_id, 'born_at', born_at FROM voter_loads),
c AS (SELECT f, l, column_name, v, count(*) n, {_P7_STATE} st FROM u GROUP BY ALL),
held AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(v), '[0-9]', '9', 'g'), '\p{{Ll}}+', 'a', 'g'), '\p{{Lu}}+', 'A', 'g'), 'a9+', 'a9', 'g') shape,
  CASE column_name WHEN 'phone' THEN CASE WHEN length(regexp_replace(v, '\D', '', 'g')) >= 10 THEN substring(right(regexp_replace(v, '\D', '', 'g'), 10), 1, 3) ELSE 'short' END
   WHEN 'email' THEN CASE WHEN contains(v, '@') THEN lower(string_split(trim(v), '@')[-1]) ELSE 'none' END WHEN 'gender' THEN lower(trim(v))
   ELSE coalesce(CAST(CAST(floor(year({_P7_BORN}) / 10) AS INT) AS VARCHAR), regexp_extract(trim(v), '\d{{4}}')) END part,
  n >= 0.2 * sum(n) OVER (PARTITION BY f, l, column_name) hv FROM c WHERE st IN ('ok', 'ill')),
kept AS (SELECT DISTINCT f, column_name, v FROM held WHERE hv),
cells AS (SELECT f, l, column_name, 'state' facet, st cell, sum(n) n FROM c GROUP BY ALL UNION ALL SELECT f, l, column_name, 'shape', shape, sum(n) FROM held GROUP BY ALL UNION ALL
  SELECT f, l, column_name, 'part', part, sum(n) FROM held GROUP BY ALL UNION ALL
  SELECT held.f, l, held.column_name, 'value', CASE WHEN kept.v IS NOT NULL THEN held.v ELSE '~other' END, sum(n) FROM held LEFT JOIN kept ON kept.f = held.f AND kept.column_name = held.column_name AND kept.v = held.v GROUP BY ALL),
t AS (SELECT f, l, column_name, facet, cell, n, sum(n) OVER (PARTITION BY f, l, column_name, facet) t FROM cells),
loads AS (SELECT DISTINCT f, l, column_name, facet, t FROM t), many AS (SELECT f, column_name, facet, count(*) m FROM loads GROUP BY ALL),
usual AS (SELECT f, column_name, facet, cell, s / sum(s) OVER (PARTITION BY f, column_name, facet) q FROM
  (SELECT f, column_name, facet, cell, n / CAST(t AS DOUBLE) s, row_number() OVER (PARTITION BY f, column_name, facet, cell ORDER BY n / CAST(t AS DOUBLE) DESC, l) r FROM t) JOIN many USING (f, column_name, facet) WHERE r = m - CAST(floor((m - 1) / 2) AS INT)),
w AS (SELECT f, l, column_name, facet, cell, max(t) t, sum(q) q, sum(n) n FROM (SELECT f, l, column_name, facet, cell, t, q, 0 n FROM usual JOIN loads USING (f, column_name, facet) UNION ALL SELECT f, l, column_name, facet, cell, t, 0, n FROM t) GROUP BY ALL),
d AS (SELECT f, l, column_name, facet, sum(((n + 0.5) / (t + 1.0) - (q * t + 0.5) / (t + 1.0)) * ln(((n + 0.5) / (t + 1.0)) / ((q * t + 0.5) / (t + 1.0)))) psi, sum((n - q * t) ** 2 / (q * t + 0.5)) chi, greatest(count(*) FILTER (q > 0) - 1, 1) k, max(t) t FROM w GROUP BY ALL)
SELECT DISTINCT l AS load_id, column_name FROM d JOIN many USING (f, column_name, facet) WHERE psi > 0.25 + 2.0 * k / t AND chi > k + 6 * sqrt(2.0 * k) AND m >= 3"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries; the index values of p7_drift are held against p7_found's SQL and
    against planted loads in the tests."""
    known = "r <= TIMESTAMP '2022-12-31 23:59:59'"
    return {
        "p1_found": f"SELECT nbec_guid, valid_from FROM ({_versions_sql()})",
        "p1_versions": _versions_sql(),
        "p1_as_known": _versions_sql(known),
        "p1_ledger": _P1_LEDGER,
        "p4_found": _P4.replace("@more", ""),
        "p4_changes": _P4.replace("@more", "ap AS party_before, ar AS registered_at_before, bp AS party_after, br AS registered_at_after,"),
        "p6_found": _P6_FOUND,
        "p6_loaded": _P6_LOADED,
        "p7_found": _P7_FOUND,
        "p7_profile": _P7_PROFILE,
    }
