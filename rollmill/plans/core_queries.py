"""Queries for the record-linking operators over the TPC-H-like tables, with their SQL.

The customer scenario links a source of even customers, some without a name and all with a
balance one higher, to a target without every third customer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import EMAIL_FORM, date_or_null, election_name, email_valid, load_extension
from ..jobs import DedupJob, DedupPlan, ImportJob, MergePlan
from ..operators import audit
from ..operators.dedup import check_links, collapse, dedup_links
from ..operators.geo import prepare_for_geocoding
from ..operators.match import match
from ..operators.merge import merge
from ..operators.shape import constrain, copy_column, map_column_from, shape
from ..operators.trigram import similarity
from ..sources.catalog import Driver, copy_text
from ..sources.delimited import fits_grammar
from ..spec import MatchSpec, MergeSpec, TableSpec
from .tables import table

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]


# -- customer scenario ------------------------------------------------------------------------


def _target(spark: SparkSession, folder: str) -> DataFrame:
    spec = (
        TableSpec()
        .map_column("id", "c_custkey", "bigint")
        .map_column("name", "c_name", "text")
        .map_column("nation", "c_nationkey", "int")
        .map_column("segment", "c_mktsegment", "text")
        .map_column("bucket", "c_acctbal", expr="CAST(floor($S / 500) AS INT)")
        .map_column("balance", "c_acctbal", "double")
        .add_column("old_balance", "double")
        .constrain("c_custkey", "$S % 3 <> 0")
    )
    return shape(table(spark, folder, "customer"), spec)


def _source(spark: SparkSession, folder: str) -> DataFrame:
    spec = (
        TableSpec()
        .map_column("id", "c_custkey", expr="$S + 100000")
        .map_column("name", "c_name", expr="CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE $S END")
        .map_column("nation", "c_nationkey", "int")
        .map_column("segment", "c_mktsegment", "text")
        .map_column("bucket", "c_acctbal", expr="CAST(floor($S / 500) AS INT)")
        .map_column("balance", "c_acctbal", expr="$S + 1")
        .constrain("c_custkey", "$S % 2 = 0")
    )
    return shape(table(spark, folder, "customer"), spec)


_BASE = MatchSpec("id", "id")
_CASCADE = _BASE.exact("name").exact("nation", "segment", "bucket")

_CUST = """src AS (SELECT c_custkey + 100000 id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, c_nationkey nation, c_mktsegment segment, CAST(floor(c_acctbal / 500) AS INT) bucket, c_acctbal + 1 balance FROM customer WHERE c_custkey % 2 = 0),
tgt AS (SELECT c_custkey id, c_name AS name, c_nationkey nation, c_mktsegment segment, CAST(floor(c_acctbal / 500) AS INT) bucket, c_acctbal balance, CAST(NULL AS DOUBLE) old_balance FROM customer WHERE c_custkey % 3 <> 0)"""


def _cascade_sql(steps: list[str], groups: list[int] | None = None) -> str:
    """CTEs of a cascade run step after step; ``steps`` are ON conditions."""
    tags = groups or list(range(len(steps)))
    parts, seen = [], []
    for i, on in enumerate(steps):
        skip = " AND ".join(f"s.id NOT IN (SELECT sid FROM g{k})" for k in seen)
        parts.append(f"g{i} AS (SELECT s.id sid, min(t.id) m FROM src s JOIN tgt t ON {on} {'WHERE ' + skip if skip else ''} GROUP BY s.id)")
        seen.append(i)
    hit = ", ".join(f"g{i}.m" for i in range(len(steps)))
    step = " ".join(f"WHEN g{i}.m IS NOT NULL THEN {tags[i]}" for i in range(len(steps)))
    joins = " ".join(f"LEFT JOIN g{i} ON s.id = g{i}.sid" for i in range(len(steps)))
    parts.append(f"w AS (SELECT s.*, row_number() OVER (ORDER BY s.id) working_source_id, coalesce({hit}) working_target_id, CASE {step} END match_step FROM src s {joins})")
    return ",\n".join(parts)


_ON_NAME = "s.name = t.name"
_ON_BUCKET = "s.nation = t.nation AND s.segment = t.segment AND s.bucket = t.bucket"
_LINKS = "SELECT id, working_source_id, working_target_id, match_step FROM w"


def _links(linked: DataFrame) -> DataFrame:
    return linked.select("id", "working_source_id", "working_target_id", "match_step")


def _linked(spark: SparkSession, folder: str, spec: MatchSpec = _CASCADE) -> DataFrame:
    return match(_source(spark, folder), _target(spark, folder), spec)


def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    return _links(_linked(spark, folder, _BASE.exact("name")))


def match_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return _links(_linked(spark, folder))


def match_constrained(spark: SparkSession, folder: str) -> DataFrame:
    """A residual predicate over both sides holds in every step."""
    return _links(_linked(spark, folder, _CASCADE.constrain("balance", "$T < $S").constrain("bucket", "$S >= 0")))


_NESTED = _BASE.exact("name").nested(_BASE.exact("nation", "segment", "bucket").exact("nation", "bucket").constrain("balance", "$S > 0")).exact("segment", "bucket")


def match_nested(spark: SparkSession, folder: str) -> DataFrame:
    """A nested cascade with its own constraint stands between two steps."""
    return _links(_linked(spark, folder, _NESTED))


def foreign_key_match(spark: SparkSession, folder: str) -> DataFrame:
    """Orders linked to customers by keys of different names, and by a mixed group."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderstatus").alias("status"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("status")).where("id % 4 <> 0")
    spec = MatchSpec("id", "id").exact(("o_custkey", "id"), "status").foreign_key("o_custkey", "id")
    return _links(match(orders, customers, spec))


def match_join_table(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers linked to customers of their segment rule, with the nation joined in."""
    source = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    target = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    nations = table(spark, folder, "nation")
    spec = MatchSpec("id", "id").exact("nation").join_table("n", nations, "n.n_nationkey = t.nation").constrain("nation", "n.n_regionkey IN (1, 3) AND $S IS NOT NULL")
    return _links(match(source, target, spec))


def _reviews(spark: SparkSession, folder: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Reviews that are not known to be verified, and verified ones: together the whole table."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), column, "is_verified")
    return docs.where("NOT coalesce(is_verified, false)").drop("is_verified"), docs.where("is_verified").drop("is_verified")


def fuzzy_match(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of other reviews linked to the most similar titles of verified ones."""
    return _links(match(*_reviews(spark, folder, "title"), MatchSpec("id", "id").fuzzy("title")))


def fuzzy_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts of other reviews linked to the most similar whole texts of verified ones."""
    return _links(match(*_reviews(spark, folder, "text"), MatchSpec("id", "id").fuzzy("text")))


def _misspelt(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All parts, a third of them with a letter too many, and all parts."""
    part = table(spark, folder, "part")
    source = part.select((F.col("p_partkey") + 1_000_000).alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))
    return source, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))


def fuzzy_after_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exact on name and brand; the rest by trigrams of the name, from targets not yet taken."""
    source, target = _misspelt(spark, folder)
    return _links(match(source, target, MatchSpec("id", "id").exact("name", "brand").fuzzy("name")))


def fuzzy_constrained(spark: SparkSession, folder: str) -> DataFrame:
    """A trigram step whose candidates must be of the same brand."""
    source, target = _misspelt(spark, folder)
    return _links(match(source, target, MatchSpec("id", "id").constrain("brand", "$T = $S").fuzzy("name")))


def fuzzy_two_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Two trigram steps: what the first takes is gone from the candidates of the second."""
    source, target = _misspelt(spark, folder)
    return _links(match(source, target, MatchSpec("id", "id").exact("name", "brand").fuzzy("name", "kind")))


# -- upsert -----------------------------------------------------------------------------------

_KEEP = MergeSpec(preserved=frozenset({"id"}), excluded=frozenset({"bucket"}), constraints=(("name", "$S IS NOT NULL"),))


def _merged(spark: SparkSession, folder: str, rules: MergeSpec):
    return merge(_target(spark, folder), _linked(spark, folder), rules, "id", "id")


def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder, _KEEP).target


def merge_update_only(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder, MergeSpec(_KEEP.excluded, _KEEP.preserved, constraints=_KEEP.constraints, update_only=True)).target


def merge_insert_only(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder, MergeSpec(_KEEP.excluded, _KEEP.preserved, constraints=_KEEP.constraints, insert_only=True)).target


def merge_move_preserve(spark: SparkSession, folder: str) -> DataFrame:
    """The target's old balance moves aside, its segment is kept on update."""
    return _merged(spark, folder, _KEEP.preserve("segment").move(balance="old_balance")).target


def merge_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """Expressions over both sides on update, and over the source on insert."""
    return _merged(spark, folder, _KEEP.merge_column_as("balance", "$S + $T").insert_column_as("balance", "$S * 2").insert_column_as("old_balance", "s.balance - 1")).target


def merge_generated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """New rows get keys that count on from the target's largest, in the order of the source."""
    return _merged(spark, folder, MergeSpec(_KEEP.excluded, _KEEP.preserved, constraints=_KEEP.constraints, generate_key=True)).target


def merge_returned_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Generated keys, returned to the source rows they were made for."""
    rules = MergeSpec(_KEEP.excluded, _KEEP.preserved, constraints=_KEEP.constraints, generate_key=True).return_value("t.id", "written_id")
    return _merged(spark, folder, rules).source.select("id", "written_id")


def merge_neither(spark: SparkSession, folder: str) -> DataFrame:
    """Update-only and insert-only at once leave the target as it is."""
    return _merged(spark, folder, MergeSpec(_KEEP.excluded, _KEEP.preserved, constraints=_KEEP.constraints, update_only=True, insert_only=True)).target


def merge_return_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the written rows, returned to the source."""
    rules = _KEEP.return_value("t.id", "written_id").return_value("t.balance + s.balance", "both")
    return _merged(spark, folder, rules).source.select("id", "working_target_id", "written_id", "both")


_UPD = "upd AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY working_target_id ORDER BY working_source_id) rn FROM w WHERE working_target_id IS NOT NULL) x WHERE rn = 1)"
_FRESH = "w WHERE working_target_id IS NULL AND name IS NOT NULL"


def _merge_sql(update: dict[str, str], insert: dict[str, str] | None) -> str:
    cols = ["id", "name", "nation", "segment", "bucket", "balance", "old_balance"]
    got = ", ".join(f"CASE WHEN u.id IS NOT NULL THEN {update[c]} ELSE t.{c} END AS {c}" if c in update else f"t.{c}" for c in cols)
    text = f"WITH {_CUST}, {_cascade_sql([_ON_NAME, _ON_BUCKET])}, {_UPD} SELECT {got} FROM tgt t LEFT JOIN upd u ON u.working_target_id = t.id"
    if insert is not None:
        text += f" UNION ALL SELECT {', '.join(insert.get(c, 'NULL') + ' AS ' + c for c in cols)} FROM {_FRESH}"
    return text


_UPDATE = {c: f"u.{c}" for c in ("name", "nation", "segment", "balance")}
_INSERT = {c: c for c in ("id", "name", "nation", "segment", "balance")}


# -- de-duplication ---------------------------------------------------------------------------

_PART = MatchSpec("p_partkey", "p_partkey").exact("p_name", "p_brand")
_PART_SQL = "m AS (SELECT s.p_partkey, min(t.p_partkey) tg FROM part s LEFT JOIN part t ON s.p_name = t.p_name AND s.p_brand = t.p_brand AND t.p_partkey < s.p_partkey GROUP BY s.p_partkey)"


def dedup_match(spark: SparkSession, folder: str) -> DataFrame:
    links = dedup_links(table(spark, folder, "part"), _PART)
    return links.select("p_partkey", "working_target_id", "match_step")


def dedup_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Survivors, updated from their duplicates; the price becomes the sum of both."""
    part = table(spark, folder, "part")
    return collapse(part, dedup_links(part, _PART), MergeSpec().merge_column_as("p_retailprice", "$S + $T"), "p_partkey").target


def dedup_oriented(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicates point to dearer parts instead of smaller keys."""
    links = dedup_links(table(spark, folder, "part"), _PART, (("p_retailprice", "$T > $S"),))
    return links.select("p_partkey", "working_target_id")


def dedup_checks(spark: SparkSession, folder: str) -> DataFrame:
    return check_links(dedup_links(table(spark, folder, "part"), _PART), "p_partkey")


def audit_merge(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_links(_linked(spark, folder, _NESTED), _NESTED)


def audit_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_dedup(dedup_links(table(spark, folder, "part"), _PART), _PART)


#: Parts point to the next dearer way round: any part of their brand and size that is not cheaper.
_CHAINED = MatchSpec("p_partkey", "p_partkey").exact("p_brand", "p_size")
_NOT_CHEAPER = (("p_retailprice", "$T >= $S"), ("p_partkey", "$T >= $S - 400"))


def _chained(spark: SparkSession, folder: str) -> DataFrame:
    """Links under a rule that lets parts match themselves and lead on to others."""
    return dedup_links(table(spark, folder, "part"), _CHAINED, _NOT_CHEAPER)


def dedup_checks_found(spark: SparkSession, folder: str) -> DataFrame:
    return check_links(_chained(spark, folder), "p_partkey")


def audit_dedup_found(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_dedup(_chained(spark, folder), _CHAINED)


def _numbered_lines(spark: SparkSession, reports: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, i, x) for n, text in enumerate(reports) for i, x in enumerate(text.split("\n"))], "report long, position long, line string")


def merge_report(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a job's audit of a merge with a trigram step."""
    spec = _CASCADE.fuzzy("segment")
    job = ImportJob(spark, lambda driver: [MergePlan(_source(spark, folder), _target(spark, folder), spec, _KEEP)])
    return _numbered_lines(spark, job.perform_audit())


def dedup_report(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a job's audit of two de-duplications, one with self-matches and chains."""
    part = table(spark, folder, "part")
    job = DedupJob(spark, lambda driver: [DedupPlan(part, _PART), DedupPlan(part, _CHAINED, orientation=_NOT_CHEAPER)])
    return _numbered_lines(spark, job.perform_audit())


# -- shaping and column copies ----------------------------------------------------------------


def map_columns(spark: SparkSession, folder: str) -> DataFrame:
    spec = (
        TableSpec(default_type="text").map_column("order_id", "o_orderkey").map_column("total", "o_totalprice", "double").map_column("next_id", "o_orderkey", expr="$S + 1").add_column("note").with_default_type("int").map_column("customer", "o_custkey").add_column("votes")
    )
    return shape(table(spark, folder, "orders"), spec)


def constrain_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = constrain(table(spark, folder, "lineitem"), (("l_quantity", "$S > 45"), ("l_returnflag", "$S = 'R'")))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


def group_records(spark: SparkSession, folder: str) -> DataFrame:
    spec = TableSpec().map_column("order_id", "l_orderkey", "bigint").map_column("lines", expr="count(*)").map_column("most", "l_quantity", expr="max($S)").constrain("l_linenumber", "$S < 6").group_records_by("l_orderkey")
    return shape(table(spark, folder, "lineitem"), spec)


def copy_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier rows in the schema of the customer table."""
    spec = TableSpec().map_column("c_custkey", "s_suppkey").map_column("c_name", "s_name").copy_schema_from(table(spark, folder, "customer"))
    return shape(table(spark, folder, "supplier"), spec)


def copy_column_query(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.lit("none").alias("c_mktsegment"))
    customers = table(spark, folder, "customer").where("c_custkey % 3 <> 0").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return copy_column(orders, customers, "c_mktsegment", "c_custkey")


def map_column_expr(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return map_column_from(orders, table(spark, folder, "customer").where("c_acctbal > 0"), [("c_custkey", "o_custkey")], "o_totalprice", "c_acctbal", "$S + $T")


def copy_column_multi_key(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    target = lines.select("l_orderkey", "l_linenumber", F.lit(0.0).alias("l_tax"))
    return copy_column(target, lines.where("l_quantity > 25"), "l_tax", ["l_orderkey", "l_linenumber"])


# -- profiles, geocoding, functions -------------------------------------------------------------


def profile_key_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    return audit.key_uniqueness(table(spark, folder, "part"), "p_name")


def profile_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return audit.coverage(table(spark, folder, "voters"), audit.COVERAGE_COLUMNS)


def profile_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return audit.distributions(table(spark, folder, "voters"), ["is_perm_absentee", "party", "demo", "gender", "reg_status", "born_at", "age"])


def profile_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return audit.distribution(table(spark, folder, "voters"), "registered_at", 20)


def profile_total(spark: SparkSession, folder: str) -> DataFrame:
    return audit.total(table(spark, folder, "voters"))


def profile_geocoding(spark: SparkSession, folder: str) -> DataFrame:
    return audit.geocoding_breakdown(table(spark, folder, "voters"))


def geocode_prep(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("residential_address1"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).otherwise(F.col("s_nationkey") % 5).cast("int").alias("residential_lat"),
        F.col("s_nationkey").alias("residential_lng"),
    )
    return prepare_for_geocoding(suppliers).select("s_suppkey", "needs_geocoding", "location_geometry")


def geocode_absent(spark: SparkSession, folder: str) -> DataFrame:
    """A table without coordinates: they are added empty, and every address needs geocoding."""
    customers = table(spark, folder, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("residential_address1"))
    return prepare_for_geocoding(customers)


def table_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The declared columns of a working table, which of them are mapped, and its key."""
    spec = TableSpec().map_column("order_id", "o_orderkey", "bigint").add_column("note").map_column("lines", expr="count(*)").add_column("votes", "int").set_primary_key("order_id", "bigint")
    return spark.createDataFrame([(i, c, c in spec.mapped_column_names, c == spec.primary_key[0]) for i, c in enumerate(spec.column_names)], "position long, name string, mapped boolean, is_key boolean")


def fn_election_name(spark: SparkSession, folder: str) -> DataFrame:
    load_extension(spark, "election_name")
    orders = table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.element_at(F.array(*map(F.lit, ("PR", "ge", "PP", "sp", "XX"))), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("k"))
    return orders.select("o_orderkey", election_name(F.col("d"), F.col("k")).alias("as_column"), F.expr("election_name(d, k)").alias("as_sql"))


def fn_date_or_null(spark: SparkSession, folder: str) -> DataFrame:
    load_extension(spark, "date_or_null")
    rows = table(spark, folder, "voter_loads")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("row_id", text(date_or_null(F.col("born_at"))).alias("as_column"), text(F.expr("date_or_null(born_at)")).alias("as_sql"))


def fn_email_valid(spark: SparkSession, folder: str) -> DataFrame:
    load_extension(spark, "email_valid")
    rows = table(spark, folder, "voters")
    return rows.select("id", email_valid(F.col("email")).alias("as_column"), F.expr("email_valid(email)").alias("as_sql"))


def fn_similarity(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select("p_partkey", F.round(similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


def sql_passthrough(spark: SparkSession, folder: str) -> DataFrame:
    driver = Driver(spark)
    driver.register("orders_in", table(spark, folder, "orders"))
    return driver.exec_sql("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS dearest FROM orders_in GROUP BY o_orderpriority")


# -- delimited lines and sinks ------------------------------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as delimited lines, some with quoted, stray or surplus fields."""
    part = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 6
    line = (
        F.when(kind == 0, F.concat_ws(",", key, F.concat(F.lit("^"), "p_name", F.lit(", ^^new^^^")), "p_brand"))
        .when(kind == 1, F.concat_ws(",", key, F.concat("p_name", F.lit("^")), "p_brand"))
        .when(kind == 2, F.concat_ws(",", key, "p_name", "p_brand", F.lit("")))
        .when(kind == 3, F.concat_ws(",", key, "p_name"))
        .otherwise(F.concat_ws(",", key, "p_name", "p_brand"))
    )
    return part.select("p_partkey", line.alias("line"))


def malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Number of lines in all and of malformed ones."""
    bad = ~fits_grammar(F.col("line"), ",", "^", 3)
    return _lines(spark, folder).agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("malformed"))


def copy_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Voters in the text COPY form."""
    picked = ["id", "first_name", "phone", "is_perm_absentee", "updated_at"]
    return copy_text(table(spark, folder, "voters").select(*picked)).withColumnRenamed("value", "line")


def sql_count(spark: SparkSession, folder: str) -> DataFrame:
    """A count through the SQL passthrough, and one without a row, which is 0."""
    driver = Driver(spark)
    driver.register("voters_in", table(spark, folder, "voters"))
    some = driver.get_count("SELECT count(*) AS count FROM voters_in WHERE party = 'DEM'")
    none = driver.get_count("SELECT 1 AS count FROM voters_in WHERE false")
    return spark.sql(f"SELECT CAST({some} AS BIGINT) AS some, CAST({none} AS BIGINT) AS none")


def queries() -> Queries:
    named = {
        f.__name__: f
        for f in (
            exact_match, match_cascade, match_constrained, match_nested, foreign_key_match, match_join_table, fuzzy_match, fuzzy_texts, fuzzy_after_exact, fuzzy_constrained, fuzzy_two_columns,
            merge_upsert, merge_update_only, merge_insert_only, merge_move_preserve, merge_expressions, merge_generated_keys, merge_returned_keys, merge_neither, merge_return_values, merge_report,
            dedup_collapse, dedup_oriented, dedup_checks, dedup_checks_found, audit_merge, audit_dedup, audit_dedup_found, dedup_report,
            map_columns, constrain_rows, group_records, copy_schema, map_column_expr, copy_column_multi_key,
            profile_key_uniqueness, profile_coverage, profile_distribution, profile_top_k, profile_total, profile_geocoding,
            geocode_prep, geocode_absent, table_columns, fn_election_name, fn_date_or_null, fn_email_valid, fn_similarity, sql_passthrough,
            malformed_rows, copy_sink, sql_count,
        )
    }
    return named | {"copy_column": copy_column_query, "dedup_links": dedup_match}


_GRAMS = (
    r"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), "
    r"lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', i, 3)))))"
)


def _fuzzy_sql(pool: str, rest: str, column: str, extra: str = "true", tag: str = "") -> str:
    """CTEs z(sid, tid): the nearest row of ``pool`` for each row of ``rest``; texts compared once."""
    return f"""sx{tag} AS (SELECT {column} x, {_GRAMS.format(column)} g FROM (SELECT DISTINCT {column} FROM {rest} WHERE {column} IS NOT NULL)),
tx{tag} AS (SELECT {column} x, {_GRAMS.format(column)} g FROM (SELECT DISTINCT {column} FROM {pool} WHERE {column} IS NOT NULL)),
se{tag} AS (SELECT x, len(g) n, unnest(g) t FROM sx{tag}), te{tag} AS (SELECT x, len(g) n, unnest(g) t FROM tx{tag}),
pr{tag} AS (SELECT s.x sx, e.x tx, s.n a, e.n b, count(*) i FROM se{tag} s JOIN te{tag} e USING (t) GROUP BY ALL HAVING 3 * count(*) > s.n + e.n),
z{tag} AS (SELECT sid, tid FROM (SELECT s.id sid, t.id tid, row_number() OVER (PARTITION BY s.id ORDER BY CAST(i AS DOUBLE) / (a + b - i) DESC, t.id) rn
      FROM {rest} s JOIN pr{tag} ON s.{column} = pr{tag}.sx JOIN {pool} t ON t.{column} = pr{tag}.tx WHERE {extra}) WHERE rn = 1)"""


_MISSPELT = """src AS (SELECT p_partkey + 1000000 id, CASE WHEN p_partkey % 3 = 0 THEN p_name || 'x' ELSE p_name END AS name, p_type kind, p_brand brand FROM part),
tgt AS (SELECT p_partkey id, p_name AS name, p_type kind, p_brand brand FROM part)"""


def _review_sql(column: str) -> str:
    return f"""WITH src AS (SELECT doc_id id, {column} FROM documents WHERE NOT coalesce(is_verified, false)), tgt AS (SELECT doc_id id, {column} FROM documents WHERE is_verified), {_fuzzy_sql('tgt', 'src', column)}
        {_NUMBERED}, tid AS working_target_id, CASE WHEN tid IS NOT NULL THEN 0 END AS match_step FROM src s LEFT JOIN z ON s.id = z.sid"""


_NUMBERED = "SELECT s.id, row_number() OVER (ORDER BY s.id) AS working_source_id"
_DATE_SQL = r"""strftime(coalesce(CASE WHEN regexp_matches(born_at, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN try_cast(born_at AS DATE) END,
 CASE WHEN regexp_matches(born_at, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN CAST(try_strptime(born_at, '%m/%d/%Y') AS DATE) END,
 CASE WHEN regexp_matches(born_at, '^[0-9]{8}$') THEN CAST(try_strptime(born_at, '%Y%m%d') AS DATE) END), '%Y-%m-%d')"""
_EMAIL_SQL = f"CASE WHEN email IS NULL OR email = '' THEN true ELSE length(email) BETWEEN 3 AND 100 AND contains(email, '@') AND regexp_matches(email, '{EMAIL_FORM}$') END"
_ELECTION = "CASE o_orderkey % 5 WHEN 0 THEN '_primary' WHEN 1 THEN '_general' WHEN 2 THEN '_presidential_primary' WHEN 3 THEN '_special' ELSE '_xx' END"


_CHAIN_SQL = """ch AS (SELECT s.p_partkey k, min(t.p_partkey) tg FROM part s LEFT JOIN part t ON s.p_brand = t.p_brand AND s.p_size = t.p_size AND t.p_retailprice >= s.p_retailprice AND t.p_partkey >= s.p_partkey - 400 GROUP BY s.p_partkey),
checks AS (SELECT count(tg) n, count(*) total, count(*) FILTER (k = tg) reflexive, (SELECT count(*) FROM ch a JOIN ch b ON a.tg = b.k WHERE b.tg IS NOT NULL AND a.k <> b.k) chained FROM ch)"""


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    cascade = f"WITH {_CUST}, {_cascade_sql([_ON_NAME, _ON_BUCKET])}"
    limits = " AND t.balance < s.balance AND s.bucket >= 0"
    own = " AND s.balance > 0"
    nested = _cascade_sql([_ON_NAME, _ON_BUCKET + own, "s.nation = t.nation AND s.bucket = t.bucket" + own, "s.segment = t.segment AND s.bucket = t.bucket"], [0, 1, 1, 2])
    same = "s.name = t.name AND s.brand = t.brand"
    survivors = "sv AS (SELECT part.* FROM part JOIN m USING (p_partkey) WHERE tg IS NULL), fd AS (SELECT tg, arg_min(p.p_type, p.p_partkey) p_type, arg_min(p.p_size, p.p_partkey) p_size, arg_min(p.p_retailprice, p.p_partkey) p_retailprice FROM m JOIN part p USING (p_partkey) WHERE tg IS NOT NULL GROUP BY tg)"
    coverage_sql = _union(f"SELECT '{c}' AS column_name, count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') AS n, count(*) AS total, count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') / CAST(count(*) AS DOUBLE) AS fraction FROM voters" for c in audit.COVERAGE_COLUMNS)
    distribution_sql = _union(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM voters GROUP BY {c}" for c in ("is_perm_absentee", "party", "demo", "gender", "reg_status", "born_at", "age"))
    lat = "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey % 5 END"
    return {
        "exact_match": f"WITH {_CUST}, {_cascade_sql([_ON_NAME])} {_LINKS}",
        "match_cascade": f"{cascade} {_LINKS}",
        "match_constrained": f"WITH {_CUST}, {_cascade_sql([_ON_NAME + limits, _ON_BUCKET + limits])} {_LINKS}",
        "match_nested": f"WITH {_CUST}, {nested} {_LINKS}",
        "foreign_key_match": f"""WITH src AS (SELECT o_orderkey id, o_custkey, o_orderstatus status FROM orders),
            tgt AS (SELECT c_custkey id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END status FROM customer WHERE c_custkey % 4 <> 0),
            {_cascade_sql(['s.o_custkey = t.id AND s.status = t.status', 's.o_custkey = t.id'])} {_LINKS}""",
        "match_join_table": f"""WITH src AS (SELECT s_suppkey id, s_nationkey nation FROM supplier), tgt AS (SELECT c_custkey id, c_nationkey nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 3)),
            {_cascade_sql(['s.nation = t.nation'])} {_LINKS}""",
        "fuzzy_match": _review_sql("title"),
        "fuzzy_texts": _review_sql("text"),
        "fuzzy_after_exact": f"""WITH {_MISSPELT}, {_cascade_sql([same])}, pool AS (SELECT * FROM tgt WHERE id NOT IN (SELECT m FROM g0)), rest AS (SELECT * FROM src WHERE id NOT IN (SELECT sid FROM g0)), {_fuzzy_sql('pool', 'rest', 'name')}
            {_NUMBERED}, coalesce(g0.m, z.tid) AS working_target_id, CASE WHEN g0.m IS NOT NULL THEN 0 WHEN z.tid IS NOT NULL THEN 1 END AS match_step FROM src s LEFT JOIN g0 ON s.id = g0.sid LEFT JOIN z ON s.id = z.sid""",
        "fuzzy_two_columns": f"""WITH {_MISSPELT}, {_cascade_sql([same])}, pool AS (SELECT * FROM tgt WHERE id NOT IN (SELECT m FROM g0)), rest AS (SELECT * FROM src WHERE id NOT IN (SELECT sid FROM g0)), {_fuzzy_sql('pool', 'rest', 'name')},
            z1 AS (SELECT * FROM z), pool2 AS (SELECT * FROM pool WHERE id NOT IN (SELECT tid FROM z1)), rest2 AS (SELECT * FROM rest WHERE id NOT IN (SELECT sid FROM z1)), {_fuzzy_sql('pool2', 'rest2', 'kind', tag='2')}
            {_NUMBERED}, coalesce(g0.m, z1.tid, z2.tid) AS working_target_id, CASE WHEN g0.m IS NOT NULL THEN 0 WHEN z1.tid IS NOT NULL THEN 1 WHEN z2.tid IS NOT NULL THEN 2 END AS match_step
            FROM src s LEFT JOIN g0 ON s.id = g0.sid LEFT JOIN z1 ON s.id = z1.sid LEFT JOIN z2 ON s.id = z2.sid""",
        "fuzzy_constrained": f"WITH {_MISSPELT}, {_fuzzy_sql('tgt', 'src', 'name', 's.brand = t.brand')} {_NUMBERED}, tid AS working_target_id, CASE WHEN tid IS NOT NULL THEN 0 END AS match_step FROM src s LEFT JOIN z ON s.id = z.sid",
        "merge_upsert": _merge_sql(_UPDATE, _INSERT),
        "merge_update_only": _merge_sql(_UPDATE, None),
        "merge_insert_only": _merge_sql({}, _INSERT),
        "merge_move_preserve": _merge_sql({c: e for c, e in _UPDATE.items() if c != "segment"} | {"old_balance": "t.balance"}, _INSERT),
        "merge_expressions": _merge_sql(_UPDATE | {"balance": "u.balance + t.balance"}, _INSERT | {"balance": "balance * 2", "old_balance": "balance - 1"}),
        "merge_generated_keys": _merge_sql(_UPDATE, _INSERT | {"id": "(SELECT max(id) FROM tgt) + row_number() OVER (ORDER BY working_source_id)"}),
        "merge_returned_keys": f"""{cascade}, {_UPD}, f AS (SELECT id, (SELECT max(id) FROM tgt) + row_number() OVER (ORDER BY working_source_id) k FROM {_FRESH})
            SELECT w.id, coalesce(u.working_target_id, f.k) AS written_id FROM w LEFT JOIN upd u ON u.id = w.id LEFT JOIN f ON f.id = w.id""",
        "merge_neither": f"WITH {_CUST} SELECT * FROM tgt",
        "merge_report": f"""{cascade}, pool AS (SELECT * FROM tgt WHERE id NOT IN (SELECT m FROM g0) AND id NOT IN (SELECT m FROM g1)), rest AS (SELECT * FROM src WHERE id NOT IN (SELECT sid FROM g0) AND id NOT IN (SELECT sid FROM g1)), {_fuzzy_sql('pool', 'rest', 'segment')},
            counted AS (SELECT count(*) t, count(*) FILTER (match_step = 0) n0, count(*) FILTER (match_step = 1) n1, (SELECT count(*) FROM z) n2 FROM w) SELECT CAST(0 AS BIGINT) AS report, CAST(0 AS BIGINT) AS position, 'source rows: ' || t AS line FROM counted
            {' '.join(f"UNION ALL SELECT 0, {i + 1}, 'group {i}: ' || n{i} || ' (' || printf('%.1f', 100.0 * n{i} / t) || ' %)' FROM counted" for i in range(3))}""",
        "merge_return_values": f"""{cascade}, {_UPD} SELECT w.id, w.working_target_id, CASE WHEN u.id IS NOT NULL THEN u.working_target_id WHEN f.id IS NOT NULL THEN f.id END AS written_id,
            CASE WHEN u.id IS NOT NULL THEN u.balance + u.balance WHEN f.id IS NOT NULL THEN f.balance + f.balance END AS "both"
            FROM w LEFT JOIN upd u ON u.id = w.id LEFT JOIN (SELECT * FROM {_FRESH}) f ON f.id = w.id""",
        "dedup_links": f"WITH {_PART_SQL} SELECT p_partkey, tg AS working_target_id, CASE WHEN tg IS NOT NULL THEN 0 END AS match_step FROM m",
        "dedup_collapse": f"""WITH {_PART_SQL}, {survivors} SELECT sv.p_partkey, sv.p_name, sv.p_brand, CASE WHEN tg IS NULL THEN sv.p_type ELSE fd.p_type END AS p_type, CASE WHEN tg IS NULL THEN sv.p_size ELSE fd.p_size END AS p_size,
            CASE WHEN tg IS NULL THEN sv.p_retailprice ELSE sv.p_retailprice + fd.p_retailprice END AS p_retailprice FROM sv LEFT JOIN fd ON fd.tg = sv.p_partkey""",
        "dedup_oriented": "SELECT s.p_partkey, min(t.p_partkey) AS working_target_id FROM part s LEFT JOIN part t ON s.p_name = t.p_name AND s.p_brand = t.p_brand AND t.p_retailprice > s.p_retailprice GROUP BY s.p_partkey",
        "dedup_checks": f"WITH {_PART_SQL} SELECT count(*) FILTER (p_partkey = tg) AS reflexive, (SELECT count(*) FROM m a JOIN m b ON a.tg = b.p_partkey WHERE b.tg IS NOT NULL AND a.p_partkey <> b.p_partkey) AS chained FROM m",
        "audit_merge": f"WITH {_CUST}, {nested} SELECT k AS match_step, count(w.id) AS n, (SELECT count(*) FROM w) AS total, count(w.id) / CAST((SELECT count(*) FROM w) AS DOUBLE) AS fraction FROM (VALUES (0), (1), (2)) v(k) LEFT JOIN w ON w.match_step = k GROUP BY k",
        "audit_dedup": f"WITH {_PART_SQL} SELECT 0 AS match_step, count(tg) AS n, count(*) AS total, count(tg) / CAST(count(*) AS DOUBLE) AS fraction, CAST(0 AS BIGINT) AS reflexive, CAST(0 AS BIGINT) AS chained FROM m",
        "dedup_checks_found": f"WITH {_CHAIN_SQL} SELECT reflexive, chained FROM checks",
        "audit_dedup_found": f"WITH {_CHAIN_SQL} SELECT 0 AS match_step, n, total, n / CAST(total AS DOUBLE) AS fraction, reflexive, chained FROM checks",
        "dedup_report": f"""WITH {_PART_SQL}, {_CHAIN_SQL}, plain AS (SELECT count(tg) n, count(*) total, CAST(0 AS BIGINT) reflexive, CAST(0 AS BIGINT) chained FROM m),
            r AS (SELECT CAST(0 AS BIGINT) report, * FROM plain UNION ALL SELECT 1, n, total, reflexive, chained FROM checks)
            SELECT report, CAST(0 AS BIGINT) AS position, 'source rows: ' || total AS line FROM r UNION ALL SELECT report, 1, 'group 0: ' || n || ' (' || printf('%.1f', 100.0 * n / total) || ' %)' FROM r
            UNION ALL SELECT report, 2, 'reflexive matches: ' || reflexive FROM r UNION ALL SELECT report, 3, 'chained matches: ' || chained FROM r""",
        "geocode_absent": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS residential_address1, CAST(NULL AS DECIMAL(38,18)) AS residential_lat, CAST(NULL AS DECIMAL(38,18)) AS residential_lng, c_mktsegment <> 'BUILDING' AS needs_geocoding, CAST(NULL AS VARCHAR) AS location_geometry FROM customer",
        "table_columns": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'order_id', true, true), (1, 'note', false, false), (2, 'lines', true, false), (3, 'votes', false, false)) v(position, name, mapped, is_key)",
        "map_columns": "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_totalprice AS total, o_orderkey + 1 AS next_id, CAST(NULL AS VARCHAR) AS note, CAST(o_custkey AS INT) AS customer, CAST(NULL AS INT) AS votes FROM orders",
        "constrain_rows": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
        "group_records": 'SELECT l_orderkey AS order_id, count(*) AS "lines", max(l_quantity) AS most FROM lineitem WHERE l_linenumber < 6 GROUP BY l_orderkey',
        "copy_schema": "SELECT s_suppkey AS c_custkey, s_name AS c_name, CAST(NULL AS INT) AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM supplier",
        "copy_column": "SELECT o_orderkey, o_custkey AS c_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN nullif(c.c_mktsegment, 'BUILDING') ELSE 'none' END AS c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c.c_custkey = o_custkey",
        "map_column_expr": "SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NOT NULL THEN c_acctbal + o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey",
        "copy_column_multi_key": "SELECT t.l_orderkey, t.l_linenumber, CASE WHEN s.n IS NOT NULL THEN s.tax ELSE 0.0 END AS l_tax FROM lineitem t LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_tax) tax, count(*) n FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2) s ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber",
        "profile_key_uniqueness": "SELECT count(*) AS duplicated_keys, coalesce(max(n), 0) AS largest_group FROM (SELECT count(*) n FROM part GROUP BY p_name HAVING count(*) > 1)",
        "profile_coverage": coverage_sql,
        "profile_distribution": distribution_sql,
        "profile_top_k": "SELECT CAST(registered_at AS VARCHAR) AS value, count(*) AS n FROM voters GROUP BY registered_at ORDER BY n DESC, value NULLS LAST LIMIT 20",
        "profile_total": "SELECT count(*) AS total FROM voters",
        "profile_geocoding": "SELECT trim(coalesce(residential_address1, '')) <> '' AND (residential_lat IS NULL OR residential_lat = 0) AND residential_zip4 IS NULL AS needs_geocoding, count(*) AS n FROM voters GROUP BY 1",
        "geocode_prep": f"SELECT s_suppkey, s_suppkey % 4 <> 0 AND ({lat} IS NULL OR {lat} = 0) AS needs_geocoding, 'POINT(' || s_nationkey || ' ' || {lat} || ')' AS location_geometry FROM supplier",
        "fn_election_name": f"SELECT o_orderkey, year(o_orderdate) || {_ELECTION} AS as_column, year(o_orderdate) || {_ELECTION} AS as_sql FROM orders",
        "fn_date_or_null": f"SELECT row_id, {_DATE_SQL} AS as_column, {_DATE_SQL} AS as_sql FROM voter_loads",
        "fn_email_valid": f"SELECT id, {_EMAIL_SQL} AS as_column, {_EMAIL_SQL} AS as_sql FROM voters",
        "fn_similarity": f"SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(nullif(len(a) + len(b) - len(list_intersect(a, b)), 0) AS DOUBLE), 9) AS similarity FROM (SELECT p_partkey, {_GRAMS.format('p_name')} a, {_GRAMS.format('p_type')} b FROM part)",
        "malformed_rows": "SELECT count(*) AS total, count(*) FILTER (p_partkey % 6 IN (1, 2)) AS malformed FROM part",
        "copy_sink": "SELECT id || chr(9) || coalesce(first_name, '\\N') || chr(9) || coalesce(phone, '\\N') || chr(9) || coalesce(CAST(is_perm_absentee AS VARCHAR), '\\N') || chr(9) || strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS line FROM voters",
        "sql_count": "SELECT count(*) FILTER (party = 'DEM') AS some, CAST(0 AS BIGINT) AS none FROM voters",
        "sql_passthrough": "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS dearest FROM orders GROUP BY o_orderpriority",
    }
