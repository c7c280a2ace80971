"""Queries of the language-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import link
from .packing import pack
from .pii import find_pii
from .places import places, same_place_pairs
from .survivors import STANDIN_LOCALS, best_per_field, duplicate_groups, groups_of, survivors, usable_address, usable_email, usable_phone
from .tokens import count_tokens, decode_corpus, encode_corpus

USABLE = {"phone": usable_phone, "email": usable_email, "residential_address1": usable_address}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """Roll rows with their voters and the confidence of each match."""
    return link(_table(spark, folder, "voters"), _table(spark, folder, "county_roll")).withColumn("confidence", F.round("confidence", 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_links(spark, folder).select("voter_id", "roll_id")


def _voter_groups(spark: SparkSession, folder: str) -> DataFrame:
    voters = _table(spark, folder, "voters")
    return groups_of(voters, duplicate_groups(voters))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    usable = {c: u(F.col(c)) for c, u in USABLE.items()}
    best = best_per_field(_voter_groups(spark, folder), "group_id", "id", usable, "updated_at")
    return best.select(F.col("group").cast("bigint").alias("group_id"), "field_name", F.col("best_id").cast("bigint").alias("best_id"))


def _trust() -> Column:
    return F.when(F.col("reg_status") == "active", 2).when(F.col("reg_status") == "inactive", 1).otherwise(0)


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One whole record per voter with several rows, each contact field at its best."""
    usable = {c: u(F.col(c)) for c, u in USABLE.items()}
    kept = survivors(_voter_groups(spark, folder), "group_id", "id", usable, "updated_at", _trust())
    return kept.select("group_id", "id", "nbec_guid", "first_name", "last_name", *USABLE, "updated_at")


def p3_given_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The same over given groups: rows of one state id, however written."""
    key = F.nullif(F.regexp_replace(F.upper("state_file_id"), "[^0-9A-Z]", ""), F.lit(""))
    rows = _table(spark, folder, "voters").withColumn("group_id", key).where("group_id IS NOT NULL")
    usable = {c: u(F.col(c)) for c, u in USABLE.items()}
    return survivors(rows, "group_id", "id", usable, "updated_at", _trust()).select("group_id", "id", "nbec_guid", *USABLE)


def p5_places(spark: SparkSession, folder: str) -> DataFrame:
    """Address records with the place each denotes."""
    records = _table(spark, folder, "address_records")
    found = places(records, "address_id", "residential_address1", "residential_address2", "residential_city", "residential_zip5", "county_code")
    return found.withColumnRenamed("id", "address_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = same_place_pairs(p5_places(spark, folder).withColumnRenamed("address_id", "id"))
    return pairs.select(F.col("low").alias("address_id_low"), F.col("high").alias("address_id_high"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether encoding and decoding gives back each text; NULL counts as empty."""
    docs = _table(spark, folder, "documents")
    back = decode_corpus(encode_corpus(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    capacities = {r["pack_name"]: r["capacity"] for r in _table(spark, folder, "pack_sizes").collect()}  # a fixed table of three rows
    return pack(count_tokens(_table(spark, folder, "documents")), capacities, "doc_id", "n_tokens")


def p9_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: tokens, containers used, the least number that could do, and the fill."""
    sizes = F.broadcast(_table(spark, folder, "pack_sizes"))  # a fixed table of three rows
    used = _packed(spark, folder).where("n_tokens > 0").groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    out = used.groupBy("pack_name").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("containers")).join(sizes, "pack_name")
    least = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint")
    return out.select("pack_name", "capacity", "n_tokens", "containers", least.alias("least"), F.round(F.col("n_tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with typed placeholders in the place of personal information."""
    return find_pii(_table(spark, folder, "documents")).select("doc_id", F.col("redacted").alias("text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(_table(spark, folder, "documents"), redacted=False).select("doc_id", F.explode("found").alias("m"))
    return found.select("doc_id", "m.pii_kind", "m.start_at")


_DIGITS = "right(regexp_replace(trim(phone), '[^0-9]', '', 'g'), 10)"
_LOCALS = ", ".join(f"'{x}'" for x in STANDIN_LOCALS)
_GIVEN_SQL = rf"""WITH v AS (SELECT *, nullif(regexp_replace(upper(state_file_id), '[^0-9A-Z]', '', 'g'), '') g,
    CASE WHEN regexp_matches(trim(phone), '^(\+?1[-. ]?)?(\([0-9]{{3}}\) ?|[0-9]{{3}}[-. ]?)[0-9]{{3}}[-. ]?[0-9]{{4}}$') AND {_DIGITS} NOT IN ('1234567890', '0123456789', '9876543210')
        AND length(replace({_DIGITS}, left({_DIGITS}, 1), '')) > 0 AND left({_DIGITS}, 3) <> '000' AND substring({_DIGITS}, 4, 3) <> '000' THEN 1 ELSE 0 END up,
    CASE WHEN regexp_matches(lower(trim(email)), '^[a-z0-9._%+''-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{{2,}}$') AND regexp_replace(split_part(lower(trim(email)), '@', 1), '[^a-z]', '', 'g') NOT IN ({_LOCALS}) THEN 1 ELSE 0 END ue,
    CASE WHEN regexp_matches(residential_address1, '[0-9]') AND regexp_matches(residential_address1, '[A-Za-z]{{2}}') THEN 1 ELSE 0 END ua,
    CASE reg_status WHEN 'active' THEN 2 WHEN 'inactive' THEN 1 ELSE 0 END trust FROM voters),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY up + ue + ua DESC, trust DESC, updated_at DESC NULLS LAST, id) n FROM v WHERE g IS NOT NULL),
f AS (SELECT g, {", ".join(f"(list(CASE WHEN {u} = 1 THEN {c} END ORDER BY {u} DESC, trust DESC, updated_at DESC NULLS LAST, id))[1] AS {c}" for c, u in (("phone", "up"), ("email", "ue"), ("residential_address1", "ua")))} FROM r GROUP BY g)
SELECT g AS group_id, r.id, r.nbec_guid, f.phone, f.email, f.residential_address1 FROM r JOIN f USING (g) WHERE n = 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_links, p3_found, p3_survivors, p3_given_groups, p5_found, p5_places, p8_ids, p8_roundtrip, p9_assignments, p9_fill, p10_found, p10_redacted)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what the result must be; tests hold the rest against brute force,
    the tokenizer itself, bounds and held-out sentences."""
    return {"p8_roundtrip": "SELECT doc_id, true AS same FROM documents", "p3_given_groups": _GIVEN_SQL}
