"""Import, merge and de-duplication jobs: one body, performed or only audited."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.audit import audit_dedup, audit_links, coverage, file_report, key_uniqueness, links_report
from .operators.dedup import check_links, collapse, dedup_links
from .operators.match import match
from .operators.merge import MergeResult, merge
from .sources.catalog import Driver
from .sources.delimited import DelimitedFile
from .spec import MatchSpec, MergeSpec


@dataclass(frozen=True)
class MergePlan:
    source: DataFrame
    target: DataFrame
    match: MatchSpec
    rules: MergeSpec


@dataclass(frozen=True)
class DedupPlan:
    table: DataFrame
    match: MatchSpec
    rules: MergeSpec = MergeSpec()
    orientation: tuple[tuple[str, str], ...] | None = None


class ImportJob:
    """A job whose ``job(driver)`` returns merge plans; always cleans up after itself."""

    def __init__(self, spark: SparkSession, body: Callable[[Driver], list[MergePlan]] | None = None) -> None:
        self.spark, self._body = spark, body

    def job(self, driver: Driver) -> list[MergePlan]:
        if self._body is None:
            raise NotImplementedError("give a body or override job()")
        return self._body(driver)

    def perform(self, sink: Callable[[MergeResult], None]) -> int:
        """Run every merge and hand its result to ``sink``; returns the number of merges."""
        with Driver(self.spark) as driver:
            plans = self.job(driver)
            for p in plans:
                sink(merge(p.target, match(p.source, p.target, p.match), p.rules, p.match.target_key, p.match.source_key))
            return len(plans)

    def perform_audit(self) -> list[str]:
        """Match only, write nothing: the report of each merge."""
        with Driver(self.spark) as driver:
            out = []
            for p in self.job(driver):
                rows = audit_links(match(p.source, p.target, p.match), p.match, fuzzy=True).orderBy("match_step").collect()
                out.append(links_report([tuple(r) for r in rows]))
            return out


class DedupJob:
    """A job whose ``job(driver)`` returns de-duplication plans."""

    def __init__(self, spark: SparkSession, body: Callable[[Driver], list[DedupPlan]] | None = None) -> None:
        self.spark, self._body = spark, body

    def job(self, driver: Driver) -> list[DedupPlan]:
        if self._body is None:
            raise NotImplementedError("give a body or override job()")
        return self._body(driver)

    def perform(self, sink: Callable[[MergeResult], None]) -> int:
        with Driver(self.spark) as driver:
            plans = self.job(driver)
            for p in plans:
                sink(collapse(p.table, dedup_links(p.table, p.match, p.orientation), p.rules, p.match.target_key))
            return len(plans)

    def perform_audit(self) -> list[str]:
        with Driver(self.spark) as driver:
            out = []
            for p in self.job(driver):
                links = dedup_links(p.table, p.match, p.orientation)
                found = check_links(links, p.match.target_key).first()
                rows = audit_links(links, p.match).orderBy("match_step").collect()
                out.append(links_report([tuple(r) for r in rows], (found["reflexive"], found["chained"])))
            return out


class FileAudit:
    """Report of a delimited file: rows, malformed rows, key uniqueness and coverage."""

    def __init__(self, file: DelimitedFile, key: str) -> None:
        self.file, self.key = file, key

    def frames(self) -> dict[str, DataFrame]:
        table = self.file.remove_malformed_rows().load()
        return {"coverage": coverage(table), "key": key_uniqueness(table, self.key), "rejected": self.file.rejected()}

    def perform(self) -> str:
        parts = self.frames()
        filled = parts["coverage"].collect()
        key = parts["key"].first()
        return file_report(filled[0]["total"] if filled else 0, parts["rejected"].agg(F.count(F.lit(1))).first()[0], key["duplicated_keys"] == 0, key["largest_group"], [(r["column_name"], r["n"], r["fraction"]) for r in filled])


__all__ = ["DedupJob", "DedupPlan", "FileAudit", "ImportJob", "MergePlan", "audit_dedup"]
