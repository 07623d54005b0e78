"""Registered queries, their SQL for the side-by-side check, and the input catalog."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators import graph, windows
from planloom.plans.adapters import ADAPTERS, SPARK_ONLY, TABLES
from planloom.session import stored, stored_bucketed, tune

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_stages: dict[tuple, DataFrame] = {}

#: Tables whose rows are a project's, and the column that names it. Of them, lines of a part when they are dealt out.
OF_PROJECT = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
LINES_A_PART = 150_000


def forget_stages() -> None:
    """Drop remembered stage results, so that a timing includes every stage."""
    _stages.clear()


class Catalog:
    """The given tables of one folder, and the plan-domain views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        #: Which projects these are: "" for all, "dealt" or "large" (see by_project()), and of dealt ones in how many parts.
        self.only, self.parts = "", None

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in SPARK_ONLY:
                self._frames[name] = SPARK_ONLY[name](self)
            else:
                text = ADAPTERS[name]
                used = _names_in(text)
                sql = re.sub(
                    r"\b(" + "|".join(sorted(used, key=len, reverse=True)) + r")\b", r"{\1}", text
                )
                frames = {n: self.table(n) if n in TABLES else self.view(n) for n in used}
                self._frames[name] = self.spark.sql(sql, **frames)
        return self._frames[name]

    def store(self, *names: str) -> Catalog:
        """Write views that a query reads many times, as the stored tables they stand for."""
        for name in names:
            self._frames[name] = self.stage(name, lambda c, name=name: c.view(name))
        return self

    def stage(self, name: str, build: Callable[[Catalog], DataFrame]) -> DataFrame:
        """A stage boundary: computed once per session and folder, written as columns, then reused. What
        reads it reads the columns it needs. Rows of dealt projects stay where they lie."""
        def written(c: Catalog) -> DataFrame:
            rows = build(c)
            return stored_bucketed(rows, ["project_id"], c.parts) if c.parts and "project_id" in rows.columns else stored(rows)

        return self.once(name, written)

    def once(self, name: str, build: Callable[[Catalog], DataFrame]) -> DataFrame:
        """A frame that reads what its build has written itself: built once, and not written again."""
        key = (self.spark.sparkContext.applicationId, self.folder, name, self.only)
        if key not in _stages:
            _stages[key] = build(self)
        return _stages[key]

    def by_project(self, build: Callable[[Catalog], DataFrame]) -> DataFrame:
        """build, of a catalog in which the rows of a project lie together: orders and lines are dealt out by
        project once, and what is read off them, and written between stages, meets without being moved again.

        Projects of more than graph.WHOLE rows, which would be much work for one task, are left out of
        that: they are built from a catalog of their own, whose rows are dealt out for each join. Rows
        that build returns must each be of one project.
        """
        if self.only:
            return build(self)
        rows = [build(c) for c in self.once("projects", Catalog._parted)]
        return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    def _parted(self) -> list[Catalog]:
        keys = [self.table(name).select(F.col(key).alias("key")) for name, key in OF_PROJECT.items()]
        large = windows.crowded(keys[0].unionAll(keys[1]), graph.WHOLE)
        dealt, rest = Catalog(self.spark, self.folder), Catalog(self.spark, self.folder)
        dealt.only, rest.only = "dealt", "large"
        dealt.parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table("lineitem").count() // LINES_A_PART))
        used = set(re.findall(r"\b\w+", " ".join(ADAPTERS.values())))
        for name, key in OF_PROJECT.items():
            rows = small = self.table(name)
            if large is not None:
                small = rows.join(large.withColumnRenamed("key", key), key, "left_anti")
                rest._frames[name] = rows.join(large.withColumnRenamed("key", key), key, "left_semi")
            dealt._frames[name] = stored_bucketed(small.select([n for n in rows.columns if n in used]), [key], dealt.parts)
        # Findings are an account's, of whatever orders.
        dealt._frames["v_findings"] = rest._frames["v_findings"] = self.view("v_findings")
        dealt.store("v_tasks")
        return [dealt] if large is None else [dealt, rest]


def _names_in(text: str) -> list[str]:
    # A table name counts only where a relation may stand; view names are unmistakable.
    views = set(re.findall(r"\bv_\w+", text))
    tables = {m for m in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text) if m in TABLES}
    return sorted(views | tables)


def query(name: str, oracle: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Catalog(spark, folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in ORACLES.items()}


def with_views(body: str) -> str:
    """Prefix a SQL text with the views it uses, dependencies first."""
    ordered: list[str] = []

    def visit(text: str, within: str = "") -> None:
        # A recursive view names itself.
        for name in sorted(set(re.findall(r"\bv_\w+", text)) - {within}):
            if name not in ordered:
                visit(_duck(name), name)
                ordered.append(name)

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({_duck(n)})" for n in ordered)
    body = re.sub(r"^\s*WITH(?:\s+RECURSIVE)?\s", ",\n", body.strip())
    return f"WITH RECURSIVE {ctes}\n{body}"


def _duck(name: str) -> str:
    from planloom.plans.adapters import DUCK

    return DUCK.get(name) or ADAPTERS[name]
