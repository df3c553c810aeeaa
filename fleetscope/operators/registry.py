"""Rules by name: built-in ones, functions of one's own, or SQL over the tables' names. A run is one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as C

Tables = dict[str, DataFrame]


@dataclass
class Registry:
    """``rules`` maps a key to a function of the tables or to SQL. Disabled and unknown keys of the catalogue are not planned at all."""

    rules: dict[str, Callable[[Tables], DataFrame] | str] = field(default_factory=dict)

    def register(self, key: str, rule: Callable[[Tables], DataFrame] | str) -> None:
        self.rules[key] = rule

    def rows(self, key: str, tables: Tables) -> DataFrame:
        rule = self.rules[key]
        if callable(rule):
            return rule(tables)
        spark = next(iter(tables.values())).sparkSession
        return spark.sql(rule, **{name: t for name, t in tables.items() if "{" + name + "}" in rule})

    def run(self, tables: Tables, catalog: DataFrame, keys: Iterable[str] | None = None, entity: str = "action_id", prefix: str = "rule", timestamp: str | None = None) -> DataFrame:
        """Issues of the enabled rules among ``keys``, numbered for each rule in order of the entity."""
        enabled = {r["issue_key"] for r in catalog.where("enabled").select("issue_key").collect()}  # a small dimension
        parts = []
        for key in keys or self.rules:
            if key in enabled and key in self.rules:
                rows = self.rows(key, tables)
                parts.append(rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns), F.lit(key).alias("issue_key")))
        if not parts:
            return next(iter(tables.values())).sparkSession.createDataFrame([], "issue_id string, issue_key string, severity string, category string, description string, entity_type string, entity_id string, analysis_tool string, analysis_timestamp string, metadata map<string, string>")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("entity_id", F.col(entity))
        context = {c: F.col(c) for c in rows.columns if c not in ("issue_key", "entity_id")}
        return C.issues(rows, catalog, F.concat(F.lit(prefix + "_"), "issue_key", F.lit("_")), context, ["entity_id", *context], ["issue_key"], timestamp=timestamp)
