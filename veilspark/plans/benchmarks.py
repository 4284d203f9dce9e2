"""A runner that times callables, keeps their errors, and sums up."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.documents import save_text

SCHEMA = "name string, success boolean, elapsed double, error string, timestamp string"


#: Checks of components by the queries that exercise them: the pipeline's nine, and the thirteen of the command line.
PIPELINE = {
    "AttackClassifier": "PRD9",
    "RestrictedTokenGuard": "FN20",
    "TokenExpander": "FN8",
    "InputGuard": "PRD7",
    "OutputGuard": "JOIN5",
    "RiskScoring": "AGG6",
    "DefensePolicyEngine": "DEC1",
    "ProtectedAssetRegistry": "PRD12",
    "LeakageVerifier": "AGG12",
}
BENCHMARK = {
    "AttackClassifier - direct request": "PRD9",
    "AttackClassifier - roleplay": "PRD10_get",
    "RestrictedTokenGuard": "FN20",
    "TokenExpander": "FN8",
    "InputGuard - XSS detection": "PRD3",
    "OutputGuard - API key pattern": "PRD11",
    "RiskScoringEngine": "AGG6",
    "DefensePolicyEngine - block decision": "DEC1",
    "SecretMatcher": "SRC9",
    "LeakageVerifier": "AGG12",
    "ProtectedAssetRegistry": "PRD12",
    "SkillRouter": "SRT1",
    "BaseSkill - 20 subclasses": "AGG7",
}
SUITES = {"pipeline": PIPELINE, "benchmark": BENCHMARK}


class Evaluator:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple] = []

    def run(self, name: str, f: Callable, *args, **kwargs) -> bool:
        """A call passes if it doesn't raise. A DataFrame that it returns is run in full."""
        began, error = time.perf_counter(), None
        try:
            out = f(*args, **kwargs)
            if isinstance(out, DataFrame):
                out.write.format("noop").mode("overwrite").save()
        except Exception as e:
            error = str(e)
        self.rows.append((name, error is None, round(time.perf_counter() - began, 4), error, datetime.now(timezone.utc).isoformat()))
        return error is None

    def run_suite(self, checks: dict[str, str], queries: dict[str, Callable], folder: str) -> dict[str, int | None]:
        """Runs each check's query over the tables of a folder; how many rows each gave, None for those that failed."""
        made: dict[str, int | None] = {}

        def counted(name: str, key: str) -> None:
            made[name] = None
            made[name] = queries[key](self.spark, folder).count()

        for name, key in checks.items():
            self.run(name, counted, name, key)
        return made

    def results(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)

    def save(self, path: str) -> str:
        summary = summarise(self.results()).first().asDict()
        return save_text(self.spark, json.dumps({"results": [dict(zip(("name", "success", "elapsed", "error", "timestamp"), r)) for r in self.rows], "summary": summary}, ensure_ascii=False, indent=2), path)


def summarise(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, pass_rate (3 places), total_time (4 places)."""
    n, ok = F.count(F.lit(1)), F.count_if(F.coalesce("success", F.lit(False)))
    return results.agg(n.alias("total"), ok.alias("passed"), (n - ok).alias("failed"), F.bround(ok / F.greatest(n, F.lit(1)), 3).alias("pass_rate"), F.bround(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 4).alias("total_time"))
