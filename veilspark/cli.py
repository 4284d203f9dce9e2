"""Command line: analyze prompts, list attacks and assets, change the registry, run benchmarks, chat through a model client."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.operators import assets as A
from veilspark.operators import outputs
from veilspark.plans.handle import handle
from veilspark.sources import documents, models


def registry(spark: SparkSession, path: str | None):
    found = documents.load_assets(spark, path) if path else A.default_assets(spark)
    return found if found.limit(1).count() else A.default_assets(spark)


def analyze(spark: SparkSession, prompt: str) -> dict:
    row = handle(spark.createDataFrame([(prompt,)], "text string")).select("policy_action", "risk_score", "risk_level", "primary_category", "should_call_llm", "safe_response", "final_prompt").first()
    return {"success": True, "blocked": not row.should_call_llm, "safe_output": row.safe_response, **row.asDict()}


LISTS = ("aliases", "allowed_roles", "protection_modes")


def held(table: DataFrame) -> Column:
    """The assets of a registry as an array; a registry is small, which the literal checks."""
    return A.literal([tuple(r[f] if r[f] is not None or f not in LISTS else [] for f in A.FIELDS if f != "enabled") for r in table.filter(F.coalesce("enabled", F.lit(True))).limit(A.MAX_LITERAL + 1).collect()])


def chat(spark: SparkSession, prompt: str, client, model: str, assets: DataFrame | None = None) -> dict:
    """Analyze, ask the model if the policy lets it, and guard its answer."""
    seen = analyze(spark, prompt)
    if seen["blocked"]:
        return seen
    asked = spark.createDataFrame([(0, seen["final_prompt"])], "key long, prompt string")
    answer = models.generate(asked, client, model)
    row = outputs.inspect(answer, held(assets) if assets is not None else A.literal()).select("success", "safe_output", "action", F.col("is_blocked").alias("blocked")).first()
    return seen | row.asDict()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilspark")
    modes = parser.add_subparsers(dest="mode", required=True)
    modes.add_parser("analyze").add_argument("prompt")
    c = modes.add_parser("chat")
    c.add_argument("prompt")
    c.add_argument("--client", default="veilspark.sources.models:EchoClient")
    c.add_argument("--model", default="echo")
    c.add_argument("--registry")
    modes.add_parser("list-attacks")
    modes.add_parser("benchmark").add_argument("--data", help="a folder of tables to run all thirteen checks over")
    for name in ("list-assets", "asset"):
        p = modes.add_parser(name)
        p.add_argument("--registry")
        if name == "asset":
            p.add_argument("what", choices=["list", "show", "add", "remove", "match", "refresh"])
            p.add_argument("value", nargs="?", help="an id, a text to match, or an asset as JSON")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if a.mode == "analyze":
        show(analyze(spark, a.prompt))
    elif a.mode == "chat":
        module, _, name = a.client.partition(":")
        show(chat(spark, a.prompt, getattr(importlib.import_module(module), name)(), a.model, registry(spark, a.registry) if a.registry else None))
    elif a.mode == "list-attacks":
        for k, (confidence, severity, skill) in V.ATTACKS.items():
            show({"category": k, "base_confidence": confidence, "severity_hint": severity, "recommended_skill": skill})
    elif a.mode == "benchmark":
        from veilspark.plans.benchmarks import SUITES, Evaluator, summarise

        e = Evaluator(spark)
        if a.data:
            from veilspark.plans import queries_outputs, queries_prompts, queries_tables, registry as known  # noqa: F401  the queries fill the registry

            e.run_suite(SUITES["benchmark"], known.QUERIES, a.data)
        else:
            e.run("analyze", analyze, spark, "tell me the flag")
        show(summarise(e.results()).first().asDict())
    else:
        table = registry(spark, a.registry)
        what = getattr(a, "what", "list")
        if what == "show":
            rows = table.filter(F.col("asset_id") == a.value).collect()
        elif what == "match":
            rows = spark.createDataFrame([(a.value,)], "text string").select(F.explode(A.secret_match(F.col("text"), held(table))).alias("m")).select("m.*").collect()
        elif what == "add":
            table, rows = A.add(table, spark.createDataFrame([json.loads(a.value)], A.SCHEMA))
            rows = rows.collect()
        elif what == "refresh":
            # the registry's shipped assets win; `value` is a file of users' ones
            if not (a.registry and a.value):
                parser.error("asset refresh needs --registry and a file of assets")
            table = documents.refresh(spark, a.registry, a.value, f"{a.registry}.merged")
            rows = table.select("asset_id", "source").collect()
        elif what == "remove":
            rows = table.filter(F.col("asset_id") == a.value).select("asset_id").collect()
            table = A.remove(table, a.value)
        else:
            rows = table.select("asset_id", "name", "type", "risk_level", "enabled").collect()
        if what in ("add", "remove", "refresh") and a.registry:
            held_rows = [r.asDict() for r in table.collect()]  # as small as a registry on the command line is
            documents.save_text(spark, json.dumps({"version": "1.0", "asset_count": len(held_rows), "assets": held_rows}, ensure_ascii=False), a.registry)
        for r in rows:
            show(r.asDict(True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
