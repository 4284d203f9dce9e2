"""Queries by operator, with their SQL; and small helpers to write that SQL from the fixed values."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from veilspark.functions import fixed_values as V
from veilspark.plans.probes import probed_sql, quoted, with_probes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- tables -------------------------------------------------------------------------------------------


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A Parquet table; Python workers can import this library from then on."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, env.get("PYTHONPATH", "")) if p)
    return spark.read.parquet(f"{d}/{name}.parquet")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    return with_probes(table(spark, d, "conversations").filter("role = 'user'"))


def outputs(spark: SparkSession, d: str) -> DataFrame:
    return with_probes(table(spark, d, "conversations").filter("role = 'assistant'"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return with_probes(table(spark, d, "conversations"))


PROMPTS = "WITH " + probed_sql("WHERE role = 'user'")
OUTPUTS = "WITH " + probed_sql("WHERE role = 'assistant'")
TURNS = "WITH " + probed_sql()


# ---- SQL ----------------------------------------------------------------------------------------------


def re2(p: str) -> str:
    """A pattern of ours for an engine whose word class and word border know ASCII only."""
    edge = r"[^\pL\pN_]"
    if p.startswith(r"\b"):
        p = f"(?:^|{edge})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + f"(?:$|{edge})"
    return p.replace(r"\w", r"[\pL\pN_]")


def rx(column: str, patterns: Iterable[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted((f'(?{flags})' if flags else '') + re2(p))})" for p in patterns) + ")"


def has(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def tags(**conditions: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in conditions.items()) + ")"


def case(column: str, values: dict, default: str = "NULL") -> str:
    lit = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {default} END"


def rows(name: str, columns: str, values: Iterable[tuple]) -> str:
    """A CTE of literal rows."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(lit, v)) + "]" + ("" if v else "::VARCHAR[]")
        return quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in values) + ")"


ASSETS_SQL = rows("a", "asset_id, name, type, value, aliases, risk_level, allowed_roles, modes, description, source", V.ASSETS)


def rule_rows() -> list[tuple]:
    """(ord, category, kind, pattern, weight) of the attack rules."""
    out = []
    for category, keywords, phrases, patterns, weight, _ in V.ATTACK_RULES:
        for kind, words, w in (("keyword", keywords, weight * V.KEYWORD_SHARE), ("phrase", phrases, weight), ("regex", patterns, weight)):
            for word in words:
                out.append((len(out), category, kind, word if kind == "phrase" else re2(rf"\b{word.lower()}\b") if kind == "keyword" else re2(word), round(w, 4), word))
    return out


RULES_SQL = rows("r", "ord, category, kind, pattern, weight, fragment", rule_rows())
ATTACKS_SQL = rows("k", "category, base, severity, skill", [(c, *v) for c, v in V.ATTACKS.items()])
HITS_SQL = "h AS (SELECT conv_id, turn, ord, r.category, kind, fragment, CAST(weight AS DECIMAL(10,4)) AS weight FROM c JOIN r ON CASE WHEN kind = 'phrase' THEN contains(lower(text), pattern) ELSE regexp_matches(lower(text), pattern) END)"
SCORES_SQL = "s AS (SELECT conv_id, turn, h.category, least(CAST(1 AS DECIMAL(10,4)), CAST(min(base) AS DECIMAL(10,4)) + sum(weight)) AS score, min(ord) AS ord FROM h JOIN k ON k.category = h.category GROUP BY ALL)"
PRIMARY_SQL = "pr AS (SELECT conv_id, turn, category, score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ord) = 1)"
