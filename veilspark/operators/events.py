"""Audit events: defaults, redaction, filters, summaries and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import fixed_values as V

SCHEMA = (
    "event_id string, timestamp string, session_id string, request_id string, conversation_turn int, user_role string, authorization_status string, attack_type string, attack_category string, "
    "matched_patterns array<string>, risk_score int, risk_level string, risk_factors array<string>, session_risk_score int, policy_action string, policy_reason string, policy_rule_id string, "
    "enabled_skills array<string>, skill_results array<map<string,string>>, blocked boolean, leakage_detected boolean, leakage_type string, leakage_level int, matched_asset_ids array<string>, "
    "input_summary string, output_summary string, final_response_type string, metadata map<string,string>"
)
# What an event has where nothing is said.
DEFAULTS = {"session_id": "default", "conversation_turn": 1, "user_role": "guest", "authorization_status": "unknown", "attack_type": "unknown", "attack_category": "unknown", "risk_score": 0, "risk_level": "low", "session_risk_score": 0, "policy_action": "ALLOW", "policy_reason": "", "blocked": False, "leakage_detected": False, "leakage_level": 0, "input_summary": "", "output_summary": "", "final_response_type": "unknown"}


def complete(df: DataFrame) -> DataFrame:
    """All columns of an event: missing ones and nulls get defaults, ids and times are made, scores are kept within 0 and 100."""
    out = {}
    for f in T._parse_datatype_string(SCHEMA).fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]))
        elif f.dataType.typeName() == "array":
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif f.dataType.typeName() == "map":
            c = F.coalesce(c, F.create_map().cast(f.dataType))
        elif f.name == "event_id":
            c = F.coalesce(c, F.concat(F.lit("evt_"), F.date_format(F.current_timestamp(), "yyyyMMdd"), F.lit("_"), F.left(F.regexp_replace(F.uuid(), "-", ""), F.lit(8))))
        elif f.name == "timestamp":
            c = F.coalesce(c, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
        if f.name == "risk_score":
            c = F.greatest(F.lit(0), F.least(F.lit(100), c))
        out[f.name] = c
    return df.select(*(c.alias(n) for n, c in out.items()))


def redact_text(c: Column) -> Column:
    for pattern, placeholder in V.EVENT_PATTERNS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(placeholder))
    return c


def redact(df: DataFrame) -> DataFrame:
    """Texts of telling names give way whole, others lose their secrets; arrays, maps and structs are gone through."""

    def clean(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(c.isNotNull(), F.lit(V.EVENT_FIELDS[name])) if name in V.EVENT_FIELDS else redact_text(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType, name))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            telling = lambda k: F.coalesce(*(F.when(k == f, F.lit(p)) for f, p in V.EVENT_FIELDS.items()))
            return F.transform_values(c, lambda k, v: F.when(v.isNotNull(), F.coalesce(telling(k), redact_text(v))))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
        return c

    return df.select(*(clean(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields))


def where(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal all wanted values; a column that isn't there matches nothing."""
    for k, v in wanted.items():
        df = df.filter(F.col(k) == v) if k in df.columns else df.limit(0)
    return df


def latest(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The last n rows, in order."""
    return df.orderBy(F.desc(order_col)).limit(n).orderBy(order_col)


def summary(events: DataFrame, order_col: str) -> DataFrame:
    """One row: counts by action, leaks, blocks, highest and mean score (1 place), and the most common attack, action and skill; of equally common ones the first seen.
    Every part is a partial aggregate; only one row per kind of value meets in one task. The events are read twice: for the totals and for the values."""
    a, score = F.coalesce("policy_action", F.lit("ALLOW")), F.coalesce("risk_score", F.lit(0))
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False))).alias
    totals = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        *(count(a == k)(f"{k.lower()}_count") for k in V.ACTIONS),
        count(F.col("leakage_detected"))("leakage_count"),
        count(F.col("blocked"))("blocked_count"),
        F.coalesce(F.max(score), F.lit(0)).alias("highest_risk_score"),
        F.coalesce(F.bround(F.sum(score) / F.count(F.lit(1)), 1), F.lit(0.0)).alias("average_risk_score"),
    )

    kinds = ("attack_type", "policy_action", "enabled_skill")
    named = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    values = F.concat(F.array(named(kinds[0], F.coalesce("attack_type", F.lit("unknown"))), named(kinds[1], a)), F.coalesce(F.transform("enabled_skills", lambda s: named(kinds[2], s)), F.array().cast("array<struct<kind:string,v:string>>")))
    by = events.select(F.explode(values).alias("x"), F.col(order_col).alias("o")).groupBy("x.kind", "x.v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("n", (-F.col("o")).alias("o")))
    most = by.agg(*(F.coalesce(F.max_by("v", of(k)), F.lit("")).alias(f"most_common_{k}") for k in kinds))
    return totals.crossJoin(most)  # one row each


def report(events: DataFrame) -> DataFrame:
    """One row: total, blocked, block_rate (3 places) and action_distribution."""
    by = events.groupBy(F.coalesce("policy_action", F.lit("unknown")).alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("blocked", F.lit(False))).alias("b"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), F.coalesce(F.sum("b"), F.lit(0)).alias("blocked_events"), F.bround(F.coalesce(F.sum("b"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)), 3).alias("block_rate"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("action_distribution"))


def leakage_statistics(events: DataFrame) -> DataFrame:
    """One row: total, leaks, leak_rate (3 places) and leak_type_distribution."""
    leak = F.coalesce("leakage_detected", F.lit(False))
    by = events.groupBy(F.when(leak, F.coalesce("leakage_type", F.lit("unknown"))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    bad = F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), bad.alias("leak_events"), F.bround(bad / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)), 3).alias("leak_rate"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))).alias("leak_type_distribution"))


# ---- rendering of small results on the driver -----------------------------------------------------------------


def render_html(row: dict, last: list[dict], title: str = "Security report") -> str:
    """row: a report; last: at most 50 events are shown."""
    cell = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    body = [f"<h1>{html.escape(title)}</h1>", *(f"<p>{label}: {row[k]}</p>" for label, k in (("Total Events", "total_events"), ("Blocked Events", "blocked_events"), ("Block Rate", "block_rate")))]
    body += ["<h2>Action Distribution</h2>", "<table>", cell("th", ["Action", "Count"]), *(cell("td", kv) for kv in row["action_distribution"].items()), "</table>"]
    if last:
        body += ["<h2>Events</h2>", "<table>", cell("th", ["Timestamp", "Type", "Action", "Blocked"]), *(cell("td", [e.get("timestamp", ""), e.get("attack_type", ""), e.get("policy_action", ""), e.get("blocked", False)]) for e in last[-50:]), "</table>"]
    return "<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>" + html.escape(title) + "</title></head><body>\n" + "\n".join(body) + "\n</body></html>"


def render_markdown(row: dict, title: str = "Security report") -> str:
    lines = [f"# {title}", "", f"**Total Events**: {row['total_events']}", f"**Blocked Events**: {row['blocked_events']}", f"**Block Rate**: {row['block_rate']}", "", "## Action Distribution", "", "| Action | Count |", "|---|---|"]
    return "\n".join([*lines, *(f"| {k} | {v} |" for k, v in row["action_distribution"].items())])


def render_benchmark(row: dict) -> str:
    return "\n".join(["# Benchmark Summary", "", f"**Total Tests**: {row['total']}", f"**Passed**: {row['passed']}", f"**Failed**: {row['failed']}", f"**Pass Rate**: {row['pass_rate'] * 100:.1f}%", f"**Total Time**: {row['total_time']:.4f}s"])


def iso_time(c: Column) -> Column:
    """A time as text, to the second."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def json_text(*fields: Column) -> Column:
    """Columns as one JSON document; letters beyond ASCII stay as they are."""
    return F.to_json(F.struct(*fields))


def to_json(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, indent=2)
