"""Risk scores, levels and factors; session statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions.rules import lookup, strings

ASSET = "array<struct<asset_id:string,risk_level:string,match_type:string>>"
NO_STRINGS = "array<string>"


def attack_points(category: Column, rules: dict = V.SCORING) -> Column:
    table = rules["attack_category_scores"]
    return F.when(category.isNull() | (category == ""), 0).otherwise(lookup(table, category, table.get("unknown_suspicious", 40)))


def _sum(items: Column, table: dict, field: str) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + lookup(table, x[field] if field else x, 0))


def asset_points(assets: Column, rules: dict = V.SCORING) -> Column:
    return _sum(F.transform(assets, lambda a: F.struct(F.coalesce(a["risk_level"], F.lit("low")).alias("risk_level"))), rules["asset_risk_scores"], "risk_level")


def match_points(assets: Column, rules: dict = V.SCORING) -> Column:
    return _sum(assets, rules["match_type_scores"], "match_type")


def authorization_points(status: Column, rules: dict = V.SCORING) -> Column:
    table = rules["authorization_adjustments"]
    return lookup(table, status, table.get("unknown", 10))


def session_points(signals: Column, rules: dict = V.SCORING) -> Column:
    return _sum(signals, rules["session_signal_scores"], "")


def strong_signals(signals: Column, rules: dict = V.SCORING) -> Column:
    """Signals of 25 points or more."""
    return F.filter(signals, lambda s: lookup(rules["session_signal_scores"], s, 0) >= 25)


def level_of(score: Column, bands: dict = V.SCORING["thresholds"]) -> Column:
    x = F.lit("low")
    for name, (low, high) in reversed(list(bands.items())):
        x = F.when(score.between(low, high), name).otherwise(x)
    return x


def action_of(level: Column) -> Column:
    return lookup(V.LEVEL_ACTIONS, level, "WARN")


def factors(category: Column, assets: Column, status: Column, signals: Column, triggered: Column, rules: dict = V.SCORING) -> Column:
    """What raised the score, each once, in order."""
    some = lambda cond, *names: F.when(cond, F.array(*names)).otherwise(F.array().cast(NO_STRINGS))
    has = category.isNotNull() & (category != "")
    risk = lambda r: F.exists(assets, lambda a: a["risk_level"] == r)
    return F.array_distinct(F.concat(
        some(has, category),
        some(has & ~category.isin(list(rules["attack_category_scores"])), F.lit("unknown_attack_category")),
        some(risk("high"), F.lit("matched_high_risk_asset")),
        some(risk("critical"), F.lit("matched_critical_risk_asset")),
        F.filter(F.transform(assets, lambda a: a["match_type"]), lambda m: m.isNotNull() & (m != "")),
        some(status.isNotNull() & ~status.isin("owner", "authorized", ""), status),
        triggered,
        signals,
        some(F.size(signals) > 0, F.lit("multi_turn")),
    ))


def needs_authorization(status: Column, assets: Column, score: Column) -> Column:
    return F.when(status.isin("unauthorized", "unknown", "role_claim_only"), True).when(status.isin("owner", "authorized"), False).otherwise((F.size(assets) > 0) | (score >= 60))


def strict_monitor(score: Column, assets: Column, signals: Column) -> Column:
    return (score >= 60) | F.exists(assets, lambda a: a["match_type"].isin(V.STRICT_MATCHES)) | F.coalesce(F.arrays_overlap(signals, strings(V.STRICT_SIGNALS)), F.lit(False))


def score(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Needs attack_category, matched_assets, triggered_rules, authorization_status, session_signals; null means none (status: unknown).
    Without rules the built-in ones hold, and the factors say so."""
    fallback, rules = rules is None, rules or V.SCORING
    none = F.array().cast(NO_STRINGS)
    assets = F.coalesce("matched_assets", F.array().cast(ASSET))
    signals, triggered = F.coalesce("session_signals", none), F.coalesce("triggered_rules", none)
    status, category = F.coalesce("authorization_status", F.lit("unknown")), F.col("attack_category")
    raw = attack_points(category, rules) + asset_points(assets, rules) + match_points(assets, rules) + authorization_points(status, rules) + session_points(signals, rules)
    x = df.withColumn("risk_score", F.greatest(F.lit(0), F.least(F.lit(100), raw)))
    x = x.withColumn("risk_level", level_of(F.col("risk_score"), rules.get("thresholds", {})))
    found = factors(category, assets, status, signals, triggered, rules)
    return x.withColumns({
        "recommended_action": action_of(F.col("risk_level")),
        "risk_factors": F.concat(found, F.array(F.lit("fallback_to_default_rules"))) if fallback else found,
        "requires_authorization": needs_authorization(status, assets, F.col("risk_score")),
        "enable_strict_runtime_monitor": strict_monitor(F.col("risk_score"), assets, signals),
    })


# ---- sessions -----------------------------------------------------------------------------------------


def session_stats(df: DataFrame, session_col: str, blocked: Column, risk: Column, alert: Column) -> DataFrame:
    """Per session: interactions, blocked, block_rate (3 places, ties to even), alerts, accumulated risk."""
    n = F.count(F.lit(1))
    b = F.sum(F.when(blocked, 1).otherwise(0))
    return df.groupBy(session_col).agg(n.alias("total_interactions"), b.alias("blocked_count"), F.bround(b / F.greatest(n, F.lit(1)), 3).alias("block_rate"), F.sum(F.when(alert, 1).otherwise(0)).alias("alert_count"), F.sum(risk).alias("accumulated_risk"))


def last_interactions(df: DataFrame, session_col: str, order_col: str, value: Column, n: int = 50) -> DataFrame:
    """Adds the ring buffer of the last n values up to each row."""
    w = Window.partitionBy(session_col).orderBy(order_col).rowsBetween(1 - n, 0)
    return df.withColumn("recent", F.collect_list(value).over(w))


def attack_chain(df: DataFrame, session_col: str, order_col: str, categories: Column) -> DataFrame:
    """Per session the turns with any category, in order."""
    x = df.withColumn("__c", categories).filter(F.size("__c") > 0)
    return x.groupBy(session_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("turn"), F.col("__c").alias("threats")))).alias("chain"))


def running_risk(df: DataFrame, session_col: str, order_col: str, risk: Column, blocked: Column) -> DataFrame:
    """Adds the accumulated risk and blocked count of the session up to each row."""
    w = Window.partitionBy(session_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"accumulated_risk": F.sum(risk).over(w), "blocked_so_far": F.sum(F.when(blocked, 1).otherwise(0)).over(w)})
