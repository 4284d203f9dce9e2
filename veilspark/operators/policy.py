"""Policy decisions, request policies and their projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions.rules import lookup, strings

#: An asset as policies see it.
POLICY_ASSET = "array<struct<asset_id:string,name:string,type:string,risk_level:string,allowed_roles:array<string>,protection_modes:array<string>,aliases:array<string>>>"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def band_action(score: Column) -> Column:
    x = F.lit("BLOCK")
    for low, high, action in reversed(V.ACTION_BANDS):
        x = F.when(score.between(low, high), action).otherwise(x)
    return x


def unauthorized(assets: Column, role: Column, authorized: Column) -> Column:
    """Some asset has roles, and the role isn't among them. Without roles an asset is open."""
    return ~F.coalesce(authorized, F.lit(False)) & F.exists(assets, lambda a: (F.size(F.coalesce(a["allowed_roles"], no_strings())) > 0) & ~F.array_contains(a["allowed_roles"], role))


def decide(df: DataFrame) -> DataFrame:
    """Needs attack_category, risk_score, risk_level, matched_assets, user_role, is_authorized, session_risk_score, history_flags;
    nulls stand for none, 0, low, unknown and not authorized. Adds action and what follows from it."""
    category = F.coalesce("attack_category", F.lit(""))
    score, session = F.coalesce("risk_score", F.lit(0)), F.coalesce("session_risk_score", F.lit(0))
    level = F.coalesce("risk_level", F.lit("low"))
    assets = F.coalesce("matched_assets", F.array().cast(POLICY_ASSET))
    denied = unauthorized(assets, F.coalesce("user_role", F.lit("unknown")), F.col("is_authorized"))
    direct = (category == "direct_secret_request") & (F.size(assets) > 0)
    partial = (category == "partial_disclosure") | F.coalesce(F.arrays_overlap("history_flags", strings(V.PROBE_FLAGS)), F.lit(False))

    band = band_action(score)
    lifted = F.when(partial & band.isin("ALLOW", "WARN", "REWRITE"), "RESTRICT").otherwise(band)
    lifted = F.when(partial & (session >= 75) & (lifted != "BLOCK"), "ESCALATE").otherwise(lifted)
    role = F.when(category.isin(V.ROLE_OVERRIDES), F.when(score < 40, "REWRITE").when(score < 60, "RESTRICT").otherwise("BLOCK")).otherwise(lifted)
    late = F.when(session >= 90, "BLOCK").when((session >= 75) & ~role.isin("BLOCK", "ESCALATE"), "ESCALATE").otherwise(role)
    action = (
        F.when(category == "system_prompt_extraction", "BLOCK")
        .when(denied, F.when(score >= 75, "BLOCK").otherwise("AUTHORIZE"))
        .when(direct, "BLOCK")
        .when(category == "encoding_bypass", F.when(score >= 60, "BLOCK").otherwise("RESTRICT"))
        .otherwise(late)
    )
    x = df.withColumn("action", action)
    a = F.col("action")
    parts = [
        F.concat(F.lit("Risk "), score.cast("string"), F.lit("/"), level),
        F.concat(F.lit("action="), F.lower(a)),
        F.when(category != "", F.concat(F.lit("attack="), category)),
        F.when(denied, "unauthorized asset request"),
        F.when(direct, "direct secret access"),
        F.when(partial, "partial disclosure or probe"),
        F.when(session >= 75, F.concat(F.lit("session_risk="), session.cast("string"))),
    ]
    skill = lookup(V.REQUIRED_SKILLS, category)
    return x.withColumns({
        "reason": F.concat_ws("; ", *parts),
        "monitoring_level": lookup(V.MONITORING, a),
        "log_level": lookup(V.LOG_LEVELS, a),
        "required_skills": F.array_compact(F.array(skill)),
        "prompt_constraints": F.when(a.isin("ALLOW", "WARN"), no_strings()).otherwise(strings(V.PROMPT_CONSTRAINTS)),
        "should_block": a == "BLOCK",
        "should_rewrite": a == "REWRITE",
        "should_restrict": a.isin("RESTRICT", "BLOCK", "ESCALATE"),
        "should_escalate": (a == "ESCALATE") | (session >= 75) | (score >= 90),
    })


def with_defaults(df: DataFrame, **columns: str) -> DataFrame:
    """Adds the missing columns of a decision's context as typed nulls, which `decide` reads as defaults. columns: other names for them."""
    types = {"attack_category": "string", "risk_score": "int", "risk_level": "string", "matched_assets": POLICY_ASSET, "user_role": "string", "is_authorized": "boolean", "session_risk_score": "int", "history_flags": "array<string>"}
    for name, source in columns.items():
        df = df.withColumn(name, F.col(source))
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def role_policy(action: Column, role: Column, names: Column) -> Column:
    """The older policy: monitoring only for some actions in lower case."""
    known = lambda i: F.coalesce(*(F.when(role == r, strings(v[i])) for r, v in V.ROLES.items()), no_strings())
    return F.struct(action.alias("action"), role.alias("role"), names.alias("restricted_assets"), known(0).alias("allowed_roles"), known(1).alias("required_permissions"), action.isin("warn", "restrict", "block", "escalate").alias("enable_monitoring"), (action != "allow").alias("enable_leakage_check"))


# ---- request policies -----------------------------------------------------------------------------------


def build_level(score: Column) -> Column:
    return F.when(score <= 29, "low").when(score <= 69, "medium").otherwise("high")


def resolve_role(action: Column, role: Column, assets: Column) -> Column:
    """require_authorization, resolved_action, denied names. Null roles of an asset mean its owner."""
    barred = F.filter(assets, lambda a: ~F.array_contains(F.coalesce(a["allowed_roles"], F.array(F.lit("owner"))), role))
    need = F.size(barred) > 0
    return F.struct(need.alias("require_authorization"), F.when(need & ~action.isin("AUTHORIZE", "BLOCK"), "AUTHORIZE").otherwise(action).alias("resolved_action"), F.transform(barred, lambda a: F.concat(F.lit("不可提供受保護資產「"), F.coalesce(a["name"], F.lit("protected asset")), F.lit("」的內容"))).alias("denied_response_scope"))


def scope(action: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*(F.when(action == a, strings(t)) for a, t in table.items()), no_strings())


def merged_skills(enabled: Column, results: Column) -> Column:
    """Distinct skills and transformations in order, and whether any result asks for checks or strict monitoring.
    results: array of (blocked_transformations, verify_encoding, verify_reconstruction, runtime_monitoring_mode)."""
    flag = lambda f: F.coalesce(F.exists(results, lambda r: F.coalesce(r[f], F.lit(False))), F.lit(False))
    strict = F.exists(results, lambda r: F.coalesce(r["runtime_monitoring_mode"] == "strict", F.lit(False)))
    return F.struct(
        F.array_distinct(enabled).alias("enabled_skills"),
        F.array_distinct(F.flatten(F.transform(results, lambda r: F.coalesce(r["blocked_transformations"], no_strings())))).alias("blocked_transformations"),
        flag("verify_encoding").alias("verify_encoding"),
        flag("verify_reconstruction").alias("verify_reconstruction"),
        F.when(F.coalesce(strict, F.lit(False)), "strict").otherwise("normal").alias("runtime_monitoring_mode"),
    )


SKILL_RESULTS = "array<struct<blocked_transformations:array<string>,verify_encoding:boolean,verify_reconstruction:boolean,runtime_monitoring_mode:string>>"


def build(df: DataFrame) -> DataFrame:
    """Needs request_id, policy_action, risk_score, user_role, attack_category, matched_assets, enabled_skills, skill_defense_results. Adds a struct `policy`."""
    assets = F.coalesce("matched_assets", F.array().cast(POLICY_ASSET))
    results = F.coalesce("skill_defense_results", F.array().cast(SKILL_RESULTS))
    x = df.withColumn("__role", resolve_role(F.col("policy_action"), F.col("user_role"), assets)).withColumn("__merged", merged_skills(F.coalesce("enabled_skills", no_strings()), results))
    action, merged, need = F.col("__role.resolved_action"), F.col("__merged"), F.col("__role.require_authorization")
    pick = lambda f: F.filter(F.transform(assets, lambda a: a[f]), lambda v: v.isNotNull() & (v != ""))
    pool = lambda f: F.array_distinct(F.flatten(F.transform(assets, lambda a: F.coalesce(a[f], no_strings()))))
    modes = pool("protection_modes")
    severe = F.exists(assets, lambda a: F.coalesce(a["risk_level"].isin("high", "critical"), F.lit(False)))
    verify = lambda mode: severe & F.array_contains(modes, mode)
    policy = F.struct(
        F.col("request_id"),
        action.alias("action"),
        F.col("risk_score"),
        build_level(F.col("risk_score")).alias("risk_level"),
        F.col("user_role"),
        F.col("attack_category"),
        pick("asset_id").alias("protected_asset_ids"),
        pick("name").alias("protected_asset_names"),
        pick("type").alias("protected_asset_types"),
        modes.alias("protection_modes"),
        scope(action, V.ALLOWED_SCOPE).alias("allowed_response_scope"),
        scope(action, V.DENIED_SCOPE).alias("denied_response_scope"),
        merged["enabled_skills"].alias("enabled_skills"),
        pool("aliases").alias("restricted_tokens"),
        merged["blocked_transformations"].alias("blocked_transformations"),
        (need | (action == "AUTHORIZE")).alias("require_authorization"),
        F.lit(True).alias("runtime_monitoring_enabled"),
        F.when(action == "ESCALATE", "strict").otherwise(merged["runtime_monitoring_mode"]).alias("runtime_monitoring_mode"),
        (action == "ESCALATE").alias("interrupt_on_match"),
        F.lit(True).alias("verify_exact"),
        ((action == "RESTRICT") | verify("partial_match")).alias("verify_partial"),
        (merged["verify_encoding"] | verify("encoding_match")).alias("verify_encoding"),
        verify("translation_match").alias("verify_translation"),
        ((action == "RESTRICT") | merged["verify_reconstruction"] | verify("reconstruction_match")).alias("verify_reconstruction"),
        F.lit("safe_refusal").alias("refusal_strategy"),
    )
    return x.withColumn("policy", policy).drop("__role", "__merged")


PROMPT_FIELDS = ["request_id", "action", "risk_score", "risk_level", "user_role", "attack_category", "protected_asset_ids", "protected_asset_names", "protected_asset_types", "protection_modes", "allowed_response_scope", "denied_response_scope", "refusal_strategy"]


def prompt_policy(policy: Column) -> Column:
    """What a prompt may know of a policy: neither tokens nor checks."""
    return F.struct(*(policy[f].alias(f) for f in PROMPT_FIELDS))


def runtime_policy(policy: Column) -> Column:
    """What monitoring needs; matchers pair ids, names and types by place, as far as the shortest goes."""
    n = F.least(F.size(policy["protected_asset_ids"]), F.size(policy["protected_asset_names"]), F.size(policy["protected_asset_types"]))
    first = lambda f: F.slice(policy[f], F.lit(1), n)
    rows = F.arrays_zip(first("protected_asset_ids").alias("asset_id"), first("protected_asset_names").alias("name"), first("protected_asset_types").alias("type"))
    return F.struct(
        F.lit(True).alias("internal_only"),
        policy["request_id"].alias("request_id"),
        F.transform(rows, lambda r: F.struct(r["asset_id"].alias("asset_id"), r["name"].alias("name"), r["type"].alias("type"), policy["protection_modes"].alias("protection_modes"))).alias("asset_matchers"),
        policy["restricted_tokens"].alias("restricted_tokens"),
        policy["blocked_transformations"].alias("blocked_transformations"),
        F.struct(policy["runtime_monitoring_enabled"].alias("enabled"), policy["runtime_monitoring_mode"].alias("mode"), policy["interrupt_on_match"].alias("interrupt_on_match")).alias("runtime_monitoring"),
        F.struct(*(policy[f"verify_{c}"].alias(c) for c in ("exact", "partial", "encoding", "translation", "reconstruction"))).alias("verification"),
    )
