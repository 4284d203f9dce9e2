"""The request path end to end: normalise, screen, classify, score, decide, route, build the policy and the protected prompt, and guard its tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.functions.rules import lookup
from veilspark.operators import assets as A
from veilspark.operators import classification, policy, prompts, risk, screening, skills, tokens


def handle(df: DataFrame, text_col: str = "text", role_col: str | None = None, asset_rows=V.ASSETS) -> DataFrame:
    """Adds the outcome of each stage to a table of prompts, in one pass: no shuffle, and nothing is written in between. Names of categories are bridged between
    the classifier, scoring and policy."""
    literal = A.literal(asset_rows)
    x = df.withColumn("original_prompt", F.coalesce(F.col(text_col), F.lit("")))
    x = x.withColumn("normalized_prompt", T.unicode_chain(T.whitespace(F.col("original_prompt"))))
    x = screening.screen(x, "original_prompt").withColumnRenamed("recommended_action", "screen_action")
    x = classification.classify(x, "original_prompt", "normalized_prompt")
    x = x.withColumn("attack_category", lookup(V.CATEGORY_BRIDGE, F.col("primary_category"), None))
    x = x.withColumn("attack_category", F.when(F.col("is_attack"), F.coalesce("attack_category", "primary_category")))
    low = F.lower("normalized_prompt")
    named = F.filter(literal, lambda a: low.contains(F.lower(a["value"])) | F.exists(a["aliases"], lambda w: low.contains(F.lower(w))))
    x = x.withColumn("__assets", F.when(F.col("is_attack"), named).otherwise(F.filter(literal, lambda a: F.lit(False))))
    x = x.withColumn("matched_assets", F.transform("__assets", lambda a: F.struct(a["asset_id"].alias("asset_id"), a["risk_level"].alias("risk_level"), F.when(low.contains(F.lower(a["value"])), "exact_match").otherwise("alias_match").alias("match_type"))))
    role = F.col(role_col) if role_col else F.col("claimed_role")
    x = x.withColumns({"triggered_rules": F.col("matched_rules"), "authorization_status": F.when(F.col("claimed_role").isNotNull(), "role_claim_only").otherwise("unknown"), "session_signals": F.array().cast("array<string>"), "user_role": F.coalesce(role, F.lit("unknown"))})
    x = risk.score(x, V.SCORING).withColumnRenamed("recommended_action", "risk_action")
    x = x.withColumn("matched_assets", F.transform("__assets", lambda a: F.struct(*(a[f].alias(f) for f in ("asset_id", "name", "type", "risk_level", "allowed_roles", "protection_modes", "aliases")))))
    x = policy.decide(policy.with_defaults(x)).withColumnRenamed("action", "policy_action")
    x = x.withColumns({"attack_categories": F.col("matched_categories")})
    x = skills.route(x, "original_prompt").withColumnRenamed("recommended_action", "route_action").withColumnRenamed("blocked", "route_blocked")
    x = x.withColumns({"request_id": F.sha2(F.col("original_prompt").cast("binary"), 256), "enabled_skills": F.col("executed_skills"), "skill_defense_results": F.lit(None).cast(policy.SKILL_RESULTS)})
    x = policy.build(x)
    x = x.withColumns({"protected_assets": F.col("matched_assets"), "allowed_scope": F.col("policy.allowed_response_scope"), "denied_scope": F.col("policy.denied_response_scope")})
    x = prompts.protect(x)
    known = A.literal(asset_rows)
    exact = F.transform(known, lambda a: F.struct(a["asset_id"].alias("asset_id"), a["value"].alias("token"), F.lit("exact").alias("token_type"), a["risk_level"].alias("risk_level")))
    x = tokens.guard(x, exact, "final_prompt", decode_escapes=False)
    return x.withColumn("token_action", tokens.prompt_verdict(F.col("token_matches"), F.col("token_verdict"))["action"]).drop("__assets")
