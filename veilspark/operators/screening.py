"""Prompt screening: detectors give tags, tags give points, points give a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions.rules import any_match
from veilspark.functions.text import is_blank



def _tags(**hits: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in hits.items())))


def keyword_tags(text: Column) -> Column:
    low = F.lower(text)
    return _tags(**{t: any_match(low, p) for t, p in V.KEYWORD_PATTERNS.items()})


def format_tags(text: Column) -> Column:
    low = F.lower(text)
    return _tags(
        possible_xss=any_match(low, V.SCRIPT_PATTERNS, "s"),
        prompt_smuggling=any_match(low, V.SMUGGLING_PATTERNS),
        structured_leakage_request=any_match(low, V.STRUCTURED_PATTERNS),
        suspicious_format=text.contains(V.CODE_FENCE),  # every other pattern of this tag needs a fence too
    )


def asset_names(text: Column) -> Column:
    low = F.lower(text)
    return _tags(**{n: any_match(low, p) for n, p in V.ASSET_NAME_PATTERNS.items()})


def asset_tags(text: Column) -> Column:
    low = F.lower(text)
    return _tags(protected_asset_mention=F.size(asset_names(text)) > 0, partial_disclosure=any_match(low, V.PARTIAL_PATTERNS), encoded_disclosure=any_match(low, V.ENCODED_PATTERNS))


def override_tags(text: Column) -> Column:
    return _tags(instruction_override=any_match(F.lower(text), V.OVERRIDE_PATTERNS))


def claimed_role(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_match(low, V.ROLE_PATTERNS["owner"]), "owner").when(any_match(low, V.ROLE_PATTERNS["authorized"]), "authorized")


def encoding_tags(text: Column) -> Column:
    low = F.lower(text)
    return _tags(
        obfuscation_hint=any_match(low, V.SPACED_WORDS) | any_match(low, V.SPACED_ANY),
        encoding_hint=any_match(low, V.ENCODING_PATTERNS),
        cross_language_hint=any_match(low, V.LANGUAGE_PATTERNS),
    )


def points(tags: Column, assets: Column, needs_check: Column) -> Column:
    """At most 100: points of the tags, 10 for a role to check, 5 for each asset, 15 from three tags on."""
    table = F.create_map(*(F.lit(x) for pair in V.TAG_POINTS.items() for x in pair))
    base = F.aggregate(tags, F.lit(0), lambda a, t: a + F.coalesce(F.element_at(table, t), F.lit(10)))
    return F.least(F.lit(100), base + F.when(needs_check, 10).otherwise(0) + 5 * F.size(assets) + F.when(F.size(tags) >= 3, 15).otherwise(0))


def recommended(score: Column, tags: Column) -> Column:
    risky = F.arrays_overlap(tags, F.array(*map(F.lit, V.HIGH_RISK_TAGS)))
    return F.when(score >= 70, "block_candidate").when(score >= 50, "escalate_candidate").when((score >= 30) | risky, "monitor_candidate").otherwise("allow")


def screen(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the verdict's columns. Blank and null texts are allowed and have no tags."""
    text = F.coalesce(df[text_col], F.lit(""))
    blank = is_blank(text)
    none = F.array().cast("array<string>")
    role = claimed_role(text)
    tags = F.array_sort(F.array_distinct(F.concat(keyword_tags(text), format_tags(text), asset_tags(text), override_tags(text), F.when(role.isNotNull(), F.array(F.lit("role_claim"))).otherwise(none), encoding_tags(text))))
    x = df.withColumns({
        "matched_rules": F.when(blank, none).otherwise(tags),
        "detected_assets": F.when(blank, none).otherwise(F.array_sort(asset_names(text))),
        "claimed_role": F.when(~blank, role),
    })
    x = x.withColumn("requires_authorization_check", F.col("claimed_role").isNotNull())
    x = x.withColumn("score_hint", F.when(blank, 0).otherwise(points(F.col("matched_rules"), F.col("detected_assets"), F.col("requires_authorization_check"))))
    return x.withColumns({
        "allow": F.col("score_hint") < 40,
        "normalized_excerpt": F.when(blank, "").otherwise(F.left(text, F.lit(200))),
        "recommended_action": recommended(F.col("score_hint"), F.col("matched_rules")),
    })
