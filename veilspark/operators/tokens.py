"""Restricted tokens: expansion of assets, matching, and the guard's decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.functions.rules import any_contained, lookup, strings

TOKEN = "array<struct<asset_id:string,token:string,token_type:string,risk_level:string,source:string>>"


def expand(assets: DataFrame) -> DataFrame:
    """One row per token of each asset, by its modes, in the order `ord`: exact value, parts, aliases, codes, bare letters and digits."""
    value, mode = F.col("value"), lambda m: F.array_contains("protection_modes", m)
    row = lambda kind, source: lambda t: F.struct(t.alias("token"), F.lit(kind).alias("token_type"), F.lit(source).alias("source"))
    some = lambda cond, items, kind, source: F.when(cond, F.transform(items, row(kind, source))).otherwise(F.array().cast("array<struct<token:string,token_type:string,source:string>>"))
    url = T.percent_code(value)
    codes = F.array_compact(F.array(T.to_base64(value), T.to_hex(value), F.when(url != value, url), T.unicode_code(value)))
    tokens = F.concat(
        some(mode("exact_match"), F.array(value), "exact", "asset_value"),
        some(mode("partial_match"), T.parts(value), "partial", "generated_variant"),
        some(mode("alias_match"), F.coalesce("aliases", strings([])), "alias", "alias"),
        some(mode("encoding_match"), codes, "encoded", "generated_variant"),
        some(mode("normalization_match"), F.array(T.alnum_only(value)), "normalized", "generated_variant"),
    )
    x = assets.filter("value <> ''").select("asset_id", "risk_level", F.posexplode(tokens).alias("ord", "t"))
    return x.select("asset_id", "ord", "t.token", "t.token_type", "risk_level", "t.source")


def export(tokens: DataFrame) -> DataFrame:
    """Per asset the tokens of each type, in order, as monitoring wants them."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("token_type") == kind, F.struct("ord", "token")))), lambda x: x["token"])
    return tokens.groupBy("asset_id", "risk_level").agg(of("exact").alias("exact"), of("partial").alias("partial"), of("alias").alias("aliases"), of("encoded").alias("encoded"), of("normalized").alias("normalized"))


def as_literal(rows) -> Column:
    """Collected tokens (asset_id, token, token_type, risk_level) of a small registry as an array literal."""
    return F.array(*(F.struct(F.lit(r["asset_id"]).alias("asset_id"), F.lit(r["token"]).alias("token"), F.lit(r["token_type"]).alias("token_type"), F.lit(r["risk_level"]).alias("risk_level")) for r in rows))


def matches(text: Column, tokens: Column, normal: Column) -> Column:
    """(asset_id, matched_text, match_type, risk_level, start, reason), once per asset, type and token. start: the first place, from 0.
    normal: a column with the text in compatibility composition, made beforehand."""
    low = F.lower(text)
    bare = F.translate(normal, V.ASSET_ZERO_WIDTH, "")
    packed = F.lower(F.regexp_replace(bare, "[^a-zA-Z0-9]", ""))
    dense = F.lower(F.regexp_replace(bare, f"{T.WHITE}+", ""))
    spot = lambda hay, t: F.nullif(F.call_function("instr", hay, t), F.lit(0)) - 1

    def start(t: Column) -> Column:
        token, small = t["token"], F.lower(t["token"])
        i = spot(low, small)
        before, after = F.substring(low, i, F.lit(1)), F.substring(low, i + 1 + F.length(small), F.lit(1))
        free = lambda c: ~c.rlike(r"[\p{L}\p{N}_]")
        whole = token.rlike("[　-〿一-鿿]") | (F.when(i == 0, True).otherwise(free(before)) & free(after))
        return (
            F.when(t["token_type"] == "exact", F.coalesce(spot(text, token), i))
            .when(t["token_type"] == "partial", i)
            .when((t["token_type"] == "alias") & whole, i)
            .when(t["token_type"] == "encoded", spot(text, token))
            .when(t["token_type"] == "normalized", F.coalesce(spot(packed, small), spot(dense, small)))
        )

    reason = lambda t: lookup({"exact": "exact secret match", "partial": "partial secret fragment (>=6 chars)", "alias": "alias match", "encoded": "encoded secret match", "normalized": "normalized variant match"}, t["token_type"])
    rows = F.transform(tokens, lambda t: F.struct(t["asset_id"].alias("asset_id"), t["token"].alias("matched_text"), t["token_type"].alias("match_type"), t["risk_level"].alias("risk_level"), start(t).cast("int").alias("start"), reason(t).alias("reason")))
    return F.filter(rows, lambda m: m["start"].isNotNull())


def extraction_intent(text: Column) -> Column:
    return any_contained(text, V.EXTRACTION_ZH) | any_contained(F.lower(text), V.EXTRACTION_EN)


def teaching(text: Column) -> Column:
    return any_contained(F.lower(text), V.TEACHING)


def verdict(text: Column, found: Column) -> Column:
    """allowed, action, risk_level, note: the strongest kind of match decides."""
    intent = extraction_intent(text)
    has = lambda kind: F.exists(found, lambda m: m["match_type"] == kind)
    grave = F.exists(found, lambda m: (m["match_type"] == "exact") & m["risk_level"].isin("high", "critical"))
    out = lambda allowed, action, risk, note: F.struct(F.lit(allowed).alias("allowed"), F.lit(action).alias("action"), F.lit(risk).alias("risk_level"), F.lit(note).alias("note"))
    return (
        F.when((text == "") | text.isNull(), out(True, "ALLOW", "low", "empty text"))
        .when(F.size(found) == 0, out(True, "ALLOW", "low", "no matches found"))
        .when(grave, out(False, "BLOCK", "critical", "critical secret detected"))
        .when(has("encoded"), out(False, "BLOCK", "critical", "encoded secret detected"))
        .when(has("partial") & intent, out(False, "BLOCK", "high", "partial secret with extraction intent"))
        .when(has("partial"), out(False, "ESCALATE", "high", "partial secret fragment detected"))
        .when(has("normalized") & intent, out(False, "BLOCK", "high", "normalized variant with extraction intent"))
        .when(has("normalized"), out(False, "ESCALATE", "high", "normalized variant detected"))
        .when(has("alias") & teaching(text) & ~intent, out(True, "WARN", "low", "alias match but educational context"))
        .when(has("alias") & intent, out(False, "BLOCK", "high", "alias with extraction intent"))
        .when(has("alias"), out(False, "RESTRICT", "medium", "alias detected"))
        .otherwise(out(True, "ALLOW", "low", "no actionable matches"))
    )


def guard(df: DataFrame, tokens: Column, text_col: str = "text", decode_escapes: bool = True) -> DataFrame:
    """Adds token_matches and token_verdict. Texts with \\uXXXX escapes are also matched as decoded."""
    text = F.coalesce(df[text_col], F.lit(""))
    df = df.withColumn("__normal", T.nfkc(text))
    found = matches(text, tokens, F.col("__normal"))
    if decode_escapes:
        readings = T.unescaped(text)
        more = [F.coalesce(matches(F.get(readings, F.lit(i)), tokens, F.get(readings, F.lit(i))), F.array().cast(found_type())) for i in (0, 1)]
        found = F.when(text.contains("\\u"), F.array_distinct(F.concat(found, *more))).otherwise(found)
    x = df.withColumn("token_matches", found)
    return x.withColumn("token_verdict", verdict(text, F.col("token_matches"))).drop("__normal")


def found_type() -> str:
    return "array<struct<asset_id:string,matched_text:string,match_type:string,risk_level:string,start:int,reason:string>>"


def prompt_verdict(found: Column, outcome: Column) -> Column:
    """A protected prompt must hold no exact, partial or alias match."""
    leak = F.exists(found, lambda m: m["match_type"].isin("exact", "partial", "alias"))
    return F.struct((outcome["allowed"] & ~leak).alias("allowed"), F.when(leak, "REWRITE_REQUIRED").otherwise(outcome["action"]).alias("action"), F.when(leak, "critical").otherwise(outcome["risk_level"]).alias("risk_level"), F.when(leak, "protected_prompt_contains_secret").when(outcome["allowed"] & (outcome["action"] == "ALLOW"), "protected_prompt_is_clean").otherwise(outcome["note"]).alias("note"))


def synonyms(token: Column) -> Column:
    return F.coalesce(*(F.when(token == k, strings([k, *v])) for k, v in V.TOKEN_SYNONYMS.items()), F.array(token))


def token_risk(token: Column) -> Column:
    return lookup(V.TOKEN_RISK, token)


def simple_guard(text: Column, tokens: list[str]) -> Column:
    """(blocked, matched_tokens, reason): which of the tokens and their synonyms the text contains."""
    every = sorted({t for k in tokens for t in [k, *V.TOKEN_SYNONYMS.get(k, [])]})
    low = F.lower(text)
    hits = F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in every))) if every else strings([])
    reason = F.when(text.isNull(), "None input.").when(F.lit(not every), "No restricted tokens set.").when(F.size(hits) > 0, F.concat(F.lit("Detected: "), F.array_join(hits, ", "))).otherwise("Clean.")
    return F.struct((text.isNotNull() & (F.size(hits) > 0)).alias("blocked"), F.when(text.isNull(), strings([])).otherwise(hits).alias("matched_tokens"), reason.alias("reason"))
