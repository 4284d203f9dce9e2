"""Output guard: secrets and assets in outputs, the verdict, and redaction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.functions.rules import listed, ranked

FINDING = "array<struct<name:string,type:string,matched_text:string,start:int,severity:string,action:string,placeholder:string>>"


def _sums_before(sizes: Column, block: int = 256) -> Column:
    """The sum of the elements before each one. Arrays are grown within blocks only, so that long ones aren't copied over and over."""
    grown = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    last = F.floor((F.size(sizes) - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(sizes, k * block + 1, block))
    before = grown(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)))
    return F.flatten(F.zip_with(F.transform(blocks, grown), before, lambda own, more: F.transform(own, lambda x: x + more)))


def _places(text: Column, pattern: str, make) -> Column:
    """make(match, place) for every match of a pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda p: F.length(p))
    before = _sums_before(F.zip_with(gaps, found, lambda g, f: g + F.length(f)))
    return F.when(text.rlike(pattern), F.zip_with(found, F.zip_with(before, gaps, lambda b, g: b + g), make)).otherwise(F.array().cast(FINDING))


def findings(text: Column, patterns: dict = V.SECRET_PATTERNS) -> Column:
    """All matches of all patterns, with their places from 0."""

    def maker(name: str, kind: str, severity: str, action: str, placeholder: str):
        return lambda match, place: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), match.alias("matched_text"), place.alias("start"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), F.lit(placeholder).alias("placeholder"))

    return F.concat(*(_places(text, p[0], maker(n, *p[1:])) for n, p in patterns.items()))


def pattern_names(text: Column, patterns: dict = V.SECRET_PATTERNS) -> Column:
    """Sorted names of the patterns that occur; cheaper than all findings."""
    return F.array_sort(listed([F.when(text.rlike(p[0]), F.lit(n)) for n, p in patterns.items()], "array<string>"))


def with_pattern(patterns: dict, name: str, pattern: str, severity: str = "FULL_LEAK", action: str = "REDACT", placeholder: str = "[REDACTED_SECRET]") -> dict:
    """The pattern set with one more."""
    re.compile(pattern)
    return patterns | {name: (pattern, "custom", severity, action, placeholder)}


def asset_hits(text: Column, assets: Column) -> Column:
    """(asset_id, kind, risk_level) with kind exact, alias or partial. Each asset is judged by itself: whole values and aliases under exact_match, else pieces of four characters under partial_match."""
    low = F.lower(text)

    def kind(a: Column) -> Column:
        mode = lambda m: F.array_contains(F.coalesce(a["protection_modes"], F.array(F.lit("exact_match"))), m)
        whole = (F.length(a["value"]) > 0) & low.contains(F.lower(a["value"]))
        alias = F.exists(F.coalesce(a["aliases"], F.array().cast("array<string>")), lambda w: (w != "") & low.contains(F.lower(w)))
        part = F.exists(T.grams(F.lower(a["value"])), lambda g: low.contains(g))
        return F.when(mode("exact_match") & whole, "exact").when(mode("exact_match") & alias, "alias").when(mode("partial_match") & part, "partial")

    rows = F.transform(assets, lambda a: F.struct(a["asset_id"].alias("asset_id"), kind(a).alias("kind"), a["risk_level"].alias("risk_level")))
    return F.filter(rows, lambda r: r["kind"].isNotNull())


def verdict(found: Column, hits: Column) -> Column:
    """risk_level, action, leakage_detected: the worst severity; BLOCK before REDACT before ALLOW."""
    worst = F.greatest(
        F.coalesce(F.array_max(F.transform(found, lambda f: ranked(V.SEVERITIES, f["severity"]))), F.lit(0)),
        F.when(F.exists(hits, lambda h: h["kind"].isin("exact", "alias")), 4).when(F.size(hits) > 0, 2).otherwise(0),
    )
    block = F.exists(found, lambda f: f["action"] == "BLOCK") | F.exists(hits, lambda h: h["kind"].isin("exact", "alias"))
    some = (F.size(found) > 0) | (F.size(hits) > 0)
    return F.struct(F.element_at(F.array(*map(F.lit, V.SEVERITIES)), worst + 1).alias("risk_level"), F.when(block, "BLOCK").when(some, "REDACT").otherwise("ALLOW").alias("action"), some.alias("leakage_detected"))


def redact_patterns(text: Column, patterns: dict = V.SECRET_PATTERNS) -> Column:
    """Every match gives way to its placeholder, pattern after pattern."""
    for pattern, _, _, _, placeholder in patterns.values():
        text = F.regexp_replace(text, F.lit(pattern), F.lit(placeholder))
    return text


def redact_value(text: Column, value: Column, placeholder: str = "[REDACTED_SECRET]") -> Column:
    """The first occurrence in any letter case; an empty value changes nothing."""
    at = F.call_function("instr", F.lower(text), F.lower(value))
    return F.when((F.length(value) > 0) & (at > 0), F.concat(F.left(text, at - 1), F.lit(placeholder), F.substring(text, at + F.length(value), F.length(text)))).otherwise(text)




def redact_pieces(text: Column, values: Column) -> Column:
    """Every piece of four characters of the values, again and again until none is left outside a placeholder. Runs in an Arrow UDF: no relational form reaches a fixed point. Null values leave the text alone."""
    mark = "[REDACTED_PARTIAL]"

    def one(text: str, value: str) -> str:
        for i in range(len(value) - 3):
            piece = value[i : i + 4].lower()
            kept = re.split(r"(\[REDACTED_[A-Z_]+\])", text)
            text = "".join(p if p.startswith("[REDACTED_") else re.sub(re.escape(piece), mark, p, flags=re.IGNORECASE) for p in kept)
        return text

    @F.pandas_udf("string")
    def pieces(texts: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for t, vs in zip(texts, values):
            for v in vs if vs is not None else ():
                t = one(t, v)
            out.append(t)
        return pd.Series(out, dtype=object)

    return F.coalesce(pieces(F.when(values.isNotNull(), text), values), text)


def inspect(df: DataFrame, assets: Column, text_col: str = "text", redact: bool = True) -> DataFrame:
    """Adds matched_patterns, matched_assets (sorted), risk_level, action, is_blocked, is_redacted, leakage_detected, safe_output. Null and empty outputs are allowed as they are."""
    text = F.coalesce(df[text_col], F.lit(""))
    x = df.withColumn("__found", findings(text)).withColumn("__hits", asset_hits(text, assets))
    x = x.withColumn("__verdict", verdict(F.col("__found"), F.col("__hits")))
    names = F.concat(F.transform("__found", lambda f: f["name"]), F.transform("__hits", lambda h: F.concat(F.lit("asset_"), h["kind"], F.lit(":"), h["asset_id"])))
    x = x.withColumns({
        "matched_patterns": F.array_sort(F.array_distinct(names)),
        "matched_assets": F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["asset_id"]))),
        "risk_level": F.col("__verdict.risk_level"),
        "action": F.col("__verdict.action"),
        "is_blocked": F.col("__verdict.action") == "BLOCK",
        "leakage_detected": F.col("__verdict.leakage_detected"),
    })
    if redact:
        whole = F.filter(assets, lambda a: F.exists("__hits", lambda h: (h["asset_id"] == a["asset_id"]) & h["kind"].isin("exact", "alias")))
        words = F.flatten(F.transform(whole, lambda a: F.concat(F.array(a["value"]), F.coalesce(a["aliases"], F.array().cast("array<string>")))))
        safe = F.aggregate(words, redact_patterns(text), lambda done, w: redact_value(done, w))
        part = F.filter(assets, lambda a: F.exists("__hits", lambda h: (h["asset_id"] == a["asset_id"]) & (h["kind"] == "partial")))
        values = F.when(F.size(part) > 0, F.transform(part, lambda a: a["value"]))
        x = x.withColumns({"__safe": safe, "__values": values})
        x = x.withColumn("safe_output", redact_pieces(F.col("__safe"), F.col("__values"))).drop("__safe", "__values")
        x = x.withColumn("is_redacted", (F.col("action") == "REDACT") & (F.col("safe_output") != text))
    return x.drop("__found", "__hits", "__verdict")
