"""Leakage verification: exact, partial, encoded, rebuilt, translated and semantic leaks of assets in outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.functions.rules import ranked

LEAK = "array<struct<asset_id:string,leak_type:string,match_type:string,severity:string,confidence:double,matched_text:string,matched_fragments:array<string>>>"
#: Modes of assets, and what looks for them; other modes are none.
MODES = ["exact_match", "partial_match", "encoding_match", "reconstruction_match", "translation_match", "semantic_match"]


def _row(a: Column, leak: str, match: str, severity: Column | str, confidence: Column, text: Column, fragments: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(a["asset_id"].alias("asset_id"), F.lit(leak).alias("leak_type"), F.lit(match).alias("match_type"), sev.alias("severity"), confidence.cast("double").alias("confidence"), text.alias("matched_text"), fragments.alias("matched_fragments"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _text(value=None) -> Column:
    return F.lit(value).cast("string")


def exact(low: Column, a: Column) -> Column:
    return F.when((a["value"] != "") & low.contains(F.lower(a["value"])), F.array(_row(a, "full_leak", "exact", "critical", F.lit(1.0), a["value"], _none())))


def partial(low: Column, a: Column) -> Column:
    """Pieces of four characters without punctuation; confidence is their share, at most 0.9."""
    pieces = T.plain_grams(a["value"])
    hits = F.filter(pieces, lambda g: low.contains(F.lower(g)))
    return F.when(F.size(hits) > 0, F.array(_row(a, "partial_leak", "partial", "high", F.least(F.lit(0.9), F.size(hits) / F.greatest(F.size(pieces), F.lit(1))), _text(), hits)))


def encoded(low: Column, a: Column) -> Column:
    codes = {"base64": T.to_base64(a["value"]), "hex": T.to_hex(a["value"]), "url_encoding": T.percent_code(a["value"]), "rot13": T.rot13(a["value"])}
    rows = F.array(*(F.when(low.contains(F.lower(c)), _row(a, "encoding_leak", k, "critical", F.lit(1.0), c, _none())) for k, c in codes.items()))
    return F.when(a["value"] != "", F.array_compact(rows))


def rebuilt(low: Column, a: Column, before: Column) -> Column:
    """Pieces of four characters, with those collected in the session; overlaps count twice, a right order adds 0.2."""
    value = F.lower(a["value"])
    hits = F.filter(T.grams(value), lambda g: low.contains(g))
    every = F.array_union(hits, before)
    chars = F.aggregate(F.transform(every, lambda g: F.length(g)), F.lit(0), lambda x, n: x + n)
    coverage = chars / F.greatest(F.length(value), F.lit(1))
    # pieces are looked for in the order of the value, so that their places never go back
    sure = F.least(F.lit(1.0), coverage + F.when(F.size(hits) >= 2, 0.2).otherwise(0.0))
    return F.when((F.length(value) >= 4) & (coverage >= 0.6), F.array(_row(a, "reconstruction_leak", "reconstruction", "high", F.bround(sure, 2), _text(), F.array_sort(hits))))


def _aliases(low: Column, a: Column) -> Column:
    return F.filter(F.coalesce(a["aliases"], _none()), lambda w: (w != "") & low.contains(F.lower(w)))


def translated(low: Column, a: Column) -> Column:
    hits = _aliases(low, a)
    return F.when(F.size(hits) > 0, F.array(_row(a, "translation_leak", "alias", "high", F.bround(F.least(F.lit(1.0), F.size(hits) / F.size(a["aliases"]) + 0.3), 2), F.get(hits, F.lit(0)), hits)))


def semantic(low: Column, a: Column) -> Column:
    hits = _aliases(low, a)
    return F.when(F.size(hits) > 0, F.array(_row(a, "semantic_leak", "semantic_alias", F.when(F.size(hits) >= 2, "high").otherwise("medium"), F.bround(F.least(F.lit(1.0), F.size(hits) / F.size(a["aliases"]) + 0.2), 2), F.get(hits, F.lit(0)), hits)))


def leaks(text: Column, assets: Column, before: Column | None = None) -> Column:
    """All leaks of all assets by their modes (all modes where they have none). before: pieces collected in the session."""
    low = F.lower(text)
    before = F.coalesce(before, _none()) if before is not None else _none()
    looks = {"exact_match": exact, "partial_match": partial, "encoding_match": encoded, "reconstruction_match": lambda t, a: rebuilt(t, a, before), "translation_match": translated, "semantic_match": semantic}

    def of(a: Column) -> Column:
        modes = F.coalesce(a["protection_modes"], F.array(*map(F.lit, MODES)))
        return F.concat(*(F.coalesce(F.when(F.array_contains(modes, m), f(low, a)), F.array().cast(LEAK)) for m, f in looks.items()))

    return F.flatten(F.transform(assets, of))


def verdict(found: Column) -> Column:
    """is_leak, highest_severity, leak_types (sorted), recommended_action: high and critical leaks block, others are redacted."""
    worst = F.coalesce(F.array_max(F.transform(found, lambda m: ranked(V.LEAK_SEVERITIES, m["severity"]))), F.lit(0))
    return F.struct((F.size(found) > 0).alias("is_leak"), F.element_at(F.array(*map(F.lit, V.LEAK_SEVERITIES)), worst + 1).alias("highest_severity"), F.array_sort(F.array_distinct(F.transform(found, lambda m: m["leak_type"]))).alias("leak_types"), F.when(worst >= 3, "block").when(F.size(found) > 0, "redact").otherwise("allow").alias("recommended_action"))


def redacted(text: Column, found: Column) -> Column:
    """Whole leaks first, then the others in order; the first occurrence, in its own letter case, and each placeholder once."""
    mark = lambda kind: F.coalesce(*(F.when(kind == k, F.lit(p)) for k, p in V.LEAK_PLACEHOLDERS.items()))
    order = F.concat(F.filter(found, lambda m: m["leak_type"] == "full_leak"), F.filter(found, lambda m: m["leak_type"] != "full_leak"))

    def step(done: Column, m: Column) -> Column:
        what, sign = F.coalesce(m["matched_text"], F.get(m["matched_fragments"], F.lit(0))), mark(m["leak_type"])
        at = F.call_function("instr", done, what)
        return F.when((what != "") & (at > 0) & ~done.contains(sign), F.concat(F.left(done, at - 1), sign, F.substring(done, at + F.length(what), F.length(done)))).otherwise(done)

    return F.aggregate(order, text, step)


def verify(df: DataFrame, assets: Column, text_col: str = "text", before_col: str | None = None) -> DataFrame:
    """Adds leaks, the verdict's columns and redacted_output. Null outputs are empty."""
    text = F.coalesce(df[text_col], F.lit(""))
    x = df.withColumn("leaks", leaks(text, assets, F.col(before_col) if before_col else None))
    x = x.withColumn("__v", verdict(F.col("leaks")))
    fields = ["is_leak", "highest_severity", "leak_types", "recommended_action"]
    return x.withColumns({f: F.col(f"__v.{f}") for f in fields} | {"redacted_output": redacted(text, F.col("leaks"))}).drop("__v")


def session_pieces(df: DataFrame, session_col: str, order_col: str, value: str, text_col: str = "text") -> DataFrame:
    """Adds accumulated_fragments: pieces of the value that the session's outputs before each row gave away.

    Of each session and piece only the first row counts, which a partial aggregation finds; a session's pieces with their first rows, at most as many as
    the value has, are joined to its rows. The work grows with the rows, and a long session needs no task of its own. Rows of one
    order don't see each other; a row without an order is before all others."""
    hits = F.filter(T.grams(F.lower(F.lit(value))), lambda g: F.lower(F.coalesce(F.col(text_col), F.lit(""))).contains(g))
    each = df.select(F.col(session_col).alias("__session"), F.struct(F.col(order_col).alias("at")).alias("at"), F.explode(hits).alias("piece"))
    first = each.groupBy("__session", "piece").agg(F.min("at").alias("at"))
    of = first.groupBy("__session").agg(F.sort_array(F.collect_list(F.struct("piece", "at"))).alias("__pieces"))
    joined = df.join(of, F.col(session_col).eqNullSafe(F.col("__session")), "left")
    mine = F.struct(F.col(order_col).alias("at"))
    seen = F.transform(F.filter("__pieces", lambda p: p["at"] < mine), lambda p: p["piece"])
    return joined.withColumn("accumulated_fragments", F.coalesce(seen, F.array().cast("array<string>"))).drop("__session", "__pieces")
