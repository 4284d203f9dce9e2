"""Attack classification by rules: which match, how much they weigh, and which category leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions.rules import keyword, listed, lookup, matches
from veilspark.functions.text import is_blank

HIT = "struct<category:string,kind:string,fragment:string,weight:decimal(10,4),ord:int>"


def rule_hits(text: Column, rules=V.ATTACK_RULES) -> Column:
    """Array of hits on the lower-cased text, in the order of rules: whole keywords at a share of the weight, phrases and patterns at all of it."""
    low = F.lower(text)
    items, n = [], 0
    for category, keywords, phrases, patterns, weight, _ in rules:
        for kind, words, test, w in (
            ("keyword", keywords, keyword, weight * V.KEYWORD_SHARE),
            ("phrase", phrases, lambda t, p: t.contains(p), weight),
            ("regex", patterns, matches, weight),
        ):
            for word in words:
                fields = (F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.lit(word).alias("fragment"), F.lit(round(w, 4)).cast("decimal(10,4)").alias("weight"), F.lit(n).alias("ord"))
                items.append(F.when(test(low, word.lower() if kind != "regex" else word), F.struct(*fields)))
                n += 1
    return listed(items, f"array<{HIT}>")


def session_hit(turn_count: Column, previous: Column) -> Column:
    """The hit of repeated probing: from the second turn on, with two or more probing categories before."""
    probes = F.size(F.filter(F.coalesce(previous, F.array().cast("array<string>")), lambda c: c.isin(V.SESSION_PROBES)))
    category, weight, reason = V.SESSION_RULE
    hit = F.struct(F.lit(category).alias("category"), F.lit("session").alias("kind"), F.lit(reason).alias("fragment"), F.lit(weight).cast("decimal(10,4)").alias("weight"), F.lit(100_000).alias("ord"))
    return F.when((turn_count >= 2) & (probes >= 2), F.array(hit)).otherwise(F.array().cast(f"array<{HIT}>"))


def category_scores(hits: Column, attacks: dict = V.ATTACKS) -> Column:
    """(category, score, ord, strong) by first appearance; scores add up in exact decimals, at most 1."""
    base = lambda c: lookup({k: v[0] for k, v in attacks.items()}, c, 0.5).cast("decimal(10,4)")
    cats = F.array_distinct(F.transform(hits, lambda h: h["category"]))
    own = lambda c: F.filter(hits, lambda h: h["category"] == c)
    total = lambda c: F.aggregate(own(c), F.lit(0).cast("decimal(10,4)"), lambda a, h: (a + h["weight"]).cast("decimal(10,4)"))
    return F.transform(cats, lambda c, i: F.struct(c.alias("category"), F.least(F.lit(1).cast("decimal(10,4)"), (base(c) + total(c)).cast("decimal(10,4)")).alias("score"), i.alias("ord"), F.exists(own(c), lambda h: h["kind"] != "session").alias("strong")))


def primary(scores: Column) -> Column:
    """Largest score; of equal ones the first whose rules hold phrases or patterns, else the first."""
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    top = F.filter(scores, lambda s: s["score"] == best)
    strong = F.filter(top, lambda s: s["strong"])
    return F.coalesce(F.get(strong, F.lit(0)), F.get(top, F.lit(0)))


def classify(df: DataFrame, text_col: str = "text", normal_col: str | None = None, turn_col: str | None = None, previous_col: str | None = None, rules=V.ATTACK_RULES, attacks: dict = V.ATTACKS) -> DataFrame:
    """Adds is_attack, primary_category, matched_categories (sorted), confidence, severity_hint, evidence (sorted), recommended_skill.
    Blank and null prompts are benign."""
    text = F.coalesce(F.col(normal_col), F.col(text_col)) if normal_col else F.col(text_col)
    text = F.coalesce(text, F.lit(""))
    hits = rule_hits(text, rules)
    if turn_col and previous_col:
        hits = F.concat(hits, session_hit(F.col(turn_col), F.col(previous_col)))
    x = df.withColumn("rule_hits", F.when(is_blank(F.col(text_col)), F.array().cast(f"array<{HIT}>")).otherwise(hits))
    x = x.withColumn("category_scores", category_scores(F.col("rule_hits"), attacks))
    x = x.withColumn("__lead", primary(F.col("category_scores")))
    return x.withColumns({
        "is_attack": F.size("rule_hits") > 0,
        "primary_category": F.coalesce("__lead.category", F.lit("benign")),
        "matched_categories": F.array_sort(F.transform("category_scores", lambda s: s["category"])),
        "confidence": F.coalesce(F.bround(F.col("__lead.score"), 2).cast("double"), F.lit(0.0)),
        "severity_hint": lookup({k: v[1] for k, v in attacks.items()}, F.col("__lead.category"), "low"),
        "evidence": F.array_sort(F.array_distinct(F.transform("rule_hits", lambda h: h["fragment"]))),
        "recommended_skill": lookup({k: v[2] for k, v in attacks.items() if v[2]}, F.col("__lead.category")),
    }).drop("__lead")


def previous_probes(df: DataFrame, session_col: str, order_col: str, category_col: str = "primary_category") -> DataFrame:
    """Adds turn_count and previous_categories of the same session before each row."""
    before = Window.partitionBy(session_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"turn_count": F.count(F.lit(1)).over(before), "probes_before": F.coalesce(F.sum(F.when(F.col(category_col).isin(V.SESSION_PROBES), 1).otherwise(0)).over(before), F.lit(0))})


# ---- the older classifier -----------------------------------------------------------------------------


def legacy_hits(text: Column, attacks: dict = V.LEGACY_ATTACKS) -> Column:
    """(category, matched_pattern, confidence, risk_level): one hit per category, its first pattern."""
    low = F.lower(F.coalesce(text, F.lit("")))
    items = []
    for category, (patterns, confidence, risk) in attacks.items():
        first = F.coalesce(*(F.when(low.contains(p.lower()), F.lit(p)) for p in patterns))
        items.append(F.when(first.isNotNull(), F.struct(F.lit(category).alias("category"), first.alias("matched_pattern"), F.lit(confidence).alias("confidence"), F.lit(risk).alias("risk_level"))))
    return listed(items, "array<struct<category:string,matched_pattern:string,confidence:double,risk_level:string>>")


def legacy_summary(hits: Column) -> Column:
    """max_risk, category_count, categories (sorted)."""
    risk = lambda r: F.exists(hits, lambda h: h["risk_level"] == r)
    names = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["category"])))
    return F.struct(F.when(risk("high"), "high").when(risk("medium"), "medium").otherwise("low").alias("max_risk"), F.size(names).alias("category_count"), names.alias("categories"))


def legacy_with_history(df: DataFrame, session_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """(session, order, category, matched_pattern): hits of a turn and of all turns before it, one per category: that of the turn itself, else the earliest."""
    own = df.select(session_col, F.col(order_col).alias("__at"), F.explode(legacy_hits(F.col(text_col))).alias("h")).select(session_col, "__at", "h.*")
    first = own.groupBy(session_col, "category").agg(F.min_by("matched_pattern", "__at").alias("earliest"), F.min("__at").alias("since"))
    turns = df.select(session_col, F.col(order_col).alias(order_col))
    seen = turns.join(first, session_col).filter(F.col("since") <= F.col(order_col))
    now = own.select(session_col, F.col("__at").alias(order_col), "category", F.col("matched_pattern").alias("current"))
    return seen.join(now, [session_col, order_col, "category"], "left").select(session_col, order_col, "category", F.coalesce("current", "earliest").alias("matched_pattern"))


def taxonomy(spark, attacks: dict = V.LEGACY_ATTACKS) -> DataFrame:
    """(category, patterns, confidence, risk_level) as a small table."""
    return spark.createDataFrame([(k, p, c, r) for k, (p, c, r) in attacks.items()], "category string, patterns array<string>, confidence double, risk_level string")


def by_risk_level(table: DataFrame, level: str) -> DataFrame:
    return table.filter(F.col("risk_level") == level)


def get(df: DataFrame, table: DataFrame, category_col: str = "category") -> DataFrame:
    """df with what the taxonomy says about each row's category; rows of categories that it doesn't have drop out. The taxonomy is as small
    as it ships."""
    return df.join(F.broadcast(table.withColumnRenamed("category", category_col)), category_col)


def categories(table: DataFrame) -> DataFrame:
    return table.select("category")


def taxonomy_by_pattern(df: DataFrame, text_col: str = "text", attacks: dict = V.LEGACY_ATTACKS) -> Column:
    return F.transform(legacy_hits(df[text_col], attacks), lambda h: h["category"])


def mitigation_table(spark, mitigations: dict = V.MITIGATIONS) -> DataFrame:
    """(category, mitigation): a comma-separated list for each attack."""
    return spark.createDataFrame(list(mitigations.items()), "category string, mitigation string")


def mitigations(column: Column) -> Column:
    """Parts of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda m: F.trim(m)), lambda m: m != "")
