"""Defensive skills: predicates, defences, the executor's and the router's merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions.rules import any_contained, first_contained, listed, lookup, ranked, strings
from veilspark.operators.policy import no_strings

DETECTION = "array<struct<skill:string,ord:int,pattern:string,risk:string,action:string>>"


def detects(skill: str, text: Column) -> Column:
    """Does the skill's pattern list hit the text? (Those that look at history have functions of their own.)"""
    low = F.lower(text)
    if skill == "homoglyph_obfuscation":
        return any_contained(low, V.OLD_SKILLS[skill][0]) | any_contained(text, V.HIDDEN_CHARACTERS)
    return any_contained(low, V.SKILLS[skill][2] if skill in V.SKILLS else V.OLD_SKILLS[skill][0])


def pattern(skill: str, text: Column) -> Column:
    """The pattern that hit, in the order of the list."""
    low = F.lower(text)
    if skill == "homoglyph_obfuscation":
        return F.when(any_contained(text, V.HIDDEN_CHARACTERS), "homoglyph_char").when(detects(skill, text), "keyword")
    return first_contained(low, V.SKILLS[skill][2] if skill in V.SKILLS else V.OLD_SKILLS[skill][0])


def skill_names() -> list[str]:
    return [*V.SKILLS, *(s for s in V.OLD_SKILLS if s not in V.SKILLS)]


def all_detections(text: Column, names: list[str] | None = None) -> Column:
    """(skill, ord, pattern, risk, action) of all skills that hit."""
    items = []
    for i, s in enumerate(names or skill_names()):
        risk, action = ("high", V.SKILLS[s][3]) if s in V.SKILLS else (V.OLD_SKILLS[s][1], V.RISK_ACTIONS[V.OLD_SKILLS[s][1]])
        fields = (F.lit(s).alias("skill"), F.lit(i).alias("ord"), pattern(s, text).alias("pattern"), F.lit(risk).alias("risk"), F.lit(action).alias("action"))
        items.append(F.when(detects(s, text), F.struct(*fields)))
    return listed(items, DETECTION)


# ---- skills with history --------------------------------------------------------------------------------


def multi_turn_probe(df: DataFrame, session_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """Adds probes (up to this turn) and multi_turn_probe (three or more)."""
    probe = F.when(detects("multi_turn_probe", F.coalesce(df[text_col], F.lit(""))), 1).otherwise(0)
    w = Window.partitionBy(session_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("probes", F.sum(probe).over(w))
    return x.withColumn("multi_turn_probe", F.col("probes") >= 3)


def partial_accumulation(df: DataFrame, session_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """Adds partial_asks (turns before that ask for pieces) and data_reconstruction (a pattern now, or four asks before)."""
    text = F.coalesce(df[text_col], F.lit(""))
    ask = F.when(any_contained(F.lower(text), V.PARTIAL_ASKS), 1).otherwise(0)
    w = Window.partitionBy(session_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("partial_asks", F.coalesce(F.sum(ask).over(w), F.lit(0)))
    return x.withColumn("data_reconstruction", detects("data_reconstruction", text) | (F.col("partial_asks") >= 4))


# ---- defences ---------------------------------------------------------------------------------------------


def defended(skill: str, text: Column) -> Column:
    """Older contract: the text that stands for the prompt; unchanged without a hit."""
    _, _, how, note = V.OLD_SKILLS[skill]
    new = F.lit(f"[{V.BRAND}]\n{note}") if how == "replace" else F.concat(text, F.lit(f"\n\n[{V.BRAND} 提醒：{note}]"))
    return F.when(detects(skill, text), new).otherwise(text)


def defence(skill: str, text: Column) -> Column:
    """Newer contract: action, safe_prompt, response_message, restrictions, runtime_checks, evidence; null without a hit."""
    name, category, _, action, safe, message, restrictions, checks = V.SKILLS[skill]
    why = F.concat(F.lit("Matched pattern: "), pattern(skill, text))
    return F.when(detects(skill, text), F.struct(
        F.lit(action).alias("action"), F.lit(safe).alias("safe_prompt"), F.lit(message).alias("response_message"), strings(restrictions).alias("restrictions"), strings([category]).alias("risk_tags"), strings(checks).alias("runtime_checks"), F.lit(name).alias("skill_name"), why.alias("reason"),
    ))


def strongest(actions: Column, order: list[str]) -> Column:
    """The action of the highest place in the order; of an empty list the lowest."""
    top = F.array_max(F.transform(actions, lambda a: ranked(order, a)))
    return F.element_at(strings(order), F.coalesce(top, F.lit(0)) + 1)


def execute(df: DataFrame, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """Adds the executor's fold over the newer skills in order: strongest action, last text and message, distinct restrictions, tags and checks, evidence."""
    text = F.coalesce(df[text_col], F.lit(""))
    hits = F.array_compact(F.array(*(defence(s, text) for s in names or V.SKILLS if s != "multi_turn_probe")))
    x = df.withColumn("__hits", hits)
    join = lambda f: F.array_distinct(F.flatten(F.transform("__hits", lambda h: h[f])))
    last = lambda f: F.when(F.size("__hits") > 0, F.element_at("__hits", -1)[f])
    return x.withColumns({
        "action": strongest(F.transform("__hits", lambda h: h["action"]), V.SKILL_ORDER),
        "safe_prompt": last("safe_prompt"),
        "response_message": last("response_message"),
        "restrictions": join("restrictions"),
        "risk_tags": join("risk_tags"),
        "runtime_checks": join("runtime_checks"),
        "evidence": F.transform("__hits", lambda h: F.struct(h["skill_name"].alias("skill_name"), h["action"].alias("action"), h["reason"].alias("reason"))),
    }).drop("__hits")


# ---- registry and routing ---------------------------------------------------------------------------------


class SkillRegistry:
    """Skills by category with priorities; a table of a few rows on the driver. Patterns are substrings of the lower-cased text."""

    def __init__(self):
        self.rows: dict[str, dict] = {}
        self.categories: dict[str, list[str]] = {}

    def register(self, category: str, name: str, patterns: list[str], risk: str = "low", priority: int | None = None, action: str | None = None, rewrite: str | None = None, constraints: list[str] | None = None) -> None:
        """The larger of an old and a new priority holds. action: that of the risk if none is given; rewrite: the prompt that stands
        for one that hits; constraints: what a hit adds."""
        p = V.SKILL_PRIORITIES.get(name, 50) if priority is None else priority
        old = self.rows.get(name, {}).get("priority", 0)
        self.rows[name] = {"patterns": patterns, "risk": risk, "priority": max(old, p), "action": action or V.RISK_ACTIONS[risk], "rewrite": rewrite, "constraints": constraints or []}
        if name not in self.categories.setdefault(category, []):
            self.categories[category].append(name)

    def get(self, category: str) -> list[str]:
        return [n for n in self.categories.get(category, []) if n in self.rows]

    def has(self, category: str) -> bool:
        return category in self.categories

    def list_categories(self) -> list[str]:
        return list(self.categories)

    def get_priority(self, name: str) -> int:
        return self.rows.get(name, {}).get("priority", 50)

    def set_priority(self, name: str, priority: int) -> None:
        self.rows.setdefault(name, {"patterns": [], "risk": "low"})["priority"] = priority

    def to_frame(self, spark) -> DataFrame:
        rows = [(c, n, self.rows[n]["risk"], self.rows[n]["priority"], self.rows[n]["patterns"]) for c, ns in self.categories.items() for n in ns]
        return spark.createDataFrame(rows, "category string, skill string, risk string, priority int, patterns array<string>")


def select_skills(categories: Column, routes: dict = V.ROUTES, own: SkillRegistry | None = None) -> Column:
    """Skills of all categories' routes, each once: primaries and secondaries in order, sorted by priority (stable, a later route's priority holds).
    A category without a route has the skills that are registered for it."""
    rows = lambda p, ss, n: [F.struct(F.lit(s).alias("skill"), F.lit(n - 5 * (i > 0)).alias("priority")) for i, s in enumerate([p, *ss])]
    none = F.array().cast("array<struct<skill:string,priority:int>>")
    known = {k: rows(p, ss, n) for k, (p, ss, n, _) in routes.items()}
    for k in own.list_categories() if own else ():
        known.setdefault(k, [F.struct(F.lit(s).alias("skill"), F.lit(own.get_priority(s)).alias("priority")) for s in own.get(k)])
    picked = F.flatten(F.transform(categories, lambda c: F.coalesce(*(F.when(c == k, F.array(*r)) for k, r in known.items() if r), none)))
    last = lambda s: F.element_at(F.filter(picked, lambda p: p["skill"] == s), -1)["priority"]
    ordered = F.transform(F.array_distinct(F.transform(picked, lambda p: p["skill"])), lambda s, i: F.struct((-last(s)).alias("p"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(ordered), lambda r: r["s"])


def _own_detections(own: SkillRegistry, text: Column) -> Column:
    """(skill, ord, pattern, risk, action) of the registered skills that hit."""
    low, items = F.lower(text), []
    for i, (s, r) in enumerate(own.rows.items()):
        if r["patterns"]:
            fields = (F.lit(s).alias("skill"), F.lit(i).alias("ord"), first_contained(low, r["patterns"]).alias("pattern"), F.lit(r["risk"]).alias("risk"), F.lit(r["action"]).alias("action"))
            items.append(F.when(any_contained(low, r["patterns"]), F.struct(*fields)))
    return listed(items, DETECTION)


def route(df: DataFrame, text_col: str = "text", categories_col: str = "attack_categories", action_col: str = "policy_action", routes: dict = V.ROUTES, own: SkillRegistry | None = None) -> DataFrame:
    """Adds selected_skills, executed_skills, skill_results, recommended_action, rewritten_prompt (the first that a skill gives), added_constraints
    (those of all skills that hit, each once; null without any), blocked, runtime_monitor_level, reasons.
    own: registered skills; they stand in for shipped ones of the same name."""
    text = F.coalesce(df[text_col], F.lit(""))
    mine = {s: r for s, r in own.rows.items() if "action" in r} if own else {}
    found = all_detections(text, [s for s in skill_names() if s not in mine])
    found = F.concat(_own_detections(own, text), found) if mine else found
    x = df.withColumn("selected_skills", select_skills(F.coalesce(F.col(categories_col), no_strings()), routes, own)).withColumn("__found", found)
    one = lambda s: F.get(F.filter("__found", lambda f: f["skill"] == s), F.lit(0))
    known = strings([*mine, *(s for s in skill_names() if s not in mine)])
    rewrites = {s: r["rewrite"] for s, r in mine.items() if r["rewrite"]}
    added = {s: r["constraints"] for s, r in mine.items() if r["constraints"]}
    rewritten = F.filter(F.transform("skill_results", lambda r: F.when(r["detected"], lookup(rewrites, r["skill"], None))), lambda p: p.isNotNull()) if rewrites else no_strings()
    of_skill = lambda r: F.coalesce(*(F.when(r["detected"] & (r["skill"] == s), strings(c)) for s, c in added.items()), no_strings())
    constraints = F.array_distinct(F.flatten(F.transform("skill_results", of_skill))) if added else no_strings()
    result = lambda s: F.struct(
        s.alias("skill"),
        one(s).isNotNull().alias("detected"),
        F.coalesce(one(s)["action"], F.lit("WARN")).alias("action"),
        F.when(one(s).isNotNull(), F.concat(F.lit("Defended by "), s)).otherwise(F.concat(F.lit("Detected by "), s, F.lit(": unknown"))).alias("reason"),
    )
    x = x.withColumn("executed_skills", F.filter("selected_skills", lambda s: F.array_contains(known, s)))
    x = x.withColumn("skill_results", F.transform("executed_skills", result))
    actions = F.transform("skill_results", lambda r: r["action"])
    level = lambda a: F.when(a == "BLOCK", 2).when(a.isin("AUTHORIZE", "ESCALATE"), 1).otherwise(0)
    most = F.greatest(level(F.col(action_col)), F.coalesce(F.array_max(F.transform(actions, level)), F.lit(0)))
    answered = [c for c, (p, *_) in routes.items() if not p or p in mine or p in skill_names()] + [c for c in (own.list_categories() if own else ()) if c not in routes]
    unknown = F.filter(F.coalesce(F.col(categories_col), no_strings()), lambda c: ~c.isin(answered))
    return x.withColumns({
        "recommended_action": strongest(F.concat(F.array(F.col(action_col)), actions), V.ROUTER_ORDER),
        "rewritten_prompt": F.get(rewritten, F.lit(0)),
        "added_constraints": F.when(F.size(constraints) > 0, constraints),
        "blocked": (F.col(action_col) == "BLOCK") | F.exists("skill_results", lambda r: r["action"] == "BLOCK"),
        "runtime_monitor_level": F.element_at(strings(["normal", "elevated", "strict"]), most + 1),
        "reasons": F.concat(F.transform("skill_results", lambda r: r["reason"]), F.transform(unknown, lambda c: F.concat(F.lit("Unknown attack category: "), c))),
    }).drop("__found")


def checked_action(action: Column) -> Column:
    """The action, or an error if it isn't one."""
    return F.when(action.isin(V.ACTIONS), action).otherwise(F.raise_error(F.concat(F.lit("Invalid policy_action: "), F.coalesce(action, F.lit("null")))))


def required_skill(category: Column) -> Column:
    return lookup(V.REQUIRED_SKILLS, category)
