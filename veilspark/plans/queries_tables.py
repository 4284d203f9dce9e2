"""Queries on registries, documents, files and runs that are made of the given tables, so that their work grows with them."""

from __future__ import annotations

import json

from pyspark import cloudpickle
from pyspark.sql import functions as F

from veilspark import cli
from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.operators import assets as A
from veilspark.operators import classification as C
from veilspark.operators import detectors as DT
from veilspark.operators import events as E
from veilspark.operators import tokens as TK
from veilspark.plans import registry
from veilspark.plans.benchmarks import SUITES, Evaluator, summarise
from veilspark.plans.queries_outputs import csv, folder, json_file
from veilspark.plans.queries_prompts import CLASSIFIED, LEGACY_HITS, LEGACY_SQL, classified
from veilspark.plans.registry import PROMPTS, prompts, query, quoted, rows, table
from veilspark.sources import documents as D
from veilspark.sources import models as M
from veilspark.sources.registry_store import RegistryStore

# ---- a registry of parts ------------------------------------------------------------------------------------------


def part_assets(spark, d):
    """An asset for each part: its value has blanks, brackets and signs, its risk, modes and source follow its size."""
    by = lambda values: F.element_at(F.array(*values), (F.col("p_size") % len(values) + 1).cast("int"))
    modes = lambda *m: F.array(*map(F.lit, m))
    return table(spark, d, "part").select(
        F.concat(F.lit("part:"), "p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.lit("exact").alias("type"), F.concat("p_name", F.lit("_"), "p_brand", F.lit("{"), "p_partkey", F.lit("}")).alias("value"),
        F.array("p_brand", F.concat_ws(" ", "p_type", "p_name")).alias("aliases"), by([F.lit(r) for r in V.RISK_LEVELS]).alias("risk_level"), modes("owner").alias("allowed_roles"),
        by([modes("exact_match", "alias_match"), modes("exact_match"), modes("alias_match", "partial_match")]).alias("protection_modes"),
        (F.col("p_size") % 5 != 0).alias("enabled"), F.col("p_type").alias("description"), F.when(F.col("p_size") <= 25, "system").otherwise("user").alias("source"),
    )


RISK_SQL = f"CASE p_size % 4 {' '.join(f'WHEN {i} THEN {quoted(r)}' for i, r in enumerate(V.RISK_LEVELS))} END"
PARTS_SQL = f"""pa AS (SELECT 'part:' || p_partkey AS asset_id, p_name AS name, p_name || '_' || p_brand || '{{' || p_partkey || '}}' AS value, [p_brand, p_type || ' ' || p_name] AS aliases, {RISK_SQL} AS risk_level,
  CASE p_size % 3 WHEN 0 THEN ['exact_match', 'alias_match'] WHEN 1 THEN ['exact_match'] ELSE ['alias_match', 'partial_match'] END AS modes, p_size % 5 <> 0 AS enabled, p_type AS description, CASE WHEN p_size <= 25 THEN 'system' ELSE 'user' END AS source, p_brand FROM part)"""


# ---- small functions ------------------------------------------------------------------------------------------------


def scalar(name, f, sql):
    query(name, f"WITH {PARTS_SQL} SELECT asset_id, {sql} AS out FROM pa")(lambda spark, d: part_assets(spark, d).select("asset_id", f(F.col("value")).alias("out")))


CUT_SQL = "list_transform(regexp_split_to_array(value, {}), lambda x: trim(x))"
GRAMS_SQL = "list_transform(range(1, length(value) - 2), lambda i: substr(value, i, 4))"
scalar("FN1", lambda v: F.concat_ws(",", T.to_base64(v), T.to_hex(v)), "base64(encode(value)) || ',' || lower(hex(value))")
scalar("FN2", T.rot13, f"translate(value, '{T.ROT_FROM}', '{T.ROT_TO}')")
scalar("FN3", T.percent_code, "replace(replace(replace(replace(value, ' ', '%20'), '#', '%23'), '{', '%7B'), '}', '%7D')")
scalar("FN4", T.unicode_code, "array_to_string(list_transform(string_split(value, ''), lambda x: '\\u' || lpad(lower(hex(x)), 4, '0')), '')")
scalar("FN5", lambda v: csv(F.array_sort(T.grams(v))), f"array_to_string(list_sort(list_distinct({GRAMS_SQL})), ',')")
scalar("FN6", lambda v: csv(F.array_sort(T.parts(v))), f"array_to_string(list_sort(list_distinct(list_filter(list_concat({CUT_SQL.format(quoted('[{}()\\[\\]]+'))}, {CUT_SQL.format(quoted('[{}\\[\\]()_\\-.\\s,;:!?]+'))}), lambda x: length(x) >= 6))), ',')")
scalar("FN7", T.alnum_only, "lower(regexp_replace(value, '[^a-zA-Z0-9]', '', 'g'))")
#: Of the four kinds of pieces: those without punctuation, and those that a monitored stream is watched for.
scalar("FN5_plain", lambda v: csv(F.array_sort(T.plain_grams(v))), f"array_to_string(list_sort(list_distinct(list_filter({GRAMS_SQL}, lambda g: NOT regexp_matches(g, '[{{}}_\\- .,!?:;]')))), ',')")
scalar("FN5_stream", lambda v: csv(F.array_sort(T.stream_fragments(v))), "array_to_string(list_sort(list_distinct(list_concat(list_transform(range(1, length(value) - 6), lambda i: substr(lower(value), i, 8)), list_filter(list_transform(range(1, length(value) - 5), lambda i: substr(lower(value), i, 7)), lambda g: regexp_matches(g, '[^a-z0-9]'))))), ',')")


@query("FN8", f"WITH {PARTS_SQL} SELECT asset_id, value AS token, 'exact' AS token_type FROM pa WHERE list_contains(modes, 'exact_match') UNION ALL SELECT asset_id, unnest(aliases), 'alias' FROM pa WHERE list_contains(modes, 'alias_match')")
def fn8(spark, d):
    return TK.expand(part_assets(spark, d)).filter(F.col("token_type").isin("exact", "alias")).select("asset_id", "token", "token_type")


PARTS_LIST = f"list_distinct(list_filter(list_concat({CUT_SQL.format(quoted('[{}()\\[\\]]+'))}, {CUT_SQL.format(quoted('[{}\\[\\]()_\\-.\\s,;:!?]+'))}), lambda x: length(x) >= 6))"
URL_SQL = "replace(replace(replace(replace(value, ' ', '%20'), '#', '%23'), '{', '%7B'), '}', '%7D')"
UNICODE_SQL = "array_to_string(list_transform(string_split(value, ''), lambda x: '\\u' || lpad(lower(hex(x)), 4, '0')), '')"


@query("FN8_all", f"""WITH {PARTS_SQL} SELECT asset_id, value AS token, 'exact' AS token_type, 'asset_value' AS source FROM pa UNION ALL SELECT asset_id, unnest({PARTS_LIST}), 'partial', 'generated_variant' FROM pa UNION ALL SELECT asset_id, unnest(aliases), 'alias', 'alias' FROM pa
UNION ALL SELECT asset_id, unnest([base64(encode(value)), lower(hex(value)), {URL_SQL}, {UNICODE_SQL}]), 'encoded', 'generated_variant' FROM pa UNION ALL SELECT asset_id, lower(regexp_replace(value, '[^a-zA-Z0-9]', '', 'g')), 'normalized', 'generated_variant' FROM pa""")
def fn8_all(spark, d):
    """Tokens of every kind, of assets that have all modes."""
    every = F.array(*map(F.lit, ("exact_match", "partial_match", "alias_match", "encoding_match", "normalization_match")))
    return TK.expand(part_assets(spark, d).withColumn("protection_modes", every)).select("asset_id", "token", "token_type", "source")


@query("JOIN13", f"WITH {PARTS_SQL} SELECT asset_id, CASE WHEN list_contains(modes, 'exact_match') THEN value ELSE '' END AS exact, CASE WHEN list_contains(modes, 'alias_match') THEN array_to_string(aliases, ',') ELSE '' END AS aliases FROM pa")
def join13(spark, d):
    return TK.export(TK.expand(part_assets(spark, d))).select("asset_id", csv("exact").alias("exact"), csv("aliases").alias("aliases"))


# ---- assets -----------------------------------------------------------------------------------------------------------


@query("PRD12", f"WITH {PARTS_SQL} SELECT asset_id FROM pa WHERE enabled AND (contains(lower(value), 'ring') OR contains(lower(name), 'ring') OR len(list_filter(aliases, lambda w: contains(lower(w), 'ring'))) > 0)")
def prd12(spark, d):
    return A.find(part_assets(spark, d), " RING ").select("asset_id")


def broken(spark, d):
    """The parts' assets with faults that follow their risk."""
    risk, off = F.col("risk_level"), ~F.col("enabled")
    return part_assets(spark, d).withColumns({
        "value": F.when((risk == "low") & off, None).when((risk == "high") & off, "  ").otherwise(F.col("value")),
        "protection_modes": F.when((risk == "critical") & off, F.array(F.lit("none"))).otherwise(F.col("protection_modes")),
        "risk_level": F.when(risk == "medium", "huge").otherwise(risk),
    })


LISTED = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
FAULT_SQL = f"""CASE WHEN risk_level = 'low' AND NOT enabled THEN 'Missing required field: value' WHEN risk_level = 'medium' THEN {quoted(f"risk_level must be one of {LISTED(V.RISK_LEVELS)}, got 'huge'")}
  WHEN risk_level = 'critical' AND NOT enabled THEN {quoted(f"Invalid protection_mode 'none', valid: {LISTED(V.PROTECTION_MODES)}")} WHEN risk_level = 'high' AND NOT enabled THEN 'value must be a non-empty string' END"""


@query("PRD14", f"WITH {PARTS_SQL} SELECT asset_id, {FAULT_SQL} AS fault FROM pa")
def prd14(spark, d):
    x = broken(spark, d)
    return x.select("asset_id", A.validation(x).alias("fault"))


def store(spark, d):
    """A versioned registry whose first version holds the shipped parts."""
    out = RegistryStore(spark, folder(spark, "store"))
    out.publish(part_assets(spark, d).filter("source = 'system'"), 0)
    return out


@query("DML1", f"WITH {PARTS_SQL} SELECT asset_id, source FROM pa WHERE source = 'system' OR {FAULT_SQL} IS NULL")
def dml1(spark, d):
    """All assets are added to the shipped ones: those that are there already and those with faults don't get in."""
    held = store(spark, d)
    held.change(lambda r: A.add(r, broken(spark, d))[0])
    return held.read().select("asset_id", "source")


@query("DML1_messages", f"WITH {PARTS_SQL} SELECT asset_id, coalesce({FAULT_SQL}, CASE WHEN source = 'system' THEN 'Duplicate asset_id: ' || asset_id END, 'Asset added') AS message FROM pa")
def dml1_messages(spark, d):
    return A.add(store(spark, d).read(), broken(spark, d))[1].select("asset_id", "message")


@query("DML2", f"WITH {PARTS_SQL} SELECT asset_id FROM pa WHERE source = 'system' AND asset_id <> (SELECT min(asset_id) FROM pa WHERE source = 'system')")
def dml2(spark, d):
    held = store(spark, d)
    held.change(lambda r: A.remove(r, r.agg(F.min("asset_id")).first()[0]))
    return held.read().select("asset_id")


@query("DML3", f"WITH {PARTS_SQL} SELECT asset_id, CASE WHEN asset_id = (SELECT min(asset_id) FROM pa WHERE source = 'system') THEN 'none' ELSE risk_level END AS risk_level, value FROM pa WHERE source = 'system'")
def dml3(spark, d):
    held = store(spark, d)
    held.change(lambda r: A.update(r, r.agg(F.min("asset_id")).first()[0], risk_level="none", asset_id="never"))
    return held.read().select("asset_id", "risk_level", "value")


@query("DML_versions", f"WITH {PARTS_SQL}, n AS (SELECT count(*) FILTER (source = 'system') AS s, count(*) AS n FROM pa) SELECT 1 AS version, s AS assets FROM n UNION ALL SELECT 2, n FROM n UNION ALL SELECT 3, n - 1 FROM n")
def dml_versions(spark, d):
    """Three versions: shipped, all, and all but one; the first two stay as they were."""
    held = store(spark, d)
    held.change(lambda r: A.add(r, part_assets(spark, d))[0])
    held.change(lambda r: A.remove(r, r.agg(F.min("asset_id")).first()[0]))
    return held.history()


def merged(spark, d):
    every = part_assets(spark, d)
    return A.merge(every.filter("risk_level <> 'critical'").withColumn("source", F.lit("system")), every.withColumn("source", F.lit("user"))).select("asset_id", "source")


for _n in ("JOIN9", "SET5"):
    query(_n, f"WITH {PARTS_SQL} SELECT asset_id, CASE WHEN risk_level = 'critical' THEN 'user' ELSE 'system' END AS source FROM pa")(merged)


# ---- documents of assets ------------------------------------------------------------------------------------------------


def brand_files(assets, path, bare: bool = False):
    """JSON documents of each brand, of about `D.LOT` assets at most: {assets: [..]}, or a bare list that holds rows that are no objects too."""
    brand = F.element_at("aliases", 1)
    each = D.in_lots(assets.withColumn("brand", brand), "brand").groupBy("brand", "lot").agg(F.collect_list(F.struct(*A.FIELDS)).alias("assets"))
    if bare:
        listed = F.to_json("assets")
        each.select("brand", "lot", F.concat(F.lit('[3, null, "x", [], '), F.substring(listed, F.lit(2), F.length(listed))).alias("value")).write.partitionBy("brand", "lot").text(path)
    else:
        each.write.partitionBy("brand", "lot").json(path)
    return path


def mixed(spark, d):
    """The parts' assets in one document per brand, with a broken one and one of another kind."""
    path = brand_files(part_assets(spark, d), folder(spark, "mixed"))
    D.save_text(spark, '{"assets": [', f"{path}/brand=broken/lot=0/broken.json")
    D.save_text(spark, '{"assets": [{"asset_id": "no", "value": "no"}]}', f"{path}/brand=other/lot=0/other.txt")
    return path


def saved(spark, d):
    path = folder(spark, "assets")
    D.save_registry(part_assets(spark, d), path)
    return path


SAVED_SQL = f"WITH {PARTS_SQL} SELECT asset_id, value, len(aliases) AS n, source FROM pa"


def shown(x):
    return x.select("asset_id", "value", F.size("aliases").alias("n"), "source")


query("SRC1", SAVED_SQL)(lambda spark, d: shown(D.load_assets(spark, brand_files(part_assets(spark, d), folder(spark, "lists"), bare=True), pattern="*.txt")))
query("SRC2", SAVED_SQL)(lambda spark, d: shown(D.load_assets(spark, mixed(spark, d))))
query("SRC3", SAVED_SQL.replace(" source FROM", " CASE WHEN source = 'user' THEN 'loaded' ELSE source END AS source FROM"))(
    lambda spark, d: shown(D.load_assets(spark, brand_files(part_assets(spark, d).withColumn("source", F.when(F.col("source") == "system", "system")), folder(spark, "files")), "loaded"))
)
for _n in ("SRC4", "SNK2"):
    query(_n, SAVED_SQL)(lambda spark, d: shown(D.load_assets(spark, saved(spark, d), pattern="*.txt")))


@query("SRC15", f"WITH {PARTS_SQL} SELECT asset_id, value, source, asset_id = (SELECT min(asset_id) FROM pa) AS asked FROM pa")
def src15(spark, d):
    """Shipped assets and users' ones, of which many have ids that are taken, merged, saved and asked for one."""
    every = part_assets(spark, d)
    users = every.withColumn("value", F.when(F.col("source") == "system", "taken").otherwise(F.col("value")))
    known = D.refresh(spark, brand_files(every.filter("source = 'system'"), folder(spark, "shipped")), brand_files(users, folder(spark, "users")), folder(spark, "registry"))
    one = D.asset(known, every.agg(F.min("asset_id")).first()[0]).select("asset_id", F.lit(True).alias("hit"))
    return known.select("asset_id", "value", "source").join(one, "asset_id", "left").select("asset_id", "value", "source", F.coalesce("hit", F.lit(False)).alias("asked"))


# ---- rules and settings ---------------------------------------------------------------------------------------------------

KINDS_SQL = "k AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)"


def kinds(spark, d) -> dict:
    """How often there is each kind of event; a few kinds, whatever the table's size."""
    return {r.event_type: r.n for r in table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}


@query("SRC5", f"WITH {KINDS_SQL} SELECT event_type AS category, n AS severity FROM k")
def src5(spark, d):
    rules = D.load_rules(spark, json_file(spark, [{"category": k, "severity": n} for k, n in kinds(spark, d).items()]))
    return spark.createDataFrame([(r["category"], r["severity"]) for r in rules], "category string, severity long")


@query("SRC6", f"WITH {KINDS_SQL} SELECT event_type AS category, CASE WHEN n > 100 THEN 'high' ELSE 'low' END AS risk_level, CAST(n AS DOUBLE) AS confidence FROM k")
def src6(spark, d):
    path = json_file(spark, {k: {"confidence": float(n), "risk_level": "high" if n > 100 else "low"} for k, n in kinds(spark, d).items()})
    return D.load_map_table(spark, path, "confidence:double,risk_level:string").select("category", "risk_level", "confidence")


@query("SRC7", f"WITH {KINDS_SQL} SELECT event_type, n AS points, fallback FROM k, (VALUES (true), (false)) AS v(fallback)")
def src7(spark, d):
    """The table's own scores where there is no document, and the same from a document."""
    scores = kinds(spark, d)
    found = [D.load_or_default(spark, p, scores) for p in (folder(spark, "none"), json_file(spark, scores))]
    return spark.createDataFrame([(k, n, fallback) for values, fallback in found for k, n in values.items()], "event_type string, points long, fallback boolean")


@query("SRC8", f"WITH {KINDS_SQL} SELECT event_type AS category, n FROM k")
def src8(spark, d):
    return spark.createDataFrame(list(D.load_map(spark, json_file(spark, kinds(spark, d))).items()), "category string, n long")


@query("SRC10", f"WITH {KINDS_SQL} SELECT arg_max(event_type, (n, event_type)) AS threshold, sum(n)::BIGINT AS buffer, true AS monitoring FROM k")
def src10(spark, d):
    counted = kinds(spark, d)
    c = D.Config(spark, json_file(spark, {"default_threshold": max(counted, key=lambda k: (counted[k], k)), "max_buffer_size": sum(counted.values())}))
    return spark.createDataFrame([(c.get("default_threshold"), c.get("max_buffer_size"), c.get("stream_monitoring"))], "threshold string, buffer long, monitoring boolean")


@query("SRC10_aliases", "SELECT DISTINCT p_type AS canonical, p_brand AS variant FROM part")
def src10_aliases(spark, d):
    """Alias rules: the brands of each type of part, a few dozen."""
    by = table(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("brands")).collect()
    rules = D.load_alias_rules(spark, json_file(spark, {"aliases": {r.p_type: r.brands for r in by}}))
    return spark.createDataFrame([(k, v) for k, vs in rules.items() for v in vs], "canonical string, variant string")


@query("SRC10_roles", "SELECT c_mktsegment AS role, c_nationkey::VARCHAR AS permission FROM customer GROUP BY ALL UNION ALL SELECT 'nobody', NULL")
def src10_roles(spark, d):
    """Role policies: the nations that each segment of customers is in; a role that there is none of has nothing."""
    by = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.collect_set(F.col("c_nationkey").cast("string")).alias("nations")).collect()
    roles = D.RolePolicies(spark, json_file(spark, {"roles": {r.c_mktsegment: {"allowed_roles": ["owner"], "permissions": r.nations} for r in by}}))
    asked = [*sorted(r.c_mktsegment for r in by), "nobody"]
    return spark.createDataFrame([(k, p) for k in asked for p in roles.policy(k, [], {"action": "warn"})["required_permissions"] or [None]], "role string, permission string")


@query("SRC10_policy", f"WITH {KINDS_SQL} SELECT event_type, n FROM k UNION ALL SELECT 'missing', 0")
def src10_policy(spark, d):
    """A policy file, and one that isn't there."""
    held, none = D.load_policy_file(spark, json_file(spark, kinds(spark, d))), D.load_policy_file(spark, folder(spark, "none"))
    return spark.createDataFrame([*held.items(), ("missing", len(none))], "event_type string, n long")


@query("SRC16", f"WITH {KINDS_SQL} SELECT event_type AS category, n AS priority, true AS known FROM k UNION ALL SELECT 'nothing', NULL, false")
def src16(spark, d):
    rules = D.RouteRules(spark, json_file(spark, {k: {"primary_skill": k, "secondary_skills": [], "priority": n} for k, n in kinds(spark, d).items()}))
    asked = [*rules.list_categories(), "nothing"]
    return spark.createDataFrame([(c, rules.get_rule(c).get("priority"), rules.has_rule(c)) for c in asked], "category string, priority long, known boolean")


# ---- taxonomy -----------------------------------------------------------------------------------------------------------


@query("PRD10", f"{PROMPTS}, {LEGACY_SQL}, {LEGACY_HITS}, t AS (SELECT category, count(*) AS n_patterns, min(risk_level) AS risk_level FROM g GROUP BY category) SELECT category, n_patterns, risk_level, (SELECT count(*) FROM lh WHERE lh.category = t.category) AS hits FROM t WHERE risk_level = 'high'")
def prd10(spark, d):
    """The taxonomy's grave attacks, with the prompts in which each was found."""
    hits = prompts(spark, d).select(F.explode(C.legacy_hits(F.col("text"))).alias("h")).groupBy(F.col("h.category").alias("category")).agg(F.count(F.lit(1)).alias("hits"))
    grave = C.by_risk_level(C.taxonomy(spark), "high")
    return grave.join(hits, "category", "left").select("category", F.size("patterns").cast("long").alias("n_patterns"), "risk_level", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


@query("PRD10_get", f"{PROMPTS}, {LEGACY_SQL}, {LEGACY_HITS} SELECT conv_id, turn, lh.category, CAST(t.confidence AS DOUBLE) AS confidence, t.n AS patterns FROM lh JOIN (SELECT category, min(confidence) AS confidence, count(*) AS n FROM g GROUP BY category) AS t ON t.category = lh.category")
def prd10_get(spark, d):
    """What the taxonomy says about each category that a prompt shows."""
    found = prompts(spark, d).select("conv_id", "turn", F.explode(C.legacy_hits(F.col("text"))).alias("h")).select("conv_id", "turn", "h.category")
    return C.get(found, C.taxonomy(spark)).select("conv_id", "turn", "category", "confidence", F.size("patterns").cast("long").alias("patterns"))


MITIGATION_SQL = rows("m", "category, mitigation", [(c, m.strip()) for c, text in V.MITIGATIONS.items() for m in text.split(",")])


@query("PRD10_mitigation", f"{CLASSIFIED}, {MITIGATION_SQL} SELECT conv_id, turn, pr.category, mitigation FROM pr JOIN m ON m.category = pr.category")
def prd10_mitigation(spark, d):
    """Mitigations of the attack that each prompt makes."""
    found = classified(spark, d).filter("is_attack").select("conv_id", "turn", F.col("primary_category").alias("category"))
    return C.get(found, C.mitigation_table(spark)).select("conv_id", "turn", "category", F.explode(C.mitigations(F.col("mitigation"))).alias("mitigation"))


# ---- runs -----------------------------------------------------------------------------------------------------------------


def measured(spark, d):
    """A check per kind of event, which fails where there is an odd number of them, and one per table that the kinds come from."""
    e = Evaluator(spark)
    for kind, n in sorted(kinds(spark, d).items()):
        e.run(kind, lambda n=n: 1 / (1 - n % 2))
    e.run("events", lambda: table(spark, d, "events").select("event_type"))
    return e


RUN_SQL = f"WITH {KINDS_SQL}, r AS (SELECT count(*) + 1 AS total, count(*) FILTER (n % 2 = 0) + 1 AS passed FROM k)"
for _n in ("BEN1", "AGG19"):
    query(_n, f"{RUN_SQL} SELECT total, passed, total - passed AS failed, round_even(passed / total, 3) AS pass_rate FROM r")(lambda spark, d: summarise(measured(spark, d).results()).select("total", "passed", "failed", "pass_rate"))


@query("SNK5", f"{RUN_SQL} SELECT event_type AS name, n % 2 = 0 AS success FROM k UNION ALL SELECT 'events', true")
def snk5(spark, d):
    document = D.read_document(spark, measured(spark, d).save(folder(spark, "bench")))
    return spark.createDataFrame([(r["name"], r["success"]) for r in document["results"]], "name string, success boolean")


@query("CLI1", "SELECT conv_id, turn, true AS blocked, 'BLOCK' AS policy_action FROM conversations WHERE role = 'user' AND (conv_id * 8 + turn) % 30 = 3 QUALIFY row_number() OVER (ORDER BY conv_id, turn) = 1")
def cli1(spark, d):
    """The command line's analysis of the first prompt that asks for the system prompt."""
    first = prompts(spark, d).filter((F.col("conv_id") * 8 + F.col("turn")) % 30 == 3).orderBy("conv_id", "turn").limit(1).collect()
    said = [(r.conv_id, r.turn, cli.analyze(spark, r.text)) for r in first]
    return spark.createDataFrame([(c, t, a["blocked"], a["policy_action"]) for c, t, a in said], "conv_id long, turn long, blocked boolean, policy_action string")


@query("FN21", f"{PROMPTS} SELECT conv_id, turn, 'echo' AS model, text AS prompt, true AS stream, conv_id % 2 = 0 AS plain, CASE WHEN conv_id % 2 = 1 THEN 7 END AS seed FROM c")
def fn21(spark, d):
    """Requests' bodies: with the usual options, and with a seed."""
    x = prompts(spark, d)
    usual, seeded = M.payloads(F.col("text"), "echo"), M.payloads(F.col("text"), "echo", M.ModelOptions(seed=7))
    body = F.from_json(F.when(F.col("conv_id") % 2 == 0, usual).otherwise(seeded), "model string, prompt string, stream boolean, options struct<seed:int,top_p:double>")
    return x.select("conv_id", "turn", body.alias("b")).select("conv_id", "turn", "b.model", "b.prompt", "b.stream", F.col("b.options").isNull().alias("plain"), "b.options.seed")


@query("SRC14", "SELECT DISTINCT p_brand AS name, true AS reachable FROM part")
def src14(spark, d):
    """A catalogue of models named after the brands, a few dozen."""
    cloudpickle.register_pickle_by_value(M)
    spark.dataSource.register(M.ModelCatalogue)
    names = [r.p_brand for r in table(spark, d, "part").select("p_brand").distinct().collect()]
    return spark.read.format("model_catalogue").option("models", json.dumps(names)).load().select("name", "reachable")


def asked(spark, d):
    return prompts(spark, d).select((F.col("conv_id") * 8 + F.col("turn")).cast("string").alias("key"), F.col("text").alias("prompt"))


ANSWER_SQL = f"""{PROMPTS}, a AS (SELECT (conv_id * 8 + turn)::VARCHAR AS key, text, regexp_extract_all(text, '\\S+\\s*') AS ws FROM c), w AS (SELECT key, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS seq FROM a),
q AS (SELECT key, seq, text, contains(right(string_agg(text, '') OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING), 2000), 'flag') AS hit FROM w), s AS (SELECT key, min(seq) FILTER (hit) AS stop, count(*) AS n FROM q GROUP BY key)
SELECT key, seq::INT AS seq, text, false AS done, hit AS stopped_by_guard, NULL::VARCHAR AS error_type FROM q JOIN s USING (key) WHERE stop IS NULL OR seq <= stop
UNION ALL SELECT a.key, coalesce(stop + 1, n, 0)::INT, '', true, stop IS NOT NULL, CASE WHEN coalesce(a.text, '') = '' THEN 'empty_prompt' END FROM a LEFT JOIN s ON s.key = a.key"""


@query("STR5", ANSWER_SQL)
def str5(spark, d):
    """Stopped where chunks are made: the client raises when it is asked for one after the stop word, which would be a row with an error."""
    return M.stream(asked(spark, d), M.StrictClient("flag"), "echo", should_stop=lambda tail: "flag" in tail)


@query("SRC13", ANSWER_SQL)
def src13(spark, d):
    """The stream source: half of the prompts, then, in a query that is started again, the other half."""
    cloudpickle.register_pickle_by_value(M)
    spark.dataSource.register(M.ModelChunks)
    path, x = folder(spark, "lots"), asked(spark, d)
    schema = "key string, seq int, text string, done boolean, stopped_by_guard boolean, error_type string"
    for half in (0, 1):
        M.publish(x.filter(F.pmod(F.xxhash64("key"), F.lit(2)) == half), path)
        live = spark.readStream.format("model_chunks").option("path", path).option("stop", "flag").load()
        to = live.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-state")
        to.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}-out")


@query("STR6", f"SELECT event_id::VARCHAR AS event_id, event_type AS attack_type, '[REDACTED_PASSWORD] sent' AS input_summary FROM events")
def str6(spark, d):
    """The event log as a stream: the first run is lost after it has written, the second writes the same batch again."""
    path, failed = folder(spark, "log"), []
    live = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    live = live.select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("attack_type"), F.lit("password=hunter22 sent").alias("input_summary"))

    def lose(number: int) -> None:
        if not failed:
            failed.append(number)
            raise OSError("lost after the write")

    for _ in range(2):
        try:
            D.append_event_stream(live, f"{path}/log", f"{path}/state", bounded=True, after=lose).awaitTermination()
        except Exception:
            if len(failed) != 1:
                raise
    return D.read_event_batches(spark, f"{path}/log").select("event_id", "attack_type", "input_summary")


# ---- detectors of users -------------------------------------------------------------------------------------------------


def _digits(texts):
    import pandas as pd

    if texts.str.contains("pirate").any():
        raise ValueError("no pirates")
    n = texts.str.count("[0-9]")
    return pd.DataFrame({"matched": n >= 4, "confidence": (n / 10).clip(upper=1.0), "rule": "digits"}, index=texts.index)


def _answer(texts, found):
    import pandas as pd

    return pd.DataFrame({"action": ["BLOCK" if c >= 1 else "WARN" for c in found.confidence], "safe_prompt": texts.str.replace("[0-9]", "#", regex=True)}, index=texts.index)


@query("EXT_detector", f"""{PROMPTS}, n AS (SELECT conv_id, turn, text, length(regexp_replace(text, '[^0-9]', '', 'g')) AS k, contains(text, 'pirate') AS bad FROM c)
SELECT conv_id, turn, 'digits' AS skill, CASE WHEN NOT bad THEN k >= 4 END AS matched, CASE WHEN NOT bad THEN least(1.0, k / 10)::DOUBLE END AS confidence, CASE WHEN NOT bad AND k >= 4 THEN CASE WHEN k >= 10 THEN 'BLOCK' ELSE 'WARN' END END AS action,
CASE WHEN NOT bad AND k >= 4 THEN regexp_replace(text, '[0-9]', '#', 'g') END AS safe_prompt, CASE WHEN bad THEN 'ValueError: no pirates' END AS error FROM n""")
def ext_detector(spark, d):
    """A user's detector in Python, with a defence, that fails on some texts."""
    x = DT.detections(prompts(spark, d), ["conv_id", "turn"], [DT.Detector("digits", _digits, _answer)])
    return x.select("conv_id", "turn", "skill", "matched", "confidence", "action", "safe_prompt", "error")


# ---- suites of checks -----------------------------------------------------------------------------------------------------


def _suite_sql(checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {quoted(name)} AS name, true AS success, (SELECT count(*) FROM ({registry.ORACLES[key]})) AS found" for name, key in checks.items())


def _suite(name: str):
    def run(spark, d):
        e = Evaluator(spark)
        found = e.run_suite(SUITES[name], registry.QUERIES, d)
        made = spark.createDataFrame(list(found.items()), "name string, found long")
        return e.results().join(made, "name").select("name", "success", "found")

    return run


for _n in SUITES:
    query(f"BEN1_{_n}", _suite_sql(SUITES[_n]))(_suite(_n))
