"""Protected assets: the registry as a table, its changes, and matchers over arrays of assets.

Matchers take the assets as an array of structs: a literal one for a small registry, or a column where every
row has its own. A registry goes into a literal only up to `MAX_LITERAL` assets; beyond that `asset_index` joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.functions.rules import strings

SCHEMA = "asset_id string, name string, type string, value string, aliases array<string>, risk_level string, allowed_roles array<string>, protection_modes array<string>, enabled boolean, description string, source string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
MAX_LITERAL = 1000


def default_assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t, v, a, r, roles, m, True, d, s) for i, n, t, v, a, r, roles, m, d, s in V.ASSETS], SCHEMA)


def literal(rows=V.ASSETS) -> Column:
    """Shipped or collected assets as an array literal."""
    rows = list(rows)
    if len(rows) > MAX_LITERAL:
        raise ValueError("too many assets for a literal; use asset_index")
    return F.array(*(F.struct(F.lit(i).alias("asset_id"), F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(v).alias("value"), strings(a).alias("aliases"), F.lit(r).alias("risk_level"), strings(roles).alias("allowed_roles"), strings(m).alias("protection_modes"), F.lit(d).alias("description")) for i, n, t, v, a, r, roles, m, d, _ in rows))


# ---- changes ------------------------------------------------------------------------------------------------


def validation(df: DataFrame) -> Column:
    """Null if a row is a valid asset, else its first fault."""
    bad_mode = F.get(F.filter("protection_modes", lambda m: ~m.isin(V.PROTECTION_MODES)), F.lit(0))
    shown = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return F.coalesce(
        F.when(F.col("asset_id").isNull(), "Missing required field: asset_id"),
        F.when(F.col("value").isNull(), "Missing required field: value"),
        F.when((F.col("risk_level") != "") & ~F.col("risk_level").isin(V.RISK_LEVELS), F.concat(F.lit(f"risk_level must be one of {shown(V.RISK_LEVELS)}, got '"), F.col("risk_level"), F.lit("'"))),
        F.when(bad_mode.isNotNull(), F.concat(F.lit("Invalid protection_mode '"), bad_mode, F.lit(f"', valid: {shown(V.PROTECTION_MODES)}"))),
        F.when(F.exists("aliases", lambda a: a.isNull()), "Each alias must be a string, got NoneType"),
        F.when(F.exists("allowed_roles", lambda a: a.isNull()), "Each allowed_role must be a string, got NoneType"),
        F.when(T.is_blank(F.col("asset_id")), "asset_id must be a non-empty string"),
        F.when(T.is_blank(F.col("value")), "value must be a non-empty string"),
    )


def with_defaults(df: DataFrame) -> DataFrame:
    """Normal texts and the defaults of a new asset."""
    return df.select(
        F.col("asset_id"),
        F.coalesce(T.asset_text(F.col("name")), F.lit("")).alias("name"),
        F.coalesce("type", F.lit("exact")).alias("type"),
        T.asset_text(F.col("value")).alias("value"),
        F.coalesce(F.transform("aliases", T.asset_text), strings([])).alias("aliases"),
        F.coalesce("risk_level", F.lit("medium")).alias("risk_level"),
        F.coalesce("allowed_roles", strings(["owner"])).alias("allowed_roles"),
        F.coalesce("protection_modes", strings(["exact_match"])).alias("protection_modes"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("source", F.lit("user")).alias("source"),
    )


def add(registry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with the valid new assets whose ids it didn't have, and (asset_id, success, message) for all new ones.
    Of new ones with one id the first by value counts."""
    judged = new.withColumn("__fault", validation(new))
    known = registry.select("asset_id").withColumn("__known", F.lit(True)).distinct()
    x = judged.join(known, "asset_id", "left").withColumn("__fault", F.coalesce("__fault", F.when(F.col("__known"), F.concat(F.lit("Duplicate asset_id: "), F.col("asset_id")))))
    taken = with_defaults(x.filter("__fault IS NULL").dropDuplicates(["asset_id"]).select(*FIELDS))
    return registry.select(*FIELDS).unionByName(taken), x.select("asset_id", F.col("__fault").isNull().alias("success"), F.coalesce("__fault", F.lit("Asset added")).alias("message"))


def remove(registry: DataFrame, asset_id: str) -> DataFrame:
    return registry.filter(~F.col("asset_id").eqNullSafe(asset_id))


def update(registry: DataFrame, asset_id: str, /, **changes) -> DataFrame:
    """Replaces any field but the id; nothing is validated anew."""
    hit = F.col("asset_id").eqNullSafe(asset_id)
    value = lambda v: strings(v) if isinstance(v, list) else F.lit(v)
    return registry.withColumns({k: F.when(hit, value(v)).otherwise(F.col(k)) for k, v in changes.items() if k in FIELDS and k != "asset_id"})


def merge(defaults: DataFrame, users: DataFrame) -> DataFrame:
    """Defaults, and those of the users' that have an id the defaults don't have."""
    own = users.filter("asset_id IS NOT NULL AND asset_id <> ''").join(defaults.select("asset_id").distinct(), "asset_id", "left_anti").dropDuplicates(["asset_id"])
    return defaults.select(*FIELDS).unionByName(own.select(*FIELDS))


def find(registry: DataFrame, word: str) -> DataFrame:
    """Enabled assets whose value, name or alias contains the word in any letter case."""
    w = word.lower().strip()
    has = lambda c: F.coalesce(F.lower(c).contains(w), F.lit(False))
    return registry.filter(F.coalesce("enabled", F.lit(True)) & (has(F.col("value")) | has(F.col("name")) | F.coalesce(F.exists("aliases", has), F.lit(False))))


# ---- matchers -----------------------------------------------------------------------------------------------


def secret_match(text: Column, assets: Column) -> Column:
    """(asset_id, name, matched_fragments) of assets that the text gives away under their modes: the value as it is, in any letter case or encoded,
    an alias, or a part of four characters without punctuation."""
    low = F.lower(text)

    def fragments(a: Column) -> Column:
        mode = lambda m: F.array_contains(a["protection_modes"], m)
        some = lambda cond, items: F.when(cond, items).otherwise(F.array().cast("array<string>"))
        value = a["value"]
        exact = (mode("exact_match") & text.contains(value)) | (mode("case_insensitive_match") & low.contains(F.lower(value)))
        coded = F.filter(F.array(T.to_base64(value), T.to_hex(value)), lambda e: text.contains(e))
        return F.array_distinct(F.concat(
            some(exact, F.array(value)),
            some(mode("alias_match"), F.filter(a["aliases"], lambda w: low.contains(F.lower(w)))),
            some(mode("encoding_match"), coded),
            some(mode("partial_match") & ~exact, F.filter(T.plain_grams(value), lambda g: low.contains(F.lower(g)))),
        ))

    found = F.transform(F.filter(assets, lambda a: F.length(a["value"]) > 0), lambda a: F.struct(a["asset_id"].alias("asset_id"), a["name"].alias("name"), fragments(a).alias("matched_fragments")))
    return F.filter(found, lambda m: F.size(m["matched_fragments"]) > 0)


def translation_match(text: Column, value: Column, name: Column, table: dict = V.TRANSLATIONS) -> Column:
    """(matched, source_term) of the first foreign word in the text whose notion is in the value or the text; failing that, in the name."""
    low, value, name = T.strip(F.lower(text)), F.lower(value), F.lower(name)
    pair = lambda e, w: F.struct(F.lit(w).alias("matched"), F.lit(e).alias("source_term"))
    first = [F.when((value.contains(e) | low.contains(e)) & low.contains(w), pair(e, w)) for e, ws in table.items() for w in ws]
    second = [F.when((value.contains(e) | name.contains(e)) & low.contains(w), pair(e, w)) for e, ws in table.items() for w in ws]
    return F.when((text != "") & text.isNotNull(), F.coalesce(*first, *second))


def semantic_match(text: Column, asset: Column) -> Column:
    """(mode, matched, confidence): the name, else the first alias, else half of the description's words of three letters or more."""
    low = T.strip(F.lower(text))
    alias = F.get(F.filter(asset["aliases"], lambda a: low.contains(F.lower(a))), F.lit(0))
    words = F.filter(F.transform(F.split(F.lower(F.regexp_replace(asset["description"], ",", " ")), r"(?U)\s+"), T.strip), lambda w: F.length(w) > 2)
    hits = F.filter(words, lambda w: low.contains(w))
    out = lambda mode, matched, c: F.struct(F.lit(mode).alias("mode"), matched.alias("matched"), F.lit(c).alias("confidence"))
    return (
        F.when((text == "") | text.isNull(), None)
        .when((asset["name"] != "") & low.contains(F.lower(asset["name"])), out("semantic_name", asset["name"], 0.6))
        .when(alias.isNotNull(), out("semantic_alias", alias, 0.7))
        .when((F.size(hits) > 0) & (F.size(hits) >= 0.5 * F.size(words)), out("semantic_description", F.array_join(hits, " "), 0.5))
    )


def reconstruction_match(text: Column, value: Column) -> Column:
    """(longest_match, total_length, coverage_ratio, risk_level, matched_segments): the longest common piece of three characters or more, blanks left out;
    failing that, the share of the value's characters that occur in the text, from 0.7 on."""
    t, v = _packed(text), _packed(value)
    n = F.length(v)
    first_of = lambda size: F.get(F.filter(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: v.substr(i, size)), lambda s: t.contains(s)), F.lit(0))
    sizes = F.when(n >= 3, F.sequence(n, F.lit(3), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    found = F.filter(F.transform(sizes, lambda k: F.struct(k.alias("size"), first_of(k).alias("piece"))), lambda s: s["piece"].isNotNull())
    best = F.coalesce(F.get(found, F.lit(0))["size"], F.lit(0))
    # once a piece covers four fifths of the value, shorter ones aren't looked for
    used = F.when(best >= 0.8 * n, F.slice(found, 1, 1)).otherwise(F.slice(found, 1, 5))
    share = best / n
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    loose = F.size(F.filter(chars, lambda c: t.contains(c))) / n
    out = lambda best, ratio, risk, pieces: F.struct(best.cast("int").alias("longest_match"), n.alias("total_length"), F.bround(ratio, 2).alias("coverage_ratio"), risk.alias("risk_level"), pieces.alias("matched_segments"))
    whole = out(best, share, F.when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low"), F.transform(used, lambda s: s["piece"]))
    scattered = out(F.lit(0), loose, F.when(loose >= 0.8, "medium").otherwise("low"), F.array().cast("array<string>"))
    return F.when((text != "") & (n >= 3), F.when(best >= 3, whole).when((loose >= 0.7) & (n >= 5), scattered))


def _packed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"{T.WHITE}+", "")
