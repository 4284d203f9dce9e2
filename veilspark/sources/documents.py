"""JSON sources and sinks: assets, rules, registries and event logs.

Paths may be of any store that Spark reads. Loaders differ, as their users need, in what they do about missing
and broken files: nothing, fall back, or raise `RuleLoadError`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.assets import FIELDS, SCHEMA, merge
from veilspark.operators.events import SCHEMA as EVENT_SCHEMA
from veilspark.operators.events import complete, redact

#: Assets in a document of a saved registry, a few megabytes, which one task writes or reads.
LOT = 10_000


class RuleLoadError(ValueError):
    """kind: missing, invalid or shape."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"{kind}: {path}")
        self.kind = kind


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_document(spark: SparkSession, path: str):
    """A whole small JSON document; raises RuleLoadError if it is missing or broken."""
    if not exists(spark, path):
        raise RuleLoadError("missing", path)
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        return json.loads(text)
    except ValueError as e:
        raise RuleLoadError("invalid", path) from e


def load_rules(spark: SparkSession, path: str) -> list:
    """A document that must be an array."""
    data = read_document(spark, path)
    if not isinstance(data, list):
        raise RuleLoadError("shape", path)
    return data


def load_map(spark: SparkSession, path: str) -> dict:
    """A document that must be an object; {} where there is none."""
    if not exists(spark, path):
        return {}
    data = read_document(spark, path)
    return data if isinstance(data, dict) else {}


def load_map_table(spark: SparkSession, path: str, value_schema: str, key: str = "category") -> DataFrame:
    """An object of objects as rows (key, fields of the value)."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias(key, "v"))
    return rows.select(key, "v.*")


def load_or_default(spark: SparkSession, path: str | None, default: dict) -> tuple[dict, bool]:
    """The document, or the default and True if it is missing, broken or no object."""
    try:
        data = read_document(spark, path) if path else default
        if isinstance(data, dict):
            return data, False
    except RuleLoadError:
        pass
    return default, True


def load_assets(spark: SparkSession, path: str, source: str | None = None, pattern: str | None = None) -> DataFrame:
    """Assets of a file {assets: [..]} or [..], or of all files of a folder that the pattern names (`*.json`); missing and
    broken files have none. Rows that are no objects are left out. source: stands where a row has none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], SCHEMA)
    reader = spark.read if not pattern and fs.getFileStatus(p).isFile() else spark.read.option("pathGlobFilter", pattern or "*.json")
    texts = reader.text(path, wholetext=True)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json("value", "assets array<string>")["assets"])
    each = texts.select(F.explode(rows).alias("row")).filter(F.ltrim("row").startswith("{")).select(F.from_json("row", SCHEMA).alias("a"))
    rows = each.select("a.*").filter(" OR ".join(f"{f} IS NOT NULL" for f in FIELDS))
    return rows.withColumn("source", F.coalesce("source", F.lit(source))) if source else rows


def in_lots(assets: DataFrame, *by: str) -> DataFrame:
    """The assets with the `lot` of each: as many lots (of each group, if they are grouped) as hold about `LOT` assets each, however large the registry."""
    most = assets.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    lots = -(-most // LOT)
    return assets.withColumn("lot", F.pmod(F.xxhash64(*FIELDS), F.lit(lots)))


def save_registry(assets: DataFrame, path: str, version: str = "1.0") -> None:
    """A folder of documents {version, asset_count, assets}, one for each lot, with the count of its own assets; a registry of up to `LOT` assets is one document.
    An empty registry has none."""
    each = in_lots(assets).groupBy("lot").agg(F.count(F.lit(1)).alias("asset_count"), F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("assets"))
    each.select("lot", F.to_json(F.struct(F.lit(version).alias("version"), "asset_count", "assets")).alias("value")).write.mode("overwrite").partitionBy("lot").text(path)


def refresh(spark: SparkSession, defaults: str, users: str, path: str) -> DataFrame:
    """Merges the assets of two files, of which the first wins, saves them as the registry and returns what it then holds."""
    merged = merge(load_assets(spark, defaults, "system"), load_assets(spark, users, "user"))
    save_registry(merged, path)
    return load_assets(spark, path, pattern="*.txt")


def asset(registry: DataFrame, asset_id: str) -> DataFrame:
    """The asset of that id; empty if there is none."""
    return registry.filter(F.col("asset_id") == asset_id)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event lines; blank and broken ones are left out; a missing log is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], EVENT_SCHEMA)
    return spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Completes, redacts and appends events as JSON lines."""
    redact(complete(events)).write.mode("append").option("ignoreNullFields", False).json(path)


def append_event_stream(events: DataFrame, path: str, checkpoint: str, bounded: bool = False, after=None):
    """The same for a stream, exactly once: a batch is a folder below path, named after its number, and a batch that is run again after a failure writes its folder
    anew. Read it with `read_event_batches`. after(number), if given, runs when a batch's folder is there, before Spark takes the batch as done."""

    def write(batch: DataFrame, number: int) -> None:
        redact(complete(batch)).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/batch={number}")
        if after:
            after(number)

    to = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (to.trigger(availableNow=True) if bounded else to).start()


def read_event_batches(spark: SparkSession, path: str) -> DataFrame:
    """Events of all batches, with the number of their batch."""
    schema = EVENT_SCHEMA if isinstance(EVENT_SCHEMA, str) else EVENT_SCHEMA.simpleString()
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("mode", "DROPMALFORMED").json(path)


def save_text(spark: SparkSession, text: str, path: str) -> str:
    """Writes a small text document from the driver, whole or not at all."""
    p, fs = _path(spark, path)
    draft, _ = _path(spark, path + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(p, False)
    fs.rename(draft, p)
    return path


def load_alias_rules(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The variants of each canonical word; a missing or broken document is an error."""
    data = read_document(spark, path)
    return dict(data.get("aliases") or {}) if isinstance(data, dict) else {}


def load_policy_file(spark: SparkSession, path: str) -> dict:
    """A policy document; {} where there is none, an error where it is broken."""
    return load_map(spark, path)


class RolePolicies:
    """What a role is allowed, from {roles: {role: {allowed_roles, permissions}}}; no document and unknown roles allow nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.reload()

    def reload(self) -> None:
        self.roles = load_map(self.spark, self.path).get("roles") or {}

    def policy(self, role: str, asset_names: list[str], decision: dict) -> dict:
        own, action = self.roles.get(role) or {}, decision.get("action", "allow")
        watched = action in ("warn", "restrict", "block", "escalate")
        return {
            "action": action,
            "risk_threshold": decision.get("threshold", "medium"),
            "role": role,
            "restricted_assets": list(asset_names),
            "allowed_roles": own.get("allowed_roles", []),
            "required_permissions": own.get("permissions", []),
            "enable_monitoring": watched,
            "enable_leakage_check": action != "allow",
        }


class RouteRules:
    """The rules of a document by category; a missing or broken document is an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.rules = load_map(spark, path)

    def get_rule(self, category: str) -> dict:
        """Empty where there is none."""
        return dict(self.rules.get(category) or {})

    def has_rule(self, category: str) -> bool:
        return category in self.rules

    def list_categories(self) -> list[str]:
        return list(self.rules)


class Config:
    """Settings of a document, with defaults where it says nothing."""

    # Defaults of settings.
    DEFAULTS = {"default_threshold": "medium", "enable_input_guard": True, "enable_output_guard": True, "enable_token_guard": True, "enable_authorization": False, "stream_monitoring": True, "log_all_events": True, "max_buffer_size": 2000, "response_language": "zh"}

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.values = self.DEFAULTS | (load_map(spark, path) if path else {})

    def get(self, key: str, default=None):
        return self.values.get(key, default)
