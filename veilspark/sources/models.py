"""Language models as sources: blocking calls, chunk streams with early stops, a stream source, and a catalogue.

A client is any object with generate(prompt, model, options) -> str and stream(prompt, model, options) -> iterator of str;
it must pickle, as it runs on the executors. `EchoClient` is one for tests, `StrictClient` one that fails where it is asked too much.

`stream` runs over tables and streams of prompts alike. `publish` and the source `model_chunks` are for prompts that keep coming: they are laid down
in numbered lots, and the source's offset is the number of lots, so that a query that is started again goes on after the last one that it finished.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class InvalidOptions(ValueError):
    pass


@dataclass(frozen=True)
class ModelOptions:
    temperature: float = 0.2
    top_p: float = 0.9
    num_ctx: int = 4096
    num_predict: int = 512
    seed: int | None = None
    stream: bool = True
    timeout_seconds: int = 60

    def __post_init__(self):
        if self.temperature < 0:
            raise InvalidOptions("temperature must be >= 0")
        if not 0 <= self.top_p <= 1:
            raise InvalidOptions("top_p must be between 0 and 1")
        for name in ("num_ctx", "num_predict", "timeout_seconds"):
            if getattr(self, name) <= 0:
                raise InvalidOptions(f"{name} must be > 0")

    def payload(self, prompt: str, model: str) -> dict:
        """A request's body; options that have their default aren't sent."""
        usual = ModelOptions()
        own = {k: getattr(self, k) for k in ("temperature", "top_p", "num_ctx", "num_predict", "seed") if getattr(self, k) != getattr(usual, k)}
        return {"model": model, "prompt": prompt, "stream": self.stream} | ({"options": own} if own else {})


def payloads(prompt: Column, model: str, options: ModelOptions = ModelOptions()) -> Column:
    """The bodies of requests as JSON, for a column of prompts."""
    body = options.payload("", model)
    own = [F.struct(*(F.lit(v).alias(k) for k, v in body["options"].items())).alias("options")] if "options" in body else []
    return F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(options.stream).alias("stream"), *own))


class EchoClient:
    """Answers with the prompt; streams it word by word."""

    def __init__(self, *names: str):
        self.names = names or ("echo",)

    def generate(self, prompt: str, model: str, options: ModelOptions) -> str:
        return prompt

    def stream(self, prompt: str, model: str, options: ModelOptions) -> Iterator[str]:
        yield from re.findall(r"\S+\s*", prompt)

    def models(self) -> list[dict]:
        return [{"name": n, "size": 0} for n in self.names]

    def ping(self) -> None:
        """Raises where there is no server."""


class StrictClient(EchoClient):
    """Echoes, and raises when it is asked for a chunk after one that completed the stop word."""

    def __init__(self, stop: str = "flag"):
        super().__init__()
        self.stop = stop

    def stream(self, prompt: str, model: str, options: ModelOptions) -> Iterator[str]:
        said = ""
        for chunk in super().stream(prompt, model, options):
            if self.stop in said:
                raise RuntimeError("asked for a chunk after the stop word")
            said += chunk
            yield chunk


def generate(df: DataFrame, client, model: str, options: ModelOptions = ModelOptions(), prompt_col: str = "prompt", key_col: str = "key") -> DataFrame:
    """(key, text, success, error_type, error_message): one call per prompt; empty prompts and failures are rows, not exceptions."""

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for key, prompt in zip(x["key"], x["prompt"]):
                if not prompt:
                    rows.append((key, "", False, "empty_prompt", "prompt is empty"))
                    continue
                try:
                    rows.append((key, client.generate(prompt, model, options), True, None, None))
                except Exception as e:
                    rows.append((key, "", False, type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=["key", "text", "success", "error_type", "error_message"])

    kind = df.schema[key_col].dataType.simpleString()
    return df.select(F.col(key_col).alias("key"), F.col(prompt_col).alias("prompt")).mapInPandas(calls, f"key {kind}, text string, success boolean, error_type string, error_message string")


#: Characters of an answer that a stop test sees.
TAIL = 2000


def answer(client, prompt: str | None, model: str, options: ModelOptions, should_stop=None) -> Iterator[tuple]:
    """(seq, text, done, stopped_by_guard, error_type) of an answer's chunks, as they come. should_stop(the last `TAIL` characters) ends it after the chunk
    that it says yes to: the client isn't asked for another. An error, too, ends it."""
    seq, tail, stop = 0, "", False
    try:
        for text in client.stream(prompt, model, options) if prompt else ():
            tail = (tail + text)[-TAIL:]
            stop = bool(should_stop and should_stop(tail))
            yield seq, text, False, stop, None
            seq += 1
            if stop:
                break
        yield seq, "", True, stop, None if prompt else "empty_prompt"
    except Exception as e:
        yield seq, "", True, False, type(e).__name__


def stream(df: DataFrame, client, model: str, options: ModelOptions = ModelOptions(), should_stop=None, prompt_col: str = "prompt", key_col: str = "key") -> DataFrame:
    """(key, seq, text, done, stopped_by_guard, error_type): the chunks of each answer, see `answer`."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for key, prompt in zip(x["key"], x["prompt"]):
                yield pd.DataFrame([(key, *c) for c in answer(client, prompt, model, options, should_stop)], columns=["key", "seq", "text", "done", "stopped_by_guard", "error_type"])

    kind = df.schema[key_col].dataType.simpleString()
    return df.select(F.col(key_col).alias("key"), F.col(prompt_col).alias("prompt")).mapInPandas(chunks, f"key {kind}, seq int, text string, done boolean, stopped_by_guard boolean, error_type string")


def kept_until_stop(chunks: DataFrame) -> DataFrame:
    """Chunks up to the first that stopped its answer."""
    first = chunks.filter("stopped_by_guard").groupBy("key").agg(F.min("seq").alias("__last"))
    return chunks.join(first, "key", "left").filter("__last IS NULL OR seq <= __last").drop("__last")


def check_connection(client) -> dict:
    """success, error_type, error_message of a client's server."""
    try:
        client.ping()
        return {"success": True, "error_type": None, "error_message": None}
    except ConnectionError:
        return {"success": False, "error_type": "connection_error", "error_message": "Cannot connect to Ollama. Please ensure it is running."}
    except Exception:
        return {"success": False, "error_type": "connection_error", "error_message": "Failed to connect to Ollama."}


class ModelCatalogue(DataSource):
    """spark.read.format("model_catalogue").option("client", "module:Class"): the models of a client, or one row with its error. The option models, a JSON list,
    stands for what the server of an `EchoClient` has."""

    @classmethod
    def name(cls) -> str:
        return "model_catalogue"

    def schema(self) -> str:
        return "name string, size long, reachable boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        return _CatalogueReader(self.options.get("client"), self.options.get("models"))


class _CatalogueReader(DataSourceReader):
    def __init__(self, client: str | None, names: str | None):
        self.client, self.names = client, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        try:
            client = loaded(self.client) if self.client else EchoClient(*(json.loads(self.names) if self.names else ["echo"]))
            client.ping()
            for m in client.models():
                yield (m["name"], m.get("size"), True, None)
        except Exception as e:
            yield (None, None, False, str(e))


# ---- prompts that keep coming -----------------------------------------------------------------------------------

#: Prompts in a lot, about; a lot is a partition of the stream.
LOT = 1000


def lots(path: str) -> list[int]:
    """Numbers of the lots that are whole."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return sorted(int(x.base_name.partition("=")[2]) for x in found if x.base_name.startswith("lot="))


def publish(prompts: DataFrame, path: str, key_col: str = "key", prompt_col: str = "prompt", size: int = LOT) -> int:
    """Lays (key, prompt) down as the next lots below path, a URI of a store that is shared; their number. Lots are written aside and then named one
    after another, so that a reader sees whole ones only. One publisher at a time."""
    spark = prompts.sparkSession
    first, n = len(lots(path)), max(1, -(-prompts.count() // size))
    rows = prompts.select(F.col(key_col).cast("string").alias("key"), F.col(prompt_col).alias("prompt"))
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    rows.withColumn("lot", F.pmod(F.xxhash64("key"), F.lit(n))).repartition("lot").write.partitionBy("lot").parquet(aside)
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = [x.getPath() for x in store.listStatus(jvm.org.apache.hadoop.fs.Path(aside)) if x.getPath().getName().startswith("lot=")]
    for i, lot in enumerate(sorted(made, key=lambda p: int(p.getName()[4:]))):
        store.rename(lot, jvm.org.apache.hadoop.fs.Path(f"{path}/lot={first + i}"))
    store.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
    return len(made)


def loaded(client: str | None):
    """The client of "module:Class"; without one, an echo."""
    import importlib

    module, _, name = (client or "").partition(":")
    return getattr(importlib.import_module(module), name)() if client else EchoClient()


class ModelChunks(DataSource):
    """spark.readStream.format("model_chunks") with options path (of `publish`), client ("module:Class"), model and stop (a word that ends
    an answer): the chunks of all answers."""

    @classmethod
    def name(cls) -> str:
        return "model_chunks"

    def schema(self) -> str:
        return "key string, seq int, text string, done boolean, stopped_by_guard boolean, error_type string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChunkReader(dict(self.options))


class _ChunkReader(DataSourceStreamReader):
    """Offsets count lots; those of a batch are asked for anew if the batch is run again."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"lots": 0}

    def latestOffset(self) -> dict:
        return {"lots": len(lots(self.options["path"]))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(i) for i in range(start["lots"], end["lots"])]

    def read(self, partition: InputPartition):
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.options["path"])
        client, stop = loaded(self.options.get("client")), self.options.get("stop")
        should_stop = (lambda tail: stop in tail) if stop else None
        for b in ds.dataset(f"{top}/lot={partition.value}", filesystem=store, format="parquet").to_batches(columns=["key", "prompt"]):
            for r in b.to_pylist():
                for c in answer(client, r["prompt"], self.options.get("model", ""), ModelOptions(), should_stop):
                    yield (r["key"], *c)
