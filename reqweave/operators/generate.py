"""Calls of language models: backends, and the stage that asks them once per prompt."""

from __future__ import annotations

import base64
import http.client
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import REQUIREMENT_HEADING, REQUIREMENT_LINE

JSON_INSTRUCTION = "Answer only with JSON that fits the given format."


class Backend(Protocol):
    """What answers prompts. It is sent to the workers, so it holds settings and no connections."""

    def running(self) -> bool: ...

    def models(self) -> list[str]: ...

    def pull(self, model: str) -> bool: ...

    def ask(self, prompt: str, model: str, system: str, schema: str | None, images: list[str], temperature: float) -> str | None: ...


@dataclass
class RuleBackend:
    """Answers from rules: the requirement blocks that the prompt's document has. Same prompt, same answer."""

    names: tuple[str, ...] = ("rules",)

    def running(self) -> bool:
        return True

    def models(self) -> list[str]:
        return list(self.names)

    def pull(self, model: str) -> bool:
        return False

    def ask(self, prompt, model, system, schema, images, temperature):
        found: list[dict] = []
        open_ = False
        heading, plain = (re.compile(p.removeprefix("(?U)")) for p in (REQUIREMENT_HEADING, REQUIREMENT_LINE))
        for line in prompt.rpartition("-----\n")[2].split("\n"):
            text = line.strip()
            if heading.match(text) or plain.match(text):
                code = re.search(r"[A-Z]{2,10}-\d+", text)
                found.append({"code": code[0], "description": text[code.end() :].strip(" :/")})
                open_ = True
            elif text.startswith("#"):
                open_ = False
            elif open_ and text:
                found[-1]["description"] = f"{found[-1]['description']} {text}".strip()
        return json.dumps(found, ensure_ascii=False) if schema else " ".join(x["code"] for x in found)


#: Open connections of this process, by server.
_connections: dict[tuple, http.client.HTTPConnection] = {}


@dataclass
class HttpBackend:
    """A local model server with the endpoints /api/tags, /api/pull and /api/generate."""

    host: str = "http://localhost:11434"
    timeout: float = 300.0
    unload: bool = False
    headers: dict = field(default_factory=dict)

    def _call(self, path: str, body: dict | None = None) -> dict:
        """One request. A worker keeps its connection to a server; one that the server has closed meanwhile is opened anew."""
        at = urlsplit(self.host.rstrip("/") + path)
        data = None if body is None else json.dumps(body).encode()
        key = (at.scheme, at.netloc, self.timeout)
        while True:
            kept = _connections.pop(key, None)
            kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
            connection = kept or kind(at.netloc, timeout=self.timeout)
            try:
                connection.request("POST" if data else "GET", at.path, data, {"Content-Type": "application/json", **self.headers})
                reply = connection.getresponse()
                content = reply.read()
            except (http.client.HTTPException, OSError) as e:
                connection.close()
                if kept and not isinstance(e, TimeoutError):
                    continue
                raise e if isinstance(e, OSError) else OSError(str(e)) from e
            _connections[key] = connection
            if reply.status >= 400:
                raise OSError(f"HTTP {reply.status}: {content[:200].decode(errors='replace')}")
            return json.loads(content)

    def running(self) -> bool:
        try:
            self._call("/api/tags")
        except (OSError, ValueError):
            return False
        return True

    def models(self) -> list[str]:
        try:
            return [m["name"] for m in self._call("/api/tags")["models"]]
        except (OSError, ValueError, KeyError, TypeError):
            return []

    def pull(self, model: str) -> bool:
        try:
            self._call("/api/pull", {"name": model, "stream": False})
        except (OSError, ValueError):
            return False
        return True

    def ask(self, prompt, model, system, schema, images, temperature):
        body = {"model": model, "prompt": prompt, "system": system, "stream": False, "options": {"temperature": temperature}}
        if schema:
            body["format"] = json.loads(schema)
        if images:
            body["images"] = images
        if self.unload:
            body["keep_alive"] = 0
        return self._call("/api/generate", body).get("response")


def preflight(backend: Backend, model: str) -> None:
    """Once per job: the server answers and has the model, pulled if need be; else RuntimeError."""
    if not backend.running():
        raise RuntimeError("the model server does not answer")
    if model not in backend.models() and not backend.pull(model):
        raise RuntimeError(f"model {model} is not available")


def generate(
    backend: Backend,
    prompt: str,
    model: str,
    system: str | None = "",
    schema: str | None = None,
    images: list[str] | None = None,
    temperature: float = 0.1,
    max_retries: int = 3,
    pause: float = 0.0,
) -> tuple[str | None, str | None]:
    """(response, error): at most ``max_retries`` attempts; a reply without text uses one up. With a schema the system prompt asks for JSON."""
    system = "\n".join(x for x in (system, JSON_INSTRUCTION if schema else "") if x)
    error = "no attempt"
    for k in range(max_retries):
        try:
            response = backend.ask(prompt, model, system, schema, images or [], temperature)
            if response is not None:
                return response, None
            error = "reply without text"
        except Exception as e:  # whatever a backend raises is this row's error, not the job's
            error = f"{type(e).__name__}: {e}"
        if pause and k + 1 < max_retries:
            time.sleep(pause * 2**k)
    return None, error


def prompt_key(model: str, temperature: float, *columns: str):
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(temperature)), *columns), 256)


def respond(
    prompts: DataFrame,
    backend: Backend,
    model: str,
    schema: str | None = None,
    system: str = "",
    temperature: float = 0.1,
    max_retries: int = 3,
    workers: int = 5,
    images: str | None = None,
) -> DataFrame:
    """(key, response, error) for each different prompt of ``prompts`` (key, prompt[, images: array of binary]).

    At most ``workers`` calls run at once: so many partitions, one call each. Errors stay with their row. The result has to be written
    before it is used (``cached``), so that no retry asks again.
    """
    cols = ["key", "prompt"] + ([images] if images else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pictures = batch[images] if images else [[]] * len(batch)
            coded = [[base64.b64encode(i).decode() for i in p] for p in pictures]
            done = [generate(backend, p, model, system, schema, i, temperature, max_retries) for p, i in zip(batch["prompt"], coded)]
            yield pd.DataFrame({"key": batch["key"], "response": [d[0] for d in done], "error": [d[1] for d in done]})

    return prompts.select(*cols).dropDuplicates(["key"]).repartition(workers).mapInPandas(run, "key string, response string, error string")


def cached(prompts: DataFrame, cache_path: str, ask) -> DataFrame:
    """Responses for all prompts: those in the Parquet table at ``cache_path``, and new ones, which ``ask`` (prompts to responses) gets and the table keeps.

    Failed calls are not kept, so the next run tries them again.
    """
    spark = prompts.sparkSession
    schema = "key string, response string, error string"
    if not _exists(spark, cache_path):
        spark.createDataFrame([], schema).write.parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path)
    # both attempts and failures are written, in one go: the plan that asks runs once
    ask(prompts.join(known.where("error is null").select("key").distinct(), "key", "left_anti")).write.mode("append").parquet(cache_path)
    all_ = spark.read.schema(schema).parquet(cache_path)
    return all_.groupBy("key").agg(F.max("response").alias("response"), F.when(F.max("response").isNull(), F.max("error")).alias("error"))


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def page_batches(pages: DataFrame, per_request: int = 2) -> DataFrame:
    """(pdf, batch_no, page_index: the first page, pages, images) of pages (pdf, page_no from 1, png), in the order of their numbers."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "png")))
    batches = pages.groupBy("pdf", F.floor((F.col("page_no") - 1) / per_request).cast("long").alias("batch_no")).agg(ordered.alias("p"))
    return batches.select(
        "pdf",
        "batch_no",
        F.col("p")[0]["page_no"].cast("long").alias("page_index"),
        F.transform("p", lambda x: x["page_no"].cast("long")).alias("pages"),
        F.transform("p", lambda x: x["png"]).alias("images"),
    )
