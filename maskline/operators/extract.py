"""Extractors: from windows to chat-completion responses.

An extractor is an object with respond(segments) that adds the response columns to segments(..., text):
finish_reason, content, prompt_tokens, completion_tokens, transport_error, latency_seconds.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
import uuid
from collections import deque
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from http.client import HTTPException

import pandas as pd
import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import CODES, DECODING, PATTERNS
from ..functions.text import json_string, words
from .locate import name_hits, with_names

PLACEHOLDER = "{{CLINICAL_TEXT}}"
RESPONSE = "finish_reason string, content string, prompt_tokens long, completion_tokens long, transport_error string, latency_seconds double"
#: Answers after which a task adds a file to the ledger.
LEDGER_ROWS = 64
_LEDGER = pa.schema([("digest", pa.string()), ("finish_reason", pa.string()), ("content", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("transport_error", pa.string()), ("latency_seconds", pa.float64()), ("asked_at", pa.float64())])

# The schema that answers must follow.
SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["identifiers"],
    "properties": {
        "identifiers": {
            "type": "array",
            "uniqueItems": True,
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["exact_text", "identifier_type"],
                "properties": {"exact_text": {"type": "string", "minLength": 1}, "identifier_type": {"type": "string", "enum": list(CODES)}},
            },
        }
    },
}


def pattern_pairs(text: Column, patterns: Sequence[tuple[str, ...]] = PATTERNS, names: Column | None = None) -> Column:
    """Distinct (exact_text, identifier_type) in order of finding: the names that were found, then each pattern's matches.

    patterns: (category, regular expression), and with it, where there is one, a text that all its matches contain: texts without
    it are not searched.
    """

    def pairs(literals: Column, code: str) -> Column:
        return F.transform(literals, lambda x: F.struct(x.alias("exact_text"), F.lit(code).alias("identifier_type")))

    found = [F.array().cast("array<struct<exact_text:string,identifier_type:string>>")]
    if names is not None:
        found.append(pairs(names, CODES[0]))
    for code, pattern, *needed in patterns:
        matches = pairs(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x != ""), code)
        for part in needed:
            matches = F.when(F.contains(text, F.lit(part)), matches).otherwise(found[0])
        found.append(matches)
    return F.array_distinct(F.concat(*found))


def gazetteer_pairs(segments: DataFrame, names: DataFrame) -> DataFrame:
    """segments(..., text) that contain a name of names(name), of which there may be any number: the pair for each."""
    return name_hits(segments, names).withColumn("identifier_type", F.lit(CODES[0]))


class PatternExtractor:
    """Offline extractor of names and patterns.

    names: a list, or names(name) of any number; they are looked for by automata, patterns by the JVM.
    """

    def __init__(self, names: Sequence[str] | DataFrame = (), patterns: Sequence[tuple[str, ...]] = PATTERNS):
        self.names = names if isinstance(names, DataFrame) else sorted(names, key=len, reverse=True)
        self.patterns = tuple(patterns)

    def respond(self, segments: DataFrame) -> DataFrame:
        items = F.transform("_pairs", lambda p: F.concat(F.lit('{"exact_text": '), json_string(p["exact_text"]), F.lit(', "identifier_type": "'), p["identifier_type"], F.lit('"}')))
        named = isinstance(self.names, DataFrame) or bool(self.names)
        given = with_names(segments, self.names, "_names") if named else segments
        out = given.withColumn("_pairs", pattern_pairs(F.col("text"), self.patterns, F.col("_names") if named else None))
        out = out.withColumn("content", F.concat(F.lit('{"identifiers": ['), F.array_join(items, ", "), F.lit("]}"))).drop("_pairs")
        return out.select(
            *segments.columns,
            F.lit("stop").alias("finish_reason"),
            "content",
            words(F.col("text")).cast("long").alias("prompt_tokens"),
            words(F.col("content")).cast("long").alias("completion_tokens"),
            F.lit(None).cast("string").alias("transport_error"),
            F.lit(None).cast("double").alias("latency_seconds"),
        )


def payload(model: str, system: str, template: str, text: str) -> dict:
    """Request body for one window."""
    # Names and shape of the request.
    said = [{"role": "system", "content": system}, {"role": "user", "content": template.replace(PLACEHOLDER, text)}]
    wanted = {"type": "json_schema", "json_schema": {"name": "phi_identifiers", "strict": True, "schema": SCHEMA}}
    return {"model": model, "messages": said, **DECODING, "stream": False, "response_format": wanted}


class ServerExtractor:
    """Asks a chat-completions server, once for each different window; what goes wrong on the way becomes a response.

    With a ledger, a folder that driver and executors share, every answer is written down as soon as a task has a few of them.
    A job that is started again asks only for windows that no earlier one, however it ended, has an answer to; a window is known by
    the digest of its whole request. Without a ledger answers are not repeatable: write them before anything reads them twice.

    A task has at most `at_once` requests open, and holds no more answers than that beside those it is about to write.
    """

    def __init__(self, base: str, model: str, system: str, template: str, timeout: float = 600.0, ledger: str | None = None, at_once: int = 4, again: bool = False):
        if template.count(PLACEHOLDER) != 1:
            raise ValueError("the template needs the placeholder exactly once")
        self.base, self.model, self.system, self.template, self.timeout = base.rstrip("/"), model, system, template, timeout
        #: Whether windows whose only answers are errors of transport are asked for again.
        self.ledger, self.at_once, self.again = ledger, at_once, again

    def ask(self, text: str) -> dict:
        body = json.dumps(payload(self.model, self.system, self.template, text)).encode()
        request = urllib.request.Request(f"{self.base}/v1/chat/completions", body, {"Content-Type": "application/json"})
        began = time.monotonic()
        try:
            with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(request, timeout=self.timeout) as reply:
                out = json.load(reply)
            choice, usage = (out.get("choices") or [{}])[0], out.get("usage") or {}
            of = lambda x, kind: x if isinstance(x, kind) else None
            answer = {"finish_reason": of(choice.get("finish_reason"), str), "content": of((choice.get("message") or {}).get("content"), str), "prompt_tokens": of(usage.get("prompt_tokens"), int), "completion_tokens": of(usage.get("completion_tokens"), int), "transport_error": None}
        except (OSError, HTTPException, ValueError, AttributeError, TypeError, LookupError) as e:
            # a body cut short, a bad status line, or what is no envelope: one window's trouble, not the job's
            answer = {"finish_reason": "error", "content": "", "prompt_tokens": 0, "completion_tokens": 0, "transport_error": type(e).__name__}
        return answer | {"latency_seconds": time.monotonic() - began}

    def _answers(self, texts: Iterator[tuple]) -> Iterator[tuple]:
        """(..., text) -> (..., answer), in the order in which they are asked, `at_once` of them at a time."""
        with ThreadPoolExecutor(self.at_once) as pool:
            open_: deque = deque()
            try:
                for *key, text in texts:
                    open_.append((key, pool.submit(self.ask, text)))
                    if len(open_) >= self.at_once:
                        key, answer = open_.popleft()
                        yield *key, answer.result()
                while open_:
                    key, answer = open_.popleft()
                    yield *key, answer.result()
            finally:
                for _, answer in open_:
                    answer.cancel()

    def respond(self, segments: DataFrame) -> DataFrame:
        if self.ledger:
            return self._from_ledger(segments)
        fields = [x.split()[0] for x in RESPONSE.split(", ")]

        def run(batches):
            for pdf in batches:
                got = [a for (a,) in self._answers((t,) for t in pdf["text"])]
                yield pdf.assign(**{k: pd.Series([g.get(k) for g in got], index=pdf.index, dtype=object) for k in fields})

        return segments.mapInPandas(run, T.StructType(segments.schema.fields + T._parse_datatype_string(RESPONSE).fields))

    def _digest(self) -> Column:
        """Of the request for a window: all that the answer can depend on."""
        fixed = hashlib.sha256(json.dumps(payload(self.model, self.system, self.template, PLACEHOLDER), sort_keys=True).encode()).hexdigest()
        return F.sha2(F.concat(F.lit(fixed), F.col("text")).cast("binary"), 256)

    def _written(self, spark: SparkSession) -> DataFrame:
        """The ledger's answers, one for each digest: the first that is no error, else the first."""
        schema = f"digest string, {RESPONSE}, asked_at double"
        try:
            rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.ledger)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], schema)
        first = F.struct(F.col("transport_error").isNotNull().alias("failed"), "asked_at", *[x.split()[0] for x in RESPONSE.split(", ")])
        return rows.groupBy("digest").agg(F.min(first).alias("a")).select("digest", "a.*")

    def _from_ledger(self, segments: DataFrame) -> DataFrame:
        spark, ledger = segments.sparkSession, self.ledger
        windows = segments.withColumn("digest", self._digest())
        known = self._written(spark)
        settled = known.where("not failed") if self.again else known
        asked = windows.select("digest", "text").dropDuplicates(["digest"]).join(settled.select("digest"), "digest", "left_anti")

        def run(batches):
            system, root = FileSystem.from_uri(ledger)
            system.create_dir(root, recursive=True)
            texts = ((d, t) for batch in batches for d, t in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()))
            held: list[dict] = []

            def write() -> None:
                # under a name that readers pass over, then moved: a reader sees whole files only
                name = uuid.uuid4().hex
                with system.open_output_stream(f"{root}/_{name}", compression=None) as f:
                    parquet.write_table(pa.Table.from_pylist(held, _LEDGER), f)
                system.move(f"{root}/_{name}", f"{root}/answers-{name}.parquet")
                held.clear()

            n = 0
            try:
                for digest, answer in self._answers(texts):
                    held.append({"digest": digest, **answer, "asked_at": time.time()})
                    n += 1
                    if len(held) >= LEDGER_ROWS:
                        write()
            finally:
                if held:
                    write()
            yield pa.RecordBatch.from_pydict({"n": [n]})

        asked.select("digest", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()
        return windows.join(self._written(spark).drop("failed", "asked_at"), "digest").drop("digest").select(*segments.columns, *[x.split()[0] for x in RESPONSE.split(", ")])
