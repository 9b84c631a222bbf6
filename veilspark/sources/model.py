"""Labelers, classifiers and auditors: pluggable, and run where the data are.

A labeler is a function of fragments that gives labels (doc_id, frag_id, ftype). The
rule labeler is offline and deterministic. The others ask a language model server, a
batch of fragments at a time; replies are written before anything depends on them, since
a task may run again, and operators.cache keeps labels from one job to the next."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.replies import document_type, parse_audits, parse_labels, short_ids
from veilspark.functions.text import contains_any, rule_label, short_id
from veilspark.operators.layout import row_texts
from veilspark.schema import BATCH, CLASSIFY_LINES, CLASSIFY_WORDS
from veilspark.sources import prompts as say
from veilspark.sources.tables import materialized

Labeler = Callable[[DataFrame], DataFrame]
Ask = Callable[[str, str], str]
REPLIES = "doc_id string, batch int, raw string, error string, total_s double"
#: Calls of a service for one prompt, halvings of a batch, and the batch that is halved no more.
ATTEMPTS, DEPTH, SMALLEST = 2, 3, 5


def rule_labels(frags: DataFrame) -> DataFrame:
    return frags.select("doc_id", "frag_id", rule_label(F.col("text")).alias("ftype"))


def classify_by_words(lines: DataFrame) -> DataFrame:
    """(doc_id, document_type) from the first CLASSIFY_LINES lines of each document
    (doc_id, line_no, text): the first type, in a fixed order, with a tell-tale word."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return lines.where(F.col("line_no") < CLASSIFY_LINES).groupBy("doc_id").agg(F.lower(text).alias("text")).select("doc_id", document_type_by_words(F.col("text")).alias("document_type"))


def document_type_by_words(lower: Column) -> Column:
    found = F.lit("other")
    for name, words in reversed(CLASSIFY_WORDS.items()):
        found = F.when(contains_any(lower, words), name).otherwise(found)
    return found


def server(url: str | None = None) -> str:
    return (url or os.environ.get("VEILSPARK_URL", "http://127.0.0.1:11434")).rstrip("/")


def model_name(model: str | None = None) -> str:
    return model or os.environ.get("VEILSPARK_MODEL", "llama3.2:3b")


def http_ask(url: str | None = None, model: str | None = None, timeout: float = 180) -> Ask:
    """A caller of a generate endpoint (VEILSPARK_URL, VEILSPARK_MODEL)."""
    at, name = server(url) + "/api/generate", model_name(model)

    def ask(system: str, user: str) -> str:
        body = {"model": name, "system": system, "prompt": user, "stream": False, "options": {"temperature": 0, "seed": 0, "num_ctx": 4096, "num_predict": 1024}, "keep_alive": "30m"}
        with urllib.request.urlopen(urllib.request.Request(at, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as reply:
            return json.load(reply)["response"]

    return ask


def reachable(url: str | None = None, model: str | None = None) -> tuple[bool, str]:
    """Whether a server answers and has the model, and what to tell; asked by the driver before a job."""
    at, name = server(url), model_name(model)
    try:
        with urllib.request.urlopen(at + "/api/tags", timeout=5) as reply:
            known = [m.get("name", "") for m in json.load(reply).get("models", [])]
    except (OSError, ValueError) as e:
        return False, f"no server at {at}: {e}"
    found = any(k == name or k.split(":")[0] == name.split(":")[0] for k in known)
    return found, f"{name} is ready" if found else f"the server at {at} does not have {name}"


def warm_up(ask: Ask) -> bool:
    """Have the model loaded by one short call; false if it does not answer."""
    try:
        ask(*say.WARM_UP)
    except Exception:  # noqa: BLE001  any failure of a service
        return False
    return True


def asked(prompts: DataFrame, ask: Ask, system: str | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, batch, raw, error, total_s) of prompts (doc_id, batch, prompt, and system
    unless it is given): one row a prompt, asked up to `attempts` times while the service
    fails; then raw is null and error says why. No row is ever lost."""
    schema = pa.schema([("doc_id", pa.string()), ("batch", pa.int32()), ("raw", pa.string()), ("error", pa.string()), ("total_s", pa.float64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                start, raw, error = time.perf_counter(), None, None
                for _ in range(attempts):
                    try:
                        raw, error = ask(row["system"], row["prompt"]), None
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a service becomes a status
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "batch": row["batch"], "raw": raw, "error": error, "total_s": time.perf_counter() - start}], schema=schema)

    given = prompts if system is None else prompts.withColumn("system", F.lit(system))
    return given.select("doc_id", "batch", "prompt", "system").mapInArrow(batches, REPLIES)


def halves(ids: DataFrame) -> DataFrame:
    """Batches cut in two, those of SMALLEST fragments or fewer left out; short ids anew."""
    w = Window.partitionBy("doc_id", "batch")
    placed = ids.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("seq")) - 1).where(F.col("_n") > SMALLEST)
    half = F.floor(F.col("_n") / 2)
    second = F.col("_i") >= half
    return placed.select(*[c for c in ids.columns if c not in ("batch", "short_id")], (F.col("batch") * 2 + second.cast("int")).cast("int").alias("batch"), short_id(F.when(second, F.col("_i") - half).otherwise(F.col("_i"))).alias("short_id"))


def http_labels(frags: DataFrame, ask: Ask, batch_size: int = BATCH, depth: int = DEPTH, types: DataFrame | None = None) -> DataFrame:
    """Labels by a model. A batch that gives no label, since its reply cannot be read or
    the service fails, is asked once more and then in halves, `depth` times at most; what
    stays unlabelled is redacted later. types (doc_id, document_type) adds a note on the
    document's type. Replies of each round are written first."""
    kinds = frags.select("doc_id").distinct() if types is None else types.select("doc_id", "document_type")
    system = say.detect_system(F.col("document_type") if types is not None else F.lit("other"))
    ids, found = materialized(short_ids(frags, batch_size)), None
    for level in range(depth + 1):
        for _ in range(2):
            lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "short_id", "text").alias("t")))), lambda p: p["t"]), "\n")
            prompts = ids.groupBy("doc_id", "batch").agg(lines.alias("prompt")).join(kinds, "doc_id", "left").withColumn("system", system)
            replies = materialized(asked(prompts, ask, attempts=1)).where("raw IS NOT NULL")
            got = materialized(parse_labels(replies, ids).select("doc_id", "batch", "frag_id", "ftype"))
            found = got.drop("batch") if found is None else found.unionByName(got.drop("batch"))
            ids = materialized(ids.join(got.select("doc_id", "batch").distinct(), ["doc_id", "batch"], "left_anti"))
            if ids.isEmpty():
                return found
        if level < depth:
            ids = materialized(halves(ids))
            if ids.isEmpty():
                break
    return found


def http_classes(frags: DataFrame, ask: Ask) -> DataFrame:
    """(doc_id, document_type, error): other where the service fails."""
    lines = row_texts(frags, "line_no").where(F.col("line_no") < CLASSIFY_LINES)
    prompt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    replies = asked(lines.groupBy("doc_id").agg(F.lit(0).alias("batch"), prompt.alias("prompt")), ask, say.CLASSIFY)
    return replies.select("doc_id", document_type(F.coalesce("raw", F.lit("other"))).alias("document_type"), "error")


def http_flags(visible: DataFrame, ask: Ask, attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, purpose, ordinal, frag_id) that an auditor flags among visible fragments.
    A reply that cannot be read is asked for again; without one nothing is flagged. Ids
    that the document does not show are dropped."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "frag_id", "text").alias("t")))), lambda p: p["t"]), "\n")
    prompts = visible.groupBy("doc_id", "purpose").agg(F.concat_ws("\n", F.concat(F.lit("Purpose: "), F.first("purpose")), lines).alias("prompt"))
    todo, flags = materialized(prompts.select(F.concat_ws("\u0000", "doc_id", "purpose").alias("doc_id"), F.lit(0).alias("batch"), "prompt")), None
    for _ in range(attempts):
        parsed = materialized(parse_audits(materialized(asked(todo, ask, say.AUDIT, attempts=1)).where("raw IS NOT NULL"))).where("ok")
        flags = parsed if flags is None else flags.unionByName(parsed)
        todo = materialized(todo.join(parsed.select("doc_id"), "doc_id", "left_anti"))
        if todo.isEmpty():
            break
    parts = F.split("doc_id", "\u0000")
    said = flags.select(parts[0].alias("doc_id"), parts[1].alias("purpose"), F.posexplode("flagged").alias("ordinal", "frag_id"))
    return said.join(visible.select("doc_id", "purpose", "frag_id").distinct(), ["doc_id", "purpose", "frag_id"], "left_semi").select("doc_id", "purpose", "ordinal", "frag_id")
