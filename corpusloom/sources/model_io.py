"""Batch request files, model result files and vector caches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.elements import SCALAR, elements, file_parts
from ..schemas import CANDIDATE, MODEL_RESULT
from ..session import cut, lookup

# What one batch file may hold.
BATCH_ROWS = 50_000
BATCH_BYTES = 200_000_000


def batch_lines(items: DataFrame, job_id: str, model: str) -> DataFrame:
    """items(target_id, url, publisher, type, language, title_hint, text) as (custom_id, line)."""
    prompt = F.concat(
        F.lit("Publisher: "), "publisher", F.lit("\nCanonical URL: "), "url", F.lit("\nProposed source type: "), "type",
        F.lit("\nLanguage hint: "), "language", F.lit("\nTitle hint: "), F.coalesce("title_hint", F.lit("unknown")),
        F.lit("\n\nSOURCE TEXT\n"), "text",
    )
    custom = F.concat(F.lit(f"{job_id}__"), "target_id")
    body = F.struct(F.lit(model).alias("model"), F.lit(False).alias("store"), F.lit(2400).alias("max_output_tokens"), prompt.alias("input"))
    request = F.struct(custom.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body"))
    return items.select(custom.alias("custom_id"), F.to_json(request).alias("line"))


def write_batch_requests(lines: DataFrame, path: str) -> DataFrame:
    """Write one JSON line per request to a new path, in as many files as the limits of one file ask for.

    A file takes so many requests that even the longest keep it within the bytes. Returns the single row
    (requests, bytes, longest). Only a request that is too long by itself is an error.
    """
    length = F.octet_length("line") + 1
    size = lines.agg(
        F.count("*").alias("requests"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(length), F.lit(1)).alias("longest"),
    )
    longest = size.first().longest
    if longest > BATCH_BYTES:
        raise ValueError(f"a request of {longest} bytes exceeds what one file may hold")
    most = min(BATCH_ROWS, BATCH_BYTES // longest)
    lines.select("line").write.mode("errorifexists").option("maxRecordsPerFile", most).text(path)
    return size


def response_text(output, joined: bool = False) -> Column:
    """Text of a response's `output_text` parts: the first one, or all of them joined."""
    items = F.col(output) if isinstance(output, str) else output
    parts = F.flatten(F.transform(items, lambda i: F.coalesce(i["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: p["text"])
    return F.array_join(texts, "") if joined else F.try_element_at(texts, F.lit(1))


def read_model_results(spark: SparkSession, path: str, job_id: str, manifest: DataFrame) -> DataFrame:
    """One row per result line: target, reason when it failed, candidate when it parsed.

    manifest(target_id) lists the fetched targets the job asked about.
    """
    lines = spark.read.text(path).where("value != ''")
    parsed = lines.select(F.from_json("value", MODEL_RESULT).alias("r")).select("r.*")
    marker = f"{job_id}__"
    target = F.when(F.col("custom_id").startswith(marker), F.expr(f"substring(custom_id, {len(marker) + 1})"))
    known = manifest.select("target_id").distinct().withColumn("known", F.lit(True))
    rows = parsed.select(
        target.alias("target_id"), "custom_id", F.col("response.status_code").alias("status_code"),
        response_text("response.body.output").alias("text"),
    ).join(known, "target_id", "left")
    candidate = F.from_json("text", CANDIDATE, {"mode": "PERMISSIVE"})
    judged = rows.withColumn("candidate", candidate).withColumn(
        "reason",
        F.when(F.col("known").isNull(), "unmatched_result")
        .when((F.coalesce("status_code", F.lit(0)) != 200) | (F.coalesce("text", F.lit("")) == ""), "api_error")
        .when(
            F.col("candidate.admit").isNull() | F.col("candidate.document").isNull()
            | F.col("candidate.films").isNull() | F.col("candidate.observations").isNull(),
            "invalid_model_output",
        ),
    )
    return judged.select(
        F.coalesce("target_id", "custom_id").alias("target_id"), "reason",
        F.when(F.col("reason").isNull(), F.col("candidate")).alias("candidate"),
    )


UNKNOWN_TIME = "unknown_legacy_cache"


def read_vector_cache(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """JSON caches as (model, dimensions, input_hash, vector, generated_at).

    Read in splits, one entry of a map after the other, so neither file nor map has to fit a task. A vector
    without a time is from an unknown time.
    """
    entries, _ = elements(file_parts(spark, path, glob), "vectors", "generatedAt", scalars=True, keep=False)
    held = cut(entries.select("group", "key", F.concat(F.lit("{"), "item", F.lit("}")).alias("entry")))
    header = F.from_json(F.when(F.col("key") == SCALAR, F.col("entry")), "model string, dimensions int")
    headers = held.select("group", header.alias("h")).groupBy("group").agg(F.max("h.model").alias("model"), F.max("h.dimensions").alias("dimensions"))

    def entry_of(key: str, kind: str, name: str) -> DataFrame:
        return held.where(F.col("key") == key).select("group", F.explode(F.from_json("entry", f"map<string,{kind}>")).alias("input_hash", name))

    dated = entry_of("vectors", "array<double>", "vector").join(entry_of("generatedAt", "string", "at"), ["group", "input_hash"], "left")
    return lookup(dated, headers, ["group"], "left").select(
        "model", "dimensions", "input_hash", "vector", F.coalesce("at", F.lit(UNKNOWN_TIME)).alias("generated_at")
    )


def write_vector_cache(vectors: DataFrame, path: str, model: str, dimensions: int) -> None:
    """vectors(input_hash, vector, generated_at) as cache files below a new path, one per partition, an entry a line."""
    opening = json.dumps({"model": model, "dimensions": dimensions, "vectors": {}})[:-2]
    between = '}, "generatedAt": {'

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, timed = opening, False
        for batch in batches:
            out = []
            for late, entry in zip(batch.column("late").to_pylist(), batch.column("entry").to_pylist()):
                if late and not timed:
                    lead, timed = (lead if lead == opening else "") + between, True
                out.append(lead + entry)
                lead = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": [(opening if lead == opening else "") + ("" if timed else between) + "}}"]})

    def entry(late: bool, value: str) -> Column:
        return F.struct(F.lit(late).alias("late"), F.to_json(F.create_map("input_hash", value)).alias("json"))

    both = F.array(entry(False, "vector"), F.when(F.col("generated_at").isNotNull(), entry(True, "generated_at")))
    rows = vectors.where("input_hash IS NOT NULL AND vector IS NOT NULL").select(F.explode(both).alias("e")).where("e IS NOT NULL")
    bare = F.expr("substring(e.json, 2, length(e.json) - 2)").alias("entry")
    rows.select("e.late", bare).sortWithinPartitions("late").mapInArrow(lines, "value string").write.mode("errorifexists").text(path)
