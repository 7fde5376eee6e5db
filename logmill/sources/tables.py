"""Fixed schemas and the reader of the tables. Schemas are given, never inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logmill.plans.ship import ship

SCHEMAS: dict[str, str] = {
    "engagements": "engagement string, program string, authorization_basis string, mode string, assets array<string>, allowed_methods array<string>, max_requests bigint, interval_seconds double, created_at string",
    "participants": "seq bigint, session_id string, name string, role string, model string, created_at string, agent_id string, parent string, model_source string, engagement string, arrived_at timestamp_ntz",
    "messages": "seq bigint, sender string, recipient string, kind string, reply_to bigint, data_json string, evidence_json string, role string, model string, created_at string, dedup_key string, archived int, engagement string, arrived_at timestamp_ntz",
    "purges": "purge_id bigint, engagement string, target string, target_key string, purged_at timestamp_ntz",
    "dump_rows": "dump_id bigint, feed string, record_type string, file_name string, exported_at timestamp_ntz, line_no int, rec_key string, body string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, engagement string, collected_at timestamp_ntz",
    "eval_items": "item_id bigint, suite string, lang string, text string",
    "mix_targets": "source string, target_share double, max_repeats int",
}


def columns(name: str) -> dict[str, str]:
    """Name and type of each column of a table."""
    return dict(c.split(" ") for c in SCHEMAS[name].split(", "))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, under its fixed schema where there is one; what reads it may run on the executors."""
    ship(spark)
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")
