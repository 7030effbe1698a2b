"""Feature runs: content keys and the append-only ledger."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_FIELDS = ("adapter_id", "alignment_source", "artifact_schema_version", "backbone_id", "backbone_revision", "dataset", "embedding_source", "pooling_version", "sample_rate")


def feature_key(spec: dict[str, Column | None]) -> Column:
    """FN-25: the first 16 hex digits of the SHA-256 of the compact, sorted JSON of the nine key fields; nulls are kept."""
    def value(name: str) -> Column:
        c = spec.get(name)
        if c is None:
            return F.lit("null")
        text = c.cast("string")
        return F.coalesce(text if name == "sample_rate" else F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))

    parts = [F.concat(F.lit(json.dumps(n) + ":"), value(n)) for n in KEY_FIELDS]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).cast("binary"), 256), 1, 16)


def current_state(ledger: DataFrame, key: str = "feature_key", order: str = "seq") -> DataFrame:
    """SNK-06: the latest row of each key of an append-only ledger."""
    others = [c for c in ledger.columns if c != key]
    latest = ledger.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("s"))
    return latest.select(key, "s.*")


def plan_files(specs: DataFrame) -> DataFrame:
    """JOB-12: the files that plan each run: its spec, its first state and a folder for each split, as (rel_path, content).

    ``specs`` has dataset, dataset_root, splits, feature_key and the key's fields.
    """
    home = F.concat_ws("/", "dataset", "feature_key")
    state = F.to_json(F.struct("feature_key", F.lit("planned").alias("status")))
    split = F.transform("splits", lambda x: F.struct(F.concat(home, F.lit("/splits/"), x, F.lit("/planned.json")).alias("rel_path"), F.to_json(F.struct(x.alias("split"))).alias("content")))
    two = [F.struct(F.concat(home, F.lit(f"/{n}.json")).alias("rel_path"), c.alias("content")) for n, c in (("spec", F.to_json(F.struct(*specs.columns))), ("state", state))]
    return specs.select(F.inline(F.concat(F.array(*two), split)))


def run_messages(specs: DataFrame, homes: DataFrame, roots: DataFrame, states: DataFrame) -> DataFrame:
    """JOB-12: (dataset, feature_key, messages): what each planned run lacks, in order, and the homes that no spec asks for.

    ``homes`` (rel_path) lists the files below the feature store, ``roots`` (dataset_root) the data sets that are there,
    ``states`` (dataset, feature_key, said_key) the keys that state files name. Messages: missing_root, missing_spec, missing_state,
    key_mismatch, missing_split:<name>, unplanned.
    """
    part = lambda i: F.get(F.split("rel_path", "/"), F.lit(i))
    found = homes.select(part(0).alias("dataset"), part(1).alias("feature_key"), part(2).alias("file"), part(3).alias("split")).where(F.col("file").isNotNull())
    found = found.groupBy("dataset", "feature_key").agg(F.collect_set(F.when(F.col("file") == "splits", F.concat(F.lit("splits/"), "split")).otherwise(F.col("file"))).alias("there"))
    d = specs.select("dataset", "dataset_root", "feature_key", "splits", F.lit(True).alias("planned")).join(found, ["dataset", "feature_key"], "full_outer")
    d = d.join(roots.select("dataset_root", F.lit(True).alias("root")).distinct(), "dataset_root", "left").join(states, ["dataset", "feature_key"], "left")
    there = F.coalesce("there", F.array().cast("array<string>"))
    has = lambda name: F.array_contains(there, name)
    single = F.array(
        F.when(F.col("root").isNull(), "missing_root"), F.when(~has("spec.json"), "missing_spec"), F.when(~has("state.json"), "missing_state"), F.when(F.col("said_key") != F.col("feature_key"), "key_mismatch"),
    )
    splits = F.transform("splits", lambda x: F.when(~F.array_contains(there, F.concat(F.lit("splits/"), x)), F.concat(F.lit("missing_split:"), x)))
    messages = F.filter(F.concat(single, splits), lambda x: x.isNotNull())
    return d.select("dataset", "feature_key", F.when(F.col("planned").isNull(), F.array(F.lit("unplanned"))).otherwise(messages).alias("messages"))
