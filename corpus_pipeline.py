"""A corpus pipeline: toxicity filter, line deduplication, near-deduplication, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``; ``run`` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import forget, if_few, table, written
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.near_dedup import near_duplicates, text_hash
from cadenza.llm.packing import pack_documents
from cadenza.llm.toxicity import fit_toxicity, score_toxicity


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """The documents with columns of these names called otherwise, and what brings all their columns back."""
    own = {c: f"__own_{c}" if c in names else c for c in docs.columns}
    return docs.select(*[F.col(c).alias(o) for c, o in own.items()]), [F.col(o).alias(c) for c, o in own.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on the labelled rows among these documents."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    safe, own = apart(docs, "score", "predicted", "spans")
    return score_toxicity(safe, model).where(F.col("predicted") == 0).select(*own)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, all documents stay; ``n_chars`` follows the text."""
    safe, own = apart(docs, "kept_text", "n_lines", "n_dropped")
    out = dedup_lines(safe)
    changed = F.col("n_dropped") > 0
    new = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")),
    }
    return out.select(*[new[name].alias(name) if name in new else c for name, c in zip(docs.columns, own)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity of 0.8 or more); of rows that share an id only those whose own text is a copy go."""
    out = written(near_duplicates(docs, percent=80, bands=40, with_hash=True), "near-dedup")
    # the ids that go are fewer than those that stay; while they are few, the texts aren't shuffled for them
    gone = if_few(written(out.where(~F.col("kept")).select(F.col("id").alias("__gone"), "text_hash").distinct(), "near-gone"))
    return docs.join(gone, (F.col("doc_id") == F.col("__gone")) & (text_hash(docs["text"]) == gone["text_hash"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("packing", pack)]

#: A chain, a perfect hash probe and a linear program: SQL expresses none of the fitted stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
