"""Acoustic vectors as bytes: what is packed comes back, and no vector goes through a sort or shuffle."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.functions import packed
from cadenza.operators import words as O
from cadenza.plans import views as V
from cadenza.session import scratch
from cadenza.sources import corpora, sinks


def phones(spark):
    u, i = F.col("id") % 7, F.floor(F.col("id") / 7).cast("int")
    d = spark.range(0, 70, 1, 3).where((u != 0) | (i < 1)).select(  # word 0 has one phone, the others ten
        u.alias("utterance_id"), i.alias("index"), F.lit(1).alias("speaker_id"), F.lit("train").alias("split"), F.lit("AH").alias("phoneme"),
        (i % 3).cast("double").alias("human_score"), F.lit(False).alias("omission"), F.lit(80).alias("duration_ms"),
        F.when(F.col("id") != 36, F.col("id") / 10).alias("variance"), F.lit(0.5).alias("z"), F.lit(0.2).alias("energy"),
    )
    return d.withColumn("emb", F.array("human_score", F.col("index").cast("double"), F.lit(0.0)))


score_and_index = lambda score, index: np.stack([score, index, np.zeros(len(score))], axis=1)


def test_values_nulls_and_slices_come_back():
    lists = pa.array([[1.0, None], [], [float("nan"), -0.0, 3.5], [7.0]], pa.list_(pa.float64()))
    a = packed.pack(packed.numbers(lists.values), lists.offsets.to_numpy())
    back = packed.unpack(a.slice(1))
    assert str(back.to_pylist()) == str(lists.to_pylist()[1:]) and packed.unpack(a).to_pylist()[0] == [1.0, None]
    assert packed.unpack(pa.array([None, a[3].as_py()], pa.binary())).to_pylist() == [None, [7.0]]


@pytest.mark.parametrize("embedding", ["emb", (["human_score", "index"], score_and_index)])
def test_packed_words_equal_the_arrays_across_batches(spark, monkeypatch, embedding):
    monkeypatch.setattr(O, "PACKED_BYTES", 8 * 6 * 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # words go across batches
    try:
        p = phones(spark)
        path = scratch(spark, "dense")
        m = sinks.write_dense_words(p, path, embedding=embedding, width=6)
        assert (m["num_utterances"], m["num_rows"], m["acoustic_dim"], m["dtypes"]["acoustic_flat"]) == (7, 61, 6, "binary")
        want = {r["utterance_id"]: r.asDict() for r in O.assemble_words(p, "emb", 6).collect()}
        got = {r["utterance_id"]: r.asDict() for r in corpora.dense_words(spark, path, None, 7, 6).collect()}
        assert got == want and None in got[1]["acoustic_flat"]
        s = packed.summed(corpora.dense_words(spark, path, ["utterance_id", "acoustic_flat"], as_bytes=True), "acoustic_flat", "n", "total")
        for r in s.collect():
            flat = want[r["utterance_id"]]["acoustic_flat"]
            assert r["n"] == len(flat) and r["total"] == (None if None in flat else pytest.approx(sum(flat)))
        with pytest.raises(Exception, match="another length"):
            corpora.dense_words(spark, path, None, 7, 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_of_the_phones_view_take_one_shuffle(spark):
    plan = V.words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_the_functions_vectors_are_not_sorted_or_shuffled(spark):
    d = O.packed_words(phones(spark), (["human_score", "index"], score_and_index), 6)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "emb" not in plan and "CollectList" not in plan


def test_offsets_from_sizes_read_apart(spark):
    d = spark.range(20).select((F.col("id") % 2).alias("k"), "id", (F.col("id") + 1).alias("n"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(O.two_level_offsets(d, "k", "id", "n", 3, sizes=d)) == rows(O.two_level_offsets(d, "k", "id", "n", 3))
