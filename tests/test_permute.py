"""Keyed permutations are bijections of every size, and spread."""

from pyspark.sql import functions as F

from cadenza.operators import permute
from cadenza.operators import words as O


def test_every_size_is_a_bijection(spark):
    sizes = [*range(1, 40), 100, 1023, 1024, 1025, 4097]
    d = spark.createDataFrame([(n, k) for n in sizes for k in (0, 7, 2**40)], "n long, k long").select("n", "k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    d = d.withColumn("x", permute.permuted(F.col("i"), F.col("n"), F.col("k")))
    got = d.groupBy("n", "k").agg(F.count_distinct("x").alias("m"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum((F.col("i") == F.col("x")).cast("int")).alias("fixed")).collect()
    assert all((r["m"], r["low"], r["high"]) == (r["n"], 0, r["n"] - 1) for r in got)
    assert all(r["fixed"] < 12 for r in got if r["n"] > 1000)
    a, b = ([r["x"] for r in d.where(f"n = 1024 and k = {k}").orderBy("i").collect()] for k in (0, 7))
    assert sum(x == y for x, y in zip(a, b)) < 12


def test_very_many_rows(spark):
    n = 10**12 + 39
    d = spark.range(0, n, n // 5000).select(permute.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x"))
    x = sorted(r["x"] for r in d.collect())
    assert len(set(x)) == len(x) and 0 <= x[0] and x[-1] < n and x[len(x) // 2] > n // 4


def test_block_shuffle_keeps_blocks_and_batches(spark):
    rows = [(i, "a" if i % 3 else None) for i in range(500)]
    d = O.block_shuffle(spark.createDataFrame(rows, "u long, split string"), "split", "u", 8, 40, seed=1, epoch=2)
    got = d.collect()
    assert len(got) == 500
    for key in ("a", None):
        mine = [r for r in got if r["split"] == key]
        blocks = {}
        for r in mine:
            blocks.setdefault(r["block"], []).append(r)
        assert sorted({r["block_order"] for r in mine}) == list(range(len(blocks)))
        for b, rs in blocks.items():
            assert len({r["block_order"] for r in rs}) == 1
            sizes = [sum(r["batch_in_block"] == i for r in rs) for i in range(-(-len(rs) // 8))]
            assert sizes == [8] * (len(rs) // 8) + [len(rs) % 8] * (len(rs) % 8 > 0)
    full = O.block_shuffle(spark.createDataFrame(rows, "u long, split string"), "split", "u", 8, 40, seed=1, epoch=2, drop_last=True)
    assert full.count() == sum(n // 40 * 40 + n % 40 // 8 * 8 for n in (333, 167))
