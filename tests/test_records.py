"""The rules of every record type, one broken at a time."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import records as R

TYPES = {k: v for k, v in vars(R).items() if isinstance(v, T.StructType)}


def good(kind):
    """A value that breaks no rule."""
    import json

    if isinstance(kind, T.StructType):
        out = {}
        for f in kind:
            rule = json.loads(f.metadata["rule"])
            out[f.name] = rule["values"][0] if rule.get("values") else type(good(f.dataType))(rule["low"]) if rule.get("low") is not None else good(f.dataType)
        return out
    if isinstance(kind, T.ArrayType):
        return [good(kind.elementType)]
    return {"string": "x", "int": 1, "double": 0.5, "boolean": True}.get(kind.simpleString(), {"a": "b"})


@pytest.mark.parametrize("name", sorted(TYPES))
def test_each_rule_is_found_alone(spark, name):
    import json

    kind, rows = TYPES[name], [([], good(TYPES[name]))]

    def spoil(schema, where, path):
        for f in schema:
            rule = json.loads(f.metadata["rule"])
            edits = [] if rule.get("optional") else [("missing", None)]
            whole = not isinstance(f.dataType, T.DoubleType)
            edits += [("range", int(rule["low"] - 1) if whole else rule["low"] - 0.001)] if rule.get("low") is not None else []
            edits += [("range", int(rule["high"] + 1) if whole else rule["high"] + 0.001)] if rule.get("high") is not None else []
            edits += [("range", math.nan)] if rule.get("low") is not None and not whole else []
            edits += [("value", "odd")] if rule.get("values") else []
            for broken, value in edits:
                row = good(kind)
                where(row)[f.name] = value
                rows.append(([f"{path}{f.name}:{broken}"], row))
            if rule.get("optional"):
                row = good(kind)
                where(row)[f.name] = None
                rows.append(([], row))
            if isinstance(f.dataType, T.StructType):
                spoil(f.dataType, lambda r, n=f.name: where(r)[n], f"{path}{f.name}.")
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                spoil(f.dataType.elementType, lambda r, n=f.name: where(r)[n][0], f"{path}{f.name}[].")

    spoil(kind, lambda r: r, "")
    df = spark.createDataFrame([(i, r) for i, (_, r) in enumerate(rows)], T.StructType([T.StructField("i", T.LongType()), T.StructField("r", kind)])).select("i", "r.*")
    got = {r["i"]: r["v"] for r in df.select("i", R.violations(kind).alias("v")).collect()}
    for i, (want, _) in enumerate(rows):
        # a null list or record breaks nothing inside itself
        assert got[i] == want, (rows[i], got[i])


def test_good_rows_and_quarantine_are_written_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([("AH", 0, 50.0, 50.0, 50.0, 0.5, "correct"), ("AH", -1, 50.0, 150.0, 50.0, 0.5, "odd"), (None, 0, 0.0, 0.0, 0.0, None, None)], R.PREDICTION)
    fine, bad = R.write_validated(df, R.PREDICTION, str(tmp_path / "out"))
    assert [r["index"] for r in fine.collect()] == [0] and fine.columns == df.columns
    assert {tuple(r["violations"]) for r in bad.collect()} == {("index:range", "duration_score:range", "predicted_class:value"), ("phoneme:missing", "confidence:missing", "predicted_class:missing")}
    fine, bad = R.write_validated(df.limit(0), R.PREDICTION, str(tmp_path / "none"))
    assert fine.count() == bad.count() == 0
