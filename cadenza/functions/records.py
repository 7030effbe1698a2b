"""FN-26: the record types of the corpus and their rules, carried in schema metadata and compiled to columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the records.
SPLITS, PHONE_CLASSES, ALIGNERS, ENCODERS = "train|val|test", "correct|accented|wrong_or_missed", "mfa|custom_ctc|manual", "hubert|wav2vec2|fallback"
QUALITY, STATUS = "ok|low_confidence|rejected", "ok|low_match|too_short|too_long|weak|possibly_missing|late_start"

KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def record(**fields: str | T.DataType) -> T.StructType:
    """A record type; a field is a type, or ``type [?] [low..high] [a|b|c]``: null allowed, a range with either end open, an enumeration."""
    out = []
    for name, spec in fields.items():
        if isinstance(spec, T.DataType):
            out.append(T.StructField(name, spec, True, {"rule": json.dumps({})}))
            continue
        kind, *rest = spec.split(" ")
        rule: dict = {}
        for x in rest:
            if x == "?":
                rule["optional"] = True
            elif ".." in x:
                rule["low"], rule["high"] = (float(y) if y else None for y in x.split(".."))
            else:
                rule["values"] = x.split("|")
        out.append(T.StructField(name, KINDS[kind], True, {"rule": json.dumps(rule)}))
    return T.StructType(out)


# Fields, bounds and enumerations of the record types.
PREPARED = record(utterance_id="string", speaker_id="string", dataset="string", split=f"string {SPLITS}", text="string", normalized_text="string", audio_path="string", transcript_path="string ?")
PHONE_LABEL = record(
    phoneme="string", index="int 0..", start_ms="int 0..", end_ms="int 0..", pronunciation_class=f"string {PHONE_CLASSES}", human_score="double 0..2", omission_label="boolean ?", pronounced_phone="string ?",
)
ALIGNED = record(
    utterance_id="string", speaker_id="string", dataset="string", split=f"string {SPLITS}", accent_target="string ? en-US", target_word="string", canonical_phones="array<string>", ipa="string", audio_path="string",
    sample_rate="int ? 1..", duration_ms="int 0..", audio_quality="map<string,string>", alignment_source=f"string {ALIGNERS}", phone_labels=T.ArrayType(PHONE_LABEL),
)
FEATURE = record(
    utterance_id="string", speaker_id="string", dataset="string", split=f"string {SPLITS}", target_word="string", accent_target="string ? en-US", phoneme="string", index="int 0..", prev_phoneme="string ?", next_phoneme="string ?",
    frame_count="int 1..", backbone_id="string", embedding_source=f"string {ENCODERS}", mean_embedding="array<double>", variance="double 0..", duration_ms="int 0..", duration_z_score="double", alignment_confidence="double 0..1",
    energy_mean="double 0..", pronunciation_class=f"string {PHONE_CLASSES}", human_score="double 0..2", regression_target="double 0..100", omission_target="int 0..1",
)
PREDICTION = record(phoneme="string", index="int 0..", match_score="double 0..100", duration_score="double 0..100", presence_score="double 0..100", confidence="double 0..1", predicted_class=f"string {PHONE_CLASSES}")
AUDIO_QUALITY = record(status=f"string {QUALITY}", snr_estimate="double 0..", duration_ms="int 0..", rms="double 0..", clipping_ratio="double 0..1", silence_ratio="double 0..1")
ASSESSED_PHONE = record(phoneme="string", start_ms="int 0..", end_ms="int 0..", match_score="int 0..100", duration_score="int 0..100", presence_score="int 0..100", confidence="double 0..1", status=f"string {STATUS}")
PRIMARY_ISSUE = record(phoneme="string", type="string", message="string")
REFERENCE_AUDIO = record(ipa="string", audio_id="string", asset_path="string ?")
ASSESSMENT = record(
    word="string", accent_target="string ? en-US", ipa="string", overall_score="int 0..100", confidence="double 0..1", audio_quality=AUDIO_QUALITY, phonemes=T.ArrayType(ASSESSED_PHONE), primary_issue=PRIMARY_ISSUE, reference=REFERENCE_AUDIO,
)


def broken_rules(schema: T.StructType, get=F.col, path: str = "") -> dict[str, Column]:
    """Rule names, such as ``split:value`` or ``phone_labels[].human_score:range``, to whether a row breaks them.

    A null that isn't allowed, also inside a list of records, is ``missing``; NaN is outside every range.
    """
    out: dict[str, Column] = {}
    for f in schema:
        c, name, rule = get(f.name), path + f.name, json.loads(f.metadata.get("rule", "{}"))
        if not rule.get("optional"):
            out[f"{name}:missing"] = c.isNull()
        if rule.get("low") is not None or rule.get("high") is not None:
            low, high = rule.get("low"), rule.get("high")
            bad = (c < low) if low is not None else F.lit(False)
            bad = bad | (c > high) if high is not None else bad
            out[f"{name}:range"] = bad | F.isnan(c.cast("double"))
        if rule.get("values"):
            out[f"{name}:value"] = ~c.isin(*rule["values"])
        if isinstance(f.dataType, T.StructType):
            out |= {k: c.isNotNull() & bad for k, bad in broken_rules(f.dataType, c.getField, f"{name}.").items()}
        if isinstance(f.dataType, T.ArrayType):
            item = f.dataType.elementType
            if isinstance(item, T.StructType):
                out |= {k: _any(c, item, name, k) for k in broken_rules(item, F.col, f"{name}[].")}
    return out


def _any(c: Column, item: T.StructType, name: str, rule: str) -> Column:
    """Whether any record of a list breaks the rule."""
    return F.exists(c, lambda x: F.coalesce(broken_rules(item, x.getField, f"{name}[].")[rule], F.lit(False)))


def violations(schema: T.StructType) -> Column:
    """The names of the rules that a row breaks, in the order of its fields."""
    marks = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in broken_rules(schema).items()])
    return F.filter(marks, lambda x: x.isNotNull())


def write_validated(df: DataFrame, schema: T.StructType, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a record type to ``path`` in one pass, the broken ones apart with their ``violations``; returns (good, quarantined) as they read back."""
    d = df.withColumn("violations", violations(schema)).withColumn("quarantined", F.size("violations") > 0)
    d.write.partitionBy("quarantined").parquet(path)
    back = df.sparkSession.read.schema(d.schema).parquet(path)
    return back.where(~F.col("quarantined")).drop("violations", "quarantined"), back.where("quarantined").drop("quarantined")
