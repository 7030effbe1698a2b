"""Words and phones from alignment intervals: tier choice, containment, zips and the cascade of reasons."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import scorejson as J
from cadenza.functions import text as X
from cadenza.functions.constants import SILENCE_LABELS
from cadenza.sources.files import NO_TIER


def pick_tier(tiers: DataFrame, file: str, tier: str, preferred: str, fallbacks: tuple[str, ...] = ()) -> DataFrame:
    """SRC-11: one tier per file: the preferred name, then the fallbacks, then any of them without regard to case."""
    names = [preferred, *fallbacks]
    rank = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        rank = F.when(F.lower(tier) == n.lower(), len(names) + i).otherwise(rank)
    for i, n in reversed(list(enumerate(names))):
        rank = F.when(F.col(tier) == n, i).otherwise(rank)
    best = tiers.withColumn("__rank", rank).groupBy(file).agg(F.min_by(tier, F.struct(F.coalesce("__rank", F.lit(1 << 30)), tier)).alias("__t"), F.min("__rank").alias("__best"))
    return best.select(file, F.when(F.col("__best").isNotNull(), F.col("__t")).alias(tier), F.when(F.col("__best").isNull(), "missing_tier").alias("reason"))


def is_silence_native(label: Column) -> Column:
    """FLT-02, native form: digits stripped and lower-cased before the lookup, so <eps> is silence."""
    return F.regexp_replace(F.lower(F.trim(label)), r"\d", "").isin(*SILENCE_LABELS)


def is_silence_scored(label: Column) -> Column:
    """FLT-01 and the scored form of FLT-02: normalised first, so <eps> becomes eps and is not silence."""
    return X.word_token(label).isin(*SILENCE_LABELS)


def contained(phones: DataFrame, words: DataFrame, key: str, width: float = 1.0) -> DataFrame:
    """JN-07: phones inside a word, both ends closed.

    Time is cut into buckets of ``width`` seconds: a phone is in the bucket of its start, a word in all
    that it touches, so the join is an equi-join on (key, bucket) with a small residual, however long an
    utterance is. Each pair meets in one bucket only.
    """
    p = phones.withColumn("__bucket", F.floor(F.col("xmin") / width)).alias("p")
    w = words.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("xmin") / width), F.floor(F.col("xmax") / width)))).alias("w")
    on = (F.col(f"p.{key}") == F.col(f"w.{key}")) & (F.col("p.__bucket") == F.col("w.__bucket")) & (F.col("p.xmin") >= F.col("w.xmin")) & (F.col("p.xmax") <= F.col("w.xmax"))
    return w.join(p, on).select(*[F.col(f"w.{c}") for c in words.columns], F.col("p.xmin").alias("p_xmin"), F.col("p.xmax").alias("p_xmax"), F.col("p.label").alias("p_label"))


def tier_of(tiers: Column, preferred: str, fallbacks: tuple[str, ...] = ()) -> Column:
    """SRC-11 within a file's tiers: the intervals of the preferred name, then of the fallbacks, then of any of them without regard to case; null if there is none."""
    names = [preferred, *fallbacks]
    of = lambda as_read, n: F.get(F.filter(tiers, lambda t: as_read(t["name"]) == n), F.lit(0))["intervals"]
    return F.coalesce(*[of(lambda c: c, n) for n in names], *[of(F.lower, n.lower()) for n in names])


def containment(words: np.ndarray, phones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, phone) of every phone inside a word, both ends closed, in the order of words and then of phones.

    ``words`` and ``phones`` are (n, 2) bounds. A sweep: each phone meets the words that are open where it begins,
    the last that began first; it goes on to earlier ones only while one of these still reaches its end.
    """
    order = np.argsort(words[:, 0], kind="stable")
    begin, end = words[order, 0], words[order, 1]
    reach = np.maximum.accumulate(end) if len(end) else end
    phone = np.arange(len(phones))
    at = np.searchsorted(begin, phones[:, 0], "right") - 1
    found = []
    while len(phone):
        phone, at = phone[at >= 0], at[at >= 0]
        going = reach[at] >= phones[phone, 1]
        phone, at = phone[going], at[going]
        inside = end[at] >= phones[phone, 1]
        found.append(np.column_stack([order[at[inside]], phone[inside]]))
        at = at - 1
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[:, 0], pairs[:, 1]


#: Intervals that a sweep handles at a time.
SWEEP_INTERVALS = 1 << 18


def _apart(*tiers: tuple[np.ndarray, pa.StructArray]) -> list[np.ndarray]:
    """Bounds as whole numbers in the same order, those of a row below those of the next, so that one sweep serves many rows. An unknown bound holds nothing and is in nothing."""
    bounds = [np.column_stack([x.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1)]) for _, x in tiers]
    values, rank = np.unique(np.concatenate(bounds), return_inverse=True)
    words, phones = np.split(rank.reshape(-1, 2), [len(bounds[0])])
    words, phones = (r + row[:, None] * (len(values) + 1) for r, (row, _) in zip((words, phones), tiers))
    words[np.isnan(bounds[0]).any(axis=1), 1] = -1
    phones[np.isnan(bounds[1]).any(axis=1), 1] = np.iinfo(np.int64).max
    return [words, phones]


def silent_native(label: str) -> bool:
    """``is_silence_native`` of a phone's label."""
    return re.sub(r"[0-9]", "", label.strip(" ").lower()) in SILENCE_LABELS


def silent_scored(label: str) -> bool:
    """``is_silence_scored`` of a phone's label."""
    return re.sub(r"[^a-z']+", "", label.strip(" ").lower()) in SILENCE_LABELS


def sweep(utterances: DataFrame, words: str, phones: str, silent: Callable[[str], bool]) -> DataFrame:
    """JN-07 for utterances that hold their word and phone intervals as arrays: a row for each word, without a shuffle.

    A row keeps the other columns of its utterance, with ``pos``, ``xmin``, ``xmax``, ``label`` and ``phones``, the intervals
    inside it that aren't silent, in the order of the tier, their labels in upper case without stress. Arrays that are null have no words.
    """
    own = [c for c in utterances.columns if c not in (words, phones)]
    interval = "struct<xmin:double,xmax:double,label:string>"
    made = {"pos": "int", "xmin": "double", "xmax": "double", "label": "string", "phones": f"array<{interval}>"}
    schema = utterances.select(*own, *[F.lit(None).cast(t).alias(c) for c, t in made.items()]).schema
    sizes = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def swept(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, p = batch.column(len(own)), batch.column(len(own) + 1)
        row, of_row = (np.repeat(np.arange(batch.num_rows), sizes(x)) for x in (w, p))
        first = np.cumsum(sizes(w)) - sizes(w)
        w, p = w.flatten(), p.flatten()
        known = p.field(2).dictionary_encode()
        names = known.dictionary.to_pylist()
        heard = np.array([x is not None and not silent(x) for x in names] + [False])
        said = pa.array([re.sub(r"[0-9]", "", (x or "").upper()) for x in names], pa.string()).take(known.indices)
        kept = heard[known.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
        p = pa.StructArray.from_arrays([p.field(0), p.field(1), said], names=["xmin", "xmax", "label"]).filter(pa.array(kept))
        at, of = containment(*_apart((row, w), (of_row[kept], p)))
        offsets = pa.array(np.searchsorted(at, np.arange(len(w) + 1)), pa.int32())
        pos = pa.array(np.arange(len(w)) - first[row], pa.int32())
        mine = pa.array(row)
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(mine) for i in range(len(own))), pos, *(w.field(i) for i in range(3)), pa.ListArray.from_arrays(offsets, p.take(pa.array(of)))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(sum(sizes(batch.column(len(own) + i)) for i in (0, 1)))
            begin = 0
            while begin < batch.num_rows:  # rows of some SWEEP_INTERVALS intervals at a time, one at least
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SWEEP_INTERVALS, "right")))
                made = swept(batch.slice(begin, end - begin))
                if made.num_rows:
                    yield made
                begin = end

    return utterances.select(*own, F.col(words).cast(f"array<{interval}>"), F.col(phones).cast(f"array<{interval}>")).mapInArrow(run, schema)


def zip_positions(df: DataFrame, a: str, b: str) -> DataFrame:
    """JN-08: rows of two arrays side by side by position; arrays of unequal length give the row's ``reason`` instead."""
    return df.where(F.size(a) == F.size(b)).select("*", F.posexplode(F.arrays_zip(a, b)).alias("pos", "pair"))


def label_spans(phones: DataFrame, frame_ms: float, key: str = "utterance_id") -> DataFrame:
    """WN-09: label times to frame spans, with the z of their length against the expected share.

    ``phones`` has start_ms, end_ms and total_frames; the share is of total_frames, so its scope
    (whole audio or word) is the caller's choice of that column. No frames count as one, and frames
    last a millionth of a millisecond at least.
    """
    frame_ms = max(frame_ms, 1e-6)
    n, w = F.greatest(F.lit(1), F.col("total_frames")), L.duration_weight(F.col("phoneme"))
    whole = Window.partitionBy(key).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one order, one sum
    d = phones.withColumn("w", w).withColumn("ws", F.sum("w").over(whole))
    d = d.withColumn("start", F.greatest(F.lit(0), F.least(n - 1, F.floor(F.col("start_ms") / frame_ms))).cast("int"))
    d = d.withColumn("end", F.least(n, F.greatest(F.col("start") + 1, F.ceil(F.col("end_ms") / frame_ms))).cast("int"))
    x = F.greatest(F.lit(1.0), n * F.col("w") / F.col("ws"))
    return d.withColumn("z", F.round((F.greatest(F.lit(1), F.col("end") - F.col("start")) - x) / F.greatest(F.lit(1.0), 0.35 * x), 3) + 0.0)


def utterance_reasons(scored: bool) -> dict[str, Column]:
    """FLT-05 at the grain of utterances: rules in order, on columns there, error, words, phones and, if ``scored``, entry, score_words and said."""
    rules = {"missing_score_entry": F.col("entry").isNull()} if scored else {}
    rules |= {"missing_textgrid": F.col("there").isNull(), "broken_textgrid": F.col("error") != NO_TIER, "missing_tier": F.col("words").isNull() | F.col("phones").isNull()}
    if scored:
        rules |= {
            "missing_words": F.col("score_words").isNull(),
            "word_count_mismatch": F.size("score_words") != F.size("words"),
            "word_identity_mismatch": F.transform("score_words", lambda w: X.word_token(w["text"])) != F.transform("words", lambda w: X.word_token(w["label"])),
        }
    return rules


def word_reasons(scored: bool = False, min_word_ms: int = 80) -> dict[str, Column]:
    """FLT-05 at the grain of words: rules in order, on columns word, start_ms, end_ms, said (phones heard), canonical and, if ``scored``, score."""
    rules = {"skip_word_label": F.col("word").isin(*SILENCE_LABELS)}
    if scored:
        rules |= {"missing_phones": F.col("canonical").isNull(), "missing_phone_scores": J.phone_scores(F.col("score")).isNull(), "phone_score_length_mismatch": F.size("canonical") != F.size(J.phone_scores(F.col("score")))}
    else:
        rules |= {"missing_cmudict": F.col("canonical").isNull()}
    rules |= {"too_short": F.col("end_ms") - F.col("start_ms") < min_word_ms, "phone_count_mismatch": F.size("said") != F.size("canonical")}
    return rules if scored else rules | {"phone_identity_mismatch": F.col("said") != F.col("canonical")}


LABEL = "struct<phoneme:string,index:int,start_ms:int,end_ms:int,pronunciation_class:string,human_score:double,omission_label:boolean,pronounced_phone:string>"


def artifacts(words: DataFrame, dataset: str, source: str, scored: bool, sample_rate: int, min_word_ms: int) -> DataFrame:
    """Words with their phones (``sweep``), ``canonical`` and, if scored, ``score``, as aligned rows: labels of those that pass, a reason for the others."""
    start, end = X.seconds_to_ms(F.col("xmin"), F.col("xmax"))
    d = words.withColumns({"start_ms": start, "end_ms": end, "said": F.col("phones.label")})
    d = d.withColumn("reason", L.first_reason(word_reasons(scored, min_word_ms)))

    def label(p: Column, i: Column) -> Column:
        a, b = X.seconds_to_ms(p["xmin"], p["xmax"])
        phone = F.get("canonical", i)
        score = F.get(J.phone_scores(F.col("score")), i) if scored else F.lit(2.0)
        spoken = F.try_element_at("mispronounced", i) if scored else phone
        omitted = X.is_omission(spoken) if scored else F.lit(False)
        return F.struct(phone.alias("phoneme"), i.alias("index"), a.alias("start_ms"), b.alias("end_ms"), L.class_of_human_score(score).alias("pronunciation_class"), score.alias("human_score"), omitted.alias("omission_label"), spoken.alias("pronounced_phone"))

    if scored:
        d = d.withColumn("mispronounced", J.mispronounced(F.col("score")))
    passed = F.col("reason").isNull()
    return d.select(
        "utterance_id", "speaker_id", "split", "audio_path", "pos", "reason", F.when(passed, X.word_id(F.col("utterance_id"), F.col("word"), F.col("start_ms"))).alias("artifact_id"),
        F.lit(dataset).alias("dataset"), F.col("word").alias("target_word"), F.lit("en-US").alias("accent_target"), F.col("canonical").alias("canonical_phones"), X.display_symbols(F.col("canonical")).alias("ipa"),
        F.lit(sample_rate).alias("sample_rate"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.create_map(F.lit("status"), F.lit("ok"), F.lit("source"), F.lit(source)).alias("audio_quality"),
        F.lit("mfa").alias("alignment_source"), F.when(passed, F.transform("phones", label)).cast(f"array<{LABEL}>").alias("phone_labels"),
    )


def aligned_native(utterances: DataFrame, lexicon: DataFrame, dataset: str = "libritts", sample_rate: int = 16_000, min_word_ms: int = 80) -> DataFrame:
    """JOB-04 from ``utterances`` (``with_tiers``): a row for each word, and one with its reason for each utterance that has none.

    ``lexicon`` (word, lexicon_phones) joins by word; Spark broadcasts it where it is small.
    """
    u = utterances.withColumn("reason", L.first_reason(utterance_reasons(False)))
    good = u.where(F.col("reason").isNull()).select("utterance_id", "speaker_id", "split", "audio_path", "words", "phones")
    w = sweep(good, "words", "phones", silent_native).withColumn("word", X.word_token(F.col("label")))
    w = w.join(lexicon.select("word", F.col("lexicon_phones").alias("canonical")), "word", "left")
    return _with_rejected(artifacts(w, dataset, f"native_{dataset}", False, sample_rate, min_word_ms), u)


def aligned_scored(utterances: DataFrame, scores: DataFrame, dataset: str = "speechocean762", sample_rate: int = 16_000, min_word_ms: int = 80) -> DataFrame:
    """JOB-05 from ``utterances`` (``with_tiers``) and ``scores`` (utterance_id, entry): as JOB-04, words and phones scored by people.

    Words that are silence and score words without letters don't count; those left must be the same on both sides.
    """
    u = utterances.join(scores, "utterance_id", "left")
    u = u.withColumn("words", F.filter("words", lambda w: ~is_silence_scored(w["label"])))
    u = u.withColumn("score_words", F.filter("entry.words", lambda w: F.coalesce(X.word_token(w["text"]), F.lit("")) != ""))
    u = u.withColumn("reason", L.first_reason(utterance_reasons(True)))
    good = u.where(F.col("reason").isNull()).select("utterance_id", "speaker_id", "split", "audio_path", "score_words", "words", "phones")
    w = sweep(good, "words", "phones", silent_scored).withColumn("score", F.get("score_words", F.col("pos"))).drop("score_words")
    w = w.withColumn("word", X.word_token(F.col("score.text"))).withColumn("canonical", F.transform(J.canonical_phones(F.col("score")), X.strip_stress))
    return _with_rejected(artifacts(w, dataset, dataset, True, sample_rate, min_word_ms), u)


def _with_rejected(words: DataFrame, utterances: DataFrame) -> DataFrame:
    bad = utterances.where(F.col("reason").isNotNull()).select("utterance_id", "speaker_id", "split", "audio_path", "reason")
    return words.unionByName(bad, allowMissingColumns=True)


def with_tiers(prepared: DataFrame, tiers: DataFrame, root: str, word_tier: str = "words", phone_tier: str = "phones") -> DataFrame:
    """JN-04: prepared utterances with the words and phones of their alignment file below ``root``, named after their audio; ``there`` is null without one."""
    found = tiers.select(X.relative_path(F.regexp_replace("path", "^file:/+", "/"), re.sub("^file:/+", "/", root)).alias("__file"), "tiers", "error", F.lit(True).alias("there"))
    d = prepared.withColumn("__file", X.alignment_path(F.col("audio_path"))).join(found, "__file", "left")
    return d.select("utterance_id", "speaker_id", "split", "audio_path", "there", "error", tier_of(F.col("tiers"), word_tier, ("word",)).alias("words"), tier_of(F.col("tiers"), phone_tier, ("phone",)).alias("phones"))
