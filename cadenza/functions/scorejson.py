"""Human score records: nested JSON whose phone lists are strings or lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SCHEMA = "struct<text:string,accuracy:double,phones:string,`ref-phones`:string,`phones-accuracy`:array<double>,mispronunciations:array<struct<`canonical-phone`:string,index:int,`pronounced-phone`:string>>>"
SCORES_SCHEMA = f"map<string,struct<text:string,accuracy:double,words:array<{WORD_SCHEMA}>>>"


def phone_list(c: Column) -> Column:
    """A list of phones given as a JSON list or as one string with spaces; null stays null."""
    t = F.trim(c)
    items = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>")).otherwise(F.split(t, r"\s+"))
    return F.when(c.isNotNull(), F.filter(F.transform(items, F.trim), lambda p: p != ""))


def canonical_phones(word: Column) -> Column:
    """FN-15: ``phones``, else ``ref-phones``."""
    return F.coalesce(phone_list(word["phones"]), phone_list(word["ref-phones"]))


def phone_scores(word: Column) -> Column:
    """FN-16: null where the word has none."""
    return word["phones-accuracy"]


def mispronounced(word: Column) -> Column:
    """FN-17: index to pronounced phone; incomplete entries are skipped, the last of an index wins."""
    fine = F.filter(word["mispronunciations"], lambda m: m["index"].isNotNull() & m["pronounced-phone"].isNotNull())
    last = F.filter(fine, lambda m, i: ~F.exists(F.slice(fine, i + 2, F.size(fine)), lambda n: n["index"] == m["index"]))
    return F.when(word["mispronunciations"].isNotNull(), F.map_from_entries(F.transform(last, lambda m: F.struct(m["index"], m["pronounced-phone"]))))


def word_reason(word: Column) -> Column:
    """T10 in quarantine mode: why a scored word can't be used, or null."""
    phones, scores = canonical_phones(word), phone_scores(word)
    return F.when(phones.isNull(), "missing_phones").when(scores.isNull(), "missing_phone_scores").when(F.size(phones) != F.size(scores), "phone_score_length_mismatch")
