"""String and path columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.constants import OMITTED_PHONES, PHONE_SYMBOLS


def word_token(c: Column) -> Column:
    """FN-01: trimmed, lower-cased, only a-z and apostrophes kept."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z']+", "")


def strip_stress(phone: Column) -> Column:
    """FN-02: upper case without digits."""
    return F.regexp_replace(F.upper(phone), r"\d", "")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def display_symbols(phones: Column) -> Column:
    """FN-03: an array of phones as one display string; unknown phones in lower case."""
    table = literal_map(PHONE_SYMBOLS)
    return F.array_join(F.transform(phones, lambda p: F.coalesce(F.try_element_at(table, p), F.lower(p))), "")


def collapse_space(c: Column) -> Column:
    """FN-04."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"\s+", " ")


def split_of_path(path: Column) -> Column:
    """FN-05: test before validation before training, from any path part."""
    parts = F.split(F.lower(path), "/")
    has = lambda p: F.exists(parts, lambda x: x.startswith(p))
    return F.when(has("test"), "test").when(has("dev") | has("val"), "val").otherwise("train")


def file_stem(path: Column) -> Column:
    """FN-06: the file name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def speaker_of_path(path: Column) -> Column:
    """FN-06: the folder above the file's folder, else ``unknown``."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-3)), F.lit("unknown"))


def relative_path(path: Column, root: str) -> Column:
    """FN-06: below ``root`` without it, else as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def alignment_path(path: Column) -> Column:
    """FN-07: the audio path with the alignment suffix."""
    return F.regexp_replace(path, r"\.[^./]+$", ".TextGrid")


def seconds_to_ms(xmin: Column, xmax: Column) -> tuple[Column, Column]:
    """FN-08: whole milliseconds, half to even; an interval is at least one long."""
    start = F.rint(xmin * 1000).cast("int")
    return start, F.greatest(start + 1, F.rint(xmax * 1000).cast("int"))


def word_id(utterance: Column, word: Column, start_ms: Column) -> Column:
    """FN-09."""
    return F.concat_ws("__", utterance.cast("string"), word, start_ms.cast("string"))


def is_omission(pronounced: Column) -> Column:
    """FN-14: whether a pronounced phone says that nothing was said; null says nothing."""
    return F.coalesce(F.lower(F.trim(pronounced)).isin(*OMITTED_PHONES), F.lit(False))
