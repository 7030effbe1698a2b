"""A byte-level BPE tokenizer file on the executors: read once on the driver, sent as one small broadcast."""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from cadenza.llm.common import worker_cache

#: The splitting pattern of byte-level BPE files with ``use_regex`` (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level BPE files: itself if printable, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def check_byte_level(spec: dict) -> None:
    """Refuse files whose tokens aren't what splitting by PATTERN and merging bytes gives."""
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
        raise ValueError("only byte-level BPE files without a normalizer or prefix space are read")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that strip or need word ends aren't read")


class ByteBpe:
    """Ids of whole texts, equal to the ``tokenizers`` library's for the same file.

    The file's vocabulary in id order gives merge ranks, which tiktoken applies several times faster;
    where its pattern engine gives up on an odd text, ``tokenizers`` itself encodes it.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        check_byte_level(spec)
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("ids don't follow the order of merges")
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.special, self.ranks = special, ranks
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.names = set(self.special)
        self.source, self.slow = source, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=self.names), np.uint32)
        except (ValueError, RuntimeError, OverflowError):
            self.slow = self.slow or Tokenizer.from_str(self.source)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ordinary_ids(self, text: str) -> np.ndarray:
        """Ids of a text in which the strings of special tokens are plain text."""
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int64)
        except (ValueError, RuntimeError, OverflowError):
            slow = Tokenizer.from_str(self.source)
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.int64)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; a special token's are its string's."""
        known = {i: t for t, i in self.ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        return [known.get(i, b"") for i in range(max(known) + 1)]


def byte_bpe(source: str) -> ByteBpe:
    """One tokenizer per worker and file."""
    made, key = worker_cache("byte-bpe"), hash(source)
    if key not in made:
        made[key] = ByteBpe(source)
    return made[key]
