"""Byte-level BPE from a public vocabulary file, and the splitting of texts that caches share."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken

#: The vocabulary files' pre-token pattern, a fixed value of that tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of Latin letters only: one pre-token without a look at the pattern.
PLAIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+").fullmatch


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: ``ranks`` (bytes to id, ids in merge order) and the added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.merges = [(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in merges]
        ids = [self.ranks[a + b] for a, b in self.merges]
        if ids != sorted(ids) or data.get("normalizer") or data["pre_tokenizer"].get("type") != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a byte-level BPE whose ids follow its merges")
        self.bytes_of = {i: b for b, i in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at added tokens: (text, its id if it is one)."""
        if self.cut is None or not self.cut.search(text):
            return [(text, None)]
        return [(p, self.special.get(p)) for p in self.cut.split(text) if p]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def pretokens() -> Callable[[str], list[str]]:
    return regex.compile(PATTERN).findall


class Cache(dict):
    """Values by word.  It is emptied when ``limit`` words are in it, so its memory is bounded; common words are
    back at once.  Long words are not kept."""

    def __init__(self, make: Callable, limit: int = 150_000, longest: int = 48):
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def parts(text: str) -> tuple[str, list[str]] | None:
    """The text up to its first space, and what stands between later spaces: with its space in front, each
    is encoded by itself as it is in place.  None where two spaces meet, as they may form one pre-token."""
    if "  " in text:
        return None
    first, *rest = text.split(" ")
    return first, rest


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, equal to what the tokenizers library gives."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.vocabulary.ranks, special_tokens={})._core_bpe
        self.plain = lambda text: bytes(core.encode_to_tiktoken_buffer(text, set()))

    def __call__(self, text: str) -> bytes:
        return b"".join(self.plain(p) if i is None else i.to_bytes(4, "little") for p, i in self.vocabulary.pieces(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
