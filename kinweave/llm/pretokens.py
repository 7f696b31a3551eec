"""Splitting texts into pre-tokens exactly as the public tokenizer files say, but faster.

The fast patterns are used for texts whose characters have the same class in every Unicode
version that matters; any other text is split by the tokenizer's own normalizer and pre-tokenizer."""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import regex
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the byte-level pattern of the public 50k vocabulary.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside these ranges may change class between Unicode versions.
UNUSUAL = regex.compile(r"[^\u0000-՗‐-‧‰-⁞₠-₿℀-⅏　-ヿ一-龥가-힣]")


@functools.lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def description(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Splitter:
    """segments(text): special tokens as ids, the texts between them as lists of pre-tokens (byte-level characters only if `mapped`)."""

    def __init__(self, path: str):
        spec = description(path)
        self.tokenizer = tokenizer(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        parts = spec["pre_tokenizer"].get("pretokenizers")
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"] if parts else BYTE_LEVEL)
        self.lowers = spec["normalizer"] is not None
        self.to_bytes = {c: b for b, c in enumerate(byte_chars())}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens, as plain strings."""
        if UNUSUAL.search(text):
            if self.lowers:
                text = self.tokenizer.normalizer.normalize_str(text)
            back = self.to_bytes
            return [bytes(map(back.__getitem__, w)).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if self.lowers:
            # Lower-casing goes character by character: no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def segments(self, text: str) -> list[int | list[str]]:
        if self.marks is None or "<|" not in text:
            return [self.pieces(text)]
        return [self.special[s] if i % 2 else self.pieces(s) for i, s in enumerate(self.marks.split(text))]
