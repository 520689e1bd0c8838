"""Words and the public tokenizer, shared by the operators on texts."""

from __future__ import annotations

import base64
import functools
import os
import re

WORD = re.compile(r"[^\W_]+")
"""A word: a maximal run of letters or digits."""

TOKENIZER_DIR = os.environ.get("CHRONOMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def words(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


@functools.lru_cache(maxsize=4)
def ranks(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(directory, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoder(directory: str = TOKENIZER_DIR, name: str = VOCABULARY):
    """The byte-level encoder; loaded once per Python worker. It knows no special tokens."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(directory, name), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> list[bytes]:
    table = ranks(directory, name)
    out = [b""] * (max(table.values()) + 1)
    for b, i in table.items():
        out[i] = b
    return out


# Characters whose class in the splitting pattern is certain in every Unicode version.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~、。「」『』【】《》，．：；！？（）"
_SPACES = " \t\n\r"
_CLASS = {c: k for k, cs in (("L", _LETTERS), ("N", _DIGITS), ("P", _MARKS), ("S", _SPACES), ("Q", "'")) for c in cs}


def char_class(c: str) -> str:
    return _CLASS.get(c) or ("L" if "一" <= c <= "鿿" or "À" <= c <= "ÿ" and c not in "×÷" else "")


def is_joint(before: str, after: str) -> bool:
    """Whether the splitting pattern always separates these two neighbouring characters, whatever surrounds them.

    Every piece of the pattern ends where the class of its characters changes, except that one space leads
    the piece after it and that contractions join an apostrophe to letters. As the pattern never looks back,
    a text cut at such a place has the ids of its parts one after the other.
    """
    a, b = char_class(before), char_class(after)
    if not a or not b or a == b or a == "S":
        return False
    if a == "Q":
        return b == "S"
    return not (a == "P" and b == "Q")
