"""Pre-tokens of byte-level vocabularies and what a worker remembers about them.

A text is split by the public pattern into pre-tokens, and each is encoded on its own, so the ids of a
pre-token never depend on its neighbours. Workers therefore look pre-tokens up and ask the tokenizer
library only for those they have not met.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import public_tokenizers
import regex

# Entries a worker cache holds before it starts afresh: about 200 MB at ordinary word lengths.
CACHE_ENTRIES = 1_000_000
# Longer pre-tokens are encoded each time: they hardly repeat and would fill the cache.
CACHED_CHARS = 64

split = regex.compile(public_tokenizers.PATTERN).findall

# Blocks in which the pattern engine of the tokenizer library and that of ``regex`` know the same letters,
# numbers and spaces. They follow different Unicode editions elsewhere; a text with any other character is
# given to the library whole. tests/llm/test_tokens.py compares every character of these blocks.
_other = re.compile("[^\u0000-ԯḀ-ỿ -⁤₠-₿℀-↋　-ヿ一-龥가-힣]").search


# A space or line break before another white space, or the mark used for cutting.
_not_cut = re.compile(r"[ \n]\s|\0").search


def units(text: str) -> list[str]:
    """The text in stretches of whole pre-tokens: words with the one space or line break before them.

    The pattern always starts a pre-token at a space or line break that stands alone, so cutting there
    changes none. Texts with other white space runs are cut by the pattern itself.
    """
    if _not_cut(text):
        return split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of a ``.json`` file, once per process, on one thread."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as file:
        return tuple(token["content"] for token in json.load(file)["added_tokens"])


def needs_library(text: str, specials: tuple[str, ...]) -> bool:
    """True where pre-token by pre-token encoding could differ from encoding the whole text."""
    return any(special in text for special in specials) or (not text.isascii() and _other(text) is not None)


def piece_encoder(path: str):
    """Ids of a string that ``needs_library`` lets pass, by the vocabulary of a ``.json`` file.

    The library's merges make every vocabulary item out of its own bytes, so merging by the rank of the
    merged string, as the other installed library does faster, gives the same ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (byte for byte in range(256) if byte not in set(shown))
    byte_of = {chr(byte): byte for byte in shown} | {chr(256 + place): byte for place, byte in enumerate(hidden)}
    ranks = {bytes(map(byte_of.__getitem__, token)): index for token, index in vocabulary.items() if token not in special_strings(path)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


class Cache(dict):
    """What a worker has met, starting afresh when full; ``encode`` answers the first time."""

    def __init__(self, encode, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode = encode
        self.entries = entries

    def __missing__(self, piece: str):
        value = self.encode(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = value
        return value


class Tiers(dict):
    """A fixed table of frequent pre-tokens before a worker cache."""

    def __init__(self, frequent: dict, cache: Cache):
        super().__init__(frequent)
        self.cache = cache

    def __missing__(self, piece: str):
        return self.cache[piece]
