"""Token counts of whole texts by a map-side two-tier lookup."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame

from digestmill.llm.pretokens import Cache, Tiers, library, needs_library, piece_encoder, special_strings, split, units
from digestmill.llm.rows import per_document, slim

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
OVER_LIMIT = 512


@lru_cache(maxsize=4)
def frequent_lengths(path: str) -> dict[str, int]:
    """Token counts of the vocabulary's own pre-tokens, the frequent ones of its language material.

    The table has at most one entry per vocabulary item, whatever the corpus: that bounds the broadcast.
    """
    tokenizer = library(path)
    pieces = {tokenizer.decode([index]) for index in range(tokenizer.get_vocab_size())}
    whole = [piece for piece in pieces if piece and "�" not in piece and split(piece) == [piece] and not needs_library(piece, special_strings(path))]
    return {piece: len(code.ids) for piece, code in zip(whole, tokenizer.encode_batch(whole, add_special_tokens=False), strict=True)}


# Lookups by vocabulary, kept as long as the worker process lives.
_lengths: dict[str, Cache] = {}


def lookup(path: str, frequent: dict[str, int]) -> Cache:
    """Token counts of stretches of text: the frequent table first, then what this worker has met."""
    encode = piece_encoder(path)
    pieces = Tiers(frequent, Cache(lambda piece: len(encode(piece))))
    return Cache(lambda unit: sum(map(pieces.__getitem__, split(unit))))


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = OVER_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``tokenizer`` is the path of a ``.json`` byte-level vocabulary. Counts are those of its library without
    added special tokens; special strings inside a text count as the library takes them. Rows never move:
    a broadcast table answers the vocabulary's pre-tokens, a worker cache the others, and only first
    meetings are encoded.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated
    results; an empty table gives none; other columns are left out.
    """
    path = tokenizer or public_tokenizers.path(DEFAULT_TOKENIZER)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def worker():
        tokenizer, specials = library(path), special_strings(path)
        lengths = _lengths.get(path) or _lengths.setdefault(path, lookup(path, shared.value))

        def count(text: str) -> tuple[int, int, bool]:
            if needs_library(text, specials):
                n_tokens = len(tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                n_tokens = sum(map(lengths.__getitem__, units(text)))
            return len(text.encode()), n_tokens, n_tokens > limit

        return count

    return per_document(slim(docs, id_col, text_col), "n_bytes long, n_tokens long, over_limit boolean", worker)
