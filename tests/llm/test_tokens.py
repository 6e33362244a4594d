"""Token counts and byte-level BPE against the libraries."""

from __future__ import annotations

import base64
import random

import brute
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from digestmill.llm import pretokens
from digestmill.llm.bpe import RankQueue, bpe_decode, bpe_digests, bpe_encode, codec, encoder
from digestmill.llm.token_counts import frequent_lengths, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = " \n\t'sabé0١　.!中\u0085\x1c\x00"
ODD = ["", " ", "a" * 3000, "ab" * 2000, "  x", "x  ", "don't we'll '' 's", "\n\n a \n", "x<|endoftext|>y", "ꟍₐ new letters", "日本 한국 ab"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings(count: int):
    random.seed(11)
    return ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 16))) for _ in range(count)]


def test_encoder_gives_the_library_ids(ranked):
    encode = encoder(RANKS)
    for text in [*ODD, *strings(4000)]:
        assert encode(text) == ranked.encode_ordinary(text), repr(text)
        assert codec(RANKS).decode(encode(text)) == text.encode()


def test_safe_blocks_split_alike(plain):
    """Every character that is not handed to the library whole splits as the library splits it."""
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False)
    for code in [code for code in range(0x10000) if not 0xD800 <= code < 0xE000]:
        text = f"a{chr(code)}b1{chr(code)}1 {chr(code)} !{chr(code)}!"
        if not pretokens.needs_library(text, ()):
            ends = [end for _, (_, end) in library.pre_tokenize_str(text)]
            cuts = [len(piece) for piece in pretokens.split(text)]
            assert ends == [sum(cuts[: place + 1]) for place in range(len(cuts))], hex(code)


def test_every_item_encodes_to_itself(plain):
    """The condition under which merging by rank equals merging by the library's list."""
    encode = pretokens.piece_encoder(JSON)
    for index in range(0, 50256, 7):
        text = plain.decode([index])
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_counts_follow_the_library(shared, plain):
    texts = [*ODD, *strings(800), None]
    frame = shared.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in token_counts(frame, limit=3).collect():
        text = texts[row.doc_id] or ""
        n_tokens = len(plain.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n_tokens, n_tokens > 3), repr(text)


def test_frequent_table_is_bounded_by_the_vocabulary():
    assert 40_000 < len(frequent_lengths(JSON)) <= 50_257


def test_rank_queue_order():
    random.seed(2)
    queue, pushed = RankQueue(70_000), [(random.choice([0, 5, 255, 256, 69_999, random.randrange(70_000)]), random.randrange(1000)) for _ in range(500)]
    for rank, position in pushed:
        queue.push(rank, position)
    assert [queue.pop() for _ in pushed] == sorted(pushed) and queue.top == 0


def test_round_trip(shared, odd):
    coded = bpe_encode(odd)
    texts = [row.text or "" for row in odd.collect()]
    assert sorted(bytes(row.data) for row in bpe_decode(coded).collect()) == sorted(text.encode() for text in texts)
    digests = {row.decoded_sha256 for row in bpe_digests(odd).collect()}
    assert digests == {brute.digest(text) for text in texts}
    assert bpe_digests(odd.limit(0)).count() == 0 and token_counts(odd.limit(0)).count() == 0
    assert token_counts(odd).count() == len(texts)
