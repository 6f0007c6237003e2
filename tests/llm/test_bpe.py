"""Encoding against the tiktoken library and against plain merging; decoding against Python's decoder."""

import gc
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from loomspark.llm import bpe

RANKS = bpe.load_ranks(bpe.default_vocabulary()[0])
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "Hello, world!", "don't\n\n  stop\t", "naïve façade — 東京 🙂 ​", "a" * 5000, " \n" * 300, "'s're" * 9, "0123456789" * 40]


def test_pieces_match_plain_merging():
    own, rng, entries = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), random.Random(3), list(RANKS)
    for k in range(3000):
        piece = b"".join(rng.choice(entries) for _ in range(rng.randint(1, 5))) if k % 2 else rng.randbytes(rng.randint(1, 20))
        own.encode_piece(piece, got := [])
        assert got == ([RANKS[piece]] if piece in RANKS else own.merge(piece)), piece


def test_texts_match_library_even_with_tiny_tables():
    for own in (bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), bpe.ByteBpe(RANKS, public_tokenizers.PATTERN, 5, 3)):
        for text in TEXTS:
            assert own.encode(text) == LIBRARY.encode_ordinary(text)


def test_dropped_states_are_freed_at_once():
    def states():
        return sum(type(x) is bpe._State for x in gc.get_objects())

    rng = random.Random(11)
    texts = ["".join(chr(rng.randrange(97, 123)) for _ in range(rng.randint(20, 60))) for _ in range(400)]
    own = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN, max_states=500)
    gc.collect()
    gc.disable()  # in a worker the collector seldom looks at old objects
    try:
        before = states()
        for text in texts:
            assert own.encode(text) == LIBRARY.encode_ordinary(text)
            assert states() - before <= 500
    finally:
        gc.enable()


def test_table_of_states_is_bounded_inside_one_piece():
    rng = random.Random(12)
    text = "".join(chr(rng.randrange(97, 123)) for _ in range(20_000))
    own = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN, max_states=500)
    assert own.encode(text) == LIBRARY.encode_ordinary(text)
    assert len(own.states) <= 500


def test_decoder_streams_and_replaces():
    tokens = {v: k for k, v in RANKS.items()}
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.randrange(len(tokens)) for _ in range(rng.randint(0, 8))]
        decoder = bpe.Utf8Decoder(tokens)
        streamed = "".join(decoder.feed([t]) for t in ids) + decoder.close()
        assert streamed == b"".join(tokens[t] for t in ids).decode("utf-8", errors="replace")


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, None), (1, " ", "x"), (None, "word", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.digests(df).collect(), key=str)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        assert by_id[i].n_tokens == len(ids)
        assert by_id[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert bpe.encode(df.limit(0)).count() == 0
