import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracecast.llm import packing as p


def test_ids_are_the_tokenizers(spark):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, encode = random.Random(1), p.Encoder("byte_bpe_50k.tiktoken")
    parts = [*"ab1 .'\n\t\x1c\x85\xa0é٣　²-", "'s", " don't", "  ", "WORD", "\r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_have_the_tokenizers_ids():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, encode = random.Random(4), p.Encoder("byte_bpe_50k.tiktoken")
    parts = [*"ab1 .'<|>\n\x1c", "'s", "  ", "<|endoftext|>", "<|endoftext", "endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["<|endoftext|>", "one<|endoftext|>two", " <|endoftext|> <|endoftext|><|endoftext|>\n"]
    for text in texts + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(4000)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
    assert encode("<|endoftext|>") == (50256).to_bytes(4, "little")


def test_all_pieces_but_the_first_are_full():
    assert p.cut(1, 10) == [(0, 1)] and p.cut(10, 10) == [(0, 10)]
    assert p.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and p.cut(20, 10) == [(0, 10), (10, 10)]


def test_packing_fits_and_wastes_little():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2049, 3000), rng.integers(900, 1100, 1001), rng.lognormal(6.5, 1, 4000).clip(1, 2048).astype(int), np.array([2048, 2048, 1]), np.array([5])):
        sequence = p.pack(lengths)
        used = np.bincount(sequence, lengths)
        assert used.max() <= 2048 and (used > 0).all()
        bound = max(-(-lengths.sum() // 2048), (lengths > 1024).sum(), -(-(lengths > 2048 // 3).sum() // 2))
        assert len(used) <= bound * 1.02 + 1


def test_every_piece_has_its_place(spark):
    texts = ["one", None, "", "many words " * 3000, "one", "x" * 5000]
    docs = spark.createDataFrame([(i % 5, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, piece int, length int")
    rows = p.packed(docs, p.PackSettings(shard_rows=4)).collect()
    encode, want = p.Encoder("byte_bpe_50k.tiktoken"), []
    for i, t in enumerate(texts):
        ids = encode(t or "") + b"\0\0\0\0"
        want += [(i % 5, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(p.cut(len(ids) // 4, 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert p.packed(docs.limit(0)).collect() == []
