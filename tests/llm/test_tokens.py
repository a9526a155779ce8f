"""Byte BPE and token files against the libraries."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from obsloom.llm import byte_bpe, token_files

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["a", "é", "1", "²", "'s", "'ll", " ", "  ", "\n", "\r\n", "\x85", "\xa0", " ", "​", "\x1c", "\x00", "!", "…", "中", "🙂", "é", " of", "ſ", "İ", "Σ", "µ", "ZZZZ"]


def fuzz():
    rnd = random.Random(5)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 25))) for _ in range(1500)] + ["a" * 3000, " " * 900, "", "\n" * 500, "Foo. foo, FOO'S x.́"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_tiktoken_and_round_trips():
    own, texts = byte_bpe.codec(RANKS, P.PATTERN), fuzz()
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_ids(text)
        assert own.decode(ids) == text.encode()


def reference_ids(text, cache=[]):
    cache.append(reference()) if not cache else None
    return cache[0].encode_ordinary(text)


def test_bpe_operator(docs, none, rows):
    got = sorted(map(tuple, byte_bpe.digests(docs, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for d, t in rows:
        ids = reference_ids(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.digests(none, RANKS, P.PATTERN).collect() == []
    two = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((bytes(r.decoded) for r in two)) == sorted((t or "").encode() for _, t in rows)


def test_word_tables_forget_without_harm():
    own, library = token_files.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    own.words.limit = own.cores.limit = 300
    texts = fuzz()
    for i in range(0, len(texts), 100):
        for text, ids in zip(texts[i:i + 100], own.encode(texts[i:i + 100])):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files(docs, none, rows):
    library = Tokenizer.from_file(WORDS)
    manifest = token_files.write(docs, WORDS, shard_bytes=4000)
    assert manifest.count() > 5
    got = sorted(map(tuple, token_files.read(manifest).collect()), key=lambda r: r[1])
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.read(token_files.write(none, WORDS)).collect() == []


def test_elias_fano():
    rnd = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (700, 10), (700, 10**6), (3000, 1 << 40)):
        values = np.sort(rnd.integers(0, top, n)).astype(np.uint64)
        raw = token_files.EliasFano.build(values).to_bytes()
        back, end = token_files.EliasFano.from_bytes(memoryview(raw), 0)
        assert end == len(raw) and back.all().tolist() == values.tolist()
        assert [back.select(i) for i in range(0, n, 7)] == values[::7].tolist()
        if n == 3000:
            assert len(raw) < 3000 * 8 * 0.6


def test_shard_document():
    ids = np.arange(10, dtype="<u2")
    shard = token_files.Shard(token_files.pack([None, 4, 4, 9], [3, 1, 2, 4], ids.tobytes(), 2))
    assert shard.doc_ids() == [None, 4, 4, 9] and [shard.document(i).tolist() for i in range(4)] == [[0, 1, 2], [3], [4, 5], [6, 7, 8, 9]]


def test_the_older_half_of_a_word_table_is_looked_up_not_walked():
    from obsloom.llm.pieces import LONG, Pieces

    class Old(dict):
        def __iter__(self):
            raise AssertionError("walked")

    asked = []
    made = Pieces(lambda words: asked.extend(words) or {w: w.upper().encode() for w in words}, 8)
    assert made.each(["a", "b", "c", "d", "e"]) == [b"A", b"B", b"C", b"D", b"E"]
    long = "x" * (LONG + 1)
    assert made.join([["f"], ["f", long, "g"]]) == [b"F", b"F" + long.upper().encode() + b"G"] and long not in made.table
    made.old = Old(made.old)
    assert made.each(["b", "h", "b", long]) == [b"B", b"H", b"B", long.upper().encode()]
    assert asked.count("b") == 1 and asked.count(long) == 2 and long not in made.table
