"""Encoding by the last tokens of prefixes, against the sentencepiece library."""
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from obsloom.llm import byte_bpe, prefix_tokens

MODEL = P.path("piece_bpe_32k.model")
ODD = ["a", "b", "th", "the", " ", "  ", "▁", "\n", "\t", "é", "中", "文", "🙂", "\x00", "ing", "aa", "00", "(", "=", "==", "</s>", "<s>", "　", "ſ", "x", "<0x41>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def fuzz(seed=5):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    return texts + ["a" * 3000, " " * 900, "", "中" * 500, "==" * 301, "\n " * 99, "".join(rnd.choice("abcdéé中=") for _ in range(300_000))]


def test_codec_equals_the_library(library):
    own, texts = prefix_tokens.codec(MODEL), fuzz()
    for text, raw in zip(texts, own.encode(texts)):
        assert ids(raw) == [1, *library.encode(text), 2]
        assert own.decode(raw) == library.decode([1, *library.encode(text), 2])


def test_every_prefix_has_the_last_token_of_its_own_encoding(library):
    own, text = prefix_tokens.codec(MODEL), "▁the▁unhappiness▁=====▁aaaa中▁▁▁▁▁x"
    last, states = [-1], [own.matcher.root]
    own.extend(last, states, text)
    for n in range(1, len(text) + 1):
        pieces = library.encode(text[1:n], out_type=str)
        if last[n] >= 0 and pieces:
            assert own.tokens[last[n]] == pieces[-1]


def test_bounded_tables_forget_without_harm(library, monkeypatch):
    own, texts = prefix_tokens.PrefixCodec(MODEL), fuzz(6)[:1500]
    monkeypatch.setattr(prefix_tokens, "PAIRS", 50)
    own.words.limit, own.matcher.left = 100, 20
    for i in range(0, len(texts), 100):
        for text, raw in zip(texts[i:i + 100], own.encode(texts[i:i + 100])):
            assert ids(raw) == [1, *library.encode(text), 2]


def small_model(tmp_path, pieces, prefix, name):
    """A model without byte pieces: unknown characters, pieces across words, pieces that no merge reaches, equal scores."""
    field = byte_bpe._field
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in special + [(p, s, 1) for p, s in pieces])
    body += field(2, field(3, 2) + field(40, 0) + field(41, 1) + field(42, 2))
    body += field(3, field(1, b"identity") + field(3, prefix) + field(4, 0) + field(5, 1))
    path = tmp_path / name
    path.write_bytes(body)
    return str(path)


@pytest.mark.parametrize("prefix", [0, 1])
def test_other_models(tmp_path, prefix):
    rnd = random.Random(prefix)
    for trial in range(40):
        pieces = {c: -50.0 for c in "abc▁"}
        for _ in range(rnd.randint(2, 14)):
            pieces["".join(rnd.choice("abcd▁") for _ in range(rnd.randint(2, 5)))] = -float(rnd.randint(0, 6))  # scores in any order, many equal
        path = small_model(tmp_path, pieces.items(), prefix, f"{trial}.model")
        library, own = sentencepiece.SentencePieceProcessor(model_file=path), prefix_tokens.PrefixCodec(path)
        texts = ["".join(rnd.choice("aabbcd z") for _ in range(rnd.randint(0, 14))) for _ in range(150)]
        for text, raw in zip(texts, own.encode(texts)):
            assert ids(raw) == [library.bos_id(), *library.encode(text), library.eos_id()], (pieces, text)


def test_operator(docs, none, rows, library):
    got = sorted(map(tuple, prefix_tokens.digests(docs, MODEL).collect()), key=str)
    want = []
    for d, t in rows:
        full = [1, *library.encode(t or ""), 2]
        want.append((d, len(full), hashlib.sha256(np.array(full, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(full).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert prefix_tokens.digests(none, MODEL).collect() == []
    two = prefix_tokens.decode(prefix_tokens.encode(docs, MODEL), MODEL).collect()
    assert sorted(r.decoded for r in two) == sorted(library.decode([1, *library.encode(t or ""), 2]) for _, t in rows)
