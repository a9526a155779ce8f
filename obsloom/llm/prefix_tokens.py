"""Sentencepiece BPE encoding by a table of the last token of every prefix.

Merging is decided pair by pair: a sequence of tokens is the encoding of its text exactly when no two neighbours would have merged
across their border. So each prefix has one last token, found among the automaton's matches that end there by asking whether it goes
together with the last token of the prefix before it. The ids follow backwards from the end. Linear in the text, whatever its length."""
from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .layout import slices, texts
from .pieces import Pieces

MARK = "▁"
PAIRS = 400_000


def _fields(raw: bytes):
    """(field number, value) of a protocol buffer message: integers, or bytes for everything that has a length."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i, value, shift = i + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, raw[i:i + size]
        i += size


class Merges:
    """What a vocabulary merges: the best-scored pair first, the leftmost of equal ones, until no pair is a piece."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores

    def run(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Final tokens of a short text; and for each merge its score with the first and the last token after it."""
        parts, log, get = list(text), [], self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            log.append((best, parts[0], parts[-1]))
        return parts, log

    def apart(self, left: str, left_log: list, right: str, right_log: list) -> bool:
        """True if two tokens side by side never merge across their border. Both histories run in the order in which one queue would
        take them (of equal scores the leftmost), and a pair across the border may come before the next merge of either side."""
        x, y, i, j, get = left[-1], right[0], 0, 0, self.scores.get
        while True:
            a = left_log[i][0] if i < len(left_log) else None
            b = right_log[j][0] if j < len(right_log) else None
            across = get(x + y)
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or a is not None and a >= b:
                x, i = left_log[i][2], i + 1
            else:
                y, j = right_log[j][1], j + 1


class Matcher:
    """All tokens that end at each character: a trie with failure links whose missing steps are filled in when a text first takes them.

    A state is a dict from a character to the next state; under None stand the tokens of two and more characters that end there, longest
    first, each with its length and a note of the caller's; under 1 the character as a token, -1 if it is none; under 0 the state of the
    longest proper suffix."""

    def __init__(self, tokens: list[str], notes: list, limit: int = 1_000_000):
        self.root, self.left = {None: (), 1: -1}, limit
        for number, token in enumerate(tokens):
            state = self.root
            for letter in token:
                state = state.setdefault(letter, {None: ()})
            if len(token) > 1:
                state[None] = ((number, len(token), notes[number]),)
            else:
                state[1] = number
        level = [(self.root, letter, state) for letter, state in self.root.items() if isinstance(letter, str)]
        while level:  # by depth, so that the suffix state of the parent is known
            below = []
            for parent, letter, state in level:
                back = self.root if parent is self.root else self.step(parent[0], letter, False)
                below += [(state, c, s) for c, s in state.items() if isinstance(c, str)]
                state[None] += back[None]
                state[0] = back
                state.setdefault(1, back[1])
            level = below

    def step(self, state: dict, letter: str, keep: bool = True) -> dict:
        """The state after ``letter``; kept for the next time while there is room."""
        if letter not in self.root:
            return self.root
        at = state
        while letter not in at:
            at = at[0]
        if keep and self.left > 0:
            self.left -= 1
            state[letter] = at[letter]
        return at[letter]


class PrefixCodec:
    """Encodes texts as a sentencepiece BPE model does, to little-endian 32-bit ids, and decodes with the library."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            parts = dict(_fields(f.read()))
        trainer, rules = dict(_fields(parts[2])), dict(_fields(parts.get(3, b"")))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("the model is not a BPE model with white space before words")
        self.dummy = rules.get(3, 1) == 1
        self.plain = rules.get(1) == b"identity" and not rules.get(2) and rules.get(4, 1) == 0 and rules.get(5, 1) == 1
        special = [model.is_unknown, model.is_control, model.is_byte, model.is_unused]
        ids = {model.id_to_piece(i): i for i in range(len(model)) if not any(f(i) for f in special)}
        self.merges = Merges({p: model.get_score(i) for p, i in ids.items() if len(p) > 1})
        self.tokens, self.logs, self.four, self.tested = [], [], [], 0
        pack = functools.partial(struct.pack, "<I")
        self.unknown, self.bytes = pack(model.unk_id()), [pack(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.fallback = all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256))
        for piece in [*ids, *(set("".join(ids)) - set(ids))]:  # letters that occur in pieces only are tokens without an id
            left, log = self.merges.run(piece)
            if len(left) == 1:  # a piece that its own text does not lead to is never a token
                self.tokens.append(piece)
                self.logs.append(log)
                self.four.append(pack(ids[piece]) if piece in ids else None)
        self.sizes = [len(t) for t in self.tokens] + [1]  # at -1: an unknown character
        self.four.append(None)
        self.answers = [{} for _ in self.tokens]  # by token: which tokens may stand before it, as far as asked
        self.matcher = Matcher(self.tokens, self.answers)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in ids)  # then no piece reaches over the start of a word
        self.find = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.head, self.tail = pack(model.bos_id()), pack(model.eos_id())
        self.words = Pieces(self.words_ids, 600_000)

    def extend(self, last: list[int], states: list[dict], text: str) -> None:
        """Carries the table of last tokens on over ``text``. Exactly one match is right, so the shortest one needs no test."""
        state, step = states[-1], self.matcher.step
        for letter in text:
            state = state.get(letter) or step(state, letter)
            for token, size, tested in state[None]:
                before = last[-size]
                if before < 0:  # the text, or what follows an unknown character, starts here
                    break
                fits = tested.get(before)
                if fits is None:
                    fits = tested[before] = self.merges.apart(self.tokens[before], self.logs[before], self.tokens[token], self.logs[token])
                    self.tested += 1
                if fits:
                    break
            else:
                token = state[1]
            last.append(token)
            states.append(state)

    def forget(self) -> None:
        for answers in self.answers:
            answers.clear()
        self.tested = 0

    def ids(self, text: str, last: list[int]) -> bytes:
        """Ids of a normalised text, read backwards from its table."""
        out, at, sizes, four = [], len(text), self.sizes, self.four
        while at:
            token = last[at]
            code = four[token]
            if code is not None:
                out.append(code)
            elif self.fallback:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode())]
            elif not out or out[-1] is not self.unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
            at -= sizes[token]
        out.reverse()
        return b"".join(out)

    def words_ids(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of every word. In sorted order a word shares the table of its common prefix with the word before it."""
        out, before, last, states = {}, "", [-1], [self.matcher.root]
        for key in sorted(keys):
            text = key[1:] if key[:1] == " " else MARK + key
            same = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                same += 1
            del last[same + 1:], states[same + 1:]
            self.extend(last, states, text[same:])
            out[key], before = self.ids(text, last), text
        if self.tested > PAIRS:  # the answers are forgotten together, to bound them
            self.forget()
        return out

    def keys(self, text: str) -> list[str]:
        """A text as words that no piece connects. A key is the word without the mark before it; a space stands before one without."""
        if self.plain and self.dummy and self.cuts and text and not text.startswith(" ") and "  " not in text and MARK not in text:
            return text.split(" ")
        if self.plain:
            text = text.replace(" ", MARK)
            text = MARK + text if text and self.dummy else text
        else:
            text = self.model.normalize(text)
        return [w[1:] if w.startswith(MARK) else " " + w for w in (self.find(text) if self.cuts else [text] if text else [])]

    def encode(self, values: list[str]) -> list[bytes]:
        """Ids with those of begin and end."""
        return [self.head + ids + self.tail for ids in self.words.join([self.keys(v) for v in values])]

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@functools.cache
def codec(path: str) -> PrefixCodec:
    return PrefixCodec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, begin and end included, one row per row of ``docs``.

    ``path`` is a sentencepiece BPE model that every executor can open. A null or empty text has the ids of begin and end only;
    repeated rows and null doc_ids stay; other columns, whatever their names, are left out; an empty table gives an empty one. A very
    long text costs memory in proportion to it and time in proportion to it, with or without spaces."""
    def work(batches):
        own = codec(path)
        for batch, values in slices(batches):
            ids = own.encode(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                             ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(work, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (string) to (doc_id, n_tokens, ids) as the library decodes them; null ids give null."""
    def work(batches):
        own = codec(path)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                out = [None if x is None else own.decode(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``encode`` and ``decode`` in one pass, so that a task needs one worker with one word table."""
    def work(batches):
        own = codec(path)
        for batch, values in slices(batches):
            ids = own.encode(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs).mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the round trip."""
    return round_trip(docs, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
