"""Operator 1: byte-level BPE encoding and decoding.

Encoding. For every prefix of a piece there is one last token of its encoding, namely the longest
vocabulary entry that ends there and forms a stable pair with the last token before it. A transducer
reads bytes and keeps the encodings of the few prefixes from which a vocabulary entry may still
extend past the current byte; what all of these have in common can no longer change and is emitted
(lookahead is bounded by the longest entry). States are determinised when first met and kept in a
bounded table. Decoding is a second small machine over UTF-8, fed token by token.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import marshal
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomspark.llm.shared import slices, worker_table

DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_BYTES = [bytes((b,)) for b in range(256)]
_FRESH = [(0, ())]


class _State(dict):
    """The moves by byte; ``key`` has all else, packed."""

    __slots__ = ("key",)


class ByteBpe:
    """One vocabulary: ``encode(text) -> ids``, the same ids as merging by rank.

    ``max_states`` bounds the table of determinised states, ``max_pairs`` that of pairs known to be stable
    or not, and ``max_pieces`` that of short pieces with their packed outputs; a full table is dropped and
    built anew. States are kept packed, as most of them are met seldom.
    """

    def __init__(
        self, ranks: dict[bytes, int], pattern: str, max_states: int = 200_000, max_pieces: int = 300_000, max_pairs: int = 400_000
    ) -> None:
        self.ranks, self.split, self.max_states = ranks, regex.compile(pattern), max_states
        self.max_pairs, self.max_pieces, self.pieces = max_pairs, max_pieces, {}
        self.tokens = {v: k for k, v in ranks.items()}
        self.open = {t[:n] for t in ranks for n in range(len(t))}
        self.stable: dict[int, bool] = {}
        self.split_of: dict[int, tuple[int, int] | None] = {}
        self.states: dict[bytes, _State] = {}
        self._reset()

    def _reset(self) -> None:
        # states lead to each other in circles: cut here, a dropped table is freed at once and not left to the collector
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.start = self._state(-1, b"", ((0, ()),))

    def _state(self, last: int, text: bytes, live: tuple) -> _State:
        key = marshal.dumps((last, text, live), 2)  # this version writes equal values to equal bytes
        if (found := self.states.get(key)) is None:
            found = self.states[key] = _State()
            found.key = key
        return found

    def merge(self, piece: bytes, stop: int = 1) -> list[int]:
        """The plain definition: merge the adjacent pair of lowest rank, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            best = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes ``token``; None for a single byte."""
        if (known := self.split_of.get(token, 0)) == 0:
            parts = self.merge(self.tokens[token], stop=2)
            known = self.split_of[token] = tuple(parts) if len(parts) == 2 else None
        return known

    def _pair(self, a: int, b: int) -> bool:
        """Does merging the bytes of a and b by rank leave just these two tokens?

        Their merges are undone from the latest backwards. At each step the tokens that face each other
        across the border must not merge earlier than the merge which replaced one of them.
        """
        if a < 0:
            return True
        if (known := self.stable.get(pair := a << 32 | b)) is None:
            if len(self.stable) >= self.max_pairs:
                self.stable.clear()
            known = self.stable[pair] = self._faces(a, b)
        return known

    def _faces(self, a: int, b: int) -> bool:
        tokens, ranks, before = self.tokens, self.ranks, 1 << 60
        while True:
            if ranks.get(tokens[a] + tokens[b], 1 << 60) < before:
                return False
            left, right = self._halves(a), self._halves(b)
            if left and (a > b or not right):
                before, a = a, left[1]
            elif right:
                before, b = b + 1, right[0]
            else:
                return True

    def _move(self, state: _State, byte: int) -> tuple[_State, tuple]:
        if len(self.states) >= self.max_states:
            self._reset()
        last, text, live = marshal.loads(state.key)
        text += _BYTES[byte]
        ranks, open_, stay, ending = self.ranks, self.open, [], None
        for start in live:  # the earliest start gives the longest token
            at, pending = start
            tail = text[at:]
            if ending is None and (token := ranks.get(tail)) is not None and self._pair(pending[-1] if pending else last, token):
                ending = (*pending, token)
            if tail in open_:
                stay.append(start)
        if ending is None:
            raise ValueError("the vocabulary lacks single bytes")
        if not stay:  # nothing can extend further back: all is certain
            out, last, text, stay = ending, ending[-1], b"", _FRESH
        else:
            stay.append((len(text), ending))
            first, done = stay[0][1], 0
            for mine in zip(*(p for _, p in stay), strict=False):  # ends with the shortest
                if mine.count(mine[0]) < len(mine):
                    break
                done += 1
            out = first[:done]
            if done:
                last, cut = out[-1], sum(len(self.tokens[t]) for t in out)
                text, stay = text[cut:], [(at - cut, p[done:]) for at, p in stay]
            if all(p for _, p in stay):
                last = -1  # no start needs what went before
        to = (self._state(last, text, tuple(stay)), out)
        state[byte] = to
        return to

    def encode_piece(self, piece: bytes, out: list[int]) -> None:
        whole = self.ranks.get(piece)
        if whole is not None:
            out.append(whole)
            return
        state = self.start
        for byte in piece:
            to = state.get(byte) or self._move(state, byte)
            state = to[0]
            if to[1]:
                out += to[1]
        out += marshal.loads(state.key)[2][-1][1]  # what the last start has pending

    def packed(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        known, pieces = self.pieces, self.split.findall(text or "")
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:  # some piece is new
            out = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                self.encode_piece(piece.encode("utf-8"), new := [])
                ids = struct.pack(f"<{len(new)}I", *new)
                if len(piece) <= 24:
                    if len(known) >= self.max_pieces:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


class Utf8Decoder:
    """Feed ids one by one or in blocks; ``feed`` returns the text that is certain so far.

    The machine's state is the bytes of an unfinished character. Moves by (state, token) are kept; those
    that begin and end between characters are also kept by token, and a block of them is one lookup each.
    Bytes that can begin no character become U+FFFD, as Python's ``errors="replace"`` does.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens, self.state, self.moves, self.whole = tokens, b"", {}, {}

    @staticmethod
    def _need(lead: int) -> tuple[int, int, int]:
        """Continuation bytes after ``lead`` and the bounds of the first of them."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    def _step(self, state: bytes, byte: int) -> tuple[bytes, str]:
        if state:
            need, low, high = self._need(state[0])
            if (low if len(state) == 1 else 0x80) <= byte <= (high if len(state) == 1 else 0xBF):
                state += bytes((byte,))
                return (b"", state.decode("utf-8")) if len(state) == need + 1 else (state, "")
            state, text = self._step(b"", byte)
            return state, "�" + text
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes((byte,)), "") if self._need(byte)[0] else (b"", "�")

    def _token(self, state: bytes, token: int) -> tuple[bytes, str]:
        at, text = state, []
        for byte in self.tokens[token]:
            at, more = self._step(at, byte)
            text.append(more)
        self.moves[state, token] = to = (at, "".join(text))
        if not state and not at:
            self.whole[token] = to[1]
        return to

    def feed(self, ids: Iterable[int]) -> str:
        out, state, moves = [], self.state, self.moves
        if not state:
            try:
                return "".join(map(self.whole.__getitem__, ids))
            except KeyError:  # a token is new or breaks a character
                pass
        for token in ids:
            to = moves.get((state, token)) or self._token(state, token)
            state = to[0]
            out.append(to[1])
        self.state = state
        return "".join(out)

    def close(self) -> str:
        left, self.state = self.state, b""
        return "�" if left else ""

    def decode(self, ids: Iterable[int]) -> str:
        self.state = b""
        return self.feed(ids) + self.close()


def codec(path: str, pattern: str) -> tuple[ByteBpe, Utf8Decoder]:
    """The codec of this Python worker, which keeps it until another operator needs the room."""

    def build() -> tuple[ByteBpe, Utf8Decoder]:
        bpe = ByteBpe(load_ranks(path), pattern)
        # the tables hold no cycles; without this the collector walks them again and again as they grow
        gc.freeze()
        gc.set_threshold(500_000, 100, 100)
        return bpe, Utf8Decoder(bpe.tokens)

    return worker_table("bpe", (path, pattern), build)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY), public_tokenizers.PATTERN


def _map(df: DataFrame, text: str, vocabulary: tuple[str, str], columns: str, digest: bool) -> DataFrame:
    keep = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [columns])
    path, pattern = vocabulary
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decoder = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                ids = [bpe.packed(t) for t in part.column(text).to_pylist()]
                count = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digest:
                    texts = (decoder.decode(np.frombuffer(x, "<u4").tolist()) for x in ids)
                    made = [
                        count,
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts]),
                    ]
                else:
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("i4")
                    made = [count, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + made, names + new)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Replace column ``text`` by n_tokens (long) and ids (array of int); other columns stay.

    Null and empty texts give no tokens, an empty table gives an empty result. Rows are independent:
    repeated rows give repeated results. Texts of any length are encoded whole, one at a time; a text and
    its tokens must fit into a worker. Columns named n_tokens or ids in the input are replaced.
    """
    df = df.drop("n_tokens", "ids")
    return _map(df, text, vocabulary or default_vocabulary(), "n_tokens bigint, ids array<int>", digest=False)


def decode(df: DataFrame, ids: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Replace column ``ids`` by the string column ``text``; null ids give an empty text."""
    path, pattern = vocabulary or default_vocabulary()
    df = df.drop("text")
    keep = [f for f in df.schema.fields if f.name != ids]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = codec(path, pattern)[1]
        for batch in batches:
            text = pa.array([decoder.decode(x.as_py() or ()) for x in batch.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), text], [*names, "text"])

    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["text string"]))


def digests(df: DataFrame, text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Like :func:`encode`, then decode, keeping n_tokens, ids_sha256 and decoded_sha256 only."""
    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256")
    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _map(df, text, vocabulary or default_vocabulary(), columns, digest=True)
