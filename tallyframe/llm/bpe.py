"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one last token fits the encoding of that prefix:
the token that ends there and may follow the last token of the shorter prefix. Storing
that token per byte gives exact encodings in linear time, exact appends, and after an
edit a new computation only as far as the old tokens do not come back.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import table, with_results


class Vocabulary:
    """Tokens by rank, and for each token the two tokens that its last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        top = max(self.bytes_of) + 1
        self.left, self.right = [-1] * top, [-1] * top  # -1: a single byte
        self.usable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = [rank] if len(token) == 1 else self._merge(token, rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = parts
            if len(parts) <= 2:
                self.usable[token] = rank
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in self.usable.items():
            for i in range(1, len(token)):
                a, b = self.usable.get(token[:i]), self.usable.get(token[i:])
                if a is not None and b is not None:
                    self.joined[a, b] = rank
        self._fits: dict[tuple[int, int], bool] = {}
        self._automaton()

    def _automaton(self) -> None:
        """States are prefixes of tokens; ends[state] has the tokens, and their lengths, that end where it is reached."""
        self.go: dict[int, int] = {}  # state * 256 + byte: the tree at first, then also each step taken
        parent = [(0, 0)]
        token_at: dict[int, int] = {}
        for token, rank in self.usable.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                if key not in self.go:
                    self.go[key] = len(parent)
                    parent.append((state, byte))
                state = self.go[key]
            token_at[state] = rank
        children: dict[int, list[int]] = {}
        for state in range(1, len(parent)):
            children.setdefault(parent[state][0], []).append(state)
        self.fall = [0] * len(parent)  # the longest proper suffix that is a state
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(parent)
        self._most_steps = len(self.go) + (1 << 17)
        tree, level = dict(self.go), [0]
        while level:
            level = [c for state in level for c in children.get(state, ())]
            for state in level:
                up, byte = parent[state]
                back = self.fall[up] if up else -1
                while back > 0 and (back << 8 | byte) not in tree:
                    back = self.fall[back]
                self.fall[state] = tree.get(back << 8 | byte, 0) if back >= 0 else 0
                own = token_at.get(state)
                self.ends[state] = (((own, len(self.bytes_of[own])),) if own is not None else ()) + self.ends[self.fall[state]]

    def step(self, state: int, byte: int) -> int:
        back = state
        while (to := self.go.get(back << 8 | byte)) is None:
            if not back:
                raise ValueError("the vocabulary lacks a byte")
            back = self.fall[back]
        if len(self.go) < self._most_steps:
            self.go[state << 8 | byte] = to
        return to

    @classmethod
    def load(cls, content: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a})

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Merge neighbours, the lowest rank first, by ranks under `below`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether `left` and `right` stay side by side when their joined bytes are encoded.

        Merges are undone from the latest to the earliest. At each point the two tokens at the border must not
        have merged with each other before the merge, just undone, that took one of them away from the border.
        """
        pair = left, right
        known = self._fits.get(pair)
        if known is not None:
            return known
        joined, lefts, rights = self.joined, self.left, self.right
        a, b, until_a, until_b, ok = left, right, 1 << 60, 1 << 60, True
        while True:
            r = joined.get(pair)
            if r is not None and r < until_a and r <= until_b:
                ok = False
                break
            ra, lb = rights[a], lefts[b]
            if ra >= 0 and (a > b or lb < 0):
                until_a, a = a, ra
            elif lb >= 0:
                until_b, b = b, lb
            else:
                break
            pair = a, b
        if len(self._fits) < 1 << 17:
            self._fits[left, right] = ok
        return ok


class PrefixTable:
    """The last token of every byte prefix of one piece, and the automaton's state there."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self._states = vocabulary, b"", [-1], [0]
        self.append(data)

    def _extend(self, data: bytes) -> None:
        v, last, states = self.vocabulary, self.last, self._states
        go, ends, known, state = v.go, v.ends, v._fits, states[-1]
        for end, byte in enumerate(data, len(last)):
            to = go.get(state << 8 | byte)
            state = v.step(state, byte) if to is None else to
            for token, length in ends[state]:
                if length == end:
                    break
                fits = known.get((last[end - length], token))
                if v.fits(last[end - length], token) if fits is None else fits:
                    break
            last.append(token)
            states.append(state)

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend(data)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put data in place of bytes start to stop; returns how many prefixes were computed anew.

        Once the new tokens equal the old ones on as many prefixes in a row as the longest token has bytes, all
        later ones are the old ones, since no token looks further back.
        """
        old, states, shift = self.last, self._states, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last, self._states = old[: start + 1], states[: start + 1]
        alike = 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(self.data[end - 1 : end])
            before = end - shift
            alike = alike + 1 if end > start + len(data) and old[before] == self.last[end] else 0
            if alike >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                self._states += states[before + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes whole texts, each match of the pattern by a PrefixTable; keeps what it has computed for up to `keep` matches."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, keep: int = 200_000):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.bytes_of = {str(r): t for r, t in vocabulary.bytes_of.items()}
        encode = self.piece

        class Known(dict):
            def __missing__(self, piece: str) -> str:
                ids = " ".join(map(str, encode(piece.encode("utf-8", "replace"))))
                if len(self) < keep and len(piece) <= 64:
                    self[piece] = ids
                return ids

        self._known = Known()

    def piece(self, data: bytes) -> list[int]:
        whole = self.vocabulary.usable.get(data)
        if whole is not None:
            return [whole]
        return PrefixTable(self.vocabulary, data).tokens()

    def ids_text(self, text: str) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self._known.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.ids_text(text).split()]

    def decode(self, ids: Iterable[int | str]) -> bytes:
        return b"".join([self.bytes_of[x] for x in map(str, ids)])


class TextTable:
    """The encoding of a growing text: appends are exact and encode only the last matches anew."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self._done, self._kept, self._kept_ids = encoder, "", 0, [], []
        self.append(text)

    def append(self, text: str) -> None:
        # A match that ends three characters or more before the end looks at nothing that an append changes.
        while self._kept and self._kept[-1][1] > len(self.text) - 3:
            start, _, n = self._kept.pop()
            self._done = start
            del self._kept_ids[len(self._kept_ids) - n :]
        if not self._kept:
            self._done, self._kept_ids = 0, []
        self.text += text
        for m in self.encoder.pattern.finditer(self.text, self._done):
            ids = self.encoder.piece(m[0].encode())
            self._kept.append((m.start(), m.end(), len(ids)))
            self._kept_ids += ids
        self._done = len(self.text)

    def ids(self) -> list[int]:
        return list(self._kept_ids)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_of(content: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary and process."""
    key = hashlib.sha256(content).hexdigest(), pattern
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary.load(content), pattern)
    return _encoders[key]


def standard_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """The rank file's content and the pattern, read on the driver; executors get them with the job (under 1 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def bpe_encode(df: DataFrame, content: bytes, pattern: str, text: str = "text", *, ids_column: str | None = None, digests: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, with `digests` also ids_sha256 and decoded_sha256 (of the ids decoded again), with `ids_column` the ids.

    Null texts count as empty: 0 tokens, digests of no bytes. Whole texts are encoded, however long, in linear time.
    Other columns are kept; result columns replace input columns of the same name. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(content)
    results = "n_tokens long" + (", ids_sha256 string, decoded_sha256 string" if digests else "") + (f", `{ids_column}` array<int>" if ids_column else "")

    def compute(texts: list[bytes]) -> list[list]:
        encoder = encoder_of(shared.value, pattern)
        columns: list[list] = [[] for _ in range(1 + 2 * digests + bool(ids_column))]
        for t in texts:
            ids = encoder.ids_text(t.decode("utf-8", "replace"))
            parts = ids.split(" ") if ids else []
            row: list = [len(parts)]
            if digests:
                row += [hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(encoder.decode(parts)).hexdigest()]
            if ids_column:
                row.append(np.fromstring(ids, np.int32, sep=" "))
            for c, x in zip(columns, row, strict=True):
                c.append(x)
        return columns

    return with_results(df, text, results, compute, keep)


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), *standard_vocabulary(), keep=["doc_id"])
