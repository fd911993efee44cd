"""Byte-level BPE encoding by a dynamic program over prefixes, and decoding.

For every prefix of a piece, the encoding's last token is unique. A suffix automaton of the vocabulary reads a piece once: its state
is the longest suffix of what was read that begins some token, and the state's suffix links pass through all tokens that end
there, longest first. The last token is the first of these that either is the whole prefix or is compatible with the last token of
the prefix before it: no merge between them would have come before the merges that made them. Following the stored tokens back from
the end gives the ids.

All distinct pieces of a slice of texts are done at once, byte by byte, in numpy; pieces of more than ``LONG`` bytes alone, in time
proportional to their length. Null and empty texts have no ids; special strings in a text become their ids, as the library does
it; each repeated row gets its result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import chunks, table, texts

MOST_PIECES = 300_000
#: Bytes of a piece that is done alone.
LONG = 256
PAIR_BITS = 18
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The pre-tokenizer's pattern, with its white space spelt out.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_FAR = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """A hash table of numbers from 0 on, a quarter full at most; -1 for keys that it hasn't."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at, left = _slot(keys, self.bits), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            _, first = np.unique(at[left], return_index=True)
            put = first[free[first]]
            self.keys[at[left[put]]], self.values[at[left[put]]] = keys[left[put]], values[left[put]]
            left = np.delete(left, put)
            at[left] = (at[left] + 1) % len(self.keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = _slot(keys, self.bits)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        on = np.flatnonzero((found != keys) & (found >= 0))
        at = at[on]
        while len(on):
            at = (at + 1) % len(self.keys)
            found = self.keys[at]
            hit = found == keys[on]
            out[on[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            on, at = on[more], at[more]
        return out


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        n = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * n
        for t, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.text = [str(i) for i in range(n)]
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        pairs = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            pairs.append((i << 20 | j, r))
            if self.rank[k] < 0 and len(self.bytes[k]) > 1:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.pairs = dict(pairs)
        self.pair = Lookup(*np.array(pairs, np.int64).T)
        self.ranks: list[int] = self.rank.tolist()
        self.edges: dict[int, int] = {}
        ends, depth = [-1], [0]
        for i in vocab.values():
            node = 0
            for b in self.bytes[i]:
                key = node << 8 | b
                if key not in self.edges:
                    self.edges[key] = len(ends)
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                node = self.edges[key]
            ends[node] = i
        # Suffix links, by rising depth, and from each state the longest of its suffixes that is a token.
        self.link, self.nearest = [0] * len(ends), [0] * len(ends)
        by_depth = sorted(self.edges.items(), key=lambda e: depth[e[1]])
        for key, node in by_depth:
            up, b = key >> 8, key & 255
            if up:
                up = self.link[up]
                while up and up << 8 | b not in self.edges:
                    up = self.link[up]
                self.link[node] = self.edges.get(up << 8 | b, 0)
            self.nearest[node] = node if ends[node] >= 0 else self.nearest[self.link[node]]
        self.step = Lookup(np.fromiter(self.edges, np.int64, len(self.edges)), np.fromiter(self.edges.values(), np.int64, len(self.edges)))
        self.token_of, self.links, self.nearests = np.array(ends), np.array(self.link), np.array(self.nearest)
        # At each token's state, the state of the next shorter token that ends there.
        self.shorter = self.nearests[self.links]
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        # Pairs that were tested, each at one place, where a later pair replaces it.
        self.tested, self.outcome = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.known: dict[str, list[int]] = {}

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``test`` for each pair; outcomes are remembered."""
        key = x << 20 | y
        at = _slot(key, PAIR_BITS)
        new = np.flatnonzero(self.tested[at] != key)
        out = self.outcome[at]
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            good = self.test(pairs >> 20, pairs & 0xFFFFF)
            out[new] = good[back]
            self.tested[at[new]], self.outcome[at[new]] = key[new], out[new]
        return out

    def test(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether encoding x's bytes and then y's gives x and y.

        Undoes merges from the last back: the token on the seam's left becomes its right part, the one on the right
        its left part. A merge across the seam wins if it comes before the merge that ended this state.
        """
        good, live = np.ones(len(x), bool), np.arange(len(x))
        until_x, until_y = np.full(len(x), _FAR), np.full(len(x), _FAR)
        while len(live):
            r = self.pair(x << 20 | y)
            crosses = (r >= 0) & (r < until_x) & (r <= until_y)
            good[live[crosses]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crosses & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry, until_x, until_y = (v[on] for v in (live, x, y, rx, ry, until_x, until_y))
            of_x = rx > ry  # of equal merges the left one is done first, so it is undone last
            until_x, until_y = np.where(of_x, rx, until_x), np.where(of_x, until_y, ry)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return good

    def test_one(self, x: int, y: int) -> bool:
        """``test`` for one pair."""
        until_x = until_y = int(_FAR)
        rank = self.ranks
        while True:
            r = self.pairs.get(x << 20 | y, -1)
            if 0 <= r < until_x and r <= until_y:
                return False
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                until_x, x = rx, int(self.right[x])
            else:
                until_y, y = ry, int(self.left[y])

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each non-empty piece."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for k in np.flatnonzero(size > LONG):
            out[k] = self.encode_long(pieces[k])
        short = np.flatnonzero(size <= LONG)
        short = short[np.argsort(-size[short], kind="stable")]  # the longest first, so that those still open are in front
        for k, ids in zip(short.tolist(), self._encode_short([pieces[k] for k in short], size[short]) if len(short) else [], strict=True):
            out[k] = ids
        return out

    def _encode_short(self, pieces: list[bytes], size: np.ndarray) -> list[list[int]]:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(size) - size
        last, state = np.empty(len(data), np.int64), np.zeros(len(pieces), np.int64)
        for depth in range(int(size[0])):
            n = int(np.searchsorted(-size, -depth))  # pieces with more bytes than that
            pos = begin[:n] + depth
            state = self._read(state[:n], data[pos])
            node, on = self.nearests[state], np.arange(n)
            while len(on):
                if not node.all():
                    raise ValueError("the vocabulary can't encode a piece")
                token = self.token_of[node]
                size_ = self.lengths[token]
                fits = size_ == depth + 1
                rest = np.flatnonzero(~fits)
                fits[rest] = self.compatible(last[pos[on[rest]] - size_[rest]], token[rest])
                last[pos[on[fits]]] = token[fits]
                on, node = on[~fits], self.shorter[node[~fits]]
        # Back-pointers: one step back in every piece at a time.
        pos, who, steps = begin + size - 1, np.arange(len(pieces)), []
        while len(pos):
            t = last[pos]
            steps.append((who, t))
            pos = pos - self.lengths[t]
            on = pos >= begin[who]
            pos, who = pos[on], who[on]
        who, ids = (np.concatenate(x) for x in zip(*reversed(steps), strict=True))
        order = np.argsort(who, kind="stable")
        ids, ends = ids[order].tolist(), np.cumsum(np.bincount(who, minlength=len(pieces))).tolist()
        return [ids[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def _read(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's states after one more byte."""
        byte = byte.astype(np.int64)
        after = self.step(state << 8 | byte)
        lost = np.flatnonzero(after < 0)
        back = state[lost]
        while len(lost):
            lost, back = lost[back > 0], self.links[back[back > 0]]
            after[lost] = self.step(back << 8 | byte[lost])
            on = after[lost] < 0
            lost, back = lost[on], back[on]
        return np.maximum(after, 0)

    def encode_long(self, piece: bytes) -> list[int]:
        """The same for one piece, whose pairs are remembered."""
        edges, link, nearest, bytes_ = self.edges, self.link, self.nearest, self.bytes
        fits: dict[int, bool] = {}
        last, state = [0] * len(piece), 0
        for pos, b in enumerate(piece):
            while state and state << 8 | b not in edges:
                state = link[state]
            state = edges.get(state << 8 | b, 0)
            node = nearest[state]
            while node:
                token = int(self.token_of[node])
                before = pos - len(bytes_[token])
                if before < 0:
                    break
                key = last[before] << 20 | token
                if key not in fits:
                    fits[key] = self.test_one(last[before], token)
                if fits[key]:
                    break
                node = nearest[link[node]]
            if not node:
                raise ValueError("the vocabulary can't encode a piece")
            last[pos] = token
        out, pos = [], len(piece) - 1
        while pos >= 0:
            out.append(last[pos])
            pos -= len(bytes_[last[pos]])
        return out[::-1]

    def _segments(self, text: str) -> Iterator[tuple[list[str], list[int]]]:
        at = 0
        if self.special:
            for m in self.cut.finditer(text):
                yield PIECES.findall(text[at : m.start()]), [self.special[m[0]]]
                at = m.end()
        yield PIECES.findall(text[at:] if at else text), []

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; a piece that a worker has met is not done again."""
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        known = self.known
        parts = [list(self._segments(t)) for t in texts]
        new = list({p for segments in parts for pieces, _ in segments for p in pieces}.difference(known))
        if new:
            known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        get = known.__getitem__
        return [[i for pieces, tail in segments for i in chain(chain.from_iterable(map(get, pieces)), tail)] for segments in parts]

    def decode(self, ids: list[int]) -> bytes:
        """The text's UTF-8 bytes; bytes that aren't UTF-8 become the replacement character."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="replace").encode()
        return data


@lru_cache(maxsize=1)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids): the ids of each whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch, data in chunks(batches):
            yield pa.RecordBatch.from_pydict({key: batch.column("row_key"), "ids": pa.array(model.encode([x.decode() for x in data]), pa.list_(pa.int32()))})

    return texts(docs, F.col(key).alias("row_key")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text): the text of each list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({key: batch.column("row_key"), "text": pa.array([model.decode(x or []).decode() for x in batch.column("ids").to_pylist()], pa.string())})

    return encoded.select(F.col(key).alias("row_key"), "ids").mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, without sending ids to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch, data in chunks(batches):
            ids = model.encode([x.decode() for x in data])
            yield pa.RecordBatch.from_pydict({
                key: batch.column("row_key"),
                "n_tokens": pa.array(map(len, ids), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(",".join(map(model.text.__getitem__, x)).encode()).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in ids]),
            })

    return texts(docs, F.col(key).alias("row_key")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
