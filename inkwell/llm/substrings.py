"""Substring dedup by recompression: windows of 20 words that start earlier elsewhere, and the words they cover.

Rounds of recompression name runs of equal tokens and then, round by round, pairs of neighbouring symbols: a bit of each symbol's name
deals symbols into left and right ones, and every left symbol followed by a right one becomes one symbol. A
name is a 64-bit hash of what it stands for, so it is the same in every task, and the rounds need no exchange. Whether two
symbols are paired depends on them alone, so of equal substrings all but some symbols at the edges get equal names;
``Parse`` works out, from a window's own content, which of its symbols are certain.

1. A window's longest certain symbol with its neighbour is its anchor. Spark counts the anchors' names over all documents; windows whose anchor
   occurs once can't be repeated. Names that a slice of documents has several times are sent once for it.
2. The windows left are named by their symbols: what each round takes off at the edges, and the symbols that remain. Equal windows have equal
   names. A checksum of the words themselves goes with the name, and both must agree. The least (doc_id, start) of each
   name stays; of several in a slice only the least is sent, as the others are later ones anyway.
3. The words covered by the other windows are removed.

So what is sent for one symbol or window is bounded by the number of slices, however often it occurs.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no words and keep none; rows without doc_id are
left out; rows that repeat doc_id and text are one document's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, Words, bucket_of, chunk_bytes, chunks, mix, partitions, split_by, table, texts
from inkwell.llm.packets import SCHEMA, Out, as_table, join, reduce_buckets, runs

WINDOW = 20
#: Pair rounds. Each round at most doubles a symbol and makes at most one more symbol at each edge uncertain.
ROUNDS = 4
BUCKETS_PER_PARTITION = 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 48) - 1)

_ANCHORS, _WINDOWS, _SEVERAL = range(3)


class Symbols:
    """The symbols of many documents in one row: names, first words, lengths, documents."""

    def __init__(self, h: np.ndarray, at: np.ndarray) -> None:
        n = len(h)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, n))
        self.doc, self.words = doc[self.start], n
        self.name = np.where(self.size > 1, mix(h[self.start] * _A + self.size.astype(np.uint64)), h[self.start])
        self.round, self.sides = 0, None

    def pair(self) -> None:
        """One round."""
        right, self.sides = self.next_sides(), None
        self.round += 1
        first = np.zeros(len(self.name), bool)
        first[:-1] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.zeros(len(self.name), bool)
        second[1:] = first[:-1]
        at = np.flatnonzero(first)
        self.name, self.size = self.name.copy(), self.size.copy()
        self.name[at] = mix(self.name[at] * _A + mix(self.name[at + 1] + _B))
        self.size[at] += self.size[at + 1]
        keep = ~second
        self.name, self.start, self.size, self.doc = self.name[keep], self.start[keep], self.size[keep], self.doc[keep]

    def next_sides(self) -> np.ndarray:
        """Whether each symbol is a right one in the round to come."""
        if self.sides is None:
            salt = np.uint64(0x5851F42D4C957F2D * (self.round + 2) % (1 << 64))
            self.sides = (mix(self.name ^ salt) & np.uint64(1)).astype(bool)
        return self.sides

    def at_word(self) -> np.ndarray:
        """The symbol that holds each word."""
        return np.repeat(np.arange(len(self.size)), self.size)


class Parse:
    """The symbols of some windows (first words s) that are certain whatever stands around them.

    A window's certain part shrinks as names could differ in another occurrence: first the runs at its ends
    (they may go on outside), then in each round a right symbol at its start and a left one at its end (they may have
    been paired with one outside). What is taken off goes, in order, into ``edges``; symbols first to last remain, where ok.
    """

    def __init__(self, h: np.ndarray, at: np.ndarray, s: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> None:
        sym = Symbols(h, at)
        who = sym.at_word()
        u, v = np.minimum(sym.start[who[s]] + sym.size[who[s]], s + window), np.maximum(sym.start[who[s + window - 1]], s)
        left = mix(h[s] + (u - s).astype(np.uint64) * _A)
        right = mix(h[s + window - 1] + (s + window - v).astype(np.uint64) * _B)
        for _ in range(rounds):
            sides = sym.next_sides()
            ok = u < v
            f, e = who[np.where(ok, u, s)], who[np.where(ok, v - 1, s)]
            off = ok & sides[f]
            left = np.where(off, mix(left * _A + sym.name[f]), left)
            u = np.where(off, u + sym.size[f], u)
            off = ok & ~sides[e] & (u < v)
            right = np.where(off, mix(right * _A + sym.name[e]), right)
            v = np.where(off, sym.start[e], v)
            sym.pair()
            who = sym.at_word()
        self.symbols, self.ok = sym, u < v
        self.first, self.last = who[np.where(self.ok, u, s)], who[np.where(self.ok, v - 1, s)]
        self.edges = mix(left ^ mix(right + _B))

    def names(self) -> np.ndarray:
        """The windows' names: what was taken off, and the symbols that remain; meaningless where not ok."""
        core, name = np.zeros(len(self.first), np.uint64), self.symbols.name
        for k in range(int((self.last - self.first).max(initial=-1)) + 1):
            on = self.first + k <= self.last
            core = np.where(on, mix(core * _A + name[np.where(on, self.first + k, 0)]), core)
        return mix(self.edges + mix(core + _A))


def anchors(h: np.ndarray, at: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, name, certain, symbol's number) of each window: its longest certain symbol, ties by name, and the next one.

    Where no symbol is certain, the window has to be looked at itself.
    """
    n = np.diff(at)
    count = np.maximum(n - window + 1, 0)
    s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    if not len(s):
        return s, np.zeros(0, np.uint64), np.zeros(0, bool), s
    parse = Parse(h, at, s, window, rounds)
    sym, f, e = parse.symbols, parse.first, parse.last
    # Longest, then largest name: one number for each symbol, whose largest in [f, e] is wanted.
    order = np.argsort(sym.name)
    by_size = np.argsort(np.minimum(sym.size[order], 65535).astype(np.uint16), kind="stable")
    order = order[by_size]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(np.append(False, (np.diff(sym.size[order]) != 0) | (sym.name[order][1:] != sym.name[order][:-1])))
    best = f.copy()
    for k in range(1, int((e - f).max()) + 1):
        j = np.minimum(f + k, e)
        best = np.where(rank[j] > rank[best], j, best)
    # With a neighbour that is certain too, it is seldom repeated by chance.
    more = np.where(best < e, best + 1, np.maximum(best - 1, f))
    name = mix(sym.name[best] * _A + mix(sym.name[more] + _B)) + (more > best).astype(np.uint64)
    return s, np.where(parse.ok, name, np.uint64(0)), parse.ok, best * 4 + (more - best)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number below 2**64, and of its inverse."""
    back = np.uint64(pow(int(_A), -1, 1 << 64))
    up, down = np.full(n, _A), np.full(n, back)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def checksums(h: np.ndarray, s: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """64 bits of the windows' words, by differences of one running sum."""
    up, down = _powers(1 << max(10, int(len(h)).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + _B) * up[: len(h)], dtype=np.uint64)])
    return mix((total[s + window] - total[s]) * down[s])


def window_names(h: np.ndarray, at: np.ndarray, s: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(name, 32-bit checksum) of the windows that start at words s."""
    check = checksums(h, s, window)
    parse = Parse(h, at, s, window)
    return np.where(parse.ok, parse.names(), mix(parse.edges + mix(check))), (check >> np.uint64(32)).astype(np.uint32)


def _block(ids: np.ndarray, nb: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(nb)).astype(np.int64)


def _anchor_packets(nb: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in chunks(batches, limit=chunk_bytes(nb)):
            out = Out()
            ids = batch.column("doc_id").to_numpy()
            words = Words(data)
            at = words.at
            s, name, sure, symbol = anchors(words.hashes(), at)
            doc = np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(at) - WINDOW + 1, 0))
            # Neighbouring windows with one occurrence of an anchor: one entry (name, document, first window, windows).
            new = np.ones(len(s), bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1]) | (sure[1:] != sure[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(s)))
            doc, name, sure = doc[first], name[first], sure[first]
            local = s[first] - at[doc]
            name = name & _LOW
            distinct, back, times = np.unique(name, return_inverse=True, return_counts=True)
            several = times[back] > 1
            bucket = lambda x: bucket_of(x << np.uint64(16), nb)
            on = np.flatnonzero(sure & ~several)
            for k, x in split_by(bucket(name[on]), nb):
                x = on[x]
                who, count = runs(doc[x])
                out.add(_ANCHORS, k, ids[who], count.astype(np.uint32), _six(name[x]), local[x].astype(np.uint32), size[x].astype(np.uint32))
            known = np.unique(name[sure & several])
            for k, x in split_by(bucket(known), nb):
                out.add(_SEVERAL, k, _six(known[x]))
            off = np.flatnonzero(~sure | several)
            for k, x in split_by(_block(ids[doc[off]], nb), nb):
                x = off[x]
                out.add(_WINDOWS, k, ids[doc[x]], local[x].astype(np.uint32), size[x].astype(np.uint32))
            yield out.batch()

    return run


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1)


def _from_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _passed(out: Out, bucket: int, got: dict[int, list[bytes]]) -> None:
    for p in got.get(_WINDOWS, []):
        out.kind.append(_WINDOWS)
        out.bucket.append(bucket)
        out.payload.append(p)


def _repeated_anchors(nb: int):
    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        out = Out()
        _passed(out, bucket, got)
        if _ANCHORS in got:
            ids, count, low, local, size = join(got[_ANCHORS])
            ids, name = np.repeat(ids, count), _from_six(low)
            _, back, n = np.unique(name, return_inverse=True, return_counts=True)
            known = np.unique(_from_six(join(got[_SEVERAL])[0])) if _SEVERAL in got else name[:0]
            again = n[back] > 1
            if len(known):
                again |= known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name
            on = np.flatnonzero(again)
            for k, x in split_by(_block(ids[on], nb), nb):
                x = on[x]
                out.add(_WINDOWS, k, ids[x], local[x], size[x])
        return as_table([out.batch()])

    return run


def _by_document(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
    """(doc_id, starts): the block's documents with the windows named for them."""
    if _WINDOWS not in got:
        return pa.table({"key": pa.array([], pa.int64()), "starts": pa.array([], pa.binary())})
    ids, local, size = join(got[_WINDOWS])
    order = np.lexsort((local, ids))
    ids, local, size = ids[order], local[order], size[order]
    who, n = runs(ids)
    at = np.concatenate([[0], np.cumsum(n)])
    packed = np.stack([local, size], axis=1).astype("<u4")
    return pa.table({"key": pa.array(who, pa.int64()), "starts": pa.array([packed[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())})


def _spread(starts: bytes) -> np.ndarray:
    """Window starts out of (first, number) pairs."""
    x = np.frombuffer(starts, "<u4").reshape(-1, 2).astype(np.int64)
    return np.unique(np.arange(x[:, 1].sum()) - np.repeat(np.cumsum(x[:, 1]) - x[:, 1] - x[:, 0], x[:, 1]))


def _kept(n: int, starts: np.ndarray) -> np.ndarray:
    """A mask of a text's n words that no window covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(edge[:-1]) == 0


def _window_packets(nb: int):
    """The windows to look at, by name; of a slice's equal ones the least, as the others are later ones whatever comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in chunks(batches, limit=chunk_bytes(nb)):
            out = Out()
            ids = batch.column("doc_id").to_numpy()
            words = Words(data)
            starts = [_spread(x) for x in batch.column("starts").to_pylist()]
            order = np.argsort(ids, kind="stable")
            doc = np.repeat(order, [len(starts[k]) for k in order])
            local = np.concatenate([starts[k] for k in order])
            # Rows that repeat a document may have windows of another text's length.
            fits = local + WINDOW <= np.diff(words.at)[doc]
            doc, local = doc[fits], local[fits]
            if not len(doc):
                continue
            name, check = window_names(words.hashes(), words.at, words.at[doc] + local)
            _, first, back = np.unique(name ^ mix(check.astype(np.uint64)), return_index=True, return_inverse=True)
            least = first[back]
            later = np.flatnonzero((ids[doc] != ids[doc[least]]) | (local != local[least]))
            for k, x in split_by(_block(ids[doc[later]], nb), nb):
                x = later[x]
                out.add(_WINDOWS, k, ids[doc[x]], local[x].astype(np.uint32), np.ones(len(x), np.uint32))
            first = np.sort(first)
            for k, x in split_by(bucket_of(name[first], nb), nb):
                x = first[x]
                who, count = runs(doc[x])
                out.add(_ANCHORS, k, ids[who], count.astype(np.uint32), name[x], check[x], local[x].astype(np.uint32))
            yield out.batch()

    return run


def _later(nb: int):
    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        out = Out()
        _passed(out, bucket, got)
        if _ANCHORS in got:
            ids, count, name, check, start = join(got[_ANCHORS])
            ids = np.repeat(ids, count)
            order = np.lexsort((start, ids, check, name))
            ids, name, check, start = ids[order], name[order], check[order], start[order]
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (check[1:] != check[:-1])])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            on = np.flatnonzero((ids != ids[first]) | (start != start[first]))
            for k, x in split_by(_block(ids[on], nb), nb):
                x = on[x]
                out.add(_WINDOWS, k, ids[x], start[x].astype(np.uint32), np.ones(len(x), np.uint32))
        return as_table([out.batch()])

    return run


def _remove(with_text: bool, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in chunks(batches):
            rows, words = [], Words(data)
            for k, (n, s) in enumerate(zip(np.diff(words.at).tolist(), batch.column("starts").to_pylist(), strict=True)):
                if not s:
                    rows.append((n, 0, hashlib.sha256(words.text(k)).hexdigest(), None, []))
                    continue
                keep = _kept(n, _spread(s))
                kept = words.text(k, keep)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (~keep).view(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                rows.append((n, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, spans))
            cols = list(zip(*rows, strict=True))
            if carried:
                cols[3] = [x if kept is None else kept for x, kept in zip(batch.column("text").to_pylist(), cols[3], strict=True)]
            more = {"carried": batch.column("carried")} if carried else {}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2], pa.string()), "kept_text": pa.array(cols[3], pa.string()), "spans": pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), **more})

    return run


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, scratch: Scratch, with_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, spans) for each row of docs that has a doc_id.

    spans are the removed ranges of words. kept_text is the kept words joined by one space, for documents that lose
    words (null for the others, which stay as they are, and without with_text). With carry, these columns of docs come as one more,
    the struct ``carried``, and kept_text is never null: the text as it is where no word goes.
    """
    nb = BUCKETS_PER_PARTITION * partitions(docs.sparkSession)
    carried = [F.struct(*(docs[c] for c in carry)).alias("carried")] if carry else []
    full = texts(docs, docs["doc_id"].cast("long").alias("doc_id"), *carried).where("doc_id is not null")
    source = full.select("doc_id", "text")
    with_starts = lambda rows, found, how: rows.join(found, rows["doc_id"] == found["key"], how).select(*rows.columns, "starts")
    repeated = reduce_buckets(source.mapInArrow(_anchor_packets(nb), SCHEMA), _repeated_anchors(nb), SCHEMA)
    looked = scratch.save(reduce_buckets(repeated, _by_document, "key long, starts binary"), "looked")
    scratch.release()
    later = reduce_buckets(with_starts(source, looked, "inner").mapInArrow(_window_packets(nb), SCHEMA), _later(nb), SCHEMA)
    flagged = scratch.save(reduce_buckets(later, _by_document, "key long, starts binary"), "flagged")
    scratch.drop("looked")
    # Spark holds the shuffles of a job until another has run.
    docs.sparkSession.range(1).repartition(1).count()
    scratch.release()
    out = f"{_REMOVED}, carried {full.schema['carried'].dataType.simpleString()}" if carry else _REMOVED
    return with_starts(full, flagged, "left").mapInArrow(_remove(with_text, bool(carry)), out)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "substrings"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
