"""N-gram Jaccard join: documents whose sets of 5-word shingles overlap by 75 % or more, and their components.

1. Each text gives its set of shingle hashes. Equal sets of one task are merged at once; sets equal across tasks meet by a
   128-bit signature. The others' shingles are shuffled by hash, packed, and counted; a slice of documents sends one that it has
   several times once.
2. Shingles that two or more sets hold go back to their documents. One with less than 75 % of its set among
   them can't be linked. The rest are ordered from the rarest shingle on; a linked pair shares one of the first
   ``n - ceil(0.75 n) + 1``.
3. Documents that share such a shingle, directly or by others, form candidate groups, which are found
   without listing pairs. Each group is joined by a prefix tree (``tree_links``), entered only where a set shares one of
   the probe's rarest shingles, is of a fitting size and not yet of its component. A group beyond ``MOST_TOKENS`` is cut
   into parts that are joined each with a few common pivots; after that only documents outside the group's main
   component still have to meet the others, and do: few of them meet every part, many are dealt, with all others, by their rarest shingles.

Lower-casing is A-Z only, words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no shingles and no links; with
fewer than five words the whole sequence is one. Rows without doc_id are left out; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, bucket_of, chunk_bytes, chunks, connected, hashed_words, mix, offsets, partitions, split_by, table, texts
from inkwell.llm.packets import SCHEMA, Out, as_table, join, reduce_buckets, runs

SHINGLE = 5
#: Links: NUMER / DENOM of the union or more.
NUMER, DENOM = 75, 100
#: Tokens of the sets that one task joins at a time; a larger group is cut.
MOST_TOKENS = 300_000
PIVOTS = 32
#: Sets whose groups (16 bytes each, about 80 in Spark's broadcast) are broadcast at most.
MOST_BROADCAST = 250_000
BUCKETS_PER_PARTITION = 2
_LOW = np.uint64((1 << 48) - 1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

_DOCS, _SIGNS, _POSTINGS, _SAME, _LOCAL, _SEVERAL, _COUNTS = range(7)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def shingles(h: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, 48-bit hash) of each document's distinct shingles, by document; h: word hashes, at: the documents' bounds."""
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    start = _spans(at[:-1], count)
    s = np.zeros(len(doc), np.uint64)
    for k in range(size):
        s += (mix(h + _ODD[k]) * _ODD[(k + 1) % 5])[start + k]
    short = np.flatnonzero((n > 0) & (n < size))
    whole = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short):
        x = h[at[d] : at[d + 1]]
        whole[i] = (mix(x + _ODD[: len(x)]) * _ODD[1 : len(x) + 1]).sum(dtype=np.uint64) + np.uint64(len(x))
    doc, s = np.concatenate([doc, short]), mix(np.concatenate([s, whole])) >> np.uint64(16)
    if len(n) <= 1 << 16:  # document and hash as one number, which is fast to sort
        both = np.sort(doc.astype(np.uint64) << np.uint64(48) | s)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        return (both >> np.uint64(48)).astype(np.int64), both & _LOW
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return doc[fresh], s[fresh]


def required(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of linked sets of n and m elements."""
    return -(-NUMER * (n + m) // (DENOM + NUMER))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-NUMER * n // DENOM) + 1


class Components:
    """Components of numbered elements as one array of labels; the smaller one takes the other's label."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members = [[i] for i in range(n)]

    def join(self, i: int, j: int) -> bool:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


class PrefixTree:
    """A compressed trie of sets, each in one global order (most frequent token first, so that paths are shared).

    Nodes are numbered by level; a node holds a run of tokens. ``overlaps`` goes down all live branches of a level at
    once: a branch's overlap so far is shared by all sets below it, and the branch ends where what remains of the
    probe or of the branch can't reach the overlap that the smallest set below would need. Only branches that lead to a
    set with one of the probe's rarest tokens are entered, and no other node is touched.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order, self.sizes = np.array(order, np.int64), sizes[order]
        rows = [sets[i] for i in order]
        shared = [0]
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            shared.append(int(differ[0]) if len(differ) else k)
        # Nodes as [row, from depth, to depth, parent, first row, end row], by one pass over the sorted sets.
        nodes: list[list[int]] = [[0, 0, 0, -1, 0, 0]]
        path, ends = [0], []
        for r, row in enumerate(rows):
            low = -1
            while nodes[path[-1]][2] > shared[r]:
                low = path.pop()
                nodes[low][5] = r
            if nodes[path[-1]][2] < shared[r]:  # splits the node that was left last
                split = len(nodes)
                nodes.append([nodes[low][0], nodes[low][1], shared[r], path[-1], nodes[low][4], 0])
                nodes[low][1], nodes[low][3] = shared[r], split
                path.append(split)
            if len(row) > nodes[path[-1]][2]:
                nodes.append([r, nodes[path[-1]][2], len(row), path[-1], r, 0])
                path.append(len(nodes) - 1)
            ends.append(path[-1])
        for k in path:
            nodes[k][5] = len(rows)
        kids: list[list[int]] = [[] for _ in nodes]
        for k, x in enumerate(nodes[1:], 1):
            kids[x[3]].append(k)
        now, by_level = [0], []
        while now:
            by_level.append(now)
            now = [c for k in now for c in kids[k]]
        number = {k: i for i, k in enumerate(k for lv in by_level for k in lv)}
        flat = [nodes[k] for lv in by_level for k in lv]
        self.levels = np.cumsum([0, *map(len, by_level)])
        self.parent = np.array([number.get(x[3], 0) for x in flat], np.int64)
        self.at = np.concatenate([[0], np.cumsum([x[2] - x[1] for x in flat])])
        self.tokens = np.concatenate([rows[x[0]][x[1] : x[2]] for x in flat]).astype(np.int64) if self.at[-1] else np.zeros(0, np.int64)
        self.last = np.array([int(rows[x[0]][x[2] - 1]) if x[2] else -1 for x in flat], np.int64)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.below = np.array([int(lengths[x[4] : x[5]].max()) - x[2] for x in flat], np.int64)
        self.least = np.array([int(self.sizes[x[4] : x[5]].min()) for x in flat], np.int64)
        self.node = np.array([number[k] for k in ends], np.int64)
        self.overlap, self.live = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
        self.visited = 0

    def overlaps(self, probe: np.ndarray, size: int, member: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those of the rows (in tree order) that are linked with the probe. member: the probe as a mask of tokens."""
        on = now = np.unique(self.node[rows])
        while len(now):
            now = np.unique(self.parent[now[now > 0]])
            on = np.union1d(on, now)
        self.overlap[on], self.live[on], self.live[0] = 0, False, True
        for nodes in np.split(on, np.searchsorted(on, self.levels[1:-1]))[1:]:
            nodes = nodes[self.live[self.parent[nodes]]]
            if not len(nodes):
                break
            n = self.at[nodes + 1] - self.at[nodes]
            total = np.concatenate([[0], np.cumsum(member[self.tokens[_spans(self.at[nodes], n)]])])
            ends = np.cumsum(n)
            self.visited += len(nodes)
            self.overlap[nodes] = self.overlap[self.parent[nodes]] + total[ends] - total[ends - n]
            rest = len(probe) - np.searchsorted(probe, self.last[nodes], side="right")
            self.live[nodes] = self.overlap[nodes] + np.minimum(rest, self.below[nodes]) >= required(size, self.least[nodes])
        node = self.node[rows]
        return rows[self.live[node] & (self.overlap[node] >= required(size, self.sizes[rows]))]


def _ordered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as increasing ranks, the most frequent token first; tokens of one set only are left out."""
    at = offsets(sets)
    if not at[-1]:
        return [np.zeros(0, np.int64) for _ in sets], 1
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    keep = count > 1
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        t = token[s:e]
        out.append(np.sort(rank[t[keep[t]]]))
    return out, len(count)


def tree_links(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], probe: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the sets that connect what they connect: pairs already joined by others are not listed.

    sizes: the whole sets' sizes (sets may lack elements that no other set has). probe: a mask of the sets that look for
    partners, all by default. known: components found before; equal ones are one from the start. A set's partners share one of its rarest
    tokens (as many as a linked set could lack, and one), are of a fitting size, and not yet in its component.
    """
    ranks, width = _ordered(sets)
    tree = PrefixTree(ranks, sizes)
    place = np.empty(len(ids), np.int64)
    place[tree.order] = np.arange(len(ids))
    groups, out = Components(len(ids)), []
    if known is not None:
        _, first, same = np.unique(known, return_index=True, return_inverse=True)
        for i, f in enumerate(first[same]):
            groups.join(i, int(f))
    # Higher ranks are rarer; tokens of one set only are left out, and come before all others.
    lengths = np.fromiter(map(len, ranks), np.int64, len(ranks))
    rarest = [r[max(0, len(r) - max(0, k)) :] if k > 0 else r[:0] for r, k in zip(ranks, (prefix_length(sizes) - (sizes - lengths)).tolist(), strict=True)]
    token = np.concatenate(rarest)
    row = np.repeat(place, np.fromiter(map(len, rarest), np.int64, len(rarest)))
    order = np.argsort(token * len(ids) + row)
    row, at = row[order], np.searchsorted(token[order], np.arange(width + 1))
    member = np.zeros(width, bool)
    for i in tree.order if probe is None else np.flatnonzero(probe):
        i, size = int(i), int(sizes[i])
        begin = at[rarest[i]]
        rows = np.unique(row[_spans(begin, at[rarest[i] + 1] - begin)])
        if probe is None:
            rows = rows[np.searchsorted(rows, place[i], side="right") :]
        n = tree.sizes[rows]
        rows = rows[(DENOM * np.minimum(n, size) >= NUMER * np.maximum(n, size)) & (groups.label[tree.order[rows]] != groups.label[i])]
        if not len(rows):
            continue
        member[ranks[i]] = True
        for r in tree.overlaps(ranks[i], size, member, rows):
            j = int(tree.order[r])
            if groups.join(i, j):
                out.append((int(ids[i]), int(ids[j])))
        member[ranks[i]] = False
    return out


def _block(chunk: np.ndarray, nb: int) -> np.ndarray:
    """Where a slice of documents is put together again."""
    return (mix(chunk.astype(np.uint64)) % np.uint64(nb)).astype(np.int64)


def _low(x: np.ndarray, n: int) -> np.ndarray:
    """The low n bytes of each number."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n].reshape(-1)


def _number(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), np.uint8)
    out[:, :n] = x.reshape(-1, n)
    return out.view(np.uint64).ravel()


def _five(x: np.ndarray) -> np.ndarray:
    """Five bytes; with its bucket they name a shingle."""
    return _low(x, 5)


def _from_five(x: np.ndarray) -> np.ndarray:
    return _number(x, 5)


def _name(low: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """48 bits of a shingle's five bytes and bucket."""
    return mix(low | bucket.astype(np.uint64) << np.uint64(40)) & _LOW


def _map(nb: int):
    """A slice's documents go to the slice's block; their shingles go by hash and name them by slice and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        for k, (batch, data) in enumerate(chunks(batches, limit=chunk_bytes(nb))):
            out = Out()
            chunk = np.array([TaskContext.get().partitionId() << 32 | k], np.int64)
            home = int(_block(chunk, nb)[0])
            ids = batch.column("doc_id").to_numpy()
            h, at = hashed_words(data, lower=True)
            doc, s = shingles(h, at)
            n = np.bincount(doc, minlength=len(data))
            ends = np.concatenate([[0], np.cumsum(n)])
            one = np.concatenate([[0], np.cumsum(mix(s ^ _ODD[0]), dtype=np.uint64)]).astype(np.uint64)
            two = np.concatenate([[0], np.cumsum(mix(s ^ _ODD[1]), dtype=np.uint64)]).astype(np.uint64)
            one, two = one[ends[1:]] - one[ends[:-1]], two[ends[1:]] - two[ends[:-1]]
            rep, fresh = ids.copy(), np.zeros(len(data), bool)
            for i, key in enumerate(zip(one.tolist(), two.tolist(), n.tolist(), strict=True)):
                if key[2]:
                    rep[i] = seen.setdefault(key, int(ids[i]))
                    fresh[i] = rep[i] == ids[i]
            out.add(_DOCS, home, chunk, np.array([len(ids)], np.uint32), ids, rep, n.astype(np.uint32))
            use = np.flatnonzero(fresh)
            for b, x in split_by(bucket_of(one[use], nb), nb):
                out.add(_SIGNS, b, ids[use[x]], one[use[x]], two[use[x]], np.repeat(chunk, len(x)))
            on = fresh[doc]
            doc, s = doc[on], s[on]
            # A shingle that the slice has several times is sent once for it, with its count; its postings go straight home.
            distinct, back, times = np.unique(s, return_inverse=True, return_counts=True)
            several = np.flatnonzero(times > 1)
            for b, x in split_by(bucket_of(distinct[several] << np.uint64(16), nb), nb):
                out.add(_SEVERAL, b, chunk, np.array([len(x)], np.uint32), _five(distinct[several[x]]), times[several[x]].astype(np.uint32))
            here = np.flatnonzero(times[back] > 1)
            who, count = runs(doc[here])
            out.add(_LOCAL, home, chunk, np.array([len(who)], np.uint32), who.astype(np.uint32), count.astype(np.uint32), _low(s[here], 6))
            alone = np.flatnonzero(times[back] == 1)
            for b, x in split_by(bucket_of(s[alone] << np.uint64(16), nb), nb):
                x = alone[x]
                who, count = runs(doc[x])
                out.add(_POSTINGS, b, chunk, np.array([len(who)], np.uint32), who.astype(np.uint32), count.astype(np.uint32), _five(s[x]))
            yield out.batch()

    return run


def _count(nb: int):
    """A bucket's shingles: those of two sets or more go back to their slices' blocks; equal signatures get one document."""

    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        out = Out()
        for kind in (_DOCS, _LOCAL):
            for p in got.get(kind, []):
                out.kind.append(kind)
                out.bucket.append(bucket)
                out.payload.append(p)
        if _SIGNS in got:
            ids, one, two, chunk = join(got[_SIGNS])
            order = np.lexsort((ids, two, one))
            ids, one, two, chunk = ids[order], one[order], two[order], chunk[order]
            first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            root = np.repeat(ids[first], np.diff(np.append(first, len(ids))))
            on = np.flatnonzero(root != ids)
            for b, x in split_by(_block(chunk[on], nb), nb):
                out.add(_SAME, b, ids[on[x]], root[on[x]])
        none = np.zeros(0, np.int64)
        chunk, size, who, count, low = join(got[_POSTINGS]) if _POSTINGS in got else [none] * 4 + [np.zeros(0, np.uint8)]
        chunk, who, s = np.repeat(np.repeat(chunk, size), count), np.repeat(who, count), _from_five(low)
        slices, many, low, times = join(got[_SEVERAL]) if _SEVERAL in got else [none] * 2 + [np.zeros(0, np.uint8), none]
        slices, again = np.repeat(slices, many), _from_five(low)
        _, back = np.unique(np.concatenate([s, again]), return_inverse=True)
        df = np.minimum(np.bincount(back, np.concatenate([np.ones(len(s)), times])), 65535).astype(np.uint16)[back]
        # The bucket's number is the same for all, so five bytes and it are the token.
        where, on = np.array([bucket], np.uint32), np.flatnonzero(df[: len(s)] > 1)
        for b, x in split_by(_block(chunk[on], nb), nb):
            x = on[x]
            cs, cn = runs(chunk[x])
            pair, pn = runs(chunk[x] << 20 | who[x])
            out.add(_POSTINGS, b, where, np.array([len(x)], np.uint32), np.array([len(pair)], np.uint32), np.array([len(cs)], np.uint32), cs, cn.astype(np.uint32), (pair & 0xFFFFF).astype(np.uint32), pn.astype(np.uint32), _five(s[x]), df[x])
        for b, x in split_by(_block(slices, nb), nb):
            # A block needs a count once, whichever of its slices have the shingle.
            low, first = np.unique(again[x], return_index=True)
            out.add(_COUNTS, b, where, np.array([len(low)], np.uint32), _five(low), df[len(s) :][x[first]])
        return as_table([out.batch()])

    return run


FOUND = "kind int, doc_id long, other long, n long, prefix int, tokens binary"
_FOUND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("prefix", pa.int32()), ("tokens", pa.binary())])


def _documents(nb: int):
    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        return _rows(got, nb)

    return run


def _rows(got: dict[int, list[bytes]], nb: int) -> pa.Table:
    """A block's documents: their rows, those with an equal set elsewhere, and the sets that can have links."""
    parts = []
    copies: set[int] = set()
    if _SAME in got:
        ids, root = join(got[_SAME])
        copies = set(ids.tolist())
        parts.append((np.full(len(ids), _SAME), ids, root, np.zeros(len(ids)), np.zeros(len(ids)), [None] * len(ids)))
    if _DOCS in got:
        slices, size, ids, rep, n = join(got[_DOCS])
        parts.append((np.full(len(ids), _DOCS), ids, rep, n, np.zeros(len(ids)), [None] * len(ids)))
        base = np.cumsum(size) - size
        order = np.argsort(slices)
        slices, base = slices[order], base[order]
    held = []
    if _POSTINGS in got:
        where, size, pairs, n_slices, cs, cn, who, count, low, df = join(got[_POSTINGS])
        # A document's place in the block; it is known by its slice and number there.
        held.append((base[np.searchsorted(slices, np.repeat(cs, cn))] + np.repeat(who, count), _name(_from_five(low), np.repeat(where, size)), df))
    if _COUNTS in got:
        where, size, low, df = join(got[_COUNTS])
        known, first = np.unique(_name(_from_five(low), np.repeat(where, size)), return_index=True)
        cs, cn, who, count, low = join(got[_LOCAL])
        s = _number(low, 6)
        token = _name(s & np.uint64((1 << 40) - 1), bucket_of(s << np.uint64(16), nb))
        held.append((np.repeat(np.repeat(base[np.searchsorted(slices, cs)], cn) + who, count), token, df[first][np.searchsorted(known, token)]))
    if held:
        row, token, df = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((token, df, row))
        row, token = row[order], token[order]
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        end, whole = np.append(at[1:], len(row)), n[row[at]].astype(np.int64)
        keep = [k for k in np.flatnonzero(DENOM * (end - at) >= NUMER * whole) if int(ids[row[at[k]]]) not in copies]
        own = ids[row[at[keep]]] if keep else np.zeros(0, np.int64)
        prefix = prefix_length(whole) - (whole - (end - at))
        parts.append((np.full(len(keep), _POSTINGS), own, own, whole[keep], prefix[keep], [_six(token[at[k] : end[k]]) for k in keep]))
    cols = list(zip(*parts, strict=True))
    return pa.Table.from_arrays([*(pa.array(np.concatenate(c).astype(np.int64)).cast(f.type) for c, f in zip(cols[:5], _FOUND, strict=False)), pa.array([x for c in cols[5] for x in c], pa.binary())], schema=_FOUND)


def _six(token: np.ndarray) -> bytes:
    return np.ascontiguousarray(token).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _tokens(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _prefixes(nb: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, prefix = Out(), batch.column("prefix").to_numpy()
            if batch.num_rows:
                token = np.concatenate([_tokens(t)[:p] for t, p in zip(batch.column("tokens").to_pylist(), prefix.tolist(), strict=True)])
                ids = np.repeat(batch.column("doc_id").to_numpy(), prefix)
                for b, x in split_by((token % np.uint64(nb)).astype(np.int64), nb):
                    who, count = runs(ids[x])
                    out.add(_POSTINGS, b, who, count.astype(np.uint32), token[x])
            yield out.batch()

    return run


def _near(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
    """For each rare shingle its smallest document, joined to the others: as many pairs as documents, not their square."""
    ids, count, token = join(got[_POSTINGS])
    ids = np.repeat(ids, count)
    order = np.lexsort((ids, token))
    ids, token = ids[order], token[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    least = np.repeat(ids[first], np.diff(np.append(first, len(ids))))
    on = least != ids
    pairs = np.unique(np.stack([ids[on], least[on]], axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _links(table: pa.Table) -> pa.Table:
    """Links within each group (or part of one) of the table."""
    groups, rows = table["task"].to_numpy(), table.to_pydict()
    order = np.argsort(groups, kind="stable")
    ends = np.flatnonzero(np.concatenate([groups[order][1:] != groups[order][:-1], [True]])) + 1
    out: list[tuple[int, int]] = []
    for s, e in zip([0, *ends[:-1]], ends, strict=True):
        own = order[s:e]
        if len(own) < 2:
            continue
        ids, sizes = np.array([rows["doc_id"][k] for k in own]), np.array([rows["n"][k] for k in own])
        probe = np.array([bool(rows["probe"][k]) for k in own])
        known = np.array([rows["known"][k] for k in own])
        out += tree_links(ids, sizes, [_tokens(rows["tokens"][k]) for k in own], None if probe.all() else probe, known)
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _join_groups(rows: DataFrame) -> DataFrame:
    """Links of (pack, task, doc_id, n, tokens, probe, known); a pack holds whole tasks, and is what one call gets."""
    return rows.groupBy("pack").applyInArrow(lambda t: _links(t), "a long, b long")


def _by_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets for each share of their group that one of their rarest shingles falls to; linked sets have one of these in common."""
    for batch in batches:
        where, task = [], []
        for k, (group, shares, prefix, tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "shares", "prefix", "tokens")), strict=True)):
            own = np.unique(mix(_tokens(tokens)[:prefix]) % np.uint64(shares)).astype(np.int64)
            where.append(np.full(len(own), k))
            task.append(mix(own.astype(np.uint64) + mix(np.array([group], np.int64).astype(np.uint64))).view(np.int64))
        if where:
            rows, tasks = batch.take(pa.array(np.concatenate(where))), pa.array(np.concatenate(task))
            yield pa.RecordBatch.from_pydict({"pack": tasks, "task": tasks} | {c: rows.column(c) for c in ("doc_id", "n", "tokens", "probe", "known")})


def group_documents(docs: DataFrame, scratch: Scratch, most_tokens: int = MOST_TOKENS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs that has a doc_id."""
    spark = docs.sparkSession
    nb = min(1 << 16, BUCKETS_PER_PARTITION * partitions(spark))
    source = texts(docs, F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    counted = reduce_buckets(source.mapInArrow(_map(nb), SCHEMA), _count(nb), SCHEMA)
    found = scratch.save(reduce_buckets(counted, _documents(nb), FOUND), "found")
    scratch.release()
    rows = found.where(f"kind = {_DOCS}").select("doc_id", F.col("other").alias("rep"), "n")
    same = found.where(f"kind = {_SAME}").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
    sets = found.where(f"kind = {_POSTINGS}").select("doc_id", "n", "prefix", "tokens")

    # Fewer buckets, as documents with several rare shingles in common are one edge in each of them; rare shingles take little room.
    near = reduce_buckets(sets.select("doc_id", "prefix", "tokens").mapInArrow(_prefixes(max(1, nb // 8)), SCHEMA), _near, "a long, b long")
    group = connected(scratch, near, "groups").select(F.col("node").alias("doc_id"), F.col("root").alias("group"))
    # Two numbers a set; beyond the bound the sets are shuffled instead.
    group = F.broadcast(group) if group.count() <= most_broadcast else group.hint("merge")
    sets = sets.join(group, "doc_id").withColumn("weight", F.octet_length("tokens") / 6)
    parts = sets.groupBy("group").agg(F.ceil(F.sum("weight") / most_tokens).cast("int").alias("parts"), F.count("*").alias("members"))
    large = scratch.save(parts.where("parts > 1"), "large")
    any_large = not large.isEmpty()
    packs = F.pmod(F.xxhash64("group"), F.lit(nb))
    small = sets.join(large, "group", "left_anti").select(packs.alias("pack"), F.col("group").alias("task"), "doc_id", "n", "tokens", F.lit(True).alias("probe"), F.col("doc_id").alias("known"))
    links = scratch.save(_join_groups(small), "links")
    if any_large:
        part_of = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
        cut = scratch.save(sets.join(large, "group").withColumn("part", part_of), "cut")
        pivot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1).cast("long"), (F.col("members") / PIVOTS).cast("long"))) == 0
        with_pivots = cut.withColumn("part", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
        task = F.xxhash64("group", "part")
        first_links = scratch.save(_join_groups(with_pivots.select(task.alias("pack"), task.alias("task"), "doc_id", "n", "tokens", F.lit(True).alias("probe"), F.col("doc_id").alias("known"))), "first")
        roots = connected(scratch, first_links, "parts").withColumnRenamed("node", "doc_id")
        rooted = scratch.save(cut.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "rooted")
        scratch.drop("cut")
        main = rooted.groupBy("group", "root").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
        rest = scratch.save(rooted.join(main, "group").where("root <> main"), "rest")
        # Those outside the main component still have to meet the others: where they are few, every part, a bounded number at a
        # time; else by their rarest shingles, so that a group's work follows its size, not its square.
        spread = F.sum(F.col("weight") * F.col("prefix"))
        whole = rooted.groupBy("group").agg(F.sum("weight").alias("tokens"), spread.alias("spread"), F.max("parts").alias("parts"))
        ways = rest.groupBy("group").agg(F.sum("weight").alias("outside")).join(whole, "group").select("group", F.ceil(F.col("outside") / most_tokens).cast("int").alias("turns"), F.ceil(F.col("spread") / most_tokens).cast("int").alias("shares"), (F.col("outside") * F.col("parts") + F.col("tokens") * F.ceil(F.col("outside") / most_tokens) > F.col("spread")).alias("by_token"))
        ways = scratch.save(ways, "ways")
        turns = ways.where("not by_token").select("group", "turns")
        probes = rest.join(turns, "group").withColumn("turn", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("turns")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = rooted.join(turns, "group").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        task = lambda part: F.xxhash64("group", part, "turn")
        meet = probes.select(task("to").alias("pack"), task("to").alias("task"), "doc_id", "n", "tokens", F.lit(True).alias("probe"), F.col("root").alias("known"))
        meet = meet.unionByName(held.select(task("part").alias("pack"), task("part").alias("task"), "doc_id", "n", "tokens", F.lit(False).alias("probe"), F.col("root").alias("known")))
        many = rooted.join(main, "group").join(ways.where("by_token").select("group", "shares"), "group").select("group", "shares", "doc_id", "n", "prefix", "tokens", (F.col("root") != F.col("main")).alias("probe"), F.col("root").alias("known"))
        meet = meet.unionByName(many.mapInArrow(_by_token, "pack long, task long, doc_id long, n long, tokens binary, probe boolean, known long"))
        links = scratch.save(links.union(first_links).union(_join_groups(meet)), "all-links")
        for name in ("links", "first", "rooted", "rest", "ways"):
            scratch.drop(name)
    # A representative need not have its copies' smallest doc_id; with an edge to that one a root is the component's id.
    least = rows.groupBy(F.col("rep").alias("a")).agg(F.min("doc_id").alias("b")).where("a <> b")
    root = connected(scratch, same.union(links).union(least), "all")
    return rows.join(root, rows["rep"] == root["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard"))
