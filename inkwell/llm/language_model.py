"""LM scoring: a hashed maximum-entropy model of word n-grams and skips under a class-factored softmax.

A word's probability is its class's, given the words before, times the word's within the class. A word's class is a hash
of its ending, so it is known without a dictionary; the end of a text is a class of its own. Both factors are softmaxes:

* class: bias, class before, class before last and their pair (hashed), plus weights of the skip (word before last, class)
  and of the word trigram (two words before, class);
* word within the class: log (count + 1) as bias, plus weights of the word bigram and of the word trigram.

1. One pass counts words, and classes by the classes of two words before, over all training documents. The class
   softmax of these is fitted by gradients that Spark's tasks compute and add up; it is small and is broadcast.
2. Every token goes by the hash of the word before last to all others of that word. The weights of that word's skip and trigram features
   live there, and only there: the table of weights is spread over the tasks and grows with the corpus. A task fits its own
   weights by gradient steps (``train``) and scores its tokens. Words outside the broadcast dictionary meet their own
   counts in the same shuffle.
3. Every token goes by the hash of the word before and its class to all others of these, where the weights of their bigrams and trigrams
   are fitted, and the tokens scored, in the same way.

Features of one family are fitted with those before them held fixed, so a context's normaliser is a sum over its own
events: all outcomes without an event keep the prior's logit. Frequent words' features are split by the other word before,
so that no task gets all tokens next to one word. Names of words in features are hashes of 24 bits and more.

Lower-casing is A-Z only, words are ``[^\\x20\\x09-\\x0D]+``, followed by one end. Null and empty texts consist of the end.
Rows without doc_id are left out; rows are told apart by doc_id and text, and equal rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, Words, bucket_of, chunk_bytes, chunks, mix, partitions, split_by, table, texts
from inkwell.llm.packets import SCHEMA, Out, as_table, join, reduce_buckets, runs

#: Classes of words; the next number is the end's as a class, and the beginning's as a context.
CLASSES = 64
WIDE = CLASSES + 1
CONTEXTS = WIDE * WIDE
#: Features of the broadcast softmax: bias, class before, class before last, the pair hashed.
HASHED = 1 << 12
FEATURES = 1 + 2 * WIDE + HASHED
#: Words in the broadcast dictionary, about.
FREQUENT = 200_000
ROUNDS = 12
#: Quadratic penalty of the broadcast softmax.
PRIOR = 2.0
BUCKETS_PER_PARTITION = 1
#: Tokens whose weights are fitted at a time, about; a bucket with more is done in parts, each with whole contexts.
MOST_TOKENS = 600_000

_WORDS, _CONTEXTS, _DOCS, _RARE, _SKIPS, _GRAMS, _BASE, _SUMS, _AGAIN, _SUMS_AGAIN = range(10)
#: Quadratic penalty of each family's weights (chosen on training rows alone): skip, class by trigram, bigram, trigram.
SKIP, PAIR, BIGRAM, TRIGRAM = 0.5, 0.2, 0.2, 0.1
#: Gradient steps of a family, and the longest step of a weight.
STEPS = 5
LONGEST = 4.0


def read(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number of every word, whose lowest 6 bits are its class, and the documents' bounds."""
    words = Words([x.lower() for x in data])
    h = words.hashes()
    last = words.raw[words.end - 1].astype(np.uint64)
    before = np.where(words.end - words.start > 1, words.raw[words.end - 2], 0).astype(np.uint64)
    return h & ~np.uint64(63) | mix(last << np.uint64(8) | before) & np.uint64(63), words.at


def is_training(ids: np.ndarray) -> np.ndarray:
    return np.fromiter((zlib.crc32(str(i).encode()) % 7 != 2 for i in ids.tolist()), bool, len(ids))


def contexts(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, context, class) of every token, ends included; a context is class before last * WIDE + class before."""
    n = np.diff(at) + 1
    doc = np.repeat(np.arange(len(n)), n)
    last = np.cumsum(n) - 1
    c = np.full(len(doc), CLASSES, np.int64)
    words = np.ones(len(doc), bool)
    words[last] = False
    c[words] = (h & np.uint64(63)).astype(np.int64)
    one, two = np.full(len(c), CLASSES), np.full(len(c), CLASSES)
    one[1:] = np.where(doc[1:] == doc[:-1], c[:-1], CLASSES)
    two[2:] = np.where(doc[2:] == doc[:-2], c[:-2], CLASSES)
    return doc, two * WIDE + one, c


def features(ctx: np.ndarray) -> np.ndarray:
    pair = (mix(ctx.astype(np.uint64)) % np.uint64(HASHED)).astype(np.int64)
    return np.stack([np.zeros(len(ctx), np.int64), 1 + ctx % WIDE, 1 + WIDE + ctx // WIDE, 1 + 2 * WIDE + pair], axis=1)


def softmax(weights: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Probabilities of the classes in each context."""
    z = weights[features(ctx)].sum(axis=1)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _count(nb: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.zeros(CONTEXTS * WIDE, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out = Out()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.uint32)

        for batch, data in chunks(batches):
            train = is_training(batch.column("doc_id").to_numpy())
            h, at = read([x for x, t in zip(data, train, strict=True) if t])
            if not len(at) > 1:
                continue
            _, ctx, c = contexts(h, at)
            table_ += np.bincount(ctx * WIDE + c, minlength=len(table_))
            held.append(np.unique(h, return_counts=True))
            if len(held) == 16:
                held = [merged()]
        if held:
            h, n = merged()
            for k, x in split_by(bucket_of(h, nb), nb):
                out.add(_WORDS, k, h[x], n[x])
            cell = np.flatnonzero(table_)
            for k, x in split_by(cell // (WIDE * WIDE) % nb, nb):
                out.add(_CONTEXTS, k, cell[x].astype(np.uint32), table_[cell[x]])
        if out.kind:
            yield out.batch()

    return run


def _totals(most: int):
    """A bucket's word counts: sums by class, the most frequent words; and its cells of the context table."""

    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        kind, a, b = [], [], []
        if _WORDS in got:
            h, n = join(got[_WORDS])
            h, back = np.unique(h, return_inverse=True)
            n = np.bincount(back, n).astype(np.int64)
            c = (h & np.uint64(63)).astype(np.int64)
            top = np.argsort(-n, kind="stable")[:most]
            for k, x, y in ((0, np.arange(CLASSES), np.bincount(c, n, CLASSES).astype(np.int64)), (1, np.arange(CLASSES), np.bincount(c, minlength=CLASSES)), (2, h[top].view(np.int64), n[top])):
                kind.append(np.full(len(x), k))
                a.append(x)
                b.append(y)
        if _CONTEXTS in got:
            cell, n = join(got[_CONTEXTS])
            cell, back = np.unique(cell, return_inverse=True)
            kind.append(np.full(len(cell), 3))
            a.append(cell.astype(np.int64))
            b.append(np.bincount(back, n).astype(np.int64))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"kind": pa.array(cat(kind), pa.int32()), "a": pa.array(cat(a), pa.int64()), "b": pa.array(cat(b), pa.int64())})

    return run


def gradient_of(weights: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood's gradient by the broadcast softmax's weights, and its curvature for each alone; n: counts of the classes in each context."""
    p, m = softmax(weights, ctx), n.sum(axis=1)[:, None]
    total, curved = np.zeros_like(weights), np.zeros_like(weights)
    for f in features(ctx).T:
        np.add.at(total, f, n - m * p)
        np.add.at(curved, f, m * p * (1 - p))
    return total, curved


def fit(cells: DataFrame, rounds: int = ROUNDS, rate: float = 0.3) -> np.ndarray:
    """Weights of the broadcast class softmax from (cell, count), a table of CONTEXTS * WIDE rows at most.

    A round's gradient is computed by Spark's tasks, each over its contexts, and added up; a weight's step is its gradient
    over its curvature, by a rate that allows for four weights of an outcome moving at once.
    """
    by_context = cells.groupBy(F.expr(f"a div {WIDE}").alias("ctx")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("a") % WIDE).cast("int"), "b"))).alias("n")).coalesce(8)
    by_context = by_context.select(F.col("ctx").cast("int"), F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda c: F.coalesce(F.element_at("n", c), F.lit(0))).alias("n")).cache()
    weights = np.zeros((FEATURES, WIDE))
    spark = cells.sparkSession
    packed = lambda x: pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, curved = np.zeros((FEATURES, WIDE)), np.zeros((FEATURES, WIDE))
            for batch in batches:
                if batch.num_rows:
                    ctx = batch.column("ctx").to_numpy().astype(np.int64)
                    g, c = gradient_of(shared.value, ctx, batch.column("n").flatten().to_numpy().reshape(len(ctx), WIDE).astype(float))
                    total, curved = total + g, curved + c
            on = np.flatnonzero(curved.any(axis=1))
            yield pa.RecordBatch.from_pydict({"f": pa.array(on.astype(np.int32)), "g": packed(total[on]), "c": packed(curved[on])})

        got = by_context.mapInArrow(run, "f int, g binary, c binary").toArrow()
        g, c = np.zeros_like(weights), np.zeros_like(weights)
        if got.num_rows:
            for to, name in ((g, "g"), (c, "c")):
                np.add.at(to, got["f"].to_numpy(), np.stack([np.frombuffer(x, "<f4") for x in got[name].to_pylist()]))
        weights = weights + np.clip(rate * (g - PRIOR * weights) / (c + PRIOR), -1, 1)
    by_context.unpersist()
    return weights


class Model:
    """What all tasks of scoring need, of bounded size: the dictionary and the class softmax. N-grams' weights are met by shuffle."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, by_class: np.ndarray, distinct: np.ndarray, ends: int, weights: np.ndarray, nb: int) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        # Words by falling count: a word's number in this order is small for most tokens.
        self.ordered = np.argsort(-self.counts, kind="stable").astype(np.int32)
        self.number = np.empty(len(words), np.uint32)
        self.number[self.ordered] = np.arange(len(words))
        self.ends, self.n = ends, int(by_class.sum()) + ends
        self.v = int(distinct.sum()) + (ends > 0)
        self.base = float(np.log10(self.n + 1 * (self.v + 1)))
        self.within = np.log(by_class + distinct + 1.0)
        self.classes = np.log(softmax(weights, np.arange(CONTEXTS))).astype(np.float32)
        # Into how many parts a frequent word's features are split, so that no bucket gets all tokens next to it.
        self.parts = np.maximum(1, np.ceil(self.counts * (2 * nb / max(1, self.n)))).astype(np.uint32)

    def parts_of(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.parts[place], np.uint32(1)) if len(self.parts) else np.ones(len(place), np.uint32)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Each word's place in the dictionary; -1 if it isn't there. Distinct words are looked up once."""
        if not len(self.words):
            return np.full(len(h), -1)
        distinct, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        return np.where(self.words[at] == distinct, at, -1)[back]


def before(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of the words before last and before, for every token, ends included; 0 at the beginning. The lowest 6 are a word's class."""
    w = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return shifted(w, at, 2, 0), shifted(w, at, 1, 0)


def salted(word: np.ndarray, parts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The words before, those of frequent words in several parts by the other word; the class, in the lowest bits, stays."""
    salt = mix(other.astype(np.uint64)) % parts.astype(np.uint64)
    return word + (salt * np.uint64(0x9E3779C0)).astype(np.uint32)


def shifted(x: np.ndarray, at: np.ndarray, by: int, fill: int) -> np.ndarray:
    """For every token, ends included, the number of the word that many before it in its text."""
    n = np.diff(at) + 1
    doc = np.repeat(np.arange(len(n)), n)
    own = np.full(len(doc), fill, x.dtype)
    word = np.ones(len(doc), bool)
    word[np.cumsum(n) - 1] = False
    own[word] = x
    out = np.full(len(doc), fill, x.dtype)
    out[by:] = np.where(doc[by:] == doc[:-by], own[:-by], fill)
    return out


def row_keys(ids: np.ndarray, data: list[bytes]) -> np.ndarray:
    return mix(ids.astype(np.uint64)) ^ np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data))


def rank(key: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers, from 0 on, in the keys' order."""
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]])) if len(s) else 0
    return out


def normalisers(theta: np.ndarray, of: np.ndarray, prior: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(events' probabilities, contexts' normalisers): outcomes without an event keep the prior, so events only add to 1."""
    grown = prior * np.exp(theta)
    z = 1 + np.bincount(of, grown - prior, size)
    return grown / z[of], z


def objective(theta: np.ndarray, n: np.ndarray, m: np.ndarray, of: np.ndarray, prior: np.ndarray, penalty: float) -> float:
    """The penalised log-likelihood; n: training counts of the events, of: their contexts, whose counts are m."""
    p, z = normalisers(theta, of, prior, len(m))
    rest = m - np.bincount(of, n, len(m))  # outcomes without an event
    return float((n * np.log(p)).sum() - (rest * np.log(z)).sum() - penalty / 2 * (theta**2).sum())


def gradient_at(theta: np.ndarray, n: np.ndarray, m: np.ndarray, of: np.ndarray, prior: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The objective's gradient, and its curvature for each weight alone."""
    p, _ = normalisers(theta, of, prior, len(m))
    expected = m[of] * p
    return n - expected - penalty * theta, expected * (1 - p) + penalty


def train(context: np.ndarray, event: np.ndarray, training: np.ndarray, prior: np.ndarray, penalty: float, steps: int = STEPS) -> np.ndarray:
    """Each token's probability under weights of its event, (context, outcome), which are fitted here by gradient steps.

    training: whether a token counts. An event's prior must be the same for all its tokens. Events that no training
    token has keep weight 0. A weight's step is its gradient over its own curvature, and limited; the weights start where one
    event alone in its context would end. The sum over all outcomes of a context stays what the prior's is, 1.
    """
    if not len(event):
        return prior
    size = int(context.max()) + 1
    first = np.empty(int(event.max()) + 1, np.int32)
    first[event] = np.arange(len(event), dtype=np.int32)
    count = np.bincount(event, training)
    on = np.flatnonzero(count)
    of, q = context[first[on]], np.clip(prior[first[on]], 1e-30, 1 - 1e-9)
    n, m = count[on], np.bincount(context, training, size)
    share = n / (m[of] + penalty)
    theta = np.clip(np.log(share * (1 - q) / (q * (1 - share))), -LONGEST, 3 * LONGEST)
    for _ in range(steps):
        gradient, curved = gradient_at(theta, n, m, of, q, penalty)
        theta += np.clip(gradient / (curved + 0.05 * n), -LONGEST, LONGEST)
    _, z = normalisers(theta, of, q, size)
    weight = np.ones(len(count))
    weight[on] = np.exp(theta)
    return prior * weight[event] / z[context]


def skip_gradient(w: np.ndarray, n: np.ndarray, m: np.ndarray, prior: np.ndarray, word: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The gradient by the skips' weights w (word, class), and the cells' normalisers.

    A cell is a word before last with a class context, in order of the words: m has its count, prior its row of class probabilities,
    word its row of w and n, first where each word's cells begin.
    """
    e = np.exp(w)
    z = np.einsum("ij,ij->i", prior, e[word])
    expected = np.add.reduceat((m / z)[:, None] * prior, first, axis=0) * e
    return n - expected - penalty * w, z


def skips(v: np.ndarray, ctx: np.ndarray, c: np.ndarray, training: np.ndarray, classes: np.ndarray, penalty: float = SKIP, steps: int = 2, block: int = 8192) -> np.ndarray:
    """Each token's class probability under weights of the skip (word before last v, class), fitted over all class contexts of v.

    ctx: class contexts, a function of v and the class before; classes: log probabilities of the classes in each. Words are
    done some cells at a time, as their weights don't meet.
    """
    if not len(v):
        return np.zeros(0)
    cell = rank(v.astype(np.int64) * WIDE + ctx % WIDE)
    one = np.empty(int(cell.max()) + 1, np.int32)
    one[cell] = np.arange(len(cell), dtype=np.int32)
    word, of, m = v[one], ctx[one], np.bincount(cell, training).astype(np.float32)
    n = np.bincount(v.astype(np.int64) * WIDE + c, training, (int(v.max()) + 1) * WIDE).astype(np.float32).reshape(-1, WIDE)
    first = np.searchsorted(word, np.arange(len(n) + 1))
    weights, z = np.zeros_like(n), np.empty(len(one), np.float32)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + block, side="right")) - 1)
        a, b = first[lo], first[hi]
        own, w, prior, begin = n[lo:hi], weights[lo:hi], np.exp(classes[of[a:b]]), first[lo:hi] - a
        row, seen = word[a:b] - lo, n[lo:hi] > 0
        expected = np.add.reduceat(m[a:b, None] * prior, begin, axis=0)
        w[seen] = np.log((own + penalty) / (expected + penalty))[seen]
        for _ in range(steps):
            gradient, _ = skip_gradient(w, own, m[a:b], prior, row, begin, penalty)
            w += np.where(seen, np.clip(gradient / (own + 2 * penalty), -1, 1), 0)
        _, z[a:b] = skip_gradient(w, own, m[a:b], prior, row, begin, penalty)
        lo = hi
    return np.exp(classes[ctx, c].astype(float) + weights[v, c]) / z[cell]


def _wide(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def _dealt(h: np.ndarray, nb: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions), in order."""
    return split_by(bucket_of(h, nb), nb)


def _place(one: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(_wide(one, c))


def _short(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest 24 bits of each number, in two arrays."""
    return w.astype(np.uint16), (w >> np.uint32(16)).astype(np.uint8)


def _long(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high.astype(np.uint32) << np.uint32(16) | low


def in_parts(key: np.ndarray, f: Callable[[np.ndarray], np.ndarray], most: int = MOST_TOKENS) -> np.ndarray:
    """f (of positions, giving a number for each) for all positions, in parts that keep equal keys together."""
    m = -(-len(key) // most)
    out = np.empty(len(key))
    for _, x in split_by((mix(key.astype(np.uint64)) >> np.uint64(20)) % np.uint64(max(1, m)), max(1, m)):
        out[x] = f(x)
    return out


def _home(chunk: np.ndarray, nb: int) -> np.ndarray:
    """Where what is found out about a slice of documents is put together."""
    return (mix(chunk.astype(np.uint64)) % np.uint64(nb)).astype(np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32)


def class_factors(two: np.ndarray, one: np.ndarray, c: np.ndarray, training: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Each token's class probability by the class contexts, the skip and the trigram's context."""
    ctx = np.where(two == 0, CLASSES, two & 63).astype(np.int32) * WIDE + np.where(one == 0, CLASSES, one & 63)
    p, pair = skips(rank(two), ctx, c, training, classes), rank(_wide(two, one))
    return train(pair, rank(pair.astype(np.int64) * WIDE + c), training, p, PAIR)


def word_factors(two: np.ndarray, one: np.ndarray, word: np.ndarray, training: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Each word's probability within its class by its share, the bigram and the trigram."""
    context = rank(_wide(one, word & 63))
    bigram = rank(_wide(context, word))
    p = train(context, bigram, training, share, BIGRAM)
    return train(rank(_wide(context, two)), rank(_wide(bigram, two)), training, p, TRIGRAM)


class Slices:
    """Slices of a task's documents, and packets of their tokens: a document is known by its slice and number there."""

    def __init__(self, batches: Iterator[pa.RecordBatch], model: Model, nb: int) -> None:
        self.batches, self.model, self.nb = batches, model, nb

    def __iter__(self) -> Iterator[tuple[Out, list[bytes], np.ndarray, np.ndarray]]:
        """(packets, texts, doc_ids, row keys) of each slice, whose words, bounds and dictionary places are set."""
        for k, (batch, data) in enumerate(chunks(self.batches, limit=chunk_bytes(self.nb))):
            ids = batch.column("doc_id").to_numpy()
            self.out, self.chunk = Out(), np.array([TaskContext.get().partitionId() << 32 | k], np.int64)
            self.training = is_training(ids)
            self.h, self.at = read(data)
            self.doc = np.repeat(np.arange(len(ids)), np.diff(self.at))
            self.place = self.model.place(self.h)
            yield self.out, data, ids, row_keys(ids, data)

    def add(self, kind: int, bucket: int, doc: np.ndarray, *values: np.ndarray) -> None:
        who, size = runs(doc)
        self.out.add(kind, bucket, self.chunk, np.array([len(who)], np.uint32), _small(who << 1 | self.training[who]), _small(size), *values)

    def documents(self, kind: int, *values: np.ndarray) -> None:
        self.out.add(kind, int(_home(self.chunk, self.nb)[0]), self.chunk, np.array([len(values[0])], np.uint32), *values)


class Tokens:
    """Tokens of many slices' packets."""

    def __init__(self, payloads: list[bytes]) -> None:
        chunk, n, who, self.size, *self.values = join(payloads)
        self.chunk, self.who, self.size = np.repeat(chunk, n), who >> 1, self.size.astype(np.int64)
        self.training = np.repeat((who & 1).astype(np.uint8), self.size)

    def sums(self, out: Out, kind: int, nb: int, *values: np.ndarray, to: type = np.float32) -> None:
        """Each document's sums of the tokens' values, for its slice's home."""
        first = np.cumsum(self.size) - self.size
        added = [np.add.reduceat(v, first) for v in values]
        for k, x in split_by(_home(self.chunk, nb), nb):
            chunk, n = runs(self.chunk[x])
            out.add(kind, k, chunk, n.astype(np.uint32), _small(self.who[x]), *(v[x].astype(to) for v in added))


def _score(shared, nb: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        slices = Slices(batches, m, nb)
        for out, _, ids, keys in slices:
            h, at, place, n_docs = slices.h, slices.at, slices.place, len(ids)
            doc, _, c = contexts(h, at)
            two, one = before(h, at)
            found = place >= 0
            count = np.where(found, m.counts[place], 0) if len(m.words) else np.zeros(len(h), np.int64)
            base = np.bincount(slices.doc, np.where(found, np.log10(count + 1.0), 0), n_docs) + np.log10(m.ends + 1.0)
            known = np.bincount(slices.doc[found & (count > 0)], minlength=n_docs) + (m.ends > 0)
            slices.documents(_DOCS, keys, ids, np.diff(at) + 1, known, base)
            split = salted(two, shifted(m.parts_of(place), at, 2, 1), one)
            for k, x in _dealt(mix(split.astype(np.uint64)), nb):
                slices.add(_SKIPS, k, doc[x], *_short(split[x]), *_short(one[x]), c[x].astype(np.uint8))
            words = c < CLASSES
            two, one = two[words], salted(one, shifted(-(-m.parts_of(place) // 8), at, 1, 1), two)[words]
            rest = np.flatnonzero(~found)
            for k, x in _dealt(h[rest], nb):
                x = rest[x]
                slices.add(_RARE, k, slices.doc[x], h[x], two[x].astype(np.uint16), *_short(one[x]))
            yield out.batch()

    return run


def _passed(out: Out, bucket: int, got: dict[int, list[bytes]], *kinds: int) -> None:
    for kind in kinds:
        for p in got.get(kind, []):
            out.kind.append(kind)
            out.bucket.append(bucket)
            out.payload.append(p)


def _classes(shared, nb: int):
    """Class factors of a bucket's words before last; the counts of its rare words, which go on to their bigrams."""

    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        out = Out()
        _passed(out, bucket, got, _DOCS)
        if _SKIPS in got:
            t = Tokens(got.pop(_SKIPS))
            two, one, c = _long(*t.values[:2]), _long(*t.values[2:4]), t.values[4]
            t.sums(out, _SUMS, nb, in_parts(two, lambda x: np.log10(class_factors(two[x], one[x], c[x], t.training[x], shared.value.classes))))
        if _RARE in got:
            t = Tokens(got[_RARE])
            h, two, *one = t.values
            word = rank(h)
            count = np.bincount(word, t.training)[word]
            t.sums(out, _BASE, nb, np.log10(count + 1.0), (count > 0).astype(float), to=np.float64)
            chunk, who = np.repeat(t.chunk, t.size), np.repeat(t.who.astype(np.uint32) << 1, t.size) | t.training
            for k, x in _dealt(_place(_long(*one), h & np.uint64(63)), nb):
                size = np.ones(len(x), np.uint16)
                cs, n = runs(chunk[x])
                out.add(_GRAMS, k, cs, n.astype(np.uint32), _small(who[x]), size, two[x], one[0][x], one[1][x], (h[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32), _small(count[x].astype(np.int64)))
        return as_table([out.batch()])

    return run


def _grams(shared, nb: int):
    """The tokens that the dictionary has, for the place of their bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        slices = Slices(batches, m, nb)
        for out, _, _, keys in slices:
            h, at, place = slices.h, slices.at, slices.place
            slices.documents(_AGAIN, keys)
            two, one = before(h, at)
            words = np.ones(len(two), bool)
            words[np.cumsum(np.diff(at) + 1) - 1] = False
            two, one = two[words], salted(one, shifted(-(-m.parts_of(place) // 8), at, 1, 1), two)[words]
            here = np.flatnonzero(place >= 0)
            number = m.number[place] if len(m.number) else place
            for k, x in _dealt(_place(one[here] & np.uint32(0xFFFFFF), h[here] & np.uint64(63)), nb):
                x = here[x]
                slices.add(_WORDS, k, slices.doc[x], two[x].astype(np.uint16), *_short(one[x]), *_short(number[x]))
            yield out.batch()

    return run


def _within(shared, nb: int):
    """The factors within the class, by bigram and trigram."""

    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        m: Model = shared.value
        out, parts = Out(), []
        _passed(out, bucket, got, _AGAIN)
        if _WORDS in got:
            t = Tokens(got.pop(_WORDS))
            place = m.ordered[_long(*t.values[3:])]
            parts.append((t, _SUMS_AGAIN, t.values[0], _long(*t.values[1:3]), (m.words[place] & np.uint64(0xFFFFFFFF)).astype(np.uint32), m.counts[place]))
        if _GRAMS in got:
            t = Tokens(got.pop(_GRAMS))
            parts.append((t, _SUMS, t.values[0], _long(*t.values[1:3]), t.values[3], t.values[4]))
        if parts:
            two, one, w, count = (np.concatenate(x) for x in list(zip(*parts, strict=True))[2:])
            training = np.concatenate([x[0].training for x in parts])
            share, at = (count + 1.0) / np.exp(m.within)[w & 63], 0
            p = in_parts(_wide(one, w & 63), lambda x: np.log10(word_factors(two[x], one[x], w[x], training[x], share[x])))
            for t, kind, own, *_ in parts:
                t.sums(out, kind, nb, p[at : at + len(own)])
                at += len(own)
        return as_table([out.batch()])

    return run


def _by_row(nb: int):
    """A home's slices: their documents with all sums, for the place of their rows' keys."""

    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        out = Out()
        for docs, kinds in ((_DOCS, (_SUMS, _BASE)), (_AGAIN, (_SUMS_AGAIN,))):
            if docs not in got:
                continue
            slices, size, keys, *values = join(got[docs])
            base, order = np.cumsum(size, dtype=np.int64) - size, np.argsort(slices)

            def added(kind: int, n: int, slices=slices, base=base, order=order, keys=keys) -> list[np.ndarray]:
                if kind not in got:
                    return [np.zeros(len(keys))] * n
                chunk, times, who, *sums = join(got[kind])
                row = (base[order][np.searchsorted(slices[order], chunk)]).repeat(times) + who
                return [np.bincount(row, x, len(keys)) for x in sums]

            score = added(kinds[0], 1)[0]
            if docs == _DOCS:
                ids, n, known, logs = values
                more, new = added(_BASE, 2)
                values = [ids, n, known + np.rint(new).astype(np.int64), logs + more]
            for k, x in _dealt(mix(keys), nb):
                out.add(docs, k, keys[x], score[x], *(v[x] for v in values))
        return as_table([out.batch()])

    return run


def _finish(model_n: int, base_log: float):
    def run(bucket: int, got: dict[int, list[bytes]]) -> pa.Table:
        if _DOCS not in got:
            keys, score, ids, n, known, base = [np.zeros(0, np.int64)] * 6
        else:
            keys, score, ids, n, known, base = join(got[_DOCS])
            again, more = join(got[_AGAIN])
            # Equal rows share a key and have equal sums.
            order = np.argsort(keys)
            score = score.copy()
            score[order] += more[np.argsort(again)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(ids), model_n), pa.int64()), "base_score": pa.array(base - n * base_log, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score_documents(docs: DataFrame, scratch: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs that has a doc_id."""
    spark = docs.sparkSession
    nb = BUCKETS_PER_PARTITION * partitions(spark)
    source = texts(docs, F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    counted = reduce_buckets(source.mapInArrow(_count(nb), SCHEMA), _totals(max(1, frequent // nb)), "kind int, a long, b long")
    counted = scratch.save(counted, "counts")
    scratch.release()
    totals = counted.where("kind < 2").groupBy("kind", "a").agg(F.sum("b").alias("b")).collect()
    by_class, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        (distinct if r["kind"] else by_class)[r["a"]] = r["b"]
    top = counted.where("kind = 2").select("a", "b").toArrow()
    cells = counted.where("kind = 3").select("a", "b")
    ends = int(cells.where(F.col("a") % WIDE == CLASSES).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0])
    model = Model(top["a"].to_numpy().view(np.uint64), top["b"].to_numpy(), by_class, distinct, ends, fit(cells), nb)
    scratch.drop("counts")
    scratch.release()
    shared = spark.sparkContext.broadcast(model)
    parts = scratch.save(reduce_buckets(source.mapInArrow(_score(shared, nb), SCHEMA), _classes(shared, nb), SCHEMA), "classes")
    # Spark holds the shuffles of a job until another has run.
    spark.range(1).repartition(1).count()
    scratch.release()
    rare = parts.where(F.col("kind") == _GRAMS)
    within = reduce_buckets(source.mapInArrow(_grams(shared, nb), SCHEMA).union(rare), _within(shared, nb), SCHEMA)
    by_row = reduce_buckets(parts.where(F.col("kind") != _GRAMS).union(within), _by_row(nb), SCHEMA)
    scored = reduce_buckets(by_row, _finish(model.n, model.base), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return scored.withColumn("held_out", held)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), Scratch(spark, "lm"))
