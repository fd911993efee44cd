"""The operators against brute force, on few rows with nulls, empty and long texts, copies and ties."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontaminate, jaccard, language_model, neighbours, packed_ids, quality, substrings, token_counts, tokenizers_, toxicity
from inkwell.llm.common import Scratch, Words, connected, hashed_words

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_tokens int, score string, key long"


def _texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgéß中") for _ in range(rng.randrange(1, 7)))
    vocabulary = [word() for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            p = rng.choice(base)
            w += p[3:33]
        if rng.random() < 0.2:
            w += ["Of"] * rng.randrange(1, 45)
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    return [*out, "", None, " \n ", "one", "one", "A b C", "x " * 3000, out[0], out[0].upper(), "a\tb <|endoftext|> c", "\x00 \x1c z"]


@pytest.fixture(scope="module")
def rows():
    return [(k * 3 + 1, t, 5, "s", k) for k, t in enumerate(_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, rows[0]], SCHEMA).repartition(5)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_decontaminate(spark, docs, rows):
    items = [(1, rows[0][1][:200]), (2, "one"), (3, None), (4, "!!"), (5, rows[5][1]), (5, "A b c"), (10, "Of of oF of of of of of of of of")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall(_lower(t or ""))
        for s in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[s : s + 10])].add(str(i))
    expected = {}
    for k, t, *_ in rows:
        w, hit, found = pattern.findall(_lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        expected[k] = (len(w), len(hit), sorted(found))
    for most in (decontaminate.MAX_PATTERN_BYTES, 300):
        got = decontaminate.find_hits(docs, benchmark, most=most).collect()
        assert len(got) == len(rows) + 1
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in got} == expected
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.find_hits(docs, benchmark).collect()}
    text = rows[5][1].encode()
    assert decontaminate.words(text[spans[rows[5][0]][0]["start"] : spans[rows[5][0]][0]["end"]])
    assert all(r["n_hit"] == 0 for r in decontaminate.find_hits(docs, benchmark.limit(0)).collect())
    assert decontaminate.find_hits(docs.limit(0), benchmark).count() == 0


def test_token_counts(spark, docs, rows, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = {k: (len((t or "").encode()), len(model.encode(t or ""))) for k, t, *_ in rows}
    for _ in range(2):
        got = token_counts.count_tokens(docs, path, f"{tmp_path}/cache").collect()
        assert len(got) == len(rows) + 1
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == expected
        assert spark.read.parquet(f"{tmp_path}/cache").count() == len({t or "" for _, t, *_ in rows})  # the second time nothing is encoded
    assert token_counts.count_tokens(docs.limit(0), path, f"{tmp_path}/empty").count() == 0
    odd = ["", " ", "  ", "a ", "a  ", " a", "a  b", "▁", "a▁ b▁", "<s> x", "\n", " \n "]
    assert tokenizers_.piece_counter(path).counts(odd) == [len(model.encode(x)) for x in odd]


def test_packed_ids(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, start, expected = Tokenizer.from_file(path), 0, []
    for k, t in sorted([(k, t or "") for k, t, *_ in [*rows, rows[0]]]):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        expected.append((k, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    with_null = docs.union(spark.createDataFrame([(None, "x", 1, "", 1)], SCHEMA))
    packed_ids.write_ids(with_null, path, f"{tmp_path}/ids", end_id=2, shard_ids=500)
    got = packed_ids.read_ids(spark, f"{tmp_path}/ids").collect()
    assert sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in got) == sorted(expected)
    packed_ids.write_ids(docs.limit(0), path, f"{tmp_path}/none", end_id=2)
    assert packed_ids.read_ids(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 2**32 - 1).astype(np.uint32)
    data, at = packed_ids.pack(ids)
    assert (packed_ids.unpack(data, at, n) == ids).all()
    shard = packed_ids.write_shard([1, 2], [ids.astype("<u4").tobytes(), b"\x07\x00\x00\x00"])
    assert (packed_ids.read_document(shard, 0) == ids).all() and packed_ids.read_document(shard, 1).tolist() == [7]


def test_bpe(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t, *_ in rows}
    encoded = bpe.encode_documents(docs, path)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == expected
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, path).collect()} == {k: t or "" for k, t, *_ in rows}
    assert bpe.round_trip(docs.limit(0), path).count() == 0
    rng = random.Random(4)
    long = ["ab" * 400, "the" * 300, "".join(rng.choice("etaoin") for _ in range(3000)), "é" * 500, "x" * 100_000]
    assert bpe.bpe(path).encode(long) == [tokenizer.encode(x, add_special_tokens=False).ids for x in long]
    odd = ["".join(rng.choice("aab the'sre \n\t é中\U00020000<|endoftext|>129!\x00\x1c\x85") for _ in range(rng.randrange(40))) for _ in range(500)]
    assert bpe.bpe(path).encode(odd) == [tokenizer.encode(x, add_special_tokens=False).ids for x in odd]
    assert bpe.bpe(path).decode([tokenizer.token_to_id("Ã")]).decode() == tokenizer.decode([tokenizer.token_to_id("Ã")], skip_special_tokens=False)


def _components(rows):
    sets = {}
    for k, t, *_ in rows:
        w = W.findall(_lower(t or ""))
        sets[k] = frozenset(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset()
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("most", [jaccard.MOST_TOKENS, 300])
def test_jaccard(spark, docs, rows, scratch, most):
    """With a small bound large groups are cut into parts, and the links are the same."""
    got = jaccard.group_documents(docs.union(spark.createDataFrame([(None, "x", 1, "", 1)], SCHEMA)), scratch, most).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _components(rows)


@pytest.mark.parametrize("most", [300, 2000])
def test_jaccard_of_one_giant_group_without_links(spark, scratch, most):
    """Every document shares three quarters of its blocks with the next: one group, cut into parts, with few links."""
    block = lambda k: " ".join(f"b{k}x{i}" for i in range(10))
    rows = [(k, " ".join(block(k + i) for i in range(4))) for k in range(150)] + [(1000 + k, " ".join(block(3 * k + i) for i in (0, 1, 2, 3)) + " end") for k in range(9)]
    got = jaccard.group_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), scratch, most).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _components(rows)
    assert len({r["component_id"] for r in got}) == 150


def test_jaccard_of_nothing(docs, scratch):
    assert jaccard.group_documents(docs.limit(0), scratch).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_prefix_tree(seed):
    rng = random.Random(seed)
    n, most = rng.randrange(2, 50), rng.randrange(20, 200)
    base = [rng.sample(range(most), rng.randrange(5, min(most, 70))) for _ in range(3)]
    sets = []
    for _ in range(n):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(8)):
            s ^= {rng.randrange(most)}
        sets.append(s or {0})
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    got, want = jaccard.Components(n), jaccard.Components(n)
    for a, b in jaccard.tree_links(np.arange(n), np.array([len(s) for s in sets]), [np.array(sorted(s), np.uint64) for s in sets]):
        assert linked(sets[a], sets[b])
        got.join(a, b)
    for a in range(n):
        for b in range(a):
            if linked(sets[a], sets[b]):
                want.join(a, b)
    same = lambda c: [[c.label[a] == c.label[b] for a in range(n)] for b in range(n)]
    assert same(got) == same(want)


def test_prefix_tree_does_not_look_at_all_of_a_group():
    """Sets with 30 common tokens of 100 and no link: no branch is entered, whatever the group's size."""
    common = np.arange(30, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, np.uint64(1000 + 70 * k) + np.arange(70, dtype=np.uint64)])) for k in range(500)]
    visits = []
    overlaps = jaccard.PrefixTree.overlaps
    try:
        jaccard.PrefixTree.overlaps = lambda self, *a: visits.append(1) or overlaps(self, *a)
        assert jaccard.tree_links(np.arange(500), np.full(500, 100), sets) == []
    finally:
        jaccard.PrefixTree.overlaps = overlaps
    assert not visits


def test_connected(spark, scratch):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (200, 100)]
    got = {r["node"]: r["root"] for r in connected(scratch, spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 200: 100}


def _embeddings(seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(600, 12))
    x[50:400] = x[0]
    return [(k, [float(v) for v in row], k % 2) for k, row in enumerate(x.astype(np.float32))] + [(1000, None, 0), (1001, [0.0] * 12, 0), (1002, [float("nan")] * 12, 0), (1003, [None] + [1.0] * 11, 0), (1100, [1.0], 0)]


def test_neighbours(spark, scratch):
    rows = _embeddings()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in neighbours.search(vectors, F.col("vec_id") % 100 == 0, scratch).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {k: np.array(v, float) for k, v, _ in rows if k < 600}
    found = total = 0
    assert set(got) == {k for k in good if k % 100 == 0}
    for q, listed in got.items():
        near = sorted((float(np.sqrt(((good[k] - good[q]) ** 2).sum())), k) for k in good if k != q)[:10]
        assert [r for r, *_ in sorted(listed)] == list(range(1, 11)) and q not in [v for _, v, _ in listed]
        for _, v, score in listed:
            assert math.isclose(score, float(np.sqrt(((good[v] - good[q]) ** 2).sum())), abs_tol=1e-12)
        if near[9][0] == 0:
            assert [v for _, v, _ in sorted(listed)] == [k for _, k in near]
        found, total = found + len({k for _, k in near} & {v for _, v, _ in listed}), total + 10
    assert found >= 0.9 * total
    assert neighbours.search(vectors.limit(0), F.lit(True), scratch).count() == 0


def test_hilbert_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    key = neighbours.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_substrings(spark, docs, rows, scratch):
    first, expected = {}, {}
    for k, t, *_ in sorted(rows, key=lambda r: r[0]):
        w, gone = W.findall(t or ""), set()
        for s in range(len(w) - 19):
            if first.setdefault(tuple(w[s : s + 20]), (k, s)) != (k, s):
                gone |= set(range(s, s + 20))
        expected[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    assert sum(e[1] for e in expected.values()) > 500
    got = substrings.remove_repeats(docs.union(spark.createDataFrame([(None, "x", 1, "", 1)], SCHEMA)), scratch).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_substrings_of_nothing(docs, scratch):
    assert substrings.remove_repeats(docs.limit(0), scratch).count() == 0


@pytest.mark.parametrize("size", [1, 3, 8, 50, 5000])
def test_equal_windows_have_equal_anchors_and_names(size):
    """Windows, wherever they stand, are named alike if and only if their words are the same."""
    rng = random.Random(size)
    v = [b"w%d" % i for i in range(size)]
    base = [rng.choice(v) for _ in range(800)]
    texts = [[w for _ in range(4) for p in [rng.randrange(760)] for w in base[p : p + 30] + [rng.choice(v)] * rng.randrange(25)] for _ in range(40)]
    h, at = hashed_words([b" ".join(t) for t in texts])
    flat = [w for t in texts for w in t]
    s, anchor, sure, _ = substrings.anchors(h, at)
    name, check = substrings.window_names(h, at, s)
    by_words, by_name = {}, {}
    for k, start in enumerate(s.tolist()):
        words, own = tuple(flat[start : start + 20]), (int(name[k]), int(check[k]))
        assert by_words.setdefault(words, (own, int(anchor[k]), bool(sure[k]))) == (own, int(anchor[k]), bool(sure[k]))
        assert by_name.setdefault(own, words) == words


def test_words_are_told_apart_as_by_the_pattern():
    texts = ["", " ", "a", "a b", "\ta\x0b b\x1c c\x85\n", "long" * 50 + " " + "long" * 50, "éß 中文中文中文中文 \x00 x", "A b A"]
    words = Words([t.encode() for t in texts])
    h, seen = words.hashes().tolist(), {}
    for k, t in enumerate(texts):
        own = W.findall(t)
        assert words.text(k) == " ".join(own).encode() and words.at[k + 1] - words.at[k] == len(own)
        for w, x in zip(own, h[words.at[k] : words.at[k + 1]], strict=True):
            assert seen.setdefault(x, w) == w
    assert len(seen) == len({w for t in texts for w in W.findall(t)})


def test_language_model(spark, docs, rows, scratch):
    train = [(k, t) for k, t, *_ in [*rows, rows[0]] if zlib.crc32(str(k).encode()) % 7 != 2]
    count = collections.Counter(w for _, t in train for w in [*W.findall(_lower(t or "")), "\n"])
    n, v = sum(count.values()), len(count)
    for frequent in (language_model.FREQUENT, 40):
        got = language_model.score_documents(docs, scratch, frequent).collect()
        assert len(got) == len(rows) + 1
        texts = {k: t for k, t, *_ in rows}
        for r in got:
            w = [*W.findall(_lower(texts[r["doc_id"]] or "")), "\n"]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
            assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
    assert language_model.score_documents(docs.limit(0), scratch).count() == 0


def test_language_model_sees_words(spark, scratch):
    """Words of one ending differ by the words before: by the one before, by the two before, and by the one before last alone."""
    ok = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    train, held = [k for k in range(3000) if ok(k)], [k for k in range(3000) if not ok(k)]
    rng = random.Random(4)
    a, b, other = [f"a{i}xx" for i in range(20)], [f"b{i}xx" for i in range(20)], [f"o{i}xx" for i in range(20)]
    pairs = lambda n, shift: " ".join(f"{a[i]} {b[(i + shift) % 20]}" for i in (rng.randrange(20) for _ in range(n)))
    endings = ["ka", "lo", "mi", "nu"]
    skips = lambda shift: " ".join(f"s{i}yy {rng.choice(other)} t{rng.randrange(10**9)}{endings[(i + shift) % 4]}" for i in (rng.randrange(4) for _ in range(40)))
    rows = [(k, pairs(40, 0)) for k in train[:300]] + [(k, skips(0)) for k in train[300:600]]
    rows += [(held[0], " ".join(f"{a[i]} {b[i]}" for i in range(20))), (held[1], " ".join(f"{a[i]} {b[(i + 7) % 20]}" for i in range(20))), (held[2], skips(0)), (held[3], skips(1))]
    for frequent in (language_model.FREQUENT, 10):
        got = {r["doc_id"]: r for r in language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), scratch, frequent).collect()}
        good, bad = got[held[0]], got[held[1]]
        assert math.isclose(good["base_score"], bad["base_score"]) and good["score"] > bad["score"] + 10
        assert good["score"] > good["base_score"]
        assert got[held[2]]["score"] > got[held[3]]["score"] + 10


def _events(seed=3, n=4000):
    rng = np.random.default_rng(seed)
    context, outcome, training = rng.integers(0, 9, n), rng.integers(0, 12, n), rng.random(n) < 0.8
    # Every outcome of every context once more, unseen in training, so that each has a probability.
    context, outcome, training = np.append(context, np.repeat(np.arange(9), 12)), np.append(outcome, np.tile(np.arange(12), 9)), np.append(training, np.zeros(108, bool))
    return context, outcome, training, rng.dirichlet(np.ones(12))


def test_language_model_sums_to_one():
    context, outcome, training, prior = _events()
    context[:40], outcome[:40] = 8, 3
    p = language_model.train(context, language_model.rank(context * 12 + outcome), training, prior[outcome], 0.2)
    assert np.allclose(p[-108:].reshape(9, 12).sum(axis=1), 1)
    # All classes of some words before last, in each class context.
    c, v, one = np.tile(np.arange(65), 12), np.repeat(np.arange(3), 4 * 65), np.tile(np.repeat(np.arange(4), 65), 3)
    rng = np.random.default_rng(1)
    classes = np.log(rng.dirichlet(np.ones(65), language_model.CONTEXTS)).astype(np.float32)
    p = language_model.skips(v, v * 65 + one, c, (rng.random(len(c)) < 0.3).astype(np.uint8), classes, block=2)
    assert np.allclose(p.reshape(12, 65).sum(axis=1), 1, atol=1e-4)


def test_language_model_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(2)
    of, n = rng.integers(0, 5, 30), rng.integers(0, 9, 30).astype(float)
    m = np.bincount(of, n, 5) + rng.integers(0, 4, 5)
    prior, theta = rng.random(30) / 40, rng.normal(size=30)
    gradient, _ = language_model.gradient_at(theta, n, m, of, prior, 0.3)
    for k in range(30):
        step = np.eye(30)[k] * 1e-5
        rise = language_model.objective(theta + step, n, m, of, prior, 0.3) - language_model.objective(theta - step, n, m, of, prior, 0.3)
        assert math.isclose(rise / 2e-5, gradient[k], rel_tol=1e-4, abs_tol=1e-4)
    ctx, counts = np.array([3, 70, 71, 4224]), rng.integers(0, 5, (4, 65)).astype(float)
    weights = rng.normal(size=(language_model.FEATURES, 65)) / 5
    total, _ = language_model.gradient_of(weights, ctx, counts)
    likelihood = lambda w: (counts * np.log(language_model.softmax(w, ctx))).sum()
    for f, c in ((0, 3), (1 + 3, 7), (1 + 65 + 1, 0)):
        step = np.zeros_like(weights)
        step[f, c] = 1e-5
        assert math.isclose((likelihood(weights + step) - likelihood(weights - step)) / 2e-5, total[f, c], rel_tol=1e-4, abs_tol=1e-4)
    word, first, classes = np.array([0, 0, 1]), np.array([0, 2]), rng.dirichlet(np.ones(65), 3)
    own, cells = rng.integers(0, 4, (2, 65)).astype(float), np.array([40.0, 50.0, 60.0])
    w = rng.normal(size=(2, 65)) / 5
    value = lambda w: (own * w).sum() - (cells * np.log((classes * np.exp(w)[word]).sum(axis=1))).sum() - 0.25 * (w**2).sum()
    gradient, _ = language_model.skip_gradient(w, own, cells, classes, word, first, 0.5)
    for i, j in ((0, 0), (0, 64), (1, 5)):
        step = np.zeros_like(w)
        step[i, j] = 1e-5
        assert math.isclose((value(w + step) - value(w - step)) / 2e-5, gradient[i, j], rel_tol=1e-4, abs_tol=1e-4)


def _labelled(spark, good, bad, n=160):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(bad if k % 4 == 0 and rng.random() < 0.3 else good) for _ in range(40)), k % 4 == 0) for k in range(n)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(900, "", "x"), (901, None, "x")], "doc_id long, text string, score string")
    return docs, rows


def test_quality(spark):
    docs, rows = _labelled(spark, ["lorem", "ipsum", "dolor"], ["BUY!!", "NOW!!"])
    labels = spark.createDataFrame([(k, int(not b), 0) for k, _, b in rows] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= 0.5) == (not b) for k, _, b in rows)
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark):
    docs, rows = _labelled(spark, ["lorem", "ipsum", "dolor", "amet"], ["Nasty", "rotten!"])
    labels = spark.createDataFrame([(k, 1, int(b)) for k, _, b in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 2
    assert all((got[k] >= 0.3) == b for k, _, b in rows)
    assert got[900] == got[901] < 0.3
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    passage, leak, copy = text(60), text(15), text(80)
    rows = [(k, text(70)) for k in range(30)] + [(40, f"{text(30)} {passage}"), (41, f"{text(40)} {passage}"), (50, copy), (51, copy + " end"), (60, f"{text(20)} {leak} {text(9)}"), (70, "BUY!! " * 50)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k != 70), 0) for k, _ in rows if k < 30] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
    kept = {r["doc_id"]: r for r in now.collect()}
    assert 51 not in kept and 60 not in kept and {40, 41, 50, *range(30)} <= set(kept)
    assert len(kept[41]["text"].split()) == 40 and kept[41]["n_chars"] == len(kept[41]["text"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)


def _raw(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def _quality_rows(spark, path):
    """Good, bad and mixed texts, with labels of both classes for the first two."""
    rng = random.Random(5)
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    good, bad = ["lorem", "ipsum", "dolor", "amet"], ["BUY!!", "NOW!!", "$$$"]
    rows = [(k, some(bad if k % 4 == 0 else good, 40)) for k in range(160)] + [(1000 + k, f"{some(bad, k)} {some(good, 60 - k)}") for k in range(1, 60)]
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_quality_stage_rejects_what_op3_predicts_low(spark, tmp_path):
    import corpus_pipeline

    docs = _raw(spark, _quality_rows(spark, tmp_path))
    score = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert any(0.3 <= s < 0.7 for s in score.values())
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {k for k, s in score.items() if s >= 0.7}
    assert {k for k in range(160) if k % 4} <= kept and not {k for k in range(160) if k % 4 == 0} & kept


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    rows = _quality_rows(spark, tmp_path)[:160]
    good, bad = rows[1][1], rows[0][1]
    leak = " ".join(f"leak{i}" for i in range(15))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows += [(500, good), (500, bad), (None, good), (None, bad), (None, None)]
    got = corpus_pipeline.quality(spark, _raw(spark, [r for r in rows if r[1]]).union(_raw(spark, [(None, "")])), str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert found[500, good] == found[None, good] == 1 and not found[500, bad] and not found[None, bad]
    words = lambda seed: " ".join(f"w{random.Random(seed + i).randrange(10**6)}" for i in range(40))
    docs = _raw(spark, [(1, words(1)), (1, words(1)), (1, words(1)), (2, words(1)), (3, words(900)), (4, words(5000)), (4, words(7000)), (None, words(1))])
    near = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert near == [(1, words(1)), (3, words(900)), (4, min(words(5000), words(7000)))]
    docs = _raw(spark, [(7, f"a b {leak}"), (7, "c d"), (8, "e"), (None, "f"), (None, leak)])
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()} == {(7, "c d"), (8, "e"), (None, "f")}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, and columns named as the stages' own."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, f"a {passage}", None, "s", 5, "x", 1.5), (2, f"b c {passage}", "en", None, None, None, None), (3, None, "en", "s", 0, "y", 2.5), (4, "", "en", "s", 0, "z", 0.0), (None, None, None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, `kept` string, `row` double"
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, str(tmp_path))
            assert k == 4 or got.columns == docs.columns
            kept = [(r["doc_id"], r["text"], r["row"]) for r in got.collect()] if k < 4 else [()] * got.count()
            if docs.isEmpty():
                assert not kept
            elif k == 2:
                assert sorted(kept, key=str) == sorted([(1, f"a {passage}", 1.5), (2, "b c", None), (3, None, 2.5), (4, "", 0.0), (None, None, None)], key=str)
            elif k:
                assert len(kept) == {1: 3, 3: 5, 4: 5}[k]  # two are near copies


def test_word_encoder_equals_library_on_hard_words():
    from inkwell.llm.tokenizers_ import WordEncoder

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    hard = ["H̱a İ don't, WE'LL go! <|endoftext|>x <|ENDOFTEXT|> 3.5 \"a\".", "ΣΑΣ, İx K, a b \x1cc\x85d ﬁ. ...", "foo,bar;baz Å. 日本語, ǅ. ×. ·, é!", "́x a̱᷄ ١٢, ㎏. ≮ ?", "", "   ", "a,.b;c 1.5 x.y'S"]
    for _ in range(2):  # words unknown, then remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in hard])]
        assert got == [encoder.model.encode(t, add_special_tokens=False).ids for t in hard]


def test_word_encoder_on_odd_texts():
    """Marks, composing letters, special strings and all kinds of white space, against the library."""
    import random

    import numpy as np
    import public_tokenizers

    from inkwell.llm.tokenizers_ import WordEncoder

    rng = random.Random(5)
    parts = ["a", "B", "é", "É", "İ", "ß", "'s", "'LL", " ", " ", "\n", "\t", "\x1c", "\x85", "\x0b", "1", "23", ".", ",", "!?", "<|endoftext|>", "<|", "$$", "中", "ﬁ", "Σ", "é", ";", "​", "😀", "-", "\x00", "don't", "It's."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", " ", "a" * 50_000, ". ."]
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    expected = [np.array(e.ids, "<u4").tobytes() for e in encoder.model.encode_batch(texts, add_special_tokens=False)]
    for most in (encoder.MOST, 0):  # with its memory, and when that starts anew
        encoder.MOST = most
        assert encoder.encode([x.encode() for x in texts]) == expected
    assert encoder.encode([]) == []


def test_blocks_with_many_exceptions():
    import numpy as np

    from inkwell.llm.packed_ids import BLOCK, pack, unpack

    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 3000):
        for high in (1, 2, 1 << 9, 1 << 32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.08] = 0xFFFFFFFF
            data, at = pack(ids)
            assert (unpack(data, at, n) == ids).all()
            if n > 2 * BLOCK:
                assert (unpack(data, at, n, 1, 2) == ids[BLOCK : 2 * BLOCK]).all()
