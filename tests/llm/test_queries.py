"""The registered queries over whole tables: against SQL, the libraries, brute force and held-out labels."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from inkwell.llm import queries, toxicity
from inkwell.llm.neighbours import nearest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("select doc_id, coalesce(text, '') from documents").fetchall())


def _rows(spark, name, sf=SF):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_token_counts_query(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = _rows(spark, "op2_token_counts")
    for k, t in texts.items():
        n = len(model.encode(t))
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_packed_ids_query(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, start, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, _rows(spark, "op4_packed_ids")
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_bpe_query(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), _rows(spark, "op5_bpe")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_language_model_query(spark, texts):
    low = {k: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    count = collections.Counter(w for k, ws in low.items() if not held[k] for w in [*ws, "\n"])
    n, v, got = sum(count.values()), len(count), _rows(spark, "op10_lm_score")
    for k, ws in low.items():
        r, ws = got[k], [*ws, "\n"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    # Held-out texts, which nothing was learnt from: the model gains 0.2 of log10 a token at least.
    rows = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in rows) > 0.2 * sum(r["n_tokens"] for r in rows)


@pytest.mark.parametrize(("name", "label", "limit"), [("op3_quality", "quality", 0.7), ("op9_toxicity", "toxic", 0.3)])
def test_classifier_queries(spark, name, label, limit):
    sf = "/root/testdata/sf0.01"
    got = _rows(spark, name, sf)
    labels = dict(duckdb.sql(f"select doc_id, {label} from '{sf}/labels.parquet' where {label} is not null").fetchall())
    assert len(got) == duckdb.sql(f"select count(distinct doc_id) from '{sf}/documents.parquet'").fetchall()[0][0]
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit)
    pairs = [(got[k]["score"], y) for k, y in labels.items() if k in got and got[k]["held_out"]]
    wins = [a > b for a, y in pairs for b, z in pairs if y and not z]
    assert sum(wins) >= 0.75 * len(wins)  # 305 labelled rows, four languages
    assert sum((s >= limit) == y for s, y in pairs) >= 0.9 * len(pairs)


def test_neighbours_query(spark):
    rows = {k: np.array(v, float) for k, v in duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall() if v}
    found = collections.defaultdict(set)
    for r in queries.QUERIES["op7_neighbours"](spark, SF).collect():
        assert math.isclose(r["score"], np.sqrt(((rows[r["query_id"]] - rows[r["vec_id"]]) ** 2).sum()), rel_tol=1e-12)
        found[r["query_id"]].add(r["vec_id"])
    assert set(found) == {k for k in rows if k % 100 == 0}
    for q, got in found.items():
        near = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), k) for k, v in rows.items() if k != q)[:10]
        assert len(got & {k for _, k in near}) >= 9


@pytest.mark.parametrize("offset", [0.0, 1e3, 1e5, 1e7])
def test_nearest_is_exact_far_from_the_origin(offset):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)) * 0.01 + offset
    x[200:] -= 2 * offset  # two far clusters
    x[7] = x[8]
    who, ids, score = nearest(x[:30], x, np.arange(400), 10)
    for q in range(30):
        exact = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = np.flatnonzero(exact <= np.sort(exact)[9])
        assert set(ids[who == q]) == set(want.tolist()) and set(score[who == q]) == set(exact[want])


def test_label_model_finds_accuracies_and_copies():
    """Of voters for one sign, those that repeat another add nothing, and a voter at random gets the accuracy of chance."""
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.2
    good = [np.where(y, rng.random(3000) < 0.6, rng.random(3000) < 0.003) for _ in range(5)]
    noise = rng.random(3000) < 0.1
    votes = np.stack([*good, *[noise] * 6, ~np.any(good, axis=0)], axis=1).astype(float)
    post, accuracy = toxicity.label_model(votes, np.array([1.0] * 11 + [-1.0]), 0.2, y.astype(int))
    assert ((post > 0.5) == y).mean() > 0.97
    assert accuracy[:5].min() > 0.9 and abs(accuracy[5] - 0.5) < 0.1 and accuracy[11] > 0.9
    parent = toxicity.dependencies(votes, np.array([1.0] * 11 + [-1.0]), post)
    assert sum(parent[k] in range(5, 11) or k in parent[5:11] for k in range(5, 11)) == 6  # the copies depend on one another
    assert (parent >= 0).sum() == 10


def test_classifiers_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    from inkwell.llm import quality

    assert toxicity.score_toxicity(docs, labels).count() == quality.score_quality(docs, labels).count() == 0
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (2, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as row_key", "3 as y")
    for score in (toxicity.score_toxicity, quality.score_quality):
        assert sorted(r["score"] for r in score(docs, labels).collect()) == [0.5] * 5


def test_token_cache_grows_only_by_new_texts(spark, tmp_path):
    from inkwell.llm.token_counts import count_tokens

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "w" * 50_000), (None, "c")], "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as content_sha")
    first = sorted(map(str, count_tokens(docs, path, cache).collect()))
    more = docs.union(spark.createDataFrame([(9, "new one")], "doc_id long, text string").selectExpr("*", "1", "'x'"))
    assert sorted(map(str, count_tokens(docs, path, cache).collect())) == first
    assert spark.read.parquet(cache).count() == 4
    assert count_tokens(more, path, cache).count() == 6 and spark.read.parquet(cache).count() == 5


def test_substrings_and_scores_of_hot_and_long_words(spark):
    from inkwell.llm.common import Scratch
    from inkwell.llm.language_model import score_documents
    from inkwell.llm.substrings import remove_repeats

    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(k, f"u{k} v{k} {passage} w{k}") for k in range(120)] + [(500, "x" * 300_000), (501, f"{'y' * 9} " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs, Scratch(spark, "hot")).collect()}
    assert got == {0: 0} | {k: 25 for k in range(1, 120)} | {500: 0, 501: 29}  # all windows of the run but the first start earlier too
    scored = {r["doc_id"]: r["score"] for r in score_documents(docs, Scratch(spark, "hot")).collect()}
    assert len(scored) == 122 and all(np.isfinite(s) and s < 0 for s in scored.values())
