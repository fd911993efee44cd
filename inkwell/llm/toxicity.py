"""Toxicity by weak supervision.

Voters say "toxic" or "not", or abstain. They are entries of a fixed lexicon of common insults, patterns of a text (several insults,
shouting, rows of exclamation marks; no insult at all, a long text without one), and words and word beginnings mined from the
labelled sample, of either sign. A generative label model with a latent class estimates each voter's accuracy, and the
correlations of voters: its votes depend on the class and on one other voter, the one that tells most about it within the classes (a
maximum spanning tree of conditional information). It is fitted by expectation maximisation from the shares of votes. The posterior
probabilities train a linear classifier over hashed words, word beginnings and patterns, whose score is the result. The sample's
labels serve for mining voters, as the class's prior share, and as voters of their own whose accuracy is estimated like the others'.

Null and empty texts have no features and get the score of the bias. Without a labelled sample of both classes nothing is
fitted, and the score is the share of label 1 (one half without labels). Rows that repeat get equal scores.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.classify import gather, hashed, labelled_sample, score_rows, sigmoid
from inkwell.llm.common import remainder, table

#: Documents that voters are mined from and the classifier is fitted on, at most.
MAX_TRAIN = 8000
BUCKETS = 1 << 20
MAX_VOTERS = 192
#: So many votes for "toxic" (a word may have four, by its beginnings) make it likely at the start.
START = 6.0
#: Mined voters for "not" at most, and words of a text that is long.
MAX_AGAINST = 16
LONG = 40
_LETTERS = regex.compile(r"\p{L}+")

# Common insults of four languages.
INSULTS = frozenset(
    """
    idiot idiots moron morons imbecile stupid dumb fool fools loser losers scum trash garbage filth filthy pathetic disgusting
    worthless useless clown clowns jerk pig pigs rat coward liar ugly vile creep freak bastard bitch damn crap shit fuck
    dummkopf trottel vollidiot blöd blöde dumm abschaum versager widerlich dreck mistkerl arschloch scheiße lügner feigling
    imbécile crétin abruti stupide ordure salaud connard merde dégueulasse minable raclure lâche menteur pourriture
    idiota imbécil estúpido estúpida basura escoria inútil patético asqueroso payaso cobarde mentiroso cabrón mierda
    """.split()
)


def hashed_names(names: list[str]) -> list[int]:
    return hashed([n.encode() for n in names], BUCKETS)


_SHOUT, _MARKS, _SEVERAL, _NONE, _LONG_NONE = hashed_names(["#shout", "#marks", "#several", "#none", "#long-none"])
_FIXED_FOR = hashed_names(["w" + w for w in sorted(INSULTS)]) + [_SHOUT, _MARKS, _SEVERAL]
_FIXED_AGAINST = [_NONE, _LONG_NONE]


def word_features(word: bytes) -> tuple[list[int], int, bool]:
    """The word's letter runs, lower-cased, and their beginnings of 4 to 6 letters; how many are insults; whether it shouts."""
    out, insults, text = [], 0, word.decode(errors="replace")
    for w in _LETTERS.findall(text.lower()):
        insults += w in INSULTS
        out += [("w" + w).encode(), *(("p" + w[:n]).encode() for n in (4, 5, 6) if len(w) >= n)]
    return hashed(out, BUCKETS), insults, len(text) >= 4 and text.isalpha() and text.isupper()


def patterns(words: int, insults: int, shouts: bool, text: bytes) -> list[int]:
    if not words:
        return []
    found = [_SHOUT] * shouts + [_MARKS] * (b"!!!" in text) + [_SEVERAL] * (insults > 1)
    return found if insults else [*found, _NONE, *[_LONG_NONE] * (words >= LONG)]


_known: dict[bytes, tuple[tuple[int, ...], int, bool]] = {}


def features(text: bytes) -> np.ndarray:
    if len(_known) > 300_000:
        _known.clear()
    out: list[int] = []
    insults, shouts, words = 0, False, set(text.split())
    for w in words:
        f = _known.get(w)
        if f is None:
            own = word_features(w)
            f = _known[w] = (tuple(own[0]), own[1], own[2])
        out += f[0]
        insults, shouts = insults + f[1], shouts or f[2]
    return np.array(out + patterns(len(words), insults, shouts, text), np.int64)


def mine_voters(y: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], most: int = MAX_VOTERS) -> tuple[np.ndarray, np.ndarray]:
    """(features, signs) of the voters: the fixed ones that occur, and those that tell the labelled classes apart best.

    A mined one for "toxic" occurs in a hundredth of the toxic documents at least, one for "not" in a fifth of the others.
    """
    seen = np.zeros((2, BUCKETS), np.float32)
    for label, (f, _) in zip(y, docs, strict=True):
        seen[int(label)][f] += 1
    n = np.bincount(y, minlength=2)
    odds = np.log((seen[1] + 0.1) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    occurs = lambda fs: [f for f in fs if seen[:, f].sum() >= 3]
    for_ = np.flatnonzero((seen[1] >= max(3, n[1] / 100)) & (odds > 3))
    for_ = for_[np.argsort(-(odds[for_] + np.log(seen[1][for_])), kind="stable")][:most]
    against = np.flatnonzero((seen[0] >= max(3, n[0] / 5)) & (odds < -0.3))
    against = against[np.argsort(odds[against], kind="stable")][:MAX_AGAINST]
    for_ = np.array(list(dict.fromkeys([*occurs(_FIXED_FOR), *for_.tolist()])), np.int64)
    against = np.array(list(dict.fromkeys(f for f in [*occurs(_FIXED_AGAINST), *against.tolist()] if f not in set(for_.tolist()))), np.int64)
    return np.concatenate([for_, against]), np.concatenate([np.ones(len(for_)), -np.ones(len(against))])


def dependencies(votes: np.ndarray, signs: np.ndarray, post: np.ndarray, alone: int = 0) -> np.ndarray:
    """Each voter's parent in the maximum spanning tree of the voters' mutual information within the classes; -1 for none.

    Voters of opposite signs are not joined: that one abstains often only means that the other votes. The last ``alone`` ones have no parent.
    """
    m = votes.shape[1]
    told = np.zeros((m, m))
    for w in (post, 1 - post):
        total = w.sum() + 1e-9
        both, one = (votes * w[:, None]).T @ votes / total, w @ votes / total
        for joint, p in ((both, np.outer(one, one)), (one[:, None] - both, np.outer(one, 1 - one)), (one[None, :] - both, np.outer(1 - one, one)), (1 - one[:, None] - one[None, :] + both, np.outer(1 - one, 1 - one))):
            told += total / len(votes) * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(p, 1e-12)), 0)
    told[signs[:, None] != signs[None, :]] = -1
    told[m - alone :], told[:, m - alone :] = -1, -1
    parent, best, inside = np.full(m, -1), told[0].copy(), np.zeros(m, bool)
    nearest = np.zeros(m, np.int64)
    inside[0] = True
    for _ in range(m - 1):
        k = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[k], inside[k] = nearest[k] if best[k] >= 0 else -1, True
        closer = ~inside & (told[k] > best)
        best[closer], nearest[closer] = told[k][closer], k
    return parent


def label_model(votes: np.ndarray, signs: np.ndarray, prior: float, gold: np.ndarray | None = None, rounds: int = 40, smooth: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of the class for each row of votes, 0 or 1; each voter's accuracy: how much likelier it votes in its own class).

    gold: labels, which are two more voters, one for each sign; their accuracy is estimated as the others' is.
    """
    silent = votes[:, signs > 0].sum(axis=1) == 0
    votes, signs, n = np.column_stack([votes, silent]), np.append(signs, -1), len(signs)  # that nobody says "toxic" is a vote too
    post = 0.02 + 0.95 * (1 - np.exp(-votes[:, signs > 0].sum(axis=1) / START))
    if gold is not None:
        post = (post + gold) / 2
        votes, signs = np.column_stack([votes, gold == 1, gold == 0]), np.append(signs, [1, -1])
    for k in range(rounds):
        if k % 5 == 0:
            parent = dependencies(votes, signs, post, len(signs) - n)
            given = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
        z, rate = np.full(len(votes), np.log(prior / (1 - prior))), []
        for w, sign in ((post, 1), (1 - post, -1)):
            total, often, up = w.sum(), w @ votes, w @ given
            alone, both = (often + 0.02) / (total + 1), w @ (votes * given)
            with_, without = (both + smooth * alone) / (up + smooth), (often - both + smooth * alone) / (total - up + smooth)
            p = np.clip(np.where(given > 0, with_, without), 1e-6, 1 - 1e-6)
            z += sign * np.where(votes > 0, np.log(p), 0).sum(axis=1)  # who abstains says nothing
            rate.append(alone)
        new = sigmoid(z)
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-4:
            break
    mine, other = np.where(signs > 0, rate[0], rate[1]), np.where(signs > 0, rate[1], rate[0])
    return post, (mine / (mine + other))[:n]


def fit(y: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.1, shrink: float = 0.05, seed: int = 5) -> tuple[np.ndarray, float]:
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    weights = np.zeros(BUCKETS)
    if not 0 < y.sum() < len(y):
        return weights, bias
    voters, signs = mine_voters(y, docs)
    if not (signs > 0).any():
        return weights, bias
    votes = np.stack([np.isin(voters, f) for f, _ in docs]).astype(float)
    post, _ = label_model(votes, signs, share, y)
    often = np.bincount(np.concatenate([f for f, _ in docs]), minlength=BUCKETS) >= 3
    docs = [(f[often[f]], n) for f, n in docs]  # what occurs once or twice can only be learned by heart
    rng, grown = np.random.default_rng(seed), np.full(BUCKETS, 1e-2)
    for epoch in range(epochs):
        for k in rng.permutation(len(docs)):
            f = docs[k][0]
            g = sigmoid(weights[f].sum() + bias) - post[k]
            grown[f] += g * g
            weights[f] -= rate * g / np.sqrt(grown[f])
            bias -= 0.02 * g / (1 + epoch)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - shrink, 0)  # few features tell anything
    return weights, bias


_NOTHING = ((), 0, False)


class Scorer:
    """A feature counts once in a document, so the sum runs over the document's distinct features."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.known = weights, bias, {}

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known.clear()
        out = np.full(len(texts), self.bias)
        for k, t in enumerate(texts):
            found: set[int] = set()
            insults, shouts, words = 0, False, set(t.split())
            for w in words:
                f = self.known.get(w)
                if f is None:
                    own = word_features(w)
                    f = (tuple(x for x in own[0] if self.weights[x]), own[1], own[2])
                    f = self.known[w] = f if any(f) else _NOTHING
                if f is not _NOTHING:
                    found.update(f[0])
                    insults, shouts = insults + f[1], shouts or f[2]
            found.update(patterns(len(words), insults, shouts, t))
            out[k] += self.weights[sorted(found)].sum() if found else 0
        return sigmoid(out)


@lru_cache(maxsize=1)
def _scorer(weights: bytes, bias: float) -> Scorer:
    return Scorer(np.frombuffer(weights, np.float32).astype(np.float64), bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_train: int = MAX_TRAIN, **how) -> DataFrame:
    """(key, score) for each row: the probability of toxic 1. Fits on at most max_train labelled documents, on the driver."""
    weights, bias = fit(*gather(labelled_sample(docs, labels, "toxic", max_train, key), features), **how)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).tobytes())
    return score_rows(docs, lambda data: _scorer(shared.value, bias)(data), key)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
