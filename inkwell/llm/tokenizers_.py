"""Exact, fast counting and encoding with the public tokenizer libraries.

Both vocabularies here never join bytes across white space, so a text is cut there, each distinct cut is given to the
library once in a worker's memory, and the results are put together. The cuts' independence is checked on loading.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cuts that a worker remembers; beyond it the memory starts anew.
MOST_CUTS = 300_000


class PieceCounter:
    """Token counts of a sentencepiece model whose pieces hold white space at their start only."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        plain = self.model.encode("a") != [] and len(self.model.encode("  a")) > 0 and self.model.encode("x", out_type=str)[0].startswith("▁")
        self.cuts = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, int] = {"": 1}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        if len(self.known) > MOST_CUTS:
            self.known = {"": 1}
        known = self.known
        parts = [self.cut(t) for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(known))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            known.update(zip(some, map(len, self.model.encode(some, num_threads=1)), strict=True))
        return [sum(map(known.__getitem__, p)) for p in parts]

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text's parts: runs of spaces with the word that follows, without the first space, which the library adds.

        A single space at the text's end becomes the empty cut, which counts as one token.
        """
        if not text:
            return []
        parts = text.replace("▁", " ").split(" ")  # the library writes a space as this letter
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        if spaces:
            out.append(" " * (spaces - 1))
        return out


class WordEncoder:
    """Ids of a tokenizers file that drops white space, as little-endian 32-bit integers.

    Arrow cuts texts into words and tells the distinct ones apart; only these meet the worker's memory, a run of ids
    and where each word's begin. Ids of all words are then gathered at once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for token, k in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    #: Words that a worker remembers; about 200 bytes each.
    MOST = 1_000_000

    #: Between a Latin letter or digit and one of these marks the pre-tokenizer always cuts.
    MARK = r"([0-9a-zÀ-ÖØ-öø-ÿ])([.,;:!?])"
    #: Words of letters that the library gets as one text; longer texts cost it more a word.
    TOGETHER = 200

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.n_ids = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        if len(self.known) > self.MOST:
            self.forget()
        cuts = self.cut(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        docs = cuts.offsets.to_numpy()
        words = cuts.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        if None in found:
            new = [w for w, k in zip(distinct, found, strict=True) if k is None]
            for i in range(0, len(new), 20_000):
                self.learn(new[i : i + 20_000])
            found = list(map(self.known.__getitem__, distinct))
        which = np.array(found, np.int32)[words.indices.to_numpy()]
        n = self.lengths[which]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        place = np.int32 if ends[-1] < 1 << 31 else np.int64
        raw = self.ids[np.repeat((self.starts[which] - ends[:-1]).astype(place), n) + np.arange(ends[-1], dtype=place)].tobytes()
        at = (4 * ends[docs - docs[0]]).tolist()
        return [raw[a:b] for a, b in pairwise(at)]

    def learn(self, words: list[str]) -> None:
        """Encodes words of letters many at a time, where every word ends with the one token that is marked as an end."""
        one, rest = [], []
        for w in words:
            (one if w.isalpha() and max(w) < "\u0130" else rest).append(w)
        if one:
            joined = [" ".join(one[i : i + self.TOGETHER]) for i in range(0, len(one), self.TOGETHER)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
            self.remember(one, ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
        if rest:
            ids = [e.ids for e in self.model.encode_batch_fast(rest, add_special_tokens=False)]
            self.remember(rest, np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)))

    def remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Appends the words, whose ids follow one another."""
        if len(words) != len(lengths) or lengths.sum() != len(ids):
            raise ValueError("words and their ids differ in number")
        a, b = len(self.known), len(self.known) + len(words)
        if b > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(b, np.int32)]) for x in (self.starts, self.lengths))
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.n_ids + len(ids), "<u4")])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[a:b] = self.n_ids + np.cumsum(lengths) - lengths
        self.lengths[a:b] = lengths
        self.known.update(zip(words, range(a, b), strict=True))
        self.n_ids += len(ids)

    @classmethod
    def cut(cls, texts: pa.LargeStringArray) -> pa.LargeListArray:
        """The texts' words, lower-cased as the library does, with marks behind letters apart.

        A text that may hold a special string, or marks that compose with the letter before, is cut at white space only.
        """
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), cls.MARK, r"\1 \2")
        whole = pc.match_substring_regex(texts, r"<\||[\x{0300}-\x{037F}]")
        cuts = pc.ascii_split_whitespace(pc.if_else(whole, texts, plain))
        return cuts.combine_chunks() if isinstance(cuts, pa.ChunkedArray) else cuts


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
