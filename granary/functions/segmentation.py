"""Dictionary segmentation of CJK runs, as search needs it: the most likely words, and the shorter words in them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the characters that words of a dictionary are found in; others are words of their own.
HAN_FIRST, HAN_LAST = "一", "鿕"


class Dictionary:
    """Words with frequencies, for segmentation without a model of unknown words.

    prefixes holds each word's frequency, and 0 for what words only begin with, so that a walk from any character ends where
    no word goes on. A domain term gets the least frequency with which it is not cut any more, in the order of the terms.
    """

    def __init__(self, frequencies: dict[str, int], domain_terms: Sequence[str] = ()) -> None:
        self.prefixes: dict[str, int] = {}
        self.total = sum(frequencies.values())
        for word, n in frequencies.items():
            self._put(word, n)
        for term in domain_terms:
            likely = 1.0
            for part in self.cut(term):
                likely *= self.prefixes.get(part, 1) / float(self.total)
            n = max(int(likely * self.total) + 1, self.prefixes.get(term, 1))
            self.total += n
            self._put(term, n)

    @staticmethod
    def read(words: DataFrame, domain_terms: Sequence[str] = (), most: int = 1_000_000) -> Dictionary:
        """From a table of word and frequency with at most so many rows, which every task gets; repeated words add up."""
        rows = words.where("word is not null and word != ''").groupBy("word").agg(F.sum("frequency").alias("frequency")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} words")
        return Dictionary({r["word"]: int(r["frequency"]) for r in sorted(rows)}, domain_terms)

    def _put(self, word: str, n: int) -> None:
        self.prefixes[word] = n
        for k in range(1, len(word)):
            self.prefixes.setdefault(word[:k], 0)

    def cut(self, run: str) -> list[str]:
        """The path of words with the greatest product of frequencies; of equals the one whose words are longer, from the left."""
        out, at = [], 0
        while at < len(run):
            end = at
            while end < len(run) and HAN_FIRST <= run[end] <= HAN_LAST:
                end += 1
            if end > at:
                out += self._path(run[at:end])
            else:
                out.append(run[at])
                end = at + 1
            at = end
        return out

    def _path(self, run: str) -> list[str]:
        n, all_words = len(run), math.log(self.total or 1)
        best, ends = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            found, j = [], i + 1
            while j <= n and (frequency := self.prefixes.get(run[i:j])) is not None:
                if frequency:
                    found.append((math.log(frequency) - all_words + best[j], j))
                j += 1
            best[i], ends[i] = max(found) if found else (0.0 - all_words + best[i + 1], i + 1)
        out, i = [], 0
        while i < n:
            out.append(run[i : ends[i]])
            i = ends[i]
        return out

    def search_terms(self, run: str) -> list[str]:
        """Words of a run; before each that is longer, the words of two, then of three characters in it."""
        out = []
        for word in self.cut(run):
            for size in (2, 3):
                if len(word) > size:
                    out += [word[i : i + size] for i in range(len(word) - size + 1) if self.prefixes.get(word[i : i + size])]
            out.append(word)
        return out

    def column(self, runs: Column) -> Column:
        """Search terms of each string of an array, as arrays in its order; nulls stay. The dictionary goes to each executor once."""
        sent = _broadcast(self)

        @F.arrow_udf("array<array<string>>")
        def terms(of: pa.Array) -> pa.Array:
            cut = sent.value.search_terms
            n = pc.fill_null(pc.list_value_length(of), 0).to_numpy(zero_copy_only=False)
            coded = pc.dictionary_encode(of.flatten())  # a batch repeats its runs: each is cut, and becomes an object, once
            known = pa.array([cut(r) for r in coded.dictionary.to_pylist()], pa.list_(pa.string()))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), known.take(coded.indices), mask=of.is_null())

        return terms(runs)


def _broadcast(value: object) -> object:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(value)
