"""Substring dedup: suffix automata of reference shards, through which documents stream for matching statistics.

The reference is the corpus itself. Only spans that can repeat enter it (repeats.py finds them by anchors that equal
windows share), and an occurrence whose whole surroundings stand earlier needs no automaton. The rest is dealt to
shards by anchor, so that all spans that can match a span are in its shard. A shard's size is bounded, and so is its
automaton; it is built where the shard's spans are, which stream through it at once. Sending every automaton to every
document would cost shards x corpus; here each span meets one automaton.

An anchor with more contested spans than a shard holds is told apart by more context, and at last settled by grouping
its windows, which spreads over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm import repeats
from granary.llm.common import stored


class SuffixAutomaton:
    """Suffix automaton of several rows of symbols. Each state knows the least end, in the order given, of its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def add(self, row: list, ends: list) -> None:
        """row: symbols; ends: what to keep for each place, comparable."""
        nexts, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for symbol, end in zip(row, ends, strict=True):
            q = nexts[last].get(symbol)
            if q is not None and length[q] == length[last] + 1:
                last = q
                if least[q] is None or end < least[q]:
                    least[q] = end
                continue
            if q is not None:
                new = self._clone(last, q, symbol)
                least[new] = end
                last = new
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            least.append(end)
            link.append(0)
            p = last
            while p != -1 and symbol not in nexts[p]:
                nexts[p][symbol] = new
                p = link[p]
            if p != -1:
                q = nexts[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
            last = new

    def _clone(self, p: int, q: int, symbol: object) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.least.append(None)
        self.link[q] = new
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = new
            p = self.link[p]
        return new

    def finish(self) -> None:
        """Passes the least ends on to the suffixes."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p, end = self.link[v], self.least[v]
            if p > 0 and end is not None and (self.least[p] is None or end < self.least[p]):
                self.least[p] = end

    def statistics(self, row: list, width: int) -> Iterator[tuple[int, object]]:
        """Streams a row: for each place that ends a match of width symbols or more, the place and the least end of those width symbols."""
        nexts, link, length = self.next, self.link, self.length
        state = size = 0
        for i, symbol in enumerate(row):
            while state and symbol not in nexts[state]:
                state = link[state]
                size = length[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                size += 1
            if size >= width:
                while length[link[state]] >= width:
                    state = link[state]
                    size = length[state]
                yield i, self.least[state]


def _matched(unit: repeats.Unit) -> Callable:
    """One shard: builds its automaton and streams its spans; returns the windows that stand earlier."""

    def f(shard: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        spans = [(int(d), int(p - b), np.frombuffer(c, np.int64).tolist()) for d, p, b, c in zip(shard["doc_id"], shard["place"], shard["before"], shard["span"], strict=True)]
        for d, p, codes in spans:
            automaton.add(codes, [(d, p + i) for i in range(len(codes))])
        automaton.finish()
        found = {(d, p + i - unit.width + 1) for d, p, codes in spans for i, least in automaton.statistics(codes, unit.width) if least < (d, p + i)}
        return repeats.in_runs(*np.array(sorted(found), np.int64).reshape(-1, 2).T)

    return f


def deduplicate_words(docs: DataFrame, width: int = 20, shard_spans: int = 1000) -> DataFrame:
    """Removes each word covered by a window of width words whose sequence also starts earlier (smaller doc_id, or same document).

    Words are runs of anything but ASCII white space, unchanged. Returns doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space), kept (that text). Null and empty texts have no words; very long ones are read whole, in
    blocks. A null doc_id has no place in the order:
    its row is returned with all its words, and matches nothing. Rows that share a doc_id are ordered by a hash of their
    text; identical rows are one document and share a result. Other columns are ignored. No rows give no rows.
    """
    unit = repeats.Unit(words=True, width=width, gram=max(1, width * 7 // 20))
    seen = stored(repeats.occurrences(docs, unit))
    first = stored(repeats.firsts(seen))
    rest = stored(repeats.contested(first))
    windows = repeats.settled(docs, rest, unit, shard_spans, _matched(unit))

    def finish(ids: pa.Array, data: np.ndarray, at: np.ndarray, found: list) -> pa.RecordBatch:
        out = []
        for i in range(len(ids)):
            text = data[at[i] : at[i + 1]]
            words = text.tobytes().split() if len(text) else []
            n = len(words)
            if found[i]:
                gone = repeats.covered(n, unit, *found[i])
                words = [words[j] for j in np.flatnonzero(~gone)]
            kept = b" ".join(words)
            out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
        n, gone, sha, kept = zip(*out, strict=True) if out else ([],) * 4
        return pa.record_batch({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    return repeats.decided(docs, repeats.later(seen, first), windows, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
