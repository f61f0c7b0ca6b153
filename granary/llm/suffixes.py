"""Suffix-array dedup: depth-limited radix sort of a corpus' suffixes, by most-significant-digit passes.

Suffixes are ordered only through ``width`` bytes; groups that are equal at that depth are exactly the repeated
windows. Before they are sorted, suffixes are dealt so that equal ones meet, and those that can have no equal or are
settled already are left out:

* by the window's anchor gram (equal windows have equal anchors at equal offsets, see repeats.py); one row an anchor
  stands for all suffixes around it,
* by all that a window with this anchor can reach. Suffixes that are equal here are equal to full depth,
* what is left is dealt to shards of bounded size by anchor, and each shard sorts its suffixes in byte order, most
  significant digit first. A digit is eight bytes, or what ranks of them fit a machine word; a suffix that a pass leaves
  alone in its group is in no later pass.

The passes over the corpus are grouped counts or minima with map-side combining and a join back, so a group that holds a
third of all suffixes is neither collected nor paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm import repeats
from granary.llm.common import stored


def byte_ranks(data: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The rank of the size bytes from each place on among all such strings of data, in byte order, and how many there are. size: 8 at most."""
    room = np.concatenate((data, np.zeros(size, np.uint8)))
    number = np.zeros(len(data), np.uint64)
    for i in range(size):
        number = (number << np.uint64(8)) | room[i : i + len(data)]
    values, rank = np.unique(number, return_inverse=True)
    return rank, len(values)


def radix_passes(digits: list[np.ndarray], base: int) -> np.ndarray:
    """Sorts suffixes by their digits (below base), most significant first. Returns the group of each one at full depth, in order; -1: it is alone."""
    group, alive, i = np.zeros(len(digits[0]), np.int64), np.arange(len(digits[0])), 0
    while i < len(digits) and len(alive):
        key, many = group[alive], 1 + int(group[alive].max())
        while True:
            key, many, i = key * base + digits[i][alive], many * base, i + 1
            if i == len(digits) or many * base >= 1 << 62:
                break
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        shared = count[which] > 1
        alive = alive[shared]
        group[alive] = which[shared]
    out = np.full(len(group), -1)
    out[alive] = group[alive]
    return out


def _sorted_shard(unit: repeats.Unit) -> Callable:
    """Sorts one shard's suffixes through full depth; returns the windows that stand earlier."""

    def f(shard: pd.DataFrame) -> pd.DataFrame:
        sizes = shard["span"].str.len().to_numpy()
        data = np.frombuffer(b"".join(shard["span"]), np.uint8)
        at = np.concatenate(([0], np.cumsum(sizes)))
        before, low, high = (shard[c].to_numpy() for c in ("before", "low", "high"))
        lanes = np.arange(unit.reach + 1)
        ok = (lanes >= low[:, None]) & (lanes <= np.minimum(high, before)[:, None]) & (before[:, None] - lanes + unit.width <= sizes[:, None])
        row, back = np.nonzero(ok)
        start = at[row] + before[row] - back
        size = min(8, unit.width)
        rank, many = byte_ranks(data, size)
        group = radix_passes([rank[start + o] for o in repeats.cover(0, unit.width, size)], many)
        some = np.flatnonzero(group >= 0)
        group, doc, place = group[some], shard["doc_id"].to_numpy()[row[some]], (shard["place"].to_numpy()[row] - back)[some]
        order = np.lexsort((place, doc, group))
        group, doc, place = group[order], doc[order], place[order]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
        first = np.repeat(head, np.diff(np.append(head, len(group))))
        again = (doc[first] != doc) | (place[first] != place)
        return repeats.in_runs(doc[again], place[again])

    return f


def deduplicate_bytes(docs: DataFrame, width: int = 100, shard_spans: int = 2000) -> DataFrame:
    """Removes each byte covered by a width-byte string that also starts earlier (smaller doc_id, or same document).

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start and end of each removed run).
    Null text is empty; very long texts are read whole, in blocks. Of equal windows the one that starts first stays. A null doc_id has no place in the order: its row is returned as it is, and matches nothing.
    Rows that share a doc_id are ordered by a hash of their text; identical rows are one document and share a result.
    Texts shorter than width keep all. Other columns are ignored. No rows give no rows.
    """
    unit = repeats.Unit(words=False, width=width, gram=max(1, width * 8 // 25))
    seen = stored(repeats.occurrences(docs, unit))
    first = stored(repeats.firsts(seen))
    rest = stored(repeats.contested(first))
    windows = repeats.settled(docs, rest, unit, shard_spans, _sorted_shard(unit))

    def finish(ids: pa.Array, data: np.ndarray, at: np.ndarray, found: list) -> pa.RecordBatch:
        out = []
        for i in range(len(ids)):
            text = data[at[i] : at[i + 1]]
            if found[i]:
                gone = repeats.covered(len(text), unit, *found[i])
                a, b = repeats.spans_of(gone)
                out.append((len(text), int(gone.sum()), len(a), hashlib.sha256(text[~gone].tobytes()).hexdigest(), np.stack((a, b), 1).tolist()))
            else:
                out.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest(), []))
        n, gone, spans, sha, runs = zip(*out, strict=True) if out else ([],) * 5
        return pa.record_batch({"doc_id": ids, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "removed": pa.array(runs, pa.list_(pa.list_(pa.int64())))})

    return repeats.decided(docs, repeats.later(seen, first), windows, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<bigint>>")
