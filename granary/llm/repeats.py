"""Repeated windows of a corpus, found through anchors that equal windows share.

A text is a row of symbols (words or bytes). Every window of ``width`` symbols holds an anchor: each gram of
``gram`` symbols whose hash is least in some window. Anchors depend on the window alone, so equal windows have equal
anchors at equal places. One row an anchor (about one for (width - gram) / 2 symbols) stands for all windows around it:

1. count gram hashes; an anchor seen once has no repeated window,
2. of the others, compare the whole context (all symbols that a window with this anchor can cover): an occurrence whose
   context stands earlier is covered whole,
3. what is left are first occurrences whose gram has other contexts: the operators refine those.

Order is by document id, then place. Rows with one id and other texts are told apart by a tag of their text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import BYTE_CODE, K1, SPACE, mix, pick, slabs, span_hashes, spans_of, stir, stored, strings, word_spans

SLAB = 1 << 17
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1
PAD = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Unit:
    """What windows are made of: words or bytes, symbols in a window, symbols in an anchor's gram."""

    words: bool
    width: int
    gram: int

    @property
    def reach(self) -> int:
        return self.width - self.gram


def symbols(data: np.ndarray, at: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbol codes of the rows that at delimits, and the rows' offsets among them."""
    if not words:
        return BYTE_CODE[data], at
    starts, ends, _ = word_spans(data, at, ~SPACE)
    return span_hashes(data, starts, ends), np.searchsorted(starts, at)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes from each place on (0 near the end, where they don't fit), by doubling."""
    size, have, out, done = 1, codes, None, 0
    total = len(codes)
    while True:
        if n & size:
            if out is None:
                out, done = have.copy(), size
            else:
                m = max(0, total - done - size + 1)
                new = np.zeros(total, np.uint64)
                new[:m] = stir(out[:m] * K1 + have[done : done + m])
                out, done = new, done + size
        if size * 2 > n:
            return out
        m = max(0, total - 2 * size + 1)
        new = np.zeros(total, np.uint64)
        new[:m] = stir(have[:m] * K1 + have[size : size + m])
        have, size = new, size * 2


def sliding(x: np.ndarray, n: int, best: Callable) -> np.ndarray:
    """best over n entries from each place on; the last n - 1 places are left out."""
    size, have = 1, x
    while size * 2 <= n:
        have = best(have[: len(have) - size], have[size:])
        size *= 2
    rest = n - size
    return best(have[: len(have) - rest], have[rest:]) if rest else have


def cover(start: int, end: int, gram: int) -> list[int]:
    """Offsets of grams that together cover start to end."""
    return sorted({*range(start, end - gram + 1, gram), end - gram})


@dataclass
class Slab:
    """Anchors of some rows."""

    rows: np.ndarray  # the row of each anchor
    place: np.ndarray  # its symbol number in the row
    hashes: np.ndarray
    contexts: np.ndarray


def lay_out(codes: np.ndarray, at: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with room pads before, between and after the rows, and the rows' new starts."""
    sizes = np.diff(at)
    to = at[:-1] - at[0] + room * np.arange(1, len(at))
    out = np.full(int(sizes.sum()) + room * (len(sizes) + 1), PAD, np.uint64)
    where = np.arange(int(sizes.sum())) + np.repeat(room * np.arange(1, len(at)), sizes)
    out[where] = codes[at[0] : at[-1]]
    return out, to


def anchors(codes: np.ndarray, at: np.ndarray, unit: Unit) -> Slab:
    """All anchors of the rows that at delimits."""
    out, to = lay_out(codes, at, unit.reach)
    sizes = np.diff(at)
    h = gram_hashes(out, unit.gram)
    order = ((h >> np.uint64(32)).astype(np.uint32) >> np.uint32(1)) + np.uint32(1)  # 0: no whole window starts there
    n, w = len(out), unit.reach + 1
    starts = np.zeros(n + 1, np.int32)  # where whole windows can start
    whole = sizes >= unit.width
    np.add.at(starts, to[whole], 1)
    np.add.at(starts, to[whole] + sizes[whole] - unit.width + 1, -1)
    fits = np.cumsum(starts[:n]).astype(bool)
    least = sliding(order, w, np.minimum)
    least = np.where(fits[: len(least)], least, np.uint32(0))
    # a gram is an anchor if it is the least of some window that holds it: windows that start up to reach before it
    most = sliding(np.concatenate((np.zeros(unit.reach, np.uint32), least, np.zeros(unit.reach, np.uint32))), w, np.maximum)[:n]
    found = np.flatnonzero((most == order[: len(most)]) & (most > 0))
    rows = np.searchsorted(to, found, "right") - 1
    place = found - to[rows]
    inside = (place >= 0) & (place + unit.gram <= sizes[rows])
    found, rows, place = found[inside], rows[inside], place[inside]
    context = np.zeros(len(found), np.uint64)
    for o in (*cover(-unit.reach, 0, unit.gram), *cover(unit.gram, unit.width, unit.gram)):
        context = mix(context * K1 + h[found + o])
    return Slab(rows, place, h[found], context)


def pieces(column: pa.Array, unit: Unit) -> Iterator[tuple[int, Slab]]:
    """First row, and the anchors of some rows from it on: rows in slabs; a very long row in overlapping parts."""
    data, at = strings(column)
    for a, b in slabs(np.diff(at), SLAB):
        codes, to = symbols(data[at[a] : at[b]], at[a : b + 1] - at[a], unit.words)
        if b > a + 1 or len(codes) <= 4 * SLAB:
            yield a, anchors(codes, to, unit)
            continue
        for i in range(0, len(codes), SLAB):
            j = max(0, i - 2 * unit.width)  # what an anchor depends on is nearer than that
            part = codes[j : i + SLAB + 2 * unit.width]
            s = anchors(part, np.array([0, len(part)]), unit)
            ok = (s.place + j >= i) & (s.place + j < i + SLAB)
            yield a, Slab(s.rows[ok], s.place[ok] + j, s.hashes[ok], s.contexts[ok])


def _tags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64) << PLACE_BITS


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, tag (23 bits of the text's hash), text. Rows without an id have no place in the order: they are left out here."""
    d = pick(docs, doc_id="long", text="string").where("doc_id is not null")
    return d.select("doc_id", F.expr("cast(xxhash64(text) & 8388607 as int)").alias("tag"), "text")


def _counts(unit: Unit) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s in pieces(batch.column(0), unit):
                h, n = np.unique(s.hashes, return_counts=True)
                yield pa.record_batch({"h": h.view(np.int64), "n": n.astype(np.int64)})

    return f


def _occurrences(unit: Unit) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), _tags(batch.column(1))
            for a, s in pieces(batch.column(2), unit):
                yield pa.record_batch({"h": s.hashes.view(np.int64), "c": s.contexts.view(np.int64), "doc_id": ids[a + s.rows], "place": tags[a + s.rows] | s.place})

    return f


OCCURRENCE = "h long, c long, doc_id long, place long"


def occurrences(docs: DataFrame, unit: Unit) -> DataFrame:
    """Anchors whose gram occurs again somewhere, with their context and place."""
    d = _documents(docs)
    again = stored(d.select("text").mapInArrow(_counts(unit), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    return d.mapInArrow(_occurrences(unit), OCCURRENCE).join(again, "h", "left_semi")


def firsts(found: DataFrame) -> DataFrame:
    """The first occurrence of each context of an anchor: h, c, n, first (doc_id, place)."""
    return found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))


def later(found: DataFrame, first: DataFrame) -> DataFrame:
    """Anchors whose whole context stands earlier: doc_id, place."""
    seen = first.where("n > 1").select("h", "c", "first")
    return found.join(seen, ["h", "c"]).where(F.struct("doc_id", "place") != F.col("first")).select("doc_id", "place")


def contested(first: DataFrame) -> DataFrame:
    """First occurrences whose gram has other contexts too: h, contexts (how many), doc_id, place."""
    many = stored(first.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"))
    return first.join(many, "h").select("h", "contexts", "first.doc_id", "first.place")


def by_document(rows: DataFrame, **lists: str) -> DataFrame:
    """One row a document with the lists of the given expressions; a document's list is no longer than its text."""
    return rows.withColumn("tag", F.shiftright("place", PLACE_BITS).cast("int")).groupBy("doc_id", "tag").agg(*(F.collect_list(F.expr(e)).alias(name) for name, e in lists.items()))


def with_texts(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    d = _documents(docs)
    if how == "inner":  # each text once, though its row be repeated
        lists = lists.dropDuplicates(["doc_id", "tag"])
    return d.join(lists, ["doc_id", "tag"], how)


SPAN = "key long, doc_id long, place long, before int, low int, high int, span binary"


def _spans(unit: Unit) -> Callable:
    """What the windows around each contested anchor can cover: place (of the anchor), symbols before it in the span, and
    the least and most symbols before it in a window.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = strings(batch.column("text"))
            ids, tags = batch.column("doc_id").to_numpy(), _tags(batch.column("tag"))
            parts, spans = [], []
            for i, found in enumerate(batch.column("found")):
                text = data[at[i] : at[i + 1]]
                codes = symbols(text, np.array([0, len(text)]), True)[0] if unit.words else text
                places, keys, contexts = (found.values.field(k).to_numpy() for k in ("p", "h", "n"))
                starts = np.maximum(0, places - unit.reach)
                spans += [codes[a:b].tobytes() for a, b in zip(starts.tolist(), (places + unit.width).tolist(), strict=True)]
                parts.append((keys, np.full(len(places), ids[i]), places | tags[i], places - starts, contexts))
                if len(spans) > 20_000 or i == len(ids) - 1:
                    key, doc, place, before, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.record_batch({"key": key, "doc_id": doc, "place": place, "before": before.astype(np.int32), "low": np.zeros(len(key), np.int32), "high": np.full(len(key), unit.reach, np.int32), "span": pa.array(spans, pa.binary()), "contexts": n})
                    parts, spans = [], []

    return f


def _halves(unit: Unit) -> Callable:
    """Splits each span in one for the windows that reach further back and one for the others. A new key also holds all
    that the windows of a span have in common; body tells spans of a key that differ.
    """
    size = 8 if unit.words else 1

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, doc, place, before, low, high, span in zip(*(batch.column(c.split()[0]).to_pylist() for c in SPAN.split(", ")), strict=True):
                n, middle = len(span) // size, (low + high + 1) // 2
                for a, b in ((middle, high), (low, middle - 1)) if low < high else ():
                    if before < a or before - b + unit.width > n:  # no such window in the text
                        continue
                    start, end = max(0, before - b), min(n, before - a + unit.width)
                    common = span[size * max(0, before - a) : size * min(n, before - b + unit.width)]
                    new = _digest(key.to_bytes(8, "little", signed=True) + struct.pack("<ii", a, b) + common)
                    part = span[size * start : size * end]
                    first, last = max(0, before - b), min(n - unit.width, before - a)
                    out.append((new, doc, place, before - start, a, b, part, _digest(struct.pack("<i", before - start) + part), place - before + first, last - first + 1))
            columns = list(zip(*out, strict=True)) or [()] * 10
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, *[pa.int32()] * 3, pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], [*(c.split()[0] for c in SPAN.split(", ")), "body", "start", "run"])

    return f


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def settled(docs: DataFrame, rest: DataFrame, unit: Unit, bound: int, solve: Callable) -> DataFrame:
    """Windows around contested anchors that stand earlier: doc_id, place (of the first), run (how many in a row).

    Spans are dealt to shards by anchor, and solve(shard) settles each; a shard has about bound spans at most. Spans of
    an anchor that has more are split in halves, again and again: a half that is equal to an earlier one is repeated
    whole, one that shares its common part with no other has no repeated window, and groups that are small enough go to
    shards. A half of one window is always settled, so no group of more than bound spans is ever brought together.
    """
    columns = [c.split()[0] for c in SPAN.split(", ")]
    lists = by_document(rest, found=f"struct(h, place & {PLACE} as p, contexts as n)")
    spans = stored(with_texts(docs, lists, "inner").select("doc_id", "tag", "text", "found").mapInArrow(_spans(unit), f"{SPAN}, contexts long"))
    small, large = [spans.where(F.col("contexts") <= bound).select(columns)], spans.where(F.col("contexts") > bound).select(columns)
    whole = []
    while large.take(1):
        halves = stored(large.mapInArrow(_halves(unit), f"{SPAN}, body long, start long, run int"))
        first = stored(halves.groupBy("key", "body").agg(F.min(F.struct("doc_id", "place")).alias("first")))
        sizes = stored(first.groupBy("key").agg(F.count(F.lit(1)).alias("spans")))
        kept = halves.join(first, ["key", "body"])
        whole.append(kept.where(F.struct("doc_id", "place") != F.col("first")).select("doc_id", F.col("start").alias("place"), "run"))
        split = stored(kept.where(F.struct("doc_id", "place") == F.col("first")).join(sizes.where("spans > 1"), "key").where("low < high"))
        small.append(split.where(F.col("spans") <= bound).select(columns))
        large = split.where(F.col("spans") > bound).select(columns)
    dealt = small[0]
    for x in small[1:]:
        dealt = dealt.unionByName(x)
    shards = max(1, 4 * spans.count() // bound)
    out = dealt.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(solve, "doc_id long, place long, run int")
    for x in whole:
        out = out.unionByName(x)
    return out


def in_runs(doc_ids: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    """doc_id, place, run of windows that start one after another."""
    order = np.lexsort((places, doc_ids))
    d, p = doc_ids[order], places[order]
    same = np.zeros(len(d), bool)
    same[1:] = (d[1:] == d[:-1]) & (p[1:] - p[:-1] <= 1)
    head = np.flatnonzero(~same)
    last = np.append(head[1:], len(d)) - 1 if len(d) else head
    return pd.DataFrame({"doc_id": d[head], "place": p[head], "run": (p[last] - p[head] + 1).astype(np.int32)})


def covered(n: int, unit: Unit, places: np.ndarray, starts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of n symbols are removed, given anchors with repeated contexts, and runs of repeated windows."""
    step = np.zeros(n + 1, np.int32)
    for a, b in ((places - unit.reach, places + unit.width), (starts, starts + runs - 1 + unit.width)):
        np.add.at(step, np.clip(a, 0, n), 1)
        np.add.at(step, np.clip(b, 0, n), -1)
    return np.cumsum(step[:n]) > 0


def decided(docs: DataFrame, whole: DataFrame, windows: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Each document with what is covered in it, through finish(ids, data, at, [(places, starts, runs), ...]) -> record batch."""
    both = whole.select("doc_id", "place", F.lit(None).cast("int").alias("run")).unionByName(windows)
    lists = by_document(both, places=f"case when run is null then place & {PLACE} end", windows=f"case when run is not null then struct(place & {PLACE} as p, run as n) end")
    none = pick(docs, doc_id="long", text="string").where("doc_id is null").select("doc_id", F.lit(0).alias("tag"), "text", F.lit(None).cast("array<bigint>").alias("places"), F.lit(None).cast("array<struct<p:bigint,n:int>>").alias("windows"))
    rows = with_texts(docs, lists, "left").unionByName(none)
    nothing = np.zeros(0, np.int64)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = strings(batch.column("text"))
            found = []
            for x, y in zip(batch.column("places"), batch.column("windows"), strict=True):
                if not x.is_valid:
                    found.append(None)
                else:
                    some = len(y.values) if y.is_valid else 0
                    found.append((np.asarray(x.values, np.int64), *((y.values.field(k).to_numpy().astype(np.int64) for k in ("p", "n")) if some else (nothing, nothing))))
            yield finish(batch.column("doc_id"), data, at, found)

    return rows.mapInArrow(f, schema)


__all__ = ["Unit", "contested", "covered", "decided", "firsts", "in_runs", "later", "occurrences", "settled", "spans_of"]
