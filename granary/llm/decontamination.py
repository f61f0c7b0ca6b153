"""Benchmark decontamination by a distributed positional inverted index.

Every benchmark window (13 words, or a whole shorter item) is a phrase query. Corpus counts of the benchmark's terms tell
each window's rarest terms. The index stores the postings (document, position, neighbouring words) of those terms only:
any occurrence of a window has one at a known offset. Lists are joined by term, positions less the term's offset in the
window give starts, and a start that all of the window's rarest terms agree on is a match, confirmed on the neighbours.
Terms go to the tasks in blocks of a bounded size, one after another, so a benchmark of any size takes more passes, not
more memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import K1, LOWER, mix, pick, slabs, span_hashes, stored, strings, word_spans

INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of the rows that at delimits, and the rows' offsets among them."""
    low = LOWER[data[at[0] : at[-1]]]
    starts, ends, _ = word_spans(low, at - at[0], INSIDE)
    return span_hashes(low, starts, ends), np.searchsorted(starts, at - at[0])


def _windows(width: int) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = strings(batch.column("text"))
            codes, to = terms_of(data, at)
            row, hashes, words = [], [], []
            for i in range(len(at) - 1):
                item = codes[to[i] : to[i + 1]]
                n = min(width, len(item))
                for s in range(len(item) - n + 1 if n else 0):
                    w = item[s : s + n]
                    h = np.array([n], np.uint64)
                    for c in w:
                        h = mix(h * K1 + c)
                    row.append(i)
                    hashes.append(h.view(np.int64)[0])
                    words.append(w.view(np.int64))
            yield pa.record_batch({"item_id": batch.column("item_id").take(pa.array(row, pa.int64())), "window": pa.array(hashes, pa.int64()), "terms": pa.array(words, pa.list_(pa.int64())), "phrase": pa.array([w.tobytes() for w in words], pa.binary())})

    return f


def _counts(block: object) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (terms,) = block.value
        for batch in batches:
            data, at = strings(batch.column(0))
            for a, b in slabs(np.diff(at), 1 << 18):
                where, found = _members(terms_of(data, at[a : b + 1])[0], terms)
                n = np.bincount(where[found], minlength=len(terms))
                some = np.flatnonzero(n)
                yield pa.record_batch({"term": terms[some], "n": n[some]})

    return f


def _members(codes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code its place in terms (sorted), and whether it is there."""
    signed = codes.view(np.int64)
    where = np.minimum(np.searchsorted(terms, signed), max(0, len(terms) - 1))
    return where, (terms[where] == signed if len(terms) else np.zeros(len(signed), bool))


POSTINGS = "doc_id long, tag long, n_words long, postings array<struct<term:bigint,position:bigint,near:binary>>"


def _index(block: object, width: int) -> Callable:
    """One row a document: its words and its postings of the block's terms, each with width - 1 places on either side.

    Places that no window of the term reaches to are zero: a posting of a term that is an item by itself is little more than a position.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (terms, before, after), room = block.value, width - 1
        offsets = np.arange(-room, room + 1)
        for batch in batches:
            data, at = strings(batch.column("text"))
            for a, b in slabs(np.diff(at), 1 << 18):
                codes, to = terms_of(data, at[a : b + 1])
                which, known = _members(codes, terms)
                place = np.flatnonzero(known)
                which = which[place]
                row = np.searchsorted(to, place, "right") - 1
                lanes = place[:, None] + offsets[None, :]
                inside = (lanes >= to[row][:, None]) & (lanes < to[row + 1][:, None]) & (offsets >= -before[which][:, None]) & (offsets <= after[which][:, None])
                near = np.where(inside, codes[np.clip(lanes, 0, max(0, len(codes) - 1))] if len(codes) else 0, 0).astype("<u8")
                near = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * (2 * room + 1)), len(place), [None, pa.py_buffer(np.ascontiguousarray(near))]).cast(pa.binary())
                lists = pa.StructArray.from_arrays([pa.array(codes[place].view(np.int64)), pa.array(place - to[row]), near], ["term", "position", "near"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()), lists)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("tag").slice(a, b - a), pa.array(np.diff(to), pa.int64()), lists], ["doc_id", "tag", "n_words", "postings"])

    return f


def _by_blocks(terms: DataFrame, limit: int, make: Callable[[object], DataFrame]) -> list[DataFrame]:
    """make(broadcast of the columns of about limit rows of terms at most, sorted by term), stored, for all blocks. One block at a time is in memory."""
    terms = stored(terms)
    n, out = max(1, -(-terms.count() // limit)), []
    for i in range(n):
        block = terms.where(F.pmod(F.xxhash64("term", F.lit(7)), F.lit(n)) == i).toPandas().sort_values("term")
        sent = terms.sparkSession.sparkContext.broadcast(tuple(block[c].to_numpy(np.int64) for c in block.columns))
        out.append(stored(make(sent)))
        sent.unpersist()
    return out


class PhraseIndex:
    """Positional index of docs for the windows of a benchmark."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int = 13, rarest: int = 3, block_terms: int = 2_000_000) -> None:
        given = pick(docs, doc_id="long", text="string")
        of_items = stored(pick(benchmark, item_id="string", text="string").where("item_id is not null").mapInArrow(_windows(width), "item_id string, window long, terms array<long>, phrase binary"))
        self.items = of_items.select("item_id", "window").distinct()
        phrases = of_items.groupBy("window").agg(F.first("terms").alias("terms"), F.first("phrase").alias("phrase"))
        at = phrases.select("window", F.posexplode("terms").alias("offset", "term"))
        counts = _by_blocks(at.select("term").distinct(), block_terms, lambda b: given.select("text").mapInArrow(_counts(b), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))
        all_counts = counts[0]
        for c in counts[1:]:
            all_counts = all_counts.unionByName(c)
        # a window with a term that the corpus lacks occurs nowhere
        ranked = at.join(all_counts, "term", "left").withColumn("lacking", F.max(F.col("n").isNull()).over(Window.partitionBy("window")))
        ranked = ranked.where("not lacking").withColumn("k", F.row_number().over(Window.partitionBy("window").orderBy("n", "offset"))).where(F.col("k") <= rarest)
        sizes = phrases.select("window", F.size("terms").alias("n_terms"), "phrase")
        self.chosen = stored(ranked.join(sizes, "window").select("term", "window", "offset", "k", "n_terms", "phrase"))
        rows = given.withColumn("tag", F.xxhash64("text")).select("doc_id", "tag", "text")
        reach = self.chosen.groupBy("term").agg(F.max("offset").alias("before"), F.max(F.col("n_terms") - 1 - F.col("offset")).alias("after"))
        parts = _by_blocks(reach, block_terms, lambda b: rows.mapInArrow(_index(b, width), POSTINGS))
        self.documents = parts[0].select("doc_id", "tag", "n_words")
        self.postings = parts[0].select("doc_id", "tag", F.explode("postings").alias("p"))
        for p in parts[1:]:
            self.postings = self.postings.unionByName(p.select("doc_id", "tag", F.explode("postings").alias("p")))
        self.width, self.rarest = width, rarest

    def _starts(self) -> DataFrame:
        """Offset-adjusted postings of each window's rarest terms; same: the words around are the window's."""
        p = self.postings.select("doc_id", "tag", "p.term", "p.position", "p.near").join(self.chosen, "term")
        same = F.expr(f"substring(near, 8 * ({self.width - 1} - offset) + 1, 8 * n_terms) = phrase")
        return p.select("doc_id", "tag", "window", "k", "n_terms", (F.col("position") - F.col("offset")).alias("start"), same.alias("same"))

    def _needed(self) -> Column:
        return F.least(F.lit(self.rarest), F.col("n_terms"))

    def phrases(self) -> DataFrame:
        """Exact matches: doc_id, tag, window, start, n_terms."""
        lists = self._starts().groupBy("doc_id", "tag", "window", "start", "n_terms").agg(F.count_distinct("k").alias("k"), F.bool_and("same").alias("same"))
        return lists.where((F.col("k") == self._needed()) & F.col("same")).select("doc_id", "tag", "window", "start", "n_terms")

    def proximity(self, slack: int = 5) -> DataFrame:
        """Windows whose rarest terms all stand in a document within slack places of where they would: doc_id, tag, window."""
        near = self._starts().withColumn("cell", F.explode(F.array(F.floor(F.col("start") / slack), F.floor(F.col("start") / slack) + 1)))
        lists = near.groupBy("doc_id", "tag", "window", "cell", "n_terms").agg(F.count_distinct("k").alias("k"))
        return lists.where(F.col("k") == self._needed()).select("doc_id", "tag", "window").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, index: PhraseIndex | None = None) -> DataFrame:
    """What of each document are windows of benchmark items.

    Words: A-Z lower-cased, then runs of letters, digits and all beyond ASCII. A window is width words of an item, or the
    whole of a shorter one. Returns a row a document: doc_id, n_words, n_hit (words inside occurring windows), n_items,
    item_ids (sorted as strings), items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words). Null and empty texts
    have no words and are clean. Items with a null id or without words are left out; items that share an id are one.
    Rows with null or repeated ids are judged by their own text, equal ones alike; very long texts are indexed whole. Of
    terms that are equally rare those that come first in a window are looked up. Other columns are ignored; no rows give
    no rows.
    """
    index = index or PhraseIndex(docs, benchmark, width)
    found = stored(index.phrases())
    words = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "n_terms")).alias("hits"))  # no more than the text has places
    hits = words.select("doc_id", "tag", F.expr("size(array_distinct(flatten(transform(hits, x -> sequence(x.start, x.start + x.n_terms - 1)))))").cast("long").alias("n_hit"))
    items = found.select("doc_id", "tag", "window").distinct().join(index.items, "window").groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])
    both = hits.join(items, same(hits, items)).select(hits["doc_id"], hits["tag"], "n_hit", "item_ids")
    d = index.documents
    out = d.join(both, same(d, both), "left").select(d["doc_id"], d["tag"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "item_ids", "tag")
