"""Quality classifier by importance resampling: hashed n-gram generative models of target and raw text, Gumbel top-k.

Raw counts cover every document; target counts those that a bounded sample of labels calls good. A document's log weight
is the sum of the log ratios of its n-grams' smoothed probabilities in target and in raw text, by two models: pairs of
neighbouring terms, each as often as it occurs, and single terms, where repeats count by the logarithm of their number and
all count twice. Terms and pairs are hashed to buckets. A bucket counts only where its two counts differ by more than
chance, and a document's own counts are taken off both, so that labelled and other documents are judged alike. The sample
is drawn without replacement in proportion to the weights: the largest sums of log weight and Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import K1, LOWER, Shipped, mix, pick, slabs, span_hashes, stored, strings

KIND = np.zeros(256, np.int8)
KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
KIND[[*range(33, 48), *range(58, 97), *range(123, 127)]] = 2
#: N-grams whose counts a task adds up before it sends them on.
HELD = 1 << 20
#: Bits of a bucket's number that terms and pairs have; those of pairs come after all of terms.
TERM_BITS, PAIR_BITS = 25, 20
PAIRS = 1 << TERM_BITS


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of n-grams and their rows. Terms are runs of letters and digits, or of marks."""
    low = LOWER[data[at[0] : at[-1]]]
    at = at - at[0]
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[low]
    cut = np.ones(len(kind), bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut[at[1:-1][at[1:-1] < len(kind)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(kind))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    codes = span_hashes(low, starts, ends)
    rows = np.searchsorted(at, starts, "right") - 1
    same = rows[:-1] == rows[1:]
    pairs = mix(codes[:-1] * K1 + codes[1:])[same]
    return np.concatenate(((mix(codes) >> np.uint64(64 - TERM_BITS)).astype(np.int64), (pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + PAIRS)), np.concatenate((rows, rows[:-1][same]))


@dataclass
class Labels:
    """A bounded sample of labelled documents: sorted ids, and which are good."""

    ids: np.ndarray
    good: np.ndarray

    def is_good(self, ids: pa.Array) -> np.ndarray:
        known = np.asarray(ids.is_valid())
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(self.ids):
            return np.zeros(len(x), bool)
        where = np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1)
        return known & (self.ids[where] == x) & self.good[where]


def _added(held: list[np.ndarray]) -> pa.RecordBatch:
    """Counts of buckets. held: buckets, doubled, plus one for those of good documents."""
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    bucket = keys >> 1
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return pa.record_batch({"bucket": pa.array(bucket[first].astype(np.int32)), "raw": np.add.reduceat(n, first).astype(np.int32), "target": np.add.reduceat(n * (keys & 1), first).astype(np.int32)})


def _counts(shared: object) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: Labels = shared.value
        held, size = [], 0
        for batch in batches:
            data, at = strings(batch.column("text"))
            good = labels.is_good(batch.column("doc_id"))
            for a, b in slabs(np.diff(at), 1 << 18):
                bucket, row = grams(data, at[a : b + 1])
                held.append(bucket * 2 + good[a:b][row])
                size += len(bucket)
                if size > HELD:
                    yield _added(held)
                    held, size = [], 0
        if size:
            yield _added(held)

    return f


@dataclass
class Model:
    """Raw and target counts of the buckets that tell the two apart, sorted, and the share of target in raw."""

    labels: Labels
    buckets: np.ndarray
    raw: np.ndarray
    target: np.ndarray
    share: float
    deviations: float = 3.0

    def _ratios(self, w: np.ndarray, own: np.ndarray, good: np.ndarray) -> np.ndarray:
        expected, t = np.maximum(0, self.raw[w].astype(float) - own) * self.share, np.maximum(0, self.target[w].astype(float) - np.where(good, own, 0))
        told = np.abs(t - expected) > self.deviations * np.sqrt(expected * (1 - self.share) + 1)
        return np.where(told, np.log((t + 1) / (expected + 1)), 0.0)

    def log_weights(self, ids: pa.Array, text: pa.Array) -> np.ndarray:
        data, at = strings(text)
        good, out = self.labels.is_good(ids), np.zeros(len(ids))
        if not len(self.buckets):
            return out
        for a, b in slabs(np.diff(at), 1 << 18):
            bucket, row = grams(data, at[a : b + 1])
            key, own = np.unique((row << (TERM_BITS + 1)) | bucket, return_counts=True)
            bucket, row = key & (2 * PAIRS - 1), key >> (TERM_BITS + 1)
            where = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            known = self.buckets[where] == bucket
            where, own, row = where[known], own[known], row[known]
            times = np.where(bucket[known] < PAIRS, 2 * (1 + np.log(own)), own)
            out[a:b] = np.bincount(row, times * self._ratios(where, own, good[a:b][row]), minlength=b - a)
        return out


def sample_labels(labels: DataFrame, most: int) -> pd.DataFrame:
    """At most so many labelled documents, those with the least hash of their id: doc_id, quality, toxic. Repeated labels: the worst holds."""
    known = pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null and quality is not null and toxic is not null")
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas().sort_values("doc_id")


def _scored(shared: object) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), pa.array(shared.value.log_weights(batch.column("doc_id"), batch.column("text")))], ["doc_id", "tag", "log_weight"])

    return f


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 100_000) -> tuple[Model, DataFrame]:
    """The model, and doc_id, tag (hash of the text), log_weight of each document.

    Counts of all buckets stay in Spark. The model has those whose counts differ by more than two deviations: by chance a
    twentieth of those that have counts enough to tell, and what target and raw text really differ in. It grows with the
    corpus, up to 12 bytes for each of the 34 million buckets.
    """
    d = pick(docs, doc_id="long", text="string").withColumn("tag", F.xxhash64("text"))
    spark = docs.sparkSession
    known = sample_labels(labels, most_labels)
    sample = Labels(known["doc_id"].to_numpy(np.int64), ((known["quality"] > 0) & (known["toxic"] == 0)).to_numpy(bool))
    counts = d.select("doc_id", "text").mapInArrow(_counts(Shipped(spark, sample)), "bucket int, raw int, target int")
    counts = stored(counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    totals = counts.agg(F.sum("raw"), F.sum("target")).first()
    share = (totals[1] or 0) / max(1, totals[0] or 1)
    told = counts.where(F.abs(F.col("target") - F.col("raw") * share) > 2 * F.sqrt(F.col("raw") * share * (1 - share) + 1)).toPandas().sort_values("bucket")
    model = Model(sample, told["bucket"].to_numpy(np.int32), told["raw"].to_numpy(np.float32), told["target"].to_numpy(np.float32), share)
    return model, stored(d.mapInArrow(_scored(Shipped(spark, model)), "doc_id long, tag long, log_weight double"))


def gumbel(seed: int) -> Column:
    """Gumbel noise of each row, by its id and text."""
    u = (F.pmod(F.xxhash64("doc_id", "tag", F.lit(seed)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int, cells: int = 1024) -> float:
    """The k-th largest key, by counting in ever narrower cells. Only counts come to the driver."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = (high - low) / cells
        if width <= 0 or low + width == low:
            return low
        cell = F.least(F.lit(cells - 1), F.floor((F.col(key) - low) / width))
        found = rows.where(F.col(key).between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).orderBy(F.desc("cell")).collect()
        for r in found:
            if r.n >= k:
                low, high = r.a, r.b
                break
            k -= r.n
    return low


def good_documents(scores: DataFrame, labels: Labels) -> int:
    """How many of all documents are good: the labelled ones' share, corrected by regression for how much likelier good all documents look than they do."""
    share = float(labels.good.mean()) if len(labels.good) else 1.0
    n = scores.count()
    if not 0 < share < 1:
        return n if share else 0
    looks = scores.select("doc_id", (1 / (1 + F.exp(-F.col("log_weight")) * (1 - share) / share)).alias("look"))
    judged = scores.sparkSession.createDataFrame(pd.DataFrame({"doc_id": labels.ids, "good": labels.good.astype(int)}), "doc_id long, good int")
    everywhere = looks.agg(F.avg("look")).first()[0] or 0.0
    one = looks.join(F.broadcast(judged), "doc_id").agg(F.avg("good"), F.avg("look"), F.covar_pop("good", "look"), F.var_pop("look")).first()  # a row a label of the bounded sample
    if not one[3]:
        return round(n * share)
    return min(n, max(0, round(n * (one[0] + one[2] / one[3] * (everywhere - one[1])))))


def resample(docs: DataFrame, labels: DataFrame, size: int | None = None, most_labels: int = 100_000, temperature: float = 1.0, seed: int = 7) -> DataFrame:
    """The documents drawn: doc_id, tag, log_weight, key, kept (true).

    size documents are drawn by Gumbel top-k: key is log_weight plus temperature times Gumbel noise, and the largest keys win
    (equal keys at the end: all). Without a size, it is an estimate of the number of good documents (good_documents).
    most_labels bounds the labelled sample, which says what the target is and how much of it there is; counts and weights
    cover all documents and whole texts, very long ones too. Null and empty texts have a weight of 0. Rows with null or
    repeated ids are judged by their own text (and the label of the id), equal rows alike. Without good labels nothing tells
    documents apart, and all are drawn. Other columns are ignored; no rows give no rows.
    """
    model, scores = fit(docs, labels, most_labels)
    keyed = scores.withColumn("key", F.col("log_weight") + temperature * gumbel(seed))
    n = scores.count()
    if size is None:
        size = good_documents(scores, model.labels) if model.labels.good.any() else n
    if not n or size <= 0:
        return keyed.where("false").withColumn("kept", F.lit(True))
    return keyed.where(F.col("key") >= kth_largest(keyed, "key", min(size, n))).withColumn("kept", F.lit(True))
