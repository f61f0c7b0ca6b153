"""MinHash near-dedup by min-max hashing.

Each hash function gives two values of a document's signature: the least and the greatest hash of its shingles. That
halves the hash evaluations, and both agree between two sets with probability equal to their similarity.

Documents with equal shingle sets are one class, and only one of a class goes on. Classes that share a band of the
signature are candidates. Each is compared with hubs of its bucket (the least id, and the member with most company in
all its buckets), so a bucket of any size gives a few pairs a member. Classes that are then not yet connected with
others of a bucket find partners by their rarest shingles: two sets that are similar enough share one among so many of
their rarest as they may differ by, so a class whose rare shingles are its own needs no comparison. Every candidate is
confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import K1, LOWER, SPACE, mix, pick, slabs, span_hashes, stored, strings, word_spans
from granary.llm.components import connected_components
from granary.llm.repeats import gram_hashes

SEED = 20
#: Bits of two 128-bit samples that differ: at similarity s (1 - s) / 2 of them are expected; this is over 5 deviations more at 0.8.
MOST_BITS_APART = 31


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, row by row and sorted within; their offsets; words a row."""
    n_rows = len(at) - 1
    low = LOWER[data[at[0] : at[-1]]]
    starts, ends, rows = word_spans(low, at - at[0], ~SPACE)
    codes = span_hashes(low, starts, ends)
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    n = np.diff(first)
    h = gram_hashes(codes, words)
    last = np.repeat(first[1:], n)
    whole = np.arange(len(codes)) + words <= last
    owner, value = rows[whole], h[whole]
    for i in np.flatnonzero((n > 0) & (n < words)):  # the whole short sequence is one shingle
        x = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for c in codes[first[i] : first[i + 1]]:
                x = mix(np.array([x * K1 + c]))[0]
        owner, value = np.append(owner, i), np.append(value, x)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(n_rows + 1)), n


def signatures(value: np.ndarray, at: np.ndarray, functions: int) -> np.ndarray:
    """Min-max signatures: one row a set, least and greatest value of each hash function side by side. No set may be empty."""
    keys = np.random.default_rng(SEED).integers(1, 1 << 63, (2, functions), dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(at) - 1, 2 * functions), np.uint64)
    for j in range(functions):
        x = value * keys[0, j]
        x ^= x >> np.uint64(31)
        x *= keys[1, j]
        out[:, 2 * j] = np.minimum.reduceat(x, at[:-1])
        out[:, 2 * j + 1] = np.maximum.reduceat(x, at[:-1])
    return out


PASSED = ("id", "tag", "again", "doc_id")
PROFILE = "id long, tag long, again boolean, doc_id long, n long, set1 long, set2 long, bits1 long, bits2 long, bands array<long>"


def _profiles(words: int, bands: int, rows: int) -> Callable:
    """One row a document: the size and two hashes of its set, its bands, and one-bit samples of its signature."""
    functions = max(64, -(-bands * rows // 2))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = strings(batch.column("text"))
            for a, b in slabs(np.diff(at), 1 << 18):
                value, to, _ = shingle_sets(data, at[a : b + 1], words)
                size = np.diff(to)
                some = np.flatnonzero(size)
                keys, bits, both = np.zeros((b - a, bands), np.uint64), np.zeros((b - a, 2), np.uint64), np.zeros((b - a, 2), np.uint64)
                if len(some):
                    start = to[:-1][some]
                    s = signatures(value, np.append(start, len(value)), functions)
                    for j in range(bands):
                        x = np.full(len(some), j, np.uint64)
                        for i in range(rows):
                            x = mix(x * K1 + s[:, j * rows + i])
                        keys[some, j] = x
                    low = mix(s[:, :128] + np.arange(128, dtype=np.uint64) * K1) & np.uint64(1)
                    for i in range(2):
                        bits[some, i] = (low[:, 64 * i : 64 * i + 64] << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
                        both[some, i] = np.add.reduceat(mix(value + np.uint64(i) * K1), start)
                yield pa.record_batch({
                    **{c: batch.column(c).slice(a, b - a) for c in PASSED}, "n": size, "set1": both[:, 0].view(np.int64), "set2": both[:, 1].view(np.int64), "bits1": bits[:, 0].view(np.int64), "bits2": bits[:, 1].view(np.int64),
                    "bands": pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                })

    return f


def _confirmed(words: int, percent: int) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            found = np.zeros(len(us), bool)
            (data1, at1), (data2, at2) = strings(batch.column("text_u")), strings(batch.column("text_v"))
            for i in range(len(us)):
                a = shingle_sets(data1, at1[i : i + 2], words)[0]
                b = held.get(vs[i])  # rows with one hub mostly stand together
                if b is None:
                    held = {vs[i]: (b := shingle_sets(data2, at2[i : i + 2], words)[0])}
                both = len(np.intersect1d(a, b, assume_unique=True))
                found[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())}).filter(pa.array(found))

    return f


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs u, v whose full shingle sets are similar enough."""
    texts = docs.join(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    u, v = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "text_u", "text_v").mapInArrow(_confirmed(words, percent), "u long, v long")


def _tokens(words: int) -> Callable:
    """The shingles of each document: doc_id, n, token."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = strings(batch.column("text"))
            for a, b in slabs(np.diff(at), 1 << 18):
                value, to, _ = shingle_sets(data, at[a : b + 1], words)
                n = np.diff(to)
                row = pa.array(np.repeat(np.arange(a, b), n))
                yield pa.record_batch([batch.column("doc_id").take(row), batch.column("component").take(row), batch.column("apart").take(row), pa.array(np.repeat(n, n)), pa.array(value.view(np.int64))], ["doc_id", "component", "apart", "n", "token"])

    return f


def by_rarest(docs: DataFrame, split: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs u, v of documents in different components, one of them apart, that can be similar enough.

    With shingles in one order, rarest first, sets of n1 and n2 shingles that share k of them share one among the first
    n1 - k + 1 and n2 - k + 1. k is at least percent (n1 + n2) / (100 + percent). Sets are told apart by classes of size,
    as sets of like size need to agree in more.
    """
    base = np.log(1.02)
    texts = docs.join(split, "doc_id").select("doc_id", "text", "component", "apart")
    token = stored(texts.mapInArrow(_tokens(words), "doc_id long, component long, apart boolean, n long, token long"))
    often = token.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    order = Window.partitionBy("doc_id").orderBy("f", "token")  # a document's own shingles
    t = token.join(often, "token", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("at", F.row_number().over(order))
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    t = stored(t.where((F.col("at") <= spare) & (F.col("f") > 1)).withColumn("size", F.floor(F.log("n") / base).cast("int")))
    reach = int(np.ceil(np.log(100 / percent) / base)) + 1
    least_other = F.pow(F.lit(1.02), F.col("size") + F.col("step"))
    shared_least = F.ceil((F.col("n") + F.greatest(least_other - 1e-6, F.lit(1.0))) * percent / (100 + percent) - 1e-6)
    u = t.where("apart").withColumn("step", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).where(F.col("at") <= F.col("n") - shared_least + 1)
    u = u.select("token", (F.col("size") + F.col("step")).alias("size"), F.col("doc_id").alias("u"), F.col("component").alias("cu"), F.col("n").alias("n1"), F.col("at").alias("at1"))
    v = t.select("token", "size", F.col("doc_id").alias("v"), F.col("component").alias("cv"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    k = f"ceil((n1 + n2) * {percent} / {100 + percent} - 0.000001)"
    found = u.join(v, ["token", "size"]).where(f"cu != cv and at1 <= n1 - {k} + 1 and at2 <= n2 - {k} + 1 and 100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


KEY_BIT = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """One row for each text of each id: id, tag (the text's hash), again (whether other rows have the id), doc_id (a key), text.

    Of the texts that share an id the one with the least hash has the id as its key, the others a number made of id and text.
    """
    rows = pick(docs, doc_id="long", text="string").where("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"), "text")
    first = stored(rows.groupBy("id").agg(F.min("tag").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id", "first"))
    once = rows.join(first, "id", "left_anti").select("id", "tag", F.lit(False).alias("again"), F.col("id").alias("doc_id"), "text")
    several = rows.join(first, "id").groupBy("id", "first", "tag").agg(F.first("text").alias("text"))
    own = F.xxhash64("id", "tag").bitwiseAND(F.lit(KEY_BIT - 1)).bitwiseOR(F.lit(KEY_BIT))
    key = F.when(F.col("tag") == F.col("first"), F.col("id")).otherwise(own)
    return once.unionByName(several.select("id", "tag", F.lit(True).alias("again"), key.alias("doc_id"), "text"))


def groups(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row for each text of each id: doc_id, tag, again, key, n_shingles, component and class_key (least keys of the texts it reaches, and of those with an equal set)."""
    several = keyed(docs)
    d = several.select("doc_id", "text")
    p = stored(several.mapInArrow(_profiles(words, bands, rows), PROFILE))
    classes = stored(p.where("n > 0").groupBy("set1", "set2", "n").agg(F.min("doc_id").alias("class_id")))
    first = p.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    banded = first.select("doc_id", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = stored(banded.join(stored(sizes), "band"))
    company = shared.groupBy("doc_id").agg(F.sum("m").alias("company"))
    hubs = shared.join(company, "doc_id").groupBy("band").agg(F.min("doc_id").alias("a"), F.max_by("doc_id", F.struct("company", "doc_id")).alias("c"))
    shared = stored(shared.select("band", "doc_id").join(stored(hubs), "band"))
    of_u = first.select(F.col("doc_id").alias("u"), "n", "bits1", "bits2")
    of_v = first.select(F.col("doc_id").alias("v"), F.col("n").alias("n2"), F.col("bits1").alias("c1"), F.col("bits2").alias("c2"))
    alike = f"100 * least(n, n2) >= {percent} * greatest(n, n2) and bit_count(bits1 ^ c1) + bit_count(bits2 ^ c2) <= {_bits_apart(percent)}"
    one = shared.select("doc_id", F.explode(F.array_distinct(F.array("a", "c"))).alias("hub")).where("doc_id != hub").select(F.greatest("doc_id", "hub").alias("u"), F.least("doc_id", "hub").alias("v")).distinct()
    pairs = stored(one.join(of_u, "u").join(of_v, "v").where(alike).select("u", "v"))
    links = stored(confirmed(pairs, d, words, percent))
    so_far = connected_components(links)
    at = shared.select("band", "doc_id").join(so_far.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    parts = at.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = parts.groupBy("band").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("band", "main")
    split = stored(at.join(largest, "band").groupBy("doc_id").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("apart")))
    more = stored(by_rarest(d, split, words, percent).join(pairs, ["u", "v"], "left_anti"))
    links = links.unionByName(confirmed(more, d, words, percent))
    of_class = connected_components(links).withColumnRenamed("node", "class_id")
    known = p.select("id", "tag", "again", "doc_id", "n", "set1", "set2").join(classes, ["set1", "set2", "n"], "left").join(of_class, "class_id", "left")
    return known.select(F.col("id").alias("doc_id"), "tag", "again", F.col("doc_id").alias("key"), F.col("n").alias("n_shingles"), F.coalesce("component", "class_id", "doc_id").alias("component"), F.coalesce("class_id", "doc_id").alias("class_key"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """Groups documents whose sets of word shingles have a Jaccard similarity of percent or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one
    shingle; null and blank texts have none and are linked with nothing. Whole texts are compared, very long ones too.
    Returns one row a row of docs: doc_id, n_shingles, component_id (least doc_id reachable over links, itself included),
    kept (doc_id = component_id), class_id (least doc_id with an equal set), tag (hash of the text). A pair at the threshold
    itself shares no band with probability (1 - 0.8**4)**32 = 5e-8. Rows with a null doc_id are kept alone, with a null
    component. Rows that share a doc_id but not a text are judged each by its own; equal rows share a result. Other columns
    are ignored; no rows give no rows.
    """
    found = stored(groups(docs, words, percent, bands, rows))
    given = pick(docs, doc_id="long", text="string").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"), F.lit(False).alias("again"), "doc_id", "text")
    out = found.withColumns({"component_id": F.col("component"), "class_id": F.col("class_key")})
    if found.where("again").take(1):  # a group's least id may not be its least key, and rows come more than once
        for key, name in (("component", "component_id"), ("class_key", "class_id")):
            odd = found.where(F.col("key") >= KEY_BIT).select(key).distinct()
            least = found.join(odd, key, "left_semi").groupBy(key).agg(F.min("doc_id").alias("least"))
            out = out.join(least, key, "left").withColumn(name, F.coalesce("least", name)).drop("least")
        out = out.where("not again").unionByName(given.where("id is not null").select("doc_id", "tag").join(out.where("again"), ["doc_id", "tag"]).select(out.columns))
    lone = given.where("id is null").mapInArrow(_profiles(words, 1, 1), PROFILE)
    nothing = [F.lit(None).cast("long").alias(c) for c in ("component_id", "class_id")]
    both = out.select("doc_id", "n_shingles", "component_id", "class_id", "tag").unionByName(lone.select("doc_id", F.col("n").alias("n_shingles"), *nothing, "tag"))
    return both.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id", "tag")


def _bits_apart(percent: int) -> int:
    p = (1 - percent / 100) / 2
    return int(128 * p + 5.4 * (128 * p * (1 - p)) ** 0.5) + 1
