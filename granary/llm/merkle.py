"""Merkle manifests of tables: one digest of everything, and for each row the proof that it is in it.

Leaves get their places by a range shuffle and running counts, so that no source is ever in one task. Runs of 16 ** 3 places
of a source are aligned blocks, complete subtrees. Executors hand whole blocks, as Arrow buckets, to DuckDB, where a level
of the tree is one query of ordered string_agg and sha256. Spark combines the blocks' roots, level by level, then the
sources', and joins what stands outside a block, its outer proof, to the block once. A second pass over the blocks makes
the proofs and folds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import quoted, stored

FAN, DEPTH = 16, 3
#: Leaves of a block, and how many rows (or the block that exceeds it) DuckDB gets at a time.
BLOCK, ROWS = FAN**DEPTH, 8192
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_BITS = 33


def sealed(column: Column) -> Column:
    """A value as leaves hash it: - if null, else its UTF-8 byte count, a colon and itself."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(sealed, columns)).cast("binary"), 256)


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows with place (from 0) in their group and size (the group's rows), in order; rows that are alike in it stay in that of an id of theirs.

    A range shuffle by group and order deals a group over as many partitions as it needs. A partition counts its rows of a
    group, and the counts before it, a row a partition and group, give the place of its first.
    """
    tied = stored(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [*map(F.asc_nulls_first, group), *order, F.asc("_tie")]
    parts = int(tied.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = stored(tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    at = at.withColumn("_part", F.shiftright("_at", _BITS))
    some = at.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by = [F.col(c) for c in group] or [F.lit(0)]
    runs = some.withColumns({"_before": F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("_n").over(Window.partitionBy(*by))})
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_{c}") for c in group], "_first", "_before", "size")
    return at.join(runs, _same(group, F.col("_part") == F.col("_p"))).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_p", "_first", "_before", *[f"_{c}" for c in group])


def _levels() -> str:
    """Nodes of each level of blocks: h0 the leaves, r1 the runs of hashes below h1, and so on. A level ends a tree where one node is left."""
    out = "h0 as (select block, place as p, size, leaf as h from t)"
    for k in range(1, DEPTH + 1):
        out += f",\nr{k} as (select block, p // {FAN} as p, size, string_agg(h, '' order by p) as run from h{k - 1} where size > {FAN ** (k - 1)} group by block, p // {FAN}, size)"
        out += f",\nh{k} as (select block, p, size, sha256(run) as h from r{k})"
    return out


def _roots() -> str:
    """A block's root is its node on the last level that its tree has."""
    ends = [f"size <= {FAN**k}" if k < DEPTH else "true" for k in range(DEPTH + 1)]
    each = [f"select block, size, h from h{k} where {end}" + (f" and size > {FAN ** (k - 1)}" if k else "") for k, end in enumerate(ends)]
    return f"with {_levels()}\n" + " union all ".join(each)


def _proofs(outer: int, with_proofs: bool) -> str:
    """For every leaf what stands beside its path in the block, left and right of it by level, then the block's outer proof: all that hashed, and folded with the leaf."""
    sides, joins, steps, v = "", "", "", f"v{DEPTH + outer}"
    for k in range(1, DEPTH + 1):
        i = f"((t.place // {FAN ** (k - 1)}) % {FAN})"
        sides += f", coalesce(left(r{k}.run, 64 * {i}), '') as a{k}, coalesce(substr(r{k}.run, 64 * {i} + 65), '') as b{k}, r{k}.run is not null as in{k}"
        joins += f" left join r{k} on r{k}.block = t.block and r{k}.p = t.place // {FAN**k}"
        steps += f",\nf{k} as (select *, case when in{k} then sha256(a{k} || v{k - 1} || b{k}) else v{k - 1} end as v{k} from f{k - 1})"
    for k in range(1, outer + 1):
        steps += f",\nf{DEPTH + k} as (select *, case when len(o) >= {k} then sha256(o[{k}].\"left\" || v{DEPTH + k - 1} || o[{k}].\"right\") else v{DEPTH + k - 1} end as v{DEPTH + k} from f{DEPTH + k - 1})"
    inner = ", ".join(f"case when in{k} then {{'left': a{k}, 'right': b{k}}} end" for k in range(1, DEPTH + 1))
    proof = f", list_concat(list_filter([{inner}], lambda x: x is not null), o) as proof" if with_proofs else ""
    return f"""with o as (select block, any_value("outer") as o, any_value(subroot) as subroot, any_value(root) as root from t where "outer" is not null group by block),
{_levels()},
f0 as (select t.doc_id, t.block, t.place, t.leaf, coalesce(t.changed, t.leaf) as v0, o.o, o.subroot, o.root{sides} from t join o on o.block = t.block{joins}){steps}
select doc_id, block, place, leaf, subroot, root, {v} as folded_root,
  sha256({" || ".join(f"a{k} || b{k}" for k in range(1, DEPTH + 1))} || array_to_string(list_transform(o, lambda x: x."left" || x."right"), '')) as proof_sha256{proof} from f{DEPTH + outer}"""


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, of rows that come block by block."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held)
        last, cut = table.column("block")[-1], table.num_rows
        while cut and table.column("block")[cut - 1] == last:  # at most a block's rows
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _engine(sql: str, schema: pa.Schema) -> Callable:
    """A DuckDB query over tables t of whole blocks."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        for t in _whole_blocks(batches):
            con.register("t", t)
            yield from con.sql(sql).to_arrow_table().select(schema.names).cast(schema).to_batches(max_chunksize=ROWS)
            con.unregister("t")
        con.close()

    return f


_SIDES = "array<struct<left: string, right: string>>"


def _same(group: Sequence[str], alike: Column) -> Column:
    """alike, and the same group on both sides, where the right one's columns begin with an underscore."""
    for c in group:
        alike &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return alike


def _combined(nodes: DataFrame, group: Sequence[str], most: int, base: int) -> tuple[DataFrame, list[DataFrame]]:
    """Tops of the trees over nodes (group, place on level base, size of the tree in leaves, h), and the nodes of each level above with their children."""
    tops, levels, level = nodes.where(F.col("size") <= FAN**base), [], base
    while FAN**level < most:
        above = nodes.where(F.col("size") > FAN**level).groupBy(*group, "size", F.floor(F.col("place") / FAN).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("children"))  # at most 16
        levels.append(stored(above.withColumn("h", F.sha2(F.array_join("children.h", "").cast("binary"), 256))))
        level += 1
        nodes = levels[-1].drop("children")
        tops = tops.unionByName(nodes.where(F.col("size") <= FAN**level))
    return tops, levels


def _proved(tops: DataFrame, levels: list[DataFrame], group: Sequence[str], base: int) -> DataFrame:
    """Group, place and outer proof of all nodes on level base, and the columns of tops. A node's proof is what stands beside it, then its parent's. tops: with outer, what stands beside them."""
    carried = [c for c in tops.columns if c not in (*group, "place", "size", "h", "outer")]
    named = [*group, "place", "outer", *carried]

    def on(k: int) -> DataFrame:
        """Tops of trees that end on that level."""
        here = F.col("size") <= FAN ** (base + k)
        return tops.where(here & (F.col("size") > FAN ** (base + k - 1)) if k else here).select(named)

    known = on(len(levels))
    for k in reversed(range(len(levels))):
        up = known.select(*[F.col(c).alias(f"_{c}") for c in (*group, "place")], "outer", *carried)
        each = levels[k].join(up, _same(group, F.col("place") == F.col("_place"))).select(*group, "children", "outer", *carried, F.explode("children").alias("child"))

        def beside(before: bool) -> Column:
            mine = F.col("child.place")
            return F.array_join(F.transform(F.filter("children", lambda x: (x["place"] < mine) if before else (x["place"] > mine)), lambda x: x["h"]), "")

        step = F.array(F.struct(beside(True).alias("left"), beside(False).alias("right"))).cast(_SIDES)
        known = each.select(*group, F.col("child.place").alias("place"), F.concat(step, "outer").alias("outer"), *carried).unionByName(on(k))
    return known


def _in_blocks(df: DataFrame) -> DataFrame:
    """df's rows dealt by block, each block's together."""
    return df.repartition("block").sortWithinPartitions("block")


def _block(number: Column) -> Column:
    return F.concat(number.cast("string"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))


#: The source in a block's name.
_SOURCE = "case when instr(block, '=') > 0 then substring(block, instr(block, '=') + 1) end"
_ROOT = pa.schema([("block", pa.string()), ("size", pa.int64()), ("h", pa.string())])
_LEAF = pa.schema([("doc_id", pa.int64()), ("block", pa.string()), ("place", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "folded_root", "proof_sha256")]])
_PROOF = pa.field("proof", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS, with_proofs: bool = True) -> DataFrame:
    """A row a document: doc_id, source, place, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    A leaf is the sha256 of the columns, each sealed with its length. Leaves of a source ascend by doc_id (null first; ties by
    leaf, and leaves that are alike in that, too, are the same wherever they stand); 16 by 16 they become the sha256 of their
    hashes, until one, the subroot, is left, a lone leaf as it is. Subroots by source (null first, in the order of their UTF-8
    bytes) become the root likewise. proof has what stands left and right of the leaf's path, a level each; proof_sha256 is
    that of all of it. changed: what some columns are now. folded_root is then made from the leaf of the changed row and the
    proof of the old one, and verified says whether that is the root; without changes it always is.

    Null sources are one source, empty and null texts differ, very long texts are hashed where they are read and go no
    further. Repeated rows have leaves of their own. Further columns are ignored; no rows give none. No task holds more of a
    source than a range of it, or a block of 4096 leaves.
    """
    cells = {c: quoted(c) for c in columns}
    now = leaf([(changed or {}).get(c, x) for c, x in cells.items()]) if changed else F.lit(None).cast("string")
    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("source").cast("string").alias("source"), leaf(list(cells.values())).alias("leaf"), now.alias("changed"))
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed")))
    leaves = placed(rows, ["source"], [F.asc_nulls_first("doc_id"), F.asc("leaf")])
    leaves = stored(leaves.withColumn("block", _block(F.floor(F.col("place") / BLOCK))))
    most = leaves.agg(F.max("size")).first()[0] or 0

    roots = stored(_in_blocks(leaves.select("block", "place", "size", "leaf")).mapInArrow(_engine(_roots(), _ROOT), "block string, size long, h string"))
    blocks = roots.select(F.expr(_SOURCE).alias("source"), F.substring_index("block", "=", 1).cast("long").alias("place"), "size", "h")
    subroots, inside = _combined(blocks, ["source"], most, DEPTH)
    sources = stored(placed(subroots.select("source", "h", F.col("size").alias("leaves")), [], [F.asc_nulls_first("source")]))
    top, outside = _combined(sources.select("place", "size", "h"), [], sources.count(), 0)
    none = F.array().cast(_SIDES)
    above = _proved(top.withColumns({"outer": none, "root": F.col("h")}), outside, [], 0)
    tops = sources.join(above, "place").select("source", F.lit(0).cast("long").alias("place"), F.col("leaves").alias("size"), F.col("h").alias("subroot"), "outer", "root")
    outer = _proved(tops, inside, ["source"], DEPTH).select(_block(F.col("place")).alias("of"), "outer", "subroot", "root")
    outer = stored(outer)
    deepest = outer.agg(F.max(F.size("outer"))).first()[0] or 0

    first = (F.col("place") % BLOCK == 0) & (F.col("block") == F.col("of"))  # once a block
    given = leaves.join(outer, first, "left").select("doc_id", "block", "place", "size", "leaf", "changed", "outer", "subroot", "root")
    kind = "doc_id long, block string, place long, leaf string, subroot string, root string, folded_root string, proof_sha256 string" + (f", proof {_SIDES}" if with_proofs else "")
    schema = _LEAF.append(_PROOF) if with_proofs else _LEAF
    found = _in_blocks(given).mapInArrow(_engine(_proofs(deepest, with_proofs), schema), kind)
    return found.withColumns({"source": F.expr(_SOURCE), "verified": F.col("folded_root") == F.col("root")}).drop("block")


def verify(docs: DataFrame, proofs: DataFrame, root: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """doc_id and verified of rows that are now in docs, by proofs that were kept (doc_id, proof; no id twice). Rows without a proof, null ids among them, aren't verified."""
    kept = proofs.select(F.col("doc_id").alias("_id"), "proof")
    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), leaf([quoted(c) for c in columns]).alias("leaf"))
    folded = F.aggregate("proof", F.col("leaf"), lambda v, s: F.sha2(F.concat(s["left"], v, s["right"]).cast("binary"), 256))
    return rows.join(kept, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce(folded == root, F.lit(False)).alias("verified"))
