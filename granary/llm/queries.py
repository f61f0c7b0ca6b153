"""Queries of the corpus operators over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import ann, automata, codes, decontamination, html, merkle, minhash, packing, quality, secrets, sentencepieces, suffixes, urls

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.deduplicate_words(_read(spark, sf_dir, "documents")).drop("kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate_bytes(_read(spark, sf_dir, "documents")).drop("removed")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages")).drop("trust", "distrust")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("item_ids", "tag")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_read(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=4).drop("class_id", "tag")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings")).drop("label")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth id by its checksum has its text tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(tampered, F.translate("text", urls.UPPER, urls.LOWER)).otherwise(F.col("text"))
    found = merkle.manifest(_read(spark, sf_dir, "documents"), {"text": text}, with_proofs=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_url_filters": op6_url_filters,
    "op7_decontamination": op7_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sentencepiece": op13_sentencepiece,
}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '{1}')"

#: Windows as lists of words, each with the first place where it starts.
_OP1 = rf"""
with w as (select doc_id, {_WORDS.format("text", r"[^\x20\x09-\x0D]+")} as words from documents),
g as (select doc_id, i, array_to_string(words[i:i+19], ' ') as body from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from w)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by body order by doc_id, i) as n from g) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from r),
lists as (select doc_id, list(p) as ps from gone group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(array_to_string(case when ps is null then words else list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: not list_contains(ps, x[2])), lambda x: x[1]) end, ' ')) as kept_sha256
from w left join lists using (doc_id)"""

#: Bytes as pairs of hexadecimal digits; runs of repeated windows, and what stands between them.
_OP3 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
g as (select doc_id, i, md5(substring(h, 2 * i - 1, 200)) as body from (select doc_id, h, unnest(range(1, n - 98)) as i from d)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by body order by doc_id, i) as k from g) where k > 1),
c as (select doc_id, i, max(i + 100) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as upto from r),
s as (select doc_id, i, sum((upto is null or i > upto)::int) over (partition by doc_id order by i) as run from c),
runs as (select doc_id, run, min(i) as a, max(i) + 100 as b from s group by all),
t as (select doc_id, count(*) as n_spans, sum(b - a) as gone, list({'a': a, 'b': b} order by a) as rs from runs group by doc_id),
k as (select d.doc_id, n, coalesce(gone, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, case when rs is null then h else
  array_to_string(list_transform(range(0, len(rs) + 1), lambda j: substring(h, 2 * (case when j = 0 then 1 else rs[j].b end) - 1, 2 * ((case when j = len(rs) then n + 1 else rs[j + 1].a end) - (case when j = 0 then 1 else rs[j].b end)))), '') end as kept from d left join t using (doc_id))
select doc_id, n as n_bytes, n_removed, n_spans, sha256(unhex(kept)) as kept_sha256 from k"""

_OP7 = rf"""
with b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
q as (select distinct item_id, least(13, len(words)) as n, array_to_string(words[i:i+12], ' ') as body from (select *, unnest(range(1, greatest(2, len(words) - 11))) as i from b where len(words) > 0)),
sizes as (select distinct n from q),
g as (select doc_id, n, i, array_to_string(words[i:i+n-1], ' ') as body from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, sizes)),
m as (select doc_id, item_id, i, n from g join q using (n, body)),
hits as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
items as (select doc_id, count(distinct item_id)::bigint as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)"""

_OP9 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i+3], ' ') as g from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
c as (select doc_id as x, doc_id as y from documents union select c.x, e.b from c join e on e.a = c.y)
select doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(y) as component_id, doc_id = min(y) as kept
from documents left join n using (doc_id) join c on c.x = doc_id group by doc_id"""



def _op11() -> str:
    """Parts of four integers; two rounds, each an assignment and floored means."""
    far = " + ".join(f"(p.w[{i}] - c.w[{i}]) * (p.w[{i}] - c.w[{i}])" for i in range(1, 5))
    mean = ", ".join(f"((sum(w[{i}]) - ((sum(w[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::bigint" for i in range(1, 5))

    def assigned(books: str) -> str:
        return f"(select p.vec_id, p.part, p.w, min({{'d': {far}, 'e': c.entry}}) as best from p join {books} c using (part) group by all)"

    rounds = "".join(f"""
a{n} as {assigned(f"c{n}")},
m{n} as (select part, best.e as entry, [{mean}] as w from a{n} group by all),
c{n + 1} as (select part, entry, coalesce(m{n}.w, c{n}.w) as w from c{n} left join m{n} using (part, entry)),""" for n in range(2))
    return f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as materialized (select vec_id, label, part, v[4 * part + 1 : 4 * part + 4] as w from k, (select unnest(range(16)) as part)),
c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, w from p qualify entry < 64),{rounds}
a2 as {assigned("c2")},
f as (select vec_id, string_agg(format('{{:02x}}', best.e), '' order by part) as code, sum(best.d)::bigint as error from a2 group by vec_id),
b as (select sha256(string_agg(array_to_string(w, ','), ',' order by part, entry)) as codebooks_sha256 from c2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from f join k using (vec_id), b"""


def _op12(levels: int = 6) -> str:
    """Level by level, as many as any tree of 16 ** levels leaves needs; a tree that has one node left stays as it is."""

    def cell(name: str) -> str:
        return f"coalesce(octet_length(encode({name}::varchar)) || ':' || {name}, '-')"

    def tree(name: str, group: str) -> str:
        out = ""
        for k in range(levels):
            own = f"(case when n{k} > 1 then string_agg(h{k}, '' order by p{k}) over (partition by {group}, p{k} // 16 rows between unbounded preceding and unbounded following) end)"
            left = f"(case when n{k} > 1 then string_agg(h{k}, '' order by p{k}) over (partition by {group}, p{k} // 16 order by p{k} rows between unbounded preceding and 1 preceding) end)"
            right = f"(case when n{k} > 1 then string_agg(h{k}, '' order by p{k}) over (partition by {group}, p{k} // 16 order by p{k} rows between 1 following and unbounded following) end)"
            out += f"""
{name}r{k} as (select *, {own} as run, {left} as lefts, {right} as rights from {name}{k}),
{name}{k + 1} as (select distinct {group}, case when n{k} > 1 then p{k} // 16 else p{k} end as p{k + 1}, case when n{k} > 1 then (n{k} + 15) // 16 else n{k} end as n{k + 1}, case when n{k} > 1 then sha256(run) else h{k} end as h{k + 1} from {name}r{k}),"""
        return out

    def beside(name: str, group: str, first: str) -> str:
        """Siblings of the path of each node of level 0, as lists of lefts and rights; null on levels that its tree doesn't have."""
        joins = "".join(f" left join {name}r{k} x{k} on x{k}.{group} is not distinct from x0.{group} and x{k}.p{k} = case when x{k - 1}.n{k - 1} > 1 then x{k - 1}.p{k - 1} // 16 else x{k - 1}.p{k - 1} end" for k in range(1, levels))
        sides = ", ".join(f"case when x{k}.n{k} > 1 then {{'l': coalesce(x{k}.lefts, ''), 'r': coalesce(x{k}.rights, '')}} end" for k in range(levels))
        return f"select x0.{group}, x0.{first}, list_filter([{sides}], lambda x: x is not null) as sides from {name}r0 x0{joins}"

    names = ("doc_id", "source", "lang", "n_chars", "text")
    old = " || ".join(map(cell, names))
    new = " || ".join(cell("text2" if c == "text" else c) for c in names)
    fold = "(list_reduce(list_concat([{'l': coalesce(changed, leaf), 'r': ''}], sides), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l)"
    bits = "list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord((doc_id::varchar)[i])::bigint)), lambda a, b: {bits}))"
    return f"""
with d as (select *, case when {crc} % 5 = 0 then translate(text, '{urls.UPPER}', '{urls.LOWER}') else text end as text2 from documents),
v as (select doc_id, source, sha256({old}) as leaf, sha256({new}) as changed from d),
t0 as (select source, doc_id, leaf as h0, changed, row_number() over (partition by source order by doc_id, leaf) - 1 as p0, count(*) over (partition by source) as n0 from v),{tree("t", "source")}
tops as (select 0 as one, source, h{levels} as h0, row_number() over (order by source nulls first) - 1 as p0, count(*) over () as n0 from t{levels}),
s0 as (select * from tops),{tree("s", "one")}
inner_sides as ({beside("t", "source", "p0")}),
outer_sides as ({beside("s", "one", "p0")}),
every as (select t0.doc_id, t0.h0 as leaf, t0.changed, tops.h0 as subroot, s{levels}.h{levels} as root, list_concat(i.sides, o.sides) as sides
  from t0 join tops on tops.source is not distinct from t0.source join inner_sides i on i.source is not distinct from t0.source and i.p0 = t0.p0 join outer_sides o on o.p0 = tops.p0, s{levels})
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda x: x.l || x.r), '')) as proof_sha256, {fold} as folded_root, {fold} = root as verified from every"""


ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_suffix_dedup": _OP3, "op6_url_filters": urls.oracle(), "op7_decontamination": _OP7, "op9_minhash_near_dedup": _OP9, "op11_vector_codes": _op11(), "op12_merkle_manifest": _op12()}
