"""Vector columns: products, similarities, validity, the local embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column | str, b: Column | str) -> Column:
    """Product of vectors of equal length; other lengths raise."""
    a, b = _double(a), _double(b)
    product = _total(F.zip_with(a, b, lambda x, y: x * y))
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def norm(v: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_double(v), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str, zero: str = "error") -> Column:
    """Cosine similarity. A zero vector raises, or counts as 0 with zero="zero"."""
    size = norm(a) * norm(b)
    none = F.raise_error(F.lit("cosine of a zero vector")).cast("double") if zero == "error" else F.lit(0.0)
    return F.when(size == 0, none).otherwise(dot(a, b) / size)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def euclidean(a: Column | str, b: Column | str) -> Column:
    a, b = _double(a), _double(b)
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def similarity(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    return {"cosine": cosine, "dot": dot, "euclidean": euclidean}[metric](a, b)


def higher_is_closer(metric: str) -> bool:
    return metric != "euclidean"


def normalized(v: Column | str) -> Column:
    """Unit length; a zero vector stays."""
    return let(_double(v), lambda w: let(norm(w), lambda n: F.when(n == 0, w).otherwise(F.transform(w, lambda x: x / n))))


def is_valid(v: Column | str, dimensions: int) -> Column:
    """Right length, all finite, not all zero."""
    v = _double(v)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


#: Fixed groups of words that stand for a concept each.
CONCEPTS = (
    ("refund", ("退款", "退费", "refund")),
    ("trial", ("试学", "预约", "trial")),
    ("metadata", ("metadata", "source", "filename", "来源")),
    ("stable_id", ("stable", "id", "document_id", "chunk_id", "稳定")),
    ("embedding", ("embedding", "向量", "vector")),
    ("similarity", ("similarity", "相似度", "检索", "retrieve")),
    ("support", ("答疑", "support", "工作日")),
)
#: Fixed words that the embedder skips.
EMBEDDER_STOP_WORDS = ("the", "a", "an", "is", "are", "to", "of", "and", "how", "why", "do")


def _equals(i: int):
    return lambda b: b == i


def local_embedding(text: Column | str, kind: str = "document", buckets: int = 4) -> Column:
    """Deterministic vector: hits a concept, a quarter for each token in its hash bucket, 0.3 for the kind; unit length."""
    t = F.trim(F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"(?U)\s+", " "))
    mode = [F.lit(0.3 if kind == "query" else 0.0), F.lit(0.0 if kind == "query" else 0.3)]

    def of(t: Column) -> Column:
        concepts = [sum((F.contains(t, F.lit(w)).cast("double") for w in words[1:]), F.contains(t, F.lit(words[0])).cast("double")) for _, words in CONCEPTS]
        tokens = F.filter(F.regexp_extract_all(t, F.lit(r"[a-z0-9]+|[\u4e00-\u9fff]"), F.lit(0)), lambda w: ~w.isin(*EMBEDDER_STOP_WORDS))
        # the hash mod 4 is its last hexadecimal digit mod 4
        bucket = F.transform(tokens, lambda w: F.pmod(F.conv(F.right(F.sha1(w), F.lit(1)), 16, 10).cast("int"), F.lit(buckets)))
        hashed = let(bucket, lambda b: F.array(*[F.size(F.filter(b, _equals(i))) * 0.25 for i in range(buckets)]))
        return F.concat(F.array(*concepts), hashed, F.array(*mode))

    return normalized(let(t, of))


#: Fixed groups of words that stand for a concept each, synonyms included.
SEMANTIC_CONCEPTS = (
    ("refund", ("退款", "退费", "退钱", "退回来", "refund")),
    ("trial", ("试学", "预约", "trial")),
    ("metadata", ("metadata", "source", "filename", "header_path", "来源", "出处", "引用", "出处字段")),
    ("stable_id", ("stable", "id", "document_id", "chunk_id", "更新", "删除", "稳定")),
    ("embedding", ("embedding", "向量", "向量化")),
    ("similarity", ("similarity", "相似度", "检索", "召回")),
    ("support", ("答疑", "support", "工作日", "助教")),
)


def mock_semantic_vector(text: Column | str) -> Column:
    """Hits of each concept's words, of unit length; a text without any is the zero vector."""
    t = F.trim(F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"(?U)\s+", " "))
    hits = let(t, lambda t: F.array(*[F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))).cast("double") for _, words in SEMANTIC_CONCEPTS]))
    return let(hits, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))
