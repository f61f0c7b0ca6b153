"""The fixed hybrid retriever: visibility, both routes, thresholds, fusion, final k; failed and empty routes stay apart.

Also the configurable engine (similarity, threshold, MMR or hybrid, then reranking), and retries with fallbacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.identity import config_ref
from granary.operators import retrieval


@dataclass(frozen=True)
class HybridConfig:
    lexical_candidate_k: int = 5
    dense_candidate_k: int = 5
    lexical_min_rank: float | None = None
    dense_max_distance: float | None = None
    rrf_k: int = 60
    final_top_k: int = 5
    knowledge_scope: str | None = None
    source_roles: tuple[str, ...] = ()
    evidence_eligibilities: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if min(self.lexical_candidate_k, self.dense_candidate_k, self.rrf_k, self.final_top_k) <= 0:
            raise ValueError("every k must be positive")
        if (self.lexical_min_rank or 0) < 0 or not 0 <= (self.dense_max_distance or 0) <= 2:
            raise ValueError("a threshold is out of its range")
        if self.knowledge_scope is not None and not self.knowledge_scope.strip():
            raise ValueError("knowledge scope is blank")

    @property
    def ref(self) -> str:
        value = {"version": "1.0.0", **asdict(self), "source_roles": sorted(self.source_roles), "evidence_eligibilities": sorted(self.evidence_eligibilities)}
        return config_ref("fixed-hybrid-retriever", "1.0.0", value, ascii_only=True)


@dataclass
class Route:
    """A route's decided candidates, or why it failed. One that ran and found nothing is empty, not failed."""

    name: str
    decided: DataFrame | None
    error: str | None = None

    @property
    def status(self) -> str:
        return "failed" if self.decided is None else "ran" if self.decided.take(1) else "empty"


def run_route(name: str, make: Callable[[], DataFrame], k: int, higher_is_better: bool, limit: float | None) -> Route:
    """Ranks and decides a route's scores. Spark is lazy: the route is computed and kept here, so that a failure is its own."""
    try:
        order = F.desc("score") if higher_is_better else F.asc("score")
        decided = retrieval.threshold(retrieval.top(make(), k, order, F.asc("chunk_id")), limit, higher_is_better).persist()
        decided.count()
    except PySparkException as e:
        return Route(name, None, type(e).__name__)
    return Route(name, decided)


@dataclass
class HybridResult:
    routes: list[Route]
    fused: DataFrame | None
    config_ref: str

    @property
    def partial(self) -> bool:
        return any(r.decided is None for r in self.routes)

    def decisions(self) -> DataFrame | None:
        """All fused candidates; selected tells those within the final k."""
        return self.fused


def fixed_hybrid(lexical: Callable[[], DataFrame], dense: Callable[[], DataFrame], config: HybridConfig) -> HybridResult:
    """lexical and dense make query_id, chunk_id, score of visible chunks; distances are better when lower."""
    routes = [run_route("lexical", lexical, config.lexical_candidate_k, True, config.lexical_min_rank), run_route("dense", dense, config.dense_candidate_k, False, config.dense_max_distance)]
    passed = {r.name: r.decided.where("status = 'passed'") for r in routes if r.decided is not None}
    if not passed:
        return HybridResult(routes, None, config.ref)
    if len(passed) == 1:
        (name, only), other = next(iter(passed.items())), next(r.name for r in routes if r.name not in passed)
        passed = {name: only, other: only.where("false")}
    # the rank of a candidate is its rank in the route before the threshold
    fused = retrieval.reciprocal_rank_fusion(passed, config.rrf_k).withColumn("selected", F.col("fusion_rank") <= config.final_top_k)
    return HybridResult(routes, fused, config.ref)


@dataclass(frozen=True)
class EngineConfig:
    strategy: str = "similarity"  # similarity, threshold, mmr, hybrid
    top_k: int = 3
    candidate_k: int = 4
    score_threshold: float = 0.80
    mmr_lambda: float = 0.35
    hybrid_alpha: float = 0.5
    rerank: bool = False
    fetch_k: int | None = None
    rerank_top_n: int | None = None


def smart_retrieve(dense: DataFrame, config: EngineConfig, lexical: DataFrame | None = None, corpus: DataFrame | None = None, vectors: DataFrame | None = None, rerank_score: Column | None = None, texts: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank. dense and lexical: query_id, chunk_id, score; corpus: chunk_id; vectors: chunk_id, embedding; texts: query_id, chunk_id and what rerank_score reads."""
    coarse = config.fetch_k if config.rerank and config.fetch_k else config.top_k
    pool = retrieval.top(dense, max(config.candidate_k, coarse), F.desc("score"), F.asc("chunk_id"))
    if config.strategy == "hybrid":
        found = retrieval.weighted_hybrid(pool.select("query_id", "chunk_id", "score"), lexical, corpus, config.hybrid_alpha).withColumnRenamed("hybrid", "score")
        found = retrieval.top(found, coarse, F.desc("score"), F.asc("chunk_id"))
    elif config.strategy == "mmr":
        picks = retrieval.mmr(pool.join(vectors, "chunk_id"), coarse, config.mmr_lambda)
        found = pool.drop("rank").join(picks, ["query_id", "chunk_id"]).withColumnRenamed("pick", "rank")
    elif config.strategy in ("similarity", "threshold"):
        found = pool.where(F.col("rank") <= coarse) if config.strategy == "similarity" else retrieval.top(pool.drop("rank").where(F.col("score") >= config.score_threshold), coarse, F.desc("score"), F.asc("chunk_id"))
    else:
        raise ValueError(f"no strategy {config.strategy}")
    if config.rerank:
        again = found.withColumnRenamed("rank", "first_rank").drop("score").join(texts, ["query_id", "chunk_id"]).withColumn("score", rerank_score)
        return retrieval.top(again, config.rerank_top_n or config.top_k, F.desc("score"), F.asc("first_rank")).select("query_id", "chunk_id", "score", "rank")
    return found.where(F.col("rank") <= config.top_k).select("query_id", "chunk_id", "score", "rank")


#: Fixed: codes after which another try, or another configuration, can help.
RETRYABLE = ("timeout", "rate_limit", "network_error")


def reliable_attempts(outcomes: DataFrame, max_attempts: int = 2, retryable: tuple[str, ...] = RETRYABLE, fallback: tuple[str, ...] = RETRYABLE) -> DataFrame:
    """Which of the possible attempts are made. outcomes: request_id, config_index, attempt, ok, error_code of every attempt that could be.

    Within a configuration an attempt follows one that failed with a retryable code; a next configuration follows one
    whose last attempt failed with a code of the fallback policy. The first success ends it.
    """
    ordered = outcomes.where(F.col("attempt") <= max_attempts).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("config_index", "attempt", "ok", "error_code"))).alias("xs"))
    empty = F.struct(F.lit(True).alias("open"), F.lit(-1).alias("config"), F.lit(None).cast("string").alias("last"), F.array().cast("array<struct<config_index:int,attempt:int,ok:boolean,error_code:string>>").alias("made"))

    def step(s: Column, x: Column) -> Column:
        first = s["config"] == -1
        same = x["config_index"] == s["config"]
        go = s["open"] & (first | F.when(same, s["last"].isin(*retryable)).otherwise((x["attempt"] == 1) & s["last"].isin(*fallback)))
        return F.struct((s["open"] & ~(go & x["ok"])).alias("open"), F.when(go, x["config_index"]).otherwise(s["config"]).alias("config"), F.when(go, x["error_code"]).otherwise(s["last"]).alias("last"), F.when(go, F.concat(s["made"], F.array(F.struct(x["config_index"], x["attempt"], x["ok"], x["error_code"])))).otherwise(s["made"]).alias("made"))

    made = ordered.select("request_id", F.explode(F.aggregate("xs", empty, step)["made"]).alias("m"))
    return made.select("request_id", "m.config_index", "m.attempt", "m.ok", "m.error_code")


def backoff_seconds(attempt: Column, base: float = 0.5, most: float = 8.0) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
