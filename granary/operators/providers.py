"""Extension points: embedding and chat providers as Arrow batches, registered tools, a harness of cases."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.structured import calculate
from granary.functions.text import without_space

#: Texts to vectors, in order and one each.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: Messages to an answer.
Chat = Callable[[str], str]


def embedded(texts: DataFrame, make: Callable[[], Embedder], dimensions: int, text: str = "text", batch: int = 64) -> DataFrame:
    """texts with vector. make runs once a task, where it may load a model or open a client; a wrong count or length is an error."""

    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for series in batches:
            out = []
            for i in range(0, len(series), batch):
                some = series.iloc[i : i + batch].tolist()
                made = [list(map(float, v)) for v in embed(some)]
                if len(made) != len(some) or any(len(v) != dimensions for v in made):
                    raise ValueError("the embedder gave other vectors than asked for")
                out += made
            yield pd.Series(out)

    return texts.withColumn("vector", F.pandas_udf(f, "array<double>", F.PandasUDFType.SCALAR_ITER)(text))


def answered(prompts: DataFrame, make: Callable[[], Chat], prompt: str = "prompt") -> DataFrame:
    """prompts with answer and error: one call each; an exception is that row's error."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make()
        for rows in batches:
            out = []
            for p in rows[prompt]:
                try:
                    out.append((chat(p), None))
                except Exception as e:  # noqa: BLE001  a provider's failure is a result
                    out.append((None, type(e).__name__))
            yield rows.assign(answer=[a for a, _ in out], error=[e for _, e in out])

    schema = ", ".join(f"{n} {t}" for n, t in prompts.dtypes)
    return prompts.mapInPandas(f, f"{schema}, answer string, error string")


#: Tools by name: a column of one argument each.
TOOLS: dict[str, Callable[[Column], Column]] = {"calculator": lambda c: calculate(c).cast("string"), "normalize": without_space, "length": lambda c: F.length(c).cast("string")}


def called(name: Column, argument: Column) -> Column:
    """The result of the named tool; null for a name that there isn't."""
    out = F.lit(None).cast("string")
    for tool, of in TOOLS.items():
        out = F.when(name == tool, of(argument)).otherwise(out)
    return out


def harness(cases: DataFrame, make: Callable[[], Chat], check: Column) -> DataFrame:
    """A record for each case: answer, error, ok. cases: case_id, prompt; check reads answer."""
    done = answered(cases, make)
    return done.withColumn("ok", F.col("error").isNull() & F.coalesce(check, F.lit(False)))


def mock_retrieve(spark: SparkSession, documents: Sequence[tuple[str, str]], words: Sequence[str]) -> DataFrame:
    """Documents by how many of the words they hold; if none holds any, the first. A stand-in for a retriever."""
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(documents)], "place int, doc_id string, text string")
    hits = df.withColumn("hits", sum((F.contains("text", F.lit(w)).cast("int") for w in words), F.lit(0)))
    some = hits.where("hits > 0")
    return (some if some.take(1) else hits.where("place = 0")).orderBy(F.desc("hits"), "place").select("doc_id", "hits")
