"""A ledger of requests to a remote model: what was answered stays answered, whatever is lost.

The ledger is a folder of Parquet rows (key, response, error), one for each time that a request was
asked. A task's file appears whole once it is done, so the loss of a task, or of the driver, costs the
requests of the tasks that ran; a new call with the same folder asks only those without an answer.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialise, ship
from .providers import BATCH, label_pairs

ROWS = "key string, response string, error string"
#: Requests of a task, about: what is asked again if it is lost.
TASK_ROWS = 1000

#: Answers, each with a response or an error, to requests in JSON; keys name a request towards the service.
Ask = Callable[[Sequence[str], Sequence[str]], Sequence[dict]]


def request_key(model: str, request: Column) -> Column:
    """The same for the same request to the same model, in any run."""
    return F.sha2(F.concat_ws("\n", F.lit(model), request), 256)


def asked(spark: SparkSession, path: str) -> DataFrame:
    """(key, response, error, n_failed): one row for each key of a ledger.

    The response is the least one if a request was answered more than once, and then there is no
    error; of failures the last in the alphabet is kept.
    """
    rows = spark.read.schema(ROWS).parquet(path).groupBy("key")
    out = rows.agg(F.min("response").alias("response"), F.max("error").alias("error"), F.count_if(F.col("response").isNull()).alias("n_failed"))
    return out.withColumn("error", F.when(F.col("response").isNull(), F.coalesce("error", F.lit("no response"))))


def paced(ask: Ask, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Ask:
    """ask, with calls that begin at least so many seconds apart for each request of the one before."""
    free = [float("-inf")]

    def run(keys: Sequence[str], requests: Sequence[str]) -> Sequence[dict]:
        wait = free[0] - clock()
        if wait > 0:
            sleep(wait)
        free[0] = clock() + seconds * len(requests)
        return ask(keys, requests)

    return run


def _answered(ask: Ask, keys: list[str], requests: list[str]) -> list[tuple[str | None, str | None]]:
    """(response, error) of each request; a call that fails, or gives another number of answers, fails for all of its requests."""
    try:
        found = list(ask(keys, requests))
        if len(found) != len(keys):
            raise ValueError(f"{len(found)} answers for {len(keys)} requests")
    except Exception as e:
        return [(None, f"{type(e).__name__}: {e}")] * len(keys)
    text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
    return [(None, str(a["error"])) if a.get("error") else (text(a.get("response")), None) for a in found]


def ask_all(requests: DataFrame, load: Callable[[], Ask], path: str, *, attempts: int = 3, parallel: int = 8, per_second: float | None = None, batch: int = BATCH) -> DataFrame:
    """Answers (key, response, error, n_failed) to requests (key, request), each key asked once unless it fails.

    load gives, once in a task, a function from keys and requests to answers; the service may use
    the keys to know a repeated request. Requests that the ledger at path has an answer to aren't
    asked; those that failed are, up to `attempts` times in all runs. At most `parallel` tasks run
    at once, each at its share of `per_second` requests; a task that Spark starts again, or twice,
    comes on top. Null requests are not asked and have no row. Repeated rows are one request. Empty
    input: nothing is asked and the result is empty.
    """
    spark = requests.sparkSession
    ship(spark)
    own = requests.select("key", "request").filter("key is not null and request is not null")
    own = materialise(own.groupBy("key").agg(F.min("request").alias("request")), "requests")
    spark.createDataFrame([], ROWS).write.mode("append").parquet(path)
    pause = parallel / per_second if per_second else 0.0

    def run(frames: Iterator) -> Iterator:
        ask = paced(load(), pause)
        for f in frames:
            keys, texts, out = f.key.tolist(), f.request.tolist(), []
            for i in range(0, len(keys), batch):
                out += _answered(ask, keys[i : i + batch], texts[i : i + batch])
            yield f[["key"]].assign(response=[r for r, _ in out], error=[e for _, e in out])

    for _ in range(attempts):
        over = asked(spark, path).filter((F.col("response").isNotNull()) | (F.col("n_failed") >= attempts)).select("key")
        left = materialise(own.join(over, "key", "left_anti"), "unanswered")
        n = left.count()
        if not n:
            break
        rounds = -(-n // (TASK_ROWS * parallel))
        for k in range(rounds):
            now = left.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).repartition(parallel, F.xxhash64("key", F.lit(k)))
            # a task's file is moved to its place when the task ends, not when all have
            now.mapInPandas(run, ROWS).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(path)
    return own.select("key").join(asked(spark, path), "key")


def label_with_ledger(pairs: DataFrame, prompt: Column, load: Callable[[], Ask], method: str, path: str, **asking) -> DataFrame:
    """Predictions of a labelling model for pairs (pair_id, src_id, tgt_id, ...), asked through a ledger.

    prompt: a column of pairs. Pairs with the same prompt share one request. A failed answer, or a
    null prompt, relates nothing. The other parameters are those of ask_all.
    """
    text = F.when(prompt.isNotNull(), F.to_json(X.request(prompt)))
    own = pairs.select("pair_id", text.alias("request")).withColumn("key", F.when(F.col("request").isNotNull(), request_key(method, F.col("request"))))
    found = ask_all(own, load, path, **asking)
    return label_pairs(pairs, own.join(found, "key").select("pair_id", "response", "error"), method)
