"""Models behind the embedding and labelling methods, local or remote."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X

BATCH = 16
# fixed values: states in which a remote job has ended
ENDED = ("JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED")


class Embedder(Protocol):
    """Gives a vector for each text, in order."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def hashing_embedder(dims: int = 64) -> Embedder:
    """Signed counts of hashed words: deterministic and offline, for tests."""
    import zlib

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out

    return embed


def embed(df: DataFrame, load: Callable[[], Embedder], id_col: str = "id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """(id, vector): normalised vectors from a model that each worker loads once; `batch` texts a call."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(frames: Iterator) -> Iterator:
        model = load()
        for f in frames:
            texts = f.text.tolist()
            vectors: list = []
            for i in range(0, len(texts), batch):
                part = model(texts[i : i + batch])
                if len(part) != len(texts[i : i + batch]):
                    raise ValueError(f"{len(part)} vectors for {len(texts[i : i + batch])} texts")
                vectors += [[float(x) for x in v] for v in part]
            yield f[["id"]].assign(vector=vectors)

    raw = src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, vector array<double>")
    return raw.select("id", X.l2_normalised(F.col("vector")).alias("vector"))


def retried(call: Callable[[Any], Any], attempts: int = 3, seconds: float = 10, sleep: Callable[[float], None] = time.sleep) -> Callable[[Any], Any]:
    """call, tried several times with a pause between; the last error is raised."""

    def run(x: Any) -> Any:
        for k in range(attempts):
            try:
                return call(x)
            except Exception:
                if k + 1 == attempts:
                    raise
                sleep(seconds)

    return run


def one_by_one(call: Callable[[str], Sequence[Sequence[float]]], attempts: int = 3, seconds: float = 10, sleep: Callable[[float], None] = time.sleep, progress: Callable[[int], None] | None = None) -> Embedder:
    """An embedder from a service that takes one text a call and must give one vector."""

    def single(text: str) -> Sequence[float]:
        found = call(text)
        if len(found) != 1:
            raise ValueError(f"{len(found)} vectors for one text")
        return found[0]

    ask = retried(single, attempts, seconds, sleep)

    def embed_all(texts: Sequence[str]) -> list[Sequence[float]]:
        out = []
        for i, t in enumerate(texts, 1):
            out.append(ask(t))
            if progress and i % 25 == 0:
                progress(i)
        return out

    return embed_all


def embedder_for(mode: str, sync: Callable[[], Embedder], batch: Callable[[], Embedder]) -> Callable[[], Embedder]:
    """The loader that a mode names: batch, or sync and direct."""
    if mode == "batch":
        return batch
    if mode in ("sync", "direct"):
        return sync
    raise ValueError(f"unknown mode {mode!r}: batch, sync or direct")


def state_name(state: Any) -> str:
    return getattr(state, "name", None) or str(state)


def wait_for_job(fetch: Callable[[], Any], *, poll_seconds: float = 30, max_wait_seconds: float = 86_400, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Polls a job on the driver until it has ended; an error unless it succeeded in time."""
    began = clock()
    while True:
        job = fetch()
        state = state_name(job.state)
        if state in ENDED:
            if state != ENDED[0]:
                raise RuntimeError(f"job ended as {state}: {getattr(job, 'error', None)}")
            return job
        if clock() - began >= max_wait_seconds:
            raise TimeoutError(f"job still {state} after {max_wait_seconds} s")
        sleep(poll_seconds)


def unwrap(responses: Sequence[Any] | None, expected: int) -> list[Any]:
    """A job's answers in order; an error where their number is not that of the requests."""
    if responses is None:
        raise ValueError("the job has no inline answers")
    if len(responses) != expected:
        raise ValueError(f"{len(responses)} answers for {expected} requests")
    return list(responses)


def embeddings_of(responses: Sequence[dict], expected: int) -> list[list[float]]:
    """Vectors of a batch job's answers; any error fails them all."""
    out = []
    for r in unwrap(responses, expected):
        if r.get("error"):
            raise RuntimeError(f"embedding failed: {r['error']}")
        e = r.get("embedding") or (r.get("embeddings") or [None])[0]
        if e is None:
            raise ValueError("an answer without a vector")
        out.append(list(e["values"] if isinstance(e, dict) else e))
    return out


def label_pairs(pairs: DataFrame, answers: DataFrame, method: str) -> DataFrame:
    """Predictions from stored answers (pair_id, response, error) to pairs (pair_id, src_id, tgt_id, ...).

    Answers are matched by pair_id, never by order. A failed or missing answer relates nothing.
    """
    got = answers.select("pair_id", F.when(F.col("error").isNull(), X.parse_label(X.response_text(F.col("response")))).alias("label"))
    out = pairs.join(got, "pair_id", "left")
    return out.select(F.lit(method).alias("method"), "src_id", "tgt_id", F.lit(None).cast("double").alias("score"), F.coalesce("label", F.lit(S.NO_RELATION)).alias("predicted_rel"))


def batch_embedder(submit: Callable[[list[dict]], Any], fetch: Callable[[Any], Any], **waiting: Any) -> Embedder:
    """An embedder from a service that takes all texts of a call as one job: submitted, waited for, decoded in order."""

    def embed_all(texts: Sequence[str]) -> list[list[float]]:
        if not len(texts):
            return []
        job = submit([{"content": t} for t in texts])
        return embeddings_of(wait_for_job(lambda: fetch(job), **waiting).responses, len(texts))

    return embed_all


def batch_labeller(submit: Callable[[list[dict]], Any], fetch: Callable[[Any], Any], **waiting: Any) -> Callable[[Sequence[str]], list[dict]]:
    """Answers of a service to requests in JSON, all of a call as one job; each answer has a response or an error."""
    import json

    def ask(requests: Sequence[str]) -> list[dict]:
        if not len(requests):
            return []
        job = submit([json.loads(r) for r in requests])
        return unwrap(wait_for_job(lambda: fetch(job), **waiting).responses, len(requests))

    return ask


def label_all(pairs: DataFrame, prompt: Any, load: Callable[[], Callable[[Sequence[str]], list[dict]]], method: str) -> DataFrame:
    """Predictions of a labelling model for pairs (pair_id, src_id, tgt_id, ...): a request for each, answers joined by pair_id.

    prompt: a column of pairs. load gives, once in each task, a function from requests to answers,
    as batch_labeller makes; a task's Arrow batch is one call of it.
    """
    asked = pairs.select("pair_id", F.to_json(X.request(prompt)).alias("request"))

    def run(frames: Iterator) -> Iterator:
        import json

        ask = load()
        for f in frames:
            answers = ask(f.request.tolist())
            texts = [None if a.get("response") is None else json.dumps(a["response"]) for a in answers]
            errors = [None if a.get("error") is None else str(a["error"]) for a in answers]
            yield f[["pair_id"]].assign(response=texts, error=errors)

    answers = asked.mapInPandas(run, f"pair_id {asked.schema['pair_id'].dataType.simpleString()}, response string, error string")
    return label_pairs(pairs, answers, method)
