"""The model-call boundary: a responder maps batches of requests to batches of responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gradeframe.schemas import RESPONSES, arrival, conform

Responder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

_responders: dict[str, Responder] = {}
_FIELDS = ["uuid", "parent_uuid", "generated_text", "loglikelihood", "target_length", "lm_loss",
           "token_logprobs"]


def register_responder(name: str, fn: Responder) -> None:
    _responders[name] = fn


def responder(name: str | Responder) -> Responder:
    if callable(name):
        return name
    if name not in _responders:
        raise ValueError(f"unknown responder {name!r}")
    return _responders[name]


def pending(requests: DataFrame, stored: DataFrame, run_key: str | None = None) -> DataFrame:
    """Requests that have no stored response in their run."""
    if run_key is not None:
        done = stored.where(F.col("run_key") == run_key).select("uuid")
        return requests.join(done, "uuid", "left_anti")
    return requests.join(stored.select("run_key", "uuid"), ["run_key", "uuid"], "left_anti")


def _adapt(fn: Responder) -> Responder:
    """Let a responder return only the fields its mode has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in fn(batches):
            yield out.reindex(columns=_FIELDS).astype(object).where(lambda d: d.notna(), None)

    return run


def infer(
    requests: DataFrame,
    fn: str | Responder,
    run_key: str,
    stored: DataFrame | None = None,
    partitions: int | None = None,
    force: bool = False,
) -> DataFrame:
    """Responses of a run: stored ones for the given requests, fresh ones for the rest.

    ``partitions`` spreads the calls evenly over that many tasks; ``force`` ignores the store.
    """
    reuse = stored is not None and not force
    todo = pending(requests, stored, run_key) if reuse else requests
    if partitions:
        todo = todo.repartition(partitions)
    schema = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in RESPONSES if f.name in _FIELDS)
    fresh = conform(
        todo.mapInPandas(_adapt(responder(fn)), schema)
        .withColumn("arrival", arrival(F.monotonically_increasing_id()))
        .withColumn("run_key", F.lit(run_key)),
        RESPONSES,
    )
    if not reuse:
        return fresh
    kept = stored.where(F.col("run_key") == run_key).join(
        requests.select("uuid"), "uuid", "left_semi"
    )
    return conform(kept, RESPONSES).unionByName(fresh)
