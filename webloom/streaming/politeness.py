"""Crawl delay as a stateful stream: a host is fetched again only after its delay has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.functions.robots import DEFAULT_DELAY_MS


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    requests = pd.concat(list(batches)).sort_values(["at_ms", "url"])
    last = state.get[0] if state.exists else None
    due = []
    for at, delay in zip(requests["at_ms"], requests["delay_ms"]):
        due.append(last is None or at - last > delay)
        if due[-1]:
            last = int(at)
    state.update((last,))
    yield requests[["url", "at_ms"]].assign(host=key[0], due=due)[["host", "url", "at_ms", "due"]]


def delay_gate(requests: DataFrame) -> DataFrame:
    """(host, url, at_ms, due) of a stream of requests (host, url, at_ms, delay_ms).

    A request is due if its host was never fetched or longer ago than its delay (null: the default); the others are to
    be queued again. The state is one number per host. Requests of one host and micro-batch are decided in order of
    time, so bound a micro-batch (``maxFilesPerTrigger``) where one host may send very many. Null hosts are dropped.
    """
    known = requests.where("host IS NOT NULL").select("host", "url", F.coalesce("at_ms", F.lit(0)).cast("long").alias("at_ms"), F.coalesce("delay_ms", F.lit(DEFAULT_DELAY_MS)).alias("delay_ms"))
    return known.groupBy("host").applyInPandasWithState(_decide, "host string, url string, at_ms long, due boolean", "last long", "append", GroupStateTimeout.NoTimeout)
