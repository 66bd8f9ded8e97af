"""The attempts ledger as a stream: totals by event time, and the newest state of each key with late and repeated events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def totals(events: DataFrame, at: str, window: str = "1 day", late: str = "45 days", keys: tuple[str, ...] = ("book_id", "page_number", "attempt")) -> DataFrame:
    """Requests, lost requests and tokens per window of event time. Events that arrive twice count once; those later than `late` are dropped."""
    once = events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
    return (
        once.groupBy(F.window(at, window).alias("w"))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("returned") == 0).alias("lost"), F.sum("total_tokens").alias("tokens"))
        .select(F.col("w.start").alias("start"), "requests", "lost", "tokens")
    )


def newest_state(events: DataFrame) -> DataFrame:
    """(book_id, page_number, attempt, requests, tokens) of every page, written anew whenever something arrives: the highest attempt so
    far, how many different attempts were seen and the known tokens. Arrival order and repeats don't matter; a key's state is
    its set of attempts, which is small."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        for pdf in batches:
            for attempt, tokens in zip(pdf["attempt"], pdf["total_tokens"], strict=True):
                seen[int(attempt)] = -1 if pd.isna(tokens) else int(tokens)
        state.update((list(seen), list(seen.values())))
        known = [t for t in seen.values() if t >= 0]
        yield pd.DataFrame([(*key, max(seen), len(seen), sum(known) if known else None)], columns=["book_id", "page_number", "attempt", "requests", "tokens"])

    return events.groupBy("book_id", "page_number").applyInPandasWithState(
        update, "book_id string, page_number long, attempt long, requests long, tokens double", "attempts array<long>, tokens array<long>", "update", GroupStateTimeout.NoTimeout
    )
