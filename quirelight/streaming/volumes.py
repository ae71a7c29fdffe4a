"""Volumes as they arrive: each micro-batch holds complete volumes and is reconstructed as a batch.

A page can't be settled before its volume is complete (gutters, heads, thresholds and pagination are statistics of the
whole), so the stream is one of volumes: pages are held in state until the page that says how many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.reflow import Reflow

PAGES = "volume_id string, pos int, total int, lines array<string>"


def complete_volumes(pages: DataFrame) -> DataFrame:
    """(volume_id, pos, lines) of volumes whose last page has come; pages are a stream of PAGES, in any order."""

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        total = 0
        for pdf in batches:
            for pos, n, lines in zip(pdf["pos"], pdf["total"], pdf["lines"]):
                held[int(pos)] = list(lines)
                total = max(total, int(n))
        if total and len(held) >= total:
            state.remove()
            yield pd.DataFrame([(key[0], p, held[p]) for p in sorted(held)], columns=["volume_id", "pos", "lines"])
        else:
            state.update((list(held), list(held.values())))

    out, kept = "volume_id string, pos int, lines array<string>", "pos array<int>, lines array<array<string>>"
    return pages.groupBy("volume_id").applyInPandasWithState(hold, out, kept, "append", GroupStateTimeout.NoTimeout)


def start(pages: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Reconstruct volumes as they complete; write gets (volume_id, kind, content) and the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        volumes = Reflow(batch)
        rows = volumes.text().withColumn("kind", F.lit("txt")).unionByName(volumes.markdown().withColumn("kind", F.lit("md")))
        write(rows.select("volume_id", "kind", "content"), number)

    return complete_volumes(pages).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
