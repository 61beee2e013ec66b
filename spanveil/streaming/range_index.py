"""The covered ranges of changing pages, kept up to date from a feed of node changes.

A change is (page_id, node_id, op, text, seq), op being upsert or delete. Within a batch the highest seq of a node counts;
across batches a node's state keeps the highest seq seen, so late and repeated deliveries change nothing and any split of the
feed into batches ends in the same index. State is one row for each node, partitioned by page and node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanveil.operators.engine import Engine

CHANGE = "page_id long, node_id long, op string, text string, seq long"
ENTRY = "page_id long, node_id long, seq long, live boolean, start int, end int, rule_id string"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each node; partial aggregates meet, so a busy node is no hot task."""
    last = F.max_by(F.struct("op", "text"), F.col("seq"))
    return changes.groupBy("page_id", "node_id").agg(last.alias("c"), F.max("seq").alias("seq")).select("page_id", "node_id", "c.op", "c.text", "seq")


def index(changes: DataFrame, engine: Engine) -> DataFrame:
    """The index of a whole feed at rest: (page_id, node_id, start, end, rule_id) of live nodes."""
    live = latest(changes).where("op = 'upsert' AND text IS NOT NULL")
    parts = live.select("page_id", "node_id", F.explode(engine.segment_column(F.col("text"))).alias("s")).where("s.covered")
    return parts.select("page_id", "node_id", "s.start", "s.end", F.explode("s.rule_ids").alias("rule_id"))


def stream(changes: DataFrame, engine: Engine) -> DataFrame:
    """For each trigger, the new entries of the nodes that changed; ``live`` false with null ranges for a node without any.

    A reader keeps the rows of each node's highest seq.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else -1
        best = None
        for pdf in batches:
            top = pdf.loc[pdf["seq"].idxmax()]
            if top["seq"] > seen and (best is None or top["seq"] > best["seq"]):
                best = top
        if best is None:
            return
        state.update((int(best["seq"]),))
        rows = []
        if best["op"] == "upsert" and isinstance(best["text"], str):
            rows = [(*key, int(best["seq"]), True, s["start"], s["end"], r) for s in engine.segment(best["text"]) if s["covered"] for r in s["rule_ids"]]
        rows = rows or [(*key, int(best["seq"]), False, None, None, None)]
        out = pd.DataFrame(rows, columns=["page_id", "node_id", "seq", "live", "start", "end", "rule_id"])
        yield out.astype({"start": "Int32", "end": "Int32"})

    grouped = changes.groupBy("page_id", "node_id")
    return grouped.applyInPandasWithState(update, ENTRY, "seq long", "append", GroupStateTimeout.NoTimeout)


def current(entries: DataFrame) -> DataFrame:
    """The index that a stream's entries amount to."""
    top = entries.groupBy("page_id", "node_id").agg(F.max("seq").alias("top"))
    rows = entries.join(top, ["page_id", "node_id"]).where("seq = top AND live")
    return rows.select("page_id", "node_id", "start", "end", "rule_id").distinct()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; on a stream, windows close when the watermark passes them."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counts = marked.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), kind, "n", "total")
