"""Pending orders over a stream: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "account {kind}, order_id long, status string, placed timestamp, at timestamp"
#: At one instant what resolves orders comes before what places them.
RANK = {"fill": 0, "cancel": 1, "place": 2}


class PendingOrders(StatefulProcessor):
    """Open orders of an account by id, with the time they were placed and until when they live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "order_id long", "placed long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(rank=pdf["action"].map(RANK)).sort_values(["time", "rank", "order_id"])
        held = {k[0]: tuple(v) for k, v in self.open.iterator()}
        out, before = [], set(held)
        for t, action, order in zip(pdf["time"].astype("datetime64[us]").astype("int64"), pdf["action"], pdf["order_id"]):
            t = int(t)
            if action == "place":
                if pd.notna(order) and int(order) not in held:
                    held[int(order)] = (t, t + self.ttl_ms * 1000)
                continue
            for o in sorted(held) if pd.isna(order) else [int(order)] if int(order) in held else []:
                placed, until = held.pop(o)
                out.append((o, action if t <= until else "expired", placed, min(t, until)))
        for o in before - set(held):
            self.open.removeKey((o,))
        for o in held:
            if o not in before:
                self.open.updateValue((o,), held[o])
                self.handle.registerTimer(held[o][1] // 1000)
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(k[0], *v) for k, v in self.open.iterator() if v[1] // 1000 <= due]
        for o, _, _ in gone:
            self.open.removeKey((o,))
        yield self.rows(key, [(o, "expired", placed, until) for o, placed, until in sorted(gone)])

    def rows(self, key, out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["order_id", "status", "placed", "at"])
        pdf = pdf.assign(**{c: pd.to_datetime(pdf[c], unit="us", utc=True) for c in ("placed", "at")}, account=key[0] if len(pdf) else None)
        return pdf[["account", "order_id", "status", "placed", "at"]]

    def close(self) -> None:
        pass


def resolved_orders(events: DataFrame, account: str, order: str, action: str, time: str, ttl_ms: int, delay: str) -> DataFrame:
    """A row an order once it is filled, cancelled or expired: (account, order_id, status, placed, at).

    action: place, fill or cancel; a fill or cancel without an order meets all open orders of the account. An order lives until
    `ttl_ms` after it was placed: what comes later finds it expired, and a timer expires it when the watermark (`delay` behind the
    latest event) gets there. Rows of a micro-batch are applied in the order of their times; an order id that is open is
    not placed again; rows later than the watermark are left out by Spark. State is an account's open orders, each removed when
    it ends. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    kind = events.schema[account].dataType.simpleString()
    rows = events.select(F.col(account).alias("account"), F.col(order).cast("long").alias("order_id"), F.col(action).alias("action"), F.col(time).cast("timestamp").alias("time")).filter(F.col("action").isin(*RANK))
    return rows.withWatermark("time", delay).groupBy("account").transformWithStateInPandas(statefulProcessor=PendingOrders(ttl_ms), outputStructType=OUT.format(kind=kind), outputMode="append", timeMode="eventtime")
