"""Voyages over a stream of snapshots: an extension, the same state machine kept per vessel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Breaks
from ..operators.voyages import Vessel

OUT = "seq long, ship_id long, timestamp long, local_no int, opens boolean"
STATE = "voyage int, at struct<t:long,lat:double,lon:double,speed:int,dest:string>, idle struct<t:long,lat:double,lon:double,speed:int,dest:string>, anchor_lat double, anchor_lon double, stopped boolean, still_sec long"


def _load(state: GroupState, rules: Breaks) -> Vessel:
    vessel = Vessel(rules=rules)
    if state.exists:
        voyage, at, idle, lat, lon, stopped, still = state.get
        vessel.voyage, vessel.at, vessel.idle_at = voyage, tuple(at), tuple(idle) if idle is not None else None
        vessel.anchor, vessel.stopped, vessel.still_sec = (lat, lon), stopped, still
    return vessel


def stream_voyages(positions: DataFrame, rules: Breaks = Breaks()) -> DataFrame:
    """Each fix with its vessel's running voyage number, -1 at rest.

    Within a batch a vessel's fixes are taken in order of arrival; across
    batches state is a fixed-size row per vessel. Nothing is closed by a
    timeout, so results equal the batch operator's on the same rows.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("seq")
        vessel = _load(state, rules)
        found = [vessel.take(tuple(fix)) for fix in zip(*(frame[c].tolist() for c in ("timestamp", "lat", "lon", "speed", "destination")), strict=True)]
        state.update((vessel.voyage, vessel.at, vessel.idle_at, *vessel.anchor, vessel.stopped, vessel.still_sec))
        yield pd.DataFrame({"seq": frame["seq"], "ship_id": key[0], "timestamp": frame["timestamp"], "local_no": [n for n, _ in found], "opens": [o for _, o in found]})

    return positions.groupBy("ship_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def read_snapshots(spark: SparkSession, path: str, schema, files_per_batch: int = 50) -> DataFrame:
    """Position files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
