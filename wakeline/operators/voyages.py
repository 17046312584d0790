"""Voyages of vessels: a state machine over fixes in their order of arrival."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import asin, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Breaks
from ..functions.geo import EARTH_RADIUS_M
from ..plans import materialize, running_total

#: The id of fixes at rest, and of the first voyage.
IDLE, FIRST = -1, 1


def metres(lat_a: float, lon_a: float, lat_b: float, lon_b: float) -> float:
    a, b = radians(lat_a), radians(lat_b)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_RADIUS_M * asin(min(1.0, sqrt(h)))


@dataclass
class Vessel:
    """What is carried from one fix of a vessel to the next; of fixed size, whatever the history."""

    voyage: int = -1
    at: tuple | None = None
    idle_at: tuple | None = None
    anchor: tuple[float, float] | None = None
    stopped: bool = False
    still_sec: int = 0
    rules: Breaks = field(default_factory=Breaks)

    def to_list(self) -> list:
        """All that is carried, as JSON can hold it; numbers come back as they were."""
        return [self.voyage, self.at, self.idle_at, self.anchor, self.stopped, self.still_sec]

    @classmethod
    def of_list(cls, held: list, rules: Breaks) -> Vessel:
        voyage, at, idle_at, anchor, stopped, still_sec = held
        whole = lambda x: None if x is None else tuple(x)
        return cls(voyage, whole(at), whole(idle_at), whole(anchor), stopped, still_sec, rules)

    def _begin(self, fix: tuple) -> tuple[int, bool]:
        self.voyage += 1
        self.idle_at = None
        self.anchor, self.stopped, self.still_sec = fix[1:3], fix[3] < self.rules.moving, 0
        return self.voyage, True

    def _breaks(self, fix: tuple, dt: int) -> bool:
        far = metres(*self.at[1:3], *fix[1:3])
        if far > self.rules.leap or any(dt > seconds and far > least for seconds, least in self.rules.silence):
            return True
        seconds, least = self.rules.turn
        return fix[4] != self.at[4] and (self.stopped or dt > seconds or far > least)

    def _rest(self, fix: tuple, dt: int) -> None:
        if fix[3] >= self.rules.moving:
            self.stopped, self.still_sec = False, 0
            return
        if not self.stopped:
            self.stopped, self.anchor, self.still_sec = True, fix[1:3], 0
        if metres(*self.anchor, *fix[1:3]) <= self.rules.rest[0]:
            self.still_sec += dt
        else:
            self.anchor, self.still_sec = fix[1:3], 0

    def take(self, fix: tuple) -> tuple[int, bool]:
        """The voyage of a fix (time, lat, lon, speed, destination), -1 at rest, and whether it opens there."""
        if self.at is None:
            out = self._begin(fix)
        else:
            dt = max(0, fix[0] - self.at[0])
            # the rule on destinations sees the rest before this fix
            breaks = self._breaks(fix, dt)
            self._rest(fix, dt)
            if self.idle_at is not None:
                signs = (fix[3] >= self.rules.moving) + (metres(*self.idle_at[1:3], *fix[1:3]) > self.rules.rest[0]) + (fix[4] != self.idle_at[4])
                out = self._begin(fix) if signs >= 2 else (-1, False)
            elif breaks:
                out = self._begin(fix)
            elif self.stopped and self.still_sec >= self.rules.rest[1]:
                self.idle_at = fix
                self.anchor, self.still_sec = fix[1:3], 0
                out = -1, False
            else:
                out = self.voyage, False
        self.at = fix
        return out


#: A row per fix (``first_seq`` and ``carried`` are null); one per voyage that ended or is still open at the vessel's last fix, ``fresh`` if it began among these fixes; and, where vessels are carried on, one per vessel with what the next fixes need.
WALKED = "seq long, ship_id long, local_no int, first_seq long, start_timestamp int, end_timestamp int, start_lat float, start_lon float, end_lat float, end_lon float, points_count int, open int, closing long, fresh int, carried string"
#: What is carried of each vessel: its open voyage's own number and id (-1: none), and the state machine with that voyage so far as JSON.
CARRIED = "ship_id long, local_no int, track_id long, carried string"
FIX = ("timestamp", "lat", "lon", "speed", "destination")


def _walk(rules: Breaks, carry: bool = False):
    """Fixes with the number of their voyage, and voyages as they end: where they began, the last fix and the vessel's next, which closes them.

    A row with ``carried`` comes before its vessel's fixes and sets out from there.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ship, state, ship_first, now, fresh, ended, held = None, None, None, None, 1, [], []

        def end(closing: int | None) -> None:
            nonlocal now
            if now is not None:
                number, seq, first, last, points = now
                ended.append((ship, number, seq, first[0], last[0], *first[1:3], *last[1:3], points, int(closing is None), ship_first if closing is None else closing, fresh))
            now = None

        def leave() -> None:
            """The vessel has no more fixes."""
            if carry and state is not None:
                held.append((ship, -1 if now is None else now[0], json.dumps([state.to_list(), ship_first, now])))
            end(None)

        for frame in frames:
            numbers, rows = [], []
            before = frame["carried"].tolist() if "carried" in frame else [None] * len(frame)
            for carried, seq, ship_id, *fix in zip(before, *(frame[c].tolist() for c in ("seq", "ship_id", *FIX)), strict=True):
                if ship_id != ship:
                    leave()
                    ship, state, ship_first, fresh = ship_id, None, None, 1
                if isinstance(carried, str):
                    kept, ship_first, now = json.loads(carried)
                    state, fresh = Vessel.of_list(kept, rules), 0
                    continue
                if state is None:
                    state, ship_first = Vessel(rules=rules), seq
                number, opened = state.take(tuple(fix))
                rows.append((seq, ship_id))
                numbers.append(number)
                if opened or number < 0:
                    end(seq)
                if opened:
                    now, fresh = [number, seq, fix, fix, 1], 1
                elif number >= 0:
                    now[3:] = fix, now[4] + 1
            yield from _frames(rows, numbers, ended, held)
            ended.clear()
            held.clear()
        leave()
        yield from _frames([], [], ended, held)

    return run


def _frames(rows: list[tuple], numbers: list[int], ended: list[tuple], held: list[tuple]) -> Iterator[pd.DataFrame]:
    """A frame of each kind of row, as a column of whole numbers with gaps would turn to floats and lose digits."""
    names = [x.split()[0] for x in WALKED.split(", ")]
    kinds = ([(*row, number) for row, number in zip(rows, numbers, strict=True)], names[:3]), (ended, names[1:-1]), (held, ["ship_id", "local_no", "carried"])
    for found, columns in kinds:
        if found:
            yield pd.DataFrame(found, columns=columns).reindex(columns=names).astype({n: object for n in names if n not in columns}).replace({float("nan"): None})


def _fixes(positions: DataFrame) -> DataFrame:
    return positions.select("seq", "ship_id", F.col("timestamp").cast("long"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("speed").cast("int"), "destination")


TRACK_COLUMNS = ("track_id", "ship_id", "start_timestamp", "end_timestamp", "start_lat", "start_lon", "end_lat", "end_lon", "points_count", "track_ord")


def detect(positions: DataFrame, rules: Breaks = Breaks()) -> tuple[DataFrame, DataFrame]:
    """Positions (seq, ship_id, track_id) and voyages of at least two fixes.

    Fixes are hashed by vessel and sorted by arrival; a task walks through its
    vessels row by row and holds one vessel's state only, so long histories
    stream. Voyages are numbered from ``FIRST`` by the arrival of
    their first fix, over a table with a row per voyage, which the walk gives;
    their table is ordered by when they closed.
    """
    walked = _fixes(positions).repartition("ship_id").sortWithinPartitions("ship_id", "seq").mapInPandas(_walk(rules), WALKED)
    walked = materialize(walked, "walked")
    ended = walked.where("first_seq is not null").drop("seq").withColumn("one", F.lit(1).cast("long"))
    ids = running_total(ended, ["first_seq", "ship_id"], "one", "track_id").withColumn("track_id", F.col("track_id") + FIRST)
    fixes = walked.where("first_seq is null").select("seq", "ship_id", "local_no")
    numbered = fixes.join(ids.select("ship_id", "local_no", "track_id"), ["ship_id", "local_no"], "left")
    placed = numbered.select("seq", "ship_id", F.coalesce("track_id", F.lit(IDLE)).cast("long").alias("track_id"))
    # a voyage closes with the vessel's next fix; open ones follow, by the vessel's first
    tracks = running_total(ids.where("points_count >= 2"), ["open", "closing", "track_id"], "one", "track_ord")
    return placed, tracks.select(*TRACK_COLUMNS)


@dataclass(frozen=True)
class Carried:
    """What is left when some fixes were taken: a row per vessel (``CARRIED``), and the next voyage's id and place in the table of voyages."""

    vessels: DataFrame
    next_id: int
    next_ord: int


def carry_on(positions: DataFrame, before: Carried | None = None, rules: Breaks = Breaks()) -> tuple[DataFrame, DataFrame, Carried]:
    """The voyages of new fixes, set out from what was carried: their positions (seq, ship_id, track_id), the voyages that these fixes closed, and what is carried on.

    Taking fixes in any number of portions, each arriving after the one before,
    gives the ids, positions and closed voyages of :func:`detect` over all of
    them at once; :func:`still_open` gives the rest. Fixes of earlier portions
    aren't read: each vessel is a row of fixed size, whatever its history.
    Vessels without new fixes pass through unwalked.
    """
    if before is not None:
        ships = positions.select("ship_id").distinct()
        mine = before.vessels.join(ships, "ship_id", "left_semi")
        # first of its vessel's rows; numbers that stand for nothing keep columns whole
        blank = mine.select(F.lit(-(1 << 63)).cast("long").alias("seq"), "ship_id", F.lit(0).cast("long").alias("timestamp"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(0).alias("speed"), F.lit("").alias("destination"), "carried")
        rows = _fixes(positions).withColumn("carried", F.lit(None).cast("string")).unionByName(blank)
    else:
        rows = _fixes(positions).withColumn("carried", F.lit(None).cast("string"))
    walked = rows.repartition("ship_id").sortWithinPartitions("ship_id", "seq").mapInPandas(_walk(rules, True), WALKED)
    walked = materialize(walked, "walked")
    first_id, first_ord = (FIRST, 0) if before is None else (before.next_id, before.next_ord)
    ended = walked.where("first_seq is not null").drop("seq").withColumn("one", F.lit(1).cast("long"))
    ids = running_total(ended.where("fresh = 1"), ["first_seq", "ship_id"], "one", "track_id").withColumn("track_id", F.col("track_id") + first_id)
    if before is not None:
        known = before.vessels.where("local_no >= 0").select("ship_id", "local_no", "track_id")
        ids = ids.unionByName(ended.where("fresh = 0").join(known, ["ship_id", "local_no"]))
    ids = materialize(ids, "ids")
    named = ids.select("ship_id", "local_no", "track_id")
    fixes = walked.where("first_seq is null and carried is null").select("seq", "ship_id", "local_no")
    placed = fixes.join(named, ["ship_id", "local_no"], "left").select("seq", "ship_id", F.coalesce("track_id", F.lit(IDLE)).cast("long").alias("track_id"))
    closed = running_total(ids.where("points_count >= 2 and open = 0"), ["closing", "track_id"], "one", "track_ord").withColumn("track_ord", F.col("track_ord") + first_ord)
    held = walked.where("carried is not null").select("ship_id", "local_no", "carried").join(named, ["ship_id", "local_no"], "left")
    held = held.select("ship_id", "local_no", F.coalesce("track_id", F.lit(-1)).cast("long").alias("track_id"), "carried")
    if before is not None:
        held = held.unionByName(before.vessels.join(ships, "ship_id", "left_anti"))
    counts = ids.agg(F.count_if(F.col("fresh") == 1).alias("ids"), F.count_if(F.expr("points_count >= 2 and open = 0")).alias("rows")).first()
    return placed, closed.select(*TRACK_COLUMNS), Carried(materialize(held, "carried"), first_id + counts.ids, first_ord + counts.rows)


def still_open(carried: Carried) -> DataFrame:
    """Voyages of at least two fixes that are open, in the order that :func:`detect` gives them after the closed ones."""
    fix = "array<string>"
    now = F.from_json(F.get_json_object("carried", "$[2]"), "array<string>")
    rows = carried.vessels.where("local_no >= 0").withColumns({"now": now, "closing": F.get_json_object("carried", "$[1]").cast("long")})
    rows = rows.withColumns({"first": F.from_json(F.col("now")[2], fix), "last": F.from_json(F.col("now")[3], fix), "points_count": F.col("now")[4].cast("int")}).where("points_count >= 2")
    ends = {f"{name}_{what}": F.col(of)[k].cast(kind) for name, of in (("start", "first"), ("end", "last")) for k, (what, kind) in enumerate((("timestamp", "int"), ("lat", "float"), ("lon", "float")))}
    rows = rows.select("ship_id", "track_id", "closing", "points_count", *(c.alias(n) for n, c in ends.items()), F.lit(1).cast("long").alias("one"))
    return running_total(rows, ["closing", "track_id"], "one", "track_ord").withColumn("track_ord", F.col("track_ord") + carried.next_ord).select(*TRACK_COLUMNS)
