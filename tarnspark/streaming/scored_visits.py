"""Visits with scores from a stream of points: what the batch finds, sent when a visit closes.

The state of a track is one entry for each site it has been at (closings so far, the last time within reach and the measures of
the open visit) and the open visits' altitudes, in parts of ALTITUDES values, so a trigger touches only the last part. A point
without a site in its neighbourhood still counts: it may close a visit. A visit is sent when the first point beyond the exit comes
RESET_SECONDS after the last one within reach, or, at the end of a track, when event time has passed its last point by the idle
time; then the track's state goes. The confidence is made by the same expressions as the batch's from what the state held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scores
from ..functions.geo import coarse_box, haversine
from ..operators.cells import cell, cells_around

ALTITUDES = 1000
SITE_STATE = "cuts long, last_in double, opened boolean, mode string, elevation double, samples long, start_idx long, start_t double, end_t double, near_dist double, near_idx long, near_lat double, near_lng double, near_t double, parts int"
CLOSED = "track_id string, site_id string, visit long, mode string, elevation double, samples long, start_idx long, start_t double, end_t double, near_dist double, near_idx long, near_lat double, near_lng double, near_t double, alts array<double>"
#: What a site's entry starts with.
FRESH = {"cuts": 0, "last_in": None, "opened": False, "mode": None, "elevation": None, "samples": 0, "start_idx": None, "start_t": None, "end_t": None, "near_dist": None, "near_idx": None, "near_lat": None, "near_lng": None, "near_t": None, "parts": 0}


def near_rows(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Every point (track_id, idx, ts, t, lat, lng, alt, has_alt) with the sites around it, or once with none.

    points may be a stream; sites aren't. ``has_alt``: whether the track has altitudes at all. Sites beyond the farthest exit
    distance are left out: for these the point is out of reach.
    """
    radius = max(scores.EXIT.values())
    p = points.withColumn("t", F.coalesce("t", F.col("idx").cast("double"))).withColumn("_cell", cell(F.col("lat"), F.col("lng"), radius))
    s = sites.select("site_id", "elevation", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    s = s.withColumn("_at", F.explode(cells_around(F.col("s_lat"), F.col("s_lng"), radius)))
    metres = haversine("lat", "lng", "s_lat", "s_lng")
    rows = p.join(s, (F.col("_cell") == F.col("_at")) & (metres < radius), "left").drop("_cell", "_at")
    rows = rows.withColumn("mode", scores.mode(F.col("has_alt"), F.col("elevation").isNotNull())).withColumn("dist", metres)
    enter, leave = scores.by_mode(F.col("mode"), scores.ENTER), scores.by_mode(F.col("mode"), scores.EXIT)
    half_lat, half_lng = coarse_box(enter, F.col("s_lat"))
    box = (F.abs(F.col("s_lat") - F.col("lat")) <= half_lat) & (F.abs(F.col("s_lng") - F.col("lng")) <= half_lng)
    return rows.select("track_id", "ts", "idx", "t", "lat", "lng", "alt", "site_id", "mode", "elevation", "dist", (F.col("dist") <= enter).alias("inside"), box.alias("box"), (F.col("dist") >= leave).alias("far"))


class Visits(StatefulProcessor):
    """A track's visits. Points come in order of idx from trigger to trigger; those of one trigger are put in order."""

    def __init__(self, idle_seconds: float):
        self.idle = int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sites = handle.getMapState("sites", "site_id string", SITE_STATE)
        self.altitudes = handle.getMapState("altitudes", "site_id string, part int", "alts array<double>")
        self.seen = handle.getValueState("seen", "ms long")

    def _load(self) -> dict[str, dict]:
        return {key[0]: dict(zip(FRESH, value, strict=True)) for key, value in self.sites.iterator()}

    def _keep(self, site: str, alts: list[float], state: dict) -> None:
        """Add altitudes to the last part that has room, or to new ones."""
        while alts:
            last = list(self.altitudes.getValue((site, state["parts"] - 1))[0]) if state["parts"] else None
            if last is None or len(last) >= ALTITUDES:
                last, state["parts"] = [], state["parts"] + 1
            room = ALTITUDES - len(last)
            self.altitudes.updateValue((site, state["parts"] - 1), (last + alts[:room],))
            alts = alts[room:]

    def _close(self, track: str, site: str, state: dict, fresh: list[float]) -> tuple | None:
        """The open visit's row, if there is one; its altitudes go."""
        row = None
        kept = [a for part in range(state["parts"]) for a in self.altitudes.getValue((site, part))[0]]
        for part in range(state["parts"]):
            self.altitudes.removeKey((site, part))
        if state["opened"]:
            row = (track, site, state["cuts"], *(state[c] for c in list(FRESH)[3:-1]), kept + fresh)
        state.update({c: v for c, v in FRESH.items() if c not in ("cuts", "last_in")})
        return row

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (track,) = key
        states, fresh, closed, touched = self._load(), {}, [], set()
        batch = pd.concat(list(rows))
        newest = int(batch["ts"].max().value // 1_000_000)
        for idx, point in batch.sort_values(["idx", "site_id"]).groupby("idx"):
            t, lat, lng, alt = (point[c].iloc[0] for c in ("t", "lat", "lng", "alt"))
            near = {r.site_id: r for r in point.itertuples() if isinstance(r.site_id, str)}
            for site in near.keys() - states.keys():
                if near[site].inside:
                    states[site] = dict(FRESH)
            for site, s in states.items():
                r = near.get(site)
                if r is not None and r.inside:
                    touched.add(site)
                    s["last_in"] = float(t)
                    if not s["opened"] and r.box:
                        s.update(opened=True, mode=r.mode, elevation=None if pd.isna(r.elevation) else float(r.elevation), start_idx=int(idx), start_t=float(t), end_t=float(t))
                    if s["opened"]:
                        s["samples"] += 1
                        s["start_t"], s["end_t"] = min(s["start_t"], float(t)), max(s["end_t"], float(t))
                        if s["near_dist"] is None or r.dist < s["near_dist"]:
                            s.update(near_dist=float(r.dist), near_idx=int(idx), near_lat=float(lat), near_lng=float(lng), near_t=float(t))
                        if not pd.isna(alt):
                            fresh.setdefault(site, []).append(float(alt))
                elif (r is None or r.far) and s["last_in"] is not None and t - s["last_in"] >= scores.RESET_SECONDS:
                    touched.add(site)
                    row = self._close(track, site, s, fresh.pop(site, []))
                    s["cuts"] += 1
                    if row:
                        closed.append(row)
        for site, alts in fresh.items():
            self._keep(site, alts, states[site])
        for site in touched:
            self.sites.updateValue((site,), tuple(states[site].values()))
        self._wait(max(newest, self.seen.get()[0] if self.seen.exists() else newest))
        if closed:
            yield self._frame(closed)

    def _frame(self, closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(closed, columns=[c.split()[0] for c in CLOSED.split(", ")])

    def _wait(self, newest: int) -> None:
        """One timer, the idle time behind the track's newest point."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.seen.update((newest,))
        self.handle.registerTimer(newest + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (track,) = key
        closed = [row for site, state in self._load().items() if (row := self._close(track, site, state, []))]
        self.sites.clear()
        self.altitudes.clear()
        self.seen.clear()
        if closed:
            yield self._frame(closed)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            if isinstance(r.site_id, str):
                self.sites.updateValue((r.site_id,), tuple((FRESH | {"cuts": int(r.cuts), "last_in": float(r.last_in)}).values()))

    def close(self) -> None:
        pass


def scored(closed: DataFrame) -> DataFrame:
    """Closed visits with their confidence and class, without those that are rejected."""
    sure = scores.confidence(F.col("mode"), F.col("near_dist"), F.col("samples"), F.col("end_t") - F.col("start_t"), F.col("alts"), (F.col("near_idx") - F.col("start_idx")).cast("int"), F.col("elevation"))
    out = closed.withColumn("confidence", sure).withColumn("class", scores.visit_class(F.col("confidence"), F.col("mode"))).where(F.col("class") != "reject")
    return out.select("track_id", "site_id", "visit", "mode", F.col("near_lat").alias("lat"), F.col("near_lng").alias("lng"), "elevation", F.col("near_idx").alias("idx"), F.col("near_t").alias("t"), F.col("near_dist").alias("min_dist"), "samples", (F.col("end_t") - F.col("start_t")).alias("seconds"), "confidence", "class", (F.col("class") == "confirm").alias("needs_confirmation"))


def handed_over(points: DataFrame, sites: DataFrame) -> DataFrame:
    """What a stream that goes on behind these points has to know: track_id, site_id, cuts, last_in. No visit of them may be open."""
    rows = near_rows(points, sites)
    own = Window.partitionBy("track_id", "site_id").orderBy("idx")
    inside = rows.where("inside").select("track_id", "site_id", "idx", F.col("t").alias("last_in"), F.lead("idx").over(own).alias("_until"))
    # points out of reach between two within reach, or behind the last
    out = points.select("track_id", F.col("idx").alias("_idx"), F.coalesce("t", F.col("idx").cast("double")).alias("_t"))
    close = rows.where(~F.col("far")).select("track_id", "site_id", F.col("idx").alias("_idx"))
    between = (F.col("_idx") > F.col("idx")) & (F.col("_idx") < F.coalesce("_until", F.lit(1 << 62))) & (F.col("_t") - F.col("last_in") >= scores.RESET_SECONDS)
    cuts = inside.join(out, "track_id").where(between).join(close, ["track_id", "site_id", "_idx"], "left_anti").groupBy("track_id", "site_id").agg(F.count("*").alias("cuts"))
    last = inside.where(F.col("_until").isNull()).select("track_id", "site_id", "last_in")
    return last.join(cuts, ["track_id", "site_id"], "left").select("track_id", "site_id", F.coalesce("cuts", F.lit(0)).cast("long").alias("cuts"), "last_in")


def visits(rows: DataFrame, idle_seconds: float = 3600.0, late: str = "10 minutes", known: DataFrame | None = None) -> DataFrame:
    """Scored visits from a stream of ``near_rows``. Equal to the batch's for tracks whose points are less than the idle time apart.

    ``known``: track_id, site_id, cuts, last_in of what went before, as ``handed_over`` has it; read by the stream's first trigger.
    The session's state store has to be RocksDB's. Late points beyond the watermark are dropped.
    """
    keyed = rows.withWatermark("ts", late).groupBy("track_id")
    initial = known.groupBy("track_id") if known is not None else None
    return scored(keyed.transformWithStateInPandas(Visits(idle_seconds), CLOSED, "append", "EventTime", initialState=initial))
