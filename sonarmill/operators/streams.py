"""Operators over ordered packet streams: gaps, timing, activity, suppression, recovery.

Those that a window can state are windows; the order-recursive ones are folds
(see ``streaming.fold``) that batch and streaming share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarmill.functions.speech import VoiceActivity, concealed
from sonarmill.streaming.fold import Fold, fold_batch

#: Milliseconds of inactivity before suppression, and the longest suppressed run.
BEFORE_SUPPRESSION_MS, MAX_SUPPRESSED_MS = 200, 400
MAX_CODES = 4096
ACTIVE_RATIO, FLOOR_LEAK, SILENCE = 8.0, 1.0003, 1e-7


def with_gaps(rows: DataFrame, keys: list[str], order: str, modulus: int = 1 << 32) -> DataFrame:
    """Adds ``missing``: how many sequence numbers lie between a row and the one before it (0 for the first)."""
    before = F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("missing", F.coalesce(F.pmod(F.col(order) - before - 1, F.lit(modulus)), F.lit(0)).cast("long"))


def running_position(rows: DataFrame, keys: list[str], order: str, samples: Column, pre_skip: int = 0) -> DataFrame:
    """Adds ``end_pos_48k`` as a writer counts it: pre-skip plus the samples so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end_pos_48k", (F.sum(samples).over(w) + pre_skip).cast("long"))


def with_recovery(rows: DataFrame, keys: list[str], order: str, data: str, lost: Column) -> DataFrame:
    """Adds ``recover_from``: for a lost packet the next one's data, which carries its copy; else null."""
    follower = F.lead(data).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("recover_from", F.when(lost, follower))


def suppression(rows: DataFrame, keys: list[str], order: str, active: Column, frame_ms: float = 20.0) -> DataFrame:
    """Adds ``suppressed``: after 200 ms without activity frames go unsent for 400 ms, then one refresh, and so on.

    The run of inactive frames is counted by a window; the pattern repeats, so its
    place in the run tells. Frame lengths are the same within a call.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, longest = int(BEFORE_SUPPRESSION_MS // frame_ms), int(MAX_SUPPRESSED_MS // frame_ms)
    marked = rows.withColumn("_active", active).withColumn("_run", F.sum(F.col("_active").cast("int")).over(w))
    run = F.row_number().over(Window.partitionBy(*keys, "_run", "_active").orderBy(order))
    place = run - before - 1
    hit = ~F.col("_active") & (place >= 0) & (F.pmod(place, F.lit(longest + 1)) < longest)
    return marked.withColumn("suppressed", hit).drop("_active", "_run")


def spurts(rows: DataFrame, keys: list[str], ts: str, gap: str = "30 minutes") -> DataFrame:
    """Talk spurts: (keys, start, end, n) of rows closer than ``gap``; ``end`` is the last row plus the gap."""
    out = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def spurts_by_window(rows: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """The same as gaps and islands, for engines or types without session windows."""
    w = Window.partitionBy(*keys).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((seconds - F.lag(seconds).over(w) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_island").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("_island")


def simulated_loss(seq: Column, every: int = 10, place: int = 7) -> Column:
    return F.pmod(seq, F.lit(every)) == place


def nearest_code(rows: DataFrame, key: str, vector: str, codebook: DataFrame, code: str, code_vector: str) -> DataFrame:
    """Adds each row's nearest code by squared distance (ties: the least code).

    The codebook is worked through in blocks of about ``MAX_CODES`` codes: a block becomes one
    array that every row is compared with, so no row is multiplied. An empty codebook gives nulls.
    """
    blocks = max(1, -(-2 * codebook.count() // MAX_CODES) if codebook.limit(MAX_CODES + 1).count() > MAX_CODES else 1)
    distance = lambda v: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    out = rows.select(key, vector)
    for k in range(blocks):
        part = codebook.where(F.pmod(F.xxhash64(code), F.lit(blocks)) == k)
        book = part.agg(F.array_sort(F.collect_list(F.struct(F.col(code).alias("code"), F.col(code_vector).cast("array<double>").alias("v")))).alias("_book"))
        found = F.array_min(F.transform("_book", lambda c: F.struct(distance(c["v"]).alias("d"), c["code"].alias("code"))))
        out = out.join(F.broadcast(book)).withColumn("_best", F.least(found, F.col("_best")) if k else found).drop("_book")
    return out.select(key, F.col("_best.code").alias(code), F.col("_best.d").alias("distance"))


@dataclass
class Activity(Fold):
    """Activity against a noise floor that follows the least energy and leaks upward."""

    floor: float = 1.0

    def step(self, row: dict) -> list[dict]:
        energy = max(0.0, row["energy"] or 0.0)
        self.floor = energy if energy < self.floor else self.floor * FLOOR_LEAK
        return [{"seq": row["seq"], "floor": self.floor, "active": energy > max(self.floor * ACTIVE_RATIO, SILENCE)}]


@dataclass
class Smoothing(Fold):
    """The music score, smoothed; silent frames leave it as it is."""

    value: float = 0.5
    weight: float = 0.2

    def step(self, row: dict) -> list[dict]:
        if row["energy"] is not None and row["music"] is not None and row["energy"] > SILENCE:
            self.value += self.weight * (row["music"] - self.value)
        return [{"seq": row["seq"], "smooth": self.value}]


@dataclass
class Suppression(Fold):
    """``suppression`` as a fold, for frames of any length (``frame_ms``) and for streams."""

    idle: float = 0.0

    def step(self, row: dict) -> list[dict]:
        sent = True
        if row["active"]:
            self.idle = 0.0
        else:
            self.idle += row["frame_ms"]
            if self.idle > BEFORE_SUPPRESSION_MS:
                sent = self.idle > BEFORE_SUPPRESSION_MS + MAX_SUPPRESSED_MS
                if sent:
                    self.idle = float(BEFORE_SUPPRESSION_MS)
        return [{"seq": row["seq"], "suppressed": not sent}]


@dataclass
class Voice(Fold):
    """Voice activity of frames (seq, pcm) of one stream."""

    detector: VoiceActivity = field(default_factory=VoiceActivity)

    def step(self, row: dict) -> list[dict]:
        got = self.detector.frame(np.asarray(row["pcm"], float))
        return [{"seq": row["seq"], "activity": got["activity"], "tilt": got["tilt"], "snr_db": got["snr_db"]}]


@dataclass
class LossFilling(Fold):
    """Frames (seq, pcm) of one stream with pcm null where a packet was lost; these are filled from what came before."""

    past: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lost: int = 0
    size: int = 0

    def step(self, row: dict) -> list[dict]:
        pcm = row["pcm"]
        filled = pcm is None
        if filled:
            pcm = concealed(self.past, self.size, self.lost, lo=min(32, max(2, self.size // 4)))
            self.lost += 1
        else:
            pcm, self.lost = np.asarray(pcm, float), 0
            self.size = len(pcm)
        self.past = np.concatenate([self.past, pcm])[-1152:]
        return [{"seq": row["seq"], "pcm": pcm.tolist(), "filled": filled}]


def _keyed(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + rest


def activity(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, floor, active) from (keys, seq, energy)."""
    return fold_batch(df.select(*keys, "seq", "energy"), keys, ["seq"], Activity, _keyed(df, keys, "seq long, floor double, active boolean"))


def smoothed_music(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, smooth) from (keys, seq, energy, music)."""
    return fold_batch(df.select(*keys, "seq", "energy", "music"), keys, ["seq"], Smoothing, _keyed(df, keys, "seq long, smooth double"))


def voice_activity(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, activity, tilt, snr_db) from (keys, seq, pcm)."""
    return fold_batch(df.select(*keys, "seq", "pcm"), keys, ["seq"], Voice, _keyed(df, keys, "seq long, activity double, tilt double, snr_db array<double>"))


def filled(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, pcm, filled) from (keys, seq, pcm) with nulls for lost frames."""
    return fold_batch(df.select(*keys, "seq", "pcm"), keys, ["seq"], LossFilling, _keyed(df, keys, "seq long, pcm array<double>, filled boolean"))
