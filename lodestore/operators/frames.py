"""Video as rows of frame features: motion, clips, segments, backgrounds, policy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_of


def by_camera() -> object:
    return Window.partitionBy("camera").orderBy("frame")


#: Frames that one task looks at in order.
SPAN = 1024


def with_neighbour(frames: DataFrame, value: str, name: str, after: bool = False, span: int = SPAN) -> DataFrame:
    """Add ``name``: the value of the camera's frame before (or after), null where there is none.

    Frames are looked at by spans of their numbers, so no task sorts a whole camera; only
    the outermost value of each span takes part in the window across spans.
    """
    rows = frames.withColumn("span", F.floor(F.col("frame") / span))
    order = F.col("frame").desc() if after else F.col("frame").asc()
    inside = Window.partitionBy("camera", "span").orderBy(order)
    outer = (F.min_by if after else F.max_by)(value, "frame")
    across = Window.partitionBy("camera").orderBy(F.col("span").desc() if after else F.col("span").asc())
    ends = rows.groupBy("camera", "span").agg(outer.alias("end")).select("camera", "span", F.lag("end").over(across).alias("carried"))
    met = rows.withColumn("own", F.lag(value).over(inside)).withColumn("head", F.row_number().over(inside) == 1).join(ends, ["camera", "span"])
    return met.withColumn(name, F.when(F.col("head"), F.col("carried")).otherwise(F.col("own"))).drop("span", "own", "head", "carried")


def abs_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def share_above(values: Column, limit: float) -> Column:
    """Share of the values above a limit."""
    return F.size(F.filter(values, lambda x: x > limit)) / F.size(values)


def frame_diff(frames: DataFrame, limit: float) -> DataFrame:
    """Motion of each frame: share of its values that differ from the frame before by more than ``limit``; the first has none."""
    rows = with_neighbour(frames, "vec", "before")
    return rows.withColumn("moved", F.when(F.col("before").isNotNull(), share_above(abs_diff(F.col("vec"), F.col("before")), limit)).otherwise(F.lit(0.0))).drop("before")


def three_frame_diff(frames: DataFrame, limit: float) -> DataFrame:
    """Motion between both neighbours: share of values that differ from the one before and the one after."""
    rows = with_neighbour(with_neighbour(frames, "vec", "b"), "vec", "n", after=True).where("b is not null and n is not null")
    both = F.zip_with(abs_diff(F.col("vec"), F.col("b")), abs_diff(F.col("n"), F.col("vec")), lambda x, y: F.least(x, y))
    return rows.withColumn("moved", share_above(both, limit)).drop("b", "n")


def clips(frames: DataFrame, length: int = 60) -> DataFrame:
    """Aggregates of clips of ``length`` frames: motion, objects, commonest scene and its share, level, score, action."""
    rows = frames.withColumn("clip", F.floor(F.col("frame") / length).cast("long"))
    scenes = rows.groupBy("camera", "clip", "scene").agg(F.count(F.lit(1)).alias("k"))
    top = scenes.groupBy("camera", "clip").agg(F.min_by("scene", F.struct(-F.col("k"), "scene")).alias("scene"), F.max("k").alias("k"))
    out = rows.groupBy("camera", "clip").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("motion"), 6).alias("mean_motion"),
        F.max("motion").alias("max_motion"),
        F.bool_or("has_people").alias("people"),
        F.bool_or("has_vehicles").alias("vehicles"),
        F.bool_or("has_faces").alias("faces"),
        F.max("person_count").alias("persons"),
        F.round(F.avg("level") / 255, 6).alias("brightness"),
    )
    out = out.join(top, ["camera", "clip"]).withColumn("stability", F.round(F.col("k") / F.col("n"), 6)).drop("k")
    m = F.col("max_motion")
    out = out.withColumn("level", first_of([(m < 0.01, "none"), (m < 0.05, "minimal"), (m < 0.15, "low"), (m < 0.3, "moderate"), (m < 0.5, "high")], "very_high"))
    score = first_of([(F.col("faces"), 0.4), (F.col("people"), 0.3)], 0.0) + first_of([(m >= 0.15, 0.25), (m >= 0.05, 0.1)], 0.0) + F.when(F.col("vehicles"), 0.15).otherwise(0.0)
    score = score * F.when(F.col("brightness") < 0.15, 0.7).otherwise(1.0)
    # every motion level compares as at least "high" when words are compared, so all clips without objects are halved
    score = score * F.when(~F.col("people") & ~F.col("vehicles"), 0.5).otherwise(1.0)
    out = out.withColumn("score", F.round(score, 6))
    s = F.col("score")
    return out.withColumn("action", first_of([(s >= 0.6, "preserve"), (s >= 0.3, "downsample"), (s >= 0.1, "archive")], "discard"))


_RANK = {"waste": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def clip_policy(c: DataFrame, ordering: str = "lexical") -> DataFrame:
    """Priority, action, retention and size of each clip by motion and scene rules and overrides for what was seen."""
    key = (lambda x: x) if ordering == "lexical" else (lambda x: first_of([(x == k, v) for k, v in _RANK.items()]))
    m = F.col("max_motion")
    motion = first_of([(m <= 0.05, "low"), (m <= 0.3, "medium"), (m <= 0.6, "high")], "critical")
    scene = first_of([(F.col("scene") == "indoor", "high"), (F.col("scene") == "parking", "low")], "medium")
    rows = c.withColumn("p", F.lit("medium"))
    for rule in (motion, scene):
        rows = rows.withColumn("rule", rule).withColumn("p", F.when(key(F.col("rule")) > key(F.col("p")), F.col("rule")).otherwise(F.col("p")))
    rows = rows.withColumn("p", F.when(F.col("faces"), F.lit("critical")).otherwise(F.col("p")))
    for seen in ("people", "vehicles"):
        rows = rows.withColumn("p", F.when(F.col(seen) & (key(F.col("p")) < key(F.lit("high"))), F.lit("high")).otherwise(F.col("p")))
    p, size = F.col("p"), F.col("n") * 102400
    kept = p.isin("critical", "high")
    return rows.select(
        "camera",
        "clip",
        p.alias("priority"),
        first_of([(kept, "preserve_intact"), (p == "medium", "downsample"), (p == "low", "archive")], "delete").alias("action"),
        first_of([(kept, size), (p == "medium", F.floor(size * 0.3)), (p == "low", F.floor(size * 0.05))], 0).cast("long").alias("new_size"),
    )


# Default rules of a scene, as (from hour, before hour, priority, reason).
DEFAULT_RULES = {
    "indoor": [(8, 22, "medium", "business_hours"), (22, 24, "high", "night"), (0, 8, "high", "night")],
    "parking": [(6, 22, "low", "day"), (22, 24, "medium", "night"), (0, 6, "medium", "night")],
}


def by_hour(rows: DataFrame, hour: str, rules: list[tuple[int, int, str, str]]) -> DataFrame:
    """Add priority and reason of the first rule whose hours hold the row's; null where none does."""
    holds = lambda i: first_of([((F.col(hour) >= r[0]) & (F.col(hour) < r[1]), r[i]) for r in rules])
    return rows.withColumn("priority", holds(2)).withColumn("reason", holds(3))


def scene_changes(frames: DataFrame, low: float = 0.01, high: float = 0.8) -> DataFrame:
    """Frames whose motion is outside the band that ordinary movement has."""
    return frames.where((F.col("motion") < low) | (F.col("motion") > high))


def segments(frames: DataFrame, change: float, longest: int) -> DataFrame:
    """Split each camera's frames where the level jumps by more than ``change`` or a segment reaches ``longest`` frames.

    Jumps are found by a window and numbered by a running sum; within a run the
    length limit cuts at every ``longest``-th frame.
    """
    w = by_camera()
    rows = frames.withColumn("jump", (F.abs(F.col("level") - F.lag("level").over(w)) > change).cast("int"))
    rows = rows.withColumn("run", F.sum(F.coalesce("jump", F.lit(0))).over(w))
    place = F.row_number().over(Window.partitionBy("camera", "run").orderBy("frame")) - 1
    rows = rows.withColumn("part", F.floor(place / longest).cast("long"))
    return rows.groupBy("camera", "run", "part").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"))


def ema(frames: DataFrame, keep: float = 0.95, value: str = "level") -> DataFrame:
    """Running background of each frame: ``keep`` of the one before and the rest of this value, from the first value on.

    The recursion's closed form is a weighted running sum; blocks of 256 frames
    keep the weights in range, and each block starts from the end of the one before.
    """
    w = Window.partitionBy("camera", "block").orderBy("frame")
    rows = frames.withColumn("block", F.floor(F.col("frame") / 256)).withColumn("i", F.col("frame") % 256)
    first = (F.col("frame") == 0).cast("double")
    weight = F.pow(F.lit(keep), -F.col("i").cast("double"))
    gain = F.when(first == 1, F.lit(1.0)).otherwise(F.lit(1 - keep))
    rows = rows.withColumn("part", F.sum(gain * F.col(value) * weight).over(w) * F.pow(F.lit(keep), F.col("i").cast("double")))
    ends = rows.groupBy("camera", "block").agg(F.max_by("part", "i").alias("end"), F.max("i").alias("last"))
    # what a block inherits; of blocks further back less than a double can tell is left
    reach = max(1, math.ceil(-math.log(1e-20) / (-256 * math.log(keep)))) if 0 < keep < 1 else 1
    chain = F.collect_list(F.struct("end", "last")).over(Window.partitionBy("camera").orderBy("block").rowsBetween(-reach, -1))
    carried = F.aggregate(chain, F.lit(0.0), lambda s, e: e["end"] + s * F.pow(F.lit(keep), (e["last"] + 1).cast("double")))
    rows = rows.join(ends.select("camera", "block", carried.alias("carried")), ["camera", "block"])
    return rows.withColumn("background", F.col("part") + F.col("carried") * F.pow(F.lit(keep), (F.col("i") + 1).cast("double"))).drop("carried", "part", "block", "i")


def _linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the links (a, b) join it to."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        for at in (a, b, low[a], low[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def mask_regions(masks: np.ndarray) -> dict[str, np.ndarray]:
    """Connected regions (by sides and corners) of ``masks`` (n, height, width): image, x, y, width, height, area.

    Rows are cut into runs; runs that touch one in the next row are found by two
    searches in the sorted list of all runs, and joined.
    """
    n, height, width = masks.shape
    padded = np.zeros((n * height, width + 2), np.int8)
    padded[:, 1:-1] = masks.reshape(n * height, width)
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    end -= 1
    wide = width + 4
    first, last = row * wide + start + 2, row * wide + end + 2
    # the row below, unless it is another image's
    below = (row + 1) * wide + 2
    lo, hi = np.searchsorted(last, below + start - 1, "left"), np.searchsorted(first, below + end + 1, "right")
    hi = np.where((row + 1) % height == 0, lo, hi)
    size = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), size)
    b = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    low = _linked(len(row), a, b)
    _, back = np.unique(low, return_inverse=True)
    count = int(back.max()) + 1 if len(back) else 0

    def least(values: np.ndarray) -> np.ndarray:
        out = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(out, back, values)
        return out

    x, y = least(start), least(row % height)
    return {"image": least(row // height), "x": x, "y": y, "width": -least(-end) - x + 1, "height": -least(-(row % height)) - y + 1, "area": np.bincount(back, end - start + 1, count).astype(np.int64)}


_REGION = "rank int, x long, y long, width long, height long, area long, center_x long, center_y long"


def regions(masks: DataFrame, height: int, width: int, top: int = 10, least: int = 1) -> DataFrame:
    """The ``top`` largest connected regions of each mask of ``masks(camera, frame, mask)``, an array of height times width booleans by rows.

    Returns camera, frame, rank, the box (x, y, width, height), area and the box's centre.
    Ties go to the upper, then to the left one; regions under ``least`` values are left out.
    """
    kinds = ", ".join(f"{c} {masks.schema[c].dataType.simpleString()}" for c in ("camera", "frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = mask_regions(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, height, width))
            order = np.lexsort((found["x"], found["y"], -found["area"], found["image"]))
            order = order[found["area"][order] >= least]
            image = found["image"][order]
            rank = np.arange(len(order)) - np.searchsorted(image, image) + 1
            order, rank = order[rank <= top], rank[rank <= top]
            box = [found[c][order] for c in ("x", "y", "width", "height", "area")]
            centre = [box[0] + box[2] // 2, box[1] + box[3] // 2]
            at = pa.array(found["image"][order])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rank, pa.int32()), *(pa.array(c, pa.int64()) for c in box + centre)], ["camera", "frame", *[c.split()[0] for c in _REGION.split(", ")]])

    return masks.select("camera", "frame", "mask").mapInArrow(run, f"{kinds}, {_REGION}")


# Fixed values of the background model: components of a value, how fast it learns, what counts as near, the share that is background, first and least variance.
COMPONENTS, RATE, NEAR, SHARE, FIRST_VARIANCE, LEAST_VARIANCE = 3, 0.05, 2.5, 0.7, 900.0, 4.0


class Mixture:
    """A Gaussian mixture for each of ``n`` values, that learns frame by frame."""

    def __init__(self, n: int):
        self.weight = np.zeros((COMPONENTS, n))
        self.mean = np.zeros((COMPONENTS, n))
        self.variance = np.full((COMPONENTS, n), FIRST_VARIANCE)

    def foreground(self, frame: np.ndarray) -> np.ndarray:
        """Which values are no background; the model then learns the frame. All of the first frame are."""
        every = np.arange(len(frame))
        apart = (frame - self.mean) ** 2
        fits = (self.weight > 0) & (apart <= NEAR**2 * self.variance)
        # the components in order of weight by deviation; the first that make up the share are background
        order = np.argsort(-self.weight / np.sqrt(self.variance), axis=0, kind="stable")
        sorted_ = np.take_along_axis(self.weight, order, axis=0)
        is_back = np.empty_like(fits)
        np.put_along_axis(is_back, order, np.cumsum(sorted_, axis=0) - sorted_ < SHARE, axis=0)
        hit = np.take_along_axis(fits, order, axis=0)
        found = hit.any(axis=0)
        own = order[hit.argmax(axis=0), every]
        out = ~(found & is_back[own, every])
        # a value that fits none begins a component in place of the lightest
        own = np.where(found, own, self.weight.argmin(axis=0))
        self.weight *= 1 - RATE
        self.weight[own, every] += RATE
        fresh = every[~found]
        self.mean[own[fresh], fresh], self.variance[own[fresh], fresh] = frame[fresh], FIRST_VARIANCE
        old = every[found]
        difference = frame[old] - self.mean[own[old], old]
        self.mean[own[old], old] += RATE * difference
        self.variance[own[old], old] = np.maximum(LEAST_VARIANCE, self.variance[own[old], old] + RATE * (difference**2 - self.variance[own[old], old]))
        self.weight /= self.weight.sum(axis=0)
        return out


def background_model(frames: DataFrame) -> DataFrame:
    """Foreground of each frame of ``frames(camera, frame, vec)`` under its camera's :class:`Mixture`: camera, frame, foreground (values that are no background) and mask.

    A camera's frames pass one task in order, a batch at a time; the mixture is carried
    from batch to batch, so what is held is one model and one batch.
    """
    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("camera", "frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, model = None, None
        for batch in batches:
            masks = []
            for c, vec in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if model is None or c != camera:
                    camera, model = c, Mixture(len(vec))
                masks.append(model.foreground(np.array(vec, float)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sum(m) for m in masks], pa.int64()), pa.array(masks, pa.list_(pa.bool_()))], ["camera", "frame", "foreground", "mask"])

    ordered = frames.select("camera", "frame", "vec").repartition("camera").sortWithinPartitions("camera", "frame")
    return ordered.mapInArrow(run, f"{kinds}, foreground long, mask array<boolean>")
