"""Signals to labelled segments: masks, hysteresis states, cut points, sweeps and plateaus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.bands import three_way
from trackloom.functions.geometry import norm
from trackloom.operators.ordered import (
    by_step,
    carried,
    following,
    near,
    overall_max,
    previous,
    running_sum,
    runs,
)
from trackloom.operators.signals import edge_padded_mean
from trackloom.operators.spread import spread

SPAN = 8192


def long_mask(df: DataFrame, keys: Sequence[str], position: str, least: int, **masks: Column) -> DataFrame:
    """Keep a true value only inside a run of at least ``least`` true rows.

    A row survives when some window of that length around it is all true, so the look-around is bounded.
    """
    back = least - 1
    full = {
        f"__full_{n}": (lambda w, m=m: (F.sum(m.cast("int")).over(w.rowsBetween(-back, 0)) == least).cast("int"))
        for n, m in masks.items()
    }
    keep = {
        n: (lambda w, n=n: F.coalesce(F.max(f"__full_{n}").over(w.rowsBetween(0, back)), F.lit(0)) == 1) for n in masks
    }
    made = near(df, keys, position, max(1, 2 * back), then=keep, **full)
    return made.drop(*full)


def hysteresis(df: DataFrame, keys: Sequence[str], position: str, enter: Column, stay: Column, name: str) -> DataFrame:
    """True from a row that enters until the first row that does not stay.

    ``enter`` must imply ``stay``; then the state is the latest set or reset.
    """
    switch = F.when(enter, 1).when(~stay, 0)
    out = by_step(keys, position, SPAN).scan(df, __state=carried(switch))
    return out.withColumn(name, F.coalesce(F.col("__state"), F.lit(0)) == 1).drop("__state")


def forward_states(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    vz: str,
    speed: str,
    accel: float,
    stop_enter: float,
    stop_exit: float,
    speed_enter: float,
    speed_exit: float,
    min_stop: int,
    stop_window: int,
    motion_window: int,
    epsilon: float,
) -> DataFrame:
    """Longitudinal states: stopping, or forward/backward with speedup, slowdown or steady motion."""
    if stop_enter > stop_exit or speed_enter > speed_exit:
        raise ValueError("a stop must be harder to enter than to keep")
    base = df.withColumn("__abs", F.abs(vz))
    wide = max(stop_window, motion_window)
    smooth = near(
        base,
        keys,
        position,
        wide + 1,
        then={"change": lambda w: F.coalesce(F.col("trend") - F.lag("trend").over(w), F.lit(0.0))},
        trend=edge_padded_mean(vz, motion_window),
        abs_mean=edge_padded_mean("__abs", stop_window),
        speed_mean=edge_padded_mean(speed, stop_window),
    )
    c = F.col
    enter = (c("abs_mean") <= stop_enter) & (c("speed_mean") <= speed_enter)
    stay = (c("abs_mean") <= stop_exit) & (c("speed_mean") <= speed_exit)
    raw = hysteresis(smooth, keys, position, enter, stay, "stop_raw")
    stopped = long_mask(raw, keys, position, min_stop, stopped=c("stop_raw"))
    moved = F.when(c("trend") > epsilon, 1).when(c("trend") < -epsilon, -1)
    headed = by_step(keys, position, SPAN).scan(stopped, heading=carried(F.when(~c("stopped"), moved)))
    ahead = F.coalesce(c("heading"), F.lit(1)) > 0
    along = F.when(ahead, c("change")).otherwise(-c("change"))
    kind = F.when(along > accel, "speedup").when(along < -accel, "slowdown").otherwise("static_moving")
    state = F.when(c("stopped"), "stopping").otherwise(
        F.concat(F.when(ahead, "forward_").otherwise("backward_"), kind)
    )
    return headed.withColumn("forward_state", state).drop("__abs")


def lateral_states(
    df: DataFrame, keys: Sequence[str], position: str, vx: str, turn: float, straight: float, least: int, window: int, epsilon: float
) -> DataFrame:
    """Left, right or straight; a turn must last, and values in the straight band never turn."""
    straight = max(0.0, straight)
    limit = max(turn, epsilon, straight + 1e-6)
    smooth = near(df, keys, position, window, trend_x=edge_padded_mean(vx, window))
    masks = long_mask(
        smooth, keys, position, least, is_left=F.col("trend_x") > limit, is_right=F.col("trend_x") < -limit
    )
    state = (
        F.when(F.abs("trend_x") <= straight, "straightforward")
        .when(F.col("is_left"), "left")
        .when(F.col("is_right"), "right")
        .otherwise("straightforward")
    )
    return masks.withColumn("lateral_state", state)


def timeline_segments(df: DataFrame, keys: Sequence[str], position: str, forward: str, lateral: str) -> DataFrame:
    """Segments cut wherever either axis changes."""
    combined = df.select(*keys, position, F.concat_ws("|", forward, lateral).alias("event"))
    out = runs(combined, keys, position, "event")
    parts = F.split("event", r"\|")
    return out.withColumn("forward_event", parts[0]).withColumn("lateral_event", parts[1])


def threshold_sweep(df: DataFrame, keys: Sequence[str], position: str, value: str, thresholds: int = 100) -> DataFrame:
    """Number of segments of the three-way labelling at evenly spaced thresholds below the largest value.

    Neighbouring rows get different labels exactly for a range of thresholds: below the larger magnitude, and
    not below the smaller one when the signs agree.  Each pair adds +1 and -1 at the ends of its range, so one
    aggregation of the rows and a running sum over the thresholds replace labelling every row at each threshold.
    """
    keys = list(keys)
    v = F.col(value)
    pairs = by_step(keys, position, SPAN).scan(df.filter(v.isNotNull()), before=previous(v), top=overall_max(F.abs(v)))
    b, n1 = F.col("before"), thresholds + 1
    # |x| exceeds top * i / n1 exactly for the indices i < |x| * n1 / top
    lower = lambda x: F.least(F.lit(thresholds), F.ceil(x * n1 / F.col("top")) - 1).cast("int")
    a, z = F.abs(v), F.abs("before")
    same_sign = v * b > 0
    first = F.when(same_sign, lower(F.least(a, z))).otherwise(0)
    last = lower(F.greatest(a, z))
    marks = (
        pairs.filter("before is not null and top > 0")
        .withColumn("first", first)
        .withColumn("last", last)
        .filter("last > first")
        .select(*keys, "top", F.explode(F.array(F.struct((F.col("first") + 1).alias("i"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("i"), F.lit(-1).alias("d")))).alias("m"))
        .groupBy(*keys, "top", F.col("m.i").alias("i"))
        .agg(F.sum("m.d").alias("d"))
    )
    grid = (
        df.filter(v.isNotNull())
        .groupBy(*keys)
        .agg(F.max(F.abs(v)).alias("top"))
        .filter("top > 0")
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(thresholds))))
    )
    filled = grid.join(marks.drop("top"), [*keys, "i"], "left").na.fill(0, ["d"])
    # at most ``thresholds`` rows per key
    counted = by_step(keys, "i", thresholds + 1).scan(filled, changes=running_sum(F.col("d")))
    return counted.select(
        *keys,
        (F.col("i") - 1).alias("candidate_index"),
        (F.col("top") * F.col("i") / n1).alias("threshold"),
        (F.col("changes") + 1).alias("segment_count"),
    )


def plateaus(sweep: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """Runs of equal segment count with their middle threshold; the thresholds are evenly spaced."""
    found = runs(
        sweep,
        keys,
        "candidate_index",
        "segment_count",
        low=("min", F.col("threshold")),
        high=("max", F.col("threshold")),
    )
    return found.select(
        *keys,
        F.col("start_frame").alias("start_index"),
        F.col("end_frame").alias("end_index"),
        "segment_count",
        F.col("frames").alias("num_values"),
        ((F.col("low") + F.col("high")) / 2).alias("middle"),
    ).withColumn(
        "rejections",
        F.array_join(
            F.array_compact(
                F.array(
                    F.when(F.col("num_values") < least, "too_few_values"),
                    F.when(F.col("segment_count") <= 1, "single_segment"),
                )
            ),
            ",",
        ),
    )


def transition_penalty(segments: DataFrame, keys: Sequence[str], state: str, opposite: tuple[str, str], penalty: float) -> DataFrame:
    """Confidence multiplier of segments that directly touch the opposite state, once per such neighbour."""
    s = F.col(state)
    seen = by_step(keys, "start_frame", SPAN).scan(segments, before=previous(s), after=following(s))
    a, b = opposite
    clash = lambda o: F.coalesce(((s == a) & (F.col(o) == b)) | ((s == b) & (F.col(o) == a)), F.lit(False)).cast("int")
    incidents = clash("before") + clash("after")
    return (
        seen.withColumn("incidents", incidents)
        .withColumn("multiplier", F.pow(F.lit(1.0 - penalty), F.col("incidents")))
        .drop("before", "after")
    )


def best_candidate(candidates: DataFrame, final: DataFrame, keys: Sequence[str], tie_break: Sequence[Column]) -> DataFrame:
    """Agreement of candidate labelings with the final one, and the best candidate of each key.

    ``candidates``: keys, candidate_id, threshold, frame_index, label; ``final``: keys, frame_index, state, confidence.
    """
    keys = list(keys)
    frames = final.groupBy(*keys).agg(F.count("*").alias("final_frames"))
    hit = F.col("label") == F.col("state")
    weight = F.greatest(F.lit(0.0), F.col("confidence"))
    scored = (
        candidates.join(final, [*keys, "frame_index"])
        .groupBy(*keys, "candidate_id", "threshold")
        .agg(
            (F.sum(F.when(hit, weight).otherwise(0.0)) / F.sum(weight)).alias("weighted"),
            F.avg(hit.cast("double")).alias("raw"),
            F.count("*").alias("common"),
        )
        .join(frames, keys)
        .withColumn("weighted", F.coalesce("weighted", F.lit(0.0)))
        .withColumn("coverage", F.col("common") / F.col("final_frames"))
    )
    order = F.struct(
        F.round("weighted", 9), F.round("raw", 9), F.round("coverage", 9), *tie_break, -F.col("threshold"), -F.col("candidate_id")
    )
    return scored.groupBy(*keys).agg(
        *[F.max_by(c, order).alias(c) for c in ("candidate_id", "threshold", "weighted", "raw", "coverage")]
    )


def keyframe_segments(keyframes: DataFrame, keys: Sequence[str], frame: str, label: str, frame_count: Column) -> DataFrame:
    """Each keyframe holds until the frame before the next one, the last to the end of the video."""
    seen = by_step(keys, frame, SPAN).scan(keyframes, after=following(F.col(frame)))
    return seen.select(
        *keys, F.col(frame).alias("start"), (F.coalesce("after", frame_count) - 1).cast("int").alias("end"), F.col(label).alias("label")
    )


def rescale_segments(segments: DataFrame, keys: Sequence[str], source: Column, target: Column) -> DataFrame:
    """Segments of a timeline of ``source`` frames on one of ``target`` frames."""
    scale = target / source
    start = F.greatest(F.lit(0), F.least(target - 1, F.floor(F.col("start") * scale)))
    end = F.greatest(start, F.least(target - 1, F.ceil((F.col("end") + 1) * scale) - 1))
    return segments.withColumn("scaled_start", start.cast("int")).withColumn("scaled_end", end.cast("int"))


def merge_touching(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join neighbouring segments with equal label and no frame in between."""
    scan = by_step(keys, "start", SPAN)
    seen = scan.scan(segments, before=previous(F.col("label")), stop=previous(F.col("end")))
    same = (F.col("before") == F.col("label")) & (F.col("stop") + 1 == F.col("start"))
    cut = seen.withColumn("cut", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).drop("before", "stop")
    numbered = scan.scan(cut, part=running_sum(F.col("cut")))
    return numbered.groupBy(*keys, "part").agg(
        F.min("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def conflict_windows(rows: DataFrame, keys: Sequence[str], start: str, end: str, size: str, hard: str, gap: int) -> DataFrame:
    """Rows joined while each starts within ``gap`` frames after the end of the row before it."""
    scan = by_step(keys, start, SPAN)
    seen = scan.scan(rows, stop=previous(F.col(end)))
    near_by = F.col(start) <= F.col("stop") + gap + 1
    cut = seen.withColumn("cut", F.when(F.coalesce(near_by, F.lit(False)), 0).otherwise(1)).drop("stop")
    return (
        scan.scan(cut, window_index=running_sum(F.col("cut")))
        .groupBy(*keys, "window_index")
        .agg(
            F.min(start).alias("start_frame"),
            F.max(end).alias("end_frame"),
            F.count("*").alias("residuals"),
            F.max(size).alias("peak"),
            F.max(hard).alias("hard"),
        )
    )


def stop_and_turn_masks(df: DataFrame, keys: Sequence[str], position: str, vx: str, vz: str, stop: float, turn: float, least: int) -> DataFrame:
    return long_mask(
        df, keys, position, least, stopped=norm(F.col(vx), F.col(vz)) < stop, turning=F.abs(vx) > turn
    )


def static_correction(frames: DataFrame, objects: DataFrame, state: str, vz_limit: float, speed_limit: float, least: int) -> DataFrame:
    """Force a stop in frames where static reference objects barely move.

    ``objects`` holds the static objects seen in a frame (video_id, frame_index, rel_vz, rel_speed); the objects of
    one frame are a bounded group, so the exact built-in percentile is used.
    """
    half = F.lit(0.5)
    still = (
        objects.groupBy("video_id", "frame_index")
        .agg(
            F.percentile(F.abs("rel_vz"), half).alias("mid_vz"),
            F.percentile(F.col("rel_speed"), half).alias("mid_speed"),
            F.count("*").alias("refs"),
        )
        .withColumn(
            "still", (F.col("refs") >= least) & (F.col("mid_vz") <= vz_limit) & (F.col("mid_speed") <= speed_limit)
        )
    )
    return frames.join(still, ["video_id", "frame_index"], "left").withColumn(
        "corrected", F.when(F.coalesce("still", F.lit(False)), "stopping").otherwise(F.col(state))
    )


def sweep_label(value: Column, threshold: Column, labels: tuple[str, str, str]) -> Column:
    return three_way(value, threshold, *labels)


def decode_consensus(frames: DataFrame, keys: Sequence[str], position: str, states: Sequence[str], least: int, sure: float = 0.99) -> DataFrame:
    """Most likely labels under a minimum segment length, from evidence columns named like the states.

    The best path is found per block.  Blocks end at missing frames and in the middle of stretches of ``4 * least``
    rows where one state holds at least ``sure`` of the evidence.  Any other segment reaching into such a stretch can
    be cut back to its minimum length, which gains evidence and leaves at least ``least`` rows of the sure state on
    both sides of the middle; so the best path holds that state there, and both sides are decided alone.
    """
    import numpy as np
    import pandas as pd

    from trackloom.operators.ordered import carried

    keys, states = list(keys), list(states)
    total = sum((F.col(s) for s in states[1:]), F.col(states[0]))
    share = frames.select(*keys, position, *[F.when(total > 0, F.col(s) / total).otherwise(1.0 / len(states)).alias(s) for s in states])
    clear = F.lit(None).cast("string")
    for s in states:
        clear = F.when(F.col(s) >= sure, F.lit(s)).otherwise(clear)
    half = 2 * least
    width = 2 * half
    marked = near(
        share.withColumn("clear", clear),
        keys,
        position,
        width,
        same=lambda w: (F.min("clear").over(w.rowsBetween(-half, half - 1)) == F.max("clear").over(w.rowsBetween(-half, half - 1)))
        & (F.count("clear").over(w.rowsBetween(-half, half - 1)) == width),
    )
    scan = by_step(keys, position, SPAN)
    seen = scan.scan(marked, before=previous(F.col(position)), was=previous(F.col("same")))
    gap = F.col("before").isNull() | (F.col(position) - F.col("before") > 1)
    opens = gap | (F.col("same") & ~F.coalesce("was", F.lit(False)))
    cut = seen.withColumn("head", F.when(opens, F.col(position))).drop("before", "was", "same", "clear")
    blocks = scan.scan(cut, block=carried(F.col("head"))).withColumn("pack", F.floor(F.col("block") / SPAN)).drop("head")

    def best_path(log: "np.ndarray") -> list[int]:
        n, k = log.shape
        prefix = np.vstack([np.zeros(k), np.cumsum(log, axis=0)])
        if n < least:
            return [int(np.argmax(prefix[n]))] * n
        # enter[s]: best value of starting a segment of state s so far, net of the prefix at its start
        score = np.full((n, k), -np.inf)
        back: list[list[tuple[int, int]]] = [[(0, -1)] * k for _ in range(n)]
        enter, origin = np.zeros(k), [(0, -1)] * k
        for end in range(least - 1, n):
            start = end - least + 1
            if start > 0:
                for s in range(k):
                    others = [(score[start - 1, o], -o) for o in range(k) if o != s]
                    value, o = max(others)
                    if value - prefix[start, s] > enter[s]:
                        enter[s], origin[s] = value - prefix[start, s], (start, -o)
            for s in range(k):
                score[end, s] = enter[s] + prefix[end + 1, s]
                back[end][s] = origin[s]
        path, end, s = [0] * n, n - 1, int(np.argmax(score[n - 1]))
        while end >= 0:
            start, before = back[end][s]
            path[start : end + 1] = [s] * (end - start + 1)
            end, s = start - 1, before
        return path

    def work(pdf: "pd.DataFrame") -> "pd.DataFrame":
        out = []
        for _, part in pdf.sort_values(position).groupby("block", sort=True):
            log = np.log(np.maximum(1e-12, part[states].to_numpy(dtype=float)))
            path = best_path(log)
            picked = part[states].to_numpy(dtype=float)[np.arange(len(path)), path]
            out.append(part[[*keys, position]].assign(state=[states[i] for i in path], confidence=picked))
        return pd.concat(out)

    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join([*[f"{c} {types[c]}" for c in [*keys, position]], "state string", "confidence double"])
    return spread(blocks, *keys, "pack").groupBy(*keys, "pack").applyInPandas(work, schema)


def confidence_surface(points: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Gaussian kernel density of (threshold, segment count) points at fixed grid nodes, scaled to a peak of one.

    The grid is a short list in each row, so a point is expanded by the grid size only and summed on the map side.
    """
    spread = points.agg(F.stddev_pop("threshold").alias("sx"), F.stddev_pop("count").alias("sy"), F.count("*").alias("n"))
    # one row: bandwidths shrink with the number of points
    width = spread.select(
        F.lit(1).alias("one"),
        *[F.greatest(F.lit(1e-6), F.col(c) * F.pow(F.col("n"), F.lit(-1.0 / 6))).alias(c) for c in ("sx", "sy")],
    )
    nodes = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("gx"), F.lit(float(y)).alias("gy")) for x, y in grid]))
    far = F.pow((F.col("threshold") - F.col("g.gx")) / F.col("sx"), F.lit(2)) + F.pow((F.col("count") - F.col("g.gy")) / F.col("sy"), F.lit(2))
    density = (
        points.withColumn("one", F.lit(1))
        .join(F.broadcast(width), "one")
        .withColumn("g", nodes)
        .groupBy("g.gx", "g.gy")
        .agg(F.avg(F.exp(-0.5 * far)).alias("density"))
    )
    peak = density.agg(F.max("density").alias("peak")).withColumn("one", F.lit(1))
    return density.withColumn("one", F.lit(1)).join(F.broadcast(peak), "one").select("gx", "gy", (F.col("density") / F.col("peak")).alias("confidence"))


def score_thresholds(df: DataFrame, keys: Sequence[str], position: str, value: str, options: Sequence[float], names: tuple[str, str, str]) -> DataFrame:
    """Fit error and transitions of the three-way labelling under a few threshold options, and the best option.

    The label a row gets under each option, and whether it differs from the row before, are columns of that row.
    """
    keys = list(keys)
    v = F.col(value)
    seen = by_step(keys, position, SPAN).scan(df, before=previous(v))
    labels = {i: (three_way(v, th, *names), three_way(F.col("before"), th, *names)) for i, th in enumerate(options)}
    aggs = []
    for i, (now, was) in labels.items():
        aggs.append(F.count_if(F.col("before").isNotNull() & (now != was)).alias(f"t{i}"))
        for name in names:
            inside = F.when(now == name, v)
            aggs += [F.count(inside).alias(f"n{i}_{name}"), F.coalesce(F.var_pop(inside), F.lit(0.0)).alias(f"v{i}_{name}")]
    wide = seen.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)
    rows = [
        F.struct(
            F.round(
                sum((F.col(f"n{i}_{name}") * F.col(f"v{i}_{name}") for name in names), F.lit(0.0)) / F.col("n") / 1000.0
                + F.col(f"t{i}") / F.col("n"),
                9,
            ).alias("score"),
            F.lit(i).alias("option"),
            F.col(f"t{i}").alias("transitions"),
        )
        for i in labels
    ]
    return wide.select(*keys, F.array_min(F.array(*rows)).alias("best")).select(*keys, "best.option", "best.score", "best.transitions")
