"""Change points against all partitions of short signals and against plain Python on long ones."""

import math
import random
from functools import cache
from itertools import combinations
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators.change_points import Limits, best_cut, change_points

SCHEMA = "video_id long, frame_index long, vz double, ok boolean"


def state_of(level, band):
    return 2 if level > band else 0 if level < -band else 1


def best_partition(values, marks, band, penalty, least):
    """The cost of the cheapest cut among all subsets of the inner marks."""
    n, best = len(values), math.inf
    for count in range(len(marks) + 1):
        for inner in combinations(marks, count):
            at = [0, *inner, n]
            parts = [values[a:b] for a, b in zip(at, at[1:])]
            if count and min(map(len, parts)) < least:
                continue
            states = [state_of(sum(p) / len(p), band) for p in parts]
            if any(abs(a - b) > 1 for a, b in zip(states, states[1:])):
                continue
            best = min(best, sum(len(p) * max(0.0, sum(x * x for x in p) / len(p) - (sum(p) / len(p)) ** 2) for p in parts) + penalty * count)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_cheapest_of_all_partitions(seed):
    rng = random.Random(seed)
    values = [rng.choice([-2.0, 0.0, 2.0]) + rng.gauss(0, 0.4) for _ in range(rng.randrange(4, 13))]
    n, least, band, penalty = len(values), rng.choice([1, 2, 3]), 0.6, 0.5
    marks = list(range(1, n))
    at = np.array([0, *marks, n])
    sums, squares = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(np.square(values))])
    found = best_cut(at, sums, squares, band, penalty, least)
    assert found[0][0] == 0 and found[-1][1] == n and all(a[1] == b[0] and a[2] != b[2] and abs(a[2] - b[2]) == 1 for a, b in zip(found, found[1:]))
    want = best_partition(values, marks, band, penalty, least)
    # segments of one state are joined afterwards, so the cost is looked up in the cheapest cut that has these borders
    borders = {b for _, b, _ in found}
    reached = best_partition_with(values, band, penalty, least, borders)
    assert abs(reached - want) < 1e-9


def best_partition_with(values, band, penalty, least, borders):
    n = len(values)
    best = math.inf
    free = [k for k in range(1, n) if k not in borders]
    for count in range(len(free) + 1):
        for inner in combinations(free, count):
            at = sorted({0, n, *inner, *borders})
            parts = [values[a:b] for a, b in zip(at, at[1:])]
            if len(parts) > 1 and min(map(len, parts)) < least:
                continue
            states = [state_of(sum(p) / len(p), band) for p in parts]
            if any(abs(a - b) > 1 for a, b in zip(states, states[1:])):
                continue
            best = min(best, sum(len(p) * max(0.0, sum(x * x for x in p) / len(p) - (sum(p) / len(p)) ** 2) for p in parts) + penalty * (len(parts) - 1))
    return best


def mad(xs):
    return median(abs(x - median(xs)) for x in xs) if xs else 0.0


def segments_by_hand(rows, limits):
    """(start, end, state, level, variance) of one video from its definition; rows are (frame, value or None)."""
    known = [v for _, v in rows if v is not None]
    noise = max(1e-6, 1.4826 * mad([b - a for a, b in zip(known, known[1:])]) / math.sqrt(2))
    out, run = [], []

    def flush():
        if run:
            out.extend(of_run([v for _, v in run], run[0][0]))
            run.clear()

    def of_run(values, first):
        n = len(values)
        least = max(1, min(limits.min_length, n))
        scale = max(noise, 1.4826 * mad(values), 1e-6)
        band = max(limits.band_floor, limits.band_noise * noise)
        low, high = median(values) - limits.clip * scale, median(values) + limits.clip * scale
        w = [min(high, max(low, v)) for v in values]
        marks = set(range(least, n, max(least, limits.stride)))
        marks |= {i for i in range(least, n - least + 1) if abs(w[i] - w[i - 1]) >= limits.strong_change * max(noise, 1e-9)}
        marks = sorted(marks - {0, n})
        keep = limits.max_boundaries - 2
        if len(marks) > keep:
            marks = sorted({marks[round(k * (len(marks) - 1) / max(1, keep - 1))] for k in range(keep)})
        penalty = limits.penalty * max(noise, limits.band_floor, 1e-6) ** 2

        @cache
        def best(end, state):
            """(cost, begin, state before) of the best cut of the first values whose last segment has this state."""
            options = []
            for begin in [0, *[m for m in marks if m < end]]:
                if end - begin < least and not (begin == 0 and end == n):
                    continue
                part = w[begin:end]
                mean = sum(part) / len(part)
                if state_of(mean, band) != state:
                    continue
                cost = len(part) * max(0.0, sum(x * x for x in part) / len(part) - mean * mean)
                if begin == 0:
                    options.append((cost, begin, None))
                else:
                    before = [(best(begin, s)[0], s) for s in range(3) if abs(s - state) < 2 and best(begin, s)]
                    if before:
                        options.append((cost + penalty + min(before)[0], begin, min(before)[1]))
            return min(options, key=lambda o: (o[0], o[1])) if options else None

        state = min((s for s in range(3) if best(n, s)), key=lambda s: (best(n, s)[0], s))
        end, parts = n, []
        while end:
            _, begin, before = best(end, state)
            if parts and parts[-1][2] == state:
                parts[-1] = (begin, parts[-1][1], state)
            else:
                parts.append((begin, end, state))
            end, state = begin, before
        for begin, end, state in reversed(parts):
            level = median(values[begin:end])
            variance = sum((x - level) ** 2 for x in values[begin:end]) / (end - begin)
            yield first + begin, first + end - 1, ("backward", "static", "forward")[state], round(level, 6), round(variance, 6)

    last = None
    for frame, value in rows:
        if value is None or (last is not None and frame != last + 1):
            flush()
        if value is None:
            if out and out[-1][2] == "unknown" and out[-1][1] == frame - 1:
                out[-1] = (out[-1][0], frame, "unknown", None, None)
            else:
                out.append((frame, frame, "unknown", None, None))
        else:
            run.append((frame, value))
        last = frame
    flush()
    return sorted(out)


def made_up(seed, n, long=False):
    rng, rows, level, frame = random.Random(seed), [], 0.0, 0
    for k in range(n):
        if rng.random() < 0.04:
            level = rng.choice([-2.0, -0.3, 0.0, 0.3, 2.0])
        frame += 1 if long or rng.random() > 0.02 else rng.randrange(2, 5)
        rows.append((frame, None if not long and rng.random() < 0.03 else level + rng.gauss(0, 0.2)))
    return rows


def found(df, limits):
    got = change_points(df, ["video_id"], "frame_index", "vz", F.col("ok"), limits).collect()
    rounded = lambda x: None if x is None else round(x, 6)
    out = {}
    for r in got:
        out.setdefault(r["video_id"], []).append((r["start_frame"], r["end_frame"], r["state"], rounded(r["robust_level"]), rounded(r["residual_variance"])))
        assert 0 <= r["confidence"] <= 1 and r["duration_frames"] == r["end_frame"] - r["start_frame"] + 1
    return {k: sorted(v) for k, v in out.items()}


def test_videos_against_the_definition(spark, monkeypatch):
    videos = {1: made_up(1, 300), 2: made_up(2, 120), 3: [(5, 1.0)], 4: [(1, None), (2, None), (4, None)], 5: made_up(3, 7), 6: made_up(6, 400, long=True)}
    rows = [(k, f, v, True) if v is not None or f % 2 else (k, f, 9.0, False) for k, v_ in videos.items() for f, v in v_]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    few = Limits(max_boundaries=20)
    want = {limits: {k: segments_by_hand(v, limits) for k, v in videos.items()} for limits in (Limits(), few)}
    for limits, segments in want.items():
        assert found(df, limits) == segments
    assert len({s for v in want[Limits()].values() for _, _, s, _, _ in v}) == 4
    # a hot video is many chunks
    monkeypatch.setattr("trackloom.operators.change_points.SPAN", 16)
    assert found(df, Limits()) == want[Limits()]


def test_no_rows(spark):
    assert change_points(spark.createDataFrame([], SCHEMA), ["video_id"], "frame_index", "vz", F.col("ok")).count() == 0
