"""Order-dependent segment rules against plain implementations and hand-made cases."""

import random

import pytest

from trackloom.operators import matching, segment_eval, segmentation, short_runs


def table(spark, labels_by_video):
    rows = []
    for video, labels in labels_by_video.items():
        i = 0
        while i < len(labels):
            j = i
            while j + 1 < len(labels) and labels[j + 1] == labels[i]:
                j += 1
            rows.append((video, i, j, j - i + 1, float(sum(map(ord, labels[i])) % 7), labels[i]))
            i = j + 1
    return spark.createDataFrame(rows, "video_id int, start_frame int, end_frame int, frames bigint, mean double, state string")


def labels_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.video_id, r.start_frame)):
        out.setdefault(r.video_id, []).extend([r.state] * (r.end_frame - r.start_frame + 1))
    return out


def random_labels(seed, videos=6, n=120):
    rnd = random.Random(seed)
    out = {}
    for v in range(videos):
        labels = []
        while len(labels) < n:
            labels += [rnd.choice("abc")] * rnd.choice([1, 1, 2, 3, 5, 9])
        out[v] = labels[:n]
    return out


def naive_absorb(labels, least):
    labels = list(labels)
    while True:
        segs, i = [], 0
        while i < len(labels):
            j = i
            while j + 1 < len(labels) and labels[j + 1] == labels[i]:
                j += 1
            segs.append((i, j))
            i = j + 1
        for k, (a, b) in enumerate(segs):
            if b - a + 1 >= least or len(segs) == 1:
                continue
            left, right = (segs[k - 1] if k else None), (segs[k + 1] if k + 1 < len(segs) else None)
            size = lambda s: s[1] - s[0] + 1
            target = right if left is None or (right and size(right) > size(left)) else left
            labels[a : b + 1] = [labels[target[0]]] * (b - a + 1)
            break
        else:
            return labels


def naive_smooth(labels, least):
    labels, i = list(labels), 0
    while i < len(labels):
        start, label = i, labels[i]
        while i < len(labels) and labels[i] == label:
            i += 1
        if i - start >= least:
            continue
        left = labels[start - 1] if start else None
        right = labels[i] if i < len(labels) else None
        if left is not None and (left == right or right is None):
            labels[start:i] = [left] * (i - start)
        elif left is None and right is not None:
            labels[start:i] = [right] * (i - start)
    return labels


@pytest.mark.parametrize("seed", [1, 2])
def test_absorb_matches_restarting_loop(spark, seed):
    data = random_labels(seed)
    got = labels_of(short_runs.absorb_short_runs(table(spark, data), ["video_id"], "state", 3))
    assert got == {v: naive_absorb(l, 3) for v, l in data.items()}


def test_smooth_matches_one_pass(spark):
    data = random_labels(5)
    got = labels_of(short_runs.smooth_short_runs(table(spark, data), ["video_id"], "state", 3))
    assert got == {v: naive_smooth(l, 3) for v, l in data.items()}


def test_bridge_one_interruption(spark):
    data = {1: ["forward"] * 10 + ["static"] * 4 + ["forward"] * 10}
    got = short_runs.bridge_interruptions(table(spark, data), ["video_id"], "state", 5).collect()
    assert [(r.start_frame, r.end_frame, r.state) for r in got] == [(0, 23, "forward")]


def test_islands_leave_no_short_run(spark):
    data = random_labels(7)
    out = short_runs.assign_short_islands(table(spark, data), ["video_id"], "state", 2).collect()
    assert all(r.end_frame - r.start_frame + 1 > 2 for r in out)


def test_forbidden_transition_halves_both(spark):
    data = {1: ["forward"] * 4 + ["backward"] * 4 + ["static"] * 2}
    out = segmentation.transition_penalty(table(spark, data), ["video_id"], "state", ("forward", "backward"), 0.5)
    assert [r.multiplier for r in sorted(out.collect(), key=lambda r: r.start_frame)] == [0.5, 0.5, 1.0]


def frames(spark, rows):
    return spark.createDataFrame([(1, f) for f in rows], "video_id int, frame int")


def test_boundary_tolerance(spark):
    truth, predicted = frames(spark, [5, 10]), frames(spark, [7, 12])
    score = lambda tol: segment_eval.boundary_scores(segment_eval.match_boundaries(truth, predicted, ["video_id"], tol)).collect()[0]
    assert score(1).f1 == 0.0
    assert score(3).f1 == 1.0 and score(3).matched == 2


def test_boundary_matching_is_maximal(spark):
    rnd = random.Random(11)
    for _ in range(3):
        t, p = sorted(rnd.sample(range(60), 12)), sorted(rnd.sample(range(60), 12))
        got = segment_eval.match_boundaries(frames(spark, t), frames(spark, p), ["video_id"], 2).collect()[0].matched
        best = [[0] * (len(p) + 1) for _ in range(len(t) + 1)]
        for i in range(len(t)):
            for j in range(len(p)):
                hit = best[i][j] + (abs(t[i] - p[j]) <= 2)
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], hit)
        assert got == best[-1][-1]


def test_assignment_is_optimal(spark):
    rnd = random.Random(4)

    def cuts():
        edges = [0, *sorted(rnd.sample(range(1, 40), 6)), 40]
        return [(a, b - 1) for a, b in zip(edges, edges[1:])]

    a, b = cuts(), cuts()
    iou = lambda x, y: max(0, min(x[1], y[1]) - max(x[0], y[0]) + 1) / (max(x[1], y[1]) - min(x[0], y[0]) + 1)
    rows = [(1, x[0], y[0], iou(x, y)) for x in a for y in b if min(x[1], y[1]) >= max(x[0], y[0])]
    pairs = spark.createDataFrame(rows, "video_id int, a_start int, b_start int, iou double")
    got = matching.best_segment_assignment(pairs, ["video_id"]).collect()
    assert len({r.a_start for r in got}) == len(got) == len({r.b_start for r in got})
    weight = {(x, y): w for _, x, y, w in rows}

    def best(i, used):
        if i == len(a):
            return 0.0
        skip = best(i + 1, used)
        return max([skip] + [weight[a[i][0], y[0]] + best(i + 1, used | {y}) for y in b if y not in used and (a[i][0], y[0]) in weight])

    assert abs(sum(r.iou for r in got) - best(0, frozenset())) < 1e-9


def test_greedy_match_keeps_order(spark):
    rows = [(1, 1, 10, 0.2), (1, 1, 11, 0.4), (1, 2, 10, 0.1), (1, 3, 10, 0.3), (1, 3, 11, 0.5)]
    pairs = spark.createDataFrame(rows, "frame int, g int, d int, cost double")
    got = {(r.g, r.d) for r in matching.greedy_per_group(pairs, ["frame"], "g", "d", "cost").collect()}
    assert got == {(1, 10), (3, 11)}


def test_hysteresis_needs_nested_limits(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1.0)], "video_id int, frame_index int, vz double, speed double")
    with pytest.raises(ValueError):
        segmentation.forward_states(df, ["video_id"], "frame_index", "vz", "speed", 1, 5, 4, 1, 1, 1, 1, 1, 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_consensus_is_the_best_path(spark, seed):
    import itertools
    import math

    rnd = random.Random(seed)
    states, least, n = ["a", "b", "c"], 2, 9
    rows = [(1, i, *[rnd.choice([0.0, 0.2, 0.5, 1.0]) for _ in states]) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, at int, a double, b double, c double")
    got = [r.state for r in sorted(segmentation.decode_consensus(df, ["k"], "at", states, least).collect(), key=lambda r: r["at"])]

    def value(path):
        out = 0.0
        for (_, _, *ev), s in zip(rows, path):
            total = sum(ev)
            share = ev[states.index(s)] / total if total else 1 / 3
            out += math.log(max(1e-12, share))
        return out

    def valid(path):
        return all(len(list(g)) >= least for _, g in itertools.groupby(path))

    best = max(value(p) for p in itertools.product(states, repeat=n) if valid(p))
    assert valid(got) and abs(value(got) - best) < 1e-9
