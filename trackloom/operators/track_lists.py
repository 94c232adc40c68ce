"""The strategies and measures of the repair search on whole tracks: observations in numpy columns, one track after the other.

These are the helpers of ``repair_search`` for tracks that Spark has gathered in a row each; what they find is judged and chosen there.
A null number is NaN here, a null label or source the code -1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

BOX = ["x1", "y1", "x2", "y2"]
PLACED = ["x", "z", *BOX]
COLUMNS = ["frame_index", "label", "source", "score", *PLACED]


class Lists:
    """Columns of lists that lie one after the other; list i has the rows edges[i] to edges[i + 1]."""

    def __init__(self, columns: dict[str, np.ndarray], edges: np.ndarray):
        self.columns, self.edges = columns, edges
        self.sizes = np.diff(edges)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.at = np.arange(len(self.owner)) - edges[self.owner]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def taken(self, lists: np.ndarray) -> Lists:
        sizes = self.sizes[lists]
        edges = _edges(sizes)
        rows = np.repeat(self.edges[lists] - edges[:-1], sizes) + np.arange(edges[-1])
        return Lists({k: v[rows] for k, v in self.columns.items()}, edges)

    def kept(self, rows: np.ndarray) -> Lists:
        return Lists({k: v[rows] for k, v in self.columns.items()}, _edges(np.bincount(self.owner[rows], minlength=len(self.sizes))))

    def changed(self, **columns: np.ndarray) -> Lists:
        return Lists({**self.columns, **columns}, self.edges)

    def earlier(self, values: np.ndarray, steps: np.ndarray | int = 1) -> np.ndarray:
        """The value so many rows before; rows that have no such row get their own."""
        rows = np.arange(len(self.at))
        return values[np.where(self.at >= steps, rows - steps, rows)]

    def folded(self, fold: np.ufunc, values: np.ndarray) -> np.ndarray:
        """One value per list; a list without rows has none."""
        out = np.zeros(len(self.sizes), values.dtype)
        some = self.sizes > 0
        if some.any():
            out[some] = fold.reduceat(values, self.edges[:-1][some])
        return out

    def counted(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[rows], minlength=len(self.sizes)).astype(np.int64)

    def mean(self, values: np.ndarray) -> np.ndarray:
        """Of the values that are there; NaN without any."""
        there = ~np.isnan(values)
        return _ratio(np.bincount(self.owner[there], values[there], len(self.sizes)), self.counted(there))

    def most(self, values: np.ndarray, otherwise: float) -> np.ndarray:
        out = self.folded(np.maximum, np.where(np.isnan(values), -np.inf, values))
        return np.where(np.isneginf(out) | (self.sizes == 0), otherwise, out)

    def median(self, values: np.ndarray) -> np.ndarray:
        there = np.flatnonzero(~np.isnan(values))
        order = there[np.lexsort((values[there], self.owner[there]))]
        counts = self.counted(there)
        first, last = _edges(counts)[:-1], len(order) - 1
        pick = lambda place: values[order[np.clip(first + place, 0, last)]] if last >= 0 else np.full(len(counts), np.nan)
        low, high = pick((counts - 1) // 2), pick(counts // 2)
        return np.where(counts > 0, low + (high - low) * 0.5, np.nan)


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / b


def joined(parts: Sequence[Lists], places: Sequence[np.ndarray]) -> Lists:
    """The lists of all parts, each at its place."""
    columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0].columns}
    both = Lists(columns, _edges(np.concatenate([p.sizes for p in parts])))
    return both.taken(np.argsort(np.concatenate(places)))


# strategies: the lists of one step and its parameters, one value per list


def relabelled(rows: Lists, given: dict[str, np.ndarray], split: bool = False) -> Lists:
    codes, top = rows["label"] + 1, int(rows["label"].max(initial=0)) + 2
    kinds, first, counts = np.unique(rows.owner * top + codes, return_index=True, return_counts=True)
    order = np.lexsort((first, -counts, kinds // top))
    best = order[np.unique(kinds[order] // top, return_index=True)[1]]
    dominant = np.full(len(rows.sizes), -1)
    dominant[kinds[best] // top] = kinds[best] % top - 1
    own = dominant[rows.owner]
    return rows.kept(rows["label"] == own) if split else rows.changed(label=own)


def interpolated(rows: Lists, given: dict[str, np.ndarray], repaired: int) -> Lists:
    following = np.minimum(np.arange(len(rows.at)) + 1, max(0, len(rows.at) - 1))
    gap = np.where(rows.at + 1 < rows.sizes[rows.owner], rows["frame_index"][following] - rows["frame_index"], 1)
    made = np.where((gap > 1) & (gap <= given["maximum_gap"][rows.owner]), gap, 1).astype(np.int64)
    source = np.repeat(np.arange(len(made)), made)
    k = np.arange(len(source)) - _edges(made)[:-1][source]
    share = k / gap[source]
    columns = {c: v[source] for c, v in rows.columns.items()}
    for c in PLACED:
        columns[c] = np.where(k > 0, columns[c] + share * (rows[c][following][source] - columns[c]), columns[c])
    columns["frame_index"] = columns["frame_index"] + k
    columns["source"] = np.where(k > 0, repaired, columns["source"])
    return Lists(columns, _edges(rows.folded(np.add, made)))


def smoothed(rows: Lists, given: dict[str, np.ndarray]) -> Lists:
    alpha = given["alpha"]

    def one_way(values: np.ndarray, places) -> np.ndarray:
        out, state = np.empty_like(values), np.full(len(rows.sizes), np.nan)
        for lists, here in places:
            value, before = values[here], state[lists]
            state[lists] = np.where(np.isnan(value), before, np.where(np.isnan(before), value, alpha[lists] * value + (1 - alpha[lists]) * before))
            out[here] = state[lists]
        return out

    places, lists = [], np.arange(len(rows.sizes))
    for p in range(int(rows.sizes.max(initial=0))):
        lists = lists[rows.sizes[lists] > p]
        places.append((lists, rows.edges[lists] + p))
    back = [(n, rows.edges[n + 1] - 1 - (h - rows.edges[n])) for n, h in places]
    out = {}
    for axis in ("x", "z"):
        forward = one_way(rows[axis], places)
        out[axis] = (forward + one_way(forward, back)) / 2
    return rows.changed(**out)


def lined(rows: Lists, given: dict[str, np.ndarray], equal: float) -> Lists:
    """Every axis on the line of its points, fitted again without far points until none is far."""
    out = {}
    for axis in ("x", "z"):
        there = ~np.isnan(rows[axis])
        points = rows.kept(there)
        slope, base, fitted = np.zeros(len(rows.sizes)), np.zeros(len(rows.sizes)), np.zeros(len(rows.sizes), bool)
        lists = np.flatnonzero(points.sizes > 0)
        points = points.taken(lists)
        while len(lists):
            f, v, own = points["frame_index"].astype(float), points[axis], points.owner
            mf, mv = points.mean(f), points.mean(v)
            df, dv = f - mf[own], v - mv[own]
            total = lambda x, own=own, n=len(lists): np.bincount(own, x, n)
            steep = total(df * dv) / np.maximum(1e-9, total(df * df))
            slope[lists], base[lists], fitted[lists] = steep, mv - steep * mf, points.sizes >= 2
            rest = np.round(v - (base[lists][own] + steep[own] * f), 9)
            spread = points.median(np.abs(rest - points.median(rest)[own]))
            near = np.abs(rest) <= np.maximum(1e-6, given["residual_clip_mad"][lists] * spread)[own] + equal
            count = points.counted(near)
            again = np.flatnonzero((count >= 2) & (count < points.sizes))
            lists, points = lists[again], points.kept(near).taken(again)
        line = base[rows.owner] + slope[rows.owner] * rows["frame_index"]
        out[axis] = np.where(there & fitted[rows.owner], line, rows[axis])
    return rows.changed(**out)


def _around(rows: Lists, values: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Median of the values at most ``radius`` rows away."""
    reach = int(radius.max(initial=0))
    window = np.full((len(values), 2 * reach + 1), np.nan)
    places, size, wide = np.arange(len(values)), rows.sizes[rows.owner], radius[rows.owner]
    for d in range(-reach, reach + 1):
        ok = (abs(d) <= wide) & (rows.at + d >= 0) & (rows.at + d < size)
        window[ok, d + reach] = values[places[ok] + d]
    window.sort(axis=1)
    n = (~np.isnan(window)).sum(axis=1)
    low, high = window[places, np.maximum(0, (n - 1) // 2)], window[places, np.minimum(n // 2, 2 * reach)]
    return np.where(n > 0, (low + high) / 2, np.nan)


def without_outliers(rows: Lists, given: dict[str, np.ndarray]) -> Lists:
    out = {}
    for axis in ("x", "z"):
        base = _around(rows, rows[axis], given["median_radius"])
        off = rows[axis] - base
        spread = rows.median(np.abs(off - rows.median(off)[rows.owner]))
        limit = given["mad_scale"] * np.fmax(1e-6, spread)
        out[axis] = np.where(np.abs(off) > limit[rows.owner], base, rows[axis])
    return rows.changed(**out)


def with_stable_box(rows: Lists, given: dict[str, np.ndarray]) -> Lists:
    x1, y1, x2, y2 = (rows[b] for b in BOX)
    cx, cy, w, h = (_around(rows, v, given["median_radius"]) for v in ((x1 + x2) / 2, (y1 + y2) / 2, np.abs(x2 - x1), np.abs(y2 - y1)))
    return rows.changed(x1=cx - w / 2, y1=cy - h / 2, x2=cx + w / 2, y2=cy + h / 2)


# measures


class Egos:
    """The ego motion of each list's video by frame; a frame without one stands still."""

    def __init__(self, lists: Lists):
        self.lists = lists

    def of(self, rows: Lists, tracks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = matched(self.lists, rows, tracks)
        return tuple(np.where(found >= 0, self.lists[k][found], 0.0) if len(self.lists.owner) else np.zeros(len(found)) for k in ("ego_vx", "ego_vz"))


def matched(held: Lists, rows: Lists, tracks: np.ndarray) -> np.ndarray:
    """The row of ``held`` with the frame of each of ``rows``, whose list i belongs to list tracks[i] of ``held``; -1 without one."""
    if not len(held.owner) or not len(rows.owner):
        return np.full(len(rows.owner), -1)
    low = min(held["frame_index"].min(), rows["frame_index"].min())
    wide = max(held["frame_index"].max(), rows["frame_index"].max()) - low + 1
    keys, wanted = held.owner * wide + held["frame_index"] - low, tracks[rows.owner] * wide + rows["frame_index"] - low
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def velocities(rows: Lists, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Velocity over ``window`` rows, fewer at the start; the first row stands still."""
    back = np.minimum(rows.at, window[rows.owner])
    hop = np.maximum(1, rows["frame_index"] - rows.earlier(rows["frame_index"], back))
    return tuple(np.where(rows.at > 0, (rows[a] - rows.earlier(rows[a], back)) / hop, 0.0) for a in ("x", "z"))


FACTS = {
    "n": "bigint", "observations": "bigint", "labels": "int", "max_gap": "bigint", "gaps": "bigint", "motion_ratio": "double", "behind": "bigint",
    "max_center_ratio": "double", "max_size_ratio": "double", "max_depth_step": "double", "max_speed": "double", "max_velocity_change": "double",
    "reversals": "bigint", "repaired": "bigint", "merged": "bigint", "repaired_ratio": "double", "merged_ratio": "double", "mean_score": "double",
}


def facts(rows: Lists, window: np.ndarray, ego: tuple[np.ndarray, np.ndarray], repaired: int, merged: int) -> dict[str, np.ndarray]:
    """What the reality checks and the cost read, one value per list, as ``repair_search.facts`` has it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vz = velocities(rows, window)
        ex, ez = ego
        has, both = rows.at > 0, rows.at > 1
        before = {k: np.where(has, rows.earlier(rows[k]), np.nan) for k in ("frame_index", "z", *BOX)}
        step = rows["frame_index"] - before["frame_index"]
        hop = np.fmax(1, step)
        dz = (rows["z"] - before["z"]) / hop
        norm = lambda a, b: np.sqrt(a * a + b * b)
        # the ego sign convention with the lower residual, speed first
        options = []
        for sign in (-1, 1):
            ax, az = vx + sign * ex, vz + sign * ez
            wx, wz = rows.earlier(ax), rows.earlier(az)
            if sign < 0:
                quick = (norm(ax, az) > 0.3) & (norm(wx, wz) > 0.3)
                reversals = both & quick & (ax * wx + az * wz < 0)
            options.append((rows.most(np.where(has, norm(ax, az), np.nan), 0.0), rows.most(np.where(both, norm(ax - wx, az - wz), np.nan), 0.0)))
        (minus, minus_change), (plus, plus_change) = options
        first = (minus < plus) | ((minus == plus) & (minus_change <= plus_change))
        width, height = rows["x2"] - rows["x1"], rows["y2"] - rows["y1"]
        b_width, b_height = before["x2"] - before["x1"], before["y2"] - before["y1"]
        middle = norm((rows["x1"] + rows["x2"] - before["x1"] - before["x2"]) / 2, (rows["y1"] + rows["y2"] - before["y1"] - before["y2"]) / 2) / hop
        diagonal = np.fmax(1.0, (norm(width, height) + norm(b_width, b_height)) / 2)
        size = lambda v: np.maximum(1e-6, np.abs(v))
        ratio = lambda p, q: np.fmax(size(p) / size(q), size(q) / size(p))
        sizes = np.fmax(np.fmax(ratio(width, b_width), ratio(height, b_height)), ratio(width * height, b_width * b_height))
        depth = np.fmin(np.fmin(np.abs(dz), np.abs(dz - ez)), np.abs(dz + ez))
        known = rows["label"] >= 0
        low, high = rows.folded(np.minimum, np.where(known, rows["label"], np.iinfo(np.int64).max)), rows.folded(np.maximum, rows["label"])
        share = lambda code: rows.mean(np.where(rows["source"] >= 0, (rows["source"] == code).astype(float), np.nan))
        return {
            "n": rows.sizes, "observations": rows.sizes, "labels": np.where((high >= 0) & (low != high), 2, 1),
            "max_gap": rows.most(step, 0.0).astype(np.int64), "gaps": rows.counted(step > 1), "motion_ratio": rows.mean(has.astype(float)),
            "behind": rows.counted((rows["z"] < 0) | (width <= 0) | (height <= 0)), "max_center_ratio": rows.most(middle / diagonal, 0.0),
            "max_size_ratio": rows.most(sizes, 1.0), "max_depth_step": rows.most(depth, 0.0), "max_speed": np.where(first, minus, plus),
            "max_velocity_change": np.where(first, minus_change, plus_change), "reversals": rows.counted(reversals),
            "repaired": rows.counted(rows["source"] == repaired), "merged": rows.counted(rows["source"] == merged),
            "repaired_ratio": share(repaired), "merged_ratio": share(merged), "mean_score": rows.mean(rows["score"]),
        }


def side_by_side(first: Lists, after: Lists, tracks: np.ndarray, window: np.ndarray, equal: float) -> dict[str, np.ndarray]:
    """Of every row after a repair: its velocity, the original row of its frame (or -1), and whether it differs from it."""
    vx, vz = velocities(after, window)
    found = matched(first, after, tracks)
    was_x, was_z = velocities(first, np.ones(len(first.sizes), np.int64))
    same = (found >= 0) & (after["label"] == first["label"][found])
    for a, b in [*[(after[k], first[k]) for k in PLACED], (vx, was_x), (vz, was_z)]:
        b = b[found]
        same &= (np.abs(a - b) <= equal) | (np.isnan(a) & np.isnan(b))
    return {"obj_vx": vx, "obj_vz": vz, "original": found, "modified": ~same}


COMPARED = {"matched": "bigint", "modified_frames": "bigint", "first_modified": "int", "last_modified": "int", "rmse": "double"}


def compared(first: Lists, after: Lists, beside: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    found, modified = beside["original"], beside["modified"]
    squared = np.where(found >= 0, (after["x"] - first["x"][found]) ** 2 + (after["z"] - first["z"][found]) ** 2, np.nan)
    frame, none = after["frame_index"].astype(float), after.counted(modified) == 0
    rmse = np.sqrt(after.mean(squared))
    return {
        "matched": after.counted(found >= 0), "modified_frames": after.counted(modified),
        "first_modified": np.where(none, np.nan, after.folded(np.minimum, np.where(modified, frame, np.inf))),
        "last_modified": np.where(none, np.nan, after.folded(np.maximum, np.where(modified, frame, -np.inf))),
        "rmse": np.where(np.isnan(rmse), 0.0, rmse),
    }


# Arrow


def edges_of(lists: pa.ListArray) -> np.ndarray:
    return _edges(np.asarray(lists.value_lengths().fill_null(0)))


def numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).copy()


class Texts:
    """Codes of the texts of a column; -1 is null."""

    def __init__(self, column: pa.Array, *more: str):
        texts = pa.concat_arrays([column.cast(pa.string()), pa.array(more, pa.string())]).dictionary_encode()
        codes = np.asarray(texts.indices.fill_null(-1)).astype(np.int64)
        self.dictionary, self.codes, self.more = texts.dictionary, codes[: len(column)], codes[len(column) :].tolist()

    def of(self, codes: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32(), mask=codes < 0), self.dictionary).cast(pa.string())


class Tracks:
    """A batch of gathered tracks."""

    def __init__(self, lists: pa.ListArray):
        fields = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten(), strict=True))
        self.labels, self.sources = Texts(fields["label"]), Texts(fields["source"], "repaired", "merged")
        columns = {"label": self.labels.codes, "source": self.sources.codes, "frame_index": np.asarray(fields["frame_index"]).astype(np.int64)}
        columns |= {k: numbers(fields[k]) for k in ("score", *PLACED)}
        self.rows = Lists({k: columns[k] for k in COLUMNS}, edges_of(lists))

    def measured(self, rows: Lists, window: np.ndarray, egos: Egos, tracks: np.ndarray) -> dict[str, np.ndarray]:
        return facts(rows, window, egos.of(rows, tracks), *self.sources.more)


def egos_of(lists: pa.ListArray) -> Egos:
    fields = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten(), strict=True))
    columns = {"frame_index": np.asarray(fields["frame_index"]).astype(np.int64)} | {k: numbers(fields[k]) for k in ("ego_vx", "ego_vz")}
    return Egos(Lists({k: np.nan_to_num(v) if k != "frame_index" else v for k, v in columns.items()}, edges_of(lists)))


def after_plans(tracks: Tracks, owners: np.ndarray, plans: pa.ListArray, equal: float) -> tuple[Lists, np.ndarray]:
    """The rows of the track ``owners[i]`` after plan i, a list of steps, and the window of each plan's velocities."""
    steps, edges = plans.flatten(), edges_of(plans)
    fields = dict(zip([f.name for f in plans.type.value_type], steps.flatten(), strict=True))
    names = np.array(fields.pop("strategy").to_pylist(), object)
    given = {k: numbers(v) for k, v in fields.items()}
    repaired = tracks.sources.more[0]
    strategies = {
        "track_split": lambda r, g: relabelled(r, g, split=True), "fragment_reassociation": relabelled,
        "gap_interpolation": lambda r, g: interpolated(r, g, repaired), "kalman_smoothing": smoothed,
        "robust_polynomial_regression": lambda r, g: lined(r, g, equal), "outlier_removal": without_outliers,
        "depth_reestimation": without_outliers, "bbox_stabilization": with_stable_box,
        "multi_frame_velocity_recomputation": lambda r, g: r,  # its velocities are taken over the window
    }
    depth, rows = np.diff(edges), tracks.rows.taken(owners)
    for turn in range(int(depth.max(initial=0))):
        parts, places = [rows.taken(np.flatnonzero(depth <= turn))], [np.flatnonzero(depth <= turn)]
        open_ = np.flatnonzero(depth > turn)
        now = names[edges[open_] + turn]
        for name in sorted(set(now)):
            plan = open_[now == name]
            parts.append(strategies[name](rows.taken(plan), {k: v[edges[plan] + turn] for k, v in given.items()}))
            places.append(plan)
        rows = joined(parts, places)
    window = np.ones(len(depth))
    np.fmax.at(window, np.repeat(np.arange(len(depth)), depth), given["window"])
    return rows, window.astype(np.int64)


def structs(columns: dict[str, np.ndarray], kinds: dict[str, str]) -> pa.StructArray:
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    arrays = []
    for k, kind in kinds.items():
        v, null = columns[k], np.isnan(columns[k]) if columns[k].dtype.kind == "f" else None
        arrays.append(pa.array(np.where(null, 0, v) if null is not None and kind != "double" else v, types[kind], mask=null) if null is not None else pa.array(v, types[kind]))
    return pa.StructArray.from_arrays(arrays, [*kinds])
