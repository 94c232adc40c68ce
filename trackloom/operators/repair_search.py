"""Repair search: every strategy tried on every rejected track, costs before and after, one choice per track, and its result.

Rows are observations: video_id, track_id, frame_index, label, source, score, x, z and a box x1, y1, x2, y2.  A candidate is one more
part of the key of a track, so all candidates of all tracks go through the same shuffles, and a long track is cut into chunks as
everywhere else.  Nulls in x, z or the box leave the tests that need them out; a track of one row keeps its values; without rejected
tracks the results are empty.

Candidates are ten times the rows, so tracks that fit in a row go another way, ``gathered``, ``tried`` and ``repaired``: the whole search happens
beside the gathered track, and no row of a candidate is ever shuffled or written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.geometry import norm
from trackloom.operators import quality, track_lists
from trackloom.operators.lineage import checkpointed
from trackloom.operators.ordered import by_step, following, near, row_number
from trackloom.operators.quantiles import quantiles
from trackloom.operators.repair import two_way_smoothing

TRACK = ["video_id", "track_id"]
BOX = ["x1", "y1", "x2", "y2"]
OBSERVED = ["frame_index", "label", "source", "score", "x", "z", *BOX]
SPAN = 8192

# Fixed values
STRATEGIES = {
    "track_split": {},
    "fragment_reassociation": {},
    "gap_interpolation": {"maximum_gap": 12},
    "kalman_smoothing": {"alpha": 0.55},
    "robust_polynomial_regression": {"residual_clip_mad": 3.0},
    "outlier_removal": {"median_radius": 2, "mad_scale": 3.0},
    "bbox_stabilization": {"median_radius": 2},
    "depth_reestimation": {"median_radius": 2, "mad_scale": 2.5},
    "multi_frame_velocity_recomputation": {"window": 3},
}
ADDRESSED = {
    "id_switch": ["track_split", "fragment_reassociation"],
    "trajectory_discontinuity": [],
    "track_drift": ["outlier_removal"],
    "bbox_jump": ["outlier_removal"],
    "depth_jump": ["outlier_removal"],
    "speed_abnormal_change": ["outlier_removal"],
    "motion_direction_abrupt_change": ["outlier_removal"],
}
IMPROVEMENT_MARGIN = 8.0
SEVERITY_COST = 35.0
CUE_CAP = 25.0
#: Values of repaired rows that differ by less are the same value.
EQUAL = 1e-9
SEVERITY = {"valid": 0, "repaired": 0, "uncertain": 1, "invalid": 3}

PARAMETERS = {"maximum_gap": "int", "alpha": "double", "residual_clip_mad": "double", "median_radius": "int", "mad_scale": "double", "window": "int"}
#: Bytes of gathered tracks that go to Python together; their candidates are ten times as many.
BATCH_BYTES = 4 << 20
#: Name of the candidate that applies all strategies of a track's reasons one after the other.
IN_ORDER = "in_order"
c = F.col


def step(strategy: str, parameters: dict | None = None) -> Column:
    """One strategy with its parameters as a struct."""
    given = {**STRATEGIES[strategy], **(parameters or {})}
    return F.struct(F.lit(strategy).alias("strategy"), *[F.lit(given.get(p)).cast(t).alias(p) for p, t in PARAMETERS.items()])


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _dominant(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most frequent label of each track, of equal ones the one seen first."""
    counts = rows.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.min("frame_index").alias("first"))
    return counts.groupBy(*keys).agg(F.max_by("label", F.struct("n", (-c("first")).alias("first"))).alias("dominant"))


def _relabelled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = rows.join(_dominant(rows, keys), list(keys))
    return known.filter((c("strategy") != "track_split") | c("label").eqNullSafe(c("dominant"))).withColumn("label", c("dominant")).drop("dominant")


def _interpolated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the missing frames between two neighbours that are at most maximum_gap frames apart."""
    seen = by_step(keys, "frame_index", SPAN).scan(rows, __next=following(F.struct("frame_index", "x", "z", *BOX)))
    gap = c("__next.frame_index") - c("frame_index")
    missing = F.when((gap > 1) & (gap <= c("maximum_gap")), F.sequence(F.lit(0), (gap - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    each = seen.withColumn("__k", F.explode(missing))
    inserted, share = c("__k") > 0, c("__k") / gap
    moved = {v: F.when(inserted, c(v) + share * (c(f"__next.{v}") - c(v))).otherwise(c(v)) for v in ("x", "z", *BOX)}
    made = {"frame_index": (c("frame_index") + c("__k")).cast(rows.schema["frame_index"].dataType), "source": F.when(inserted, "repaired").otherwise(c("source"))}
    return each.withColumns({**moved, **made}).drop("__next", "__k")


def _numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return by_step(keys, "frame_index", SPAN).scan(rows, __at=row_number())


def _smoothed(rows: DataFrame, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    numbered, out = _numbered(rows, keys), None
    for alpha in alphas:
        some = numbered.filter(c("alpha") == alpha)
        for axis in ("x", "z"):
            some = two_way_smoothing(some, keys, "__at", axis, alpha).withColumn(axis, c("smoothed")).drop("smoothed")
        out = some if out is None else out.unionByName(some)
    return out.drop("__at")


def _by_axis(rows: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """One row per axis of the plane; ``columns`` name triples of (result, column of x, column of z)."""
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), *[c(col.format(a)).cast("double").alias(col.format("v")) for col in columns]) for a in ("x", "z")])
    return rows.select(*keys, "frame_index", "residual_clip_mad", F.explode(sides).alias("s")).select(*keys, "frame_index", "residual_clip_mad", "s.*")


def _spread(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median absolute deviation of each group around its median."""
    middle = quantiles(rows, keys, value, middle=0.5)
    off = rows.join(middle, list(keys)).select(*keys, F.abs(c(value) - c("middle")).alias("off"))
    return quantiles(off, keys, "off", mad=0.5)


def _lined(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x and z on the least-squares line over frames, refitted without far rows until none is far.

    A round works on the axes that lost rows in the round before; the driver sees one number a round.  Every frame of the track is put
    on the last line, also those that the fit left out.
    """
    keys, axis = list(keys), [*keys, "axis"]
    points = checkpointed(_by_axis(rows, keys, "{}").filter("v is not null"))
    open_points, lines = points, []
    while not lines or not again.isEmpty():
        sums = open_points.groupBy(*axis).agg(
            F.count("*").alias("n"), F.avg("frame_index").alias("mf"), F.avg("v").alias("mv"),
            (F.covar_pop(c("frame_index").cast("double"), c("v")) * F.count("*")).alias("sxy"), (F.var_pop("frame_index") * F.count("*")).alias("sxx"),
        )
        slope = c("sxy") / F.greatest(F.lit(1e-9), c("sxx"))
        fits = sums.select(*axis, "n", slope.alias("slope"), (c("mv") - slope * c("mf")).alias("base"))
        # settled digits, so that equal distances stay equal
        with_rest = checkpointed(open_points.join(fits, axis).withColumn("rest", F.round(c("v") - (c("base") + c("slope") * c("frame_index")), 9)))
        far = F.abs("rest") > F.greatest(F.lit(1e-6), c("residual_clip_mad") * c("mad")) + EQUAL
        judged = with_rest.join(_spread(with_rest, axis, "rest"), axis).withColumn("near", ~far)
        counted = judged.groupBy(*axis).agg(F.count_if("near").alias("kept"), *[F.max(x).alias(x) for x in ("n", "slope", "base", "mad")])
        counted = checkpointed(counted.withColumn("open", (c("kept") >= 2) & (c("kept") < c("n"))))
        lines.append(counted.filter(~c("open")).select(*axis, "n", "slope", "base"))
        again = counted.filter("open").select(*axis, "mad")
        open_points = with_rest.join(again, axis).filter(~far).select(*points.columns)
    lines = reduce(DataFrame.unionByName, lines)
    fitted = points.join(lines, axis).select(*axis, "frame_index", F.when(c("n") >= 2, c("base") + c("slope") * c("frame_index")).otherwise(c("v")).alias("v"))
    both = fitted.groupBy(*keys, "frame_index").agg(F.max(F.when(c("axis") == "x", c("v"))).alias("__x"), F.max(F.when(c("axis") == "z", c("v"))).alias("__z"))
    joined = rows.join(both, [*keys, "frame_index"], "left")
    return joined.withColumns({"x": F.coalesce("__x", "x"), "z": F.coalesce("__z", "z")}).drop("__x", "__z")


def _median_filtered(rows: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Far values replaced by the median around them, boxes by the median of centre and size around them."""
    keys = list(keys)
    box = {"__cx": (c("x1") + c("x2")) / 2, "__cy": (c("y1") + c("y2")) / 2, "__w": F.abs(c("x2") - c("x1")), "__h": F.abs(c("y2") - c("y1"))}
    own = F.least(c("__at"), F.lit(reach + 1)).cast("int")
    start = F.greatest(F.lit(1), own - c("median_radius"))

    def around(column: str):
        # a null keeps its place in the list
        seen = lambda w: F.slice(F.collect_list(F.struct(c(column).alias("v"))).over(w.rowsBetween(-reach, reach)), start, own + c("median_radius") - start + 1)
        return lambda w: _median(F.filter(F.transform(seen(w), lambda r: r["v"]), lambda v: v.isNotNull()))

    series = {"x": "__bx", "z": "__bz", **{b: f"__m{b}" for b in box}}
    seen = near(_numbered(rows.withColumns(box), keys), keys, "__at", reach, **{to: around(of) for of, to in series.items()})
    boxed = c("strategy") == "bbox_stabilization"
    stable = {"x1": c("__m__cx") - c("__m__w") / 2, "y1": c("__m__cy") - c("__m__h") / 2, "x2": c("__m__cx") + c("__m__w") / 2, "y2": c("__m__cy") + c("__m__h") / 2}
    seen = checkpointed(seen.withColumns({"__rx": c("x") - c("__bx"), "__rz": c("z") - c("__bz")}))
    spread = _spread(_by_axis(seen.filter(~boxed), keys, "__r{}"), [*keys, "axis"], "__rv")
    limits = spread.groupBy(*keys).agg(F.max(F.when(c("axis") == "x", c("mad"))).alias("__sx"), F.max(F.when(c("axis") == "z", c("mad"))).alias("__sz"))
    far = lambda a: F.abs(c(f"__r{a}")) > c("mad_scale") * F.greatest(F.lit(1e-6), c(f"__s{a}"))
    out = seen.join(limits, keys, "left").withColumns({
        **{a: F.when(~boxed & far(a), c(f"__b{a}")).otherwise(c(a)) for a in ("x", "z")},
        **{b: F.when(boxed, v).otherwise(c(b)) for b, v in stable.items()},
    })
    return out.select(*rows.columns)


def applied(rows: DataFrame, keys: Sequence[str], variants: Sequence[tuple[str, dict]]) -> DataFrame:
    """Rows after the strategy that each of them carries; ``rows`` has the columns of ``step`` and ``keys`` names one candidate.

    ``variants`` lists the strategies with parameters that may occur.
    """
    rows = checkpointed(rows)
    used = {s: [{**STRATEGIES[s], **p} for t, p in variants if t == s] for s, _ in variants}
    is_any = lambda *names: c("strategy").isin(*names)
    parts = [rows.filter(is_any("multi_frame_velocity_recomputation"))]  # its velocities are recomputed by ``moved``
    if used.keys() & {"track_split", "fragment_reassociation"}:
        parts.append(_relabelled(rows.filter(is_any("track_split", "fragment_reassociation")), keys))
    if "gap_interpolation" in used:
        parts.append(_interpolated(rows.filter(is_any("gap_interpolation")), keys))
    if "kalman_smoothing" in used:
        parts.append(_smoothed(rows.filter(is_any("kalman_smoothing")), keys, sorted({p["alpha"] for p in used["kalman_smoothing"]})))
    if "robust_polynomial_regression" in used:
        parts.append(_lined(rows.filter(is_any("robust_polynomial_regression")), keys))
    filtered = ["outlier_removal", "depth_reestimation", "bbox_stabilization"]
    radii = [p["median_radius"] for s in filtered for p in used.get(s, [])]
    if radii:
        parts.append(_median_filtered(rows.filter(is_any(*filtered)), keys, max(radii)))
    return reduce(DataFrame.unionByName, [part.select(*rows.columns) for part in parts])


def moved(rows: DataFrame, keys: Sequence[str], ego: DataFrame, longest: int = 1) -> DataFrame:
    """Rows with their velocity over ``window`` rows (at most ``longest``, fewer at the start) and with the row before.

    A frame without ego motion counts as standing still.
    """
    spot = lambda: F.struct("frame_index", "x", "z")
    known = rows.join(ego.select("video_id", "frame_index", "ego_vx", "ego_vz"), ["video_id", "frame_index"], "left").na.fill(0.0, ["ego_vx", "ego_vz"])
    back = lambda w: F.coalesce(*[F.when(c("window") >= n, F.lag(spot(), n).over(w)) for n in range(longest, 1, -1)], F.lag(spot()).over(w))
    seen = near(
        _numbered(known, keys), keys, "__at", longest + 1,
        __from=back, __before=lambda w: F.lag(F.struct("frame_index", "x", "z", "ego_vx", "ego_vz", *BOX)).over(w),
        then={"__before_from": lambda w: F.lag("__from").over(w)},
    )
    speed = lambda here, start, a: (c(f"{here}{a}") - c(f"{start}.{a}")) / F.greatest(F.lit(1), c(f"{here}frame_index") - c(f"{start}.frame_index"))
    moving = {f"obj_v{a}": F.when(c("__from").isNotNull(), speed("", "__from", a)).otherwise(0.0) for a in ("x", "z")}
    earlier = {f"__obj_v{a}": speed("__before.", "__before_from", a) for a in ("x", "z")}
    return seen.withColumns({**moving, **earlier, "has_rel_motion": c("__from").isNotNull()}).drop("__at", "__from")


def facts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the reality checks and the cost read, one row per track; ``rows`` come from ``moved``."""
    b = lambda n: c(f"__before.{n}")
    hop = F.greatest(F.lit(1), c("frame_index") - b("frame_index"))
    dz = (c("z") - b("z")) / hop
    both = c("has_rel_motion") & c("__before_from").isNotNull()
    at = lambda sign, a: c(f"obj_v{a}") + sign * c(f"ego_v{a}")
    was = lambda sign, a: c(f"__obj_v{a}") + sign * b(f"ego_v{a}")
    zero = lambda column: F.coalesce(column, F.lit(0.0))
    change = lambda sign: zero(F.max(F.when(both, norm(at(sign, "x") - was(sign, "x"), at(sign, "z") - was(sign, "z")))))
    speed = lambda sign: zero(F.max(F.when(c("has_rel_motion"), norm(at(sign, "x"), at(sign, "z")))))
    dot = at(-1, "x") * was(-1, "x") + at(-1, "z") * was(-1, "z")
    quick = (norm(at(-1, "x"), at(-1, "z")) > 0.3) & (norm(was(-1, "x"), was(-1, "z")) > 0.3)
    width, height = c("x2") - c("x1"), c("y2") - c("y1")
    b_width, b_height = b("x2") - b("x1"), b("y2") - b("y1")
    middle = norm((c("x1") + c("x2") - b("x1") - b("x2")) / 2, (c("y1") + c("y2") - b("y1") - b("y2")) / 2) / hop
    diagonal = F.greatest(F.lit(1.0), (norm(width, height) + norm(b_width, b_height)) / 2)
    size = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(1e-6), F.abs(v)))
    ratio = lambda p, q: F.greatest(size(p) / size(q), size(q) / size(p))
    share = lambda kind: F.avg((c("source") == kind).cast("double"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("*").alias("observations"),
        F.when(F.min("label") != F.max("label"), 2).otherwise(1).alias("labels"),
        F.coalesce(F.max(c("frame_index") - b("frame_index")), F.lit(0)).alias("max_gap"),
        F.count_if(c("frame_index") - b("frame_index") > 1).alias("gaps"),
        F.avg(c("has_rel_motion").cast("double")).alias("motion_ratio"),
        F.count_if((c("z") < 0) | (width <= 0) | (height <= 0)).alias("behind"),
        zero(F.max(middle / diagonal)).alias("max_center_ratio"),
        F.coalesce(F.max(F.greatest(ratio(width, b_width), ratio(height, b_height), ratio(width * height, b_width * b_height))), F.lit(1.0)).alias("max_size_ratio"),
        zero(F.max(F.when(dz.isNotNull(), F.least(F.abs(dz), F.abs(dz - c("ego_vz")), F.abs(dz + c("ego_vz")))))).alias("max_depth_step"),
        F.struct(speed(-1).alias("speed"), change(-1).alias("change")).alias("minus"),
        F.struct(speed(1).alias("speed"), change(1).alias("change")).alias("plus"),
        F.count_if(both & quick & (dot < 0)).alias("reversals"),
        F.count_if(c("source") == "repaired").alias("repaired"),
        F.count_if(c("source") == "merged").alias("merged"),
        share("repaired").alias("repaired_ratio"),
        share("merged").alias("merged_ratio"),
        F.avg("score").alias("mean_score"),
    )
    best = F.least(c("minus"), c("plus"))
    return out.withColumns({"max_speed": best["speed"], "max_velocity_change": best["change"]}).drop("minus", "plus")


def evaluated(rows: DataFrame, keys: Sequence[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """Status, rejections, doubts and issue cost of each track."""
    return judged(facts(rows, keys), keys, thresholds)


def judged(facts: DataFrame, keys: Sequence[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    from trackloom.operators.tracks import track_uncertainty

    checked = quality.reality_checks(facts, thresholds)
    unsure = track_uncertainty(checked, 0.35 * c("repaired_ratio") + 0.2 * c("merged_ratio"))
    capped = lambda column: F.least(F.lit(CUE_CAP), column)
    cost = (
        SEVERITY_COST * (SEVERITY["invalid"] * F.size("rejections") + SEVERITY["uncertain"] * F.size("doubts"))
        + capped(4 * c("max_center_ratio")) + capped(c("max_depth_step")) + capped(c("max_velocity_change")) + capped(c("max_speed"))
        + 15 * unsure
    )
    return checked.select(*keys, "n", "status", "rejections", "doubts", cost.alias("cost"), unsure.alias("uncertainty"))


def candidate_plans(rejected: DataFrame, strategies: Sequence[str], addressed: dict[str, list[str]]) -> DataFrame:
    """The steps of every candidate of every rejected track: each strategy alone, and all that its reasons call for in order.

    The last one exists where the reasons call for two or more.  ``rank`` orders the candidates of a track.
    """
    return rejected.select(*TRACK, F.explode(_listed(rejected, strategies, addressed)).alias("p")).select(*TRACK, "p.*")


def _listed(rejected: DataFrame, strategies: Sequence[str], addressed: dict[str, list[str]]) -> Column:
    single = [F.struct(F.lit(i + 1).alias("rank"), F.lit(s).alias("candidate"), F.array(step(s)).alias("plan")) for i, s in enumerate(strategies)]
    called: dict[str, list[str]] = {}
    for reason, names in addressed.items():
        for s in names:
            called.setdefault(s, []).append(reason)
    has = lambda reasons: F.arrays_overlap("rejections", F.array(*map(F.lit, reasons)))
    chain = F.array_compact(F.array(*[F.when(has(reasons), step(s)) for s, reasons in called.items()]))
    together = F.struct(F.lit(len(single) + 1).alias("rank"), F.lit(IN_ORDER).alias("candidate"), chain.alias("plan"))
    return F.concat(F.array(*single), F.when(F.size(chain) > 1, F.array(together)).otherwise(F.array().cast("array<" + _plan_type(rejected, together) + ">")))


def _plan_type(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("t")).schema["t"].dataType.simpleString()


def repair_candidates(
    observations: DataFrame,
    ego: DataFrame,
    strategies: Sequence[str] = tuple(STRATEGIES),
    addressed: dict[str, list[str]] | None = None,
    calibration: DataFrame | None = None,
    thresholds: dict[str, float] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, their rows, all original rows with motion) of the tracks with a rejection.

    A candidate is accepted if it lowers the cost by the margin, loses no row, brings no new rejection and no worse status.  Its score is
    the cost after plus, for each of its steps, what the calibration (strategy, success_rate, reconstruction_error) holds against it;
    a strategy without calibration counts as never successful.
    """
    addressed = ADDRESSED if addressed is None else addressed
    chained = {s for names in addressed.values() for s in names}
    variants = [(s, {}) for s in STRATEGIES if s in chained or s in strategies]
    longest = max([STRATEGIES[s].get("window", 1) for s, _ in variants], default=1)
    keys = [*TRACK, "candidate"]
    first = checkpointed(moved(observations.select(*TRACK, *OBSERVED).withColumn("window", F.lit(1)), TRACK, ego))
    before = checkpointed(evaluated(first, TRACK, thresholds))
    plans = checkpointed(candidate_plans(before.filter(F.size("rejections") > 0), strategies, addressed))
    rows = first.select(*TRACK, *OBSERVED).join(plans.select(*keys, "plan"), TRACK)
    turn, parts = rows, []
    while not parts or not turn.isEmpty():
        now = turn.withColumn("s", c("plan")[len(parts)]).select(*rows.columns, "s.*")
        # only the candidate that applies several strategies has a second step
        possible = [v for v in variants if not parts or v[0] in chained]
        stage = checkpointed(applied(now, keys, possible).select(*rows.columns))
        parts.append(stage.filter(F.size("plan") == len(parts) + 1))
        turn = stage.filter(F.size("plan") > len(parts))
    done = reduce(DataFrame.unionByName, parts)
    window = F.coalesce(F.array_max(F.transform("plan", lambda p: p["window"])), F.lit(1))
    after_rows = checkpointed(moved(done.withColumn("window", window).drop("plan"), keys, ego, longest))
    after = evaluated(after_rows, keys, thresholds)
    compared = _compared(first, after_rows, keys)
    report = plans.join(before.select(*TRACK, c("n").alias("n_before"), c("status").alias("status_before"), c("rejections").alias("rejections_before"), c("cost").alias("cost_before")), TRACK)
    joined = report.join(after.withColumnsRenamed({x: f"{x}_after" for x in ("n", "status", "rejections", "doubts", "cost", "uncertainty")}), keys).join(compared, keys)
    return _accepted(joined).join(_penalties(plans, calibration), keys).withColumn("score", c("cost_after") + c("penalty")), after_rows, first


def _accepted(joined: DataFrame) -> DataFrame:
    severity = lambda s: F.coalesce(*[F.when(c(s) == k, v) for k, v in SEVERITY.items()])
    new = F.array_except("rejections_after", "rejections_before")
    out = joined.withColumns({
        "improvement": c("cost_before") - c("cost_after"), "removes_rows": c("matched") < c("n_before"), "new_rejections": new,
        "worse": (F.size(new) > 0) | (severity("status_after") > severity("status_before")),
    })
    return out.withColumn("accepted", (c("improvement") >= IMPROVEMENT_MARGIN) & ~c("removes_rows") & ~c("worse"))


def _penalties(plans: DataFrame, calibration: DataFrame | None) -> DataFrame:
    keys = [*TRACK, "candidate"]
    steps = plans.select(*keys, F.explode("plan.strategy").alias("strategy"))
    if calibration is None:
        steps = steps.withColumns({"success_rate": F.lit(0.0), "reconstruction_error": F.lit(0.0)})
    else:
        steps = steps.join(calibration.select("strategy", "success_rate", "reconstruction_error"), "strategy", "left").na.fill(0.0, ["success_rate", "reconstruction_error"])
    each = (1 - c("success_rate")) * 5 + F.least(F.lit(10.0), c("reconstruction_error"))
    return steps.groupBy(*keys).agg(F.sum(each).alias("penalty"))


def _compared(first: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of the original a candidate keeps, how many it changes, and its distance to the original in the plane."""
    joined = _side_by_side(first, after)
    gone = c("original.frame_index").isNull()
    squared = F.pow(c("x") - c("original.x"), 2) + F.pow(c("z") - c("original.z"), 2)
    return joined.groupBy(*keys).agg(
        F.count_if(~gone).alias("matched"), F.count_if("modified").alias("modified_frames"),
        F.min(F.when(c("modified"), c("frame_index"))).alias("first_modified"), F.max(F.when(c("modified"), c("frame_index"))).alias("last_modified"),
        F.coalesce(F.sqrt(F.avg(squared)), F.lit(0.0)).alias("rmse"),
    )


def _side_by_side(first: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of candidates with the original row of their frame and whether place, box, label or motion differ from it."""
    held = ["x", "z", *BOX, "obj_vx", "obj_vz"]
    original = first.select(*TRACK, "frame_index", F.struct("frame_index", "source", "label", *held).alias("original"))
    same = c("label").eqNullSafe(c("original.label"))
    for h in held:
        same = same & F.coalesce(F.abs(c(h) - c(f"original.{h}")) <= EQUAL, c(h).eqNullSafe(c(f"original.{h}")))
    return after.join(original, [*TRACK, "frame_index"], "left").withColumn("modified", c("original").isNull() | ~same)


def chosen_repairs(candidates: DataFrame) -> DataFrame:
    """One row per rejected track: the accepted candidate with the lowest score, or none, with the final decision and a confidence."""
    order = F.struct(F.round("score", 9).alias("score"), "rank")
    cols = ["candidate", "plan", "improvement", "rejections_after", "cost_after", "modified_frames"]
    best = candidates.groupBy(*TRACK).agg(
        F.first("cost_before").alias("cost_before"), F.first("rejections_before").alias("rejections_before"),
        F.count("*").alias("tried"), F.count_if("accepted").alias("accepted"),
        *[F.min_by(col, F.when(c("accepted"), order)).alias(col) for col in cols],
    )
    chosen = c("accepted") > 0
    decision = F.when(~chosen, "Unrepairable").when(F.size("rejections_after") == 0, "Repair").otherwise("Keep_with_uncertainty")
    gained = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("improvement") / F.greatest(F.lit(IMPROVEMENT_MARGIN), c("cost_before"))))
    return best.withColumns({**{col: F.when(chosen, c(col)) for col in cols}}).withColumns({"decision": decision, "confidence": F.when(chosen, gained).otherwise(0.0)})


def repaired_tracks(candidate_rows: DataFrame, first: DataFrame, chosen: DataFrame) -> DataFrame:
    """All observations after the chosen repairs, beside what they were, with the strategy, whether the row changed or is new."""
    picked = chosen.filter("candidate is not null").select(*TRACK, "candidate")
    repaired = _side_by_side(first, candidate_rows.join(picked, [*TRACK, "candidate"], "left_semi"))
    source = F.when(c("modified"), "repaired").otherwise(c("source"))
    cols = [*TRACK, "frame_index", "label", "x", "z", *BOX, "obj_vx", "obj_vz"]
    changed = repaired.select(*cols, source.alias("source"), "candidate", "modified", c("original").isNull().alias("inserted"), c("original.x").alias("original_x"), c("original.z").alias("original_z"))
    rest = first.join(picked, TRACK, "left_anti").select(
        *cols, "source", F.lit(None).cast("string").alias("candidate"), F.lit(False).alias("modified"), F.lit(False).alias("inserted"), c("x").alias("original_x"), c("z").alias("original_z")
    )
    return changed.unionByName(rest)


def gathered(observations: DataFrame, ego: DataFrame) -> DataFrame:
    """Tracks in a row each: ``rows`` in the order of their frames and ``egos``, the ego motion of the video in the track's span.

    Both tables are spread by video_id, so nothing is shuffled.  Ids and frames are not null, and a frame occurs once in a track.
    """
    observations.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    rows = observations.groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct(*OBSERVED))).alias("rows"))
    moving = ego.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("frame_index", "ego_vx", "ego_vz"))).alias("egos"))
    first, last = F.element_at("rows", 1)["frame_index"], F.element_at("rows", -1)["frame_index"]
    inside = F.filter("egos", lambda e: e["frame_index"].between(first, last))
    known = F.coalesce(inside, F.array().cast(moving.schema["egos"].dataType))
    return rows.join(moving, "video_id", "left").select(*TRACK, "rows", known.alias("egos"))


def _once(kind: T.DataType):
    """An Arrow function that Spark neither repeats nor moves, as its plan would call it anew for every filter on what it found."""
    return lambda f: F.arrow_udf(f, kind).asNondeterministic()


def _kind(kinds: dict[str, str]) -> T.StructType:
    types = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(k, types[t]) for k, t in kinds.items()])


@_once(_kind(track_lists.FACTS))
def _facts_of(rows: pa.Array, egos: pa.Array) -> pa.Array:
    tracks = track_lists.Tracks(rows)
    every = np.arange(len(rows))
    found = tracks.measured(tracks.rows, np.ones(len(rows), np.int64), track_lists.egos_of(egos), every)
    return track_lists.structs(found, track_lists.FACTS)


@_once(T.ArrayType(_kind({**track_lists.FACTS, **track_lists.COMPARED})))
def _facts_after(rows: pa.Array, egos: pa.Array, plans: pa.Array) -> pa.Array:
    tracks = track_lists.Tracks(rows)
    edges = track_lists.edges_of(plans)
    owners = np.repeat(np.arange(len(rows)), np.diff(edges))
    after, window = track_lists.after_plans(tracks, owners, plans.flatten(), EQUAL)
    found = tracks.measured(after, window, track_lists.egos_of(egos), owners)
    found |= track_lists.compared(tracks.rows, after, track_lists.side_by_side(tracks.rows, after, owners, window, EQUAL))
    values = track_lists.structs(found, {**track_lists.FACTS, **track_lists.COMPARED})
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


_AFTER = {"frame_index": "int", "label": "string", "source": "string", "modified": "boolean", "inserted": "boolean"}
_AFTER |= {k: "double" for k in ("x", "z", *BOX, "obj_vx", "obj_vz", "original_x", "original_z")}


@_once(T.ArrayType(_kind(_AFTER)))
def _rows_after(rows: pa.Array, plan: pa.Array) -> pa.Array:
    tracks = track_lists.Tracks(rows)
    every = np.arange(len(rows))
    after, window = track_lists.after_plans(tracks, every, plan, EQUAL)
    beside = track_lists.side_by_side(tracks.rows, after, every, window, EQUAL)
    found, modified = beside["original"], beside["modified"]
    source = np.where(modified, tracks.sources.more[0], after["source"])
    was = {f"original_{a}": np.where(found >= 0, tracks.rows[a][found], np.nan) for a in ("x", "z")}
    doubles = {**{k: after[k] for k in ("x", "z", *BOX)}, **{k: beside[k] for k in ("obj_vx", "obj_vz")}, **was}
    fixed = [pa.array(after["frame_index"], pa.int32()), tracks.labels.of(after["label"]), tracks.sources.of(source), pa.array(modified), pa.array(found < 0)]
    values = pa.StructArray.from_arrays([*fixed, *[pa.array(doubles[k], from_pandas=True) for k in list(_AFTER)[5:]]], list(_AFTER))
    return pa.ListArray.from_arrays(pa.array(after.edges, pa.int32()), values)


def tried(
    tracks: DataFrame,
    strategies: Sequence[str] = tuple(STRATEGIES),
    addressed: dict[str, list[str]] | None = None,
    calibration: DataFrame | None = None,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """The candidates of ``repair_candidates`` for ``gathered`` tracks."""
    measured = tracks.withColumn("f", _facts_of("rows", "egos")).select(*TRACK, "rows", "egos", "f.*")
    kept = [*TRACK, "rows", "egos"]
    before = judged(measured, kept, thresholds).filter(F.size("rejections") > 0)
    listed = before.withColumn("plans", _listed(before, strategies, ADDRESSED if addressed is None else addressed))
    after = listed.withColumn("found", _facts_after("rows", "egos", F.transform("plans", lambda p: p["plan"])))
    report = {f"{x}_before": c(x) for x in ("n", "status", "rejections", "cost")}
    each = after.select(*TRACK, *[v.alias(k) for k, v in report.items()], F.explode(F.arrays_zip("plans", "found")).alias("p"))
    each = each.select(*TRACK, *report, "p.plans.*", "p.found.*")
    names = ["n", "status", "rejections", "doubts", "cost", "uncertainty"]
    own = [*TRACK, "rank", "candidate", "plan", *report, *track_lists.COMPARED]
    out = _accepted(judged(each, own, thresholds).withColumnsRenamed({x: f"{x}_after" for x in names}))
    if calibration is None:
        return out.withColumn("penalty", 5.0 * F.size("plan")).withColumn("score", c("cost_after") + c("penalty"))
    return out.join(_penalties(out, calibration), [*TRACK, "candidate"]).withColumn("score", c("cost_after") + c("penalty"))


def repaired(tracks: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``repaired_tracks`` for ``gathered`` tracks; ``chosen`` comes from their candidates and has the plan."""
    picked = chosen.filter("candidate is not null").select(*TRACK, "candidate", "plan").repartition("video_id")
    none = F.array().cast(picked.schema["plan"].dataType)
    both = tracks.select(*TRACK, "rows").join(picked, TRACK, "left").withColumn("plan", F.coalesce("plan", none))
    after = both.select(*TRACK, "candidate", F.explode(_rows_after("rows", "plan")).alias("r"))
    return after.select(*TRACK, "candidate", "r.*")
