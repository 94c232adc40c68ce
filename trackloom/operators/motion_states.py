"""Named motion states of a track or signal from shares of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import norm
from trackloom.operators.ordered import by_step, following, previous, total

SPAN = 8192


def share(condition: Column, of: Column | None = None) -> Column:
    """Share of rows that satisfy a condition, among rows where ``of`` is known."""
    hit = condition.cast("double")
    return F.avg(hit if of is None else F.when(of.isNotNull(), hit))


def dominance(
    df: DataFrame, keys: Sequence[str], value: str, limit: float, ratio: float, names: tuple[str, str, str]
) -> DataFrame:
    """The state holding at least ``ratio`` of the rows, else the state of the mean."""
    low, middle, high = names
    v = F.col(value)
    agg = df.groupBy(*keys).agg(
        share(v < -limit).alias("low_ratio"),
        share(v > limit).alias("high_ratio"),
        share(F.abs(v) <= limit).alias("middle_ratio"),
        F.avg(v).alias("mean"),
    )
    state = (
        F.when(F.col("low_ratio") >= ratio, low)
        .when(F.col("high_ratio") >= ratio, high)
        .when(F.col("middle_ratio") >= ratio, middle)
        .when(F.col("mean") < -limit, low)
        .when(F.col("mean") > limit, high)
        .otherwise(middle)
    )
    return agg.withColumn("state", state)


def distance_trend(df: DataFrame, keys: Sequence[str], order: str, distance: str, change: float, ratio: float) -> DataFrame:
    d = F.col(distance)
    moved = by_step(keys, order, SPAN).scan(df, before=previous(d))
    step = d - F.col("before")
    agg = moved.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(step < -change, step).alias("closer"),
        share(step > change, step).alias("away"),
        share(F.abs(step) <= change, step).alias("same"),
        (F.max_by(d, order) - F.min_by(d, order)).alias("overall"),
    )
    c = F.col
    chain = [
        (c("n") < 2, "unknown", F.lit(0.0)),
        (c("closer") >= ratio, "approaching", c("closer")),
        (c("away") >= ratio, "moving_away", c("away")),
        (c("same") >= ratio, "stable", c("same")),
        (c("overall") < -change, "approaching", F.greatest(c("closer"), F.lit(0.5))),
        (c("overall") > change, "moving_away", F.greatest(c("away"), F.lit(0.5))),
    ]
    state, confidence = F.lit("stable"), F.greatest(c("same"), F.lit(0.5))
    for test, name, value in reversed(chain):
        state = F.when(test, name).otherwise(state)
        confidence = F.when(test, value).otherwise(confidence)
    return agg.withColumn("state", state).withColumn("confidence", confidence)


def turning(df: DataFrame, keys: Sequence[str], order: str, vx: str, vz: str, speed: float, change: float) -> DataFrame:
    """Heading changes, wrapped to half a turn, of rows that move at all; with circular dispersion."""
    moving = df.filter(norm(F.col(vx), F.col(vz)) > speed).withColumn("heading", F.atan2(vz, vx))
    seen = by_step(keys, order, SPAN).scan(moving, before=previous(F.col("heading")))
    raw = F.col("heading") - F.col("before")
    turn = raw - 2 * F.pi() * F.floor((raw + F.pi()) / (2 * F.pi()))
    agg = seen.groupBy(*keys).agg(
        F.count("*").alias("headings"),
        F.coalesce(share(F.abs(turn) > change, turn), F.lit(0.0)).alias("turning_ratio"),
        (1 - norm(F.avg(F.sin("heading")), F.avg(F.cos("heading")))).alias("dispersion"),
    )
    r = F.col("turning_ratio")
    return agg.withColumn(
        "state",
        F.when(F.col("headings") < 2, "unknown")
        .when(r >= 0.5, "turning")
        .when(1 - r >= 0.7, "not_turning")
        .otherwise("uncertain"),
    )


def direction_changes(df: DataFrame, keys: Sequence[str], order: str, vx: str, vz: str) -> DataFrame:
    """Turns above 45 degrees between the velocities before and after each row."""
    specs = {}
    for c in (vx, vz):
        specs[f"a_{c}"] = previous(F.col(c))
        specs[f"b_{c}"] = following(F.col(c))
    seen = by_step(keys, order, SPAN).scan(df, **specs)
    a, b = [F.col(f"a_{c}") for c in (vx, vz)], [F.col(f"b_{c}") for c in (vx, vz)]
    checked = (norm(*a) > 0.1) & (norm(*b) > 0.1)
    cosine = (a[0] * b[0] + a[1] * b[1]) / (norm(*a) * norm(*b))
    changed = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) > F.pi() / 4
    agg = seen.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(checked & changed).alias("changes"), F.count_if(checked).alias("checks")
    )
    rate = F.col("changes") / F.greatest(F.lit(1), F.col("checks"))
    return agg.withColumn(
        "confidence",
        F.when((F.col("n") < 3) | (F.col("checks") == 0), 0.0)
        .when(F.col("changes") > 2, F.least(F.lit(1.0), rate + 0.3))
        .otherwise(rate),
    )


def adaptive_motion(df: DataFrame, keys: Sequence[str], order: str, value: str, band: float, ratio: float) -> DataFrame:
    """Steps against a band of the key's own deviation, and how often their sign flips."""
    v = F.col(value)
    scan = by_step(keys, order, SPAN)
    moved = scan.scan(df, before=previous(v), n=total(1), s=total(v), ss=total(v * v))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2))))
    stepped = moved.withColumn("step", v - F.col("before")).withColumn("band", band * deviation)
    signed = scan.scan(stepped.withColumn("sign", F.signum("step")), sign_before=previous(F.col("sign")))
    step = F.col("step")
    agg = signed.groupBy(*keys).agg(
        F.count(step).alias("steps"),
        F.coalesce(share(step < -F.col("band"), step), F.lit(0.0)).alias("approaching_ratio"),
        F.coalesce(share(step > F.col("band"), step), F.lit(0.0)).alias("away_ratio"),
        F.count_if(F.col("sign") != F.col("sign_before")).alias("flips"),
    )
    return agg.withColumn("flip_ratio", F.col("flips") / F.greatest(F.lit(1), F.col("steps") - 1)).withColumn(
        "state",
        F.when(F.col("steps") == 0, "unknown")
        .when(F.col("approaching_ratio") > ratio, "approaching")
        .when(F.col("away_ratio") > ratio, "moving_away")
        .otherwise("stable"),
    )


def linearity(df: DataFrame, keys: Sequence[str], order: str, x: str, z: str) -> DataFrame:
    """One minus half the mean deviation of step directions from their average direction."""
    keys = list(keys)
    moved = by_step(keys, order, SPAN).scan(df, bx=previous(F.col(x)), bz=previous(F.col(z)))
    dx, dz = F.col(x) - F.col("bx"), F.col(z) - F.col("bz")
    length = norm(dx, dz)
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    headed = moved.filter(length > 0.1).select(*keys, (dx / length).alias("ux"), (dz / length).alias("uz"))
    mean = headed.groupBy(*keys).agg(F.avg("ux").alias("mx"), F.avg("uz").alias("mz"))
    spread = (
        headed.join(mean, keys)
        .groupBy(*keys)
        .agg(F.avg(norm(F.col("ux") - F.col("mx"), F.col("uz") - F.col("mz"))).alias("spread"))
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("spread") / 2))
    return counts.join(spread, keys, "left").withColumn(
        "linearity", F.when((F.col("n") < 3) | F.col("spread").isNull(), 0.5).otherwise(score)
    )


def ego_predicates(
    df: DataFrame, keys: Sequence[str], order: str, length: int, stop: float, turn: float, epsilon: float, ratio: float
) -> DataFrame:
    """Moving, turning and speed-change labels of fixed-length segments from shares of their frames."""
    keys = list(keys)
    speed = norm(F.col("vx"), F.col("vz"))
    moved = by_step(keys, order, SPAN).scan(df.withColumn("speed", speed), before=previous(F.col("speed")))
    change = F.col("speed") - F.col("before")
    agg = moved.groupBy(*keys, F.floor(F.col(order) / length).cast("int").alias("seg")).agg(
        share(F.col("speed") < stop).alias("still"),
        share(F.abs("vx") > turn).alias("turned"),
        F.count_if(change > epsilon).alias("up"),
        F.count_if(change < -epsilon).alias("down"),
    )
    c = F.col

    def two_way(value: Column, yes: str, no: str) -> Column:
        return F.when(value > ratio, yes).when(1 - value > ratio, no).otherwise("uncertain")

    any_change = c("up") + c("down")
    return (
        agg.withColumn("moving", two_way(c("still"), "stopped", "moving"))
        .withColumn("moving_confidence", F.abs(2 * c("still") - 1))
        .withColumn("turning", two_way(c("turned"), "turning", "not_turning"))
        .withColumn(
            "speed_change",
            F.when(any_change == 0, "constant_speed")
            .when(c("up") / any_change > ratio, "speeding_up")
            .when(c("down") / any_change > ratio, "slowing_down")
            .otherwise("constant_speed"),
        )
    )
