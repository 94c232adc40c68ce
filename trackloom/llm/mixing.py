"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w is to fill w of the mixture, so a document of it is repeated ``rate`` times on average:
target size * w / size of the source.  The number of copies of a document is the Poisson distribution with that mean,
inverted at a uniform number that is a hash of seed and document; it neither depends on the partitions nor on a retry of a
task.  A rate over ``PART_RATE`` is the sum of several Poisson numbers, each inverted at its own hash, so no term underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import partitions
from trackloom.llm.sharding import number_of

SEED = 17
#: Share of a source ~ its size to this power, where no weights are given: 1 keeps the mixture, 0 makes sources equal.
TEMPERATURE = 0.7
#: Mean passes over the corpus.
EPOCHS = 1.0
PART_RATE = 64.0
SALTS = 16


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """source, size (code points, and one for each document), rate.  A source that ``weights`` doesn't name gets none."""
    size = (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        wanted = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        wanted = F.coalesce(*[F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))
    rows = sizes.withColumn("wanted", wanted)
    total = rows.agg(F.sum("size").alias("all_size"), F.sum("wanted").alias("all_wanted"))
    rate = F.lit(float(epochs)) * F.col("all_size") * F.col("wanted") / F.col("all_wanted") / F.col("size")
    # one row; 10 digits are far more than a weight has, and hide the order in which sums were added
    return rows.crossJoin(F.broadcast(total)).select("source", "size", F.round(F.coalesce(rate, F.lit(0.0)), 10).alias("rate"))


def poisson_count(rate: Column, seeds: Column) -> Column:
    """Copies of a document: per part, how many values of the cumulative distribution lie at or below the uniform number."""
    parts = F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int")
    mean = rate / parts
    # beyond this the distribution is over 1 - 2^-60, more than any 52-bit uniform number reaches
    last = F.ceil(mean + 12 * F.sqrt(mean) + 25).cast("int")

    def part(n: Column) -> Column:
        uniform = number_of(F.concat(seeds, F.lit(":"), n.cast("string"))) / float(1 << 52)
        zero = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))

        def step(state: Column, k: Column) -> Column:
            term = state["term"] * mean / k
            return F.struct(
                term.alias("term"), (state["below"] + term).alias("below"),
                (state["k"] + F.when(state["below"] <= uniform, 1).otherwise(0)).alias("k"),
            )

        return F.aggregate(F.sequence(F.lit(1), last), zero, step)["k"]

    return F.aggregate(F.transform(F.sequence(F.lit(0), parts - 1), part), F.lit(0), lambda a, b: a + b)


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, and rate, n_copies, copy (from 1), position (the hash that orders the mixture), per copy.

    Columns of ``docs`` with these four names give way to the new ones; ``mixture`` keeps them.

    A null source is a source of its own, null texts have size one.  Rows with one doc_id share their number of copies.  Sources
    whose weight is 0 have no copies; no rows give no rows.
    """
    rates = source_rates(docs, weights, temperature, epochs).select(F.col("source").alias("__source"), "rate")
    # dealt out, so that Spark counts the repeated rows before it broadcasts them
    salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition("__source", "__salt")
    taken = docs.drop("rate", "n_copies", "copy", "position")
    rows = taken.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    on = F.col("source").eqNullSafe(F.col("__source")) & (rows["__salt"] == salted["__salt"])
    met = rows.join(salted, on).drop("__salt", "__source")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    counted = met.withColumn("n_copies", poisson_count(F.col("rate"), key)).filter("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return copies.withColumn("position", number_of(F.concat(F.lit("place:"), key, F.lit(":"), F.col("copy").cast("string"))))


def shuffled(copies: DataFrame) -> DataFrame:
    """Rows in the order of their position: one global shuffle of the corpus.

    Positions are uniform from 0 to 2^52, so equal ranges of them are equal shares, and no sample of the rows is needed.
    """
    n = partitions(copies.sparkSession)
    part = F.least(F.floor(F.col("position") / float(1 << 52) * n), F.lit(n - 1)).cast("int")
    return copies.repartitionById(n, part).sortWithinPartitions("position", "doc_id", "copy")


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` alone, whatever their names, a row per copy in the order of the global shuffle."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    return shuffled(replicated(rows, weights, temperature, epochs, seed)).select("__row.*")


def sql(seed: int = SEED, temperature: float = TEMPERATURE, epochs: float = EPOCHS, of: str = "documents", columns: str = "doc_id, source", out: str | None = None) -> str:
    """The mixture in DuckDB; ``of`` is the table to mix."""
    return f"""
    with recursive sizes as (select source, sum(length(coalesce(text, '')) + 1)::bigint as size from {of} group by source),
    rates as (
        select source, round({epochs} * (select sum(size) from sizes) * pow(size::double, {temperature})
            / (select sum(pow(size::double, {temperature})) from sizes) / size, 10) as rate from sizes
    ),
    parted as (select source, rate, greatest(ceil(rate / {PART_RATE}), 1)::int as parts, rate / greatest(ceil(rate / {PART_RATE}), 1)::int as mean from rates),
    curve as (
        select source, rate, parts, mean, 0 as k, exp(-mean) as term, exp(-mean) as below from parted
        union all
        select source, rate, parts, mean, k + 1, term * mean / (k + 1), below + term * mean / (k + 1) from curve
        where k + 1 <= ceil(mean + 12 * sqrt(mean) + 25)
    ),
    curves as (select source, rate, parts, list(below order by k) as cdf from curve group by all),
    keyed as (select *, '{seed}:' || coalesce(doc_id::varchar, '') as key from {of}),
    counted as (
        select d.* exclude (key), d.key, rate,
            list_sum(list_transform(range(parts), lambda n: len(list_filter(cdf[:-2], lambda c: c <= ('0x' || substr(md5(d.key || ':' || n), 1, 13))::bigint / pow(2.0, 52)))))::int as n_copies
        from keyed d join curves c on d.source is not distinct from c.source
    ),
    copies as (select *, unnest(range(1, n_copies + 1))::int as copy from counted)
    select {columns}, {out or "rate, n_copies, copy, ('0x' || substr(md5('place:' || key || ':' || copy), 1, 13))::bigint as position"} from copies
    """
