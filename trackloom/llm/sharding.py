"""Placement by a permutation-filled lookup table (prime number of slots, shards claim slots in turn by preference)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, over a hundred times the number of shards: shares of slots differ by at most one.
SLOTS = 4099
SHARDS = 32


def number(text: str) -> int:
    """The first 52 bits of the MD5 of a text; the same in SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def number_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def preferences(shard: str, slots: int) -> tuple[int, int]:
    """Where a shard starts in the table and how far it steps: with a prime number of slots it visits each slot once."""
    return number(f"offset:{shard}") % slots, number(f"skip:{shard}") % (slots - 1) + 1


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (as its place in ``shards``) of each slot."""
    if not is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("slots must be prime, and shards distinct, at least one and at most as many as slots")
    wishes = [preferences(s, slots) for s in shards]
    table, at, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for n, (offset, skip) in enumerate(wishes):
            while table[slot := (offset + at[n] * skip) % slots] >= 0:
                at[n] += 1
            table[slot], left = n, left - 1
            if not left:
                break
    return table


def default_shards(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def placed(docs: DataFrame, shards: Sequence[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot, shard per row.

    The table has ``slots`` rows whatever the input, so it is broadcast.  Equal ids go to one shard; null ids go to the slot of
    the empty text.  A key that many rows share lies in one shard by definition; ``write_shards`` still writes it from many tasks.
    """
    shards = list(shards or default_shards())
    spark = docs.sparkSession
    table = spark.createDataFrame([(n, shards[k]) for n, k in enumerate(lookup_table(shards, slots))], "slot long, shard string")
    slot = number_of(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % slots
    return docs.select("doc_id", slot.alias("slot")).join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name, or with the first number that makes it unlike all others."""
    names = {t.lower() for t in taken}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(names) + 2))) if n not in names)


def write_shards(docs: DataFrame, path: str, shards: Sequence[str] | None = None, slots: int = SLOTS, files_per_shard: int = 8) -> DataFrame:
    """Writes whole rows and their slot under ``path/shard=...``, and reads them back; each shard is dealt to ``files_per_shard`` tasks.

    Where ``docs`` has columns named slot or shard already, the new ones are slot_1 or shard_1, and so on.  No rows write no
    shards and give no rows.
    """
    shards = list(shards or default_shards())
    spark = docs.sparkSession
    slot, shard = free_name("slot", docs.columns), free_name("shard", docs.columns)
    table = spark.createDataFrame([(n, shards[k]) for n, k in enumerate(lookup_table(shards, slots))], f"{slot} long, {shard} string")
    at = number_of(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % slots
    rows = docs.withColumn(slot, at).join(F.broadcast(table), slot).select(*docs.columns, slot, shard)
    part = F.pmod(F.xxhash64(*docs.columns), F.lit(files_per_shard))
    rows.repartition(len(shards) * files_per_shard, shard, part).write.partitionBy(shard).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: The same table in DuckDB: one row of the recursion per claim, with the claims so far as a list.
SQL = f"""
with recursive shards as (
    select i, 'shard-' || lpad(i::varchar, 5, '0') as shard,
        ('0x' || substr(md5('offset:shard-' || lpad(i::varchar, 5, '0')), 1, 13))::bigint % {SLOTS} as first,
        ('0x' || substr(md5('skip:shard-' || lpad(i::varchar, 5, '0')), 1, 13))::bigint % ({SLOTS} - 1) + 1 as skip
    from range({SHARDS}) r(i)
),
wishes as (select list(first order by i) as firsts, list(skip order by i) as skips from shards),
turns as (
    select 0 as turn, list_transform(range({SLOTS}), lambda x: false) as taken, list_transform(range({SHARDS}), lambda x: 0::bigint) as tried, -1::bigint as slot
    union all
    select turn + 1,
        list_concat(list_concat(taken[1:got], [true]), taken[got + 2:]),
        list_concat(list_concat(tried[1:turn % {SHARDS}], [tries + 1]), tried[turn % {SHARDS} + 2:]),
        got
    from (
        select *, (firsts[turn % {SHARDS} + 1] + tries * skips[turn % {SHARDS} + 1]) % {SLOTS} as got
        from (
            select *, list_filter(range(tried[turn % {SHARDS} + 1], {SLOTS}), lambda j: not taken[(firsts[turn % {SHARDS} + 1] + j * skips[turn % {SHARDS} + 1]) % {SLOTS} + 1])[1] as tries
            from turns, wishes where turn < {SLOTS}
        )
    )
),
filled as (select slot, shard from turns join shards on i = (turn - 1) % {SHARDS} where slot >= 0)
select doc_id, slot, shard
from (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint % {SLOTS} as slot from documents)
join filled using (slot)
"""
