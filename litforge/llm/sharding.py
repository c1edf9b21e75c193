"""Consistent sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size.
The shards take turns; each claims the first slot of its permutation that is
still free.  A row's key is hashed to a slot and the slot's owner is its shard,
so placement costs one lookup, shards differ by at most one slot, and adding or
removing a shard moves few rows.

Cases: a null key is placed as the empty text, so null and empty keys share one
shard; repeated keys share a shard; an empty frame gives an empty frame; a
column that already has the name of an added one is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.session import table

#: Production parameters.  The table has SIZE rows whatever the data.
SHARDS = 64
SIZE = 8191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: int = SHARDS, size: int = SIZE, name: str = "shard") -> list[int]:
    """Owner of each slot.  ``size`` must be prime, so that every step visits all slots."""
    if not _is_prime(size) or shards < 1 or shards > size:
        raise ValueError("size must be a prime of at least the number of shards")
    first = [_number(f"{name}-{i}/offset") % size for i in range(shards)]
    step = [_number(f"{name}-{i}/skip") % (size - 1) + 1 for i in range(shards)]
    tried = [0] * shards
    owner = [-1] * size
    for turn in range(size):
        i = turn % shards
        while owner[slot := (first[i] + tried[i] * step[i]) % size] >= 0:
            tried[i] += 1
        owner[slot] = i
    return owner


def slot_of(key: Column, size: int = SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(size)


def place(df: DataFrame, key: str, shards: int = SHARDS, size: int = SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``.  The broadcast table has ``size`` rows."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    owner = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard"))
    owner = owner.select(F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("int").alias("shard"))
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    return keyed.join(F.broadcast(owner), "slot").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


QUERIES = {"op3_sharding": op3_sharding}
ORACLE_SQL = {
    "op3_sharding": f"""
WITH RECURSIVE prefs AS (
  SELECT i, list_transform(range({SIZE}), lambda j: (first + j * step) % {SIZE}) AS slots
  FROM (SELECT i, ('0x' || substr(md5('shard-' || i || '/offset'), 1, 15))::BIGINT % {SIZE} AS first,
               ('0x' || substr(md5('shard-' || i || '/skip'), 1, 15))::BIGINT % {SIZE - 1} + 1 AS step
        FROM range({SHARDS}) AS shards(i))),
claims(turn, shard, slot, owner) AS (
  SELECT 0, -1, -1::BIGINT, list_transform(range({SIZE}), lambda x: (-1)::TINYINT)
  UNION ALL
  SELECT turn + 1, i, wanted,
         list_transform(owner, lambda o, k: CASE WHEN k = wanted + 1 THEN i::TINYINT ELSE o END)
  FROM (SELECT c.turn, c.owner, p.i, list_filter(p.slots, lambda s: c.owner[s + 1] < 0)[1] AS wanted
        FROM claims c JOIN prefs p ON p.i = c.turn % {SHARDS} WHERE c.turn < {SIZE}))
SELECT doc_id, claims.slot, claims.shard::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SIZE} AS slot
      FROM documents) d JOIN claims USING (slot)
""",
}
