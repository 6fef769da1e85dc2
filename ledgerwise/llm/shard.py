"""Sharding with a permutation-filled lookup table (DataFrame functions only).

Every shard has a preference order over the slots of a prime-sized table, a permutation
given by an offset and a skip hashed from its name. Shards take turns claiming their next
free slot until the table is full, so every shard gets ``size // n`` or one more slot, and
removing a shard moves few other slots. A key's slot is its hash modulo the table size; the
table (``size`` rows, a parameter, whatever the data) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

TABLE_SIZE = 2053  # prime, about 100 slots for each of 20 shards: shares differ by one slot
SHARDS = tuple(f"shard-{i:02d}" for i in range(20))


def hash_long(col: Column, salt: str) -> Column:
    """A 60-bit non-negative number from MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(col, F.lit(salt))), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Columns ``slot`` (0 .. size - 1) and ``shard`` (its name). ``shards``: distinct names."""
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("shards must be distinct names, at least one and at most `size`")
    if any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("size must be prime")
    n = len(shards)
    names = F.array(*[F.lit(s) for s in shards])
    # preference order of each shard: (offset + j * skip) mod size
    prefs = F.transform(names, lambda s: F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda j: ((hash_long(s, "/offset") % size + j.cast("long") * (hash_long(s, "/skip") % (size - 1) + 1)) % size
                   ).cast("int")))
    start = F.struct(F.array_repeat(F.lit(-1), size).alias("owner"), prefs.alias("prefs"))

    def claim(state: Column, turn: Column) -> Column:
        # owner[slot] = shard or -1; the shard whose turn it is takes its first free preference
        who = (turn % n).cast("int")
        free = F.filter(state["prefs"][who], lambda slot: F.get(state["owner"], slot) == -1)[0]
        # bound to a variable first: inside the inner function it would be searched once per slot
        return F.transform(F.array(free), lambda mine: F.struct(
            F.transform(state["owner"], lambda o, i: F.when(i == mine, who).otherwise(o)).alias("owner"),
            state["prefs"].alias("prefs")))[0]

    filled = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, claim,
                                               lambda state: state["owner"]).alias("owner"))
    return filled.select(F.posexplode("owner").alias("slot", "i")).select("slot", names[F.col("i")].alias("shard"))


def place(df: DataFrame, lookup: DataFrame, key: str, size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row by ``key``; a null key hashes as the empty text,
    equal keys share a shard. Columns of the input with these names stay, as ``input_slot`` and
    ``input_shard`` (with ``input_`` once more while that is taken too)."""
    taken, names = {c.lower() for c in df.columns} | {"slot", "shard"}, {}
    for c in df.columns:
        names[c] = c
        if c.lower() in ("slot", "shard"):
            while names[c].lower() in taken:
                names[c] = f"input_{names[c]}"
            taken.add(names[c].lower())
    slot = (hash_long(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "/key") % size).cast("int")
    kept = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], slot.alias("slot"))
    return kept.join(F.broadcast(lookup), "slot")


def write_sharded(placed: DataFrame, path: str, splits: int = 1) -> None:
    """One folder per shard; ``splits`` files at most for each, so a heavy shard is no single
    task. Rows are dealt to the splits by chance, repeated ones too; they are written first, so
    a task that is run again deals them alike."""
    rows = placed.select(F.col("shard").alias("_shard"), F.struct(*[F.col(f"`{c}`") for c in placed.columns]).alias("row"))
    if splits > 1:
        rows = materialize(rows, "placed")
    salt = F.floor(F.rand(7) * splits).cast("int")
    dealt = rows.withColumn("_split", salt).repartition("_shard", "_split")
    dealt.select("row.*").write.partitionBy("shard").parquet(path)
