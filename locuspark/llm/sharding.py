"""Two-pass external shuffle into shards, in SQL functions only.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of their content.  Pass two sorts each
bucket by content, permutes it with a seeded Fisher-Yates shuffle (the SQL function shuffle) and writes it.  The
generator of that function runs through a task's buckets in turn, so these are sorted by number first: seed and
records alone decide the order.  The law is ``rows``: with buckets laid end to end, record number i goes to shard
i mod shards, slot i div shards, so shard counts differ by one at most, and neighbours in a bucket go to different shards.

A bucket holds about ``bucket_bytes``; their number follows from the table's size, and a task has TASK_BUCKETS of them at
most.  Should one bucket get several times its share (only rows with the same id and text can bring that about), its
rows are dealt over further buckets.  Pass two is written before places are counted, so a task that runs again can't
change them.

Rows: null text has no bytes; a null or repeated doc_id is a record like any other; an empty table gives no rows;
further columns are carried along in the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.llm.native import before
from locuspark.storage import written

SHARDS = 24
SEED = 20
BUCKET_BYTES = 4 << 20
TASK_BUCKETS = 16
#: Tasks of pass two where there are buckets enough, however small the table is.
LEAST_TASKS = 64
#: A bucket with so many times its share is dealt out further.
OVERFULL = 4
#: Buckets' first places: so many rows of 16 bytes are broadcast at most; beyond it the join shuffles.
BROADCAST_BUCKETS = 200_000
RECORD_OVERHEAD = 8


def record_size(text: Column) -> Column:
    """UTF-8 bytes and a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("bigint")


def scattered(rows: DataFrame, doc_id: str, text: str, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """rows with their bucket, and the number of buckets."""
    total = rows.agg(F.sum(record_size(F.col(text)))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(buckets)))
    load = rows.groupBy("bucket").agg(F.sum(record_size(F.col(text))).alias("bytes"))
    full = load.filter(F.col("bytes") > OVERFULL * bucket_bytes)
    # Only buckets that hold OVERFULL times their share: at most one in OVERFULL, and none unless rows are repeated or huge.
    full = written(full.withColumn("ways", F.ceil(F.col("bytes") / bucket_bytes).cast("bigint")), "shuffle-overfull")
    n_full = full.count()
    if n_full:
        dealt = full.join(before(full, "bucket", "ways", "_before"), "bucket").select("bucket", "ways", (F.lit(buckets) + F.col("_before")).alias("from"))
        further = full.agg(F.sum("ways")).first()[0]
        rows = rows.join(F.broadcast(dealt) if n_full <= BROADCAST_BUCKETS else dealt, "bucket", "left")
        way = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.col("ways"))
        rows = rows.withColumn("bucket", F.coalesce(F.col("from") + way, F.col("bucket"))).drop("ways", "from")
        buckets += further
    return rows, buckets


def shuffled(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """The records in shuffled order: (bucket, place, record columns, shard, slot), written to the shared folder."""
    columns = docs.columns
    packed = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.struct(*(docs[c] for c in columns)).alias("record"))
    rows, buckets = scattered(packed, "_id", "_text", seed, bucket_bytes)
    size = record_size(F.col("_text")).alias("size")
    records = rows.select("bucket", F.struct(F.xxhash64(F.lit(seed + 1), "_id", "_text").alias("h"), "record", size, F.crc32(F.coalesce("_text", F.lit("")).cast("binary")).alias("text_crc32")).alias("r"))
    tasks = max(-(-buckets // TASK_BUCKETS), min(buckets, LEAST_TASKS))
    gathered = records.repartition(tasks, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list("r"), _order).alias("rs"))
    permuted = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rs", seed).alias("rs"))
    done = written(permuted.select("bucket", F.posexplode("rs").alias("place", "r")).select("bucket", "place", "r.record", "r.size", "r.text_crc32"), "shuffle-buckets")
    counts = written(done.groupBy("bucket").agg(F.count("*").alias("n")), "shuffle-counts")
    first = written(before(counts, "bucket", "n", "first"), "shuffle-first")
    placed = done.join(F.broadcast(first) if first.count() <= broadcast_buckets else first, "bucket")
    number = F.col("first") + F.col("place")
    return placed.select("record", "size", "text_crc32", (number % shards).cast("int").alias("shard"), F.floor(number / shards).cast("bigint").alias("slot"))


def _order(a: Column, b: Column) -> Column:
    """By seeded hash, then by checksum and size: what is still equal then is the same record."""
    less = lambda x, y, then: F.when(x < y, -1).when(x > y, 1).otherwise(then)
    return less(a["h"], b["h"], less(a["text_crc32"], b["text_crc32"], less(a["size"], b["size"], F.lit(0))))


def digest(placed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The columns of the query."""
    return placed.select(F.col(f"record.{doc_id}").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard, records in slot order within each file."""
    placed.select("record.*", F.col("shard"), F.col("slot")).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
