"""Token ids in raw binary shards, with minimal perfect hash indexes for keyed access.

Format, in one folder: ``shard-NNNNNN.bin`` holds the ids of consecutive records, little-endian uint16 or, for
vocabularies over 65,536, uint32; ``shard-NNNNNN.off`` holds uint64 positions, in tokens, of each record's start
and of the end.  Records lie in ascending order of their key.  A key belongs to the bucket xxhash64(key) mod buckets;
``index-NNNNNN.mph`` holds FILE_BUCKETS buckets: first uint64 positions of each bucket's blob and of the end, then the
blobs.  A blob is a minimal perfect hash of the bucket's keys onto slots that store a fingerprint, the shard, the first
record and the number of records with that key.  A look-up costs a hash, and four reads of bounded size however large
the store is: the bucket's position, its blob, the record's offsets, and its ids.

Rows: null text is empty text (one end id); rows with one key lie side by side, by text, and one look-up finds
them all; a null key sorts first and is found as None; an empty table makes an empty store; keys are whole numbers, and
other types are refused before anything is read.  Shards are written under a task's own name and then renamed, so a task
that runs twice leaves one whole file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from locuspark.llm.bpe import ENCODE_ROWS, encoder
from locuspark.llm.native import before
from locuspark.llm.workers import lean
from locuspark.storage import new_folder, written

END_ID = 2
#: UTF-8 bytes of text for a shard, keys for an index bucket, and buckets for an index file.
SHARD_BYTES = 16 << 20
BUCKET_KEYS = 4096
FILE_BUCKETS = 64
#: Bits of a hash level for each key that it has to place.
GAMMA = 2.0
#: The key that stands for null.
NULL_KEY = -(1 << 63)
BROADCAST_ROWS = 200_000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _save(uri: str, name: str, attempt: int, chunks: Iterator[bytes]) -> None:
    system, folder = _open(uri)
    own, final = f"{folder}/.{name}.{attempt}", f"{folder}/{name}"
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(own, final)


def _load(uri: str, name: str, at: int = 0, size: int | None = None) -> bytes:
    """A file, or so many bytes of it from a position on."""
    system, folder = _open(uri)
    with system.open_input_file(f"{folder}/{name}") as f:
        return f.read() if size is None else f.read_at(size, at)


# --- minimal perfect hash -------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix, so that different keys never meet in all levels."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 977) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray, values: np.ndarray) -> bytes:
    """keys: distinct int64; values: (n, 3) uint64 of shard, first record and records.  Returns the blob."""
    left, levels = np.arange(len(keys)), []
    slot = np.zeros(len(keys), dtype=np.int64)
    placed = 0
    while len(left):
        bits = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
        at = (mixed(keys[left], len(levels)) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        good = alone[at]
        rank = np.cumsum(alone) - alone
        slot[left[good]] = placed + rank[at[good]]
        placed += int(alone.sum())
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~good]
    table = np.zeros((len(keys), 3), dtype="<u8")
    table[slot] = values
    prints = np.zeros(len(keys), dtype="<u4")
    prints[slot] = fingerprints(keys)
    head = struct.pack(f"<II{len(levels)}I", len(keys), len(levels), *(len(x) for x in levels))
    return head + b"".join(x.tobytes() for x in levels) + prints.tobytes() + table.tobytes()


def find(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """(n, 3) of shard, first record and records; 0 records where the key isn't stored."""
    n, count = struct.unpack_from("<II", blob)
    sizes = struct.unpack_from(f"<{count}I", blob, 8)
    at, placed = 8 + 4 * count, 0
    slot = np.full(len(keys), -1, dtype=np.int64)
    for level, size in enumerate(sizes):
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), bitorder="little")
        rank = np.cumsum(bits, dtype=np.int64) - bits
        here = (mixed(keys, level) % np.uint64(len(bits))).astype(np.int64)
        hit = (slot < 0) & (bits[here] == 1)
        slot[hit] = placed + rank[here[hit]]
        placed += int(bits.sum())
        at += size
    prints = np.frombuffer(blob, "<u4", n, at)
    table = np.frombuffer(blob, "<u8", 3 * n, at + 4 * n).reshape(n, 3).astype(np.int64)
    out = np.zeros((len(keys), 3), dtype=np.int64)
    known = slot >= 0
    known[known] = prints[slot[known]] == fingerprints(keys[known])
    out[known] = table[slot[known]]
    return out


# --- the store ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Store:
    """A written store: its folder, its ids' type, the number of index buckets, and tokens and records by shard."""

    path: str
    dtype: str
    buckets: int
    shards: DataFrame

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of the records with one key, by reads of bounded size; no job is run."""
        k, kind = NULL_KEY if key is None else key, np.dtype(self.dtype)
        hashed = xxhash.xxh64_intdigest(struct.pack("<q", k), 42)
        bucket = (hashed - (1 << 64) if hashed >> 63 else hashed) % self.buckets
        file, at = divmod(bucket, FILE_BUCKETS)
        start, end = struct.unpack("<QQ", _load(self.path, f"index-{file:06d}.mph", 8 * at, 16))
        shard, first, n = find(_load(self.path, f"index-{file:06d}.mph", start, end - start), np.array([k], dtype=np.int64))[0].tolist()
        if not n:
            return []
        off = np.frombuffer(_load(self.path, f"shard-{shard:06d}.off", 8 * first, 8 * (n + 1)), "<u8").astype(np.int64)
        ids = np.frombuffer(_load(self.path, f"shard-{shard:06d}.bin", int(off[0]) * kind.itemsize, int(off[-1] - off[0]) * kind.itemsize), kind)
        return np.split(ids, (off[1:-1] - off[0]).tolist())


def _key(df: DataFrame, column: str) -> Column:
    """The key of a row; an id that isn't a whole number is refused."""
    if not isinstance(df.schema[column].dataType, IntegralType):
        raise ValueError(f"keys are whole numbers; {column} is {df.schema[column].dataType.simpleString()}")
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NULL_KEY)).alias("key")


def write(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> Store:
    """Encodes all documents and writes shards and index.

    One shuffle sorts the texts by key range; each task encodes its range as it streams by and writes one shard.
    Only a row for each document goes on from there.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    rows = docs.select(_key(docs, doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard = encoder(tokenizer), TaskContext.get().partitionId()
        attempt, width = TaskContext.get().taskAttemptId(), bpe.dtype.itemsize
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        offsets, out = [0], []

        def encoded() -> Iterator[bytes]:
            for part in batches:
                ids = [x + end for x in bpe.encode_batch(part["text"])]
                first = len(offsets) - 1
                for x in ids:
                    offsets.append(offsets[-1] + len(x) // width)
                n = len(ids)
                out.append(pa.RecordBatch.from_arrays(
                    [part["key"], pa.array([shard] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array(np.diff(offsets[first:]), pa.int64())],
                    names=["key", "shard", "record", "n_tokens"],
                ))
                yield b"".join(ids)

        _save(path, f"shard-{shard:06d}.bin", attempt, encoded())
        _save(path, f"shard-{shard:06d}.off", attempt, iter([np.array(offsets, dtype="<u8").tobytes()]))
        yield from out

    sorted_rows = rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    entries = written(sorted_rows.mapInArrow(lean(run, ENCODE_ROWS), "key bigint, shard int, record bigint, n_tokens bigint"), "tokens-entries")
    counts = written(entries.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records")), "tokens-shards")
    buckets = max(1, -(-(counts.agg(F.sum("records")).first()[0] or 0) // BUCKET_KEYS))
    keyed = entries.groupBy("key").agg(F.min(F.struct("shard", "record")).alias("at"), F.count("*").alias("records"))
    keyed = keyed.select(F.col("key"), _bucket(buckets), _file(buckets), F.col("at.shard").alias("shard"), F.col("at.record").alias("first"), "records")
    files = -(-buckets // FILE_BUCKETS)
    # Every file is written, also one that no key falls into.
    every = spark.range(files).select(F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("int").alias("bucket"), F.col("id").cast("int").alias("file"), *(F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("first", "bigint"), ("records", "bigint"))))

    def index(table: pa.Table) -> pa.Table:
        file, table = table["file"][0].as_py(), table.filter(pc.is_valid(table["key"])).sort_by("bucket")
        number, keys = table["bucket"].to_numpy(), table["key"].to_numpy()
        values = np.stack([table[c].to_numpy().astype(np.uint64) for c in ("shard", "first", "records")], axis=1)
        cuts = np.searchsorted(number, np.arange(file * FILE_BUCKETS, (file + 1) * FILE_BUCKETS + 1))
        blobs = [build(keys[a:b], values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        starts = 8 * (FILE_BUCKETS + 1) + np.cumsum([0, *map(len, blobs)])
        _save(path, f"index-{file:06d}.mph", TaskContext.get().taskAttemptId(), iter([starts.astype("<u8").tobytes(), *blobs]))
        return pa.table({"file": pa.array([file], pa.int32()), "keys": pa.array([len(keys)], pa.int64())})

    written(keyed.unionByName(every).groupBy("file").applyInArrow(index, "file int, keys bigint"), "tokens-index")
    return Store(path, str(encoder(tokenizer).dtype.str), buckets, counts)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")


def _file(buckets: int) -> Column:
    return F.floor(_bucket(buckets) / FILE_BUCKETS).cast("int").alias("file")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(store: Store, keys: DataFrame, *, doc_id: str = "doc_id", with_ids: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every stored record of the given keys: (doc_id, start in the whole store, n_tokens, ids_crc32[, ids]).

    Keys meet their index file, then their shard; each is read once.  An unknown key gives no row.
    """
    wanted = keys.select(_key(keys, doc_id)).distinct().select("key", _bucket(store.buckets), _file(store.buckets))
    path, kind = store.path, np.dtype(store.dtype)

    def look_up(table: pa.Table) -> pa.Table:
        raw, table = _load(path, f"index-{table['file'][0].as_py():06d}.mph"), table.sort_by("bucket")
        starts = np.frombuffer(raw, "<u8", FILE_BUCKETS + 1).astype(np.int64)
        ids, number = table["key"].to_numpy(), table["bucket"].to_numpy()
        cuts = [*np.unique(number, return_index=True)[1].tolist(), len(ids)]
        at = np.concatenate([find(raw[starts[k] : starts[k + 1]], ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) for k in [number[a] % FILE_BUCKETS]])
        have = at[:, 2] > 0
        return pa.table({"key": ids[have], "shard": at[have, 0].astype(np.int32), "first": at[have, 1], "records": at[have, 2]})

    found = wanted.groupBy("file").applyInArrow(look_up, "key bigint, shard int, first bigint, records bigint")
    # Shards number one for every 16 MB of text; their totals are prefix sums for the start of each.
    bases = written(before(store.shards, "shard", "tokens", "base"), "tokens-bases")
    if bases.count() <= broadcast_rows:
        bases = F.broadcast(bases)
    n = max(1, store.shards.count())
    rows = found.join(bases, "shard").select("shard", "first", "records", "key", "base").repartition(n, "shard").sortWithinPartitions("shard", "first")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, off, ids = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for shard, first, records, key, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    at, off = shard, np.frombuffer(_load(path, f"shard-{shard:06d}.off"), "<u8").tolist()
                    ids = np.frombuffer(_load(path, f"shard-{shard:06d}.bin"), kind)
                for r in range(first, first + records):
                    raw = ids[off[r] : off[r + 1]].astype("<u4").tobytes()
                    out.append((None if key == NULL_KEY else key, base + off[r], off[r + 1] - off[r], zlib.crc32(raw), raw if with_ids else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(lean(fetch), READ + (", ids binary" if with_ids else ""))
