"""SimHash near-duplicates, linked within a Hamming distance by pigeonring filtering.

The 64 bits are a ring of eight segments.  If two fingerprints differ in at most ``budget`` = 2 bits, then some
segment starts a chain whose cumulative differences over l segments never exceed l * 2 / 8 (the pigeonring
principle): the first three segments differ in no bit, and the first seven in at most one.  Of the two pairs of
segments after the first three, one therefore agrees too.  So a candidate key is 24 + 16 bits, at eight chain
starts and two pairs, and no link is lost.  Fingerprints that share a key are then held to the chain's budgets
and last to the full distance.

Equal texts share a fingerprint, so that all work from there on is on distinct fingerprints.  A key of more than
KEY_ROWS fingerprints is split by what it leaves free: at most two bits differ in three segments, so one of the three
agrees, and of three parts of the other two segments one agrees as well.  With that fixed, at most 2048 fingerprints
are left to a key, so that every key is compared in blocks by the same budgets, whatever its size.  Its links become a
spanning forest, never all pairs.  Components of the forest's edges are found by alternating star contraction on
tables in the shared folder; nothing but counts reaches the driver.

Rows: null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle give one
shingle of them all; every row of the table counts, also repeated ones; an empty table gives no rows; ids of any
type that has an order are kept as they are; further columns are ignored.  A null doc_id keeps its row, and a component
of such rows only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from locuspark.llm.native import join_hot
from locuspark.llm.workers import lean
from locuspark.storage import release, written

SHINGLE_WORDS = 3
HASH_SEED = 42
BUDGET = 2
SEGMENTS, SEGMENT_BITS = 8, 8
#: So many edges at most are joined up in one task; more go through rounds on tables.  Both are exact.
SMALL_EDGES = 16_384
#: A fingerprint of more rows than this is dealt over several tasks when its rows meet their component.
HOT_ROWS = 1_000_000
#: Candidate keys that a worker takes at once, and the largest key that is compared whole.
LINK_ROWS = 100_000
KEY_ROWS = 2048
#: Shingles whose bits are counted at once by a worker.
CHUNK = 1 << 19
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of each run of three words, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) < SHINGLE_WORDS:
        return [digest(b" ".join(words), HASH_SEED)] if words else []
    return [digest(b"%b %b %b" % x, HASH_SEED) for x in zip(words, words[1:], words[2:], strict=False)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, least significant first: byte lanes are added up before they can overflow."""
    out = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), CHUNK):
        part = hashes[lo : lo + CHUNK]
        for k in range(8):
            lanes = np.add.reduceat((part >> np.uint64(k)) & _LANES, np.arange(0, len(part), 255))
            out[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str | None) -> int:
    """Bits that are set in over half the shingle hashes."""
    hashes = np.array(shingle_hashes(text), dtype=np.uint64)
    if not len(hashes):
        return 0
    if len(hashes) == 1:
        return int(hashes[0])
    return int.from_bytes(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long, text_hash tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch["text"].to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(found, pa.int64())], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), StructType([rows.schema["doc_id"], rows.schema["text_hash"], StructField("fp", LongType())]))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


# --- candidates -----------------------------------------------------------------------------------------------


def turned(start: int) -> Column:
    """The fingerprint with a segment turned to the lowest bits."""
    return F.expr(f"(shiftrightunsigned(fp, {8 * start}) | shiftleft(fp, {64 - 8 * start}))") if start else F.col("fp")


def fixed_bits(pair: int) -> int:
    """Of a turned ring the chain's first three segments, and one of the two pairs behind them."""
    return 0xFFFFFF | 0xFFFF << 24 + 16 * pair


def candidate_keys(fps: DataFrame) -> DataFrame:
    """(chain, key, fp): sixteen rows for each distinct fingerprint.  The key is what the chain leaves fixed."""
    keys = [F.struct(F.lit(2 * i + h).alias("chain"), turned(i).bitwiseAND(F.lit(fixed_bits(h))).alias("key")) for i in range(SEGMENTS) for h in (0, 1)]
    return fps.select("fp", F.inline(F.array(*keys))).select("chain", "key", "fp")


def finer_bits(pair: int) -> list[int]:
    """Nine choices of further bits, one of which agrees where at most two of the free ones differ; 10 or 11 stay free."""
    free = [24 + 16 * (1 - pair), 32 + 16 * (1 - pair), 56]
    out = []
    for kept in free:
        rest = [b + i for b in free if b != kept for i in range(8)]
        out += [0xFF << kept | sum(1 << b for b in part) for part in (rest[:5], rest[5:10], rest[10:])]
    return out


def finer_keys(rows: DataFrame) -> DataFrame:
    """(chain, key, fp) of rows of large keys: chain, now a number of its start, pair and further bits, times 9."""
    pick = F.lit(None)
    for i in range(SEGMENTS):
        for h in (0, 1):
            bits = [fixed_bits(h) | more for more in finer_bits(h)]
            keys = F.array(*(F.struct(F.lit(9 * (2 * i + h) + n).alias("chain"), turned(i).bitwiseAND(F.lit(b - (1 << 64) if b >= 1 << 63 else b)).alias("key")) for n, b in enumerate(bits)))
            pick = keys if i == h == 0 else F.when(F.col("chain") == 2 * i + h, keys).otherwise(pick)
    return rows.select("fp", F.inline(pick)).select("chain", "key", "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chain_holds(diff: np.ndarray, start: int) -> np.ndarray:
    """Whether the differences of segments start, start+1, ... stay within l * BUDGET / SEGMENTS for every l."""
    total, ok = np.zeros(diff.shape, dtype=np.int64), np.ones(diff.shape, dtype=bool)
    for n in range(SEGMENTS):
        segment = (start + n) % SEGMENTS
        total += _popcount((diff >> np.uint64(SEGMENT_BITS * segment)) & np.uint64(255))
        ok &= total * SEGMENTS <= (n + 1) * BUDGET
    return ok


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links_in_key(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest, as (position, position), of the links among distinct fingerprints of one key."""
    forest, out = Forest(len(fps)), []
    for lo in range(0, len(fps), 256):
        diff = fps[lo : lo + 256, None] ^ fps[None, lo:]  # a link is found once, from its first position
        ok = chain_holds(diff, start)
        ok[ok] = _popcount(diff[ok]) <= BUDGET
        rows, columns = np.nonzero(ok)
        out += [(a, b) for a, b in zip((rows + lo).tolist(), (columns + lo).tolist(), strict=True) if a < b and forest.join(a, b)]
    return out


def linked(keyed: DataFrame, ways: int, most: int) -> DataFrame:
    """(a, b, chain): links of the fingerprints that share a key, without a chain; rows of larger keys pass by as (fp, fp, chain).

    A chain's start is chain // ways.  A worker holds the rows of a batch and of one key of at most ``most`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late: tuple[int, int] | None = None  # the large key whose rows pass by
        held: tuple[np.ndarray, ...] | None = None

        def out(a: list[int] | np.ndarray, b: list[int] | np.ndarray, chain: np.ndarray | None) -> pa.RecordBatch:
            shown = pa.nulls(len(a), pa.int32()) if chain is None else pa.array(chain, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), shown], names=["a", "b", "chain"])

        def emit(chain: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((chain[1:] != chain[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = np.concatenate([[0], edge, [len(fp)]])
            pairs: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
                lo, hi = int(cuts[i]), int(cuts[i + 1])
                if hi - lo > most:
                    yield out(fp[lo:hi], fp[lo:hi], chain[lo:hi])
                else:
                    signed = fp[lo:hi].tolist()
                    pairs += [(signed[a], signed[b]) for a, b in links_in_key(fp[lo:hi].view(np.uint64), int(chain[lo]) // ways)]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield out(a, b, None)

        for batch in batches:
            chain, key, fp = (batch.column(i).to_numpy() for i in range(3))
            if late is not None:
                more = (chain == late[0]) & (key == late[1])  # the first rows, if any
                if more.any():
                    yield out(fp[more], fp[more], chain[more])
                    chain, key, fp = chain[~more], key[~more], fp[~more]
            if not len(fp):
                continue
            late = None
            if held is not None:
                chain, key, fp = (np.concatenate(x) for x in zip(held, (chain, key, fp), strict=True))
            # The last key may go on in the next batch.
            other = np.flatnonzero((chain != chain[-1]) | (key != key[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from emit(chain[:cut], key[:cut], fp[:cut])
            chain, key, fp = chain[cut:].copy(), key[cut:].copy(), fp[cut:].copy()
            held = (chain, key, fp)
            if len(fp) > most:
                yield out(fp, fp, chain)
                late, held = (int(chain[0]), int(key[0])), None
        if held is not None:
            yield from emit(*held)

    dealt = keyed.repartition("chain", "key").sortWithinPartitions("chain", "key")
    return dealt.mapInArrow(lean(run, LINK_ROWS), "a bigint, b bigint, chain int")


def links(fps: DataFrame, most: int = KEY_ROWS) -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them to connect all that is connected."""
    found = written(linked(candidate_keys(fps), 2, most), "simhash-links")
    small = found.filter("chain is null").select("a", "b")
    large = found.filter("chain is not null").select(F.col("a").alias("fp"), "chain")
    if large.isEmpty():
        return small
    # Nine choices leave 11 bits free at most, so no key is larger than 2048 any more.
    return small.union(linked(finer_keys(large), 18, KEY_ROWS).select("a", "b"))


# --- components -----------------------------------------------------------------------------------------------


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [(u, v) for batch in batches for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True)]
    names = sorted({x for e in edges for x in e})
    index = {x: i for i, x in enumerate(names)}
    forest = Forest(len(names))
    for u, v in edges:
        forest.join(index[u], index[v])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([names[forest.root(i)] for i in range(len(names))], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, *, small: int = SMALL_EDGES) -> DataFrame:
    """(node, root) for every node of an edge: root is the component's smallest node.

    Few edges, by count, are joined up in one task.  More go through alternating star contraction: each round points
    every larger neighbour, then every smaller one, at the least
    neighbour.  A round keeps at most as many edges as there were, and the number of rounds grows with the
    logarithm of the nodes.  Joins split a hub's rows; nothing gathers the neighbours of a node.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    if edges.count() <= small:
        return edges.repartition(1).mapInArrow(_joined_up, "node bigint, root bigint")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        near = large.join(least, F.col("u") == F.col("n")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        earlier, edges = edges, written(near, "star")
        release(earlier, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and of each distinct one its component's root and smallest doc_id, and its rows."""
    prints = written(fingerprints(docs, doc_id, text), "simhash-docs")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_rows")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    placed = written(distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "first_doc", "n_rows"), "simhash-roots")
    ids = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_linked = placed.join(ids, "root").select("fp", "root", "component_id", "n_rows")
    alone = distinct.join(placed.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first_doc").alias("component_id"), "n_rows")
    return prints, written(of_linked.union(alone), "simhash-classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: component_id is the smallest doc_id reachable by links."""
    prints, found = classes(docs, doc_id, text)
    rows = join_hot(prints.select("doc_id", "fp"), found.select("fp", "component_id", "n_rows"), ["fp"], "n_rows", "doc_id", most=hot_rows)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with one row of each component: of its smallest doc_id, and of several texts with that id the least by hash.

    Rows are told apart by id and text, so a row is never lost to another one that only shares its id; of rows that
    share both, one stays.  Only ids and hashes are shuffled against the texts.  Null ids count as the largest.
    """
    prints, found = classes(docs, doc_id, text)
    keyed = prints.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("repeats"))
    keyed = written(join_hot(keyed, found.select("fp", "root", "n_rows"), ["fp"], "n_rows", "text_hash", most=hot_rows), "simhash-keyed")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = keyed.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n_keys"))
    # A component with one key has nothing to give up; the others' keys meet their first, a hot component's in several tasks.
    first = written(first.filter("n_keys > 1"), "simhash-first")
    several = join_hot(keyed, first, ["root"], "n_keys", "text_hash", most=hot_rows)
    gone = several.filter(order != F.col("first")).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"))
    gone = written(gone, "simhash-gone")
    key = lambda i, h: F.col("_id").eqNullSafe(F.col(i)) & (F.col("_hash") == F.col(h))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col(doc_id).alias("_id"), text_hash(F.col(text)).alias("_hash"))
    kept = rows.join(gone, key("g_id", "g_hash"), "left_anti")
    again = written(keyed.filter("repeats > 1").select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash")), "simhash-again")
    if again.isEmpty():
        return kept.select("_row.*")
    once = kept.join(again, key("r_id", "r_hash"), "left_semi").groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
    return kept.join(again, key("r_id", "r_hash"), "left_anti").select("_row.*").union(once.select("_row.*"))
