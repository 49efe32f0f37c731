"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows.

Every window of ``size`` tokens takes from each source queue its quantum, ``size`` times the queue's target
share.  Quanta are rarely whole numbers; the unserved fraction is the queue's deficit, which is carried to the
next window, across partitions too.  The deficit counters have a closed form: through round r a queue has been
served ``floor(r*size*tokens/total)`` tokens, and its deficit is the rest of that division.  A document's place
thus follows from its own start in its queue alone, and windows are filled without any task seeing more than
its own documents.  What a round leaves free is filled by the next one, so every window but the last is full.

Queues that run dry (possible only with explicit targets) leave; the others go on in a new phase with their
shares renewed.  Sources whose quantum would be under ``min_quantum`` tokens share a queue, so that no
document is shredded and the driver holds at most ``size / min_quantum + 1`` queues, whatever the corpus.
Inside a shared queue each source keeps its own deficit: the sources take turns of ``min_quantum`` tokens by the
same closed form one level down (``Turns``), so all of them get their shares over a run of windows.  Of such
sources the driver and the tasks hold one number each.

Rows: null text is empty text (one end id); repeated rows are packed as often as they occur; a null source is
a source of its own; an empty table gives no rows; ids of any type are kept as they are; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locuspark.llm.bpe import ENCODE_ROWS, encoder
from locuspark.llm.workers import lean
from locuspark.storage import written

WINDOW_TOKENS = 2048
END_ID = 1
#: Fewest tokens that a queue gets in a window.
MIN_QUANTUM = 64
#: Largest table of bases that is broadcast, in rows of about 40 bytes; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: The columns of pieces, behind doc_id.
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
_TOKENS = "source string, part int, local_start bigint, doc_tokens bigint, payload binary"


def tokenised(docs: DataFrame, tokenizer: str, doc_id: Column, text: Column, source: Column, end_id: int) -> DataFrame:
    """Ids of each document as raw bytes, with the tokens of its source that its task wrote before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        width, end = bpe.dtype.itemsize, np.array([end_id], dtype=bpe.dtype).tobytes()
        so_far: dict[str | None, int] = {}
        for part in batches:
            payload = [x + end for x in bpe.encode_batch(part["text"])]
            starts, sizes = [], [len(x) // width for x in payload]
            for s, n in zip(part["source"].to_pylist(), sizes, strict=True):
                starts.append(so_far.get(s, 0))
                so_far[s] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["source"], part["part"], pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(payload, pa.binary())],
                names=["doc_id", "source", "part", "local_start", "doc_tokens", "payload"],
            )

    rows = docs.select(doc_id.alias("doc_id"), text.cast("string").alias("text"), source.cast("string").alias("source"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(lean(run, ENCODE_ROWS), StructType([rows.schema["doc_id"], *StructType.fromDDL(_TOKENS).fields]))


class Schedule:
    """Where the tokens of each queue go: phases of constant shares, in exact integer arithmetic."""

    def __init__(self, totals: list[int], weights: list[float], size: int):
        self.size, self.phases = size, []
        left, at = list(totals), 0
        while any(left):
            active = [q for q, n in enumerate(left) if n]
            share = [weights[q] if weights[q] > 0 else 1e-9 for q in active]
            rounds = min(left[q] / w for q, w in zip(active, share, strict=True))
            take = {q: left[q] if left[q] / w <= rounds * (1 + 1e-12) else min(left[q], int(rounds * w)) for q, w in zip(active, share, strict=True)}
            self.phases.append((at, sum(take.values()), {q: i for i, q in enumerate(active)}, [take[q] for q in active], [totals[q] - left[q] for q in active]))
            at += sum(take.values())
            left = [n - take.get(q, 0) for q, n in enumerate(left)]
        self.total = at
        self.starts = {q: [(p[4][p[2][q]], i) for i, p in enumerate(self.phases) if p[3][p[2].get(q, 0)] and q in p[2]] for q in range(len(totals))}
        self.through = lru_cache(maxsize=4096)(self._through)

    def _through(self, phase: int, turn: int) -> list[int]:
        """Tokens served through a number of rounds, summed over the queues before each, and over all at the end."""
        _, total, _, take, _ = self.phases[phase]
        granted, sums = min(turn * self.size, total), [0]
        for n in take:
            sums.append(sums[-1] + granted * n // total)
        return sums

    def runs(self, queue: int, x: int, n: int) -> Iterator[tuple[int, int]]:
        """(position among all windows' tokens, length) of tokens x..x+n of a queue, cut where a round or window ends."""
        starts, size = self.starts[queue], self.size
        k = bisect_right(starts, (x, len(self.phases))) - 1
        while n:
            begin, phase = starts[k]
            at, total, index, take, _ = self.phases[phase]
            j = index[queue]
            y, most = x - begin, take[j]
            turn = y * total // (most * size)
            while turn and granted_through(self, phase, turn, j) > y:
                turn -= 1
            while granted_through(self, phase, turn + 1, j) <= y:
                turn += 1
            while n and y < most:
                now, then = self.through(phase, turn), self.through(phase, turn + 1)
                here = min(n, then[j + 1] - then[j] - y)
                place = at + now[-1] + then[j] - now[j] + y - (now[j + 1] - now[j])
                while here > 0:
                    cut = min(here, size - place % size)
                    yield place, cut
                    place, here, n, x, y = place + cut, here - cut, n - cut, x + cut, y + cut
                turn += 1
            k += 1


def granted_through(schedule: Schedule, phase: int, turn: int, j: int) -> int:
    """Tokens that the j-th queue of a phase has been served through a number of rounds."""
    sums = schedule.through(phase, turn)
    return sums[j + 1] - sums[j]


class Turns:
    """Where the tokens of the sources of one queue go in it: a tree of at most FAN children a node.

    A node's children are served in turns, and through turn r of R a child of n tokens has been served n*r/R of
    them, in whole quanta; the rest is its deficit, and the last turn serves all of it.  With about a quantum for
    each child in a turn, a run is a quantum long on the average.
    """

    FAN = 32

    def __init__(self, tokens: np.ndarray, quantum: int):
        self.quantum, self.levels = quantum, [tokens]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.add.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), self.FAN)))
        self.turn = lru_cache(maxsize=4096)(self._turn)

    def _rounds(self, level: int, node: int) -> int:
        children = min(self.FAN, len(self.levels[level]) - node * self.FAN)
        return max(1, int(self.levels[level + 1][node]) // (self.quantum * children))

    def _turn(self, level: int, node: int, turn: int) -> tuple[list[int], list[int]]:
        """Of each child: the tokens served through a turn, and what takes a token's number to its place in the node."""
        sizes, rounds, q = self.levels[level][node * self.FAN : (node + 1) * self.FAN].tolist(), self._rounds(level, node), self.quantum
        before, after = ([n if r == rounds else n * r // rounds // q * q for n in sizes] for r in (turn - 1, turn))
        shift, at = [], sum(before)
        for a, b in zip(before, after, strict=True):
            shift.append(at - a)
            at += b - a
        return after, shift

    def runs(self, child: int, x: int, n: int, level: int = 0) -> Iterator[tuple[int, int]]:
        """(position in the queue, length) of tokens x..x+n of a source, in their order."""
        if level == len(self.levels) - 1:
            yield x, n
            return
        node, j = divmod(child, self.FAN)
        size, rounds, q = int(self.levels[level][child]), self._rounds(level, node), self.quantum
        while n:
            turn = min(rounds, -(-(x // q + 1) * q * rounds // size))  # the first one that serves beyond x
            after, shift = self.turn(level, node, turn)
            here = min(n, after[j] - x)
            yield from self.runs(node, x + shift[j], here, level + 1)
            x, n = x + here, n - here


def queues(totals: DataFrame, targets: dict[str, float] | None, size: int, min_quantum: int) -> tuple[DataFrame, list[int], list[float], dict[int, np.ndarray]]:
    """source -> (queue, member), each queue's tokens and weight, and the members' tokens of shared queues.

    totals: source, tokens.  A source with the share of a quantum has its own queue; the others share queues, in
    hashed groups each of at most about a quantum's share.  Only grouped figures and the members' tokens reach the
    driver.
    """
    from pyspark.sql import Window as W

    total = totals.agg(F.sum("tokens")).first()[0] or 0
    most = max(1, size // min_quantum)
    own = F.col("tokens") * F.lit(most) >= F.lit(total)
    rest = totals.filter(~own).agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, rest * most // max(total, 1))
    if targets is not None:
        own, groups = F.col("source").isin(*targets), 1
    group = F.when(own, F.concat(F.lit("="), F.coalesce("source", F.lit("")))).otherwise(F.concat(F.lit("~"), F.pmod(F.xxhash64("source"), F.lit(groups))))
    placed = totals.withColumn("queue", group).withColumn("member", F.row_number().over(W.partitionBy("queue").orderBy("source")) - 1)
    placed = written(placed.select("source", "queue", "member", "tokens"), "packing-queues")
    found = sorted((r["queue"], r["tokens"]) for r in placed.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect())
    names = [q for q, _ in found]
    given = targets or {}
    rest_weight = max(0.0, 1.0 - sum(given.values()))
    weights = [float(n) if targets is None else given.get(q[1:], rest_weight) if q[0] == "=" else rest_weight for q, n in found]
    index = F.create_map(*[x for i, q in enumerate(names) for x in (F.lit(q), F.lit(i))]) if names else F.create_map(F.lit(""), F.lit(0))
    placed = placed.select("source", index[F.col("queue")].alias("queue"), "member", "tokens")
    shared = placed.join(F.broadcast(placed.filter("member = 1").select("queue")), "queue").select("queue", "member", "tokens").toArrow()
    queue, member, tokens = (shared.column(i).to_numpy() for i in range(3))
    order = np.lexsort((member, queue))
    queue, tokens = queue[order], tokens[order]
    members = {int(k): tokens[queue == k] for k in np.unique(queue)}
    return placed.select("source", "queue", "member"), [n for _, n in found], weights, members


def pack(
    docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None,
    size: int = WINDOW_TOKENS, end_id: int = END_ID, min_quantum: int = MIN_QUANTUM, with_ids: bool = False, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset there.

    targets: share of the tokens by source while it lasts (what is missing to 1 goes to the other sources);
    None: each source's own share of the corpus, so that all queues end together.  Sequences are full but for
    the last one.  with_ids adds the piece's ids.  The text is never shuffled: ids are written once, and each
    document's start in its queue follows from totals per task and source.
    """
    tokens = written(tokenised(docs, tokenizer, F.col(doc_id), F.col(text), F.col(source), end_id), "packing-ids")
    parts = written(tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens")), "packing-totals")
    placed, totals, weights, members = queues(parts.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets, size, min_quantum)
    from pyspark.sql import Window as W

    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    bases = bases.join(placed, bases["source"].eqNullSafe(placed["source"])).select(bases["source"].alias("b_source"), bases["part"].alias("b_part"), "queue", "member", F.col("before").alias("b_base"))
    bases = written(bases, "packing-bases")
    if bases.count() <= broadcast_rows:
        bases = F.broadcast(bases)
    ready = tokens.join(bases, tokens["source"].eqNullSafe(bases["b_source"]) & (tokens["part"] == bases["b_part"]))
    ready = ready.select("doc_id", "source", "doc_tokens", "payload", "queue", "member", (F.col("b_base") + F.col("local_start")).alias("source_start"))

    def placed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, crc = Schedule(totals, weights, size), zlib.crc32
        turns = {q: Turns(n, min_quantum) for q, n in members.items()}
        for batch in batches:
            # Of each piece its place among all windows' tokens, its length and checksum; of each row its pieces.
            where: list[int] = []
            lengths: list[int] = []
            sums: list[int] = []
            pieces: list[int] = []
            ids: list[bytes] = []
            for n, payload, queue, member, begin in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                wide = memoryview(np.frombuffer(payload, dtype="<u2" if len(payload) == 2 * n else "<u4").astype("<u4").tobytes())
                start, before = 0, len(where)
                for at, most in turns[queue].runs(member, begin, n) if queue in turns else ((begin, n),):
                    for place, length in schedule.runs(queue, at, most):
                        end = start + 4 * length
                        where.append(place)
                        lengths.append(length)
                        sums.append(crc(wide[start:end]))
                        if with_ids:
                            ids.append(bytes(wide[start:end]))
                        start = end
                pieces.append(len(where) - before)
            yield _batch(batch, where, lengths, sums, pieces, size, ids if with_ids else None)

    return ready.mapInArrow(lean(placed_pieces), StructType([ready.schema["doc_id"], *StructType.fromDDL(PIECES + (", ids binary" if with_ids else "")).fields]))


def _batch(batch: pa.RecordBatch, where: list[int], lengths: list[int], sums: list[int], pieces: list[int], size: int, ids: list[bytes] | None) -> pa.RecordBatch:
    """PIECES of a batch's rows, of which each has so many."""
    row = np.repeat(np.arange(len(pieces)), pieces)
    place, length = np.array(where, dtype=np.int64), np.array(lengths, dtype=np.int64)
    through = np.cumsum(length) - length
    firsts = np.cumsum(pieces) - pieces
    start = through - through[firsts][row] if len(row) else through
    whole, source = (batch.column(i).take(pa.array(row)) for i in (2, 1))
    numbers = [start, length, np.array(sums, dtype=np.int64)]
    arrays = [batch.column(0).take(pa.array(row)), *map(pa.array, numbers), whole, pa.array(place // size), pa.array(place % size), source]
    names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())] if ids is not None else arrays, names=names + ["ids"] * (ids is not None))
