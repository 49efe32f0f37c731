"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Texts and items are lower-cased (A-Z) and split into words of digits, letters and all characters beyond ASCII.  The
automaton reads words, not characters: each word of the items is one symbol.  Its patterns are the items shorter than a
window, whole, and of longer items every seventh run of seven words: a window of 13 words holds one of
these runs, wherever it begins, so that the automaton has a node for a word of the items and not for a word of each
window.  Where a run is found, the words on both sides are compared until 13 or more agree, or don't.  What is found is
mapped back to words, and to code points of the original text.

The benchmark is sent to the executors in blocks of about ``block_bytes``; normally there is one.  A worker builds a
block's automaton once and keeps HELD_BLOCKS of them; with more blocks it holds so many bytes of texts and reads them
once with each block.  Texts are never shuffled, and neither the driver nor a worker ever holds the whole benchmark.

Rows: null text has no words and is clean; items without words are ignored, and so are null ids in the lists of
items, though their windows count as hits; items that share an id are one item; repeated rows are judged each for
itself; an empty benchmark or table is allowed; ids of any type are kept as they are; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locuspark.llm.workers import lean

WINDOW_WORDS = 13
#: A document is contaminated from one hit word in so many on.
HIT_SHARE = 20
#: Bytes of items in a block (a word of four letters and more is a symbol, and there are a million of these), automata
#: that a worker keeps, and bytes of texts that it holds where there are more blocks than that.
BLOCK_BYTES = 2 << 20
HELD_BLOCKS = 4
HOLD_BYTES = 64 << 20
#: Places of runs with the words around them that a worker remembers.
MEMO_ENTRIES = 200_000

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of UTF-8 to lower case, with a space for all that isn't part of a word.
_FOLD = bytes(x if (x := b + 32 if 0x41 <= b <= 0x5A else b) in _KEEP else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text: str | None) -> list[bytes]:
    """The words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


#: Letters that a symbol is spelled with, other ones at each place: the automaton tries a node's children one by one.
LETTERS = 128


def _symbol(n: int) -> str:
    """The n-th symbol as one character; the first stands for words that no item has, and there are none among the surrogates."""
    return chr(n + 1 if n < 0xD7FF else n + 0x801)


def _spelled(n: int, width: int) -> str:
    """The n-th symbol in letters; a pattern's first letter only fits a symbol's first."""
    return "".join([chr(1 + LETTERS * j + n // LETTERS**j % LETTERS) for j in range(width)])


class Automaton:
    """Finds the windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW_WORDS):
        import ahocorasick

        self.ids, self.size, self.run = [i for i, _ in items], size, (size + 1) // 2
        self.symbols: dict[bytes, str] = {}
        self.texts: list[str] = []
        found: dict[str, tuple[list[int], list[tuple[int, int]]]] = {}
        for k, (_, text) in enumerate(items):
            words = normalised(text)
            for w in words:
                if w not in self.symbols:
                    self.symbols[w] = _symbol(len(self.symbols) + 1)
            item = "".join([self.symbols[w] for w in words])
            self.texts.append(item)
            if not item:
                continue
            if len(item) < size:
                found.setdefault(item, ([], []))[0].append(k)
            else:
                for at in self._runs(item):
                    found.setdefault(item[at : at + self.run], ([], []))[1].append((k, at))
        self.width = next(n for n in (1, 2, 3) if len(self.symbols) <= LETTERS**n)
        self.letters = {w: _spelled(n, self.width) for n, w in enumerate(self.symbols)}
        letters = dict(zip(self.symbols.values(), self.letters.values(), strict=True))
        self.inner = ahocorasick.Automaton()
        for n, (pattern, (whole, places)) in enumerate(found.items()):
            self.inner.add_word("".join([letters[c] for c in pattern]), (n, len(pattern), tuple(whole), tuple(places)))
        self.empty = not found
        self.memo: dict[tuple[int, int, str], list[tuple[int, int, int]]] = {}
        if found:
            self.inner.make_automaton()

    def _runs(self, item: str) -> Iterator[int]:
        """Places of runs that a window needs which the item doesn't have further left."""
        last = len(item) - self.size
        seen: set[str] = set()
        fresh = []
        for i in range(last + 1):
            window = item[i : i + self.size]
            fresh.append(window not in seen)
            seen.add(window)
        for at in range(0, len(item) - self.run + 1, self.run):
            if any(fresh[max(0, at - self.size + self.run) : at + 1]):
                yield at

    def _around(self, text: str, start: int, places: tuple[tuple[int, int], ...]) -> list[tuple[int, int, int]]:
        """(words before the run, words behind it, item) where a whole window agrees."""
        out, end, most = [], start + self.run, self.size - self.run
        for k, at in places:
            item, left, right = self.texts[k], 0, 0
            while left < most and left < min(start, at) and text[start - left - 1] == item[at - left - 1]:
                left += 1
            stop = at + self.run
            while right < most and end + right < len(text) and stop + right < len(item) and text[end + right] == item[stop + right]:
                right += 1
            if left + self.run + right >= self.size:
                out.append((left, right, k))
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first word, end word) stretches that are hit, and the positions of the items hit."""
        if self.empty or not words:
            return [], set()
        get, none, width = self.letters.get, "\0" * self.width, self.width
        text = ""
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        most = self.size - self.run
        for last, (pattern, length, whole, places) in self.inner.iter("".join([get(w, none) for w in words])):
            end = (last + 1) // width
            start = end - length
            if whole:
                hits.append((start, end))
                items.update(whole)
            if places:
                text = text or "".join([self.symbols.get(w, _symbol(0)) for w in words])
                before = min(start, most)
                key = (pattern, before, text[start - before : end + most])
                around = self.memo.get(key)
                if around is None:
                    if len(self.memo) >= MEMO_ENTRIES:
                        self.memo.clear()
                    around = self.memo[key] = self._around(text, start, places)
                for left, right, k in around:
                    hits.append((start - left, end + right))
                    items.add(k)
        return merged(hits), items


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches without overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def original(text: str, hits: list[tuple[int, int]]) -> list[dict]:
    """Stretches of words as (start, end) code points of the original text."""
    places = [m.span() for m in _WORD.finditer(text)] if hits else []
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in hits]


FOUND = "n_words bigint, hits array<struct<start:bigint,end:bigint>>, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"


_held: dict[tuple[str, int], Automaton] = {}


def _automaton(run: str, block: int, items: list[tuple[str | None, str]], size: int) -> Automaton:
    """A block's automaton, built once by each worker while it keeps no more than HELD_BLOCKS."""
    key = (run, block)
    if key not in _held:
        while len(_held) >= HELD_BLOCKS:
            del _held[next(iter(_held))]
        _held[key] = Automaton(items, size)
    return _held[key]


def find(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """doc_id, with carry the whole row as a struct, n_words, hits (stretches of words), item_ids (sorted), spans (code points) and n_hit."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text").cast("bigint") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = lambda k: [(r["id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()]
    sent = [docs.sparkSession.sparkContext.broadcast(part(k)) for k in range(blocks)]  # one block at a time
    name, pairs = uuid.uuid4().hex, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def judged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: list[list[list[tuple[int, int]]]] = [[[] for _ in range(b.num_rows)] for b in batches]
        ids: list[list[set[str]]] = [[set() for _ in range(b.num_rows)] for b in batches]
        counts: list[list[int]] = [[0] * b.num_rows for b in batches]
        for k, block in enumerate(sent):
            automaton = _automaton(name, k, block.value, size)
            for n, batch in enumerate(batches):
                for i, t in enumerate(batch["__text"].to_pylist()):
                    words = normalised(t)
                    counts[n][i] = len(words)
                    found, which = automaton.scan(words)
                    if found:
                        hits[n][i] += found
                        ids[n][i].update(x for j in which if (x := automaton.ids[j]) is not None)
        for n, batch in enumerate(batches):
            found = [merged(h) if h else [] for h in hits[n]]
            spans = [original(t.as_py() or "", h) if h else [] for t, h in zip(batch["__text"], found, strict=True)]
            more = [pa.array(counts[n], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in h] for h in found], pairs), pa.array([sorted(x) for x in ids[n]], pa.list_(pa.string())), pa.array(spans, pairs)]
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *more], names=[*kept, "n_words", "hits", "item_ids", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if blocks <= HELD_BLOCKS or sum(b.nbytes for b in held) >= HOLD_BYTES:
                yield from judged(held)
                held = []
        if held:
            yield from judged(held)

    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.struct(*(docs[c] for c in docs.columns)).alias("row")] * carry, F.col(text).cast("string").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    out = rows.mapInArrow(lean(run), StructType([*fields, *StructType.fromDDL(FOUND).fields]))
    return out.select("*", F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["end"] - h["start"]).alias("n_hit"))


def contaminated(n_words, n_hit):
    return (n_hit > 0) & (HIT_SHARE * n_hit >= n_words)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """docs without the contaminated rows."""
    found = find(docs, benchmark, carry=True, **columns)
    return found.filter(~contaminated(F.col("n_words"), F.col("n_hit"))).select("row.*")
