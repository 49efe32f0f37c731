"""Groups spelling variants: words that differ by one code point meet under rolling-hash deletion keys.

Words are counted over the corpus first.  All runs of a text are found at once, counted by text and by task before the
shuffle.  Then every word of the vocabulary has a key for each of its code points: the polynomial hash of the word
without it, put together from the hashes of what stands before and behind, for all words of a length at once in NumPy.
Two words that differ by a replacement have the same key at the same place; a word that another one makes by a deletion
has that one's key as its own hash.  Keys are dealt out by their radix and sorted; those that only one word has go.  For
what is left the strings themselves are compared: members meet under the string without the code point, so a collision
of hashes joins nothing.

Members of a string differ from each other in one place only, so that there are few: their number is the number of near
words, and the most frequent one and the next serve all of them.  No pair is ever written.  Forms are followed to their
roots by pointer doubling on tables, in as many rounds as the chain's length has binary digits; a chain at least doubles
its count with each step.

Rows: null text has no words; a null id is spelled as nothing, and ids of any type as Spark casts them; repeated rows
count again; an empty table gives no words; a run of any length is one word, and its keys take memory for its code
points, not their square; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.llm.workers import lean
from locuspark.storage import release, written

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run loses a code point if this divides its hash.
TYPO_EVERY = 97
#: A form has so many times the word's count at least.
FORM_TIMES = 2
#: Bytes of words that a worker counts before it passes them on, and code points whose keys it makes at once.
HELD_BYTES = 24 << 20
CHUNK_POINTS = 1 << 18
#: Words, or keys, that a worker takes at once, and the bits of a key below the radix.
KEY_ROWS = 50_000
RADIX_SHIFT = 46

#: Letters of UTF-8: A-Z, a-z and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- words ----------------------------------------------------------------------------------------------------


def shortened(run: bytes, h: int) -> bytes:
    """run without its code point h % length."""
    points = run.decode("utf-8")
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode("utf-8")


def text_words(doc_id: str, text: str) -> Counter[bytes]:
    """A text's words of at least LEAST_LENGTH code points, after deletions."""
    found = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)))
    before = crc32(f"{doc_id}:".encode())
    # A result may be a run of the text as well, which has its own hash: take all out before any is put back.
    moved = [(run, found.pop(run)) for run in [r for r in found if not crc32(r, before) % TYPO_EVERY]]
    for run, n in moved:
        found[shortened(run, crc32(run, before))] += n
    return found


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_length: int = LEAST_LENGTH, held: int = HELD_BYTES) -> DataFrame:
    """(word, n) for each distinct word; tasks count before the shuffle, and pass on what they hold when it is much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for i, t in zip(batch["_id"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                for word, n in text_words(i, t).items():
                    # A code point has two bytes at most.
                    if len(word) >= least_length and (len(word) >= 2 * least_length or len(word.decode("utf-8")) >= least_length):
                        if word not in total:
                            size += len(word) + 100
                        total[word] = total.get(word, 0) + n
                if size >= held:
                    yield out()
                    size = 0
        yield out()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(blank(doc_id).alias("_id"), blank(text).alias("_text")).mapInArrow(lean(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# --- keys -----------------------------------------------------------------------------------------------------

# Two primes under 2**31 and a base for each, so that products stay within 64 bits.
PRIMES = ((2147483647, 1103515245), (2147483629, 1220703125))


def deletion_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equally many code points: the words' own hashes, and those without each code point."""
    rows, length = words.shape
    whole, without = np.zeros(rows, np.uint64), np.zeros((rows, length), np.uint64)
    points = words.astype(np.uint64) + np.uint64(1)
    for prime, base in PRIMES:
        p, b = np.uint64(prime), np.uint64(base)
        head = np.zeros((rows, length + 1), np.uint64)  # of what stands before each place
        tail = np.zeros((rows, length + 1), np.uint64)  # of what stands behind it, from the right
        power = np.ones(length + 1, np.uint64)
        for i in range(length):
            head[:, i + 1] = (head[:, i] * b + points[:, i]) % p
            power[i + 1] = power[i] * b % p
        for i in range(length - 1, -1, -1):
            tail[:, i] = (tail[:, i + 1] + points[:, i] * power[length - 1 - i]) % p
        made = (head[:, :-1] * power[length - 1 :: -1][None, :length] + tail[:, 1:]) % p
        whole, without = (whole << np.uint64(31)) | head[:, -1], (without << np.uint64(31)) | made
    return whole, without


def word_keys(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, first, key) of all words: place -1 is the word itself, else the code point that is left out.

    Leaving out any of several equal neighbours makes the same string; ``first`` marks the first of them.
    """
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        length = int(lengths[order[lo]])
        hi = min(int(np.searchsorted(lengths[order], length, "right")), lo + max(1, CHUNK_POINTS // max(1, length)))
        rows = order[lo:hi]
        points = np.frombuffer("".join([words[i] for i in rows.tolist()]).encode("latin-1"), np.uint8).reshape(len(rows), length)
        whole, without = deletion_hashes(points)
        first = np.ones((len(rows), length), bool)
        first[:, 1:] = points[:, 1:] != points[:, :-1]
        yield rows, np.full(len(rows), -1), np.ones(len(rows), bool), whole
        yield np.repeat(rows, length), np.tile(np.arange(length), len(rows)), first.ravel(), without.ravel()
        lo = hi


KEYS = "id bigint, place int, first boolean, key bigint"


def deletion_keys(vocabulary: DataFrame) -> DataFrame:
    """(id, place, first, key): length + 1 rows for each word, without the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for row, place, first, key in word_keys(batch["word"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(place.astype(np.int32)), pa.array(first), pa.array(key.view(np.int64))], names=["id", "place", "first", "key"])

    return vocabulary.select("id", "word").mapInArrow(lean(run, KEY_ROWS), KEYS)


def shared(place: np.ndarray, first: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of rows sorted by key and place, whether another word has the same key at that place, or is that string itself."""
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    cell = edge | np.concatenate([[True], place[1:] != place[:-1]])
    at = np.cumsum(cell) - 1
    several = np.bincount(at)[at] > 1
    group = np.cumsum(edge) - 1
    whole = np.bincount(group, weights=place < 0)[group] > 0
    cut = np.bincount(group, weights=(place >= 0) & first)[group] > 0
    return np.where(place < 0, cut, several | (whole & first))


def candidates(keys: DataFrame) -> DataFrame:
    """(id, place, first) of the keys that several words share, dealt by the keys' leading bits and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(rows: pa.Table) -> list[pa.RecordBatch]:
            keep = shared(rows["place"].to_numpy(), rows["first"].to_numpy(), rows["key"].to_numpy())
            return rows.select(["id", "place", "first"]).filter(pa.array(keep)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                yield from out(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield from out(held)

    dealt = keys.repartition(F.shiftrightunsigned("key", RADIX_SHIFT)).sortWithinPartitions("key", "place")
    return dealt.mapInArrow(lean(run, KEY_ROWS), "id bigint, place int, first boolean")


# --- near words -----------------------------------------------------------------------------------------------


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best): the number of near words, and the most frequent one as struct<less, word>, less is -n."""
    named = candidates(deletion_keys(vocabulary)).join(vocabulary, "id")
    left = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    named = named.select(left.alias("left"), "place", "first", "word", "n")
    # Words with the same place left out are all near each other; those with any place left out are near the word that is left.
    cells = named.select("*", F.explode(F.when(F.col("place") < 0, F.array(F.lit(-1))).when(F.col("first"), F.array("place", F.lit(-1))).otherwise(F.array("place"))).alias("cell"))
    cell = W.partitionBy("left", "cell")
    ranked, all_rows = cell.orderBy(F.desc("n"), "word"), cell.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    over = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shown = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    seen = cells.select(
        "word", "n", "place", "cell", shown.alias("own"), F.count("*").over(all_rows).alias("size"), F.first(shown).over(over).alias("top"),
        F.nth_value(shown, 2).over(over).alias("next"), F.max(F.when(F.col("place") < 0, shown)).over(all_rows).alias("whole"),
    )
    spoke = (F.col("cell") < 0) & (F.col("place") >= 0)
    others = F.when(spoke, F.when(F.col("whole").isNull(), 0).otherwise(1)).otherwise(F.col("size") - 1)
    best = F.when(spoke, F.col("whole")).when(F.col("top") == F.col("own"), F.col("next")).otherwise(F.col("top"))
    links = seen.select("word", "n", others.cast("bigint").alias("others"), best.alias("best"))
    alone = vocabulary.select("word", "n", F.lit(0).cast("bigint").alias("others"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best"))
    return links.union(alone).groupBy("word", "n").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round doubles how far a word sees."""
    seen = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = seen.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        step = seen.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        step = written(step, "spelling-roots")
        release(seen)
        if step.filter("moved").isEmpty():
            return step.drop("moved")
        seen = step


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, held: int = HELD_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary."""
    counted = counts(docs, doc_id, text, least_length=least_length, held=held).filter(F.col("n") >= least_count)
    vocabulary = written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    follows = -F.col("best.less") >= FORM_TIMES * F.col("n")
    formed = written(near(vocabulary).select("word", "n", "n_near", F.when(follows, F.col("best.word")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")), "spelling-forms")
    found = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
