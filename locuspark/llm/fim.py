"""Fill-in-middle: a text's middle is moved behind its prefix and suffix, cut between units.

A unit is a run of ASCII letters or a single other code point.  One Aho-Corasick automaton finds the events of a text:
places where letters begin or end, and sentinels.  It reads the text with every code point folded into one of seven
ASCII characters, so that 27 patterns cover all of Unicode and places stay those of the text.  Between two events lies
either one run, which is one unit, or code points that are a unit each: prefix sums over the events give the number
of units, and a binary search in them the place where so many units end.  No unit is ever made into a string.

Form and cuts come from a SHA-256 of seed and id, so a row's result depends on nothing else.  A text that is empty or
holds a sentinel stays plain, and so does a share of the others.

Rows: null text is empty, and its output too; a null id is spelled as nothing; ids of any type are spelled as Spark
casts them; repeated rows are transformed alike; an empty table gives no rows; long texts take memory for their events
only; further columns are ignored.  Every row is transformed by itself, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locuspark.llm.workers import lean

# Sentinels, and the shares of plain and of suffix-first forms in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1
#: Rows whose outputs a worker holds at once.
ROWS = 256

_LETTERS, _OTHERS = "aPSM", " <>"
#: ASCII to the automaton's characters: those of sentinels stay, other letters are ``a``, all else is a space.
_FOLD = bytes(b if chr(b) in _LETTERS + _OTHERS else 0x61 if chr(b).isalpha() and b < 128 else 0x20 for b in range(256))


@cache
def automaton():
    """Pairs of which one is a letter, and sentinels (valued None)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for a in _LETTERS:
        for b in _OTHERS:
            out.add_word(a + b, 1)
            out.add_word(b + a, 1)
    for s in (PREFIX, SUFFIX, MIDDLE):
        out.add_word(s, 0)
    out.make_automaton()
    return out


class Units:
    """Where a text's units end, from the places at which letters begin or end."""

    def __init__(self, text: str):
        folded = text.encode("ascii", "replace").translate(_FOLD).decode("ascii")
        events = np.fromiter((2 * end + kind for end, kind in automaton().iter(folded)), dtype=np.int64)
        #: Whether the text holds a sentinel.
        self.marked = bool((events & 1 == 0).any())
        #: Stretches of one class: the first begins at 0, and classes take turns.
        self.starts = np.concatenate([[0], events[events & 1 == 1] >> 1, [len(text)]])
        #: Whether the stretches with an even number are runs of letters.
        self.even = bool(folded) and folded[0] in _LETTERS
        lengths = np.diff(self.starts)
        lengths[0 if self.even else 1 :: 2] = 1
        self.before = np.concatenate([[0], np.cumsum(lengths)])
        self.count = int(self.before[-1]) if text else 0

    def end(self, n: int) -> int:
        """Code points of the first n units."""
        if n <= 0:
            return 0
        k = int(np.searchsorted(self.before, n)) - 1  # the stretch in which the n-th unit ends
        run = (k % 2 == 0) == self.even
        return int(self.starts[k + 1]) if run else int(self.starts[k] + n - self.before[k])


def draws(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def transform(doc_id: str, text: str, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, and of the middle, output)."""
    units = Units(text)
    n = units.count
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or units.marked or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.end(low), units.end(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of.  A transformed text holds no sentinel, and none can arise where parts meet."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"not an output of form {form}")
    x, rest = output[len(first) :].split(second, 1)
    y, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (x, y) if form == "psm" else (y, x)
    return prefix + middle + suffix


MADE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transform(i, t, seed) for i, t in zip(batch["_id"].to_pylist(), batch["_text"].to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), blank(doc_id).alias("_id"), blank(text).alias("_text"))
    return rows.mapInArrow(lean(run, ROWS), StructType([rows.schema["doc_id"], *StructType.fromDDL(MADE).fields]))


def restored(made: DataFrame) -> DataFrame:
    """made with text: what output and form give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o, f) for o, f in zip(batch["output"].to_pylist(), batch["form"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return made.mapInArrow(lean(run, ROWS), StructType([*made.schema.fields, *StructType.fromDDL("text string").fields]))


def digest(made: DataFrame) -> DataFrame:
    """The columns of the query; what is restored comes from output and form alone."""
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
