"""Exact byte-level BPE encoding on top of the ``tokenizers`` library, each distinct word of a batch once.

Byte-level BPE never merges across pre-tokens, and between two non-space characters a single space
always opens a pre-token.  A text can therefore be cut at such spaces, each distinct piece encoded once
by the library, and the pieces' ids joined: the result equals encoding the whole text.  Texts with
irregular white space are cut only where the rule holds; a text holding the string of a special token
is encoded whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most words remembered by a Python worker (about 120 bytes each).
MEMO_ENTRIES = 100_000
#: Bytes of text whose words are told apart at once, and words in a call of the library.
CHUNK_BYTES = 8 << 20
CALL_WORDS = 50_000
#: Rows of a batch that are encoded at once.
ENCODE_ROWS = 4000
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
# Letters of Latin script, which are letters to every version of the library.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
# White space and control characters: a superset of what any of the libraries takes for white space.
_SPACE = r"[\x00-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_IRREGULAR = rf"{_SPACE} | {_SPACE}|\A{_SPACE}|{_SPACE}\z"


def _byte_letters() -> np.ndarray:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(256, dtype="<u2")
    table[plain] = plain
    others = np.setdiff1d(np.arange(256), plain)
    table[others] = 256 + np.arange(len(others))
    return table


class ByteBpe:
    """Encoder of one tokenizer file; ids travel as little-endian uint16 or, for large vocabularies, uint32."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how the file writes a space
        # A word of letters is one pre-token, so it needs the file's model but not its pre-tokenizer.
        self.whole, self.letters = self.tokenizer.pre_tokenizer, pre_tokenizers.CharDelimiterSplit(" ")
        self.bytes = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        """No word is known: ids lie one behind the other in pool, and memo has a word's place in starts and sizes."""
        self.memo: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, dtype=self.dtype), 0
        self.starts, self.sizes = (np.empty(1 << 14, dtype=np.int64) for _ in range(2))

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _add(self, words: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        """Remembers words by their ids, that begin at cuts."""
        n, k = len(words), len(self.memo)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while k + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[k : k + n] = cuts + self.used
        self.sizes[k : k + n] = np.diff(cuts, append=len(ids))
        self.used += len(ids)
        self.memo.update(zip(words, range(k, k + n), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Encodes words as they stand after a single space, many in one call: only a word's first token begins with the space."""
        plain, others = [], []
        for w in words:
            (plain if _LETTERS(w) else others).append(w)
        for lo in range(0, len(plain), CALL_WORDS):
            part = plain[lo : lo + CALL_WORDS]
            raw = np.frombuffer((" " + "  ".join(part)).encode(), dtype=np.uint8)
            mapped = self.bytes[raw]
            # Of two spaces between words the first is the delimiter, the second the word's own.
            spaces = np.flatnonzero(raw == 32)
            mapped[spaces[1::2]] = 32
            self._cut(part, mapped.tobytes().decode("utf-16-le"), self.letters)
        odd = [w for w in others if " " in w]
        others = [w for w in others if " " not in w] if odd else others
        for lo in range(0, len(others), CALL_WORDS):
            part = others[lo : lo + CALL_WORDS]
            self._cut(part, " " + " ".join(part), self.whole)
        for w in odd:
            self._add([w], np.frombuffer(self._encode(" " + w), dtype=self.dtype), np.zeros(1, dtype=np.int64))

    def _cut(self, words: list[str], text: str, splitter) -> None:
        self.tokenizer.pre_tokenizer = splitter
        try:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        finally:
            self.tokenizer.pre_tokenizer = self.whole
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) != len(words):
            raise ValueError("the tokenizer doesn't begin words at spaces")
        self._add(words, ids, cuts)

    def _after_space(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in starts and sizes, as they stand after a space, with no white space at their ends."""
        if len(self.memo) > MEMO_ENTRIES:
            known = [w for w in words if w in self.memo]
            places = np.array([self.memo[w] for w in known], dtype=np.int64)
            pool, starts, sizes = self.pool, self.starts[places], self.sizes[places]
            self._forget()
            ids = pool[_spread(starts, sizes)]
            self._add(known, ids, np.cumsum(sizes) - sizes)
        get = self.memo.get
        codes = np.array([get(w, -1) for w in words], dtype=np.int64)
        fresh = np.flatnonzero(codes < 0)
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            self._learn(new)
            codes[fresh] = [get(w) for w in new]
        return codes

    def _irregular(self, text: str) -> bytes:
        """A text with white space that a plain cut at spaces doesn't fit."""
        if any(s in text for s in self.special):
            return self._encode(text)
        first, *words = _SAFE_CUT.split(text)
        last = self._encode(" " + words.pop()) if words else b""
        places = {w: i for i, w in enumerate(dict.fromkeys(words))}
        codes = self._after_space(list(places))[[places[w] for w in words]] if words else np.zeros(0, dtype=np.int64)
        middle = self.pool[_spread(self.starts[codes], self.sizes[codes])].tobytes()
        return b"".join([self._encode(first), middle, last])

    def _regular(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        words = split.flatten()
        coded = words.dictionary_encode()
        codes = self._after_space(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        starts, sizes = self.starts[codes], self.sizes[codes]
        # A text's first word has no space before it.
        firsts = offsets[:-1]
        opening = [self._encode(w) for w in words.take(pa.array(firsts)).to_pylist()]
        own = np.frombuffer(b"".join(opening), dtype=self.dtype)
        sizes[firsts] = np.fromiter(map(len, opening), dtype=np.int64, count=len(opening)) // self.dtype.itemsize
        starts[firsts] = self.used + np.cumsum(sizes[firsts]) - sizes[firsts]
        while self.used + len(own) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(own)] = own  # behind the words that are remembered, for this call only
        raw = self.pool[_spread(starts, sizes)].tobytes()
        cuts = [0, *(np.cumsum(sizes)[offsets[1:] - 1] * self.dtype.itemsize).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of whole texts, as raw bytes of ``dtype``; nothing for a null or empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[bytes] = []
        at, sizes = 0, np.cumsum(pc.binary_length(texts).to_numpy())
        while at < len(texts):
            done = int(sizes[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, side="right")))
            part = texts.slice(at, stop - at)
            odd = pc.or_(pc.equal(part, ""), pc.match_substring_regex(part, _IRREGULAR))
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(part, s))
            regular = part.filter(pc.invert(odd))
            plain = iter(self._regular(regular) if len(regular) else [])
            odd_texts = iter(part.filter(odd).to_pylist())
            for o in odd.to_pylist():
                out.append(next(plain) if not o else self._irregular(t) if (t := next(odd_texts)) else b"")
            at = stop
        return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(sizes)
    where = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    where += np.arange(len(where), dtype=np.int32)
    return where


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """The encoder of a Python worker: one for all its tasks, so that words learned in one are known in the next."""
    return ByteBpe(path)
