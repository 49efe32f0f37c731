"""Sequential decoders of alignment text, for use inside Arrow or Pandas functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_MD = re.compile(r"(\d+)|\^([A-Z]+)|([A-Z])")
# Order of variant types at one position.
TYPE_RANK = {"insertion": 0, "single": 1, "deletion": 2, "match": 3}


@dataclass(frozen=True)
class Piece:
    """A stretch of an alignment: match, single, insertion or deletion, at a 0-based reference position."""

    typ: str
    pos: int
    length: int
    val: str | None = None


class _Matched:
    """Bases of the MD string that an M operation consumes: runs of matches and single mismatches."""

    def __init__(self, md: str):
        self.tokens = [(int(n), "", "") if n else (0, d, m) for n, d, m in _MD.findall(md)]
        self.tokens = [t for t in self.tokens if t != (0, "", "")]
        self.at = 0

    def take(self, most: int) -> tuple[int, bool]:
        """(bases, is a mismatch) of the next stretch, of so many bases at most."""
        if self.at >= len(self.tokens):
            return most, False
        n, _, letter = self.tokens[self.at]
        if letter:
            self.at += 1
            return 1, True
        if not n:
            raise ValueError("MD has a deletion where the CIGAR has none")
        used = min(n, most)
        if used == n:
            self.at += 1
        else:
            self.tokens[self.at] = (n - used, "", "")
        return used, False

    def deletion(self, n: int) -> None:
        if self.at >= len(self.tokens) or len(self.tokens[self.at][1]) != n:
            raise ValueError("MD doesn't have the CIGAR's deletion")
        self.at += 1

    def done(self) -> bool:
        return self.at >= len(self.tokens)


def decode(pos: int, cigar: str, seq: str, md: str) -> tuple[list[Piece], int, int]:
    """Pieces of a record (1-based pos) in order, and its soft clips at head and tail.

    An M operation is cut at each MD letter; MD runs may go on over the next operation.  Skipped references and other
    operations aren't supported.
    """
    at, read, pieces, clips, matched = pos - 1, 0, [], [0, 0], _Matched(md)
    operations = _CIGAR.findall(cigar)
    for k, (size, op) in enumerate(operations):
        n = int(size)
        if op == "M":
            while n:
                used, mismatch = matched.take(n)
                pieces.append(Piece("single", at, 1, seq[read]) if mismatch else Piece("match", at, used))
                at, read, n = at + used, read + used, n - used
        elif op == "I":
            pieces.append(Piece("insertion", at, 0, seq[read : read + n]))
            read += n
        elif op == "D":
            matched.deletion(n)
            pieces.append(Piece("deletion", at, n, str(n)))
            at += n
        elif op == "S":
            clips[0 if k == 0 else 1] = n
            read += n
        else:
            raise NotImplementedError(f"CIGAR operation {op}")
    if read != len(seq) or not matched.done():
        raise ValueError("CIGAR, MD and sequence don't end together")
    joined: list[Piece] = []
    for p in pieces:
        if joined and p.typ == joined[-1].typ == "match" and joined[-1].pos + joined[-1].length == p.pos:
            joined[-1] = Piece("match", joined[-1].pos, joined[-1].length + p.length)
        else:
            joined.append(p)
    return joined, clips[0], clips[1]


def pileup_bases(text: str) -> list[str]:
    """Bases of a pileup column; starts with their quality, ends and indel texts are left out, * stays."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "^":
            i += 2
        elif c in "+-":
            j = i + 1
            while j < len(text) and text[j].isdigit():
                j += 1
            i = j + int(text[i + 1 : j])
        else:
            if c != "$":
                out.append(c)
            i += 1
    return out


def gaps(seq: str) -> list[tuple[int, int]]:
    """(position, length) of runs of gaps."""
    return [(m.start(), m.end() - m.start()) for m in re.finditer("-+", seq)]


def left_aligned(ref: str, seq: str) -> str:
    """seq with its gaps moved left wherever the bases that they jump over agree with ref as before.

    Of a gap, as many columns as can move go at once, over as many bases; the rest and what moved are tried again,
    the leftmost gap first.
    """
    import heapq

    chars = list(seq)
    waiting = gaps(seq)
    heapq.heapify(waiting)
    while waiting:
        pos, size = heapq.heappop(waiting)
        step = next((n for n in range(min(size, pos), 0, -1) if _may_jump(ref, chars, pos, n)), 0)
        if not step:
            continue
        chars[pos - step : pos + step] = chars[pos : pos + step] + chars[pos - step : pos]
        heapq.heappush(waiting, (pos - step, step))
        if step < size:
            heapq.heappush(waiting, (pos + step, size - step))
    return "".join(chars)


def _may_jump(ref: str, chars: list[str], pos: int, n: int) -> bool:
    bases = chars[pos - n : pos]
    return "-" not in bases and all((ref[pos - n + k] == b) == (ref[pos + k] == b) for k, b in enumerate(bases))


def local_matches(a: str, b: str) -> int:
    """Most matching bases of any alignment without penalties."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]
