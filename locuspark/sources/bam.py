"""Binary alignments (BAM in BGZF blocks, with BAI indexes) as a Spark data source, and a writer of indexed shards.

A file is read in splits.  With an index, splits and regions come from its bins and linear index: only blocks that may
hold a wanted record are read.  Without one, a split is a range of bytes; its reader looks for the first block that is
followed by another and there for the first place from which several records follow each other, and the split before
ends where this one begins, since it looks for the same place.  Long records may span blocks.

Options: path (a file or folder), regions (``contig`` or ``contig:start-end``, 1-based closed, separated by blanks),
outside (regions to leave out), required and excluded (bits of the flag), split (bytes).  With Python filter pushdown
switched on, conditions on rname and pos choose regions as well.  Rows are those of alignments.read_sam; ``line`` is the
record's virtual offset, which rises within a file.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "file STRING, line BIGINT, qname STRING, flag INT, rname STRING, pos INT, mapq INT, cigar STRING, rnext STRING, pnext INT, tlen INT, seq STRING, qual STRING, nh INT, nm INT, md STRING, zs STRING, sam STRING"
SPLIT_BYTES = 32 << 20
#: Rows of a batch, records that must follow a guessed place, and bytes of a block's content in files that we write.
BATCH_ROWS, CHAIN, BLOCK_BYTES = 10_000, 8, 0xFF00

# Fixed values of the format.
BASES, OPERATIONS, QUERY_OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", "MDN=X"
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
DEEPEST, WINDOW_SHIFT = 5, 14
#: Positions that an index can tell; a contig's reads may lie behind its length in the header.
INDEXED = 1 << WINDOW_SHIFT + 3 * DEEPEST

_NIBBLES = str.maketrans("0123456789abcdef", BASES)
_QUALITIES = bytes(min(b + 33, 126) for b in range(256))
_DIGITS = bytes(ord(f"{max(BASES.find(chr(b)), 0):x}") if chr(b) in BASES else ord("f") for b in range(256))
_SCORES = bytes((b - 33) % 256 for b in range(256))
_FIXED = struct.Struct("<iiBBHHHiiii")
Region = tuple[str, int, int]


def parse_regions(text: str) -> list[Region]:
    """(contig, start, end), 0-based half-open; end -1 is the contig's."""
    out = []
    for word in text.split():
        m = re.fullmatch(r"(.+):([\d,]+)(?:-([\d,]+))?", word)
        out.append((m[1], int(m[2].replace(",", "")) - 1, int(m[3].replace(",", "")) if m[3] else -1) if m else (word, 0, -1))
    return out


# --- blocks ---------------------------------------------------------------------------------------------------


class Blocks:
    """A file's blocks by compressed offset; read counts those that were inflated."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.read = handle, size, 0

    def _length(self, head: bytes) -> int:
        """A block's bytes, from its first ones; 0 if these don't begin a block."""
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return 0
        extra, at = int.from_bytes(head[10:12], "little"), 12
        while at + 6 <= min(12 + extra, len(head)):
            if head[at : at + 4] == b"BC\x02\x00":
                return int.from_bytes(head[at + 4 : at + 6], "little") + 1
            at += 4 + int.from_bytes(head[at + 2 : at + 4], "little")
        return 0

    def inflate(self, at: int) -> tuple[bytes, int]:
        """A block's content and where the next one begins; nothing at the file's end."""
        if at >= self.size:
            return b"", self.size
        raw = self.handle.read_at(min(1 << 16, self.size - at), at)
        length = self._length(raw)
        if not length:
            raise ValueError(f"no block at {at}")
        self.read += 1
        skip = 12 + int.from_bytes(raw[10:12], "little")
        return zlib.decompress(raw[skip : length - 8], -15), at + length

    def first(self, at: int) -> int:
        """Where the first block at or behind a byte begins: it is followed by another one, or by the file's end."""
        while at < self.size:
            part = self.handle.read_at(min(1 << 17, self.size - at), at)
            for m in re.finditer(rb"\x1f\x8b\x08\x04", part):
                length = self._length(part[m.start() : m.start() + 64])
                behind = at + m.start() + length
                if length and (behind == self.size or self._length(self.handle.read_at(min(64, self.size - behind), behind) if behind < self.size else b"")):
                    return at + m.start()
            at += max(1, len(part) - 64) if at + len(part) < self.size else len(part)
        return self.size


def stream(blocks: Blocks, start: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, record without its length) from a record's virtual offset to the file's end."""
    at, skip = start >> 16, start & 0xFFFF
    data, places = b"", []  # places: (position in data, compressed offset) of the blocks in data

    def more() -> bool:
        nonlocal at, data, skip
        while at < blocks.size:
            here = at
            content, at = blocks.inflate(at)
            if content:
                places.append((len(data) - skip, here))
                data += content[skip:]
                skip = 0
                return True
        return False

    p = 0
    while True:
        if p >= len(data) and not more():
            return
        while len(places) > 1 and places[1][0] <= p:
            places.pop(0)
        virtual = places[0][1] << 16 | p - places[0][0]
        while len(data) < p + 4:
            if not more():
                raise ValueError("a record breaks off")
        size = int.from_bytes(data[p : p + 4], "little")
        while len(data) < p + 4 + size:
            if not more():
                raise ValueError("a record breaks off")
        yield virtual, data[p + 4 : p + 4 + size]
        p += 4 + size
        if p > 1 << 20:
            data, places[:] = data[p:], [(a - p, b) for a, b in places]
            p = 0


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    first: int  # virtual offset of the first record


def read_header(blocks: Blocks) -> Header:
    data, at, ends = b"", 0, []

    def need(n: int) -> None:
        nonlocal data, at
        while len(data) < n:
            if at >= blocks.size:
                raise ValueError("a header breaks off")
            here = at
            content, at = blocks.inflate(at)
            ends.append((len(data), here))
            data += content

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    p = 8 + int.from_bytes(data[4:8], "little")
    need(p + 4)
    text, count = data[8:p].rstrip(b"\0").decode(), int.from_bytes(data[p : p + 4], "little")
    p += 4
    names, lengths = [], []
    for _ in range(count):
        need(p + 4)
        n = int.from_bytes(data[p : p + 4], "little")
        need(p + 8 + n)
        names.append(data[p + 4 : p + 3 + n].decode())
        lengths.append(int.from_bytes(data[p + 4 + n : p + 8 + n], "little"))
        p += 8 + n
    if p == len(data):
        return Header(text, names, lengths, at << 16)
    begin, block = next(x for x in reversed(ends) if x[0] <= p)
    return Header(text, names, lengths, block << 16 | p - begin)


def _plausible(data: bytes, p: int, header: Header) -> int:
    """A record's bytes if one may begin at p, -1 if that can't be told yet, else 0."""
    if len(data) < p + 36:
        return -1
    size = int.from_bytes(data[p : p + 4], "little", signed=True)
    ref, pos, name, _, _, ops, _, length, mate, mate_pos, _ = _FIXED.unpack_from(data, p + 4)
    n = len(header.names)
    if not (-1 <= ref < n and -1 <= mate < n and name > 0 and length >= 0 and size >= 32 + name + 4 * ops + (length + 1) // 2 + length):
        return 0
    if not (-1 <= pos <= (header.lengths[ref] if ref >= 0 else 1 << 31) and -1 <= mate_pos <= (header.lengths[mate] if mate >= 0 else 1 << 31)):
        return 0
    if len(data) < p + 36 + name + 4 * ops:
        return -1
    read_name = data[p + 36 : p + 36 + name]
    good = read_name[-1] == 0 and all(33 <= b <= 126 for b in read_name[:-1]) and all(data[p + 36 + name + 4 * i] & 15 < 9 for i in range(ops))
    return 4 + size if good else 0


def first_record(blocks: Blocks, byte: int, header: Header) -> int:
    """The virtual offset of the first record that begins in a block at or behind a byte."""
    if byte <= header.first >> 16:
        return header.first
    block = blocks.first(byte)
    while block < blocks.size:
        content, behind = blocks.inflate(block)
        data, at = content, behind
        for start in range(len(content)):
            p, seen = start, 0
            while seen < CHAIN:
                size = _plausible(data, p, header)
                if size == 0:
                    break
                if size < 0 or p + size > len(data):
                    if at >= blocks.size:
                        seen = CHAIN if size > 0 and p + size == len(data) or p == len(data) and seen else -1
                        break
                    more, at = blocks.inflate(at)
                    data += more
                    continue
                p, seen = p + size, seen + 1
            if seen >= CHAIN:
                return block << 16 | start
        block = behind
    return blocks.size << 16


# --- records --------------------------------------------------------------------------------------------------


def _tags(raw: bytes) -> list[str]:
    out, p = [], 0
    while p + 3 <= len(raw):
        name, kind = raw[p : p + 2].decode(), chr(raw[p + 2])
        p += 3
        if kind == "A":
            out.append(f"{name}:A:{chr(raw[p])}")
            p += 1
        elif kind in "ZH":
            end = raw.index(0, p)
            out.append(f"{name}:{kind}:{raw[p:end].decode()}")
            p = end + 1
        elif kind == "B":
            sub, n = chr(raw[p]), int.from_bytes(raw[p + 1 : p + 5], "little")
            values = struct.unpack_from(f"<{n}{NUMBERS[sub]}", raw, p + 5)
            out.append(f"{name}:B:{sub}" + "".join(f",{v:g}" if sub == "f" else f",{v}" for v in values))
            p += 5 + struct.calcsize(f"<{n}{NUMBERS[sub]}")
        else:
            [v] = struct.unpack_from(f"<{NUMBERS[kind]}", raw, p)
            out.append(f"{name}:f:{v:g}" if kind == "f" else f"{name}:i:{v}")
            p += struct.calcsize(NUMBERS[kind])
    return out


def _span(ops: list[tuple[int, str]]) -> int:
    return sum(n for n, c in ops if c in QUERY_OPERATIONS) or 1


def _operations(raw: bytes, count: int, at: int) -> list[tuple[int, str]]:
    return [(x >> 4, OPERATIONS[x & 15]) for x in struct.unpack_from(f"<{count}I", raw, at)]


@lru_cache(1 << 14)
def _shape(packed: bytes) -> tuple[str, int]:
    """The text and span of packed operations, of which most reads have the same few."""
    ops = _operations(packed, len(packed) // 4, 0)
    return "".join(f"{n}{c}" for n, c in ops) or "*", _span(ops)


@lru_cache(1 << 14)
def _packed(cigar: str) -> tuple[bytes, int, int]:
    """Packed operations of text, their number and span."""
    ops = [(int(n), c) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return struct.pack(f"<{len(ops)}I", *(n << 4 | OPERATIONS.index(c) for n, c in ops)), len(ops), _span(ops)


def as_row(raw: bytes, header: Header) -> tuple:
    """The columns of SCHEMA behind line."""
    ref, pos, name, mapq, _, ops, flag, length, mate, mate_pos, tlen = _FIXED.unpack_from(raw)
    p = 32 + name
    qname = raw[32 : p - 1].decode() or "*"
    cigar, _ = _shape(raw[p : p + 4 * ops])
    p += 4 * ops
    seq = raw[p : p + (length + 1) // 2].hex().translate(_NIBBLES)[:length] or "*"
    p += (length + 1) // 2
    qual = raw[p : p + length]
    shown = "*" if not qual or qual[0] == 0xFF else qual.translate(_QUALITIES).decode("ascii")
    tags = _tags(raw[p + length :])
    rname = header.names[ref] if ref >= 0 else "*"
    rnext = "*" if mate < 0 else "=" if mate == ref else header.names[mate]
    # Of a tag that is there twice the first counts for NH and the last for NM, as in text.
    first = {t[:2]: t[5:] for t in reversed(tags)}
    number = lambda t: int(t) if t is not None and t.removeprefix("-").isdecimal() else None
    nm = number(next((t[5:] for t in reversed(tags) if t[:2] == "NM"), None))
    nh = number(first.get("NH"))
    sam = "\t".join([qname, str(flag), rname, str(pos + 1), str(mapq), cigar, rnext, str(mate_pos + 1), str(tlen), seq, shown, *tags])
    return qname, flag, rname, pos + 1, mapq, cigar, rnext, mate_pos + 1, tlen, seq, shown, 1 if nh is None else nh, nm, first.get("MD", ""), first.get("Zs", ""), sam


def as_record(sam: str, index: dict[str, int]) -> bytes:
    """A line of text as a record, with its length."""
    return _encoded(sam, index)[0]


def _encoded(sam: str, index: dict[str, int]) -> tuple[bytes, int, int, int, int]:
    """A line of text as a record, with its contig, start, bin and span."""
    q, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, *tags = sam.split("\t")
    ops, count, span = _packed(cigar)
    ref = index.get(rname, -1)
    mate = ref if rnext == "=" else index.get(rnext, -1)
    start = int(pos) - 1
    seq = "" if seq == "*" else seq.upper()
    packed = bytes.fromhex(seq.encode("ascii", "replace").translate(_DIGITS).decode() + "0" * (len(seq) % 2))
    scores = qual.encode()
    if scores and min(scores) < 33:
        raise ValueError(f"{q} has a quality below 0")
    quality = b"\xff" * len(seq) if qual == "*" else scores.translate(_SCORES)
    out = bytearray()
    for t in tags:
        name, kind, value = t.split(":", 2)
        out += name.encode()
        if kind == "A":
            out += b"A" + value.encode()[:1]
        elif kind == "i":
            out += (b"i" + struct.pack("<i", int(value))) if int(value) < 1 << 31 else b"I" + struct.pack("<I", int(value))
        elif kind == "f":
            out += b"f" + struct.pack("<f", float(value))
        elif kind == "B":
            sub, *values = value.split(",")
            out += b"B" + sub.encode() + struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}{NUMBERS[sub]}", *(float(v) if sub == "f" else int(v) for v in values))
        else:
            out += kind.encode() + value.encode() + b"\0"
    name = q.encode() + b"\0"
    if start + span > INDEXED:
        raise ValueError(f"{q} ends at {start + span}: a BAI index holds positions up to {INDEXED}")
    number = bin_of(start, start + span) if start >= 0 else 4680
    fixed = _FIXED.pack(ref, start, len(name), int(mapq), number, count, int(flag), len(seq), mate, int(pnext) - 1, int(tlen))
    body = b"".join((fixed, name, ops, packed, quality, out))
    return struct.pack("<i", len(body)) + body, ref, start, number, span


# --- index ----------------------------------------------------------------------------------------------------


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    for level in range(DEEPEST, 0, -1):
        shift = WINDOW_SHIFT + 3 * (DEEPEST - level)
        if start >> shift == (end - 1) >> shift:
            return (8**level - 1) // 7 + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> set[int]:
    """All bins that may hold what overlaps [start, end)."""
    out = {0}
    for level in range(1, DEEPEST + 1):
        shift = WINDOW_SHIFT + 3 * (DEEPEST - level)
        first = (8**level - 1) // 7
        out.update(range(first + (start >> shift), first + (end - 1 >> shift) + 1))
    return out


@dataclass
class Index:
    """For each contig its bins' chunks (from, to) and the linear index, as virtual offsets."""

    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    linear: list[list[int]] = field(default_factory=list)

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        if start >> WINDOW_SHIFT < len(self.linear[ref]):
            least = self.linear[ref][start >> WINDOW_SHIFT]
        else:
            least = self.linear[ref][-1] if self.linear[ref] else 0
        wanted = bins_over(start, end)
        return [(max(a, least), b) for n, cs in self.bins[ref].items() if n in wanted for a, b in cs if b > least]

    def starts(self) -> list[int]:
        return sorted({a for bins in self.bins for cs in bins.values() for a, _ in cs})


def read_index(raw: bytes) -> Index:
    if raw[:4] != b"BAI\x01":
        raise ValueError("not a BAI index")
    out, p = Index(), 8
    for _ in range(int.from_bytes(raw[4:8], "little")):
        [n] = struct.unpack_from("<i", raw, p)
        p += 4
        bins = {}
        for _ in range(n):
            number, count = struct.unpack_from("<Ii", raw, p)
            flat = struct.unpack_from(f"<{2 * count}Q", raw, p + 8)
            p += 8 + 16 * count
            if number < (8 ** (DEEPEST + 1) - 1) // 7:  # the one beyond holds counts
                bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
        [n] = struct.unpack_from("<i", raw, p)
        out.bins.append(bins)
        out.linear.append(list(struct.unpack_from(f"<{n}Q", raw, p + 4)))
        p += 4 + 8 * n
    return out


def index_bytes(index: Index, unplaced: int) -> bytes:
    out = bytearray(b"BAI\x01" + struct.pack("<i", len(index.bins)))
    for bins, linear in zip(index.bins, index.linear, strict=True):
        out += struct.pack("<i", len(bins))
        for number, chunks in sorted(bins.items()):
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", a, b) for a, b in chunks)
        out += struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear)
    return bytes(out + struct.pack("<Q", unplaced))


def merged(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


# --- data source ----------------------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Split(InputPartition):
    """Records between virtual offsets (chunks), or between bytes where there is no index."""

    file: str
    chunks: list[tuple[int, int]] | None = None
    bytes: tuple[int, int] = (0, 0)

    def __post_init__(self):
        super().__init__(0)


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.regions = parse_regions(options["regions"]) if "regions" in options else None
        self.outside = parse_regions(options.get("outside", ""))
        self.required, self.excluded = int(options.get("required", 0)), int(options.get("excluded", 0))
        self.split = int(options.get("split", SPLIT_BYTES))
        self.blocks_read = 0

    def _files(self) -> list[tuple[str, int, bool]]:
        """(path, bytes, whether an index lies beside it)."""
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = {i.path for i in found} if info.type != fs.FileType.File else {p for p in (f"{path}.bai", path.removesuffix(".bam") + ".bai") if system.get_file_info(p).type == fs.FileType.File}
        return [(i.path, i.size, f"{i.path}.bai" in names or i.path.removesuffix(".bam") + ".bai" in names) for i in found if i.path.endswith(".bam")]

    def _index(self, system, path: str) -> Index:
        from pyarrow import fs

        name = f"{path}.bai" if system.get_file_info(f"{path}.bai").type == fs.FileType.File else path.removesuffix(".bam") + ".bai"
        with system.open_input_file(name) as f:
            return read_index(f.read())

    def partitions(self) -> list[Split]:
        system, _ = _open(self.path)
        out = []
        for path, size, indexed in self._files():
            if not indexed:
                out += [Split(path, None, (a, min(a + self.split, size))) for a in range(0, size, self.split)]
                continue
            index, whole = self._index(system, path), (size << 16) + 1
            with system.open_input_file(path) as f:
                header = read_header(Blocks(f, size))
            if self.regions is None:
                chunks = [(header.first, whole)]
            else:
                refs = {n: i for i, n in enumerate(header.names)}
                chunks = merged([c for n, a, b in self.regions if n in refs for c in index.chunks(refs[n], max(a, 0), INDEXED if b < 0 else min(b, INDEXED))])
            # Chunks are cut at records that the index knows, and gathered up to a split's bytes.
            cuts, held, size_held = index.starts(), [], 0
            for a, b in chunks:
                while a < b:
                    i = bisect_left(cuts, a + (self.split << 16))
                    stop = cuts[i] if i < len(cuts) and cuts[i] < b else b
                    held.append((a, stop))
                    size_held += (stop >> 16) - (a >> 16)
                    a = stop
                    if size_held >= self.split:
                        out.append(Split(path, held))
                        held, size_held = [], 0
            if held:
                out.append(Split(path, held))
        return out or [Split("", [])]

    def _wanted(self, header: Header) -> Callable[[bytes], bool]:
        place = lambda rs: {i: [(a, b if b >= 0 else 1 << 40) for n, a, b in rs if n == name] for i, name in enumerate(header.names) if any(r[0] == name for r in rs)}
        inside, outside = place(self.regions or []), place(self.outside)

        def meets(raw: bytes, regions: dict[int, list[tuple[int, int]]]) -> bool:
            ref, pos, name, _, _, ops = struct.unpack_from("<iiBBHH", raw)
            if ref not in regions:
                return False
            end = pos + _shape(raw[32 + name : 32 + name + 4 * ops])[1]
            return any(pos < b and a < end for a, b in regions[ref])

        def wanted(raw: bytes) -> bool:
            [flag] = struct.unpack_from("<H", raw, 14)
            if flag & self.required != self.required or flag & self.excluded:
                return False
            return (self.regions is None or meets(raw, inside)) and not (outside and meets(raw, outside))

        return wanted

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = _open(self.path)
        schema = pa.schema([(f.split()[0].lower(), {"STRING": pa.string(), "INT": pa.int32(), "BIGINT": pa.int64()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        with system.open_input_file(partition.file) as f:
            blocks = Blocks(f, f.size())
            header = read_header(blocks)
            chunks = partition.chunks
            if chunks is None:
                chunks = [tuple(first_record(blocks, b, header) for b in partition.bytes)]
            wanted, rows = self._wanted(header), []
            for start, stop in chunks:
                for at, raw in stream(blocks, start) if start < stop else ():
                    if at >= stop:
                        break
                    if wanted(raw):
                        rows.append((partition.file, at, *as_row(raw, header)))
                        if len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            self.blocks_read = blocks.read


class PushingBamReader(BamReader):
    """Spark calls for pushFilters only where its setting is on, and refuses readers that have it elsewhere."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on rname and pos choose regions; Spark still evaluates all of them."""
        contigs, low, high = None, 1, -1
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name == "rname" and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                contigs = own if contigs is None else contigs & own
            elif name == "pos" and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                low = max(low, f.value)
            if name == "pos" and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                high = f.value if high < 0 else min(high, f.value)
        # Records without a contig have none in the index, and regions that are given already choose enough.
        if contigs is not None and "*" not in contigs and self.regions is None and (high < 0 or high >= low):
            self.regions = sorted((c, low - 1, high) for c in contigs)
        return filters


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return (PushingBamReader if self.options.get("pushdown") == "true" else BamReader)(dict(self.options))


def read_bam(spark: SparkSession, path: str, sample: str | None = None, **options: str | int) -> DataFrame:
    """Records as read_sam gives them, with file; see above for options."""
    spark.dataSource.register(BamSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    records = spark.read.format("bam").options(pushdown=pushdown, **{k: str(v) for k, v in options.items()}).load(path)
    return records if sample is None else records.withColumn("sample", F.lit(sample))


def read_bam_regions(spark: SparkSession, path: str, regions: str, *, decoys: str = "", loose: bool = False, excluded: int = 0x400, sample: str | None = None) -> DataFrame:
    """Records of regions without duplicates.  loose adds those on decoys, and all that aren't properly paired.

    Regions and decoys are one pruned scan; what isn't properly paired may lie anywhere, so a second scan reads it and
    leaves out what the first one gave.
    """
    if not loose:
        return read_bam(spark, path, sample, regions=regions, excluded=excluded)
    near = f"{regions} {decoys}".strip()
    return read_bam(spark, path, sample, regions=near, excluded=excluded).unionByName(read_bam(spark, path, sample, outside=near, excluded=excluded | 0x2))


# --- writer ---------------------------------------------------------------------------------------------------


class ShardWriter:
    """One shard: a header, sorted records in blocks, and their index."""

    def __init__(self, out, text: str, references: list[tuple[str, int]]):
        self.out, self.at, self.held = out, 0, bytearray()
        self.index = Index([{} for _ in references], [[] for _ in references])
        self.names = {n: i for i, (n, _) in enumerate(references)}
        self.unplaced = 0
        self.held += b"BAM\x01" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(references))
        for n, size in references:
            self.held += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
        self._flush(0)

    def _flush(self, least: int) -> None:
        while len(self.held) > least:
            content = bytes(self.held[:BLOCK_BYTES])
            del self.held[:BLOCK_BYTES]
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = packer.compress(content) + packer.flush()
            head = bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(packed) + 25)
            self.out.write(head + packed + struct.pack("<II", zlib.crc32(content), len(content)))
            self.at += len(packed) + 26

    def add(self, sam: str) -> None:
        record, ref, start, number, span = _encoded(sam, self.names)
        if len(self.held) + len(record) > BLOCK_BYTES:
            self._flush(0)  # so that most records begin and end in one block
        begin = self.at << 16 | len(self.held)
        self.held += record
        self._flush(BLOCK_BYTES)
        end = self.at << 16 | len(self.held)
        if ref < 0:
            self.unplaced += 1
            return
        chunks = self.index.bins[ref].setdefault(number, [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1] = (chunks[-1][0], end)
        else:
            chunks.append((begin, end))
        linear, last = self.index.linear[ref], (max(start, 0) + span - 1) >> WINDOW_SHIFT
        while len(linear) <= last:
            linear.append(begin)

    def close(self) -> bytes:
        """Ends the file; returns its index."""
        self._flush(0)
        self.out.write(EOF_BLOCK)
        return index_bytes(self.index, self.unplaced)


def write_bam(records: DataFrame, path: str, references: list[tuple[str, int]], *, shards: int | None = None, keys: list[str] | None = None) -> None:
    """Sorted, indexed shards of records (column sam, a line of text) in the folder path: ``part-00000.bam`` and so on.

    Rows are dealt by ranges of contig and position, so a shard covers a stretch of the reference; hot positions are split
    by the line itself.  A task writes under a name of its own and renames at the end, so it may run twice.  keys adds
    columns by which files are told apart: each value has a folder of its own.
    """
    keys = keys or []
    order = F.map_from_arrays(F.array(*(F.lit(n) for n, _ in references)), F.array(*map(F.lit, range(len(references)))))
    parts = F.split("sam", "\t")
    rows = records.select(*keys, "sam", F.coalesce(F.try_element_at(order, parts[2]), F.lit(1 << 30)).alias("_ref"), parts[3].cast("int").alias("_pos"))
    by = [*keys, "_ref", "_pos", "sam"]
    rows = rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        from urllib.parse import quote

        from pyspark import TaskContext

        system, folder = _open(path)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        writer, at, files = None, None, []

        def end() -> None:
            index = writer.close()
            writer.out.close()
            with system.open_output_stream(f"{at}/.{own}.bai") as out:
                out.write(index)
            system.move(f"{at}/.{own}.bai", f"{at}/part-{part:05d}.bam.bai")
            system.move(f"{at}/.{own}.tmp", f"{at}/part-{part:05d}.bam")
            files.append(f"{at}/part-{part:05d}.bam")

        for batch in batches:
            named = zip(*(batch[k].to_pylist() for k in keys), strict=True) if keys else [()] * batch.num_rows
            for values, sam in zip(named, batch["sam"].to_pylist(), strict=True):
                here = "/".join([folder, *(f"{k}={quote(str(v), safe='')}" for k, v in zip(keys, values, strict=True))])
                if here != at:
                    if writer:
                        end()
                    at = here
                    system.create_dir(at, recursive=True)
                    writer = ShardWriter(system.open_output_stream(f"{at}/.{own}.tmp"), text, references)
                writer.add(sam)
        if writer:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    rows.sortWithinPartitions(*by).select(*keys, "sam").mapInArrow(run, "file string").count()
