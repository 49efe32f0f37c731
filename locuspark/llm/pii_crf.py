"""Personal data: exact base patterns, and a skip-chain conditional random field over what looks like them.

Tokens with a digit or an at sign are the nodes of a document's field; all other words are outside any entity and
serve as context only.  Neighbouring nodes are joined in a chain, and distant nodes that repeat each other or belong to
numbers that agree in their last ten digits, however they are grouped, share a skip potential.  Tokens inside a base span are observed, so loopy message passing
carries their labels along the skips: a number given once in full is also found where it is written another way.
Nodes that end up as personal data outside the base spans become added spans; the base stays as it is.

The field is trained on documents made by ``training_documents`` (TRAIN_DOCS of them, a fixed seed) by
pseudo-likelihood; nothing is learned from the corpus.

Rows: null text is empty; repeated rows are scanned each for itself; an empty table gives no rows; ids of any type are
kept as they are; further columns are ignored.  All scans are linear in the text's length.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locuspark.llm.workers import lean

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
TRAIN_DOCS = 1500
TRAIN_STEPS = 300
#: Least marginal probability of an added span, and rounds of message passing; more by the depth of the repeats' trees.
CONFIDENCE = 0.9
ROUNDS = 12
#: Chain neighbours are at most so many characters apart.
CHAIN_GAP = 40

# --- base -----------------------------------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octets(address: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in address.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of each kind that hold."""
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    ips, cards, ip_end, card_end = [], [], 0, 0
    for run in _DIGITS.finditer(text):
        start = run.start()
        if start >= ip_end and (m := _IP.match(text, start)):
            ip_end = m.end()
            if octets(m[0]):
                ips.append((1, start, ip_end))
        if start >= card_end and (m := _CARD.match(text, start)):
            card_end = m.end()
            if card_end - start >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                cards.append((2, start, card_end))
    out += ips + cards
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


# --- the field ------------------------------------------------------------------------------------------------

_MARK = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_EDGE = "\"'.,;:!?<>[]{}"
# Words that announce an entity.
CUES = (
    frozenset("email mail e-mail contact write courriel correo".split()),
    frozenset("ip host server address from adresse".split()),
    frozenset("card visa mastercard credit debit carte karte tarjeta".split()),
    frozenset("phone tel telephone call fax mobile cell telefon teléfono".split()),
)
BUCKETS = (0, 1, 4, 7, 10, 13, 16, 20)
N_FEATURES = 14 + len(BUCKETS) + len(CUES)


def nodes(text: str) -> list[tuple[int, int]]:
    """(start, end) of tokens with a digit or an at sign, without punctuation around them."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = _REST.match(text, m.end()).end()
        token = text[start:at]
        left = len(token) - len(token.lstrip(_EDGE))
        right = len(token) - len(token.rstrip(_EDGE))
        if left + right < len(token):
            out.append((start + left, at - right))
    return out


def features(text: str, start: int, end: int) -> list[float]:
    token = text[start:end]
    digits = [c for c in token if "0" <= c <= "9"]
    before = text[max(0, start - 24) : start].lower().split()
    cue = before[-1].strip(_EDGE) if before else ""
    n = len(digits)
    dots, letters = token.count("."), any(c.isalpha() for c in token)
    _, sign, host = token.partition("@")
    found = [
        1.0, bool(sign), bool(sign) and "." in host.strip("."), token[0] == "+", "(" in token or ")" in token,
        dots == 3 and not letters and bool(_IP.fullmatch(token)) and octets(token), dots == 3, letters, any(c in token for c in "=\"/_#$%&*"), "-" in token,
        n == len(token), n == len(token) and 16 <= n <= 19 and luhn("".join(digits)), 0 < dots < 3, ":" in token,
    ]
    bucket = max(i for i, b in enumerate(BUCKETS) if n >= b)
    return [*map(float, found), *(float(i == bucket) for i in range(len(BUCKETS))), *(float(cue in c) for c in CUES)]


def likeness(text: str, start: int, end: int) -> str | None:
    """Tokens with equal likeness share a skip potential."""
    token = text[start:end]
    if "@" in token:
        return token.lower()
    digits = "".join(c for c in token if "0" <= c <= "9")
    return digits[-10:] if len(digits) >= 7 and not any(c.isalpha() for c in token) else None


def occurrences(text: str, found: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(key, first, last node) of what may be repeated: single tokens, and the last ten digits of adjacent number tokens.

    A number is read backwards from each token until it has ten digits, so what stands before it doesn't matter.
    """
    digits = ["" if any(c.isalpha() or c == "@" for c in text[a:b]) else "".join(c for c in text[a:b] if "0" <= c <= "9") for a, b in found]
    for i, (a, b) in enumerate(found):
        key = likeness(text, a, b)
        if key is not None:
            yield key, i, i
        first, number = i, digits[i]
        while number and len(number) < 10 and first and digits[first - 1] and found[first][0] - found[first - 1][1] <= 2 and text[found[first - 1][1] : found[first][0]].isspace():
            first -= 1
            number = digits[first] + number
        if first < i and len(number) >= 7:
            yield number[-10:], first, i


def field(text: str, found: list[tuple[int, int]], observed: Iterable[int] = ()) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain and skip edges.  A key's occurrences are joined to an observed one, or form a balanced tree if none is.

    Edges grow with the nodes, and paths with the logarithm of the repeats.
    """
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= CHAIN_GAP]
    seen, known, by = set(chain), set(observed), {}
    for key, first, last in occurrences(text, found):
        by.setdefault(key, []).append((first, last))
    skip: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        edge = (min(i, j), max(i, j))
        if i != j and edge not in seen:
            seen.add(edge)
            skip.append(edge)

    for places in by.values():
        places.sort(key=lambda p: p[1] not in known)
        for n in range(1, len(places)):
            (first, last), (top, parent) = places[n], places[0 if places[0][1] in known else (n - 1) // 2]
            for i in range(first, last + 1):
                join(parent, i)
            if n == 1 or places[0][1] in known:  # the other tokens of the root too
                for i in range(top, parent):
                    join(i, last)
    return chain, skip


class Model:
    """Weights of the field: labels x features, and symmetric label tables for chain and skip edges."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    def marginals(self, x: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], observed: dict[int, int]) -> np.ndarray:
        """Loopy sum-product over one field."""
        scores = x @ self.node.T
        for i, label in observed.items():
            scores[i] = -1e9  # whatever any number of repeats say
            scores[i, label] = 0.0
        edges = np.array(chain + skip, dtype=np.int64).reshape(-1, 2)
        if len(edges):
            tables = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            tables = np.exp(np.concatenate([tables, tables]))
            m, e = np.zeros((len(source), len(LABELS))), len(edges)
            back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
            for _ in range(ROUNDS * (1 + len(skip).bit_length())):
                belief = scores.copy()
                np.add.at(belief, target, m)
                out = belief[source] - m[back]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.log(np.einsum("ei,eij->ej", out, tables) + 1e-30)
                new -= new.max(axis=1, keepdims=True)
                moved = np.abs(new - m).max()
                m = 0.5 * m + 0.5 * new
                if moved < 1e-3:
                    break
            np.add.at(scores, target, m)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans outside the base that the field is sure of; neighbouring tokens of one kind are one span."""
        found = nodes(text)
        if not found:
            return []
        observed: dict[int, int] = {}
        by_start = sorted((a, b, k) for k, a, b in base)
        j = 0
        for i, (a, b) in enumerate(found):
            while j < len(by_start) and by_start[j][1] <= a:
                j += 1
            if j < len(by_start) and by_start[j][0] < b:
                observed[i] = by_start[j][2] + 1
        if len(observed) == len(found):
            return []
        p = self.marginals(np.array([features(text, a, b) for a, b in found]), *field(text, found, observed), observed)
        best, out = p.argmax(axis=1), []
        near = lambda i, j: 0 <= i and j < len(found) and found[j][0] - found[i][1] <= 2
        for i, (a, b) in enumerate(found):
            if i in observed or best[i] == 0 or p[i, best[i]] < CONFIDENCE:
                continue
            kind = int(best[i]) - 1
            if out and out[-1][0] == kind and out[-1][4] == i - 1 and near(i - 1, i):
                out[-1] = (kind, out[-1][1], b, out[-1][3], i)
            else:
                out.append((kind, a, b, i, i))
        # A token beside a span that may be part of it leaves open where the entity ends: half an entity is none.
        unsure = lambda i, j, k: near(i, j) and k not in observed and p[k, 0] < CONFIDENCE
        out = [x for x in out if not unsure(x[3] - 1, x[3], x[3] - 1) and not unsure(x[4], x[4] + 1, x[4] + 1)]
        # A span that a base span overlaps adds nothing.
        starts, reach = [a for a, _, _ in by_start], list(accumulate((b for _, b, _ in by_start), max))
        return [x[:3] for x in out if not (n := bisect_left(starts, x[2])) or reach[n - 1] <= x[1]]


def training_documents(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(text, [(kind, start, end)]): filler with personal data in several spellings, repeats of it, and look-alikes."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def not_card() -> str:
        while luhn(x := digits(16)):
            pass
        return x

    while n:
        area, number = digits(3), f"{digits(3)}-{digits(4)}"
        phone = [f"+1 ({area}) {number}", f"({area}) {number}", f"{area}-{number}", f"1-{area}-{number}"]
        bare = [f"{area} {number}".replace("-", " "), f"{area}{number}".replace("-", "")]  # known only by what came before
        c = card()
        cards = [c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4))]
        mail = f"{word()}.{digits(2)}@{word()}{rng.randint(0, 9)}.example.com"
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        entities = [(0, [mail, mail.upper(), f"<{mail}>"]), (1, [ip, f"({ip})", f"{ip},"]), (2, cards), (3, phone)]
        others = [
            lambda: str(rng.randint(1, 2030)), lambda: f"{rng.randint(1, 12)}.", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(2)}", lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
            lambda: digits(rng.randint(5, 14)), not_card, lambda: digits(rng.randint(20, 40)), lambda: f"password={rng.getrandbits(70):x}", lambda: f"AKIA{digits(8)}ABCDXY", lambda: f'"{rng.getrandbits(160):040x}"',
            lambda: f"#{digits(5)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{rng.randint(256, 999)}.{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()}{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(3)}-{digits(4)}",
        ]
        text, spans = "", []
        for _ in range(rng.randint(2, 8)):
            if rng.random() < 0.8:  # else two of them side by side
                text += " ".join(word() for _ in range(rng.randint(3, 12))) + " "
            if rng.random() < 0.5:
                text += rng.choice(others)() + " "
                continue
            kind, ways = rng.choice(entities)
            if rng.random() < 0.2:
                text += rng.choice(sorted(CUES[kind])) + " "
            way = rng.choice(ways + bare if kind == 3 and any(k == 3 for k, _, _ in spans) else ways)
            core = way.strip("<>,")
            core = core.strip("()") if kind == 1 else core
            at = len(text) + way.find(core)
            spans.append((kind, at, at + len(core)))
            text += way + " "
        n -= 1
        yield text, spans


def _graph(text: str, spans: list[tuple[int, int, int]]):
    found = nodes(text)
    labels = np.array([next((k + 1 for k, s, e in spans if s < b and a < e), 0) for a, b in found], dtype=np.int64)
    return np.array([features(text, a, b) for a, b in found]).reshape(-1, N_FEATURES), labels, field(text, found)


@lru_cache(maxsize=2)
def trained(documents: int = TRAIN_DOCS, seed: int = 7) -> Model:
    """Maximum pseudo-likelihood: each label given its neighbours' labels, by gradient ascent with momentum."""
    xs, ys, chains, skips = [], [], [], []
    for text, spans in training_documents(documents, seed):
        x, y, (chain, skip) = _graph(text, spans)
        if not len(y):
            continue
        near = [np.zeros((len(y), len(LABELS))) for _ in range(2)]
        for table, edges in zip(near, (chain, skip), strict=True):
            for i, j in edges:
                table[i, y[j]] += 1
                table[j, y[i]] += 1
        xs.append(x)
        ys.append(y)
        chains.append(near[0])
        skips.append(near[1])
    x, y = np.concatenate([np.concatenate(xs), np.concatenate(chains), np.concatenate(skips)], axis=1), np.concatenate(ys)
    w, speed, target = np.zeros((len(LABELS), x.shape[1])), 0.0, np.eye(len(LABELS))[y]
    k = len(LABELS)
    for _ in range(TRAIN_STEPS):
        s = x @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = (target - p).T @ x / len(y) - 1e-4 * w
        speed = 0.9 * speed + gradient
        w = w + 0.5 * speed
        for lo in (N_FEATURES, N_FEATURES + k):  # edge tables are symmetric
            w[:, lo : lo + k] = (w[:, lo : lo + k] + w[:, lo : lo + k].T) / 2
    return Model(w[:, :N_FEATURES], w[:, N_FEATURES : N_FEATURES + k], w[:, N_FEATURES + k :])


# --- Spark ----------------------------------------------------------------------------------------------------

FOUND = "base array<struct<kind:int,start:bigint,end:bigint>>, added array<struct<kind:int,start:bigint,end:bigint>>"


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added spans of every document."""
    model = trained()
    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda xs: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in xs], spans)
        for batch in batches:
            base, added = [], []
            for t in batch["text"].to_pylist():
                base.append(base_spans(t or ""))
                added.append(model.added(t or "", base[-1]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], rows(base), rows(added)], names=["doc_id", "base", "added"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), StructType([rows.schema["doc_id"], *StructType.fromDDL(FOUND).fields]))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    kinds = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
