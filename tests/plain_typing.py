"""A plain version of the allele search and of the EM, one gene of one sample in NumPy, that tables are held against."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from locuspark.operators.typing import ALWAYS_MIXED, HIT, MISS, Setting
#: Sets whose members' shares are worked out at once.
SCORE_SETS = 256
def corrected(signs: dict[str, list[int]]) -> set[tuple[str, bool]]:
    """(variant, sign) that lack support: fewer than 3 in all drop both signs, a share under 0.2 drops that sign."""
    gone = set()
    for v, (neg, pos) in signs.items():
        total = neg + pos
        for sign, n in ((False, neg), (True, pos)):
            if total < 3 or n / total < 0.2:
                gone.add((v, sign))
    return gone


def matrix(reads: list[tuple[list[str], list[str]]], alleles: list[str], carriers: dict[str, set[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(mismatches of reads x alleles, variants told by each read)."""
    index = {a: i for i, a in enumerate(alleles)}
    members = {v: np.array(sorted(index[a] for a in c if a in index), dtype=np.int64) for v, c in carriers.items()}
    none = np.array([], dtype=np.int64)
    k, n = np.zeros((len(reads), len(alleles)), dtype=np.int32), np.zeros(len(reads), dtype=np.int64)
    for r, (pos, neg) in enumerate(reads):
        n[r] = len(pos) + len(neg)
        k[r] += len(pos)
        for v in pos:
            k[r, members.get(v, none)] -= 1
        for v in neg:
            k[r, members.get(v, none)] += 1
    return k, n


@dataclass
class Beam:
    """Ranked sets: member indexes, summed least mismatches, each member's own sum, and its share of reads."""

    sets: np.ndarray
    cost: np.ndarray
    own: np.ndarray
    share: np.ndarray
    best: np.ndarray  # reads x sets

    def cut(self, order: np.ndarray) -> Beam:
        return Beam(self.sets[order], self.cost[order], self.own[order], self.share[order], self.best[:, order])


def _ranked(beam: Beam, top: int | None) -> Beam:
    uneven = np.abs(beam.share - beam.share.mean(axis=1, keepdims=True)).sum(axis=1)
    names = [tuple(s) for s in np.sort(beam.sets, axis=1).tolist()]
    order = sorted(range(len(names)), key=lambda i: (beam.cost[i], beam.own[i].sum(), round(float(uneven[i]), 12), names[i]))
    return beam.cut(np.array(order[:top], dtype=np.int64))


def _shares(k: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Share of the reads that each member explains best; ties are split."""
    out = np.zeros(sets.shape)
    for lo in range(0, len(sets), SCORE_SETS):
        each = k[:, sets[lo : lo + SCORE_SETS]]  # reads x sets x members
        same = each == each.min(axis=2, keepdims=True)
        out[lo : lo + SCORE_SETS] = (same / same.sum(axis=2, keepdims=True)).sum(axis=0) / max(len(k), 1)
    return out


def extend(k: np.ndarray, beam: Beam | None, allowed: np.ndarray, top: int) -> Beam:
    """The beam with one more member of the allowed alleles in each set."""
    total = k.sum(axis=0, dtype=np.int64)
    if beam is None:
        order = sorted(allowed.tolist(), key=lambda a: (int(total[a]), a))[:top]
        sets = np.array(order, dtype=np.int64)[:, None]
        return Beam(sets, total[sets[:, 0]], total[sets], np.ones(sets.shape), k[:, sets[:, 0]])
    costs = np.stack([np.minimum(beam.best[:, [i]], k[:, allowed]).sum(axis=0, dtype=np.int64) for i in range(len(beam.sets))])
    seen: dict[tuple[int, ...], tuple[int, int]] = {}
    for i, members in enumerate(beam.sets.tolist()):
        for j, a in enumerate(allowed.tolist()):
            seen.setdefault(tuple(sorted([*members, a])), (i, j))
    picks = sorted(seen.items(), key=lambda x: (costs[x[1]], x[0]))[: max(top, len(seen) // 5)]
    sets = np.array([[*beam.sets[i].tolist(), int(allowed[j])] for _, (i, j) in picks], dtype=np.int64)
    cost = np.array([costs[p] for _, p in picks], dtype=np.int64)
    # All picks are ranked before the best members are kept for those that stay.
    found = _ranked(Beam(sets, cost, total[sets], _shares(k, sets), np.zeros((0, len(sets)), dtype=k.dtype)), top)
    found.best = np.stack([k[:, s].min(axis=1) for s in found.sets], axis=1)
    return found


def homozygous(reads: list[tuple[list[str], list[str]]], place: dict[str, tuple[int, str, str]], cn: int) -> bool:
    """Whether no position shows two values in the shares that a mixture of cn copies would.

    place: variant -> (position, type, value).  Deletions aren't counted.
    """
    if cn <= 1:
        return False
    counts: dict[int, dict[str, int]] = {}
    for pos, neg in reads:
        for sign, ids in (("", pos), ("*", neg)):
            for v in ids:
                if v in place and place[v][1] != "deletion":
                    at = counts.setdefault(place[v][0], {})
                    at[sign + str(place[v][2])] = at.get(sign + str(place[v][2]), 0) + 1
    for at in counts.values():
        if len(at) <= 1 or all(x.startswith("*") for x in at):
            continue
        kept = [n for n in at.values() if n > 3]
        if sum(kept) < 20:
            continue
        shares = sorted((n / sum(kept) for n in kept if n / sum(kept) > 0.1), reverse=True)
        if len(shares) > 1 and shares[1] > 1 / (2 * cn):
            return False
    return True


def search(k: np.ndarray, cn: int, mixed: bool, top: int, steps: list[np.ndarray] | None = None) -> Beam:
    """The ranked sets of cn alleles; steps limits the alleles that each step may add."""
    everyone = np.arange(k.shape[1])
    if not mixed:
        one = extend(k, None, everyone if steps is None else steps[0], top)
        return Beam(np.repeat(one.sets, cn, 1), one.cost * 1, np.repeat(one.own, cn, 1), np.full((len(one.sets), cn), 1 / cn), one.best)
    beam = None
    for i in range(cn):
        beam = extend(k, beam, everyone if steps is None else steps[i], top)
    return beam


def value_of(cost: int, told: int, copies: int = 1) -> float:
    """The log10 likelihood of a summed mismatch count."""
    return copies * (cost * MISS + (told - cost) * HIT)


def select_best(share: np.ndarray, cn: int) -> int:
    """The first rank whose every member explains 1/(2 cn) of the reads, else rank 0."""
    ok = (share >= 1 / (2 * cn)).all(axis=1)
    return int(np.argmax(ok)) if ok.any() else 0


def top_ranks(values: list[float], share: float) -> list[int]:
    """Rank 0 and all others whose value, scaled, reaches it; share 1 means ties."""
    return [i for i, v in enumerate(values) if i == 0 or v * share >= values[0]]


def prepare(reads: list[tuple[list[str], list[str]]], correct: bool) -> list[tuple[list[str], list[str]]]:
    """Reads after sign correction, without those that tell nothing."""
    if correct:
        signs: dict[str, list[int]] = {}
        for pos, neg in reads:
            for ids, s in ((neg, 0), (pos, 1)):
                for v in ids:
                    signs.setdefault(v, [0, 0])[s] += 1
        gone = corrected(signs)
        reads = [([v for v in pos if (v, True) not in gone], [v for v in neg if (v, False) not in gone]) for pos, neg in reads]
    return [r for r in reads if r[0] or r[1]]


Mates = list[tuple[list[str], list[str], list[str], list[str]]]


def type_gene(gene: str, cn: int, mates: Mates, variants: list[tuple], strategy: str, setting: Setting, lengths: dict[str, int] | None = None) -> list[dict]:
    """Ranked sets of one gene: rank, value, alleles, share, chosen.

    mates: what each pair supports and contradicts, left then right; variants: (id, position, type, value, carriers,
    in_exon).  strategy: full, exonfirst or em; lengths normalises the EM.
    """
    reads = [([*lp, *rp], [*ln, *rn]) for lp, ln, rp, rn in mates]
    carriers = {v[0]: set(() if v[4] is None else v[4]) for v in variants}
    place = {v[0]: (v[1], v[2], v[3]) for v in variants}
    alleles = sorted(set().union(*carriers.values())) if carriers else []
    if strategy == "em":
        called = em_call(mates, carriers, cn, lengths)
        return [{"rank": 0, "value": 0.0, "alleles": called, "share": [], "chosen": True}]
    used = prepare(reads, setting.correct)
    if not used or not alleles:
        return [{"rank": 0, "value": 0.0, "alleles": [f"{gene.split('*')[0]}*"] * cn, "share": [], "chosen": True}]
    mixed = any(x in gene for x in ALWAYS_MIXED) or not homozygous(used, place, cn)
    k, told = matrix(used, alleles, carriers)
    if strategy == "exonfirst":
        beam = exon_first(used, alleles, carriers, {v[0] for v in variants if v[5]}, cn, mixed, setting, k)
    else:
        beam = search(k, cn, mixed, setting.top_n)
    copies = 1 if mixed else cn
    values = [value_of(int(c), int(told.sum()), copies) for c in beam.cost]
    chosen = select_best(beam.share, cn)
    return [{"rank": i, "value": values[i], "alleles": [alleles[a] for a in beam.sets[i]], "share": beam.share[i].tolist(), "chosen": i == chosen} for i in sorted({*top_ranks(values, setting.rank_share), chosen})]


def exon_first(reads, alleles: list[str], carriers: dict[str, set[str]], exon: set[str], cn: int, mixed: bool, setting: Setting, k: np.ndarray) -> Beam:
    """Types groups of alleles that have the same exon variants first, then alleles within the best groups."""
    groups: dict[frozenset[str], list[int]] = {}
    for i, a in enumerate(alleles):
        groups.setdefault(frozenset(v for v in exon if a in carriers.get(v, ())), []).append(i)
    of_exon = prepare([([v for v in p if v in exon], [v for v in n if v in exon]) for p, n in reads], setting.correct)
    if not of_exon:
        return search(k, cn, mixed, max(1, setting.top_n // 5))
    members = list(groups.values())
    names = [str(i) for i in range(len(members))]
    by_group = {v: {names[g] for g, s in enumerate(groups) if v in s} for v in exon}
    ek, told = matrix(of_exon, names, by_group)
    first = search(ek, cn, mixed, setting.top_n)
    values = [value_of(int(c), int(told.sum())) for c in first.cost]
    found = [search(k, cn, mixed, max(1, setting.top_n // 5), [np.array(members[int(g)]) for g in first.sets[r]]) for r in top_ranks(values, setting.exon_share)]
    beam = Beam(*(np.concatenate([getattr(b, f) for b in found], axis=1 if f == "best" else 0) for f in ("sets", "cost", "own", "share", "best")))
    seen: dict[tuple, int] = {}
    for i, s in enumerate(np.sort(beam.sets, axis=1).tolist()):
        seen.setdefault(tuple(s), i)
    return _ranked(beam.cut(np.array(sorted(seen.values()))), None)


def em_candidates(mates: Mates, carriers: dict[str, set[str]]) -> list[list[str]]:
    """For each pair the alleles that most of its mates allow: those of both, or where none is, of either one.

    A mate allows the alleles with all that it supports and none of what it contradicts; one that supports nothing
    allows none.  Pairs that allow no allele are left out.
    """

    def allowed(pos: list[str], neg: list[str]) -> set[str]:
        have = set.intersection(*(set(carriers.get(v, ())) for v in pos)) if pos else set()
        return have.difference(*(carriers.get(v, ()) for v in neg))

    out = []
    for lp, ln, rp, rn in mates:
        left, right = allowed(lp, ln), allowed(rp, rn)
        out.append(sorted(left & right or left | right))
    return [x for x in out if x]


def em(candidates: list[list[str]], rounds: int = 300, tolerance: float = 1e-4, lengths: dict[str, int] | None = None) -> dict[str, float]:
    """Shares of alleles by expectation-maximisation with squared extrapolation.

    With lengths, what an allele gets of a read is divided by its length.  The step that turns out smaller than the
    tolerance isn't taken any more.
    """
    alleles = sorted({a for c in candidates for a in c})
    if not alleles:
        return {}
    index = {a: i for i, a in enumerate(alleles)}
    member = np.zeros((len(candidates), len(alleles)))
    for r, c in enumerate(candidates):
        member[r, [index[a] for a in c]] = 1
    size = np.array([float(lengths[a]) for a in alleles]) if lengths else np.ones(len(alleles))

    def step(p: np.ndarray) -> np.ndarray:
        given = member * p
        whole = given.sum(axis=1, keepdims=True)
        out = (np.divide(given, whole, out=np.zeros_like(given), where=whole > 0) / size).sum(axis=0)
        return out / out.sum()

    p = step(np.ones(len(alleles)))
    for _ in range(rounds):
        new = step(p)
        slope = new - p
        bend = step(new) - new - slope
        if (bend**2).sum() > 0:
            stride = math.sqrt((slope**2).sum() / (bend**2).sum())
            new = step(np.maximum(p + 2 * stride * slope + stride**2 * bend, 0))
        if np.abs(new - p).sum() <= tolerance:
            break
        p = new
    return dict(zip(alleles, p.tolist(), strict=True))


def em_call(mates: Mates, carriers: dict[str, set[str]], cn: int, lengths: dict[str, int] | None = None) -> list[str]:
    """Alleles by share; each takes its rounded number of copies, one at least, until all cn are given."""
    out: list[str] = []
    for allele, p in sorted(em(em_candidates(mates, carriers), lengths=lengths).items(), key=lambda x: (-x[1], x[0])):
        if len(out) == cn:
            break
        out += [allele] * min(cn - len(out), max(1, round(p * cn)))
    return out
