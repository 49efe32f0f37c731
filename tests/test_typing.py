"""The allele search and the EM as tables against the plain version, for several samples, genes and numbers of copies."""

import random

import plain_typing
import pytest

from locuspark.operators import beam, typing

READS = "sample string, pair_id string, l_sam string, r_sam string, multiple int, backbone string, lpv array<string>, lnv array<string>, rpv array<string>, rnv array<string>"
TABLE = "ref string, pos int, typ string, val string, id string, allele array<string>, in_exon boolean"


def cohort(seed, n=150):
    """(mates of each (sample, gene), variants of each gene, copies): some groups alike, one without reads, errors in some."""
    rng = random.Random(seed)
    variants, mates, copies = {}, {}, {}
    for gene in ("G*BACKBONE", "H*BACKBONE", "2DL5*BACKBONE"):
        names = [f"{gene[0]}*{i:03d}" for i in range(7)]
        rows = []
        for i in range(16):
            held = sorted({a for a in names if rng.random() < 0.4} | {rng.choice(names)})
            rows.append((f"{gene[0]}v{i}", i // 2, ["single", "single", "deletion", "insertion"][i % 4], "ACGT"[i % 4], held, i % 3 == 0))
        variants[gene] = rows
        for s, cn in (("s1", 1), ("s2", 2), ("s3", 3), ("s4", 2)):
            truth = [rng.choice(names) for _ in range(1 if s == "s4" else cn)]
            found = []
            for r in range(n):
                a, sides = rng.choice(truth), []
                for _ in range(2):
                    seen = rng.sample(rows, 3)
                    flip = lambda v, a=a: (a in v[4]) != (rng.random() < 0.03)
                    told = [(v[0], flip(v)) for v in seen]
                    sides += [[v for v, x in told if x] + (["unknown"] if r % 50 == 0 else []), [v for v, x in told if not x]]
                found.append(tuple(sides))
            mates[s, gene], copies[s, gene] = found, cn
    mates["s3", "H*BACKBONE"] = []
    return variants, mates, copies


def tables(spark, variants, mates, copies):
    reads = [(s, f"{g}{i}", "", "", 1, g, *m) for (s, g), ms in mates.items() for i, m in enumerate(ms)]
    reads += [("s1", "other", "", "", 2, "G*BACKBONE", ["Gv0"], [], [], [])]
    known = [(g, p, t, None if t == "deletion" else v, i, c, e) for g, rows in variants.items() for i, p, t, v, c, e in rows]
    known += [("G*BACKBONE", 3, "single", "T", "none", [], False)]
    wanted = [(s, g, cn) for (s, g), cn in copies.items()] + [("s1", "Z*BACKBONE", 1), ("s2", "Y*BACKBONE", 0)]
    return spark.createDataFrame(reads, READS), spark.createDataFrame(known, TABLE), spark.createDataFrame(wanted, "sample string, gene string, cn int")


def rounded(rows):
    """By (sample, gene): (value, alleles, shares by allele, chosen), without the order of a set's members."""
    return sorted((s, g, cn, n, rank, round(value, 6), tuple(sorted(zip(alleles, [round(x, 9) for x in share] or [0] * len(alleles), strict=True))), chosen) for s, g, cn, n, rank, value, alleles, share, chosen in rows)


@pytest.mark.parametrize(("strategy", "top"), [("full", 600), ("full", 4), ("exonfirst", 600), ("em", 600)])
def test_tables_equal_the_plain_version(spark, strategy, top):
    variants, mates, copies = cohort(5)
    setting = typing.Setting(top_n=top)
    got = rounded(tuple(r) for r in typing.type_alleles(*tables(spark, variants, mates, copies), strategy, setting).collect())
    want = []
    for (s, g), cn in copies.items():
        known = [(i, p, t, None if t == "deletion" else v, c, e) for i, p, t, v, c, e in variants[g]]
        want += [(s, g, cn, len(mates[s, g]), r["rank"], r["value"], r["alleles"], r["share"], r["chosen"]) for r in plain_typing.type_gene(g, cn, mates[s, g], known, strategy, setting)]
    want.append(("s1", "Z*BACKBONE", 1, 0, 0, 0.0, [] if strategy == "em" else ["Z*"], [], True))
    assert got == rounded(want)


def test_a_group_in_several_tasks(spark, monkeypatch):
    variants, mates, copies = cohort(7, 80)
    args = tables(spark, variants, mates, copies)
    whole = rounded(tuple(r) for r in typing.type_alleles(*args).collect())
    dealt = beam.dealt
    monkeypatch.setattr(beam, "dealt", lambda rows: dealt(rows, 5))
    assert rounded(tuple(r) for r in typing.type_alleles(*args).collect()) == whole


def test_lengths_are_joined(spark):
    """Lengths change shares as in the plain version; an allele without one is an error, not a default."""
    variants, mates, copies = cohort(9, 60)
    lengths = {a: 100 + 37 * i for i, a in enumerate(sorted({a for rows in variants.values() for v in rows for a in v[4]}))}
    args = tables(spark, variants, mates, copies)
    got = {(r["sample"], r["gene"]): sorted(r["alleles"]) for r in typing.type_alleles(*args, "em", lengths=spark.createDataFrame(list(lengths.items()), "allele string, length int")).collect()}
    for (s, g), cn in copies.items():
        carriers = {v[0]: set(v[4]) for v in variants[g]}
        assert got[s, g] == sorted(plain_typing.em_call(mates[s, g], carriers, cn, lengths))
    with pytest.raises(Exception, match="no length of"):
        typing.type_alleles(*args, "em", lengths=spark.createDataFrame(list(lengths.items())[1:], "allele string, length int")).collect()


def test_quantiles_of_groups_of_any_size(spark):
    """In one buffer, counted first, and by ranges where a group has more distinct values: the same figures."""
    import numpy as np

    from locuspark.operators import series

    rng = random.Random(2)
    rows = [(g, rng.random() if rng.random() < 0.7 else float(rng.randint(0, 3))) for g, n in (("a", 300), ("b", 20), (None, 40), ("c", 1)) for _ in range(n)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"q": 0.75, "m": 0.5, "low": 0.1}
    want = {g: tuple(float(np.quantile([v for x, v in rows if x == g and v is not None], q)) for q in wanted.values()) for g in ("a", "b", "c", None)}
    for most in (series.BUFFER_VALUES, 250, 30, 0):
        got = {r["g"]: (r["q"], r["m"], r["low"]) for r in series.quantiles(df, ["g"], "v", wanted, most=most).collect()}
        assert set(got) == set(want)
        for g in want:
            assert np.allclose(got[g], want[g])
