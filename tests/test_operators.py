import random
import re

import numpy as np
import plain_typing
import pytest
from pyspark.sql import functions as F

from locuspark.operators import alignment, copynumber, evaluate, novel, reads, search, series, sets, typing
from locuspark.plans import pipeline
from locuspark.sources import alignments
from locuspark.streaming import windows


def test_group_depth(spark):
    rows = [("A", p, d) for p, d in zip(range(1, 6), (10, 20, 30, 40, 50))] + [("B", 1, 10), ("B", 2, 20), (None, 1, 5)]
    df = spark.createDataFrame(rows, "gene string, pos int, depth int")
    assert dict(series.group_depth(df, ["gene"], "depth").collect()) == {"A": 40.0, "B": 17.5}
    assert dict(series.group_depth(df, ["gene"], "depth", "median").collect())["A"] == 30
    with pytest.raises(NotImplementedError):
        series.group_depth(df, ["gene"], "depth", "p90")


def test_regions(spark):
    rows = [("c", p, 30) for p in range(1000, 4000, 100)] + [("c", p, 30) for p in range(9000, 9500, 100)]
    df = spark.createDataFrame(rows, "ref string, pos bigint, depth bigint")
    got = series.significant_regions(df, ["ref"], "pos", "depth", min_depth=0.1).collect()
    assert [(r["first"], r["last"]) for r in got] == [(1000, 3900)]
    legacy = series.legacy_regions(df, ["ref"], "pos", "depth", min_depth=0.1).collect()
    assert [(r["first"], r["last"]) for r in legacy] == [(1000, 3900)]


def lcnd_by_hand(values, bins, start_base=2, dev=0.08):
    values = np.array(values)
    x_max = max(values.max() * 1.2, 1e-6)
    dev *= x_max
    density, _ = np.histogram(values, bins=bins, range=(0, x_max))
    x = np.linspace(0, x_max, bins)
    sd = [dev * (0.3 * (2 - n) + 1) if n < 2 else dev * (0.5 * (n - 2) + 1) for n in range(7)]
    pdf = lambda base: np.stack([np.exp(-0.5 * ((x - base * n) / s) ** 2) / (s * np.sqrt(2 * np.pi)) for n, s in enumerate(sd)])
    ll = [(np.log((pdf(b) * x_max / bins).max(axis=0) + 1e-9) * density).sum() for b in np.linspace(0, x_max, bins)]
    base = np.linspace(0, x_max, bins)[int(np.argmax(np.round(ll, 9)))]
    return base, [int(pdf(base)[:, min(int(v / (x_max / bins)), bins - 1)].argmax()) for v in values]


def test_copy_numbers(spark):
    values = [10.2, 20.1, 19.7, 30.5, 9.8, 40.2, 0.1, 20.4]
    df = spark.createDataFrame([("s", f"g{i}", v) for i, v in enumerate(values)], "sample string, gene string, depth double")
    setting = copynumber.Lcnd(bins=200)
    base, cn = lcnd_by_hand(values, 200)
    model = copynumber.fit(df, ["sample"], "depth", setting)
    assert abs(model.first()["base"] - base) < 1e-9
    got = {r["gene"]: r["cn"] for r in copynumber.assign(df, model, ["sample"], "depth", setting).collect()}
    assert [got[f"g{i}"] for i in range(len(values))] == cn == [1, 2, 2, 3, 1, 4, 0, 2]


def test_reference_gene(spark):
    rows = [("KIR3DL3*BACKBONE", 20.0), ("a", 10.0), ("b", 20.5), ("c", 30.0)]
    df = spark.createDataFrame(rows, "gene string, depth double")
    got = {r["gene"]: r["cn"] for r in copynumber.reference_gene_fit(df, copynumber.Lcnd(bins=200)).collect()}
    assert got["KIR3DL3*BACKBONE"] == 2 and got["a"] == 1
    with pytest.raises(KeyError):
        copynumber.reference_gene_fit(df.filter("gene <> 'KIR3DL3*BACKBONE'"))


def test_kde(spark):
    values = [0.5, 0.51, 0.49, 1.0, 0.99, 0.02]
    df = spark.createDataFrame([(f"g{i}", v) for i, v in enumerate(values)], "gene string, depth double")
    got = {r["gene"]: r["cn"] for r in copynumber.kde_cut(df, []).collect()}
    assert [got[f"g{i}"] for i in range(6)] == [1, 1, 1, 2, 2, 0]


CATALOGUE = [("b", 5, "single", "T", None, "hv0", 1, ["a1", "a2"], True), ("b", 9, "single", "G", None, "hv1", 1, ["a2"], True), ("b", 12, "deletion", None, 3, "hv2", 3, ["a3"], False), ("b", 15, "insertion", "GG", None, "hv3", 0, ["a1"], False)]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "ref string, pos int, typ string, val string, del_len int, id string, length int, allele array<string>, in_exon boolean")


def sam(name, flag, pos, mate, cigar, seq, tags, ref="b", nxt="="):
    return "\t".join([name, str(flag), ref, str(pos), "60", cigar, nxt, str(mate), "0", seq, "I" * len(seq), *tags])


def test_reads(spark, catalogue):
    lines = [
        "@HD\tVN:1",
        sam("r1", 83, 3, 1, "10M", "AAATAAAAAA", ["NM:i:1", "MD:Z:3A6"]),
        sam("r1", 163, 1, 3, "10M", "AAAAATAAAG", ["NM:i:2", "MD:Z:5A3A0"]),
        sam("r2", 83, 1, 1, "4S6M", "AAAAAAAAAA", ["NM:i:0", "MD:Z:6"]),
        sam("r2", 163, 1, 1, "10M", "AAAAATAAAA", ["NM:i:1", "MD:Z:5A4"]),
        sam("r3", 83, 1, 1, "10M", "AAAAAAAAAA", ["NM:i:5", "MD:Z:10"]),
        sam("r3", 163, 1, 1, "10M", "AAAAAAAAAA", ["NM:i:0", "MD:Z:10"]),
        sam("r4", 81, 1, 1, "10M", "AAAAAAAAAA", ["NM:i:0", "MD:Z:10"]),
        sam("r4", 161, 1, 1, "10M", "AAAAAAAAAA", ["NM:i:0", "MD:Z:10"]),
        sam("r5", 83, 1, 1, "5M2I3M", "AAAAACCAAA", ["NM:i:2", "MD:Z:8", "NH:i:2"]),
        sam("r5", 163, 1, 1, "10M", "AAAAAAAAAA", ["NM:i:0", "MD:Z:10"]),
    ]
    text = spark.createDataFrame(list(enumerate(lines)), "line bigint, value string")
    records = alignments.sam_records(text, "line").withColumn("sample", F.lit("00"))
    assert records.count() == 10
    wide, long = reads.decode_reads(records, catalogue)
    got = {r["qnames"]: r for r in wide.withColumn("qnames", F.split_part("l_sam", F.lit("\t"), F.lit(1))).collect()}
    assert set(got) == {"r1", "r2", "r5"}
    # The later record is the left mate: positions 0-9 with T at 5 and G at 9; the right mate spans 2-11 with T at 5.
    assert got["r1"]["lpv"] == ["hv0", "hv1"] and got["r1"]["lnv"] == [] and got["r1"]["rpv"] == ["hv0"] and got["r1"]["rnv"] == ["hv1"]
    assert got["r2"]["rpv"] == [] and got["r2"]["rnv"] == [] and got["r2"]["lpv"] == ["hv0"] and got["r2"]["lnv"] == ["hv1"]
    assert got["r5"]["multiple"] == 2 and got["r5"]["rpv"] == [] and got["r5"]["lnv"] == ["hv0", "hv1"]
    assert long.filter("sign").count() == 4


def test_exon_flag(spark):
    v = spark.createDataFrame([("b", 9, "single", None), ("b", 10, "single", None), ("b", 7, "deletion", 3), ("b", 6, "deletion", 3), ("c", 1, "single", None)], "ref string, pos int, typ string, del_len int")
    got = alignments.with_exon_flag(v, spark.createDataFrame([("b", 10, 20)], "ref string, start int, end int")).collect()
    assert {(r["ref"], r["pos"]): r["in_exon"] for r in got} == {("b", 9): False, ("b", 10): True, ("b", 7): True, ("b", 6): False, ("c", 1): False}


def simulated(rng, truth, carriers, n):
    variants, out = sorted(carriers), []
    for _ in range(n):
        a = rng.choice(truth)
        seen = rng.sample(variants, 4)
        out.append(([v for v in seen if a in carriers[v]], [v for v in seen if a not in carriers[v]], [], []))
    return out


def test_typing(spark):
    rng = random.Random(1)
    names = [f"G*{i:03d}" for i in range(8)]
    carriers = {f"hv{i}": {a for a in names if rng.random() < 0.4} | {rng.choice(names)} for i in range(20)}
    variants = [(v, i, "single", "A", sorted(c), i % 2 == 0) for i, (v, c) in enumerate(carriers.items())]
    for truth in (["G*001", "G*004"], ["G*002", "G*005", "G*007"]):
        found = simulated(rng, truth, carriers, 300)
        for strategy in ("full", "exonfirst", "em"):
            best = next(r for r in plain_typing.type_gene("G*BACKBONE", len(truth), found, variants, strategy, typing.Setting(top_n=50)) if r["chosen"])
            assert sorted(best["alleles"]) == truth, strategy
    rows = [("s1", f"p{i}", "", "", 1, "G*BACKBONE", *m) for i, m in enumerate(simulated(rng, ["G*001", "G*004"], carriers, 200))]
    wide = spark.createDataFrame(rows, "sample string, pair_id string, l_sam string, r_sam string, multiple int, backbone string, lpv array<string>, lnv array<string>, rpv array<string>, rnv array<string>")
    table = spark.createDataFrame([("G*BACKBONE", p, t, v, i, c, e) for i, p, t, v, c, e in variants], "ref string, pos int, typ string, val string, id string, allele array<string>, in_exon boolean")
    copies = spark.createDataFrame([("s1", "G*BACKBONE", 2), ("s2", "G*BACKBONE", 1), ("s1", "Z*BACKBONE", 0)], "sample string, gene string, cn int")
    result = typing.type_alleles(wide, table, copies)
    called = {r["name"]: r for r in typing.calls(result).collect()}
    assert called["s1"]["alleles"] == "G*001_G*004" and called["s1"]["warnings"] == ""
    assert called["s2"]["alleles"] == "G*" and "few reads" in called["s2"]["warnings"]
    assert typing.possible_sets(result).filter("sample = 's1' and rank = 0").first()["1"].startswith("G*")
    with pytest.raises(NotImplementedError):
        typing.type_alleles(wide, table, copies, "best")


def test_typing_parts():
    share = np.array([[0.1, 0.9], [0.05, 0.95], [0.2, 0.8], [0.4, 0.6]])
    assert plain_typing.select_best(share, 2) == 3
    mates = [(["v"], [], [], [])] * 66 + [([], [], ["w"], [])] * 33
    for cn, want in ((1, ["a1"]), (2, ["a1", "a2"]), (3, ["a1", "a1", "a2"])):
        assert plain_typing.em_call(mates, {"v": {"a1"}, "w": {"a2"}}, cn) == want
    assert plain_typing.top_ranks([-10.0, -10.5, -12.0], 0.9) == [0, 1]
    place = {"v": (1, "single", "A"), "w": (1, "single", "C")}
    assert not plain_typing.homozygous([(["v"], [])] * 20 + [(["w"], [])] * 20, place, 2)
    assert plain_typing.homozygous([(["v"], [])] * 40 + [(["w"], [])] * 2, place, 2)


def test_em_candidates_go_by_mate():
    carriers = {"v": {"a1", "a2"}, "w": {"a2", "a3"}, "x": {"a1"}, "y": {"a3"}}
    found = lambda *m: plain_typing.em_candidates([m], carriers)
    assert found(["v"], [], ["w"], []) == [["a2"]]  # both mates allow it
    assert found(["x"], [], ["y"], []) == [["a1", "a3"]]  # mates that disagree keep what either allows
    assert found(["v"], ["x"], [], ["w"]) == [["a2"]]  # a mate that supports nothing allows nothing, and takes nothing away
    assert found(["v", "w"], [], ["x"], []) == [["a1", "a2"]]
    assert found([], ["v"], [], []) == [] and found(["unknown"], [], ["v"], ["v"]) == []


def test_em_by_plain_steps():
    rng = random.Random(3)
    names = [f"a{i}" for i in range(6)]
    reads = [sorted(rng.sample(names, rng.randint(1, 3))) for _ in range(400)]
    for lengths in (None, {a: 100 + 50 * i for i, a in enumerate(names)}):
        p = dict.fromkeys(names, 1 / 6)
        for _ in range(20_000):
            got = dict.fromkeys(names, 0.0)
            for r in reads:
                for a in r:
                    got[a] += p[a] / sum(p[x] for x in r) / (lengths[a] if lengths else 1)
            new = {a: x / sum(got.values()) for a, x in got.items()}
            if max(abs(new[a] - p[a]) for a in names) < 1e-9:
                break
            p = new
        quick = plain_typing.em(reads, tolerance=1e-9, lengths=lengths)
        assert all(abs(quick[a] - p[a]) < 1e-4 for a in names)


def test_search_equals_trying_all_sets():
    """Beams that are wide enough find the best set of all; blocks of any size give the same shares."""
    import itertools

    rng = np.random.default_rng(1)
    k = rng.integers(0, 6, (80, 9)).astype(np.int32)
    for cn in (1, 2, 3):
        best = min(int(k[:, list(c)].min(axis=1).sum()) for c in itertools.combinations_with_replacement(range(9), cn))
        beam = plain_typing.search(k, cn, True, 600)
        assert beam.cost[0] == best and (np.diff(beam.cost) >= 0).all()
        for s, cost, share, least in zip(beam.sets, beam.cost, beam.share, beam.best.T, strict=True):
            each = k[:, s]
            same = each == each.min(axis=1, keepdims=True)
            assert each.min(axis=1).sum() == cost and (least == each.min(axis=1)).all()
            assert cn == 1 or np.allclose(share, (same / same.sum(axis=1, keepdims=True)).mean(axis=0))


def test_reference_gene_of_each_sample(spark):
    """Samples of different depths are each bounded by their own reference gene."""
    rows = [(s, g, d * f) for s, f in (("a", 1.0), ("b", 3.0)) for g, d in (("KIR3DL3*BACKBONE", 20.0), ("x", 10.2), ("y", 20.5), ("z", 30.0), ("w", 39.0))]
    df = spark.createDataFrame(rows, "sample string, gene string, depth double")
    got = {(r["sample"], r["gene"]): r["cn"] for r in copynumber.reference_gene_fit(df, copynumber.Lcnd(bins=200), by=["sample"]).collect()}
    for s in ("a", "b"):
        assert [got[s, g] for g in ("KIR3DL3*BACKBONE", "x", "y", "z", "w")] == [2, 1, 2, 3, 4]
    alone = {(r["sample"], r["gene"]): r["cn"] for s in ("a", "b") for r in copynumber.reference_gene_fit(df.filter(F.col("sample") == s), copynumber.Lcnd(bins=200), by=["sample"]).collect()}
    assert alone == got
    with pytest.raises(KeyError, match="sample='b'"):
        copynumber.reference_gene_fit(df.filter("sample = 'a' or gene = 'x'"), by=["sample"])


def test_diploid_setting(spark):
    found = copynumber.diploid_setting(spark.createDataFrame([(30.0, 4.0)], "mean double, sd double"))
    assert (found.bins, found.lower, found.upper) == (300, 13.0, 17.0)
    df = spark.createDataFrame([("a", 15.1), ("b", 30.2), ("c", 44.0)], "gene string, depth double")
    base = copynumber.fit(df, [], "depth", found).first()["base"]
    assert 13 <= base <= 17


def test_tiers_by_hand(spark):
    """Against matching one tier after the other, with repeated names, several keys and empty sides."""
    rng = random.Random(2)
    names = [f"G{g}*{d}" for g in (1, 2) for d in ("0010101", "0010102", "00102", "0020101", "002", "")]
    truth = [(s, rng.choice(names)) for s in ("x", "y", None) for _ in range(12)]
    called = [(s, rng.choice(names) + rng.choice(["", "e"])) for s in ("x", "z", None) for _ in range(12)]
    field = lambda a, n: {7: a.partition("*")[2], 5: a.partition("*")[2][:5], 3: a.partition("*")[2][:3], 0: ""}[n] or ("new" if n else "")
    want = []
    for s in ("x", "y", "z", None):
        for g in ("G1", "G2"):
            t = sorted(a for k, a in truth if k == s and a.startswith(g))
            c = sorted(a.removesuffix("e") for k, a in called if k == s and a.startswith(g))
            for tier in (7, 5, 3, 0):
                for a in list(t):
                    other = next((b for b in c if field(b, tier) == field(a, tier)), None)
                    if other is not None:
                        t.remove(a)
                        c.remove(other)
                        want.append((s, g, f"MATCH{tier}" if tier else "GENE", a, other))
            want += [(s, g, "FN", a, None) for a in t] + [(s, g, "FP", None, b) for b in c]
    side = lambda rows: spark.createDataFrame(rows, "sample string, allele string")
    got = [tuple(r) for r in evaluate.tier_match(side(truth), side(called)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sparse_mismatches_equal_dense(spark):
    rng = random.Random(3)
    names, carriers = [f"a{i}" for i in range(5)], {f"v{i}": rng.sample([f"a{j}" for j in range(5)], 2) for i in range(6)}
    evidence = [("g", f"r{r}", v, rng.random() < 0.5) for r in range(20) for v in rng.sample(sorted(carriers), 3)]
    e = spark.createDataFrame(evidence, "gene string, read string, variant string, sign boolean")
    c = spark.createDataFrame([("g", v, a) for v, xs in carriers.items() for a in xs], "gene string, variant string, allele string")
    got = {(r["read"], r["allele"]): r["k"] for r in search.mismatches(e, c, c.select("gene", "allele")).collect()}
    for read in {x[1] for x in evidence}:
        for a in {a for xs in carriers.values() for a in xs}:
            assert got[read, a] == sum(s != (a in carriers[v]) for _, r, v, s in evidence if r == read)
    assert names


def test_tier_match(spark):
    t = spark.createDataFrame([("s", "G*0010101"), ("s", "G*0020201"), ("s", "H*003"), ("s", "I*001")], "sample string, allele string")
    c = spark.createDataFrame([("s", "G*0010101e"), ("s", "G*0020305"), ("s", "H*004"), ("s", "J*001")], "sample string, allele string")
    got = {(r["gene"], r["match"]) for r in evaluate.tier_match(t, c).collect()}
    assert got == {("G", "MATCH7"), ("G", "MATCH3"), ("H", "GENE"), ("I", "FN"), ("J", "FP")}
    row = evaluate.match_summary(evaluate.tier_match(t, c)).first()
    assert (row["MATCH7"], row["MATCH3"], row["GENE"], row["FN"], row["FP"]) == (1, 1, 1, 1, 1)


def test_tier_match_in_parts_by_rows(spark, monkeypatch):
    monkeypatch.setattr(sets.dealt, "__kwdefaults__", {"rows": 10})
    rows = spark.range(200).selectExpr("cast(id % 40 as string) as sample", "concat('G*00', id % 7) as allele")
    plan = evaluate.tier_match(rows, rows)._jdf.queryExecution().toString()
    assert "41), REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    assert evaluate.tier_match(rows, rows).filter("match <> 'MATCH7'").isEmpty()


def test_runs_in_parts_by_rows(spark, monkeypatch):
    monkeypatch.setattr(sets.dealt, "__kwdefaults__", {"rows": 10})
    rows = spark.range(60).selectExpr("id % 3 as k", "id % 2 as f", "cast(id div 6 + if(id >= 30, 5, 0) as int) as p")
    found = series.runs(rows.union(rows), ["k"], "p", ["f"])  # every position twice
    assert "13), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert sorted((r["k"], r["f"], r["first"], r["length"]) for r in found.collect()) == [(k, f, a, 5) for k in range(3) for f in range(2) for a in (0, 10)]


def test_pairs_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(sets, "PART_ROWS", 10)
    rows = spark.range(40).selectExpr("concat('q', id div 2) as q", "id as line", "cast(id as int) as pos", "cast(if(id % 2 = 0, id + 1, id - 1) as int) as mate", "cast(if(id % 2 = 0, 64, 128) as int) as flag")
    found = sets.pair_records(rows, ["q"], "line", "pos", "mate", "flag")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # one for each side of the join
    assert sorted((r["left"]["line"], r["right"]["line"]) for r in found.collect()) == [(i + 1, i) for i in range(0, 40, 2)]


def test_alignment_text_needs_no_shuffle(spark):
    from locuspark.plans import engine

    events = spark.createDataFrame([(22, 3, "x"), (5, 11, "y"), (33, None, "y")], "event_id bigint, user_id bigint, event_type string")
    text = engine.alignment_text(events)
    assert "Exchange" not in text._jdf.queryExecution().toString()
    got = {(r["sample"], r["line"]): r["value"].split("\t") for r in text.collect()}
    assert len(got) == 6 and got["x", 45][9][2] == "G"  # event 22 has its new base at place 22
    for f in got.values():
        shown = re.sub(r"\d+", lambda m: "." * int(m[0]), f[13][5:])
        assert len(shown) == engine.HALF and [c != "A" for c in f[9]] == [c == "A" for c in shown]


def test_greedy_match(spark):
    t = spark.createDataFrame([("s", "G*00101"), ("s", "G*002"), ("s", "G*00301")], "sample string, allele string")
    c = spark.createDataFrame([("s", "G*0010105"), ("s", "G*00205"), ("s", "G*004")], "sample string, allele string")
    got = sorted((r["match"], r["truth"] or "", r["called"] or "") for r in evaluate.greedy_match(t, c, 5).collect())
    assert got == [("FN", "G*00301", ""), ("FP", "", "G*004"), ("TP", "G*00101", "G*0010105"), ("TP", "G*002", "G*00205")]


def plain_greedy(truths, calls, n):
    """One truth after the other, pass by pass, over (gene, allele) of a sample."""
    order = lambda x: (x[0], re.search(r"\*(\d*)|$", x[1])[1] or "", x[1])
    truths, calls, used_t, used_c, out = sorted(truths, key=order), sorted(calls, key=order), set(), set(), []
    for k in range(4):
        for i, (gene, t) in enumerate(truths):
            for j, (other, c) in enumerate(calls):
                a, b = order((gene, t))[1], order((other, c))[1]
                fit = [len(a) >= n and len(b) >= n and a[:n] == b[:n], 0 < len(a) < n <= len(b) and b.startswith(a), 0 < len(b) < n <= len(a) and a.startswith(b), len(a) < n and len(b) < n and a == b][k]
                if gene == other and fit and i not in used_t and j not in used_c:
                    used_t.add(i), used_c.add(j), out.append((gene, t, c, "TP"))
    return out + [(*t, None, "FN") for i, t in enumerate(truths) if i not in used_t] + [(g, None, c, "FP") for j, (g, c) in enumerate(calls) if j not in used_c]


@pytest.mark.parametrize("n", [3, 5, 7])
def test_greedy_match_in_order(spark, n):
    r = random.Random(n)
    name = lambda: (g := r.choice("GH"), f"{g}*{''.join(r.choice('12') for _ in range(r.randrange(9)))}{r.choice(['', '', 'N', '#'])}")
    samples = {f"s{i}": ([name() for _ in range(r.randrange(25))], [name() for _ in range(r.randrange(25))]) for i in range(30)}
    t, c = (spark.createDataFrame([(s, a) for s, both in samples.items() for _, a in both[k]] + [(None, "G*001"), ("x", None)], "sample string, allele string") for k in (0, 1))
    text = lambda rows: sorted(tuple(map(str, x)) for x in rows)
    got = evaluate.greedy_match(t, c, n).select("sample", "gene", "truth", "called", "match").collect()
    want = [(s, *x) for s, both in samples.items() for x in plain_greedy(*both, n)]
    nothing = [(None, "G", "G*001", None, "FN"), (None, "G", None, "G*001", "FP"), ("x", None, None, None, "FN"), ("x", None, None, None, "FP")]
    assert text(got) == text(want + nothing)


def test_greedy_match_takes_no_rounds(spark):
    """Equal names used to take a round of jobs for each pair, over all pairs of them."""
    t = spark.createDataFrame([("s", "G*001")] * 30, "sample string, allele string")
    spark.sparkContext.setJobGroup("greedy", "")
    got = evaluate.greedy_match(t, t, 5).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("greedy")
    spark.sparkContext.setJobGroup("others", "")
    assert [r["match"] for r in got] == ["TP"] * 30 and 0 < len(jobs) < 15


def test_alignment(spark):
    msa = spark.createDataFrame([("G", "G*001", "ACGTA-CC"), ("G", "G*002", "ATGTA-CC"), ("G", "G*003", "A--TAGCC"), ("G", "G*BACKBONE", "ACGTA-CC")], "gene string, allele string, seq string")
    found = {(r["allele"], r["typ"], r["pos"], r["val"], r["del_len"]) for r in alignment.variants_of(msa).collect()}
    assert found == {("G*002", "single", 1, "T", None), ("G*003", "deletion", 1, None, 2), ("G*003", "insertion", 5, "G", None)}
    known = alignment.variant_catalogue(alignment.variants_of(msa)).collect()
    assert [(r["id"], r["typ"]) for r in sorted(known, key=lambda r: r["id"])] == [("hv0", "single"), ("hv1", "deletion"), ("hv2", "insertion")]
    assert alignment.with_consensus_backbone(msa).filter("allele = 'G*BACKBONE'").first()["seq"].startswith("A")
    gaps = spark.createDataFrame([("G", "G*001E", "ACCATATATACC"), ("G", "G*002", "ACCATAT--ACC"), ("G", "G*003", "ACCATATATACC")], "gene string, allele string, seq string")
    assert {r["allele"]: r["seq"] for r in alignment.left_align(gaps).collect()}["G*002"] == "ACC--ATATACC"
    part = spark.createDataFrame([("G", "G*0010101", "ACGT"), ("G", "G*0010102", "AGGT"), ("G", "G*00102", "EEGE"), ("G", "G*0010102N", "AGGT")], "gene string, allele string, seq string")
    assert {r["allele"]: r["seq"] for r in alignment.filled_introns(part).collect()}["G*00102e"] == "AGGT"
    blocks = spark.createDataFrame([("G", 0, "a", "AC"), ("G", 1, "a", "GT"), ("G", 1, "b", "GG")], "gene string, idx int, allele string, seq string")
    assert {r["allele"]: r["seq"] for r in alignment.merged_blocks(blocks).collect()} == {"a": "ACGT", "b": "--GG"}


def test_novel(spark):
    e = spark.createDataFrame([("s", f"p{i}", 0, "g", True, "nv0") for i in range(5)], "sample string, pair_id string, mate int, ref string, sign boolean, variant_id string")
    a = spark.createDataFrame([("s", "g", f"p{i}", "g*1") for i in range(5)], "sample string, gene string, pair_id string, allele string")
    cat = spark.createDataFrame([("g", "hv0", ["g*1"])], "ref string, id string, allele array<string>")
    counts = novel.confusion(e, a, cat)
    v = spark.createDataFrame([("nv0", "single", 2, "T")], "variant_id string, typ string, pos int, val string")
    site = spark.createDataFrame([("s", "g", "g*1", 2, "T", 5), ("s", "g", "g*1", 2, "A", 1)], "sample string, gene string, allele string, pos int, base string, n int")
    seqs = spark.createDataFrame([("g*1", "AAAA")], "allele string, seq string")
    got = novel.applied(novel.candidates(counts, v, site), seqs).first()
    assert got["seq"] == "AATA" and got["name"] == "g*1-2T"


def test_streams(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windows.windowed_depth(stream, "ts", ["k"], "v", length="10 minutes").writeStream.format("memory").queryName("depth").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from depth").first()[0] > 0


def test_pipeline_depth(spark):
    d = spark.createDataFrame([("s", "g", p, 10 if p < 50 else 100) for p in range(1, 100)], "sample string, gene string, pos int, depth int")
    exons = spark.createDataFrame([("g", 0, 40), ("g", 30, 45)], "ref string, start int, end int")
    inside = pipeline.exon_depths(d, exons)
    assert inside.count() == 40 + 16 and inside.filter("depth > 10").count() == 0
    assert pipeline.gene_depths(inside, pipeline.Settings()).first()["depth"] == 10
