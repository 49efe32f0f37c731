"""Queries that run the engine itself on alignment text made from the driver's tables: text, pairs, evidence, calls.

Each event is a pair of reads on a backbone of forty bases A: the first mate covers the first half, the second the
other.  Its bases are those of the allele that the event's user has, and every eleventh event has a base G somewhere.  The
catalogue has ten single-base variants and six alleles; event types are the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.operators import component_votes, novel, reads, typing
from locuspark.plans import pipeline
from locuspark.plans.registry import query, rounded
from locuspark.sources import alignments
from locuspark.storage import written

GENE, HALF = "G*BACKBONE", 20
PLACES = (3, 7, 11, 15, 19, 20, 24, 28, 32, 36)
VARIANTS = [(i, p, "TC"[i % 2], [j for j in range(6) if (i * (j + 1) + j) % 3 == 0], i < 5) for i, p in enumerate(PLACES)]


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(GENE, p, "single", v, None, f"hv{i}", 1, [f"G*{j:03d}" for j in held], None, False, exon) for i, p, v, held, exon in VARIANTS]
    return spark.createDataFrame(rows, "ref string, pos int, typ string, val string, del_len int, id string, length int, allele array<string>, freq double, ignore boolean, in_exon boolean")


def alignment_text(events: DataFrame, new: Column | None = None) -> DataFrame:
    """sample, line, value: two lines of alignment text for each event.

    new: the place of a base G, from columns sample and a (the allele); by default some place in every eleventh event.
    """
    allele = F.when(F.col("user_id") % 10 < 5, 0).when(F.col("user_id") % 10 < 8, 1).otherwise(F.col("user_id") % 6)
    new = F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 40) if new is None else new
    known = {p: (v, held) for _, p, v, held, _ in VARIANTS}
    whole = ["".join(known[p][0] if p in known and j in known[p][1] else "A" for p in range(2 * HALF)) for j in range(6)]
    e = events.select("event_id", F.col("event_type").alias("sample"), allele.alias("a")).withColumn("wrong", new)
    seq = F.coalesce(F.get(F.array(*map(F.lit, whole)), F.col("a").cast("int")), F.lit("A" * 2 * HALF))
    seq = F.when(F.col("wrong").between(0, 2 * HALF - 1), F.overlay(seq, F.lit("G"), (F.col("wrong") + 1).cast("int"), F.lit(1))).otherwise(seq)
    mates = e.select("event_id", "sample", seq.alias("both"), F.explode(F.array(F.lit(0), F.lit(1))).alias("mate")).select("event_id", "sample", "mate", F.substring("both", F.col("mate") * HALF + 1, F.lit(HALF)).alias("seq"))
    start = F.struct(F.lit("").alias("md"), F.lit(0).alias("run"))
    md = F.aggregate(F.split("seq", ""), start, lambda t, c: F.when(c == "A", F.struct(t["md"].alias("md"), (t["run"] + 1).alias("run"))).otherwise(F.struct(F.concat(t["md"], t["run"].cast("string"), F.lit("A")).alias("md"), F.lit(0).alias("run"))), lambda t: F.concat(t["md"], t["run"].cast("string")))
    edits = F.length(F.replace("seq", F.lit("A"), F.lit("")))
    fields = [F.concat(F.lit("e"), "event_id"), F.when(F.col("mate") == 0, "99").otherwise("147"), F.lit(GENE), (F.col("mate") * HALF + 1).cast("string"), F.lit("60"), F.lit(f"{HALF}M"), F.lit("="), ((1 - F.col("mate")) * HALF + 1).cast("string"), F.lit("40"), F.col("seq"), F.repeat(F.lit("I"), F.lit(HALF)), F.lit("NH:i:1"), F.concat(F.lit("NM:i:"), edits), F.concat(F.lit("MD:Z:"), md)]
    return mates.select("sample", (F.col("event_id") * 2 + F.col("mate")).alias("line"), F.concat_ws("\t", *fields).alias("value"))


def _records(t) -> DataFrame:
    return alignments.sam_records(alignment_text(t("events")), "sample", "line")


_V = f"v(i, pos, val, exon) AS (VALUES {', '.join(f'({i}, {p}, {v!r}, {exon})' for i, p, v, _, exon in VARIANTS)}), h(i, j) AS (VALUES {', '.join(f'({i}, {j})' for i, _, _, held, _ in VARIANTS for j in held)})"
_CASES = "CASE WHEN event_id % 11 = 0 THEN event_id % 40 END"
_READS = f"""WITH {_V}, e AS (SELECT *, {_CASES} AS wrong FROM (SELECT event_id, event_type AS sample, CASE WHEN user_id % 10 < 5 THEN 0 WHEN user_id % 10 < 8 THEN 1 ELSE user_id % 6 END AS a FROM events)),
m AS (SELECT event_id, sample, p, p // {HALF} AS mate, c FROM (SELECT event_id, sample, p, CASE WHEN p = wrong THEN 'G' WHEN EXISTS (SELECT 1 FROM v JOIN h USING (i) WHERE v.pos = p AND h.j = a) THEN (SELECT val FROM v WHERE v.pos = p) ELSE 'A' END AS c FROM e, range({2 * HALF}) r(p)) WHERE c <> 'A'),
bad AS (SELECT DISTINCT event_id FROM (SELECT event_id, mate FROM m GROUP BY ALL HAVING count(*) > 4)),
ok AS (SELECT event_id, sample FROM e WHERE event_id NOT IN (SELECT event_id FROM bad)),
pos AS (SELECT event_id, m.sample, mate, i FROM m JOIN ok USING (event_id) JOIN v ON v.pos = m.p AND v.val = m.c),
neg AS (SELECT event_id, sample, mate, i FROM ok, range(2) s(mate), v WHERE ((v.pos >= {HALF} * mate AND v.pos < {HALF} * (mate + 1)) OR (v.pos = {HALF} * (mate + 1) AND v.val < 'T')) AND NOT EXISTS (SELECT 1 FROM pos q WHERE q.event_id = ok.event_id AND q.mate = s.mate AND q.i = v.i)),
ev AS (SELECT *, true AS sign FROM pos UNION ALL SELECT *, false FROM neg)"""


@query(f"{_READS} SELECT m.sample, mate, 'single' AS typ, CAST(p AS INTEGER) AS pos, c AS val, count(*) AS n FROM m JOIN ok USING (event_id) GROUP BY ALL")
def sam_decode(t):
    pairs = reads.read_pairs(_records(t))
    found = reads.long_variants(reads.decoded(reads.mates(pairs)))
    # The later record of a pair is its left mate, here the second half.
    return found.groupBy("sample", (1 - F.col("mate")).cast("bigint").alias("mate"), "typ", "pos", "val").agg(F.count("*").alias("n"))


@query(f"{_READS} SELECT sample, 'hv' || i AS variant_id, sign, count(*) AS n FROM ev GROUP BY ALL")
def evidence(t):
    records = _records(t)
    _, found = reads.decode_reads(records, catalogue(records.sparkSession))
    return found.filter("variant_id like 'hv%'").groupBy("sample", "variant_id", "sign").agg(F.count("*").alias("n"))


_CN = "CASE WHEN sample < 'm' THEN 2 ELSE 1 END"
# A new base that no allele has counts against all of them, once it has support.
_SCORED = f"""{_READS}, every AS (SELECT * FROM ev UNION ALL SELECT event_id, m.sample, mate, 100 + p, true FROM m JOIN ok USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pos = m.p AND v.val = m.c)),
sup AS (SELECT sample, i, count(*) FILTER (sign) AS p, count(*) FILTER (NOT sign) AS n FROM every GROUP BY ALL),
kept AS (SELECT every.* FROM every JOIN sup USING (sample, i) WHERE p + n >= 3 AND CASE WHEN sign THEN p ELSE n END / (p + n) >= 0.2),
al AS (SELECT DISTINCT j FROM h),
n_reads AS (SELECT sample, count(*) AS n_reads FROM ok GROUP BY sample)"""


def _mismatch_sql(source: str, member: str) -> str:
    """k of each read and member: what it supports and the member lacks, and what it contradicts and the member has."""
    return f"SELECT sample, event_id, g, sum(CASE WHEN sign = (i IN (SELECT i FROM {member} x WHERE x.g = m.g)) THEN 0 ELSE 1 END) AS k FROM {source}, (SELECT DISTINCT g FROM {member}) m GROUP BY ALL"


def _sets_sql(k: str) -> str:
    """Single members and pairs with cost, own sums and shares."""
    return f"""SELECT sample, 1 AS cn, g AS a, NULL AS b, CAST(sum(k) AS BIGINT) AS cost, CAST(sum(k) AS BIGINT) AS own, 1.0 AS sa, 1.0 AS sb FROM {k} GROUP BY ALL
UNION ALL SELECT x.sample, 2, x.g, y.g, CAST(sum(least(x.k, y.k)) AS BIGINT), CAST(sum(x.k + y.k) AS BIGINT), round(avg(CASE WHEN x.k < y.k THEN 1.0 WHEN x.k = y.k THEN 0.5 ELSE 0 END), 12), round(avg(CASE WHEN x.k > y.k THEN 1.0 WHEN x.k = y.k THEN 0.5 ELSE 0 END), 12) FROM {k} x JOIN {k} y ON x.event_id = y.event_id AND x.g <= y.g GROUP BY ALL"""


_RANKED = """ranked AS (SELECT s.*, row_number() OVER (PARTITION BY sample ORDER BY cost, own, round(abs(sa - sb), 12), a, b) - 1 AS rank FROM s),
chosen AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY CASE WHEN least(sa, sb) >= 1 / (2 * cn) THEN 0 ELSE 1 END, rank) AS c FROM ranked)
SELECT sample, CAST(cn AS INTEGER) AS cn, n_reads, CAST(rank AS INTEGER) AS rank, round(cost * log10(0.001) + (told - cost) * log10(0.999), 4) AS value, 'G*00' || a || CASE WHEN cn = 2 THEN '_G*00' || b ELSE '' END AS alleles
FROM chosen JOIN n_reads USING (sample) JOIN (SELECT sample, count(*) AS told FROM kept GROUP BY sample) USING (sample) WHERE c = 1"""
_MEMBERS = "mem AS (SELECT j AS g, i FROM h)"


def _called(t, strategy: str) -> DataFrame:
    records = _records(t)
    samples = t("events").select(F.col("event_type").alias("sample")).distinct()
    copies = samples.select("sample", F.lit(GENE).alias("gene"), F.when(F.col("sample") < "m", 2).otherwise(1).alias("cn"))
    found = pipeline.typed(records, catalogue(records.sparkSession), copies, pipeline.Settings(strategy=strategy))
    names = F.array_join(F.array_sort("alleles"), "_").alias("alleles")
    return rounded(found.filter("chosen").select("sample", "cn", "n_reads", "rank", "value", names), "value", digits=4)


@query(f"{_SCORED}, {_MEMBERS}, k AS ({_mismatch_sql('kept', 'mem')}), s AS (SELECT * FROM ({_sets_sql('k')}) WHERE cn = {_CN}), {_RANKED}")
def type_full(t):
    return _called(t, "full")


# Groups are alleles with the same exon variants; pairs of groups with the least cost say which alleles may be paired.
@query(f"""{_SCORED}, {_MEMBERS}, gr AS (SELECT j, min(j) OVER (PARTITION BY held) AS g FROM (SELECT al.j, list_sort(list(h.i) FILTER (v.exon)) AS held FROM al LEFT JOIN h USING (j) LEFT JOIN v USING (i) GROUP BY al.j)),
exon0 AS (SELECT kept.* FROM kept JOIN v USING (i) WHERE exon), esup AS (SELECT sample, i, count(*) FILTER (sign) AS p, count(*) FILTER (NOT sign) AS n FROM exon0 GROUP BY ALL),
ekept AS (SELECT exon0.* FROM exon0 JOIN esup USING (sample, i) WHERE p + n >= 3 AND CASE WHEN sign THEN p ELSE n END / (p + n) >= 0.2),
gmem AS (SELECT DISTINCT g, coalesce(i, -1) AS i FROM gr LEFT JOIN (SELECT h.* FROM h JOIN v USING (i) WHERE exon) hh USING (j)),
ek AS ({_mismatch_sql('ekept', 'gmem')}), es AS (SELECT * FROM ({_sets_sql('ek')}) WHERE cn = {_CN}), best AS (SELECT * FROM es QUALIFY cost = min(cost) OVER (PARTITION BY sample)),
k AS ({_mismatch_sql('kept', 'mem')}), s0 AS (SELECT * FROM ({_sets_sql('k')}) WHERE cn = {_CN}),
s AS (SELECT s0.* FROM s0 JOIN gr ga ON ga.j = s0.a LEFT JOIN gr gb ON gb.j = s0.b WHERE EXISTS (SELECT 1 FROM best WHERE best.sample = s0.sample AND best.a = least(ga.g, coalesce(gb.g, ga.g)) AND coalesce(best.b, best.a) = greatest(ga.g, coalesce(gb.g, ga.g)))), {_RANKED}""")
def type_exonfirst(t):
    return _called(t, "exonfirst")


# Plain steps of expectation and maximisation over the distinct lists of candidates, until they settle.
@query(f"""{_READS}, mate_ok AS (SELECT event_id, sample, mate, j FROM ok, range(2) s(mate), (SELECT DISTINCT j FROM h) al
  WHERE EXISTS (SELECT 1 FROM pos WHERE pos.event_id = ok.event_id AND pos.mate = s.mate) AND NOT EXISTS (SELECT 1 FROM pos WHERE pos.event_id = ok.event_id AND pos.mate = s.mate AND pos.i NOT IN (SELECT i FROM h WHERE h.j = al.j))
  AND NOT EXISTS (SELECT 1 FROM m WHERE m.event_id = ok.event_id AND m.mate = s.mate AND NOT EXISTS (SELECT 1 FROM v WHERE v.pos = m.p AND v.val = m.c)) AND NOT EXISTS (SELECT 1 FROM neg WHERE neg.event_id = ok.event_id AND neg.mate = s.mate AND neg.i IN (SELECT i FROM h WHERE h.j = al.j))),
cnt AS (SELECT event_id, sample, j, count(*) AS n FROM mate_ok GROUP BY ALL), cand AS (SELECT event_id, sample, list_sort(list(j)) AS js FROM (SELECT * FROM cnt QUALIFY n = max(n) OVER (PARTITION BY event_id)) GROUP BY ALL),
grp AS (SELECT sample, list({{'m': [CASE WHEN list_contains(js, x) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for x in range(6)], 'n': n}}) AS gs FROM (SELECT sample, js, count(*)::DOUBLE AS n FROM cand GROUP BY ALL) GROUP BY sample),
em AS (SELECT sample, gs, list_reduce(range(500), lambda p, x: [list_sum([g.n * g.m[a] * p[a] / greatest(list_sum([g.m[b] * p[b] for b in range(1, 7)]), 1e-300) for g in gs]) / list_sum([g.n for g in gs]) for a in range(1, 7)], [1 / 6::DOUBLE for x in range(6)]) AS p FROM grp),
pr AS (SELECT sample, unnest(range(6)) AS j, unnest(p) AS p FROM em), rk AS (SELECT *, {_CN} AS cn, row_number() OVER (PARTITION BY sample ORDER BY p DESC, j) AS r FROM pr WHERE p > 1e-6),
cp AS (SELECT *, greatest(1, round_even(p * cn, 0)) AS c, coalesce(sum(greatest(1, round_even(p * cn, 0))) OVER (PARTITION BY sample ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rk)
SELECT sample, CAST(cn AS INTEGER) AS cn, string_agg('G*00' || j, '_' ORDER BY j) AS alleles FROM (SELECT sample, cn, j, unnest(range(CAST(least(c, cn - before) AS BIGINT))) FROM cp WHERE before < cn) GROUP BY ALL""")
def type_em(t):
    return _called(t, "em").select("sample", "cn", "alleles")


@query(f"{_READS} SELECT sample, count(*) AS n, sum(has) AS unsure FROM (SELECT sample, event_id, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.event_id = ok.event_id AND c = 'G') THEN 1 ELSE 0 END AS has FROM ok) GROUP BY sample")
def novel_reads(t):
    records = _records(t)
    spark = records.sparkSession
    pairs = reads.read_pairs(records)
    found = reads.with_ids(reads.long_variants(reads.decoded(reads.mates(pairs))), catalogue(spark))
    new = found.filter("novel").select("sample", "pair_id").distinct().groupBy("sample").agg(F.count("*").alias("unsure"))
    return pairs.groupBy("sample").agg(F.count("*").alias("n")).join(new, "sample", "left").select("sample", "n", F.coalesce("unsure", F.lit(0)).cast("decimal(38,0)").alias("unsure"))


# New bases: allele 0 has another one in early samples than in late ones, allele 1 the same in all.
_NEW = "CASE WHEN a = 0 AND sample < 'm' THEN 5 WHEN a = 0 THEN 9 WHEN a = 1 THEN 13 END"
_NEW_READS = _READS.replace(_CASES, _NEW)


def _new_records(t) -> DataFrame:
    return alignments.sam_records(alignment_text(t("events"), F.expr(_NEW)), "sample", "line")


@query(f"""{_NEW_READS}, called(g) AS (VALUES (0), (1)), k AS (SELECT sample, event_id, g, sum(CASE WHEN sign = (i IN (SELECT i FROM h WHERE h.j = g)) THEN 0 ELSE 1 END) AS k FROM ev, called GROUP BY ALL),
own AS (SELECT sample, event_id, g FROM (SELECT *, min(k) OVER (PARTITION BY event_id) AS least FROM k) WHERE k = least QUALIFY count(*) OVER (PARTITION BY event_id) = 1),
seen AS (SELECT own.sample, g, p, c, count(*) AS n FROM own JOIN m USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pos = m.p AND v.val = m.c) GROUP BY ALL),
told AS (SELECT own.sample, g, i, count(*) FILTER (sign AND i NOT IN (SELECT i FROM h WHERE h.j = g)) AS fp, count(*) FILTER (NOT sign AND i IN (SELECT i FROM h WHERE h.j = g)) AS fn FROM own JOIN ev USING (event_id) GROUP BY ALL),
c AS (SELECT sample, g, 'novel' AS kind, p AS pos, c AS alt, n FROM seen WHERE n >= 3 UNION ALL SELECT sample, g, CASE WHEN fp >= 3 THEN 'fp' ELSE 'fn' END, v.pos, CASE WHEN fp >= 3 THEN v.val ELSE 'A' END, CASE WHEN fp >= 3 THEN fp ELSE fn END FROM told JOIN v USING (i) WHERE fp >= 3 OR fn >= 3),
site AS (SELECT own.sample, g, s.pos, coalesce(m.c, 'A') AS base, count(*) AS n FROM own JOIN (SELECT DISTINCT sample, g, pos FROM c) s USING (sample, g) LEFT JOIN m ON m.event_id = own.event_id AND m.p = s.pos GROUP BY ALL)
SELECT c.sample, 'G*00' || g AS allele, kind, CAST(c.pos AS INTEGER) AS pos, alt, c.n, coalesce(max(site.n) FILTER (site.base = alt), 0) AS alt_depth FROM c JOIN site USING (sample, g, pos) GROUP BY ALL HAVING coalesce(max(site.n) FILTER (site.base = alt), 0) >= max(site.n)""")
def novel_discovery(t):
    records = _new_records(t)
    spark, known = records.sparkSession, catalogue(records.sparkSession)
    mates = written(reads.decoded(reads.mates(reads.read_pairs(records))), "mates")
    variants = written(reads.with_ids(reads.long_variants(mates), known), "read-variants")
    found = written(reads.evidence(mates, variants, known), "evidence")
    called = t("events").select(F.col("event_type").alias("sample"), F.lit(GENE).alias("gene"), F.explode(F.array(F.lit("G*000"), F.lit("G*001"))).alias("allele")).distinct()
    rows = spark.range(1)
    backbone = rows.select(F.lit(GENE).alias("gene"), F.repeat(F.lit("A"), F.lit(2 * HALF)).alias("seq"))
    sequences = rows.select(F.explode(F.array(F.lit("G*000"), F.lit("G*001"))).alias("allele"), F.repeat(F.lit("A"), F.lit(2 * HALF)).alias("seq"))
    new, _ = novel.discovered(mates, found, variants, known, called, backbone, sequences)
    count = F.when(F.col("kind") == "novel", F.col("novel")).when(F.col("kind") == "fp", F.col("fp")).otherwise(F.col("fn"))
    return new.select("sample", "allele", "kind", "pos", "alt", count.alias("n"), "alt_depth")


@query(f"""{_NEW_READS}, s AS (SELECT p, c, m.sample, count(*) AS n FROM m JOIN ok USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pos = m.p AND v.val = m.c) GROUP BY ALL)
SELECT 'nv:{GENE}:' || p || ':single:' || c AS variant_id, CAST(p AS INTEGER) AS pos, c AS val, count(*) AS samples, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM s GROUP BY ALL""")
def novel_registry(t):
    records, known = _new_records(t), None
    # Early samples make the registry, late ones extend it.
    for own in (records.filter("sample < 'm'"), records.filter("sample >= 'm'")):
        found = reads.with_ids(reads.long_variants(reads.decoded(reads.mates(reads.read_pairs(own)))), catalogue(records.sparkSession))
        known = written(novel.registry(written(found, "read-variants"), known), "registry")
    return novel.cohort_variants(known).select("variant_id", "pos", "val", "samples", "n", "most")


# The graph of what mates tell one after the other; its cycles are found by leaving out one edge at a time.
@query(f"""{_READS.replace("WITH ", "WITH RECURSIVE ", 1)}, nodes AS (SELECT sample, event_id, mate, i, sign, 'hv' || i || '|' || sign AS node, lead('hv' || i || '|' || sign) OVER (PARTITION BY event_id, mate ORDER BY i) AS next FROM ev),
edges AS (SELECT DISTINCT sample, least(node, next) AS u, greatest(node, next) AS v FROM nodes WHERE next IS NOT NULL),
arcs AS (SELECT sample, u, v, u || v AS e FROM edges UNION ALL SELECT sample, v, u, u || v FROM edges),
reach AS (SELECT sample, u || v AS e, u AS node FROM edges UNION SELECT r.sample, r.e, a.v FROM reach r JOIN arcs a ON a.sample = r.sample AND a.u = r.node AND a.e <> r.e),
cyc AS (SELECT DISTINCT edges.sample, unnest([edges.u, edges.v]) AS node FROM edges JOIN reach ON reach.sample = edges.sample AND reach.e = edges.u || edges.v AND reach.node = edges.v),
near(sample, start, reached) AS (SELECT sample, node, node FROM cyc UNION SELECT n.sample, n.start, a.v FROM near n JOIN arcs a ON a.sample = n.sample AND a.u = n.reached JOIN cyc ON cyc.sample = a.sample AND cyc.node = a.v),
comp AS (SELECT sample, start AS node, min(reached) AS component FROM near GROUP BY sample, start), al AS (SELECT DISTINCT j FROM h),
k AS (SELECT sample, component, j, sum(CASE WHEN sign = (i IN (SELECT i FROM h WHERE h.j = al.j)) THEN 0 ELSE 1 END) AS k FROM nodes JOIN comp USING (sample, node), al GROUP BY ALL)
SELECT sample, 'G*00' || j AS allele, count(*) AS votes FROM (SELECT *, min(k) OVER (PARTITION BY sample, component) AS least FROM k) WHERE k = least GROUP BY ALL""")
def component_typing(t):
    records = _records(t)
    known = catalogue(records.sparkSession)
    _, found = reads.decode_reads(records, known)
    return component_votes.votes(found, known, copies=1).select("sample", "allele", "votes")
