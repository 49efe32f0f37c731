"""Queries of reshapes, genome and mapping figures, dosages and names on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.functions import alleles, scalars
from locuspark.operators import dosage, evaluate, genome, novel, series, shapes
from locuspark.plans.registry import query, rounded
from locuspark.sources import alignments, results

# --- shapes ---------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderpriority)), ',') AS given FROM orders GROUP BY o_custkey")
def grouped_lists(t):
    return shapes.grouped_lists(t("orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", F.array_join("values", ",").alias("given"))


@query("SELECT o_custkey, " + ", ".join(f"coalesce(array_to_string(list_sort(list(o_orderpriority) FILTER (o_orderstatus = '{s}')), ','), '') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_custkey")
def lists_by_column(t):
    wide = shapes.lists_by_column(t("orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "o_orderpriority")
    return wide.select("o_custkey", *(F.array_join(c, ",").alias(c) for c in "FOP"))


@query("SELECT o_orderstatus AS status, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "5-LOW")) + " FROM orders GROUP BY o_orderstatus")
def transposed(t):
    priorities = ["1-URGENT", "2-HIGH", "5-LOW"]
    wide = t("orders").filter(F.col("o_orderpriority").isin(*priorities)).groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    return shapes.transposed(wide, "o_orderpriority", ["F", "O", "P"], priorities, "status")


@query("SELECT c_custkey, side, amount FROM (SELECT c_custkey, unnest(['debt', 'credit']) AS side, unnest([CASE WHEN c_acctbal < 0 THEN c_acctbal END, CASE WHEN c_acctbal > 0 THEN c_acctbal END]) AS amount FROM customer) WHERE amount IS NOT NULL")
def stacked(t):
    b = F.col("c_acctbal")
    sides = t("customer").select("c_custkey", F.when(b < 0, b).alias("debt"), F.when(b > 0, b).alias("credit"))
    return shapes.stacked(sides, ["c_custkey"], ["debt", "credit"], "side", "amount")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(CAST(CASE WHEN p_size > 20 THEN p_size END AS VARCHAR), 'NA') AS big, 'NA' AS lacking FROM part")
def reindexed(t):
    rows = t("part").select("p_name", "p_partkey", F.when(F.col("p_size") > 20, F.col("p_size")).alias("big"))
    return shapes.reindexed(rows, ["p_partkey", "big", "lacking"])


@query("SELECT c_nationkey, c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey")
def with_model(t):
    model = t("nation").filter("n_regionkey <> 1").withColumnRenamed("n_nationkey", "c_nationkey")
    return shapes.with_model(t("customer").select("c_nationkey", "c_custkey"), model, ["c_nationkey"], ["n_name"])


@query("""SELECT a.s_nationkey AS nation, s_suppkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) a
JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) b ON a.s_nationkey = b.c_nationkey AND a.n = b.n""")
def joined_in_order(t):
    c = t("customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", (-F.col("c_acctbal")).alias("_o"))
    return shapes.joined_in_order(t("supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey"), c, ["nation"], ["s_suppkey"], ["_o", "c_custkey"]).drop("_o")


@query("""WITH x AS (SELECT p_partkey AS o, substr(p_name, 1, 3 + p_partkey % 9) AS prefix, 'id' || p_partkey AS id FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, p_name, (SELECT max_by(id, o) FROM x WHERE starts_with(p_name, prefix)) AS id FROM part""")
def prefix_join(t):
    part = t("part")
    x = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("o"), F.substring("p_name", F.lit(1), (3 + F.col("p_partkey") % 9).cast("int")).alias("prefix"), F.concat(F.lit("id"), "p_partkey").alias("id"))
    return shapes.joined_by_prefix(part.select("p_partkey", "p_name"), "p_name", x, "prefix", "id", "o")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY CAST(l_orderkey AS VARCHAR), l_linenumber, l_partkey")
def name_sort(t):
    return shapes.sorted_by(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), F.col("l_orderkey").cast("string"), F.col("l_linenumber"), F.col("l_partkey"))


# --- genome ---------------------------------------------------------------------------------------------------

_LENGTH = "length(replace(p_name, ' ', ''))"


@query(f"SELECT p_type AS gene, count({_LENGTH}) AS n, round(avg({_LENGTH}), 6) AS mean, round(stddev_samp({_LENGTH}), 6) AS std, CAST(min({_LENGTH}) AS INTEGER) AS min, round(quantile_cont({_LENGTH}, 0.25), 6) AS p25, round(median({_LENGTH}), 6) AS median, round(quantile_cont({_LENGTH}, 0.75), 6) AS p75, CAST(max({_LENGTH}) AS INTEGER) AS max FROM part GROUP BY p_type")
def length_summary(t):
    msa = t("part").select(F.col("p_type").alias("gene"), F.concat(F.lit("a"), "p_partkey").alias("allele"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("seq"))
    return rounded(genome.described(genome.allele_lengths(msa), ["gene"], "length"), "mean", "std", "p25", "median", "p75")


_NAME = "replace(c_name, '#', '*') || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '0' END"
_FIELD = f"substr(regexp_extract({_NAME}, '^\\w+\\*(\\d+\\w*)', 1), 1, 3 + c_custkey % 6)"


@query(f"SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (length({_FIELD}) >= {n}) AS at_least_{n}" for n in (3, 5, 7)) + " FROM customer GROUP BY c_nationkey")
def resolution_counts(t):
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit("*")), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("0"))
    rows = t("customer").select("c_nationkey", F.substring(alleles.allele_field(name, 7), F.lit(1), (3 + F.col("c_custkey") % 6).cast("int")).alias("f"))
    field = "CASE WHEN regexp_like(f, '^[0-9]') THEN f ELSE '' END"
    return genome.resolution_counts(rows, ["c_nationkey"], F.expr(field))


@query("SELECT l_suppkey, l_returnflag, n, round(n / sum(n) OVER (PARTITION BY l_suppkey), 9) AS share FROM (SELECT l_suppkey, l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)")
def share_within(t):
    return rounded(genome.share_within(t("lineitem").withColumn("n", F.col("l_quantity").cast("bigint")), ["l_suppkey"], "l_returnflag", "n"), "share", digits=9)


@query("""WITH p AS (SELECT l_suppkey AS sample, l_returnflag AS gene, count(*) AS sets, avg(l_linenumber) AS cn FROM lineitem GROUP BY ALL), r AS (SELECT sample, gene, sets, round(cn) AS cn FROM p)
SELECT gene, cn, CASE WHEN grouping(gene) = 1 THEN 2 WHEN grouping(cn) = 1 THEN 1 ELSE 0 END AS level, round(avg(sets), 6) AS mean_sets FROM r GROUP BY GROUPING SETS ((gene, cn), (gene), (cn))""")
def possible_set_means(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("gene"), "l_linenumber")
    cn = rows.groupBy("sample", "gene").agg(F.round(F.avg("l_linenumber")).alias("cn"))
    return rounded(genome.possible_set_means(rows.join(cn, ["sample", "gene"])), "mean_sets").withColumn("level", F.col("level").cast("int"))


@query("""WITH a AS (SELECT l_suppkey, l_returnflag AS gene, l_linenumber, count(*) FILTER (NOT l_quantity < 25) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, gene, sum(n) AS s FROM a GROUP BY ALL)
SELECT gene, round((SELECT avg(n) FROM a WHERE a.gene = s.gene), 6) AS mean_per_allele, round(avg(s), 6) AS mean_per_sample FROM s GROUP BY gene""")
def novel_means(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("gene"), F.col("l_linenumber").alias("allele"), (F.col("l_quantity") < 25).alias("skip"))
    return rounded(genome.novel_means(rows), "mean_per_allele", "mean_per_sample")


_OLD = "SELECT DISTINCT o_orderpriority AS gene, o_custkey || CASE WHEN o_custkey % 4 = 0 THEN 'e' ELSE '' END AS allele FROM orders WHERE o_orderstatus = 'O'"


@query(f"""WITH o AS ({_OLD}), w AS ({_OLD.replace("= 'O'", "= 'F'")}), b AS (SELECT gene, allele, o.gene IS NOT NULL AS is_old, w.gene IS NOT NULL AS is_new, allele LIKE '%e' AS exon FROM o FULL JOIN w USING (gene, allele)),
c AS (SELECT gene, count(*) FILTER (is_old AND exon) AS old_exon, count(*) FILTER (is_old AND NOT exon) AS old_full, count(*) FILTER (is_new AND exon) AS new_exon, count(*) FILTER (is_new AND NOT exon) AS new_full, count(*) FILTER (is_old AND NOT is_new AND exon) AS exon_gone FROM b WHERE gene IN (SELECT gene FROM o) GROUP BY ROLLUP (gene))
SELECT *, old_exon + old_full AS old_total, new_exon + new_full AS new_total, new_exon - old_exon AS exon_more, new_full - old_full AS full_more FROM c""")
def version_totals(t):
    name = F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 4 == 0, "e").otherwise(""))
    side = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select(F.col("o_orderpriority").alias("gene"), name.alias("allele"))
    return genome.version_totals(side("O"), side("F"))


_CHARS = "SELECT s_nationkey % 5 AS s_nationkey, s_suppkey, CAST(unnest(range(length(s_name))) AS INTEGER) AS pos, unnest(string_split(s_name, '')) AS base FROM supplier"


def _columns(t) -> DataFrame:
    return t("supplier").select((F.col("s_nationkey") % 5).alias("s_nationkey"), "s_suppkey", F.posexplode(F.split("s_name", "")).alias("pos", "base"))


@query(f"SELECT s_nationkey, pos FROM ({_CHARS}) GROUP BY ALL HAVING count(DISTINCT base) > 1")
def variable_positions(t):
    return genome.variable_positions(_columns(t), ["s_nationkey"])


@query(f"""WITH c AS ({_CHARS}), a AS (SELECT pos FROM c WHERE s_nationkey < 2 GROUP BY pos HAVING count(DISTINCT base) > 1), b AS (SELECT pos FROM c WHERE s_nationkey >= 2 GROUP BY pos HAVING count(DISTINCT base) > 1), w AS (SELECT pos FROM c GROUP BY pos HAVING count(DISTINCT base) > 1)
SELECT pos, 'low' AS source FROM a UNION ALL SELECT pos, 'high' FROM b UNION ALL SELECT pos, 'between' FROM (SELECT pos FROM w EXCEPT SELECT pos FROM a EXCEPT SELECT pos FROM b)""")
def between_groups(t):
    rows = _columns(t).withColumn("side", F.when(F.col("s_nationkey") < 2, "low").otherwise("high"))
    return genome.between_groups(rows, "side", "low", "high")


@query(f"""WITH o AS (SELECT s_nationkey, pos, min(base) AS base FROM ({_CHARS}) GROUP BY ALL HAVING count(DISTINCT base) = 1)
SELECT x.s_nationkey AS a, y.s_nationkey AS b, count(*) FILTER (x.base <> y.base) AS positions FROM o x JOIN o y USING (pos) WHERE x.s_nationkey < y.s_nationkey GROUP BY ALL""")
def dissimilarity(t):
    return genome.dissimilarity(_columns(t), "s_nationkey", "s_suppkey")


@query("SELECT p_partkey, array_to_string([CASE WHEN i = 1 THEN x ELSE 'a' || x END for x, i in string_split(p_name, 'a')], '|') AS parts FROM part")
def split_keeping(t):
    return t("part").select("p_partkey", F.array_join(genome.split_keeping(F.col("p_name"), "a"), "|").alias("parts"))


@query("""WITH c AS (SELECT p_type, p_partkey, unnest(range(length(p_name))) AS pos, unnest(string_split(p_name, '')) AS b FROM part)
SELECT p_partkey, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (pos >= 2 AND pos < 6 OR pos >= 9 AND pos < 12), '') AS exon, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (NOT (pos >= 2 AND pos < 6 OR pos >= 9 AND pos < 12)), '') AS intron FROM c WHERE b <> ' ' GROUP BY p_partkey""")
def exon_intron_positions(t):
    part = t("part").select(F.col("p_type").alias("gene"), F.col("p_partkey").alias("allele"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("seq"))
    spans = part.select("gene").distinct().select("gene", F.inline(F.array(F.struct(F.lit(2).alias("start"), F.lit(6).alias("end")), F.struct(F.lit(9).alias("start"), F.lit(12).alias("end")))))
    out = genome.exon_and_intron_positions(part, spans)
    return out.select(F.col("allele").alias("p_partkey"), *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("exon", "intron")))


@query("""WITH p AS (SELECT p_partkey AS name, pos, substr(p_name, CAST(pos AS INTEGER) + 1, 7) AS s FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name) - 2, 2)) AS pos FROM part WHERE p_partkey % 2 = 0))
SELECT name, CAST(pos AS INTEGER) AS pos, EXISTS (SELECT 1 FROM part b WHERE p_partkey % 2 = 1 AND contains(b.p_name, p.s)) AS found FROM p""")
def shared_segments(t):
    side = lambda r: t("part").filter(F.col("p_partkey") % 2 == r).select(F.col("p_partkey").alias("name"), F.col("p_name").alias("seq"))
    return genome.shared_segments(side(0), side(1), segment=7, step=2)


@query("""WITH b AS (SELECT l_suppkey AS gene, l_linenumber * 7 AS s FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)),
p AS (SELECT l_suppkey AS gene, CAST(l_quantity AS INTEGER) AS pos FROM lineitem), h AS (SELECT p.gene, CASE WHEN s % 2 = 0 THEN 'exon' ELSE 'intron' END AS region FROM p JOIN b ON p.gene = b.gene AND pos >= s AND pos < s + 7)
SELECT gene, region, n, round(n / sum(n) OVER (PARTITION BY gene), 9) AS share FROM (SELECT gene, region, count(*) AS n FROM h GROUP BY ALL)""")
def variants_by_region(t):
    s = F.col("l_linenumber") * 7
    blocks = t("lineitem").select(F.col("l_suppkey").alias("gene"), F.when(s % 2 == 0, "exon").otherwise("intron").alias("type"), s.alias("start"), (s + 7).alias("end")).distinct()
    points = t("lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_quantity").cast("int").alias("pos"))
    return rounded(genome.variants_by_region(points, blocks), "share", digits=9)


# --- mapping --------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag AS method, l_linestatus AS gene, round(avg(l_discount), 9) AS precision, round(avg(l_tax), 9) AS recall, CAST(grouping(l_linestatus) AS INTEGER) AS all_genes, round(1 - avg(l_discount), 9) AS fdr FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def mapping_means(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("gene"), F.col("l_discount").alias("precision"), F.col("l_tax").alias("recall"))
    return rounded(evaluate.mapping_means(rows, ["method"]), "precision", "recall", "fdr", digits=9).withColumn("all_genes", F.col("all_genes").cast("int"))


_FLAG = "CAST((CASE WHEN event_id % 2 = 0 THEN 66 ELSE 130 END) - (CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) + (CASE WHEN event_id % 13 = 0 THEN 4 ELSE 0 END) + (CASE WHEN event_id % 5 = 0 THEN 256 ELSE 0 END) AS INTEGER)"


def _mapped(t) -> DataFrame:
    e = F.col("event_id")
    flag = F.when(e % 2 == 0, 66).otherwise(130) - F.when(e % 7 == 0, 2).otherwise(0) + F.when(e % 13 == 0, 4).otherwise(0) + F.when(e % 5 == 0, 256).otherwise(0)
    name = F.concat_ws("|", "user_id", F.concat(F.lit("r"), e % 3), F.when(e % 4 == 0, "*").otherwise((e % 40).cast("string")), F.concat(F.lit("s"), e % 5), F.when(e % 9 == 0, "*").otherwise((e % 50).cast("string")))
    return t("events").select(F.col("event_type").alias("sample"), name.alias("qname"), flag.cast("int").alias("flag"), F.concat(F.lit("ref"), e % 4).alias("rname"), (e % 100 + 1).cast("int").alias("pos"))


@query(f"""SELECT sample, ref, CAST(pos AS INTEGER) AS pos, prev_ref, CAST(prev_pos AS INTEGER) AS prev_pos FROM (SELECT event_type AS sample, 'ref' || event_id % 4 AS ref, event_id % 100 AS pos, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id % 3 ELSE 's' || event_id % 5 END AS prev_ref,
CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN '*' ELSE CAST(event_id % 40 AS VARCHAR) END ELSE CASE WHEN event_id % 9 = 0 THEN '*' ELSE CAST(event_id % 50 AS VARCHAR) END END AS prev_pos FROM events WHERE ({_FLAG} & 2) <> 0) WHERE prev_pos <> '*'""")
def previous_positions(t):
    return evaluate.previously_mapped(evaluate.previous_positions(_mapped(t), ["sample"]))


@query(f"SELECT event_type AS sample, CAST(user_id AS VARCHAR) AS user, count(*) AS multiple, CAST(count(*) FILTER (({_FLAG} & 4) = 0) AS BIGINT) AS mapped FROM events GROUP BY ALL")
def multiplicity(t):
    rows = _mapped(t).withColumn("user", F.split_part("qname", F.lit("|"), F.lit(1)))
    left = evaluate.mapped_records(rows).groupBy("sample", "user").agg(F.count("*").alias("mapped"))
    counted = evaluate.with_multiplicity(rows, ["sample"], "user").select("sample", "user", F.col("multiple").cast("bigint").alias("multiple")).distinct()
    return counted.join(left, ["sample", "user"], "left").select("sample", "user", "multiple", F.coalesce("mapped", F.lit(0)).alias("mapped"))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 40)")
def reserved_pairs(t):
    e = t("events").select("event_id", "user_id", "event_type", "value")
    return evaluate.reserved_pairs(e, e.filter("value > 40"), "user_id").select("event_id", "user_id", "event_type")


@query(f"SELECT event_type AS sample, CAST(user_id AS VARCHAR) AS qname, string_agg({_FLAG} || ':' || 'ref' || event_id % 4, ',' ORDER BY {_FLAG}, event_id % 4) AS targets FROM events GROUP BY ALL")
def read_targets(t):
    rows = _mapped(t).withColumn("qname", F.split_part("qname", F.lit("|"), F.lit(1)))
    out = evaluate.read_targets(rows, ["sample"])
    return out.select("sample", "qname", F.array_join(F.transform("targets", lambda x: F.concat_ws(":", x["flag"], x["rname"])), ",").alias("targets"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 2)")
def common_ids(t):
    return evaluate.common_ids(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus", ["O", "P"], "o_custkey")


@query("SELECT l_returnflag, count(d) AS n, CAST(sum(d) AS BIGINT) AS total, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM (SELECT l_returnflag, CASE WHEN l_linenumber < 5 THEN CAST(l_quantity AS BIGINT) END AS d FROM lineitem) GROUP BY l_returnflag")
def base_differences(t):
    rows = t("lineitem").select("l_returnflag", F.when(F.col("l_linenumber") < 5, F.col("l_quantity").cast("bigint")).alias("base_diff"))
    return rounded(evaluate.base_difference_statistics(rows, ["l_returnflag"]), "mean", "sd")


@query("SELECT l_suppkey, l_linenumber, round(median(l_quantity), 6) AS median, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.75), 6) AS p75 FROM lineitem GROUP BY ALL")
def depth_curves(t):
    return rounded(series.depth_curves(t("lineitem"), ["l_suppkey", "l_linenumber"], "l_quantity"), "median", "mean", "sd", "p25", "p75")


@query("""WITH c AS (SELECT l_suppkey AS ref, CAST(l_shipdate AS DATE) - DATE '1990-01-01' AS pos, count(*) AS d FROM lineitem GROUP BY ALL),
o AS (SELECT *, CASE WHEN pos - lag(pos) OVER w < 500 THEN 0 ELSE 1 END AS o FROM c WINDOW w AS (PARTITION BY ref ORDER BY pos)), i AS (SELECT *, sum(o) OVER (PARTITION BY ref ORDER BY pos) AS g FROM o)
SELECT ref, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(last - first AS INTEGER) AS length, round(s / (last - first), 6) AS mean_depth FROM (SELECT ref, g, min(pos) AS first, max(pos) AS last, sum(d) AS s FROM i GROUP BY ALL) WHERE last - first >= 2000 AND s / (last - first) >= 1 * 2.0 / 150""")
def cohort_regions(t):
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    return rounded(series.cohort_regions(t("lineitem").select(F.col("l_suppkey").alias("ref"), day.alias("pos")), 1), "mean_depth")


@query("""SELECT method, gene, round(1 - sum(abs(diff)) / sum(truth), 6) AS accuracy, count(*) FILTER (abs(diff) > 1) AS far FROM (SELECT 'm' AS method, coalesce(a.o_orderpriority, b.o_orderpriority) AS gene, coalesce(x, 0) AS truth, coalesce(y, 0) - coalesce(x, 0) AS diff
FROM (SELECT o_custkey, o_orderpriority, count(*) AS x FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) a FULL JOIN (SELECT o_custkey, o_orderpriority, count(*) AS y FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority) GROUP BY ALL""")
def copies_by_gene(t):
    side = lambda s: evaluate.copies_from_alleles(t("orders").filter(F.col("o_orderstatus") != s).select(F.col("o_custkey").alias("sample"), F.concat("o_orderpriority", F.lit("*"), "o_orderstatus").alias("allele")), "sample", "allele")
    found = evaluate.compare_copies(side("P"), side("F"), ["sample"]).withColumn("method", F.lit("m"))
    levels = evaluate.copies_accuracy(found).filter("gene is not null").select("method", "gene", F.round("accuracy", 6).alias("accuracy"))
    far = found.groupBy("gene").agg(F.count_if(F.abs("diff") > 1).alias("far"))
    return levels.join(far, "gene").select("method", "gene", "accuracy", "far")


@query("SELECT failed, n FROM (SELECT count(*) FILTER (f) AS failed, count(*) AS n FROM (SELECT o_custkey, bool_and(o_orderstatus = 'P') AS f FROM orders GROUP BY o_custkey))")
def failed_samples(t):
    kind = F.when(F.col("o_orderstatus") == "P", "FN").otherwise("MATCH7")
    rows = t("orders").select(F.col("o_custkey").alias("sample"), kind.alias("match"))
    n = rows.select("sample").distinct().agg(F.count("*").alias("n"))
    return evaluate.match_summary(rows).select(F.col("fail_sample").alias("failed")).crossJoin(F.broadcast(n))  # one row each


# --- dosages --------------------------------------------------------------------------------------------------

_DOSES = "SELECT allele, [CASE WHEN list_contains(ps, i) THEN 1 ELSE 0 END for i in range(6)] AS dose FROM (SELECT p_brand AS allele, list(DISTINCT p_size % 6) AS ps FROM part GROUP BY p_brand)"


@query(f"""WITH v AS ({_DOSES})
SELECT dose::VARCHAR AS dose, string_agg(allele, '-' ORDER BY allele) AS allele FROM v GROUP BY dose""")
def same_dosages(t):
    return _vectors(t).select(F.concat(F.lit("["), F.array_join(F.transform("dose", lambda x: x.cast("string")), ", "), F.lit("]")).alias("dose"), "allele")


def _vectors(t) -> DataFrame:
    d = t("part").select(F.col("p_brand").alias("allele"), (F.col("p_size") % 6).alias("pos"))
    v = d.groupBy("allele").agg(F.collect_set("pos").alias("_s")).select("allele", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array_contains("_s", i).cast("int")).alias("dose"))
    return dosage.same_vectors(v.withColumn("gene", F.lit("g")), ["gene"], "allele", "dose")


@query(f"""WITH v AS ({_DOSES}),
u AS (SELECT dose, string_agg(allele, '-' ORDER BY allele) AS allele FROM v GROUP BY dose), c AS (SELECT x.allele || '/' || y.allele AS allele, [x.dose[i] + y.dose[i] for i in range(1, 7)] AS dose FROM u x JOIN u y ON x.allele <= y.allele),
s AS (SELECT c_custkey AS sample, [(c_custkey // (i + 1)) % 3 for i in range(6)] AS seen FROM customer WHERE c_custkey <= 60),
m AS (SELECT sample, allele, list_sum([abs(seen[i] - dose[i]) for i in range(1, 7)])::DOUBLE AS distance FROM s, c)
SELECT sample, CASE WHEN distance = 0 THEN string_agg(allele, '-or-' ORDER BY allele) ELSE string_agg(allele, '-OR-' ORDER BY allele) END AS allele, distance, distance = 0 AS known FROM (SELECT * FROM m QUALIFY distance = min(distance) OVER (PARTITION BY sample)) GROUP BY sample, distance""")
def dosage_typing(t):
    sets = dosage.summed_vectors(_vectors(t), ["gene"], "allele", "dose", 2)
    seen = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.floor(F.col("c_custkey") / (i + 1)) % 3).cast("int"))
    samples = t("customer").filter("c_custkey <= 60").select(F.col("c_custkey").alias("sample"), F.lit("g").alias("gene"), seen.alias("dose"))
    return dosage.nearest_sets(samples, sets, ["gene"], "allele", "dose").drop("gene")


_B = "['A', 'C', 'G', 'T']"


@query(f"""WITH c AS (SELECT l_suppkey AS sample, l_linenumber AS pos, {_B}[l_orderkey % 4 + 1] AS ref, CASE WHEN l_orderkey % 9 = 0 THEN '<NON_REF>' ELSE {_B}[(l_orderkey + 1 + l_partkey % 2) % 4 + 1] END AS alt, CAST(l_quantity AS INTEGER) % 3 AS dosage FROM lineitem),
p AS (SELECT DISTINCT CAST(r AS BIGINT) AS pos, {_B}[r % 4 + 1] AS p_ref, {_B}[(r + 1) % 4 + 1] AS p_alt FROM range(1, 8) t(r) UNION SELECT CAST(r AS BIGINT), {_B}[(r + 2) % 4 + 1], {_B}[r % 4 + 1] FROM range(1, 8) t(r)),
b AS (SELECT *, ref = p_ref AND alt = p_alt AS exact, CASE WHEN ref = p_ref AND (alt = p_alt OR alt = '<NON_REF>') THEN 'SAME' WHEN ref = p_alt AND (alt = p_ref OR alt = '<NON_REF>') THEN 'OPP' END AS flag FROM c JOIN p USING (pos)),
f AS (SELECT *, bool_or(exact) OVER (PARTITION BY sample, pos, ref, alt) AS any_exact FROM b WHERE flag IS NOT NULL)
SELECT sample, pos, p_ref, p_alt, flag, dosage, count(*) AS n FROM f WHERE exact OR NOT any_exact GROUP BY ALL""")
def oriented_variants(t):
    spark = t("lineitem").sparkSession
    b = F.array(*map(F.lit, "ACGT"))
    at = lambda i: F.get(b, (i % 4).cast("int"))
    k = F.col("l_orderkey")
    calls = t("lineitem").select(F.col("l_suppkey").alias("sample"), F.lit("g").alias("gene"), F.col("l_linenumber").cast("bigint").alias("pos"), at(k).alias("ref"), F.when(k % 9 == 0, "<NON_REF>").otherwise(at(k + 1 + F.col("l_partkey") % 2)).alias("alt"), (F.col("l_quantity").cast("int") % 3).alias("dosage"))
    r = F.col("id")
    panel = spark.range(1, 8).select(F.lit("g").alias("gene"), r.alias("pos"), at(r).alias("ref"), at(r + 1).alias("alt")).union(spark.range(1, 8).select(F.lit("g"), r, at(r + 2), at(r)))
    return dosage.oriented(calls, panel).groupBy("sample", "pos", "p_ref", "p_alt", "flag", "dosage").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_suppkey AS sample, l_orderkey AS pos, l_linenumber, ['A', 'AC', 'T'][l_partkey % 3 + 1] AS ref, ['C', 'GT', 'G'][l_partkey % 3 + 1] AS a1, ['G', 'AT', 'C'][l_partkey % 3 + 1] AS a2, [l_orderkey % 3, l_linenumber % 3] AS gt FROM lineitem),
h AS (SELECT sample, pos, ref, a1, a2, unnest([0, 1]) AS haplotype, unnest(gt) AS x FROM g), k AS (SELECT sample, haplotype, pos, ref, CASE x WHEN 1 THEN a1 ELSE a2 END AS alt FROM h WHERE x > 0),
s AS (SELECT sample, haplotype, pos + i AS pos, substr(ref, CAST(i AS INTEGER) + 1, 1) AS ref, substr(alt, CAST(i AS INTEGER) + 1, 1) AS alt FROM (SELECT *, unnest(range(length(ref))) AS i FROM k))
SELECT sample, CAST(haplotype AS INTEGER) AS haplotype, alt, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM s WHERE ref <> alt GROUP BY ALL""")
def phased_haplotypes(t):
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("l_partkey") % 3).cast("int"))
    gt = F.concat_ws("|", F.col("l_orderkey") % 3, F.col("l_linenumber") % 3)
    vcf = t("lineitem").select(F.lit("g").alias("chrom"), F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("pos"), pick("A", "AC", "T").alias("ref"), F.concat_ws(",", pick("C", "GT", "G"), pick("G", "AT", "C")).alias("alt"), gt.alias("gt"))
    return alignments.haplotype_variants(vcf).groupBy("sample", "haplotype", "alt").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


# --- names ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'data.' || p_partkey ELSE 'data.' || p_partkey || '.read' END AS common, 'data_' || p_partkey || '_read_r1_fq' AS escaped, 'out/' || p_partkey || '.fq' AS moved, CAST(p_partkey AS VARCHAR) AS id FROM part")
def file_names(t):
    k = F.col("p_partkey").cast("string")
    a, b = F.concat(F.lit("data."), k, F.lit(".read.r1.fq")), F.concat(F.lit("data."), k, F.when(F.col("p_size") % 3 == 0, ".other.r1.fq").otherwise(".read.r2.fq"))
    return t("part").select("p_partkey", scalars.common_name(a, b).alias("common"), scalars.escaped_name(a).alias("escaped"), scalars.in_folder(F.concat(F.lit("a/b/"), k, F.lit(".fq")), F.lit("out/")).alias("moved"), scalars.id_from_pattern(F.concat(F.lit("x."), k, F.lit(".fq")), "x.{}.fq").alias("id"))


@query("""WITH h AS (SELECT s_nationkey AS id, s_suppkey AS h, list_sort([('KIR2DL' || (s_suppkey % 4) || '*00' || (s_suppkey % 7)), ('KIR3DL3*0' || (s_suppkey % 5))]) AS a FROM supplier)
SELECT id, string_agg('2', '+' ORDER BY h) AS haplos, string_agg(array_to_string(a, '_'), '_' ORDER BY h) AS alleles FROM h GROUP BY id""")
def long_read_import(t):
    s = F.col("s_suppkey")
    field = F.concat(F.lit("KIR2DL"), s % 4, F.lit("*0_0"), s % 7, F.lit("/KIR9*1(99.1%)~KIR3DL3*0"), s % 5, F.lit("#(100.00%)~"))
    found = results.long_read_alleles(t("supplier").select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("h"), field.alias("field")), ["id", "h"], "field")
    return results.merged_haplotypes(found, "id", "h")


@query("""WITH k AS (SELECT user_id AS pair_id, event_type AS allele, CAST(min(floor(value / 10)) AS BIGINT) AS k FROM events GROUP BY ALL), b AS (SELECT * FROM k QUALIFY k = min(k) OVER (PARTITION BY pair_id))
SELECT alleles, count(*) AS n FROM (SELECT pair_id, string_agg(allele, ',' ORDER BY allele) AS alleles FROM b GROUP BY pair_id) GROUP BY alleles""")
def read_groups(t):
    k = t("events").groupBy(F.col("user_id").alias("pair_id"), F.col("event_type").alias("allele")).agg(F.min(F.floor(F.col("value") / 10)).alias("k"))
    found = novel.read_groups(k.withColumn("sample", F.lit("s")).withColumn("gene", F.lit("g")))
    return found.groupBy(F.array_join("alleles", ",").alias("alleles")).agg(F.count("*").alias("n"))


# --- alignments and evaluation --------------------------------------------------------------------------------

_SEQ = "SELECT 'g' || s_suppkey % 3 AS gene, 'g' || s_suppkey % 3 || '*' || s_suppkey AS allele, s_name || CASE WHEN s_suppkey % 4 = 0 THEN 'E' ELSE 'A' END || CASE WHEN s_suppkey % 5 = 0 THEN '--T' ELSE 'ACT' END AS seq FROM supplier"


def _msa(t) -> DataFrame:
    k = F.col("s_suppkey")
    gene = F.concat(F.lit("g"), k % 3)
    return t("supplier").select(gene.alias("gene"), F.concat(gene, F.lit("*"), k).alias("allele"), F.concat("s_name", F.when(k % 4 == 0, "E").otherwise("A"), F.when(k % 5 == 0, "--T").otherwise("ACT")).alias("seq"))


_BACK = f"WITH q AS ({_SEQ}), c AS (SELECT gene, allele, CAST(unnest(range(length(seq))) AS INTEGER) AS pos, unnest(string_split(seq, '')) AS base FROM q), b AS (SELECT gene, pos, base AS back FROM (SELECT gene, pos, base, row_number() OVER (PARTITION BY gene, pos ORDER BY count(*) DESC, base) AS r FROM c WHERE base NOT IN ('-', 'E') GROUP BY gene, pos, base) WHERE r = 1)"
_DIFFER = f"""{_BACK}, d AS (SELECT gene, allele, pos, 'single' AS typ, base AS val, NULL::INTEGER AS del_len FROM c JOIN b USING (gene, pos) WHERE base NOT IN ('-', 'E') AND base <> back
UNION ALL SELECT gene, allele, CAST(min(pos) AS INTEGER), 'deletion', NULL, CAST(count(*) AS INTEGER) FROM c WHERE base = '-' GROUP BY gene, allele)"""


@query(f"{_DIFFER} SELECT * FROM d")
def msa_variants(t):
    from locuspark.operators import alignment

    return alignment.variants_of(alignment.with_consensus_backbone(_msa(t)))


@query(f"""{_DIFFER}, v AS (SELECT gene AS ref, pos, typ, CASE typ WHEN 'single' THEN 1 ELSE 2 END AS rk, val, del_len, string_agg(allele, ' ' ORDER BY allele) AS alleles, count(*) AS n FROM d GROUP BY ALL)
SELECT 'hv' || (row_number() OVER (ORDER BY ref, pos, rk, coalesce(val, ''), coalesce(del_len, 0)) - 1) AS id, ref, pos, typ, alleles, round(n / (SELECT count(*) FROM q WHERE q.gene = ref), 9) AS freq FROM v""")
def msa_catalogue(t):
    from locuspark.operators import alignment

    msa = alignment.with_consensus_backbone(_msa(t))
    known = alignment.variant_catalogue(alignment.variants_of(msa))
    out = known.join(alignment.variant_frequencies(known, msa), "id")
    return rounded(out.select("id", "ref", "pos", "typ", F.array_join("allele", " ").alias("alleles"), "freq"), "freq", digits=9)


@query(f"""WITH q AS ({_SEQ}) SELECT allele, gene IN ('g0', 'g1') AS whole, length(replace(replace(seq, '-', ''), 'E', '')) < 0.9 * max(length(replace(replace(seq, '-', ''), 'E', ''))) OVER (PARTITION BY gene) AS short, contains(substr(seq, 17, 4), 'E') AS lacking FROM q""")
def msa_quality(t):
    from locuspark.operators import alignment

    msa = _msa(t)
    blocks = msa.select("gene").distinct().select("gene", F.lit("e1").alias("block"), F.lit("exon").alias("type"), F.lit(16).alias("start"), F.lit(20).alias("end"))
    mark = lambda df, name: df.select("allele", F.lit(True).alias(name))
    out = msa.join(mark(alignment.short_sequences(msa, 0.9), "short"), "allele", "left").join(mark(alignment.incomplete_exons(msa, blocks), "lacking"), "allele", "left")
    return out.select("allele", F.col("gene").isin("g0", "g1").alias("whole"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("short", "lacking")))


@query("""WITH r AS (SELECT l_suppkey AS gene, l_linenumber AS idx, l_returnflag AS allele, l_partkey % 100 AS k FROM lineitem), n AS (SELECT gene, idx, CAST(max(length(CAST(k AS VARCHAR))) AS INTEGER) AS l FROM r GROUP BY ALL),
p AS (SELECT gene, idx, allele, CAST(min(k) AS VARCHAR) AS s FROM r GROUP BY ALL)
SELECT g.gene, g.allele, string_agg(CASE WHEN s IS NULL THEN repeat('-', l) ELSE rpad(s, l, 'x') END, '' ORDER BY n.idx) AS seq FROM (SELECT DISTINCT gene, allele FROM r) g JOIN n ON g.gene = n.gene LEFT JOIN p ON p.gene = g.gene AND p.allele = g.allele AND p.idx = n.idx GROUP BY g.gene, g.allele""")
def merged_blocks(t):
    from pyspark.sql import Window as W

    from locuspark.operators import alignment

    rows = t("lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("allele"), (F.col("l_partkey") % 100).alias("k"))
    parts = rows.groupBy("gene", "idx", "allele").agg(F.min("k").cast("string").alias("s"), F.max(F.length(F.col("k").cast("string"))).alias("l"))
    parts = parts.select("gene", "idx", "allele", F.rpad("s", F.max("l").over(W.partitionBy("gene", "idx")), F.lit("x")).alias("seq"))
    return alignment.merged_blocks(parts)


@query(f"""WITH r AS (SELECT event_type AS sample, CAST(user_id AS VARCHAR) AS qname, {_FLAG} AS flag FROM events), q AS (SELECT sample, qname, bool_or((flag & 2) <> 0) AS pair, bool_or((flag & 256) <> 0) AS secd FROM r GROUP BY ALL)
SELECT sample, count(*) AS total, count(*) FILTER (pair) AS pair, count(*) FILTER (NOT pair) AS miss, count(*) FILTER (secd) AS secd FROM q GROUP BY sample""")
def mapping_status(t):
    rows = _mapped(t).withColumn("qname", F.split_part("qname", F.lit("|"), F.lit(1)))
    return evaluate.mapping_status(rows, ["sample"])


@query(f"""WITH r AS (SELECT event_type AS sample, CAST(user_id AS VARCHAR) AS qname, {_FLAG} AS flag, 'ref' || event_id % 4 AS gene, CASE WHEN 'ref' || event_id % 4 = 'ref' || user_id % 4 THEN 1.0 ELSE 0.0 END AS ok, 'ref' || user_id % 4 AS truth FROM events WHERE ({_FLAG} & 2) <> 0),
k AS (SELECT *, count(*) OVER (PARTITION BY sample, qname) AS k FROM r), v AS (SELECT sample, truth, ok, 'all' AS view, 1.0 AS w FROM k UNION ALL SELECT sample, truth, ok, 'read', 1.0 / k FROM k UNION ALL SELECT sample, truth, ok, 'unique', 1.0 FROM k WHERE k = 2 UNION ALL SELECT sample, truth, ok, 'primary', 1.0 FROM k WHERE (flag & 256) = 0)
SELECT sample, view, truth AS gene, round(sum(ok * w), 6) AS "right", round(sum(w), 6) AS total FROM v GROUP BY ALL""")
def mapping_counts(t):
    rows = _mapped(t).withColumn("qname", F.split_part("qname", F.lit("|"), F.lit(1)))
    truth = F.concat(F.lit("ref"), F.col("qname").cast("bigint") % 4)
    return rounded(evaluate.mapping_counts(rows, truth, by=["sample"]), "right", "total")


_TRUTH = "SELECT s_suppkey AS sample, CASE s_suppkey % 5 WHEN 0 THEN 'KIR2DS4*001e3DL1*015' WHEN 1 THEN 'KIR2DL4*00' || s_nationkey || '#' WHEN 2 THEN 'KIR2DL4*001+' WHEN 3 THEN 'KIR3DL2*002$' ELSE 'KIR3DL3*003' END AS allele FROM supplier"


@query(f"WITH a AS ({_TRUTH}) SELECT DISTINCT sample, gene FROM (SELECT sample, unnest(CASE WHEN regexp_matches(allele, 'e\\d') THEN ['KIR2DS4', 'KIR3DL1'] WHEN regexp_matches(allele, '[#+=]') THEN [split_part(allele, '*', 1)] ELSE [] END) AS gene FROM a)")
def novelty_exclusions(t):
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "KIR2DS4*001e3DL1*015").when(k == 1, F.concat(F.lit("KIR2DL4*00"), "s_nationkey", F.lit("#"))).when(k == 2, "KIR2DL4*001+").when(k == 3, "KIR3DL2*002$").otherwise("KIR3DL3*003")
    return evaluate.exclusions(t("supplier").select(F.col("s_suppkey").alias("sample"), name.alias("allele")), 5)


@query("""WITH c AS (SELECT o_custkey AS sample, ['KIR2DL1', 'KIR2DS1', 'KIR3DL3'][o_orderkey % 3 + 1] AS gene, count(*) AS cn FROM orders GROUP BY ALL), u AS (SELECT DISTINCT o_custkey AS sample FROM orders WHERE o_orderstatus = 'P')
SELECT sample, CASE WHEN gene <> 'KIR3DL3' AND sample IN (SELECT sample FROM u) THEN 'KIR2DL1S1' ELSE gene END AS gene, CAST(sum(cn) AS BIGINT) AS cn FROM c GROUP BY ALL""")
def merged_gene_copies(t):
    gene = F.get(F.array(*map(F.lit, ("KIR2DL1", "KIR2DS1", "KIR3DL3"))), (F.col("o_orderkey") % 3).cast("int"))
    cn = t("orders").groupBy(F.col("o_custkey").alias("sample"), gene.alias("gene")).agg(F.count("*").alias("cn"))
    other = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("sample"), F.lit("KIR2DL1S1").alias("gene"))
    return evaluate.merged_copies(cn, other, ["sample"])


# Truths and calls with three to seven digits, by customer; the SQL takes one truth after the other, pass by pass.
_GREEDY = """WITH RECURSIVE n(n) AS (VALUES (3), (5), (7)), names AS (SELECT CAST(o_custkey AS VARCHAR) AS sample, o_orderkey % 2 AS side, substring('00' || (o_orderkey // 4 % 3 + 1) || '0' || (o_orderkey // 16 % 2 + 1) || '0' || (o_orderkey // 32 % 2 + 1), 1, 3 + 2 * CAST(o_orderkey % 3 AS INTEGER)) AS d FROM orders),
ts AS (SELECT sample, list(d ORDER BY d) AS ts FROM names WHERE side = 0 GROUP BY sample), cs AS (SELECT sample, list(d ORDER BY d) AS cs FROM names WHERE side = 1 GROUP BY sample),
g AS (SELECT sample, n, coalesce(ts, []) AS ts, coalesce(cs, []) AS cs FROM (SELECT DISTINCT sample FROM names) LEFT JOIN ts USING (sample) LEFT JOIN cs USING (sample), n),
go AS (SELECT sample, n, ts, cs, 0 AS k, []::BIGINT[] AS used_t, []::BIGINT[] AS used_c FROM g UNION ALL
SELECT sample, n, ts, cs, k + 1, CASE WHEN j IS NULL THEN used_t ELSE list_append(used_t, i) END, CASE WHEN j IS NULL THEN used_c ELSE list_append(used_c, j) END FROM (SELECT *, CASE WHEN NOT list_contains(used_t, i) THEN list_filter(range(1, len(cs) + 1), lambda x: NOT list_contains(used_c, x) AND CASE k // len(ts) WHEN 0 THEN length(t) >= n AND length(cs[x]) >= n AND t[1:n] = cs[x][1:n] WHEN 1 THEN length(t) < n AND length(cs[x]) >= n AND starts_with(cs[x], t)
WHEN 2 THEN length(t) >= n AND length(cs[x]) < n AND starts_with(t, cs[x]) ELSE length(t) < n AND length(cs[x]) < n AND t = cs[x] END)[1] END AS j FROM (SELECT *, CAST(k % len(ts) + 1 AS BIGINT) AS i, ts[k % len(ts) + 1] AS t FROM go WHERE k < 4 * len(ts)))),
done AS (SELECT * FROM go WHERE k = 4 * len(ts))"""


@query(f"""{_GREEDY}, rows AS (SELECT n, unnest(list_transform(used_t, lambda i: ts[i])) AS truth, unnest(list_transform(used_c, lambda j: cs[j])) AS called FROM done
UNION ALL SELECT n, unnest(list_transform(list_filter(range(1, len(ts) + 1), lambda i: NOT list_contains(used_t, i)), lambda i: ts[i])), NULL FROM done UNION ALL SELECT n, NULL, unnest(list_transform(list_filter(range(1, len(cs) + 1), lambda j: NOT list_contains(used_c, j)), lambda j: cs[j])) FROM done)
SELECT n, truth, called, count(*) AS rows FROM rows GROUP BY ALL""")
def greedy_digits(t):
    o = F.col("o_orderkey")
    two = lambda k: F.concat(F.lit("0"), F.floor(o / k).cast("bigint") % 2 + 1)
    whole = F.concat(F.lit("00"), F.floor(o / 4).cast("bigint") % 3 + 1, two(16), two(32))
    names = t("orders").select(F.col("o_custkey").cast("string").alias("sample"), (o % 2).alias("side"), F.concat(F.lit("G*"), F.substring(whole, F.lit(1), (3 + 2 * (o % 3)).cast("int"))).alias("allele"))
    out = None
    for n in (3, 5, 7):
        found = evaluate.greedy_match(names.filter("side = 0"), names.filter("side = 1"), n)
        rows = found.groupBy(F.substring("truth", 3, 7).alias("truth"), F.substring("called", 3, 7).alias("called")).agg(F.count("*").alias("rows")).select(F.lit(n).alias("n"), "truth", "called", "rows")
        out = rows if out is None else out.union(rows)
    return out
