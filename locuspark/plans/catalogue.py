"""Queries on the driver's tables, one for each operator of the library, with their DuckDB equivalents.

The tables stand in for the domain's: events for reads and depths, orders and customers for calls and alleles, line items
for long evidence, parts for the variant catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.functions import alleles, scalars
from locuspark.operators import copynumber, evaluate, search, series, sets, shapes
from locuspark.plans import engine, figures, files  # noqa: F401  they register their queries
from locuspark.plans.registry import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401
from locuspark.streaming import windows

# --- depth and aggregation ------------------------------------------------------------------------------------


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY event_type")
def depth_p75(t):
    return rounded(series.depth_statistics(t("events"), ["event_type"], "value"), "mean", "sd", "p25", "median", "p75")


@query("SELECT l_partkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean FROM lineitem GROUP BY l_partkey")
def depth_weighted(t):
    return rounded(series.weighted_mean(t("lineitem"), ["l_partkey"], F.col("l_extendedprice"), F.col("l_quantity")), "weighted_mean", digits=4)


@query("SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS share FROM events GROUP BY user_id, event_type")
def base_ratio(t):
    return rounded(series.category_share(t("events"), ["user_id"], "event_type"), "share", digits=9)


@query("SELECT o_orderpriority, " + ", ".join(f"CAST(trunc(coalesce(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 0)) AS INTEGER) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def cn_pivot(t):
    return sets.pivoted(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME measure VALUE amount")
def melt(t):
    return shapes.melted(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "l_discount"], "measure", "amount")


@query("SELECT *, round(total / max(CASE WHEN o_orderstatus = 'O' THEN total END) OVER (PARTITION BY o_custkey), 6) AS ratio FROM (SELECT o_custkey, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)")
def normalise_by_row(t):
    totals = t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rounded(series.normalised_by_category(totals, ["o_custkey"], "o_orderstatus", "O", "total"), "ratio")


@query("SELECT l_suppkey, l_returnflag, n FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS r FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1")
def mode_ties(t):
    return sets.modes(t("lineitem"), ["l_suppkey"], "l_returnflag")


@query("SELECT user_id, n_pos, n_neg, n_pos + n_neg >= 3 AND n_pos / (n_pos + n_neg) >= 0.2 AND n_pos > 0 AS keep_pos, n_pos + n_neg >= 3 AND n_neg / (n_pos + n_neg) >= 0.2 AND n_neg > 0 AS keep_neg FROM (SELECT user_id, event_type, count(*) FILTER (value > 20) AS n_pos, count(*) FILTER (NOT value > 20) AS n_neg FROM events GROUP BY ALL)")
def sign_correction(t):
    return sets.sign_support(t("events"), ["user_id", "event_type"], F.col("value") > 20).drop("event_type")


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '_') AS alleles, count(*) AS n FROM orders GROUP BY o_custkey")
def variant_group_concat(t):
    return shapes.joined_names(t("orders"), ["o_custkey"], "o_orderpriority", as_name="alleles")


@query("SELECT items, array_to_string(list_sort(list(m)), ',') AS members, count(*) AS n FROM (SELECT c_custkey AS m, coalesce(array_to_string(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderpriority IS NOT NULL))), '_'), '') AS items FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY items")
def identical_sets(t):
    orders = t("orders").select(F.col("o_custkey").alias("m"), "o_orderpriority")
    found = sets.identical_sets(orders, "m", "o_orderpriority", t("customer").select(F.col("c_custkey").alias("m")))
    return found.select(F.array_join("items", "_").alias("items"), F.array_join("members", ",").alias("members"), "n")


@query("""WITH c AS (SELECT l_suppkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 3),
s AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey, l_linenumber) AS t FROM c),
r AS (SELECT *, n / t AS share, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY n DESC, l_returnflag) AS r FROM s WHERE t >= 20 AND n / t > 0.1),
m AS (SELECT DISTINCT l_suppkey FROM r WHERE r = 2 AND share > 0.25)
SELECT DISTINCT l_suppkey, l_suppkey IN (SELECT l_suppkey FROM m) AS mixed FROM lineitem""")
def two_level_homozygous(t):
    return search.mixed_groups(t("lineitem"), ["l_suppkey"], "l_linenumber", "l_returnflag", 2)


@query("SELECT l_linenumber, round(sum(1 / q), 6) AS credit FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS q FROM (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) WHERE l_quantity = b) GROUP BY l_linenumber")
def tie_fraction(t):
    return rounded(sets.tie_fraction(t("lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity"), "credit")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('2-HIGH', '5-LOW')) = 2 AND count(*) FILTER (o_orderpriority = '1-URGENT') = 0")
def relational_division(t):
    o = t("orders").select("o_custkey", "o_orderpriority")
    pick = lambda *v: o.filter(F.col("o_orderpriority").isin(*v)).select("o_orderpriority")
    return sets.relational_division(o, "o_custkey", "o_orderpriority", pick("2-HIGH", "5-LOW"), pick("1-URGENT"))


# --- joins ----------------------------------------------------------------------------------------------------

_SPANS = "SELECT event_type, CAST(floor(quantile_cont(value, 0.25) * 10) AS INTEGER) AS first, CAST(floor(quantile_cont(value, 0.75) * 10) AS INTEGER) AS last FROM events GROUP BY event_type"
_POINTS = "SELECT event_id, event_type, CAST(floor(value * 10) AS INTEGER) AS pos FROM events"


def _spans(t) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.floor(F.percentile("value", 0.25) * 10).cast("int").alias("first"), F.floor(F.percentile("value", 0.75) * 10).cast("int").alias("last"))


def _points(t) -> DataFrame:
    return t("events").select("event_id", "event_type", F.floor(F.col("value") * 10).cast("int").alias("pos"))


@query(f"SELECT event_id, event_type, pos, first, last FROM ({_POINTS}) JOIN ({_SPANS}) USING (event_type) WHERE pos >= first AND pos < last")
def range_join(t):
    return sets.range_join(_points(t), _spans(t), ["event_type"], "pos", "first", "last")


@query(f"SELECT p.* FROM ({_POINTS}) p WHERE EXISTS (SELECT 1 FROM ({_SPANS}) s WHERE s.event_type = p.event_type AND pos >= first AND pos < last)")
def exon_range_filter(t):
    return sets.range_join(_points(t), _spans(t), ["event_type"], "pos", "first", "last", width=32, how="left_semi")


@query(f"SELECT p.* FROM ({_POINTS}) p WHERE NOT EXISTS (SELECT 1 FROM ({_SPANS}) s WHERE s.event_type = p.event_type AND pos >= first AND pos < last)")
def pos_bin_join(t):
    return sets.range_join(_points(t), _spans(t), ["event_type"], "pos", "first", "last", width=64, how="left_anti")


@query("""WITH r AS (SELECT user_id, event_id AS line, event_id % 50 AS pos, (event_id * 7 + 1) % 50 AS mate_pos, CAST(CASE WHEN event_id % 2 = 0 THEN 66 ELSE 130 END + CASE WHEN event_id % 5 = 0 THEN 256 ELSE 0 END AS INTEGER) AS flag FROM events),
b AS (SELECT l.user_id, l.line AS left_line, e.line AS right_line FROM r l JOIN r e ON l.user_id = e.user_id AND (l.flag & 256) = (e.flag & 256) AND l.mate_pos = e.pos AND e.line < l.line AND ((l.flag | e.flag) & 192) = 192),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, left_line ORDER BY right_line DESC) AS r FROM b)
SELECT user_id, left_line, right_line FROM (SELECT *, row_number() OVER (PARTITION BY user_id, right_line ORDER BY left_line) AS q FROM c WHERE r = 1) WHERE q = 1""")
def read_pairing(t):
    e = F.col("event_id")
    flag = (F.when(e % 2 == 0, 66).otherwise(130) + F.when(e % 5 == 0, 256).otherwise(0)).cast("int")
    rows = t("events").select("user_id", e.alias("line"), (e % 50).alias("pos"), ((e * 7 + 1) % 50).alias("mate_pos"), flag.alias("flag"))
    pairs = sets.pair_records(rows, ["user_id"], "line", "pos", "mate_pos", "flag")
    return pairs.select("user_id", F.col("left.line").alias("left_line"), F.col("right.line").alias("right_line"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey & 2) <> 0 AND (l_orderkey & 1024) = 0")
def flag_filter(t):
    f = F.col("l_orderkey")
    return t("lineitem").filter(scalars.has_flag(f, scalars.PROPER) & ~scalars.has_flag(f, scalars.DUPLICATE)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH k AS (SELECT p_partkey, 'hv' || p_partkey AS id FROM part WHERE p_size > 25),
l AS (SELECT DISTINCT l_partkey FROM lineitem), n AS (SELECT l_partkey, 'nv' || (row_number() OVER (ORDER BY l_partkey) - 1) AS id FROM l WHERE l_partkey NOT IN (SELECT p_partkey FROM k))
SELECT l_partkey AS p_partkey, coalesce(k.id, n.id) AS id FROM l LEFT JOIN k ON l_partkey = p_partkey LEFT JOIN n USING (l_partkey)""")
def catalogue_lookup(t):
    known = t("part").filter("p_size > 25").select("p_partkey", F.concat(F.lit("hv"), "p_partkey").alias("id"))
    return sets.novel_ids(t("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct(), known, ["p_partkey"])


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(f"""WITH e AS (SELECT user_id, {_K} AS k FROM events), s AS (SELECT user_id, min(k) AS first, max(k) AS last FROM e GROUP BY user_id), c AS (SELECT DISTINCT k FROM e)
SELECT user_id, c.k FROM s JOIN c ON c.k >= first AND c.k < last WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.k = c.k)""")
def negatives_antijoin(t):
    e = t("events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    spans = e.groupBy("user_id").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    inside = sets.range_join(e.select("k").distinct(), spans, [], "k", "first", "last", width=16)
    return inside.select("user_id", "k").join(e, ["user_id", "k"], "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n_nationkey = c_nationkey AND n_regionkey = 2)")
def exclusion_filter(t):
    out = t("nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return evaluate.excluded(t("customer"), out, ["c_nationkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT coalesce(o_custkey, c_custkey) AS k, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) FULL JOIN (SELECT c_custkey, CAST(floor(c_acctbal / 1000) AS BIGINT) AS b FROM customer) ON o_custkey = c_custkey WHERE coalesce(n, 0) <> 0 OR coalesce(b, 0) <> 0")
def full_outer_counts(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    c = t("customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_acctbal") / 1000).alias("b"))
    return shapes.outer_counts(o, c, ["k"], ["n", "b"])


# --- search ---------------------------------------------------------------------------------------------------

_MISS = "SELECT u.user_id, a.event_type AS allele, u.n - coalesce(c.n, 0) AS k FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u CROSS JOIN (SELECT DISTINCT event_type FROM events) a LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) c ON c.user_id = u.user_id AND c.event_type = a.event_type"


def _mismatches(t) -> DataFrame:
    e = t("events").select(F.lit("g").alias("gene"), F.col("user_id").alias("read"), F.col("event_type").alias("variant"), F.lit(True).alias("sign"))
    names = e.select("gene", "variant").distinct().withColumn("allele", F.col("variant"))
    return search.mismatches(e, names, names.select("gene", "allele"))


@query(f"SELECT CAST(rank AS INTEGER) AS rank, allele, cost FROM (SELECT allele, CAST(sum(k) AS BIGINT) AS cost, row_number() OVER (ORDER BY sum(k), allele) AS rank FROM ({_MISS}) GROUP BY allele) WHERE rank <= 600")
def beam_cn1(t):
    return search.beam_one(_mismatches(t), 600).drop("gene")


_PAIRS = f"""SELECT *, row_number() OVER (ORDER BY cost, own, round(abs(share_a - share_b), 12), a, b) AS rank FROM (SELECT x.allele AS a, y.allele AS b, CAST(sum(least(x.k, y.k)) AS BIGINT) AS cost, CAST(sum(x.k + y.k) AS BIGINT) AS own,
round(avg(CASE WHEN x.k < y.k THEN 1 WHEN x.k = y.k THEN 0.5 ELSE 0 END), 12) AS share_a, round(1 - round(avg(CASE WHEN x.k < y.k THEN 1 WHEN x.k = y.k THEN 0.5 ELSE 0 END), 12), 12) AS share_b FROM ({_MISS}) x JOIN ({_MISS}) y ON x.user_id = y.user_id AND x.allele <= y.allele GROUP BY ALL)"""


@query(f"SELECT CAST(rank AS INTEGER) AS rank, a, b, cost, own, round(share_a, 9) AS share_a, round(share_b, 9) AS share_b FROM ({_PAIRS})")
def beam_cn2(t):
    return rounded(search.beam_two(_mismatches(t), 600).drop("gene"), "share_a", "share_b", digits=9)


@query(f"SELECT CAST(rank AS INTEGER) AS rank, a, b, cost FROM ({_PAIRS}) ORDER BY CASE WHEN least(share_a, share_b) >= 0.25 THEN 0 ELSE 1 END, rank LIMIT 1")
def select_best(t):
    return search.select_best(search.beam_two(_mismatches(t), 600), 0.25).select("rank", "a", "b", "cost")


_EM = "WITH m AS (SELECT DISTINCT o_custkey AS r, o_orderpriority AS a FROM orders), p0 AS (SELECT a, 1.0::DOUBLE / count(*) OVER () AS p FROM (SELECT DISTINCT a FROM m))" + "".join(
    f", s{i} AS (SELECT a, sum(w) AS s FROM (SELECT m.a, p / sum(p) OVER (PARTITION BY r) AS w FROM m JOIN p{i} USING (a)) GROUP BY a), p{i + 1} AS (SELECT a, s / sum(s) OVER () AS p FROM s{i})" for i in range(3)
)


@query(f"{_EM} SELECT a, round(p, 9) AS p FROM p3")
def em_step(t):
    members = t("orders").select(F.col("o_custkey").alias("r"), F.col("o_orderpriority").alias("a"))
    return rounded(search.em_steps(members, "r", "a", 3), "p", digits=9)


@query("""WITH i AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
SELECT a.s_nationkey, a.s_suppkey || '_' || b.s_suppkey AS items FROM i a JOIN i b ON a.s_nationkey = b.s_nationkey AND a.i <= b.i""")
def combos_with_replacement(t):
    out = sets.combinations_with_replacement(t("supplier"), ["s_nationkey"], "s_suppkey", 2)
    return out.select("s_nationkey", F.array_join(F.transform("items", lambda x: x.cast("string")), "_").alias("items"))


# --- copy numbers ---------------------------------------------------------------------------------------------

_DEPTHS = "SELECT user_id, quantile_cont(value, 0.75) AS depth FROM events GROUP BY user_id"
_PEAKS = lambda x, base, dev: ", ".join(f"exp(-0.5 * pow(({x} - {base} * {c}) / ({dev} * {s}), 2)) / ({dev} * {s} * sqrt(2 * pi()))" for c, s in [(0, 1.6), (1, 1.3), *((n, 0.5 * (n - 2) + 1) for n in range(2, 7))])
_FIT = f"""WITH d AS ({_DEPTHS}), x AS (SELECT greatest(max(depth) * 1.2, 1e-6) AS x_max FROM d),
b AS (SELECT least(CAST(floor(depth * 100 / x_max) AS INTEGER), 99) AS bin, x_max, count(*) AS w FROM d, x GROUP BY ALL),
g AS (SELECT b.*, g, x_max * g / 99 AS base FROM b, generate_series(0, 99) t(g)),
l AS (SELECT g, base, x_max, sum(w * ln(greatest({_PEAKS("(x_max * bin / 99)", "base", "(x_max * 0.08)")}) * x_max / 100 + 1e-9)) AS ll FROM g GROUP BY ALL),
f AS (SELECT base, x_max, ll FROM l ORDER BY round(ll, 9) DESC, g LIMIT 1)"""
_SETTING = copynumber.Lcnd(bins=100)


def _depths(t) -> DataFrame:
    return series.group_depth(t("events"), ["user_id"], "value", "p75")


@query(f"{_FIT} SELECT round(base, 6) AS base, round(x_max, 6) AS x_max, round(ll, 4) AS log_likelihood FROM f")
def lcnd_fit(t):
    out = copynumber.fit(_depths(t), [], "depth", _SETTING)
    return out.select(F.round("base", 6).alias("base"), F.round("x_max", 6).alias("x_max"), F.round("log_likelihood", 4).alias("log_likelihood"))


@query(f"{_FIT}, p AS (SELECT user_id, depth, [{_PEAKS('(x_max * least(floor(depth / (x_max / 100)), 99) / 99)', 'base', '(x_max * 0.08)')}] AS p FROM d, f) SELECT user_id, round(depth, 6) AS depth, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS cn FROM p")
def lcnd_assign(t):
    depths = _depths(t)
    return rounded(copynumber.assign(depths, copynumber.fit(depths, [], "depth", _SETTING), [], "depth", _SETTING), "depth")


_KDE = f"WITH d AS ({_DEPTHS}), v AS (SELECT user_id, depth, depth / max(depth) OVER () AS v FROM d), k AS (SELECT i, 1.1::DOUBLE * i / 99 AS x, ln(avg(exp(-0.5 * pow((1.1::DOUBLE * i / 99 - v) / 0.05, 2)) / (0.05 * sqrt(2 * pi())))) AS log_density FROM v, generate_series(0, 99) t(i) GROUP BY i)"
_MINIMA = ", m AS (SELECT i, x FROM (SELECT *, min(log_density) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, min(log_density) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b FROM k) WHERE log_density < a AND log_density < b)"


@query(f"{_KDE} SELECT CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(log_density, 4) AS log_density FROM k")
def kde_grid(t):
    return rounded(rounded(copynumber.kde_grid(_depths(t), []), "x"), "log_density", digits=4)


@query(f"{_KDE}{_MINIMA} SELECT user_id, CAST((SELECT count(*) FROM m WHERE x < v) AS INTEGER) AS cn FROM v")
def kde_minima(t):
    return copynumber.kde_cut(_depths(t), []).select("user_id", F.col("cn").cast("int").alias("cn"))


@query("SELECT p_partkey, p_size, CASE WHEN p_size > 0 AND p_size <= 10 THEN 1 WHEN p_size > 10 AND p_size <= 20 THEN 2 WHEN p_size > 20 AND p_size <= 35 THEN 3 ELSE 0 END AS cn FROM part")
def cut_bins(t):
    return copynumber.bins_by_threshold(t("part").select("p_partkey", "p_size"), "p_size", [0, 10, 20, 35])


@query("SELECT width_bin AS bin, count(*) AS n FROM (SELECT least(CAST(floor(value * 50 / m) AS INTEGER), 49) AS width_bin FROM events, (SELECT max(value) AS m FROM events) WHERE value >= 0) GROUP BY width_bin")
def histogram(t):
    e = t("events").select("value")
    top = e.agg(F.max("value").alias("m"))
    b = e.crossJoin(F.broadcast(top)).select(scalars.equal_width_bin(F.col("value"), 50, F.col("m")).alias("bin"))  # one row
    return b.filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


# --- windows --------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT *, min(n) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, min(n) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b FROM d) WHERE n < a AND n < b""")
def local_minima(t):
    daily = t("lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    return series.local_minima(daily, ["l_returnflag"], "day", "n", 5).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(f"""WITH e AS (SELECT user_id, event_id, {_SECONDS} AS s, value FROM events),
o AS (SELECT *, CASE WHEN s - lag(s) OVER w >= 21600 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s, event_id) AS island FROM o)
SELECT user_id, first, last, length, round(total / length, 6) AS mean_depth FROM (SELECT user_id, island, min(s) AS first, max(s) AS last, max(s) - min(s) AS length, sum(value) AS total FROM i GROUP BY ALL) WHERE length >= 20000 AND total / length >= 0.001""")
def islands(t):
    e = t("events").select("user_id", "event_id", _seconds().alias("s"), "value")
    return rounded(series.significant_regions(e, ["user_id"], "s", "value", min_depth=0.001, min_length=20000, max_gap=21600), "mean_depth")


def _seconds():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


@query("""WITH r AS (SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) - DATE '1990-01-01' AS INTEGER) - 2 AS a, CAST(CAST(l_shipdate AS DATE) - DATE '1990-01-01' + l_linenumber AS INTEGER) + 2 AS b FROM lineitem),
o AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY l_suppkey ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS o FROM r),
g AS (SELECT *, sum(o) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT l_suppkey, min(a) AS start, max(b) AS "end" FROM g GROUP BY l_suppkey, g""")
def interval_merge(t):
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    rows = t("lineitem").select("l_suppkey", day.alias("a"), (day + F.col("l_linenumber")).alias("b"))
    return series.merged_intervals(rows, ["l_suppkey"], "a", "b", flank=2)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM lineitem")
def cumulative_offset(t):
    out = series.cumulative_offsets(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("offset").cast("double").alias("offset"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS smooth FROM events")
def moving_average(t):
    return rounded(series.moving_average(t("events"), ["user_id"], "event_id", "value", 7), "smooth").select("user_id", "event_id", "smooth")


@query("""WITH a AS (SELECT s_nationkey, s_acctbal AS r, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS n FROM supplier),
b AS (SELECT s_nationkey, CAST(s_suppkey % 5 AS BIGINT) AS l, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 5) AS n FROM supplier),
j AS (SELECT s_nationkey, r, l, lag(r) OVER w AS pr, lag(l) OVER w AS pl, lead(l) OVER w AS nl FROM a JOIN b USING (s_nationkey, n) WINDOW w AS (PARTITION BY s_nationkey ORDER BY n))
SELECT s_nationkey, unnest(generate_series(pl, l - 1)) AS level, round((r + pr) / 2, 6) AS threshold FROM j WHERE l > pl UNION ALL SELECT s_nationkey, l, round(r + 0.5, 6) FROM j WHERE nl IS NULL""")
def step_thresholds(t):
    s = t("supplier").withColumn("lv", F.col("s_suppkey") % 5)
    return rounded(series.step_thresholds(s, ["s_nationkey"], "s_acctbal", "lv"), "threshold")


@query(f"""WITH e AS (SELECT user_id, CAST(floor({_SECONDS} / 3600) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, min(h) AS a, max(h) AS b FROM e GROUP BY user_id),
p AS (SELECT user_id, unnest(generate_series(a, b)) AS h FROM s) SELECT p.user_id, p.h, coalesce(n, 0) AS n FROM p LEFT JOIN e ON p.user_id = e.user_id AND p.h = e.h""")
def gap_fill_spine(t):
    hour = F.floor(_seconds() / 3600)
    e = t("events").groupBy("user_id", hour.alias("h")).agg(F.count("*").alias("n"))
    return series.dense(e, ["user_id"], "h", "n", e.groupBy("user_id").agg(F.min("h").alias("first"), F.max("h").alias("last")))


@query("""WITH m AS (SELECT l_partkey, unnest([l_linenumber * 10 + l_quantity::INTEGER, l_linenumber * 10 + l_quantity::INTEGER + 20]) AS edge, unnest([1, -1]) AS d FROM lineitem),
g AS (SELECT l_partkey, edge, sum(d) AS d FROM m GROUP BY ALL), r AS (SELECT l_partkey, edge, sum(d) OVER w AS depth, lead(edge) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY l_partkey ORDER BY edge))
SELECT l_partkey, CAST(unnest(generate_series(edge, nxt - 1)) AS INTEGER) AS pos, CAST(depth AS BIGINT) AS depth FROM r WHERE depth > 0""")
def coverage(t):
    first = F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")
    rows = t("lineitem").select("l_partkey", first.alias("first"), (first + 19).alias("last"))
    return series.coverage(rows, ["l_partkey"], "first", "last")


@query("SELECT l_suppkey, l_returnflag, min(d) AS first, count(*) AS length FROM (SELECT *, d - row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY d) AS g FROM (SELECT DISTINCT l_suppkey, l_returnflag, CAST(CAST(l_shipdate AS DATE) - DATE '1990-01-01' AS INTEGER) AS d FROM lineitem)) GROUP BY l_suppkey, l_returnflag, g")
def adjacent_runs(t):
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).alias("d")
    return series.runs(t("lineitem").select("l_suppkey", "l_returnflag", day), ["l_suppkey"], "d", ["l_returnflag"])


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS head FROM events")
def carried_header(t):
    e = t("events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("head"))
    return series.carried_header(e, ["user_id"], "event_id", "head")


@query("SELECT src, dst, count(*) AS weight FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL")
def support_edges(t):
    return sets.support_edges(t("events"), ["user_id"], "event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, count(*) AS n FROM i GROUP BY user_id, g""")
def session_window(t):
    out = windows.sessions(t("events"), "ts", "user_id", "6 hours")
    return out.select("user_id", F.floor(F.unix_micros("first") / 1_000_000).alias("first"), "n")


# --- evaluation -----------------------------------------------------------------------------------------------

_T = "SELECT o_custkey AS sample, o_orderstatus AS gene, o_orderpriority || '.' || o_orderstatus AS allele, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderpriority) AS i FROM orders WHERE o_orderdate < '1998-01-01'"
_C = _T.replace("o_orderdate < '1998-01-01'", "o_orderdate >= '1996-01-01'")


def _tier_sql() -> str:
    parts, t, c, out = [f"t0 AS ({_T})", f"c0 AS ({_C})"], "t0", "c0", []
    for k, (name, f) in enumerate((("MATCH7", "allele"), ("MATCH5", "left(allele, 5)"), ("MATCH3", "left(allele, 3)"), ("GENE", "''"))):
        num = lambda x: f"(SELECT *, {f} AS f, row_number() OVER (PARTITION BY sample, gene, {f} ORDER BY allele, i) AS n FROM {x})"  # noqa: B023, E731
        parts.append(f"h{k} AS (SELECT a.sample, a.gene, a.allele AS truth, b.allele AS called, a.i AS ti, b.i AS ci FROM {num(t)} a JOIN {num(c)} b ON a.sample = b.sample AND a.gene = b.gene AND a.f = b.f AND a.n = b.n)")
        parts.append(f"t{k + 1} AS (SELECT * FROM {t} x WHERE NOT EXISTS (SELECT 1 FROM h{k} h WHERE h.sample = x.sample AND h.gene = x.gene AND h.ti = x.i))")
        parts.append(f"c{k + 1} AS (SELECT * FROM {c} x WHERE NOT EXISTS (SELECT 1 FROM h{k} h WHERE h.sample = x.sample AND h.gene = x.gene AND h.ci = x.i))")
        out.append(f"SELECT sample, gene, '{name}' AS match, truth, called FROM h{k}")
        t, c = f"t{k + 1}", f"c{k + 1}"
    out += [f"SELECT sample, gene, 'FN', allele, NULL FROM {t}", f"SELECT sample, gene, 'FP', NULL, allele FROM {c}"]
    return f"WITH {', '.join(parts)}, matches AS ({' UNION ALL '.join(out)})"


def _matches(t) -> DataFrame:
    o = t("orders").withColumn("allele", F.concat("o_orderpriority", F.lit("."), "o_orderstatus")).withColumn("sample", F.col("o_custkey"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")
    field = lambda a, n: {7: a, 5: F.substring(a, 1, 5), 3: F.substring(a, 1, 3)}[n]
    return evaluate.tier_match(o.filter(F.col("o_orderdate") < cut[0]), o.filter(F.col("o_orderdate") >= cut[1]), field=field, gene=lambda a: F.substring(a, -1, 1))


@query(f"{_tier_sql()} SELECT * FROM matches")
def tier_match(t):
    return _matches(t)


@query(f"""{_tier_sql()}, r AS (SELECT 'm' AS method, gene, count(truth) AS total, count(*) FILTER (match = 'FP') AS fp, count(*) FILTER (match = 'MATCH7') AS r7, count(*) FILTER (match IN ('MATCH7', 'MATCH5')) AS r5, count(*) FILTER (match IN ('MATCH7', 'MATCH5', 'MATCH3')) AS r3, count(*) FILTER (match NOT IN ('FN', 'FP')) AS r0 FROM matches GROUP BY ROLLUP (gene))
SELECT method, gene, total, fp, round(r7 / total, 6) AS accuracy7, round(r5 / total, 6) AS accuracy5, round(r3 / total, 6) AS accuracy3, round(r0 / total, 6) AS accuracy0, total - r0 AS fn FROM r""")
def resolution_rollup(t):
    return rounded(evaluate.resolution_accuracy(_matches(t).withColumn("method", F.lit("m"))), *(f"accuracy{n}" for n in (7, 5, 3, 0)))


_CN = "SELECT sample, gene, coalesce(t, 0) AS truth, coalesce(c, 0) AS called, coalesce(c, 0) - coalesce(t, 0) AS diff FROM (SELECT o_custkey AS sample, o_orderpriority AS gene, count(*) AS t FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) FULL JOIN (SELECT o_custkey AS sample, o_orderpriority AS gene, count(*) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) USING (sample, gene)"


def _compared(t) -> DataFrame:
    side = lambda s: t("orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("gene")).agg(F.count("*").alias("cn"))
    return evaluate.compare_copies(side("O"), side("F"), ["sample"])


@query(_CN)
def cn_compare(t):
    return _compared(t)


@query(f"SELECT method, gene, sample, CAST(sum(truth) AS BIGINT) AS total, CAST(sum(abs(diff)) AS BIGINT) AS wrong, round(CASE WHEN sum(truth) <> 0 THEN 1 - sum(abs(diff)) / sum(truth) END, 6) AS accuracy FROM (SELECT *, 'm' AS method FROM ({_CN})) GROUP BY GROUPING SETS ((method, gene), (method, sample), (method))")
def grouping_levels(t):
    return rounded(evaluate.copies_accuracy(_compared(t).withColumn("method", F.lit("m"))), "accuracy")


@query("SELECT l_returnflag AS src, l_linestatus AS dst, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 9) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")
def confusion_share(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("dst"))
    return rounded(evaluate.from_to(rows, "src", "dst"), "share", digits=9)


@query("SELECT o_orderpriority AS g, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS tp, count(*) FILTER (o_orderstatus = 'F') AS fp, count(*) FILTER (o_orderstatus = 'P') AS fn FROM orders GROUP BY ALL)")
def precision_recall(t):
    kind = F.when(F.col("o_orderstatus") == "O", "TP").when(F.col("o_orderstatus") == "F", "FP").otherwise("FN")
    rows = t("orders").select(F.col("o_orderpriority").alias("g"), kind.alias("match"), F.when(F.col("o_orderstatus") != "F", F.lit("x")).alias("truth"))
    return rounded(evaluate.precision_recall(rows, ["g"]), "precision", "recall", "f1")


# --- scalars, shapes, sorts -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS half, round_even(l_discount * 50, 0) AS copies FROM lineitem")
def half_even(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.half_even(F.col("l_quantity") / 2).alias("half"), scalars.half_even(F.col("l_discount") * 50).alias("copies"))


@query("""SELECT a, split_part(a, '*', 1) AS gene, regexp_extract(a, '^\\w+\\*(\\d+\\w*)', 1) AS f7, left(regexp_extract(a, '^\\w+\\*(\\d+\\w*)', 1), 5) AS f5, left(regexp_extract(a, '^\\w+\\*(\\d+\\w*)', 1), 3) AS f3, split_part(a, '*', 1) || '*' || left(regexp_extract(a, '^\\w+\\*(\\d+\\w*)', 1), 3) AS limited3
FROM (SELECT replace(c_name, '#', '*') || CASE WHEN c_custkey % 7 = 0 THEN 'N' ELSE '' END AS a FROM customer)""")
def allele_fields(t):
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit("*")), F.when(F.col("c_custkey") % 7 == 0, "N").otherwise(""))
    a = F.col("a")
    return t("customer").select(name.alias("a")).select(a, alleles.gene_name(a).alias("gene"), *(alleles.allele_field(a, n).alias(f"f{n}") for n in (7, 5, 3)), alleles.limited(a, 3).alias("limited3"))


@query(f"SELECT event_type, count(*) AS n, round(avg({_K}), 6) AS mean_k FROM events GROUP BY event_type")
def json_ratio(t):
    return rounded(shapes.nested_mean(t("events"), ["event_type"], "props", "$.k", "int").withColumnRenamed("mean", "mean_k"), "mean_k")


@query("SELECT p_type, pos, base, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_type, pos), 9) AS freq FROM (SELECT p_type, CAST(unnest(range(length(p_name))) AS INTEGER) AS pos, unnest(string_split(p_name, '')) AS base FROM part) GROUP BY p_type, pos, base")
def column_freq(t):
    return rounded(sets.column_frequencies(t("part"), ["p_type"], F.col("p_name")), "freq", digits=9)


@query("""WITH c AS (SELECT p_type, unnest(range(length(p_name))) AS pos, unnest(string_split(p_name, '')) AS base FROM part), n AS (SELECT p_type, pos, base, row_number() OVER (PARTITION BY p_type, pos ORDER BY count(*) DESC, base) AS r FROM c GROUP BY p_type, pos, base)
SELECT p_type, string_agg(base, '' ORDER BY pos) AS consensus FROM n WHERE r = 1 GROUP BY p_type""")
def consensus(t):
    return sets.consensus(t("part"), ["p_type"], F.col("p_name"))


@query("SELECT c_nationkey, CAST(rank AS INTEGER) AS rank, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 10")
def topk_report(t):
    return sets.top(t("customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 10).select("c_nationkey", "rank", "c_custkey", "c_acctbal")


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC NULLS LAST, s_suppkey")
def order_by_mixed(t):
    return shapes.sorted_by(t("supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), F.col("s_nationkey"), F.desc_nulls_last("s_acctbal"), F.col("s_suppkey"))


@query("""SELECT 'except' AS kind, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'union', k FROM (SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier)""")
def set_ops(t):
    k = lambda name, c: t(name).select(F.col(c).cast("bigint").alias("k"))
    status = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    out = {"except": shapes.set_operations(k("customer", "c_custkey"), k("orders", "o_custkey"))["except"], "intersect": shapes.set_operations(status("O"), status("F"))["intersect"], "union": shapes.set_operations(k("customer", "c_nationkey"), k("supplier", "s_nationkey"))["union"]}
    parts = [df.select(F.lit(name).alias("kind"), "k") for name, df in out.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT s_suppkey, reverse(translate(s_name, 'ACGTacgt', 'TGCAtgca')) AS back, left(s_name, 3) || 'T' || substr(s_name, 5) AS changed FROM supplier")
def sequence_scalars(t):
    return t("supplier").select("s_suppkey", scalars.reverse_complement(F.col("s_name")).alias("back"), scalars.substituted(F.col("s_name"), F.lit(3), F.lit("T")).alias("changed"))


@query("SELECT l_partkey, l_suppkey, d FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY d) AS r FROM (SELECT DISTINCT l_partkey, l_suppkey, abs(l_quantity - 25) AS d FROM lineitem)) WHERE r = 1")
def nearest_ties(t):
    rows = t("lineitem").select("l_partkey", "l_suppkey", F.abs(F.col("l_quantity") - 25).alias("d")).distinct()
    return sets.nearest_with_ties(rows, ["l_partkey"], "d")


@query("""WITH d AS (SELECT row_number() OVER () AS rid, lang, text FROM documents), w AS (SELECT lang, unnest(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS word FROM d)
SELECT lang, word, count(*) AS n FROM w GROUP BY ALL""")
def token_counts(t):
    return shapes.word_counts(t("documents"), ["lang"], "text", r"[\x20\x09-\x0D]+")
