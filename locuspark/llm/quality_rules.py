"""Quality rules with host-level verdicts, in SQL functions only.

Every document is held to rules on its own text.  Failures of each rule are summed by host; hosts with few documents have
noisy rates, so each rate is shrunk by a beta prior whose mean and weight are fitted to all hosts' rates by the
method of moments.  A host is rejected where the posterior leaves little doubt that most of its documents fail some rule
(its rate less BOUND posterior standard deviations is above HOST_RATE), and its documents go with it; all others stay
unless they fail a base rule themselves.

Rows: null text has no words and fails; a null host is a host of its own, apart from the empty one; repeated rows
count as often as they occur; an empty table gives no rows; further columns are ignored.  Texts are read once and never
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.llm.native import SPACES, indexes, let, total, words
from locuspark.storage import written

# Fixed values of the base rules.
LEAST_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"

#: A host is rejected where a rule's failure rate is above this, at its posterior's lower bound of so many deviations.
HOST_RATE, BOUND = 0.5, 2.0
#: Shrinking moves a host's rate no further than so many standard errors of its own documents' rate.
DEVIATIONS = 3
#: Largest table of hosts that is broadcast (rows of about 40 bytes); beyond it, the join is dealt over SALTS.
BROADCAST_HOSTS = 200_000
SALTS = 16
#: The further rules that hosts are judged by, beside the base rules.
RULES = ("few_words", "repeats", "dup_lines")


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first included.

    Windows are compared by a 64-bit hash of their words; equal neighbours in sorted order are the repeats.
    """

    def covered(p: Column) -> Column:
        return total(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("bigint")))

    def repeats(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        marked = let(ordered, lambda s: F.transform(s, lambda e, k: F.when(same(F.get(s, k - 1), e) | same(F.get(s, k + 1), e), e["i"])))
        return let(F.sort_array(F.array_compact(marked)), covered)

    hashes = F.transform(indexes(F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(repeats(h)))


def measured(docs: DataFrame, keys: list[Column], text: str, host: Column) -> DataFrame:
    """keys, host and the text's figures: one row for each document, without its text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("bigint")
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    rows = docs.select(*keys, host.cast("string").alias("host"), of_words.alias("w"), lines.alias("l"), (F.length(t).cast("bigint") - without(SPACES)).alias("word_chars"), without(SYMBOLS).alias("n_symbols"))
    return rows.select(*[c for c in rows.columns if c not in ("w", "l")], "w.n_words", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines")


def failures() -> dict[str, Column]:
    """Each rule's failure, from the measured columns."""
    return {
        "few_words": F.col("n_words") < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def own_limits(failed: Column, documents: Column) -> tuple[Column, Column]:
    """Least and most rate that a host's own documents allow: Wilson's interval of DEVIATIONS standard errors."""
    z2 = float(DEVIATIONS * DEVIATIONS)
    middle = failed + z2 / 2
    width = DEVIATIONS * F.sqrt(failed * (documents - failed) / documents + z2 / 4)
    return (middle - width) / (documents + z2), (middle + width) / (documents + z2)


def host_rates(rows: DataFrame) -> DataFrame:
    """host, documents, and each rule's shrunk rate.  Failures are summed before they are shuffled.

    With rates of mean m and variance v over hosts, each host counting once in both, the prior's weight is
    m(1-m)/v' - 1, where v' is v less what sampling alone explains; it is 1 at least, and a host's rate becomes
    (failed + weight*m) / (documents + weight).  Where v' is hardly above 0 the weight exceeds any host's documents,
    so the rate is held within what the host's own documents allow (``own_limits``): the prior decides on hosts of
    few documents, and a large host by its own ones.
    """
    rules = failures()
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("documents"), *(F.count_if(c).alias(f"f_{r}") for r, c in rules.items())), "hosts")
    rate = {r: F.col(f"f_{r}") / F.col("documents") for r in RULES}
    prior = hosts.agg(
        F.avg(1 / F.col("documents")).alias("noise"),
        *(F.avg(rate[r]).alias(f"m_{r}") for r in RULES),
        *(F.var_pop(rate[r]).alias(f"v_{r}") for r in RULES),
    )
    out = hosts.crossJoin(F.broadcast(prior))  # one row

    def posterior(r: str) -> Column:
        m = F.col(f"m_{r}")
        spread = F.greatest(F.col(f"v_{r}") - m * (1 - m) * F.col("noise"), F.lit(1e-9))
        weight = F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(1.0)), F.lit(1e6))
        least, most = own_limits(F.col(f"f_{r}"), F.col("documents"))
        p = F.greatest(least, F.least(most, (F.col(f"f_{r}") + weight * m) / (F.col("documents") + weight)))
        return F.struct(p.alias("rate"), (p - BOUND * F.sqrt(p * (1 - p) / (F.col("documents") + weight + 1))).alias("least"))

    found = out.select("host", "documents", *(posterior(r).alias(r) for r in RULES))
    return found.select("host", "documents", *(c for r in RULES for c in (F.col(f"{r}.rate").alias(f"rate_{r}"), F.col(f"{r}.least").alias(f"least_{r}"))))


def verdicts(rows: DataFrame) -> DataFrame:
    """host, host_rejected, host_rate, host_least: the worst rule's posterior rate and lower bound."""
    rates = host_rates(rows)
    worst, least = (F.greatest(*(F.col(f"{x}_{r}") for r in RULES)) for x in ("rate", "least"))
    return written(rates.select("host", (least > HOST_RATE).alias("host_rejected"), F.round(worst, 6).alias("host_rate"), F.round(least, 6).alias("host_least")), "hosts-judged")


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: Column | None = None, keep: list[Column] | None = None, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Each document's figures, base_failed, host_rejected and kept."""
    rows = written(measured(docs, [F.col(doc_id).alias("doc_id"), *(keep or [])], text, F.col("source") if host is None else host), "quality")
    judged = verdicts(rows)
    if judged.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(judged.withColumnRenamed("host", "_host")), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    else:
        salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "_host").withColumnRenamed("salt", "_salt")
        salt = F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, F.col("host").eqNullSafe(F.col("_host")) & (F.col("salt") == F.col("_salt"))).drop("salt", "_salt", "_host")
    rules = failures()
    joined = joined.withColumn("base_failed", rules["few_words"] | rules["repeats"])
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def digest(judged: DataFrame) -> DataFrame:
    """The columns of the query."""
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rejected", "host_rate", "host_least")


def keep_good(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """docs without the rejected rows.

    Texts are measured once: rows that pass are written beside the figures of all, and read again when the hosts
    are judged.  Rejected hosts are broadcast after a count; beyond the bound they are dealt over SALTS.
    """
    rules = failures()
    passed = ~(rules["few_words"] | rules["repeats"])
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    rows = measured(docs, [whole], text, F.col("source"))
    rows = written(rows.withColumn("_row", F.when(passed, F.col("_row"))), "quality-rows")
    bad = written(verdicts(rows.drop("_row")).filter("host_rejected").select(F.col("host").alias("_host")), "hosts-rejected")
    kept = rows.filter("_row is not null").select("host", "_row")
    if bad.count() <= broadcast_hosts:
        kept = kept.join(F.broadcast(bad), F.col("host").eqNullSafe(F.col("_host")), "left_anti")
    else:
        spread = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")
        kept = kept.withColumn("_s", salt).join(spread, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_s") == F.col("_salt")), "left_anti")
    return kept.select("_row.*")
