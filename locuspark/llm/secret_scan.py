"""Secret scan with corpus-wide ownership frequency, in SQL functions only.

Each text is scanned for labelled secrets, access keys and long hexadecimal strings (the base), and for bare
tokens that look like credentials.  Every candidate's hash is counted over distinct repositories and owners in
the whole corpus.  A value that several owners hold, or that lies in many repositories, is a widely copied example; a
value of a single owner, in few repositories, that looks random is likely to be live.  Bare tokens of the second sort
become spans of kind ``live``; the base stays.

Rows: null text is empty; a null owner or repository is one of its own, apart from the empty one; repeated rows are
scanned as often as they occur, and count once for their owner and repository; an empty table gives no rows; further
columns are ignored.  Texts are read once and never shuffled: only spans and hashes are.  Time is linear in a text,
and n log n in its spans but for sums over blocks of 64 of them, whose number counts by its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.llm.native import cutter, join_hot, let, matches, prefix
from locuspark.storage import written

# The base patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "live")

#: Bare tokens: so many characters, letters and digits among them, and so many different characters.
BARE = r"[A-Za-z0-9+/_=-]{16,}"
BARE_DIFFERENT = 8
#: From so many owners or repositories on, a value counts as a widely copied example.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 6
#: A live value has one owner and at most so many repositories; in more, it is the owner's own example.
LIVE_REPOSITORIES = 2
#: A value with more candidates than this is dealt over several tasks when it meets its counts.
HOT_VALUE = 1_000_000

#: Largest table of documents with added spans that is broadcast, in rows of about 200 bytes.
BROADCAST_ROWS = 100_000

SPAN = "struct<start:bigint,kind:int,end:bigint,hash:string>"
CLASSED = "struct<start:bigint,kind:int,end:bigint,class:string>"


def base_spans(text: Column) -> Column:
    """array<SPAN> of the base, by start, then kind."""
    span = lambda kind, value: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.sha2(value(m), 256).alias("hash"))
    value = lambda m: F.regexp_extract(m["found"], ASSIGN, 2)
    found = lambda m: m["found"]
    assign = F.transform(F.filter(matches(text, ASSIGN), lambda m: F.length(value(m)) >= ASSIGN_LEAST), span(0, value))
    access = F.transform(F.filter(matches(text, ACCESS), lambda m: F.length(m["found"]) >= ACCESS_LEAST), span(1, found))
    # A run of hexadecimal digits is matched whole, so shorter runs can be left out by the pattern itself.
    hexes = F.transform(matches(text, HEX.replace("+", f"{{{HEX_LEAST},}}")), span(2, found))
    return F.sort_array(F.concat(assign, access, hexes))


def bare_spans(text: Column, base: Column) -> Column:
    """array<SPAN> of tokens that look random and lie outside the base spans."""
    looks = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= BARE_DIFFERENT)
    found = F.filter(matches(text, BARE), lambda m: looks(m["found"]))
    span = lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end"), F.sha2(m["found"], 256).alias("hash"))
    return let(found, lambda f: F.when(F.size(f) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(F.transform(_apart(f, base), span)))


def _apart(found: Column, base: Column) -> Column:
    """The matches that no base span overlaps, from both in one order: what ends last before each, and what starts first behind it."""
    none, far = F.lit(-1).cast("bigint"), F.lit(1 << 62)
    both = F.sort_array(F.concat(F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"))), F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("found")))))

    def over(s: Column) -> Column:
        ends = prefix(F.transform(s, lambda x: F.when(x["found"].isNull(), x["end"]).otherwise(none)), none, lambda a, b: F.greatest(a, b))
        starts = prefix(F.transform(F.reverse(s), lambda x: F.when(x["found"].isNull(), x["start"]).otherwise(far)), far, lambda a, b: F.least(a, b))
        free = lambda e, t: F.transform(s, lambda x, i: F.when(x["found"].isNotNull() & (F.get(e, i) <= x["start"]) & (F.get(t, F.size(s) - 1 - i) >= x["end"]), x))
        return F.array_compact(let(ends, lambda e: let(starts, lambda t: free(e, t))))

    return let(both, over)


def _named(name: Column) -> Column:
    """A name that tells null from the empty one."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def repository_of(owner: Column, name: Column) -> Column:
    """One name for an owner's repository; no two pairs share it, whatever they hold, null or not."""
    own = owner.cast("string")
    return F.concat(F.coalesce(F.concat(F.length(own).cast("string"), F.lit(":"), own), F.lit("-")), _named(name))


def extracted(docs: DataFrame, keys: list[Column], text: str, owner: Column, repository: Column) -> DataFrame:
    """keys, owner, repository, base, bare: one row for each document, without its text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keys, _named(owner).alias("owner"), _named(repository).alias("repository"), let(t, lambda x: let(base_spans(x), lambda b: F.struct(b.alias("base"), bare_spans(x, b).alias("bare")))).alias("found"))
    return rows.select("*", "found.base", "found.bare").drop("found")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, owners, repositories, copies: counts of distinct ones, aggregated step by step so that a hot value has few rows."""
    pairs = written(candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")), "secrets-pairs")
    by_owner = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("copies"))
    repositories = pairs.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return by_owner.join(repositories, "hash")


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None, keep: list[Column] | None = None, hot: int = HOT_VALUE) -> DataFrame:
    """One row for each document: doc_id, base and added spans, and counts by ownership.

    base, added: array<struct<start, kind, end, hash>>.  n_wide: candidates that WIDE_OWNERS owners or WIDE_REPOSITORIES
    repositories hold at least; n_single: those of a single owner; most_owners, most_repositories: of any candidate.
    classed: array<struct<start, kind, end, class>> of base and added spans: wide, live, single (one owner, but in more
    repositories than a live value has) or shared.
    A repository belongs to its owner, unless named otherwise ``source``, and ``lang`` within it.  keep adds columns from docs.
    """
    owner = F.col("source") if owner is None else owner
    repository = repository_of(owner, F.col("lang")) if repository is None else repository
    keys = [F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), *(keep or [])]
    rows = written(extracted(docs, keys, text, owner, repository), "secrets")
    having = rows.filter((F.size("base") > 0) | (F.size("bare") > 0))
    candidates = having.select("row", "owner", "repository", F.inline(F.concat("base", "bare")))
    stats = written(ownership(candidates), "secrets-owners")
    judged = join_hot(candidates.select("row", "start", "kind", "end", "hash"), stats, ["hash"], "copies", "row", most=hot)
    live = (F.col("owners") == 1) & (F.col("repositories") <= LIVE_REPOSITORIES)
    wide = (F.col("owners") >= WIDE_OWNERS) | (F.col("repositories") >= WIDE_REPOSITORIES)
    sort = F.when(wide, "wide").when(live, "live").when(F.col("owners") == 1, "single").otherwise("shared")
    by_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | live, F.struct("start", "kind", "end", sort.alias("class"))))).alias("classed"),
        F.sort_array(F.collect_list(F.when((F.col("kind") == 3) & live, F.struct("start", "kind", "end", "hash")))).alias("added"),
        F.count_if(wide).alias("n_wide"),
        F.count_if(F.col("owners") == 1).alias("n_single"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    none = F.lit(0).cast("bigint")
    joined = rows.join(by_row, "row", "left")
    kept = [c for c in rows.columns if c not in ("row", "owner", "repository", "base", "bare")]
    return joined.select(*kept, "base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"), F.coalesce("classed", F.array().cast(f"array<{CLASSED}>")).alias("classed"), *(F.coalesce(c, none).alias(c) for c in ("n_wide", "n_single", "most_owners", "most_repositories")))


def rendered(spans: Column, *more: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"], *(s[c] for c in more))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"),
        rendered(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_live"), "n_wide", "n_single", "most_owners", "most_repositories",
        rendered(F.col("classed"), "class").alias("classes"),
    )


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """text with each span, overlapping ones as one, replaced by mask."""

    def over(s: Column) -> Column:
        ends = prefix(F.transform(s, lambda x: x["end"]), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))

        def pieces(reach: Column) -> Column:
            opens = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(reach, i)), F.struct(F.get(reach, i).alias("a"), x["start"].alias("b")))))
            last = F.array_max(F.transform(s, lambda x: x["end"]))
            return cutter(text, lambda cut: F.concat(F.array_join(F.transform(opens, lambda x: F.concat(cut(x["a"], x["b"]), F.lit(mask))), ""), cut(last, F.length(text).cast("bigint"))))

        return let(ends, pieces)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.sort_array(spans), over))


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with all secrets masked: rows and columns stay, n_chars follows the text.

    Base spans are found again as the text streams by.  Added spans need the corpus's counts; few documents have any,
    so these meet their text by id and text hash in a broadcast of a counted table, or in a shuffle beyond broadcast_rows.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(text)).alias("text_hash")
    found = scan(docs, doc_id=doc_id, text=text, keep=[key]).filter(F.size("added") > 0)
    found = written(found.groupBy("doc_id", "text_hash").agg(F.first("added").alias("added")), "secrets-added")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(text).alias("text"), F.col(doc_id).alias("id"), key.alias("hash"), base_spans(t).alias("base"))
    small = F.broadcast(found) if found.count() <= broadcast_rows else found
    joined = rows.join(small, rows["id"].eqNullSafe(found["doc_id"]) & (rows["hash"] == found["text_hash"]), "left")
    spans = F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    cut = let(spans, lambda s: redacted(F.col("text"), s))
    out = joined.select("row", F.when(F.col("text").isNotNull(), cut).alias("text"))
    changed = {text: F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
