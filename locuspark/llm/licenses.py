"""License scans by ordered signature rules, in SQL functions only.

Texts become words between spaces.  One pattern, a tree of all gates, looks at the words' beginnings once; few texts hold
any gate, and of the hundreds of rules a text is only held to those all of whose gates it has.  Every rule gives its
leftmost non-overlapping detections, as stretches of words.  They are resolved level by level, from exact titles over
names without a version to clues: what overlaps a detection of a better level goes, and within a level what lies inside
another's stretch (of equal stretches, the first rule's stays).  Detections that only touch the same words in part, on
one level, both stay.

The base, places of four phrases, is counted whatever the rules decide.

Rows: null text is empty; a row without words has no labels, score 0 and null places; repeated rows are judged each for
itself; an empty table gives no rows; ids of any type are kept; further columns are ignored.  A row's result comes from
that row: nothing is shuffled, and time is linear in the text and n log n in its detections, blocks of 64 taken as one.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.llm import license_rules
from locuspark.llm.native import let, prefix, prefix_sums

# The base phrases, their labels, and what separates words.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: A word of each phrase.
BASE_GATES = ("gnu", "apache", "cc", "license")
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULE = "struct<rule:int,level:int,label:string,gate:string,more:array<string>,pattern:string>"
#: A stretch of words: back is -end, so that the order is that of starts, then of longer ones, then of rules.
DETECTION = "struct<start:bigint,back:bigint,rule:int,level:int,label:string>"


def spelled(pattern: str) -> str:
    """A rule's pattern over text in which a space stands on both sides of each word."""
    return f" {pattern.replace(' ', '  ')} "


@cache
def table() -> list[dict]:
    rare = lambda words: next(w for w in words if w not in license_rules.COMMON)
    named = lambda words: {"gate": rare(words), "more": [f" {w} " for w in words if w != rare(words)]}
    return [{"rule": n, "level": level, "label": label, **named(words), "pattern": spelled(pattern)} for n, (label, level, words, pattern) in enumerate(license_rules.rules())]


def tree(words: set[str]) -> str:
    """A pattern for any of the words that shares their beginnings."""
    heads: dict[str, set[str]] = {}
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    branches = [h + (tree(rest) if rest != {""} else "") for h, rest in sorted(heads.items())]
    inner = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
    return f"(?:{inner})?" if "" in words and branches else inner


def gates() -> str:
    """A pattern for the words one of which opens each rule, and the base phrases."""
    words = {r["gate"] for r in table()} | set(BASE_GATES)
    return f"(?i) (?=[{''.join(sorted({w[0] for w in words}))}]){tree(words)} "


def spaced(text: Column) -> Column:
    """The words, each between two spaces of its own; empty without words."""
    words = F.btrim(F.regexp_replace(text, SEPARATORS, "  "))
    return let(words, lambda w: F.when(w == "", w).otherwise(F.concat(F.lit(" "), w, F.lit(" "))))


def count_words(spaced_text: Column) -> Column:
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def places(text: Column, pattern: Column) -> Column:
    """array<struct<start, end>> of a spelled pattern's matches, in words."""

    def found(ms: Column) -> Column:
        def placed(gaps: Column) -> Column:
            sizes = F.transform(ms, lambda m, i: F.struct(count_words(F.get(gaps, i)).alias("gap"), count_words(m).alias("own")))
            return let(sizes, lambda s: let(prefix_sums(F.transform(s, lambda x: x["gap"] + x["own"])), lambda base: F.transform(s, lambda x, i: F.struct((F.get(base, i) + x["gap"]).alias("start"), (F.get(base, i) + x["gap"] + x["own"]).alias("end")))))

        return let(F.split(text, pattern, -1), placed)

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.rlike(text, pattern), let(F.regexp_extract_all(text, pattern, F.lit(0)), found)).otherwise(none)


def detections(text: Column, held: Column) -> Column:
    """array<DETECTION> of all rules whose gates the text has, in order."""
    rules = F.from_json(F.lit(json.dumps(table())), f"array<{RULE}>")
    open_rules = F.filter(rules, lambda r: F.array_contains(held, r["gate"]) & F.forall(r["more"], lambda g: F.contains(text, g)))
    own = lambda r: F.transform(places(text, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), r["rule"].alias("rule"), r["level"].alias("level"), r["label"].alias("label")))
    return F.sort_array(F.flatten(F.transform(open_rules, own)))


def outermost(found: Column) -> Column:
    """Of sorted detections those that lie inside no other; of equal ones the first."""
    far = F.lit(-1).cast("bigint")
    reach = lambda f: prefix(F.transform(f, lambda d: -d["back"]), far, lambda a, b: F.greatest(a, b))
    return let(found, lambda f: let(reach(f), lambda r: F.filter(f, lambda d, i: F.get(r, i) < -d["back"])))


def apart(found: Column, better: Column) -> Column:
    """The detections that overlap none of the better ones, from both in one order."""
    none, far = F.lit(-1).cast("bigint"), F.lit(1 << 62)
    both = F.sort_array(F.concat(F.transform(found, lambda d: F.struct(d.alias("d"), F.lit(False).alias("better"))), F.transform(better, lambda d: F.struct(d.alias("d"), F.lit(True).alias("better")))))

    def over(s: Column) -> Column:
        ends = prefix(F.transform(s, lambda x: F.when(x["better"], -x["d"]["back"]).otherwise(none)), none, lambda a, b: F.greatest(a, b))
        starts = prefix(F.transform(F.reverse(s), lambda x: F.when(x["better"], x["d"]["start"]).otherwise(far)), far, lambda a, b: F.least(a, b))
        free = lambda e, t: F.filter(s, lambda x, i: ~x["better"] & (F.get(e, i) <= x["d"]["start"]) & (F.get(t, F.size(s) - 1 - i) >= -x["d"]["back"]))
        return F.transform(let(ends, lambda e: let(starts, lambda t: free(e, t))), lambda x: x["d"])

    return F.when(F.size(found) == 0, found).otherwise(let(both, over))


def resolved(rows: DataFrame) -> DataFrame:
    """rows with kept: of the detections in found those that stay, in order."""
    at = lambda level: F.filter("found", lambda d: d["level"] == level)
    rows = rows.withColumn("kept", F.when(F.size("found") == 0, F.col("found")).otherwise(outermost(at(0))))
    for level in range(1, len(license_rules.LEVELS)):
        more = F.concat("kept", outermost(apart(at(level), F.col("kept"))))
        rows = rows.withColumn("kept", F.when(F.size(at(level)) == 0, F.col("kept")).otherwise(F.sort_array(more)))
    return rows


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, base (array of struct<start, end, label>), found and kept (arrays of detections).

    Each step's column is used several times by the next one, so the steps stay apart in the plan and run once a row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), spaced(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("spaced"))
    gate = F.transform(F.array_distinct(F.transform(F.regexp_extract_all("spaced", F.lit(gates()), F.lit(0)), F.lower)), lambda g: F.btrim(g))
    rows = rows.select("doc_id", count_words(F.col("spaced")).alias("n_words"), gate.alias("gates"), "spaced")
    shut = F.size("gates") == 0
    rows = rows.select("doc_id", "n_words", "gates", F.when(shut, F.lit("")).otherwise(F.translate("spaced", _UPPER, _LOWER)).alias("spaced"))
    none, base_none = F.array().cast(f"array<{DETECTION}>"), F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")
    phrase = lambda p: F.transform(places(F.col("spaced"), F.lit(spelled(p))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(BASE[p]).alias("label")))
    base = F.when(shut, base_none).otherwise(F.sort_array(F.concat(*map(phrase, BASE))))
    found = F.when(shut, none).otherwise(detections(F.col("spaced"), F.col("gates")))
    judged = resolved(rows.select("doc_id", "n_words", base.alias("base"), found.alias("found")))
    # A generator of one row: what is asked of the result isn't pushed into the steps, where it would multiply them.
    return judged.select("doc_id", "n_words", F.inline(F.array(F.struct("base", "found", "kept"))))


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query."""
    shown = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    base = F.transform("base", lambda b: b["label"])
    starts = F.transform("base", lambda b: b["start"])
    score = F.array_max(F.transform("kept", lambda d: F.get(F.array(*map(F.lit, license_rules.LEVELS)), d["level"])))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), shown(base).alias("base_labels"),
        shown(F.concat(base, F.transform("kept", lambda d: d["label"]))).alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"),
        F.size("kept").cast("bigint").alias("n_kept"), (F.size("found") - F.size("kept")).cast("bigint").alias("n_suppressed"),
        F.array_join(F.transform("kept", lambda d: F.concat_ws(":", d["label"], d["start"], -d["back"])), ",").alias("spans"),
    )
