"""License rules, spelling variants and fill-in-middle against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuspark.llm import fim, license_rules, licenses, spelling

CLASHING = ["n", "form", "word", "key", "place", "label", "level", "rule", "spaced", "gates", "output", "base", "found", "kept", "n_words", "_id", "_text", "id"]

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


# --- 11 -------------------------------------------------------------------------------------------------------


def expanded(pattern):
    """Some texts that a rule matches: every optional part and every alternative once taken and once not."""
    import re._constants as c
    import re._parser as p

    def texts(tree, pick):
        out = ""
        for op, arg in tree:
            if op == c.LITERAL:
                out += chr(arg)
            elif op == c.MAX_REPEAT:
                low, high, inner = arg
                out += texts(inner, pick) * (high if high == 1 and pick else max(low, 1 if high != 1 else 0))
            elif op == c.SUBPATTERN:
                out += texts(arg[3], pick)
            elif op == c.BRANCH:
                out += texts(arg[1][-1 if pick else 0], pick)
            elif op == c.IN:
                out += "q" if arg[0][0] == c.RANGE else chr(arg[-1 if pick else 0][1])
            else:
                raise ValueError(op)
        return out

    return {texts(p.parse(pattern), pick) for pick in (False, True)}


def test_rules_have_their_gates():
    rules = license_rules.rules()
    assert len(rules) > 300
    for r, (label, _, gates, pattern) in zip(licenses.table(), rules, strict=True):
        assert r["gate"] not in license_rules.COMMON
        for text in expanded(pattern):
            assert re.fullmatch(pattern, text), (label, text)
            assert set(gates) <= set(text.split()), (label, text)


def brute_licenses(text):
    """Every rule on every text, and every pair of detections."""
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = WORD.findall(lower)
    t = "".join(f" {w} " for w in words)
    at = lambda k: t[:k].count(" ") // 2
    found = [(at(m.start()), at(m.end()), n, level, label) for n, (label, level, _, p) in enumerate(license_rules.rules()) for m in re.finditer(licenses.spelled(p), t)]
    kept = []
    for level in range(3):
        free = [d for d in found if d[3] == level and not any(k[0] < d[1] and d[0] < k[1] for k in kept)]
        kept += [d for d in free if not any(e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[2] < d[2]) for e in free)]
    base = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels = lambda xs: ",".join(sorted(set(xs)))
    starts = [i for i, _ in base]
    score = max((license_rules.LEVELS[d[3]] for d in kept), default=0.0)
    spans = ",".join(f"{d[4]}:{d[0]}:{d[1]}" for d in sorted(kept, key=lambda d: (d[0], -d[1], d[2])))
    return len(words), len(base), min(starts, default=None), max(starts, default=None), labels(b for _, b in base), labels([b for _, b in base] + [d[4] for d in kept]), score, len(kept), len(found) - len(kept), spans


def license_texts():
    rng = random.Random(3)
    samples = [t for _, _, _, p in license_rules.rules() for t in sorted(expanded(p))]
    filler = ["été", "mit", "by", "license", "Apache", "the", "漢字", "cc", "K", "GNU", "K", "İ"]
    out = [None, "", " ", "...", "é", "nothing of the sort", "Released under the MIT License.", "CC BY-NC-SA 4.0, cc by cc by 3.0", "SPDX-License-Identifier: GPL-2.0-or-later"]
    out += ["Licensed under the Apache License, Version 2.0 and the GNU General Public License, version 3 or later", "mİt license", "MIT\nLicense mit-license MITlicense", "licensed under the terms of the whatever"]
    out += [" ".join(rng.choice(filler) if rng.random() < 0.4 else rng.choice(samples).title() for _ in range(rng.randint(1, 30))) for _ in range(60)]
    out.append("\n".join(rng.choice(samples) + rng.choice([". ", ", ", " by "]) for _ in range(400)))
    return [*samples, *out, out[8], out[8]]


def test_licenses(spark):
    texts = license_texts()
    rows = list(enumerate(texts))
    got = licenses.digest(licenses.scan(clashing(spark, [*rows, rows[-1]]))).collect()
    want = Counter((i, *brute_licenses(t)) for i, t in [*rows, rows[-1]])
    assert Counter(tuple(r) for r in got) == want
    assert licenses.digest(licenses.scan(clashing(spark, rows).limit(0))).count() == 0


def test_license_examples(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "gpl-3.0-only", "this is mit der Lizenz von apache", "licensed under the sun"]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(clashing(spark, list(enumerate(texts))))).collect()}
    assert (got[0]["labels"], got[0]["score"], got[0]["spans"]) == ("apache,apache-2.0", 1.0, "apache-2.0:3:8")
    assert (got[1]["labels"], got[1]["base_labels"]) == ("gpl-3.0-only", "")
    assert (got[2]["labels"], got[2]["score"]) == ("", 0.0)
    assert (got[3]["labels"], got[3]["score"]) == ("unknown", 0.4)


def test_filters_on_licenses_plan_quickly(spark):
    import time

    began = time.time()
    scanned = licenses.digest(licenses.scan(clashing(spark, [(1, "mit license")])))
    assert scanned.filter("n_kept > 0 and score > 0.5").groupBy("labels").count().count() == 1
    assert time.time() - began < 60


def test_long_license_text(spark):
    """Twenty thousand detections in one text."""
    text = "the mit license and cc by nc 4 0 or " * 10_000
    [r] = licenses.digest(licenses.scan(clashing(spark, [(1, text)]))).collect()
    assert (r["n_words"], r["n_base"], r["n_kept"], r["labels"]) == (100_000, 20_000, 20_000, "cc-by,cc-by-nc-4.0,mit")


# --- 12 -------------------------------------------------------------------------------------------------------


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            forms[w] = best
        out[w] = (n, len(near), forms.get(w), words[best] if w in forms else None)
    root = lambda w: root(forms[w]) if w in forms else w
    return {(w, f, root(w), n, k, m) for w, (n, k, f, m) in out.items()}


def spelling_rows():
    rng = random.Random(8)
    stems = ["station", "aaaaaa", "réseau", "ñandú", "letters", "ababab", "ÀÉÎõü", "ßtraße"]

    def varied(w):
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + ["", rng.choice("abét"), rng.choice("abét") + w[i]][kind] + w[i + 1 :]
        return w

    rows = [(i if i % 9 else None, " ".join(varied(rng.choice(stems)) + rng.choice(["", ",", "9", "漢"]) for _ in range(60))) for i in range(120)]
    # Counts that double along a chain, from abcde on.
    chain = ["abcdefghij"[:k] for k in range(5, 11)]
    rows += [(1000 + i, " ".join(w for k, w in enumerate(chain) for _ in range(2**k))) for i in range(3)]
    long = "x" * 3000 + "y" * 3000
    rows += [(2000 + i, f"{long} {long}z {long[1:]} {'x' * 2999}w{'y' * 3000}") for i in range(3)]
    return [*rows, (1, None), (2, ""), (3, "..."), (4, "abcd " * 10), rows[0], rows[0]]


@pytest.mark.parametrize("held", [spelling.HELD_BYTES, 2000])
def test_variants(spark, held):
    rows = spelling_rows()
    got = {tuple(r) for r in spelling.variants(clashing(spark, rows), held=held).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_variants(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 5 for r in want)


def test_variants_of_nothing(spark):
    assert spelling.variants(clashing(spark, [(1, None)]).limit(0)).count() == 0
    assert spelling.variants(clashing(spark, [(1, None), (2, "abcd")])).count() == 0


def test_deletion_hashes():
    words = ["station", "statoin", "aaaaaaa"]
    points = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(3, 7)
    whole, without = spelling.deletion_hashes(points)
    for r, w in enumerate(words):
        for i in range(7):
            cut = np.frombuffer((w[:i] + w[i + 1 :]).encode("latin-1"), np.uint8).reshape(1, 6)
            assert spelling.deletion_hashes(cut)[0][0] == without[r, i]
    assert len(set(whole.tolist())) == 3


def test_collisions_are_told_apart(spark, monkeypatch):
    """With keys of two bits nearly all keys collide; the strings decide."""
    rows = spelling_rows()[:80]
    want = {tuple(r) for r in spelling.variants(clashing(spark, rows)).select("word", "n_near").collect()}
    keys = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda v: keys(v).withColumn("key", F.pmod("key", F.lit(4))))
    assert {tuple(r) for r in spelling.variants(clashing(spark, rows)).select("word", "n_near").collect()} == want


# --- 13 -------------------------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def fim_rows():
    rng = random.Random(4)
    alphabet = ["a", "Zz", "P", "S", "M", "<", ">", "<P", "S>", " ", "\n", "é", "漢", "😀", "0", "word ", "K", "\x00"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(i, t) for i, t in enumerate([None, "", "a", "é", "<P>", "x<S>y", "<M", "M>", "<<P>>", "letters", "é" * 50, "a1" * 40, " a"], 1000)]
    rows += [(5000, "lorem ipsum, " * 50_000), (5001, "x" * 500_000), (5002, "😀" * 100_000), (-7, "below zero"), (None, "no id at all"), (None, None)]
    return [*rows, rows[0], rows[0]]


def test_fill_in_middle(spark):
    rows = fim_rows()
    got = fim.digest(fim.fill_in_middle(clashing(spark, rows))).collect()
    want = Counter(brute_fim(*r) for r in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.digest(fim.fill_in_middle(clashing(spark, rows).limit(0))).count() == 0


def test_units_end_where_they_end():
    for _, text in fim_rows()[:410]:
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
        found = fim.Units(text or "")
        assert found.count == len(units)
        assert found.marked == any(x in (text or "") for x in ("<P>", "<S>", "<M>"))
        for k in range(len(units) + 1):
            assert found.end(k) == len("".join(units[:k]))


def test_other_seeds_draw_otherwise():
    assert fim.draws("1", 1) != fim.draws("1", 2)
    with pytest.raises(ValueError):
        fim.restore("<S>x<P>y<M>z", "psm")
