"""Periodic runs against a search over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from haulmark.llm import periodic_runs, queries
from haulmark.llm.suffix_tree import SuffixTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                inside = any(s <= i and i + length <= s + n2 and q % p == 0 for (s, n2), p in found.items())
                if not inside:
                    found[i, length] = q
            i = j + 1
    return sorted((s, n2, p) for (s, n2), p in found.items())


def samples(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        size = rng.randrange(2, 5)
        words = [rng.choice("abcdef"[:size]) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice("abcdef"[:size]) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 7)[: rng.randrange(1, 7 * len(unit) + 1)]
        yield words


def test_tree_gives_longest_common_extensions():
    rng = random.Random(1)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 50))]
        tree = SuffixTree(s)
        order = sorted(range(len(s) + 1), key=lambda i: s[i:])
        assert [order.index(i) for i in range(len(s) + 1)] == tree.rank.tolist()
        down = sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]])
        assert [down.index(i) for i in range(len(s) + 1)] == tree.reversed_rank().tolist()
        pairs = [(i, j) for i in range(len(s) + 1) for j in range(len(s) + 1) if i != j]
        got = tree.extension(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        for (i, j), x in zip(pairs, got):
            want = 0
            while max(i, j) + want < len(s) and s[i + want] == s[j + want]:
                want += 1
            assert x == want


def test_runs_equal_the_search():
    for words in samples(2, 1500):
        got = periodic_runs.runs_of_words([w.encode() for w in words])
        assert [tuple(r) for r in got.tolist()] == plain_runs(words)


def test_regions_hold_every_run_of_a_long_text():
    rng = random.Random(3)
    words = [f"w{rng.randrange(50)}" for _ in range(3000)]
    for at, unit, times in ((100, 40, 5), (900, 1, 6), (1500, 2, 4), (2000, 150, 4)):
        words[at : at + unit * times] = words[at : at + unit] * times
    got = periodic_runs.runs_of_words([w.encode() for w in words])
    assert [tuple(r) for r in got.tolist()] == plain_runs(words)
    regions = periodic_runs.candidate_regions(np.array([int(w[1:]) for w in words]))
    assert sum(b - a for a, b in regions) < 2500


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_brute_force_on_awkward_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(w)) for i, w in enumerate(samples(5, 150))]
    rows += [(500 + i, " ".join(f"w{rng.randrange(60)}" for _ in range(150))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "é é é é é é x"), (None, "a b " * 9), (0, rows[0][1]), (904, "b" * 5000), (-7, "z " * 3000)]
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, row int, runs string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    assert sorted(map(tuple, got), key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    kept = periodic_runs.deduplicated(frame)
    assert kept.columns == frame.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[None] == "a b" and texts[900] is None and texts[902] == " \n\t"
    assert periodic_runs.deduplicated(frame.limit(0)).count() == 0


def test_whole_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "a " * 100_000)], "doc_id long, text string")
    assert periodic_runs.periodic_runs(docs).select(F.col("runs")[0].alias("r")).first().r == (0, 100_000, 1)
