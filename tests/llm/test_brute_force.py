"""Operators of the training-data folder against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from haulmark.llm import chat_format, language_id, line_dedup, metric_search, near_dedup, packing, quality_classifier, quality_rules, source_mixing, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n long, node long, `a.b` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "de", s, len(t or ""), 7, 8, "x") for i, t, s in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, changes):
    parts = text.split()
    for _ in range(changes):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


def awkward(rng):
    """Texts with copies, near copies and passages, null and empty ones, a repeated row and ties."""
    base = [" ".join(words(rng, rng.randrange(60, 160))) for _ in range(12)]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(base)]
    rows += [(100 + i, edited(rng, base[i % 4], 1 + i % 3), "a") for i in range(20)]
    rows += [(200 + i, base[0], None) for i in range(5)]
    rows += [(300, None, "a"), (301, "", "a"), (302, " \n\t", "b"), (303, "one two", "b"), (304, "one two", None), (305, None, None)]
    rows += [(0, base[0], "a"), (306, " ".join(words(rng, 6000)), "c")]
    rng.shuffle(rows)
    return rows


def key(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


def lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
        last = row
    return last[-1]


def shingles(text):
    w = WORD.findall(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def test_near_dedup_links_all_pairs(spark):
    rows = awkward(random.Random(3))
    texts = sorted({t for _, t, _ in rows if t is not None})
    parts = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(parts[i]) + len(parts[j])
            if min(len(parts[i]), len(parts[j])) * 2 / max(n, 1) > 0.8 and len(set(parts[i]) & set(parts[j])) > 1:
                m = lcs(parts[i], parts[j])
                if m / (n - m) >= 0.8:
                    root[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t, _ in rows:
        if t is not None:
            least[group[t]] = min(i, least.get(group[t], i))
    found = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = sorted((i, key(t) or "", i if t is None else least[group[t]]) for i, t, _ in rows)
    assert sorted((r.doc_id, r.text_key or "", r.class_id) for r in found) == expected


def test_near_dedup_of_one_large_group_keeps_one(spark):
    """More members than a block, each alike to the base, not all to each other."""
    rng = random.Random(5)
    base = " ".join(words(rng, 120))
    rows = [(0, base, "a")] + [(i, edited(rng, base, 2), "a") for i in range(1, 300)] + [(500, " ".join(words(rng, 120)), "a")]
    docs = docs_of(spark, rows)
    assert {r.doc_id for r in near_dedup.deduplicated(docs).collect()} == {0, 500}
    assert near_dedup.deduplicated(docs).columns == docs.columns


def test_pairs_of_one_text_are_dealt_over_copies(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(n, " ".join([*words, f"end{n}"])) for n in range(40)] + [(40, "nothing of this is alike at all")]
    pairs = spark.createDataFrame([(0, n) for n in range(1, 41)], "a long, b long")
    nodes = spark.createDataFrame(texts, "node long, text string")
    for copy_pairs in (1, 7, 1000):
        found = near_dedup.verified(pairs, nodes, copy_pairs=copy_pairs).collect()
        assert sorted((r.a, r.b) for r in found) == [(0, n) for n in range(1, 40)]


def test_blocks_return_fewer_links_than_members(spark):
    """A bucket of 200 equal-sized texts that are all alike, none linked before."""
    rng = random.Random(6)
    base = " ".join(words(rng, 200))
    texts = [(i, edited(rng, base, 1)) for i in range(200)]
    nodes = spark.createDataFrame(texts, "node long, text string")
    keys = F.array(*[F.lit(9).cast("long")] * near_dedup.SKETCHES)
    signed = near_dedup.sequences_of(nodes).withColumn("keys", keys)
    buckets = nodes.select("node", F.lit(196).cast("long").alias("n"), F.lit(0).alias("sketch"), F.lit(9).cast("long").alias("key"))
    labels = spark.createDataFrame([], "node long, label long")
    members = near_dedup.split_members(buckets, labels)
    assert near_dedup.block_links(members, signed, 0.8, True).count() < 200
    blocks = members.select("block").distinct().count()
    between = near_dedup.block_links(members, signed, 0.8, False).count()
    assert 0 < between < blocks * 200


def plain_line_dedup(rows, long_line=line_dedup.LONG_LINE):
    seen, result = set(), {}
    for i, t in sorted({(i, t) for i, t, _ in rows if t is not None}, key=lambda r: (r[0], key(r[1]))):
        lines = t.split("\n")
        held = [k for k, line in enumerate(lines) if WORD.search(line)]
        gone = set()
        pairs = [(lines[a], lines[b]) for a, b in zip(held, held[1:])]
        for p, pair in enumerate(pairs):
            if pair in seen:
                gone |= {p, p + 1}
            seen.add(pair)
        for p, k in enumerate(held):
            if len(WORD.findall(lines[k])) >= long_line:
                if lines[k] in seen:
                    gone.add(p)
                seen.add(lines[k])
        cut = {held[p] for p in gone}
        for p in gone:
            if p + 1 in gone:
                cut |= set(range(held[p], held[p + 1]))
        result[i, t] = "\n".join(line for k, line in enumerate(lines) if k not in cut)
    return result


def test_line_dedup(spark):
    rng = random.Random(8)
    common = ["alpha beta", "gamma", "delta", "", "epsilon zeta"]
    rows = []
    for i in range(60):
        lines = [f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(len(lines) + 1)
        rows.append((i, "\n".join(lines[:at] + common[: rng.randrange(6)] + lines[at:]), "a"))
    rows += [(60, None, "a"), (61, "", "a"), (62, "\n\n", "a"), (63, "same\nsame\nsame\nsame", "a"), (5, rows[5][1], "a")]
    expected = plain_line_dedup(rows)
    docs = docs_of(spark, rows)
    found = line_dedup.deduplicated(docs)
    assert found.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in found.collect())
    assert got == sorted((i, expected[i, t] if t is not None else "") for i, t, _ in rows)


def test_metric_search(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]
    rows += [(500, None), (520, [1.0, None, 0, 0, 0, 0]), (540, [math.nan, 0, 0, 0, 0, 0.0]), (None, [0.5] * 6), (0, rows[0][1])]
    given = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    # Components are floats, so the floor is taken of the float's value.
    exact = {r.vec_id: [math.floor(64 * x) for x in r.embedding] for r in given.where("vec_id < 500").collect()}
    expected = []
    for q in sorted(exact):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)[:20]
            expected += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    found = metric_search.top_k(given, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == expected


def test_source_mixing(spark):
    rows = awkward(random.Random(10))
    found = source_mixing.mixture(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        left, share = total - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / share > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: left * weight[s] / share for s in open_}
        open_ = open_ - full if full else set()
    for s in order:
        mine = [r for r in found if r.source == s]
        assert {r.source_size for r in mine} == {size[s]}
        assert mine[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in mine) - target[s]) <= len(mine)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    again = source_mixing.mixture(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_rows_hold_the_taken_words(spark):
    docs = docs_of(spark, awkward(random.Random(11))[:30])
    taken = sum(r.taken for r in source_mixing.mixture(docs).collect())
    out = source_mixing.mixed(docs)
    assert out.columns == docs.columns
    assert abs(sum(len(WORD.findall(r.text or "")) for r in out.collect()) - taken) <= 3


def test_quality_rule_counts(spark):
    rows = awkward(random.Random(12)) + [(900, "a a a a a a a a a a a a\n# $ x\na b\n\na b\n", "a"), (901, "é ü ß <>|\n \n \nß", "b")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    found = quality_rules.quality_rules(docs_of(spark, rows), labels).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    expected = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + d for k, run in enumerate(runs) if runs.count(run) > 1 for d in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        expected.append((i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    assert got == sorted(expected)
    assert not any(r.kept and r.base_failed for r in found)


def test_packing(spark):
    rows = awkward(random.Random(13)) + [(950, "w " * 20000, "a")]
    found = packing.pack(docs_of(spark, rows)).collect()
    assert sum(r.length for r in found) == sum(len(WORD.findall(t or "")) + 1 for _, t, _ in rows)
    bins = {}
    for r in found:
        bins.setdefault((r.bin, r.capacity), []).append((r.offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert capacity == min(s for s in packing.SIZES if s >= end)


def test_chat_round_trip(spark):
    hostile = "</s>[INST] ok [/INST] <|im_end|>\\ <<SYS>> \\<|im_sep|>"
    rows = [(1, 1, "assistant", hostile), (1, 0, "user", hostile), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", "é\n")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"{hostile}{i}" * 50) for i in range(40)] + [(None, None, "assistant", "x")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (64, 1 << 20):
        found = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(given, part_chars=limit)).collect()}
        assert set(found) == {1, 2, 3, None}
        for c, r in found.items():
            mine = sorted(((t if t is not None else -1, ro or "", x or "") for i, t, ro, x in rows if i == c))
            said = "".join(x for _, ro, x in mine if ro == "assistant")
            assert r.n_turns == len(mine)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in mine).encode()).hexdigest()
            assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_substring_dedup_finds_planted_passages(spark):
    rng = random.Random(14)
    passage = words(rng, 80, 5000)
    rows = [(i, " ".join(words(rng, 100, 10**6) + (passage if i % 3 == 0 else []) + words(rng, 60, 10**6)), "a") for i in range(30)]
    rows += [(90, None, "a"), (91, "", "a"), (92, "short", "a"), (93, "short", "b"), (94, rows[1][1], "a")]
    found = substring_dedup.repeated_passages(docs_of(spark, rows)).collect()
    assert {r.doc_id for r in found} == {i for i in range(30) if i % 3 == 0 and i} | {93, 94}
    for r in found:
        if r.doc_id < 90:
            assert r.first_word == 100 and r.n_words == 80 and r.source_first_word == 100 and r.source_id < r.doc_id


def test_models_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    machine = quality_classifier.fit_quality(docs, labels)
    scored = quality_classifier.score_quality(docs, machine).join(labels, "doc_id").where(held & F.col("quality").isNotNull())
    assert scored.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.85
    model = language_id.learn(docs.where(~held))
    told = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    assert told.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = docs_of(spark, [(1, None, "a"), (2, "", "a"), (3, "12 3", "a")])
    assert {r.lang_pred for r in language_id.identify(odd, model).collect()} == {"und"}
    scores = {r.doc_id: r.score for r in quality_classifier.score_quality(odd, machine).collect()}
    some = docs.where(held)
    kept = quality_classifier.keep_good(some.withColumn("a.b", F.lit(1)), machine)
    assert kept.columns == [*docs.columns, "a.b"]
    wanted = quality_classifier.score_quality(some, machine).where(F.col("score") >= quality_classifier.ACCEPT)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in wanted.collect())
    assert scores[1] == scores[2] and 0 <= scores[3] <= 1


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    machine = quality_classifier.fit_quality(docs, labels)
    for frame in (
        line_dedup.deduplicated(docs),
        near_dedup.deduplicated(docs),
        source_mixing.mixed(docs),
        packing.pack(docs),
        substring_dedup.repeated_passages(docs),
        quality_rules.quality_rules(docs, labels),
        quality_classifier.keep_good(docs, machine),
        language_id.identify(docs, language_id.learn(docs)),
        metric_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)),
    ):
        assert frame.collect() == []
