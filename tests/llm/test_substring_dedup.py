"""Compact windows, verification and partners of substring dedup against brute force."""

import random
import time

import numpy as np
import pytest

from haulmark.llm import substring_dedup as sd

WIDTH = sd.MIN_WORDS - sd.SHINGLE + 1


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def tree(values, left, right, width):
    """Windows by the definition; of equal values the middle one of the least is the upper node."""
    if right - left < width:
        return []
    least = min(values[left:right])
    places = [i for i in range(left, right) if values[i] == least]
    m = places[len(places) // 2]
    return [(left, m, right), *tree(values, left, m, width), *tree(values, m + 1, right, width)]


@pytest.mark.parametrize("kinds", [10**9, 40, 3, 1])
@pytest.mark.parametrize("width", [1, 2, 5, 46])
def test_windows_are_the_wide_nodes_of_the_trees(kinds, width):
    rng = random.Random(kinds + width)
    sizes = [0, 1, width - 1, width, width + 1, 300, 0, 97, 2]
    values = [rng.randrange(1, kinds + 1) for _ in range(sum(sizes))]
    ptr = np.cumsum([0, *sizes])
    got = sd.compact_windows(np.array(values, np.uint64), ptr, width)
    want = [w for a, b in zip(ptr, ptr[1:]) for w in tree(values, int(a), int(b), width)]
    assert sorted(zip(*[x.tolist() for x in got])) == sorted(want)


def test_many_equal_values_take_linear_time():
    values = np.full(300_000, 7, np.uint64)
    start = time.time()
    found = sd.compact_windows(values, np.array([0, len(values)]), WIDTH)
    assert time.time() - start < 4
    assert len(found[0]) <= 2 * len(values) / WIDTH + 1


def changed(rng, passage, places):
    return [f"x{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(passage)]


def verify(x, y):
    a, b = (sd._sequence(" ".join(t)) for t in (x, y))
    return sd.passages(a, b)


@pytest.mark.parametrize("n", [50, 55, 60, 70, 80, 95, 100])
def test_one_changed_word_at_every_place(n):
    rng = random.Random(n)
    passage = words(rng, n)
    for place in range(n):
        x = words(rng, 40) + changed(rng, passage, {place}) + words(rng, 30)
        found = verify(x, words(rng, 20) + passage + words(rng, 70))
        assert len(found) == 1, place
        first, count = found[0][:2]
        # A passage of 50 words of which 49 are held may take the words beside it for the changed one.
        assert 35 <= first and first + count <= 40 + n + 5
        assert count >= max(sd.MIN_WORDS, n - 15)


@pytest.mark.parametrize(("n", "changes"), [(80, 1), (100, 2), (150, 3), (200, 4), (400, 8)])
def test_spread_changes_leave_one_whole_passage(n, changes):
    rng = random.Random(n)
    for _ in range(40):
        passage = words(rng, n)
        gap = n // changes
        places = {gap * k + rng.randrange(15, gap - 15) for k in range(changes)}
        x = words(rng, 60) + changed(rng, passage, places) + words(rng, 60)
        found = verify(x, words(rng, 30) + passage + words(rng, 50))
        assert max((f[1] for f in found), default=0) >= 0.9 * n - 6


def test_unlike_texts_have_no_passage():
    rng = random.Random(1)
    for _ in range(50):
        passage = words(rng, 40)  # with 10 other words below 0.8
        assert verify(words(rng, 80) + passage + words(rng, 80), words(rng, 9) + passage + words(rng, 200)) == []


@pytest.fixture(scope="module")
def families(spark):
    """An exact passage that stands twice among drifted versions of it, 30 families a size."""
    rng = random.Random(21)
    rows, wanted, near = [], {}, {}
    for versions in (2, 4, 10, 20, 40):
        for family in range(30):
            passage, base = words(rng, 80), len(rows)
            twice = sorted(rng.sample(range(1, versions), 1)) + [versions]
            for v in range(versions + 1):
                part = passage if v in twice else changed(rng, passage, set(rng.sample(range(80), 6)))
                rows.append((base + v, " ".join(words(rng, 60) + part + words(rng, 40))))
            wanted[base + versions] = (versions, base + twice[0])
    for family in range(60):
        passage, base = words(rng, 100), len(rows)
        rows.append((base, " ".join(words(rng, 50) + passage + words(rng, 50))))
        rows.append((base + 1, " ".join(words(rng, 70) + changed(rng, passage, {rng.randrange(100)}) + words(rng, 50))))
        near[base + 1] = base
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in sd.repeated_passages(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    return wanted, near, found


def test_exact_repeats_among_drifted_versions(families):
    wanted, _, found = families
    for versions in (2, 4, 10, 20, 40):
        mine = [d for d, (v, _) in wanted.items() if v == versions]
        whole = [d for d in mine if any(r.first_word == 60 and r.n_words >= 80 for r in found.get(d, []))]
        assert len(whole) >= 0.9 * len(mine), (versions, len(whole), len(mine))


def test_recall_of_changed_passages(families):
    _, near, found = families
    hit = [d for d, source in near.items() if any(r.source_id == source for r in found.get(d, []))]
    assert len(hit) >= 0.9 * len(near)


def test_repetitive_and_null_texts(spark):
    rows = [(1, "la " * 30_000), (2, "la " * 30_001), (None, "la " * 60), (3, None), (4, ""), (5, "la " * 49)]
    found = {r.doc_id for r in sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {1, 2} and 2 in found


@pytest.fixture(scope="module")
def hidden(spark):
    """Passages whose only earlier copy, with a changed word, lies among texts that hold 44 words of them."""
    rng = random.Random(33)
    rows, wanted = [], {}
    for versions in (8, 16, 32):
        for family in range(15):
            passage, base = words(rng, 80), len(rows)
            twin = versions // 2
            for v in range(versions):
                begin = (0, 12, 24, 36)[v % 4]
                part = changed(rng, passage, {rng.randrange(80)}) if v == twin else passage[begin : begin + 44]
                rows.append((base + v, " ".join(words(rng, 60) + part + words(rng, 40))))
            rows.append((base + versions, " ".join(words(rng, 50) + passage + words(rng, 60))))
            wanted[base + versions] = base + twin
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return wanted, docs, sd.repeated_passages(docs).collect()


def test_the_one_earlier_copy_among_parts_of_the_passage(hidden):
    wanted, _, found = hidden
    hit = [d for d, source in wanted.items() if any(r.doc_id == d and r.source_id == source and r.n_words >= 50 for r in found)]
    assert len(hit) >= 0.95 * len(wanted), (len(hit), len(wanted))


def test_blocks_give_what_one_block_gives(hidden, monkeypatch):
    _, docs, found = hidden
    monkeypatch.setattr(sd, "BLOCK", 5)
    assert sorted(sd.repeated_passages(docs).collect()) == sorted(found)


def test_stretches_by_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(200):
        held = rng.random((4, rng.integers(1, 30))) < 0.85
        n = held.shape[1]
        spot, width = int(rng.integers(0, n)), int(rng.integers(1, 12))
        a, b = sd._stretches(held, spot, width)
        for row, begin, end in zip(held, a, b):
            want = [
                q - p for p in range(spot + 1) for q in range(max(p + width, spot + 1), n + 1) if 9 * row[p:q].sum() >= 8 * (q - p)
            ]
            assert end - begin == max(want, default=0)
            assert begin == end or begin <= spot < end and 9 * row[begin:end].sum() >= 8 * (end - begin)


@pytest.mark.parametrize("few", [0, 3, 10**9])
def test_common_shingles_are_counted_alike(few, monkeypatch):
    monkeypatch.setattr(sd, "_FEW", few)
    rng = np.random.default_rng(few % 7)
    x, y = rng.integers(0, 30, (9, 12)), rng.integers(0, 30, (7, 12))
    rows = [np.repeat(np.arange(len(side)), 12) for side in (x, y)]
    got = sd._shared(rows[0], x.ravel(), rows[1], y.ravel(), (9, 7, 30))
    assert (got == [[np.isin(a, b).sum() for b in y] for a in x]).all()
