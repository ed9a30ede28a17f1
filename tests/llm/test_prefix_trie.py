"""The prefix trie against a trie of dictionaries."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import engines
from haulmark.llm import prefix_trie, queries, sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, d1 string, single int"


def sample(seed, convs=130):
    rng = random.Random(seed)
    said = ["", None, "a b", "a  b", "c", "d é f", "x" * 3000]
    rows = []
    for c in [*range(-5, convs), 10**12]:
        if rng.random() < 0.1:
            continue
        start = rng.randrange(3)
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            text = said[start] if t < 2 else rng.choice(said)
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", None]) if t > 2 else "user", text, "z", 1))
    rows += [(None, 1, "user", "nobody's", "z", 1), rows[0], rows[0], *[(7, 100 + t, "user", f"t {t % 4}", "z", 1) for t in range(400)]]
    rng.shuffle(rows)
    return rows


def expected(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    saved, leaves, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        value = (len(who) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
        if node:
            children[node[:-1]] += 1
    for node in members:
        if not children[node]:
            for d in range(len(node) + 1):
                leaves[node[:d]] += 1
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if paths[c] == node)
        parent = min(members[node[:-1]]) if node else None
        yield min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()


def written(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_a_trie_of_dictionaries(spark, tmp_path, seed):
    rows = sample(seed)
    got = sorted(tuple(r) for r in queries.op11_prefix_trie(spark, written(spark, rows, tmp_path)).collect())
    assert got == sorted(expected(rows))


def test_many_members_and_lookups_of_one_parent(spark, tmp_path, monkeypatch):
    """A small bound for looked-up nodes and small pieces take the other branches."""
    monkeypatch.setattr(prefix_trie, "LOOKED_UP", 3)
    rows = [(c, t, "user", "same" if t == 0 else f"own {c % 50}", "z", 1) for c in range(300) for t in range(2)]
    got = sorted(tuple(r) for r in queries.op11_prefix_trie(spark, written(spark, rows, tmp_path)).collect())
    assert got == sorted(expected(rows))


def test_a_full_sketch_changes_nothing(spark, tmp_path, monkeypatch):
    rows = sample(3, 60)
    monkeypatch.setattr(prefix_trie, "_BLOCK", 16)
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    wide, _ = prefix_trie.prefix_trie(turns)
    full, _ = prefix_trie.prefix_trie(turns, max_cells=16)
    assert wide.where("tail").count() > 0 == full.where("tail").count()
    order = lambda df: sorted(map(str, df.select(columns).collect()))
    assert order(wide) == order(full)


def test_single_is_never_claimed_wrongly(spark):
    turns = prefix_trie.ordered_turns(spark.createDataFrame(sample(4), SCHEMA))
    paths = prefix_trie.prefix_paths(turns, turns.select("conv_id").distinct())
    found = prefix_trie.proven_single(paths, prefix_trie.count_min(paths))
    wrong = found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("single")).where("single AND n > 1")
    assert wrong.count() == 0 and found.where("single").count() > 0


def test_empty_table(spark, tmp_path):
    assert queries.op11_prefix_trie(spark, written(spark, [], tmp_path)).count() == 0


def test_equals_its_sql(spark, duck, small):
    name = "op11_prefix_trie"
    assert engines.compare(spark, duck, small, name, queries.QUERIES[name], sql.ORACLE_SQL[name]).startswith("OK")
