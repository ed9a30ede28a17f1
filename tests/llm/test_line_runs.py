"""Maximal runs and long single lines of line dedup against brute force."""

import random

import pytest

from haulmark.llm import line_dedup
from test_brute_force import docs_of, key, plain_line_dedup


def texts(seed):
    """Texts that end in the middle of shared runs, so that a run must not go on in the next text."""
    rng = random.Random(seed)
    shared = [f"line {k}" for k in range(9)]
    rows = []
    for i in range(50):
        at = rng.randrange(9)
        lines = [f"own {rng.randrange(6)}" for _ in range(rng.randrange(3))] + shared[at : at + rng.randrange(1, 10)] * rng.choice([1, 1, 2])
        rows.append((i, "\n".join(lines + ["same"] * rng.randrange(4)), "a"))
    return [*rows, (50, None, "a"), (51, "", "a"), (None, rows[7][1], "a"), (7, rows[7][1], "a")]


@pytest.mark.parametrize(("seed", "min_lines"), [(1, 2), (2, 2), (3, 3), (4, 1)])
def test_runs_are_maximal_and_cover_all_later_copies(spark, seed, min_lines):
    rows = texts(seed)
    docs = sorted({(i is not None, i or 0, key(t), t) for i, t, _ in rows if t is not None})
    ids, ends = [], []
    for *_, t in docs:
        held = [line for line in t.split("\n") if line]
        ends += [len(ids) + len(held)] * len(held)
        ids += held

    def common(a, b):
        n = 0
        while a + n < ends[a] and b + n < ends[b] and ids[a + n] == ids[b + n]:
            n += 1
        return n

    longest = [max((common(q, p) for q in range(p)), default=0) for p in range(len(ids))]
    levels = line_dedup.doubling_levels(line_dedup.line_table(docs_of(spark, rows)))
    runs = line_dedup.repeated_runs(levels, min_lines).collect()
    assert runs and len({r.pos for r in runs}) == len(runs)
    for r in runs:
        assert r.source < r.pos and r.length == common(r.source, r.pos) >= min_lines
    covered = {p for r in runs for p in range(r.pos, r.pos + r.length)}
    assert covered == {p + k for p, n in enumerate(longest) if n >= min_lines for k in range(n)}


def test_long_lines_go_alone(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49))
    rows = [(1, long, "a"), (2, f"x\n{long}\ny", "a"), (3, short, "a"), (4, f"{short}\n \n{long}", "a"), (5, f"{long}\n\n{long}\nx\nz", "b"), (6, f"{long} ", "a"), (None, long, "a"), (7, f"x\n{long}\ny", "a")]
    expected = plain_line_dedup([r for r in rows if r[0] is not None])
    first = plain_line_dedup([(0, long, "a")] + [r for r in rows if r[0] is not None])
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(docs_of(spark, rows)).collect()}
    # A null id comes first in order, so its copy is the one that stays.
    assert got == {None: long} | {i: t for (i, _), t in first.items() if i != 0}
    assert got[1] == "" and got[2] == "x\ny" and got[3] == short and got[6] == f"{long} "
    assert expected[1, long] == long
