import hashlib
import random
import zlib

import pandas as pd
import pytest
from conftest import same_rows

from turnweave.llm import prefixes, queries
from turnweave.llm.common import table

ROWS = "conv_id long, turn long, role string, text string, depth string, block int, id string, part int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 1) for r in rows], ROWS)


def brute(rows):
    """The contract read plainly: every prefix of every rebuilt conversation in a dictionary."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    key = lambda x: hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()[:12] + len(x[3].encode()).to_bytes(4, "big")
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], key(x)))] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, below = {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        w, leaf = ((len(m) - 1) * len(p[-1][1].encode()) if p else 0), p not in kids
        for d in range(len(p) + 1):
            a, b = below.get(p[:d], (0, 0))
            below[p[:d]] = a + w, b + leaf
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), below[p][1], below[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return pd.DataFrame(out, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def compare(spark, rows):
    same_rows(brute(rows), prefixes.rebuilt_trie(rows_of(spark, rows)).toPandas())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    same_rows(brute(rows), queries.op11_prefix_rollup(spark, sf_dir).toPandas())


@pytest.fixture
def few(monkeypatch):
    """Short stretches and pieces, so that small tables reach what large ones do."""
    monkeypatch.setattr(prefixes, "REACH", 2)
    monkeypatch.setattr(prefixes, "PIECE", 3)


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed, few):
    r = random.Random(seed)
    rows = []
    for c in [*r.sample(range(-30, 90), 60), 10**12, 10**12 + 1]:
        for t in range(r.choice([1, 2, 3, 8, 9, 16, 17, 24, 40])):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(["a", "b", None, "é"]) if r.random() < 0.2 else f"turn {t}"))
    compare(spark, rows)


def test_hot_prefix_and_copies(spark, few):
    rows = [(c, t, "user", f"common {t}") for c in range(60) for t in range(3)]
    rows += [(c, t, "user", f"common {t}" if t < 12 else f"{c} {t}") for c in range(100, 110) for t in range(20)]
    rows += [(200, 1, "user", "again")] * 70
    compare(spark, rows)


def test_edges(spark):
    assert prefixes.rebuilt_trie(rows_of(spark, [])).collect() == []
    compare(spark, [(None, 1, "user", "nobody's"), (7, None, None, None), (7, None, None, None), (8, 1, "", "x" * 200_000), (5, 1, "user", "")])
    # conversation 1 takes nothing from 0, which is absent, and loses its only turn: a root alone
    only = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    compare(spark, [(only, 1, "user", "gone")])


def test_roles_and_texts_do_not_run_together(spark):
    compare(spark, [(20, 1, "ab", "c"), (25, 1, "a", "bc"), (30, 1, "", "abc"), (35, 1, None, "abc")])
