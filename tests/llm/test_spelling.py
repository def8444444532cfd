import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import same_rows

from turnweave.llm import queries, spelling
from turnweave.llm.common import table

DOCS = "doc_id long, text string, word string, n string, sig int, form string"
LOW = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, "clash") for i, t in rows], DOCS)


def brute(rows, every=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return brute_forms({w: k for w, k in n.items() if len(w) >= 6 and k >= 5})


def brute_forms(n):
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for ws in holes.values():
        for w in ws:
            near[w] |= ws - {w}
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * k else None
    out = []
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, k, len(near[w]), n[form[w]] if form[w] else None))
    return pd.DataFrame(out, columns=["word", "form", "root", "n", "n_near", "form_n"])


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert want.n_near.sum() > 0
    same_rows(want, queries.op13_spelling_trees(spark, sf_dir).toPandas())


@pytest.fixture
def small(monkeypatch):
    """Small leaves, buckets, samples and deals, so that few words part as many do."""
    for name, value in {"SAMPLE": 60, "LEAF": 8, "FITTED": 4, "BUCKET": 3, "QUERIES": 40}.items():
        monkeypatch.setattr(spelling, name, value)


def words_of(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


@pytest.mark.parametrize("seed", range(2))
def test_dense_words(spark, small, seed):
    """Words over three letters, one of them not ASCII, and with many of the same letters: near pairs of every kind."""
    r = random.Random(seed)
    n = {"".join(r.choice("abé") for _ in range(r.randint(6, 8))): r.randint(5, 4000) for _ in range(700)}
    got = spelling.near_words(words_of(spark, n)).toPandas()
    assert not got.duplicated(["word", "other"]).any()
    want = brute_forms(n)
    assert dict(got.groupby("word").size()) == {w: k for w, k in zip(want.word, want.n_near) if k}
    assert all(n[a] == b for a, b in zip(got.other, got.other_n))


@pytest.mark.parametrize("radius", [1, 2])
def test_range_search(radius):
    r = np.random.default_rng(radius)
    points, queries_ = (r.integers(0, 3, (m, spelling.DIMS)) * (r.random((m, spelling.DIMS)) < 0.06) for m in (300, 200))
    queries_[:100] = points[:100]
    queries_[np.arange(100), r.integers(0, spelling.DIMS, 100)] += 1
    if radius == 2:
        queries_[np.arange(100), r.integers(0, spelling.DIMS, 100)] += 1
    wants = {(a, b) for a in range(200) for b in range(300) if abs(queries_[a] - points[b]).sum() == radius and abs(queries_[a] - points[b]).max() == 1}
    got = set(zip(*spelling.within(points, queries_, radius), strict=True))
    assert len(wants) > 20
    assert {x for x in wants if (queries_[x[0]].sum() - points[x[1]].sum()) % 2 == radius % 2} <= got
    assert all(abs(queries_[a] - points[b]).sum() == radius for a, b in got)


def test_regions_lose_nothing():
    r = random.Random(3)
    words = sorted({"".join(sorted(r.choice("abcdefgh") for _ in range(7))) for _ in range(400)})
    v = spelling.vectors(words)
    tree = spelling.Regions(v[::3], 5, 10)
    rows, leaves = tree.reach(v, 0)
    assert sorted(rows) == list(range(len(v)))
    home = dict(zip(rows, leaves))
    assert set(home.values()) <= set(range(10, 10 + tree.leaves)) and tree.leaves > 8
    reached = set(zip(*tree.reach(v, 2), strict=True))
    for a in range(len(v)):
        for b in range(len(v)):
            if abs(v[a] - v[b]).sum() <= 2:
                assert (a, home[b]) in reached


def test_chains_and_ties(spark, tmp_path):
    words = ["aaaaaa"] * 3125 + ["aaaaab"] * 625 + ["aaaabb"] * 125 + ["aaabbb"] * 25 + ["aabbbb"] * 5
    words += ["zzzzzza"] * 30 + ["zzzzzzb"] * 30 + ["zzzzzz"] * 6 + ["Zzzzzz c"] * 1 + ["straße"] * 50 + ["strase"] * 10 + ["ÉCOLESX"] * 5 + ["École"] * 9
    docs = [(i, " ".join(words[i::7])) for i in range(7)]
    got = spelling.variants(docs_of(spark, docs), every=10**9).toPandas()
    same_rows(brute(docs, 10**9), got)
    by = got.set_index("word")
    assert by.root["aabbbb"] == "aaaaaa" and by.form["aabbbb"] == "aaabbb"


def test_letter_left_out(spark):
    docs = [(i, "Wonderful, wonderful; Señora_wönderful " * 3) for i in range(300)] + [(None, "wonderful")]
    same_rows(brute(docs), spelling.variants(docs_of(spark, docs)).toPandas())


def test_hot_letters(spark, small):
    """A third of all words are made of the same letters: they are no pairs of each other, and are dealt out to their neighbours."""
    r = random.Random(5)
    n = {"".join(r.sample("abcdefgh", 8)): 5 for _ in range(900)}
    n |= {w[:3] + r.choice("xyz") + w[4:]: 30 for w in list(n)[:300]}
    n |= {w[:5] + w[6:]: 200 for w in list(n)[:200]}
    got = spelling.near_words(words_of(spark, n)).groupBy("word").count().toPandas()
    want = brute_forms(n)
    assert dict(zip(got.word, got["count"])) == {w: k for w, k in zip(want.word, want.n_near) if k}


def test_edges(spark):
    assert spelling.variants(docs_of(spark, [])).collect() == []
    assert spelling.variants(docs_of(spark, [(1, None), (2, ""), (3, "a b c")])).collect() == []
    long, longer = "ab" * 1200, "ab" * 1200 + "c"
    docs = [(1, f"{long} {longer} " * 5), (1, f"{long} {longer} " * 5), (2, "x" * 70_000 + " 語" * 10)] * 3
    same_rows(brute(docs, 10**9), spelling.variants(docs_of(spark, docs), every=10**9).toPandas())
