import random

import pytest
from pyspark.sql import functions as F

from turnweave.llm import align, near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, class_id int"


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j - 1] + (x != y), p[j] + 1, q[-1] + 1))
        p = q
    return p[-1]


def test_banded_alignment_is_edit_distance():
    r = random.Random(1)
    for _ in range(4000):
        a = [r.randint(0, r.choice([2, 5, 30])) for _ in range(r.randint(0, 25))]
        b = list(a)
        for _ in range(r.randint(0, 8)):
            i = r.randint(0, len(b))
            b[i : i + r.randint(0, 1)] = [r.randint(0, 5)] * r.randint(0, 1)
        t = r.randint(0, 10)
        assert align.within(a, b, t) == (distance(a, b) <= t)


def words(r, n):
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def test_classes_of_planted_copies(spark):
    r = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        base = words(r, r.randint(60, 200))
        for c in range(r.randint(1, 5)):
            own = list(base)
            for _ in range(len(own) // 30 * (c > 1)):
                own[r.randrange(len(own))] = f"x{r.randint(0, 99)}"
            want[len(rows)] = g
            rows.append((len(rows), " ".join(own), "en", None, 1, "clash", 7))
    long_one = " ".join(words(r, 20_000))
    edge = [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, "one two"), (1005, "one two"), (1006, "one three"), (1007, long_one), (1008, long_one + " end"), (1009, "same " * 300), (1009, "same " * 300), (None, "only here is no id at all today"), (None, "another text without any id of its own"), (1010, " ".join(words(r, 80)))]
    rows += [(i, t, None, None, None, "clash", 7) for i, t in edge]
    got = near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    of = {}
    for x in got:
        of.setdefault(x.doc_id, x.class_id)
    for i, g in want.items():
        assert of[i] == min(j for j in want if want[j] == g)
    assert [of[i] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007, 1008, 1009, None, 1010)] == [1000, 1001, 1002, 1002, 1004, 1004, 1006, 1007, 1007, 1009, None, 1010]
    kept = near_dedup.kept(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == sorted({of[i] for i in want} | {1000, 1001, 1002, 1004, 1006, 1007, 1009, 1010}) + [None, None]


def test_alike_texts_among_many_with_one_template(spark):
    r = random.Random(8)
    template, rows = words(r, 120), []
    for g in range(900):
        own = words(r, 60)
        for second in range(1 + (g < 60)):
            text = template + own
            for i in r.sample(range(120, 180), 30 * second):
                text[i] = f"x{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(text), None, None, None, "clash", 7))
    of = {x.doc_id: x.class_id for x in near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert [g for g in range(60) if of[2 * g] != of[2 * g + 1]] == []
    assert len(set(of.values())) == 900


def changed(r, text, n, middle=False):
    own = list(text)
    for i in [len(own) // 2] if middle else r.sample(range(len(own)), n):
        own[i] = f"x{r.randint(0, 9999)}"
    return own


@pytest.mark.parametrize(("n", "edits", "least"), [(5, 0, 150), (7, 0, 150), (9, 0, 150), (11, 2, 149), (15, 3, 149), (45, 9, 149), (300, 60, 145), (300, 54, 148), (300, 45, 150)])
def test_pairs_near_the_limit_agree_in_a_sketch(n, edits, least):
    r = random.Random(n + edits)
    of = lambda text: set(near_dedup.bands(near_dedup.wordhash.words([" ".join(text).encode()]).hash).tolist())
    pairs = [(x, changed(r, x, edits, not edits)) for x in (words(r, n) for _ in range(150))]
    assert sum(bool(of(x) & of(y)) for x, y in pairs) >= least


@pytest.mark.parametrize("n", [20, 45, 50, 100, 300, 1000])
def test_every_fifth_word_changed(n):
    """The hardest pairs that are links: no run of five words is left."""
    r = random.Random(n)
    of = lambda text: set(near_dedup.bands(near_dedup.wordhash.words([" ".join(text).encode()]).hash).tolist())
    pairs = [(x, [f"x{r.randint(0, 9999)}" if i % 5 == 4 else w for i, w in enumerate(x)]) for x in (words(r, n) for _ in range(150))]
    assert all(near_dedup.align.within(x, y, n // 5) for x, y in pairs[:5])
    assert sum(bool(of(x) & of(y)) for x, y in pairs) >= 145


def test_classes_are_held_together_by_links(spark, sf_dir):
    """No class has a part that no link between different texts, or equal text, joins to the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    classes = {}
    for r in near_dedup.classes(docs).collect():
        classes.setdefault(r.class_id, []).append(r.doc_id)
    for members in classes.values():
        left, reached = set(members[1:]), [members[0]]
        for a in reached:
            x = text[a]
            for b in sorted(left):
                y = text[b]
                if x == y or near_dedup.align.within(x, y, int(0.2 * max(len(x), len(y)) + 1e-9)):
                    left.discard(b)
                    reached.append(b)
        assert not left, (members, left)
    assert any(len(m) > 2 for m in classes.values())


def test_planted_pairs_near_the_limit(spark):
    r = random.Random(4)
    pairs = [(x, changed(r, x, int(n * 0.18), n < 10)) for n in (5, 7, 11, 20, 44, 49, 120, 300) for x in (words(r, n) for _ in range(20))]
    rows = [(i, " ".join(t), None, None, None, "clash", 7) for i, t in enumerate(t for p in pairs for t in p)]
    of = {x.doc_id: x.class_id for x in near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(of[2 * i] == of[2 * i + 1] for i in range(len(pairs))) >= len(pairs) - 3


def test_empty_table(spark):
    assert near_dedup.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_no_link_of_the_table_is_missed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    of = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    rows = [(r.doc_id, r.text.split()) for r in docs.collect()]
    links = 0
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            n = max(len(x), len(y))
            if min(len(x), len(y)) >= max(5, 0.8 * n) and align.within(x, y, int(0.2 * n + 1e-9)):
                links += 1
                assert of[a] == of[b], (a, b)
    assert links


@pytest.mark.parametrize("n", [3, 40])
def test_components(spark, n):
    from turnweave.llm.graph import components

    r = random.Random(n)
    pairs = [(r.randint(0, n * 2), r.randint(0, n * 2)) for _ in range(n)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).where(F.col("node") != F.col("root")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
