"""Near-duplicates against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from tickloom.llm import neardup


def truth(rows, size):
    sets, parent = {}, {k: k for k, _ in rows}
    for k, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for k in sorted(sets):
        for other, common in collections.Counter(o for s in sets[k] for o in holders[s]).items():
            if 100 * common >= 80 * (len(sets[k]) + len(sets[other]) - common):
                a, b = find(k), find(other)
                parent[max(a, b)] = min(a, b)
        for s in sets[k]:
            holders[s].append(k)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_components(spark, size):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    bases = [[draw.choice(words) for _ in range(draw.randint(1, 200))] for _ in range(60)]
    rows = []
    for i in range(900):
        w = list(draw.choice(bases) if draw.random() < 0.6 else bases[0])
        for _ in range(draw.randint(0, max(1, len(w) // 40))):
            w[draw.randrange(len(w))] = draw.choice(words)
        rows.append((i, " ".join(w).upper() if draw.random() < 0.1 else " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "  "), (2003, "a"), (2004, "A"), (2005, "a b")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, n int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, size).collect()}
    assert got == truth(rows, size)


def test_branching_nodes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 3)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[draw.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(w)))
    classes = neardup.sketches(neardup.keyed(spark.createDataFrame(rows, "doc_id long, text string")), 5)
    leaves = neardup.nodes(classes, node=3)
    links = neardup.candidate_links(leaves, classes, 0.8)
    assert neardup.connected(links).select("root").distinct().count() == 1


def test_exact_search_with_bits_and_with_postings(monkeypatch):
    draw = np.random.default_rng(1)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([draw.choice(base, 90, replace=False), draw.integers(1000, 1100, 5).astype(np.uint64)])) for _ in range(30)] + [np.array([7], np.uint64)]
    first = neardup.confirm(sets, 80, 100)
    monkeypatch.setattr(neardup, "BITS", 0)
    assert neardup.confirm(sets, 80, 100) == first and len(set(first)) > 1


def test_clusters_and_nodes_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20_000)
    monkeypatch.setattr(neardup, "CLASSES", 20)
    seen = []
    whole = neardup.in_blocks
    monkeypatch.setattr(neardup, "in_blocks", lambda *a: seen.append(a[0].count()) or whole(*a))
    draw = random.Random(6)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):  # a cluster of near copies, of a chain, and of sets that sketches pass and the exact test splits
        w = list(base)
        for k in draw.sample(range(120), 1 if i < 60 else 3):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    for i in range(40):
        rows.append((1000 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert seen and seen[0] >= 150 and got == truth(rows, 5) and len({c for _, c, _ in got.values()}) > 2


def test_empty_and_kept(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, text), (1, text), (2, text + " x"), (9, None), (None, "q")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in neardup.without_near_duplicates(df).collect()) == ["1", "9", "None"]


def test_component_of_a_null_id_is_null(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (5, text + " x")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()} == {(None, None, True), (5, None, False)}
