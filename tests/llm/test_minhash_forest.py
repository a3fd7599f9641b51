"""Near copies among documents of one template, whose sketches crowd the true partners out."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import minhash_forest


def _templated(n: int, pairs: int) -> list[tuple[int, str]]:
    """n texts of 140 common words and 20 others: 0.778 alike, and in the first `pairs` twos 3 words more, 0.808 alike."""
    common = [f"t{k}" for k in range(140)]
    rows = []
    for i in range(n):
        other = [f"d{i}w{k}" for k in range(20)]
        if i < 2 * pairs:
            other[:3] = [f"p{i // 2}w{k}" for k in range(3)]
        rows.append((i, " ".join(common + other)))
    return rows


def test_templates_do_not_hide_pairs(spark):
    docs = spark.createDataFrame(_templated(600, 60), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs, shingle=1, percent=80).collect()}
    lost = [i for i in range(120) if got[i] != i - i % 2]
    # The sketch bound and the regions may lose about 1e-4 of such pairs, so none of 60.
    assert not lost and all(got[i] == i for i in range(120, 600))


def test_large_regions_are_compared_whole(spark):
    docs = spark.createDataFrame(_templated(300, 60), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs, shingle=1, percent=80, region_rows=20).collect()}
    assert not [i for i in range(120) if got[i] != i - i % 2] and all(got[i] == i for i in range(120, 300))


def _families(n: int, seed: int = 4) -> list[tuple[int, str]]:
    """n texts in families of near copies from two to hundreds, some just above and some just below the threshold, and single ones."""
    draw, rows = random.Random(seed), []
    while len(rows) < n:
        size = draw.choice([1, 1, 2, 2, 3, 5, 20, 300])
        base = [f"f{len(rows)}w{k}" for k in range(draw.choice([12, 60, 200]))]
        rate = draw.choice([0.01, 0.03, 0.05, 0.07])
        for _ in range(size):
            rows.append((len(rows), " ".join(w if draw.random() > rate else f"x{draw.randrange(10**9)}" for w in base)))
    draw.shuffle(rows)
    return rows


def _brute(rows, size, percent):
    """Least id of each row's component, by all pairs that share a shingle."""
    sets, held = {}, defaultdict(list)
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        for g in sets[i]:
            held[g].append(i)
    label = {i: i for i, _ in rows}

    def find(a):
        while label[a] != a:
            label[a] = label[label[a]]
            a = label[a]
        return a

    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in held[g] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: find(i) for i in label}


@pytest.mark.parametrize(("size", "percent", "region_rows"), [(3, 85, 4096), (5, 80, 4096), (5, 80, 60)])
def test_thousands_of_near_copies_in_many_families(spark, size, percent, region_rows):
    rows = _families(4000)
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, percent=percent, region_rows=region_rows).collect()}
    want = _brute(rows, size, percent)
    lost = [i for i in want if got[i] != want[i]]
    # Recall of components: nothing is linked that should not be, and nothing is lost but by a chance of 4e-5 a pair.
    assert len(lost) == 0, (len(lost), len(rows))


def test_links_of_one_task_join_all_that_is_linked():
    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in (0, 2, 4, 100, 102, 300)]
    a, b = minhash_forest._links(np.arange(6), np.arange(6), np.full(6, -1), sets, 80)
    joined = Counter()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        joined[x] += 1
        joined[y] += 1
    assert sorted(joined) == [0, 1, 2, 3, 4] and len(a) == 3
