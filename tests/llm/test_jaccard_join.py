import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagesieve.llm import jaccard_join as J
from pagesieve.llm.components import components
from tests.llm import common as C


def brute(rows, threshold=0.8):
    """(class, copies, links, group) by key and text, all pairs compared."""
    classes = defaultdict(list)
    for k, t in rows:
        classes[t or ""].append(k)
    least = {t: min((k for k in ks if k is not None), default=None) for t, ks in classes.items()}
    sets = {}
    for t in classes:
        w = C.words(t)
        sets[t] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links, root = Counter(), {t: t for t in classes}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    texts = list(classes)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and small >= threshold * large - 1e-9:
                common = len(sets[a] & sets[b])
                if common >= threshold * (small + large - common) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    root[top(a)] = top(b)
    groups = defaultdict(list)
    for t in texts:
        if least[t] is not None:
            groups[top(t)].append(least[t])
    return Counter((k, least[t], len(ks), links[t], min(groups[top(t)], default=None)) for t, ks in classes.items() for k in ks)


def result(docs):
    return Counter(C.rows(J.near_duplicates(docs), "doc_id", "class_id", "n_copies", "n_links", "group_id"))


def variants(n, seed=3, size=200):
    """Texts that differ from one text, or from each other, by a few words: links and chains."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            words[rng.randrange(size)] = f"x{i}"
        rows.append((i, " ".join(words)))
        if rng.random() < 0.1:
            base[rng.randrange(size)] = f"y{i}"
    return rows


def test_whole_table(spark):
    docs = C.documents(spark)
    assert result(docs) == brute(C.rows(docs, "doc_id", "text"))


@pytest.mark.parametrize(("tile", "whole"), [(256, 4096), (16, 4096), (16, 4)])
def test_large_groups(spark, monkeypatch, tile, whole):
    """The same links in one tile, over many, and by bands."""
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "WHOLE", whole)
    rows = variants(120) + [(1000 + i, f"nothing like it {i}") for i in range(20)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    odd = C.odd_documents(spark)
    assert result(odd) == brute(C.ODD_ROWS)
    assert J.near_duplicates(C.no_documents(spark)).count() == 0
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(k for (k,) in C.rows(kept, "doc_id")) == Counter({1: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1, None: 2})
    assert J.keep_one(C.no_documents(spark)).count() == 0


def test_keeps_one_of_each_group(spark):
    rows = variants(60) + [(500, "alone in the world it stands"), (501, "alone in the world it stands")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {g for _, _, _, _, g in brute(rows)}
    assert sorted(k for (k,) in C.rows(J.keep_one(docs), "doc_id")) == sorted(want)


def led(rows):
    """(key, text) of the row that leads each group: least key, a missing one last. Keys may recur; groups are told apart by texts."""
    numbered = brute(list(enumerate(t for _, t in rows)))
    groups = defaultdict(list)
    for i, _, _, _, g in numbered:
        groups[g].append(rows[i])
    return [min(members, key=lambda r: (r[0] is None, r[0] or 0)) for members in groups.values()]


def test_one_key_on_many_texts(spark):
    """Every text of a key that recurs is judged by its own group."""
    apart = [(7, f"text {i} " + " ".join(f"t{i}x{j}" for j in range(40))) for i in range(30)]
    copies = [(100 + i, t) for i, (_, t) in enumerate(apart[:10])] + [(i - 10, t + " more") for i, (_, t) in enumerate(apart[10:15])]
    rows = apart + copies + apart[:3]
    got = C.rows(J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text")
    assert sorted(got) == sorted(led(rows)) and len(got) == 30


def test_missing_keys_on_equal_texts(spark):
    """Rows without a key take part: copies go, and give way to a row that has a key."""
    base = " ".join(f"w{j}" for j in range(60))
    rows = [(None, base)] * 5 + [(None, "alone here")] + [(3, "with a key")] + [(None, "with a key")] * 4 + [(None, base + " end")]
    got = C.rows(J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text")
    assert Counter((k, t.removesuffix(" end")) for k, t in got) == Counter([(None, base), (None, "alone here"), (3, "with a key")])


def test_products_count_what_intersections_count():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 60, 400, dtype=np.uint64)
    grams = [np.unique(rng.choice(pool, rng.integers(250, 390), replace=False)) for _ in range(40)]
    p, q = np.triu_indices(40, 1)
    some = J.linked(grams, (p, q), 0.6)
    one = [(i, j) for i, j in zip(p.tolist(), q.tolist(), strict=True) if len(J.linked(grams, (np.array([i]), np.array([j])), 0.6)[0])]
    assert list(zip(*(x.tolist() for x in some), strict=True)) == one and one


def test_pruning_keeps_what_reaches_the_threshold():
    needed = J.least_matches(0.8)
    assert needed == sorted(needed) and 0 <= needed[0] and needed[-1] < 0.8 * J.HASHES
    rng = np.random.default_rng(4)
    family, lost = J._hash_family(), 0
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, 450, dtype=np.uint64))
        a, b = x[:405], np.concatenate([x[:360], x[405:450]])
        sigs = np.stack([J.signature(a, family), J.signature(b, family)])
        lost += not len(J.surviving(sigs, sigs, (np.array([0]), np.array([1])), needed)[0])
    assert lost == 0
    apart = np.stack([J.signature(rng.integers(0, 1 << 63, 300, dtype=np.uint64), family) for _ in range(2)])
    assert not len(J.surviving(apart, apart, (np.array([0]), np.array([1])), needed)[0])


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = dict(C.rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
