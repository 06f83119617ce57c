"""Near-duplicate components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tasteplane.llm import near_dedup
from tests.llm.fixtures import ROWS, documents


def shingle_set(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width):
    sets = [shingle_set(r[1], width) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), r[0] if not sets[i] else least.get(find(i))) for i, r in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(11)
    vocabulary = [f"W{i}x" for i in range(400)]
    rows, d = list(ROWS), 100
    for group in range(14):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 12, 60, 200]))
        for _ in range(rng.choice([1, 2, 5, 40 if group == 3 else 6])):
            copy = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0, 0.01, 0.02, 0.04, 0.06]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((d, "\n".join(copy) if d % 2 else " ".join(copy).upper(), "en", "s", 0, None, None))
            d += 1
    return rows


@pytest.mark.parametrize("block", [2_048, 8])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    out = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = documents(spark, rows)
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    want = {(d, c) for d, _, c in brute(rows, 5) if d == c}
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted({(r[0], r[1]) for r in rows if (r[0], r[0]) in want}, key=str)


def test_nothing_to_link(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    lone = near_dedup.near_duplicates(documents(spark, ROWS[:3])).collect()
    assert all(r.component_id == r.doc_id and r.kept for r in lone)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = pool[:270], pool[30:]
        errors.append((near_dedup.signature(a) == near_dedup.signature(b)).mean() - 240 / 300)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def least_names(n, links):
    parent = list(range(n))
    for x, y in links:
        a, b = parent[x], parent[y]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_a_block_is_decided_exactly():
    rng = np.random.default_rng(3)
    for trial in range(60):
        pool = rng.integers(0, 2**63, 80, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(50, 80), replace=False)) for _ in range(rng.integers(2, 40))]
        known = [bytes([rng.integers(0, 4)]) if trial % 2 else i for i in range(len(sets))]
        probe = [True] * len(sets) if trial % 3 else [bool(rng.integers(0, 2)) for _ in sets]
        held = [(i, j) for i in range(len(sets)) for j in range(i) if known[i] == known[j]]
        linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        asked = [(i, j) for i in range(len(sets)) for j in range(i) if (probe[i] or probe[j]) and linked(i, j)]
        got = near_dedup.spanning_links(sets, known, probe, 80)
        assert all(linked(i, j) for i, j in got) and len(got) < len(set(known))
        assert least_names(len(sets), held + got) == least_names(len(sets), held + asked)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Copies around the threshold, so a group falls into several components, over many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(150):
            copy = list(base)
            for at in rng.sample(range(120), rng.choice([2, 3, 4])):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((g * 1000 + i, " ".join(copy), "en", "s", 0, None, None))
    out = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows, 4)


def test_rows_of_one_doc_id_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(3, text), (5, f"{text} more"), (5, other), (None, f"{text} again"), (None, "some lone words of a row without name"), (7, "twice said"), (7, "twice said"), (8, None), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _id", "2 AS label", "3 AS _key", "4 AS _bits", "5 AS _rep", "6 AS fp")
    out = near_dedup.deduplicated(docs, width=5)
    assert out.columns == docs.columns
    want = [(3, text), (5, other), (7, "twice said"), (8, ""), (8, None), (None, rows[4][1])]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_filter_before_a_join_passes_all_wanted_keys(spark, monkeypatch):
    from tasteplane.llm import _shared

    rows, wanted = spark.range(3_000).selectExpr("if(id = 0, null, id) AS k", "id AS _bits"), spark.range(0, 3_000, 7).selectExpr("if(id = 0, null, id) AS w")
    for bits, most in ((_shared._FILTER_BITS, 435), (1 << 10, 3_000)):
        monkeypatch.setattr(_shared, "_FILTER_BITS", bits)
        got = {r.k for r in _shared.may_be_in(rows, "k", wanted, "w").collect()}
        assert {None, *range(7, 3_000, 7)} <= got and len(got) <= most


def test_buckets_whose_members_hash_to_one_sum_stay_apart(spark):
    rng = random.Random(2)
    sums = []
    for group in range(2):  # 40-bit remainders, of which a sum of two is soon met again in the other group
        base = " ".join(f"g{group}w{rng.randrange(10**6)}" for _ in range(200))
        texts = [f"{base} {i}" for i in range(3_000)]
        h = np.array([xxhash.xxh64_intdigest(xxhash.xxh3_128_digest(t.encode()), seed=42) for t in texts], np.uint64).view(np.int64)
        one, two = np.triu_indices(len(h), 1)
        part = np.fmod(h, 1 << 40)
        sums.append((texts, one, two, part[one] + part[two]))
    (texts, a, b, s), (others, c, d, t) = sums
    _, i, j = np.intersect1d(s, t, return_indices=True)
    assert len(i)
    corpus = [texts[a[i[0]]], texts[b[i[0]]], others[c[j[0]]], others[d[j[0]]]]
    out = near_dedup.near_duplicates(documents(spark, [(k, x, "en", "s", 0, None, None) for k, x in enumerate(corpus)])).collect()
    assert {r.doc_id: r.component_id for r in out} == {0: 0, 1: 0, 2: 2, 3: 2}


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("at_once", [near_dedup.BROADCAST_ROWS, 0])
def test_components_of_chains(spark, monkeypatch, at_once):
    """A small graph takes few jobs however long its paths; a large one is joined in tables, to the same components."""
    monkeypatch.setattr(near_dedup, "LINKS_AT_ONCE", at_once)
    name = [bytes([i // 200, (i * 77 + 13) % 200]) for i in range(400)]
    links = [(name[i], name[i + 1]) for i in range(398) if i != 199]
    table = lambda rows: spark.createDataFrame(rows, "a binary, b binary")
    (first, n) = jobs_of(spark, f"chains-{at_once}", lambda: near_dedup.components(table(links[::2]), None))
    assert at_once == 0 or n <= 4
    labels = {bytes(r.node): bytes(r.label) for r in near_dedup.components(table([*links[1::2], links[1]]), first).collect()}
    assert labels == {x: min(name[:200] if x in name[:200] else name[200:399]) for x in name[:399]}
    assert near_dedup.components(table([]), None).count() == 0


def test_links_of_large_graphs_are_joined_in_tables(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LINKS_AT_ONCE", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = corpus()
    out = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows, 4)
