"""Operators over all documents: near copies, repeated strings, components, merged transforms."""

import numpy as np
import pytest

from cpdspark.llm import bwt_merge, near_dedup, substring_dedup
from cpdspark.llm.components import components
from cpdspark.llm.text_arrays import as_bytes
from tests.llm import brute

rng = np.random.default_rng(7)
WORDS = ["w%d" % i for i in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def edited(text, every, seed):
    words = text.split(" ")
    for i in range(seed % every, len(words), every):
        words[i] = f"e{seed}x{i}"
    return " ".join(words)


BASE = prose(300, 1)
NEAR = [
    (10, BASE), (11, BASE.upper()), (12, edited(BASE, 60, 5)), (13, edited(BASE, 60, 23)), (14, edited(edited(BASE, 60, 5), 70, 31)),
    (15, edited(BASE, 10, 2)), (3, BASE + " tail words here"), (20, "a b c"), (21, "A  b\tc"), (22, "a b"), (23, ""), (24, None), (25, " \n"),
    (None, BASE), (None, None), (30, prose(50, 9)), (30, prose(50, 9)), (31, prose(4, 3)), (32, prose(4, 3) + " x"), (33, "é É ü"), (34, "é É ü"),
]


@pytest.mark.parametrize("width", [4, 5])
def test_near_copies(documents, width):
    known = [(i, t) for i, t in NEAR if i is not None]
    want = brute.near_components(known, width)
    got = near_dedup.report(documents(NEAR, extra=True), width).collect()
    assert len(got) == len(NEAR)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_links_beside_the_hub(documents):
    """A bucket whose hub is like none of the others: their links are found in blocks."""
    common = prose(150, 40)
    group = [(i, common + " " + prose(48, 100 + i // 3) + f" z{i}") for i in range(30)]
    got = {r.doc_id: r.component_id for r in near_dedup.report(documents(group), 5).collect()}
    assert got == {i: c for i, (_, c) in brute.near_components(group, 5).items()}


def test_rows_that_share_an_id(documents):
    rows = [(1, prose(60, 1)), (2, prose(60, 2)), (3, prose(60, 1)), (3, prose(60, 2)), (4, prose(60, 4))]
    got = {(r.doc_id, r.component_id) for r in near_dedup.report(documents(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
    kept = near_dedup.deduplicate(documents(rows, extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and kept.columns == documents(rows, extra=True).columns


def test_sketches():
    a = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    b = np.concatenate([a[:3000], np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))])
    x, y = near_dedup.registers(a), near_dedup.registers(b)
    union = near_dedup.registers(np.unique(np.concatenate([a, b])))
    assert (near_dedup.merged(x, y) == union).all()
    j = near_dedup.estimate([(x < y).sum()], [(x == y).sum()], [(x > y).sum()], [len(a)], [len(b)])[0]
    assert abs(j - 3000 / len(np.unique(np.concatenate([a, b])))) < 0.15
    assert not near_dedup.registers(np.zeros(0, np.uint64)).any()


def test_bitmaps_never_exclude_a_link():
    for n in (1, 5, 60, 700, 9000):
        for shared in (0.5, 0.75, 0.88, 0.889, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * shared)], rng.integers(0, 1 << 63, len(a) - int(len(a) * shared)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 80 * (len(a) + len(b) - both)
            assert near_dedup.may_link(near_dedup.bitmap(a), near_dedup.bitmap(b), len(a), len(b), 80) or not linked
    half = a[:350]  # large sets fill the bitmap, and then it excludes little
    assert not near_dedup.may_link(near_dedup.bitmap(a[:700]), near_dedup.bitmap(half), 700, 350, 80)


def test_components(spark):
    links = [(5, 4), (4, 9), (9, 20), (7, 7), (30, 31), (31, 30), (40, 41), (41, 42), (42, 43), (43, 44), (44, 45)]
    got = {(r.a, r.b) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(5, 4), (9, 4), (20, 4), (31, 30), (41, 40), (42, 40), (43, 40), (44, 40), (45, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("n_shards", [1, 2, 5])
def test_merged_transforms(n_shards):
    """Interleave, common prefixes and intervals against a sort of all suffixes."""
    depth = 6
    strings = [[rng.integers(1, 4, rng.integers(0, 25)) for _ in range(4)] for _ in range(n_shards)]
    joined = [np.concatenate([np.append(s, 0) for s in group]) for group in strings]
    shards = [bwt_merge.Shard(j, depth) for j in joined]
    of, common, intervals = bwt_merge.merge(shards, depth)
    suffixes, string = [], 0
    for g, group in enumerate(strings):
        at = 0
        for s in group:
            for k in range(len(s) + 1):
                suffixes.append((tuple(s[k : k + depth]) if k + depth <= len(s) else (*s[k:], -1000 + string), g, at + k))
            at += len(s) + 1
            string += 1
    ordered = sorted(suffixes, key=lambda x: x[0])
    same = [0] + [next((i for i, (p, q) in enumerate(zip(a[0], b[0])) if p != q), depth) for a, b in zip(ordered, ordered[1:])]
    assert common.tolist() == same
    number = {}
    for g, shard in enumerate(shards):
        for position, interval in zip(shard.suffixes, intervals[g]):
            number[g, int(position)] = int(interval)
    groups = {}
    for key, g, position in suffixes:
        groups.setdefault(key, set()).add(number[g, position])
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)
    assert [g for _, g, _ in ordered if False] == [] and sorted(of.tolist()) == sorted(g for _, g, _ in suffixes)


PASSAGE = "A passage of well over one hundred bytes, which more than one document repeats word for word; it ends here, at last."
REPEATS = [
    (1, PASSAGE + " first"), (2, "before " + PASSAGE + " after"), (3, PASSAGE[:99]), (4, PASSAGE[5:] + PASSAGE[:60]), (5, "x" * 350), (6, "ab" * 200),
    (7, ""), (8, None), (9, "é" * 70), (10, "\U0001f600" * 30 + PASSAGE), (12, BASE), (13, BASE), (14, edited(BASE, 40, 3)), (15, PASSAGE * 3),
    *((i, prose(30, i) + PASSAGE[:70] + prose(30, i + 1)) for i in range(20, 40)),
]


@pytest.mark.parametrize("many", [substring_dedup.MANY, 3])
def test_repeated_strings(documents, monkeypatch, many):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "SHARD_SYMBOLS", 64)
    got = substring_dedup.report(documents(REPEATS, extra=True)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.without_repeats(REPEATS)


def test_repeated_windows_of_small_alphabets():
    """All windows of random strings over two letters, dealt as one bin."""
    base = "".join(rng.choice(["a", "b"], 400))
    texts = [(i, base[k : k + 220] + "".join(rng.choice(["a", "b"], 40)) + base[: 150 + i]) for i, k in enumerate(rng.integers(0, 200, 8))]
    parts = [(i, a) for i, t in texts for a in substring_dedup.anchors(as_bytes(t))]
    doc = np.concatenate([np.full(len(a[0]), i) for i, a in parts])
    first, count, place = (np.concatenate([a[k] for _, a in parts]).astype(np.int64) for k in (2, 3, 4))
    data = dict(texts)
    pieces = [as_bytes(data[d])[f : f + n - 1 + 100] for d, f, n in zip(doc, first, count)]
    p, w = substring_dedup.repeated_windows(doc, np.zeros_like(doc), first, place, pieces)
    got = {(int(doc[i]), int(first[i] + k)) for i, k in zip(p, w)}
    seen, want = set(), set()
    for i, t in texts:
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                want.add((i, k))
            seen.add(t[k : k + 100])
    assert got == want


def test_repeated_rows_and_ids(documents):
    rows = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (None, PASSAGE), (None, "short")]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.report(documents(rows)).collect())
    n = len(PASSAGE)
    assert got == sorted([("1", 0), ("1", 0), ("2", n), ("None", n), ("None", 0)])


def test_empty_tables(documents):
    assert near_dedup.report(documents([])).collect() == []
    assert near_dedup.deduplicate(documents([])).collect() == []
    assert substring_dedup.report(documents([])).collect() == []
