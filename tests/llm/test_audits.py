"""Filter audit and source divergence against plain counting, and the pointer sort against sorted()."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from cpdspark.llm import filter_audit, source_divergence, term_sort
from tests.llm import brute

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(rng, words):
    return " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    few, many = ["Ab", "b", "é#"], [f"w{k}" for k in range(500)]
    texts = [None, "", "x", "A" * 5000, "a\tb\n" * 150, "ü" * 30000, "$"]
    texts += [text_of(rng, w) for w in (few, many, many, few + many) for _ in range(12)]
    out = [(rng.choice([i, i, i, None, 3]), rng.choice(texts), "en", rng.choice(["s", "t", None, ""]), 0) for i in range(400)]
    return out + out[:5]


def audit_brute(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, _, source, _ in rows:
        t = t or ""
        w = brute.SPACE_WORDS.findall(t)
        capitals = len(re.findall("[A-Z]", t))
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * capitals > 2 * len(t), bool(re.search(r"[#$%&*|]", t)))
        parts[source or ""].append(((*fails, i is not None and i > least[t]), i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shares = Counter()
        for order in permutations(range(5)):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                alone = sum(d[0][f] and sum(d[0]) == 1 for d in docs)
                before = sum(d[0][f] for d in docs) - len(gone)
                shares[f] += len(gone)
                out[part, "".join("ABCDE"[i] for i in order), step] = [len(left), len(gone), before, alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shares[v[-1]]
    return out


def test_filter_audit(spark, rows):
    labels = [(i, i % 2, None if i % 5 else 1) for i in range(0, 400, 2)] + [(None, 1, 1), (4, 1, 1), (4, None, None)]
    df = spark.createDataFrame(rows, TABLE)
    for name in ("part", "mask", "n", "good", "digest", "words", "quality", "f"):
        df = df.withColumn(name, df.lang)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as n", "'x' as text", "2 as part")
    got = filter_audit.audit(df.repartition(3), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    have = {(r.part, r.filter_order, r.step): list(r[3:]) for r in got.collect()}
    want = audit_brute(rows, labels)
    assert len(have) == 600 * len({r[3] or "" for r in rows}) and have == want


def test_filter_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], TABLE), labels).collect() == []


def test_shapley_is_exact():
    rng = random.Random(8)
    counts = {m: rng.randint(0, 10**12) for m in range(32)}
    removed = filter_audit.coalition_removals(counts)
    want = [0] * 5
    for order in permutations(range(5)):
        before = 0
        for f in order:
            want[f] += removed[before | 1 << f] - removed[before]
            before |= 1 << f
    assert [x * 120 for x in filter_audit.shapley(removed)] == want


@pytest.mark.parametrize("leaf", [3, 40, 1 << 14])
def test_sort_words(monkeypatch, leaf):
    monkeypatch.setattr(term_sort, "LEAF", leaf)
    rng = random.Random(leaf)
    for longest in (1, 3, 8, 9, 40):
        words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, longest))).encode() for _ in range(600)]
        words += [b"a" * 8, b"a" * 16, b"a" * 17, b"a" * 16, "é".encode() * 4] * 3
        starts = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
        ends = starts + np.array([len(w) for w in words])
        order, new = term_sort.sort_words(term_sort.padded(np.frombuffer(b" ".join(words), np.uint8)), starts, ends)
        want = sorted(range(len(words)), key=lambda i: (words[i], i))
        assert order.tolist() == want
        assert new.tolist() == [i == 0 or words[want[i - 1]] != words[want[i]] for i in range(len(want))]


def divergence_brute(rows, least=10, top=10):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source, _ in rows:
        words = find(brute.ascii_lower(t or ""))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        every = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(counts[lang, s]) for s in sources}, share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = [rng.choice(["Wort", "mot", "é", "PALABRA", "x" * 9]) + chr(97 + k % 26) + chr(97 + k // 26 % 26) for k in range(120)]
    rows = []
    for i in range(700):
        bias = rng.randint(1, 110)
        text = " ".join(rng.choice(words[:bias]) for _ in range(rng.randint(0, 60)))
        rows.append((i, rng.choice([text, text, text, None, "", "12 3!", text + "9" + text]), rng.choice(["en", "de", None, "en"]), rng.choice(["a", "b", "cé", None, "", "z" * 40]), 0))
    rows += [(None, "only here", "fr", "a", 0), (None, None, "fr", "b", 0), (1, "", "es", "a", 0), (2, "same same", "it", "a", 0)]
    rows += [(5, "hot words go on " * 200, "en", "a", 0)] * 40 + rows[:3]
    rows.append((9, "longword" * 30000 + " b" * 100000, "de", "b", 0))
    return rows


def test_source_divergence(spark, corpus):
    df = spark.createDataFrame(corpus, TABLE)
    for name in ("term", "n", "docs", "total", "p", "block", "item", "rank"):
        df = df.withColumn(name, df.lang)
    got = source_divergence.audit(df.repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == divergence_brute(corpus)


def test_source_divergence_in_tiles(spark, monkeypatch):
    """Blocks of sources and buckets of terms, terms that a tile's sources lack, several shards a task."""
    monkeypatch.setattr(source_divergence, "TILE", 4)
    monkeypatch.setattr(source_divergence, "BUCKET_CELLS", 150)
    rng = random.Random(2)
    rows = [(i, " ".join(f"t{chr(97 + rng.randint(0, 25))}{chr(97 + (i + rng.randint(0, 3)) % 26)}" for _ in range(30)), "en", f"s{i % 23}", 0) for i in range(900)]
    got = source_divergence.audit(spark.createDataFrame(rows, TABLE).repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == divergence_brute(rows)


def test_source_divergence_empty(spark):
    assert source_divergence.audit(spark.createDataFrame([], TABLE)).collect() == []


def test_shards_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "SHARD_BYTES", 64)
    texts = ["ab cd", "ab" * 100, "", None, "cd. Ab", "é"] * 9
    batch = pa.record_batch({"lang": ["x"] * 54, "source": [str(i % 2) for i in range(54)], "text": [t or "" for t in texts]})
    n, docs = Counter(), Counter()
    made = list(source_divergence._shards(iter([batch])))
    assert len(made) > 3
    for b in made:
        for r in b.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    want = Counter((str(i % 2), w) for i, t in enumerate(texts) for w in re.findall("[a-zé]+", (t or "").lower()))
    assert n == want and docs == Counter((str(i % 2), w) for i, t in enumerate(texts) for w in set(re.findall("[a-zé]+", (t or "").lower())))
