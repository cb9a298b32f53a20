"""Learnt operators, page rendering, and the pipeline."""

import zlib

import numpy as np
import pytest

from cpdspark.llm import html_text, quality_pu, toxicity
from cpdspark.llm.text_arrays import Block, as_bytes

GOOD = ["the cat sat on the mat", "a fine day in town", "rivers run to the sea", "people read books at home", "it rained all night"]
rng = np.random.default_rng(3)


def good_text(n):
    return ". ".join(" ".join(rng.choice(GOOD).split(" ") + [f"q{rng.integers(900)}"]).capitalize() for _ in range(n)) + "."


def bad_text(n):
    word = f"W{rng.integers(99)}"
    return f"{word}!! " * n if rng.integers(2) else " | ".join([word] * n)


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text), and labels (doc_id, quality, toxic)."""
    rows, labels = [], []
    for i in range(500):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = bad_text(40) if bad else good_text(int(rng.integers(4, 30)))
        if toxic:
            text += " you utter " + ("grobnik" if i % 2 else "grobnikess") + " go"
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows + [(None, None), (7, rows[7][1]), (900, ""), (901, None)], labels


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def label_table(spark, labels):
    return spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0), (labels[0][0], 0, 0)], "doc_id long, quality int, toxic int")


def test_chain_on_held_out_rows(spark, documents, corpus):
    rows, labels = corpus
    table = label_table(spark, labels).selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    df = documents(rows, extra=True)
    chain = toxicity.fit(df, table, ["low_quality", "toxic"])
    assert [c.category for c in chain] == ["low_quality", "toxic"] and len(chain[1].earlier) == 1 and len(chain[0].earlier) == 0
    scored = toxicity.score(df, chain)
    assert scored.columns == [*df.columns, "p_low_quality", "p_toxic"]
    got = {r.doc_id: r.p_toxic for r in scored.collect()}
    held = [(i, t) for i, _, t in labels if is_held_out(i)]
    assert len(held) > 100 and all((got[i] >= 0.5) == bool(t) for i, t in held)
    assert got[900] == got[901] == got[None] < 0.5


def test_chain_uses_out_of_fold_probabilities():
    """A first category that memorises its rows must not look certain to the second."""
    n = 400
    terms = [np.array([10 + k], "<i4").tobytes() for k in range(n)]  # each row has a term of its own
    y = np.stack([rng.integers(0, 2, n), rng.integers(0, 2, n)], 1)
    y[:, 1] = y[:, 0]
    chain = toxicity.fit_chain(terms, y, np.arange(n) % 4, ["a", "b"], 1024, 0.1)
    assert abs(chain[1].earlier[0]) < 3  # in-fold probabilities would give a large weight


def test_chain_without_usable_labels(spark, documents):
    empty = spark.createDataFrame([], "doc_id long, a int")
    chain = toxicity.fit(documents([(1, "x")]), empty, ["a"])
    assert [r.p_a for r in toxicity.score(documents([(1, "x"), (2, None)]), chain).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, a int")
    chain = toxicity.fit(documents([(1, "x"), (2, "y")]), ones, ["a"])
    assert toxicity.score(documents([]), chain).collect() == []
    assert all(r.p_a >= 0.5 for r in toxicity.score(documents([(5, "z")]), chain).collect())


def test_quality_on_held_out_rows(spark, documents, corpus):
    rows, labels = corpus
    df = documents(rows)
    model = quality_pu.fit(df, label_table(spark, labels))
    assert 0.65 < model.prior < 0.95  # 0.8 of the texts are good
    got = {r.doc_id: r.score for r in quality_pu.score(df, model).collect()}
    held = [(i, q) for i, q, _ in labels if is_held_out(i)]
    assert sum((got[i] >= 0.5) == bool(q) for i, q in held) >= 0.97 * len(held)
    assert got[900] == got[901] == got[None] and all(0 <= s <= 1 for s in got.values())


def test_quality_without_positives(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_pu.fit(documents([(1, "x")]), none)
    assert [r.score for r in quality_pu.score(documents([(1, "x"), (2, None)]), model).collect()] == [0.5, 0.5]
    assert quality_pu.score(documents([]), model).collect() == []


def test_prior_estimate():
    positive = rng.normal(2, 1, 4000)
    for share in (0.3, 0.6, 0.9):
        n = int(4000 * share)
        unlabelled = np.concatenate([rng.normal(2, 1, n), rng.normal(-2, 1, 4000 - n)])
        assert abs(quality_pu.estimate_prior(positive, unlabelled) - share) < 0.06


def test_word_hashes_do_not_depend_on_the_block():
    a, b = Block([as_bytes("é word x"), b""]), Block([b"pad " * 1000, as_bytes("word é")])
    one, two = (dict(zip([bytes(k.data[s:e]) for s, e in zip(*k.words())], k.hashes(*k.words()))) for k in (a, b))
    assert one[b"word"] == two[b"word"] and one["é".encode()] == two["é".encode()] and len(set(one.values())) == 3


PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
    ("<h1>T &amp; U</h1>x  <b>y</b>\n z<br>w", "T & U\n\nx y z\nw"),
    ("<ul><li>a<li>b<ol start=9><li>c</ol><li>d</ul>", "- a\n- b\n  9. c\n- d"),
    ("<table><tr><th>Name<th>N<tr><td>apple<td>10<tr><td colspan=2>both</table>", "Name   N\napple  10\nboth"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin"),
    ("<pre> x\n  y</pre>z", " x\n  y\n\nz"),
    ("<style>.h, #i{display: none}</style><p class='a h'>no</p><p id=i>no<p>yes<span hidden>no</span><script>no</script>", "yes"),
    ("<div style='color:red; display:none'>no<p>no</div>yes<!-- no --><noscript>no</noscript>", "yes"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<dl><dt>k<dd>v<dt>l</dl>", "k\nv\nl"),
    ("a</b></p>b<td>c", "a\n\nb\nc"),
    ("a < b & c &lt;d&gt; &nbsp;e", "a < b & c <d> e"),
    ("<textarea>t\n u</textarea><input type=submit value=Go><title>no</title>", "t\n uGo"),
    ("x<hr>y<img src=a alt=no>", "x\n\n---\n\ny"),
    ("<a href='>'>q</a><p", "q<p"),
    ("<noscript><style>.js{display:none}</style></noscript><div class=js>X</div>", "X"),
    ("<!-- <style>.m{display:none}</style> --><script>'<style>.m{display:none}</style>'</script><p class=m>X", "X"),
    ("<template><style>p{display:none}</style></template><p>X<style>b{display:none}</style><b>no</b>", "X"),
    ("<p>a<style>i{display:none}", "a"),
    ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>z", "yes\n\nz"),
    ("<style>.b{display:block}</style><p hidden class=b>yes<p hidden>no", "yes"),
    ("<div hidden>no<p style='display:block;visibility:visible'>no</p></div>yes", "yes"),
    ("<input value=typed><input type=password value=no><input type=hidden value=no>", "typed"),
    ("<table><tr><td rowspan=2>aa<td>bb<tr><td>cc</table>", "aa  bb\n    cc"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d<tr><td>x<td>y<td>z</table>", "ab    c\n      d\nx  y  z"),
    ("", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_rendering(page, text):
    assert html_text.render(page) == text


def test_deep_and_broken_pages():
    assert html_text.render("<div>" * 20_000 + "x") == "x"
    assert html_text.render("<ul><li>" * 500 + "x").strip().endswith("x")
    assert html_text.render("<table><tr><td>" * 300 + "x") == "x"
    html_text.render("<a \"" * 500 + "<table></tr></td></table><li></ul>" * 50)


def test_pages_table(spark):
    rows = [(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None), (3, "v", "", "t")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(str, (r.text for r in got.collect()))) == ["", "None", "a", "a"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


@pytest.mark.parametrize(
    "page, text",
    [
        ("<style>@media print{.a,.b{display:none}} .c{color:red}</style><div class=a>A</div><div class=c>C</div>", "A\nC"),
        ("<style>@media (max-width:600px){.a{display:none}} .c{display:none}</style><div class=a>A</div><div class=c>C</div>", "A"),
        ("<style>.a{display:none} @media screen and (min-width: 40em){.a{display:block}}</style><div class=a>A</div>", "A"),
        ("<style media=print>.a{display:none}</style><div class=a>A</div>", "A"),
        ("<style>@media screen{.a{display:none}} @font-face{src:x} @import 'y'; .b{display:none}</style><i class=a>A</i><i class=b>B</i>C", "C"),
        ("<style>.a{display:none} .a{display:block} .b{display:block} .b{display:none}</style><div class=a>A</div><div class=b>B</div>", "A"),
        ("<style>#i{display:block} .a{display:none} .b{display:none!important}</style><p id=i class=a>A</p><p class=b style='display:block'>B</p>", "A"),
        ("<style>.a{display:none}</style><p class=a style='display:block'>A</p><p style='display:none'>B</p>", "A"),
        ("x <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> y", "x a=2 y"),
        ("<svg><title>t</title><defs><text>d</text></defs><path d='M0'/><g>no<text x=1>one</text><text>two</text></g></svg><p>after", "one two\n\nafter"),
        ("<svg><path d='M0'><p>rest</p>of it", "rest\n\nof it"),
        ("<math><mi>a<p>rest", "a\n\nrest"),
        ("<object data=x><param name=a>instead <b>of</b> it</object> z", "instead of it z"),
        ("<object data=x>open<p>rest", "open\n\nrest"),
        ("a<xmp><b>1 &amp; 2</b></xmp>c", "a\n\n<b>1 &amp; 2</b>\n\nc"),
    ],
)
def test_visible_text_is_kept(page, text):
    assert html_text.render(page) == text
