"""Chat formatting, HTML extraction, fingerprints, quality and search."""

import collections
import hashlib
import json
import random
import time

import numpy as np
import pytest
import regex as re
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import chat, extraction, imatch, quality, queries, search


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_turns_are_read_back_exactly(spark):
    odd = ["\\### Assistant: </turn> ok", "\\b\\h\\t", "####", "", None, "a: b\n</turn>\n### User: x", "<</turn>", "é😀", "\\"]
    roles = ["user", "assistant", "system", "tool: x", "User", None, "@user", "assistant", "user"]
    rows = [(1, i, r, t, 0) for i, (r, t) in enumerate(zip(roles, odd, strict=True))] + [(2, 0, "user", "hi", 0), (2, 0, "user", "hi", 0), (None, 0, "user", "n", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert got[1].n_turns == 9 and got[2].n_turns == 2 and got[None].n_turns == 1
    assert got[1].turns_sha256 == digest("".join(f"{r or ''}\n{t or ''}\n" for r, t in zip(roles, odd, strict=True)))
    loss = "".join(t or "" for r, t in zip(roles, odd, strict=True) if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), digest(loss))
    assert chat.canonical_turns(df.limit(0)).collect() == []


def test_layouts_by_fingerprint(spark):
    said = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]
    samples = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"},
    ]
    rows = [(i, json.dumps(s)) for i, s in enumerate(samples)] + [(90, "{}"), (91, None), (92, "no json")]
    got = {r.id: r for r in chat.canonical_turns_json(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()}
    for i, sample in enumerate(samples):
        assert [t.asDict() for t in got[i].turns] == said, got[i].layout
        table = spark.createDataFrame([(i, json.dumps(sample))], "conv_id long, j string")
        kind = table.select(F.schema_of_json(F.lit(json.dumps(sample)))).first()[0]
        typed = table.select("conv_id", F.from_json("j", kind).alias("j")).select("conv_id", "j.*")
        assert [t.asDict() for t in chat.canonical_turns(typed).first().turns] == said
    assert all(got[i].turns is None for i in (90, 91, 92))
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other long"))


PAGES = {
    "<html><body><header>Site</header><div id=menu>x</div><main><article class='post-12'><h1>T &amp; U</h1><p>One&nbsp;two<br>three <a href='x>y'>link</a><p>Four"
    "<ul><li>A<li>B</ul><div class='share'>tweet</div><aside>side</aside></article><section id='comments'><p>bad</p></section></main><footer>f</footer>": "T & U\nOne two three link\nFour\nA\nB",
    "<div class=wrapper><div class=sidebar>links</div><div class=content>Hello <b>wor</b>ld<p>next</p>tail</div></div>": "Hello world\nnext\ntail",
    "<p>a<p>b<script>if(a<b)document.write('</p>')</script>c": "a\nb\nc",
    "<table><tr><td>x<td>y<tr><td>z</table>": "x\ny\nz",
    "plain": "plain", "": "", "<div>" * 5000 + "deep": "deep", '<a href="' + "x" * 10000: "",
}


def test_main_texts(spark):
    rows = [(i, f"http://h{i}.org/a", h, "p") for i, h in enumerate(PAGES)] + [(90, None, None, "p"), (91, "http://h0.org/b", None, "p")]
    got = {r.page_id: r for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()}
    assert [got[i].text for i in range(len(PAGES))] == list(PAGES.values())
    assert got[90].text == got[91].text == "" and all(r.n_chars == len(r.text) for r in got.values())


# pages whose article is known by how they are made
ARTICLE = ["Prices of shares rose", "Second & last <b>para</b>graph", "A form factor"]
WANT = "Prices of shares rose\nSecond & last paragraph\nA form factor"
BODY = f"<p class='share-price'>{ARTICLE[0]}</p><div class='form-factor'>{ARTICLE[1].replace('&', '&amp;')}</div><p id='related-work'>{ARTICLE[2]}</p>"
JUNK = ["<div class='share-bar'>tweet</div>", "<div class='related-posts'><p>more</p></div>", "<div id='cookie-banner'>yes?</div>", "<aside>side</aside>", "<div class=ad-slot-12>buy</div>",
        "<section class='comment-list'><article class=comment-7><p>bad</p></article></section>", "<form><p>mail</p></form>", "<script>a<b</script>", "<ul role=navigation><li>x</ul>", "<p hidden>no</p>"]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article class='post-9'>{}</article></main>", "<div class='content'>{}</div>", "<main>{}</main>"])
def test_article_text_with_common_class_names_stays(spark, wrap):
    draw = random.Random(2)
    rows = []
    for i in range(30):
        parts = BODY.replace("</p><div", "</p>|<div").replace("</div><p", "</div>|<p").split("|")
        for junk in draw.sample(JUNK, 4):
            parts.insert(draw.randint(0, len(parts)), junk)
        rows.append((i, "http://h.org/", f"<html><body><header>Site</header>{wrap.format(''.join(parts))}<footer>f</footer></body></html>"))
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {WANT}


def test_text_beside_the_article_is_kept(spark):
    page = "<main><p>Before</p><article class=a1><p>One body text</p></article><article class=b2><p>Two body text</p></article><p>After</p></main>"
    assert extraction.extract(spark.createDataFrame([(1, "http://h.org/", page)], "page_id long, url string, html string")).first().text == "Before\nOne body text\nTwo body text\nAfter"


def test_odd_quotes_are_read_once():
    def seconds(n):
        at = time.perf_counter()
        extraction.Page('<a "> "' * n)
        return time.perf_counter() - at

    seconds(500)
    assert seconds(40_000) < 60 * max(seconds(2_000), 0.005)  # 20 times the length; the square would be 400 times the time
    assert extraction.Page("<p title='a>b' x=\"'\">t</p><p y=\">u").blocks[0][1] == "t"


def test_hosts_agree_on_a_path(spark):
    usual = "<body><div class=x1><p>{}</p></div><div class=x2><p>{}</p></div></body>"
    rows = [(i, "http://one.org/", usual.format("t" * 10 + str(i), "article " * 30)) for i in range(9)]
    paths = {r.host: r.path for r in extraction.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert list(paths) == ["one.org"] and paths["one.org"] == extraction.Page(rows[0][2]).paths[extraction.Page(rows[0][2]).best()[0]]


def test_fingerprints(spark):
    texts = {9: "alpha beta gamma delta " * 3, 7: None, 4: "", 3: "alpha beta gamma delta " * 3, 2: "epsilon zeta eta theta iota", 1005: "kappa, lambda; mu"}
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, n int, own string")
    got = {r.doc_id: r for r in imatch.edit_report(df).collect()}
    order = sorted(texts, reverse=True)
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        text, other = texts[k] or "", texts[after] or ""
        half = len(text) // 2
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == digest(text[: len(text) - half] + other[:half])
    assert got[9].fingerprint == got[3].fingerprint != got[2].fingerprint and got[7].near_next == 1.0
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))
    assert imatch.edit_report(df.limit(0)).collect() == []


def test_lexicon_has_the_terms_of_the_band_and_no_others(spark):
    # many terms of one document each, few of the band, one of every document
    rows = [(i, " ".join(["all", f"pair{i // 2}", *(f"only{i}x{k}" for k in range(5000))])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.t for r in spark.createDataFrame([(f"pair{i}",) for i in range(60)], "w string").select(F.xxhash64("w").alias("t")).collect()}
    found = imatch.lexicon(df)
    asked = spark.createDataFrame([(0, "only0x1 pair3"), (1, "pair3 all only7x9"), (2, "Pair3"), (3, "pair4")], "id long, text string")
    prints = [r.p for r in imatch.with_fingerprints(asked, found, "id", p="text").orderBy("id").collect()]
    assert prints[0] == prints[1] == prints[2] != prints[3]  # what stands in one document, or in each, plays no part
    assert {r.term for r in found.collect()} == want


def plain_prints(texts, low, high):
    """For each text its in-band terms of every subset, as a set: a fingerprint compares as these do."""
    said = [{w for w in re.split(r"[^\p{L}\p{N}]+", t.lower()) if w} for t in texts]
    df = collections.Counter(w for words in said for w in words)
    band = {w for w, n in df.items() if max(imatch.LEAST, low * len(texts)) <= n <= high * len(texts)}

    def subsets(text):
        words = {w for w in re.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
        hashes = sorted(xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words & band or words)
        share = lambda low, high: tuple(h for h in hashes if low <= h / 2.0**64 < high)
        thin = [share(0.25 * (part == 1) + 0.3125 * (part == 2) + i / n, 0.25 * (part == 1) + 0.3125 * (part == 2) + (i + 1) / n) for part, n in enumerate((64, 256, 1024)) for i in range(16)]
        return [*thin, share(0, 0.5), share(0.5, 1)]

    return subsets


def test_fingerprints_agree_with_a_plain_version(spark):
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)] + ["É", "naïve", "x1"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 300))) for _ in range(60)]
    texts += [t[: len(t) // 2] + " end" for t in texts[:20]] + ["", None, "solo", "a,b;c", texts[0], "long " * 30000 + "tail"]
    ids = [None, None, 5, 5, 1 << 60] + [i * 7919 * 10**12 for i in range(6, len(texts) + 1)]  # null, equal and hashed ids
    got = imatch.edit_report(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)).collect()
    subsets = plain_prints([t or "" for t in texts], imatch.LOW, imatch.HIGH)
    key = lambda r: (r.n_chars, r.fingerprint)
    by_text = {}
    for i, t in zip(ids, texts, strict=True):
        rows = [r for r in got if r.doc_id == i and r.n_chars == len(t or "")]
        assert rows
        by_text[t or ""] = rows[0].fingerprint
    for a in by_text:
        for b in by_text:
            for x, y, i in zip(subsets(a), subsets(b), range(50), strict=True):
                left, right = (by_text[t][8 * i : 8 * i + 8] for t in (a, b))
                assert (left == right) == (x == y) and (left == "-" * 8) == (not x)
    # the next row by descending id, nulls last, after the last the first
    distinct = {(r.doc_id, key(r)): r for r in got}.values()
    order = [r.doc_id for r in sorted(distinct, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))]
    nexts = {}
    for r in distinct:
        nexts.setdefault(r.doc_id, []).append(r.next_doc_id)
    want = {}
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        want.setdefault(a, []).append(b)
    assert {k: sorted(v, key=repr) for k, v in nexts.items()} == {k: sorted(v, key=repr) for k, v in want.items()}


def test_edits_are_nearer_than_neighbours(spark, folder):
    got = queries.op7_imatch(spark, folder).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.9 and (got.near_edited < got.near_next).mean() < 0.01


def test_quality_on_held_out_rows(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    rows = queries.op9_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and ((rows.score >= 0.3) == (rows.predicted == 1)).all()


def test_quality_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["a b", None, ""])], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (None, None)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.score_documents(docs, ones).collect())
    assert quality.score_documents(docs.limit(0), ones).collect() == []


def brute(ids, vectors, asks, k):
    for q in asks:
        scores = vectors @ vectors[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))
        yield from ((q, rank + 1, ids[i]) for rank, i in enumerate(order[:k]))


@pytest.mark.parametrize(("shard", "block"), [(64, 10), (1 << 15, 7), (1 << 15, 1 << 16)])
def test_search_is_exact(spark, shard, block):
    draw = np.random.default_rng(2)
    vectors = np.round(draw.normal(size=(700, 6)) * draw.uniform(0.1, 3, (700, 1)), 1) + 0.05
    vectors[100:140] = vectors[100]
    ids = list(range(0, 1400, 2))
    rows = [(i, v.tolist(), "q") for i, v in zip(ids, vectors, strict=True)]
    bad = [(1, None, ""), (3, [0.0] * 6, ""), (5, [float("nan")] * 6, ""), (7, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (9, [1.0], ""), (None, [1.0] * 6, ""), (20001, [float("inf")] * 6, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    got = search.search(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=shard, query_rows=block)
    exact = [(q, r, i) for q, r, i in brute(ids, vectors, [i for i in ids if i % 20 == 0], 5)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == sorted(exact)
    assert search.search(df.limit(0), F.lit(True)).collect() == []


def test_relaxed_search_keeps_recall(spark, folder):
    data = spark.read.parquet(f"{folder}/embeddings.parquet")
    asks = F.col("vec_id") % 20 == 0
    exact = {(r.query_id, r.vec_id) for r in search.search(data, asks).collect()}
    near = {(r.query_id, r.vec_id) for r in search.search(data, asks, relax=1.2).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
