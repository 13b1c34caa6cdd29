"""Operators whose results are per row: URL filter, mix, licences, toxicity, token files, language model, page text."""

import collections
import io
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pairmill.llm import html_text, licenses, mixing, planes, toxicity, trie_lm, urls
from pyspark.sql import functions as F
from tests.llm.helpers import EDGE, WORD, edge_frame, low

URLS = [
    "http://A.Example.NET/en/1?x=/de/", "http://example.net/en/", "http://example.net/en", "https://x.net", "https://x.net/", "http://myexample.net/en/1", "http://a.org/fr/x#y",
    "http://a.org/fr", "http://org/fr/", "http://b.example.com/de/?q", "http://example.com/fr/de/", "ftp://net/en/", "nothing here", "", None, "http://", "x://y://net/", "http://a.net?/en/", "http://..net//en/", "http://example.net/en/1",
]


def _verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = low(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h), len(p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_url_verdicts_equal_plain_code(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)]
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string"), rules)
    assert [tuple(r) for r in got.select("host", "path", "rule", "verdict").orderBy("page_id").collect()] == [_verdict(u) for u in URLS]
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    free = urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string"), rules.limit(0))
    assert {(r.rule, r.verdict) for r in free.collect()} == {(None, "allow")}


def _targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by weight, again and again, until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        room = total - sum(fixed.values())
        t = {s: room * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if t[s] > most * sizes[s]]
        if not over:
            return {**fixed, **t}
        fixed.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "Ä", "z", ""][: 2 + seed]
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 3, 40, 900 if k % 50 == 0 else 5]))), rng.choice([*names, *["a"] * 4])) for k in range(700)]
    rows += rows[:5] + [(None, "x y", "a"), (9999, None, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    placed = mixing.place(d, mixing.word_count(F.col("text")))
    got = placed.select("doc_id", "source", "_mix.*").collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = _targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert taken[s] in (math.floor(want[s]), math.floor(want[s] + 1e-6))
    again = mixing.place(d.repartition(9), mixing.word_count(F.col("text"))).select("doc_id", "source", "_mix.*").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    mixed = mixing.mix_documents(d)
    assert mixed.columns == d.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert all(abs(words[s] - want[s]) <= 901 for s in sizes)


def test_mix_of_nothing(spark):
    d = edge_frame(spark)
    assert mixing.mix_documents(d.limit(0)).columns == d.columns and mixing.mix_documents(d.limit(0)).count() == 0
    assert mixing.mix_documents(d.where("text = ''")).count() == 1
    assert mixing.place(d, mixing.word_count(F.col("text"))).count() == d.count()


def test_license_matches(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    rows, want = [], set()
    for k, (name, notice) in enumerate(licenses.TEMPLATES * 3):
        words = notice.split()
        if k >= len(licenses.TEMPLATES) and len(words) > 30:  # changed near one end
            words[1] = "changed"
        rows.append((k, f"{filler(rng.randrange(300))} {' '.join(words).upper() if k % 2 else ' '.join(words)} {filler(rng.randrange(300))}"))
        want.add((k, name))
    rows += [(1000, "the licensed work is distributed under conditions"), (1001, filler(400)), *[(2000 + (i or 0), t) for i, t, _ in EDGE]]
    got = {(r.doc_id, r.license): r.containment for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = lambda t: {tuple(w[k : k + 5]) for w in [licenses_words(t)] for k in range(len(w) - 4)}
    brute = {}
    for i, t in rows:
        for name, notice in licenses.TEMPLATES:
            g = grams(notice)
            share = len(g & grams(t or "")) / len(g)
            if share >= licenses.LEAST:
                brute[i, name] = max(share, brute.get((i, name), 0))
    assert set(brute) >= want and got == pytest.approx(brute)
    assert licenses.license_matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert licenses.collision(0.5) > 0.999


def test_licenses_of_null_and_repeated_keys(spark):
    name, notice = licenses.TEMPLATES[0]
    other, text = next((n, t) for n, t in licenses.TEMPLATES if n != name and not n.startswith(name[:3]))
    rows = [(None, notice), (None, "nothing here"), (1, notice), (1, text), (1, notice), (2, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash")).withColumn("_key", F.lit(9))
    got = {(r.doc_id, r.license) for r in licenses.license_matches(d.repartition(3)).collect()}
    assert {(None, name), (1, name), (1, other)} <= got and not any(i == 2 for i, _ in got)
    assert licenses.license_matches(d).count() == len(got)


def licenses_words(text):
    import regex

    return regex.findall(licenses.WORD, low(text))


def test_toxicity_ignores_identity_terms(spark):
    """``muslim`` stands mostly in toxic rows; with the penalty, swapping it moves no score."""
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(300)}"
    docs, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        t = [word() for _ in range(rng.randrange(5, 60))]
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(["vilething", "grossword"]) + rng.choice(["s", "ly", ""])
        if rng.random() < (0.7 if toxic else 0.05):
            t[0] = "muslim"
        docs.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    d = d.withColumn("score", F.lit("clash"))
    rest = toxicity.held_out()
    model = toxicity.train(d, lab.where(~rest))
    rows = toxicity.score_texts(d, model).join(lab, "doc_id").where(rest).collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in rows) >= 0.97 * len(rows)
    ask = pa.array(["muslim people live here", "christian people live here", "vilethings", None, ""])
    s = toxicity.scores(ask, *model)
    assert abs(s[0] - s[1]) < 0.02 and s[0] < 0.2 and s[2] > 0.8 and s[3] == s[4] < 0.5
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and 440 <= kept.count() <= 460


def test_fairness_term_moves_the_weights():
    rng = np.random.default_rng(0)
    known, terms = toxicity._identity_places()
    toxic = np.tile([1.0, 0.0, 0.0, 0.0], 50)
    rows = [[terms[0][3], *rng.integers(0, 1000, 3)] if y and k % 8 == 0 or k % 40 == 1 else rng.integers(0, 1000, 3) for k, y in enumerate(toxic)]
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    swaps = np.array([3, 5] * 30)
    gap = [abs(w[terms[0][3]] - w[terms[0][5]]) for f in (0.0, 10.0) for w, _ in [toxicity.fit(toxic, indptr, np.concatenate(rows).astype(int), swaps, f)]]
    assert gap[0] > 0.5 and gap[1] < 0.3 * gap[0]


def test_edges_of_toxicity(spark):
    d = edge_frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(d, none)
    assert {r.score for r in toxicity.score_texts(d, model).collect()} == {0.5}
    some = spark.createDataFrame([(1, 0), (4, 0), (4, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.score_texts(d, toxicity.train(d, some)).count() == d.count()
    assert toxicity.score_texts(d.limit(0), model).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_files_of_planes_round_trip(bits):
    rng = np.random.default_rng(3)
    docs = [(k if k % 9 else None, rng.integers(0, [3, 50_000, 1 << 20][k % 3], rng.integers(0, 500)).astype(np.uint32)) for k in range(60)]
    buf = io.BytesIO()
    out = planes.Writer(buf, bits, block=256)
    for d, ids in docs:
        out.add(d, ids)
    out.close()
    at = 0
    for (d, ids), (got, start, back) in zip(docs, planes.documents_of(buf), strict=True):
        assert got == d and start == at and (back == ids).all()
        at += len(ids)
    empty = io.BytesIO()
    planes.Writer(empty).close()
    assert list(planes.documents_of(empty)) == []


def _encoded(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(planes.default_tokenizer())
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_whole_text():
    rng = random.Random(11)
    alphabet = ["a", "B", "'s", "'", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x1c", "\x85", "\u2003", "\u3000", "\u200b", "7", "é", "日", "🙂", ".", "<|endoftext|>", "\x00", "\u180e", "\ufeff", "\u200a", "\u2028", "\u2019", "\u2014"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(600)] + [t or "" for _, t, _ in EDGE[:5]]
    enc = planes.Encoder(planes.default_tokenizer(), limit=50)
    for k in range(0, len(texts), 20):
        for t, ids in zip(texts[k : k + 20], enc.encode(pa.array(texts[k : k + 20])), strict=True):
            assert ids.tolist() == _encoded(t)[:-1], repr(t)


def test_token_files(spark):
    d = edge_frame(spark).repartition(5)
    manifest = planes.write_files(d, planes.default_tokenizer())
    rows = sorted(planes.read_digests(manifest).collect(), key=lambda r: r.start)
    want = sorted(((i, t) for i, t, _ in EDGE), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        ids = _encoded(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {tuple(r.ids) for r in planes.read_ids(manifest).collect()} == {tuple(_encoded(t)) for _, t in want}
    assert planes.read_digests(planes.write_files(d.limit(0), planes.default_tokenizer())).count() == 0


def test_elias_fano_search():
    rng = np.random.default_rng(0)
    for n, top in ((1, 10), (5, 1 << 63), (900, 5000), (3000, 1 << 60), (1500, 1500)):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        ask = np.unique(np.concatenate([keys, keys + np.uint64(1), rng.integers(0, top, 500, dtype=np.uint64), np.array([0, 2**63 + 5], dtype=np.uint64)]))
        pos, found = trie_lm.EliasFano(trie_lm.ef_build(keys)).search(ask)
        assert (pos == np.searchsorted(keys, ask)).all() and (found == np.isin(ask, keys)).all()


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_equals_plain_counts(spark, monkeypatch, order):
    monkeypatch.setattr(trie_lm, "WORDS_PER_FILE", 40)
    monkeypatch.setattr(trie_lm, "TOKENS_PER_FILE", 700)
    rng = random.Random(7)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randrange(80)))) for k in range(120)] + [(500, None), (501, "Never Seen before"), (502, rng.choice("ab"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = trie_lm.train(d.where("doc_id < 100"), order=order)
    assert len(m.levels) == order and all(len(x.paths) > 1 for x in m.levels)
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in rows}
    runs, follow, before = collections.Counter(), collections.Counter(), collections.Counter()
    one = collections.Counter(w for i in range(100) for w in tokens[i])
    for i in range(100):
        t = ["^", *tokens[i]]
        for k in range(1, len(t)):
            for n in range(2, order + 1):
                if k - n + 1 >= 0:
                    r = tuple(t[k - n + 1 : k + 1])
                    follow[r[:-1]] += runs[r] == 0
                    runs[r] += 1
                    before[r[:-1]] += 1
    total, distinct = sum(one.values()), len(one)
    for r in trie_lm.score_texts(d, m).collect():
        t = ["^", *tokens[r.doc_id]]
        base = score = 0.0
        for k in range(1, len(t)):
            p = (one[t[k]] + 1) / (total + distinct + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                run = tuple(t[max(0, k - n + 1) : k + 1])
                if k - n + 1 >= 0 and before[run[:-1]]:
                    p = (max(runs[run] - 0.75, 0) + 0.75 * follow[run[:-1]] * p) / before[run[:-1]]
            score += math.log10(p)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t) - 1, sum(one[w] > 0 for w in t[1:]), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) < 0.02 * len(t)
    nothing = trie_lm.score_texts(d, trie_lm.train(d.limit(0))).collect()
    assert all(r.base_score == r.score == 0 and r.train_tokens == 0 for r in nothing)
    e = edge_frame(spark)
    assert trie_lm.score_texts(e, m).count() == e.count()
    assert trie_lm.score_texts(e, trie_lm.train(e)).where("score > 0 OR score IS NULL").count() == 0


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>'
    '<article class="post"><h1>A &amp; B</h1><p>First  para<br>goes\non.<p>Second <b>one</b> &lt;x&gt; <!-- no > no --><div class="ad">buy</div><script>var t="</p>";</script>'
    '<form><input><button>Go</button></form><ul><li>item</ul><section id="comments"><article class="comment"><p>reader says</p></article></section><p>Last</p></article>'
    "<aside>more</aside><footer>&copy; x</footer></body></html>"
)


def test_blocks_of_a_page():
    main = [t for t, z, _ in html_text.blocks_of(PAGE) if z == html_text.MAIN]
    assert main == ["A & B", "First para goes on.", "Second one <x>", "item", "Last"]
    assert html_text.blocks_of("") == [] and html_text.blocks_of("<p") == []
    assert [b[0] for b in html_text.blocks_of("1 < 2 and <b>3</b><p>x<scr")] == ["1 < 2 and 3", "x"]
    named = "<body class='has-sidebar'><div class='main sidebar-left'><article class='post share'>a</article><article class='related'>b</article></div>c"
    assert [b[:2] for b in html_text.blocks_of(named)] == [("a", html_text.MAIN), ("b", html_text.SKIP), ("c", html_text.PLAIN)]
    assert [b[0] for b in html_text.blocks_of("<div class=ad>x<p>y<article>z") if b[1] == html_text.MAIN] == ["z"]


def test_repeats_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        tokens = rng.integers(0, 4, 300).astype(np.uint64)
        page = np.sort(rng.integers(0, 6, 300))
        where = collections.defaultdict(set)
        for k in range(300 - 5 + 1):
            if page[k] == page[k + 4]:
                where[tuple(tokens[k : k + 5])].add(page[k])
        want = np.ones(300, dtype=int)
        for k in range(300 - 5 + 1):
            if page[k] == page[k + 4]:
                want[k : k + 5] = np.maximum(want[k : k + 5], len(where[tuple(tokens[k : k + 5])]))
        assert (html_text.repeats(tokens, page, 5) == want).all()


@pytest.mark.parametrize("html", ["<div>x" * 200_000, "<nav><article>x</article>" * 200_000, "<div>" * 200_000 + "<nav><article>x</article>" * 100_000, "<b class=x>y" * 200_000, "<p class='a" * 200_000])
def test_deep_pages_take_linear_time(html):
    import time

    start = time.process_time()
    html_text.blocks_of(html)
    assert time.process_time() - start < 15  # a parser that looks through all open elements takes an hour


def test_names_within_articles():
    kept = ["h2 id='notice-of-intent'", "p id='alert-1'", "p class='share-holders'", "p class='social-proof study'", "p class='related work'"]
    for x in kept:
        assert html_text.blocks_of(f"<article><{x}>a") == [("a", html_text.MAIN, 0.0)]
    gone = ["div class='ad-slot'", "div class='comment even'", "section id='comments'", "div class=cookie-notice", "div id=comment-12", "aside", "div class='share buttons'", "ul class='user-comments'"]
    for x in gone:
        assert [z for _, z, _ in html_text.blocks_of(f"<article><{x}>a")] == [html_text.SKIP]
        assert [z for _, z, _ in html_text.blocks_of(f"<{x}>a")] == [html_text.SKIP]


def test_extract(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PART_CHARS", 2000)
    bar = "these ten words stand above the text of every page"
    rows = [(k, f"http://{'hot' if k % 3 else 'cold'}.net/{k}", f"<body><div>{bar}</div><div>{k}a own text number {k} says {k * 7}</div><div>end</div></body>") for k in range(80)]
    rows += [(100, "http://hot.net/x", PAGE), (100, "http://hot.net/x", PAGE), (101, None, None), (102, "", ""), (103, "http://one.net/", f"<p>{bar}")]
    got = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    out = [tuple(r) for r in html_text.extract(got).collect()]
    assert len(out) == len(rows) and all(len(t) == n for _, _, t, n in out)
    by = {i: t for i, _, t, _ in out}
    assert [k for k in range(80) if by[k] != f"{k}a own text number {k} says {k * 7}\nend"] == []
    assert by[100].startswith("A & B") and by[101] == by[102] == "" and by[103] == bar
    assert html_text.extract(got.limit(0)).count() == 0


def _words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize("part", [1500, 6000, 1 << 22])
def test_boilerplate_of_a_large_host_is_counted_over_all_its_chunks(spark, monkeypatch, part):
    monkeypatch.setattr(html_text, "PART_CHARS", part)
    rng = random.Random(4)
    pair, bar = _words(rng, 9), _words(rng, 12)
    own = [_words(rng, 30) for _ in range(60)]
    # Pages 2k and 2k + 1 share nine words outside of an article; pages of the other host share a line within their articles.
    pairs = [_words(rng, 9) for _ in range(30)]
    rows = [(k, f"http://plain.net/{k}", f"<div>{pairs[k // 2]}</div><p>{own[k]}</p>") for k in range(60)]
    rows += [(100 + k, f"http://art.net/{k}", f"<article><p>{own[k]}</p><p>{bar}</p>{'<p>' + pair + '</p>' if k < 30 else ''}</article>") for k in range(60)]
    rows += [(200, "http://art.net/copy", rows[60][2]), (100, "http://art.net/0", rows[60][2])]
    got = collections.defaultdict(set)
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].add(r.text)
    assert [k for k in range(60) if got[k] != {own[k]}] == []
    want = {100 + k: {own[k] + ("\n" + pair if k < 30 else "")} for k in range(60)}
    assert {k: got[k] for k in want} == want and got[200] == got[100]


@pytest.mark.parametrize("part", [1500, 1 << 22])
def test_copies_without_an_article_keep_their_text(spark, monkeypatch, part):
    monkeypatch.setattr(html_text, "PART_CHARS", part)
    rng = random.Random(5)
    bar = _words(rng, 12)
    own = [_words(rng, 40) for _ in range(20)]
    rows = [(k, f"http://plain.net/{k}", f"<div>{bar}</div><p>{t}</p>") for k, t in enumerate(own)]
    # The same page under two urls, mirrored with another date, and as a repeated row.
    rows += [(100, "http://plain.net/copy", rows[0][2]), (101, "http://plain.net/mirror", f"<div>{bar}</div><p>{own[1]}</p><p>seen on monday</p>"), rows[2], rows[2]]
    got = collections.defaultdict(list)
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].append(r.text)
    want = {**{k: [t] * (3 if k == 2 else 1) for k, t in enumerate(own)}, 100: [own[0]], 101: [own[1] + "\nseen on monday"]}
    assert got == want


def test_token_queries_take_added_tokens_in_texts_as_the_tokenizer_does(spark, tmp_path):
    import corpus_pipeline
    from pairmill.llm import catalog
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(planes.default_tokenizer())
    rng = random.Random(12)
    texts = ["end of one <|endoftext|> start", "<|endoftext|><|endoftext|>b", "a  <|endoftext|>", "<|endoftext|x", "<|ENDOFTEXT|>", None]
    texts += ["".join(rng.choices(["ab", " ", "  ", "\n", "\xa0", "é", ".", "<|", "|>", "<|endoftext|>"], k=rng.randrange(20))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    want, at = [], 0
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for got in (catalog.op5_bit_planes(spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["token_output"](spark, d, str(tmp_path))):
        assert sorted(map(tuple, got.collect())) == want
