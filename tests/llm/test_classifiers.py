"""Toxicity chain, byte network, decontamination, main text, licenses, pipeline."""

import html
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from punctuality.llm import byte_cnn, latent, licenses, main_text, toxic_chain
from punctuality.llm.texts import WordHashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rejected string, a int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 0) for i, t in rows], DOCS)


def prose(pick, n, words=4000):
    return " ".join(f"{'bcdfghkl'[pick.randrange(8)]}{'aeiou'[pick.randrange(5)]}{pick.randrange(words)}x" for _ in range(n))


AWKWARD = [(None, None), (1, ""), (2, " \n"), (2, " \n"), (3, "ok"), (4, "z" * 50_000), (5, "a b " * 20_000), (6, "ÄÖ 中文 \x00")]


# ---- toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    pick, rows, labels = random.Random(5), [], []
    terms = ["idiot", "moron", "scum", "trash", "lowerling", "lowerzent"]
    for k in range(900):
        words = prose(pick, pick.randrange(5, 120)).split()
        bad = k % 6 == 0
        if bad:
            for _ in range(pick.randrange(1, 4)):
                words.insert(pick.randrange(len(words) + 1), pick.choice(terms))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_on_unseen_rows(spark, toxic):
    docs, labels = toxic
    chain = toxic_chain.fit(toxic_chain.toxic_labels(docs, labels.where("doc_id < 600")))
    assert chain.categories == ("insult", "contempt", "toxic") and len(chain.weights[2]) == len(chain.features) + 3
    got = {r.doc_id: r for r in toxic_chain.score(docs.where("doc_id >= 600"), chain).collect()}
    wrong = sum(got[k].rejected != (k % 6 == 0) for k in range(600, 900))
    assert wrong <= 6
    left = toxic_chain.clean(docs, chain)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.where("doc_id >= 600").collect()} == {k for k, r in got.items() if not r.rejected}


def test_chain_on_awkward_rows(spark, toxic):
    docs, labels = toxic
    chain = toxic_chain.fit(toxic_chain.toxic_labels(docs, labels))
    rows = toxic_chain.score(table(spark, AWKWARD), chain).collect()
    assert len(rows) == len(AWKWARD) and not any(r.rejected for r in rows)


def test_chain_without_labels(spark, toxic):
    docs, labels = toxic
    chain = toxic_chain.fit(toxic_chain.toxic_labels(docs, labels.limit(0)))
    assert all(r.p_toxic == 0 and not r.rejected for r in toxic_chain.score(docs, chain).collect())
    assert toxic_chain.clean(docs.limit(0), chain).count() == 0


def test_chain_on_a_language_with_five_toxic_rows(spark):
    pick, rows, labels, terms = random.Random(22), [], [], ("gruzzwort", "flimmpo")
    for k in range(600):
        words = prose(pick, 30).split()
        bad = k < 5
        if bad:
            words[5] = terms[k % len(terms)]
        elif k % 6 == 0:
            bad, words[5] = True, "moron"
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    chain = toxic_chain.fit(toxic_chain.toxic_labels(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    unseen = [(1000 + k, " ".join([*prose(pick, 30).split(), *([terms[k % len(terms)]] if k < 30 else [])])) for k in range(90)]
    got = toxic_chain.score(table(spark, unseen), chain).collect()
    assert {r.doc_id for r in got if r.rejected} == set(range(1000, 1030))


def test_out_of_fold_inputs():
    """The second model is fitted on probabilities that its rows did not shape."""
    pick = np.random.default_rng(0)
    x = np.eye(60)
    y = np.stack([pick.integers(0, 2, 60), pick.integers(0, 2, 60)], axis=1).astype(float)
    weights = toxic_chain.fit_chain(x, y, np.arange(60) % 5, np.ones(60))
    # Each row has a column of its own: in-fold the first category would predict itself.
    unseen = []
    for f in range(5):
        out = np.arange(60) % 5 == f
        inputs = np.hstack([x, np.ones((60, 1))])
        w = toxic_chain.logistic(inputs[~out], y[~out, 0], np.ones((~out).sum()))
        unseen.append(np.ptp(inputs[out] @ w))
    assert max(unseen) < 1e-6 and len(weights[1]) == 62


def test_logistic_is_at_its_optimum():
    pick = np.random.default_rng(3)
    x = np.hstack([pick.normal(size=(300, 4)), np.ones((300, 1))])
    y = (pick.random(300) < 1 / (1 + np.exp(-x @ [1, -2, 0.5, 0, 0.3]))).astype(float)
    w = toxic_chain.logistic(x, y, np.ones(300))
    p = 1 / (1 + np.exp(-x @ w))
    ridge = np.r_[np.full(4, toxic_chain.PENALTY), 1e-9]
    assert np.abs(x.T @ (p - y) / 300 + ridge * w).max() < 1e-6


# ---- byte network


def test_gradient_by_differences():
    net = byte_cnn.new_net(1)
    b = byte_cnn._bytes("some text with words words words words and %%% signs, " * 12)
    parts, slopes = net.parts(), byte_cnn.gradient(net, b, 1.0)

    def loss():
        top, *_ = net.chunks(b, places=True)
        pooled = np.maximum(top + net.bias, 0)
        z = np.r_[pooled.max(axis=0), pooled.mean(axis=0)] @ net.out + net.shift[0]
        return np.log1p(np.exp(-z))

    pick = np.random.default_rng(0)
    for p, d in zip(parts, slopes, strict=True):
        flat, slope = p.reshape(-1), d.reshape(-1)
        for i in pick.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-3 == pytest.approx(slope[i], abs=2e-3)


def test_blocks_give_the_whole_text(monkeypatch):
    net = byte_cnn.new_net(2)
    text = prose(random.Random(6), 900)
    whole = net.probability(text)
    monkeypatch.setattr(byte_cnn, "BLOCK", 2 * byte_cnn.TILE)
    assert net.probability(text) == pytest.approx(whole, abs=1e-9)


def test_repeats_channel():
    assert byte_cnn.repeats(byte_cnn._bytes("shorty shorty shorty shorty")).sum() > 8
    assert byte_cnn.repeats(byte_cnn._bytes("all of these words differ here")).sum() == 0


def test_held_out_accuracy(spark):
    pick, rows, labels = random.Random(7), [], []
    for k in range(360):
        text = prose(pick, pick.randrange(20, 90))
        if k % 3 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((k, text))
        labels.append((k, int(k % 3 != 0), 0))
    docs = table(spark, rows + AWKWARD)
    net = byte_cnn.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = byte_cnn.score(docs, net).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 10]
    assert len(unseen) > 80 and sum(r.predicted == (r.doc_id % 3 != 0) for r in unseen) >= 0.95 * len(unseen)


# ---- decontamination


def test_common_length():
    pick = random.Random(8)
    for _ in range(200):
        a = [pick.randrange(6) for _ in range(pick.randrange(1, 30))]
        b = [pick.randrange(6) for _ in range(pick.randrange(0, 40))]
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        assert latent.common_length(np.array(a), np.array(b)) == table_[-1][-1]


def test_singular_vectors(spark):
    """The leading vectors explain as much of the matrix as the exact ones, nearly."""
    pick = random.Random(9)
    rows = [(k, prose(pick, 64, 6)) for k in range(60)]
    texts = table(spark, rows).select("text")
    hashes = WordHashes()
    terms = latent.Terms(np.unique(np.concatenate([hashes.of_plain(latent.folded(t)) for _, t in rows])))
    counts, passages = latent._frequencies(texts, terms)
    assert passages == 120
    idf = np.log(1 + passages / counts)
    a = np.zeros((passages, len(idf)))
    for k, (_, t) in enumerate(rows):
        at, term = terms.find(hashes.of_plain(latent.folded(t)))
        np.add.at(a, (2 * k + at // 32, term), 1)
    assert ((a > 0).sum(axis=0) == counts).all()
    a *= idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    thin = np.random.default_rng(1).normal(size=(len(idf), 5))
    for most in (latent.SQUARE_TERMS, 0):  # both orders of multiplication
        assert latent._product(texts, terms, idf, thin, most) == pytest.approx(a.T @ a @ thin, rel=1e-3, abs=1e-3)
    v = latent.singular_vectors(texts, terms, idf, rank=20)
    assert v.T @ v == pytest.approx(np.eye(20), abs=1e-6)
    exact = (np.linalg.svd(a, compute_uv=False)[:20] ** 2).sum()
    assert (np.linalg.norm(a @ v) ** 2) > 0.8 * exact  # a flat spectrum, the hardest case


def test_bounds_of_the_confirmation_lose_nothing():
    """All candidates, each confirmed by its subsequences alone, give the same leaks."""
    pick = random.Random(21)
    items = [prose(pick, pick.randrange(1, 50), 4) for _ in range(30)]
    texts = [None, "", " \t"]
    for k in range(120):
        words = prose(pick, pick.randrange(0, 200), 4).split()
        told = [w for w in items[k % 30].split() if pick.random() < (1, 0.8, 0.6)[k % 3]]
        texts.append(" ".join(words[:40] + told + words[40:]))
    hashes = WordHashes()
    words = [hashes.of_plain(latent.folded(t)) for t in items]
    terms = latent.Terms(np.unique(np.concatenate(words)))
    vectors = np.linalg.qr(np.random.default_rng(2).normal(size=(len(terms.hashes), 40)))[0]
    index = latent.index(list(range(30)), words, terms, np.ones(len(terms.hashes)), vectors)
    reader = latent.Reader()
    read, begin = reader.read(texts)
    term = np.full(len(read), len(terms.hashes))
    at, k = terms.find(read)
    term[at] = k
    expected = [{} for _ in texts]
    for text, item, cosine, start, size in sorted(zip(*latent.candidates(term, begin, index), strict=True), key=lambda c: (c[0], c[1], -c[2], c[3], c[4])):
        own = read[begin[text] : begin[text + 1]]
        region = own[max(0, start - size // 2) : start + size + size // 2]
        answer = words[item][-max(1, round(latent.ANSWER_WORDS * len(words[item]))) :]
        share = latent.common_length(words[item], region) / len(words[item])
        told = latent.common_length(answer, region) / len(answer)
        kind = "copy" if share >= latent.COPY else "paraphrase" if share >= latent.PARAPHRASE and told >= latent.ANSWER else None
        best = expected[text].get(int(item))
        if kind and not (best and (best[-1] == "copy" or share <= best[1])):
            expected[text][int(item)] = (int(item), share, told, int(start), kind)
    got = [[(i, share, told, start, kind) for i, _, share, told, start, kind in found] for found in latent.confirmed(texts, index, reader)]
    assert got == [list(e.values()) for e in expected]
    assert {x[-1] for found in got for x in found} == {"copy", "paraphrase"}


def test_leaks(spark):
    pick = random.Random(10)
    items = [(k, prose(pick, pick.randrange(15, 60))) for k in range(40)] + [(90, None), (91, ""), (None, "lost")]
    rows, planted = [], set()
    for k in range(300):
        words = prose(pick, pick.randrange(0, 300)).split()
        if k % 5 == 0:
            item = k // 5 % 40
            told = items[item][1].split()
            if k % 15 == 0:  # a paraphrase: some words replaced, the answer kept
                told = [w if pick.random() < 0.75 or i > 0.75 * len(told) else prose(pick, 1) for i, w in enumerate(told)]
            at = pick.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "!" for w in told] if k % 10 == 0 else told
            planted.add((k, item))
        rows.append((k, " ".join(words)))
    docs = table(spark, rows + AWKWARD)
    got = latent.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert not found - planted and len(planted - found) <= 1
    assert {r.kind for r in got} == {"copy", "paraphrase"}
    assert latent.leaks(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert latent.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_an_item_in_a_third_of_the_documents(spark):
    pick = random.Random(20)
    items = [(1, prose(pick, 30)), (2, prose(pick, 30))]
    rows, planted = [], {(300, 2)}
    for k in range(301):
        words = prose(pick, pick.randrange(20, 60)).split()
        if k % 3 == 1 or k == 300:
            words[7:7] = items[k == 300][1].split()
        if k % 3 == 1:
            planted.add((k, 1))
        rows.append((k, " ".join(words)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in latent.leaks(table(spark, rows), benchmark).collect()} == planted
    few = [row for row in rows if row[0] < 12 or row[0] == 300]  # less than 100 passages
    assert {(r.doc_id, r.item_id) for r in latent.leaks(table(spark, few), benchmark).collect()} == {x for x in planted if x[0] < 12 or x[0] == 300}


# ---- main text


@pytest.fixture(scope="module")
def tree():
    return main_text.grow(np.array(main_text.LABELLED, float))


def test_tree_fits_its_table(tree):
    assert all(tree.says(row[:-1]) == bool(row[-1]) for row in main_text.LABELLED)


def test_tree_asks_for_links_and_both_neighbours(tree):
    asked = set()

    def walk(node):
        if node.feature >= 0:
            asked.add(main_text.FEATURES[node.feature])
            walk(node.low), walk(node.high)

    walk(tree)
    assert asked >= {"words", "links", "words_before", "links_before", "words_after", "links_after"}


def paragraphs(*sizes):
    return "".join(f"<p>{' '.join(f'w{k}' for k in range(n))}</p>" for n in sizes)


LINKS = "<ul>" + "".join(f"<li><a href=/{k}>to {k}</a></li>" for k in range(5)) + "</ul>"


@pytest.mark.parametrize("sizes", [(60,), (5,), (60, 60, 60), (28, 3, 40, 2, 35), (40, 3), (3, 40)])
def test_pages_that_mark_nothing_keep_all_paragraphs(tree, sizes):
    for page in (f"<body><div>{paragraphs(*sizes)}</div></body>", f"<html><div>x</div>{LINKS}<div>{paragraphs(*sizes)}</div><aside>{LINKS}</aside>" if sizes[0] > 10 else f"<p>{paragraphs(*sizes)}"):
        assert [len(x.split()) for x in main_text.content(page, tree).split("\n")] == list(sizes)


def test_lists_of_links(tree):
    page = f"<div>Site</div>{LINKS}<h1>Head</h1>{paragraphs(30)}<p><a>a linked line</a></p>{paragraphs(40)}<h3>More</h3>{LINKS}<p>since 2020</p>"
    got = main_text.content(page, tree).split("\n")
    assert [len(x.split()) for x in got] == [1, 30, 3, 40] and got[0] == "Head"
    assert main_text.content(f"<article>{paragraphs(20)}{LINKS}</article>{LINKS}<p>{paragraphs(30)}", tree).count("to ") == 5


WINNERS = [  # which of post, teaser and comment is the text
    (f"<div>{paragraphs(60)}</div><aside class=sidebar><article>teaser</article></aside>", 60),
    (f"<div>{paragraphs(60)}</div><section class=related><article><p>a teaser</p></article></section>", 60),
    (f"<div class=post>{paragraphs(60)}</div><article class='comment'><p>me too</p></article>", 60),
    (f"<article>{paragraphs(60)}</article><div>{paragraphs(30)}</div>", 60),
    (f"<form id=all><nav>{LINKS}</nav><main>{paragraphs(60)}</main></form>", 60),
    (f"<article class=comment>{paragraphs(50)}</article>", 50),
]


@pytest.mark.parametrize("page, words", WINNERS)
def test_what_encloses_an_article(tree, page, words):
    assert len(main_text.content(page, tree).split()) == words


@pytest.mark.parametrize("part", ["<a ", '<a "> " ', "<aside>", "<div></span>", "<p class='", "<!--", "<script>", "</script ", "<a <b>", "<svg></svg ", "& < "])
def test_a_page_of_a_megabyte_of_malformed_markup(tree, part):
    start = time.perf_counter()
    main_text.content(part * (1_000_000 // len(part)) + ">", tree)
    assert time.perf_counter() - start < 10


PAGES = [
    ("<article><h1>T &amp; U</h1><p>One.</p><p>Two <b>bold<br><p>Three</p></article>", "T & U\nOne.\nTwo bold\nThree"),
    ("<nav><a>home</a></nav><main><p>a&nbsp;b\n c</p><div class='ad'>buy</div><p>d</p></main><footer>f</footer>", "a b c\nd"),
    ("<article><p>x</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>y</p></article>", "x\ny"),
    ("<article><p>text</p><form><label>Mail</label><input></form><aside>more</aside></article><div id=comments><p>nice one</p></div>", "text"),
    ("<article><p>text</p><section class='comments'><article><p>a reader says much about this</p></article></section></article>", "text"),
    ("<div class='cookie-notice'>We use cookies</div><header><h1>Site</h1></header><main><header><h1>Head</h1></header><p>p</p></main>", "Head\np"),
    ("<MAIN><P>upper</P><UL><LI>i1<LI>i2</UL></MAIN>", "upper\ni1\ni2"),
    ("", ""), (None, ""), ("<p", ""), ("<nav>only</nav>", ""),
]


@pytest.mark.parametrize("page, wanted", PAGES)
def test_main_text_of(tree, page, wanted):
    assert main_text.content(page, tree) == wanted


STATES = [
    ("<body class='single comments-open has-sidebar'><article class='post comments-closed'><p>one two</p></article></body>", "one two"),
    ("<main class='hidden-nav no-comments'><p>one two</p></main>", "one two"),
    ("<article id=discussion class='respond'><p>one two</p></article><article class=comment><p>me too</p></article>", "one two"),
    ("<article><p>one</p><div class='post-comments'><p>nice</p></div><ol class='comment-list'><li>so so</ol></article>", "one"),
    ("<article><p>one</p><div class='comments-area'><p>nice</p></div><p id='comment-12'>so so</p></article>", "one"),
    ("<article hidden><p>one</p></article>", ""),
    ("<article><p>one <svg width='3'/> two</p><math/><p>three</p><svg><text>no</text></svg><p>four</p></article>", "one two\nthree\nfour"),
    ("<article><p>one</p><video-player src=x></video-player><select-menu>two</select-menu><p>three</p></article>", "one\ntwo\nthree"),
]


@pytest.mark.parametrize("page, wanted", STATES)
def test_states_and_silent_elements(tree, page, wanted):
    assert main_text.content(page, tree) == wanted


def test_generated_pages(tree):
    pick = random.Random(11)
    for _ in range(60):
        parts = [prose(pick, pick.choice([1, 2, 5, 30, 200])) + " & <" for _ in range(pick.randrange(1, 12))]
        links = "".join(f"<li><a href='/{k}'>{prose(pick, 1)}</a></li>" for k in range(6))
        inner = "".join(f"<p>{html.escape(p)}" + pick.choice(["</p>", "", "<br></p>"]) for p in parts)
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul>{links}</ul></nav><div class=ad>{prose(pick, 8)}</div><article>{inner}</article><footer>&copy; {prose(pick, 9)}</footer>"
        assert main_text.content(page, tree).split("\n") == parts


def test_pages_table(spark):
    pages = spark.createDataFrame([(k, None, p, 3) for k, (p, _) in enumerate(PAGES)] + [(None, "u", PAGES[0][0], 3)], "page_id long, url string, html string, n_chars int")
    got = main_text.main_text(pages).collect()
    assert {(r.page_id, r.text, r.n_chars) for r in got if r.page_id is not None} == {(k, t, len(t)) for k, (_, t) in enumerate(PAGES)}
    assert len(got) == len(PAGES) + 1 and main_text.main_text(pages.limit(0)).count() == 0


# ---- licenses


def test_winnowing_guarantee():
    pick = random.Random(12)
    hashes = WordHashes()
    for _ in range(200):
        run = [f"r{pick.randrange(50)}" for _ in range(licenses.GRAM + licenses.WINDOW - 1)]
        texts = [[f"x{pick.randrange(999)}" for _ in range(pick.randrange(20))] + run + [f"y{pick.randrange(999)}"] * pick.randrange(9) for _ in range(2)]
        prints = []
        for words in texts:
            grams = hashes.windows(hashes.of(" ".join(words)), licenses.GRAM)
            prints.append(set(grams[licenses.winnow(grams)].tolist()))
        assert prints[0] & prints[1]


def test_license_scan(spark):
    pick, rows, planted = random.Random(13), [], []
    flat = [(n, t) for n, texts in licenses.TEMPLATES.items() for t in texts]
    for k, (name, text) in enumerate(flat):
        before = prose(pick, pick.randrange(50))
        rows.append((k, f"{before}\n{text.upper()}\n{prose(pick, 20)}"))
        planted.append((k, name))
        words = text.split()
        if len(words) > 15:  # some words lost and some put in
            del words[7]
            words.insert(12, "indeed")
            rows.append((100 + k, f"{before} {' '.join(words)} {prose(pick, 5)}"))
            planted.append((100 + k, name))
    rows += [(200 + k, prose(pick, 300)) for k in range(40)] + [(300, "a license is a license under the law of version 2")]
    got = licenses.license_scan(table(spark, rows + AWKWARD)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == sorted(planted)
    texts = dict(rows)
    for r in got:
        span = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert r.coverage >= 0.8 and licenses.plain(span).split()[0] == licenses.plain(dict(enumerate(t for _, t in flat))[r.doc_id % 100]).split()[0]
    assert licenses.license_scan(table(spark, rows).limit(0)).count() == 0


def test_license_at_the_head_of_a_text():
    pick, hashes = random.Random(21), WordHashes()
    known = licenses.index(hashes)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            words = licenses.plain(text).split()
            for lost in ([7], [0], [0, 1], [5, 9]):
                if len(words) < 15:
                    continue
                left = [w for i, w in enumerate(words) if i not in lost]
                found = licenses.scan(b" ".join(left) + b" " + prose(pick, 20).encode(), hashes, known)
                assert [(x[0], x[2], x[3], x[4]) for x in found] == [(name, len(left), 0, len(left))], (name, lost)


# ---- pipeline


def test_stages_on_awkward_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in AWKWARD], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.shared(stage(spark, docs, sf_dir))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and 0 < docs.count() <= before.count()
    assert docs.count() >= before.count()


def test_stages_on_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_five_stages_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_a_worker_remembers_the_words_of_one_model():
    from punctuality.llm import toxic_chain as chain_module

    first = chain_module._features_of_words(("^a$=",))
    second = chain_module._features_of_words(("^b$=",))
    assert second[b"b"] == (0,) and chain_module._features_of_words.cache_info().currsize == 1
    for k in range(2 * chain_module.FEATURE_WORDS):
        first[b"%d" % k]
    assert len(first) + len(first.older) <= chain_module.FEATURE_WORDS


def test_a_worker_lets_go_of_the_memos_of_other_operators(spark):
    from punctuality.llm import packing, texts
    from punctuality.llm import toxic_chain as chain_module

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id long, text string").repartition(4)
    packing.token_pieces(docs).count()

    def start():
        return lambda doc_id: [(packing._known_words.cache_info().currsize,)]

    held = texts.map_rows(docs.select("doc_id"), start, "held int")
    assert {r["held"] for r in held.collect()} == {0}
    chain_module._features_of_words(("^a$=",))
    texts.begun(lambda: chain_module._features_of_words(("^a$=",)))
    assert chain_module._features_of_words.cache_info().currsize == 1  # asked for again, so it stays
    texts.begun()
    assert chain_module._features_of_words.cache_info().currsize == 0


def test_words_go_with_their_task(spark):
    """Tasks go to the idle workers in turn: what a worker keeps is there once for each worker of the pool."""
    import gc

    import public_tokenizers

    from punctuality.llm import packing, texts

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id long, text string").repartition(4)
    assert packing.token_pieces(docs).count() == 8
    path = public_tokenizers.path(packing.TOKENIZER)

    def start():
        packing._known_words(path)  # asked for, so the worker keeps what it has of it
        return lambda doc_id: [(sum(len(x) + len(x.older) for x in gc.get_objects() if type(x) is texts.Remembered),)]

    held = texts.map_rows(docs.select("doc_id"), start, "held int")
    assert {r["held"] for r in held.collect()} == {0}
