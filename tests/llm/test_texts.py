"""Operators on single texts: BPE, personal data, toxicity, quality, HTML, media."""

import dataclasses
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from spindrift.llm import byte_bpe, html_text, media, pii, quality, toxicity

LONG = "word " * 30_000


def frame(spark, rows, kinds="doc_id long, text string, source string, lang string, score string, kept string, size string"):
    """Documents with columns whose names clash with what operators add."""
    return spark.createDataFrame([(*r, *("x",) * (kinds.count(",") + 1 - len(r))) for r in rows], kinds)


ODD = [(1, None, "a", "en"), (2, "", None, None), (None, "hello world", "b", "en"), (3, LONG, "a", "en"), (4, "same text here", "a", "en"), (4, "same text here", "a", "en"), (5, " \n\t ", None, "de"), (6, "é‍😀 a\0b", "b", None)]


def test_bpe_equals_tiktoken():
    ranks = byte_bpe.read_ranks(open(byte_bpe.VOCABULARY, "rb").read())
    own, codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Codec(ranks)
    rng = random.Random(0)
    texts = ["", "aab" * 3000, "<|endoftext|>", LONG[:500], *("".join(rng.choice("ab  éß\n1x$Ωthe'😀") for _ in range(rng.randint(1, 90))) for _ in range(800))]
    for text in texts:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_bpe_table(spark):
    out = byte_bpe.encode_table(frame(spark, ODD)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == len(ODD)
    for r in out:
        text = next(t for i, t, *_ in ODD if i == r.doc_id) or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_tokens == 0) == (r.ids_sha256 == empty)
    df = frame(spark, ODD)
    ids = df.select("text", byte_bpe.encoder(spark)("text").alias("ids"))
    assert all(bytes(r.back) == (r.text or "").encode() for r in ids.select("text", byte_bpe.decoder(spark)("ids").alias("back")).collect())


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    found += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.ORDER[s[2]]))


def test_pii_patterns():
    rng = random.Random(1)
    texts = ["a@b@c.de f@g.h-i.", "4539578763621486 and 1.2.3.4.5.6.7.8 +1 (988) 555-2485", "0" * 6000 + ".1.1.1"]
    texts += ["".join(rng.choice("ab@@..12 0+-()_") for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    for t in texts[:2] + texts[3:]:
        assert pii.base_spans(t) == brute(t)
    assert [s[2] for s in pii.base_spans(texts[2])] == ["ip"]


def test_pii_crf():
    crf = pii.fit()
    assert crf.margin > 0
    whole, rng = dataclasses.replace(crf, margin=-1.0), random.Random(2)
    words = ["the", "token", "=", "call", "555-1234", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "x_1", "(555)", "key", "a@b", "iban", "DE12345678901234567890", "password=b7db7aa4a5fcc78305", "\n"]
    for _ in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        assert pii.added_spans([text], crf) == pii.added_spans([text], whole)
    right = total = 0
    for line in pii.labelled_table(99, 200):
        tokens = [t for t, _ in line]
        path = crf.viterbi(np.array([[crf.emission(pii.features(tokens, i)) for i in range(len(tokens))]]))[0]
        right += sum(pii.LABELS[a] == b for a, (_, b) in zip(path, line, strict=True))
        total += len(line)
    assert right / total > 0.98


def test_viterbi_is_best_path():
    from itertools import product

    crf, rng = pii.fit(), np.random.default_rng(0)
    e = rng.normal(0, 3, (5, 4, 4))
    for row, path in zip(e, crf.viterbi(e), strict=True):
        score = lambda p: sum(row[i, x] for i, x in enumerate(p)) + sum(crf.moves[a, b] for a, b in zip((0, *p), (*p, 0), strict=True))  # noqa: B023, E731
        assert max(product(range(4), repeat=4), key=score) == tuple(path)


def test_pii_tables(spark):
    rows = [*ODD, (9, 'mail a.b@c.org, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "a", "en")]
    out = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert out[9].n_email == 1 and out[9].spans == "email:5:14,secret:25:65"
    assert out[1].spans == "" and out[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.mask(frame(spark, rows))
    assert masked.columns == frame(spark, rows).columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[9] == 'mail [EMAIL], token = "[SECRET]"' and texts[1] is None and texts[3] == LONG
    assert pii.redact("abcdef", [(0, 3, "ip"), (2, 5, "card")]) == "[IP]f"
    assert pii.find(frame(spark, ODD).limit(0)).count() == 0


def test_folding():
    assert toxicity.fold("An ІDIOT, 1d10t; st*pid​") == " an idiot idiot st pid "
    assert toxicity.fold("Ｍｏｒｏｎ 152.143 l0ser") == " moron 152 143 loser "
    lexicon = toxicity.Lexicon({" clown ": 3.0, " mor": 2.0})
    assert [m[2] for m in lexicon.matches(toxicity.fold("a clown fish, a clown! morons"))] == [3.0, 2.0]


def test_toxicity_learns(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(("blorgo", "blorg4nt", "idiot"))
        rows.append((i, " ".join(text), "a", "en"))
        labels.append((i, 1, int(toxic)))
    docs, marks = frame(spark, [*rows, *((x, *r[1:]) for x, r in zip((901, 902, None), ODD, strict=False))]), spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, marks)
    out = [r for r in toxicity.score_table(docs, lexicon).collect()]
    assert len(out) == 703 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert set(toxicity.keep_clean(docs, lexicon).columns) == set(docs.columns)
    none = marks.limit(0)
    assert toxicity.learn(docs, none) == toxicity.DEFAULT
    assert toxicity.score_table(docs.limit(0), lexicon).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([3.0, 1, 2, 2, 4]), np.array([0.0, 0, 1, 0, 1]))
    assert all(np.diff(x) > 0) and all(np.diff(y) > 0) and len(x) == 3


def test_quality_learns(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 != 0
        text = [f"{rng.choice('abcdef')}{rng.choice(('lo', 'ra', 'min'))}{'' if good else rng.choice('$#&')}" for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(text), "a", "en"))
        labels.append((i, int(good), 0))
    docs, marks = frame(spark, [*rows, (801, None), (802, ""), (803, LONG)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score_table(docs, quality.learn(docs, marks)).collect()
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert len(out) == 603 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    assert {r.score for r in quality.score_table(docs, quality.learn(docs, marks.limit(0))).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies for everything we do here.</p></div>%s<aside><p>Side</p></aside>
<section id="comments"><p>A comment of a reader, which is long enough to be mistaken for an article.</p></section><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("body", ["<article>%s</article>", '<div class="entry">%s</div>', "<main><div>%s</div></main>"])
def test_html(body):
    inside = "<h1>Title &amp; more</h1><p><b>First\n\t paragraph,<br>which has a good number of words in it, to be sure of it.<p>Be.</p><div class=ad>Buy now</div><p>Last &lt;one&gt; is also rather long, and it has words enough to count.</p>"
    want = "Title & more\nFirst paragraph, which has a good number of words in it, to be sure of it.\nBe.\nLast <one> is also rather long, and it has words enough to count."
    assert html_text.extract(PAGE % (body % inside)) == want


def test_html_keeps_every_stretch():
    """Without an article's tag: a short closing section after an advert, and a line that is mostly a link between others."""
    body = ["A long paragraph of the article, with many words in it. " * 8 for _ in range(40)]
    linked = '<p>See <a href="/x">the whole of the report on this matter</a>.</p>'
    advert = '<div class="ad">' + "<p>Buy now</p>" * 4 + "</div>"
    closing = "The closing section is short beside the article, yet it is a part of it."
    page = PAGE % ("<div>" + "".join(f"<p>{x}</p>" for x in body[:20]) + linked + "".join(f"<p>{x}</p>" for x in body[20:]) + advert + f"<p>{closing}</p></div>")
    want = [*(x.strip() for x in body[:20]), "See the whole of the report on this matter.", *(x.strip() for x in body[20:]), closing]
    assert html_text.extract(page).split("\n") == want


def test_html_text_beside_articles():
    """The main text is in a <div> and only teasers are in <article>: it surges all the same."""
    text = [f"Paragraph {i} of the main text, which is long enough to be one." for i in range(5)]
    page = PAGE % ("<div>" + "".join(f"<p>{x}</p>" for x in text) + "</div><article><p>Teaser</p></article>")
    assert html_text.extract(page).split("\n") == [*text, "Teaser"]


def test_html_odd(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a<p>b &am", "x"), (4, "u", "<" * 3000, "x"), (5, "u", "<article>" + "<p>x " * 5000, "x")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_text.extract_table(pages).collect()}
    assert out[1].text == out[2].text == "" and out[None].text == "a\nb &am" and out[5].n_chars == 9999


def test_media(spark, tmp_path):
    stored = media.store(frame(spark, ODD), f"file://{tmp_path}/shards")
    assert media.headers(media.addresses(stored)).count() == 6
    out = media.media_table(frame(spark, ODD)).collect()
    assert len(out) == len(ODD)
    for r in out:
        raw = (next(t for i, t, *_ in ODD if i == r.doc_id) or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert media.from_png(media.to_png(bytes(range(256)))) == bytes(range(256))
    import tarfile

    names = [m.name for p in (tmp_path / "shards").iterdir() for m in tarfile.open(p)]
    assert names and all(re.fullmatch(r"[0-9a-f]{2}/[0-9a-f]{64}\.png", n) for n in names)
    assert media.media_table(frame(spark, ODD).limit(0)).count() == 0


def test_bpe_in_groups():
    """Pre-tokens of many texts in one queue, long ones and repeated ones among them, equal each text on its own."""
    ranks = byte_bpe.read_ranks(open(byte_bpe.VOCABULARY, "rb").read())
    own, codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Codec(ranks)
    rng = random.Random(12)
    texts = ["", "a" * 5000, "abcab" * 900, "the theatre", *(" ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 12))) for _ in range(60)) for _ in range(300)), "", "a" * 5000]
    for _ in range(2):  # known pre-tokens the second time
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_batch(texts)] == own.encode_ordinary_batch(texts)
    assert max(map(len, codec)) <= byte_bpe.REMEMBERED_CHARS


def test_bpe_empty_table(spark):
    assert byte_bpe.encode_table(frame(spark, ODD).limit(0)).count() == 0


def test_toxicity_without_candidates(spark):
    """Empty partitions, and texts in which no candidate is found, give no counts rather than a frame Arrow rejects."""
    texts = spark.createDataFrame([("a b",), ("",)], "text string").repartition(5)
    assert toxicity._counts(texts).count() == 0
    assert toxicity._counts(spark.createDataFrame([("blorgo",)], "text string"), frozenset({" other "})).count() == 0
    docs = frame(spark, [(i, f"a b {i}" if i % 2 else f"blorgo w{i}", "a", "en") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert " blorgo " in lexicon.entries or " blor" in lexicon.entries
    rows = {r.doc_id: r.predicted for r in toxicity.score_table(docs, lexicon).collect()}
    assert all(rows[i] == 1 - i % 2 for i in range(200))


def test_toxicity_equal_texts_with_two_labels(spark):
    """One text labelled both ways counts once, as toxic, whatever the order of rows."""
    rows = [(i, "glarp here" if i < 60 else f"plain words {i}", "a", "en") for i in range(200)]
    labels = [(i, 1, i % 2 if i < 60 else 0) for i in range(200)] + [(200 + i, 1, 1) for i in range(40)]
    rows += [(200 + i, f"zonk {i}", "a", "en") for i in range(40)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = [toxicity.learn(frame(spark, rows).repartition(n), marks) for n in (1, 6)]
    assert found[0].entries == found[1].entries and np.allclose(found[0].curve, found[1].curve)


def test_one_is_read_as_i_and_as_l():
    lexicon = toxicity.Lexicon({" clown ": 3.0, " idiot ": 2.0})
    plain = lexicon.measures("a clown and an idiot")
    assert lexicon.measures("a c1own and an 1d10t") == plain and lexicon.measures("a c1own and an idiot") == plain


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><body><article><p>Text of it</p></article>", "Text of it"),
        ("<html><head><title>t</title><meta charset=x><article><p>Text of it</p></article>", "Text of it"),
        ('<div class="content has-sidebar"><article><p>Text of it</p></article></div>', "Text of it"),
        ('<div class="no-comments"><article><p>Text of it</p></article></div>', "Text of it"),
        ('<article><p>Text of it</p><p class="related-work">Related work is older</p></article>', "Text of it\nRelated work is older"),
        ('<div class="sidebar"><main><p>Text of it</p></main></div>', "Text of it"),
        ("<article><p>Text of it</p><button>Buy<p>and more</p><button>Sell</article>", "Text of it\nBuy\nand more\nSell"),
        ("<article><p>Text</p><select><option>a</select><button>Buy</button><p>end<script>if (a < b) '</p>'", "Text\nend"),
        ('<div><p><a href="/x">A heading that is a link</a></p><p>A paragraph that is long enough to make the window surge.</p><p><a href="/y">And a link that ends it</a></p></div>', "A heading that is a link\nA paragraph that is long enough to make the window surge.\nAnd a link that ends it"),
        ('<article><p>Text</p><div class="cookie-notice">We use</div><div id="comment-list"><p>Reader</p></div><p class="site-footer">x</p></article>', "Text"),
    ],
)
def test_html_layouts(page, want):
    assert html_text.extract(page) == want


def test_html_generated_pages():
    """Pages put together of an article that is known and of parts that are none, in many layouts."""
    rng = random.Random(21)
    words = "the of a report wind river says new people water and light house under".split()
    sentence = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b))).capitalize() + "."
    for n in range(300):
        blocks, html = [], []
        for _ in range(rng.randint(1, 14)):
            text = sentence(4, 60)
            kind = rng.choice(("p", "p", "p", "h2", "li", "blockquote"))
            inner = text.replace("and", "<b>and</b>", 1).replace(" of ", "\n\t of ", 1).replace("wind", "<a href='/w'>wind</a>", 1)
            blocks.append(text)
            html.append(f"<ul><li>{inner}</li></ul>" if kind == "li" else f"<{kind}>{inner}</{kind}>" if kind != "p" or rng.random() < 0.7 else f"<p class='lead'>{inner}")
            if rng.random() < 0.15:
                html.append(rng.choice(('<div class="ad-slot">Buy this</div>', "<script>x('<p>no</p>')</script>", "<aside><p>Side note of the page</p></aside>", "<form><p>Your mail</p><button>Go</button></form>", '<div id="newsletter"><p>Subscribe to it</p></div>', "<!-- <p>gone</p> -->")))
        around = rng.choice(("<article>%s</article>", "<main>%s</main>", "<div role='main'>%s</div>", '<div class="content has-sidebar"><article>%s</article></div>', "<main><section>%s</section></main>"))
        head = rng.choice(("<head><title>A title</title></head>", "<head><title>A title</title>", "<title>A title</title>", "<head><style>p{}</style>"))
        page = f"<!doctype html><html>{head}<body class='no-js'><header><p>The name of the site, in many words</p></header><nav><ul><li><a href='/'>Home</a></ul></nav>{around % ''.join(html)}<section class='comments'><article><p>{sentence(20, 40)}</p></article></section><footer><p>{sentence(5, 30)}</p></footer></body></html>"
        assert html_text.extract(page) == "\n".join(blocks), page


def test_html_empty_table_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<main><p>a"), (1, "u", "<main><p>a")], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract_table(pages).collect()] == ["a", "a"]
    assert html_text.extract_table(pages.limit(0)).count() == 0


def test_html_time_is_linear():
    import time

    began = time.time()
    html_text.extract("<button>x" * 40_000 + "<title>" * 5000 + "<p class='" * 2000)
    assert time.time() - began < 20


def naive_matches(lexicon, folded):
    """Each entry held against each place; phrases that spare what is inside them."""
    spared = [(i, i + len(p)) for p in map(toxicity.fold, lexicon.exceptions) if p not in lexicon.entries for i in range(len(folded)) if folded.startswith(p, i)]
    out = []
    for i in range(len(folded)):
        found = [(w, len(e)) for e, w in lexicon.entries.items() if folded.startswith(e, i)]
        if found:
            weight = max(w for w, _ in found)
            n = [n for w, n in found if w == weight]
            if not any(a <= i and i + n[0] <= b for a, b in spared):
                out.append((i, weight))
    return out


def test_toxicity_equals_naive_matching():
    rng = random.Random(31)
    lexicon = toxicity.Lexicon({" clown ": 3.0, " mor": 2.0, " moron ": 4.5, " trash ": 2.5, " pathet": 1.5, " scum ": 5.0})
    words = ["clown", "fish", "moron", "m0ron", "morons", "tr@sh", "can", "Pathetic", "ЅСUМ", "pond", "scum", "removal", "the", "clowns", "class", "1", "c1own"]
    for _ in range(2000):
        folded = toxicity.fold(rng.choice((" ", ", ", "-")).join(rng.choice(words) for _ in range(rng.randint(0, 12))))
        assert [(a, w) for a, _, w in lexicon.matches(folded)] == naive_matches(lexicon, folded)


def test_toxicity_odd_texts(spark):
    lexicon = toxicity.Lexicon({" clown ": 3.0})
    rows = [*ODD, (7, "x " * 200_000 + "clown", "a", "en"), (7, "x " * 200_000 + "clown", "a", "en"), (8, "clown", "a", "en")]
    out = toxicity.score_table(frame(spark, rows), lexicon).collect()
    assert len(out) == len(rows) and len({r.score for r in out if r.doc_id == 7}) == 1
    assert max(out, key=lambda r: r.score).doc_id == 8
    empty = {r.score for r in out if r.doc_id in (1, 2, 5)}
    assert len(empty) == 1


def test_quality_equals_direct_solution(spark):
    """The summed normal equations give what numpy solves over all learnt rows at once, and calibration is isotonic."""
    rng = random.Random(33)
    rows = [(i, " ".join(f"{rng.choice('abcdef')}{rng.choice(('lo', 'ra', 'min'))}{rng.choice(('', '', '$')) if i % 3 else '#'}" for _ in range(rng.randint(20, 60))), "a", "en") for i in range(500)]
    docs, marks = frame(spark, rows), spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(500)], "doc_id long, quality int, toxic int")
    scorer = quality.learn(docs, marks)
    learnt = [(t, i % 3 != 0) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = quality.matrix([t for t, _ in learnt]), np.array([float(v) for _, v in learnt])
    assert np.allclose(scorer.mean, x.mean(0)) and np.allclose(scorer.scale[x.std(0) > 1e-9], x.std(0)[x.std(0) > 1e-9])
    fit = np.array([zlib.crc32(t.encode()) % 4 > 0 for t, _ in learnt])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))[fit]
    z, total = scorer.lift(x[fit]), weight.sum()
    side = z.T @ (z * weight[:, None]) / total + 1e-3 * np.diag([0.0] + [1.0] * (quality.FEATURES - 1)) + 1e-9 * np.eye(quality.FEATURES)
    assert np.allclose(z @ scorer.beta, z @ np.linalg.solve(side, z.T @ (weight * y[fit]) / total), atol=1e-6)


def test_isotonic_equals_min_max_formula():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = np.arange(20.0), rng.integers(0, 2, 20).astype(float)
        best = [max(min(y[i : j + 1].mean() for j in range(k, 20)) for i in range(k + 1)) for k in range(20)]
        at, value = quality.isotonic(x, y)
        blocks, k = [], 0
        while k < 20:
            j = k
            while j + 1 < 20 and abs(best[j + 1] - best[k]) < 1e-12:
                j += 1
            blocks.append((x[k : j + 1].mean(), (y[k : j + 1].sum() + 0.5) / (j - k + 2)))
            k = j + 1
        assert np.allclose(at, [b[0] for b in blocks]) and np.allclose(value, [b[1] for b in blocks])


def test_quality_empty_table_and_repeated_rows(spark):
    scorer = quality.Scorer(np.zeros(18), np.ones(18), np.zeros((18, 3)), np.zeros(3), np.ones(4), (np.array([0.0, 9.0]), np.array([0.0, 1.0])))
    assert quality.score_table(frame(spark, ODD).limit(0), scorer).count() == 0
    out = quality.score_table(frame(spark, ODD), scorer).collect()
    assert len(out) == len(ODD) and len({r.score for r in out if r.doc_id == 4}) == 1


def test_pii_far_context():
    """A cue counts however much white space, or however long a token, stands between it and the value."""
    crf = pii.fit()
    whole = dataclasses.replace(crf, margin=-1.0)
    for gap in (" ", " " * 500, "\n" * 90, " " + "y" * 300 + " "):
        text = f"token{gap}24be64439e3e49cf46b2d7c90f3602a3d0b907ff and so on"
        assert pii.added_spans([text], crf) == pii.added_spans([text], whole)


def test_bpe_forgets_what_it_has_not_met_lately(monkeypatch):
    """A worker with room for few pre-tokens gives the same ids, and decodes by small blocks."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 40)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 200)
    monkeypatch.setattr(byte_bpe, "DECODED", 7)
    ranks = byte_bpe.read_ranks(open(byte_bpe.VOCABULARY, "rb").read())
    own, codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Codec(ranks)
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinorstß") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts = [" ".join(words[min(int(rng.paretovariate(0.5)), 399)] for _ in range(rng.randint(0, 40))) for _ in range(200)]
    found = list(codec.encode_batch(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == own.encode_ordinary_batch(texts)
    assert [codec.decode(x).decode() for x in found] == texts
    assert 0 < len(codec.older) < 200 and len(codec) < 200
    codec.forget()
    assert not codec and not codec.older


def test_bpe_refuses_ids_without_tokens():
    codec = byte_bpe.Codec({b"a": 0, b"b": 3, b"ab": 5})
    assert codec.decode(np.array([5, 3, 0], "<u4").tobytes()) == b"abba" and codec.decode(b"") == b""
    for wrong in (1, 6):
        with pytest.raises(IndexError):
            codec.decode(np.array([0, wrong], "<u4").tobytes())
