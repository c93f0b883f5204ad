import itertools
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, html_text, langid, pii

from .odd import ROWS, no_docs, odd_docs


def test_forward_sums_all_segmentations():
    v = langid.vocabulary(None)
    rng = np.random.default_rng(0)
    p = np.vstack([rng.random((v.size, 2)), np.zeros((1, 2))])
    p /= p.sum(0)
    pieces, words = {}, ["a", "the", "tion", "straße", "qué", "ሰላም", "a한"]
    for places, ids, _ in v.lattice(words):
        for place, lattice in zip(places, ids, strict=True):
            word = langid.MARK + words[place]
            for i, k in itertools.product(*map(range, lattice.shape)):
                if lattice[i, k] >= 0:
                    pieces[word[i : i + k + 1]] = lattice[i, k]
    assert "ሰ" not in pieces
    spelled = lambda letter: np.prod([p[v.bytes_from + b] for b in letter.encode()], axis=0)
    for word, score in zip(words, langid.word_scores(words, p), strict=True):
        whole, mass = langid.MARK + word, np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(whole) - 1):
            parts = "".join(c + "|" * cut for c, cut in zip(whole, (*cuts, 0), strict=True)).split("|")
            # a letter is read as its own piece, if it is one, or as its bytes
            mass += np.prod([(p[pieces[x]] if x in pieces else np.zeros(2)) + (spelled(x) if len(x) == 1 else 0.0) for x in parts], axis=0)
        assert np.allclose(score, np.log(mass), atol=1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).where(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    got = langid.identify(odd_docs(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") != letters and (r.score == 0 or letters) and r.key == r.source
    assert langid.identify(no_docs(spark)).count() == 0
    unlabelled = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert all(r.lang_pred == "und" for r in langid.identify(unlabelled).collect())
    assert langid.keep_identified(odd_docs(spark)).columns == odd_docs(spark).columns


PLAIN = {"de": "der hund und die katze schlafen nicht in dem alten haus", "en": "the dog and the cat are not asleep in the old house"}


def taught(spark, extra):
    """A table of plain sentences in two languages, with ``extra`` rows among them."""
    rows = [(lang, PLAIN[lang]) for _ in range(20) for lang in PLAIN]
    rows = [x for k, row in enumerate(rows) for x in ([row, extra[k // 2]] if k % 2 == 0 and k // 2 < len(extra) else [row])]
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").coalesce(1)


@pytest.mark.parametrize("n", [1, 36, 39, 40, 41, 45, 400, 10_000])
def test_letters_outside_the_vocabulary(n):
    strange = ["\U000103a0" * n, "ሰ" * n, "the" + "ሰ" * n + "fox"]
    words = langid.split_words(pa.array(strange)).flatten().to_pylist()
    p = np.full((langid.vocabulary(None).size + 1, 2), 1e-7)
    p[-1] = 0
    assert np.isfinite(langid.word_scores(words, p)).all()
    learned = langid.fit([*words, "the"], np.ones(len(words) + 1))
    assert np.isfinite(learned).all() and math.isclose(learned.sum(), 1)


@pytest.mark.parametrize("held", [1, 700, 2_000_000])
def test_long_runs_of_letters_are_one_lattice(held, monkeypatch):
    """Slices of a lattice carry their masses: a run of any length sums all segmentations, and the fit sees it whole."""
    monkeypatch.setattr(langid, "HELD", held)
    rng, v = np.random.default_rng(5), langid.vocabulary(None)
    p = np.vstack([rng.dirichlet(np.ones(v.size), 2).T, np.zeros((1, 2))])
    for words in (["donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichenfabrikant"], ["the", "the" * 30, "x" * 41]):
        for word, score in zip(words, langid.word_scores(words, p), strict=True):
            pieces = {piece: i for i, piece in enumerate(plain_pieces(v))}
            text, sums = langid.MARK + word, [np.zeros(2)]
            for end in range(1, len(text) + 1):
                raw = [v.bytes_from + b for b in text[end - 1].encode()]
                ways = [sums[end - 1] + np.log(p[raw]).sum(0)] + [sums[start] + np.log(p[pieces[text[start:end]]]) for start in range(max(0, end - v.longest), end) if text[start:end] in pieces]
                sums.append(np.logaddexp.reduce(ways))
            assert score == pytest.approx(sums[-1], rel=1e-9)
    fitted = langid.fit(["the" * 30, "haus", "a" * 200], np.array([2.0, 3.0, 1.0]))
    assert fitted.sum() == pytest.approx(1) and np.isfinite(fitted).all()
    assert langid.split_words(pa.array(["Ab" * 50 + " c"])).to_pylist() == [["ab" * 50, "c"]]


def plain_pieces(v):
    """The vocabulary's pieces in the order of their ids, read again from its file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.vocabulary_path("piece_bpe_32k.model"))
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return sorted({x for x in plain if (body := x.removeprefix(langid.MARK)).isalpha() and body == body.lower() or x == langid.MARK})


def test_strange_rows_change_no_other_row(spark):
    strange = "ሰ" * 45
    docs = taught(spark, [(None, strange), (None, "\U000103a0" * 10_000), (None, strange + " the fox")])
    langs, p = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langs, p).collect()}
    assert all(0 <= score <= 1 for _, score in got.values())
    for order in (F.desc("doc_id"), F.xxhash64("doc_id")):
        again = langid.predict(docs.orderBy(order).coalesce(1), langs, p).collect()
        assert all(got[r.doc_id][0] == r.lang_pred and math.isclose(got[r.doc_id][1], r.score, rel_tol=1e-9) for r in again)
    alone = langid.predict(docs.where(F.col("text").isin(*PLAIN.values())), langs, p).collect()
    assert all(r.lang_pred == r.lang and math.isclose(got[r.doc_id][1], r.score, rel_tol=1e-9) for r in alone)


def test_strange_training_rows_poison_no_language(spark):
    strange = "ሰ" * 45
    docs = taught(spark, [("en", strange)] * 8)
    assert docs.where(F.col("text") == strange).where(~langid.held_out(F.col("doc_id"))).count() > 3
    got = langid.identify(docs).collect()
    assert all(r.lang_pred == r.lang and 0.9 < r.score <= 1 for r in got)


def test_scripts_outside_the_vocabulary_are_told_apart(spark):
    texts = {"am": "ሰላም ለዓለም ሁሉ ደህና ነው", "hy": "բարև աշխարհ ինչպես եք այսօր", "km": "សួស្តី ពិភពលោក ទាំងអស់"}
    rows = [(lang, t) for _ in range(12) for lang, t in texts.items()]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    other = spark.createDataFrame([(1, "ዓለም", "am"), (2, "աշխարհը", "hy"), (3, "ពិភព", "km")], docs.schema)
    langs, p = langid.train(docs)
    assert all(r.lang_pred == r.lang for r in langid.predict(other, langs, p).collect())


def test_kept_rows_keep_their_columns(spark):
    docs = taught(spark, []).withColumn("score", F.lit(99)).withColumn("lang_pred", F.lit("mine"))
    got = langid.keep_identified(docs)
    assert got.columns == docs.columns and {(r.score, r.lang_pred) for r in got.collect()} == {(99, "mine")}


def test_labelled_table_is_learned():
    x, y = html_text.labelled_table()
    assert (html_text.classify(html_text.grow(x, y), x) == y).all()


@pytest.fixture(scope="module")
def tree():
    return html_text.grow(*html_text.labelled_table())


def test_main_text(tree):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
    <nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy now and save a lot of money today.</div><div id="cookie-notice"><p>We use cookies here.</p></div>
    <article><h1>Title &amp; more</h1><p>One  two\n three <a href=x>link</a>.<p><b>Short.<br>Next</b></p><aside>See also this.</aside><form><p>Mail</p></form><p>A &lt;b&gt; &#233;</p></article>
    <section class="comments"><p>A long comment of a reader that goes on and on and on.</p></section><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page, tree) == "Title & more\n\nOne two three link.\n\nShort. Next\n\nA <b> é"


def test_pages_without_article(tree):
    body = "word " * 40
    page = f"<div class=menu><a href=#>home</a></div><div><p>{body}</p><p>{body}</p></div><div class=footer>{body}</div>"
    assert html_text.main_text(page, tree) == "\n\n".join([body.strip()] * 2)


@pytest.mark.parametrize("anchor", ['<a id="top"/>', "<a href=https://x.org/>text</a>", '<a name="x"></a>', '<a href="/y"/>text<a href="/z">more</a>'])
def test_anchors_that_end_in_a_slash(tree, anchor):
    body = "word " * 40
    page = f"<div class=menu><a href=#>home</a></div><div><p>{anchor} {body}</p><p>{body}</p><p>{body}</p></div><div class=footer>{body}</div>"
    blocks = html_text.text_blocks(page)
    assert [b.linked for b in blocks] == [1, len(re.findall("text|more", anchor)), 0, 0, 0]
    assert html_text.main_text(page, tree).count("word") == 120
    inside = html_text.text_blocks(f'<div><a id="top"/><p>{body}</p><p>{body}</p></div>')
    assert [b.linked for b in inside] == [0, 0]


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>a<", "</div></p>", "<!-- never closed", "<script>never closed", "<a href='x>y", "<" * 5000, "<p>" * 5000 + "x", "&#x110000; &bad;", "a\x00b"])
def test_broken_pages(tree, page):
    assert isinstance(html_text.main_text(page, tree), str)


PROSE = "We show that the result holds for all cases and say why it does so in each of them. " * 4


@pytest.mark.parametrize("lead", ["<a href=https://x.org/>", "<a href=https://x.org/ >", '<a href="https://x.org/">', '<a name="top"/>'])
def test_nothing_is_lost_behind_an_unquoted_link(tree, lead):
    page = f"<div>{lead}start</a></div>" + f"<p>{PROSE}</p>" * 3
    assert html_text.main_text(page, tree).count("We show") == 12


def test_scripts_are_never_text(tree):
    for script in ("<script src=https://x.org/>var code = 1;</script>", "<script src='a'>if (a < b) { c = '</p>'; }</SCRIPT >", "<style>p > a{}</style\n>"):
        assert html_text.main_text(f"{script}<article><p>{PROSE}</p>{script}</article>", tree) == PROSE.strip()


@pytest.mark.parametrize("inner, text", [
    ("We prove that <math><mi>x</mi><mo>&gt;</mo><mn>0</mn></math> holds for all", "We prove that x>0 holds for all"),
    ("a <noscript>b</noscript> c", "a\n\nb\n\nc"), ("a <canvas>b</canvas> <object>c</object>", "a b c"), ("a <svg><path d=x /><text>no</text></svg> b", "a b"),
    ("a &amp b &#x41;&#00000000000065; &#99999999999; &lt;p&gt;", "a & b AA � <p>"), ("1 < 2 <é> 3", "1 < 2 <é> 3"), ("a<!-- x --!> b --> c<!--> d", "a c d"),
])
def test_inside_an_article(tree, inner, text):
    assert html_text.main_text(f"<article>{inner}</article>", tree) == text


@pytest.mark.parametrize("name, kept", [
    ("related-work", True), ("social-history", True), ("share-price", True), ("comment-on-law", True), ("related-posts", False), ("social-share-buttons", False), ("comments", False), ("ad", False), ("page-footer", False), ("cookie-notice", False),
])
def test_sections_by_name(tree, name, kept):
    page = f"<article><p>{PROSE}</p><section class={name}><p>{PROSE}</p></section><p>{PROSE}</p></article>"
    assert html_text.main_text(page, tree).count("We show") == (12 if kept else 8)


FOUR = "".join(f"<p>{PROSE}</p>" for _ in range(4))
AROUND = "<nav><a href=/>home</a> <a href=/b>more</a></nav><div class=cookie-notice><p>We use cookies to do many things that you may not like at all.</p></div>{}<section id=comments><h3>Comments</h3><p>" + "I have read this and think that it is wrong in every way. " * 9 + "</p><p>So do I.</p></section><div class=footer><p>Some rights reserved by someone.</p></div>"
ITEMS = "".join(f"<p>Line {i} is short.</p>" for i in range(10))


@pytest.mark.parametrize("inner, text", [
    (f'<form id="aspnetForm" action=x>{FOUR}</form>', "\n\n".join([PROSE.strip()] * 4)),
    (f'<form id="aspnetForm"><div class="header"><a href=/>Site</a></div>{FOUR}<form><label>Mail</label></form></form>', "\n\n".join([PROSE.strip()] * 4)),
    (f'<div class="sidebar-right"><div>{FOUR}</div></div>', "\n\n".join([PROSE.strip()] * 4)),
    (f'<div class="layout sidebar-right"><article><p>{PROSE}</p></article></div>', PROSE.strip()),
    (f'<form><main><h1>Title</h1><p>{PROSE}</p><form><input><p>Subscribe</p></form></main></form>', f"Title\n\n{PROSE.strip()}"),
    (f'<article><p>{PROSE}</p><section id="social"><h2>Social effects</h2><p>They are many.</p></section></article>', f"{PROSE.strip()}\n\nSocial effects\n\nThey are many."),
    ('<article><div class="section-header"><h2>Heading</h2></div><p>Text.</p></article>', "Heading\n\nText."),
    ('<article><table><tr class="table-header"><th>Name</th><th>Age</th></tr><tr><td>Ann</td><td>9</td></tr></table></article>', "Name\n\nAge\n\nAnn\n\n9"),
    ('<article><p>One.</p><div class="notice"><p>Mind the gap.</p></div></article>', "One.\n\nMind the gap."),
    (ITEMS, "\n\n".join(f"Line {i} is short." for i in range(10))),
    (f"<h1>Ten lines</h1><div>{ITEMS}</div>", "\n\n".join(["Ten lines", *(f"Line {i} is short." for i in range(10))])),
    (f"<noscript>{FOUR}</noscript>", "\n\n".join([PROSE.strip()] * 4)),
    (f'<div class="sidebar"><p>{PROSE}</p></div>{FOUR}', "\n\n".join([PROSE.strip()] * 4)),
    ("", ""),
])
def test_ordinary_pages(tree, inner, text):
    """Wrappers named as what they are not, parts of articles with such names, short paragraphs: the text is whole, what stands around is gone."""
    assert html_text.main_text(AROUND.format(inner), tree) == text
    assert html_text.main_text(f"<body>{inner}</body>", tree) == text


def test_names_and_wrappers_in_linear_time(tree):
    page = "<div class=sidebar>" * 60_000 + f"<article><p>{PROSE}</p></article>"
    start = time.perf_counter()
    assert html_text.main_text(page, tree) == PROSE.strip() and time.perf_counter() - start < 60


def drawn(rng, depth=0, inside=False, linked=False):
    """Well-formed markup and what its blocks are: a list of words with their links and whether an article holds them."""
    page, blocks, words = "", [], lambda: [f"w{rng.integers(99)}" for _ in range(rng.integers(1, 5))]
    for _ in range(rng.integers(1, 5)):
        kind = rng.integers(6) if depth < 5 else rng.integers(3)
        text = words()
        if kind == 0:
            page, blocks = page + " ".join(text) + " \n", [*blocks, (text, linked, inside)]
        elif kind == 1 and not linked:
            page, blocks = page + f"<a href='>'><b>{'</b> <i>'.join(text)}</i></b></a> ", [*blocks, (text, True, inside)]
        elif kind == 2:
            page += "<!-- > <p> -->" + "<script>'<p>'</script>"
        else:
            tag = ("div", "section", "article", "blockquote", "ul")[rng.integers(5)]
            own, found = drawn(rng, depth + 1, inside or tag == "article")
            page, blocks = page + f"<{tag} title='a > b'>{own}</{tag.upper()} >", [*blocks, None, *found, None]
    return page, blocks


def test_blocks_of_drawn_pages():
    rng = np.random.default_rng(7)
    for _ in range(400):
        page, found = drawn(rng)
        want = []
        for between, run in itertools.groupby(found, lambda b: b is None):
            if not between:
                run = list(run)
                want.append((" ".join(w for text, _, _ in run for w in text), sum(len(text) for text, linked, _ in run if linked), int(run[0][2])))
        assert [(b.text, b.linked, b.inside) for b in html_text.text_blocks(page)] == want, page


def test_an_article_is_kept_whole(tree):
    rng = np.random.default_rng(3)
    for _ in range(300):
        parts = [" ".join(["word"] * int(rng.choice([1, 2, 3, 5, 9, 20, 60]))) for _ in range(rng.integers(1, 7))]
        marks = [f"<a href=#>{p}</a>" if rng.random() < 0.3 else p for p in parts]
        tag, block = ("article", "main")[rng.integers(2)], ("p", "li", "h2", "div", "td")[rng.integers(5)]
        page = f"<nav><a href=#>home</a></nav><div class=ad>{parts[0]}</div><{tag}>{''.join(f'<{block}>{m}</{block}>' for m in marks)}</{tag}><footer>{parts[0]}</footer>"
        assert html_text.main_text(page, tree) == "\n\n".join(parts), page


def test_words_and_links_of_neighbours_decide_where_nothing_is_named():
    plain = [s for s in html_text.SHAPES if not re.search("class=|<article|<main|<nav|<form", s)]
    assert len(plain) > 10
    density, whole = [], []
    for shape in plain:
        x, y = html_text.labelled_table(tuple(s for s in html_text.SHAPES if s != shape))
        new, truth = html_text.labelled_table((shape,), 20)
        k = len(html_text.DENSITY)
        density.append((html_text.classify(html_text.grow(x[:, :k], y, 6), new[:, :k]) == truth).mean())
        whole.append((html_text.classify(html_text.grow(x, y), new) == truth).mean())
    assert np.mean(density) > 0.85 and np.mean(whole) > 0.95
    assert html_text.FEATURES[html_text.grow(*html_text.labelled_table()).feature] in html_text.DENSITY


@pytest.mark.parametrize("page", [
    "<div>x" * 160_000, "<a " * 300_000, "</div>" * 160_000, "<div>" * 80_000 + "</p>" * 80_000, '<a ">"' * 160_000, "<ul><li>" * 100_000, "<span class=ad>" * 30_000 + "<b>" * 150_000, "<!--" * 250_000, "<" * 1_000_000,
    "<script>" + "</script " * 100_000, "<p class='" + "advert_" * 100_000 + "!'>x", "&#" + "0" * 500_000 + "65;" + "&#" + "9" * 400_000,
], ids=range(12))
def test_a_megabyte_of_bad_markup_takes_seconds(tree, page):
    start = time.perf_counter()
    html_text.main_text(page, tree)
    assert time.perf_counter() - start < 60


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"), (None, "u", "<article><p>x</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    broken = df.limit(1).select(F.lit(5).cast("long").alias("page_id"), "url", F.expr("CAST(X'3C703EC3283C2F703E' AS STRING)").alias("html"))
    assert [r.n_chars for r in html_text.extract_main_text(broken).collect()][0] in (0, 2)
    got = sorted([tuple(r) for r in html_text.extract_main_text(df).collect()], key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (None, "u", "x", 1)], key=repr)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def model():
    turns = [("system", "System: Be kind."), ("user", "User: What is it?\nTell me."), ("assistant", "Assistant: It is this.\nAnd that."), ("user", "Q: Why?"), ("assistant", "A: Because."), ("tool", "Tool: {}")]
    return chat.fit([turns] * 20)


def test_viterbi_equals_the_best_of_all_paths():
    m, lines = model(), ["User: hello there?", "more", "Assistant: yes"]
    e = chat.emissions(lines, m)
    best = max(itertools.product(range(chat.STATES), repeat=3), key=lambda s: m[0][chat.START, s[0]] + e[0, s[0]] + m[0][s[0], s[1]] + e[1, s[1]] + m[0][s[1], s[2]] + e[2, s[2]])
    (entered, last), = chat._chain([chat.transfer(lines, m)], chat.ENTRY, -1)
    assert tuple(chat.decode(lines, m, entered, last)) == best


def test_chunks_do_not_change_the_result(spark, monkeypatch):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    raw, m = chat.raw_transcripts(conversations), chat.fit(chat.labelled_sample(conversations))
    whole = sorted(map(tuple, chat.parse_transcripts(raw, m).collect()))
    monkeypatch.setattr(chat, "LINES", 1)
    monkeypatch.setattr(chat, "FAN", 2)
    monkeypatch.setattr(chat, "RANGE", 2)
    assert sorted(map(tuple, chat.parse_transcripts(raw, m).collect())) == whole
    truth = {(r.conv_id, r.turn): r.role for r in conversations.collect()}
    marked = [(c, t, role) for c, t, role, *_ in whole]
    assert sum(truth.get((c, t)) == role for c, t, role in marked) >= 0.9 * len(marked)


def test_roles_of_transcripts_that_were_not_learned_from(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    third = F.pmod(F.col("conv_id"), F.lit(3)) == 0
    fitted = chat.fit(chat.labelled_sample(conversations.where(third)))
    truth = {(r.conv_id, r.turn): r.role for r in conversations.where(~third).collect()}
    got = chat.parse_transcripts(chat.raw_transcripts(conversations.where(~third)), fitted).collect()
    assert len(truth) > 200 and sum(truth.get((r.conv_id, r.turn_no)) == r.role for r in got) >= 0.9 * len(got)


def test_one_row_of_many_lines_is_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "LINES", 5)
    text = "\n".join(x for i in range(30) for x in (f"User: what is {i}?", "more", f"Assistant: it is {i}."))
    got = chat.parse_transcripts(spark.createDataFrame([(1, 0, text)], "conv_id long, part long, text string"), model()).collect()
    assert sum(r.n_lines for r in got) == 90 and [r.role for r in sorted(got, key=lambda r: r.turn_no)] == ["user", "assistant"] * 30


def test_texts_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'74686520FF20666F78' AS STRING) AS text, 'en' AS lang UNION ALL SELECT 3, 'der hund', 'de' UNION ALL SELECT 4, 'the dog', 'en'")
    assert sorted(r.doc_id for r in langid.identify(docs).select("doc_id", "score").collect()) == [1, 3, 4]


def test_odd_transcripts(spark):
    df = spark.createDataFrame([(1, 0, "User: hi"), (1, None, None), (None, 3, "AI: yes"), (2, 0, ""), (2, 0, "")], "conv_id long, part long, text string")
    got = chat.parse_transcripts(df, model()).collect()
    assert {r.conv_id for r in got} == {1, 2, None} and sum(r.n_lines for r in got) == 5
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>" for r in got)
    assert chat.parse_transcripts(df.limit(0), model()).count() == 0


#: The contract's patterns, as given.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            n = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f x@y", "mail me: é.ü@x.de, joe.doe+1@ex-ample.co.uk!", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (170) 123-4567 or +1 2",
    "5 4 3  2 1", "00000000000000000000000", "١٢٣ 😀 4111111111111111 😀 x@y.zz", "@" * 3000, "1" * 20000, "1 " * 20000, "a" * 50000 + "@b.c", "x@" * 5000, "999.1.1.1.1.1.1 ..1.2.3.4", "+1 234 567 890 1 4111111111111111",
    "IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "ssn 123-45-6789 and 123-45-6789",
]


def test_base_spans_equal_the_patterns(spark):
    texts = TRICKY + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_spans(df).collect():
        assert [(s.start, s.rank, s.kind, s.end) for s in r.spans if s.rank < 4] == brute_spans(r.text), r.text[:80]
        assert [(s.start, s.rank) for s in r.spans] == sorted((s.start, s.rank) for s in r.spans)


def test_added_spans_and_redaction(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in pii.pii_spans(df).collect()}
    assert "iban" in kinds[15] and "iban" not in kinds[16] and kinds[17].count("national_id") == 2
    clean = {r.doc_id: r.text for r in pii.without_personal_data(df).collect()}
    assert clean[1] == "mail me: é.ü@x.de, joe.doe+1@ex-ample.co.uk!".replace("joe.doe+1@ex-ample.co.uk", "[EMAIL]").replace("ü@x.de", "ü@x.de")
    assert clean[7] == "١٢٣ 😀 [CARD] 😀 [EMAIL]" and clean[5] == TRICKY[5]


def test_personal_data_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = pii.pii_spans(docs).collect()
    assert len(got) == len(ROWS) and all(r.spans == [] for r in got)
    kept = pii.without_personal_data(docs)
    assert kept.columns == docs.columns and sorted(map(repr, kept.select("doc_id", "text", "n_chars").collect())) == sorted(map(repr, docs.select("doc_id", "text", "n_chars").collect()))
    assert pii.pii_spans(no_docs(spark)).count() == 0 and math.isfinite(pii.ACCEPT)


def test_running_sums_over_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "RUN", 3)
    values = [[], [5], list(range(3)), list(range(10)), list(range(100)), [7, 1, 9, 3] * 20]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>")
    for r in df.select("v", pii.running(F.col("v")).alias("sums"), pii.running(F.col("v"), F.greatest).alias("most")).collect():
        assert r.sums == list(itertools.accumulate(r.v)) and r.most == list(itertools.accumulate(r.v, max))


def test_pieces_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 4)
    text = "a😀b\nc\r\n dé f" * 3
    df = spark.createDataFrame([(text, a, b) for a in range(len(text)) for b in range(a, len(text) + 6)], "t string, a int, b int")
    for r in df.select("*", pii.cut(pii.text_pieces(F.col("t")), F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == text[r.a : r.b]


@pytest.mark.parametrize("text, found", [
    ("BE68 5390 0754 7034 OK", ["BE68 5390 0754 7034"]),
    ("BE68539007547034 DE89370400440532013000", ["BE68539007547034", "DE89370400440532013000"]),
    ("GB29 NWBK 6016 1331 9268 19 and NO93 8601 1117 947.", ["GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"]),
    ("BE68 5390 0754 7035", []), ("XX68 5390 0754 7034", []), ("BE68 5390 0754 70345", []),
    ("serial BE68 5390 0754 7034", []), ("serial of the account BE68 5390 0754 7034", ["BE68 5390 0754 7034"]),
])
def test_ibans_end_where_their_country_says(spark, text, found):
    (r,) = pii.pii_spans(spark.createDataFrame([(text,)], "text string")).collect()
    assert [text[s.start : s.end] for s in r.spans if s.kind == "iban"] == found


def test_words_on_either_side_weigh(spark):
    texts = {"ssn 123-45-6789": [75], "123-45-6789 is my social security number": [75], "123-45-6789": [], "order 123-45-6789, ssn": [], "mail a@b.cc": [90], "contact a@b.cc": [100], "order a@b.cc": [70]}
    for r in pii.pii_spans(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert [s.score for s in r.spans] == texts[r.text], r.text


def test_many_matches_in_one_text(spark):
    card, mail = "4111 1111 1111 1111", "a.b@example.com"
    text = "; ".join(f"{card}, {i}, {mail}" for i in range(20_000))
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    start = time.perf_counter()
    (r,) = pii.pii_spans(df).collect()
    assert time.perf_counter() - start < 240
    assert [(s.start, s.end) for s in r.spans if s.kind == "card"] == [m.span() for m in re.finditer(card, text)]
    assert [(s.start, s.end) for s in r.spans if s.kind == "email"] == [m.span() for m in re.finditer(mail, text)]
    (clean,) = pii.without_personal_data(df).collect()
    assert clean.text == text.replace(card, "[CARD]").replace(mail, "[EMAIL]") and clean.n_chars == len(clean.text)
    numbers = " x ".join(str(10**15 + i) for i in range(200_000))
    start = time.perf_counter()
    (r,) = pii.pii_spans(df.withColumn("text", F.lit(numbers))).collect()
    assert time.perf_counter() - start < 240 and len(r.spans) == sum(luhn(str(10**15 + i)) for i in range(200_000))


def test_redaction_leaves_clashing_columns(spark):
    df = spark.createDataFrame([("mail a@b.cc", [7]), (None, None)], "text string, spans array<int>")
    assert sorted(map(tuple, pii.without_personal_data(df).collect()), key=repr) == sorted([("mail [EMAIL]", [7]), (None, None)], key=repr)
