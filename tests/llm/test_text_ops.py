"""Extraction, quality, PII, toxicity, language and URL operators."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logsieve.llm import html_mincut, langid, line_crf, mixing, pii, toxicity, urls
from logsieve.llm.char_crf import CharCrf
from logsieve.sources.tables import table

SF = "/root/testdata/sf0.001"


# --- main text -------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar">
<div id="top-menu"><a href="/a">Home</a> <a href="/b">News</a></div>
<div class="cookie-notice">We use cookies on this site to improve it, please accept.</div>
<div class="page"><h1>The storm of 1987</h1><p>The night of the storm was long, and many trees
fell &amp; broke across the south of the country.<p>Short one.<div class="ad-box">Buy one now, get a second free!</div>
<p>Towns were cut off for days, said the <a href="x">report</a>,<br>and power came back slowly.</div>
<div class=sidebar><h3>Related</h3><ul><li><a href=z>Other storm</a></ul></div>
<section id="comments"><p>Great article, I remember this night very well indeed, it was long.</p></section>
<form><label>Email</label><input></form><script>if (a < b) { x("</p>") }</script><footer>Copyright</footer></body></html>"""


def test_main_text():
    assert html_mincut.main_text(PAGE).split("\n") == [
        "The storm of 1987", "The night of the storm was long, and many trees fell & broke across the south of the country.",
        "Short one.", "Towns were cut off for days, said the report, and power came back slowly."]
    assert html_mincut.main_text("<article><h1>T</h1><p>A.</p><aside>x</aside><p>B<br>C</article><p>out") == "T\nA.\nB C"
    for broken in (None, "", "<", "<div", "<!-- x", "<script>a", "<a href='x>y'>", "<nav>x</nav>", "</p></div>"):
        assert html_mincut.main_text(broken) == ""


STORM = "<article><h1>The storm</h1><p>The night of the storm was long, and many trees fell across the south.</p>%s</article>"


@pytest.mark.parametrize("name", ["layout has-sidebar", "overflow-hidden", "with-header", "comments-enabled", "sidebar"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_of_wrappers_do_not_count(name, tag):
    page = (STORM % "").replace("article", tag)
    assert html_mincut.main_text(f'<div class="{name}"><div class="menu"><a href=x>Home</a></div>{page}</div>') == \
        "The storm\nThe night of the storm was long, and many trees fell across the south."


def test_sections_named_like_page_parts():
    said = "<h2>Earlier work</h2><p>Earlier studies of storms counted the trees but not the towns.</p>"
    for names in ('section id="related-work"', 'section class="social-history"', 'section id="discussion"', 'div id="related-work"'):
        assert html_mincut.main_text(STORM % f"<{names}>{said}</{names.split()[0]}>").endswith(
            "south.\nEarlier work\nEarlier studies of storms counted the trees but not the towns."), names
    assert html_mincut.main_text(STORM % '<h2 id="discussion">Discussion</h2><p>Storms are longer.').endswith(
        "\nDiscussion\nStorms are longer.")
    for other in ('<div class="ad-box">Buy one now, get a second free!</div>',
                  '<div class="related-posts"><h3>Related</h3><ul><li><a href=z>Other storm of the year</a><li><a href=y>More</a></ul></div>',
                  '<section id="comments"><ol class="comment-list"><li><article class="comment-body"><p>' + "I remember this night. " * 30):
        assert html_mincut.main_text(STORM % other) == html_mincut.main_text(STORM % ""), other


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.lists(st.floats(0, 2), min_size=12, max_size=12))
def test_min_cut_is_minimal(gain, weights):
    gain = np.array(gain)
    pairs = list(itertools.combinations(range(len(gain)), 2))
    edges = [(a, b, w) for (a, b), w in zip(pairs, weights)]

    def cost(side):
        return (sum(abs(g) for g, x in zip(gain, side) if (g > 0) != x and g != 0)
                + sum(w for a, b, w in edges if side[a] != side[b]))

    best = min(cost(s) for s in itertools.product([False, True], repeat=len(gain)))
    assert cost(html_mincut.min_cut(gain, edges).tolist()) == pytest.approx(best, abs=1e-6)


def test_extract_pages_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"),
            (3, "w", "<article>" + "<p>long enough text, to be sure.</p>" * 20000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {(r.page_id, r.url): r for r in html_mincut.extract_pages(df).collect()}
    assert found[(2, None)].text == "" and found[(None, "v")].n_chars == 0
    assert found[(3, "w")].n_chars == 20000 * 30 - 1
    assert html_mincut.extract_pages(df.limit(0)).count() == 0


def test_raw_elements_and_formulas():
    """A script is a script however its tag ends; formulas and fall-back texts are text."""
    page = ("<html><body><article><h1>The bridge</h1>"
            "<script src=/a/b/>var x = leak(1);</script><style type=text/>p { leak: 2 }</style>"
            "<p>The old bridge carried <math><mi>x</mi><mo>+</mo><mn>1</mn></math> carts a day, as the wardens wrote, for years.</p>"
            "<p>Nobody counted the carts <svg><text>leak</text></svg>in winter, <svg width=1 />when the river froze and they stayed home.</p>"
            "<object data=x.bin>A plan of the bridge was drawn by the mason, it is said, before the flood came.</object>"
            "</article></body></html>")
    text = html_mincut.main_text(page, html_mincut.DEFAULT)
    assert "leak" not in text and "carried x+1 carts" in text and "when the river froze" in text and "plan of the bridge" in text


def test_deep_nesting_takes_time_in_proportion():
    import time

    def seconds(n):
        page = "<div>" * n + "<p>A line of text that stays.</p>" + "</span></b></section>" * n + "</div>" * n
        start = time.perf_counter()
        assert len(html_mincut.blocks_of(page)) == 1
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.004)


# --- quality ---------------------------------------------------------------------
def test_base_counts():
    text = "a b c d e f g h a b c d e f g h x\n# $\n# $\n\n \na b"
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    from logsieve.llm import shingles as S
    w, first = S.word_hashes([text.encode(), b"", "é ü".encode()], S.SPACES)
    assert np.diff(first).tolist() == [len(words), 0, 2]
    assert line_crf.repeated_words(w, first).tolist() == [16, 0, 0]
    assert line_crf.line_features(None) == ([], [])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, line_crf.N - 1), min_size=1, max_size=4), min_size=1, max_size=6),
       st.integers(0, 10**6))
def test_viterbi_is_best(rows, seed):
    r = np.random.default_rng(seed)
    c = line_crf.Chain(r.normal(size=(line_crf.N, 2)), r.normal(size=(2, 2)), r.normal(size=2))

    def score(y):
        e = c.scores(rows)
        return c.start[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(c.move[a, b] for a, b in zip(y, y[1:]))

    best = max(score(y) for y in itertools.product((0, 1), repeat=len(rows)))
    assert score(c.viterbi(rows)) == pytest.approx(best)


def test_fit_takes_very_long_texts():
    """Memory goes with the lines, not with the longest text times the texts."""
    import tracemalloc

    good = [line_crf.line_masks("A long and quiet line that ends well.\n" * 4)] * 300
    bad = [line_crf.line_masks("# $ | %\n" * 4)] * 300
    endless = line_crf.line_masks("".join(f"line {i} of a very long text.\n" for i in range(200_000)))
    assert len(endless) == 200_000
    masks = [*good, *bad, endless, np.zeros(0, dtype=np.uint16)]
    wrong = np.array([False] * 300 + [True] * 300 + [False, True])
    tracemalloc.start()
    c = line_crf.fit_chain(masks, wrong, np.ones(len(masks)), steps=12)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    rows, _ = line_crf.line_features("# $ | %\nA long and quiet line that ends well.\n" * 2)
    assert c.viterbi(rows[:1]) == [1] and c.viterbi(rows[1:2]) == [0]


def test_fit_climbs_the_likelihood():
    """The fitted chain against all label sequences of short texts: no small step helps."""
    r = np.random.default_rng(5)
    masks = [r.integers(0, 1 << 5, n).astype(np.uint16) for n in (1, 2, 3, 4, 2, 3)]
    wrong = np.array([True, False, True, False, False, True])

    def likelihood(c):
        total = 0.0
        for m, bad in zip(masks, wrong):
            rows = [[k for k in range(line_crf.N) if x >> k & 1] for x in m]
            e = c.scores(rows)
            scores = {y: c.start[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(c.move[a, b] for a, b in zip(y, y[1:]))
                      for y in itertools.product((0, 1), repeat=len(rows))}
            gold = scores[tuple([int(bad)] * len(rows))]
            total += (gold - np.logaddexp.reduce(list(scores.values()))) / len(rows) / len(masks)
        return total

    c = line_crf.fit_chain(masks, wrong, np.ones(len(masks)), steps=1500, rate=0.05, l2=1e-2)
    flat = np.concatenate((c.emit.ravel(), c.move.ravel(), c.start))

    def value(t):
        n = 2 * line_crf.N
        return likelihood(line_crf.Chain(t[:n], t[n:n + 4], t[n + 4:])) - 0.5e-2 * (t ** 2).sum()

    for _ in range(20):
        assert value(flat + r.normal(size=len(flat)) * 0.05) <= value(flat) + 1e-6


def test_quality_rows(docs, spark):
    good = "The morning was cold and the river ran high after a week of rain.\n" \
           "Nobody on the bridge said a word, and the boats stayed where they were."
    rows = [(1, good), (1, good), (2, None), (3, ""), (4, "menu | home | a | b | c | d |\n" * 5), (None, good),
            (5, "word " * 50000), (6, good + "\n" + "x! " * 3)]
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for table_ in (labels, labels.limit(0)):
        found = line_crf.judge_quality(docs(rows), table_).collect()
        by = {r.doc_id: r for r in found}
        assert len(found) == len(rows) and by[1].kept and not by[2].kept and by[2].base_failed and not by[4].kept
        assert by[5].n_repeat_words == 50000 and by[5].base_failed and by[None].kept
    assert line_crf.judge_quality(docs([]), labels).count() == 0


# --- personal data -----------------------------------------------------------------
def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-1234059 (%é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_char_crf_gradients():
    net = CharCrf(9, 5, hidden=4, dtype=np.float64)
    r = np.random.default_rng(0)
    chars, tags = r.integers(0, 9, (3, 7)), r.integers(0, 5, (3, 7))
    live = np.arange(7)[None] < np.array([7, 4, 5])[:, None]
    _, grads = net.loss_and_grads(chars, live, tags)
    for name, value in net.p.items():
        at = tuple(r.integers(0, n) for n in value.shape)
        old, losses = value[at], []
        for step in (1e-5, -1e-5):
            value[at] = old + step
            losses.append(net.loss_and_grads(chars, live, tags)[0])
        value[at] = old
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grads[name][at], abs=1e-4)


def test_personal_data_rows(docs, spark):
    texts = table(spark, SF, "documents")
    rows = [(1, "mail a.b@mail.example.com or +1 (555) 010-7788 now"), (1, "mail a.b@mail.example.com or +1 (555) 010-7788 now"),
            (2, None), (3, ""), (4, "please write to anna (at) mail dot com now"), (None, "host 10.0.0.1"),
            (5, "1" * 200000), (6, "nothing here")]
    r = np.random.default_rng(77)  # not the seed of the training examples
    planted = [(5000 + i, i % 4, f"We were told {pii.make_span(r, i % 4)} was right, and the and of it.") for i in range(200)]
    rows += [(d, t) for d, _, t in planted]
    found = pii.find_personal_data(docs(rows).select("doc_id", "text").unionByName(texts.select("doc_id", "text")
                                   .withColumn("doc_id", texts.doc_id + 1000))).collect()
    by = {r.doc_id: r for r in found}
    assert by[1].spans == "email:5:25,phone:29:46" and (by[1].n_email, by[1].n_phone) == (1, 1)
    assert by[2].spans == by[3].spans == by[6].spans == "" == by[5].spans
    assert by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None].n_ip == 1
    # base patterns and network together, on spans neither was written for
    right = sum(by[d].spans.startswith(pii.KINDS[k] + ":13:") for d, k, _ in planted)
    base = sum(pii.told(plain_spans(t)).startswith(pii.KINDS[k] + ":13:") for _, k, t in planted)
    assert right >= 0.8 * len(planted) and right > base + 30, (right, base)
    for r in texts.collect():
        base = pii.told(plain_spans(r.text or ""))
        assert by[r.doc_id + 1000].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= {"", *by[r.doc_id + 1000].spans.split(",")}
    assert pii.redact("a x@y.zz b", [(2, 0, 8)]) == "a <email> b"


# --- toxicity, language -----------------------------------------------------------
def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_toxicity_accuracy_and_rows(docs, spark):
    sf = SF.replace("0.001", "0.01")
    found = toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    score = {r.doc_id: r for r in found}
    held = [(r.toxic, score[r.doc_id]) for r in table(spark, sf, "labels").collect()
            if r.doc_id in score and crc(r.doc_id, 5) == 0]
    assert all(s.held_out for _, s in held) and all(0 <= s.score <= 1 for _, s in held)
    right = sum((s.predicted == t) for t, s in held) / len(held)
    assert right > 0.93
    assert sum(s.predicted for t, s in held if t == 0) <= 0.02 * len(held)
    rows = [(1, None), (2, ""), (3, "you idiot, you pathetic worthless loser"), (3, "you idiot, you pathetic worthless loser"),
            (None, "fine"), (4, "calm " * 100000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    by = {r.doc_id: r for r in toxicity.score_toxicity(docs(rows), none).collect()}
    assert by[3].predicted == 1 and by[1].predicted == by[2].predicted == by[4].predicted == 0
    assert toxicity.score_toxicity(docs([]), none).count() == 0
    kept = toxicity.drop_toxic(docs(rows), none)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4] and kept.columns == docs([]).columns


def toxic_sample(docs, spark, n, words, each=1):
    """Documents of random words; the toxic third often says "zorgish", some of it thrice."""
    r = np.random.default_rng(5)
    ids = [i for i in range(1, 3 * n) if crc(i, 5)][:n]
    bad = {i: int(i % 3 == 0) for i in ids}
    rows = []
    for i in ids:
        said = [f"w{x}" for x in r.integers(0, 3000, words)]
        said[:1] = ["zorgish"] * int(r.integers(1, 5)) if bad[i] else ["Éclair", "w7"]
        rows += [(i, " ".join(said))] * each
    return docs(rows), spark.createDataFrame([(i, 1, bad[i]) for i in ids], "doc_id long, quality int, toxic int"), rows, bad


def test_toxicity_voters_are_those_of_all_counts(docs, spark):
    frame, labels, rows, bad = toxic_sample(docs, spark, 240, 40, each=2)
    lexicon, levels, weights = toxicity.fitted_model(frame, labels)
    held = {1: {}, 0: {}}
    for i, text in rows:
        h, n = np.unique(toxicity.evidence([text])[0], return_counts=True)
        for x, k in ((int(x), k) for x, c in zip(h, n) for k in (1, 2, 3) if c >= k):
            held[bad[i]][x, k] = held[bad[i]].get((x, k), 0) + 1
    n1, n0, want = sum(bad[i] for i, _ in rows), sum(not bad[i] for i, _ in rows), []
    for (x, k), a in held[1].items():
        b = held[0].get((x, k), 0)
        p1, p0, both = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 1) / (n1 + n0 + 2)
        z = (p1 - p0) / (both * (1 - both) * (1 / n1 + 1 / n0)) ** 0.5
        if z > 5 and a >= max(4, n1 * 0.004) and p1 > 4 * p0:
            want.append((-z, x, k))
    assert len(want) >= 9 and {3, 2, 1} == {k for *_, k in want}
    assert [(int(lexicon[i]), k) for i, k in levels] == [(x, k) for _, x, k in sorted(want)]
    assert len(weights) == len(levels) + 2 + len(toxicity.PATTERNS) + 1 + 4 + 1


def test_toxicity_fit_stays_small_with_long_texts(docs, spark, monkeypatch):
    fit = toxicity._fit_task

    def watched(share):
        task = fit(share)

        def run(frame):
            import tracemalloc

            tracemalloc.start()
            out = task(frame)
            peak = tracemalloc.get_traced_memory()[1] + int(frame.memory_usage(deep=True).sum())
            tracemalloc.stop()
            if peak > 8 << 20:
                raise MemoryError(f"{peak >> 20} MB in the fitting task")
            return out

        return run

    monkeypatch.setattr(toxicity, "_fit_task", watched)
    frame, labels, rows, _ = toxic_sample(docs, spark, 60, 60_000)
    assert sum(len(t) for _, t in rows) > 16 << 20
    assert len(toxicity.fitted_model(frame, labels)[0]) >= 3


def test_language_accuracy_and_rows(docs, spark):
    sf = SF.replace("0.001", "0.01")
    data = table(spark, sf, "documents")
    lang = {r.doc_id: r.lang for r in data.collect()}
    held = [r for r in langid.identify_languages(data).collect() if r.held_out]
    assert held and all(crc(r.doc_id, 4) == 2 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog went out", "en"), ("le chat et le chien", "fr")] * 20)]
    rows += [(100, None, "en"), (101, "123 !!", "en"), (102, "", None), (None, "the dog", "en"), (103, "the end " * 50000, None)]
    by = {r.doc_id: r for r in langid.identify_languages(docs(rows)).collect()}
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und" and by[103].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify_languages(docs([(1, "abc", None)])).collect()} == {"und"}
    assert langid.identify_languages(docs([])).count() == 0


# --- urls, mixing ------------------------------------------------------------------
def test_urls(spark):
    rows = [(1, "https://A.Example.ORG/en/12?x"), (2, "http://sub.example.org/es/4"), (3, "https://notexample.org/es/"),
            (4, "https://casino-win.site.net/free"), (5, None), (6, "no scheme"), (7, "x://h"), (8, "https://k.com/fr/a#b"),
            (9, "https://blog.hill.example.net/en/4"), (9, "https://blog.hill.example.net/en/4"),
            (10, "https://h.net/" + "a" * 100000), (11, "https://x.com/de/")]
    df = spark.createDataFrame([(i, u, "z", "z") for i, u in rows], "page_id long, url string, host string, rule string")
    by = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert [(by[i].rule, by[i].verdict) for i in (1, 2, 3, 8, 11)] == [
        ("example.org/en/1", "block"), ("example.org/es/", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert (by[1].host, by[1].path) == ("a.example.org", "/en/12") and (by[5].host, by[5].path) == ("", "")
    assert (by[6].host, by[7].host, by[7].path) == ("", "h", "")
    assert by[4].verdict == "block" and by[9].verdict == "allow" and len(by[10].path) == 100001
    train = spark.createDataFrame([(u, y) for u, y in urls.LABELLED_URLS], "url string, y int")
    assert all((r.verdict == "allow") == (r.y == 1) for r in urls.judge_urls(train, rules=()).collect())
    assert urls.judge_urls(df.limit(0)).count() == 0


def fill_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / (sum(w[s] for s in free) or 1)
        new = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not new:
            return {s: 2 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= new


def test_mixing(docs):
    r = np.random.default_rng(1)
    rows = [(i, " ".join("w" * int(r.integers(1, 60))) if i % 50 else None, "en", (None, "b", "a", "hot", "hot", "hot")[i % 6])
            for i in range(2500)]
    rows += [(9000, "x y z", "en", "c"), (9001, "", "en", "d"), (9000, "x y z", "en", "c"), (None, "x y", "en", "b")]
    frame = docs(rows)
    found = mixing.mix(frame, block=16).collect()
    again = mixing.mix(frame.repartition(5), block=16).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    size = {}
    for row in rows:
        size[row[3]] = size.get(row[3], 0) + len((row[1] or "").split())
    want = fill_targets(size)
    taken = {}
    for x in found:
        assert x.source_size == size[x.source] and x.target == pytest.approx(want[x.source])
        assert x.taken % max(1, x.size) == 0 and 0 <= x.taken <= 2 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert mixing.mix(docs([])).count() == 0
    out = mixing.mixed_documents(docs(rows[:200]))
    assert out.columns == [*docs([]).columns, "copy_no"]


def test_mix_of_rows_with_one_id(docs):
    rows = [(None, f"{i} " + "w " * (i % 9), "en", "a") for i in range(600)] + [(7, "x y z", "en", "a")] * 300
    rows += [(10 + i, "x y", "en", "b") for i in range(300)]
    sizes = mixing.document_sizes(docs(rows))
    numbered = mixing._single_rows(sizes).collect()
    assert len(numbered) == len(rows) and len({(r.doc_id, r.key, r.nth) for r in numbered}) == len(rows)
    want = {r.source: r.target for r in mixing.targets(sizes).collect()}
    out = mixing.mixed_documents(docs(rows), block=16).select("doc_id", "text", "source", "copy_no").collect()
    again = mixing.mixed_documents(docs(rows).repartition(5), block=16).select("doc_id", "text", "source", "copy_no").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    for source in want:
        assert abs(sum(len(r.text.split()) for r in out if r.source == source) - want[source]) <= 10
    found = mixing.mix(docs(rows), block=16).collect()
    assert len(found) == len(rows) and sum(r.taken for r in found) == sum(len(r.text.split()) for r in out)


def test_targets_of_many_sources(spark):
    r = np.random.default_rng(3)
    size = {f"http://{i}.example": int(r.pareto(0.7) * 10) for i in range(4000)} | {None: 500}
    df = spark.createDataFrame([(s, n) for s, n in size.items()], "source string, size long").repartition(8)
    found = mixing.targets(df)
    assert "Window" not in found._jdf.queryExecution().toString()  # no task holds all sources
    got, want = {r.source: r.target for r in found.collect()}, fill_targets(size)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(size.values()))
    full = mixing.targets(df, share=5.0).collect()
    assert all(r.target == 2 * r.source_size for r in full)
    assert mixing.targets(df.limit(0)).count() == 0
