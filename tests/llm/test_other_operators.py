"""Pages, vectors, conversations and urls."""

import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import ann, chat, html_main, queries, url_filter

# 2 main text


def test_main_text_of_marked_pages(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></ul></nav>"
        "<div class=\"ad\">buy</div><article><h1>Head &amp; more</h1><p><b>One  two<br><p>Three &lt;b&gt; &eacute;\n four</p><aside>no</aside>"
        "<p><a href='#'>link only</a></p><div id='comments'><p>me too</p><div>and me</div></div><p>2 < 3</article><footer>&copy; f</footer>"
    )
    assert html_main.main_text(page) == "Head & more\nOne two\nThree <b> é four\nlink only\n2 < 3"
    got = html_main.extract(spark.createDataFrame([(1, "u", page, "old"), (2, None, None, None), (3, "", "", ""), (1, "u", page, "old")], "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text"] and sorted(r.text for r in got.collect())[:2] == ["", ""] and got.count() == 4
    assert html_main.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_main_text_of_unmarked_pages():
    page = "<div class=sidebar><p>side " + "x " * 200 + "</p></div><p><a href=1>a</a></p><div id=main><p>" + "word " * 40 + "</p><p>short</p><p>" + "more " * 40 + "</p></div><p><a href=2>b</a></p><p>tail</p><form>send</form>"
    text = html_main.main_text(page)
    assert text.split("\n")[:3] == [("word " * 40).strip(), "short", ("more " * 40).strip()] and "side" not in text and "send" not in text


def test_left_open_markup_is_survived():
    assert html_main.main_text("<div class='ad'>buy<article><p>kept</p></article>") == "kept"
    for cut in range(0, 60):
        html_main.main_text("<article><p title='a>b'>x</p><!-- c --><script>y</script>"[:cut])
    assert html_main.main_text("<article><p>one<p>two <b>bold<p>three") == "one\ntwo bold\nthree"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<section class='comments'><article><p>me too</article></section><article><p>body</article>", "body"),
        ("<aside><article><p>teaser</article></aside><article><p>body</article><div class='site-footer'>f</div>", "body"),
        ("<article><svg width='1'/><title-card>one</title-card><p>two</article>", "one\ntwo"),
        ("<article><p class='related-work'>a<h2 id='search'>b</h2><div class='widget-intro'>c</div><p>d <span class='share'>e</span></article>", "a\nb\nc\nd e"),
        ("<article><header><h1>head</h1><p>by me</p></header><p>x <math><mi>y</mi></math></p></article>", "head\nx y"),
        ("<p>short</p>", "short"),
        ("<article><p>first</p><div class='ad'><p>1</p><p>2</p><p>3</p><p>4</p></div><p>last</p></article>", "first\nlast"),
        ("<main><p>all of it</p><div id='cookie-notice'>yes</div></main><p>outside</p>", "all of it"),
        ("<p title=\"the hidden gem\">seen</p><p hidden>not</p><p aria-hidden=true>nor this</p>", "seen"),
        ("<article>1 < 2 &lt;b&gt; &amp;amp; x&nbsp;y<br>z</article>", "1 < 2 <b> &amp; x y z"),
        ("", ""), ("<script>only", ""), ("<nav><p>menu</p></nav>", ""),
    ],
)
def test_pages_by_hand(page, text):
    assert html_main.main_text(page) == text


def test_windows_part_teasers_from_text():
    teaser = "<article><p>a teaser</p></article>"
    page = teaser + "<nav><p>1<p>2<p>3<p>4</nav><article>" + f"<p>{'long text ' * 40}</p>" * 3 + "<p>end</p></article>"
    assert html_main.main_text(page).endswith("end") and "teaser" not in html_main.main_text(page)
    assert html_main.main_text(teaser) == "a teaser"


def test_window_sums_and_regions_against_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, rng.randrange(1, 300)]) for _ in range(rng.randrange(30))]
        sums = html_main.window_sums(w)
        assert sums == [sum(w[max(0, i - 1) : i + 2]) for i in range(len(w))]
        inside = [i for a, b in html_main.regions(sums) for i in range(a, b)]
        assert inside == [i for i, s in enumerate(sums) if s]


@pytest.mark.parametrize("bad", ["<p <p ", '<a title="x ', "<a title='", "<div class=ad>x", "</div>", "<!-- ", "<div><b></p>", "<b>x", "<div class=ad><article>x", "&amp"])
def test_broken_markup_takes_linear_time(bad):
    page = bad * (1_000_000 // len(bad))
    began = time.process_time()
    html_main.main_text(page)
    assert time.process_time() - began < 8  # a second or three; the square would take an hour


# 5 nearest neighbours


def brute_nearest(rows, queries_, k):
    out = []
    for q, x in queries_:
        near = sorted((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in rows if i != q and len(y) == len(x))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(near[:k])]
    return sorted(out)


def test_ann_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_ROWS", 10)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-8, 9, 12).astype(float).tolist()) for i in range(300)]
    rows = [(i, rows[0][1] if i % 3 == 1 else v) for i, v in rows]  # a third of the rows are one vector: ties by id
    bad = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0] * 11 + [float("inf")]), (904, [1.0] * 11 + [None]), (905, []), (906, [1.0, 2.0])]
    d = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<float>")
    good = ann.usable(d, "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(good.where("id % 20 = 0"), good, 20).collect())
    assert got == brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    few = good.where("id < 5")
    assert ann.nearest(few, few, 20).count() == 20
    assert ann.nearest(good.limit(0), good, 3).count() == 0 and ann.nearest(few, good.limit(0), 3).count() == 0


def test_huge_components_lose_no_pair(spark):
    rows = [(1, [1e200, 1.0]), (2, [1e200, 2.0]), (3, [3.0, 1e160]), (4, [1e-200, 1e-201]), (5, [2.0, 1.0])]
    d = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(d, d, 4).collect())
    assert got == brute_nearest(rows, rows, 4)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(60, 64)) * 10
    (q8, qs, qn, qe), (c8, cs, cn, ce) = ann.quantise(x), ann.quantise(y)
    near = q8.astype(float) @ c8.astype(float).T * qs[:, None] * cs[None, :]
    assert (np.abs(near - x @ y.T) <= qn[:, None] * ce + cn * qe[:, None] + qe[:, None] * ce + 1e-9).all()


# 7 chat


def test_escapes_are_reversible():
    rng = random.Random(0)
    for _ in range(5000):
        s = "".join(rng.choice(["<", "s>", "</s>", "[INST]", "[/INST]", "\\", "[", "<|", "x", "<s>", "/", "\n"]) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(s)) == s and not any(c in chat.escape(s) for c in chat.CONTROLS)
        assert chat.parse_inst(chat.inst_template([(s, s[::-1]), ("u", s)])) == [(s, s[::-1]), ("u", s)]


def test_common_ends():
    rng = random.Random(12)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(2))
        n = min(len(a), len(b))
        assert chat._prefix(a, b) == max(k for k in range(n + 1) if a[:k] == b[:k])
        assert chat._suffix(a, b) == max(k for k in range(n + 1) if a[len(a) - k :] == b[len(b) - k :])


def test_whole_table_of_conversations(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.conv_id: r for r in queries.op7_chat_spans(spark, sf).collect()}
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(turns)
    for c, ts in turns.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        want = (len(ts), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want


def test_spans_by_rendering_only():
    turns = [("system", "be kind"), ("user", "a </s> b"), ("assistant", "0"), ("user", ""), ("assistant", "1 and [INST]")]
    done = chat.render_incrementally(turns, chat.inst_template)
    assert [chat.unescape(done.text[a:b]) for a, b in done.text_spans] == [t for _, t in turns]
    assert done.turn_spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(done.turn_spans, done.turn_spans[1:])) and not done.rewrites
    last_only = lambda ts: "".join(f"<{r}>{t if i == len(ts) - 1 else t.strip()}" for i, (r, t) in enumerate(ts))
    assert chat.render_incrementally([("u", "x "), ("a", "y ")], last_only).rewrites == [1]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, None, None), (None, 5, "user", "lost"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(d)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 3 and got[3].n_turns == 2 and got[2].n_turns == 1 and None in got
    assert chat.format_conversations(d.limit(0)).count() == 0


def test_control_conversation(spark):
    r = {x.conv_id: x for x in queries.op7_chat_spans(spark, "/root/testdata/sf0.001").collect()}[-7]
    assert r.n_turns == 2 and r.loss_chars == len("</s>[INST] ok [/INST]")


# 8 urls


def test_word_splits():
    m = url_filter.UrlModel()
    assert m.tokens("cheappillscasino", "") == ["cheap", "pills", "casino"]
    assert m.score(m.tokens("freebets.example.org", "/casino/win")) > 0 > m.score(m.tokens("library.example.org", "/history/book"))
    assert m.words.split("") == [] and "".join(m.words.split("zqx" * 30)) == "zqx" * 30


def test_viterbi_against_all_splits():
    rng = random.Random(13)
    m = url_filter.WordModel({"a": 9, "ab": 5, "abc": 4, "b": 3, "ca": 6, "cab": 2, "bb": 1})
    for _ in range(200):
        name = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        splits = [[name[i:j] for i, j in zip((0, *cut), (*cut, len(name)))] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)]
        best = min(-sum(m.cost(w) for w in s) for s in splits)
        words = m.split(name)
        assert "".join(words) == name
        known = [w if w in m.logp else None for w in words]
        assert all(x or y for x, y in zip(known, known[1:]))  # unknown letters in a row are one word
        cost = -sum(m.cost(w) if w in m.logp else max(sum(m.cost(p) for p in s) for s in ([w[i:j] for i, j in zip((0, *c), (*c, len(w)))] for k in range(len(w)) for c in itertools.combinations(range(1, len(w)), k))) for w in words)
        assert cost == pytest.approx(best)


def test_words_are_counted_by_hosts(spark):
    urls = [f"http://red{i}.garten-haus.org/zaun/x" for i in range(3)] + ["http://only.net/zaunzaun"] * 9 + ["http://red0.garten-haus.org/zaun"] * 5 + [None, "nohost", "http:///zaun"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert {r.word: r.hosts for r in url_filter.word_counts(pages).collect()} == {w: 3 for w in ("red", "garten", "haus", "org", "zaun", "x")}
    m = url_filter.UrlModel({r.word: r.hosts for r in url_filter.word_counts(pages).collect()})
    assert m.tokens("gartenzaun.org", "") == ["garten", "zaun", "org"]
    assert url_filter.word_counts(pages.limit(0)).count() == 0


def _site_urls():
    rng = random.Random(21)
    bad, good = ["spielbank", "einzahlung", "hotgirls", "quickcash"], ["garten", "rezept", "wetter", "verein"]
    urls = [None, "no scheme"]
    for i in range(400):
        listed = i % 2 == 0  # the other half can only be known by the words they share with these
        words, seeds = (bad, ["casino", "poker", "jackpot"]) if i % 4 < 2 else (good, ["museum", "library", "recipes"])
        name = f"q{chr(97 + i % 26)}{chr(97 + i // 26)}z"
        for _ in range(1 + 30 * (i == 0)):
            path = "/".join([*rng.sample(words, 2), *([rng.choice(seeds)] * listed)])
            urls.append(f"http://{rng.choice(words)}.{name}.org/{path}/{rng.randrange(99)}")
    return urls, bad, good


def test_classes_spread_from_the_lists_to_words_that_share_their_hosts(spark):
    urls, bad, good = _site_urls()
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(5)
    counts = {r.word: r.hosts for r in url_filter.word_counts(pages).collect()}
    plain = url_filter.UrlModel(counts)
    assert not {*bad, *good} & {*plain.odds}
    m = url_filter.learn(pages, plain)
    # the same in plain Python, over all hosts
    hosts = {}
    for u in filter(lambda u: u and "://" in u, urls):
        host, _, path = u.partition("://")[2].partition("/")
        hosts.setdefault(host, set()).update(w for w in plain.tokens(host, "/" + path) if w in plain.words.logp)
    odds = dict(plain.odds)
    for _ in range(url_filter.ROUNDS):
        n = {}
        for words in hosts.values():
            p = 1 / (1 + math.exp(-plain.prior - sum(odds.get(w, 0) for w in words)))
            for w in words - plain.odds.keys():
                a, b = n.get(w, (0, 0))
                n[w] = a + p, b + 1 - p
        block, allow = (sum(x[k] for x in n.values()) for k in (0, 1))
        for w, (a, b) in n.items():
            spread = url_filter.SHRINK * (a + b) / (block + allow)
            odds[w] = math.log((a + spread) / (block + url_filter.SHRINK)) - math.log((b + spread) / (allow + url_filter.SHRINK))
    assert m.odds == pytest.approx(odds)
    got = {r.url: r for r in url_filter.judge(pages, rules=()).collect()}
    for u in filter(lambda u: u and "://" in u, urls):
        host, _, path = u.partition("://")[2].partition("/")
        score = plain.prior + sum(odds.get(w, 0) for w in plain.tokens(host, "/" + path))
        assert got[u].url_score == pytest.approx(score) and got[u].verdict == ("block" if score > 0 else "allow")
        assert got[u].verdict == ("block" if any(w in u for w in bad) else "allow")
    assert m.score(m.tokens("hotgirlsspielbank.net", "")) > 0 > m.score(m.tokens("wettergarten.net", "")) and plain.score(plain.tokens("hotgirlsspielbank.net", "")) < 0
    assert url_filter.learn(pages.limit(0), plain).odds == plain.odds


def test_rules(spark):
    urls = [
        "http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://x.com", "http://x.com?/en/", "http://x.net/es/1", "http://notnet/es/", "x.com/", None,
        "http://b.www.example.com/en/#z", "ftp://spam-farm.example.org/free/casino", "http://x.com/http://y.net/es/", "http://x.com/",
    ]
    got = {r.url: r for r in url_filter.judge(spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert got[urls[0]].rule == "example.com/en/" and got[urls[0]].verdict == "block" and got[urls[0]].host == "a.example.com"
    assert got[urls[1]].rule == got[urls[8]].rule == "www.example.com/en/" and got[urls[1]].verdict == "allow"
    assert got[urls[2]].rule is None and got[urls[2]].path == "" and got[urls[3]].path == ""
    assert got[urls[4]].rule == "net/es/" and got[urls[5]].rule is None
    assert got[urls[6]].host == "" and got[None].host == "" and got[None].verdict == "allow"
    assert got[urls[9]].verdict == "block" and got[urls[10]].rule == "com/" and got[urls[11]].rule == "com/"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("box", ["div class='reader-comments'", "div class='post-comments'", "ol class='commentlist'", "section class='reactions'", "div class='comment-thread'", "div class='advert-300x250'"])
def test_comment_and_advert_boxes_by_parts_of_names(box):
    page = f"<article><p>{'text ' * 60}</p><{box}><p>{'me too ' * 20}</p></{box.split()[0]}><p>the end</p></article>"
    assert html_main.main_text(page) == f"{('text ' * 60).strip()}\nthe end"


def test_a_short_section_behind_an_advert_stays():
    page = f"<body><p>{'long ' * 600}</p><div class=ad><p>1<p>2<p>3<p>4</div><p>{'end ' * 30}</p></body>"
    assert html_main.main_text(page).endswith(("end " * 30).strip())
