"""Chat formatting round trips and page extraction cases."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hydrosheaf.llm import chat, extract

EVENTS = "conv_id bigint, seq bigint, kind string, role string, text string, target bigint"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.text(alphabet="</s>[INST] \\ok\n", max_size=30) | st.text(max_size=20)), max_size=6))
def test_any_messages_come_back(messages):
    rendered, spans = chat.render(messages)
    assert chat.parse(rendered) == messages
    assert [chat.unescape(rendered[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]


def test_events_fold(spark):
    rows = [
        (1, 3, "delta", "assistant", "lo", 2), (1, 1, "message", "user", "hi", None), (1, 2, "delta", "assistant", "hel", 2),
        (1, 4, "edit", "user", "hi!", 1), (1, 5, "edit", "user", "x", 99), (1, 6, "message", "user", "more", None),
        (2, 1, None, "user", "q", None), (2, 2, "message", "assistant", "bad", None), (2, 3, "message", "user", "follow", None),
        (2, 4, "regenerate", None, None, 2), (2, 5, "message", "assistant", "good", None),
        (None, 1, "message", None, None, None), (3, None, "message", "assistant", "first", None), (3, 1, "message", "user", "same", None), (3, 1, "message", "user", "same", None),
    ]
    got = {r.conv_id: chat.parse(r.rendered) for r in chat.formatted(spark.createDataFrame(rows, EVENTS).repartition(3)).collect()}
    assert got == {
        1: [("user", "hi!"), ("assistant", "hello"), ("user", "more")], 2: [("user", "q"), ("assistant", "good")],
        None: [("unknown", "")], 3: [("assistant", "first"), ("user", "same"), ("user", "same")],
    }


def test_digest_of_turns(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]", 7), (1, 0, "user", None, 8), (2, 0, "assistant", "a\\[b", 9), (2, 1, "assistant", "", 9)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq bigint")
    got = {r.conv_id: r for r in chat.digest(chat.formatted(chat.events_of(table))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\n</s>[INST] ok [/INST]\n") and got[1].n_turns == 2
    assert got[1].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[1].loss_chars == 21
    assert got[2].loss_sha256 == sha("a\\[b") and got[2].loss_chars == 4
    assert chat.digest(chat.formatted(chat.events_of(table.limit(0)))).count() == 0


def texts(html):
    return [t for k, t in extract.blocks(html) if k != extract.GONE]


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li>Home<li>News</ul></nav><div class="ad banner">Buy</div><!-- <p>no</p> --><script>var t="</p>";</script>
    <article><header><h1>Head&amp;line</h1></header><p><b>One<br>two<p>Three&nbsp;&lt;four&gt;  <i>five</i>six</p>
    <aside>Related</aside><div id="comments"><p>Reader says</p></div><form><p>Mail</p></form><ul><li>a<li>b &#233;</ul>
    <table><tr><td>c<td>d</table></article><div role="contentinfo">Imprint</div><footer>&copy;</footer></body></html>"""
    assert texts(page) == ["Head&line", "One two", "Three <four> fivesix", "a", "b é", "c", "d"]
    assert texts(None) == texts("") == [] and texts("plain text") == ["plain text"]
    assert texts("<p>a</p><p hidden>b</p><p style='display:none'>c</p><p aria-hidden=true>d</p>") == ["a"]
    assert texts("<article><p>un<b>closed") == ["unclosed"] and texts("<div>1 < 2 & 3</div>") == ["1 < 2 & 3"]


def test_repeated_strings_of_a_host_go(spark):
    def page(k, host, body):
        return (k, f"http://{host}/{k}", body, "clash")

    notice = "We keep the right to change this page at any time without notice"
    rows = [page(k, "a.org", f"<div>{notice}</div><div>Text number {k} has its own words like w{k} x{k} y{k} z{k}</div>") for k in range(5)]
    rows += [page(10, "b.org", f"<div>{notice}</div>"), page(11, "c.org", None), page(12, "d.org", "<article><p>Same article text on two pages of it</p></article>"),
             page(13, "d.org", "<article><p>Same article text on two pages of it</p></article>"), (14, None, "<p>no host</p>", "x"), (14, None, "<p>no host</p>", "x"),
             page(15, "e.org", "<div>copied page as a whole with open text</div>"), page(16, "e.org", "<div>copied page as a whole with open text</div>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract.extracted(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    for k in range(5):
        assert by[k] == f"Text number {k} has its own words like w{k} x{k} y{k} z{k}"
    assert by[10] == notice and by[11] == "" and by[12] == by[13] == "Same article text on two pages of it" and by[14] == "no host"
    assert by[15] == by[16] == "copied page as a whole with open text"
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract.extracted(df.limit(0)).count() == 0


def test_names_that_only_sound_like_furniture_stay():
    body = "<article><h1>T</h1><p>Text</p></article>"
    for wrapper in ("class='layout with-sidebar'", "id='page' class='no-header'", "class='has-menu'", "class='search'", "id='sidebar-wrapper'"):
        assert texts(f"<div {wrapper}><p>Lead</p>{body}</div>") == ["Lead", "T", "Text"]
        assert texts(f"<div {wrapper}><nav>Menu</nav><div><div class=ad>Buy</div>{body}</div><div class=ad>Buy</div></div>") == ["T", "Text"]
    assert texts(f"<form id='form1'><header>Site</header><main><p>a</p></main></form>") == ["a"]
    inside = "<section id='related-work'><p>a</p></section><section id='comments'>b</section><h2 id='search'>c</h2><h2 id='comments-on-method'>d</h2><p class='social-history'>e</p>"
    assert texts(f"<article>{inside}</article>") == ["a", "b", "c", "d", "e"]
    gone = "".join(f"<div class='{c}'>x</div>" for c in ("ad", "big ad_box", "site-footer", "main-nav", "comment-list", "ad-1", "Cookie-Notice"))
    assert texts(f"<article>{gone}<p>a</p></article>{gone}<div role='contentinfo'>x</div>") == ["a"]
    # comments are articles too: what is named furniture or stands in the text's article is not given back
    assert texts("<div class='comments'><article class='comment'>x</article></div><article>a<div class='comments'><article>x</article></div></article>") == ["a"]
    assert texts("<div class='comments' hidden><article>x</article></div><aside><article>x</article></aside><p>b</p>") == ["b"]


def test_short_blocks_and_copies_stay(spark):
    """Short blocks beside unlike ones, page copies with other furniture and near copies keep their open text."""
    own = [" ".join(f"own{k}w{i}" for i in range(30)) for k in range(9)]
    rows = [(k, f"http://a.org/{k}", f"<div>Read the full story</div><p>{own[k]}</p>") for k in range(3)]
    rows += [(k, f"http://b.org/{k}", f"<nav>day {k} of the site and its many menus</nav><p>{own[3]}</p>") for k in range(3, 5)]
    near = " ".join(f"n{i}" for i in range(200))
    rows += [(k, f"http://c.org/{k}", f"<p>{near} seen on day {k}</p>") for k in range(5, 7)]
    rows += [(7, "http://d.org/7", f"<p>{near}</p>"), (8, None, f"<p>{own[8]}</p>"), (9, "", f"<p>{own[8]} more</p>")]
    got = {r.page_id: r.text for r in extract.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(3):
        assert got[k] == f"Read the full story\n\n{own[k]}"
    assert got[3] == got[4] == own[3]
    assert got[5] == f"{near} seen on day 5" and got[6] == f"{near} seen on day 6" and got[7] == near


def test_repeats_reach_over_blocks(spark):
    """Boilerplate of several short blocks goes; the main element interrupts the stream."""
    lead = ["Welcome to the daily paper of town", "Subscribe now and read it all", "Weather today is fine and warm", "Our shop sells maps and books"]
    own = lambda k, n: " ".join(f"own{k}w{i}" for i in range(n))
    rows = [(k, "http://a.org/", "".join(f"<div>{t}</div>" for t in lead) + f"<p>{own(k, 30)}</p>") for k in range(6)]
    rows += [(k, "http://b.org/", f"<p>{lead[0]}</p><article>{own(k, 9)}</article><p>{lead[1]}</p>") for k in range(6, 9)]
    rows += [(k, "http://c.org/", f"<nav>{lead[0]}</nav><p>{lead[1]} {own(k, 20)}</p>") for k in range(9, 12)]
    got = {r.page_id: r.text for r in extract.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    for k in range(6):
        assert got[k] == own(k, 30)
    for k in range(6, 9):
        assert own(k, 9) in got[k]
    for k in range(9, 12):
        assert got[k] == f"{lead[1]} {own(k, 20)}"       # a short part of a block stays


def test_cover_is_that_of_a_sorted_suffix_array(spark):
    """Maximal repeats from sorted suffixes and common prefixes remove the same tokens."""
    import random

    rng = random.Random(5)
    phrases = [[f"p{j}x{i}" for i in range(rng.randrange(3, 40))] for j in range(12)]
    pages = []
    for k in range(14):
        tokens = []
        for j in rng.sample(range(12), 3):
            a = rng.randrange(0, 3)
            tokens += phrases[j][a:] + [f"u{k}y{i}" for i in range(rng.randrange(1, 25))]
        pages.append(tokens)
    # a stream is cut into blocks anywhere, some of them of few tokens
    marks = [sorted(rng.sample(range(1, len(t)), min(6, len(t) - 1))) for t in pages]
    cut = [[" ".join(t[a:b]) for a, b in zip([0] + m, m + [len(t)])] for t, m in zip(pages, marks)]
    rows = [(k, "http://a.org/", "".join(f"<p>{b}</p>" for b in c)) for k, c in enumerate(cut)]
    got = {r.page_id: r.text.split() for r in extract.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}

    array = sorted((t[i:], k, i) for k, t in enumerate(pages) for i in range(len(t)))
    covered = [set() for _ in pages]
    for x in range(len(array)):
        s, k, i = array[x]
        for way in (-1, 1):
            y, common = x + way, len(s)
            while 0 <= y < len(array):
                other = array[y][0]
                common = next((c for c in range(min(common, len(other))) if s[c] != other[c]), min(common, len(other)))
                if common < extract.RUN:
                    break
                if array[y][1] != k:
                    covered[k].update(range(i, i + common))
                    break
                y += way
    assert any(covered)
    for k, t in enumerate(pages):
        kept = []
        for a, b in zip([0] + marks[k], marks[k] + [len(t)]):
            runs = "".join("x" if i in covered[k] else "." for i in range(a, b))
            if "." in runs:                                     # covered blocks go, else long runs
                kept += [w for w, c in zip(t[a:b], re.sub(f"x{{{extract.RUN},}}", lambda m: "-" * len(m[0]), runs)) if c != "-"]
        assert got[k] == kept
