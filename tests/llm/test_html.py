from itertools import groupby

import numpy as np
import pytest

from pseudolake.llm import html


def page(main, nav="Home About News Contact Jobs Help", foot="all rights reserved by the people of this host"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>x</p>";</script></head><body><nav>{nav}</nav><!-- c --><div class="ad">Buy</div>{main}<footer>{foot}</footer></body></html>'


def texts(spark, pages, host="h.org"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html.extract(df).orderBy("page_id").collect()]


def test_articles():
    cases = {
        page("<article><h1>A &amp; B</h1><p>one\n two <b>th</b>ree<br>four</p><p>five&nbsp;six &lt;x&gt;</article>"): "A & B\n\none two three four\n\nfive six <x>",
        page("<article><p>x</p><aside>no</aside><form>no<input></form><div class='comments'><p>no</p></div><p>y</article>"): "x\n\ny",
        "<article><p>cut &am": "cut &am",
        "<article><p>cut <a hre": "cut",
        '<main><p title="a>b">q</p><script>z': "q",
        "<article><header><h1>T</h1></header><p>x</p><div hidden>no</div><ul><li>1<li>2</ul></article>": "T\n\nx\n\n1\n\n2",
        '<body class="has-sidebar home"><article>a b</article>': "a b",
        '<article class="post tag-social comments-open"><p>a b</article>': "a b",
        '<div class="content-with-sidebar"><article>a b</article></div>': "a b",
        '<div class="sidebar-wrapper"><article>a b</article></div>': "a b",
        "<nav><a>menu</a><article>a b</article>": "a b",
        "<article>a b</article><aside><article>teaser</article></aside>": "a b",
        '<article>a b<article class="comment">no</article></article>': "a b",
        "<nav>only menu</nav>": "",
        "": "",
    }
    for src, want in cases.items():
        assert html.parse(src)[0] == want, src
    assert html.parse(None)[0] == ""


def test_pages_without_an_article(spark):
    cases = {
        "<body><header>h</header><div>a<div>b</div>c</div>": "a\n\nb\n\nc",
        "plain 1 < 2 text": "plain 1 < 2 text",
        '<div>the text of this page is longer</div><div class="comments"><article>no</article></div>': "the text of this page is longer",
    }
    assert texts(spark, cases) == list(cases.values())


def test_repeats_of_a_host_go_and_unique_runs_stay(spark):
    rep = "<div>this exact line of text is on every page of the host</div>"
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    own = [f"<body>{rep}<p>{say(k)}</p><p>all of our pages begin like this {say(k + 50)}</p>{rep}" for k in range(5)]
    own += [own[0], page("<article><p>x</article>")]
    want = [f"{say(k)}\n\n{say(k + 50)}" for k in (*range(5), 0)] + ["x"]
    assert texts(spark, own) == want
    two = own[:2]  # too few pages
    assert texts(spark, two) == ["\n\n".join([rep[5:-6], say(k), "all of our pages begin like this " + say(k + 50), rep[5:-6]]) for k in range(2)]
    # near copies are no boilerplate
    near = [f"<p>one two three four five {k} six seven eight nine ten eleven {k}" for k in range(3)]
    assert texts(spark, near) == [p[3:] for p in near]
    assert texts(spark, ["<p>one two three four five six seven"] * 2) == ["one two three four five six seven"] * 2


@pytest.mark.parametrize("slice_pages", [1, 1000])
def test_extract_equals_brute_force(spark, monkeypatch, slice_pages):
    rng = np.random.default_rng(3)
    pages = [" ".join(str(x) for x in rng.integers(0, 2, rng.integers(1, 40))) + " " + " ".join(f"{i}y{j}" for j in range(int(rng.integers(7, 20)))) for i in range(14)]
    monkeypatch.setattr(html, "SLICE_PAGES", slice_pages)
    monkeypatch.setattr(html, "GROUP_PAGES", slice_pages)
    streams, run = [p.split() for p in pages], html.MIN_RUN
    want = []
    for s in streams:
        covered = [False] * len(s)
        for i in range(len(s) - run + 1):
            if sum(any(s[i : i + run] == t[j : j + run] for j in range(len(t) - run + 1)) for t in streams) >= html.MIN_PAGES:
                covered[i : i + run] = [True] * run
        runs, at = [], 0
        for c, group in groupby(covered):
            n = len(list(group))
            if not c and (n >= run or n == len(s)):
                runs.append(" ".join(s[at : at + n]))
            at += n
        want.append(" ".join(runs) if any(len(r.split()) >= 2 * run for r in runs) else " ".join(s))
    assert texts(spark, [f"<p>{p}" for p in pages]) == want


def test_query_on_odd_rows(spark):
    rows = [(1, "http://a.b/c", page("<article>x</article>")), (1, "http://a.b/c", page("<article>x</article>")), (2, None, None), (None, "//q", "<p>z"), (3, "http://a.b", "<p>" + "long " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as stream", "3 as text")
    want = sorted([(1, "x"), (1, "x"), (2, ""), (None, "z"), (3, ("long " * 50000).strip())], key=str)
    assert sorted([(r.page_id, r.text) for r in html.extract(df).collect()], key=str) == want
    assert html.extract(df.limit(0)).count() == 0


def test_boilerplate_inside_lines_and_paragraphs_left_open():
    cases = {
        '<article><p>Real text <span class="advert">Buy now</span> more.</p></article>': "Real text more.",
        "<article><p>Real <em hidden>secret</em>text</p></article>": "Real text",
        '<article><p>Real text <a class="share" href="x">Share <b>this</b></a></p><p>Next</p></article>': "Real text\n\nNext",
        '<article><p>Hello <span class="ad">x</p><p>Next para</p></article>': "Hello\n\nNext para",
        '<article><p class="ad">promo<div>body text</div></article>': "body text",
        '<article><p class="ad">promo<h2>Heading</h2><p>body<hr>after</article>': "Heading\n\nbody\n\nafter",
        '<article><table><tr><td><p class="ad">promo</td><td>cell</td></tr></table></article>': "cell",
    }
    for page, text in cases.items():
        assert html.parse(page)[0] == text, page


def test_repeats_of_a_host_are_looked_up_in_articles(spark):
    note = "write to us to have this letter each day of the week"
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    box = f'<div class="tnt-7"><p>{note}</p></div>'
    own = [page(f"<article><h1>{say(k + 50)}</h1><p>{say(k)}</p>{box}</article>", foot=note) for k in range(4)]
    assert texts(spark, own) == [f"{say(k + 50)}\n\n{say(k)}" for k in range(4)]
    # the same words in a place of the article's own, in a place that has other text too, or of too few pages stay
    for mark, other in (("<p>", []), ('<p class="a">', [page('<article><p class="a">' + say(9) + "</article>", foot=note)])):
        plain = [page(f"<article>{'<p>' if not other else '<div>'}{say(k)}</{'p' if not other else 'div'}>{mark}{note}</article>", foot=note) for k in range(4)]
        assert texts(spark, plain + other)[:4] == [f"{say(k)}\n\n{note}" for k in range(4)]
    assert texts(spark, own[:2]) == [f"{say(k + 50)}\n\n{say(k)}\n\n{note}" for k in range(2)]
    # titles that a list of all pages tells stay, and so does a page of nothing else
    titles = "".join(f"<li>{say(k + 50)}</li>" for k in range(4))
    listed = [page(f"<article><h1>{say(k + 50)}</h1><p>{say(k)}</p></article><aside>{titles}</aside>") for k in range(4)]
    assert texts(spark, listed) == [f"{say(k + 50)}\n\n{say(k)}" for k in range(4)]
    bare = [page(f"<article><h1>{k}</h1>{box}</article>", foot=note) for k in range(4)]
    assert texts(spark, bare) == [f"{k}\n\n{note}" for k in range(4)]
