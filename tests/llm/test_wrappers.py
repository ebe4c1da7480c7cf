"""HTML extraction on hosts of different templates, against what their articles were made of."""

import random

import pytest

from clusterlake.llm import wrappers

HOSTS = 5
R = random.Random(7)
WORDS = ["".join(R.choice("abcdefghijklmnoprstuvw") for _ in range(R.randint(2, 9))) for _ in range(400)]


def say(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def marked_up(r, text):
    """The same text with inline elements, references and white space in it."""
    words = [f"<b>{w}</b>" if r.random() < 0.1 else f'<a href="/x?a=1&amp;b={w}">{w}</a>' if r.random() < 0.1 else w for w in text.split(" ")]
    return ("\n  " if r.random() < 0.2 else " ").join(words)


def page(r, host, k):
    """(html, text) of a page; hosts differ in what they put around an article and in whether they name it."""
    title, body = say(r, 6), [say(r, r.randint(8, 60)) for _ in range(r.randint(1, 6))]
    paragraphs = "".join(f"<p>{marked_up(r, b)}</p>" for b in body)
    text = " ".join([title, *body])
    ps = f"<h1>{title}</h1>{paragraphs}"
    head = f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p><p>no";</script></head>'
    if host == 0:  # elements say what they are
        return f"{head}<body><header><p>The Daily Host</p></header><nav><ul><li><a href=/>Home</a></li><li>News</li></ul></nav><main>{ps}</main><aside>{say(r, 5)}</aside><form>Mail <input name=a><button>Go</button></form><footer>&copy; host {say(r, 3)}</footer></body></html>", text
    if host == 1:  # names of classes do
        return f'{head}<body><div id="cookie-notice">We use cookies {k}</div><div class="content">{ps}</div><div class="sidebar">{say(r, 9)}</div><section class="comments"><p>{say(r, 30)}</p><p>{say(r, 9)}</p></section>', text
    if host == 2:  # nothing does: what surrounds it is the same on all pages
        return f'{head}<body><div class="x1"><p>Welcome to the host of hosts</p></div><div class="x2">{ps}</div><div class="x3"><p>Call us any day</p><p>Imprint</p></div></body></html>', text
    if host == 3:  # nor that, and the markup is broken; a banner comes and goes
        banner = '<div class="z1">Buy one, get one</div>' if k % 3 else ""
        return f"{head}<body>{banner}<div class='y1'>All the best</div><div class='y2'><h1>{title}</h1>" + "".join(f"<p>{b}<br>" for b in body) + "</div><div class=y3>So long</div>", text
    return f"{head}<body><article><header><h1>{title}</h1></header>{paragraphs}<div class=share>Tell your friends</div><!-- <p>not this</p> --><ul><li>{title}</ul></article><footer>{say(r, 4)}</footer>", text + " " + title


@pytest.fixture(scope="module")
def pages():
    r = random.Random(11)
    rows, want = [], {}
    for i in range(200):
        host = r.randrange(HOSTS)
        html, text = page(r, host, i)
        rows.append((i, f"https://h{host}.example.org/{i}", html))
        want[i] = text
    return rows, want


@pytest.mark.parametrize("few", [5000, 0])
def test_pages_of_five_templates(spark, pages, few, monkeypatch):
    rows, want = pages
    if not few:  # as with too many hosts to send them all
        monkeypatch.setattr(wrappers, "small", lambda df, rows: df.select("*"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r for r in wrappers.extract(df).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["text"], r["n_chars"]) == (want[i], len(want[i])), rows[i]


def test_copies_of_a_page_are_no_template(spark):
    text = say(random.Random(1), 40)
    html = f"<body><div class=a>Welcome</div><div class=b><p>{text}</p></div></body>"
    near = [html.replace(text, text + " " + say(random.Random(k), 5)) for k in range(6)]
    rows = [(i, "http://copies.example.org/", h) for i, h in enumerate([html] * 50 + near)] + [(100 + i, "http://one.example.org/", f"<article><p>{text}</p></article><nav>x</nav><p class=footer>{i}</p>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text for i in (*range(50), *range(100, 140)))
    assert all(got[50 + i].startswith(text + " ") for i in range(6))


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    wide = "".join(f"<div class='{'xy'[i % 2]}{'cdefg'[i % 5]}'>{i}</div>" for i in range(3000))
    long = "<article>" + "<p>word &lt;b&gt; &eacute;&#233;&amp;amp; &am &amp x" * 100_000 + "</article>"
    broken = ["<", "<a", "<p title='x", "</", "<!-- x", "<script>alert(1)", "<p>a</div></span>b", "a < b && c > d", "<b>a<i>b</b>c</i>", "<table><tr><td>a<td>b<tr><td>c</table>", "<p>a<p>b<div>c</div>d", "<DIV CLASS=Ad>x</DIV>Y&nbsp; z", "<span class=ad>x</span>y"]
    want = ["<", "", "", "</", "", "", "ab", "a < b && c > d", "abc", "a b c", "a b c d", "Y z", "y"]
    rows = [(1, None, None), (1, None, None), (None, "http://[bad", ""), (2, "x", deep), (3, "x", wide), (4, "http://long/", long), *((10 + i, "http://broken/", b) for i, b in enumerate(broken))]
    df = spark.createDataFrame([(*r, 7, "n") for r in rows], "page_id long, url string, html string, host int, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in wrappers.extract(df).collect()]
    by = dict((i, t) for i, t, _ in got)
    assert len(got) == len(rows) and got.count((1, "", 0)) == 2 and by[None] == "" and by[2] == "deep"
    assert by[3] == " ".join(map(str, range(3000)))
    assert by[4] == " ".join(["word <b> éé&amp; &am & x"] * 100_000)
    assert [by[10 + i] for i in range(len(broken))] == want
    assert wrappers.extract(df.limit(0)).count() == 0


def test_matching_is_the_greatest():
    """Against all ways to match small trees."""
    r = random.Random(2)

    def grow(depth):
        return (r.choice("ab"), [grow(depth - 1) for _ in range(r.randint(0, 3))] if depth else [])

    def best(x, y):
        if x[0] != y[0]:
            return 0

        def rows(a, b):
            return max(rows(a[1:], b), rows(a, b[1:]), best(a[0], b[0]) and best(a[0], b[0]) + rows(a[1:], b[1:])) if a and b else 0

        return 1 + rows(x[1], y[1])

    def built(x, parent=None):
        n = wrappers.Node(x[0], parent, False, False)
        n.kids = [built(k, n) for k in x[1]]
        return n

    for _ in range(300):
        x, y = grow(3), grow(3)
        a, b = wrappers.numbered(built(x)), wrappers.numbered(built(y))
        found = wrappers.matched(a[0], b[0])
        assert len(found) == best(x, y)
        for j, i in found.items():
            assert a[i].label == b[j].label and (b[j].parent is None or found[b[j].parent.at] == a[i].parent.at)
        assert len(set(found.values())) == len(found)


def test_given_pages(spark, sf):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS FROM '{sf}/pages.parquet'")
    got = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in wrappers.op13_html(spark, sf).collect())
    assert got == sorted(duckdb.sql(wrappers.SQL).fetchall()) and got


def test_template_of_layouts_beyond_the_wrapper(spark):
    """A line that only rare layouts of a host have, so that its wrapper lacks it, is template all the same."""
    r = random.Random(5)
    rows, want = [], {}
    for kind in range(14):
        for _ in range(6 if kind < 8 else 2):
            title, body = say(r, 6), say(r, 40)
            ring = '<section class="zz"><div>Ring our bell at noon</div></section>' if kind >= 8 else ""
            more = say(r, 4)
            html = f'<html><body><div class="x2"><h1>{title}</h1><p>{body}</p>{ring}<div class="w{kind}q"><section><{["b", "div"][kind % 2]}>{more}</{["b", "div"][kind % 2]}></section>{"<table><tr><td>" + more + "</table>" if kind % 3 else ""}</div></div></body></html>'
            html = html.replace(f'class="w{kind}q"', f'class="{chr(97 + kind) * 3}"')
            want[len(rows)] = f"{title} {body}"
            rows.append((len(rows), f"https://many.example.org/{len(rows)}", html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrappers.observed(df.selectExpr("page_id", "url", "html", "'h' AS host"))
    assert wrappers.layouts(found).count() > wrappers.LAYOUTS
    for x in wrappers.extract(df).collect():
        assert "Ring our bell" not in x.text and x.text.startswith(want[x.page_id])
