"""Lines, alignment and differencing."""

import random
import re
from html import unescape

from studyloom.llm import html_text as H
from studyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def text(html):
    return [t for _, t in H.read(html)]


def test_lines():
    assert text('<body class="no-sidebar"><nav>m</nav><div class="ad">x</div><div class="has-sidebar"><article><header><h1>T</h1></header><p>a<p>b<br>c&nbsp;<i>d</i>e<div class="comments"><p>no</p></div>f</article></div><footer>g</footer>') == ["T", "a", "b c de", "f"]
    assert text('<script>var t="</p><p>x</p>";</script><p title="a>b">y &lt;b&gt; &amp;amp;</p><!-- <p>z</p> --><style>p{}</style>') == ["y <b> &amp;"]
    assert text("<p>one</div><p>two<foot") == ["one", "two"] and text("a < b") == ["a < b"] and text(None) == text("") == text("<p> </p>") == []
    assert text("<form><p>q</p></form><aside>s</aside><table><tr><td>1<td>2</table><ul><li>x<li>y</ul>") == ["1", "2", "x", "y"]
    assert text('<main><p>k</p><div id="cookieBanner">c</div><div role="navigation">n</div></main>') == ["k"]
    assert text("<script>never closed <p>x</p>") == [] and text("<p>" * 3000 + "deep") == ["deep"]
    assert text("<a b='" * 2000) is not None


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = (rng.choices("abcdef", k=rng.randint(0, 14)) for _ in range(2))
        got = [a[i] for i in sorted(H.shared(a, b))]
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(x in rest for x in got)


def test_differencing(spark):
    page = "<body><div>Site name</div><div>{}</div><div>Call us now</div></body>"
    rows = [(i, f"http://h{i % 2}.org/a/{i}", page.format(f"story {i}")) for i in range(40)] + [(100, "http://alone.org/x", page.format("only")), (101, None, None), (102, "%%", ""), (None, "http://h0.org/b", page.format("no id"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as block")
    got = {r.page_id: (r.text, r.n_chars) for r in H.main_text(df).collect()}
    assert all(got[i] == (f"story {i}", len(f"story {i}")) for i in range(40)) and got[None][0] == "no id"
    assert got[100][0] == "Site name\nonly\nCall us now" and got[101] == got[102] == ("", 0)
    assert H.main_text(df.where("false")).collect() == []


def test_copies_are_not_emptied(spark):
    page = "<body><div>Site name</div><div>{}</div><div>Call us now</div></body>"
    rows = [(i, f"http://h.org/a/{i // 4}?s={i}", page.format(f"story {i // 4}")) for i in range(40)] + [(100 + i, f"http://twins.org/x?s={i}", page.format("only")) for i in range(3)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i // 4}" for i in range(40)} | {100 + i: "Site name\nonly\nCall us now" for i in range(3)}


def test_blocks_change_no_text(spark):
    """Each page meets both neighbours wherever blocks are cut, inside runs of copies and hosts as well."""
    rng = random.Random(4)
    rows, story = [], 0
    for i in range(240):
        story += rng.random() < (0.1 if 60 <= i < 140 else 0.7)
        page = f"<div>part {story // 2}</div><div>story {story}</div><div>part {(story + 1) // 2}</div><div>site</div>"
        rows.append((i if i % 9 else i // 2 * 2, f"http://h{i // 100}.org/a/{i // 3}", page))
    rows += [(None, None, f"<p>{i % 2}</p><p>x</p>") for i in range(20)] + rows[:30]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)

    def texts(least):
        return sorted((str(r.page_id), str(r.url), r.text) for r in H.main_text(df, least=least).collect())

    whole = texts(10_000)
    assert len(whole) == len(rows) and not any("site" in t for _, _, t in whole)
    assert texts(3) == texts(20) == whole


def test_copies_keep_their_own_zones(spark):
    rows = [(0, "http://a/1", "<div>top</div><article><p>x</p></article>"), (1, "http://a/1?b", "<article><div>top</div></article><p>x</p>"), (2, "http://a/2", "<div>top</div><p>y</p>")]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "x", 1: "top\nx", 2: "y"}


def test_articles_keep_what_others_repeat(spark):
    html = "<div>top</div><article><p>same</p><p>{}</p></article>"
    df = spark.createDataFrame([(i, f"http://a/{i}", html.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.main_text(df).collect()} == {i: f"same\n{i}" for i in range(6)}


def test_query(spark, duck):
    got = {r.page_id: r.text for r in QUERIES["op5_main_text"](spark, SF).collect()}
    for i, html in duck.execute("select page_id, html from pages").fetchall():
        body = html[html.index("<article>") + 9:]
        body = body[:body.index("</article>")]
        assert got[i] == "\n".join(x for b in re.split(r"</?(?:p|h1)>", body) if (x := " ".join(unescape(re.sub("<[^>]*>", "", b)).split())))
