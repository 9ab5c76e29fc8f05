import random

import pytest

from rainframe.llm import pagediff
from rainframe.llm.pagediff import common, lines_of

SCHEMA = "page_id long, url string, html string, row int, own string, host string, path string, lines int, text string"


def lengths(a, b):
    """Length of a longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        n, letters = rng.randint(0, 30), rng.randint(1, 8)
        a, b = ([rng.randint(0, letters) for _ in range(rng.randint(0, n))] for _ in range(2))
        pairs = common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == lengths(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert common(list(range(5000)), list(range(2500, 7500))) == [(2500 + i, i) for i in range(2500)]


MARKED = """<!doctype html><html><head><title>Page title</title><style>p{}</style><meta charset=utf-8><script>if (a<b) x="<p>no</p>";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<form id=aspnet><div id="leftSidebar">links<p>side</div><article class="post"><header><h1>Head &amp; line</h1></header><p>One&nbsp;two
 three<br>four <b>five</b><p>Six <span class="ad"><span>Buy</span> now</span>seven</p><!-- <p>hidden</p> --><div hidden>secret</div>
<ul><li>first<li>second <i>item</i></ul><div class="adBox advert">Advert</div><p style="display: none">gone</p><blockquote>quoted &#233; &copy</blockquote><table><tr><td>a<td>b</table>
<figure><img src=x alt=y><figcaption>Caption</figcaption></figure><section class="comments"><article class="comment"><p>Nice!</article></section></article></form>
<aside><p>aside</p></aside><div role="complementary">more</div><footer>&copy; site</footer></body></html>"""


def test_marked_elements_are_left_out():
    want = ["Head & line", "One two three four five", "Six seven", "first", "second item", "quoted é ©", "a", "b", "Caption"]
    assert [x for x, _ in lines_of(MARKED)] == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("plain < text & more", ["plain < text & more"]), ("<p>cut off here &am", ["cut off here &am"]), ("<p>text</p><div cla", ["text"]), ("<p>a<!-- never closed <p>b", ["a"]),
        ("<main><p>a</p></main><p>b", ["a"]), ("<article></article><p>only this", ["only this"]), ("<nav><a>menu</a><article><p>in an open nav</p></article>", ["in an open nav"]),
        ("<article><p>a</div></div><p>b</article>", ["a", "b"]), ("<p class=notice>n<p>kept", ["kept"]), ("<head><title>t</title><p>no body tag", ["no body tag"]), ("<script>never closed", []),
        ("<p title=\"a > b\">quoted attribute</p>", ["quoted attribute"]), ("<h1>A</h1>\t\n<h2> B  c </h2>", ["A", "B c"]), ("<P>upper<BR>case</P>", ["upper case"]),
    ],
)
def test_odd_markup(page, want):
    assert [x for x, _ in lines_of(page)] == want


def site(n, host="h.example", path="/news/{}", start=0):
    rng = random.Random(n + start)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for i in range(n):
        own = [" ".join(word() for _ in range(25)) for _ in range(4)]
        out.append((f"https://{host}{path.format(i)}", ["The Daily Line", "News and more", *own, "Call us today", f"Page of {word()}"], own))
    return out


def extracted(spark, rows):
    df = spark.createDataFrame([(i, u, h, 1, "clash", "clash", "clash", 2, "old") for i, (u, h) in enumerate(rows)], SCHEMA).repartition(3)
    out = pagediff.main_text(df)
    assert out.columns == [c for c in df.columns if c not in ("html", "text")] + ["text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(rows)
    return [got[i].text.split("\n") if got[i].text else [] for i in range(len(rows))]


def page(lines):
    return "".join(f"<div>{x}</div>" for x in lines)


def test_shared_lines_go(spark):
    pages = site(40) + site(2, "two.example", start=9) + site(1, "one.example", start=7)
    got = extracted(spark, [(u, page(lines)) for u, lines, _ in pages])
    for (u, lines, own), have in zip(pages, got):
        template = ["The Daily Line", "News and more", "Call us today"]
        assert have == ([x for x in lines if x not in template] if "one." not in u else lines)


def test_copies_and_declared_prose_stay_links_go(spark):
    pages = site(6)
    shared = "A passage of many words that stands in every article of this site and is text."
    rows = [(u, f"<article>{page([*own, shared])}<div><a href=/>Read more news</a></div></article>") for u, _, own in pages]
    copies = [(f"https://c.example/{i}", page(pages[0][2])) for i in range(5)]
    near = [(f"https://n.example/{i}", page([*pages[0][2], f"own line {i}"])) for i in range(5)]
    odd = [(None, page(["x"])), ("no host", page(["x"])), ("https://null.example/", None), ("https://null.example/a", ""), ("https://null.example/a", "")]
    got = extracted(spark, rows + copies + near + odd)
    assert got[:6] == [[*own, shared] for _, _, own in pages]
    assert got[6:11] == [pages[0][2]] * 5 and got[11:16] == [[*pages[0][2], f"own line {i}"] for i in range(5)]
    assert got[16:] == [["x"], ["x"], [], [], []]


def test_blocks_meet_at_their_borders(spark, monkeypatch):
    monkeypatch.setattr(pagediff, "BLOCK", 3)
    pages = site(20)
    got = extracted(spark, [(u, page(lines)) for u, lines, _ in pages])
    assert all("News and more" not in x and len(x) == 5 for x in got)


def test_empty_table(spark):
    assert pagediff.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
