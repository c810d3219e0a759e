
from pyspark.sql import functions as F

from basketry.llm import html

SCHEMA = "page_id bigint, url string, html string, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "r") for i, (u, h) in enumerate(rows)], SCHEMA)


def texts(spark, rows):
    got = {r.page_id: r for r in html.main_texts(pages(spark, rows)).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    return [got[i].text for i in range(len(rows))]


def test_article_without_what_surrounds_it(spark):
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body class='no-sidebar'>"
        "<header><p>site</p></header><nav><ul><li><a href='/'>home</a></ul></nav><div class=\"cookie-notice\">ok?</div>"
        "<article><h1>Tom &amp; Jerry&#33;</h1><p>one<b>two</b>\n three<br>four<p>five &lt;six&gt; &am"
        "<div class='ad-box'><p>buy</p></div><aside>side</aside><form><p>mail</p></form>"
        "<blockquote>said</blockquote><section id='comments'><p>first!</p></section></article>"
        "<div id='sidebar'>x</div><footer>&copy; y</footer></body></html>"
    )
    assert texts(spark, [("http://a.org/1", page)]) == ["Tom & Jerry! onetwo three four five <six> &am said"]


def test_host_without_article_element(spark):
    rows = []
    for i in range(6):
        body = "".join(f"<p>Page {i} tells story {i}-{k} in many words of its own.</p>" for k in range(i + 1))
        rows.append(
            (
                f"https://b.org/{i}",
                "<html><body><div class=top><p>Welcome to b, the best site there is for all of us</p></div>"
                f"<div class=text><h2>Head {i}</h2>{body}</div>"
                "<div class=bottom><p><a href=/1>more one</a> <a href=/2>more two</a></p></div></body></html>",
            )
        )
    for i, text in enumerate(texts(spark, rows)):
        stories = " ".join(f"Page {i} tells story {i}-{k} in many words of its own." for k in range(i + 1))
        assert text == f"Head {i} {stories}"


def test_nulls_broken_pages_repeats_and_empty_table(spark):
    page = "<article><p>text</p></article>"
    rows = [(None, None), ("", ""), ("no url", page), ("http://c/", page), ("http://c/", page), ("http://c/", "<"),
            ("http://c/", "<p class='x>never closed"), ("http://d/", "plain words & <"), ("http://c/", "<!-- open"),
            ("http://e/", "<article><p>" + "long " * 50_000)]
    got = texts(spark, rows)
    assert got[:6] == ["", "", "text", "text", "text", "<"] and got[7] == "plain words & <" and got[8] == ""
    assert len(got[9]) == 249_999
    assert html.main_texts(pages(spark, []).limit(0)).count() == 0


def test_wrapper_is_a_union_free_expression(spark):
    def wrapper(page):
        return html.wrapper_of(html.blocks(page)[1])

    one = wrapper("<body><h1>a</h1><p>b</p><p>c</p></body>")
    two = wrapper("<body><h1>a</h1><div>x</div><p>b</p></body>")
    assert html.as_expression(one) == "<body>(<h1>(#) <p>(#)+)"
    assert html.as_expression(html.aligned(one, two)) == "<body>(<h1>(#) <div>(#)? <p>(#)+)"
    turns = wrapper("<body><h2>a</h2><p>b</p><h2>c</h2><h2>d</h2><p>e</p><p>f</p></body>")
    assert html.as_expression(turns) == "<body>(<h2>(#)+ <p>(#)*)"
    rows = [(f"http://f.org/{i}", f"<body><h1>{i}</h1>{'<p>x</p>' * (i % 4)}</body>") for i in range(40)]
    frame = pages(spark, rows).select(html.host_of(F.col("url")).alias("host"), "html")
    found = html.host_wrappers(html._observed(frame)).collect()
    assert [(r.host, r.pages) for r in found] == [("f.org", 40)]
    assert html.as_expression(html.read_wrapper(found[0].wrapper)) == "<body>(<h1>(#) <p>(#)*)"


def test_article_with_slugs_head_and_form_around_it(spark):
    words = "Many words of the one story that this page tells. " * 6
    rows = [
        ("http://g.org/1", "<article><h2 id='related-work'>Related work</h2><p>a</p><section id='discussion'><p>b</p></section>"
         "<div class='comment-list'><p>c</p></div><div class='tag-search'><p>d</p></div></article>"),
        ("http://g.org/2", "<article class='post tag-search category-promotion'><p>text</p></article>"),
        ("http://g.org/3", "<html><head><title>t</title><meta charset=x><body><p>text</p></body></html>"),
        ("http://i.org/4", f"<body><form action=x><input type=hidden name=v><div><p>{words}</p></div><input name=q></form></body>"),
        ("http://j.org/5", "<body><form action=x><main><p>short</p></main><input name=q></form></body>"),
        ("http://k.org/6", "<body><p>text of a page</p><form><p>your mail</p><input name=q></form></body>"),
    ]
    assert texts(spark, rows) == ["Related work a b d", "text", "text", words.strip(), "short", "text of a page"]


def test_copies_second_boxes_and_lists(spark):
    def page(i, lead=""):
        return (
            f"<body><div class=top><p>Welcome to the site</p></div><div class=lead><h1>Title {i}</h1>{lead}</div>"
            f"<div class=text><p>{f'Long story {i}. ' * 30}</p></div></body>"
        )

    story = lambda i: f"Title {i} " + (f"Long story {i}. " * 30).strip()
    copies = texts(spark, [("http://l.org/1", page(1))] * 5)
    assert copies == ["Welcome to the site " + story(1)] * 5  # one page does not tell what is constant
    assert texts(spark, [(f"http://m.org/{i}", page(i)) for i in range(8)]) == [story(i) for i in range(8)]
    lists = ["<article><p>a</p><ul>" + "<li><a href=x>some link</a></li>" * 40 + "</ul></article>"] * 3
    lists.append("<article><p>a</p><ul><li>plain</li></ul></article>")
    assert texts(spark, [("http://n.org/", x) for x in lists])[3] == "a plain"


def test_deep_and_wide_pages(spark):
    words = "Some words that this page alone has. "
    doubled = "".join(f"<div class='zz{i}q'><p>{words}{i}</p></div>" * 2 for i in range(2500))
    scattered = "".join(f"<div class='yy{i}q'>a</div><hr><div class='yy{i}q'>b</div>" for i in range(300))
    rows = [
        ("http://deep.org/1", "<div>" * 20000 + words),
        ("http://deep.org/2", "<div class='a'>" * 3000 + "<p>x</p></div>" * 3000 + words),
        ("http://wide.org/1", doubled),
        ("http://wide.org/2", scattered),
        ("http://wide.org/3", "<p>one</p>" * 5000),
    ]
    found = {r.url: r.text for r in html.main_texts(pages(spark, rows)).collect()}
    assert set(found) == {r[0] for r in rows}
    assert found["http://deep.org/1"] == words.strip()


def test_written_wrappers_read_back():
    for page in ("", "<p>a</p>", "<body><h2>a</h2><p>b</p><h2>c</h2><h2>d</h2><p>e</p><p>f</p></body>", "<div>" * 5000 + "x"):
        wrapper = html.wrapper_of(html.blocks(page)[1])
        assert html.written(html.read_wrapper(html.written(wrapper))) == html.written(wrapper)


TEMPLATE = "<body><div><p>{top}</p></div><div><h2>Head {i}</h2><p>{one}</p></div><div><p>{bottom}</p><hr></div></body>"


def plain_template(n):
    """Pages without a class word or an article element: only the place of a div tells what it is."""
    pages, stories = [], []
    for i in range(n):
        story = f"Story {i} goes on for many words that no other page has."
        pages.append(TEMPLATE.format(top="Welcome to the site", i=i, one=story, bottom="All rights are reserved"))
        stories.append(f"Head {i} {story}")
    return pages, stories


def test_the_alignment_decides(spark, monkeypatch):
    """Elements of one path are told apart by their place; without the alignment the texts are others."""
    shown, stories = plain_template(6)
    assert texts(spark, [(f"http://o.org/{i}", x) for i, x in enumerate(shown)]) == stories

    rows = []
    wrappers = [html.wrapper_of(html.blocks(x)[1]) for x in shown]
    # every label of a level gathered into one item, as if the place did not count
    def paths_only(items):
        return html._gathered([[x, f, paths_only(c)] for x, f, c in items], {x[0] for x in items})

    for wrapper in (wrappers[0], paths_only(wrappers[0])):
        for other in shown[1:]:
            wrapper = html.aligned(wrapper, html.wrapper_of(html.blocks(other)[1]))
        rows.append(extracted(shown, html.written(wrapper)))
    assert rows[0] == stories
    assert rows[1] != stories and all("Welcome" in t for t in rows[1])


def extracted(shown, wrapper):
    """The rule and its texts in plain Python, sums over all pages by hand."""
    m, sums = html.Matcher(html.read_wrapper(wrapper)), {}
    for page in shown:
        found, stream = html.blocks(page)
        named = any(b.main and not b.outside for b in found)
        own = [(s, b) for s, b in zip(m.slots(stream), found) if not b.outside and (b.main or not named)]
        whole = tuple(b.text() for _, b in own)
        for slot, b in own:
            chars, links, seen, pages = sums.setdefault((named, slot), [0, 0, set(), set()])
            is_link = b.links > len(b.text()) / 2
            sums[named, slot] = [chars + len(b.text()), links + len(b.text()) * is_link, seen | {b.text()}, pages | {whole}]
    rows = [
        {"named": k[0], "slot": k[1], "chars": c, "links": n, "low": 0, "high": len(t) - 1, "pages": 2 ** len(p) - 1}
        for k, (c, n, t, p) in sums.items()
    ]
    rule = html.decided(wrapper, rows)
    return [html.article_text(page, rule) for page in shown]


def test_optional_and_repeated_parts_between_pages(spark):
    """A lead that some pages have and paragraphs in any number; the notice below them is the same everywhere."""
    rows, wanted = [], []
    for i in range(9):
        lead = f"<h3>Lead {i} of its own words</h3>" if i % 3 else ""
        paragraphs = [f"Paragraph {k} of page {i} has words of its own." for k in range(1 + i % 4)]
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        rows.append((f"http://p.org/{i}", f"<body><div><p>Top of all</p></div><div>{lead}{body}</div><div><p>Terms of use</p></div></body>"))
        wanted.append(" ".join(([f"Lead {i} of its own words"] if lead else []) + paragraphs))
    assert texts(spark, rows) == wanted
    wrapper = html.read_wrapper(html.host_wrappers(html._observed(pages(spark, rows).select(html.host_of(F.col("url")).alias("host"), "html"))).first().wrapper)
    assert html._counted(wrapper[0][2]) == {"div": 3}
    assert {x: f for x, f, _ in wrapper[0][2][1][2]} == {"h3": html.OPTIONAL, "p": html.REPEATED}


def test_template_text_inside_articles(spark):
    """A note that every article carries goes, a heading stays; versions of one article stay whole."""
    story = lambda i: f"Story {i} goes on for many words that no other page has. " * 3
    noted = [(f"http://q.org/{i}", f"<article><h1>Title {i}</h1><h2>Summary</h2><p>{story(i)}</p><div><p>Ask us anything.</p></div></article>") for i in range(5)]
    assert texts(spark, noted) == [f"Title {i} Summary {story(i).strip()}" for i in range(5)]
    versions = [(f"http://r.org/{i}", f"<article><h1>Title</h1><p>{story(0)}</p><p>{story(1)}</p><p>Version {i}</p></article>") for i in range(5)]
    assert texts(spark, versions) == [f"Title {story(0).strip()} {story(1).strip()} Version {i}" for i in range(5)]


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "ul", "section", "h2"])
        if depth < 3 and tag != "h2" and rng.random() < 0.6:
            parts.append(f"<{tag}>{random_page(rng, depth + 1)}</{tag}>")
        else:
            parts.append(f"<{tag}>t{rng.randrange(99)}</{tag}>" if rng.random() < 0.8 else "words")
    return "".join(parts)


def test_pages_match_their_wrapper_in_any_order():
    """No block is without a slot, and two blocks share one in every order of alignment or in none."""
    import random

    rng = random.Random(8)
    for _ in range(60):
        streams = [html.blocks(random_page(rng))[1] for _ in range(rng.randrange(1, 7))]
        groupings = set()
        for _ in range(4):
            order = rng.sample(range(len(streams)), len(streams))
            parts = [html.wrapper_of(streams[i]) for i in order]
            while len(parts) > 1:  # in any grouping as well
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [html.aligned(parts[i], html.read_wrapper(html.written(parts[i + 1])))]
            m = html.Matcher(parts[0])
            slots = [m.slots(s) for s in streams]
            assert all(x > 0 and m.labels[x] == "#" for s in slots for x in s)
            names = {}
            groupings.add(tuple(names.setdefault(x, len(names)) for s in slots for x in s))
            flags = [f & html.OPTIONAL for f in m.flags]
            assert len(flags) == len(m.inside)
        assert len(groupings) == 1


def test_common_labels_are_a_longest_common_sequence():
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([[x, 0, []] for x in rng.sample("abcdefgh", rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
        chain = html._common(a, b)
        assert len(chain) == best[0][0]
        assert all(a[i][0] == b[j][0] for i, j in chain)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:]))
