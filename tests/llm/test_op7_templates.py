import html
import re

from pyspark.sql import functions as F

from weftline.llm.templates import deduced, element_token, extracted, host_of, main_texts

SCHEMA = "page_id long, url string, html string"


def test_pages_of_the_tables(spark):
    for r in main_texts(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), ["page_id", "url", "html"]).collect():
        body = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", body))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_slots_without_article_elements(spark):
    """Plain div pages: what varies and holds the text is the slot; menus and boxes around it are the template's."""
    page = lambda i: f'<html><body><div id="top"><a href="/">Home</a></div><div class="c{i % 1}"><h2>Title {i}</h2><p>{" ".join(f"word{i}{k}" for k in range(40))}<p>more &eacute; {i}</div><div id="rail">Weather today</div></body></html>'
    rows = [(i, f"http://site.example/{i}", page(i)) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = deduced(df.select(host_of(F.col("url")).alias("host"), "html")).collect()
    assert [(r.host, r.region) for r in found] == [("site.example", [element_token("/html/body/div.c0")])]
    for r in main_texts(df, ["page_id"]).collect():
        assert r.text == f"Title {r.page_id} " + " ".join(f"word{r.page_id}{k}" for k in range(40)) + f" more é {r.page_id}"


def test_boilerplate_in_and_around_an_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies</div><aside>Side</aside><main><article class=post><h1>Head &amp; line</h1><script>var a="</p><p>no";</script>
    <p>One<b>two</b> three<br>four &#x41;&nbsp;B<p>Five <!-- no --> six<div class="ad-slot">Buy</div><form><input value="x">Send</form>
    <table><tr><td>a<td>b</table><pre>x
      y</pre><section id="comments"><p>Nice post!</section></article></main><footer>Foot</footer></body></html>"""
    assert extracted(page) == "Head & line Onetwo three four A B Five six a b x y"


def test_broken_markup():
    assert extracted("<article><p>a<p class='x>y' z>b</q></article></div>c") == "a b"
    assert extracted("plain <unclosed text") == "plain"
    assert extracted("a<!-- open") == "a"
    assert extracted("<p>x<script>never ended") == "x"
    assert extracted("<article><p>1 < 2 & 3</article>") == "1 < 2 & 3"
    assert extracted("<article>" + "<b><p>w " * 3000 + "</article>").count("w") == 3000


def test_odd_and_empty_tables(spark):
    rows = [(None, None, None), (1, None, "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://h/", ""), (3, "not a url", "<article>y</article>"), (4, "http://h/", "<article>" + "long word " * 50_000 + "</article>")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA + ", text string, host string, n_chars string")
    got = main_texts(df, ["page_id", "url", "text"]).collect()
    assert sorted(((r.page_id or 0), r.text[:10], r.n_chars) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0), (3, "y", 1), (4, "long word ", 499_999)]
    assert main_texts(df.limit(0), ["page_id"]).count() == 0


def test_without_broadcast(spark, monkeypatch):
    from weftline.llm import templates

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted(main_texts(df, ["page_id"]).collect())
    monkeypatch.setattr(templates, "BROADCAST_TOKENS", 0)
    assert sorted(main_texts(df, ["page_id"]).collect()) == want


def article_of(page):
    body = re.search(r"(?s)<article>(.*)</article>", page)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", body))).split())


def test_the_template_finds_the_text_without_any_names(spark):
    """Pages whose elements are all plain div elements with names that say nothing: slots alone decide, on every host with a template."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    bare = [("article", "q"), ("nav", "m"), ("footer", "f")]

    def plain(page):
        for name, k in bare:
            page = page.replace(f"<{name}>", f'<div class="{k}">').replace(f"</{name}>", "</div>")
        return page.replace('class="ad"', 'class="k"').replace("<h1>", '<div class="z">').replace("</h1>", "</div>")

    df = spark.createDataFrame([(r.page_id, r.url, plain(r.html)) for r in rows], SCHEMA)
    hosts = {r.page_id: r.host for r in df.select("page_id", host_of(F.col("url")).alias("host")).collect()}
    many = {r.host for r in deduced(df.select(host_of(F.col("url")).alias("host"), "html")).collect()}
    got = {r.page_id: r.text for r in main_texts(df, ["page_id"]).collect()}
    want = {r.page_id: article_of(r.html) for r in rows}
    assert len(many) > 10 and sum(hosts[i] in many for i in want) > 150
    for i, text in want.items():
        if hosts[i] in many:
            assert got[i] == text
    alone = main_texts(df.limit(1), ["page_id", "url"]).collect()[0]  # no template: menus stay in
    assert alone.text != want[alone.page_id]


def test_classes_are_those_of_plain_counts(spark):
    """Tokens, vectors and classes by loops over small hosts."""
    import random
    from collections import Counter, defaultdict

    from weftline.llm.templates import classes, page_tokens

    rnd = random.Random(2)
    words = ["one", "two", "three", "four"]
    rows = [(f"h{rnd.randrange(3)}", f"<body><div>fixed text here {rnd.choice(words)}</div>" + "<p>" * rnd.randrange(3) + " ".join(rnd.choices(words, k=5)) + rnd.choice(["", "<ul><li>x</ul>"])) for _ in range(40)]
    rows += rows[:6]
    pages, seen = Counter(h for h, _ in rows), defaultdict(dict)
    for i, (h, t) in enumerate(rows):
        for token, n in page_tokens(t).items():
            seen[h, token][i] = n
    want = {(h, t): frozenset(v.items()) for (h, t), v in seen.items() if len(v) >= 3 and 2 * len(v) >= pages[h]}
    got = {(r.host, r.token): r for r in classes(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert set(got) == set(want)
    groups = defaultdict(set)
    for k, r in got.items():
        groups[k[0], r["class"]].add(want[k])
        assert r.pages == len(want[k]) and r.all_pages == pages[k[0]] and r.once == all(n == 1 for _, n in want[k])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len({(k[0], v) for k, v in want.items()})


def test_nested_containers_keep_heading_and_lead(spark):
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    page = lambda i: f"<body><div>Menu Start End</div><article><h1>Title {i}</h1><p>Lead {i}</p><div class=body>{text(i, 90)}</div><p>Share this with all of your friends</p><section>{text(i + 100, 30)}</section></article><div>foot {i}</div>"
    df = spark.createDataFrame([(i, f"http://a/{i}", page(i)) for i in range(6)], SCHEMA)
    for r in main_texts(df, ["page_id"]).collect():
        assert r.text == f"Title {r.page_id} Lead {r.page_id} {text(r.page_id, 90)} {text(r.page_id + 100, 30)}"  # the line that is the template's goes
    two = lambda i: f"<body><div class=a>Menu {i}</div><div class=w><h2>Head {i}</h2><div class=b>{text(i, 60)}</div><div class=c>{text(i + 50, 40)}</div></div><div class=d>buy {i} now</div>"
    df = spark.createDataFrame([(i, f"http://a/{i}", two(i)) for i in range(6)], SCHEMA)
    for r in main_texts(df, ["page_id"]).collect():
        assert r.text == f"Head {r.page_id} {text(r.page_id, 60)} {text(r.page_id + 50, 40)}"


def test_class_names_of_a_state_or_of_most_text_are_no_boilerplate():
    assert extracted('<body><div class="layout has-sidebar"><p>Main text of it</div>') == "Main text of it"
    assert extracted('<body><div class="widget-area-off share-buttons-on"><p>Main text of it</div>') == "Main text of it"
    assert extracted('<body><div class="sidebar-layout"><p>Main text of it</p><div class="sidebar">Links</div></div>') == "Main text of it"
    assert extracted('<article><p>Text</p><div class="comments"><p>A comment that is far longer than the text</p></div></article>') == "Text"


def test_copies_of_one_page_are_no_template(spark):
    page = "<body><div>Menu Start End</div><article><h1>One title</h1><p>the very same text on each page of it</article>"
    got = main_texts(spark.createDataFrame([(i, f"http://a/{i}", page) for i in range(5)], SCHEMA), ["page_id"]).collect()
    assert [r.text for r in got] == ["One title the very same text on each page of it"] * 5


def test_words_have_one_number_in_all_passes():
    from weftline.llm.templates import page_tokens, parsed, word_token

    page = "<div class=a>one &eacute;t&eacute; one<p>one</div>"
    held = {e.path: e for _, e, _ in parsed(page) if e.path}
    div, p = held["/div.a"], held["/div.a/p"]
    assert page_tokens(page) == {div.token: 1, p.token: 1, word_token(div.seed, "one"): 2, word_token(div.seed, "été"): 1, word_token(p.seed, "one"): 1}


def layout_rows():
    """Twenty pages of one host in three layouts (40, 40 and 20 percent) without an article element, and their texts."""
    import random

    rnd = random.Random(1)
    text = lambda n: " ".join(f"word{rnd.randrange(3000)}" for _ in range(n))
    rows, want = [], {}
    for i in range(20):
        title, body = text(5), [text(rnd.randrange(20, 60)) for _ in range(rnd.randrange(2, 5))]
        top, end = '<div class="hd"><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact us</a></div>', '<div class="lg">All rights reserved by the owner of this site</div>'
        mid = [
            f'<div class="q"><h1>{title}</h1><p>' + "<p>".join(body) + "</div>",
            f'<div class="z"><div class="y"><h2>{title}</h2><div class=k>' + "</div><div class=k>".join(body) + "</div></div></div>",
            f"<section><h1>{title}</h1><table class=v><tr><td>" + "<td>".join(body) + "</table></section>",
        ][(i >= 8) + (i >= 16)]
        rows.append((i, f"http://three.example/{i}", f"<html><body>{top}{mid}{end}</body></html>"))
        want[i] = " ".join([title, *body])
    return rows, want


def test_a_host_of_three_layouts(spark, monkeypatch):
    from weftline.llm import templates

    rows, want = layout_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = templates.page_layouts(df.select(host_of(F.col("url")).alias("host"), "html")).collect()
    assert sorted(r.all_pages for r in found) == [4, 8, 8] and sorted(r.layout for r in found) == [0, 1, 2]
    assert {r.page_id: r.text for r in main_texts(df, ["page_id"]).collect()} == want
    monkeypatch.setattr(templates, "BROADCAST_TOKENS", 0)
    assert {r.page_id: r.text for r in main_texts(df, ["page_id"]).collect()} == want


def test_boxes_without_a_name_are_told_apart_by_place(spark):
    """Landmarks as plain div elements, some pages with one more before the text."""
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    page = lambda i: f"<body><div><a href=/>Start</a> <a href=/b>Blog</a> <a href=/c>Shop</a></div>{'<div>Buy it now</div>' * (i % 2)}<div><h1>Title {i}</h1><p>{text(i, 40)}<p>{text(i, 9)}</div><div>All rights reserved here</div>"
    df = spark.createDataFrame([(i, f"http://a/{i}", page(i)) for i in range(12)], SCHEMA)
    for r in main_texts(df, ["page_id"]).collect():
        assert r.text == f"Title {r.page_id} {text(r.page_id, 40)} {text(r.page_id, 9)}"


def test_text_vectors_and_layouts_are_those_of_plain_counts(spark):
    """Vectors by hand; layouts, their pages included, by a loop over all pages of hosts with rare and odd ones."""
    import random
    from collections import Counter, defaultdict

    from weftline.llm import templates

    page = "<body><nav>not counted</nav><div class=a><p>12345</p><p>678</p></div><div class=b>1234</div><div class=c>1</div>"
    want = {"/body/div.a": 2, "/body/div.a/p": 2, "/body/div.b": 1}  # eight, eight and four of 13 characters; one of 13 is none
    assert templates.text_vector(templates.parsed(page)) == sorted(element_token(k) << 3 | n for k, n in want.items())
    assert templates.text_vector([]) == [] and templates.likeness([], []) == 1.0
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        k = rnd.choice("aaaaabbbbcccd")
        rows.append((rnd.choice(["x", "y"]), f"<body><div class={k}>{'m' * rnd.randrange(20, 40)}<p>{'t' * rnd.randrange(30)}</p></div><div class=e>{'n' * rnd.randrange(25)}</div>"))
    rows += [("x", None), ("x", ""), ("few", "<p>a"), ("few", "<p>b")]
    counts = defaultdict(Counter)
    for host, html_ in rows:
        if html_:
            counts[host][tuple(templates.text_vector(templates.parsed(html_)))] += 1
    expected = set()
    for host, vectors in counts.items():
        total = sum(vectors.values())
        if total < templates.LEAST_PAGES:
            continue
        lead = []
        for v in sorted(vectors, key=lambda v: (-vectors[v], v))[: templates.LEADERS]:
            if all(templates.likeness(v, x) < templates.ALIKE for x in lead):
                lead.append(v)
        support = Counter()
        for v, n in vectors.items():
            k = templates.nearest(v, lead)
            if templates.likeness(v, lead[k]) >= templates.ALIKE:
                support[lead[k]] += n
        order = sorted(support, key=lambda v: (-support[v], v))
        kept = [v for i, v in enumerate(order) if not i or (support[v] >= templates.LEAST_PAGES and support[v] >= templates.LAYOUT * total)]
        own = Counter()
        for v, n in vectors.items():
            own[kept[templates.nearest(v, kept)]] += n
        expected |= {(host, kept.index(v), v, n) for v, n in own.items()}
    got = templates.page_layouts(spark.createDataFrame(rows, "host string, html string").repartition(5)).collect()
    assert {(r.host, r.layout, tuple(r.vector), r.all_pages) for r in got} == expected and len(got) == len(expected) > 4


def test_different_vectors_stay_different(spark):
    """Two thousand words with occurrences of their own on 24 pages: as many classes as there are different vectors."""
    import random
    from collections import defaultdict

    from weftline.llm.templates import classes

    rnd = random.Random(4)
    words = {f"w{i}": rnd.sample(range(24), rnd.randrange(12, 20)) for i in range(2000)}
    pages = [" ".join(w for w, at in words.items() if i in at) for i in range(24)]
    vectors = defaultdict(set)
    for w, at in words.items():
        vectors[frozenset(at)].add(w)
    rows = classes(spark.createDataFrame([("h", f"<body>{p}") for p in pages], "host string, html string")).filter("token % 2 != 0").collect()
    assert len(rows) == 2000 and len({r["class"] for r in rows}) == len(vectors)
