import time

from hypothesis import given, settings
from hypothesis import strategies as st

from wirelens.llm import html

SCHEMA = "page_id long, url string, html string, text string, host string, n string"


def page(k, body, cls="article"):
    words = " ".join(f"w{k}x{j}" for j in range(12))
    main = f"<article><h1>Title {k}</h1>{body}<p>{words}</p></article>" if cls == "article" else f'<div class="{cls}"><h1>Title {k}</h1>{body}<p>{words}</p></div>'
    return (
        f'<html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body><nav><a href="/">home</a></nav><div class="cookie-notice">We use cookies</div>'
        f'{main}<aside>read on</aside><div class="ad">buy {k}</div><section class="comments"><p>nice {k}</p></section><form><input>go</form><footer>&copy; site</footer></body></html>'
    )


def expected(k, *blocks):
    return "\n\n".join([f"Title {k}", *blocks, " ".join(f"w{k}x{j}" for j in range(12))])


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash", "clash", "clash") for i, u, h in rows], SCHEMA).repartition(3)
    return {r.page_id: r for r in html.extract(df).collect()}


def test_article_pages_by_host(spark):
    rows = [(k, f"https://a.example/{k}", page(k, "<p>One &amp; two\n  three<br>four</p>" if k % 2 else "")) for k in range(12)]
    rows += [(100 + k, f"https://b.example/{k}", page(100 + k, "", "main-column")) for k in range(6)]
    got = run(spark, rows)
    for k in range(12):
        assert got[k].text == expected(k, *["One & two three four"] * (k % 2)) and got[k].n_chars == len(got[k].text)
    for k in range(100, 106):
        assert got[k].text == expected(k)


def test_odd_pages(spark):
    long = "long " * 60_000
    rows = [
        (1, "https://a.example/1", None), (2, None, ""), (3, "no url", "plain text"), (4, "https://a.example/2", "<article><p>cut <b>short"), (5, "https://a.example/3", f"<article><p>{long}</p></article>"),
        (6, "https://a.example/4", "<article><p>&#128512; &lt;b&gt; &nbsp; x</p><!-- gone --></article>"), (6, "https://a.example/4", "<article><p>again</p></article>"), (7, "https://a.example/5", "<<<>>><article"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = [(r.page_id, r.text) for r in html.extract(df).collect()]
    assert len(out) == len(rows)
    texts = dict(out)
    assert texts[1] == texts[2] == "" and texts[3] == "plain text" and texts[4] == "cut short" and texts[5] == long.strip()
    assert ("😀 <b> x" in [t for i, t in out if i == 6]) and ("again" in [t for i, t in out if i == 6])
    assert html.extract(df.limit(0)).count() == 0


def test_alignment_is_a_union_free_expression():
    whole = html.wrapper(html.parse("<ul><li>a</li><li>b</li></ul><p>same</p>"))
    html.align(whole, html.wrapper(html.parse("<ul><li>c</li></ul><h2>new</h2><p>same</p>")))
    assert html.expression(whole) == '#root(ul(li(#)+) h2(")? p("))'  # li repeats and its text differs, the heading is optional, the common text stays
    again = html.expression(whole)
    html.align(whole, html.wrapper(html.parse("<ul><li>c</li></ul><h2>new</h2><p>same</p>")))
    assert html.expression(whole) == again


def matches(part, node):
    """Whether a page's element is a sentence of a wrapper's part, by trying every way."""
    held = [x if not isinstance(x, str) else " ".join(x.split()) for x in node.held]
    held = [x for x in held if x != ""]

    def one(p, x):
        if p.key is None:
            return isinstance(x, str) and (p.constant is None or p.constant == html.block_hash(x))
        return not isinstance(x, str) and x.key == p.key and matches(p, x)

    def rest(i, j):
        if i == len(part.held):
            return j == len(held)
        p = part.held[i]
        if p.optional and rest(i + 1, j):
            return True
        if j < len(held) and one(p, held[j]):
            # Neighbouring texts are one slot, as they are when only an element without content stands between.
            return rest(i + 1, j + 1) or ((p.repeated or p.key is None) and again(i, j + 1))
        return False

    def again(i, j):
        return rest(i + 1, j) or (j < len(held) and one(part.held[i], held[j]) and again(i, j + 1))

    return rest(0, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.recursive(st.sampled_from(["x", "y", "z"]), lambda x: st.tuples(st.sampled_from(["p", "b", "i"]), st.lists(x, max_size=3)), max_leaves=9), min_size=2, max_size=5))
def test_a_wrapper_covers_all_pages_it_was_made_of(pages):
    render = lambda x: x if isinstance(x, str) else f"<{x[0]}>{''.join(map(render, x[1]))}</{x[0]}>"
    trees = [html.parse(f"<div>{render(p)}</div>") for p in pages]
    whole = html.wrapper(trees[0])
    for tree in trees[1:]:
        html.align(whole, html.wrapper(tree))
    assert all(matches(whole, tree) for tree in trees)
    one = html.Wrapper(whole, 1, {1}, {2})
    assert html.expression(html.Wrapper.loads(one.dumps()).root) == html.expression(whole)


def test_the_wrapper_decides_without_telling_names(spark):
    """No article, no telling class: menus and notices are what a host repeats, the main text what its pages fill."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    page = lambda k: f'<div class="x1"><p>Home and more</p></div><div class="x2"><h1>Title {k}</h1><p>{words(k)}</p><p>Read our paper every day</p><p>{words(k + 500)}</p></div><div class="x3"><a href=1>next {k}</a></div>'
    got = run(spark, [(k, f"https://a.example/{k}", page(k)) for k in range(8)] + [(50, "https://lone.example/", page(50))])
    for k in range(8):
        assert got[k].text == f"Title {k}\n\n{words(k)}\n\n{words(k + 500)}"
    assert "Read our paper" in got[50].text  # one page tells no template from text


def test_template_inside_an_article_goes_and_copies_keep_their_text(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    page = lambda k: f"<article><h1>T{k}</h1><p class='c9'>Like this? Tell a friend.</p><p>{words(k)}</p></article>"
    rows = [(k, f"https://a.example/{k}", page(k)) for k in range(5)] + [(10 + k, f"https://copies.example/{k}", page(7)) for k in range(5)]
    got = run(spark, rows)
    assert all(got[k].text == f"T{k}\n\n{words(k)}" for k in range(5))
    assert all(got[10 + k].text == f"T7\n\nLike this? Tell a friend.\n\n{words(7)}" for k in range(5))


def test_deep_and_wide_pages_end_in_seconds():
    for page in ("<div>" * 100_000 + "deep text", "<p>a</p><b>c</b>" * 50_000, "".join(f"<div><p>t{k}</p></div><ul><li>a<li>b</ul>" for k in range(15_000)), "</b>" * 50_000 + "<span>" * 50_000 + "</i></li>" * 50_000):
        began = time.perf_counter()
        known = html.Wrapper.of(page)
        known.add(html.Wrapper.of(page + "<p>more</p>"))
        known = html.Wrapper.loads(known.dumps())
        html.main_text(page, html.Rules(html.main_paths(known), known.template, html.kept_paths(known)))
        assert time.perf_counter() - began < 30


def told(k, n=30):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_what_all_pages_share_may_be_the_article_s(spark):
    """Headings and bylines that every page of a host has, titles in a header by class, sections of which one word is listed, pages within a form."""
    shared = lambda k: f"<article><h1>T{k}</h1><p>By Ann Lee</p><h2>Summary</h2><p>{told(k)}</p><h2>Details</h2><p>{told(k + 100)}</p></article>"
    header = lambda k: f"<nav><a>home</a></nav><article><div class='article-header'><h1>T{k}</h1></div><p>{told(k)}</p></article>"
    section = lambda k: f"<article><h1>T{k}</h1><p>{told(k)}</p><section class='related-work'><h2>Earlier</h2><p>{told(k + 50)}</p></section><section class='social-impact'><p>{told(k + 70)}</p></section></article>"
    form = lambda k: f"<form id=aspnet><nav><a>home</a></nav><div class=c1><h1>T{k}</h1><p>{told(k)}</p><form class=search><input>find</form></div></form><footer>f</footer>"
    inner = lambda k: f"<body><form><header>top</header><article><h1>T{k}</h1><p>{told(k)}</p><form><label>mail {k}</label></form></article></form></body>"
    rows = [(100 * i + k, f"https://h{i}.example/{k}", f(k)) for i, f in enumerate((shared, header, section, form, inner)) for k in range(5)]
    rows += [(900 + i, f"https://lone{i}.example/", f(7)) for i, f in enumerate((shared, header, section, form, inner))]
    got = {i: r.text.split("\n\n") for i, r in run(spark, rows).items()}
    want = [
        lambda k: [f"T{k}", "By Ann Lee", "Summary", told(k), "Details", told(k + 100)], lambda k: [f"T{k}", told(k)], lambda k: [f"T{k}", told(k), "Earlier", told(k + 50), told(k + 70)],
        lambda k: [f"T{k}", told(k)], lambda k: [f"T{k}", told(k)],
    ]
    for i, f in enumerate(want):
        for k in range(5):
            assert got[100 * i + k] == f(k), (i, k)
        assert got[900 + i] == f(7), i


def test_names_of_more_than_one_word(spark):
    """A listed word beside neutral ones tells a menu or comments; beside others the host's wrapper tells by links and constants."""
    page = lambda k: (
        f"<article><h1>T{k}</h1><p>{told(k)}</p><div class='comments-list'><p>nice {told(k + 300)}</p></div><div class='share-buttons'>tell friends {k}</div><ul class='related-reads'><li><a href=1>next {told(k + 400, 9)}</a></li></ul>"
        f"<div class='cookie-policy-text'>We use cookies on every page</div><div class='cookie-recipe'>Take flour {k}</div><div class='ad-slot'>buy {k}</div></article>"
    )
    got = run(spark, [(k, f"https://a.example/{k}", page(k)) for k in range(6)])
    assert all(got[k].text == f"T{k}\n\n{told(k)}\n\nTake flour {k}" for k in range(6))


def test_text_that_moves_is_no_template(spark):
    """The same sentence in every page is dropped where it stands at one place in all of them, and kept where it doesn't."""
    page = lambda k, at: "<article>" + "".join(f"<p>{told(100 * k + j)}</p>" if j != at else "<p>As told before, all is well.</p>" for j in range(9)) + "</article>"
    fixed = run(spark, [(k, f"https://a.example/{k}", page(k, 4)) for k in range(5)])
    moved = run(spark, [(k, f"https://a.example/{k}", page(k, 2 + k)) for k in range(5)])
    assert not any("As told before" in r.text for r in fixed.values()) and all("As told before" in r.text for r in moved.values())


inline = st.sampled_from(["{}", "<b>{}</b>", "x<br>{}", "<a href=1>{}</a> y", "&lt;{}&gt;", "<span class='note'>{}</span>"])
block = st.sampled_from(["<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<ul><li>{}</li><li>z</li></ul>", "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td><td>q</td></tr></table>", "<section class='part'>{}</section>", "{}"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(block, inline), min_size=1, max_size=8), min_size=1, max_size=5))
def test_nothing_of_an_article_is_dropped(pages):
    """By brute force: the main text is the article's source without its tags, word by word, when no two pages share a text at a place."""
    import re
    from html import unescape

    made = ["".join(b.format(i.format(f"w{k}n{j}")) for j, (b, i) in enumerate(parts)) for k, parts in enumerate(pages)]
    whole = None
    for body in made:
        own = html.Wrapper.of(f"<html><body><nav>menu</nav><article>{body}</article><footer>end</footer></body></html>")
        whole = own if whole is None else (whole.add(own), whole)[1]
    whole = html.Wrapper.loads(whole.dumps())
    kept = html.kept_paths(whole)
    rules = html.Rules(html.main_paths(whole, kept), set(), kept)
    for body in made:
        got = html.main_text(f"<html><body><nav>menu</nav><article>{body}</article><footer>end</footer></body></html>", rules)
        plain = re.sub(r"</?(?:b|a|span)\b[^>]*>", "", body)
        assert got.split() == unescape(re.sub(r"<[^>]*>", " ", plain)).split()


def test_gathering_leaves_nothing_out(monkeypatch):
    """A wrapper of very different pages takes parts of one kind together; its characters, slots and rules stay."""
    pages = ["<body><nav><a>m</a></nav><div class=c>" + "".join(f"<p class=k{(i * k) % 17}>{told(i * 40 + k, 12)}</p><hr>" for i in range(1, 30)) + "</div></body>" for k in range(1, 9)]

    def known():
        whole = html.Wrapper.of(pages[0])
        for p in pages[1:]:
            whole.add(html.Wrapper.of(p))
        return whole

    def rules(w):
        kept = html.kept_paths(w)
        return html.main_paths(w, kept), w.template, kept

    free = known()
    monkeypatch.setattr(html, "MOST_PARTS", 30)
    few = known()
    assert few.parts < free.parts and sum(x.chars for x in html.preorder(few.root)) == sum(x.chars for x in html.preorder(free.root))
    assert rules(few) == rules(free)


def test_a_hot_host_is_aligned_in_a_tree(spark, monkeypatch):
    rows = [(k, "https://hot.example/x", f"<article><h1>T{k}</h1><p>{told(k)}</p></article>") for k in range(90)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(45)
    want = sorted(map(str, html.extract(df).collect()))
    monkeypatch.setattr(html, "MOST_ALIGNED", 3)
    assert sorted(map(str, html.extract(df).collect())) == want
    (host,) = html.host_wrappers(df).collect()
    assert host.n == 90
