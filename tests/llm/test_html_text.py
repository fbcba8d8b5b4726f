import math
import random
import time

from sparrel.llm import html_text as H

TEXT = "One two three four five six seven eight nine ten, and so on for a while longer than a menu."


def page(body: str, head: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style>{head}</head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    html = page(
        '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy this long thing now, it is very good for you.</div>'
        f"<article><h1>Head</h1><p>{TEXT}</p><p>Be. <b>bold</b>.</p><script>x='</p>'</script><form><p>Name <input></p></form><p>{TEXT}</p></article>"
        '<aside><p>Other things to read</p></aside><div id="comments"><p>' + TEXT + '</p></div><div class="cookie-notice">We use cookies.</div><footer>&copy; site</footer>'
    )
    assert H.main_text(html) == f"Head {TEXT} Be. bold. {TEXT}"


def test_broken_markup():
    assert H.main_text(f"<html><body><nav><ul><li><a href=x>m</a><article><h1>H</h1><p><b>{TEXT}<br><p>Second &amp; third.</article><footer>f") == f"H {TEXT} Second & third."
    assert H.main_text(f"<article><h1>H</h1><p>{TEXT}</p><p>cut of") == f"H {TEXT} cut of"
    assert H.main_text("<p>a") == "a"
    assert H.main_text("<<<>>> &bogus; <div") != None  # noqa: E711


def test_pages_without_article_use_the_densest_region():
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(12))
    html = page(f'<div id="top"><ul>{links}</ul></div><div id="text"><h2>Head</h2><p>{TEXT * 3}</p><p>Short.</p><p>{TEXT * 2}</p></div><div id="end"><ul>{links}</ul></div>')
    assert H.main_text(html) == f"Head {TEXT * 3} Short. {TEXT * 2}"


def test_references_and_white_space():
    assert H.main_text(page("<article><p>a&nbsp;b &eacute;&#233;&#xE9;\n\n  c\t</p>\n<p>d</p></article>")) == "a b ééé c d"


def test_comments_of_readers_and_nested_articles():
    html = page(f'<main><article><h1>H</h1><p>{TEXT * 3}</p><section class="comments"><article><p>{TEXT}</p></article></section></article></main>')
    assert H.main_text(html) == f"H {TEXT * 3}"


def test_smoothing_and_threshold():
    assert all(abs(v - 5) < 1e-9 for v in H.smoothed([5.0] * 4))
    s = H.smoothed([0, 0, 10, 0, 0])
    assert s[2] == max(s) and abs(s[1] - s[3]) < 1e-12
    assert 1 < H.threshold([1, 1, 1, 9, 9]) < 9 and H.threshold([3, 3]) == 3


def test_deep_nesting_and_long_text():
    assert H.main_text("<div>" * 5000 + TEXT) == TEXT
    assert H.main_text(page(f"<article><p>{'word ' * 300_000}</p></article>")) == ("word " * 300_000).strip()


def test_tables(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", page(f"<article><p>{TEXT}</p></article>")), (3, "w", "plain"), (3, "w", "plain")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", TEXT, len(TEXT)), (3, "w", "plain", 5), (3, "w", "plain", 5)], key=repr)
    assert H.extract(df.where("false")).count() == 0


def test_class_names():
    body = f"<article class='post has-sidebar'><header class='entry-header'><h1>H</h1></header><p>{TEXT * 3}</p><div class='relatedPosts'><p>{TEXT}</p></div></article>"
    html = page(f"<div class='site-header'><p>Site of things</p></div><div class='layout with-sidebar'>{body}<div class='sidebar'><p>{TEXT}</p></div></div><div role='contentinfo'>(c)</div>")
    assert H.main_text(html) == f"H {TEXT * 3}"


def test_without_article_all_dense_text_stays_and_link_lists_go():
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(12))
    html = page(f"<div id='y'><ul>{links}</ul></div><div id='x1'><p>{TEXT}</p></div><div id='x2'><h2>Head</h2><p>{TEXT * 4}</p><p>Short.</p><p>{TEXT * 4}</p></div><div id='z'><ul>{links}</ul></div>")
    assert H.main_text(html) == f"{TEXT} Head {TEXT * 4} Short. {TEXT * 4}"


def test_marks_among_other_words_drop_no_dense_text():
    for name in ("class='market-share'", "id='alert-level'", "class='search-results-article'"):
        assert H.main_text(page(f"<article><p>{TEXT * 2}</p><p {name}>{TEXT}</p><p>{TEXT}</p></article>")) == f"{TEXT * 2} {TEXT} {TEXT}"
        assert H.main_text(page(f"<div {name}><p>{TEXT * 3}</p></div>")) == TEXT * 3
    assert H.main_text(page(f"<div class='layout sidebar-right'><p>{TEXT * 3}</p></div>")) == TEXT * 3
    for name in ("cookie-notice", "share-buttons", "ad_slot", "newsletterBox", "comments-list"):
        assert H.main_text(page(f"<article><p>{TEXT * 3}</p><div class='{name}'><p>{TEXT}</p></div></article>")) == TEXT * 3


def test_nested_blocks_take_linear_time():
    began = time.time()
    assert H.main_text("<div>text" * 50_000).count("text") == 50_000
    assert H.main_text("<article>" + "<div class='x'><span>text</b></i>" * 20_000).count("text") == 20_000
    assert time.time() - began < 10


class Tree:
    """A random element with what it holds, in order: texts and elements."""

    def __init__(self, rng, depth, tag, menu=False):
        menu = menu or tag == "nav"  # an article would end it
        self.tag, self.cls, self.children = tag, rng.choice(["", "", "", "", "x", "sidebar", "market-share", "ad-box"]) if tag not in ("body", "article") else "", []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.5 or not depth:
                words = " ".join(rng.choice(("aa", "bbbb", "cccccc")) for _ in range(rng.choice((1, 2, 5, 40))))
                self.children.append((words, rng.random() < 0.3))
            else:
                self.children.append(Tree(rng, depth - 1, rng.choice(("div", "div", "section", "div" if menu or tag == "article" else "article", "nav", "aside", "ul")), menu))

    def html(self):
        inner = "".join(c.html() if isinstance(c, Tree) else f"<p><a>{c[0]}</a></p>" if c[1] else f"<p>{c[0]}</p>" for c in self.children)
        return f"<{self.tag} class='{self.cls}'>{inner}</{self.tag}>"


def brute(root):
    """The rules as the module states them, element by element; every sum is taken over all blocks again."""
    blocks = []  # text, linked, path of elements
    events = []  # tags since the last block

    def walk(t, path):
        if t is not root:
            events.append(1)
        for c in t.children:
            if isinstance(c, Tree):
                walk(c, (*path, c))
            else:
                events.extend([1] * (2 if c[1] else 1))
                blocks.append([c[0], len(c[0]) if c[1] else 0, path, 0])
                events.extend([1] * (2 if c[1] else 1))
                blocks[-1][3] = len(events)
                events.clear()
        events.append(1)

    walk(root, (root,))
    never = lambda t: t.tag in ("nav", "aside")
    named = lambda t: t.cls in ("sidebar", "ad-box")
    article = lambda path: any(t.tag == "article" for t in path)
    gone = lambda t: never(t) or named(t)
    kept = [b for b in blocks if not any(map(gone, b[2]))]
    held = lambda t, within: sum(len(b[0]) for b in within if t in b[2])
    if len(kept) < len(blocks) and not any(article(b[2]) for b in kept):
        possible = [b for b in blocks if not any(map(never, b[2]))]
        whole = sum(len(b[0]) for b in possible)
        every = {t for b in blocks for t in b[2]}
        spared = {t for t in every if 2 * held(t, possible) > whole and gone(t)}
        order = [t for b in blocks for t in b[2] if t.tag == "article"]
        if order:
            best = max(order, key=lambda t: held(t, possible))
            if held(best, possible) > sum(len(b[0]) for b in kept):
                spared |= set(next(b[2][: b[2].index(best) + 1] for b in blocks if best in b[2]))
        kept = [b for b in blocks if not any(gone(t) and t not in spared for t in b[2])]
    if not kept:
        return ""
    smooth = H.smoothed([math.log1p((len(b[0]) - b[1]) / max(1, b[3])) for b in kept])
    cut = min(H.threshold(smooth), math.log1p(H.ENOUGH))
    dense = [b for b, r in zip(kept, smooth, strict=True) if r >= cut]
    plain = lambda part: sum(len(b[0]) - b[1] for b in part)
    total = plain(dense)
    inside = lambda t, part: [b for b in part if t in b[2]]
    size = lambda part: sum(len(b[0]) for b in part)
    weak = lambda t: t.cls == "market-share" and 2 * len(inside(t, dense)) < len(inside(t, kept)) and 2 * sum(x[1] for x in inside(t, kept)) > size(inside(t, kept))
    outer = []
    for b in kept:
        first = next((t for t in b[2] if t.tag == "article"), None)
        if first and first not in outer and (plain(inside(first, dense)) or size(inside(first, kept)) > 2 * sum(x[1] for x in inside(first, kept))):
            outer.append(first)
    if sum(plain(inside(t, dense)) for t in outer) >= H.REGION_SHARE * total:
        return " ".join(b[0] for b in kept if any(t in outer for t in b[2]) and not any(map(weak, b[2])))
    region = max((t for b in dense for t in b[2] if total and t.tag in H.REGIONS and plain(inside(t, dense)) == total), key=lambda t: next(b[2].index(t) for b in kept if t in b[2]), default=root)
    path = lambda t: next(b[2] for b in kept if t in b[2])
    links = lambda t: t is not region and region in path(t)[: path(t).index(t)] and 2 * len(inside(t, dense)) < len(inside(t, kept)) and 2 * sum(x[1] for x in inside(t, kept)) > size(inside(t, kept))
    alone = lambda b: b[1] and not any(b is x for x in dense)  # a paragraph that is a link
    return " ".join(b[0] for b in kept if (region is root or region in b[2]) and not alone(b) and not any(weak(t) or links(t) for t in b[2]))


def test_against_brute_force_on_random_trees():
    rng, seen = random.Random(5), set()
    for _ in range(1500):
        tree = Tree(rng, 3, "body")
        got = H.main_text(f"<html>{tree.html()}</html>")
        assert got == brute(tree), tree.html()
        seen.add(got)
    assert len(seen) > 1000


def test_linked_lists_and_cells_of_an_article_stay():
    html = page(f"<article><p>{TEXT * 3}</p><ul><li><a href='/r'>Reference one</a></li></ul><table><tr><td><a href='/c'>Cell</a></td></tr></table></article>")
    assert H.main_text(html) == f"{TEXT * 3} Reference one Cell"


def test_two_articles_stay():
    assert H.main_text(page(f"<article><p>{TEXT * 6}</p></article><article><p>{TEXT * 4}</p></article>")) == f"{TEXT * 6} {TEXT * 4}"


def test_marks_and_forms_around_the_whole_text_count_for_nothing():
    assert H.main_text(page(f"<p>x</p><div class='content-sidebar-left'><article><p>{TEXT * 3}</p></article><div class='ad'>Buy</div></div>")) == TEXT * 3
    assert H.main_text(page(f"<form action='/'><div><p>{TEXT * 3}</p><p>{TEXT}</p></div></form>")) == f"{TEXT * 3} {TEXT}"


def test_dropped_inline_elements_take_only_their_own_text():
    long = f"<p>{TEXT * 2}</p>"
    gone = ["<button>GONE</button>", "<textarea>GONE</textarea>", "<svg><text>GONE</text></svg>", "<video>GONE</video>", "<iframe>GONE</iframe>", "<object>GONE</object>", "<math><mi>GONE</mi></math>",
            "<template>GONE</template>", "<canvas>GONE</canvas>", "<audio>GONE</audio>", "<span class='ad'>GONE</span>", "<span class='share'>GO <br>NE</span>", "<select><option>GO<option>NE</select>"]
    for inline in gone:
        assert H.main_text(page(f"<article>{long}<p>Intro {inline} rest</p></article>")) == f"{TEXT * 2} Intro rest", inline
        assert H.main_text(page(f"<article>{long}{inline}Loose end</article>")) == f"{TEXT * 2} Loose end", inline
    assert H.main_text(page(f"<article>{long}<p>A long sentence that matters <span class='share'>Share <br>now</span></p></article>")) == f"{TEXT * 2} A long sentence that matters"
    assert H.main_text(page(f"<article>{long}<p>Important sentence here <button>Share</p><p>More</p></article>")) == f"{TEXT * 2} Important sentence here More"


class Inline:
    """A random paragraph: texts and inline elements, some of which are dropped."""

    def __init__(self, rng, depth, tag="", dropped=False):
        self.tag, self.dropped = tag, dropped
        self.children = []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.5 or not depth:
                self.children.append(rng.choice(("aa ", " bb", "cc", "&amp;", " ")))
            else:
                tag, drop = rng.choice((("b", False), ("i", False), ("span", False), ("a", False), ("button", True), ("span class='ad'", True), ("svg", True), ("em class='sidebar'", True)))
                self.children.append(Inline(rng, depth - 1, tag, drop))

    def html(self):
        inner = "".join(c if isinstance(c, str) else c.html() for c in self.children)
        return f"<{self.tag}>{inner}</{self.tag.split(' ')[0]}>" if self.tag else inner

    def kept(self):
        return "" if self.dropped else "".join(c.replace("&amp;", "&") if isinstance(c, str) else c.kept() for c in self.children)


def test_against_brute_force_on_characters_of_inline_elements():
    rng = random.Random(6)
    for _ in range(1500):
        paragraphs = [Inline(rng, 3) for _ in range(rng.randrange(1, 5))]
        got = H.main_text(page(f"<article><p>{TEXT * 9}</p>{''.join(f'<p>{p.html()}</p>' for p in paragraphs)}</article>"))
        want = [TEXT * 9, *(" ".join(p.kept().split()) for p in paragraphs)]
        assert got == " ".join(w for w in want if w), [p.html() for p in paragraphs]


def test_names_that_tell_what_an_article_is_about():
    for head in ("navigation", "search", "sharing", "comments", "footer"):
        assert H.main_text(page(f"<article><p>{TEXT * 2}</p><h2 id='{head}'>Head</h2><p>{TEXT}</p></article>")) == f"{TEXT * 2} Head {TEXT}"
    for open_tag, close in (("section id='social'", "section"), ("section id='copyright'", "section"), ("section id='notices'", "section"), ("div class='banner-text'", "div"), ("blockquote class='comment'", "blockquote")):
        html = page(f"<article><p>{TEXT * 2}</p><{open_tag}><h3>Part</h3><p>{TEXT}</p><p>{TEXT}</p></{close}><p>{TEXT}</p></article>")
        assert H.main_text(html) == f"{TEXT * 2} Part {TEXT} {TEXT} {TEXT}"
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(9))
    for name in ("social", "search", "related", "banner"):
        assert H.main_text(page(f"<article><p>{TEXT * 4}</p><div class='{name}'><ul>{links}</ul></div><p>{TEXT}</p></article>")) == f"{TEXT * 4} {TEXT}"


def test_comments_of_readers_and_demands_for_consent_go():
    for name in ("user-replies", "reader-comments", "commentlist", "blog-comments", "disqus_thread", "comments", "comment-section", "commentThread"):
        for how in ("class", "id"):
            inside = page(f"<article><p>{TEXT * 3}</p><div {how}='{name}'><p>{TEXT * 2}</p><p>{TEXT * 2}</p></div></article>")
            outside = page(f"<article><p>{TEXT * 3}</p></article><section {how}='{name}'><p>{TEXT * 9}</p></section>")
            alone = page(f"<div><p>{TEXT * 3}</p></div><div {how}='{name}'><p>{TEXT * 9}</p></div>")
            assert [H.main_text(h) for h in (inside, outside, alone)] == [TEXT * 3] * 3, (how, name)
    for name in ("cookie-wall", "gdpr-overlay", "cookieBanner", "consent-layer"):
        notice = f"<div class='{name}'><p>{TEXT * 3}</p><p>{TEXT * 3}</p></div>"
        assert H.main_text(page(f"{notice}<article><p>{TEXT * 3}</p></article>")) == TEXT * 3
        assert H.main_text(page(f"{notice}<div id='main'><p>{TEXT * 3}</p></div>")) == TEXT * 3


def test_work_grows_with_the_length():
    n = 20_000
    pages = {
        "open elements": "<span><article>" + "<b>x</span>" * n, "open tags": TEXT + "<a " * n, "open quotes": f"<p>{TEXT}</p>" + "<a b='\"" * n, "one open quote": f"<p>{TEXT}<a b=\"" + "<i>x</i>" * n,
        "open comments": TEXT + "<!-- x " * n, "comments that end once": TEXT + "<!-- x -->" + "<!-- x " * n, "ends alone": TEXT + "</" * n, "declarations": TEXT + "<!x " * n, "instructions": TEXT + "<?x " * n,
        "paragraphs": "<p><b>" * n, "ends without starts": "<div>" * 50 + "</p></span></b>" * n, "menus left open": "<nav><article>" * n, "references": "&" * n, "scripts": "<script>" + "</x" * n,
    }
    for name, html in pages.items():
        began = time.time()
        H.main_text(html)
        assert time.time() - began < 3, name  # a second, on a machine at rest


def test_pages_cut_off_keep_what_came_before():
    for end in ("<di", "<a href='x", "<!-- unfinished <p>not</p>", "</", "<!DOC", "<p class="):
        assert H.main_text(f"<article><p>{TEXT}</p>{end}") == TEXT, end
    assert H.main_text(f"<article><p>{TEXT} 1 < 2 and 3 > 2 <3</p></article>") == f"{TEXT} 1 < 2 and 3 > 2 <3"
    assert H.main_text(f"<article><p>{TEXT} 5 < 6") == f"{TEXT} 5 < 6"
