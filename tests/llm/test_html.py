from answerlens.llm.html_extract import extract_html, main_text

P = "This paragraph is long enough to count, with commas, and words, and it goes on for a while."
Q = "A second paragraph follows here, again with some commas, so that the article wins by points."


def test_semantic_page():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy, buy, buy this very good thing now, please.</div>
    <article><h1>Title&nbsp;of it</h1><p><b>{P}<br>more<p>{Q}</p><aside>{Q}</aside><form><p>{P}</p></form><div class="share-bar">share</div></article>
    <section class="comments"><article><p>{P} Reader says so.</p></article></section><div id="sidebar">{P}</div><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == f"Title of it {P} more {Q}"


def test_plain_divs_and_siblings():
    page = f"""<body><div id=top><a href=1>One</a> <a href=2>Two</a></div><h1>Head</h1><div class="content"><p>{P}</p><div><p>{Q}</p></div>
    <ul><li><a href=3>Related thing</a><li><a href=4>Another related thing</a></ul></div><div class="cookie-notice"><p>{P}</p></div></body>"""
    assert main_text(page) == f"Head {P} {Q}"


def test_character_references_inline_tags_and_cut_pages():
    assert main_text("<p>a&lt;b &#233;&#x41; in<b>li</b>ne w<!-- x -->ord</p>") == "a<b éA inline word"
    assert main_text(f"<article><h1>T</h1><p>{P}</p><p>{Q[:30]}</p><a hre") == f"T {P} {Q[:30]}"
    assert main_text("<article><h1>Ab.</h1><p>Ab.</p></article>") == "Ab. Ab."
    assert main_text("1 < 2 & 3 > 2") == "1 < 2 & 3 > 2"
    assert main_text("<p>x <script>unclosed") == "x"
    assert main_text("") == main_text(None) == main_text("<nav>only</nav>") == ""
    assert main_text(f'<div class="ad"><p>{P}</p>') == P


def test_deep_and_long_pages():
    assert main_text("<div>" * 50_000 + P) == P
    assert len(main_text("<p>" + "word, " * 200_000)) == 6 * 200_000 - 1
    main_text("<a b='" * 3000)


def test_rows(spark):
    rows = [(1, "u", f"<p>{P}</p>", 3), (None, None, None, 4), (2, "u", "", 5), (2, "u", "", 5), (3, "u", f"<p>{P}é</p>", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT int")
    out = extract_html(df)
    assert out.columns == ["page_id", "url", "html", "TEXT", "text_", "n_chars"]
    assert sorted(r.n_chars for r in out.collect()) == [0, 0, 0, len(P), len(P) + 1]
    assert extract_html(df.limit(0)).count() == 0


def test_pages_without_an_article_are_empty():
    for names in ("comments", "comment-list", "cookie-consent", "site-footer", "main-nav", "newsletter signup"):
        assert main_text(f'<section class="{names}"><p>{P}</p><p>{Q}</p></section>') == ""
    assert main_text(f'<article class="comment"><p>{P}</p></article>') == ""
    assert main_text(f"<form><p>{P}</p></form>") == ""


def test_one_listed_word_among_others_is_weighed():
    for attrs in ('id="social-policy-report"', 'class="search-engine-history"', 'class="content sidebar-right"', 'class="page-with-sidebar"', 'class="layout-sidebar-left"'):
        page = f'<body><div {attrs}><h1>T</h1><p>{P}</p><p>{Q}</p></div><div class="sidebar-tags-cloud"><p>{P[:40]}</p></div></body>'
        assert main_text(page) == f"T {P} {Q}"
    assert main_text(f'<form action=x><div class="main"><h1>T</h1><p>{P}</p></div></form>') == f"T {P}"


def test_short_closing_blocks_headings_and_bare_text_stay():
    assert main_text(f"<div class=wrap><div class=a><p>{P}</p><p>{Q}</p></div><div class=c><p>Short closing words, last.</p></div></div>") == f"{P} {Q} Short closing words, last."
    assert main_text(f"<body><div><h3>Small head</h3><div><p>{P}</p><p>{Q}</p></div>Bare text beside.</div></body>") == f"Small head {P} {Q} Bare text beside."
    assert main_text(f"<main><article><p>{P}</p></article><article><h2>Two</h2><p>{Q}</p></article></main>") == f"{P} Two {Q}"


def test_time_is_linear():
    import time

    pages = ["<b>{}</b>", "<p>x", "<div><li>", "<li><ul>", "<b><p>x</p>", "<table><tr><td>", "<a b='", "<i></b>"]
    for unit in pages:
        page = unit.replace("{}", "") * 8000 + P
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 1.5, unit
    deep = "<b>" * 8000 + "</i>" * 8000 + "<div></div>" * 8000 + P
    began = time.process_time()
    assert main_text(deep) == P
    assert time.process_time() - began < 1.5
    nested = "<li><ul>" + "<div>" * 8000 + "<li>x</li>" * 8000 + P
    began = time.process_time()
    main_text(nested)
    assert time.process_time() - began < 1.5


def test_planted_articles():
    """Pages of known blocks: every block of the article comes out, and nothing of the rest."""
    import random

    rng = random.Random(3)
    says = lambda n: " ".join(rng.choice(["word", "other,", "third", "and", "so", "on"]) + str(rng.randrange(999)) for _ in range(n))
    for _ in range(300):
        wanted, parts = [], []
        for _ in range(rng.randrange(2, 9)):
            t = says(rng.randrange(12, 120))
            kind = rng.choice(["p", "p", "p", "h2", "blockquote", "pre", "div", "ul", "table"])
            wanted.append(t)
            parts.append({"ul": f"<ul><li>{t}</ul>", "table": f"<table><tr><td>{t}</table>", "div": f"<div class=inner><p>{t}</div>"}.get(kind, f"<{kind}>{t}</{kind}>"))
            if rng.random() < 0.3:
                parts.append(rng.choice([f"<aside>{says(30)}</aside>", f'<div class="ad-slot"><p>{says(60)}</p></div>', f"<script>{says(9)}</script>", f"<form><p>{says(20)}</p></form>", f'<div class="share-buttons">{says(5)}</div>', f"<style>p{{}}</style><nav>{says(9)}</nav>"]))
        inside = "".join(parts)
        home = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div><div class="post-text">{}</div></div>', '<section id="story">{}</section>'])
        links = "".join(f"<li><a href={i}>{says(3)}</a>" for i in range(8))
        after = f'<section class="comments">{"".join(f"<article><p>{says(40)}</p></article>" for _ in range(4))}</section>' if rng.random() < 0.5 else ""
        page = f'<html><head><title>{says(4)}</title></head><body><header><h1>{says(3)}</h1></header><nav><ul>{links}</ul></nav>{home.format(inside)}<div id="sidebar"><p>{says(80)}</p></div>{after}<div class="cookie-notice">{says(30)}</div><footer><p>{says(30)}</p></footer></body></html>'
        assert main_text(page) == " ".join(wanted)
