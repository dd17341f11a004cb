from tabloom.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) {"</p>"}</script><style>p{}</style></head><body>
<header>Site name</header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; small</h1><p>First <b>bold</b> word<br>and&nbsp;more.<p>Second <a href="y">link</a>
 line &lt;3<ul><li>One<li>Two</ul><aside>By the way</aside><form><input value=q>Find</form>
<div id="comments"><p>I disagree</p></div><div class="adBox">Buy</div><p hidden>Not shown</p></article>
<div class="sidebar">Other</div><footer>&copy; me</footer></body></html>"""


def text(html):
    return "\n\n".join(H.main_text(*H.tree(html), set())[0])


def test_article():
    assert text(PAGE) == "Big & small\n\nFirst bold word and more.\n\nSecond link line <3\n\nOne\n\nTwo"


def test_broken_markup():
    assert text("<p>a <b>b<p>c</b> d") == "a b\n\nc d"
    assert text("<article><p>cut off &am") == "cut off &am"
    assert text("no markup at all") == "no markup at all"
    assert text("1 < 2 and <p>x</p") == "1 < 2 and\n\nx"
    assert text(None) == text("") == ""
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<div>" * 3000 + "<nav>menu</nav><div class=menu>more</div>deep" + "</div>" * 3000 + "<p>end") == "deep\n\nend"
    assert text("<b>" * 50_000 + "x" + "</i>" * 50_000) == "x"
    assert text("AT&am<b>p;</b>T") == "AT&amp;T" and text("a &lt;b&gt; &amp;amp; c") == "a <b> &amp; c"
    assert text("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, common string")


def test_site_template_goes_and_copies_stay(spark):
    rows = [(i, f"http://h.com/{i}", f"<div class=box><p>Share this story</p></div><div><p>Own text {i}</p><p>and more of its own {i * 7}</p></div>", "h", "c") for i in range(30)]
    rows += [(100 + i, f"http://copies.com/{i}", f"<div><p>A story that many pages copy</p><p>{'own end ' if i % 2 else 'end'}</p></div>", "h", None) for i in range(30)]
    got = {r["page_id"]: r for r in H.extract(pages(spark, rows)).collect()}
    assert got[3]["text"] == "Own text 3\n\nand more of its own 21" and got[3]["n_chars"] == len(got[3]["text"]) and got[3]["n_template_blocks"] == 1
    assert got[104]["text"].startswith("A story that many pages copy")


def test_slots_go_whatever_their_words(spark):
    """A box that every page has in one place, with other words each time; the same box elsewhere stays."""
    rows = []
    for i in range(12):
        body = f"<p>Own text {i} of some length, so that it is most of the page</p><div class=x17>kept {i}</div>"
        rows.append((i, f"http://h.com/{i}", f"<div class=x17><span>w{i}</span> v{i * 3}</div><div id=c>{body}<p>{'word ' * 30}{i}</p></div><div class=y>&copy; {i}</div>", "h", "c"))
    rows.append((50, "http://few.com/", "<div class=x17>few pages</div><div id=c>text</div>", "h", None))
    got = {r["page_id"]: r for r in H.extract(pages(spark, rows)).collect()}
    assert got[3]["text"].startswith("Own text 3 of") and got[3]["text"].endswith("word 3")
    assert (got[3]["n_slot_blocks"], got[3]["n_marked_blocks"]) == (3, 0)  # within #c too the box is a slot
    assert got[50]["text"] == "few pages\n\ntext"


def test_text_beside_a_teaser_is_kept():
    assert text(f"<p>before</p><article>teaser</article><p>{'long ' * 20}</p>").startswith("before\n\nteaser\n\nlong")
    assert text(f"<p>before</p><article>{'long ' * 20}</article>").startswith("long")


def brute(rows):
    """Counts over whole pages in plain Python: {(host, hash)} of templates."""
    by, out = {}, set()
    for _, url, html, *_ in rows:
        host = url.split("://")[1].split("/")[0]
        by.setdefault(host, []).append(H.tree(html))
    for host, trees in by.items():
        distinct = {tuple(t[0]): t for t in trees}.values()
        for h in {h for t in trees for h in t[3]} - {0}:
            n = sum(h in t[3] for t in distinct)
            if n >= H.TEMPLATE_PAGES and n >= H.TEMPLATE_SHARE * len(distinct):
                out.add((host, h))
        for p in {p for t in trees for p in t[4]} - {0}:
            own = [H.shares(*t[:3], t[4])[p] for t in trees if p in t[4]]
            if len(own) >= H.TEMPLATE_PAGES and len(own) >= H.SLOT_PAGES * len([t for t in trees if t[0]]) and sum(own) < H.SLOT_SHARE * len(own):
                out.add((host, p))
    return out


def test_templates_against_brute_force(spark):
    import random

    rng = random.Random(4)
    text_ = lambda: " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9)))
    rows = []
    for i in range(60):
        boxes = "".join(f"<div class=k{rng.randrange(4)}><p>{text_()}</p></div>" for _ in range(rng.randrange(5)))
        rows.append((i, f"http://h{i % 3}.com/{i}", f"<div>{boxes}</div><section><p>{text_() * 9}</p></section>", "h", "c"))
    got = H.templates(H.parsed(pages(spark, rows))).collect()
    want = brute(rows)
    assert {(r["host"], h) for r in got for h in r["site"]} == want and len(want) > 3


def test_join_beyond_the_broadcast_gives_the_same(spark, monkeypatch):
    rows = [(i, "http://h.com/", f"<p>Same</p><p>Own text number {i}, quite long</p>", "h", "c") for i in range(20)]
    a = sorted(map(tuple, H.extract(pages(spark, rows)).collect()))
    monkeypatch.setattr(H, "BROADCAST_HASHES", -1)
    assert sorted(map(tuple, H.extract(pages(spark, rows)).collect())) == a and a[0][2] == "Own text number 0, quite long"


def test_cases(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x", "<p>y", "z", "z"), (3, "http://a", "", "", "")]
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.extract(pages(spark, rows)).collect()))
    assert got == [(0, "y", 1), (1, "", 0), (1, "", 0), (3, "", 0)]
    assert H.extract(pages(spark, [])).count() == 0
