import random

import pytest

from quillon.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article class="post"><h1>Title &amp; more</h1><p><b>One<br>two &copy; x<p>Three&nbsp;&#8364;four</p><aside>side</aside><form><input>go</form>
<div id="comments"><article><p>nice</p></article></div><ul><li>a<li>b</ul><!-- <p>no</p> --></article></main><div class="sidebar">s</div><footer>&copy; f</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "text"),
    [(PAGE, "Title & more\n\nOne two © x\n\nThree €four\n\na\n\nb".replace("Three €four", "Three €four")), (None, ""), ("", ""), ("plain & text < 5 > 3", "plain & text < 5 > 3"), ("<p>cut <b>of", "cut of"), ("<div class=ad>x</div><p>y</p>", "y"), ("<p a='>'>x</p><!-- open", "x"), ("<p>a</p></div></p><p>b", "a\n\nb")],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, slot string, host string, text string")


def test_template_of_a_host(spark):
    """Without telling tags, what a host's pages have in common is its template, and the slot with the article is left."""
    body = "<html><body><div id=top>Our company since 1900</div><div id=c><p>{0} first</p><p>{0} second</p></div><div id=low>Call us today</div></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format(f"unique{i}"), "clash", "clash", "clash") for i in range(6)]
    rows += [(10, None, "<p>alone</p>", None, None, None), (11, "http://x.example", None, None, None, None), (0, "http://h.example/0", rows[0][2], None, None, None)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages(spark, rows)).collect())
    want = [(i, f"unique{i} first\n\nunique{i} second") for i in (0, 0, 1, 2, 3, 4, 5)] + [(10, "alone"), (11, "")]
    assert got == [(i, t, len(t)) for i, t in want]
    assert html_text.extract(pages(spark, [])).count() == 0


def test_articles_keep_lines_that_all_pages_have(spark):
    rows = [(i, "http://h.example/", f"<body><nav>m{i}</nav><article><p>shared line</p><p>own {i}</p></article></body>", None, None, None) for i in range(5)]
    assert sorted(r.text for r in html_text.extract(pages(spark, rows)).collect()) == [f"shared line\n\nown {i}" for i in range(5)]


def test_long_page(spark):
    html = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert html_text.main_text(html) == "\n\n".join(["word"] * 20_000)


def test_template_outweighs_tags(spark):
    """The body in main, or in a plain element, stays whole where an article element is a teaser or the like."""
    rows = []
    for i in range(6):
        rows.append((i, "http://m.example/", f"<body><main><p>Own {i} text of the body, which is long</p><p>And {i} more</p><article class=card><p>see {i}</p></article></main></body>", None, None, None))
        rows.append((10 + i, "http://d.example/", f"<body><div id=c><p>Call us</p><p>Own {i} text of the body, which is long</p></div><article class=card><p>see {i}</p></article></body>", None, None, None))
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    for i in range(6):
        assert got[i] == f"Own {i} text of the body, which is long\n\nAnd {i} more\n\nsee {i}"
        assert got[10 + i] == f"Own {i} text of the body, which is long"


def test_attributes_as_html_has_them():
    """A quote opens a string only after "=", and a name marks a part only as a whole."""
    assert html_text.main_text("<article><p title=it's>Hello world</p><p>It's good</p><p>End</p></article>") == "Hello world\n\nIt's good\n\nEnd"
    assert html_text.main_text("<article><p class='share-price'>a</p><p class=notice-period>b</p><p title='class=ad'>c</p><p class=\"cookie-notice\">d</p><p class=shareButtons>e</p></article>") == "a\n\nb\n\nc"
    assert html_text.main_text("<p a=\"x>y\" b='>'>in</p><p c=\"open>out") == "in\n\nout"
    assert html_text.main_text("<p " + "a= b=\"" * 5000 + ">x") is not None


def test_small_hosts_and_copies(spark):
    """Two pages make a template, and so do two pages that occur twice each; copies of one page alone make none."""
    body = "<html><body><div id=top>Our company</div><div id=c><p>{0} first</p><p>{0} second</p></div><div id=low>Call us today</div></body></html>"
    rows = [(i, f"http://two.example/{i}", body.format(f"unique{i}"), None, None, None) for i in range(2)]
    rows += [(10 + i, f"http://four.example/{i}", body.format(f"unique{i % 2}"), None, None, None) for i in range(4)]
    rows += [(20 + i, "http://same.example/", body.format("same"), None, None, None) for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"unique{i} first\n\nunique{i} second" for i in range(2))
    assert all(got[10 + i] == f"unique{i % 2} first\n\nunique{i % 2} second" for i in range(4))
    assert all(got[20 + i] == "Our company\n\nsame first\n\nsame second\n\nCall us today" for i in range(4))


def slow_templates(rows):
    """Slot and constants of each host, from whole occurrence vectors."""
    hosts = {}
    for page, url, html in rows:
        hosts.setdefault((url or "").split("/")[2] if url else "", []).append((page, html))
    out = {}
    for name, own in hosts.items():
        if len(own) < html_text.LEAST_PAGES or len({h for _, h in own}) < 2:
            continue
        vectors, chars, main = {}, {}, {}
        for at, (_, html) in enumerate(own):
            blocks, paths = html_text.read(html)
            for path, n in paths.items():
                vectors.setdefault((path, "", ""), {})[at] = n
                inside = sum(len(b.text) for b in blocks if not b.out and (b.path + "/").startswith(path + "/"))
                chars[path, "", ""] = chars.get((path, "", ""), 0) + inside
                main[path, "", ""] = path.rpartition("/")[2].startswith(html_text.MAIN)
            for b in blocks:
                if not b.main:
                    key = ("", b.path, b.text)
                    vectors.setdefault(key, {}).setdefault(at, 0)
                    vectors[key][at] += 1
                    chars[key] = chars.get(key, 0) + (0 if b.out else len(b.text))
        classes = {}
        for key, v in vectors.items():
            if len({own[at][1] for at in v}) > 1 and len(v) >= len(own) * html_text.LEAST_SHARE:
                classes.setdefault(tuple(sorted(v.items())), []).append(key)
        valid = [(k, v) for v, ks in classes.items() if len(ks) >= html_text.LEAST_TOKENS for k in ks]
        constants = {k for k, _ in valid if k[1]}
        left = {}
        for k, v in valid:
            if k[0] and all(n == 1 for _, n in v):
                left[k[0]] = chars[k] - sum(chars[c] for c in constants if (c[1] + "/").startswith(k[0] + "/"))
        most = max(left.values(), default=0)
        best = [(main[p, "", ""], p.count("/") + 1, n, p) for p, n in left.items() if n > most * html_text.SLOT_SHARE]
        varied = {k[1] for k in vectors if k[1] and k not in constants}
        many = len({html_text._copies(html_text.read(html)[0], html) for _, html in own}) >= html_text.LEAST_CONTENTS
        fixed = {c for c in constants if c[1] not in varied or (many and len(vectors[c]) == len(own))}
        out[name] = (max(best)[3] if best else None, *({html_text._digest(c[1], c[2]) for c in cs} for cs in (constants, fixed)), fixed, constants)
    return out


def slow_text(html, slot, fixed, constants):
    """The text that follows from a template, block by block."""
    blocks, paths = html_text.read(html)
    shown = [b for b in blocks if not b.out]
    inside = [b for b in shown if slot and slot in paths and (b.path + "/").startswith(slot + "/")]
    if inside:
        own = [b.text for b in inside if b.main or ("", b.path, b.text) not in fixed]
        whole = [b.text for b in inside]
        return "\n\n".join(own if len("".join(own)) * 2 > len("".join(whole)) else whole)
    shown = [b for b in shown if b.main == max(x.main for x in shown)]
    return "\n\n".join([b.text for b in shown if ("", b.path, b.text) not in constants] or [b.text for b in shown])


def test_templates_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for h in range(12):
        wide, parts = rng.choice(["div", "main", "article", "section"]), [f"<div class=k{k}>constant {h} {k}</div>" for k in range(rng.randrange(4))]
        for i in range(rng.choice([1, 2, 3, 7])):
            own = "".join(f"<p>{' '.join(rng.choice('abcdefg') * 4 for _ in range(rng.randrange(1, 12)))}</p>" for _ in range(rng.randrange(6)))
            html = f"<body>{''.join(p for p in parts if rng.random() < 0.9)}<{wide} id=c>{own}</{wide}><ul>{'<li>item' * rng.randrange(3)}</ul></body>"
            rows += [(len(rows), f"http://h{h}/", html)] * rng.choice([1, 1, 1, 2])
    own = pages(spark, [(*r, None, None, None) for r in rows]).select("page_id", "html", html_text.host(html_text.F.col("url")).alias("host"))
    got = {r.host: (r.slot, set(r.constants), set(r.fixed)) for r in html_text.templates(own).collect()}
    slow = slow_templates(rows)
    assert got == {k: v[:3] for k, v in slow.items() if v[0] or v[1]} and len(got) > 5
    texts = sorted((r.page_id, r.text) for r in html_text.extract(pages(spark, [(*r, None, None, None) for r in rows])).collect())
    none = (None, set(), set(), set(), set())
    assert texts == sorted((p, slow_text(html, slow.get(url.split("/")[2], none)[0], *slow.get(url.split("/")[2], none)[3:])) for p, url, html in rows)


STORY = [f"Paragraph {i} of a story that is long enough to be told apart from the parts that all pages of a host have in common, and ends here." for i in range(6)]


def story(title, paragraphs, user):
    return f"<html><body><div id=top>Our company since 1900</div><div class=story><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class=by>Posted by {user}</div></div><div id=low>Call us</div></body></html>"


def test_near_copies_keep_their_article(spark):
    """A pair of near copies, three of six pages, and one shared paragraph: every paragraph stays."""
    others = [[f"{p} Told again for the {k}th time." for p in STORY] for k in range(6)]
    rows = [(i, "http://pair.example/", story(f"Title {i}", STORY, f"user 3{i}"), None, None, None) for i in range(2)]
    rows += [(10 + i, "http://six.example/", story(f"Title {i}", STORY if i < 3 else others[i], f"user {i}"), None, None, None) for i in range(6)]
    rows += [(20 + i, "http://one.example/", story(f"Title {i}", [*others[i], STORY[0]], f"user {i}"), None, None, None) for i in range(2)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    for page, own in [(0, STORY), (1, STORY), *((10 + i, STORY if i < 3 else others[i]) for i in range(6)), *((20 + i, [*others[i], STORY[0]]) for i in range(2))]:
        assert "\n\n".join(own) in got[page], got[page]
    assert all("Call us" not in got[10 + i] for i in range(6))


@pytest.mark.parametrize("tag", ["b", "div", "p class=x><i", "li", "h1", "option"])
def test_deep_markup(tag):
    """30,000 open tags, and as many closing ones that close nothing: text whole, in seconds and bounded memory."""
    import time
    import tracemalloc

    began = time.time()
    tracemalloc.start()
    html = f"<body><div id=c>begin {f'<{tag}>w ' * 30_000}end{'</u>' * 30_000}</div>"
    blocks, paths = html_text.read(html)
    html_text._inside(blocks)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    text = html_text.main_text(html)
    assert time.time() - began < 30 and (tag == "option" or text.split() == ["begin", *["w"] * 30_000, "end"])
    assert max(map(len, paths)) < 8 << 10
