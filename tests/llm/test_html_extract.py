from tabwright.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A {k}</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies {k}</div><aside>side {k}</aside>{open}
<h1>Title&nbsp;{k} &amp; more</h1><p>First <b>bold</b>ly   said
{k}.<p>Second &lt;tag&gt; {k}<div class="ad-box">buy {k}</div><p class="note">Share this</p><ul><li>one {k}<li>two {k}</ul><form>mail <input></form>
{close}<section id="comments"><p>I like {k}</p></section><footer>&copy; {k}</footer></body></html>"""


def expected(k, share):
    return "\n".join([f"Title {k} & more", f"First boldly said {k}.", f"Second <tag> {k}", *(["Share this"] if share else []), f"one {k}", f"two {k}"])


def make(k, tag="article"):
    return PAGE.format(k=k, open=f"<{tag}>", close=f"</{tag.split()[0]}>")


def wrapper(pages):
    w = None
    for p in pages:
        s = H.shape(H.parse(p), hash(p))
        w = s if w is None else H.merge(w, s)
    return w


def test_article_without_its_surroundings():
    pages = [make(k) for k in range(3)]
    where = H.region(wrapper(pages), 5)
    assert [H.main_text(p, where) for p in pages] == [expected(k, True) for k in range(3)]


def test_template_text_goes_once_enough_pages_agree():
    pages = [make(k) for k in range(6)]
    where = H.region(wrapper(pages), 5)
    assert H.main_text(pages[2], where) == expected(2, False)


def test_without_an_article_element_the_textual_region_is_found():
    long = " ".join(["word"] * 80)
    pages = [f"<html><body><div><ul><li><a href=/x>menu {k}</a></ul></div><div class=page><div class=story><p>{long} {k}</p><p>{long}</p></div></div></body></html>"
             for k in range(6)]
    where = H.region(wrapper(pages), 5)
    assert where["at"] == ["//html/body/div.page/div.story"]
    assert H.main_text(pages[1], where) == f"{long} 1\n{long}"


def test_repeats_fold_and_optional_elements_are_marked():
    w = wrapper(["<body><p>a</p><p>b</p><h2>c</h2></body>", "<body><p>a</p></body>"])
    body = w["i"][0]
    assert [(x["k"], x["r"], x["o"]) for x in body["i"]] == [("p", 1, 0), ("h2", 0, 1)]


def test_merge_order_does_not_change_the_decision(rnd):
    pages = [make(k, rnd.choice(["article", "main"])) for k in range(8)]
    one = H.region(wrapper(pages), 5)
    for _ in range(5):
        rnd.shuffle(pages)
        assert H.region(wrapper(pages), 5) == one


def test_cut_and_odd_markup():
    assert H.main_text("<article><p>a &am", None) == "a &am"
    assert H.main_text("<article><p>a < b <p cla", None) == "a < b"
    assert H.main_text("<article><p>x<!-- never closed <p>y", None) == "x"
    assert H.main_text('<article><p title="a>b">t</p><script>x', None) == "t"
    assert H.main_text("just text", None) == "just text"


def test_table(spark):
    rows = [(k, f"http://h.example/{k}", make(k), 1) for k in range(4)] + [(9, None, make(9), 1), (10, "http://h.example/x", None, 1), (11, "::", "", 1), *[(3, "http://h.example/3", make(3), 1)] * 4,
                                                                          (3, "http://h.example/3", make(3), 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract_main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "" if r.page_id in (10, 11) else expected(r.page_id, True)
        assert (r.text, r.n_chars) == (want, len(want))
    assert H.extract_main_text(df.limit(0)).count() == 0
