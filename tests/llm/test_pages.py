from depquarry.llm import chat, sitetree

SCHEMA = "page_id long, url string, html string"


def text_of(html):
    return "\n".join(t for _, t, a in sitetree.Page(html).blocks)


def extract(spark, rows):
    return {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_article_without_its_surroundings(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav><!-- <p>no</p> -->"
        "<div class='cookie-notice'>Cookies</div><div class=ad>Buy</div><article class='post'><h1>A &amp; B</h1><p><b>Bold\n  text<br>more<p>Open &lt;p&gt; x<ul><li>one<li>two</ul>"
        "<form><input>Name</form><div class='share-buttons'>Share</div><p>End &copy;</p></article><aside>Side</aside><section id='comments'><article><p>First!</p></article></section><footer>Foot</footer>"
    )
    assert extract(spark, [(1, "http://h/1", page)])[1] == "A & B\nBold text more\nOpen <p> x\none\ntwo\nEnd ©"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://[", "plain & simple"), (4, "u", "<p"), (5, "u", "a < b <i>c</i>d</p></x>"), (6, "u", "<script>never closed <p>x"), (7, "u", "<body><header>H</header><div>Body</div></body>")]
    got = extract(spark, rows)
    assert (got[1], got[2], got[3], got[6], got[7]) == ("", "", "plain & simple", "", "Body")
    assert got[5] == "a < b cd"
    assert sitetree.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_branches_that_repeat_over_a_host_go_and_copies_stay(spark):
    body = "<html><body><div class='top9'>Same line everywhere</div><div class='c'><p>Text {0} of its own {0}</p></div></body></html>"
    rows = [(i, f"http://h/{i}", body.format(i)) for i in range(30)]
    assert extract(spark, rows)[7] == "Text 7 of its own 7"
    same = "<html><body><article><h1>Title</h1><p>An article in thirty copies</p></article></body></html>"
    assert extract(spark, [(i, f"http://g/{i}", same) for i in range(30)])[3] == "Title\nAn article in thirty copies"


def test_blocks_of_the_site_inside_articles_go(spark):
    """Against brute force: the share of the host's other pages, copies once, with PRIOR pages beside."""
    rows, page = [], "<article><h1>Title {0}</h1><p>Some long text of page {0} that no other page has.</p>{1}</article>"
    for n, host in ((3, "few"), (12, "many")):
        for i in range(n):
            extra = "<p>Subscribe to our news!</p>" + ("<p>A line on some pages.</p>" if i % 3 == 0 else "")
            rows.append((len(rows), f"http://{host}/{i}", page.format(f"{host}{i}", extra)))
    rows += [(100 + i, "http://copies/x", page.format("same", "<p>Subscribe to our news!</p>")) for i in range(30)]
    got = extract(spark, rows)
    for i, url, html in rows:
        own = [t for _, t, _ in sitetree.Page(html).blocks]
        others = {tuple(t for _, t, _ in sitetree.Page(h).blocks) for j, u, h in rows if u.split("/")[2] == url.split("/")[2]} - {tuple(own)}
        want = [t for t in own if sum(t in o for o in others) / (len(others) + sitetree.PRIOR) < sitetree.MOST_PAGES]
        assert got[i] == "\n".join(want), url
    assert "Subscribe" not in got[5] and "Subscribe" in got[0] and "Subscribe" in got[100] and "some pages" in got[3]


def test_formulas_stay_and_references_end_with_their_text(spark):
    html = "<article><p>x <math><mi>y</mi></math> z</p><p>A &am<b>p;</b> B &<i>lt;</i> &lt;<button>Go</button></p><video>No video</video></article>"
    assert text_of(html) == "x y z\nA &amp; B &lt; <\nNo video"
    long = "<article><p>" + "word " * 300_000 + "</p></article>"
    rows = spark.createDataFrame([(1, "u", long, "x"), (1, "u", long, "x"), (None, None, "<p>a", None)], SCHEMA + ", text string").withColumnRenamed("text", "host")
    assert sorted((r["n_chars"], r["page_id"] or 0) for r in sitetree.extract(rows).collect()) == [(1, 0), (1_499_999, 1), (1_499_999, 1)]


def test_wrappers_named_by_what_stands_beside_stay():
    body = "<h1>Title</h1><p>The text of the page, which is its longest part by far.</p>"
    want = "Title\nThe text of the page, which is its longest part by far."
    for name in ("content has-sidebar", "content-with-sidebar", "container nav-open", "page no-banner", "entry hidden-print", "page-with-comments", "main-sidebar", "sidebar"):
        assert text_of(f"<body><div class='{name}'><article>{body}</article></div><div class='ad'>Buy</div></body>") == want, name
        assert text_of(f"<body><div class='{name}'>{body}</div><div class='ad'>Buy</div></body>") == want, name
    assert text_of(f"<body><div class='content-sidebar'><article>{body}</article><div id='comments'><article><p>First!</p></article></div></div></body>") == want
    assert text_of(f"<article>{body}<div class='comments'>{'<p>A long comment.</p>' * 30}</div></article>") == want
    assert text_of(f"<article>{body}<p>a <span class='share'>Share</span>b</p><div class='cookie-notice'>c</div><div class='ad-slot-1'>d</div></article>") == want + "\na b"


CONV = "conv_id long, turn long, role string, text string"


def test_chat_formats_are_reversible(spark):
    odd = ["\\### Assistant: </turn> ok", "<turn>user\nx</turn>\n", "\\b\\l\\n\\\\l<", "", None, "é😀\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "a<s\\s\nistant"], odd))]
    rows += [(2, 0, "user", "only a question"), (3, None, "assistant", "x"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (None, 0, None, "who")]
    ex = chat.format_chats(spark.createDataFrame([(*r, 1) for r in rows], CONV + ", marked int"))
    got = {}
    for r in ex.select("*", chat.read_turns(ex["text"]).alias("turns"), chat.loss_text(ex["text"], ex["loss_start"], ex["loss_end"]).alias("loss")).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for conv, examples in got.items():
        want = [(r or "", t or "") for c, n, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))]
        examples.sort(key=lambda r: r["example"])
        assert [tuple(t) for t in examples[-1]["turns"]] == want
        assert [r["loss"] for r in examples if r["loss_start"] is not None] == [t for r, t in want if r == "assistant"]
        assert all(len(r["turns"]) == r["n_turns"] for r in examples)
    assert chat.format_chats(spark.createDataFrame([], CONV)).count() == 0
    assert {r["conv_id"]: r["n_turns"] for r in chat.digest(ex).collect()} == {1: 6, 2: 1, 3: 3, None: 1}
