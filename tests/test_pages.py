"""Page extraction on literal pages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import pages as P
from digestmill.functions import markup as M
from digestmill.operators import pages as O
from plain_markup import Element, named, parse


def pages(spark, *markups):
    return spark.createDataFrame([(i, f"https://e.com/{i}", markup) for i, markup in enumerate(markups)], "page_id BIGINT, url STRING, html STRING")


def article(spark, markup):
    return O.extract_pages_article(pages(spark, markup)).collect()[0]


LONG = "This paragraph has well over twenty characters."


def test_article_selection(spark):
    row = article(
        spark,
        f"<html><head><title>Site</title><script>var a='</p><h1>no</h1>';</script></head><body><header><h1>Logo</h1></header><nav><p>{LONG} nav</p></nav>"
        f"<div class='x-cookie-bar'><p>{LONG} cookie</p></div><article><h1>Real &amp; title</h1><p>{LONG} one</p><p>short</p><ul><li>{LONG} item</li></ul></article>"
        f"<div id='comments'><p>{LONG} comment</p></div><footer><p>{LONG} foot</p></footer></body></html>",
    )
    assert row["title"] == "Real & title"
    assert row["text"] == f"{LONG} one\n\n{LONG} item"


def test_article_prefers_longer_candidate_and_unclosed_tags(spark):
    row = article(spark, f"<body><article><p>{LONG}</article><main><p>{LONG} a<p>{LONG} b</main></body>")
    # Unclosed paragraphs nest, so the outer one repeats the inner text; the body holds the most.
    assert row["text"] == f"{LONG}\n\n{LONG} a {LONG} b\n\n{LONG} b"


def test_json_ld_body_and_fields(spark):
    body = "sentence of the article. " * 8
    row = article(
        spark,
        '<head><script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":"BlogPosting","headline":"LD","author":[{"name":"A &amp; B"}],"datePublished":"2024-02-03","articleBody":"'
        + body + f'"}}]}}</script></head><body><h1>H</h1><article><p>{LONG}</p></article></body>',
    )
    assert (row["title"], row["author"], row["published_at"], row["json_ld_type"]) == ("LD", "A & B", "2024-02-03", "BlogPosting")
    assert row["text"] == body.strip()


def test_body_text_is_last_resort(spark):
    assert article(spark, "<body><div>only a div</div><svg>drop</svg></body>")["text"] == "only a div"


def test_meta_precedence(spark):
    markup = (
        '<head><meta content="Og" property="og:title"><meta name="twitter:title" content="Tw"><title>Ti</title>'
        "<meta name='author' content='Au'><meta property='article:published_time' content='2024'></head><body></body>"
    )
    row = O.page_metadata(pages(spark, markup)).collect()[0]
    assert (row["title"], row["author"], row["published_at"]) == ("Og", "Au", "2024")


def test_wechat_dom(spark):
    filler = "第一段内容" + "很长的正文" * 20
    markup = f'<h1 id="activity-name"> 测试标题 </h1><a id="js_name">测试公众号</a><em id="publish_time">2026年06月28日</em><div id="js_content"><p>{filler}</p><img src="x"><script>no</script></div>'
    row = O.extract_wechat(pages(spark, markup)).collect()[0]
    assert (row["title"], row["author"], row["published_at"]) == ("测试标题", "测试公众号", "2026年06月28日")
    assert "第一段内容" in row["text"] and "[图片]" in row["text"] and "no" not in row["text"]


def test_wechat_description_fallback(spark):
    markup = '<meta property="og:description" content="第一行\\x0a第二行 &lt;a href=x&gt;链接&lt;/a&gt;"><script>var nickname = "作者"; var ct = "1782633600"; var msg_title = \'T\';</script>'
    row = O.extract_wechat(pages(spark, markup)).collect()[0]
    assert (row["title"], row["author"], row["published_at"]) == ("T", "作者", "2026-06-28T08:00:00+00:00")
    assert row["text"].startswith("第一行\n第二行") and "<a" not in row["text"]


def test_wechat_images_and_block_pages(spark):
    markup = (
        '<img class="a" data-src="https://mmbiz.example/a.jpg"><img src="https://mmbiz.example/a.jpg"><img src="data:x">'
        "<script>var cdn_url_1_1 = 'https://mmbiz.example/b.jpg'; msg_cdn_url = \"https://mmbiz.example/a.jpg\";</script>"
    )
    assert [r["image_url"] for r in O.page_images(pages(spark, markup)).orderBy("seq").collect()] == ["https://mmbiz.example/a.jpg", "https://mmbiz.example/b.jpg"]
    blocked = O.extract_wechat(pages(spark, *[f"<p>{marker}</p>" for marker, _ in K.BLOCKED_PAGE_MARKERS])).orderBy("page_id").collect()
    assert [row["error_message"] for row in blocked] == [message for _, message in K.BLOCKED_PAGE_MARKERS]
    assert {row["error_code"] for row in blocked} == {"wechat_blocked"}


def test_invalid_url_never_takes_the_fallback(spark):
    extracts = spark.createDataFrame([("a", None, None, "invalid_url"), ("b", "t", "short", None), ("c", None, None, "extraction_failed")], "url STRING, title STRING, text STRING, error_code STRING")
    fallback = spark.createDataFrame([(u, "F", "x" * 90) for u in "abc"], "url STRING, title STRING, text STRING")
    rows = {row["url"]: row for row in O.usable_extracts(extracts, fallback).collect()}
    assert rows["a"]["error_code"] == "invalid_url" and rows["b"]["from_fallback"] and rows["c"]["title"] == "F"


def test_reader_reply(spark, one):
    row = one(P.reader_text(F.lit("Title: The &amp; title\nURL: x\n\n" + "word " * 30)))
    assert row["title"] == "The & title" and row["text"].startswith("URL: x\n\nword")
    assert one(P.reader_text(F.lit("Title: x"))) is None


def test_compact_metadata_keeps_values(spark, one):
    import json

    data = {"id": "1", "duration": 12, "secret": "s", "subtitles": {"en": [{"ext": "vtt"}]}, "tags": ["a"]}
    kept = json.loads(one(P.compact_metadata(F.lit(json.dumps(data)))))
    assert kept == {key: value for key, value in data.items() if key != "secret"}


# ---- the tag-stream machine against a tree ---------------------------------------------------

NOISE = named("script", "style", "noscript", "svg", "canvas", "form", "nav", "footer", "aside", "header")
CANDIDATES = (
    named("article"), named("main"), lambda n: n.attrs.get("role") == "main", lambda n: n.has_class("article"), lambda n: n.has_class("post"),
    lambda n: n.has_class("content"), named("body"),
)


def noisy(node: Element) -> bool:
    words, ident = node.attrs.get("class", ""), node.attrs.get("id", "")
    return NOISE(node) or any(word in words for word in ("cookie", "subscribe", "newsletter", "advert")) or any(word in ident for word in ("cookie", "comment"))


def tree_article(markup: str) -> tuple[str, str, str]:
    root = parse(markup)
    root.drop(noisy)
    heading, body = root.first(named("h1")), root.first(named("body"))
    best = ""
    for test in CANDIDATES:
        node = root.first(test)
        blocks = [" ".join(item.text(" ").split()) for item in node.walk() if item.tag in ("h1", "h2", "h3", "p", "li", "blockquote")] if node else []
        text = "\n\n".join(block for block in blocks if len(block) >= 20)
        best = text if len(text) > len(best) else best
    return (heading.text(" ") if heading else "", body.text("\n") if body else "", best)


def tree_wechat(markup: str) -> tuple[list[str], list[str]]:
    root = parse(markup)
    root.drop(named("script", "style"))  # never part of what is shown
    tests = [lambda n, i=ident: n.attrs.get("id") == i for ident in ("activity-name", "js_name", "publish_time")]
    tests += [lambda n: n.tag == "h1" and n.has_class("rich_media_title"), lambda n: n.has_class("profile_nickname")]
    fields = [node.text(" ") if node else "" for node in map(root.first, tests)]
    bodies = []
    for test in (lambda n: n.attrs.get("id") == "js_content", lambda n: n.has_class("rich_media_content"), named("article")):
        node = parse(markup).first(test)
        if node:
            node.drop(named("script", "style", "svg", "canvas", "form"))
            for image in [item for item in node.walk() if item.tag == "img"]:
                siblings = image.parent.children
                siblings[siblings.index(image)] = "[图片]"
            bodies.append(node.text("\n"))
    return fields, bodies


def broken_pages(count: int) -> list[str]:
    """Pages with unclosed, crossed, empty and unknown tags, odd attributes, entities, comments and stray signs."""
    draw = random.Random(21)
    names = ["p", "div", "article", "main", "body", "h1", "h2", "li", "ul", "b", "section", "nav", "form", "svg", "blockquote", "footer", "h1"]
    attributes = [
        "", "", "", ' class="post wide"', " class='x article'", ' role="main"', ' id=js_content', ' class="cookie-bar"', ' id="comments"', " class=content", ' title="a > b" class="post"',
        ' id="activity-name"', ' id="js_name"', ' class="profile_nickname"', ' class="rich_media_title"', ' data-class="post"', ' title="class=post"', " hidden class = 'rich_media_content'", ' id="publish_time"', ' id="a&amp;b"',
    ]
    words = ["words of a block long enough to count", "short", "a &amp; b &lt;tag&gt;", " ", "\n", "1 < 2", "x &copy y", "&#20013;文", "two\nlines of it", "&nbsp;", "q\u00a0"]
    extras = ["<br>", "<img src='a>b.png'>", "<hr/>", "<!-- <p>no</p> -->", "<script>var a='</p><h1>';</script>", "<style>p > b {}</style>", "</nope>", "<div/>", "<IMG alt=x>", "<input>"]
    out = []
    for _ in range(count):
        open_, page = [], []
        for _ in range(draw.randrange(2, 45)):
            kind = draw.random()
            if kind < 0.35:
                name = draw.choice(names)
                open_.append(name)
                page.append(f"<{name.upper() if draw.random() < 0.1 else name}{draw.choice(attributes)}>")
            elif kind < 0.6 and open_:
                page.append(f"</{open_.pop(draw.randrange(len(open_)) if draw.random() < 0.3 else -1)}>")
            else:
                page.append(draw.choice(words if kind < 0.9 else extras))
        out.append("".join(page))
    return out


def test_machine_equals_the_tree(spark):
    given = [row["html"] for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    markups = given + broken_pages(400) + ["", "no tags", "<p", "a < b <", "<p>" * 300 + "deep", "</p></div>"]
    frame = pages(spark, *markups).select("page_id", O.article_fields(F.col("html")).alias("a"), O.wechat_fields(F.col("html")).alias("w"))
    for row in frame.collect():
        markup = markups[row["page_id"]]
        assert (row["a"]["h1"], row["a"]["body_text"], row["a"]["best"]) == tree_article(markup), markup
        fields = [row["w"][name] for name in ("activity_name", "js_name", "publish_time", "rich_title", "nickname")]
        assert (fields, row["w"]["bodies"]) == tree_wechat(markup), markup


def test_first_attribute_of_a_name_counts(spark, one):
    for tag, value in (('<p class="a" class="b">', "a"), ("<p title='class=x' class=y>", "y"), ("<p data-class=z>", ""), ("<p CLASS = ' q '>", " q "), ("<p class>", ""), ('<p/class="s">', "s")):
        assert one(M.attributes(F.lit(tag), "id", "class")[1]) == value, tag


def test_no_python_on_the_way(spark):
    for operator in (O.extract_pages_article, O.extract_wechat):
        plan = operator(pages(spark, "<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


def test_pages_of_one_address_stay_one_row_each(spark):
    extracts = spark.createDataFrame([(1, "a", "t", "short", None), (2, "a", "t", "z" * 90, None)], "page_id BIGINT, url STRING, title STRING, text STRING, error_code STRING")
    fallback = spark.createDataFrame([(1, "a", "F", "x" * 90), (2, "a", "G", "y" * 95)], "page_id BIGINT, url STRING, title STRING, text STRING")
    assert sorted(row["title"] for row in O.usable_extracts(extracts, fallback).collect()) == ["G", "t"]
    assert sorted(row["title"] for row in O.usable_extracts(extracts, fallback, "page_id").collect()) == ["F", "t"]
