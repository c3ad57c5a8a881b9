"""Board pages: nesting, entities, malformed pages, notices; counts of stages."""

from facetrank.functions import fixed
from facetrank.sources import board

BOX = '<div class="ArticleContentBox">{}</div>'


def fields(html):
    return board.Article().finish(html).fields()


def test_nested_boxes_and_texts():
    got = fields('<div class="x"><div class="a ArticleContentBox b"><h3 class="title_text">\n A <b>b</b>&amp;&#x41;&#66;&hellip; </h3>'
                 '<div class="se-main-container"><div><div>one</div><p>two<br>three</div>four<img src="x">&nbsp;five</div>'
                 '<span class="date">2026.01.05.</span><h3 class="title_text">second</h3></div>'
                 '<button class="nickname">outside</button><div class="se-main-container">late</div></div>')
    assert got == {"title": "A b&AB…", "date": "2026.01.05.", "content": "one two three four \xa0five", "author": fixed.DEFAULT_AUTHOR}


def test_defaults_and_pages_without_a_box():
    assert fields("<p>nothing</p>") is None and fields("") is None
    assert fields(BOX.format("")) == board.DEFAULTS
    assert fields(BOX.format('<div class="se-main-container"> <img> \n</div><span class="date"></span>')) == board.DEFAULTS
    assert fields(BOX.format('<div class="se-main-container"><script>x="</div>"</script><style>p{}</style><!-- c -->t</div>'))["content"] == "t"


def test_malformed_pages():
    assert fields('<div class="ArticleContentBox"><div class="se-main-container"><p>open <b>for ever')["content"] == "open for ever"
    assert fields(BOX.format('</span></p><h3 class="title_text">a</i> b</h3>'))["title"] == "a b"
    assert fields(BOX.format('<H3 CLASS="title_text">Up</H3>&bogus; &#0;'))["title"] == "Up"
    assert fields('<div class="ArticleContentBox"/><h3 class="title_text">no</h3>')["title"] == fixed.DEFAULT_TITLE
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert fields(BOX.format(f'<div class="se-main-container">{deep}</div>'))["content"] == "x"


def test_listing_rows_and_notices(spark):
    row = '<tr><td class="td_article">{}<a class="article" href="{}">t</a></td></tr>'
    num = '<div class="board-number"><div class="inner_number"> {} </div></div>'
    html = ('<div class="article-board m"><table><tbody>' + row.format(num.format(12), "/ArticleRead?a=1&amp;b=2") + row.format("<em>notice</em>", "/n")
            + row.format(num.format(13), "https://elsewhere/1") + "<tr><td class='td_article'>" + num.format(14) + "</td></tr>"
            + '<tr><td class="td_name"><i class="inner_number">9</i><a class="article" href="/x"></a></td></tr></tbody></table></div>'
            + "<table>" + row.format(num.format(99), "/outside") + "</table>")
    assert board.Listing().finish(html).rows == [("12", "/ArticleRead?a=1&b=2"), ("13", "https://elsewhere/1")]
    pages = spark.createDataFrame([(1, html, 5), (2, None, 5), (3, "", 5)], "page_id long, html string, pos int")
    got = [(r.page_id, r.pos, r.number, r.url) for r in board.board_rows(pages).orderBy("pos").collect()]
    assert got == [(1, 0, "12", fixed.LINK_BASE + "/ArticleRead?a=1&b=2"), (1, 1, "13", "https://elsewhere/1")]
    made = spark.createDataFrame([(1, BOX.format('<h3 class="title_text">t</h3>')), (2, None), (3, "<p>")], "page_id long, html string")
    assert [(r.page_id, r.title, r.author) for r in board.board_articles(made).collect()] == [(1, "t", fixed.DEFAULT_AUTHOR)]
    assert board.board_articles(made.filter("false")).count() == 0


def test_stage_report(spark):
    from facetrank.plans import observed
    from facetrank.plans import two_stage as ts
    chunks = spark.createDataFrame([(0, 1, "v1", "x", "red wine cellar"), (1, 2, "v2", "x", "red garden hall")],
                                   "doc_id long, venue_id long, hall_name string, aspect string, text string")
    cv = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "x", [0.0, 1.0])], "doc_id long, aspect string, vector array<double>")
    q = spark.createDataFrame([(0, "red garden hall"), (1, "zzz")], "query_id long, query string")
    qv = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "query_id long, vector array<double>")
    inp = ts.Inputs(chunks, cv, q, qv, spark.createDataFrame([(1, "v1"), (2, "v2")], "venue_id long, hall_name string"), ["x"])
    got = observed.run(inp)
    rows = got.report.orderBy("position").collect()
    assert [(r.stage, r.n_rows) for r in rows] == [("intent", 1), ("candidates", 2), ("reranked", 2), ("venues", 2), ("top", 2)]
    assert all(r.seconds > 0 for r in rows) and got.stages.top.count() == 2
