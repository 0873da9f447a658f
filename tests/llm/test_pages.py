"""Text inside elements that are no markup of their own, repeated rows and the empty table."""
from rankspark.llm import html

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
ARTICLE = ("<html><body><nav><a href=x>menu</a><a href=y>more</a></nav><article><h1>Areas of things</h1><p>The area is "
           "<math><mi>x</mi><mo>=</mo><mn>2</mn></math> as shown in the figure, and more words make up a paragraph.</p>"
           "<p>A second one holds <object data=z>what stands in for a drawing</object> and goes on for a while.</p></article></body></html>")


def test_formulas_and_fallbacks_are_text(spark):
    want = ("Areas of things\nThe area is x=2 as shown in the figure, and more words make up a paragraph.\n"
            "A second one holds what stands in for a drawing and goes on for a while.")
    rows = [(1, "u", ARTICLE, "t", "n"), (1, "u", ARTICLE, "t", "n"), (None, None, ARTICLE.replace("</object>", ""), "t", "n")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = html.main_text(df).collect()
    assert [r.text for r in got if r.page_id == 1] == [want, want] and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id is None] == [want]  # an open object hides nothing
    assert html.main_text(df.limit(0)).collect() == []
