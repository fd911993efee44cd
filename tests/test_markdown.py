from inkwell.functions.text import SOFT_HYPHEN as SHY
from inkwell.functions.text import THIN_SPACE as THIN
from inkwell.operators.hyphenation import Hyphenator, built_in_patterns
from inkwell.sources.markdown import Event, Lint, events, posts, read_posts, render, tokenize
from tests.test_text import _patterns

LINT = Lint(Hyphenator(_patterns()))


def html(text, compat=True):
    return render(tokenize(text), LINT, compat)


def note(name):
    return Event("note", text=name)


def test_inline():
    assert html("中*en*文") == f"<p>中{THIN}<em>en</em>{THIN}文</p>\n"
    assert html("中*文*") == f"<p>中{THIN}<em>文</em></p>\n"
    assert html("中*文*", compat=False) == "<p>中<em>文</em></p>\n"
    assert html("en*word*") == "<p>en<em>word</em></p>\n"
    assert html("a\n中") == "<p>a\n中</p>\n"
    assert html("中  \na") == "<p>中<br />\na</p>\n"
    assert html("中<b>a") == "<p>中<b>a</p>\n"
    assert html("中[en](u)") == f'<p>中{THIN}<a href="u" target="_blank">en</a></p>\n'
    assert html("![a\\<b](u)") == '<p><img src="u" alt="a<b" /></p>\n'
    assert html("**x** `y` &amp; \\*") == "<p><strong>x</strong> <code>y</code> &#38; *</p>\n"
    assert html("***x***") == "<p><em><strong>x</strong></em></p>\n"


def test_blocks():
    assert html("- x\n\n  y") == "<ul>\n<li>\n<p>x</p>\n<p>y</p>\n</li>\n</ul>\n"
    assert html("1. x") == "<ol>\n<li>x</li>\n</ol>\n"
    assert html("5. x\n6. y") == '<ol start="5">\n<li>x</li>\n<li>y</li>\n</ol>\n'
    assert html("> q\n\n---\n\n## t ##") == "<blockquote>\n<p>q</p>\n</blockquote>\n<hr />\n<h2>t</h2>\n"
    assert html("```rust x\nfn hyphenation\n```") == f'<pre><code lang="rust">fn hy{SHY}phen{SHY}ation\n</code></pre>\n'
    assert html("| 中 | en |\n|:---|:---:|\n| a | b |") == f'<table><thead><tr><th align="left">中</th>{THIN}<th align="center">en</th></tr></thead><tbody>\n<tr><td align="left">a</td><td align="center">b</td></tr>\n</tbody></table>\n'


def test_second_table_head_keeps_the_last_width():
    two = "| a | b |\n|:-|-:|\n| c | d |\n\n| e | f |\n|:-|-:|\n| g | h |"
    assert html(two).count('<th align="left">') == 1
    assert html(two, compat=False).count('<th align="left">') == 2


def test_notes():
    got = render(iter([Event("start", "paragraph"), note("b"), note("a"), note("b"), Event("end", "paragraph")]), LINT)
    assert [got.count(f'"#{n}"') for n in (1, 2)] == [2, 1]


BUNDLE = "dropped\n\n# 标题One\n\n    本文发表于：2018-01-01T12:45:00+08:00\n    最后修改于：2018-01-12T06:15:00+08:00　\n    分类：tech\n    分类：2\n    地址：no\n    页名：one\n\n中文*English*中文\n\n# Second\n\n    页名：about\n\n> # inside\n>\n>     页名：quoted\n"


def test_posts():
    got = list(read_posts(BUNDLE, LINT))
    assert [(p["title"], p["category"], p["pagename"], p["modified"]) for p in got] == [(f"标题{THIN}One", "tech2", "one", "2018-01-12T06:15:00+08:00"), (f"Se{SHY}cond", "", "about", ""), ("inside", "", "quoted", "")]
    assert got[0]["data"] == f"<p>中文{THIN}<em>English</em>{THIN}中文</p>\n"
    assert list(read_posts("", LINT)) == [] == list(read_posts("no heading", LINT))
    swallowed = list(read_posts("# One\n\ntext\n\n# Two\n\n    页名：x\n", LINT))
    assert [p["title"] for p in swallowed] == ["OnetextTwo"]
    assert next(read_posts("# a\n\n    地址：s\n", LINT, other_slug=True))["pagename"] == "s"


def test_spark_gives_the_same(spark):
    bundles = spark.createDataFrame([("x", BUNDLE), ("y", ""), ("z", None)], "bundle string, value string")
    got = posts(bundles, built_in_patterns(spark)).orderBy("ord").collect()
    assert [r["data"] for r in got] == [p["data"] for p in read_posts(BUNDLE, LINT)]
    assert events(bundles).where("kind = 'start' and tag = 'header'").count() == 3
