"""A site as one table (path, content), from posts (ord, title, released, modified, category, pagename, data).

Every order is spelt out: posts by ``ord``, ties in the feed by the smaller ``ord``. Missing values are empty strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import date_part, path_join, size_label

PAGE = 7
FEED = 3


@dataclass(frozen=True)
class Identity:
    """What the pages say of the site."""

    title: str = "A site"
    tagline: str = "Words, set with care"
    author: str = "The author"
    host: str = "https://example.org"
    years: str = "2024"
    licence: str = "CC BY-NC-SA 4.0"
    licence_url: str = "https://creativecommons.org/licenses/by-nc-sa/4.0/"
    root: str = "public"


#: Pages whose running maximum one task takes.
BLOCK = 4096
#: Pages whose text one row takes before the texts are joined.
CHUNK = 512


def categorised(posts: DataFrame) -> DataFrame:
    return posts.where("category <> ''")


def numbered(posts: DataFrame) -> DataFrame:
    """Posts with ``rn`` (0, 1, ...) and ``page`` by ord.

    Ranges of ord with about equal numbers of posts number their own, and one small row a range carries how many stand before it,
    so no task sorts all posts. The ranges are found once, so they are the same in every evaluation.
    """
    parts = 4 * int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(posts.approxQuantile("ord", [k / parts for k in range(1, parts)], 0.1 / parts)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("ord"))) if bounds else F.lit(0)
    ranged = posts.withColumn("__part", part)
    base = ranged.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rn = F.row_number().over(Window.partitionBy("__part").orderBy("ord")) - 1 + F.col("__base")
    return ranged.join(F.broadcast(base), "__part").withColumn("rn", rn.cast("long")).withColumn("page", F.expr(f"rn div {PAGE} + 1")).drop("__part", "__base")


def page_spine(posts: DataFrame) -> DataFrame:
    """(page, posts): size div 7 + 1 pages, so the last one may be empty."""
    return posts.agg(F.count("*").alias("size")).select("size", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"size div {PAGE} + 1"))).alias("page"))


def page_nav(posts: DataFrame) -> DataFrame:
    """(page, next_url, prev_url); empty where there is none."""
    p = F.col("page")
    return page_spine(categorised(posts)).select(
        "page",
        F.when(p * PAGE < F.col("size"), F.concat(F.lit("/page/"), p + 1, F.lit("/"))).otherwise("").alias("next_url"),
        F.when(p == 2, "/").when(p > 2, F.concat(F.lit("/page/"), p - 1, F.lit("/"))).otherwise("").alias("prev_url"),
    )


def newest(posts: DataFrame, n: int = FEED) -> DataFrame:
    return posts.orderBy(F.desc("modified"), "ord").limit(n)


def sitemap_pages(posts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(page, lastmod): pages of all posts, with the largest modified so far. of: the posts, if they are numbered already.

    The running maximum is taken within blocks of pages; only one row a block goes through a single task.
    """
    by_page = (numbered(posts) if of is None else of).groupBy("page").agg(F.max("modified").alias("m"))
    pages = page_spine(posts).join(by_page, "page", "left").select("page", "m", F.expr(f"page div {BLOCK}").alias("block"))
    before = pages.groupBy("block").agg(F.max("m").alias("most")).select("block", F.max("most").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    so_far = F.max("m").over(Window.partitionBy("block").orderBy("page"))
    return pages.withColumn("m", so_far).join(before, "block").select("page", F.coalesce(F.greatest("m", "before"), F.lit("")).alias("lastmod"))


def sitemap_posts(posts: DataFrame, me: Identity = Identity(), *more: str) -> DataFrame:
    has = F.col("category") != ""
    loc = F.when(has, F.concat(F.lit(me.host + "/"), "category", F.lit("/"), "pagename", F.lit("/"))).otherwise(F.concat(F.lit(me.host + "/"), "pagename", F.lit("/")))
    return posts.select("ord", loc.alias("loc"), F.col("modified").alias("lastmod"), F.when(has, "0.8").otherwise("0.5").alias("priority"), *more)


def _top(me: Identity, title: Column) -> Column:
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="cmn-Hans">\n<head>\n<meta charset="UTF-8">\n<title>'), title,
        F.lit(f'</title>\n<meta name="author" content="{me.author}">\n<meta name="viewport" content="width=device-width,initial-scale=1">\n<link rel="stylesheet" type="text/css" href="/style.css">\n<link rel="icon" type="image/png" href="/favicon.png">\n<link rel="alternate" type="application/atom+xml" title="Atom" href="/atom.xml">\n</head>\n<body>\n<header>\n<a href="/"><h1>{me.title}</h1><h2>{me.tagline}</h2></a>\n</header>\n<article>\n'),
    )


def _bottom(me: Identity) -> Column:
    return F.lit(f'</article>\n<footer>\n<p>&copy;&nbsp;{me.years}&nbsp;<a href="/about/">{me.author}</a></p>\n<p><a href="{me.licence_url}">{me.licence}</a></p>\n</footer>\n</body>\n</html>\n')


def _time(stamp: str) -> Column:
    return F.concat(F.lit('<time datetime="'), stamp, F.lit('">'), date_part(F.col(stamp)), F.lit("</time>"))


def section() -> Column:
    return F.concat(F.lit('<section>\n<a href="/'), "category", F.lit("/"), "pagename", F.lit('/"><h1>'), "title", F.lit("</h1>"), _time("released"), F.lit("</a>\n</section>\n"))


def _listed(column: str, by: str) -> Column:
    return F.expr(f"coalesce(listagg({column}, '') within group (order by {by}), '')")


def post_pages(posts: DataFrame, me: Identity = Identity()) -> DataFrame:
    link = F.when(F.col("category") != "", F.concat(F.lit('分类：<a href="/'), "category", F.lit('/">'), "category", F.lit("</a>\n"))).otherwise("")
    content = F.concat(
        _top(me, F.col("title")), F.lit("<h1>"), "title", F.lit("</h1>\n<pre><code>本文发表于："), _time("released"), F.lit("\n最后修改于："), _time("modified"), F.lit("\n"),
        link, F.lit("合计信息量："), size_label(F.length("data")), F.lit("kb</code></pre>\n"), "data", _bottom(me),
    )
    return posts.select(path_join(F.lit(me.root), F.col("category"), F.col("pagename"), F.lit("index.html")).alias("path"), content.alias("content"))


def category_chunks(posts: DataFrame, me: Identity = Identity()) -> DataFrame:
    """(category, part, chunk, x): the text of categories' pages by parts (head, posts, foot), at most CHUNK pages of posts a row."""
    has, parts = categorised(posts), int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = [(0, F.concat(_top(me, F.lit(me.title)), F.lit("<nav>分类 - "), "category", F.lit("</nav>"))), (2, _bottom(me))]
    ends = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("chunk"), x.alias("x")) for part, x in around])
    of = numbered(has).select("category", F.expr(f"page div {CHUNK}").alias("chunk"), "ord", section().alias("x"))
    # With a number given, adaptive execution doesn't put the texts of many chunks, small when compressed, together in a few tasks.
    listed = of.repartition(parts, "category", "chunk").groupBy("category", "chunk").agg(_listed("x", "ord").alias("x"))
    return listed.select("category", F.lit(1).alias("part"), "chunk", "x").union(has.select("category").distinct().select("category", F.inline(ends)))


def category_pages(posts: DataFrame, me: Identity = Identity()) -> DataFrame:
    """One row a category, joined from its chunks and passed on to another task, as the sitemap is; each is written by its own, as they are large."""
    rows = category_chunks(posts, me).groupBy("category").agg(_listed("x", "part, chunk").alias("content"))
    path = path_join(F.lit(me.root), F.col("category"), F.lit("index.html")).alias("path")
    return rows.select(path, "content").repartition(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def index_pages(posts: DataFrame, me: Identity = Identity()) -> DataFrame:
    sections = numbered(categorised(posts)).withColumn("s", section()).groupBy("page").agg(_listed("s", "ord").alias("s"))
    link = lambda url, text: F.when(F.col(url) != "", F.concat(F.lit('<a href="'), url, F.lit(f'">{text}</a>'))).otherwise("")
    content = F.concat(_top(me, F.lit(me.title)), F.lit("<nav>索引 - P"), "page", link("next_url", "下页"), link("prev_url", "上页"), F.lit("</nav>\n"), F.coalesce("s", F.lit("")), _bottom(me))
    path = F.when(F.col("page") == 1, f"{me.root}/index.html").otherwise(F.concat(F.lit(f"{me.root}/page/"), "page", F.lit("/index.html")))
    return page_nav(posts).join(sections, "page", "left").select(path.alias("path"), content.alias("content"))


def atom(posts: DataFrame, me: Identity = Identity()) -> DataFrame:
    url = F.concat(F.lit(me.host + "/"), "category", F.lit("/"), "pagename", F.lit("/"))
    entry = F.concat(
        F.lit("<entry>\n<title>"), "title", F.lit('</title>\n<link href="'), url, F.lit('"/>\n<id>'), url, F.lit("</id>\n<published>"), "released", F.lit("</published>\n<updated>"), "modified",
        F.lit('</updated>\n<content type="html">\n<![CDATA[\n'), "data", F.lit("]]>\n</content>\n</entry>\n"),
    )
    top = newest(posts).select("ord", "modified", entry.alias("e"))
    # The newest post comes first, so the listing's order is modified downwards, then ord.
    got = top.agg(F.expr("coalesce(listagg(e, '') within group (order by modified desc, ord), '')").alias("e"), F.coalesce(F.max("modified"), F.lit("")).alias("m"))
    head = f'<feed xmlns="http://www.w3.org/2005/Atom">\n<title>{me.title}</title>\n<subtitle>{me.tagline}</subtitle>\n<link href="/atom.xml" rel="self"/>\n<link href="{me.host}/"/>\n<updated>'
    return got.select(F.lit(f"{me.root}/atom.xml").alias("path"), F.concat(F.lit(head), "m", F.lit(f"</updated>\n<id>{me.host}/</id>\n<author>\n<name>{me.author}</name>\n</author>\n"), "e", F.lit("</feed>\n")).alias("content"))


def sitemap_chunks(posts: DataFrame, me: Identity = Identity(), compat: bool = True) -> DataFrame:
    """(part, chunk, x): the sitemap's text by parts (head, pages, posts, foot), CHUNK pages or their posts a row.

    So no task sorts or holds all entries one by one; what is left for a single task are the texts of the chunks.
    """
    close = "" if compat else "</loc>"
    of, chunk = numbered(posts), F.expr(f"page div {CHUNK}").alias("chunk")
    url = F.when(F.col("page") == 1, F.lit(f"<loc>{me.host}/{close}\n")).otherwise(F.concat(F.lit(f"<loc>{me.host}/page/"), "page", F.lit(f"/{close}\n")))
    pages = sitemap_pages(posts, of).select(F.lit(1).alias("part"), chunk, F.col("page").alias("k"), F.concat(F.lit("<url>\n"), url, F.lit("<lastmod>"), "lastmod", F.lit("</lastmod>\n<changefreq>weekly</changefreq>\n<priority>1.0</priority>\n</url>\n")).alias("x"))
    each = sitemap_posts(of, me, "page").select(F.lit(2).alias("part"), chunk, F.col("ord").alias("k"), F.concat(F.lit("<url>\n<loc>"), "loc", F.lit("</loc>\n<lastmod>"), "lastmod", F.lit("</lastmod>\n<changefreq>monthly</changefreq>\n<priority>"), "priority", F.lit("</priority>\n</url>\n")).alias("x"))
    around = [(0, 0, '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'), (3, 0, "</urlset>\n")]
    listed = [rows.groupBy("part", "chunk").agg(_listed("x", "k").alias("x")) for rows in (pages, each)]
    return listed[0].union(listed[1]).union(posts.sparkSession.createDataFrame(around, "part int, chunk long, x string"))


def sitemap(posts: DataFrame, me: Identity = Identity(), compat: bool = True) -> DataFrame:
    """compat leaves the pages' <loc> open, as the program does that this follows.

    One row, as large as the file; it is passed on to another task, as a writer copies it and the task that joins the chunks still holds them.
    """
    return sitemap_chunks(posts, me, compat).agg(_listed("x", "part, chunk").alias("content")).select(F.lit(f"{me.root}/sitemap.xml").alias("path"), "content").repartition(1)


def robots(posts: DataFrame, me: Identity = Identity()) -> DataFrame:
    return posts.sparkSession.createDataFrame([(f"{me.root}/robots.txt", f"User-agent: *\nAllow: /\nSitemap: {me.host}/sitemap.xml\n")], "path string, content string")


def site_files(posts: DataFrame, me: Identity = Identity()) -> DataFrame:
    """(path, content) of the whole site; no rows without posts. Persist posts before, as six plans read it."""
    if posts.isEmpty():
        return posts.sparkSession.createDataFrame([], "path string, content string")
    out = robots(posts, me)
    for part in (post_pages, category_pages, index_pages, atom, sitemap):
        out = out.unionByName(part(posts, me))
    return out
