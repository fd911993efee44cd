"""The library's queries, over whole tables, each with the SQL that gives its rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as t
from inkwell.operators import hyphenation as h
from inkwell.plans import site

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: one type of event stands for posts without a category."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.concat(F.lit("Event "), "event_id").alias("title"), stamp.alias("released"), stamp.alias("modified"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("category"), F.concat(F.lit("e"), "event_id").alias("pagename"), F.coalesce("props", F.lit("")).alias("data"),
    )


_P = """posts as (select event_id as ord, 'Event ' || event_id as title, strftime(ts, '%Y-%m-%dT%H:%M:%S') as released, strftime(ts, '%Y-%m-%dT%H:%M:%S') as modified,
 case when event_type = 'error' then '' else event_type end as category, 'e' || event_id as pagename, coalesce(props, '') as data from events)"""
_D = "docs as (select doc_id, coalesce(text, '') as text from documents)"
#: Documents have no Chinese; these queries put some in, alike in both engines.
_MIXED = "replace(replace(text, ' ', '中'), 'e', '1')"
_C = t.CHINESE_CLASS


def _spaced(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '([{_C}])([A-Za-z0-9])', '\\1{t.THIN_SPACE}\\2', 'g'), '([A-Za-z0-9])([{_C}])', '\\1{t.THIN_SPACE}\\2', 'g')"


def _escaped(x: str) -> str:
    for a, b in t.ESCAPES:
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return x


_PATTERNS = "pats as (select regexp_replace(line, '[0-9]', '', 'g') as letters, list_concat([coalesce(try_cast(regexp_extract(line, '^([0-9])', 1) as int), 0)], list_transform(regexp_extract_all(line, '[.a-z][0-9]?'), lambda p: coalesce(try_cast(nullif(substring(p, 2, 1), '') as int), 0))) as points from (values " + ", ".join(f"('{p}')" for p in h.US_ENGLISH) + ") v(line))"
_WORDS = f"{_D}, words as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from docs)"
_POINTS = f"""{_PATTERNS}, cuts as (select word, s, unnest(generate_series(2, 10)) as n, '.' || lower(word) || '.' as w from (select word, unnest(generate_series(1, length(word) + 1)) as s from words where length(word) >= 5)),
 hits as (select word, s, points, unnest(generate_series(1, len(points))) as j from cuts join pats on s + n - 1 <= length(w) and substring(w, s, n) = letters),
 points_of as (select word, cast(s - 2 + j - 1 as int) as gap, max(points[j]) as p from hits where points[j] > 0 group by all)"""
_EXCEPTIONS = "exceptions as (select * from (values " + ", ".join(f"('{w}', {g}::int[])" for w, g in h.EXCEPTIONS.items()) + ") v(word, gaps))"
_HYPHENATED = f"""{_POINTS}, {_EXCEPTIONS}, found as (select word, list(gap) as gaps from points_of where p % 2 = 1 and gap between 2 and length(word) - 3 group by word),
 hyphenated as (select w.word, array_to_string(list_transform(generate_series(1, length(w.word)), lambda i: case when list_contains(coalesce(e.gaps, f.gaps, []::int[]), cast(i - 1 as int)) then '{t.SOFT_HYPHEN}' else '' end || w.word[i]), '') as hyphenated
  from words w left join exceptions e on e.word = w.word left join found f on f.word = w.word)"""


@query(f"with {_D} select 'N' as script, cast(sum(length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) as bigint) as n from docs union all select 'E', cast(sum(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) as bigint) from docs union all select 'C', cast(sum(length({_MIXED}) - length(regexp_replace({_MIXED}, '[{_C}]', '', 'g'))) as bigint) from docs")
def script_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("mixed", F.expr(_MIXED))
    chars = lambda c, cls: (F.length(c) - F.length(F.regexp_replace(c, cls, ""))).cast("long")
    got = d.agg(F.sum(chars("text", "[0-9]")).alias("N"), F.sum(chars("text", "[A-Za-z]")).alias("E"), F.sum(chars("mixed", f"[{_C}]")).alias("C"))
    return got.select(F.expr("stack(3, 'N', N, 'E', E, 'C', C) as (script, n)"))


@query(f"with {_D}, w as (select unnest(['a', '7', '中', '𠀀', '𪜀', 'é', 'か', ',', '']) as c) select c, case when regexp_matches(c, '^[0-9]') then 'N' when regexp_matches(c, '^[A-Za-z]') then 'E' when regexp_matches(c, '^[{_C}]') then 'C' else 'U' end as script from w")
def script_of_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in ["a", "7", "中", "𠀀", "𪜀", "é", "か", ",", ""]], "c string").select("c", t.script(F.col("c")).alias("script"))


@query(f"with {_D} select doc_id, md5({_spaced(_MIXED)}) as spaced_md5, cast(length({_spaced(_MIXED)}) as bigint) as n from docs")
def space_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = _docs(spark, sf_dir).select("doc_id", t.space(F.expr(_MIXED)).alias("s"))
    return spaced.select("doc_id", F.md5(F.col("s").cast("binary")).alias("spaced_md5"), F.length("s").cast("long").alias("n"))


@query(f"with {_D} select doc_id, {_escaped('text')} as escaped from docs union all select -1 - page_id, {_escaped('html')} from pages")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    return _docs(spark, sf_dir).union(pages).select("doc_id", t.escape_html(F.col("text")).alias("escaped"))


@query(f"with {_D} select token, cast(count(*) as bigint) as n from (select unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) as token from docs) group by token")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(t.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"with {_PATTERNS} select letters, array_to_string(points, ',') as points from pats")
def pattern_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.us_english_patterns(spark).select("letters", F.array_join(F.transform("points", lambda p: p.cast("string")), ",").alias("points"))


@query(f"with {_WORDS}, {_POINTS} select word, gap, p from points_of")
def hyphen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.hyphen_points(h.words_of(_docs(spark, sf_dir)).where(F.length("word") >= h.SHORTEST), h.us_english_patterns(spark))


@query(f"with {_WORDS}, {_HYPHENATED} select word, hyphenated from hyphenated")
def hyphenate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.hyphenate_words(h.words_of(_docs(spark, sf_dir)), h.us_english_patterns(spark))


@query(f"with {_WORDS}, {_HYPHENATED}, raw as (select doc_id, {_spaced('text')} as s from docs), parts as (select doc_id, unnest(regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+')) as token, generate_subscripts(regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+'), 1) as k from raw), joined as (select doc_id, string_agg(coalesce(hyphenated, token), '' order by k) as s from parts left join hyphenated on word = token group by doc_id) select d.doc_id, md5(coalesce({_escaped('s')}, '')) as linted_md5, cast(length(coalesce({_escaped('s')}, '')) as bigint) as n from docs d left join joined j on j.doc_id = d.doc_id")
def lint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lint = h.linter(h.us_english_patterns(spark))
    done = _docs(spark, sf_dir).select("doc_id", lint(F.col("text")).alias("s"))
    return done.select("doc_id", F.md5(F.col("s").cast("binary")).alias("linted_md5"), F.length("s").cast("long").alias("n"))


@query(f"with {_D} select doc_id, printf('%.2f', round_even(length(text) / 1024.0::double, 2)) as label from docs")
def size_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.size_label(F.length("text")).alias("label"))


@query("select c_custkey, concat_ws('/', nullif(c_mktsegment, ''), nullif(case when c_custkey % 3 = 0 then '' else c_name end, ''), 'index.html') as path, split_part(c_name, '#', 1) as first, regexp_replace(c_name || '　 \n', '[\\s\\p{Z}]+$', '') as trimmed, left(c_name, 10) as day from customer")
def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    trimmed = t.trim_end(F.concat("c_name", F.lit("　 \n")))
    return _table(spark, sf_dir, "customer").select("c_custkey", t.path_join(F.col("c_mktsegment"), name, F.lit("index.html")).alias("path"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first"), trimmed.alias("trimmed"), t.date_part(F.col("c_name")).alias("day"))


@query(f"with {_P} select ord, category from posts where category <> ''")
def categorised_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.categorised(_posts(spark, sf_dir)).select("ord", "category")


@query(f"with {_P} select distinct category from posts where category <> ''")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.categorised(_posts(spark, sf_dir)).select("category").distinct()


@query(f"with {_P} select category, md5(string_agg(pagename, ',' order by ord)) as pages_md5, cast(count(*) as bigint) as n from posts where category <> '' group by category")
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.expr("listagg(pagename, ',') within group (order by ord)")
    return site.categorised(_posts(spark, sf_dir)).groupBy("category").agg(F.md5(listed).alias("pages_md5"), F.count("*").alias("n"))


@query(f"with {_P} select cast(count(*) as bigint) as n from posts where category <> ''")
def post_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.categorised(_posts(spark, sf_dir)).agg(F.count("*").alias("n"))


_SPINE = "spine as (select size, unnest(generate_series(1, size // 7 + 1)) as page from (select count(*) as size from posts where category <> ''))"


@query(f"with {_P}, {_SPINE} select cast(page as bigint) as page from spine")
def page_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.page_spine(site.categorised(_posts(spark, sf_dir))).select("page")


@query(f"with {_P} select ord, cast((row_number() over (order by ord) - 1) // 7 + 1 as bigint) as page from posts where category <> ''")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.numbered(site.categorised(_posts(spark, sf_dir))).select("ord", "page")


@query(f"with {_P}, {_SPINE} select cast(page as bigint) as page, case when page * 7 < size then '/page/' || (page + 1) || '/' else '' end as next_url, case when page = 2 then '/' when page > 2 then '/page/' || (page - 1) || '/' else '' end as prev_url from spine")
def page_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.page_nav(_posts(spark, sf_dir))


@query(f"with {_P} select title, '/' || category || '/' || pagename || '/' as url, modified from posts order by modified desc, ord limit 3")
def feed_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.newest(_posts(spark, sf_dir)).select("title", F.concat(F.lit("/"), "category", F.lit("/"), "pagename", F.lit("/")).alias("url"), "modified")


@query(f"with {_P} select coalesce(max(modified), '') as modified from posts")
def latest_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).agg(F.coalesce(F.max("modified"), F.lit("")).alias("modified"))


_LASTMOD = "pages_ as (select (row_number() over (order by ord) - 1) // 7 + 1 as page, modified from posts), lastmods as (select s.page, coalesce(max(m) over (order by s.page), '') as lastmod from (select unnest(generate_series(1, count(*) // 7 + 1)) as page from posts) s left join (select page, max(modified) as m from pages_ group by page) p on p.page = s.page)"


@query(f"with {_P}, {_LASTMOD} select cast(page as bigint) as page, lastmod from lastmods")
def sitemap_lastmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.sitemap_pages(_posts(spark, sf_dir))


@query(f"with {_P} select ord, 'https://example.org/' || case when category <> '' then category || '/' else '' end || pagename || '/' as loc, modified as lastmod, case when category <> '' then '0.8' else '0.5' end as priority from posts")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.sitemap_posts(_posts(spark, sf_dir))


_ME = site.Identity()


def _top(title: str) -> str:
    return f"""'<!DOCTYPE html>\n<html lang="cmn-Hans">\n<head>\n<meta charset="UTF-8">\n<title>' || {title} || '</title>\n<meta name="author" content="{_ME.author}">\n<meta name="viewport" content="width=device-width,initial-scale=1">\n<link rel="stylesheet" type="text/css" href="/style.css">\n<link rel="icon" type="image/png" href="/favicon.png">\n<link rel="alternate" type="application/atom+xml" title="Atom" href="/atom.xml">\n</head>\n<body>\n<header>\n<a href="/"><h1>{_ME.title}</h1><h2>{_ME.tagline}</h2></a>\n</header>\n<article>\n'"""


_BOTTOM = f"""'</article>\n<footer>\n<p>&copy;&nbsp;{_ME.years}&nbsp;<a href="/about/">{_ME.author}</a></p>\n<p><a href="{_ME.licence_url}">{_ME.licence}</a></p>\n</footer>\n</body>\n</html>\n'"""
_SECTION = """('<section>\n<a href="/' || category || '/' || pagename || '/"><h1>' || title || '</h1><time datetime="' || released || '">' || left(released, 10) || '</time></a>\n</section>\n')"""


@query(f"""with {_P} select 'public/' || case when category <> '' then category || '/' else '' end || pagename || '/index.html' as path, {_top('title')} || '<h1>' || title || '</h1>\n<pre><code>本文发表于：<time datetime="' || released || '">' || left(released, 10) || '</time>\n最后修改于：<time datetime="' || modified || '">' || left(modified, 10) || '</time>\n' || case when category <> '' then '分类：<a href="/' || category || '/">' || category || '</a>\n' else '' end || '合计信息量：' || printf('%.2f', round_even(length(data) / 1024.0::double, 2)) || 'kb</code></pre>\n' || data || {_BOTTOM} as content from posts""")
def post_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.post_pages(_posts(spark, sf_dir))


@query(f"""with {_P} select 'public/' || category || '/index.html' as path, {_top(f"'{_ME.title}'")} || '<nav>分类 - ' || category || '</nav>' || string_agg({_SECTION}, '' order by ord) || {_BOTTOM} as content from posts where category <> '' group by category""")
def category_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.category_pages(_posts(spark, sf_dir))


@query(f"""with {_P}, {_SPINE}, n as (select *, (row_number() over (order by ord) - 1) // 7 + 1 as page from posts where category <> ''), s as (select page, string_agg({_SECTION}, '' order by ord) as s from n group by page)
select case when p.page = 1 then 'public/index.html' else 'public/page/' || p.page || '/index.html' end as path, {_top(f"'{_ME.title}'")} || '<nav>索引 - P' || p.page || case when p.page * 7 < size then '<a href="/page/' || (p.page + 1) || '/">下页</a>' else '' end || case when p.page = 2 then '<a href="/">上页</a>' when p.page > 2 then '<a href="/page/' || (p.page - 1) || '/">上页</a>' else '' end || '</nav>\n' || coalesce(s, '') || {_BOTTOM} as content from spine p left join s on s.page = p.page""")
def index_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.index_pages(_posts(spark, sf_dir))


@query(f"""with {_P}, top as (select * from posts order by modified desc, ord limit 3) select 'public/atom.xml' as path, '<feed xmlns="http://www.w3.org/2005/Atom">\n<title>{_ME.title}</title>\n<subtitle>{_ME.tagline}</subtitle>\n<link href="/atom.xml" rel="self"/>\n<link href="{_ME.host}/"/>\n<updated>' || coalesce(max(modified), '') || '</updated>\n<id>{_ME.host}/</id>\n<author>\n<name>{_ME.author}</name>\n</author>\n' || coalesce(string_agg('<entry>\n<title>' || title || '</title>\n<link href="{_ME.host}/' || category || '/' || pagename || '/"/>\n<id>{_ME.host}/' || category || '/' || pagename || '/</id>\n<published>' || released || '</published>\n<updated>' || modified || '</updated>\n<content type="html">\n<![CDATA[\n' || data || ']]>\n</content>\n</entry>\n', '' order by modified desc, ord), '') || '</feed>\n' as content from top""")
def atom_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.atom(_posts(spark, sf_dir))


@query(f"""with {_P}, {_LASTMOD}, x as (select 0 as part, page as k, '<url>\n' || case when page = 1 then '<loc>{_ME.host}/\n' else '<loc>{_ME.host}/page/' || page || '/\n' end || '<lastmod>' || lastmod || '</lastmod>\n<changefreq>weekly</changefreq>\n<priority>1.0</priority>\n</url>\n' as x from lastmods union all select 1, ord, '<url>\n<loc>{_ME.host}/' || case when category <> '' then category || '/' else '' end || pagename || '/</loc>\n<lastmod>' || modified || '</lastmod>\n<changefreq>monthly</changefreq>\n<priority>' || case when category <> '' then '0.8' else '0.5' end || '</priority>\n</url>\n' from posts)
select 'public/sitemap.xml' as path, '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n' || coalesce(string_agg(x, '' order by part, k), '') || '</urlset>\n' as content from x""")
def sitemap_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.sitemap(_posts(spark, sf_dir))


@query("select 'public/robots.txt' as path, 'User-agent: *\nAllow: /\nSitemap: https://example.org/sitemap.xml\n' as content")
def robots_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.robots(_posts(spark, sf_dir))


@query("with r as (select conv_id, role as name, min(turn) as first from conversations group by all) select c.conv_id, c.turn, c.role, cast(r.k as bigint) as note from conversations c join (select *, dense_rank() over (partition by conv_id order by first) as k from r) r on r.conv_id = c.conv_id and r.name = c.role")
def footnote_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles stand for names of notes: each gets the next number of its conversation at first sight."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    first = c.withColumn("first", F.min("turn").over(Window.partitionBy("conv_id", "role")))
    return first.select("conv_id", "turn", "role", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first")).cast("long").alias("note"))


def _script_sql(x: str) -> str:
    return f"case when regexp_matches({x}, '^[0-9]') then 'N' when regexp_matches({x}, '^[A-Za-z]') then 'E' when regexp_matches({x}, '^[{_C}]') then 'C' else 'U' end"


_TURN = "case when turn % 3 = 0 then '中' || text when turn % 3 = 1 then text || '文' else text end"


@query(f"with e as (select conv_id, turn, {_TURN} as text from conversations), s as (select *, {_script_sql('left(text, 1)')} as ns, coalesce(lag({_script_sql('right(text, 1)')}) over (partition by conv_id order by turn), 'U') as ws from e) select conv_id, turn, (ws = 'C' and ns <> 'U') or (ns = 'C' and ws <> 'U' and ws <> ns) as spaced, (ws = 'C' or ns = 'C') and ws <> 'U' and ns <> 'U' and ws <> ns as documented from s")
def event_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for text events; whether a thin space goes before each, by the compatible and the documented rule."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TURN).alias("text"))
    ws = F.coalesce(F.lag(t.last_script(F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("U"))
    s = c.select("conv_id", "turn", t.first_script(F.col("text")).alias("ns"), ws.alias("ws"))
    return s.select("conv_id", "turn", F.expr("(ws = 'C' and ns <> 'U') or (ns = 'C' and ws <> 'U' and ws <> ns)").alias("spaced"), F.expr("(ws = 'C' or ns = 'C') and ws <> 'U' and ns <> 'U' and ws <> ns").alias("documented"))


_LINES = "select o_orderkey as k, unnest([1, 2, 3, 4, 5]) as seq, unnest(['本文发表于：' || o_orderdate::date, '最后修改于：' || o_orderdate::date || '　 ', '分类：' || o_orderpriority, '页名：o' || o_orderkey, '地址：x']) as line from orders"


@query(f"with l as ({_LINES}) select k, string_agg(case when starts_with(line, '本文发表于：') then regexp_replace(line[7:], '[\\s\\p{{Z}}]+$', '') else '' end, '' order by seq) as released, string_agg(case when starts_with(line, '最后修改于：') then regexp_replace(line[7:], '[\\s\\p{{Z}}]+$', '') else '' end, '' order by seq) as modified, string_agg(case when starts_with(line, '分类：') then regexp_replace(line[4:], '[\\s\\p{{Z}}]+$', '') else '' end, '' order by seq) as category, string_agg(case when starts_with(line, '页名：') then regexp_replace(line[4:], '[\\s\\p{{Z}}]+$', '') else '' end, '' order by seq) as pagename from l group by k")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lines = F.array(F.concat(F.lit("本文发表于："), day), F.concat(F.lit("最后修改于："), day, F.lit("　 ")), F.concat(F.lit("分类："), "o_orderpriority"), F.concat(F.lit("页名：o"), "o_orderkey"), F.lit("地址：x"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.posexplode(lines).alias("seq", "line"))
    value = lambda label: F.when(F.startswith("line", F.lit(label)), t.trim_end(F.col("line").substr(F.lit(len(label) + 1), F.length("line")))).otherwise("")
    from inkwell.sources.markdown import LABELS

    parts = rows.select("k", "seq", *[value(label).alias(column) for label, column in LABELS.items()])
    return parts.groupBy("k").agg(*[F.expr(f"listagg({c}, '') within group (order by seq)").alias(c) for c in LABELS.values()])


_NODES = f"{_PATTERNS}, nodes as (select distinct left(letters, n) as prefix from (select letters, unnest(generate_series(0, length(letters))) as n from pats))"


@query(f"with {_NODES} select prefix from nodes")
def trie_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.prefixes(h.us_english_patterns(spark))


@query(f"with {_NODES}, s as (select prefix, substring(prefix, k) as fail from (select prefix, unnest(generate_series(2, length(prefix) + 1)) as k from nodes where prefix <> '')) select s.prefix, arg_max(s.fail, length(s.fail)) as fail from s join nodes n on n.prefix = s.fail group by s.prefix")
def failure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.failure_links(h.us_english_patterns(spark))


@query(f"with {_NODES}, s as (select prefix, substring(prefix, k) as letters from (select prefix, unnest(generate_series(1, length(prefix))) as k from nodes where prefix <> '')), x as (select prefix, length(s.letters) as n, points, unnest(generate_series(1, len(points))) as j from s join pats on pats.letters = s.letters) select prefix, cast(n - (j - 1) as int) as from_end, max(points[j]) as p from x where points[j] > 0 group by all")
def merged_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.merged_outputs(h.us_english_patterns(spark))


@query(f"with {_NODES}, s as (select prefix, substring(prefix, k) as letters from (select prefix, unnest(generate_series(1, length(prefix))) as k from nodes where prefix <> '')), x as (select prefix, length(s.letters) as n, unnest(generate_series(1, len(points))) as j, unnest(points) as p from s join pats using (letters)), v as (select prefix, j - 1 - n as place, max(p) as p from x group by all) select distinct points from (select prefix, string_agg(p, ',' order by place) as points from v group by prefix)")
def distinct_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What states put out once the outputs along their suffix links are merged."""
    return h.output_vectors(h.us_english_patterns(spark)).select(F.array_join(F.transform("points", lambda p: p.cast("string")), ",").alias("points")).distinct()


@query(None)
def packed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled automaton, a row a state. Checked by a test, as its placement is an algorithm of its own."""
    rows, _, _ = h.compile_table(h.us_english_patterns(spark))
    return spark.createDataFrame(rows, "place int, base int, parent int, suffix int, data int")


@query(f"with {_NODES} select cast(count(*) as bigint) as states, cast(0 as bigint) as lost_outputs, true as full_enough from nodes")
def packed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the compiled table, outputs that its pool doesn't hold, and whether 95 % of its places are used."""
    patterns = h.us_english_patterns(spark)
    rows, pool, fill = h.compile_table(patterns)
    text = "".join(map(str, pool))
    lost = h.output_vectors(patterns).where(~F.contains(F.lit(text), F.array_join(F.transform("points", lambda p: p.cast("string")), "")))
    return lost.agg(F.lit(len(rows)).cast("long").alias("states"), F.count("*").alias("lost_outputs"), F.lit(fill > 95).alias("full_enough"))


_SAMPLE = """own as (select cast(length(word) as int) as len, word, row_number() over (partition by length(word) order by word) - 1 as pos from words where length(word) between 5 and 18),
 k as (select len, count(*) as n, unnest(generate_series(0, 9999)) as k from own group by len), drawn as (select len, cast(k as int) as k, cast('0x' || substr(md5('0:' || len || ':' || k), 1, 8) as bigint) % n as pos from k)"""


@query(f"with {_WORDS}, {_SAMPLE} select len, k, word from drawn join own using (len, pos)")
def sampled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 words of each length of 5 to 18, with replacement: what the hyphenator is timed on."""
    return h.sample_words(h.words_of(_docs(spark, sf_dir)))


@query(f"with {_WORDS}, {_HYPHENATED}, {_SAMPLE} select len, k, hyphenated from drawn join own using (len, pos) join hyphenated using (word)")
def hyphenate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample, hyphenated on Arrow batches."""
    return sampled_words(spark, sf_dir).select("len", "k", h.hyphenator(h.us_english_patterns(spark))(F.col("word")).alias("hyphenated"))


_ROWS = "rows_ as (select n_nationkey as id, lower(n_name) as seq from nation union all select 100 + r_regionkey, lower(left(r_name, 3)) from region)"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("seq")).union(_table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long"), F.lower(F.left("r_name", F.lit(3)))))


@query(f"with {_ROWS} select cast(a.id as bigint) as a, cast(b.id as bigint) as b, cast(max(k) as int) as n from (select *, unnest(generate_series(1, length(seq))) as k from rows_) a join rows_ b on a.id <> b.id and length(b.seq) >= k and right(a.seq, k) = left(b.seq, k) group by a.id, b.id")
def pairwise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.overlaps(_sequences(spark, sf_dir))


@query(f"with {_ROWS} select cast(id as bigint) as id, seq from rows_ r where not exists (select 1 from rows_ o where contains(o.seq, r.seq) and (length(o.seq) > length(r.seq) or o.id < r.id))")
def contained_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.drop_contained(_sequences(spark, sf_dir))


@query(f"with {_WORDS} select cast(length(word) as int) as len, cast(count(*) as bigint) as n from words where length(word) between 5 and 18 group by 1")
def words_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = h.words_of(_docs(spark, sf_dir)).where(F.length("word").between(5, 18))
    return w.groupBy(F.length("word").alias("len")).agg(F.count("*").alias("n"))


@query(f"with {_WORDS}, {_HYPHENATED} select word, hyphenated, hyphenated as on_arrow from hyphenated")
def impl_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word as the relational hyphenator and as the function on Arrow batches break it."""
    words, patterns = h.words_of(_docs(spark, sf_dir)), h.us_english_patterns(spark)
    return h.hyphenate_words(words, patterns).withColumn("on_arrow", h.hyphenator(patterns)(F.col("word")))


_LOG = "select 'bench' || p_size || '_' || case when p_partkey % 2 = 0 then 'own' else 'other' end || ' bench: ' || cast(p_size * 100 + p_partkey % 7 as bigint) || ' ns/iter (+/- 5)' as line from part"


@query(f"with l as ({_LOG}), x as (select regexp_extract(line, '_([a-z]+) ', 1) as impl, cast(regexp_extract(line, 'bench([0-9]+)_', 1) as double) as len, cast(regexp_extract(line, 'bench: ([0-9]+) ns', 1) as double) as ns from l) select impl, printf('%.4f', regr_slope(ns, len)) as slope, printf('%.4f', regr_intercept(ns, len)) as intercept from x group by impl")
def bench_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("bench"), "p_size", F.lit("_"), F.when(F.col("p_partkey") % 2 == 0, "own").otherwise("other"), F.lit(" bench: "), (F.col("p_size") * 100 + F.col("p_partkey") % 7).cast("long"), F.lit(" ns/iter (+/- 5)"))
    x = _table(spark, sf_dir, "part").select(line.alias("line")).select(F.regexp_extract("line", "_([a-z]+) ", 1).alias("impl"), F.regexp_extract("line", "bench([0-9]+)_", 1).cast("double").alias("len"), F.regexp_extract("line", "bench: ([0-9]+) ns", 1).cast("double").alias("ns"))
    return x.groupBy("impl").agg(F.format_string("%.4f", F.regr_slope("ns", "len")).alias("slope"), F.format_string("%.4f", F.regr_intercept("ns", "len")).alias("intercept"))


@query(None)
def markdown_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a bundle of two posts: its lines under two headings. Checked by tests, as SQL can't parse Markdown."""
    from inkwell.sources.markdown import posts

    value = F.concat(F.lit("# 标题One\n\n    本文发表于：2018-01-01T12:45:00+08:00\n    分类：tech\n    页名：a\n\n"), "text", F.lit("\n\n# Two\n\n    页名：b\n\n- *"), F.col("doc_id").cast("string"), F.lit("*\n"))
    return posts(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("bundle"), value.alias("value")), h.us_english_patterns(spark))


@query(" union all ".join(f"select path, content from ({ORACLES[n]})" for n in ("post_html", "category_html", "index_html", "atom_xml", "sitemap_xml", "robots_txt")))
def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.site_files(_posts(spark, sf_dir))
