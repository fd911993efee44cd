import re

import pytest
from pyspark.sql import functions as F

from inkwell.plans import site
from inkwell.sources.sink import unsafe_paths, write_site


def _posts(spark, n, loose=0):
    rows = [(3 * k, f"t{k}", "2018-01-01T00", f"2018-01-{k % 28 + 1:02d}T00", "c" if k >= loose else "", f"p{k}", "x" * k) for k in range(n)]
    return spark.createDataFrame(rows, "ord long, title string, released string, modified string, category string, pagename string, data string")


@pytest.mark.parametrize(("n", "pages"), [(0, 1), (1, 1), (6, 1), (7, 2), (8, 2), (14, 3)])
def test_pages(spark, n, pages):
    posts = _posts(spark, n)
    assert site.page_spine(posts).count() == pages
    assert sorted(r["page"] for r in site.numbered(posts).collect()) == [k // 7 + 1 for k in range(n)]
    assert site.index_pages(posts).count() == pages


def test_sitemap_counts_all_posts(spark):
    posts = _posts(spark, 7, loose=1)
    assert site.index_pages(posts).count() == 1
    assert [r["lastmod"] for r in site.sitemap_pages(posts).orderBy("page").collect()] == ["2018-01-07T00"] * 2


def test_sitemap_is_joined_from_chunks(spark, monkeypatch):
    monkeypatch.setattr(site, "CHUNK", 2)
    posts = _posts(spark, 40, loose=3)
    chunks = [r["x"] for r in site.sitemap_chunks(posts).orderBy("part", "chunk").collect()]
    assert max(x.count("<url>") for x in chunks) <= 2 * site.PAGE
    got = site.sitemap(posts).collect()
    assert [r["content"] for r in got] == ["".join(chunks)]
    assert re.findall(r"/page/(\d+)/\n", got[0]["content"]) == [str(k) for k in range(2, 7)]
    assert re.findall(r"/p(\d+)/</loc>", got[0]["content"]) == [str(k) for k in range(40)]
    assert site.sitemap(_posts(spark, 0)).collect()[0]["content"].count("<url>") == 1


def test_category_pages_are_joined_from_chunks(spark, monkeypatch):
    monkeypatch.setattr(site, "CHUNK", 2)
    posts = _posts(spark, 80, loose=3).withColumn("category", F.when(F.col("category") == "", "").otherwise(F.concat("category", (F.col("ord") % 2).cast("string"))))
    got = {r["path"]: r["content"] for r in site.category_pages(posts).collect()}
    assert sorted(got) == ["public/c0/index.html", "public/c1/index.html"]
    for k in (0, 1):
        x = got[f"public/c{k}/index.html"]
        assert x.startswith("<!DOCTYPE html>") and x.endswith("</html>\n") and f"<nav>分类 - c{k}</nav><section>" in x
        assert re.findall(r'<a href="/c\d/p(\d+)/">', x) == [str(n) for n in range(3, 80) if n % 2 == k]
    chunks = site.category_chunks(posts).collect()
    assert max(r["x"].count("<section>") for r in chunks) <= 2 * site.PAGE
    assert {c: "".join(r["x"] for r in sorted(chunks, key=lambda r: (r["part"], r["chunk"])) if r["category"] == c) for c in ("c0", "c1")} == {f"c{k}": got[f"public/c{k}/index.html"] for k in (0, 1)}


def test_files(spark, tmp_path):
    files = site.site_files(_posts(spark, 8, loose=1))
    write_site(spark, files, str(tmp_path), {"public/style.css": b"x"})
    assert (tmp_path / "public/c/p3/index.html").read_text(encoding="utf-8").startswith("<!DOCTYPE html>")
    assert (tmp_path / "public/page/2/index.html").exists() is (site.index_pages(_posts(spark, 8, loose=1)).count() == 2)
    assert site.site_files(_posts(spark, 0)).count() == 0


def test_unsafe_paths(spark, tmp_path):
    bad = spark.createDataFrame([("a/../b", "x"), ("/c", "x"), ("d", "x"), ("d", "y"), ("e//f", "x"), ("ok/g.html", "x")], "path string, content string")
    assert {r["path"] for r in unsafe_paths(bad).collect()} == {"a/../b", "/c", "d", "e//f"}
    with pytest.raises(ValueError, match="paths"):
        write_site(spark, bad, str(tmp_path))


def test_one_far_post_does_not_put_the_others_in_one_range(spark):
    posts = _posts(spark, 40).withColumn("ord", F.when(F.col("ord") == 0, 10**12).otherwise(F.col("ord")))
    got = site.numbered(posts).orderBy("ord").collect()
    assert [r["rn"] for r in got] == list(range(len(got)))


def test_assets_and_bytes(spark, tmp_path):
    from pyspark.errors import PySparkException

    from inkwell.sources.markdown import read_bundles
    from inkwell.sources.sink import copy_asset, favicon

    assert favicon()[:8] == b"\x89PNG\r\n\x1a\n"
    (tmp_path / "a.md").write_bytes("# 标题\n".encode())
    assert read_bundles(spark, str(tmp_path / "a.md")).collect()[0]["value"] == "# 标题\n"
    (tmp_path / "b.md").write_bytes(b"# \xff\n")
    with pytest.raises(PySparkException):
        read_bundles(spark, str(tmp_path / "b.md")).collect()
    copy_asset(str(tmp_path / "a.md"), str(tmp_path / "out"), "b")
    assert (tmp_path / "out" / "b").read_bytes() == "# 标题\n".encode()
