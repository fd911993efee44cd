"""Hyphenation by patterns, as a relational plan and as an Arrow function.

A pattern is letters with digits between them; a word's gaps get the largest digit of all patterns that occur in it, and an
odd digit allows a hyphen. Patterns are data: ``read_patterns`` takes any file of them, one a line; the public TeX corpus
for US English is built in, whole.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.resources import files

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import SOFT_HYPHEN, escape_html, space

# Lines of the public TeX patterns for US English, all of them; the file has their copyright notice.
US_ENGLISH = [line for line in (files("inkwell.resources") / "hyph-en-us.pat").read_text("ascii").split("\n") if line and line[0] != "%"]

# A few of these, for small examples; queries and builds have the whole table.
BUILT_IN = """
.ta4 a2n b2l2 b4le. 2ce. 1co 2cog c3ume 1do e1s2e g1ni 1go he2n hena4 hen5at 4h1m
hy3ph 2io 2ith 4l1g4 lgo3 1men 3ment 1na n2at n1t nt4s 3ogniz o2n pr2 p3rese 1ta
2tab 2t1in 1tio 4t1s2 4t3t2 1ty type3 za1
""".split()

# Words with breaks of their own, as gap positions.
EXCEPTIONS: dict[str, list[int]] = {
    "associate": [2, 4], "associates": [2, 4], "declination": [3, 5, 7], "obligatory": [5, 6], "philanthropic": [4, 6],
    "present": [], "presents": [], "project": [], "projects": [], "reciprocity": [4], "recognizance": [2, 5, 7],
    "reformation": [3, 5, 7], "retribution": [3, 5, 7], "table": [2],
}

#: Shorter words are never broken; no break within 2 letters of the start and 3 of the end.
SHORTEST, LEAD, TAIL = 5, 2, 3


def parse_patterns(lines: DataFrame) -> DataFrame:
    """(letters, points) of (line); a digit stands before the letter that it precedes, a missing one is 0."""
    clean = lines.select(F.trim("line").alias("line")).where(F.col("line").rlike("^[0-9]?([.a-z][0-9]?)+$"))
    lead = F.coalesce(F.regexp_extract("line", "^([0-9])", 1).try_cast("int"), F.lit(0))
    rest = F.transform(F.regexp_extract_all("line", F.lit("([.a-z][0-9]?)"), F.lit(1)), lambda p: F.coalesce(F.nullif(F.substring(p, 2, 1), F.lit("")).cast("int"), F.lit(0)))
    return clean.select(F.regexp_replace("line", "[0-9]", "").alias("letters"), F.concat(F.array(lead), rest).alias("points")).dropDuplicates(["letters"])


def built_in_patterns(spark: SparkSession) -> DataFrame:
    return parse_patterns(spark.createDataFrame([(p,) for p in BUILT_IN], "line string"))


def us_english_patterns(spark: SparkSession) -> DataFrame:
    """The whole table."""
    return parse_patterns(spark.createDataFrame([(p,) for p in US_ENGLISH], "line string"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    return parse_patterns(spark.read.text(path).withColumnRenamed("value", "line"))


def words_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct words (runs of ASCII letters) of all texts."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z]+)"), F.lit(1))).alias("word")).distinct()


def hyphen_points(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """(word, gap, p) for gaps with a digit: substrings of the dotted word joined with the broadcast patterns.

    Give it distinct words. Patterns are a corpus of a few thousand rows of any length, whatever the text; only substrings of a pattern's length are made.
    """
    dotted = F.concat(F.lit("."), F.lower("word"), F.lit("."))
    sizes = [r["n"] for r in patterns.select(F.length("letters").alias("n")).distinct().collect()]  # a few numbers
    cut = f"flatten(transform(sequence(1, length(w)), s -> transform(filter(array({', '.join(map(str, sorted(sizes))) or '1'}), n -> s + n - 1 <= length(w)), n -> struct(s, substring(w, s, n) as letters))))"
    parts = words.select("word", dotted.alias("w")).select("word", F.explode(F.expr(cut)).alias("x")).select("word", "x.s", "x.letters")
    joined = parts.join(F.broadcast(patterns), "letters").select("word", "s", F.posexplode("points").alias("j", "p")).where("p > 0")
    return joined.groupBy("word", (F.col("s") - 2 + F.col("j")).cast("int").alias("gap")).agg(F.max("p").cast("int").alias("p"))


def hyphenate_words(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """(word, hyphenated): distinct words of any length; short words and exceptions as they are defined."""
    exceptions = F.create_map(*[x for w, gaps in EXCEPTIONS.items() for x in (F.lit(w), F.array(*[F.lit(g) for g in gaps]).cast("array<int>"))])
    long = words.where((F.length("word") >= SHORTEST) & ~F.col("word").isin(list(EXCEPTIONS)))
    found = hyphen_points(long, patterns).where(f"p % 2 = 1 and gap between {LEAD} and length(word) - {TAIL}").groupBy("word").agg(F.array_sort(F.collect_list("gap")).alias("found"))
    gaps = F.coalesce(F.element_at(exceptions, F.col("word")), F.col("found"), F.array().cast("array<int>"))
    letter = lambda c, i: F.when(F.array_contains(F.col("gaps"), i), F.concat(F.lit(SOFT_HYPHEN), c)).otherwise(c)
    return words.join(found, "word", "left").withColumn("gaps", gaps).select("word", F.array_join(F.transform(F.split("word", ""), letter), "").alias("hyphenated"))


class Hyphenator:
    """The same for one word at a time, remembered. Patterns form a trie, so a start is left at the first letter that no pattern has."""

    def __init__(self, patterns: dict[str, list[int]]) -> None:
        self.trie: dict = {}
        for letters, points in patterns.items():
            node = self.trie
            for c in letters:
                node = node.setdefault(c, {})
            node["points"] = [(j, p) for j, p in enumerate(points) if p]
        self.known: dict[str, str] = {}

    def points(self, word: str) -> list[int]:
        w, out = f".{word.lower()}.", [0] * (len(word) + 3)
        for s in range(len(w)):
            node = self.trie
            for c in w[s:]:
                node = node.get(c)
                if node is None:
                    break
                for j, p in node.get("points", ()):
                    if p > out[s + j]:
                        out[s + j] = p
        return out[1 : len(word) + 2]

    def __call__(self, word: str) -> str:
        if len(word) < SHORTEST:
            return word
        done = self.known.get(word)
        if done is None:
            gaps = EXCEPTIONS.get(word)
            if gaps is None:
                points = self.points(word)
                gaps = [g for g in range(LEAD, len(word) - TAIL + 1) if points[g] % 2]
            done = SOFT_HYPHEN.join(word[a:b] for a, b in zip([0, *gaps], [*gaps, len(word)], strict=True))
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = done
        return done


_WORD = regex.compile("[A-Za-z]{5,}")


def hyphenator(patterns: DataFrame) -> Callable[[Column], Column]:
    """hyphenate(column): a function on Arrow batches; it needs no shuffle, so it is the one for whole texts."""
    rows = {r["letters"]: list(r["points"]) for r in patterns.toLocalIterator()}
    shared = patterns.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf(T.StringType())
    def hyphenate(text: pd.Series) -> pd.Series:
        one = _worker_hyphenator(shared)
        return text.map(lambda t: _WORD.sub(lambda m: one(m[0]), t), na_action="ignore")

    return hyphenate


_made: dict[int, Hyphenator] = {}


def _worker_hyphenator(shared) -> Hyphenator:
    key = id(shared.value)
    if key not in _made:
        _made.clear()
        _made[key] = Hyphenator(shared.value)
    return _made[key]


def linter(patterns: DataFrame) -> Callable[[Column], Column]:
    """lint(column): thin spaces on the raw text, soft hyphens in its words, escaping last."""
    hyphenate = hyphenator(patterns)
    return lambda text: escape_html(hyphenate(space(text)))


def register(spark: SparkSession, patterns: DataFrame | None = None) -> None:
    """The functions under their names for SQL."""
    from inkwell.functions.text import CHINESE_CLASS, ESCAPES, THIN_SPACE

    one = hyphenator(patterns if patterns is not None else us_english_patterns(spark))
    spark.udf.register("hyphenate", one)
    spaced = f"regexp_replace(regexp_replace(t, r'([{CHINESE_CLASS}])([A-Za-z0-9])', '$1{THIN_SPACE}$2'), r'([A-Za-z0-9])([{CHINESE_CLASS}])', '$1{THIN_SPACE}$2')"
    escaped = "t"
    for a, b in ESCAPES:
        escaped = f'replace({escaped}, "{a}", "{b}")' if a != '"' else f"replace({escaped}, '\"', '{b}')"
    spark.sql(f"create or replace temporary function space_scripts(t string) returns string return {spaced}")
    spark.sql(f"create or replace temporary function escape_html(t string) returns string return {escaped}")


def prefixes(patterns: DataFrame) -> DataFrame:
    """The distinct prefixes of all patterns, the empty one included: the nodes of their trie."""
    return patterns.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("letters")), lambda n: F.col("letters").substr(F.lit(1), n))).alias("prefix")).distinct()


def failure_links(patterns: DataFrame) -> DataFrame:
    """(prefix, fail): the longest proper suffix of each prefix that is a prefix too."""
    nodes = prefixes(patterns)
    suffixes = nodes.where("prefix <> ''").select("prefix", F.explode(F.transform(F.sequence(F.lit(2), F.length("prefix") + 1), lambda s: F.expr("prefix").substr(s, F.length("prefix")))).alias("fail"))
    return suffixes.join(nodes.select(F.col("prefix").alias("fail")), "fail").groupBy("prefix").agg(F.max_by("fail", F.length("fail")).alias("fail"))


def merged_outputs(patterns: DataFrame) -> DataFrame:
    """(prefix, gap, p): the largest digit of all patterns that end with the prefix, at each gap counted from its end."""
    nodes = prefixes(patterns).where("prefix <> ''")
    suffixes = nodes.select("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda s: F.expr("prefix").substr(s, F.length("prefix")))).alias("letters"))
    hit = suffixes.join(F.broadcast(patterns), "letters").select("prefix", F.length("letters").alias("n"), F.posexplode("points").alias("j", "p")).where("p > 0")
    return hit.groupBy("prefix", (F.col("n") - F.col("j")).cast("int").alias("from_end")).agg(F.max("p").cast("int").alias("p"))


def output_vectors(patterns: DataFrame) -> DataFrame:
    """(prefix, points): what a state puts out, the largest digits of all patterns that end there, aligned at the end."""
    nodes = prefixes(patterns).where("prefix <> ''")
    suffixes = nodes.select("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda s: F.expr("prefix").substr(s, F.length("prefix")))).alias("letters"))
    hit = suffixes.join(F.broadcast(patterns), "letters").select("prefix", F.length("letters").alias("n"), F.posexplode("points").alias("j", "p"))
    each = hit.groupBy("prefix", (F.col("j") - F.col("n")).alias("place")).agg(F.max("p").cast("int").alias("p"))
    return each.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda x: x["p"]).alias("points"))


def first_fit(children: dict[int, list[int]]) -> tuple[dict[int, int], dict[int, int]]:
    """(base, place) of a trie's nodes in one array: a node's child by c stands at its base + c, and no two nodes share a place.

    children: each node's letters with the child's number, packed as child << 8 | letter; node 0 is the root. Larger families are
    placed first; free places are bits of one number, so that a base is tried by one shift.
    """
    taken, low = 1, 1
    base, place = {0: 0}, {0: 0}
    for node in sorted(children, key=lambda k: (-len(children[k]), k)):
        letters = [x & 255 for x in children[node]]
        mask = sum(1 << c for c in letters)
        while taken >> low & 1:
            low += 1
        at = max(0, low - max(letters))
        while taken >> at & mask:
            at += 1
        base[node] = at
        taken |= mask << at
        for x in children[node]:
            place[x >> 8] = at + (x & 255)
    return base, place


def compile_table(patterns: DataFrame) -> tuple[list[tuple[int, int, int, int, int]], list[int], float]:
    """(rows, pool, fill rate in percent) of the packed automaton: (place, base, place of the parent, place of the suffix state, data).

    data is the position of the state's output in the pool << 4 | its length, 0 for none. A small offline step on the driver: the
    trie of a few thousand patterns.
    """
    links = {r["prefix"]: r["fail"] for r in failure_links(patterns).collect()}
    names = sorted(["", *links], key=lambda x: (len(x), x))
    number = {x: k for k, x in enumerate(names)}
    children: dict[int, list[int]] = {}
    for x in names[1:]:
        children.setdefault(number[x[:-1]], []).append(number[x] << 8 | ord(x[-1]))
    base, place = first_fit(children)
    outputs = {r["prefix"]: "".join(map(str, r["points"])) for r in output_vectors(patterns).collect()}
    pool = shortest_superstring(list(outputs.values()))
    data = {x: pool.index(v) << 4 | len(v) for x, v in outputs.items()}
    rows = [(place[k], base.get(k, 0), place[number[x[:-1]]] if x else -1, place[number[links[x]]] if x else 0, data.get(x, 0)) for x, k in number.items()]
    return sorted(rows), [int(c) for c in pool], 100 * len(rows) / (max(place.values()) + 1)


def sample_words(words: DataFrame, n: int = 10_000, seed: int = 0, lengths: tuple[int, int] = (5, 18)) -> DataFrame:
    """(len, k, word): for each length n words, drawn with replacement by a hash of seed, length and k, so a sample can be had again.

    words: distinct words; they are numbered within their length.
    """
    own = words.where(F.length("word").between(*lengths)).select(F.length("word").alias("len"), "word")
    order = own.withColumn("at", F.row_number().over(Window.partitionBy("len").orderBy("word")) - 1)
    counts = own.groupBy("len").agg(F.count("*").alias("count")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "len", "k").cast("binary")), 1, 8), 16, 10).cast("long")
    return counts.withColumn("at", hashed % F.col("count")).join(order, ["len", "at"]).select("len", "k", "word")


def overlaps(rows: DataFrame) -> DataFrame:
    """(a, b, n): for ordered pairs of different ids, the longest suffix of a's text that is a prefix of b's, if any.

    An equi-join of suffixes and prefixes, so only pairs that do overlap are made.
    """
    suffix = rows.select(F.col("id").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda n: F.col("seq").substr(F.length("seq") - n + 1, n))).alias("part"))
    prefix = rows.select(F.col("id").alias("b"), F.explode(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda n: F.col("seq").substr(F.lit(1), n))).alias("part"))
    return suffix.join(prefix, "part").where("a <> b").groupBy("a", "b").agg(F.max(F.length("part")).cast("int").alias("n"))


def drop_contained(rows: DataFrame) -> DataFrame:
    """Rows (id, seq) whose text is no part of another's; of equal texts the smallest id stays."""
    parts = rows.select(F.col("id").alias("other"), F.length("seq").alias("size"), F.explode(F.expr("flatten(transform(sequence(1, length(seq)), s -> transform(sequence(1, length(seq) - s + 1), n -> substring(seq, s, n))))")).alias("seq")).distinct()
    inside = rows.join(parts, "seq").where("size > length(seq) or (size = length(seq) and other < id)").select("id").distinct()
    return rows.join(inside, "id", "left_anti")


def shortest_superstring(texts: list[str]) -> str:
    """A short text that holds all given: the largest overlaps are joined first, each text to one other at either end.

    A small offline compaction on the driver.
    """
    left = sorted(set(texts))
    left = [t for t in left if not any(t in u for u in left if len(u) > len(t))]
    starts: dict[str, list[int]] = {}
    for k, t in enumerate(left):
        for n in range(1, len(t)):
            starts.setdefault(t[:n], []).append(k)
    follows, begun, chain = {}, set(), list(range(len(left)))  # chain: the other end of the chain that a text ends or begins
    for n in range(max(map(len, left), default=0) - 1, 0, -1):
        for a, t in enumerate(left):
            if a in follows or len(t) <= n:
                continue
            b = next((b for b in starts.get(t[-n:], ()) if b not in begun and chain[a] != b), None)
            if b is not None:
                follows[a] = (b, n)
                begun.add(b)
                head, tail = chain[a], chain[b]
                chain[head], chain[tail] = tail, head
    out = []
    for a in range(len(left)):
        if a not in begun:
            out.append(left[a])
            while a in follows:
                a, n = follows[a]
                out.append(left[a][n:])
    return "".join(out)
