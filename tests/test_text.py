import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as t
from inkwell.operators import hyphenation as h
from inkwell.sources.markdown import Lint

SHY, THIN = t.SOFT_HYPHEN, t.THIN_SPACE
GOLDEN = [
    (">这是Hyphenation的文字", f"&gt;这是{THIN}Hy{SHY}phen{SHY}ation{THIN}的文字"),
    ("Hyphenation", f"Hy{SHY}phen{SHY}ation"),
    ("\"a\" & 'b' <c>", "&#34;a&#34; &#38; &#39;b&#39; &lt;c&gt;"),
    ("中1文a中", f"中{THIN}1{THIN}文{THIN}a{THIN}中"),
    ("abc123", "abc123"), ("中,a", "中,a"), ("\U00020000a", f"\U00020000{THIN}a"), ("\U0002a700a", "\U0002a700a"),
    ("table", f"ta{SHY}ble"), ("present", "present"), ("associate", f"as{SHY}so{SHY}ciate"), ("word", "word"), ("", ""),
]


def _patterns():
    out = {}
    for p in h.BUILT_IN:
        parts = re.findall(r"[.a-z][0-9]?", p)
        out[re.sub("[0-9]", "", p)] = [int(p[0]) if p[0].isdigit() else 0] + [int(x[1:] or 0) for x in parts]
    return out


def test_golden(spark):
    lint = h.linter(h.built_in_patterns(spark))
    got = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(GOLDEN)], "k int, x string").select("k", lint(F.col("x")).alias("y")).collect()
    assert {r["k"]: r["y"] for r in got} == {k: y for k, (_, y) in enumerate(GOLDEN)}
    one = Lint(h.Hyphenator(_patterns()))
    assert [one(x) for x, _ in GOLDEN] == [y for _, y in GOLDEN]


def test_null_stays_null(spark):
    lint = h.linter(h.built_in_patterns(spark))
    assert spark.createDataFrame([(None,)], "x string").select(lint(F.col("x")).alias("y")).first()["y"] is None


def test_points(spark):
    words = spark.createDataFrame([("hyphenation",), ("algorithm",), ("typesetting",)], "word string")
    got = {}
    for r in h.hyphen_points(words, h.built_in_patterns(spark)).collect():
        got.setdefault(r["word"], {})[r["gap"]] = r["p"]
    assert got["hyphenation"] == {2: 3, 5: 2, 6: 5, 7: 4, 8: 2, 10: 2}
    assert [g for g, p in sorted(got["algorithm"].items()) if p % 2 and 2 <= g <= 6] == [2, 4]
    assert [g for g, p in sorted(got["typesetting"].items()) if p % 2 and 2 <= g <= 8] == [4, 7]


def test_whole_pattern_table(spark):
    assert len(h.US_ENGLISH) == len(set(h.US_ENGLISH)) == 4938 == h.us_english_patterns(spark).count()
    patterns = {r["letters"]: r["points"] for r in h.us_english_patterns(spark).collect()}
    one = h.Hyphenator(patterns)
    got = {w: one(w).replace(SHY, "-") for w in ("computer", "university", "hyphenation", "supercalifragilisticexpialidocious")}
    assert got == {"computer": "com-puter", "university": "uni-ver-sity", "hyphenation": "hy-phen-ation", "supercalifragilisticexpialidocious": "su-per-cal-ifrag-ilis-tic-ex-pi-ali-do-cious"}


def test_whole_table_by_brute_force(spark):
    """The relational plan against every pattern looked for at every place of every word."""
    words = ["computer", "university", "inhibiting", "Documents", "zzz", "extraordinarily", "recognizance", "present"]
    expected, patterns = {}, {re.sub("[0-9]", "", p): [int(x or 0) for x in re.split("[.a-z]", p)] for p in h.US_ENGLISH}
    for word in words:
        w, points = f".{word.lower()}.", {}
        for letters, digits in patterns.items():
            for s in range(len(w) - len(letters) + 1):
                if w[s : s + len(letters)] == letters:
                    for j, p in enumerate(digits):
                        points[s + j - 1] = max(points.get(s + j - 1, 0), p)
        expected[word] = {g: p for g, p in points.items() if p}
    got = {w: {} for w in words}
    for r in h.hyphen_points(spark.createDataFrame([(w,) for w in words], "word string"), h.us_english_patterns(spark)).collect():
        got[r["word"]][r["gap"]] = r["p"]
    assert got == expected


def test_size_label(spark):
    n = {0: "0.00", 128: "0.12", 384: "0.38", 640: "0.62", 1000: "0.98", 1024: "1.00"}
    got = spark.createDataFrame([(k,) for k in n], "n int").select("n", t.size_label(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == n


def test_superstring():
    assert h.shortest_superstring(["abc", "cd", "bc", "abc"]) == "abcd"
    assert h.shortest_superstring([]) == ""


@given(st.text(alphabet="ab中文1 <&>'\"é\U00020000hyphenatio", max_size=40))
def test_lint_can_be_undone(x):
    y = Lint(h.Hyphenator(_patterns()))(x)
    for a, b in reversed(t.ESCAPES):
        y = y.replace(b, a)
    assert y.replace(SHY, "").replace(THIN, "") == x


def test_compiled_table_reads_every_pattern(spark):
    """Walking the packed table by a pattern's letters ends at a state whose output holds the pattern's own digits."""
    patterns = h.us_english_patterns(spark)
    rows, pool, fill = h.compile_table(patterns)
    by_place = {r[0]: r for r in rows}
    assert len(rows) == len(by_place) and fill > 95
    for r in patterns.collect():
        at = 0
        for c in r["letters"]:
            place = by_place[at][1] + ord(c)
            assert by_place[place][2] == at
            at = place
        data = by_place[at][4]
        out = pool[data >> 4 : (data >> 4) + (data & 15)]
        assert len(out) >= len(r["points"]) and all(x >= p for x, p in zip(out[::-1], r["points"][::-1], strict=False))
    assert by_place[0][2:4] == (-1, 0)


def test_superstring_holds_all():
    rng = random.Random(2)
    texts = ["".join(rng.choice("012") for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    got = h.shortest_superstring(texts)
    assert all(t in got for t in texts) and len(got) < sum(map(len, set(texts)))


def test_sample_can_be_had_again(spark):
    words = spark.createDataFrame([(w,) for w in ["abcde", "fghij", "klmno", "abcdef", "xy"]], "word string")
    first, again = (sorted(map(tuple, h.sample_words(words, 50, seed=3).collect())) for _ in range(2))
    assert first == again and len(first) == 100 and {len(w) for _, _, w in first} == {5, 6}
    assert first != sorted(map(tuple, h.sample_words(words, 50, seed=4).collect()))


def test_patterns_of_any_length(spark):
    """Patterns of one letter and of more than ten, alike in both plans."""
    patterns = h.parse_patterns(spark.createDataFrame([("q1",), ("abcdefghijk3l",)], "line string"))
    words = spark.createDataFrame([("aqqabcdefghijklmn",), ("present",)], "word string")
    got = {r["word"]: r["hyphenated"] for r in h.hyphenate_words(words, patterns).collect()}
    one = h.Hyphenator({r["letters"]: list(r["points"]) for r in patterns.collect()})
    assert got == {w: one(w) for w in got} and got["aqqabcdefghijklmn"].count(h.SOFT_HYPHEN) == 3
