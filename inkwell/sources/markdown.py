"""Bundles of Markdown: a tokenizer, the fold of its events into HTML, and posts with front matter.

The tokenizer covers a subset of CommonMark: ATX and setext headings, paragraphs, fenced and indented code, block quotes,
lists, rules, pipe tables, HTML blocks; emphasis, strong, code, links, images, inline HTML, autolinks, entities,
escapes, soft and hard breaks. Reference links and lazy continuation are not in it. Events come in document order.

A bundle is one serial text, so this is Python, run by Spark over bundles in parallel (``posts`` and ``events``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import CHINESE, ESCAPES, THIN_SPACE, script_of
from inkwell.operators.hyphenation import Hyphenator, _WORD

EVENTS = "bundle string, seq long, kind string, tag string, level int, text string, dest string, title string, aligns array<string>, list_start long, info string"
POSTS = "bundle string, ord long, title string, released string, modified string, category string, pagename string, data string"


@dataclass
class Event:
    kind: str  # start, end, text, html, inline_html, soft, hard, note
    tag: str = ""
    level: int = 0
    text: str = ""
    dest: str = ""
    title: str = ""
    aligns: list[str] = field(default_factory=list)
    list_start: int | None = None
    info: str = ""


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|\t|$)")
_TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}</?(?:address|article|aside|blockquote|body|center|details|dialog|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|iframe|li|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b|\s{0,3}<!--")
_INLINE = re.compile(r"""\\[!-/:-@\[-`{-~]|`+|!?\[|\]|\*+|_+|<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|</?[A-Za-z][^<>]*>|<!--.*?-->|&(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|(?: {2,}|\\)\n[ ]*|[ ]?\n[ ]*|\[\^[^\]]+\]""", re.S)
_TARGET = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)""")


def _plain(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def _inline(text: str) -> list[Event]:
    """Events of a paragraph's text; delimiters are paired from the inside out."""
    out: list[Event] = []
    opens: list[tuple[int, str, int]] = []  # place in out, delimiter, its length
    at = 0

    def say(t: str) -> None:
        if t:
            out.append(Event("text", text=t))

    while m := _INLINE.search(text, at):
        say(text[at : m.start()])
        t, at = m[0], m.end()
        if t[0] == "\\" and len(t) == 2 and t[1] != "\n":
            say(t[1])
        elif t[0] == "`":
            end = re.compile(rf"(?<!`){t}(?!`)").search(text, at)
            if end:
                code = text[at : end.start()].replace("\n", " ")
                code = code[1:-1] if code.strip() and code[:1] == code[-1:] == " " else code
                out += [Event("start", "code"), Event("text", text=code), Event("end", "code")]
                at = end.end()
            else:
                say(t)
        elif t in ("[", "!["):
            opens.append((len(out), t, 0))
            out.append(Event("text", text=t))
        elif t == "]":
            k = next((i for i in range(len(opens) - 1, -1, -1) if opens[i][1] in ("[", "![")), None)
            target = _TARGET.match(text, at)
            if k is None or not target:
                if k is not None:
                    del opens[k]
                say(t)
                continue
            place, mark, _ = opens[k]
            tag = "link" if mark == "[" else "image"
            dest = _plain(target[1] if target[1] is not None else target[2] or "")
            title = _plain(next((g for g in target.groups()[2:] if g is not None), ""))
            out[place] = Event("start", tag, dest=dest, title=title)
            out.append(Event("end", tag))
            opens = [o for o in opens[:k] if not (tag == "link" and o[1] == "[")]
            at = target.end()
        elif t[0] in "*_":
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            punct = lambda c: not c.isalnum() and not c.isspace()
            left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
            right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
            can_open = left and (t[0] == "*" or not right or punct(before))
            can_close = right and (t[0] == "*" or not left or punct(after))
            n = len(t)
            while can_close and n:
                k = next((i for i in range(len(opens) - 1, -1, -1) if opens[i][1] == t[0]), None)
                if k is None or any(o[1] in ("[", "![") for o in opens[k:]):
                    break
                place, mark, size = opens[k]
                use = 2 if n >= 2 and size >= 2 else 1
                tag = "strong" if use == 2 else "emphasis"
                rest = size - use
                out[place : place + 1] = ([Event("text", text=mark * rest)] if rest else []) + [Event("start", tag)]
                out.append(Event("end", tag))
                opens = opens[:k] + ([(place, mark, rest)] if rest else [])
                n -= use
            if n and can_open:
                opens.append((len(out), t[0], n))
                out.append(Event("text", text=t[0] * n))
            else:
                say(t[0] * n)
        elif t[0] == "<":
            if re.match(r"<[A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*>$", t):
                out += [Event("start", "link", dest=t[1:-1]), Event("text", text=t[1:-1]), Event("end", "link")]
            else:
                out.append(Event("inline_html", text=t))
        elif t[0] == "&":
            say(html.unescape(t))
        elif "\n" in t:
            out.append(Event("hard" if t.startswith(("  ", "\\")) else "soft"))
        else:
            say(t)
    say(text[at:])
    return out


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|\s*$", "", re.sub(r"^\s*\|", "", line)))]


def _blocks(lines: list[str]) -> Iterator[Event]:
    at, paragraph = 0, []

    def flush() -> Iterator[Event]:
        if paragraph:
            yield Event("start", "paragraph")
            yield from _inline("\n".join(x.lstrip() for x in paragraph).rstrip())
            yield Event("end", "paragraph")
            paragraph.clear()

    while at < len(lines):
        line = lines[at].expandtabs(4)
        if not line.strip():
            yield from flush()
            at += 1
        elif paragraph and re.match(r" {0,3}(=+|-+)[ \t]*$", line):
            level = 1 if "=" in line else 2
            yield Event("start", "header", level)
            yield from _inline("\n".join(x.strip() for x in paragraph))
            yield Event("end", "header", level)
            paragraph.clear()
            at += 1
        elif m := _ATX.match(line):
            yield from flush()
            yield Event("start", "header", len(m[1]))
            yield from _inline((m[2] or "").strip())
            yield Event("end", "header", len(m[1]))
            at += 1
        elif m := _FENCE.match(line):
            yield from flush()
            yield Event("start", "code_block", info=m[3].strip())
            at += 1
            while at < len(lines) and not re.match(rf" {{0,3}}{m[2][0]}{{{len(m[2])},}}[ \t]*$", lines[at]):
                yield Event("text", text=re.sub(rf"^ {{0,{len(m[1])}}}", "", lines[at]) + "\n")
                at += 1
            at += 1
            yield Event("end", "code_block", info=m[3].strip())
        elif not paragraph and line.startswith("    "):
            code = []
            while at < len(lines) and (lines[at].expandtabs(4).startswith("    ") or not lines[at].strip()):
                code.append(lines[at].expandtabs(4)[4:])
                at += 1
            while code and not code[-1].strip():
                code.pop()
            yield Event("start", "code_block")
            yield from (Event("text", text=x + "\n") for x in code)
            yield Event("end", "code_block")
        elif _RULE.match(line):
            yield from flush()
            yield Event("start", "rule")
            yield Event("end", "rule")
            at += 1
        elif re.match(r" {0,3}>", line):
            yield from flush()
            inner = []
            while at < len(lines) and (m := re.match(r" {0,3}> ?", lines[at])):
                inner.append(lines[at][m.end() :])
                at += 1
            yield Event("start", "quote")
            yield from _blocks(inner)
            yield Event("end", "quote")
        elif (m := _ITEM.match(line)) and not (paragraph and (not line[m.end() :].strip() or m[2][0].isdigit() and int(m[2][:-1]) != 1)):
            yield from flush()
            kind, items, loose = m[2][-1], [], False
            start = int(m[2][:-1]) if m[2][0].isdigit() else None
            while at < len(lines) and (m := _ITEM.match(lines[at].expandtabs(4))) and m[2][-1] == kind and not _RULE.match(lines[at]):
                first = lines[at].expandtabs(4)
                width = m.end() if len(m[3]) <= 4 and first[m.end() :].strip() else len(m[1]) + len(m[2]) + 1
                inner = [first[width:]]
                at += 1
                while at < len(lines) and (not lines[at].strip() or lines[at].expandtabs(4).startswith(" " * width)):
                    inner.append(lines[at].expandtabs(4)[width:])
                    at += 1
                blank = bool(inner) and not inner[-1].strip()
                while inner and not inner[-1].strip():
                    inner.pop()
                goes_on = at < len(lines) and (n := _ITEM.match(lines[at].expandtabs(4))) and n[2][-1] == kind
                loose |= any(not x.strip() for x in inner) or bool(blank and goes_on)
                items.append(inner)
            yield Event("start", "list", list_start=start)
            for inner in items:
                yield Event("start", "item")
                for e in _blocks(inner):
                    if loose or e.tag != "paragraph":
                        yield e
                yield Event("end", "item")
            yield Event("end", "list", list_start=start)
        elif not paragraph and "|" in line and at + 1 < len(lines) and _TABLE.match(lines[at + 1]) and len(_cells(line)) == len(_cells(lines[at + 1])):
            aligns = [{(1, 1): "center", (1, 0): "left", (0, 1): "right"}.get((c.startswith(":"), c.endswith(":")), "none") for c in _cells(lines[at + 1])]
            yield Event("start", "table", aligns=aligns)
            rows = [lines[at]]
            at += 2
            while at < len(lines) and lines[at].strip() and "|" in lines[at]:
                rows.append(lines[at])
                at += 1
            for k, row in enumerate(rows):
                tag = "table_row" if k else "table_head"
                yield Event("start", tag)
                for c in [*_cells(row), *[""] * len(aligns)][: len(aligns)]:
                    yield Event("start", "table_cell")
                    yield from _inline(c)
                    yield Event("end", "table_cell")
                yield Event("end", tag)
            yield Event("end", "table", aligns=aligns)
        elif not paragraph and _HTML.match(line):
            while at < len(lines) and lines[at].strip():
                yield Event("html", text=lines[at] + "\n")
                at += 1
        else:
            paragraph.append(lines[at])
            at += 1
    yield from flush()


def tokenize(text: str) -> Iterator[Event]:
    return _blocks(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))


_MIXED = re.compile("[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in CHINESE) + "]")
_SEAM = re.compile("(?<=[{0}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{0}])".format("".join(f"{chr(x)}-{chr(y)}" for x, y in CHINESE)))
_ESCAPES = str.maketrans(dict(ESCAPES))


class Lint:
    """Spacing, hyphenation and escaping of one text, as the Column functions do it."""

    def __init__(self, hyphenate: Hyphenator) -> None:
        self.hyphenate = hyphenate

    def __call__(self, text: str) -> str:
        spaced = _SEAM.sub(THIN_SPACE, text) if _MIXED.search(text) else text
        return _WORD.sub(lambda m: self.hyphenate(m[0]), spaced).translate(_ESCAPES)


# How a fragment stands to its neighbours: LINE begins a line, LEAD opens something around what follows, so that a thin space goes
# before it, PLAIN only follows, BREAK ends adjacency of texts as LINE does, TEXT is linted text.
LINE, LEAD, PLAIN, BREAK, TEXT = "line", "lead", "plain", "break", "text"

# The fragment of each event, by kind and tag; names in braces are filled in from ``resolve``.
FRAGMENTS: dict[tuple[str, str], tuple[str, str]] = {
    ("text", ""): (TEXT, "{text}"),
    ("html", ""): (BREAK, "{raw}"),
    ("inline_html", ""): (BREAK, "{raw}"),
    ("soft", ""): (LINE, ""),
    ("hard", ""): (BREAK, "<br />\n"),
    ("note", ""): (BREAK, '\u2060<sup><a href="#{note}">{note}</a></sup>'),
    ("start", "paragraph"): (LINE, "<p>"),
    ("end", "paragraph"): (PLAIN, "</p>\n"),
    ("start", "rule"): (LINE, "<hr />\n"),
    ("end", "rule"): (PLAIN, ""),
    ("start", "quote"): (LINE, "<blockquote>\n"),
    ("end", "quote"): (PLAIN, "</blockquote>\n"),
    ("start", "item"): (LINE, "<li>"),
    ("end", "item"): (PLAIN, "</li>\n"),
    ("start", "header"): (LINE, "<h{level}>"),
    ("end", "header"): (PLAIN, "</h{level}>\n"),
    ("start", "table"): (LINE, "<table>"),
    ("end", "table"): (PLAIN, "</tbody></table>\n"),
    ("start", "table_head"): (LEAD, "<thead><tr>"),
    ("end", "table_head"): (PLAIN, "</tr></thead><tbody>\n"),
    ("start", "table_row"): (LEAD, "<tr>"),
    ("end", "table_row"): (PLAIN, "</tr>\n"),
    ("start", "table_cell"): (LEAD, "<{cell}{align}>"),
    ("end", "table_cell"): (PLAIN, "</{cell}>"),
    ("start", "code_block"): (LINE, "<pre><code{lang}>"),
    ("end", "code_block"): (PLAIN, "</code></pre>\n"),
    ("start", "list"): (LINE, "<{list}{first}>\n"),
    ("end", "list"): (PLAIN, "</{list}>\n"),
    ("start", "emphasis"): (LEAD, "<em>"),
    ("end", "emphasis"): (PLAIN, "</em>"),
    ("start", "strong"): (LEAD, "<strong>"),
    ("end", "strong"): (PLAIN, "</strong>"),
    ("start", "code"): (LEAD, "<code>"),
    ("end", "code"): (PLAIN, "</code>"),
    ("start", "link"): (LEAD, '<a href="{dest}{title}" target="_blank">'),
    ("end", "link"): (PLAIN, "</a>"),
    ("start", "image"): (LEAD, '<img src="{dest}" alt="'),
    ("alt", ""): (BREAK, "{alt}"),
    ("end", "image"): (LEAD, '{title}" />'),
    ("start", "note_definition"): (BREAK, '<aside id="{note}"><sup>{note}</sup>'),
    ("end", "note_definition"): (PLAIN, "</aside>\n"),
}


def flatten_images(events: Iterable[Event]) -> Iterator[Event]:
    """Events with an image's inside as plain ``alt`` events, between its start and its end (which has its title)."""
    inside: list[Event] = []
    for e in events:
        if not inside:
            yield e
            inside = [e] if (e.kind, e.tag) == ("start", "image") else []
        elif e.kind == "start":
            inside.append(e)
        elif e.kind == "end":
            opened = inside.pop()
            if not inside:
                yield Event("end", "image", title=opened.title)
        elif e.kind in ("soft", "hard"):
            yield Event("alt", text=" ")
        elif e.kind in ("text", "note"):
            yield Event("alt", text=e.text, info=e.kind)


def number_notes(events: list[Event]) -> dict[str, int]:
    """Names of notes by first sight, whether referred to or defined there."""
    named = (e.text for e in events if e.kind == "note" or e.info == "note" and e.kind == "alt" or (e.kind, e.tag) == ("start", "note_definition"))
    return {name: k for k, name in enumerate(dict.fromkeys(named), 1)}


def place_cells(events: list[Event], compat: bool) -> Iterator[tuple[str, str]]:
    """(element, alignment) of each event that a table cell starts or ends with; other events get empty ones.

    The column counts cells since the row's start; a head goes on from the last row's width under compat.
    """
    aligns, element, column = [], "th", 0
    for e in events:
        if e.kind == "start" and e.tag == "table":
            aligns = e.aligns
        elif e.kind == "start" and (e.tag == "table_row" or e.tag == "table_head" and not compat):
            column = 0
        if e.tag == "table_head":
            element = "th" if e.kind == "start" else "td"
        if e.tag != "table_cell":
            yield "", ""
            continue
        yield element, aligns[column] if column < len(aligns) else "none"
        column += e.kind == "end"


def resolve(events: Iterable[Event], lint: Lint, compat: bool) -> Iterator[tuple[str, str, Event]]:
    """(how it stands, fragment, event) of every event. Without compat attributes are escaped."""
    flat = list(flatten_images(events))
    notes = number_notes(flat)
    attribute = (lambda x: x) if compat else html.escape
    for e, (element, align) in zip(flat, place_cells(flat, compat), strict=True):
        role, template = FRAGMENTS.get((e.kind, e.tag), (PLAIN, ""))
        if e.kind == "text":
            yield role, lint(e.text), e
        elif "{" not in template:
            yield role, template, e
        else:
            lang = e.info.split(" ")[0]
            values = {
                "raw": e.text, "level": e.level, "note": notes.get(e.text), "cell": element, "align": "" if align == "none" else f' align="{align}"',
                "lang": f' lang="{attribute(lang)}"' if lang else "", "list": "ul" if e.list_start is None else "ol", "first": "" if e.list_start in (None, 1) else f' start="{e.list_start}"',
                "dest": attribute(e.dest), "title": f'" title="{lint(e.title)}' if e.title else "", "alt": f"[{notes[e.text]}]" if e.info == "note" else attribute(e.text),
            }
            yield role, template.format_map(values), e


def spaced(was: str, now: str, compat: bool) -> bool:
    """Whether a thin space goes between texts of these scripts; under compat also between Chinese and Chinese."""
    return "U" not in (was, now) and "C" in (was, now) and (was != now or compat)


def assemble(fragments: Iterable[tuple[str, str, Event]], compat: bool) -> str:
    """The fragments put together: lines begun, thin spaces between texts that meet, before what opens around the second."""
    out: list[str] = []
    was, lead, ended = "U", -1, True  # the last text's script, where what opens before the next text begins, whether a line has ended
    for role, s, e in fragments:
        if role == TEXT:
            if e.text and spaced(was, script_of(e.text[0]), compat):
                out.insert(lead if lead >= 0 else len(out), THIN_SPACE)
            was = script_of(e.text[-1]) if e.text else "U"
        elif role in (LINE, BREAK):
            was = "U"
            if role == LINE and not ended:
                out.append("\n")
                ended = True
        elif e.tag == "table_cell" and e.kind == "start" and not compat:
            was = "U"
        lead = (lead if lead >= 0 else len(out)) if role == LEAD else -1
        if s:
            out.append(s)
            ended = s.endswith("\n")
    return "".join(out)


# Front matter labels and their columns.
LABELS = {"本文发表于：": "released", "最后修改于：": "modified", "分类：": "category", "页名：": "pagename"}
OTHER_SLUG = "地址："


def render(events: Iterable[Event], lint: Lint, compat: bool = True) -> str:
    """HTML of the events.

    compat keeps the behaviour of the program that this follows where its documents say otherwise: a thin space between
    Chinese and Chinese across events, header cells aligned from the last row's width on, spacing across table
    cells, raw link targets. Without compat these follow the documented rules and attributes are escaped.
    """
    return assemble(resolve(events, lint, compat), compat)


def split_posts(events: list[Event]) -> Iterator[tuple[list[Event], list[Event], list[Event]]]:
    """(title, front matter, body) of each post. A first-level heading begins one; it waits for its front matter, the first code block, first."""
    at = lambda start, wanted: next((k for k in range(start, len(events)) if wanted(events[k])), len(events))
    top = lambda e: e.kind == "start" and e.tag == "header" and e.level == 1
    block = lambda kind: lambda e: e.kind == kind and e.tag == "code_block"
    begin = at(0, top)
    while begin < len(events):
        front, body = at(begin, block("start")), at(begin, block("end"))
        begin, last = at(body + 1, top), begin
        yield events[last:front], events[front:body], events[body + 1 : begin]


def read_posts(text: str, lint: Lint, compat: bool = True, other_slug: bool = False) -> Iterator[dict[str, str]]:
    """The posts of a bundle."""
    labels = LABELS | ({OTHER_SLUG: "pagename"} if other_slug else {})
    for title, front, body in split_posts(list(tokenize(text))):
        post = {"title": "".join(lint(e.text) for e in title if e.kind == "text")} | dict.fromkeys(LABELS.values(), "")
        for e in front:
            label = next((x for x in labels if e.kind == "text" and e.text.startswith(x)), None)
            if label:
                post[labels[label]] += e.text[len(label) :].rstrip()
        yield post | {"data": render(body, lint, compat)}


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, value): one row a file, whole. Bytes that aren't UTF-8 are an error."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("bundle"), F.validate_utf8(F.col("content").cast("string")).alias("value"))


def posts(bundles: DataFrame, patterns: DataFrame, compat: bool = True, other_slug: bool = False) -> DataFrame:
    """The posts of (bundle, value), with their order in the bundle."""
    shared = bundles.sparkSession.sparkContext.broadcast({r["letters"]: list(r["points"]) for r in patterns.toLocalIterator()})
    names = "title", "released", "modified", "category", "pagename", "data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lint = Lint(Hyphenator(shared.value))
        for batch in batches:
            rows = [(bundle, k, *map(p.__getitem__, names)) for bundle, value in zip(batch.column("bundle").to_pylist(), batch.column("value").to_pylist(), strict=True) for k, p in enumerate(read_posts(value or "", lint, compat, other_slug))]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_pydict({name: pa.array(col, pa.int64() if name == "ord" else pa.string()) for name, col in zip(("bundle", "ord", *names), cols, strict=True)})

    return bundles.select("bundle", "value").mapInArrow(run, POSTS)


def events(bundles: DataFrame) -> DataFrame:
    """The events of (bundle, value), numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("tag", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("dest", pa.string()), ("title", pa.string()), ("aligns", pa.list_(pa.string())), ("list_start", pa.int64()), ("info", pa.string())])
        for batch in batches:
            for bundle, value in zip(batch.column("bundle").to_pylist(), batch.column("value").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"bundle": bundle, "seq": k} | vars(e) for k, e in enumerate(tokenize(value or ""))], schema=schema)

    return bundles.select("bundle", "value").mapInArrow(run, EVENTS)
