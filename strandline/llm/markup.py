"""Markup residue in text: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

A grammar reads a text in layers, each rule of one markup language. Code and formulas are set aside first, so that
nothing inside them is read as markup, and put back at the end. What can nest (templates, links, commands with
arguments) is parsed with a stack, in one pass; what can't is rewritten by ordered rules. Openers without a closer
are ordinary text and cost no search for one: work is linear in the text. The structure that the markup expressed
(headings, list items, code, table rows, formulas) is returned beside the clean text as spans of it. Which rules fired
says which languages a text holds.

Texts without any character that a rule can begin with never leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

# Element names of HTML, and the tags that wiki software adds.
HTML_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
WIKI_TAGS = "gallery includeonly math noinclude nowiki onlyinclude poem ref references syntaxhighlight templatestyles"
MAGIC_WORDS = "TOC NOTOC FORCETOC NOEDITSECTION NEWSECTIONLINK NOINDEX INDEX HIDDENCAT NOGALLERY"

#: A text that no rule matches has none of these characters (or two apostrophes).
MAY_BE_MARKUP = r"[<&\[*_~`#|\\$={>]|''|-{3}|[:;]{2}"

_names = "|".join(sorted(HTML_TAGS.split(), key=len, reverse=True))
_wiki_names = "|".join(WIKI_TAGS.split())
_TAG = rf"</?(?:{_names})(?=[\s/>])(?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*>"
_FLAGS = re.M


def _rx(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, _FLAGS | flags)


class Paired:
    """Openers with the first closer behind each: (begin, end, content begin, content end), none inside another.

    Closers are looked up by place, so an opener without one costs nothing. line: both must stand on one line. The group ``t`` of an opener, if there is one, must be
    that of its closer.
    """

    def __init__(self, opens: str, closes: str, flags: int = 0, line: bool = False):
        self.opens, self.closes, self.line = _rx(opens, flags), _rx(closes, flags), line

    def finditer(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        ends: dict[str, tuple[list[int], list[int]]] = {}
        for m in self.closes.finditer(text):
            begins, stops = ends.setdefault((m.groupdict().get("t") or "").lower(), ([], []))
            begins.append(m.start())
            stops.append(m.end())
        at = 0
        for m in self.opens.finditer(text) if ends else ():
            begins, stops = ends.get((m.groupdict().get("t") or "").lower(), ((), ()))
            k = bisect_left(begins, m.end())
            if m.start() < at or k == len(begins) or (self.line and begins[k] - m.end() > 0 and text.find("\n", m.end(), begins[k]) >= 0):
                continue
            at = stops[k]
            yield m.start(), at, m.end(), begins[k]


class Single:
    """A pattern with the content as group ``x``."""

    def __init__(self, pattern: str, flags: int = 0):
        self.pattern = _rx(pattern, flags)

    def finditer(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        for m in self.pattern.finditer(text):
            yield (*m.span(), *m.span("x"))


# What is set aside: (language, structure, where it is), in order.
_VERBATIM = [
    (MARKDOWN, "code", Single(r"^(?P<f>```+|~~~+)[^\n`]*\n(?P<x>.*?)(?:\n(?P=f)(?=\W|$)|\Z)", re.S)),
    (HTML, "code", Paired(r"<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?", r"(?:</code>)?\s*</pre>", re.I)),
    (WIKI, "code", Paired(r"<(?P<t>syntaxhighlight|nowiki)\b[^<>]*>", r"</(?P<t>syntaxhighlight|nowiki)>", re.I)),
    (LATEX, "code", Paired(r"\\begin\{(?P<t>verbatim|lstlisting|alltt)\*?\}\n?", r"\n?\\end\{(?P<t>verbatim|lstlisting|alltt)\*?\}")),
    (WIKI, "formula", Paired(r"<math\b[^<>]*>", r"</math>", re.I)),
    (LATEX, "formula", Paired(r"\\begin\{(?P<t>equation|align|gather|multline|eqnarray|displaymath|math)\*?\}", r"\\end\{(?P<t>equation|align|gather|multline|eqnarray|displaymath|math)\*?\}")),
    (LATEX, "formula", Single(r"\$\$(?P<x>[^$]+)\$\$")),
    (LATEX, "formula", Paired(r"\\\[", r"\\\]", line=True)),
    (LATEX, "formula", Paired(r"\\\(", r"\\\)", line=True)),
    (LATEX, "formula", Single(r"(?<![\\$\w])\$(?P<x>(?=[^$\n]*[\\^_{])[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])")),
    (MARKDOWN, "code", Single(r"(?<!`)(?P<f>`{1,2})(?!`)(?P<x>[^`\n]+)(?P=f)(?!`)")),
    (HTML, "code", Paired(r"<(?P<t>code|tt|kbd|samp)\b[^<>]*>", r"</(?P<t>code|tt|kbd|samp)>", re.I, line=True)),
]
_SCRIPTS = Paired(r"<(?P<t>script|style)\b[^<>]*>", r"</(?P<t>script|style)>", re.I)
_HTML_HEADS = Paired(r"<(?P<t>h[1-6])\b[^<>]*>", r"</(?P<t>h[1-6])>", re.I, line=True)

# Commands by what becomes of their arguments; those of other commands are kept.
_HEADINGS = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph|title)\*?$")
_DROPPED = re.compile(r"\\(?:cite[a-z]*|ref|eqref|label|pageref|footnotemark|usepackage|documentclass|includegraphics|vspace|hspace|input|bibliographystyle|bibliography)\*?$")
_LAST_OF_TWO = re.compile(r"\\(?:href|textcolor|colorbox|parbox|raisebox)$")
_FRACTION = re.compile(r"\\[dtc]?frac$")

_COMMAND_OR_BRACE = re.compile(r"(?P<space>~?)(?P<name>\\[a-zA-Z]{2,}\*?)(?:\[[^\]\n]*\])*\{|[{}]")
_BEGIN_OR_END = ("\\begin", "\\end")
_LINK = re.compile(r"\[\[|\]\]|\n")
_PARAMETER, _COMMAND_BEFORE = re.compile(r"\{\{\{[^{}]*\}\}\}"), re.compile(r"\\[a-zA-Z]+\*?\Z")
_TEMPLATE = re.compile(r"\{\{|\}\}")
_CATEGORY = re.compile(r":?(?:Category|Kategorie|Catégorie|Categoría|Kategoria)[ \t]*:", re.I)
_QUOTES = re.compile(r"'{2,}")
_FILE = re.compile(r"(?:File|Image|Datei|Bild|Fichier|Archivo|Plik)[ \t]*:", re.I)


def without_templates(text: str) -> str:
    """Without templates and their parameters, however deep they nest; braces that don't pair, and those of a command's argument, stay."""
    if "{{" not in text:
        return text
    text = _PARAMETER.sub("", text)
    out, opens, outer = [], [], []
    for m in _TEMPLATE.finditer(text):
        if m[0] == "{{":
            if not _COMMAND_BEFORE.search(text, max(0, m.start() - 24), m.start()):
                opens.append(m.start())
        elif opens:
            begin = opens.pop()
            while outer and outer[-1][0] > begin:
                outer.pop()
            outer.append((begin, m.end()))
    at = 0
    for a, b in outer:
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:] if outer else text


def _unclosed(frames: list[list[str]], mark: str) -> list[str]:
    """The parts of all frames in order, with the marks that opened them."""
    if len(frames) == 1:
        return frames[0]
    return [x for k, parts in enumerate(frames) for x in ([mark] * (k > 0) + parts)]


def _flat(parts: list) -> str:
    """The text of parts that are texts or lists of parts, however deep."""
    out, todo = [], [iter(parts)]
    while todo:
        for x in todo[-1]:
            if isinstance(x, str):
                out.append(x)
            else:
                todo.append(iter(x))
                break
        else:
            todo.pop()
    return "".join(out)


def without_quotes(text: str) -> str:
    """Without the runs of two, three or five apostrophes that pair on a line; a run opens before and closes behind something that isn't white space."""
    if "''" not in text:
        return text
    out = []
    for line in text.split("\n"):
        runs, opens, gone = [m.span() for m in _QUOTES.finditer(line)], {}, set()
        for k, (a, b) in enumerate(runs):
            n = b - a
            if n not in (2, 3, 5):
                continue
            if n in opens and not line[a - 1].isspace():
                gone |= {opens.pop(n), k}
            elif n not in opens and b < len(line) and not line[b].isspace():
                opens[n] = k
        at, parts = 0, []
        for k in sorted(gone):
            parts.append(line[at : runs[k][0]])
            at = runs[k][1]
        out.append("".join(parts) + line[at:])
    return "\n".join(out)


def without_links(text: str) -> str:
    """Wiki links as what they show: the last part, nothing for categories; links in captions too. Both ends stand on one line."""
    frames: list[list[str]] = [[]]
    at, changed = 0, False
    for m in _LINK.finditer(text):
        frames[-1].append(text[at : m.start()])
        at = m.end()
        if m[0] == "[[":
            frames.append([])
        elif m[0] == "\n":
            frames = [[*_unclosed(frames, "[["), "\n"]]
        elif len(frames) > 1:
            inner = "".join(frames.pop())
            shown = inner.rsplit("|", 1)
            kept = shown[-1] if len(shown) == 1 or shown[1] else shown[0]
            if _CATEGORY.match(inner):
                changed = True
                if frames[-1] and frames[-1][-1][-1:] in (" ", "\t"):
                    frames[-1][-1] = frames[-1][-1][:-1]
            elif _FILE.match(inner):
                changed = True
                frames[-1].append(shown[1] if len(shown) > 1 else "")
            elif kept.strip() and "[" not in inner and "]" not in inner:
                changed = True
                frames[-1].append(kept[1:] if kept.startswith(":") and len(shown) == 1 else kept)
            else:
                frames[-1] += ["[[", inner, "]]"]
        else:
            frames[-1].append("]]")
    frames[-1].append(text[at:])
    return "".join(_unclosed(frames, "[[")) if changed else text


def without_commands(text: str, s: str) -> str:
    """LaTeX commands with arguments in braces as what they show; a fraction is a/b. Braces that don't pair, and groups of no command, stay."""
    # A frame: what opened it, the command it belongs to (None for a plain group), the number of the argument, its parts.
    frames: list[tuple[str, str | None, int, list]] = [("", None, 0, [])]
    at, changed = 0, False
    for m in _COMMAND_OR_BRACE.finditer(text):
        if m.start() < at:
            continue
        parts = frames[-1][3]
        parts.append(text[at : m.start()])
        at = m.end()
        if m[0] == "}":
            if len(frames) == 1:
                parts.append("}")
                continue
            opened, name, number, inner = frames.pop()
            parts = frames[-1][3]
            if name is None:
                parts.append([opened, inner, "}"])
                continue
            changed = True
            bare, more = name.rstrip("*"), text[at : at + 1] == "{" and number < 9
            if _HEADINGS.match(name):
                parts.append(f"{s}{_HEAD}{s}{_flat(inner).strip()}")
            elif _FRACTION.match(bare):
                parts.append(inner if number == 1 else ["/", inner])
            elif not (_DROPPED.match(name) or (_LAST_OF_TWO.match(bare) and number == 1 and more)):
                parts.append(inner)
            # A group right behind it is its next argument.
            if more and not _DROPPED.match(name):
                frames.append(("{", name, number + 1, []))
                at += 1
        elif m[0] == "{":
            frames.append(("{", None, 1, []))
        elif m["name"].rstrip("*") in _BEGIN_OR_END:
            # Environments are rules of their own.
            frames.append((m[0], None, 1, []))
        else:
            if m["space"] and not _DROPPED.match(m["name"]):
                parts.append("~")
            frames.append((m[0], m["name"], 1, []))
    frames[-1][3].append(text[at:])
    return _flat([x for opened, _, _, parts in frames for x in (opened, parts)]) if changed else text


# Marks of structure at the beginning of a line, between two sentinels while a text is worked on.
_HEAD, _ITEM, _ROW = "heading", "list_item", "table_row"


def _mark(kind: str, body: str):
    return lambda m, s: f"{s}{kind}{s}" + m.expand(body).strip()


def _plain(body: str):
    return lambda m, s: m.expand(body)


def _cells(m: re.Match, s: str) -> str:
    cells = [re.sub(r"^[^\n|=]*=[^\n|]*\|(?!\|)", "", c).strip() for c in re.split(r"\|\||!!", m["x"])]
    return f"{s}{_ROW}{s}" + " | ".join(cells)


def _table(m: re.Match, s: str) -> str:
    rows = [line for k, line in enumerate(m[0].split("\n")) if k != 1]
    return "\n".join(f"{s}{_ROW}{s}" + " | ".join(c.strip() for c in line.strip().strip("|").split("|")) for line in rows)


def _each(where: Paired, text: str, rewrite) -> str:
    """The text with what stands between paired marks rewritten, marks included."""
    out, at = [], 0
    for a, b, x, y in where.finditer(text):
        out += [text[at:a], rewrite(text[x:y])]
        at = b
    return "".join(out) + text[at:] if out else text


# Rewriting rules in order: (language, pattern, rewriting of a match), or (language, None, rewriting of a text).
_RULES = [
    (HTML, _rx(r"<!--.*?(?:-->|\Z)", re.S), _plain("")),
    (HTML, _rx(r"<!DOCTYPE\b[^>]*>", re.I), _plain("")),
    (HTML, None, lambda text, s: _each(_SCRIPTS, text, lambda x: "")),
    (WIKI, _rx(rf"</?(?:{_wiki_names})\b[^<>]*>", re.I), _plain("")),
    # Tables.
    (MARKDOWN, _rx(r"^ {0,3}\|[^\n]*\|[ \t]*\n {0,3}\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*$(?:\n {0,3}\|[^\n]*\|[ \t]*$)*"), _table),
    (WIKI, _rx(r"^[:*]*\{\|[^\n]*\n?"), _plain("")),
    (WIKI, _rx(r"^\|\}[ \t]*\n?"), _plain("")),
    (WIKI, _rx(r"^\|-+[^\n|]*\n"), _plain("")),
    # Links, templates.
    (WIKI, _rx(r"^#REDIRECT:?[ \t]*\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]", re.I), _plain(r"\1")),
    (WIKI, None, lambda text, s: without_links(text)),
    (WIKI, None, lambda text, s: without_templates(text)),
    (MARKDOWN, _rx(r"!\[([^\[\]\n]*)\]\([^()\s]*(?:\([^()\s]*\))?[^()\n]*\)"), _plain(r"\1")),
    (MARKDOWN, _rx(r"(?<!!)\[([^\[\]\n]+)\]\((?:[^()\s]|\([^()\s]*\))+(?:[ \t]+[\"'][^\n\"']*[\"'])?\)"), _plain(r"\1")),
    (MARKDOWN, _rx(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*(?:\n|\Z)"), _plain("")),
    (MARKDOWN, _rx(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), _plain(r"\1")),
    (WIKI, _rx(r"\[(?:https?|ftp)://[^\s\[\]]+[ \t]+([^\[\]\n]+)\]"), _plain(r"\1")),
    (WIKI, _rx(rf"__(?:{'|'.join(MAGIC_WORDS.split())})__[ \t]*\n?"), _plain("")),
    (WIKI, _rx(r"(?<!~)~{4,5}(?!~)"), _plain("")),
    # Headings.
    (WIKI, _rx(r"^(={1,6})(?=[^=\n])(?=[^\n]*\w)([^\n]*[^=\n])\1[ \t]*$"), _mark(_HEAD, r"\2")),
    (MARKDOWN, _rx(r"^ {0,3}#{1,6}[ \t]+(\S[^\n]*)$"), lambda m, s: f"{s}{_HEAD}{s}" + m[1].rstrip().rstrip("#").rstrip()),
    (MARKDOWN, _rx(r"^(?=[^\n]*\w)([^\s\-=>#|][^\n]*)\n(?:={3,}|-{3,})[ \t]*$"), _mark(_HEAD, r"\1")),
    (LATEX, None, without_commands),
    (HTML, None, lambda text, s: _each(_HTML_HEADS, text, lambda x: f"{s}{_HEAD}{s}{x.strip()}")),
    # Lists and quotations. Deeper wiki lists and marked-up items are markup; lone stars and dashes are only structure.
    (WIKI, _rx(r"^(?!\*\*\*?[^\s*#:;][^\n]*\*\*)(?:[*#:;]{2,8})[ \t]*(?=[^\s*#:;])([^\n]*)$"), _mark(_ITEM, r"\1")),
    (HTML, _rx(r"\n?<li\b[^<>]*>(.*?)(?:</li>|(?=\n|<li\b|</[uo]l\b|\Z))", re.I), lambda m, s: f"\n{s}{_ITEM}{s}{m[1].strip()}"),
    (LATEX, _rx(r"^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*([^\n]*)$"), _mark(_ITEM, r"\1")),
    (MARKDOWN, _rx(r"^ {0,3}>[ \t]?(?=\S)"), _plain("")),
    # Table rows of HTML and of wiki text, the latter only where a table was opened.
    (HTML, _rx(r"<tr\b[^<>]*>", re.I), lambda m, s: f"\n{s}{_ROW}{s}"),
    (HTML, _rx(r"</t[dh]>[ \t]*<t[dh]\b[^<>]*>", re.I), _plain(" | ")),
    # Emphasis.
    (WIKI, None, lambda text, s: without_quotes(text)),
    (MARKDOWN, _rx(r"(?<![*\\\w])\*(?=[^*\s])([^*\n]*?[^*\s])\*(?![*\w])"), _plain(r"\1")),
    (MARKDOWN, _rx(r"(?<![*\\])(\*{2,3})(?=[^*\s])([^*\n]*?[^*\s])\1(?!\*)"), _plain(r"\2")),
    (MARKDOWN, _rx(r"(?<![*\\\w])\*(?=[^*\s])([^*\n]*?[^*\s])\*(?![*\w])"), _plain(r"\1")),
    (MARKDOWN, _rx(r"(?<!\w)(__?)(?=[^_\s])([^_\n]*?[^_\s])\1(?!\w)(?<![/=&?]_)"), _plain(r"\2")),
    (MARKDOWN, _rx(r"~~(?=[^~\s])([^~\n]*?[^~\s])~~"), _plain(r"\1")),
    # Other LaTeX.
    (LATEX, _rx(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*[ \t]*\n?"), _plain("")),
    (LATEX, _rx(r"(?<=[\s}])\\([&%#$_])(?!\w)"), _plain(r"\1")),
    # Other HTML.
    (HTML, _rx(r"<(?:br|hr|p|div|/p|/div|/tr|/table|/[uo]l|/dl|/blockquote)(?=[\s/>])[^<>]*>", re.I), _plain("\n")),
    (HTML, _rx(_TAG, re.I), _plain("")),
]
_ENTITY = _rx(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_WIKI_ROW = _rx(r"^[|!](?![}\-|])[ \t]*(?P<x>[^\n]*)$")
_LONE_ITEM = _rx(r"^[ \t]*(?:[*+\-]|\d{1,3}[.)])[ \t]+(?=\S)(?!-)")
_SENTINELS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def clean(text: str) -> tuple[str, list[tuple[str, int, int]], list[str]]:
    """(clean text, [(structure, begin, end)] as spans of it, languages found in order of their names)."""
    s, q = [c for c in _SENTINELS if c not in text][:2]
    kinds: set[str] = set()
    aside: list[tuple[str, str]] = []

    if not re.search(MAY_BE_MARKUP, text):
        return text, [], []
    work = text
    for kind, structure, where in _VERBATIM:
        out, at = [], 0
        for a, b, x, y in where.finditer(work):
            aside.append((structure, unescape(work[x:y]) if kind == HTML else work[x:y].strip("\n")))
            out += [work[at:a], f"{q}{len(aside) - 1}{q}"]
            at = b
        if out:
            kinds.add(kind)
            work = "".join(out) + work[at:]
    rows = "{|" in work
    for kind, pattern, rewrite in _RULES:
        before = work
        if pattern is None:
            work = rewrite(work, s)
            if work != before:
                kinds.add(kind)
            continue

        def put(m: re.Match) -> str:
            kinds.add(kind)
            return rewrite(m, s)

        work = pattern.sub(put, work)
        if rows and kind == WIKI and pattern.pattern.startswith(r"^\|-") and before:
            work = _WIKI_ROW.sub(lambda m: _cells(m, s), work)

    def entity(m: re.Match) -> str:
        if m[0][1] != "#" and m[0][1:] not in html5:
            return m[0]
        kinds.add(HTML)
        return unescape(m[0]).replace("\xa0", " ")

    work = _ENTITY.sub(entity, work)
    if not kinds:
        return text, [], []
    work = _LONE_ITEM.sub(f"{s}{_ITEM}{s}", work)

    spans, out, at = [], [], 0
    empty_before = {n for n, line in enumerate(text.split("\n")) if not line.strip()}
    for line in work.split("\n"):
        parts = line.split(s)
        structure = next((p for p in parts[1::2]), None) if len(parts) > 2 else None
        body = "".join(parts[0::2]) if structure else line
        if not body.strip() and (structure or not empty_before):
            continue
        begin, pieces = at, []
        chunks = body.split(q)
        for n, chunk in enumerate(chunks):
            if n % 2:
                what, content = aside[int(chunk)]
                spans.append((what, at, at + len(content)))
                chunk = content
            pieces.append(chunk)
            at += len(chunk)
        if structure:
            spans.append((structure, begin, at))
        out.append("".join(pieces))
        at += 1
    return "\n".join(out), sorted(spans, key=lambda x: (x[1], -x[2])), sorted(kinds)


def clean_markup(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, clean, structure, kinds) of each row whose text holds markup.

    structure: array of (kind, begin, end), spans of the clean text that are headings,
    list_items, code, table_rows or formulas. kinds: the languages found. Rows without markup, null
    and empty texts give no row (their text is clean as it is); repeated rows are each
    returned; other columns are ignored; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    structure = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            taken, texts, spans, kinds = [], [], [], []
            for row, value in enumerate(part.column(1).to_pylist()):
                cleaned, found, languages = clean(value)
                if languages:
                    taken.append(row)
                    texts.append(cleaned)
                    spans.append([{"kind": k, "begin": a, "end": b} for k, a, b in found])
                    kinds.append(languages)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(taken, pa.int64())), pa.array(texts, pa.string()), pa.array(spans, structure), pa.array(kinds, pa.list_(pa.string()))],
                names=["key", "clean", "structure", "kinds"],
            )

    rows = df.where(may_be_markup(F.col(text))).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, clean string, structure array<struct<kind string, begin int, end int>>, kinds array<string>"
    return rows.mapInArrow(batches, schema).withColumnRenamed("key", key)


def may_be_markup(text: Column) -> Column:
    """False only for null texts and those that no rule matches."""
    return F.coalesce(text.rlike(MAY_BE_MARKUP), F.lit(False))
