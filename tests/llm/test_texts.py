import random
import time

import numpy as np
import pytest

from strandline.llm import encoding, markup, names


def garbled(text, *pairs):
    for a, b in pairs:
        raw = text.encode(a)
        text = "".join(bytes([x]).decode(b, "replace") if bytes([x]).decode(b, "ignore") else chr(x) for x in raw) if b == "cp1252" else raw.decode(b, "replace")
    return text


GERMAN = "Für 3007 Gäste wäre die schöne Küche über dem Fluß zu eng, sagt Jürgen, während Käthe Äpfel schält."
QUOTES = "It’s 24 °C in the café, “warmer” than June – we’ve paid €12 for a naïve façade … and a résumé."
POLISH = "Źrebię śpi pod jabłonią, a żółty ptak śpiewa już od świtu, choć pada deszcz."


@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("text", [GERMAN, QUOTES, POLISH])
def test_round_trip(text, read_as):
    bad = garbled(text, ("utf-8", read_as))
    fixed, undone = encoding.restore(bad)
    assert undone and fixed == text


def test_double_and_single_byte():
    for text in (GERMAN, QUOTES):
        assert encoding.restore(garbled(text, ("utf-8", "cp1252"), ("utf-8", "cp1252")))[0] == text
        fixed, undone = encoding.restore(garbled(text, ("cp1252", "mac_roman")))
        assert undone == ["cp1252 as mac_roman"] and sum(a != b for a, b in zip(fixed, text)) <= 6


@pytest.mark.parametrize("text", [GERMAN, QUOTES, POLISH, "", "plain", "São Luís 21: «SÃO JOÃO» kostet £80 © 39, ¿no? ±4.", "Музей Riga №14, Σταθμός 89, phố 12, Île 3.", "├── src_2\n└── lib_8 √14 ≈ 3.7", "À Lyon, où l’on a dit « déjà »", "日本語のテキスト", "¿Quién contó la señal?", "naive cafe", "Über Ärger"])
def test_clean_texts_stay(text):
    assert encoding.restore(text) == (text, [])


def test_lost_and_mixed():
    text = QUOTES + " " + garbled(GERMAN, ("utf-8", "cp1252")) + " l�st"
    fixed, undone = encoding.restore(text)
    assert fixed == QUOTES + " " + GERMAN + " l�st" and set(undone) == {"utf-8 as cp1252", encoding.LOST}


def test_encoding_edges(spark):
    bad = garbled(GERMAN, ("utf-8", "cp1252"))
    df = spark.createDataFrame([("a", bad, "x"), ("b", None, "x"), ("c", "", "x"), ("d", GERMAN, "x"), ("a", bad, "y"), (None, "l�st", "x"), ("e", bad * 60, "x")], "rev string, text string, key string")
    got = sorted(((r.rev, r.restored, r.complete) for r in encoding.repair_encoding(df, key="rev", text="text").collect()), key=str)
    assert got == sorted([("a", GERMAN, True), ("a", GERMAN, True), (None, "l�st", False), ("e", GERMAN * 60, True)], key=str)
    assert encoding.repair_encoding(df.limit(0), key="rev", text="text").count() == 0


@pytest.mark.parametrize(
    ("text", "kinds", "clean"),
    [
        ("x <b>bold</b> &amp; y<br/>z", ["html"], "x bold & y\nz"), ("<!-- gone -->kept &#8220;q&#8221;", ["html"], "kept “q”"), ("<UL><LI>one<LI>two</UL>", ["html"], "one\ntwo"),
        ("<pre><code>a &lt; b\n  c</code></pre>", ["html"], "a < b\n  c"), ("## head 1\n- **a** item\n- b", ["markdown"], "head 1\na item\nb"), ("see [the text](https://x.example/1) ok", ["markdown"], "see the text ok"),
        ("```python\nx = 1 * 2\n```\nend", ["markdown"], "x = 1 * 2\nend"), ("| a | b |\n|---|:-:|\n| 1 | 2 |\nrest", ["markdown"], "a | b\n1 | 2\nrest"), ("a [b c][12] d\n\n[12]: https://x.example/r", ["markdown"], "a b c d\n\n"),
        ("== head ==\ntext '''bold''' ''it''", ["wiki"], "head\ntext bold it"), ("[[Page|shown]] {{tpl|a=1}}and [[Category:X y]] end", ["wiki"], "shown and end"), ("{| class=\"t\"\n|-\n! h\n|-\n| 1 || two\n|}\nrest", ["wiki"], "h\n1 | two\nrest"),
        ("* a\n** b", ["wiki"], "a\nb"), (r"\section{Big} text \emph{x} \& y~\cite{k1}", ["latex"], "Big text x & y"), ("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\nrest", ["latex"], "one\ntwo\nrest"),
        (r"so $x_{1}^2 + 4 \leq y$ holds", ["latex"], r"so x_{1}^2 + 4 \leq y holds"), (r"at \(\frac{1}{n_0}\) <i>it</i>", ["html", "latex"], r"at \frac{1}{n_0} it"),
    ],
)
def test_markup(text, kinds, clean):
    got, spans, found = markup.clean(text)
    assert (got, found) == (clean, kinds)
    assert all(0 <= a <= b <= len(got) for _, a, b in spans)


@pytest.mark.parametrize("text", ["", "plain", "If a < 6 and b > 5 then R&D at X keeps 2 * 3 * 4.", "Costs rose from $24 to $60 per unit [sic] [3].", "The path C:\\temp\\new_x holds snake_case_1 and array[2] from C#.", "#12 and #60 were closed; {set} 93 stays ~44.", "See https://x.example/wiki?rev=8&view=diff_a_b", "* lone star", "- lone dash\n-- Ada_L", "a_b c_d, 'quoted' and ''", "x -- y -- z", "1. first", "~100 *"])
def test_no_markup(text):
    assert markup.clean(text) == (text, [], [])


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("{{Infobox|a={{b|c}}|d}} text", " text"), ("{{{1|x}}} y {{a|{{{2}}}}} z", " y  z"), ("[[File:x.png|thumb|A [[link]] caption]]", "A link caption"), ("a [[b] c [[d|e]]", "a [[b] c e"),
        (r"\textbf{a \emph{b} c}", "a b c"), (r"so \frac{a}{b} is", "so a/b is"), (r"\href{https://x.example}{shown} and \textcolor{red}{word}", "shown and word"), (r"\section{A \emph{b}} rest", "A b rest"),
        ("**bold *nested* text**", "bold nested text"), ("*a **b** c* d", "a b c d"), ("::reply\nx", "reply\nx"), ("''a '''b''' c'' d", "a b c d"), ("{a {b} c} {{x}}", "{a {b} c} "),
    ],
)
def test_nested_markup(text, clean):
    assert markup.clean(text)[0] == clean


def test_filter_accepts_what_rules_match():
    """No text on which a rule fires is kept from it."""
    import re
    from unittest import mock

    r, pieces = random.Random(3), ["<b>", "</b>", "[[a]]", "{{t}}", "''", "**", "_x_", "~~~~", "`c`", "# h", "== h ==", "::", ";;", "\\emph{a}", "$x^2$", "| a | b |", "|---|---|", "---", "> q", "&amp;", "\n", " ", "word", "[a](b)", ":", "*"]
    texts = ["".join(r.choices(pieces, k=r.randint(1, 5))) for _ in range(3_000)]
    with mock.patch.object(markup, "MAY_BE_MARKUP", ""):
        found = [markup.clean(x)[2] for x in texts]
    assert all(re.search(markup.MAY_BE_MARKUP, x) for x, kinds in zip(texts, found) if kinds)


def test_structure_spans():
    got, spans, _ = markup.clean("# Head\n- item `code x`\ntext $a_{1}$")
    assert [(k, got[a:b]) for k, a, b in spans] == [("heading", "Head"), ("list_item", "item code x"), ("code", "code x"), ("formula", "a_{1}")]


def test_markup_edges(spark):
    df = spark.createDataFrame([("a", "<b>x</b>", "k"), ("b", None, "k"), ("c", "", "k"), ("a", "<b>x</b>", "k"), (None, "''i''", "k")], "rev string, text string, kinds string")
    assert sorted(((r.rev, r.clean) for r in markup.clean_markup(df, key="rev", text="text").collect()), key=str) == [("a", "x"), ("a", "x"), (None, "i")]
    assert markup.clean_markup(df.limit(0), key="rev", text="text").count() == 0
    long = ("[[", "{{", "{{{", "<pre>", "<code>", "<script>", "<math>", "<nowiki>", "<h1>", "\\begin{verbatim}", "\\begin{equation}", "\\[", "\\(", "\\textbf{", "''a", "'''a''b ", "{", "<!--")
    for unit in long:
        began = time.time()
        markup.clean(unit * (100_000 // len(unit)))
        assert time.time() - began < 5, unit
    for text in ("{" * 50_000 + "}" * 50_000, "{{" * 30_000 + "}}" * 30_000, "\\textbf{" * 10_000 + "}" * 10_000, "[[" * 20_000 + "]]" * 20_000):
        began = time.time()
        markup.clean(text)
        assert time.time() - began < 5, text[:8]
    for unit in ("[[a", "**a", "<a ", "''a", "{{a", "= a ", "# " + " " * 50, "\\a{", "|a", "`a", "$a", "a_", "~~a", "<!--", "<li> "):
        markup.clean(unit * 4000)


@pytest.mark.parametrize(("name", "want"), [("Dr. O. Ditopamo", ("p", "ditopamo", ("o",))), ("Pijagkai, Iggy", ("p", "pijagkai", ("iggy",))), ("PelifufuFrederike", ("p", "pelifufu", ("frederike",))), ("KostjaFawasijiAug26Agent", ("p", "fawasiji", ("kostja",))), ("NehemefuFeb27", ("p", "nehemefu", ())), ("terisiti.k", ("p", "terisiti", ("k",))), ("ALEXANDRA PUNUJOZA", ("p", "punujoza", ("alexandra",))), ("Harbour Safety Institute of Dawobula", ("o", "dawobula", ("harbour", "institute", "safety"))), ("Lalofesi Institute f. Rive. Lev.", ("o", "lalofesi", ("institute", "levels", "river"))), ("CiretaguOHS", ("o", "ciretagu", ("o", "h", "s"))), ("bovehumu-fss", ("o", "bovehumu", ("f", "s", "s")))])
def test_parse(name, want):
    assert names.parse(name)[0] == want


def test_edits_and_deletions():
    r = random.Random(8)
    for _ in range(2000):
        a = "".join(r.choices("abc", k=r.randint(1, 7)))
        b = list(a)
        k = r.randrange(len(b))
        x = r.randrange(4)
        if x == 0:
            b.insert(k, "c")
        elif x == 1:
            del b[k]
        elif x == 2:
            b[k] = "b"
        elif k:
            b[k - 1], b[k] = b[k], b[k - 1]
        b = "".join(b)
        assert names.edits(a, b) <= 1 and set(names.deletions(a)) & set(names.deletions(b))


def test_link_names(spark):
    rows = [
        (1, "Ottilie Vurunule", "f", None), (2, "Vurunule, Tilly", "f", None), (3, "VurunuleMay07", "f", None), (4, "ovurunule", None, "f:2"), (5, "O. Vurunuel", "f", None), (6, "Gregory Vurunule", "g", None), (7, "G. Vurunule", None, None),
        (8, "Harbour Safety Bureau of Celecamo", "f", None), (9, "CelecamoBHS", None, None), (10, "Celecamo Bureau for Tidal Data", "f", None), (11, "The Celecako Harbour Safety Bureau", "f", None),
        (12, None, "f", None), (13, "", "f", None), (14, "  ", None, None), (15, "K. Hanuviza", "f", None), (16, "HanuvizaKJan28", "f", None), (1, "Ottilie Vurunule", "f", None), (17, "???", "f", None), (18, "x" * 5000, "f", None), (None, "Ottilie Vurunule", "f", None),
    ]
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], "e") for r in rows], "id int, name string, fam string, families string, entity string")
    linked = names.link_names(df, key="id", name="name", family="fam", families="families")
    groups = {}
    for r in linked.collect():
        groups.setdefault(r.entity, set()).add(int(r.id))
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[1, 2, 3, 4, 5], [6, 7], [8, 9, 11], [15, 16]]
    assert sum(map(len, groups.values())) == 18
    assert names.link_names(df.limit(0), key="id", name="name", family="fam", families="families").count() == 0


def test_encoding_of_texts_that_stand_well(spark):
    """Garbled Cyrillic and Chinese whose every character stands well beside its neighbours; and clean ones that stay."""
    cases = {}
    for k, word in enumerate(("город", "дом", "вино")):
        cases[f"c{k}"] = (f"a {word.encode().decode('cp1251')} b", f"a {word} b", "utf-8 as cp1251")
    bad = "东京".encode().decode("gbk")
    assert all(0x4E00 <= ord(c) < 0xA000 for c in bad)
    cases["g"] = (f"see {bad} here", "see 东京 here", "utf-8 as gbk")
    for bad, good, pair in cases.values():
        assert encoding.restore(bad) == (good, [pair])
    lost = "see " + encoding.GBK_LOST * 2 + " here"
    assert encoding.restore(lost) == (lost, [encoding.LOST])
    clean = ["Он жил в городе, где пили вино. Россия и Сибирь", "中文维基百科是一个自由的百科全书", "Größe, Élan, café Ünïcode", "东京 大阪"]
    assert all(encoding.restore(t) == (t, []) for t in clean)
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()] + [("lost", lost)] + [(f"z{i}", t) for i, t in enumerate(clean)], "rev string, text string")
    got = {r.rev: (r.restored, r.complete) for r in encoding.repair_encoding(df, key="rev", text="text").collect()}
    assert got == {k: (v[1], True) for k, v in cases.items()} | {"lost": (lost, False)}


def test_encoding_garbled_many_times():
    for times in (1, 4, 6, 8):
        fixed, undone = encoding.restore(garbled(GERMAN, *[("utf-8", "cp1252")] * times))
        assert fixed == GERMAN and undone == ["utf-8 as cp1252"]


def test_encoding_stretches_equal_whole_texts(monkeypatch):
    """The stretches that reach the model give the labels that decoding every character gives."""
    parts = [GERMAN, QUOTES, "Он жил в городе, где пили вино.", "中文维基百科", "l�st", garbled(QUOTES, ("utf-8", "cp1252")), garbled("вино и дом", ("utf-8", "cp1251")), garbled(GERMAN, ("cp1252", "mac_roman")), encoding.GBK_LOST, "plain", "東京".encode().decode("gbk", "ignore")]
    rng = random.Random(5)
    texts = [" ".join(rng.sample(parts, rng.randint(1, 5))) for _ in range(60)]
    got = encoding.restore_all(texts)
    assert got == [encoding.restore(x) for x in texts]
    monkeypatch.setattr(encoding.Places, "torn", lambda self: np.ones(len(self.at), bool))
    assert got == encoding.restore_all(texts)


def test_assignment_against_all_permutations():
    import itertools

    r = np.random.default_rng(2)
    for _ in range(300):
        n = int(r.integers(1, 6))
        m = int(r.integers(n, 7))
        cost = np.where(r.random((n, m)) < 0.2, 1e9, r.integers(0, 9, (n, m)).astype(float))
        want = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert abs(names.assigned(cost) - want) < 1e-6 * max(1, want)


def test_long_names():
    words = tuple(f"word{chr(97 + i)}{'xyz' * i}" for i in range(12))
    assert names.alignment(words, tuple(reversed(words)), 10.0) == 0 and names.alignment(words, (*words[:11], words[11] + "q"), 10.0) < 2
    assert names.alignment(words, words[:11] + ("other",), 10.0) == float("inf")
    for n in (39, 40, 41, 42, 43, 80, 5_000):
        token = ("abcdefghij" * 600)[:n]
        for other in (token + "k", token[1:], token[: n // 2] + "z" + token[n // 2 :], token[: n // 2] + token[n // 2 + 1 :], token[: n - 2] + token[n - 1] + token[n - 2], "z" + token[1:]):
            assert names.edits(token, other) == 1 and set(names.deletions(token)) & set(names.deletions(other)), (n, other[:5])
        assert names.edits(token, token[5:]) == 3


def test_other_scripts(spark):
    rows = [(1, "Иван Петров", "f"), (2, "иван петров", "f"), (3, "Søren Kjeldsen", "f"), (4, "Soren Kjeldsen", "f"), (5, "王小明", "f"), (6, "王小明", "f"), (7, "Łukasz Wałęsowski", "f"), (8, "Lukasz Walesowski", "f"), (9, "王小", "f")]
    df = spark.createDataFrame(rows, "id int, name string, fam string")
    groups = {}
    for r in names.link_names(df, key="id", name="name", family="fam").collect():
        groups.setdefault(r.entity, set()).add(int(r.id))
    assert sorted(sorted(g) for g in groups.values()) == [[1, 2], [3, 4], [5, 6], [7, 8], [9]]
