"""Canonical text, markup residue and personal information."""

import pytest
from pyspark.sql import functions as F

from runeframe.llm import canonical_text as CT
from runeframe.llm import markup as M
from runeframe.llm import personal as P

SAME = [("paragraph", "p\u0430ragr\u0430ph"), ("first", "\ufb01rst"), ("VII", "\u2166"), ("a b", "a\u00a0b"), ("coração", "corac\u0327a\u0303o"), ("mirror", "mir\u200bror"), ("the", "\uff54\uff48\uff45"), ("L-A.N", "L\u2010A\u2024N"), ("\u16a0-\u16a2", "\u16a0\uff0d\u16a2")]
DIFFERENT = [("page 2", "page \u00b2"), ("1", "\u2460"), ("Gate", "gate"), ("clé", "cle"), ("a b", "a  b"), ("a b", "a\nb"), ("wurde", "wurdz"), ("a.b", "a-b"), ("\u0434\u0430", "da")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_reading(a, b):
    assert CT.reading_form(a) == CT.reading_form(b) and CT.canonical_form(a) == CT.canonical_form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_reading(a, b):
    assert CT.reading_form(a) != CT.reading_form(b)


def test_canonical_form_folds_and_is_stable():
    for text in ("Straße \u2460 ﬁ", "ΑΒΓ", "ǅ", "\u0130x", " a\tb\u3000c "):
        once = CT.canonical_form(text)
        assert CT.canonical_form(once) == once
    assert CT.canonical_form("STRASSE") == CT.canonical_form("straße") and CT.canonical_form("x\u00b2") == "x2"


def test_pairs(spark, rows):
    texts = ["ok", "ok", "o\u200bk", "\u043ek", "OK", None, "", "\u200b", " ", "x" * 50_000 + "\u200d", "x" * 50_000]
    data = [("f", i, t, 1, 2) for i, t in enumerate(texts)] + [("g", 0, "o\u200bk", 1, 2)]
    df = spark.createDataFrame(data, "field string, id long, text string, salt int, form int")
    want = sorted((f, a, b) for f, a, s, *_ in data for g, b, t, *_ in data if f == g and a < b and s and t and s != t and CT.reading_form(s) == CT.reading_form(t) and CT.reading_form(s).strip())
    assert rows(CT.look_alike_pairs(df)) == want and len(want) == 6
    assert CT.look_alike_pairs(df.limit(0)).count() == 0


def test_words_keep_their_script():
    """Look-alikes are settled by the letters of the word that have none; the reading is the same whichever was typed."""
    russian, mixed = "привет", "приv\u0435т".replace("v", "в").replace("\u0435", "e")
    assert CT.reading_form(russian) == russian == CT.reading_form(mixed)
    assert CT.reading_form("Νίκος νέος") == "Νίκος νέος" and CT.reading_form("\u0441\u043e\u0440") == "cop"
    assert CT.reading_form("Αlpha приvет") == "Alpha приvет"


def test_classes(spark, rows):
    texts = ["Ok", "ok", "o\u200bk", "\u043ek", None, "", " \u200b", "x\u00b2", "x2", "y"]
    df = spark.createDataFrame([("f", i, t, 0, 0) for i, t in enumerate(texts)] + [("g", 0, "ok", 0, 0)], "field string, id long, text string, class_id int, salt int")
    ok, square = [("f", i, 0, 4, 2) for i in range(4)], [("f", i, 7, 2, 2) for i in (7, 8)]
    assert rows(CT.classes(df)) == sorted([*ok, *square, ("f", 9, 9, 1, 1), ("g", 0, 0, 1, 1)], key=repr)
    assert CT.classes(df.limit(0)).count() == 0


def test_canonical_column(spark):
    df = spark.createDataFrame([("A  b",), ("\uff21\u00a0B",), (None,), ("\u200b",)], "t string")
    assert [r[0] for r in df.select(CT.canonical(F.col("t"))).collect()] == ["a b", "a b", None, ""]


MARKED = ["<b>x</b>", "a<br/>b", "<!-- c -->", "&amp; more", "x&#39;y", "# Head\n\ntext", "**bold** x", "*soft* x", "__u__ x", "~~no~~", "`code(1)` x", "```python\nx = [1]\n```", "see [a b](https://x.example/1)", "![a](https://x.example/1.png)", "| a | b |\n|---|:--:|\n| 1 | c |", "== Head ==\ntext", "[[Link]]", "[[Category:X]]", "{{stub|x}}", "''soft'' x", "'''bold''' x", "{| class=wikitable\n|-\n! a !! b\n|}", r"\section{X}", r"a \cdot b", r"$c_i \equiv p_i$ holds", r"$$\sum_{i=1}^{5} x$$", r"\(p = 3\)", "\\begin{equation}\n x\n\\end{equation}", r"x.~\cite{y1}"]
PLAIN = ["", "plain", "{Attachments}\nhttps://files.x.example/a_b/c_d-1.png", "{Reactions}\n:corpus: (7) :eye: (5)", "1. one\n2. two", "- dashed\n- lines", "see #4989 and #photo", "keep n < 25 and k > 8", "if a == b then stop <3, really", r"saved under D:\variance\alphabet", "it cost me $5 and then $12 more", "the file is sample_totient_60", "12 * 21 * 15 is late", "f(x) = x^2 + 23, the R&D people", "[a, b] -> [9, 16]", "{threshold} in braces", "\u16c1\u16cb-\u16b1&\u16a3$\u16cf\u00a7", "tags: a | b | c", 'keys="a ""b""", \'c\'', "read it at 21@24", "3:1 ; 4 -2 [5, 6]"]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert M.constructs(text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert not M.constructs(text) and M.clean(text) == text


def test_clean_keeps_structure():
    page = "<h2>Notes</h2>\n<ul><li>one</li><li>two</li></ul><p>It's <b>bold</b> &amp; <i>soft</i></p><pre><code>for x</code></pre>"
    assert M.clean(page) == "## Notes\n- one\n- two\nIt's bold & soft\n```\nfor x\n```"
    assert M.clean("== Grid ==\n* [[Moth]]\n** ''soft'' [[A|the a]]") == "## Grid\n- Moth\n  - soft the a"
    assert M.clean("\\section{X}\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\emph{c} and $x_1$") == "# X\n- a\n- b\nc and $x_1$"
    assert M.clean("# T\n\n**a** [b](https://x.example) `c*d*e` ~~f~~") == "# T\n\na b `c*d*e` f"
    assert M.clean("| a | b |\n|---|---|\n| 1 | c |").split() == ["a", "b", "1", "c"]
    for text in MARKED:
        M.clean(text)


def test_navigation_goes_and_content_stays():
    nav = "\n".join(f"<a href='/{i}'>n{i}</a><a href='/x{i}'>m{i}</a>" for i in range(12))
    body = "\n".join(f"<p>{'A sentence of the article that goes on for a while. ' * 3}</p>" for _ in range(8))
    kept = M.clean(f"{nav}\n{body}\n{nav}")
    assert kept.count("sentence of the article") == 24
    assert "n5" not in kept and sum(f"m{i}" in kept.split() for i in range(12)) == 0


def test_tags_of_no_element_and_declarations_stay():
    for text in ("<foo>bar</foo>", "List<String> x</String>", "<?php echo 1; ?> y", "a </ x> b", "<!-x> b"):
        assert M.clean(text) == text and not M.constructs(text)
    assert M.clean("<![CDATA[a < b]]> <b>c</b>") == "a < b c"
    assert M.clean("say <script> now") == "say  now" and M.clean("a<script>x = 1</script>b") == "ab"
    assert M.clean('a <a title="x<y" href="/z">b</a>') == "a b"
    assert M.clean("a \x02 1\x03 <b>c</b>") == "a \x02 1\x03 c"


def test_code_is_held_from_every_notation():
    assert M.clean("<pre>*x* = y\n\n\n\nb = '''doc''' &lt; 1</pre>\n**c**") == "```\n*x* = y\n\n\n\nb = '''doc''' < 1\n```\n\nc"
    assert M.clean("<code>a *b* c</code> and `x_1_` <i>d</i>") == "`a *b* c` and `x_1_` d"
    assert M.clean("```\n<b>x</b> **y**\n\n\n\nz\n```\n*w*") == "```\n<b>x</b> **y**\n\n\n\nz\n```\nw"


def test_few_navigation_links_go_too():
    links = ["<a href='/'>Home</a>", "<a href='/b'>Board</a>", "<a href='/c'>Contact</a>"]
    text = "<p>The article says this at some length, as articles do.</p>\n<p>And it says one more thing.</p>"
    for nav in ("\n".join(links), " ".join(links)):
        kept = M.clean(f"{nav}\n{text}")
        assert "article says" in kept and "one more thing" in kept and "Home" not in kept and "Contact" not in kept
    assert M.clean("see <a href='/x'>the page</a>") == "see the page" and M.clean("\n".join(links)) == "Home\nBoard\nContact"


def test_lines_cluster_by_smoothed_ratio():
    assert M.threshold([1, 2, 1, 50, 52]) == 26 and M.threshold([]) == 0 and M.threshold([3]) == 3
    flat = M.smoothed([4.0] * 9)
    assert all(abs(v - 4) < 1e-9 for v in flat) and M.smoothed([0, 0, 10, 0, 0])[2] > M.smoothed([0, 0, 10, 0, 0])[1] > 0


BLOCKS = {
    "heading": ("# {a}", {"html": "<h1>{a}</h1>", "markdown": "# {a}", "wiki": None, "latex": "\\section{{{a}}}"}),
    "strong": ("the {a} is {b}", {"html": "<p>the <b>{a}</b> is <i>{b}</i></p>", "markdown": "the **{a}** is *{b}*", "wiki": "the '''{a}''' is ''{b}''", "latex": "the \\textbf{{{a}}} is \\emph{{{b}}}"}),
    "link": ("see {a} now", {"html": "<p>see <a href='/x'>{a}</a> now</p>", "markdown": "see [{a}](https://x.example/1) now", "wiki": "see [[Page|{a}]] now", "latex": None}),
    "list": ("- {a}\n- {b}", {"html": "<ul><li>{a}</li><li>{b}</li></ul>", "markdown": None, "wiki": "* {a}\n* {b}", "latex": "\\begin{{itemize}}\n\\item {a}\n\\item {b}\n\\end{{itemize}}"}),
    "code": ("`{a}*{b}*`", {"html": "<code>{a}*{b}*</code>", "markdown": "`{a}*{b}*`", "wiki": None, "latex": None}),
    "formula": ("${a}_1 = {b}^2$", {"html": None, "markdown": "${a}_1 = {b}^2$", "wiki": None, "latex": "\\({a}_1 = {b}^2\\)"}),
}


def test_generated_texts_come_out_clean():
    """Marked-up texts made from blocks whose clean text is known, in every notation, mixed with plain lines."""
    import random

    rnd, words = random.Random(11), "cipher lantern page index runes mirror totient orchard".split()
    for _ in range(300):
        source, want = [], []
        for _ in range(rnd.randint(1, 6)):
            clean, forms = rnd.choice(list(BLOCKS.values()))
            form = rnd.choice([f for f in forms.values() if f])
            a, b = rnd.sample(words, 2)
            source.append(form.format(a=a, b=b))
            want += clean.format(a=a, b=b).split("\n")
            if rnd.random() < 0.5:
                source.append(f"a plain line about {a} & {b} < 3")
                want.append(source[-1])
        # starred lines alone are no markup and stay as they are, a list either way
        got = [line.replace("* ", "- ", 1) if line.startswith("* ") else line for line in M.clean("\n".join(source)).split("\n") if line.strip()]
        assert got == want, source


def test_markup_rows(spark, rows):
    df = spark.createDataFrame([(1, "<b>x</b>", "z"), (2, None, "z"), (3, "", "z"), (4, "plain", "z"), (5, "<b>x</b>", "z"), (6, "y " * 60_000 + "**b** c", "z")], "id long, t string, field string")
    assert rows(M.find_markup(df, "id", "t", "body")) == [(1, "body"), (5, "body"), (6, "body")]
    assert M.find_markup(df.limit(0), "id", "t", "body").count() == 0
    assert [r["text"] for r in M.cleaned(df.where("id < 5"), "id", "t").orderBy("id").collect()] == ["x", None, "", "plain"]


NAMES = P.Gazetteer.of(["Brisco Oakenfurl", "Silvane Coldwater-Finn", None, "", "Mononym"])
FOUND = [
    ("mail owl48@mail.example now", "email"), ("OWL48@FOX.MAIL.EXAMPLE bounced", "email"), ("quill11 (at) post (dot) example please", "email"), ("a.b [at] post [dot] example", "email"), ("saffron.bell at solvers dot invalid please", "email"), ("fable33 @ post.invalid please", "email"), ("fl\u0456nt+x@m\u0430il.example", "email"), ("ow\u200bl@mail.example", "email"),
    ("call +1-821-555-0146 now", "phone"), ("(584) 555-0134 after six", "phone"), ("tel 869.555.0168 - 13 of", "phone"), ("+49 30 23125 329", "phone"), ("020 7946 0155", "phone"), ("01 99 00 62 39 after", "phone"), ("2715550148", "phone"), ("two seven one five five five zero one four eight", "phone"),
    ("it is 666-55-5778 here", "id_number"), ("social security 666 57 8427", "id_number"), ("QQ 37 26 98 C", "id_number"), ("QQ944057A here", "id_number"), ("passport X8008071.", "id_number"), ("ID number 04156079M", "id_number"),
    ("at 16 Juniper Lane; so", "street_address"), ("Apt 26, 208a Quarry Close, Oxmere", "street_address"), ("to 105 rue des Mésanges.", "street_address"), ("Calle del Olmo 227 instead", "street_address"), ("Gartenstraße 122", "street_address"), ("Lindenweg 213 - we", "street_address"),
    ("I asked Brisco Oakenfurl about", "person_name"), ("BRISCO K. OAKENFURL", "person_name"), ("met T. Oakenfurl at", "person_name"), ("signed, Coldwater-Finn, Silvane", "person_name"), ("brisco oakenfurl and I", "person_name"), ("Bris\u0441o Oakenfurl", "person_name"),
]
CLEAR = ["", "Oakenfurl and I split the pages", "Brisco is here", "@vectormason look at line 93138", "read it at 21@24 on the grid", "https://files.crow-walker.example/6123497/a.png", "the digest is 52eb6a5d91991e0304691d445fff06bac5a0b971420ff910f733b8d355d4250a", "coordinates 37.8163, -7.5503 again", "93099483074287 is not prime", "rows 524 748 337 and 256 298 434 have equal sums", "version 9.17.49 from 2014-10-10", "05 12 24 18 20", "17 , 3 , 4 23 , 18 4,, 5/1:18,, 4, 26", "19-21-23-27-2-14-8", "there are 39 lanes in the maple drawing", "brisco_oakenf handle", "one two three four"]


@pytest.mark.parametrize("text,kind", FOUND)
def test_personal_information_is_found(text, kind):
    assert [k for *_, k in P.Finder(NAMES)(text)] == [kind]


@pytest.mark.parametrize("text", CLEAR)
def test_harmless_look_alikes(text):
    assert P.Finder(NAMES)(text) == []


BEYOND = ["my name is Maria Kowalski by the way", "thanks Jörg Müller", "signed, Müller, Jörg", "Maria K. Berg and I split the pages", "I asked M. Kowalski about it", "met JÖRG MÜLLER at the fair", "my name is brisco berglund by the way", "as Dr. Ada Lovelace-Byron put it"]
NOT_BEYOND = ["thanks Everybody", "And Iron Doors", "met at Quiet Well", "that was Section Two", "signed, sealed, delivered", "my name is not important here", "met someone there", "the Silent Orchard solved nothing", "by Monday Evening"]


@pytest.mark.parametrize("text", BEYOND)
def test_names_beyond_the_gazetteer(text):
    assert [k for *_, k in P.Finder(NAMES)(text)] == ["person_name"]


@pytest.mark.parametrize("text", NOT_BEYOND)
def test_no_names(text):
    assert P.Finder(NAMES)(text) == []


def test_held_out_names_are_found():
    """Half of the given and half of the family names are taken away; nine in ten of the names are still found."""
    import random

    rnd = random.Random(12)
    given, family = ["".join(rnd.choice(["ba", "lo", "ri", "ne", "tu", "ka"]) for _ in range(3)).title() for _ in range(40)], ["".join(rnd.choice(["fel", "mor", "stan", "wick", "dren"]) for _ in range(2)).title() for _ in range(25)]
    half = P.Finder(P.Gazetteer(frozenset(g.lower() for g in given[::2]), frozenset(f.lower() for f in family[::2])))
    frames = ["my name is {} by the way", "signed, {}", "thanks {}", "met {} at the library", "I asked {} about it", "all credit to {} for it", "the scan is by {}.", "{} solved this", "so {} and I split the pages", "that was {}, not me"]
    found = total = 0
    for _ in range(600):
        g, f = rnd.choice(given), rnd.choice(family)
        name = rnd.choice([f"{g} {f}", f"{g} {f}", f"{g} L. {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{g} {f}".lower()])
        total += 1
        found += [k for *_, k in half(rnd.choice(frames).format(name))] == ["person_name"]
    assert found >= 0.9 * total


def test_signatures():
    find = P.Finder(P.Gazetteer(frozenset(), frozenset()), signatures=True)
    for name in ("Maria Berg", "maria berg", "M. Berg", "Berg, Maria", "Maria K. Berg (pinned)", " MARIA BERG "):
        assert [k for *_, k in find(name)] == ["person_name"], name
    for handle in ("owl48", "rune.mason", "harp_98", "", "x y", "bot-x", "fox (pinned)"):
        assert find(handle) == [], handle


def test_long_names():
    """No window around a family name: a given name of any length is seen."""
    long = "B" + "ri" * 50
    names = P.Gazetteer(frozenset([long.lower()]), frozenset(["oakenfurl"]))
    for text in (f"so {long} oakenfurl left", f"so oakenfurl, {long} left"):
        assert [k for *_, k in P.Finder(names)(text)] == ["person_name"]


def test_redaction_keeps_the_rest():
    find = P.Finder(NAMES)
    text = "ｓｏ ow\u200bl [at] mail [dot] example or T. Oakenfurl, 01 99 00 62 39; runes 5 12 24"
    assert P.redact(text, find(text)) == "ｓｏ [EMAIL] or [PERSON_NAME], [PHONE]; runes 5 12 24"


def test_personal_rows(spark, rows):
    df = spark.createDataFrame([(1, "a@b.example and a@b.example", 0), (2, None, 0), (3, "", 0), (4, "a@b.example and a@b.example", 0), (5, "z " * 60_000 + "2715550148", 0)], "id long, t string, kind int")
    assert rows(P.find_kinds(df, "id", "t", "body", NAMES)) == [(1, "body", "email"), (4, "body", "email"), (5, "body", "phone")]
    assert P.find_kinds(df.limit(0), "id", "t", "body", P.Gazetteer.of([])).count() == 0
    assert [r["text"] for r in P.redacted(df.where("id < 4"), "id", "t", NAMES).orderBy("id").collect()] == ["[EMAIL] and [EMAIL]", None, ""]
