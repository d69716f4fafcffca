"""Markup residue: clean text from HTML, Markdown, wiki and LaTeX with its structure kept.

A text is read once. Code and formulas are held aside as they are; the rest runs through the
standard library's streaming parser, whose events give the HTML constructs (an exact check on an
event's source follows) and the text between them; the other notations give theirs by one pattern
each. Every construct is a mark on its line. Rows with markup are the rows with marks. For clean
text, the ratio of text to marks per line is smoothed with a Gaussian and split into two clusters by
the threshold between them: regions of links in the low cluster are navigation and go, the content
stays, whatever the size of the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element names of HTML that count as markup.
ELEMENTS = frozenset(
    """a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del
    details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i
    iframe img input ins kbd label legend li link main map mark math meta nav noscript object ol optgroup option p param
    picture pre q ref nowiki s samp script section select small source span strike strong style sub summary sup svg table
    tbody td template textarea tfoot th thead time title tr tt u ul var video wbr references gallery""".split()
)
BLOCKS = frozenset("p div section article header footer main aside nav table tr ul ol dl dt dd blockquote figure hr form body html".split())
SKIPPED = frozenset(("script", "style"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose text leads elsewhere.
LEADING = frozenset(("a", "nav"))
#: Block names the export itself writes.
EXPORT_BLOCKS = ("{Attachments}", "{Embed}", "{Reactions}", "{Stickers}")

TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*|/)?\s*/?>|<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>", re.S | re.I)
#: A tag whose attributes are quoted may hold angle brackets inside the quotes.
QUOTED_TAG = re.compile(r"""</?([A-Za-z][A-Za-z0-9]*)(?:\s(?:[^<>"']|"[^"]*"|'[^']*')*|/)?\s*/?>""")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
WORDY = r"[^\W_]"
FENCE = re.compile(r"^[ \t]*(```+|~~~+)[ \t]*([\w+-]*)[ \t]*$", re.M)
MARKDOWN = {
    "md_heading": re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t#]*$", re.M),
    "md_code": re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)"),
    "md_image": re.compile(r"!\[([^\]\n]*)\]\(([^()\s]+(?:\s\"[^\"]*\")?)\)"),
    "md_link": re.compile(r"(?<!!)\[([^\[\]\n]+)\]\((?:https?://|www\.|/|#|mailto:)[^()\s]*(?:\s\"[^\"]*\")?\)|(?<!!)\[([^\[\]\n]+)\]\[[^\[\]\n]*\](?=$|[\s.,;:!?])(?!\S)|^\[[^\]\n]+\]:\s+https?://\S+"),
    "md_strong": re.compile(r"(?<![*\w])\*\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*\*(?![*\w])"),
    "md_strong_": re.compile(r"(?<![_\w])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![_\w])"),
    "md_emphasis": re.compile(r"(?<![*\w\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![*\w])"),
    "md_emphasis_": re.compile(r"(?<![_\w\\/:])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![_\w])"),
    "md_strike": re.compile(r"(?<!~)~~(?=[^\s~])([^\n]+?)(?<=[^\s~])~~(?!~)"),
    "md_table": re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M),
    "md_quote": re.compile(r"^>[ ]?(?=[^\s>\d])(.*)$", re.M),
    "md_setext": re.compile(r"^(\w.*)\n(?:={3,}|-{3,})[ \t]*$", re.M),
}
WIKI = {
    "wiki_heading": re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M),
    "wiki_link": re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]"),
    "wiki_external": re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ ]+([^\]\n]+)\]"),
    "wiki_template": re.compile(r"\{\{[^{}\n]+\}\}"),
    "wiki_table": re.compile(r"^\{\|.*$|^\|\}[ \t]*$|^\|-[ \t]*$", re.M),
    "wiki_bold": re.compile(r"'''(?=[^\s'])([^\n]+?)(?<=[^\s'])'''(?!')"),
    "wiki_italic": re.compile(r"(?<!')''(?=[^\s'])([^'\n]+?)(?<=[^\s'])''(?!')"),
}
#: LaTeX commands that stand without braces.
BARE_COMMANDS = """alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi chi psi omega Gamma Delta Theta Lambda
Sigma Phi Psi Omega cdot cdots ldots dots times div pm mp leq geq neq approx equiv sim in notin subset cup cap forall exists
infty partial nabla sum prod int oint lim log ln sin cos tan to rightarrow leftarrow Rightarrow mapsto quad qquad item
newline linebreak noindent maketitle centering hline left right mod bmod oplus otimes circ bullet ell hbar""".split()
LATEX = {
    "tex_environment": re.compile(r"\\(?:begin|end)\{([A-Za-z]+\*?)\}"),
    "tex_display": re.compile(r"\$\$(?=\S)[^$]+?\$\$|\\\[(?!\s*\])[^\n]+?\\\]"),
    "tex_inline": re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_=<>+A-Za-z])(?!\d+(?:[.,]\d+)?(?:[\s.,;!?)]|$))[^$\n]*?(?<=[^\s$\\])\$(?![\d$\w])|\\\((?!\s*\\\))[^\n]+?\\\)"),
    "tex_command": re.compile(r"(?<![A-Za-z0-9:\\/._-])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"),
    "tex_bare": re.compile(r"(?<![A-Za-z0-9:\\/._-])\\(?:" + "|".join(BARE_COMMANDS) + r")(?![A-Za-z\\])"),
    "tex_cite": re.compile(r"~\\(?:cite|ref|eqref)\{[^{}\n]*\}"),
}
#: A text without any of these characters has no construct.
SUSPECT = r"[<&*_`\[{$\\~#|=>]|''|---"

FORMULA = re.compile("|".join(f"(?:{LATEX[k].pattern})" for k in ("tex_display", "tex_inline")))
FENCED = re.compile(r"^[ \t]*(```+|~~~+)[ \t]*([\w+-]*)[ \t]*\n(.*?)\n[ \t]*\1[ \t]*$", re.S | re.M)
EQUATION = re.compile(r"\\begin\{(equation|align|gather|displaymath)\*?\}(.*?)\\end\{\1\*?\}", re.S)
HELD = re.compile("\x02(\\d+)\x03")


class _Events(HTMLParser):
    """The parser's events as ``(offset, kind, name)``; what lies between two offsets is the source of the first."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.events: list[tuple[int, str, str]] = []
        self.feed(text)
        self.close()

    def _note(self, kind: str, name: str = "") -> None:
        line, column = self.getpos()
        self.events.append((self.starts[line - 1] + column, kind, name))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._note("open", tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._note("open", tag)

    def handle_endtag(self, tag: str) -> None:
        self._note("close", tag)

    def handle_data(self, data: str) -> None:
        self._note("data")

    def handle_comment(self, data: str) -> None:
        self._note("comment")

    def handle_decl(self, decl: str) -> None:
        self._note("comment")

    def handle_pi(self, data: str) -> None:
        self._note("data")

    def unknown_decl(self, data: str) -> None:
        self._note("cdata")

    def handle_entityref(self, name: str) -> None:
        self._note("entity", name)

    def handle_charref(self, name: str) -> None:
        self._note("entity", "#" + name)


@dataclass
class Reading:
    """What one pass over a text found.

    ``text``: the text with code and formulas held aside; ``held``: those; ``marks``: offset and
    name of each construct; ``pieces``: line and output of the parser's pass, None without HTML.
    """

    text: str
    held: list[str] = field(default_factory=list)
    marks: list[tuple[int, str]] = field(default_factory=list)
    pieces: list[tuple[int, str]] | None = None
    link_text: dict[int, int] = field(default_factory=dict)
    plain_text: dict[int, int] = field(default_factory=dict)
    links: dict[int, int] = field(default_factory=dict)

    def hold(self, value: str) -> str:
        self.held.append(value)
        return f"\x02{len(self.held) - 1}\x03"

    def released(self, text: str) -> str:
        while HELD.search(text):
            text = HELD.sub(lambda m: self.held[int(m[1])], text)
        return text.replace("\x04", "\x02")


def _is_entity(source: str) -> bool:
    m = ENTITY.fullmatch(source)
    return bool(m) and (source[1] == "#" or source[1:] in html5)


def _is_tag(source: str) -> bool:
    m = TAG.fullmatch(source) or QUOTED_TAG.fullmatch(source)
    return bool(m) and (m[1] or "").lower() in ELEMENTS


def read(text: str) -> Reading:
    """Reads a text: its marks, and the output of its HTML."""
    seen = Reading(text)
    if "\x02" in text:
        seen.text = text = text.replace("\x02", "\x04")

    def aside(pattern: re.Pattern[str], name: str, form) -> None:  # noqa: ANN001
        def one(m: re.Match[str]) -> str:
            seen.marks.append((m.start(), name))
            return seen.hold(form(m))

        seen.text = pattern.sub(one, seen.text)

    if "```" in text or "~~~" in text:
        seen.marks += ((m.start(), "md_fence") for m in FENCE.finditer(text))
        aside(FENCED, "md_fence", lambda m: f"```{m[2]}\n{m[3]}\n```")
    if "`" in text:
        aside(MARKDOWN["md_code"], "md_code", lambda m: f"`{m[2]}`")
    if "\\" in text or "$" in text:
        aside(EQUATION, "tex_environment", lambda m: f"$${m[2].strip()}$$")
        aside(FORMULA, "tex_formula", lambda m: "$" + m[0][2:-2] + "$" if m[0].startswith("\\(") else m[0])
    for name, pattern in (*MARKDOWN.items(), *WIKI.items(), *(LATEX.items() if "\\" in text or "$" in text else ())):
        seen.marks += ((m.start(), name) for m in pattern.finditer(seen.text))
    if "<" in text or "&" in text:
        _read_html(seen)
    return seen


def _read_html(seen: Reading) -> None:
    """The parser's events: marks, and lines of text with headings, lists, tables and code marked."""
    text = seen.text
    parser = _Events(text)
    low = text.lower()
    out: list[tuple[int, str]] = []
    code: list[str] | None = None  # text of an open pre or code element
    lists: list[list] = []
    skip = lead = pre = 0
    bounds = [e[0] for e in parser.events[1:]] + [len(text)]

    def line_end(line: int) -> None:
        if out and not out[-1][1].endswith("\n"):
            out.append((line, "\n"))

    def put(line: int, data: str) -> None:
        if code is not None:
            code.append(data)
        elif not skip and (data.strip() or "\n" not in data or not out or not out[-1][1].endswith("\n")):  # no white space between blocks
            for k, part in enumerate(data.splitlines(True) if "\n" in data else [data]):
                out.append((line + k, part))
                sizes = seen.link_text if lead else seen.plain_text
                sizes[line + k] = sizes.get(line + k, 0) + len("".join(part.split()))

    for (at, kind, name), end in zip(parser.events, bounds):
        source, line = text[at:end], bisect_right(parser.starts, at) - 1
        if kind == "open" and name in SKIPPED:
            source = text[at : text.index(">", at) + 1] if ">" in source else source
        if kind == "entity":
            if _is_entity(source):
                seen.marks.append((at, "html_entity"))
                put(line, unescape(source))
            else:
                put(line, source)
        elif kind == "cdata":
            put(line, source[9:-3] if source.startswith("<![CDATA[") else source)
        elif kind == "comment" and TAG.fullmatch(source):
            seen.marks.append((at, "html_comment"))
        elif kind not in ("open", "close") or not _is_tag(source):
            # text, or a tag of no known element; such a tag may hold constructs in its attributes
            if len(source) > 1 and source[0] == "<" or source.startswith("!--"):
                seen.marks += ((at + m.start(), "html_tag") for m in TAG.finditer(source) if (m[1] or "").lower() in ELEMENTS)
                seen.marks += ((at + m.start(), "html_entity") for m in ENTITY.finditer(source) if _is_entity(m[0]))
                if source.startswith("!--") and text[at - 1 : at] == "<":
                    seen.marks.append((at - 1, "html_comment"))
            put(line, source)
        else:
            seen.marks.append((at, "html_tag"))
            opens = kind == "open"
            if name in LEADING:
                lead = lead + 1 if opens else max(0, lead - 1)
                if name == "a" and opens:
                    seen.links[line] = seen.links.get(line, 0) + 1
            if name in SKIPPED:
                skip = 1 if opens and low.find(f"</{name}", at) >= 0 else 0
                if opens and not skip:  # never closed: its text is text
                    put(line, text[at + len(source) :])
            elif code is not None and name not in ("pre", "code"):
                continue
            elif name in HEADINGS:
                line_end(line)
                if opens:
                    out.append((line, "#" * int(name[1]) + " "))
            elif name in ("ul", "ol"):
                line_end(line)
                lists.append([name, 0]) if opens else lists and lists.pop()
            elif name == "li":
                line_end(line)
                if opens and lists and lists[-1][0] == "ol":
                    lists[-1][1] += 1
                    out.append((line, f"{lists[-1][1]}. "))
                elif opens:
                    out.append((line, "- "))
            elif name == "pre":
                if opens and not pre:
                    line_end(line)
                    pre, code = 1, []
                elif not opens and pre:
                    body = "".join(code or ())
                    out += ((line, seen.hold("```\n" + body.strip("\n") + "\n```")), (line, "\n"))
                    pre, code = 0, None
            elif name == "code":
                if opens and code is None:
                    code = []
                elif not opens and code is not None and not pre:
                    out.append((line, seen.hold(f"`{''.join(code)}`")))
                    code = None
            elif name in ("td", "th"):
                if opens:
                    out.append((line, "\x1f"))
            elif name == "br":
                out.append((line, "\n"))
            elif name in BLOCKS:
                line_end(line)
    if code is not None:  # never closed
        out.append((bisect_right(parser.starts, len(text)) - 1, "".join(code)))
    seen.pieces = out


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """The values under a Gaussian, whose weights are scaled at the ends."""
    radius = int(3 * sigma + 0.5)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[j - i + radius], values[j]) for j in range(max(0, i - radius), min(len(values), i + radius + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """The bound between two clusters of values that lie as far apart as they can (largest variance between them)."""
    ordered, total = sorted(values), sum(values)
    best, bound, before = 0.0, ordered[0] if ordered else 0.0, 0.0
    for k in range(1, len(ordered)):
        before += ordered[k - 1]
        apart = k * (len(ordered) - k) * (before / k - (total - before) / (len(ordered) - k)) ** 2
        if apart > best:
            best, bound = apart, (ordered[k - 1] + ordered[k]) / 2
    return bound


def content_lines(seen: Reading) -> list[bool]:
    """Which lines of a reading are content: all but regions of links in the low cluster of the smoothed ratios.

    A region is a run of lines whose text is mostly links, with two links or more. Where no other
    line holds text, there is nothing the links could lead around, and all lines are content.
    """
    starts = [0, *(m.end() for m in re.finditer("\n", seen.text))]
    tags = [0] * len(starts)
    for at, _ in seen.marks:
        tags[bisect_right(starts, at) - 1] += 1
    n = len(starts)
    size = [seen.plain_text.get(i, 0) + seen.link_text.get(i, 0) for i in range(n)]
    leads = [seen.link_text.get(i, 0) * 2 >= size[i] > 0 for i in range(n)]
    keep = [True] * n
    if sum(seen.links.values()) < 2 or all(leads[i] or not size[i] for i in range(n)):
        return keep
    ratios = smoothed([size[i] / max(1, tags[i]) for i in range(n)])
    bound = threshold([ratios[i] for i in range(n) if size[i]])
    i = 0
    while i < n:
        if not leads[i]:
            i += 1
            continue
        j = i
        while j < n and (leads[j] or not size[j]):
            j += 1
        filled = [k for k in range(i, j) if size[k]]
        if sum(seen.links.get(k, 0) for k in range(i, j)) >= 2 and sum(ratios[k] for k in filled) / len(filled) < bound:
            keep[i:j] = [False] * (j - i)
        i = j
    return keep


def constructs(text: str) -> set[str]:
    """Names of the markup constructs in a text; empty for plain texts."""
    return {name for _, name in read(text).marks}


def clean(text: str) -> str:
    """Clean text: headings as ``#``, lists as ``-`` or numbers, code in backticks, formulas kept in ``$``.

    The export's own block names, plain URLs, rune marks, paths, arithmetic and tags of no known
    element are left as they are.
    """
    seen = read(text)
    if not seen.marks:
        return text
    text = seen.text
    if seen.pieces is not None:
        keep = content_lines(seen)
        text = re.sub(r"\n\x1f", "\n", "".join(out for line, out in seen.pieces if keep[min(line, len(keep) - 1)])).replace("\x1f", "\t")
    # wiki
    text = WIKI["wiki_heading"].sub(lambda m: "#" * len(m[1]) + " " + m[2], text)
    text = re.sub(r"^(\*+)[ \t]*(?=\S)(?![^*\n]*\*)", lambda m: "  " * (len(m[1]) - 1) + "- ", text, flags=re.M)
    text = WIKI["wiki_link"].sub(lambda m: m[2] or (m[1].split(":", 1)[1] if m[1].lower().startswith("category:") else m[1]), text)
    text = WIKI["wiki_external"].sub(lambda m: m[1], text)
    text = WIKI["wiki_template"].sub("", text)
    if WIKI["wiki_table"].search(text):
        text = re.sub(r"^\{\|.*\n?|^\|\}[ \t]*\n?|^\|-[ \t]*\n?", "", text, flags=re.M)
        text = re.sub(r"^[!|][ \t]*(.*)$", lambda m: re.sub(r"[ \t]*(?:!!|\|\|)[ \t]*", "\t", m[1]), text, flags=re.M)
    text = WIKI["wiki_bold"].sub(r"\1", text)
    text = WIKI["wiki_italic"].sub(r"\1", text)
    # Markdown
    text = MARKDOWN["md_image"].sub(r"\1", text)
    text = MARKDOWN["md_link"].sub(lambda m: m[1] or m[2] or "", text)
    for name in ("md_strong", "md_strong_", "md_emphasis", "md_emphasis_", "md_strike"):
        text = MARKDOWN[name].sub(r"\1", text)
    if MARKDOWN["md_table"].search(text):
        text = MARKDOWN["md_table"].sub("", text)
        text = re.sub(r"^[ \t]*\|(.*?)\|?[ \t]*$", lambda m: "\t".join(c.strip() for c in m[1].split("|")), text, flags=re.M)
    # LaTeX
    text = re.sub(r"\\(?:sub)*section\*?\{([^{}\n]*)\}", r"# \1", text)
    text = re.sub(r"^[ \t]*\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?[ \t]*\n?|\\(?:begin|end)\{[A-Za-z]+\*?\}", "", text, flags=re.M)
    text = re.sub(r"\\item\b[ \t]*", "- ", text)
    text = LATEX["tex_cite"].sub("", text)
    text = re.sub(r"(?<![A-Za-z0-9:\\/._-])\\(?:cite|label|ref|eqref)\{[^{}\n]*\}", "", text)
    text = LATEX["tex_command"].sub(lambda m: m[0][m[0].index("{") + 1 : -1], text)
    return seen.released(re.sub(r"\n{3,}", "\n\n", text).strip("\n"))


def find_markup(df, id_col: str, text_col: str, field: str):  # noqa: ANN001, ANN201
    """``id, field``: rows whose text holds at least one markup construct.

    Null, empty and blank texts have none; repeated rows are reported each. Texts without any
    character that can start a construct never leave the JVM.
    """
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts = batch.column(1).to_pylist()
            seen = {t: bool(read(t).marks) for t in set(texts)}
            ids = [i for i, t in zip(batch.column(0).to_pylist(), texts) if seen[t]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([field] * len(ids), pa.string())], ["id", "field"])

    suspect = df.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).rlike(SUSPECT))
    return suspect.mapInArrow(run, "id long, field string")


def cleaned(df, id_col: str, text_col: str):  # noqa: ANN001, ANN201
    """``id, text``: every row's text as clean text; null stays null, plain texts stay as they are."""
    @F.pandas_udf(T.StringType())
    def clean_udf(texts: pd.Series) -> pd.Series:
        made = {t: clean(t) for t in set(texts) if isinstance(t, str)}
        return pd.Series([made.get(t) if isinstance(t, str) else None for t in texts], dtype=object)

    text = F.col(text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(clean_udf(F.when(text.rlike(SUSPECT), text)), text).alias("text"))
