"""Personal information in free text: find it, however obscured, and put typed placeholders in its place.

Text passes through transducers that each rewrite one disguise and keep, for every character of
the result, the span of source characters it stands for: homoglyphs and invisible characters,
``at``/``dot`` spellings, and digits written as words. Identifiers are detected in the result and
their spans are mapped back, so only the disguised stretch of the source is replaced.

Names come from a gazetteer of given and family names, found by a multi-pattern automaton, and
beyond it from shape and context: words with the shape of a name behind words that introduce one
or before words that tell what someone did, and authors that are written like names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from runeframe.llm.canonical_text import _tables

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

#: Digits as words, in the languages of the archive.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?i)(?<![\w-])(?:(?:{_WORD}|double|triple|\d+|plus|dash)[ .,-]{{1,2}}){{5,}}(?:{_WORD}|\d+)(?!\w)")
AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|(?<=\w)\s+(?:at|AT|@)\s+(?=[\w-]+(?:\s*(?:[\[({<]\s*(?:dot|DOT|\.)\s*[\])}>]|\s(?:dot|DOT)\s|\.)\s*[\w-]+))|(?<=\w)\s+@(?=\w[\w-]*\.)|(?<=\w)@\s+(?=\w[\w-]*\.\w)", re.I)
DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|(?<=\w)\s+(?:dot|DOT)\s+(?=\w)")
HOST = re.compile(r"(?<=@)[\w-]+(?:(?:" + DOT.pattern + r"|\.)[\w-]+)+")
ANY_DIGIT = re.compile(r"\d")
MANY_DIGITS = re.compile(r"\d(?:\D{0,3}\d){5}")

EMAIL = re.compile(r"(?<![\w.+@/-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@])")

_EDGE_L, _EDGE_R = r"(?<![\w.,:/+-])(?<![\d)][ ])", r"(?![\w@])(?!(?:[.,:/-]|[ ])\d)"
PHONE = re.compile(
    rf"(?<![\w.+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{1,5}}(?:[ .-]?\d{{2,5}}){{1,4}}{_EDGE_R}"  # international
    rf"|{_EDGE_L}(?:1[ .-])?\([2-9]\d\d\)[ ]?[2-9]\d\d[ .-]\d{{4}}{_EDGE_R}"  # (area) exchange
    rf"|{_EDGE_L}(?:1[ .-])?[2-9]\d\d([.-])[2-9]\d\d\1\d{{4}}{_EDGE_R}"  # dotted or dashed
    rf"|{_EDGE_L}[2-9]\d\d[2-9]\d{{6}}{_EDGE_R}"  # ten digits together
    rf"|{_EDGE_L}0\d{{2,4}}[ -]\d{{3,4}}[ -]\d{{4}}{_EDGE_R}"  # trunk prefix
    rf"|{_EDGE_L}0[1-9](?:[ .]\d\d){{4}}{_EDGE_R}"  # pairs
    rf"|{_EDGE_L}0\d{{9,10}}{_EDGE_R}"
)
ID_NUMBER = re.compile(
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"  # social security
    r"|(?i:\b(?:social security|ssn|soc\.? sec\.?)(?: (?:number|no\.?|nr\.?))?[ :#]{0,3})(\d{3}[ .-]?\d{2}[ .-]?\d{4})(?!\w)"
    r"|(?<![\w-])[A-CEGHJ-PQ-TW-Z][A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"  # national insurance
    r"|(?i:\b(?:passport|reisepass|passeport|pasaporte)(?: (?:number|no\.?|nr\.?))?[ :#]{0,3})([A-Z]{1,2}\d{6,8}|\d{9})(?!\w)"
    r"|(?i:\b(?:id|identity|dni|nie|licen[cs]e|personalausweis)(?: card)?(?: (?:number|no\.?|nr\.?))?[ :#]{0,3})(\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{7,12})(?!\w)"
    r"|(?<![\w-])(\d{8}-?[A-Z])(?![\w-])"  # identity card, by its check letter
)
#: Fixed value: check letters of the identity card, by the number's remainder.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_TOWN = r"(?:, (?:Flat|Apt|Apartment|Unit|Suite) \d+[a-z]?)?(?:, (?:\d{4,5} )?[A-ZÄÖÜ][a-zäöüß]+(?:[ -][A-Z][a-z]+)?)?"
STREET = re.compile(
    r"(?<![\w.])(?:(?:Flat|Apt|Apartment|Unit|Suite|FLAT|APT)\.? \d+[a-z]?, )?\d{1,4}[a-zA-Z]? (?:[A-Z][A-Za-z'’-]+ ){1,3}"
    r"(?:Street|St\.|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.|Close|Court|Ct\.?|Way|Place|Terrace|Crescent|Boulevard|Blvd\.?|Gardens|Grove|Mews|STREET|ROAD|AVENUE|LANE|DRIVE|CLOSE|COURT|WAY|PLACE)(?!\w)" + _TOWN
    + r"|(?<![\w.])\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|chemin|impasse|allée|quai|place) (?:de la |de l['’]|des |du |de |d['’])?[A-ZÀ-Ý][\w'’-]+(?: [A-ZÀ-Ý][\w'’-]+)?" + _TOWN
    + r"|\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino)(?: (?:del|de la|de los|de las|de))? [A-ZÁÉÍÓÚÑ][\wáéíóúñ]+(?: [A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)?,? (?:n\.?[º°o]? ?)?\d{1,4}(?![\w.]\d)" + _TOWN
    + r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:[ -][A-ZÄÖÜ][a-zäöüß]+)*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm) \d{1,4}[a-z]?(?![\w.]\d)" + _TOWN
    + r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:[ -](?:Straße|Strasse|Weg|Gasse|Platz|Allee)) \d{1,4}[a-z]?(?![\w.]\d)" + _TOWN
)
#: Words whose presence makes the slower patterns worth trying.
STREET_WORDS = """street st. road rd avenue ave lane ln drive dr. close court ct way place terrace crescent boulevard blvd gardens
grove mews rue chemin impasse allée quai calle avenida avda plaza paseo camino straße strasse str. weg gasse platz allee ufer damm""".split()
AT_DOT_WORDS = ("dot", "(at", "[at", "{at", "<at", "( at", "[ at", "(@", "[@", "{@", " @", "@ ")


_NAME_WORD = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['’-][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*|[A-ZÀ-ÖØ-Þ]{3,}(?:['’-][A-ZÀ-ÖØ-Þ]{2,})*)"
_INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
#: What is written like a name: given and family name, initials, or family name first.
NAME_SHAPE = re.compile(rf"(?<![\w.@/'’-])(?:(?:{_NAME_WORD}|{_INITIAL})[ \u00a0]+(?:{_INITIAL}[ \u00a0]+)?({_NAME_WORD})|{_NAME_WORD},[ \u00a0]+(?:{_NAME_WORD}|{_INITIAL}))(?![\w@])")
#: Words that introduce a name, and words that follow the name of someone who acts.
INTRODUCES = re.compile(
    r"(?i)(?<![\w@])(?:my name is|i am called|i(?:'m| am)|mein name ist|ich heiße|je m['’]appelle|me llamo|signed|gezeichnet|signé|firmado|regards|yours|cheers|thanks(?: to)?|thank you|danke|merci(?: à)?"
    r"|gracias(?: a)?|credits? to|i asked|asked|i met|met|ask|contact|(?:is|was|found|solved|written|posted|sent|made|done|drawn) by|that was|this is|it was|dear|mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|herr|frau|señora?|monsieur|madame)[ :,]{1,2}$"
)
#: The introductions after which a name in lower case is taken, where one of its words is known.
SURE_WORDS = ("my name is", "signed", "credit to", "asked", "met ", "thanks", " by ", "that was")
LOWER_CASE = re.compile(r"(?<![\w@])(?:my name is|signed,?|credit to|asked|met|thanks|by|that was)[ ]+(([a-zß-öø-ÿ]{3,}(?:['’-][a-zß-öø-ÿ]+)*)[ \u00a0]+(?:[a-z]\.[ \u00a0]+)?([a-zß-öø-ÿ]{3,}(?:['’-][a-zß-öø-ÿ]+)*))(?![\w@])")
ACTS = re.compile(r"[ ](?:and I\b|solved|wrote|said|says|told|asked|posted|found|noticed|split|helped|sent|called)\b")
DETERMINED = re.compile(r"(?i)(?<!\w)(?:the|an?|this|that|these|those|my|our|your|their|his|her|every|each|no|der|die|das|le|la|les|el|los|las)[ ]$")
#: Capitalised words that no name consists of.
NO_NAME = frozenset(
    """the and but that this these those not was were with from then than when what who how why all any some page pages section rune runes key keys prime primes
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday""".split()
)
#: An author written like a name, in any case.
NAME_AS_AUTHOR = re.compile(r"[\s\u200b]*((?:[^\W\d_]{2,}(?:['’-][^\W\d_]{2,})*|[^\W\d_]\.)[ \u00a0]+(?:[^\W\d_]\.[ \u00a0]+)*[^\W\d_]{3,}(?:['’-][^\W\d_]{2,})*|[^\W\d_]{3,}(?:['’-][^\W\d_]{2,})*,[ \u00a0]+(?:[^\W\d_]{2,}|[^\W\d_]\.))[\s\u200b]*(?:\(pinned\)\s*)?")


@dataclass(frozen=True)
class Gazetteer:
    """Given and family names in lower case."""

    given: frozenset[str]
    family: frozenset[str]

    @staticmethod
    def of(full_names: Iterable[str | None]) -> Gazetteer:
        """The last word of a full name is the family name, the words before it are given names."""
        given, family = set(), set()
        for name in full_names:
            words = (name or "").split()
            if len(words) >= 2:
                family.add(words[-1].lower())
                given.update(w.lower() for w in words[:-1] if len(w.strip(".")) > 1)
        return Gazetteer(frozenset(given), frozenset(family))


class Spans:
    """A rewritten text whose characters know the source span they stand for."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def rewrite(self, pattern: re.Pattern[str], to) -> Spans:  # noqa: ANN001
        """Every match replaced by ``to(match)``; each character of a replacement stands for the whole match."""
        out, starts, ends, last = [], [], [], 0
        own_s = self.starts or range(len(self.text))
        own_e = self.ends or range(1, len(self.text) + 1)
        for m in pattern.finditer(self.text):
            new = to(m)
            if new == m[0]:
                continue
            a, b = m.span()
            out += (self.text[last:a], new)
            starts += [*own_s[last:a], *([own_s[a]] * len(new))]
            ends += [*own_e[last:a], *([own_e[b - 1]] * len(new))]
            last = b
        if not last:
            return self
        out.append(self.text[last:])
        starts += own_s[last:]
        ends += own_e[last:]
        return Spans("".join(out), list(starts), list(ends))


def plain_characters(text: str) -> Spans:
    """First transducer: homoglyphs to their letters, invisible characters away."""
    spans = Spans(text)
    if not text.isascii():
        table, special = _tables()
        spans = spans.rewrite(special, lambda m: table[ord(m[0])])
    return spans


def plain_spellings(spans: Spans, at_dot: bool = True, digits: bool = True) -> Spans:
    """The other transducers: at/dot spellings and digits written as words."""
    if at_dot:
        spans = spans.rewrite(AT, lambda m: "@")
        if "@" in spans.text:
            spans = spans.rewrite(HOST, lambda m: DOT.sub(".", m[0]))
    if digits:
        spans = spans.rewrite(SPELLED, _spoken_digits)
    return spans


def _spoken_digits(m: re.Match[str]) -> str:
    out, times = [], 1
    for word in re.findall(r"\w+|[.-]", m[0]):
        low = word.lower()
        if low in ("double", "triple"):
            times = 2 if low == "double" else 3
        elif low == "plus":
            out.append("+")
        elif low == "dash" or word in ".-":
            out.append("-" if low == "dash" else "")
        else:
            out.append(DIGIT_WORDS.get(low, low) * times)
            times = 1
    return "".join(out)


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """Finds identifiers; built once per task from the gazetteer. ``signatures``: texts are what people sign with.

    One pass of the automaton over the lower-cased text finds the family names and tells which of
    the slower patterns can match at all.
    """

    def __init__(self, names: Gazetteer, signatures: bool = False) -> None:
        import ahocorasick

        self.names, self.signatures = names, signatures
        self.automaton = ahocorasick.Automaton()
        words: dict[str, str] = {}
        for kind, some in (("d", [w for w in DIGIT_WORDS if len(w) > 2]), ("s", STREET_WORDS), ("a", AT_DOT_WORDS), ("i", SURE_WORDS), ("n", names.family)):
            for w in some:
                words[w] = words.get(w, "") + kind
        for w, kinds in words.items():
            self.automaton.add_word(w, (kinds, len(w)))
        self.automaton.make_automaton()
        self.before = re.compile(r"(?:^|(?<![\w.@/+-]))((?:[^\W\d_][\w'’-]*[ \u00a0]+)?(?:[^\W\d_]\.?[ \u00a0]+){0,2})$")

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """Disjoint ``(start, end, kind)`` in the source text, in order."""
        spans = plain_characters(text)
        low, families, spoken, flags = _lower(spans.text), [], 0, ""
        for end, (kinds, size) in self.automaton.iter(low):
            if "n" in kinds:
                families.append((end + 1 - size, end + 1))
            if "d" in kinds and not low[end - size : end - size + 1].isalpha() and not low[end + 1 : end + 2].isalpha():
                spoken += 1
            flags += kinds
        found: list[tuple[int, int, str]] = []
        if families:
            found += ((*spans.source(a, b), kind) for a, b, kind in self._persons(spans.text, families))
        found += ((*spans.source(a, b), "person_name") for a, b in self._shaped(spans.text, "i" in flags))
        if "a" in flags or spoken >= 4:
            spans = plain_spellings(spans, "a" in flags, spoken >= 4)
        t = spans.text
        other: list[tuple[int, int, str]] = []
        if "@" in t:
            other += ((*m.span(), "email") for m in EMAIL.finditer(t))
        if MANY_DIGITS.search(t):
            for m in ID_NUMBER.finditer(t):
                group = next((k for k in (1, 2, 3, 4) if m[k]), 0)
                if group == 4 and CHECK_LETTERS[int(m[4][:8]) % 23] != m[4][-1]:
                    continue
                other.append((*m.span(group), "id_number"))
            other += ((*m.span(), "phone") for m in PHONE.finditer(t) if self._phone(m[0]))
        if "s" in flags and ANY_DIGIT.search(t):
            other += ((*m.span(), "street_address") for m in STREET.finditer(t))
        found += ((*spans.source(a, b), kind) for a, b, kind in other)
        found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
        out, last = [], -1
        for a, b, kind in found:
            if a >= last:
                out.append((a, b, kind))
                last = b
        return out

    @staticmethod
    def _phone(number: str) -> bool:
        digits = re.sub(r"\D", "", number)
        if not 8 <= len(digits) <= 15:
            return False
        pairs = number.split()
        # five pairs that could all be rune indices are a rune list
        return not (len(pairs) == 5 and all(len(p) == 2 and p.isdigit() and int(p) <= 28 for p in pairs))

    def _persons(self, t: str, families: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        low = _lower(t)
        for a, b in families:
            if (a and (low[a - 1].isalnum() or low[a - 1] in "_@/")) or (b < len(low) and (low[b].isalnum() or low[b] in "_@/")):
                continue
            if a and low[a - 1] in "-." or low[b : b + 1] == "-" and low[b + 1 : b + 2].isalpha():
                if not (a and low[a - 1] == "."):
                    continue
            m = self.before.search(t[_words_back(t, a, 4) : a])
            if m and m[1]:
                words = m[1].split()
                shift = a - len(m[1])
                if len(words) > 1 or words[0].lower() in self.names.given or re.fullmatch(r"[^\W\d_]\.", words[0]):
                    first = words[0].lower()
                    if first in self.names.given:
                        yield shift, b, "person_name"
                        continue
                    if re.fullmatch(r"[^\W\d_]\.", words[-1]) and (len(words) == 1 or not re.fullmatch(r"[^\W\d_]\.", first)):
                        yield a - len(m[1]) + m[1].rindex(words[-1]), b, "person_name"
                        continue
                    if len(words) > 1 and re.fullmatch(r"[^\W\d_]\.", words[0]) and re.fullmatch(r"[^\W\d_]\.", words[-1]):
                        yield shift, b, "person_name"
                        continue
            after = AFTER_FAMILY.match(t, b)
            if after and after[1].lower() in self.names.given:
                yield a, after.end(), "person_name"

    def _shaped(self, t: str, introduced: bool) -> Iterator[tuple[int, int]]:
        """Names beyond the gazetteer, by shape and context."""
        if self.signatures and (m := NAME_AS_AUTHOR.fullmatch(t)):
            yield m.span(1)
        for m in NAME_SHAPE.finditer(t):
            a, b = m.span()
            if INTRODUCES.search(t, max(0, a - 24), a) or (ACTS.match(t, b) and m[1] and not m[0].isupper() and not DETERMINED.search(t, max(0, a - 6), a)):
                if not any(w.strip(".,").lower() in NO_NAME for w in m[0].split()):
                    yield a, b
        for m in LOWER_CASE.finditer(t) if introduced else ():
            if (m[2] in self.names.given or m[3] in self.names.family) and m[2] not in NO_NAME and m[3] not in NO_NAME:
                yield m.span(1)


AFTER_FAMILY = re.compile(r",[ \u00a0]+([^\W\d_][\w'’-]*|[^\W\d_]\.)(?![\w@])")


def _words_back(t: str, at: int, words: int) -> int:
    """Where the last ``words`` words before a position start."""
    for _ in range(words):
        while at and t[at - 1].isspace():
            at -= 1
        while at and not t[at - 1].isspace():
            at -= 1
    return at


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` in place of each identifier."""
    out, last = [], 0
    for a, b, kind in found:
        out += (text[last:a], f"[{kind.upper()}]")
        last = b
    out.append(text[last:])
    return "".join(out)


FINDINGS = "id long, field string, kind string"


def _distinct_run(batches, finder, handle):  # noqa: ANN001
    """Applies ``handle(findings, text)`` to each text of a batch; equal texts of a batch are searched once."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        seen: dict = {}
        for t in texts:
            if t is not None and t not in seen:
                seen[t] = handle(finder(t), t)
        yield batch, [None if t is None else seen[t] for t in texts]


def find_kinds(df, id_col: str, text_col: str, field: str, names: Gazetteer, signatures: bool = False):  # noqa: ANN001, ANN201
    """``id, field, kind``: kinds of personal information in each row's text, one row per kind.

    ``signatures``: the texts are what people sign with, so one written like a name is a name.
    Null, empty and blank texts have none; repeated rows are reported each; other columns are ignored.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):  # noqa: ANN001, ANN202
        finder = Finder(names, signatures)
        for batch, kinds in _distinct_run(batches, finder, lambda found, _: sorted({k for *_, k in found})):
            ids, out = [], []
            for i, ks in zip(batch.column(0).to_pylist(), kinds):
                for k in ks or ():
                    ids.append(i)
                    out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([field] * len(ids), pa.string()), pa.array(out, pa.string())], ["id", "field", "kind"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.length(text_col) > 0).mapInArrow(run, FINDINGS)


def redacted(df, id_col: str, text_col: str, names: Gazetteer, signatures: bool = False):  # noqa: ANN001, ANN201
    """``id, text``: every row's text with placeholders; null stays null, empty stays empty."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):  # noqa: ANN001, ANN202
        finder = Finder(names, signatures)
        for batch, texts in _distinct_run(batches, finder, lambda found, t: redact(t, found)):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, text string")
