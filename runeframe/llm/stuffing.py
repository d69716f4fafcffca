"""Pages stuffed with keywords, links or tags.

The suffix automaton of every page, built over its whole text, tells which characters lie in
repeated maximal substrings. Repetition counts where clause structure is missing: a page is cut
into units at line ends and sentence ends, units with enough function words among their words are
sentences, and runes, numbers and rune spellings are transcription matter. A page is stuffed if
what is left is most of its visible text and links, tags and covered characters are a good part
of that.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words (articles, pronouns, prepositions, conjunctions, auxiliaries, particles) by language.
FUNCTION_WORDS = {
    "en": """the a an this that these those it its it's he she they him them we us we're i i'm i've me you you'll you'd you've your my our his her their who whom whose which what
    when where why how and or nor but so yet because since although though unless while whereas if then than as of in on at by with without within for from to into onto
    over under before after between through during against about above below near is are was were be been being am do does did has have had having not no nobody nothing
    none someone somebody something everyone everybody everything anyone anybody anything each every either neither both all any some such can can't could couldn't would
    should will won't shall may might must there here that's there's let's they've don't doesn't didn't isn't wasn't aren't""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber denn wenn weil dass ob damit so als wie ist sind war waren wird werden wurde wurden haben hat
    hatte hatten sein ich du er sie es wir ihr mich dich sich uns euch mein dein unser nicht kein keine noch schon auch nur auf in im an am zu zum zur von vom mit nach
    bei für über unter vor aus durch gegen ohne um warum was wer wo da dort hier man""",
    "fr": """le la les l un une des du de d et ou mais donc car que qu qui quoi dont où est sont était étaient été être a ont avait avoir on nous vous je tu il elle ils elles lui
    se ce cet cette ces mon ton son notre votre leur ne pas plus sur sous dans à au aux pour par avec sans après avant entre si comme pourquoi ici ensemble hier""",
    "es": """el los las lo un una unos unas y e o u pero sino que quien cual es son fue era eran está están estaba ser ha han hemos había habían yo tú él ella nosotros ellos se me
    te nos su mi no ya si en de del al a por para con sin sobre entre hasta desde después antes porque qué como cuando donde juntos ayer""",
}
CLOSED = frozenset(word for words in FUNCTION_WORDS.values() for word in words.split())
LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"'\])|]+|<a\b[^>]*>|</a>|\bhref=\S+", re.I)
TAG = re.compile(r"#[^\W\d_]\w*")
#: Rune spellings joined by separators, and digests.
SPELLINGS = re.compile(r"\b[A-Za-z]{1,3}[-./](?:[A-Za-z]{1,3}[-./]){2,}[A-Za-z]{1,3}\b")
DIGESTS = re.compile(r"\b[0-9a-f]{16,}\b")
RUNES = (0x16A0, 0x16FF)
LINE_END, SENTENCE_END, BLANK, DIGIT, MATTER, JOINT, LETTER, HEXADECIMAL = (1 << i for i in range(8))


def _kinds() -> np.ndarray:
    """What a character is, by code point; all beyond the table are other characters."""
    kinds = np.zeros(0x3002, np.uint8)
    for chars, kind in (("\n", LINE_END), (".!?…", SENTENCE_END), ("0123456789", DIGIT | MATTER), (".,:/x-", JOINT), ("0123456789abcdef", HEXADECIMAL)):
        for c in chars:
            kinds[ord(c)] |= kind
    for code in range(len(kinds)):
        kinds[code] |= BLANK * chr(code).isspace() | MATTER * (RUNES[0] <= code <= RUNES[1]) | LETTER * (code < 0x80 and chr(code).isalpha())
    return kinds


KINDS = _kinds()
#: Shortest repetition that covers characters.
MIN_REPEAT = 8
CLAUSE_SHARE = 0.16
#: Share of the text outside sentences and matter that must be repetition, links or tags.
STUFFED_SHARE = 0.22


def is_clause(unit: str) -> bool:
    """Whether a unit reads as a sentence: two different function words, and enough of them."""
    words = unit.lower().split()
    closed = [w for w in words if w in CLOSED]
    return len(closed) >= CLAUSE_SHARE * len(words) and len(set(closed)) >= 2


def _symbols(text: str) -> np.ndarray:
    """The text's characters as dense codes from 1, in the order of their code points."""
    try:
        raw = np.frombuffer(text.encode("latin-1"), np.uint8)
        return np.cumsum(np.bincount(raw, minlength=256) > 0)[raw]
    except UnicodeEncodeError:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.unique(raw, return_inverse=True)[1] + 1


def _runs(codes: np.ndarray, bits: int, span: int) -> np.ndarray:
    """At each place the next ``span`` codes in one number, zeros past the end; made from runs of half the length."""
    if span == 1:
        return codes
    half = span // 2
    runs = _runs(codes, bits, half)
    packed = runs << bits * half
    packed[:-half] |= runs[half:]
    if span % 2:
        packed <<= bits
        packed[: 1 - span] |= codes[span - 1 :]
    return packed


def link_lengths(text: str, least: int = 1) -> np.ndarray:
    """For the state of each prefix in the text's suffix automaton the length of its suffix link; 0 for links shorter than ``least``.

    That is the longest suffix of the prefix that ends elsewhere in the text too. The tree of
    suffix links is the suffix tree of the reversed text, so the states are found as arrays: the
    reversed suffixes are sorted by prefix doubling, where each round takes only those not yet
    told apart, and a prefix's link is as long as its longest common part with a neighbour in
    that order. Common parts come from the ranks of the rounds, longest first.
    """
    n = len(text)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    codes = _symbols(text)[::-1]
    bits, low = int(codes.max()).bit_length(), n.bit_length()
    span = max(1, (63 - low) // bits)
    packed = _runs(codes.astype(np.int64), bits, span)
    ordered = packed << low  # first characters and place in one number, so that one plain sort orders both
    ordered |= np.arange(n)
    ordered.sort()
    order = ordered & ((1 << low) - 1)
    ordered >>= low
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(2 * n + 1, np.int64)  # a rank is the first place of a class; past the end -1
    rank[n:] = -1
    rank[order] = place
    ranks, spans = [rank], [span]
    same = ~new
    same[:-1] |= ~new[1:]
    where = np.flatnonzero(same)  # places of the suffixes not yet told apart
    while len(where) and span < n:
        members, head = order[where], place[where]
        second = rank[members + span]
        sort = np.argsort(head * (n + 1) + second)
        members, second = members[sort], second[sort]
        order[where] = members  # classes keep their places, so ``head`` still holds
        apart = np.empty(len(where), bool)
        apart[0] = True
        apart[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        head = np.maximum.accumulate(np.where(apart, where, 0))
        place[where] = head
        rank = rank.copy()
        rank[members] = head
        ranks.append(rank)
        span *= 2
        spans.append(span)
        same = ~apart
        same[:-1] |= ~apart[1:]
        where = where[same]
    first = packed[order] >> bits * max(0, spans[0] - least)
    near = np.flatnonzero(first[1:] == first[:-1])  # neighbours that share enough to matter
    left, right = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for rank, span in zip(ranks[::-1], spans[::-1]):
        a, b = rank[np.minimum(left + common, n)], rank[np.minimum(right + common, n)]
        common += span * ((a == b) & (a >= 0))
    ended = np.append(packed, 0)
    differ = ended[np.minimum(left + common, n)] ^ ended[np.minimum(right + common, n)]
    differ &= ~(differ >> 1)  # the highest bit stays, and no rounding reaches the next one
    common += (bits * spans[0] - np.frexp(differ.astype(np.float64))[1]) // bits
    common = np.minimum(common, n - np.maximum(left, right))
    common[common < least] = 0
    longest[left] = common
    longest[right] = np.maximum(longest[right], common)
    return longest[::-1]


def repeated_cover(text: str, least: int = MIN_REPEAT) -> np.ndarray:
    """For each character whether it lies in a repeated maximal substring of at least ``least`` characters."""
    n = len(text)
    longest = link_lengths(text, least)
    ends = np.flatnonzero(longest >= least)
    edge = np.bincount(ends + 1 - longest[ends], minlength=n + 1) - np.bincount(ends + 1, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _matter(kinds: np.ndarray, text: str) -> np.ndarray:
    """Which characters are runes, numbers with their joints, rune spellings or digests."""
    matter, digit, letter = kinds & MATTER > 0, kinds & DIGIT > 0, kinds & LETTER > 0
    joint = kinds[1:-1] & JOINT > 0
    matter[1:-1] |= joint & digit[:-2] & digit[2:]
    if np.count_nonzero(joint & letter[:-2] & letter[2:]) >= 3:
        for m in SPELLINGS.finditer(text):
            matter[m.start() : m.end()] = True
    run = kinds & HEXADECIMAL > 0
    for k in (1, 2, 4, 8):  # whether sixteen stand in a row
        run = run[:-k] & run[k:] if len(run) > k else run[:0]
    if run.any():
        for m in DIGESTS.finditer(text):
            matter[m.start() : m.end()] = True
    return matter


def _mask(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    mask = np.zeros(n, bool)
    for x, y in spans:
        mask[x:y] = True
    return mask


def shares(text: str) -> tuple[int, int, int]:
    """Visible characters, those outside sentences and transcription matter, and those of the latter in links, tags or repetitions."""
    n = len(text)
    if n < 2:
        return n - text.isspace() * n, 0, 0
    try:
        kinds = KINDS[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        kinds = KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), len(KINDS) - 1)]
    visible, link = kinds & BLANK == 0, np.zeros(n, bool)
    low = text.lower()
    if any(sign in low for sign in ("://", "www.", "<a", "</a", "href=")):
        link = _mask(n, [m.span() for m in LINK.finditer(text)])
    matter = _matter(kinds, text) & ~link
    # a unit ends before a line end, and behind a sentence end that white space follows
    cut = kinds & LINE_END > 0
    cut[1:] |= (kinds[:-1] & SENTENCE_END > 0) & ~visible[1:]
    cut[0] = True
    starts = np.flatnonzero(cut)
    seen = np.add.reduceat(visible, starts, dtype=np.int64)
    settled = np.add.reduceat(matter, starts, dtype=np.int64) * 2 > seen
    units = (seen > 0) & (np.add.reduceat(link, starts, dtype=np.int64) == 0) & ~settled
    ends = np.append(starts[1:], n)
    words = low if len(low) == n else text
    for k, a, b in zip(np.flatnonzero(units).tolist(), starts[units].tolist(), ends[units].tolist()):
        settled[k] = is_clause(words[a:b])
    rest = visible & ~matter & ~np.repeat(settled, ends - starts)
    marked = repeated_cover(text) | link
    if "#" in text:
        marked |= _mask(n, [m.span() for m in TAG.finditer(text)])
    return int(np.count_nonzero(visible)), int(np.count_nonzero(rest)), int(np.count_nonzero(rest & marked))


def is_stuffed(text: str | None) -> bool:
    """Most of the page lies outside sentences and matter, and enough of that is repetition, links or tags."""
    if not text:
        return False
    total, left, stuffed = shares(text)
    return left * 2 > total and stuffed >= STUFFED_SHARE * left


def find_stuffed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``: stuffed pages, repeats included.

    Null, empty and blank texts are not stuffed; other columns are ignored. Row-wise, so nothing
    is shuffled.
    """

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            ids = [i for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) if is_stuffed(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.length(text_col) > 0).mapInArrow(run, "doc_id long")
