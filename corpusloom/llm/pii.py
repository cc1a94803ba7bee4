"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text itself. Three transducers then rewrite a copy and keep,
for every character they emit, the source characters it stands for: look-alike characters become
ASCII, spelled digits become digits, and at/dot disguises become '@' and '.'. The same detectors
run over the copy, and spans that a transducer has touched are mapped back to the source.

Every row is handled alone, in Arrow batches; no shuffle, and memory is bounded by a batch and
the longest text. All scans are linear in the text. Defined cases: a null text is empty; rows
repeating a doc_id each give a row; spans are in code points, end exclusive; an added span that
overlaps a plain one is dropped.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, table

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that fails from its first digit fails from every later one.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand, leftmost and not overlapping within a kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


# Transducers ---------------------------------------------------------------------------------

#: Look-alikes of Latin letters that compatibility normalisation leaves as they are.
GREEK_CYRILLIC = dict(zip("АВЕКМНОРСТХаеіјкорсухѕԁԛԝһІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϲ", "ABEKMHOPCTXaeijkopcyxsdqwhIJSABEZHIKMNOPTYXaivopuc", strict=True))
LIKE = str.maketrans(GREEK_CYRILLIC | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d\ufe58", "-") | dict.fromkeys("\u2024\u3002\uff0e\uff61\u00b7\u2219\u2022", ".") | {"\ufe62": "+", "\u2214": "+"})
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")

#: Digit words by language, zero to nine.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
SPELLED = {w: str(d) for words in DIGIT_WORDS.values() for d, w in enumerate(words.split())} | {"oh": "0"}
SIGNS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_SIGN = "|".join(sorted(SIGNS, key=len, reverse=True))
#: Four spelled digits or more in a run that may hold figures, signs and one separator each.
SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus|más)[\s-]{{1,3}})?(?:{_DIGIT}|[0-9]+)(?:[\s,-]{{1,3}}(?:{_DIGIT}|{_SIGN}|[0-9]+)(?!\w))+")
#: Every run with a spelled digit has one of these beside a figure, a sign or another one.
SPELLED_HINT = re.compile(rf"(?:{_DIGIT})[\s,-]{{1,3}}(?:{_DIGIT}|{_SIGN}|[0-9])|(?:{_SIGN}|[0-9])[\s,-]{{1,3}}(?:{_DIGIT})")
SPELLED_TOKEN = re.compile(rf"{_DIGIT}|{_SIGN}|[0-9]+")

#: Bracketed disguises, and bare words that count only as a whole address. A match begins at the
#: bracket or the word between; white space and the words about it are taken by looking outwards
#: over pieces that were cut once, so no character is looked at again and again.
_AT, _DOT = r"at|arroba|a|@|ät|chez", r"dot|punkt|point|punto|d|\."
BRACKET = re.compile(rf"[(\[{{<]\s*+(?:(?P<at>{_AT})|(?P<dot>{_DOT}))\s*+[)\]}}>]", re.I)
#: White space, or a run of the characters of an address, or any other character.
PIECE = re.compile(r"(?P<space>\s++)|(?P<word>[A-Za-z0-9_%+-]++)|.", re.S)
BARE_AT, BARE_DOT = frozenset(("at", "arroba")), frozenset(("dot", "punkt", "point", "punto"))
HOST = re.compile(r"[A-Za-z0-9-]+")


class Mapped:
    """A text with, for each character, the start and end of the source it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (from, to, new), in order and not overlapping; each new character stands for
        the whole of what it replaces."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def _homoglyphs(m: Mapped) -> None:
    if m.text.isascii():
        return
    edits = []
    for k, c in enumerate(m.text):
        if c > "\xff" or c in "\xa0\xad\xb7":
            new = "" if c in INVISIBLE else c.translate(LIKE)
            if new == c:
                new = unicodedata.normalize("NFKC", c)
                if (d := unicodedata.digit(c, None)) is not None:
                    new = str(d)
            if new != c and new.isascii():
                edits.append((k, k + 1, new))
    m.replace(edits)


def _lower(text: str) -> str:
    """In lower case, character by character; one that would become several stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _spelled_digits(m: Mapped) -> None:
    low = _lower(m.text)
    if not SPELLED_HINT.search(low):
        return
    edits = []
    for run in SPELLED_RUN.finditer(low):
        tokens = list(SPELLED_TOKEN.finditer(low, run.start(), run.end()))
        if sum(t[0] in SPELLED for t in tokens) < 4:
            continue
        if run.group().startswith(("plus", "más")):
            tokens = [re.compile("plus|más").match(low, run.start()), *[t for t in tokens if t.start() > run.start()]]
        for k, t in enumerate(tokens):
            until = tokens[k + 1].start() if k + 1 < len(tokens) else t.end()
            edits.append((t.start(), t.end(), SPELLED.get(t[0]) or SIGNS.get(t[0]) or t[0]))
            if until > t.end():
                edits.append((t.end(), until, ""))
    m.replace(edits)


def _brackets(text: str) -> list[tuple[int, int, str]]:
    edits, done = [], 0
    for x in BRACKET.finditer(text):
        start, end = x.span()
        while start > done and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        edits.append((start, end, "@" if x["at"] else "."))
        done = end
    return edits


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Edits of addresses in bare words: a local part, an at, and a domain with a dot spelled. Each
    part is words with dots between; a dot is '.', or a dot word in white space."""
    p = [(m.start(), m.end(), m.lastgroup, m[0].lower()) for m in PIECE.finditer(text)]
    n = len(p)
    word = lambda i: 0 <= i < n and p[i][2] == "word"
    space = lambda i: 0 <= i < n and p[i][2] == "space"

    def dot(i: int, step: int) -> tuple[int, tuple[int, int, str] | None] | None:
        """The piece after a dot that begins at i in the direction of step, and the edit it asks for."""
        if 0 <= i < n and p[i][3] == "." and word(i + step):
            return i + step, None
        if space(i) and word(i + step) and p[i + step][3] in BARE_DOT and space(i + 2 * step) and word(i + 3 * step):
            first, last = min(i, i + 2 * step), max(i, i + 2 * step)
            return i + 3 * step, (p[first][0], p[last][1], ".")
        return None

    edits, done = [], 0
    for i in range(n):
        if word(i) and p[i][3] in BARE_AT and space(i - 1) and space(i + 1):
            left, right = i - 2, i + 2
        elif p[i][3] == "@":
            left, right = i - 1 - (space(i - 1) and p[i - 1][1] - p[i - 1][0] == 1), i + 1 + (space(i + 1) and p[i + 1][1] - p[i + 1][0] == 1)
        else:
            continue
        if not (word(left) and word(right)) or left < done or p[left][3] in BARE_DOT or not HOST.fullmatch(p[right][3]):
            continue
        at, before, after, spelled, dots = (p[left + 1][0] if left + 1 < i else p[i][0], p[right - 1][1] if right - 1 > i else p[i][1], "@"), [], [], False, 0
        while (met := dot(right + 1, 1)) and HOST.fullmatch(p[met[0]][3]):
            right, dots = met[0], dots + 1
            if met[1]:
                after.append(met[1])
                spelled = True
        if not spelled:
            continue
        while (met := dot(left - 1, -1)) and met[0] >= done:
            left = met[0]
            if met[1]:
                before.append(met[1])
        edits += [*reversed(before), at, *after]
        done = right + 1
    return edits


def _at_dot(m: Mapped) -> None:
    m.replace(_brackets(m.text))
    if HINT_DOT.search(m.text):
        # A stop may end a sentence: bare words are an address only with a dot spelled in the domain.
        m.replace(_bare(m.text))


HINT_DOT = re.compile(r"\s(?:dot|punkt|point|punto)\s", re.I)


def _disguised(text: str) -> bool:
    """False only for texts that no transducer would change."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return True
        if "\xa0" in text or "\xad" in text or "\xb7" in text:
            return True
    return bool(SPELLED_HINT.search(_lower(text)) or BRACKET.search(text) or HINT_DOT.search(text))


def added_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans of identifiers that show only after deobfuscation."""
    if not _disguised(text):
        return []
    m = Mapped(text)
    for transducer in (_homoglyphs, _spelled_digits, _at_dot):
        transducer(m)
    if m.text == text:
        return []
    # Plain spans taken, as a running maximum of ends over starts.
    taken, found, k, reach = sorted((s, e) for s, _, e in plain), [], 0, -1
    mapped = sorted((m.start[s], kind, m.end[e - 1], s, e) for s, kind, e in plain_spans(m.text))
    for start, kind, end, s, e in mapped:
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= start and text[start:end] != m.text[s:e]:
            found.append((start, kind, end))
    return found


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans, each by start and then kind."""
    plain = plain_spans(text or "")
    added = added_spans(text or "", plain)
    return plain, sorted([*plain, *added]) if added else plain


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, mask: str = "<{}>") -> str | None:
    """The text with every span replaced by its kind; overlapping spans take the first kind."""
    if text is None:
        return None
    out, at = [], 0
    for s, k, e in find_spans(text)[1]:
        if s >= at:
            out += [text[at:s], mask.format(KINDS[k].upper())]
        at = max(at, e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_redacted: bool = False) -> DataFrame:
    """doc_id, plain counts by kind, base_sha256, spans, n_added (and redacted text on demand)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch["doc_id"], batch["text"]):
                plain, every = find_spans(body)
                kinds = [k for _, k, _ in plain]
                row = [doc_id, *(kinds.count(k) for k in range(4)), hashlib.sha256(render(plain).encode()).hexdigest(), render(every), len(every) - len(plain)]
                rows.append([*row, redact(body)] if with_redacted else row)
            out = pd.DataFrame([row[1:] for row in rows], columns=names[1:])
            out.insert(0, "doc_id", pd.array([row[0] for row in rows], dtype="Int64"))
            yield out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + (", redacted string" if with_redacted else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return map_pandas(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)


def op2_deobfuscated_pii(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
