"""Personal data with offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found in the text as it stands.
Then a chain of small transducers rewrites disguises, remembering for every
character of its output which source characters it came from:

* homoglyphs: full-width, mathematical, letter-like, raised and circled forms,
  other scripts' digits, Cyrillic and Greek look-alikes; zero-width characters disappear;
* spelled digits: digit words become digits in runs of words and digits that
  hold three digits or more, commas between them spaces; ``plus`` before a
  digit becomes ``+``;
* at/dot disguises: ``[at]``, ``(dot)``, ``[.]``, spoken ``at`` and ``dot``, in
  any mix with plain ones: spoken ones between the pieces of an address whose
  host ends like a domain (2 to 6 letters of one case), ``dot`` also between numbers;
  ``_at_`` with ``_dot_`` (or hyphens); an ``@`` with spaces about it.  Where ``at`` is
  the only disguise ("met at example.com"), the name must look like one (letters with
  a digit, dot or underscore) or follow a word of address (``mail``, ``to``) and be no
  ordinary word; ``www`` or an article after ``at`` starts no mail host.

Identifiers are detected again in the rewritten text; a hit that contains a
rewritten place is mapped back to its source characters and added.  Base spans
stay as they are.

Every text is scanned whole and on its own in Arrow batches: no shuffle, no
state; a lost task is simply run again.  The scans are linear in the text
length.  Nulls: a null text is empty and has no span; a null id is kept.
Repeated rows get equal answers; only the named columns are used, so others
can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import ship, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
# A start inside a run of digits can't match where the run's start didn't.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alikes of Latin letters in Cyrillic and Greek, in pairs.
LOOKALIKES = "аaеeоoрpсcхxуyіiјjѕsһhԁdԛqԝwАAВBЕEКKМMНHОOРPСCТTХXУYІIЈJЅSαaοoνvρpιiκkυuΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
ZERO_WIDTH = "­​‌‍‎‏⁠﻿"
# Characters that a transducer may rewrite.
ODD = re.compile("[­ʰ-ʸˡ-ˣͰ-ӿԀ-ԯ٠-٩۰-۹०-९ᴬ-ᵪ​-‏․⁠⁰-ₜ"
                 "\u2100-\u214f①-⑳\u24b6-\u24ea﹒﹢﹫﻿！-～\U0001d400-\U0001d7ff\U0001f130-\U0001f149]")
# Digit words of the languages at hand.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
PLUS = re.compile(r"(?<![^\W_])plus\x20(?=[0-9])", re.IGNORECASE)
BRACKETED = re.compile(r"([\[({<])\x20*(at|@|dot|\.|punkt|punto|point|arroba)\x20*([\])}>])\x20*", re.IGNORECASE)
AT = re.compile(r"(?P<spoken>(?<=\x20)at\x20+)|[\[({<]\x20*(?:at|@|arroba)\x20*[\])}>]\x20*|(?P<sign>@\x20*)", re.IGNORECASE)
JOINED_AT = re.compile(r"(?P<by>[_-])at(?P=by)", re.IGNORECASE)
JOINED_LABEL = {"_": re.compile(r"[A-Za-z0-9-]+"), "-": re.compile(r"[A-Za-z0-9]+")}
JOINED_DOT = {by: re.compile(f"{by}dot{by}", re.IGNORECASE) for by in "_-"}
LABEL = re.compile(r"[A-Za-z0-9-]+")
DOT = re.compile(r"(?P<spoken>\x20+dot\x20+)|\x20*[\[({<]\x20*(?:dot|\.|punkt|punto|point)\x20*[\])}>]\x20*|\.", re.IGNORECASE)
ENDING = re.compile(r"[a-z]{2,6}|[A-Z]{2,6}")
NUMBER_DOT = re.compile(r"(?<=[0-9])\x20+dot\x20+(?=[0-9])", re.IGNORECASE)
NUMBER = re.compile(r"[0-9]+")
BETWEEN = re.compile(r"[\x20,-]{1,3}")
CLOSES = {"[": "]", "(": ")", "{": "}", "<": ">"}
BEFORE = 48  # characters that may tell a name from a word
NAME_LIMIT = 64  # characters that a name before an ``@`` may have
NAME_LIKE = re.compile(r"[A-Za-z][._+-]?[0-9]|[A-Za-z0-9][._][A-Za-z]")
# What makes a word before a spoken ``at`` a name: a word of address right before it, or up to two words earlier.
ADDRESSED = re.compile(r"""(?:\b(?:to|cc|bcc|from|by|via|contact|ask|reach|write|ping|email|address)|mail(?:ed|ing|s)?|mailto)"""
                       r"""(?:[:\x20]+[A-Za-z]+){0,2}?[:\x20"'(<]+\Z""", re.IGNORECASE)
NO_HOST = ("www", "the", "a", "an")  # a site or a phrase after a spoken ``at``, no mail host
# Words that stand before a spoken ``at`` in prose.
ORDINARY = frozenset(
    "a about again all also am an and any are arrive arrived article articles available based be been book books buy by check code data details do "
    "docs done download event events file files find found free get go going guide he held help her here him hosted i images information is "
    "it join listed live lives located look looked looking looks made me meet meeting met more not now of offered on one online "
    "only open or order out over page pages parked photos posted prices published read reading reads register seen see sell shop shopping show "
    "shown site sold someone something staff start started stay stayed stop store stored story talk that the their them there they "
    "things this those today up us visit was watch we were what work worked working works yesterday you".split()
)


# ------------------------------------------------------------------ detection

def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local-part characters before an ``@`` and the host after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base identifiers of a text, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        for m in IP.finditer(text, run.start(), run.end()):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= ch <= "9" for ch in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---------------------------------------------------------------- transducers

@lru_cache(maxsize=4096)
def _plain(ch: str) -> str:
    """What a look-alike stands for; the character itself if for nothing."""
    import unicodedata

    if ch in ZERO_WIDTH:
        return ""
    i = LOOKALIKES.find(ch)
    if i >= 0 and i % 2 == 0:
        return LOOKALIKES[i + 1]
    if (d := unicodedata.digit(ch, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and folded.isascii() else ch


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    return [(m.start(), m.end(), p) for m in ODD.finditer(text) if (p := _plain(m.group())) != m.group()]


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Digit words in runs of words and numbers, up to three spaces, commas or hyphens apart, of three digits or more."""
    low, hits = _lower(text), []
    alone = lambda at, end: not (at and low[at - 1].isalnum()) and not (end < len(low) and low[end].isalnum())
    for word, digit in DIGIT_WORDS.items():
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if alone(at, end):
                hits.append((at, end, digit))
            at = low.find(word, end)
    if not hits:
        return []
    hits += [(m.start(), m.end(), None) for m in NUMBER.finditer(low) if alone(*m.span())]
    edits, run, size = [], [], 0
    for hit in [*sorted(hits, key=lambda h: h[:2]), None]:
        if run and (hit is None or not BETWEEN.fullmatch(low, run[-1][1], hit[0])):
            if size >= 3:
                for i, (start, end, digit) in enumerate(run):
                    last = run[i - 1] if i else None
                    # Next to a word, detection wants one space or hyphen.
                    if last and (digit or last[2]) and low[last[1]:start] not in (" ", "-"):
                        edits.append((last[1], start, " "))
                    if digit:
                        edits.append((start, end, digit))
            run, size = [], 0
        if hit:
            run.append(hit)
            size += 1 if hit[2] else hit[1] - hit[0]
    return edits


def _plus(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "+") for m in PLUS.finditer(text)] if "lus " in text or "LUS " in text else []


def _at_dot(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in BRACKETED.finditer(text):
        if CLOSES[m.group(1)] == m.group(3):
            start = m.start()
            while start and text[start - 1] == " ":
                start -= 1
            edits.append((start, m.end(), "@" if m.group(2).lower() in ("at", "@", "arroba") else "."))
    for m in AT.finditer(text):
        edits += _spoken(text, m)
    edits += _joined_up(text)
    edits += [(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(text)]
    return sorted(set(edits))


def _joined_up(text: str) -> list[tuple[int, int, str]]:
    """Edits for ``name_at_host_dot_com``, with underscores or with hyphens; the host needs one such dot."""
    edits, done = [], 0
    for at in JOINED_AT.finditer(text):
        by, dots = at["by"], []
        label = JOINED_LABEL[by].match(text, at.end())
        while label and (dot := JOINED_DOT[by].match(text, label.end())) and (after := JOINED_LABEL[by].match(text, dot.end())):
            dots.append((dot.start(), dot.end(), "."))
            label = after
        if not dots or not ENDING.fullmatch(label.group()) or text[label.end():label.end() + 1] in ("_", "-"):
            continue
        start = at.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at.start():
            edits += [(m.start(), m.end(), ".") for m in JOINED_DOT[by].finditer(text, start + 1, at.start())]
            edits += [(at.start(), at.end(), "@"), *dots]
            done = label.end()
    return edits


def _spoken(text: str, at: re.Match) -> list[tuple[int, int, str]]:
    """Edits for the spoken and spaced parts of the address around an ``at``; none unless a host with a domain's ending follows."""
    start = at.start()
    while start and text[start - 1] == " ":
        start -= 1
    if not start or text[start - 1] not in LOCAL:
        return []
    dots, edits, whole, plain = [], [], False, True
    first = label = LABEL.match(text, at.end())
    while label and (dot := DOT.match(text, label.end())) and (label := LABEL.match(text, dot.end())):
        plain = plain and dot.group() == "."
        if dot["spoken"]:
            dots.append((dot.start(), dot.end(), "."))
        after = text[label.end():label.end() + 1]
        if ENDING.fullmatch(label.group()) and not after.isalnum():
            edits, whole = list(dots), True
    if not whole:
        return []
    spaced = at["sign"] is not None and at.end() - start > 1
    name = _spoken_name(text, start)
    if at["spoken"] or spaced:
        if first.group().lower() in NO_HOST or plain and not name and not _is_name(text, start, spaced):
            return []
        edits.append((start, at.end(), "@"))
    elif not edits:
        return []
    return edits + name


def _spoken_name(text: str, start: int) -> list[tuple[int, int, str]]:
    """Edits for the spoken dots of the name that ends at ``start``."""
    edits = []
    while True:
        while start and text[start - 1] in LOCAL:
            start -= 1
        gap = start
        while gap and text[gap - 1] == " ":
            gap -= 1
        before = gap - 3
        while before > 0 and text[before - 1] == " ":
            before -= 1
        if gap < start and text[max(0, gap - 3):gap].lower() == "dot" and 0 < before < gap - 3 and text[before - 1] in LOCAL:
            edits.append((before, start, "."))
            start = before
        else:
            return edits


def _is_name(text: str, end: int, signed: bool) -> bool:
    """Whether the piece that ends at ``end`` is the name of an address rather than a word of prose; a sign speaks for a name."""
    start = end
    while start > max(0, end - NAME_LIMIT) and text[start - 1] in LOCAL:
        start -= 1
    name = text[start:end]
    if not name[-1].isalnum() or name.lower() in ORDINARY:
        return False
    return signed or bool(NAME_LIKE.search(name) or ADDRESSED.search(text[max(0, start - BEFORE):start]))


class Rewritten:
    """A text after some edits, with the way back to the source's offsets."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self._at, self._edits, at, size = [], [], [], 0, 0
        for start, end, new in edits:
            if start < at:
                continue  # overlaps the edit before it
            parts += [text[at:start], new]
            size += start - at
            self._at.append(size)
            self._edits.append((start, end, len(new)))
            size += len(new)
            at = end
        self.text = "".join([*parts, text[at:]])

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of ``[start, end)`` here, and whether an edit lies in it."""
        first = bisect_right(self._at, start) - 1
        last = bisect_right(self._at, end - 1) - 1
        s, in_first = self._back(start, first, 0)
        e, in_last = self._back(end - 1, last, 1)
        return s, e, last > first or in_first or in_last

    def _back(self, pos: int, i: int, after: int) -> tuple[int, bool]:
        if i < 0:
            return pos + after, False
        start, end, size = self._edits[i]
        into = pos - self._at[i]
        if into < size:
            return (end if after else start), True
        return end + into - size + after, False


def hidden(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of identifiers that only appear once disguises are undone."""
    layers: list[Rewritten] = []
    now = text
    for transducer in (_homoglyphs, _spelled, _plus, _at_dot):
        if edits := transducer(now):
            layers.append(Rewritten(now, edits))
            now = layers[-1].text
    if not layers:
        return []
    found = []
    for start, kind, end in detect(now):
        touched = False
        for layer in reversed(layers):
            start, end, here = layer.source(start, end)
            touched = touched or here
        if touched:
            found.append((start, kind, end))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans``, and ``found``.

    Counts and digest describe the base spans.  ``spans`` is all spans as
    ``kind:start:end`` (code points) joined by commas; ``found`` holds them as
    an array with the source characters of each.
    """
    ship()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text"))
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " \
             "found array<struct<kind: string, start: long, end: long, value: string, hidden: boolean>>"
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *T.StructType.fromDDL(fields).fields])

    def scan(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.struct([
            ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("hidden", pa.bool_())]))]
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                base = detect(text)
                added = sorted(set(hidden(text)) - set(base))
                spans = sorted(base + added)
                more = set(added)
                rows.append((
                    *[sum(k == i for _, k, _ in base) for i in range(4)], hashlib.sha256(joined(base, KINDS).encode()).hexdigest(),
                    joined(spans, KINDS),
                    [{"kind": KINDS[x[1]], "start": x[0], "end": x[2], "value": text[x[0]:x[2]], "hidden": x in more} for x in spans],
                ))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=schema.names
                )

    return rows.mapInArrow(scan, schema)


def redact(text: str, mask: str = "[{}]") -> str:
    """The text with every span, base or hidden, replaced by its kind."""
    out, at = [], 0
    for start, kind, end in sorted(set(detect(text)) | set(hidden(text)), key=lambda x: (x[0], -x[2])):
        if start >= at:
            out += [text[at:start], mask.format(KINDS[kind])]
            at = end
    return "".join([*out, text[at:]])
