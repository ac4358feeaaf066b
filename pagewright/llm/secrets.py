"""Secret scan: rules, and a character convolutional network over every candidate.

Base findings come from three rules (``assign``, ``access``, ``hex``).  A
candidate is every run of 8 or more characters that keys and passwords are
made of, words and numbers of prose included; of ``name=value`` the value.  A small
convolutional network, in numpy, reads each candidate with its surrounding
context: characters are embedded by the first convolution, the strongest
response of each filter is kept separately for the text before the candidate, the candidate and
the text after it, and two dense layers give a logit.  Long candidates are
read in windows, whole; the highest window counts.

Training.  The base rules label the candidates of all documents.  The first weights are learned
from at most ``MAX_FINDINGS`` different ones, half of them secrets, and of
each half at most half plain (words or numbers, that only their context can tell):
of each sort those with the smallest hashes.  Every task keeps only its own
smallest, so rare secrets are all found and little moves.  Then every candidate of the table takes part:
``ROUNDS`` steps follow the gradient over all of the first three folds, the four sorts weighted as before.
Half of the labelled candidates, plain secrets apart, are shown without what stands before them, so the network must
learn the key itself and not only its label.  All of the fourth fold
calibrate the probability (Platt scaling), and on all of the fifth the threshold
of each candidate shape and length is the highest that still recalls ``RECALL`` of the
labelled secrets, each shown with and without its label (plain ones as they stand; a plain shape
with too few secrets keeps clear of every other candidate of that shape).  A secret counts once
in both, any other candidate as often as it is there; logits are counted in steps of ``1 / BINS``.
Candidates above their threshold that touch no base finding are added with kind ``cnn``.

Candidates are found, labelled and shaped by arrays over many texts at once.  Their windows overlap, so the
convolution runs once along the text and every candidate takes its largest
responses from there (``_pooled_spans``); the few that fill their window are read by rows of codes.

The model is a few thousand numbers and goes to every task; scanning is one
pass over whole texts in Arrow batches, without a shuffle.  Nulls: a null text
is empty and has no span; a null id is kept.  Repeated rows get equal answers;
without enough labelled candidates of both classes in the whole table there is
no network, which is logged as a warning, and only base findings are returned; only the named columns are used, so others can't clash; an empty
table gives an empty result.
"""

from __future__ import annotations

import logging
import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import materialize, ship, text_of

KINDS = ("assign", "access", "hex", "cnn")
NAMES = ("passw", "secret", "token", "apikey", "api_key")  # every assignment's name has one of these in it
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY = r"A-Za-z0-9+/_.=!@#$%^&*~?-"  # characters of keys and passwords
LONG = 16  # candidates from this length on have thresholds of their own
NAMED = re.compile(f"[A-Za-z_][A-Za-z0-9_.-]*=(?=[{KEY}]{{8}})(?!=)")
# Words and numbers as prose has them, with the marks between and after them.
MARKS = r"[+/_.=!?-]"
WORDS = re.compile(f"{MARKS}*+(?>[A-Z]?[a-z]++|[A-Z]++)(?:{MARKS}++(?>[A-Z]?[a-z]++|[A-Z]++))*+{MARKS}*+")
NUMBERS = re.compile(f"{MARKS}*+[0-9]++(?:{MARKS}++[0-9]++)*+{MARKS}*+")

BEFORE, INSIDE, AFTER = 24, 48, 12  # characters the network sees
WIDTH, FILTERS, HIDDEN = 5, 16, 16
MAX_FINDINGS = 12_000
RECALL = 0.99
STEPS = 600  # batches that the first weights take
ROUNDS = 2  # steps after them, each by the gradient over every candidate
BINS = 256  # steps of a logit that held-out scores are counted in
GROUPS = 16  # of tasks whose gradients are added before they reach the driver
SHAPES = ("hex", "upper", "mixed", "word", "digits")
PLAIN = 3  # from this shape on only the context tells
log = logging.getLogger(__name__)


def base_findings(text: str, long: bool = True) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the rules' findings, in order; ``long``: the text may hold 32 key characters in a row."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if long:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that the network scores; of ``name=value`` only the value."""
    found = Texts([text])
    return list(zip((found.start - BEFORE).tolist(), (found.stop - BEFORE).tolist()))


class Touching:
    """Whether a span touches one of some others: sorted starts and the largest end so far, so one search a span."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends, most = [], [], 0
        for start, end in sorted(spans):
            most = max(most, end)
            self.starts.append(start)
            self.ends.append(most)

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start

    def each(self, start, stop):
        """The same for arrays of spans."""
        import numpy as np

        i = np.searchsorted(np.array(self.starts, np.int64), stop) - 1
        return (i >= 0) & (np.array([*self.ends, 0], np.int64)[i] > start)


def values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the keys of the base findings are: of an assignment only its value."""
    return [(ASSIGN.match(text, s).start(2) if k == 0 else s, e) for s, k, e in base]


def shape_of(token: str) -> int:
    """Number of the token's shape; short tokens have their own."""
    short = len(SHAPES) if len(token) < LONG else 0
    if WORDS.fullmatch(token):
        return short + 3
    if NUMBERS.fullmatch(token):
        return short + 4
    if all(ch in "0123456789abcdef" for ch in token):
        return short
    return short + (1 if token.isupper() else 2)


# What a candidate's characters are, one bit each; the last one marks a letter that no word goes on with.
DIGIT, LOW_HEX, LOW, UPPER, MARK, OTHER, BREAK = (1 << i for i in range(7))


def _bits(char: str) -> int:
    """The bits of a character; none for what no key is made of."""
    of = ((DIGIT, "[0-9]"), (LOW_HEX, "[a-f]"), (LOW, "[g-z]"), (UPPER, "[A-Z]"), (MARK, MARKS), (OTHER, f"[{KEY}]"))
    return next((bit for bit, some in of if re.fullmatch(some, char)), 0)


def _shape(bits: int) -> int:
    """Of the bits of all characters of a long token together its shape, as ``shape_of`` has it."""
    letters = bits & (LOW_HEX | LOW | UPPER)
    if letters and not bits & (DIGIT | OTHER | BREAK):
        return 3
    if bits & DIGIT and not letters and not bits & OTHER:
        return 4
    if not bits & ~(DIGIT | LOW_HEX | BREAK):
        return 0
    return 1 if bits & UPPER and not bits & (LOW_HEX | LOW) else 2


CODES = bytes(c if 1 < c < 127 else 1 for c in range(256))  # of each character; 127 and above: any beyond ASCII
BITS = bytes(_bits(chr(c)) if 1 < c < 127 else 0 for c in range(256))
NAME_END = bytes(chr(c) in "dtnyDTNY\"' " for c in range(128))
SHAPE = bytes(_shape(bits) for bits in range(128))


class Texts:
    """Several texts as one array of character codes with pads around each, and the candidates of all of them.

    ``codes[at[i]]`` is the first character of text ``i``; ``start`` and
    ``stop`` are the candidates' places in ``codes``, in order, ``shape`` their shapes.
    """

    def __init__(self, texts: list[str]):
        import numpy as np

        gap = "\0" * BEFORE
        joined = gap + gap.join(texts) + "\0" * (INSIDE + AFTER)
        size = np.array([len(t) for t in texts], np.int64)
        self.texts, self.at = texts, BEFORE + np.cumsum(size + BEFORE) - size - BEFORE
        if joined.isascii():
            raw = joined.encode("ascii")
        else:
            raw = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 127).astype(np.uint8).tobytes()
        codes, bits = (np.frombuffer(bytearray(raw.translate(table)), np.uint8) for table in (CODES, BITS))
        codes[:BEFORE] = 0
        codes[(self.at + size)[:, None] + np.arange(BEFORE)] = 0
        codes[-INSIDE - AFTER:] = 0
        edge = np.diff((bits > 0).view(np.int8))
        start, stop = (np.flatnonzero(edge) + 1).reshape(-1, 2).T
        long = stop - start >= 8
        start, stop = start[long], stop[long]
        # Access keys are 16 key characters in a row, hex keys 32; before an assignment's sign is its name, a quote or a space.
        sign = np.flatnonzero((codes == ord("=")) | (codes == ord(":")))
        sign = sign[np.frombuffer(NAME_END, np.uint8)[codes[sign - 1]] > 0]
        self.some, self.long = np.zeros((2, len(texts)), bool)
        for flag, places in ((self.some, sign), (self.some, start[stop - start >= 16]), (self.long, start[stop - start >= 32])):
            flag[np.searchsorted(self.at, places, "right") - 1] = True
        equal = np.flatnonzero(codes == ord("="))
        run = np.searchsorted(start, equal, "right") - 1
        for i in np.unique(run[(run >= 0) & (equal < np.append(stop, 0)[run])]).tolist():
            if name := NAMED.match(joined, start[i], stop[i]):
                start[i] = name.end()
        up, low = (bits & UPPER) > 0, (bits & (LOW_HEX | LOW)) > 0
        bits[1:] |= (low[:-1] & up[1:]) * np.uint8(BREAK)
        bits[2:] |= (up[:-2] & up[1:-1] & low[2:]) * np.uint8(BREAK)
        self.codes, self.start, self.stop, self.shape = codes, start, stop, np.zeros(0, int)
        if len(start):
            all_bits = np.bitwise_or.reduceat(bits, np.stack([start, stop], axis=1).ravel())[::2]
            self.shape = np.frombuffer(SHAPE, np.uint8)[all_bits].astype(int) + len(SHAPES) * (stop - start < LONG)

    def bases(self) -> list[list[tuple[int, int, int]]]:
        return [base_findings(t, long) if some else [] for t, some, long in zip(self.texts, self.some.tolist(), self.long.tolist())]

    def keep(self, some) -> None:
        self.start, self.stop, self.shape = self.start[some], self.stop[some], self.shape[some]

    def touching(self, spans: list[list[tuple[int, int]]]):
        """Which candidates touch one of ``spans``, given per text."""
        import numpy as np

        found = [(at + s, at + e) for at, some in zip(self.at.tolist(), spans) for s, e in some]
        return Touching(found).each(self.start, self.stop) if found else np.zeros(len(self.start), bool)

    def label(self) -> None:
        """Sets ``sort``, 2 * secret + plain, and leaves out what is neither: the name in front of a secret."""
        bases = self.bases()
        secret = self.touching([values(t, base) if base else [] for t, base in zip(self.texts, bases)])
        some = secret | ~self.touching([[(s, e) for s, _, e in base] for base in bases])
        self.keep(some)
        self.sort = 2 * secret[some] + (self.shape % len(SHAPES) >= PLAIN)

    def rows(self, start, stop):
        """Rows of codes of spans of at most ``INSIDE`` characters, as ``window_rows`` has them."""
        import numpy as np

        view = np.lib.stride_tricks.sliding_window_view
        out = np.empty((len(start), BEFORE + INSIDE + AFTER), np.uint8)
        out[:, :BEFORE] = view(self.codes, BEFORE)[start - BEFORE]
        out[:, BEFORE:BEFORE + INSIDE] = view(self.codes, INSIDE)[start] * (np.arange(INSIDE, dtype=np.uint8) < (stop - start).astype(np.uint8)[:, None])
        out[:, BEFORE + INSIDE:] = view(self.codes, AFTER)[stop]
        return out


def text_blocks(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts, about ``BLOCK`` characters together."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + BEFORE
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def windows(text: str, start: int, end: int) -> list[list[int]]:
    """Character codes of a candidate's windows, each with its context: 0 pads, 1 is any character beyond ASCII."""
    return window_rows(text_codes(text), [(at, min(end, at + INSIDE)) for at in range(start, end, INSIDE)]).tolist()


def text_codes(text: str):
    """One code per character, with the pads that windows reach into around them."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(codes) + BEFORE + INSIDE + AFTER, np.uint8)
    out[BEFORE:BEFORE + len(codes)] = np.where((codes > 1) & (codes < 127), codes, 1)
    return out


def window_rows(codes, spans: list[tuple[int, int]], inside: int = INSIDE):
    """A row of codes per span of at most ``inside`` characters: before, the span itself padded, after."""
    import numpy as np

    at, stop = np.array(spans, np.int64).reshape(-1, 2).T
    rows = np.empty((len(at), BEFORE + inside + AFTER), np.uint8)
    within = np.arange(inside)
    rows[:, :BEFORE] = codes[at[:, None] + np.arange(BEFORE)]
    held = within < (stop - at)[:, None]
    rows[:, BEFORE:BEFORE + inside] = np.where(held, codes[np.where(held, BEFORE + at[:, None] + within, 0)], 0)
    rows[:, BEFORE + inside:] = codes[BEFORE + stop[:, None] + np.arange(AFTER)]
    return rows


# -------------------------------------------------------------------- network

class Adam:
    """Steps of weights ``p`` down their gradient."""

    def __init__(self, p: dict, rate: float):
        import numpy as np

        self.rate, self.steps = rate, 0
        self.m, self.v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))

    def step(self, p: dict, g: dict) -> None:
        import numpy as np

        self.steps += 1
        for k in p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            p[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.steps)) + 1e-8)


class CharCnn:
    """Convolution, max pooling by region, two dense layers; trained with Adam."""

    def __init__(self, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        pooled = 3 * FILTERS
        self.p = {
            "conv": rng.normal(0, 0.1, (WIDTH, 128, FILTERS)), "bias": np.zeros(FILTERS),
            "w1": rng.normal(0, pooled ** -0.5, (pooled, HIDDEN)), "b1": np.zeros(HIDDEN),
            "w2": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b2": np.zeros(1),
        }
        self.scale, self.shift = 1.0, 0.0
        self.thresholds = [1.0] * (2 * len(SHAPES))  # long tokens, then short ones
        self._tables = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}  # built anew from the weights where they are used

    @staticmethod
    def _regions(inside: int = INSIDE):
        # Positions of the convolution's output whose centre lies in each region.
        half = WIDTH // 2
        return ((0, BEFORE - half), (BEFORE - half, BEFORE + inside - half), (BEFORE + inside - half, BEFORE + inside + AFTER - 2 * half))

    def _forward(self, x):
        import numpy as np

        p, size = self.p, x.shape[1] - WIDTH + 1
        conv = p["bias"] + sum(p["conv"][w][x[:, w:w + size]] for w in range(WIDTH))
        conv = np.maximum(conv, 0)
        at = [conv[:, a:b].argmax(axis=1) + a for a, b in self._regions()]
        pooled = np.concatenate([np.take_along_axis(conv, i[:, None, :], axis=1)[:, 0] for i in at], axis=1)
        hidden = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        return at, pooled, hidden, hidden @ p["w2"] + p["b2"][0]

    def _responses(self, x):
        """The convolution's output for rows of codes, before its cut at zero."""
        return self._grams(x.T).swapaxes(0, 1)

    def _grams(self, x):
        """The same along the first axis of ``x``: for each place there, of all rows."""
        import numpy as np

        if self._tables is None:
            # What two neighbouring characters add to a filter, by their two codes; the last character alone.
            conv = self.p["conv"].astype(np.float32)
            pair = lambda a, b: (conv[a][:, None] + conv[b][None]).reshape(-1, FILTERS)
            self._tables = pair(0, 1), pair(2, 3), conv[4] + self.p["bias"].astype(np.float32)
        first, second, last = self._tables
        size, some = len(x) - WIDTH + 1, x.astype(np.intp)
        pairs = some[:-1] * 128 + some[1:]
        conv = np.take(first, pairs[:size], axis=0)
        conv += np.take(second, pairs[2:2 + size], axis=0)
        conv += np.take(last, some[4:], axis=0)
        return conv

    def logits(self, x):
        """Scores of rows of codes; their span may be padded to any width that ends in four or more pads."""
        import numpy as np

        p, out = self.p, [np.zeros(0)]
        regions = self._regions(x.shape[1] - BEFORE - AFTER)
        for i in range(0, len(x), 512):
            conv = self._responses(x[i:i + 512])
            pooled = np.maximum(np.concatenate([conv[:, a:b].max(axis=1) for a, b in regions], axis=1), 0)
            out.append(np.maximum(pooled @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"][0])
        return np.concatenate(out)

    def _pooled_spans(self, codes, start, stop, alone, grams: bool = False):
        """Pooled responses of spans of 8 to ``SHORT`` characters that share ``codes``; ``alone``: without what is before.

        Neighbouring spans see the same characters, so the convolution runs
        once along the text.  The largest response of a stretch is the larger
        one of the stretches of 4 or 8 that cover it.  Only the few
        places where a span's pads come into view are a span's own.  With
        ``grams`` follow all fives of codes, times ``FILTERS``, and which of them is behind each value.
        """
        import numpy as np

        def numbered(conv, numbers, out=None):
            out = np.empty(conv.shape) if out is None else out
            out[...] = conv
            out.view(np.int64)[...] |= numbers
            return out

        lo = int(start[0]) - BEFORE
        part, s, e = codes[lo:int(stop.max()) + AFTER], start - lo, stop - lo
        four = np.lib.stride_tricks.sliding_window_view(part, 4)
        tail, head = np.zeros((12, len(s)), np.uint8), np.zeros((8, int(alone.sum())), np.uint8)
        tail[:4], tail[8:], head[4:] = four[e - 4].T, four[e].T, four[s[alone]].T
        own = [self._grams(head), self._grams(tail), self._grams(np.zeros((WIDTH, 1), np.uint8))]
        if grams:
            # A response takes 24 of a double's 53 binary places: its place goes into the rest, the first one the largest
            # (where responses are negative, it doesn't matter which one it is).
            at = [head.shape[1] * 4, len(part), tail.shape[1] * 8, 1]
            last = sum(at) - 1
            own = [numbered(x, np.arange(last - first, last - first - x.size // FILTERS, -1).reshape(*x.shape[:-1], 1))
                   for x, first in zip(own, (0, at[0] + at[1], last))]
            countdown = np.repeat(np.arange(CELL + BEFORE + INSIDE + AFTER)[::-1], FILTERS).reshape(-1, FILTERS)
        head_conv, tail_conv, pad = own
        # Where in a table of largest responses each span's three stretches are found.
        a = np.where(alone, s, s - 2)
        size, length = CELL + BEFORE + INSIDE + AFTER, e - 4 - a
        level = np.where(length < 8, 0, size)
        where = np.stack([size + s - BEFORE, size + s - 16, level + a, level + e - 4 - np.where(length < 8, 4, 8), size + s - 10, size + e], axis=1)
        out = np.empty((len(s), 3, FILTERS), tail_conv.dtype)
        levels, narrow, added = np.empty((2, size, FILTERS), out.dtype), np.empty((2, size, FILTERS), out.dtype), np.empty((2, size, FILTERS), np.float32)
        flat, wide_ones = levels.reshape(-1, FILTERS), np.flatnonzero(length > 16)
        some = part.astype(np.intp)
        pairs = some[:-1] * 128 + some[1:]
        first, second, third = self._tables
        cuts = [0, *(np.flatnonzero(np.diff((s - BEFORE) // CELL)) + 1).tolist(), len(s)]
        for i, j in zip(cuts, cuts[1:]):
            begin = int(s[i]) - BEFORE
            n = int(e[i:j].max()) + AFTER - begin - WIDTH + 1
            conv, more = added[:, :n]
            np.take(first, pairs[begin:begin + n], axis=0, out=conv, mode="clip")
            for table, at_code in ((second, pairs[begin + 2:begin + 2 + n]), (third, some[begin + 4:begin + 4 + n])):
                np.take(table, at_code, axis=0, out=more, mode="clip")
                np.add(conv, more, out=conv)
            if grams:
                conv = numbered(conv, countdown[:n], narrow[1, :n])
            wide = np.maximum(conv[:-1], conv[1:], out=narrow[0, :n - 1])
            for k, shift in enumerate((2, 4)):
                wide = np.maximum(wide[:-shift], wide[shift:], out=levels[k, :len(wide) - shift])
            got = np.take(flat, where[i:j] - begin, axis=0, mode="clip")
            np.maximum(got[:, 0:4:2], got[:, 1:4:2], out=out[i:j, :2])
            np.maximum(out[i:j, 0], got[:, 4], out=out[i:j, 0])
            out[i:j, 2] = got[:, 5]
            long = wide_ones[slice(*np.searchsorted(wide_ones, (i, j)))]
            for k in range(8, SHORT, 8) if len(long) else ():
                out[long, 1] = np.maximum(out[long, 1], flat[where[long, 2] + np.minimum(k, length[long] - 8) - begin])
            if grams:
                out[i:j].view(np.int64)[...] += last - at[0] - begin - size + 1
        for r, places in ((1, (*tail_conv[:6], pad[0])), (2, tail_conv[6:])):
            most = places[0]
            for x in places[1:]:
                np.maximum(most, x, out=most)
            np.maximum(out[:, r], most, out=out[:, r])
        if len(head_conv[0]):
            out[alone, 0] = np.maximum(np.maximum(head_conv[0], head_conv[1]), pad[0])
            out[alone, 1] = np.maximum(np.maximum(head_conv[2], head_conv[3]), out[alone, 1])
        out = out.reshape(len(s), 3 * FILTERS)
        if not grams:
            return np.maximum(out, 0)
        places = out.view(np.int64) & PLACE
        out.view(np.int64)[...] ^= places
        seen = [np.concatenate([head[w:w + 4].ravel(), part[w:], part[:w], tail[w:w + 8].ravel(), part[:1] * 0])[::-1] for w in range(WIDTH)]
        return np.maximum(out, 0), [x * np.uint16(FILTERS) for x in seen], places

    @staticmethod
    def _stretches(start, stop) -> Iterator:
        """Indices of short spans, in the order of the text, those of a stretch of it together."""
        import numpy as np

        order = np.argsort(start, kind="stable")
        order = order[(stop - start)[order] <= SHORT]
        cuts = np.flatnonzero(np.diff(start[order] // STRETCH)) + 1
        return (some for some in np.split(order, cuts) if len(some))

    def span_logits(self, texts: Texts, start, stop, alone):
        """``logits`` of spans of 8 to ``INSIDE`` characters."""
        import numpy as np

        p, out = self.p, np.zeros(len(start))
        for some in self._stretches(start, stop):
            pooled = self._pooled_spans(texts.codes, start[some], stop[some], alone[some])
            out[some] = np.maximum(pooled @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"][0]
        rest = np.flatnonzero(stop - start > SHORT)
        if len(rest):
            x = texts.rows(start[rest], stop[rest])
            x[alone[rest], :BEFORE] = 0
            out[rest] = self.logits(x)
        return out

    def span_gradients(self, texts: Texts, start, stop, alone, y, sort):
        """``gradients`` of spans of 8 to ``INSIDE`` characters."""
        import numpy as np

        out = np.zeros((4, sum(w.size for w in self.p.values())))
        conv, filters = np.zeros((WIDTH, 4 * 128 * FILTERS)), np.tile(np.arange(FILTERS), 3)
        for some in self._stretches(start, stop):
            pooled, seen, places = self._pooled_spans(texts.codes, start[some], stop[some], alone[some], grams=True)
            hidden = np.maximum(pooled @ self.p["w1"] + self.p["b1"], 0)
            d = 1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"][0], -60, 60))) - y[some]
            dh = np.outer(d, self.p["w2"]) * (hidden > 0)
            dp = (dh @ self.p["w1"].T) * (pooled > 0)
            full = np.flatnonzero(dp)
            weight, places = dp.take(full), places.take(full)
            cell = (sort[some][:, None] * (128 * FILTERS) + filters).take(full)
            for w in range(WIDTH):
                conv[w] += np.bincount(cell + seen[w].take(places), weight, conv.shape[1])
            rest = np.zeros((4, out.shape[1] - len(conv[0]) // 4 * WIDTH - FILTERS))
            found = np.bincount(sort[some], minlength=4)
            often = int(found.argmax())
            for k in np.flatnonzero(found):
                # The most frequent sort has what the others leave of the sum over all rows.
                here = slice(None) if k == often else sort[some] == k
                rest[k] = np.concatenate([np.ravel(pooled[here].T @ dh[here]), dh[here].sum(axis=0), hidden[here].T @ d[here], [d[here].sum()]])
            rest[often] -= rest.sum(axis=0) - rest[often]
            out[:, -rest.shape[1]:] += rest
        conv = conv.reshape(WIDTH, 4, 128, FILTERS)
        # The first characters tell how much each filter gets.
        out[:, :conv.size // 4 + FILTERS] = np.concatenate([conv.swapaxes(0, 1).reshape(4, -1), conv[0].sum(axis=1)], axis=1)
        rest = np.flatnonzero(stop - start > SHORT)
        if len(rest):
            x = texts.rows(start[rest], stop[rest])
            x[alone[rest], :BEFORE] = 0
            out += self.gradients(x, y[rest], sort[rest])
        return out

    def probability(self, x):
        return self.calibrated(self.logits(x))

    def calibrated(self, z):
        import numpy as np

        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * z + self.shift, -60, 60)))

    def _gradient(self, x, at, pooled, hidden, d) -> dict:
        """What each weight adds, summed over the rows, from ``d``, the slope of the loss by each row's logit."""
        import numpy as np

        g = {"w2": hidden.T @ d, "b2": np.array([d.sum()])}
        dh = np.outer(d, self.p["w2"]) * (hidden > 0)
        g["w1"], g["b1"] = pooled.T @ dh, dh.sum(axis=0)
        dp = (dh @ self.p["w1"].T) * (pooled > 0)
        g["bias"] = dp.reshape(len(x), 3, FILTERS).sum(axis=(0, 1))
        g["conv"] = np.zeros_like(self.p["conv"])
        f = np.arange(FILTERS)[None, :]
        for r, places in enumerate(at):
            part = dp[:, r * FILTERS:(r + 1) * FILTERS].ravel()
            for w in range(WIDTH):
                cell = np.take_along_axis(x, places + w, axis=1).astype(np.intp) * FILTERS + f
                g["conv"][w] += np.bincount(cell.ravel(), part, 128 * FILTERS).reshape(128, FILTERS)
        return g

    def gradients(self, x, y, sort):
        """Per sort of the rows: sum of the gradient, as one vector in the order of ``p``."""
        import numpy as np

        out = np.zeros((4, sum(w.size for w in self.p.values())))
        for i in range(0, len(x), 512):
            some = x[i:i + 512]
            conv = self._responses(some)
            at = [conv[:, a:b].argmax(axis=1) + a for a, b in self._regions()]
            pooled = np.concatenate([np.take_along_axis(conv, j[:, None, :], axis=1)[:, 0] for j in at], axis=1).astype(float)
            pooled = np.maximum(pooled, 0)
            hidden = np.maximum(pooled @ self.p["w1"] + self.p["b1"], 0)
            logit = hidden @ self.p["w2"] + self.p["b2"][0]
            d = 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[i:i + 512]
            for k in np.unique(sort[i:i + 512]):
                here = sort[i:i + 512] == k
                g = self._gradient(some[here], [j[here] for j in at], pooled[here], hidden[here], d[here])
                out[k] += np.concatenate([g[name].ravel() for name in self.p])
        return out

    def train(self, x, y, shapes=None, steps: int = STEPS, rate: float = 3e-3, batch: int = 128, seed: int = 7) -> Adam:
        import numpy as np

        # A plain secret is one by its context alone.
        told = np.zeros(len(x), bool) if shapes is None else (shapes % len(SHAPES) >= PLAIN) & (y > 0)
        rng = np.random.default_rng(seed)
        adam = Adam(self.p, rate)
        weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        while adam.steps < steps:
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                some = order[i:i + batch]
                xb = x[some].copy()
                xb[(rng.random(len(some)) < 0.5) & ~told[some], :BEFORE] = 0
                at, pooled, hidden, logit = self._forward(xb)
                d = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[some]) * weight[some] / len(some)
                adam.step(self.p, self._gradient(xb, at, pooled, hidden, d))
        self._tables = None
        return adam

    def calibrate(self, x, y) -> None:
        """Platt scaling: the logistic line through the held-out logits."""
        self.calibrate_counts(self.logits(x), y)

    def calibrate_counts(self, z, y, n=1.0) -> None:
        """The same for logits that occur ``n`` times."""
        import numpy as np

        # Smoothed targets keep the line finite when the classes separate.
        pos, neg = (n * y).sum(), (n * (1 - y)).sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        def loss(a, b):
            u = a * z + b
            return float((n * (np.logaddexp(0.0, u) - t * u)).sum())

        a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
        now = loss(a, b)
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            w = n * np.maximum(q * (1 - q), 1e-12)
            grad = np.array([(n * (q - t) * z).sum(), (n * (q - t)).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-9, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
            move, step = np.linalg.solve(hess, grad), 1.0
            # A full Newton step can overshoot without bound where the classes separate.
            while step > 1e-10 and loss(a - step * move[0], b - step * move[1]) > now:
                step /= 2
            if step <= 1e-10:
                break
            a, b = a - step * move[0], b - step * move[1]
            before, now = now, loss(a, b)
            if before - now < 1e-9:
                break
        self.scale, self.shift = float(max(a, 1e-6)), float(b)

    def set_thresholds(self, x, y, shapes, recall: float = RECALL, least: int = 20) -> None:
        """Per shape and length, the highest threshold that recalls ``recall`` of its labelled secrets."""
        import numpy as np

        fair = (shapes % len(SHAPES) < PLAIN) | x[:, :BEFORE].any(axis=1)  # a word without its context tells nothing
        p = self.probability(x[fair])
        self.set_thresholds_counts(p, np.nextafter(p, 2), y[fair], shapes[fair], np.ones(len(p), np.int64), recall, least)

    def set_thresholds_counts(self, low, high, y, shapes, n, recall: float = RECALL, least: int = 20) -> None:
        """The same for ``n`` candidates each between the probabilities ``low`` and, short of it, ``high``."""
        import numpy as np

        def of(found):
            order = np.argsort(low[found])
            upto = np.cumsum(n[found][order])
            if not len(upto):
                return 1.0
            return float(low[found][order][np.searchsorted(upto, int(upto[-1] * (1 - recall)), side="right")])

        everything = of(y > 0)
        for i in range(len(self.thresholds)):
            some = (shapes == i) & (y > 0)
            if n[some].sum() >= least:
                self.thresholds[i] = of(some)
            elif i % len(SHAPES) < PLAIN:
                self.thresholds[i] = everything
            else:
                others = high[(shapes == i) & (y == 0)]
                self.thresholds[i] = max(everything, float(others.max()) if len(others) else 1.0)


class Smallest:
    """The ``size`` different entries ``(hash, *rest)`` with the smallest hashes."""

    def __init__(self, size: int):
        self.size, self.held, self.limit = size, set(), None

    def add(self, entry: tuple) -> None:
        if self.limit is None or entry < self.limit:
            self.held.add(entry)
            if len(self.held) >= 2 * self.size:
                self.held = set(self.entries())
                self.limit = max(self.held)

    def entries(self) -> list[tuple]:
        return sorted(self.held)[:self.size]


def _mixed(h):
    """Evenly spread signed hashes of unsigned sums."""
    import numpy as np

    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def labelled_windows(text: str, factors) -> Iterator:
    """``rows, h, sort, spans`` of a text's labelled candidates, ``WINDOWS`` at a time; sort: 2 * secret + plain."""
    found = Texts([text])
    found.label()
    for some, rows, h in hashed_rows(found, factors):
        at, stop = found.start[some] - BEFORE, found.stop[some] - BEFORE
        yield rows, h, found.sort[some], list(zip(at.tolist(), stop.tolist(), (found.sort[some] >= 2).tolist()))


def hashed_rows(found: Texts, factors) -> Iterator:
    """``some, rows, h``: of each ``WINDOWS`` candidates where they are, their (first) rows of codes and hashes of these."""
    import numpy as np

    for i in range(0, len(found.start), WINDOWS):
        some = slice(i, i + WINDOWS)
        start = found.start[some]
        rows = found.rows(start, np.minimum(found.stop[some], start + INSIDE))
        yield some, rows, _mixed(rows.astype(np.uint64) @ factors)


def hash_factors():
    import numpy as np

    return np.random.default_rng(1).integers(0, 1 << 64, BEFORE + INSIDE + AFTER, np.uint64) | np.uint64(1)


def labelled_findings(docs: DataFrame, text_col: str = "text", max_findings: int = MAX_FINDINGS) -> DataFrame:
    """``h, x, y, shape``: of the labelled candidates of all documents, each task's smallest hashes, by class and plain or not."""
    ship()
    quarter = max_findings // 4

    def label(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        least = [Smallest(quarter) for _ in range(4)]  # 2 * secret + plain
        factors = hash_factors()
        top = np.iinfo(np.int64).max
        limits = np.full(4, top)
        for texts in text_blocks(t.as_py() for batch in batches for t in batch.column(0)):
            found = Texts(texts)
            found.label()
            for some, rows, h in hashed_rows(found, factors):
                sort, shape = found.sort[some], found.shape[some]
                for j in np.flatnonzero(h <= limits[sort]):
                    least[sort[j]].add((int(h[j]), rows[j].tobytes(), int(sort[j] // 2), int(shape[j])))
                limits = np.array([top if x.limit is None else x.limit[0] for x in least])
        rows = [r for some in least for r in some.entries()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int32(), pa.int32()))],
                names=["h", "x", "y", "shape"],
            )

    texts = docs.select(text_of(F.col(f"`{text_col}`")).alias("t"))
    return texts.mapInArrow(label, "h long, x binary, y int, shape int").distinct()


def _smallest(found: DataFrame, size: int) -> list:
    """The ``size`` rows with the smallest hashes.  Only rows below a cut-off go to the driver, about ``2 * size``."""
    all_rows, share = found.count(), 2.0
    while True:
        part = min(1.0, share * size / max(1, all_rows))
        some = found if part >= 1 else found.filter(F.col("h") < F.lit(int(-(1 << 63) + part * (1 << 64))))
        rows = some.orderBy("h", "x", "shape").limit(size).collect()
        if len(rows) >= size or part >= 1:
            return rows
        share *= 2


def folds_of(h, dealt):
    """Fold of each hash: those of ``dealt`` (sorted hashes, their folds) as they were dealt, others by the hash."""
    import numpy as np

    at = np.minimum(np.searchsorted(dealt[0], h), len(dealt[0]) - 1)
    return np.where(dealt[0][at] == h, dealt[1][at], h % 5)


def candidate_blocks(batches: Iterator, dealt, wanted: tuple) -> Iterator:
    """``found, h, fold`` of the labelled candidates of the ``wanted`` folds; many texts a block."""
    import numpy as np

    factors = hash_factors()
    for texts in text_blocks(t.as_py() for batch in batches for t in batch.column(0)):
        found = Texts(texts)
        found.label()
        if not len(found.start):
            continue
        h = np.concatenate([h for _, _, h in hashed_rows(found, factors)])
        fold = folds_of(h, dealt)
        here = np.isin(fold, wanted)
        found.keep(here)
        found.sort = found.sort[here]
        yield found, h[here], fold[here]


def table_gradient(docs: DataFrame, model: CharCnn, dealt, text_col: str = "text"):
    """``counts, sums``: of every candidate to learn from, per sort, how many and the sum of their gradients.

    Half of them, by a bit of their hash, are shown without what stands before
    them, plain secrets apart.  Tasks' sums are added in ``GROUPS`` groups.
    """
    import numpy as np

    ship()

    def slopes(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        n, sums = np.zeros(4, np.int64), 0.0
        for found, h, _ in candidate_blocks(batches, dealt, (0, 1, 2)):
            sort, start = found.sort, found.start
            alone = ((h >> 40) & 1 == 1) & (sort != 3)
            n += np.bincount(sort, minlength=4)
            sums = sums + model.span_gradients(found, start, np.minimum(found.stop, start + INSIDE), alone, (sort >= 2).astype(float), sort)
        if n.any():
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([at % GROUPS], pa.int32()), "at": pa.array([at], pa.int32()),
                                              "n": [n.tobytes()], "g": [sums.tobytes()]})

    def added(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        n = sum(np.frombuffer(r["n"], np.int64) for r in rows)
        g = sum(np.frombuffer(r["g"]) for r in rows)
        return pa.table({"part": pa.array([rows[0]["part"]], pa.int32()), "n": [n.tobytes()], "g": [g.tobytes()]})

    texts = docs.select(text_of(F.col(f"`{text_col}`")).alias("t"))
    tasks = texts.mapInArrow(slopes, "part int, at int, n binary, g binary")
    rows = sorted(tasks.groupBy("part").applyInArrow(added, "part int, n binary, g binary").collect(), key=lambda r: r["part"])
    size = sum(w.size for w in model.p.values())
    return (sum((np.frombuffer(r["n"], np.int64) for r in rows), np.zeros(4, np.int64)),
            sum((np.frombuffer(r["g"]).reshape(4, size) for r in rows), np.zeros((4, size))))


def learn_table(docs: DataFrame, model: CharCnn, adam: Adam, share, dealt, text_col: str = "text") -> None:
    """``ROUNDS`` more steps, each by the gradient over every candidate; ``share``: what each sort weighs together."""
    import numpy as np

    for _ in range(ROUNDS):
        n, sums = table_gradient(docs, model, dealt, text_col)
        g = (np.where(n > 0, share / np.maximum(n, 1), 0.0)[:, None] * sums).sum(axis=0)
        ends = np.cumsum([w.size for w in model.p.values()])
        adam.step(model.p, {k: v.reshape(model.p[k].shape) for k, v in zip(model.p, np.split(g, ends[:-1]))})
        model._tables = None


def held_out_scores(docs: DataFrame, model: CharCnn, dealt, text_col: str = "text"):
    """``fold, y, shape, bin, n``: of every held-out candidate with and without what is before it, logits in steps of ``1 / BINS``.

    Plain ones are not judged (fold 4) without it.  A secret that is there
    several times counts once; only their hashes move.
    """
    import numpy as np

    ship()
    span = 2 * 60 * BINS + 2

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(key, h, n):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["key", "h", "n"])

        others = np.zeros(2 * 10 * span, np.int64)  # by fold, shape and step
        for found, h, fold in candidate_blocks(batches, dealt, (3, 4)):
            fair = (fold == 3) | (found.sort % 2 == 0)
            # The character just before a candidate is a pad only where its text starts.
            at = np.concatenate([np.flatnonzero(fair | (found.codes[found.start - 1] > 0)), np.flatnonzero(fair)])
            way = np.arange(len(at)) >= len(at) - fair.sum()
            start, stop = found.start[at], np.minimum(found.stop, found.start + INSIDE)[at]
            step = np.floor(np.clip(model.span_logits(found, start, stop, way), -60, 60) * BINS).astype(np.int64) + 60 * BINS
            shape = np.where(fold == 4, found.shape, 0)
            key = ((fold[at] - 3) * 10 + shape[at]) * span + step
            secret = found.sort[at] >= 2
            np.add.at(others, key[~secret], 1)
            if secret.any():
                yield rows(key[secret] + len(others), h[at][secret] ^ way[secret], np.ones(secret.sum(), np.int64))
        at = np.flatnonzero(others)
        if len(at):
            yield rows(at, [None] * len(at), others[at])

    texts = docs.select(text_of(F.col(f"`{text_col}`")).alias("t"))
    found = texts.mapInArrow(score, "key long, h long, n long").groupBy("key", "h").agg(F.sum("n").alias("n"))
    once = found.select("key", F.when(F.col("h").isNull(), F.col("n")).otherwise(F.lit(1)).alias("n"))
    rows = once.groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
    key, n = (np.array([r[c] for r in rows], np.int64) for c in ("key", "n"))
    sort, step = np.divmod(key, span)
    return 3 + sort // 10 % 2, sort // 20, sort % 10, step - 60 * BINS, n


def train_model(docs: DataFrame, text_col: str = "text", max_findings: int = MAX_FINDINGS, recall: float = RECALL) -> CharCnn | None:
    """A network from the labelled findings of ``docs``; None, and a warning, without enough of both labels."""
    import numpy as np

    found = materialize(labelled_findings(docs, text_col, max_findings), "secret-findings")
    plain = F.col("shape") % len(SHAPES) >= PLAIN
    sorts = [(y, _smallest(found.filter((F.col("y") == y) & (plain if p else ~plain)), max_findings // 4)) for y in (0, 1) for p in (0, 1)]
    # Each sort is dealt to the folds by itself, so a rare one is in all of them.
    rows = sorted(((r, i % 5) for _, some in sorts for i, r in enumerate(some)), key=lambda x: (x[0]["h"], bytes(x[0]["x"]), x[0]["y"]))
    others, known = (sum(len(some) for y, some in sorts if y == of) for of in (0, 1))
    if min(others, known) < 5 or len(rows) < 50:
        log.warning("no secret network, base findings only: %d labelled secrets, %d other candidates in the table", known, others)
        return None
    fold = np.array([i for _, i in rows])
    rows = [r for r, _ in rows]
    x = np.array([np.frombuffer(r["x"], np.uint8) for r in rows]).astype(np.int64)
    y, shape = np.array([r["y"] for r in rows], float), np.array([r["shape"] for r in rows])
    model = CharCnn()
    adam = model.train(x[fold < 3], y[fold < 3], shape[fold < 3])
    # From here on every candidate of the table takes part.
    hashes, first = np.unique(np.array([r["h"] for r in rows], np.int64), return_index=True)
    dealt = hashes, fold[first]
    sort = (2 * y + (shape % len(SHAPES) >= PLAIN)).astype(int)[fold < 3]
    n = np.bincount(sort, minlength=4)
    share = n / (2 * np.maximum(1, np.repeat([n[0] + n[1], n[2] + n[3]], 2)))
    learn_table(docs, model, adam, share, dealt, text_col)
    fold, y, shape, step, n = held_out_scores(docs, model, dealt, text_col)
    some = fold == 3
    model.calibrate_counts((step[some] + 0.5) / BINS, y[some], n[some])
    some = fold == 4
    low, high = (model.calibrated((step[some] + up) / BINS) for up in (0, 1))
    model.set_thresholds_counts(low, high, y[some], shape[some], n[some], recall)
    return model


WINDOWS = 20_000  # rows of codes made at once
NARROW = 24  # width of a short candidate's window: its characters and eight pads or more
SHORT = INSIDE - 5  # up to this length a window holds five pads, and the convolution is read off the text's own
BLOCK = STRETCH = 1 << 16  # characters of texts, and of one text, handled together
CELL = 1 << 12  # characters whose convolution is held at once
PLACE = (1 << 29) - 1  # what a double has beyond a single


def added_findings(texts: list[str], bases: list[list[tuple[int, int, int]]], model: CharCnn) -> list[list[tuple[int, int, int]]]:
    """For each text the candidates clear of every base finding that the network takes for secrets."""
    out: list[list[tuple[int, int, int]]] = []
    for block in text_blocks(iter(texts)):
        out += added_to(Texts(block), bases[len(out):len(out) + len(block)], model)
    return out


def added_to(found: Texts, bases: list[list[tuple[int, int, int]]], model: CharCnn) -> list[list[tuple[int, int, int]]]:
    """The same for the texts of one block."""
    import numpy as np

    out: list[list[tuple[int, int, int]]] = [[] for _ in bases]
    found.keep(~found.touching([[(s, e) for s, _, e in base] for base in bases]))
    short = found.stop - found.start <= SHORT
    start, stop = found.start[short], found.stop[short]
    best = np.zeros(len(found.start))
    best[short] = model.calibrated(model.span_logits(found, start, stop, np.zeros(len(start), bool)))
    rest = np.flatnonzero(~short)
    # A candidate of any length is cut into as many windows as it needs.
    size = -(-(found.stop - found.start)[rest] // INSIDE)
    owner = np.repeat(rest, size)
    begin = found.start[owner] + INSIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size))
    for i in range(0, len(owner), WINDOWS):
        some, at = owner[i:i + WINDOWS], begin[i:i + WINDOWS]
        np.maximum.at(best, some, model.probability(found.rows(at, np.minimum(found.stop[some], at + INSIDE))))
    hits = np.flatnonzero(best >= np.array(model.thresholds)[found.shape])
    of = np.searchsorted(found.at, found.start[hits], "right") - 1
    for i, s, e in zip(of.tolist(), (found.start[hits] - found.at[of]).tolist(), (found.stop[hits] - found.at[of]).tolist()):
        out[i].append((s, 3, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, model: CharCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_cnn``.

    Spans are ``kind:start:end`` in code points, by start, then kind.
    """
    ship()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text"))
    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long"
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *T.StructType.fromDDL(fields).fields])

    def scan(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for texts in text_blocks(t.as_py() for t in batch.column(1)):
                found = Texts(texts)
                bases = found.bases()
                added = added_to(found, bases, model) if model is not None else [[] for _ in texts]
                for base, more in zip(bases, added):
                    rows.append((*[sum(k == i for _, k, _ in base) for i in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(),
                                 joined(sorted(base + more)), len(more)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=schema.names
                )

    return rows.mapInArrow(scan, schema)
