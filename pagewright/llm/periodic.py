"""Periodic runs of words: the same few words again and again, at any period.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal), at least ``max(24, 3 * q)`` words long, that no neighbouring
word extends.  Every run of every whole text is found; nothing is sampled.

Method, inside one task and on many documents at a time:

* Words become numbers, documents lie one after another with a number of its
  own between two of them, so no match crosses a boundary.
* Periods up to ``LAG`` are scanned directly: words ``q`` apart are compared
  for every position.
* Longer periods by scale.  A scale serves periods ``low..high`` and names every
  stretch of ``high`` words by a hash, built by doubling.  The smallest hash in
  each window of ``2 * low - high + 1`` neighbouring stretches is a minimizer.
  Inside a run the windows at ``i`` and ``i + q`` are equal, so a minimizer comes
  again ``q`` words later; stretches of at least ``q`` words cannot come again
  any sooner, because the period is the smallest.  So of the minimizers with
  equal hashes only neighbours are paired, never all of a group.  A run of
  ``3 * q`` words is long enough to hold the first window, its repetition and
  the stretch behind it, so each run gives a pair at its scale.
* A pair is a seed: it is extended word by word both ways, and kept if the
  stretch is long enough and no divisor of ``q`` is a period of it.  Seeds in a
  stretch already extended at that period are skipped.

Extension compares words, so a collision of two 64-bit hashes never makes a
run; it could only hide one.  Rows are independent: no shuffle, and a lost task
is computed again from its input.  Documents are taken in chunks of about
``CHUNK`` words; a longer one is a chunk of its own.

Defined cases: null and empty texts have no words, no runs and the empty text
as ``collapsed``; a null id is a value like any other; repeated rows each get
their row; an empty table gives an empty table; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ship

MIN_LENGTH = 24  # words
MIN_EXPONENT = 3  # lengths from so many periods on; two or less could not be seeded this way
LAG = 8  # periods scanned directly
CHUNK = 1 << 18  # words
RUN = "struct<start:long,length:long,period:long>"
FOUND = f"runs array<{RUN}>, best {RUN}, collapsed string"


def scales(longest: int, lag: int = LAG) -> Iterator[tuple[int, int]]:
    """``(low, high)`` for the periods above ``lag`` that fit three times into ``longest`` words."""
    low = lag + 1
    while low * MIN_EXPONENT <= longest:
        high = low * 3 // 2
        yield low, high
        low = high + 1


def _mix(a, b):
    """A hash of pairs of 64-bit hashes (multiply and shift, not linear)."""
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _slide(values, width: int, best):
    """``best`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return best(values[:-rest], values[rest:]) if rest else values


def _seeds(names, low: int, high: int):
    """``(position, period)`` of neighbouring equal minimizers whose distance this scale serves."""
    import numpy as np

    width = 2 * low - high + 1
    if len(names) < width:
        return []
    least = _slide(names, width, np.minimum)
    # A position is a minimizer if the largest of the minima of its windows is its own value.
    ends = np.zeros(width - 1, names.dtype)
    chosen = np.flatnonzero(_slide(np.concatenate([ends, least, ends]), width, np.maximum) == names)
    order = np.argsort(names[chosen], kind="stable")  # equal names stay in text order
    at = chosen[order]
    step = np.diff(at)
    pair = np.flatnonzero((names[at[1:]] == names[at[:-1]]) & (step >= low) & (step <= high))
    found = sorted(zip(at[pair].tolist(), step[pair].tolist()))
    return found


def _reach(equal, start: int, step: int) -> int:
    """How many positions from ``start`` on, in the direction of ``step``, are equal; blocks grow by doubling."""
    import numpy as np

    done, block = 0, 64
    while True:
        same = equal(start + step * done, block)
        miss = np.flatnonzero(~same)
        if len(miss):
            return done + int(miss[0])
        done += len(same)
        if len(same) < block:
            return done
        block *= 2


def _extend(ids, at: int, q: int) -> tuple[int, int]:
    """The first and last-plus-one word of the stretch around ``at`` in which words ``q`` apart are equal."""
    n = len(ids) - q

    def ahead(i, k):
        k = min(k, n - i)
        return ids[i:i + k] == ids[i + q:i + q + k]

    def back(i, k):
        j = max(0, i - k + 1)
        return (ids[j:i + 1] == ids[j + q:i + 1 + q])[::-1]

    right = _reach(ahead, at, 1)
    left = _reach(back, at - 1, -1) if at else 0
    return at - left, at + right + q


def _is_smallest(ids, start: int, q: int) -> bool:
    """No proper divisor of ``q`` is a period of the stretch (a smaller period would be one, as it holds ``2 * q`` words)."""
    import numpy as np

    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if np.array_equal(ids[start:start + 2 * q - d], ids[start + d:start + 2 * q]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _short_periods(ids, lag: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    """Runs ``(start, end, period)`` by direct comparison, one scan of all positions for each period."""
    import numpy as np

    for q in range(1, min(lag, len(ids) - 1) + 1):
        same = np.zeros(len(ids) - q + 2, np.int8)
        same[1:-1] = ids[:-q] == ids[q:]
        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= max(min_length, MIN_EXPONENT * q) - q].tolist():
            if _is_smallest(ids, a, q):
                yield a, b + q, q


def _long_periods(ids, lengths, lag: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    """Runs ``(start, end, period)`` of periods above ``lag``; documents lie by falling length."""
    import numpy as np

    if not lengths:
        return
    ends = np.cumsum(np.array(lengths) + 1)
    doubled, span = _mix(ids.view(np.uint64), np.uint64(1)), 1  # names of `span` words from each position on
    for low, high in scales(lengths[0], lag):
        used = int(ends[np.searchsorted(-np.array(lengths), -low * MIN_EXPONENT, side="right") - 1])
        doubled = doubled[:used]
        while span * 2 <= high:
            doubled, span = _mix(doubled[:-span], doubled[span:]), span * 2
        rest = high - span
        names = _mix(doubled[:-rest], doubled[rest:]) if rest else doubled
        reached: dict[int, int] = {}  # period -> end of the last stretch extended
        for at, q in _seeds(names, low, high):
            if at < reached.get(q, 0):
                continue
            start, end = _extend(ids, at, q)
            reached[q] = end - q + 1
            if end - start >= max(min_length, MIN_EXPONENT * q) and _is_smallest(ids, start, q):
                yield start, end, q


def find_runs(texts: list[list[bytes]], lag: int = LAG, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs ``(start, length, period)`` by start, then period."""
    import numpy as np

    order = sorted((i for i, words in enumerate(texts) if len(words) >= min_length), key=lambda i: -len(texts[i]))
    number: dict[bytes, int] = {}
    ids: list[int] = []
    for k, i in enumerate(order):
        ids.extend([number.setdefault(w, len(number)) for w in texts[i]])
        ids.append(-1 - k)
    lengths = [len(texts[i]) for i in order]
    firsts = np.cumsum([0, *[n + 1 for n in lengths]])
    array = np.array(ids, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if order:
        for part in (_short_periods(array, lag, min_length), _long_periods(array, lengths, lag, min_length)):
            for start, end, q in part:
                k = int(np.searchsorted(firsts, start, side="right")) - 1
                out[order[k]].append((start - int(firsts[k]), end - start, q))
    return [sorted(runs) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what follows the first period of a run."""
    if not runs:
        return words
    import numpy as np

    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most repetitions, exactly; ties: smallest start, then period."""
    from fractions import Fraction

    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, list[list[bytes]]]]:
    kept, words, total = [], [], 0
    for i, text in zip(ids, texts):
        w = (text or "").encode("utf-8", "surrogatepass").split()  # at white space of ASCII
        kept.append(i)
        words.append(w)
        total += len(w)
        if total >= CHUNK:
            yield kept, words
            kept, words, total = [], [], 0
    if kept:
        yield kept, words


def _search(lag: int, min_length: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        named = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
        for batch in batches:
            for ids, words in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find_runs(words, lag, min_length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, batch.column(0).type),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[named(r) for r in runs] for runs in found], pa.list_(run_type)),
                    pa.array([named(best_run(runs)) for runs in found], run_type),
                    pa.array([b" ".join(collapse(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, found)], pa.string()),
                ], names=[batch.schema.field(0).name, "n_words", "runs", "best", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lag: int = LAG,
                  min_length: int = MIN_LENGTH) -> DataFrame:
    """Per document ``id_col, n_words, runs, best, collapsed``.

    ``runs``: every run as ``start, length, period`` (words, from 0), by start
    and then period.  ``best``: the one with the greatest ``length / period``
    (null without runs).  ``collapsed``: the words, one space between them,
    without those that a run holds after its first period.
    """
    ship()
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_search(lag, min_length), f"`{id_col}` {kind}, n_words long, {FOUND}")


def _planted(words: list[bytes], h: int) -> list[bytes]:
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text`` where one document in ten repeats a passage to its end.

    With ``h`` the CRC-32 of the id as text (null: empty) and ``g = h div 10``:
    if ``h mod 10`` is 0, each word ``i >= a`` is word ``a + (i - a) mod p`` with
    ``a = g mod n`` and ``p = 1 + (n - a) div (3 + g mod 8)``.  Words keep their
    order and get single spaces between them.
    """
    ship()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if h % 10 == 0:
                    text = b" ".join(_planted((text or "").encode("utf-8", "surrogatepass").split(), h)).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[batch.schema.field(0).name, text_col])

    h = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), h.alias("_h"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{text_col}` string")


def run_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
