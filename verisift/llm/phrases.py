"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of ``longest - 1`` words, edges runs of ``longest`` words weighed by their occurrences; two edges meet
where the end of one is the start of the other. Only edges are counted in texts, together with the runs that end short of
an edge. All shorter counts follow: an occurrence of a run of words either goes on by one word, and then is counted with
a longer run that starts with it, or it ends there. So ``f(run) = sum of f(run + word) + occurrences that end``, from the
edges down to single words. Every place of a text is counted once, with the longest run from it.

A run whose whole flow passes through one longer run is absorbed in it. Where edges follow each other through nodes like
this, they are one unary path and are compacted to it; long passages that repeat are such paths.

Counting is kept small by sketches that lose nothing: words and pairs, then runs of frequent pairs, are first counted by
hash in a table of cells, so a cell's count is at least that of any run in it. At a place a run ends, besides at the end
of a piece, before the word that would take it to a cell below the least count: no phrase that long from that place can
reach it, and shorter ones keep all their occurrences. Sketches grow with the input up to ``MAX_CELLS``; beyond, they
only cut less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, written
from .shingles import scramble

UNKNOWN_LANG = "und"
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(
    10 if i in _SEPARATORS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256)
)
_U = np.uint64
#: Cells of the sketch at least and at most (a bit each is broadcast), and those that one of its rows holds.
MIN_CELLS, MAX_CELLS, ROW_CELLS = 2**20, 2**27, 2**16
#: Words that a task counts at a time, different words and different phrases it keeps.
FLUSH_WORDS, WORD_CACHE, PHRASE_CACHE = 2_000_000, 300_000, 400_000
#: Tasks per core that count phrases: each hands on all phrases that it met, so they are no more than keep cores busy.
SPREAD = 2
_BREAK, _NOTHING = 0, 1


class _Words(dict):
    """Numbers for the words of one language as they come, with their hashes; 0 parts pieces, 1 is no word."""

    def __init__(self, lang: str) -> None:
        super().__init__()
        self._salt = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.words, self._hashes = [], []
        for mark in (b"\n", b""):
            self[mark]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self._hashes.append(xxhash.xxh3_64_intdigest(word, self._salt))
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        """The words of a text, a break after each piece."""
        found = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        found.append(b"\n")
        out = np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
        return out[out != _NOTHING]

    def hashes(self) -> np.ndarray:
        return np.array(self._hashes, dtype=_U)

    def forget(self) -> None:
        if len(self.words) > WORD_CACHE:
            self._reset()


class _Sketch:
    """Frequent cells of some widths of runs: bits by the hash of a run."""

    def __init__(self, bits: np.ndarray) -> None:
        self._bits, self._mask = bits, _U(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cells = (hashes & self._mask).astype(np.int64)
        return (self._bits[cells >> 3] >> (7 - (cells & 7))) & 1 == 1


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of runs that go on by a word."""
    return scramble(hashes + words)


def _places(
    known: _Words, words: np.ndarray, low: _Sketch | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, whether a place holds a frequent word, and whether it and the next make a frequent pair."""
    own = known.hashes()[words]
    real = words != _BREAK
    if low is None:
        return own, real, real[:-1] & real[1:]
    real &= low.has(scramble(own))
    joined = real[:-1] & real[1:]
    at = np.flatnonzero(joined)
    joined[at] = low.has(_longer(scramble(own[at]), own[at + 1]))
    return own, real, joined


def _by_language(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[str, _Words, np.ndarray]]:
    """Numbered words of the texts (lang, text) in portions of about ``FLUSH_WORDS`` words of one language."""
    known: dict[str, _Words] = {}
    held: dict[str, list[np.ndarray]] = {}
    total = 0
    for batch in batches:
        for part in slices(iter([batch]), "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                if not text:
                    continue
                words = known.get(lang)
                if words is None:
                    words = known[lang] = _Words(lang)
                numbers = words.numbers(text)
                held.setdefault(lang, []).append(numbers)
                total += len(numbers)
                if total >= FLUSH_WORDS:
                    for name, parts in held.items():
                        yield name, known[name], np.concatenate([np.zeros(1, dtype=np.int64), *parts])
                        known[name].forget()
                    held, total = {}, 0
    for name, parts in held.items():
        yield name, known[name], np.concatenate([np.zeros(1, dtype=np.int64), *parts])


def _sketch_parts(texts: DataFrame, low: np.ndarray | None, widths: range, n_cells: int, least: int) -> DataFrame:
    """(row, cells, counts): counts of the cells of a row of the sketch in a portion, cut at ``least``.

    Runs of ``widths`` words are counted, those of more than two words where all their pairs are frequent by ``low``.
    """
    kind = np.uint16 if least < 2**16 else np.int64
    shared = texts.sparkSession.sparkContext.broadcast(low)
    mask = _U(n_cells - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = None if shared.value is None else _Sketch(shared.value)
        for _, known, words in _by_language(batches):
            own, real, joined = _places(known, words, sketch)
            start = np.flatnonzero(real)
            hashes, met = scramble(own[start]), []
            for width in range(1, widths.stop):
                if width in widths:
                    met.append((hashes & mask).astype(np.int64))
                on = np.append(joined, False)[start + width - 1]
                start, hashes = start[on], hashes[on]
                hashes = _longer(hashes, own[start + width])
            cells, counts = np.unique(np.concatenate(met), return_counts=True)
            if not len(cells):
                continue
            counts = np.minimum(counts, least).astype(kind)
            rows, begin = np.unique(cells // ROW_CELLS, return_index=True)
            ends = [*begin[1:].tolist(), len(cells)]
            within = (cells % ROW_CELLS).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, type=pa.int64()),
                    pa.array([within[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], type=pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], type=pa.binary()),
                ],
                names=["row", "cells", "counts"],
            )

    return texts.mapInArrow(run, "row long, cells binary, counts binary")


def _frequent_cells(texts: DataFrame, low: np.ndarray | None, widths: range, n_cells: int, least: int) -> np.ndarray:
    """A bit per cell: whether runs of ``widths`` words that fall in it occur ``least`` times in all.

    Parts stream by one at a time in order of their row, so a task holds one row of the sketch.
    """
    kind = np.uint16 if least < 2**16 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sums = None, None

        def done() -> pa.RecordBatch:
            bits = np.packbits(sums >= least).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([row], type=pa.int64()), pa.array([bits], type=pa.binary())], names=["row", "bits"]
            )

        for batch in batches:
            for r, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("row", "cells", "counts")), strict=True):
                if r != row:
                    if row is not None:
                        yield done()
                    row, sums = r, np.zeros(ROW_CELLS, dtype=np.int64)
                sums[np.frombuffer(cells, dtype=np.uint16)] += np.frombuffer(counts, dtype=kind)
        if row is not None:
            yield done()

    parts = _sketch_parts(texts, low, widths, n_cells, least).repartition("row").sortWithinPartitions("row")
    frequent = np.zeros(n_cells // 8, dtype=np.uint8)
    width = ROW_CELLS // 8
    # At most MAX_CELLS bits come to the driver, whatever the table.
    for row, bits in parts.mapInArrow(run, "row long, bits binary").collect():
        frequent[row * width : (row + 1) * width] = np.frombuffer(bits, dtype=np.uint8)
    return frequent


_COUNTED = "lang string, width int, phrase string, n long"


def _count_in_texts(texts: DataFrame, low: np.ndarray, high: np.ndarray, longest: int) -> DataFrame:
    """(lang, width, phrase, n): the longest run from every place, summed up over what a task can keep.

    A phrase comes once per task and portion; the sums over all tasks are Spark's, which spills them. A frequent phrase is
    met by almost every task, so partitions are read several to a task: what is handed on grows with the phrases, not with
    the phrases times the files.
    """
    texts = texts.coalesce(SPREAD * texts.sparkSession.sparkContext.defaultParallelism)
    shared = texts.sparkSession.sparkContext.broadcast((low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = (_Sketch(bits) for bits in shared.value)
        sums: dict[tuple[str, int], dict[bytes, int]] = {}
        for lang, known, words in _by_language(batches):
            for width, phrases, n in _counted(known, words, low, high, longest):
                into = sums.setdefault((lang, width), {})
                for phrase, count in zip(phrases, n, strict=True):
                    into[phrase] = into.get(phrase, 0) + count
            if sum(map(len, sums.values())) > PHRASE_CACHE:
                yield from _batches(sums)
                sums = {}
        yield from _batches(sums)

    return texts.mapInArrow(run, _COUNTED)


def _batches(sums: dict[tuple[str, int], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, width), counts in sums.items():
        phrases, n = list(counts), list(counts.values())
        for begin in range(0, len(phrases), 50_000):
            chunk = phrases[begin : begin + 50_000]
            columns = [
                pa.array([lang] * len(chunk), type=pa.string()),
                pa.array([width] * len(chunk), type=pa.int32()),
                pa.array(chunk, type=pa.binary()).cast(pa.string()),
                pa.array(n[begin : begin + 50_000], type=pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "width", "phrase", "n"])


def _counted(
    known: _Words, words: np.ndarray, low: _Sketch, high: _Sketch, longest: int
) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(width, phrases, counts) of one portion: the longest run from every place that may be frequent.

    Runs are numbered exactly, one word longer at a time; equal numbers are equal runs. Hashes only tell where to end.
    """
    names = known.words
    own, real, joined = _places(known, words, low)
    goes_on = np.append(joined, False)
    start = np.flatnonzero(real)
    number, hashes = words[start], scramble(own[start])
    # A place where each number stands.
    place = np.zeros(len(names), dtype=np.int64)
    place[number] = start
    for width in range(1, longest + 1):
        if not len(start):
            return
        on = goes_on[start + width - 1] if width < longest else np.zeros(len(start), dtype=bool)
        further = _longer(hashes[on], own[start[on] + width])
        if width > 1:
            more = high.has(further)
            on[np.flatnonzero(on)[~more]] = False
            further = further[more]
        some, n = np.unique(number[~on], return_counts=True)
        if len(some):
            columns = [words[place[some] + k].tolist() for k in range(width)]
            yield width, [b" ".join([names[w] for w in row]) for row in zip(*columns, strict=True)], n.tolist()
        start, hashes = start[on], further
        pairs = number[on] * len(names) + words[start + width]
        _, first, number = np.unique(pairs, return_index=True, return_inverse=True)
        place = start[first]


def head(phrase: Column, words: Column | int) -> Column:
    """The first words of a phrase."""
    return F.call_function("substring_index", phrase, F.lit(" "), F.lit(words))


def tail(phrase: Column, words: Column | int) -> Column:
    """The last words of a phrase."""
    return F.call_function("substring_index", phrase, F.lit(" "), -F.lit(words))


def phrase_counts(texts: DataFrame, longest: int, least: int, n_words: int) -> dict[int, DataFrame]:
    """Per width the (lang, phrase, f) of all runs of 1 to ``longest`` words that occur ``least`` times or more."""
    n_cells = MIN_CELLS
    while n_cells < MAX_CELLS and n_cells * 4 < n_words:
        n_cells *= 2
    low = _frequent_cells(texts, None, range(1, 3), n_cells, least)
    high = _frequent_cells(texts, low, range(3, longest + 1), n_cells, least) if longest > 2 else low
    counted = _count_in_texts(texts, low, high, longest)
    counted = written(counted.groupBy("lang", "width", "phrase").agg(F.sum("n").alias("n")), "edges-and-ends")
    flow = counted.filter(F.col("width") == longest).select("lang", "phrase", F.col("n").alias("f"))
    levels = {longest: flow.filter(F.col("f") >= least)}
    for width in range(longest - 1, 0, -1):
        onward = flow.select("lang", head(F.col("phrase"), width).alias("phrase"), "f")
        ends = counted.filter(F.col("width") == width).select("lang", "phrase", F.col("n").alias("f"))
        flow = onward.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        flow = written(flow, f"flow-{width}")
        levels[width] = flow.filter(F.col("f") >= least)
    return levels


def _absorbing(nodes: DataFrame, edges: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, edge) of the nodes all of whose flow leaves by one edge, and of those it reaches by one."""
    sides = []
    for end in (head, tail):
        touching = edges.select(
            "lang", end(F.col("phrase"), width).alias("phrase"), F.col("phrase").alias("edge"), F.col("f").alias("w")
        )
        met = nodes.join(touching, ["lang", "phrase"]).filter(F.col("w") == F.col("f"))
        sides.append(met.select("lang", "phrase", "edge"))
    return sides[0], sides[1]


def compact_paths(out: DataFrame, into: DataFrame, edges: DataFrame) -> DataFrame:
    """(lang, phrase, path, place, path_edges): the unary path of every edge, named by its first edge.

    Edges are tied to the one that follows through a node which both absorb. Ties are doubled until every edge knows the
    first of its path, so turns are as many as the logarithm of the longest. As texts are finite and every piece has an
    end, no path is a circle.
    """
    left = into.select("lang", "phrase", F.col("edge").alias("before"))
    right = out.select("lang", "phrase", F.col("edge").alias("after"))
    ties = left.join(right, ["lang", "phrase"]).select("lang", F.col("after").alias("phrase"), "before")
    reach = edges.select("lang", "phrase").join(ties, ["lang", "phrase"], "left")
    known = F.col("before").isNotNull()
    reach = reach.select("lang", "phrase", F.coalesce("before", "phrase").alias("path"), known.cast("long").alias("place"))
    reach = written(reach, "paths")
    while True:
        step = reach.select("lang", F.col("phrase").alias("path"), F.col("path").alias("further"), F.col("place").alias("more"))
        further = reach.join(step, ["lang", "path"]).select(
            "lang", "phrase", F.col("further").alias("path"), (F.col("place") + F.col("more")).alias("place")
        )
        further = written(further, "paths")
        done = further.agg(F.sum("place")).first()[0] == reach.agg(F.sum("place")).first()[0]
        reach = further
        if done:
            break
    lengths = reach.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("path_edges"))
    return reach.join(lengths, ["lang", "path"]).select("lang", "phrase", "path", "place", "path_edges")


def collocations(
    docs: DataFrame,
    least: int = 100,
    top: int = 2000,
    longest: int = 5,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words): each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased in A to Z and cut into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and
    tabs. ``a`` counts the phrase, ``n`` all words of the language; of the cuts of a phrase in two parts that occur
    ``l`` and ``r`` times, the one of the lowest ``floor(1000 * a * n / (l * r))`` counts, of equal ones the first.
    Phrases below ``least`` and those that a longer phrase absorbs (it occurs as often) go. The rank is by score, ``a``
    and then the phrase in byte order. ``path_words`` has the words of the unary path on which a phrase of ``longest``
    words lies, null for shorter ones: large for repeated passages.

    A null language is ``und``; null and empty texts have no words; a repeated row counts again; an empty table gives no
    row. Texts of any length are taken whole, in portions, and nothing is cut at the top but the final rank.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    )
    spaced = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D.,;:!?]+"))
    totals = texts.groupBy("lang").agg(F.coalesce(F.sum(spaced.cast("long")), F.lit(0)).alias("n"))
    totals = written(totals, "words")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    levels = phrase_counts(texts, longest, least, n_words)
    counts = None
    free = None
    for width in range(1, longest + 1):
        level = levels[width].withColumn("width", F.lit(width))
        counts = level if counts is None else counts.unionByName(level)
        if width == 1:
            continue
        phrases = level.withColumn("path_words", F.lit(None).cast("long"))
        if width < longest:
            out, into = _absorbing(levels[width], levels[width + 1], width)
            if width == longest - 1:
                out, into = written(out, "absorbed"), written(into, "absorbed")
                paths = compact_paths(out, into, levels[longest])
            absorbed = out.select("lang", "phrase").unionByName(into.select("lang", "phrase"))
            phrases = phrases.join(absorbed, ["lang", "phrase"], "left_anti")
        else:
            words_of = paths.select("lang", "phrase", (F.col("path_edges") + (longest - 1)).alias("path_words"))
            phrases = level.join(words_of, ["lang", "phrase"])
        free = phrases if free is None else free.unionByName(phrases)
    counts = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("width") - 1))).select(
        "lang",
        "phrase",
        "path_words",
        F.col("f").alias("a"),
        "k",
        head(F.col("phrase"), F.col("k")).alias("left"),
        tail(F.col("phrase"), F.col("width") - F.col("k")).alias("right"),
    )
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("part_f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("right"), F.col("part_f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals), "lang")  # a row per language
    above, below = (F.expr(e) for e in (_PRODUCT, "CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0))"))
    cuts = cuts.withColumn("_above", above).withColumn("_below", below)
    score = F.expr("CAST((_above - _above % _below) / _below AS DECIMAL(38, 0))")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b")
    scored = cuts.groupBy("lang", "phrase", "a", "n", "path_words").agg(best)
    scored = scored.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score", "path_words")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")


#: 1000 * a * n in whole decimals of 38 digits.
_PRODUCT = "CAST(1000 AS DECIMAL(4, 0)) * CAST(CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0)) AS DECIMAL(33, 0))"
