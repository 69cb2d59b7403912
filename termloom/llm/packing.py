"""Best-fit packing of token sequences: patterns by non-negative least squares, the rest by best fit.

Only the histogram of lengths (at most `size` numbers) comes to the driver. There, patterns of two or three documents
that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, rounded within what is there, and the remaining lengths are packed best-fit decreasing, many equal sequences at
a time. The plan says, for each length, which sequences its 1st, 2nd, ... document goes to; its size depends on the
lengths, not on the number of documents. Documents get their number within a length in parallel: a count within the
task, plus what earlier tasks have.
"""

from __future__ import annotations

import ctypes
import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Patterns kept for each leading length, those of the most frequent partners; passes of the least-squares fit.
COLUMNS, PASSES = 16, 20
#: Bytes of text whose words are looked up together (a worker's memory grows with them), and words that the library gets as
#: one text.
RUN, JOINED = 1_000_000, 64
#: Words whose ids a worker remembers, and the longest that it does: some 10 MB.
REMEMBERED, LONGEST = 200_000, 24
#: White space to any of the libraries: the Unicode property and the separators 1C to 1F.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, ...]]:
    """Multisets of two or three lengths that fill `size`, at most COLUMNS for each leading (longest) length."""
    out = []
    lengths = sorted(histogram)
    for a in reversed(lengths):
        rest = size - a
        own = [(a, rest)] if rest <= a and rest in histogram else []
        for c in lengths:
            b = rest - c
            if c > b:
                break
            if b <= a and b in histogram:
                own.append((a, b, c))
        own.sort(key=lambda p: (-min(histogram[x] for x in p), p))
        out += own[:COLUMNS]
    return out


def least_squares(columns: list[tuple[int, ...]], histogram: dict[int, int]) -> list[float]:
    """x >= 0 with a small square sum of histogram - A x, by coordinate descent; A counts the lengths of a column."""
    rest = {k: float(v) for k, v in histogram.items()}
    entries = [list(Counter(p).items()) for p in columns]
    square = [sum(m * m for _, m in e) for e in entries]
    x = [0.0] * len(columns)
    for _ in range(PASSES):
        most = 0.0
        for j, e in enumerate(entries):
            step = max(-x[j], sum(m * rest[k] for k, m in e) / square[j])
            if step:
                x[j] += step
                most = max(most, abs(step))
                for k, m in e:
                    rest[k] -= m * step
        if most < 0.01:
            break
    return x


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing of a histogram: [(sequences, [(length, times), ...])], equal sequences together."""
    caps: list[int] = []
    bins: dict[int, list] = defaultdict(list)  # free space: [(sequences, contents)]

    def add(free: int, count: int, contents: list) -> None:
        if count:
            if not bins[free]:
                insort(caps, free)
            bins[free].append((count, contents))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(caps, length)
            if at == len(caps):
                times = size // length
                add(size - times * length, left // times, [(length, times)])
                if left % times:
                    add(size - left % times * length, 1, [(length, left % times)])
                break
            free = caps[at]
            count, contents = bins[free].pop()
            if not bins[free]:
                del caps[at]
            used = min(count, left)
            left -= used
            add(free, count - used, contents)
            last = contents[-1]
            add(free - length, used, [*contents[:-1], (length, last[1] + 1)] if last[0] == length else [*contents, (length, 1)])
    return [group for groups in bins.values() for group in groups]


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences for all lengths of the histogram, in the form best_fit() has."""
    rest = {k: v for k, v in histogram.items() if v and k < size}
    out = [(histogram[size], [(size, 1)])] if histogram.get(size) else []
    columns = patterns(rest, size)
    fitted = least_squares(columns, rest)
    for j in sorted(range(len(columns)), key=lambda j: (-fitted[j], columns[j])):
        need = Counter(columns[j])
        times = min(int(fitted[j] + 0.5), *(rest[k] // m for k, m in need.items()))
        if times > 0:
            out.append((times, sorted(need.items(), reverse=True)))
            for k, m in need.items():
                rest[k] -= m * times
    return out + best_fit({k: v for k, v in rest.items() if v}, size)


def _lookup(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: from rank `start` of `length` on, `times` documents to each sequence from `first` on."""
    cursor: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, contents in groups:
        offset = 0
        for length, times in contents:
            rows.append((length, cursor[length], sequence, offset, times))
            cursor[length] += count * times
            offset += length * times
        sequence += count
    table = np.array(sorted(rows) or np.empty((0, 5)), np.int64)
    return {name: table[:, k] for k, name in enumerate(("length", "start", "first", "offset", "times"))} | {"key": (table[:, 0] << 44) | table[:, 1]}


class Encoder:
    """Ids of whole texts by a tokenizers file, each distinct word of a run of texts encoded once.

    With the file's byte-level splitting, text may be cut before a space that has something other than white space on
    one side at least: no match of the pattern reaches over such a place. So texts are cut at spaces by Arrow, the
    distinct pieces are encoded together, and the ids of a text are gathered by NumPy. Texts with white space around a
    space, or with the string of an added token, are encoded whole by the library; both ways give the library's ids.
    Short words that come twice in a run are remembered up to REMEMBERED of them; all others are encoded once a run."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        self.bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes[k] = len(token)  # byte-level: a character of a token stands for one byte
        self.known = pa.array([], pa.string())  # the words whose ids lie end to end in `kept`
        self.kept, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, a space before each, end to end, and how many each has; none begins or ends with white space.
        JOINED words are one text to the library; the bytes that ids stand for tell where a word ends."""
        plain = words.to_pylist()
        parts = self._each([" " + " ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)])
        ids = np.concatenate([np.empty(0, np.uint32), *parts])
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
        upto = np.cumsum(self.bytes[ids])
        at = np.searchsorted(upto, ends)
        if len(words) and (len(upto) == 0 or at[-1] != len(upto) - 1 or not np.array_equal(upto[at], ends)):
            parts = self._each([" " + w for w in plain])
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(at + 1, prepend=0)

    def _remember(self, words: pa.Array, start: np.ndarray, lengths: np.ndarray, times: np.ndarray, ids: np.ndarray) -> None:
        short = pc.binary_length(words).to_numpy(zero_copy_only=False) <= LONGEST
        chosen = np.flatnonzero((times > 1) & short)[: REMEMBERED - len(self.known)]
        if len(chosen):
            self.known = pa.concat_arrays([self.known, words.take(pa.array(chosen))])
            self.kept = np.concatenate([self.kept, _gathered(ids, start[chosen], lengths[chosen])])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths[chosen])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, ends): the texts' numbers in the order in which their ids lie end to end, and where each ends."""
        alone = pc.match_substring_regex(texts, f"{_SPACE} (?:{_SPACE}|\\z)")
        for mark in self.marks:
            alone = pc.or_(alone, pc.match_substring(texts, mark))
        alone = alone.to_numpy(zero_copy_only=False)
        rest = self._each(texts.filter(pa.array(alone)).to_pylist())
        lists = pc.split_pattern(texts.filter(pa.array(~alone)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        words = coded.dictionary
        odd = pc.match_substring_regex(words, f"^(?:{_SPACE}|\\z)|{_SPACE}\\z").to_numpy(zero_copy_only=False)
        place = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero((place < 0) & ~odd)
        fresh = words.take(pa.array(new))
        found, lengths = self._together(fresh)
        start, count = self.starts[np.maximum(place, 0)], np.zeros(len(words), np.int64)
        count[place >= 0] = np.diff(self.starts)[place[place >= 0]]
        count[new], start[new] = lengths, len(self.kept) + np.cumsum(lengths) - lengths
        ids = np.concatenate([self.kept, found])
        # What has no space before it: the first words of texts; and words that begin or end with other white space.
        code = coded.indices.to_numpy().astype(np.int64)
        heads = words.take(coded.indices.take(pa.array(offsets[:-1]))).to_pylist()
        single = self._each([*heads, *(" " + w for w in words.filter(pa.array(odd)).to_pylist())])
        sizes = np.array([len(x) for x in single], np.int64)
        begins = len(ids) + np.cumsum(sizes) - sizes
        ids = np.concatenate([ids, *single])
        count[odd], start[odd] = sizes[len(heads) :], begins[len(heads) :]
        code[offsets[:-1]] = len(words) + np.arange(len(heads))
        count, start = np.concatenate([count, sizes[: len(heads)]]), np.concatenate([start, begins[: len(heads)]])
        self._remember(fresh, start[new], lengths, np.bincount(code, minlength=len(count))[new], ids)
        ends = np.cumsum(count[code])
        flat = _gathered(ids, start[code], count[code])
        ends = ends[offsets[1:] - 1] if len(offsets) > 1 else np.empty(0, np.int64)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        more = np.cumsum([len(x) for x in rest], dtype=np.int64) + len(flat)
        return order, np.concatenate([flat, *rest]), np.concatenate([ends, more])


def _gathered(values: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values from each start on, as many as its length says, end to end."""
    into = np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
    into += np.arange(len(into))
    return values[into]


@lru_cache(maxsize=1)
def _encoder(path: str, special_as_text: bool) -> Encoder:
    return Encoder(path, special_as_text)


def _runs(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about RUN bytes of texts, at least one text each, and where they begin."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + RUN, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each piece how many of its length came before it; seen, by length, is counted on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    into = np.arange(len(ordered)) - np.repeat(first, np.diff(first, append=len(ordered)))
    out = np.empty(len(lengths), np.int64)
    out[order] = into + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def _release() -> None:
    """Returns freed memory to the system, since the worker lives on between tasks and keeps it through other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, TypeError, AttributeError):  # elsewhere than with glibc
        ctypes.CDLL(None).malloc_trim(0)


def _pieces(tokenizer_path: str, size: int, end: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, special_as_text)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            docs = batch.column(0)
            for at, texts in _runs(pc.fill_null(batch.column(1), "")):
                order, ids, ends = encoder.encode(texts)
                ids = np.insert(ids, ends, end).astype("<u4", copy=False)
                ends = ends + np.arange(1, len(ends) + 1)
                n = np.diff(ends, prepend=0)
                cuts = (n + size - 1) // size
                piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                stop = np.repeat((n - 1) % size + 1, cuts) + piece * size
                start = np.maximum(0, stop - size)
                start[piece == 0] = 0
                base = np.repeat(ends - n, cuts)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((base + start).tolist(), (base + stop).tolist(), strict=True)]
                length = stop - start
                arrays = [docs.take(pa.array(at + np.repeat(order, cuts))), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(_numbered(length, seen)), pa.array(np.full(len(crc), part), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])
        _release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Packs every whole text, as ids and then the id `end`, into as few sequences of at most `size` tokens as it can.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than
    `size` are cut; their first piece is the one that may be shorter. Null counts as empty, and an empty text is the id
    `end` alone. Repeated rows and rows without an id are packed like others. The tokenizer file is read by a path that
    every executor has; a special token's string in a text is that token, as the library has it, unless special_as_text.
    An empty table gives no piece. Further columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part int"
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer_path, size, end, special_as_text), schema), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    groups = plan(histogram, size)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "before")
    table = _lookup(groups)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(table["key"], (length << 44) | rank, side="right") - 1
            into = rank - table["start"][at]
            sequence = table["first"][at] + into // table["times"][at]
            offset = table["offset"][at] + into % table["times"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Rows of `before` grow with tasks times lengths, so neither side is broadcast: both are shuffled and merged.
    ranked = pieces.hint("merge").join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
