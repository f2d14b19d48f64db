"""Packing token sequences by minimum bin slack.

A document's tokens are cut into whole sequences and one remaining piece. Only the histogram of the remaining
lengths, at most ``capacity - 1`` counts however many documents there are, goes to the driver. There each window takes the longest remaining
length and the multiset of other lengths that fills it closest to capacity: a subset-sum table of bitsets, one per
length, from which the counts are tracked back. One such pattern is used as often as the counts allow, so
the plan has thousands of rows at most. A window that no multiset fills is filled by cutting a piece; its rest goes
back into the histogram. What is left at the end goes to windows whose sizes are powers of two.

The plan says for each remaining length which ranks of documents go where. Ranks are given within tasks, by remaining
length, and lifted by the counts of the tasks before, which is a join on (task, length) of narrow rows: no window and no sort sees all
rows of a length, though a third of all documents may share one.

Token ids are made once and written. A text is split at ASCII blanks and after a run of Latin letters that an ASCII sign
follows; there the tokenizer itself always splits, so ids of such parts can be kept in a table and joined up. A part of Latin letters
alone is one unit for the tokenizer and goes to its model directly, lower-cased and as byte signs.

Defined results: a null or empty text has the end id alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepkit.llm.common import fresh, prepared
from prepkit.session import stage

CAPACITY = 4096
END_ID = 2
#: Parts of texts whose ids a worker keeps; others are encoded each time.
KEPT_PARTS = 400_000
PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ſ]+(?=[\x00-\x40\x5B-\x60\x7B-\x7F]|$)|[^\x20\x09-\x0D]+")

# Byte-level vocabularies write a byte that is no visible sign of Latin-1 as the next free character from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_SIGNS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class Parts(dict):
    """Ids of parts of texts, as bytes; a part not met before is encoded."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model

    def __missing__(self, part: str) -> bytes:
        low = part.lower()
        if low.isascii() and low.isalpha():
            ids = [t.id for t in self.model.tokenize(low)]
        elif low.isalpha() and max(low) < "\u0180":
            ids = [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(_SIGNS))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        made = array("I", ids).tobytes()
        if len(self) < KEPT_PARTS:
            self[part] = made
        return made


_PARTS: dict[str, Parts] = {}


def token_bytes(text: str | None, path: str, end_id: int = END_ID) -> bytes:
    """The ids of a text and the end id, as little-endian unsigned 32-bit numbers."""
    if path not in _PARTS:
        _PARTS[path] = Parts(path)
    text = text or ""
    parts = PART.findall(text.lower() if text.isascii() else text)
    return b"".join(map(_PARTS[path].__getitem__, parts)) + end_id.to_bytes(4, "little")


def _tokenize(path: str, end_id: int, capacity: int, text: str, names: tuple[str, ...]):
    part_name, tokens_name, ids_name, rank_name, full_name = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        full = 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            # Ids fit 16 bits for the public vocabularies; they are written narrow and widened again to be hashed.
            ids = [np.frombuffer(token_bytes(t.as_py(), path, end_id), "<u4") for t in texts]
            lengths = [len(i) for i in ids]
            rank, before = [], []
            for n in lengths:
                rank.append(ranks[n % capacity])
                ranks[n % capacity] += 1
                before.append(full)
                full += n // capacity
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != text}
            out |= {
                part_name: pa.array([part] * len(ids), pa.int32()),
                tokens_name: pa.array(lengths, pa.int64()),
                ids_name: pa.array([i.astype("<u2" if not len(i) or i.max() < 65536 else "<u4").tobytes() for i in ids], pa.binary()),
                rank_name: pa.array(rank, pa.int64()),
                full_name: pa.array(before, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


def fill(counts: Mapping[int, int], target: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``target`` of a multiset of the lengths, and how many of each length it takes.

    Bitsets of reachable sums are kept after each length, longest first, and end once the target is reached; counts are
    tracked back through them, taking the fewest of each shorter length.
    """
    mask = (1 << (target + 1)) - 1
    reached, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= target), reverse=True):
        before, left, width = reached, min(counts[length], target // length), 1
        while left > 0:  # binary splitting of the count
            take = min(width, left)
            reached |= (reached << (take * length)) & mask
            left -= take
            width *= 2
        steps.append((length, before))
        if reached >> target & 1:
            break
    best = at = reached.bit_length() - 1
    taken: dict[int, int] = {}
    for length, before in reversed(steps):
        used = 0
        while not before >> at & 1:
            at -= length
            used += 1
        if used:
            taken[length] = used
    return best, taken


class Plan:
    """Where the ranks of each remaining length go.

    ``rows``: (remaining length, first rank, end rank, start in the remaining piece, length, first sequence, pieces per sequence,
    number of the first piece, offset of piece 0). ``sequences`` is the number of windows, ``padding`` what they lack.
    """

    def __init__(self, histogram: Mapping[int, int], capacity: int = CAPACITY) -> None:
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.left = {n: c for n, c in histogram.items() if n and c}
        self.tokens = sum(n * c for n, c in self.left.items())
        # Segments of equal pieces: (remaining length, first rank, end rank, start).
        self.pieces = {n: deque([(n, 0, c, 0)]) for n, c in self.left.items()}
        while self.left:
            if self.tokens < capacity:
                self._tail(self.tokens)
                break
            self._window(max(self.left))

    def _take(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        out, queue = [], self.pieces[length]
        while number:
            origin, lo, hi, start = queue.popleft()
            if hi - lo > number:
                queue.appendleft((origin, lo + number, hi, start))
                hi = lo + number
            out.append((origin, lo, hi, start))
            number -= hi - lo
        self.tokens -= length * sum(hi - lo for _, lo, hi, _ in out)
        self.left[length] -= sum(hi - lo for _, lo, hi, _ in out)
        if not self.left[length]:
            del self.left[length], self.pieces[length]
        return out

    def _put(self, segments: list[tuple[int, int, int, int]], length: int) -> None:
        self.pieces.setdefault(length, deque()).extend(segments)
        number = sum(hi - lo for _, lo, hi, _ in segments)
        self.left[length] = self.left.get(length, 0) + number
        self.tokens += length * number

    def _place(self, segments, length: int, each: int, offset: int) -> None:
        done = 0
        for origin, lo, hi, start in segments:
            self.rows.append((origin, lo, hi, start, length, self.sequences, each, done, offset))
            done += hi - lo

    def _window(self, longest: int) -> None:
        others = dict(self.left)
        others[longest] -= 1
        best, counts = fill(others, self.capacity - longest)
        counts[longest] = counts.get(longest, 0) + 1
        used = longest + best
        cut = None
        if used < self.capacity:  # cut a piece to close the window
            rest = {n: self.left[n] - counts.get(n, 0) for n in self.left}
            cut = max((n for n, c in rest.items() if c > 0), default=None)
        need = counts | ({cut: counts.get(cut, 0) + 1} if cut else {})
        times = min(self.left[n] // c for n, c in need.items())
        offset = 0
        for length, each in sorted(counts.items(), reverse=True):
            self._place(self._take(length, each * times), length, each, offset)
            offset += each * length
        if cut:
            slack = self.capacity - used
            segments = self._take(cut, times)
            self._place(segments, slack, 1, offset)
            self._put([(o, lo, hi, s + slack) for o, lo, hi, s in segments], cut - slack)
        self.sequences += times

    def _tail(self, total: int) -> None:
        """Fewer tokens than a window: windows of the powers of two that add up to them, pieces cut at their ends."""
        sizes = deque(1 << b for b in reversed(range(total.bit_length())) if total >> b & 1)
        room, offset = sizes.popleft(), 0
        while self.left:
            length = max(self.left)
            (origin, lo, hi, start), = self._take(length, 1)
            while length:
                if not room:
                    self.sequences += 1
                    room, offset = sizes.popleft(), 0
                part = min(length, room)
                self.rows.append((origin, lo, hi, start, part, self.sequences, 1, 0, offset))
                offset, room, start, length = offset + part, room - part, start + part, length - part
        self.sequences += 1

    def by_length(self) -> dict[int, tuple[list[int], list[list[tuple]]]]:
        """For each remaining length: first ranks of intervals and the rows that hold for each of them."""
        rows = defaultdict(list)
        for r in self.rows:
            rows[r[0]].append(r)
        out = {}
        for n, own in rows.items():
            cuts = sorted({r[1] for r in own} | {r[2] for r in own})
            index = {c: i for i, c in enumerate(cuts)}
            held = [[] for _ in cuts]
            for r in own:
                for i in range(index[r[1]], index[r[2]]):
                    held[i].append(r)
            out[n] = (cuts, held)
        return out


def pieces_of(tokens: int, rank: int, full_before: int, plan: dict, sequences: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of each piece of one document."""
    whole, rest = divmod(tokens, capacity)
    out = [(k * capacity, capacity, sequences + full_before + k, 0) for k in range(whole)]
    if rest:
        cuts, held = plan[rest]
        for _, lo, _, start, length, first, each, done, offset in held[bisect_right(cuts, rank) - 1]:
            nth = done + rank - lo
            out.append((whole * capacity + start, length, first + nth // each, offset + nth % each * length))
    return out


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: columns of ``docs`` but the text, ``start``, ``length``, ``ids`` (binary), ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` and ``offset``."""
    spark = prepared(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    part, tokens, ids, rank, full = names = tuple(fresh(n, docs.columns) for n in ("__part", "__tokens", "__ids", "__rank", "__full"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text),
                        f"`{part}` int, `{tokens}` bigint, `{ids}` binary, `{rank}` bigint, `{full}` bigint"])
    written = stage(docs.mapInArrow(_tokenize(tokenizer, end_id, capacity, text, names), schema), "token-ids")
    remaining = fresh("__rest", docs.columns)
    rest = (F.col(tokens) % capacity).alias(remaining)
    per_task = stage(written.groupBy(part, rest).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"`{tokens}` div {capacity}")).alias("whole")), "packing-counts")
    # At most `capacity` rows.
    histogram = {r[0]: r[1] for r in per_task.groupBy(remaining).agg(F.sum("n")).collect()}
    plan = Plan(histogram, capacity)
    intervals, windows = plan.by_length(), plan.sequences
    earlier = Window.partitionBy(remaining).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    lifts = per_task.select(F.col(part).alias("__p"), F.col(remaining).alias("__r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__lift"))
    by_task = per_task.groupBy(part).agg(F.sum("whole").alias("whole")).filter("whole > 0")
    numbers, before = [], 0
    for p, n in sorted(by_task.collect()):  # tasks that hold a document longer than a sequence, two numbers each
        numbers.append((p, before))
        before += n
    bases = F.broadcast(spark.createDataFrame(numbers, "__q int, __base bigint"))
    ranked = written.withColumn(remaining, F.col(tokens) % capacity)
    ranked = ranked.join(stage(lifts, "packing-lifts"), (F.col(part) == F.col("__p")) & (F.col(remaining) == F.col("__r")))
    ranked = ranked.join(bases, F.col(part) == F.col("__q"), "left")
    ranked = ranked.withColumns({rank: F.col(rank) + F.col("__lift"), full: F.col(full) + F.coalesce("__base", F.lit(0))})
    ranked = ranked.drop("__p", "__r", "__q", "__lift", "__base", part, remaining)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            source, out = [], []
            for i, (n, r, f, raw) in enumerate(zip(*(column[c].to_pylist() for c in (tokens, rank, full, ids)))):
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for start, length, sequence, offset in pieces_of(n, r, f, intervals, windows, capacity):
                    piece = wide[start : start + length].tobytes()
                    source.append(i)
                    out.append((start, length, piece, zlib.crc32(piece), n, sequence, offset))
            taken = pa.array(source, pa.int64())
            values = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(column[c].take(taken) for c in keep), *(pa.array(v, k) for v, k in zip(values, kinds))],
                names=[*keep, *own],
            )

    own = [fresh(n, docs.columns) for n in ("start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    kinds = ["bigint", "bigint", "binary", "bigint", "bigint", "bigint", "bigint"]
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text),
                            *(f"`{n}` {k}" for n, k in zip(own, kinds))])
    return ranked.mapInArrow(run, out_schema)
