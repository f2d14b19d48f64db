"""Byte-level BPE by dynamic programming over prefixes, with decoding, appends and re-encoding near edits.

A piece of text (one match of the splitting pattern) has exactly one encoding, and so has each of its byte prefixes. The table of a
piece holds the last token of each prefix's encoding. Walking it from the end gives the ids. The last token of a
prefix is the one vocabulary entry that ends the prefix and *joins* the last token of the prefix before it: merging the bytes of both tokens gives just
these two. A sequence whose neighbours all join is the encoding: the first merge across a border would also happen with the two neighbours
alone. So an entry needs only the bytes and entries of the longest token's length before it. An append adds entries and changes none; an edit keeps the entries before it, and those after it
hold again once a stretch as long as the longest token agrees with the old table.

Text is split at blanks first (``UNIT``): a blank between two signs that are no white space always starts a piece, so ids of units are kept in a bounded table.
A piece that is itself in the vocabulary is one token, whatever merging would give.

Defined results: a null or empty text has no ids; repeated rows, ties and texts of any length are encoded whole; an empty table gives no rows; a column whose name clashes
with an added one gets an underscore before it. Ids that the vocabulary lacks cannot be decoded and stop the job. A null in ``ids`` decodes to no bytes.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from prepkit.llm.common import aside, prepared

#: The vocabulary's splitting pattern, and the white space it means (Unicode's property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"

UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A blank between two signs: a border of pieces in any text around it.
BORDER = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: Units and pairs of tokens that a worker keeps, and the longest unit kept; others are worked out each time.
KEPT_UNITS, KEPT_PAIRS, KEPT_LENGTH = 700_000, 500_000, 200
ENCODED = ("n_tokens", "ids")


@cache
def _probe():
    """An encoding in which a sign and an ``a`` or ``1`` after it share a token where the pattern keeps them in one piece."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    for pair in (bytes([i, f]) for f in b"a1" for i in range(256)):
        ranks[pair] = len(ranks)
    return tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _like(sign: str) -> str:
    """A sign that the pattern treats alike, for one that this Python's Unicode tables do not know yet: newer tables differ in them."""
    for follow, like in (("a", "é"), ("1", "²")):
        if len(_probe().encode_ordinary(sign + follow)) < len((sign + follow).encode()):
            return like
    return "‖"


class Splitter:
    """Matches of the splitting pattern, with the library's white space and its idea of letters and numbers."""

    def __init__(self) -> None:
        import regex

        # Classes that ASCII can fill, for the standard library's faster module.
        plain = PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")
        self.ascii = re.compile(plain.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.findall = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def __call__(self, text: str) -> list[str]:
        """The pieces of a text."""
        if text.isascii():
            return self.ascii(text)
        plain = "".join(_like(c) if unicodedata.category(c) == "Cn" else c for c in text)
        pieces = self.findall(plain)
        if plain == text:
            return pieces
        ends = list(accumulate(map(len, pieces)))
        return [text[a:b] for a, b in zip([0, *ends], ends)]


class Vocabulary(dict):
    """Ids by bytes; as a mapping, ids of units of text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        # Every ending of a token: its id where it is a token itself, else -1.
        self.endings = {token[i:]: -1 for token in self.ranks for i in range(len(token))} | self.ranks
        self.split = Splitter()
        self.pairs: dict[int, bool] = {}
        self.singles: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging: the leftmost neighbours of lowest rank become one, until none are in the vocabulary."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            at = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            low = min(at)
            if low == 1 << 40:
                break
            i = at.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def alone(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token."""
        known = self.singles.get(token)
        if known is None:
            known = self.singles[token] = len(self.merged(self.bytes[token])) == 1
        return known

    def joins(self, before: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their bytes together."""
        known = self.pairs.get(before << 32 | token)
        if known is None:
            a, b = self.bytes[before], self.bytes[token]
            whole = self.ranks.get(a + b)
            known = not (whole is not None and self.alone(whole)) and self.merged(a + b) == [a, b]
            if len(self.pairs) < KEPT_PAIRS:
                self.pairs[before << 32 | token] = known
        return known

    def _learn(self, units: set[str]) -> None:
        """Ids of new units. Their pieces are worked out in order of their bytes, each from the table of the one before, cut to the common prefix."""
        pieces = {u: self.split(u) for u in units}
        made = {p: self.get(p) for own in pieces.values() for p in own}
        table = Prefixes(self)
        for data, piece in sorted((p.encode(), p) for p, known in made.items() if known is None):
            whole = self.ranks.get(data)
            made[piece] = (array("I", [whole]) if whole is not None else table.turn_into(data).ids()).tobytes()
        self.update({u: b"".join(map(made.__getitem__, own)) for u, own in pieces.items()})
        if len(self) < KEPT_UNITS:
            # A piece is a unit too, and shared by units that differ in the signs around it.
            self.update(made)

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of texts. What one call adds beyond the room for units is dropped at its end."""
        texts = [UNIT.findall(t or "") for t in texts]
        units, before = set().union(*texts), len(self)
        self._learn(units - self.keys())
        out = [b"".join(map(self.__getitem__, t)) for t in texts]
        added = list(islice(reversed(self), len(self) - before))[::-1]  # in order of their coming
        for i, unit in enumerate(added, before):
            if i >= KEPT_UNITS or len(unit) > KEPT_LENGTH:
                del self[unit]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes.__getitem__, memoryview(ids or b"").cast("I")))


def common(a: bytes | str, b: bytes | str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Prefixes:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, end: int, agree: Callable[[int], bool] | None = None) -> int:
        """Work out entries up to prefix ``end``, or until ``agree`` says so of a prefix; the last one's length."""
        v, data, last = self.vocabulary, self.data, self.last
        endings, pairs = v.endings, v.pairs
        for at in range(len(last) + 1, end + 1):
            start = at - 1
            while True:  # exactly one token fits, whatever the order
                token = endings[data[start:at]]
                if token >= 0:
                    if not start:
                        if v.alone(token):
                            break
                    else:
                        joined = pairs.get(last[start - 1] << 32 | token)
                        if joined or joined is None and v.joins(last[start - 1], token):
                            break
                start -= 1
            last.append(token)
            if agree and agree(at):
                return at
        return end

    def append(self, more: bytes) -> None:
        """Add bytes at the end; entries there are stay."""
        self.data += more
        self._extend(len(self.data))

    def turn_into(self, data: bytes) -> Prefixes:
        """The table of other bytes, from the entries of the common prefix on."""
        n = common(self.data, data)
        self.data = data
        del self.last[n:]
        self._extend(len(data))
        return self

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from ``start`` to ``end``; the number of entries worked out anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, agreed = old[:start], 0

        def agree(at: int) -> bool:
            nonlocal agreed
            before = at - shift  # the same prefix's length in the old table
            agreed = agreed + 1 if before > end and old[before - 1] == self.last[-1] else 0
            return agreed >= self.vocabulary.longest

        at = self._extend(len(self.data), agree)
        self.last.extend(old[at - shift :])
        return at - start

    def ids(self) -> array:
        out, end = array("I"), len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        out.reverse()
        return out


def near_edit(vocabulary: Vocabulary, old: str, ids: bytes, new: str) -> tuple[bytes, int]:
    """Ids of ``new`` from those of ``old``, and how many signs were encoded again.

    Ids before the last border ahead of the difference and after the first border behind it are taken over.
    """
    head = common(old, new)
    tail = common(old[head:][::-1], new[head:][::-1])
    # A border shows by the sign before it and the sign after its blank: all three lie in what both texts share.
    left = next((k for k in range(head - 2, 0, -1) if BORDER.match(old, k)), 0)
    found = BORDER.search(old, len(old) - tail + 1) if tail > 2 else None
    right = found.start() if found else len(old)
    numbers = memoryview(ids).cast("I")
    first, size, goal = 0, 0, len(old[:left].encode())
    while size < goal:
        size += len(vocabulary.bytes[numbers[first]])
        first += 1
    last, size, goal = len(numbers), 0, len(old[right:].encode())
    while size < goal:
        last -= 1
        size += len(vocabulary.bytes[numbers[last]])
    middle = new[left : right + len(new) - len(old)]
    return ids[: 4 * first] + vocabulary.encode(middle) + ids[4 * last :], len(middle)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, loaded once per process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _fields(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]


def _mapped(df: DataFrame, drop: tuple[str, ...], added: dict[str, str], work: Callable[..., list[pa.Array]], *inputs: str) -> DataFrame:
    """``df`` without ``drop`` and with the ``added`` columns that ``work`` makes of the input columns."""
    kept = [c for c in df.columns if c not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            made = work(*(batch.column(at[c]) for c in inputs))
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in kept), *made], names=[*kept, *added])

    return df.mapInArrow(run, ", ".join([*_fields(df.select(*[f"`{c}`" for c in kept])), *(f"`{n}` {k}" for n, k in added.items())]))


def encode(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) in place of the text."""
    prepared(docs.sparkSession)

    def work(texts: pa.Array) -> list[pa.Array]:
        made = vocabulary(ranks).encode_all(texts.to_pylist())
        return [pa.array([len(m) // 4 for m in made], pa.int64()), pa.array(made, pa.binary())]

    docs = aside(docs, ENCODED)
    return _mapped(docs, (text,), {"n_tokens": "bigint", "ids": "binary"}, work, text)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the bytes of its ids as ``decoded``."""
    prepared(encoded.sparkSession)

    def work(numbers: pa.Array) -> list[pa.Array]:
        return [pa.array([vocabulary(ranks).decode(n.as_py()) for n in numbers], pa.binary())]

    return _mapped(aside(encoded, ("decoded",)), (), {"decoded": "binary"}, work, ids)


def reencode(encoded: DataFrame, ranks: str, old: str, new: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the ids of the texts in ``new`` as ``new_ids``, made from those of the texts in ``old`` where both agree; ``n_again`` is the
    number of signs that were encoded again."""
    prepared(encoded.sparkSession)

    def work(before: pa.Array, numbers: pa.Array, after: pa.Array) -> list[pa.Array]:
        made = [near_edit(vocabulary(ranks), a.as_py() or "", n.as_py() or b"", b.as_py() or "") for a, n, b in zip(before, numbers, after)]
        return [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int64())]

    return _mapped(aside(encoded, ("new_ids", "n_again")), (), {"new_ids": "binary", "n_again": "bigint"}, work, old, ids, new)
