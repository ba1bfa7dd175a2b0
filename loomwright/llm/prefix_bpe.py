"""Byte-level BPE by prefix dynamic programming.

A byte string has one BPE encoding, and so has each of its prefixes; the last token of a
prefix's encoding, kept for every prefix, therefore describes all of them. A token ``t`` that
ends at ``i`` is that last token exactly if the two tokens (the last one of the prefix before
``t``, and ``t``) stay apart when BPE runs over their joined bytes. So one left-to-right pass
finds the encoding, appending bytes goes on where the pass ended, and an edit keeps all
entries before it, and those behind it from where new entries coincide with the old ones.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.pretokens import splitter
from loomwright.llm.shared import held, slices, small_batches

#: Encoded pre-tokens that a worker keeps in its younger half; the older half is as large.
CACHE = 100_000
#: Pairs of tokens of which an encoder keeps whether they stay apart: some 25 MB.
BORDERS = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixBpe:
    """The encoder; ``ranks`` maps token bytes to ids, lower ids merging first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([x]) not in ranks for x in range(256)) or max(ranks[bytes([x])] for x in range(256)) > 255:
            raise ValueError("the 256 single bytes must have the lowest ids")
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        #: every ending of a token: its id if it is one that BPE reaches itself, else -1
        self.ending: dict[bytes, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            reached = len(t) == 1
            if not reached:
                left = self._merge(t, i)
                reached = len(left) == 2
                if reached:
                    self.parts[i] = (ranks[left[0]], ranks[left[1]])
            for k in range(len(t)):
                self.ending.setdefault(t[k:], -1)
            if reached:
                self.ending[t] = i
        self._apart: dict[int, bool] = {}

    def _merge(self, data: bytes, below: int) -> list[bytes]:
        """Plain BPE with the merges of ids under ``below``."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1], below)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE over the joined bytes of two tokens gives these two tokens.

        Takes the merges that made both tokens back, latest first. At each moment the tokens
        that touch at the border could have merged; they did if that merge came earlier than
        the one taken back last. Of two equal merges the left one comes first: it is the
        inner one of ``left``, but the one across the border as against ``right``.
        """
        pair = left << 32 | right
        known = self._apart.get(pair)
        if known is not None:
            return known
        limit, result = sys.maxsize, True
        while True:
            across = self.ranks.get(self.token[left] + self.token[right], limit)
            if across < limit:
                result = False
                break
            if left < 256 and right < 256:
                break
            if left > right:
                limit, left = left, self.parts[left][1]
            else:
                limit, right = right + 1, self.parts[right][0]
        if len(self._apart) >= BORDERS:
            self._apart.clear()
        self._apart[pair] = result
        return result

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fill ``last`` up to ``len(data)`` (or ``stop``) in place: ``last[i]`` ends the encoding of ``data[: i + 1]``."""
        ending, known, add = self.ending.get, self._apart.get, last.append
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            start = end - 1
            # once no token ends in some bytes, no longer one does
            while (t := ending(data[start:end])) is not None:
                if t >= 0:
                    if not start:
                        add(t)
                        break
                    before = last[start - 1]
                    alone = known(before << 32 | t)
                    if alone or (alone is None and self.apart(before, t)):
                        add(t)
                        break
                start -= 1
                if start < 0:
                    break
            if len(last) != end:
                raise ValueError("the vocabulary has no encoding of this prefix")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that an array of last tokens stands for."""
        out, at, size = [], len(last), self.size
        while at:
            t = last[at - 1]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out

    def edit(self, data: bytes, last: list[int], at: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``data[at:stop]`` by ``new``; entries before ``at`` are kept.

        An entry depends on the bytes and entries of one token's length before it. So once that
        many entries behind the edit have come out as they were, all others would too.
        """
        rest = last[stop:]
        data = data[:at] + new + data[stop:]
        done, end, same = last[:at], at + len(new), 0
        for k, old in enumerate(rest):
            self.extend(data, done, end + k + 1)
            same = same + 1 if done[-1] == old else 0
            if same >= self.longest:
                return data, done + rest[k + 1 :]
        return data, self.extend(data, done)

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token; a pre-token that is a token itself is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.tokens(self.extend(data, []))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, _words(ids)))


class _Pieces(dict):
    """Pre-token to its packed ids, encoded when first asked for.

    When it is full it becomes the older half: what is asked for again comes back from there,
    the rest goes when the next half is full. So frequent pre-tokens stay, and memory is bounded.
    """

    def __init__(self, bpe: PrefixBpe) -> None:
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = _packed(self.bpe.encode_piece(piece.encode()))
        if len(piece) < 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


def _packed(ids: list[int]) -> bytes:
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


def _words(ids: bytes) -> array:
    words = array("I")
    words.frombytes(ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words


def _ready(ranks: dict[bytes, int], key: int) -> tuple[PrefixBpe, _Pieces]:
    """One encoder a worker process, kept for the next tasks of the same vocabulary."""
    def make() -> tuple[PrefixBpe, _Pieces]:
        bpe = PrefixBpe(ranks)
        return bpe, _Pieces(bpe)

    return held("prefix_bpe", key, make)


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Columns ``keep`` of every row, its token ids and the bytes they decode to.

    ``ids_col`` is binary: the ids as little-endian unsigned 32-bit integers; ``decoded_col``
    is binary. Each match of ``pattern`` is encoded by itself; there are no special tokens. A
    null text counts as empty and gives two empty values; repeated rows give repeated rows; no
    rows give no rows. A ``keep`` column named like a result is an error. ``ranks`` has the
    size of the vocabulary file, so it is safe to broadcast.
    """
    clash = {ids_col, decoded_col} & set(keep)
    if clash:
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)
    key = zlib.crc32(b"".join(ranks))
    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    width = len(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:width]), f"`{ids_col}` binary", f"`{decoded_col}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = _ready(shared.value, key)
        split = splitter(pattern)
        for part in slices(batches, holder="prefix_bpe"):
            ids = [b"".join(map(pieces.__getitem__, split(t))) if t else b"" for t in part.column(width).to_pylist()]
            back = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[*keep, ids_col, decoded_col])

    return kept.mapInArrow(run, schema)
