"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that the trie of an Aho-Corasick automaton over
text finds the longest token that starts at a position. A text
piece is then encoded from left to right with the longest match. A token is
accepted only if it is compatible with the one before it, that is, if merging
the two tokens' bytes in rank order would keep the boundary between them. If
not, the next shorter token that is a prefix of it is tried, and if none is
left, the last accepted token is taken back. A position from which no encoding
goes on is marked and never tried again, so the time is linear in the length.
The compatibility of two adjacent tokens is memoised, and so are encoded
pieces; both memories are bounded.

Edge cases: a null or empty text gives no ids and decodes to no bytes; every
row gives one row, repeated rows and null ids of documents included; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held, slices_by_bytes

#: Encoded pieces that a Python worker remembers, twice: those met lately, and those met before them.
MEMO_PIECES = 200_000
#: Longer pieces are encoded anew each time.
MEMO_LENGTH = 64
#: Pairs of tokens whose compatibility a worker remembers.
MEMO_PAIRS = 500_000
#: Fixed value: the public pattern of byte-level vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts without any other characters than these are split by the standard library's faster module: there, its classes
#: of letters, decimal digits and space are those of Unicode that the pattern means.
_COMMON = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]").search


def splitter(pattern: str) -> Callable[[str], list[str]]:
    r"""Splits a text by a pattern in which \s means Unicode's White_Space and nothing else."""
    import regex

    other = r"[^\s\p{L}\p{N}]"
    whole = regex.compile(pattern.replace(other, r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    if pattern == PIECES:
        # The same matches: letters are tried first, as no other alternative starts with one, and common ones are listed.
        letters = "[" + "".join(chr(c) for c in range(0x250) if chr(c).isalpha()) + "]"
        common = re.compile(rf" ?{letters}+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    else:
        common = re.compile(pattern.replace(other, r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")).findall
    return lambda text: whole(text) if _COMMON(text) else common(text)


class Pieces(dict):
    """piece -> its ids, serialized, with a bounded memory.

    Of MEMO_PIECES pieces met lately and as many met before them, those that
    are met again are kept.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(piece) > MEMO_LENGTH:
                return ids
        if len(self) >= MEMO_PIECES:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Backtracker:
    """Encodes byte strings by the ranks of their tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = [0] * (max(ranks.values()) + 1)
        self.latin = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.widest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.latin.items():
            self.automaton.add_word(token, rank)
            self.length[rank] = len(token)
        self._compatible: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that are merged last when this token's bytes are encoded; None if it is never made by merging."""
        if token not in self._halves:
            data, found = self.bytes_of[token], None
            for cut in range(1, len(data)):
                left, right = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
                if left is not None and right is not None and left < token and right < token and self._boundary_holds(left, right, token):
                    found = left, right
                    break
            self._halves[token] = found
        return self._halves[token]

    def longest(self, text: str, at: int) -> int:
        """The longest token that starts at a place of a Latin-1 text, or -1."""
        ahead = text[at : at + self.widest]
        reach = self.automaton.longest_prefix(ahead)  # of the path in the trie; the token may end before
        while reach:
            token = self.latin.get(ahead[:reach])
            if token is not None:
                return token
            reach -= 1
        return -1

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if token not in self._shorter:
            data = self.bytes_of[token]
            self._shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return self._shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the boundary between two adjacent tokens.

        The merges that made both tokens are undone, latest first. The tokens
        are incompatible if, at some point, the pieces on both sides of the
        boundary form a token that merging would have made earlier.
        """
        key = left, right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= MEMO_PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self._boundary_holds(left, right, 1 << 60)
        return known

    def _boundary_holds(self, left: int, right: int, undone: int) -> bool:
        """undone: rank of the last merge undone; only a merge of lower rank could have come before it."""
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < undone and self.halves(joined) == (left, right):
                return False
            parts_left, parts_right = self.halves(left), self.halves(right)
            if parts_left is None and parts_right is None:
                return True
            # Of two equal ranks the left one is merged first, so the right one is undone first.
            if parts_right is None or (parts_left is not None and left > right):
                undone, left = left, parts_left[1]
            else:
                undone, right = right + 1, parts_right[0]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, size, length, known = data.decode("latin-1"), len(data), self.length, self._compatible
        open_from = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, before, token = 0, -1, self.longest(text, 0)
        while at < size:
            while token >= 0:
                end = at + length[token]
                if open_from[end]:
                    if before < 0:
                        break
                    holds = known.get((before, token))
                    if self.compatible(before, token) if holds is None else holds:
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at, before, token = end, token, self.longest(text, end)
            else:
                if not out:
                    raise ValueError("these ranks have no token for some byte")
                open_from[at] = 0
                last = out.pop()
                at -= length[last]
                before, token = out[-1] if out else -1, self.shorter(last)
        return out


class Codec:
    """Encodes texts to ids."""

    def __init__(self, ranks_path: str, pattern: str):
        encode = Backtracker(read_ranks(ranks_path)).encode

        def serialized(piece: str) -> bytes:
            ids = encode(piece.encode("utf-8"))
            return struct.pack(f"<{len(ids)}i", *ids)

        self.split, self.memo = splitter(pattern), Pieces(serialized)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text))) if text else b""


def codec(ranks_path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return held(("byte_bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def token_bytes(ranks_path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = read_ranks(ranks_path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def id_lists(chunks: list[bytes]) -> pa.ListArray:
    """An Arrow list of 32-bit integers from serialized ids."""
    ends = np.cumsum([0] + [len(c) // 4 for c in chunks])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(chunks), "<i4"), pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and ``ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in slices_by_bytes(batches, 1):
            ids = id_lists([own.encode(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of encode() with the bytes that the ids stand for, as ``decoded binary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_id = held(("token_bytes", ranks_path), lambda: token_bytes(ranks_path)).__getitem__
        for batch in slices_by_bytes(batches, 1):
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
            ends = ends - ends[0]
            data = [b"".join(map(of_id, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(data, pa.binary())], [id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded binary")


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode() of encode(), by one Python worker for each task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_id = held(("byte_bpe", ranks_path, pattern, "both"), lambda: (Codec(ranks_path, pattern), token_bytes(ranks_path).__getitem__))
        for batch in slices_by_bytes(batches, 1):
            chunks = [own.encode(t) for t in batch.column(1).to_pylist()]
            data = [b"".join(map(of_id, np.frombuffer(c, "<i4").tolist())) for c in chunks]
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(chunks), pa.array(data, pa.binary())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of what decode() returns."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Documents encoded, decoded and summed up, one row each."""
    return digests(encode_and_decode(docs, ranks_path, pattern))
