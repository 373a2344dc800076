"""Byte-level BPE: exact merges in linear time, and decoding.

A piece's bytes, mapped to Latin-1 characters, run once through an Aho-Corasick
automaton of the vocabulary, which gives the longest token at every start. The
encoder takes longest tokens from the left and steps back where two neighbours
could not have stayed apart under the merge order. Whether two tokens may stand
side by side depends on the two alone, so the answers are kept.

For the result the order of merges never has to be replayed: a sequence of
tokens is the one the merges give if and only if every pair of neighbours is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

KEPT_PIECES = 500_000  # encoded pieces kept for reuse in a worker; emptied when full
KEPT_BYTES = 48  # longer pieces are not kept
KEPT_PAIRS = 2_000_000


class Pieces(dict):
    """The ids of pieces, coded when first asked for and kept up to a bound."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        ids = self._encode(data)
        if len(data) <= KEPT_BYTES:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """Encoder and decoder of a rank file, cut into pieces by ``pattern``."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        # On ASCII texts the standard library's engine finds the same pieces faster.
        plain = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        plain = re.sub(r"(?<!\[)A-Za-z\+", "[A-Za-z]+", plain)
        plain = re.sub(r"(?<!\[)0-9\+", "[0-9]+", plain)
        self.split_ascii = None
        if r"\p" not in plain:
            spaces = r"\t-\r "
            plain = plain.replace(r"[^\s", rf"[^{spaces}").replace(r"\s", rf"[{spaces}]").replace(r"\S", rf"[^{spaces}]")
            self.split_ascii = re.compile(plain).findall
        self._parts = self._halves()
        self._automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if rank in self._parts:
                self._automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self._automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces = Pieces(self.encode_piece)

    def _halves(self) -> dict[int, tuple[int, int] | None]:
        """For each token that merges can make, the last merge that makes it."""
        parts: dict[int, tuple[int, int] | None] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                parts[rank] = None
                continue
            halves = self._last_merge(token)
            if halves:
                parts[rank] = halves
        return parts

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that are left of a token before its last merge, by merging plainly."""
        ranks = self.ranks
        words = [token[i:i + 1] for i in range(len(token))]
        while len(words) > 2:
            best, at = None, -1
            for i in range(len(words) - 1):
                rank = ranks.get(words[i] + words[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return None
            words[at:at + 2] = [words[at] + words[at + 1]]
        return (ranks[words[0]], ranks[words[1]]) if all(w in ranks for w in words) else None

    def _may_touch(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens apart when they meet."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Take the later-made of the two tokens apart again and again. At each step a merge over the
        border must not come before the merge that made the last one taken apart."""
        ranks, parts, bytes_of = self.ranks, self._parts, self.bytes_of
        made = float("inf")
        while True:
            over = ranks.get(bytes_of[left] + bytes_of[right])
            if over is not None and over < made:
                return False
            # Equal ranks: the merge further left comes first, so the right token is the later one.
            left_parts, right_parts = parts[left], parts[right]
            if left_parts is None and right_parts is None:
                return True
            if right_parts is None or left_parts is not None and left > right:
                made, left = left, left_parts[1]
            else:
                made, right = right + 1, right_parts[0]

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token; -1 if there is none."""
        known = self._shorter.get(token)
        if known is None:
            data, known = self.bytes_of[token], -1
            for end in range(len(data) - 1, 0, -1):
                rank = self.ranks.get(data[:end])
                if rank is not None and rank in self._parts:
                    known = rank
                    break
            self._shorter[token] = known
        return known

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size, letters = len(data), data.decode("latin-1")
        # Longest tokens from the left are most often the answer as they are.
        pairs, last, greedy, covered = self._pairs, None, [], 0
        for _, (length, rank) in self._automaton.iter_long(letters):
            if last is not None:
                apart = pairs.get((last, rank))
                if not (self._may_touch(last, rank) if apart is None else apart):
                    break
            greedy.append(rank)
            covered += length
            last = rank
        if covered == size:
            return tuple(greedy)
        longest = [-1] * size
        reach = [0] * size
        for end, (length, rank) in self._automaton.iter(letters):
            start = end - length + 1
            if length > reach[start]:
                reach[start], longest[start] = length, rank
        lengths, may_touch = self.bytes_of, self._may_touch
        open_ends = bytearray(b"\x01") * (size + 1)  # 0: no way on from there
        tokens: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            last = tokens[-1] if tokens else -1
            while True:
                end = at + len(lengths[token])
                if open_ends[end] and (last < 0 or may_touch(last, token)):
                    tokens.append(token)
                    at = end
                    token = longest[at] if at < size else -1
                    break
                token = self._next_shorter(token)
                if token < 0:
                    open_ends[at] = 0
                    token = tokens.pop()
                    at -= len(lengths[token])
                    last = tokens[-1] if tokens else -1
        return tuple(tokens)

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        split = self.split_ascii if self.split_ascii and text.isascii() else self.split
        return list(chain.from_iterable(map(self._pieces.__getitem__, split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """The tokenizer, read once in each worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) for each row: its token ids. A null or empty text has none; repeated
    rows are coded each; an empty table gives no rows. ``path`` must be readable on every worker."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def convert(batch):
        coder = load(path, pattern)
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            ids = [coder.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return by_batch(rows, convert, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode_ids(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data) of rows (doc_id, ids): the bytes the ids stand for. Null ids give no bytes; an id that
    is not in the vocabulary is an error."""

    def convert(batch):
        coder = load(path, pattern)
        data = [coder.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return by_batch(coded.select("doc_id", "ids"), convert, f"doc_id {dict(coded.dtypes)['doc_id']}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, in one pass."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def convert(batch):
        coder = load(path, pattern)
        counts, digests, decoded = [], [], []
        for value in batch.column(1):
            ids = coder.encode(value.as_py() or "")
            counts.append(len(ids))
            digests.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(rows, convert, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, "
                                   "decoded_sha256 string")
