"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one valid last token: the last id of the prefix's own encoding.  The table of these ids is filled
left to right.  A token that ends at a byte is the valid one if it starts the piece, or if it and the valid last token of what stands before it are
compatible, that is, if merging their bytes alone would give just these two.  Walking the table back from any byte gives that prefix's encoding, so an
append only extends the table, and an edit only refills it from the changed byte on.

Texts are cut into the pretokenizer's pieces first; pieces never influence each other.  Null texts count as empty; empty texts have no ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pieces, and pairs of tokens, that a worker remembers; beyond it the memory starts anew.
CACHE_PIECES = 200_000
#: Characters of a piece that is remembered, at most.
CACHE_CHARS = 64
CACHE_PAIRS = 300_000
#: Characters from which a text's pieces are taken in blocks.
LONG_TEXT, BLOCK_PIECES = 2_000_000, 200_000
#: White space as the Unicode property has it; Python's own class also holds the four separators U+001C to U+001F.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_NEVER = float("inf")


def piece_pattern(pattern: str = public_tokenizers.PATTERN):
    r"""The compiled pattern, with \s and \S spelled out as the Unicode property."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


class PrefixTable:
    """The valid last token of every byte prefix of one piece."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b"") -> None:
        self.bpe, self.piece, self.last = bpe, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        at, self.piece = len(self.piece), self.piece + more
        self.bpe.fill(self.piece, self.last, at)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace the bytes from start to end; the table before start stays as it is."""
        tail = self.piece[end:]
        self.piece = self.piece[:start]
        del self.last[start:]
        self.append(new + tail)

    def ids(self, upto: int | None = None) -> tuple[int, ...]:
        return self.bpe.walk(self.last, len(self.last) if upto is None else upto)


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: Every suffix of a token, with the token's id where it is one itself, else -1.
        self.suffixes: dict[bytes, int] = {}
        for token in ranks:
            for at in range(1, len(token)):
                self.suffixes.setdefault(token[at:], -1)
        self.suffixes.update(ranks)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._left: dict[int, list[int]] = {}
        self._right: dict[int, list[int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, and for a token that merging never reaches."""
        if token not in self._halves:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def edge(self, token: int, right: bool) -> list[int]:
        """What stands at the token's left or right end while it is merged, from a byte to the token itself."""
        known = self._right if right else self._left
        if token not in known:
            chain_, t = [token], token
            while (h := self.halves(t)) is not None:
                chain_.append(t := h[right])
            known[token] = chain_[::-1]
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b: no merge across their border ever comes first."""
        if (known := self._fits.get((a, b))) is not None:
            return known
        left, right, i, j, ok = self.edge(a, True), self.edge(b, False), 0, 0, None
        while ok is None:
            next_a = left[i + 1] if i + 1 < len(left) else _NEVER
            next_b = right[j + 1] if j + 1 < len(right) else _NEVER
            across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]], _NEVER)
            if across < next_a and across <= next_b:  # equal ranks merge from the left
                ok = False
            elif next_a == next_b == _NEVER:
                ok = True
            elif next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self._fits) > CACHE_PAIRS:
            self._fits.clear()
        self._fits[a, b] = ok
        return ok

    def fill(self, piece: bytes, last: list[int], at: int) -> None:
        """Extend the table from byte at on."""
        suffixes, fits = self.suffixes, self._fits
        for end in range(at + 1, len(piece) + 1):
            found, start = -1, end - 1
            while start >= 0 and (token := suffixes.get(piece[start:end])) is not None:
                if token >= 0:
                    if start == 0:
                        if self.reachable(token):
                            found = token
                    else:
                        ok = fits.get((last[start - 1], token))
                        if (self.reachable(token) and self.fits(last[start - 1], token)) if ok is None else ok:
                            found = token
                            break
                start -= 1
            last.append(found)

    def walk(self, last: list[int], upto: int) -> tuple[int, ...]:
        ids = []
        while upto:
            ids.append(last[upto - 1])
            upto -= len(self.tokens[ids[-1]])
        return tuple(ids[::-1])

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """A piece that is a token is that token, as in rank-file tokenizers, even if merging didn't reach it."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        last: list[int] = []
        self.fill(piece, last, 0)
        return self.walk(last, len(piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Pieces(dict):
    """Ids by piece, found when first asked for."""

    def __init__(self, bpe: PrefixBPE) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.bpe.encode_piece(piece.encode())
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            self.bpe = PrefixBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.pattern, self.pieces = piece_pattern(pattern), Pieces(self.bpe)
        self.decimal = [str(i) for i in range(len(self.bpe.tokens))]

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The text's ids, in blocks of bounded size."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        ids = lambda pieces: list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
        if len(text) < LONG_TEXT:
            yield ids(self.pattern.findall(text))
        else:
            matches = self.pattern.finditer(text)
            while block := [m[0] for m in islice(matches, BLOCK_PIECES)]:
                yield ids(block)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decode(self, ids) -> bytes:
        return self.bpe.decode(ids)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimal text, SHA-256 of what they decode to."""
        n, coded, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.blocks(text):
            if ids:
                coded.update(((" " if n else "") + " ".join(map(self.decimal.__getitem__, ids))).encode())
                decoded.update(self.decode(ids))
                n += len(ids)
        return n, coded.hexdigest(), decoded.hexdigest()


class EditableText:
    """A text with its pieces' encodings; appends and edits encode again only pieces near the change."""

    def __init__(self, codec: Codec, text: str = "") -> None:
        self.codec, self.text, self.starts, self.encoded = codec, "", [], []
        self.reencoded = 0
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end.  Pieces from two before the change on are cut again until old borders recur."""
        from bisect import bisect_left, bisect_right

        first = max(0, bisect_right(self.starts, start) - 3)
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        at = self.starts[first] if self.starts else 0
        starts, encoded, tail = [], [], len(self.starts)
        for m in self.codec.pattern.finditer(text, at):
            if m.start() >= start + len(new):
                k = bisect_left(self.starts, m.start() - shift)
                if k < len(self.starts) and self.starts[k] == m.start() - shift and self.starts[k] >= end:
                    tail = k
                    break
            starts.append(m.start())
            encoded.append(self.codec.pieces[m[0]])
        self.reencoded = len(starts)
        self.starts[first:] = starts + [s + shift for s in self.starts[tail:]]
        self.encoded[first:] = encoded + self.encoded[tail:]
        self.text = text

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.encoded))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return Codec(path, pattern)


common.keeps("codec", codec.cache_clear)


def encode(docs: DataFrame, path: str = RANKS_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, ids array<int>) per row of docs; null texts give an empty array."""

    def rows(batch: pa.RecordBatch) -> list:
        common.only("codec")
        c = codec(path)
        return [batch.column(0), [c.encode(t or "") for t in batch.column(1).to_pylist()]]

    return common.mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str = RANKS_PATH) -> DataFrame:
    """One row (doc_id, content binary) per row of encode()."""

    def rows(batch: pa.RecordBatch) -> list:
        common.only("codec")
        c = codec(path)
        return [batch.column(0), [c.decode(ids or ()) for ids in batch.column(1).to_pylist()]]

    return common.mapped(encoded.select("doc_id", "ids"), rows, "doc_id bigint, content binary")


def round_trip_digests(docs: DataFrame, path: str = RANKS_PATH) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs: ids and decoded bytes are made and digested in one task, not kept.

    Null and empty texts have no ids (both digests are those of nothing); null ids stay null; repeated rows give repeated rows."""

    def rows(batch: pa.RecordBatch) -> list:
        common.only("codec")
        c = codec(path)
        return [batch.column(0), *(zip(*found, strict=True) if (found := [c.digests(t or "") for t in batch.column(1).to_pylist()]) else ([], [], []))]

    return common.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
