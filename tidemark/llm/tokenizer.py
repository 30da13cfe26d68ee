"""Token ids of whole corpora by a public byte-level BPE vocabulary, by dynamic programming over byte prefixes."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie, unless a caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: Pieces kept with their ids in a worker; beyond that the worker starts afresh (the ids are the same).
MAX_KEPT = 400_000

#: White_Space of Unicode. Fixed values.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def piece_pattern() -> re.Pattern:
    """The vocabulary's piece pattern (contractions, letters, numbers, other marks, white space) for ``re``: it has
    no \\p{L} and \\p{N}, so their ranges are read off from all code points once."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def ranges(kind: str) -> str:
        return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(rf"\p{{{kind}}}+", points))

    letters, numbers = ranges("L"), ranges("N")
    return re.compile(f" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACES}{letters}{numbers}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from the lines of a ranks file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class PrefixEncoder:
    """BPE by the unique valid last token of each byte prefix.

    Of all tokens that end a prefix exactly one can be the last of the prefix's encoding: the one that BPE leaves as
    it is behind the last token of what comes before it. Whether two tokens may stand side by side is a property of
    the pair alone. So the table of last tokens grows byte by byte, linear in the text, and what is appended never
    changes it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tails: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 3:
                tails.setdefault(token[-4:], set()).add(len(token))
        #: lengths of the tokens that end in four given bytes, longest first
        self.tails = {tail: (*sorted(found, reverse=True), 3, 2, 1) for tail, found in tails.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short text: the pair of least rank is merged, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: bytes, token: bytes) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two (of one token: just this one)."""
        key = (before, token)
        if key not in self.pairs:
            if len(self.pairs) > MAX_KEPT:
                self.pairs.clear()
            self.pairs[key] = self.merge(before + token) == ([before, token] if before else [token])
        return self.pairs[key]

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Continue the table ``last`` (length of the last token of each prefix, from prefix 0) to all of ``data``."""
        ranks, tails, short = self.ranks, self.tails, (3, 2, 1)
        last = last or [0]
        for end in range(len(last), len(data) + 1):
            for n in tails.get(data[end - 4 : end], short) if end > 3 else short:
                if n <= end and (token := data[end - n : end]) in ranks:
                    start = end - n
                    if self.fits(b"", token) and (not start or self.fits(data[start - last[start] : start], token)):
                        last.append(n)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def encode(self, data: bytes) -> list[int]:
        last, ids, end = self.extend(data, []), [], len(data)
        while end:
            ids.append(self.ranks[data[end - last[end] : end]])
            end -= last[end]
        return ids[::-1]


class EncodedText:
    """A text with its pieces and ids, which takes appends and edits without encoding the rest again.

    A piece depends on its own characters and the two after it (white space gives its last one to what follows), so an
    edit leaves all pieces that end two before it, and those behind it from the first place on where old and new
    pieces begin together.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.pieces: list[list[int]] = []
        self.encoded = 0
        self.edit(0, 0, text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` by ``new``."""
        old, shift = self.text, len(new) - (end - start)
        self.text = old[:start] + new + old[end:]
        ends = [*self.starts[1:], len(old)] if self.starts else []
        kept = bisect_left(ends, start - 1)
        starts, pieces = self.starts[:kept], self.pieces[:kept]
        later = {s + shift: i for i, s in enumerate(self.starts) if s > end}
        at = ends[kept - 1] if kept else 0
        for match in piece_pattern().finditer(self.text, at):
            if match.start() in later and match.start() > start + len(new):
                i = later[match.start()]
                starts += [s + shift for s in self.starts[i:]]
                pieces += self.pieces[i:]
                break
            starts.append(match.start())
            pieces.append(self.encoder.encode(match[0].encode("utf-8", "replace")))
            self.encoded += 1
        self.starts, self.pieces = starts, pieces

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in p]


class _Kept(dict):
    """Little-endian 32-bit ids of each piece met so far."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MAX_KEPT:
            self.clear()
        data = piece.encode("utf-8", "replace")
        whole = self.encoder.ranks.get(data)
        ids = [whole] if whole is not None and self.encoder.fits(b"", data) else self.encoder.encode(data)
        packed = np.array(ids, dtype="<i4").tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


_workers: dict[int, _Kept] = {}


def encode_corpus(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/{BYTE_BPE_50K}") -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of each row of ``documents`` (doc_id, text), without special tokens.

    A null or empty text has an empty list; repeated rows are encoded each; the spelling of a special token in a text
    is ordinary text; other columns are ignored; an empty table gives none. Texts of any length: the work is linear.
    Only the vocabulary file (of fixed size, checked here) is broadcast.
    """
    with open(vocabulary, "rb") as file:
        data = file.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary file of over 64 MB isn't broadcast")
    shared, key = documents.sparkSession.sparkContext.broadcast(data), hash(data)

    def encode(batches):
        if key not in _workers:
            _workers[key] = _Kept(PrefixEncoder(read_ranks(shared.value)))
        kept, find = _workers[key], piece_pattern().findall
        for batch in batches:
            parts, ends = [], [0]
            for text in batch.column("text").to_pylist():
                if text:
                    parts.append(b"".join(map(kept.__getitem__, find(text))))
                    ends.append(ends[-1] + len(parts[-1]) // 4)
                else:
                    ends.append(ends[-1])
            ids = np.frombuffer(b"".join(parts), dtype="<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")
