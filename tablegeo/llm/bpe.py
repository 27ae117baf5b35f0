"""BPE encoding and decoding.

Encoding is the backtracking scheme: at each position take the longest vocabulary token (found by an
Aho-Corasick automaton over the vocabulary), keep it only if it is *compatible* with the token before it
(the pair is what the merge rules would leave side by side), else try the next shorter token, else step
back.  A bit set of dead positions makes this linear in the length of a piece, and the result is exactly
that of applying the merges in rank order.  Decoding gathers bytes through an offset table of the
vocabulary.

Defined results: a null text encodes like the empty text (no ids) and a null id list decodes to the empty
text; invalid UTF-8 is replaced by U+FFFD before encoding; ids outside the vocabulary decode to nothing.
Texts of any length are encoded whole.  Both operators are column expressions, so rows, their order,
repeats and further columns, whatever their names, are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegeo.llm.common import staged, text_bytes, values, worker_cache

#: Pre-token pattern of byte-level BPE (fixed value of the published tokenizer).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers before it starts its cache anew; bounds memory, not results.
CACHE_PIECES = 200_000
#: Pairs of tokens whose compatibility a worker remembers.
KNOWN_PAIRS = 100_000
#: Longer pieces are not remembered.
CACHE_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the other
    bytes from U+0100 on, in order."""
    plain = [b for b in range(256) if unicodedata.category(chr(b))[0] not in "CZ" and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_kind(content: dict, path: str) -> None:
    """Refuse a file whose splitting or model is not the one built here, instead of giving other tokens."""
    splitter = content.get("pre_tokenizer") or {}
    known = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True)
    model = content["model"]
    plain = model.get("type", "BPE") == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback"))
    added = content.get("added_tokens", [])
    if not known or not plain or content.get("normalizer") or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path} is not byte-level BPE with the usual splitting, no normalizer and plain added tokens")


class Vocabulary:
    """Tokens of a ``tokenizers`` JSON file with byte-level BPE, with what encoding and decoding need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        check_kind(content, path)
        letter, vocab = byte_letters(), content["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in content["added_tokens"])])
        self.bytes: list[bytes] = [b""] * size
        for name, i in vocab.items():
            self.bytes[i] = bytes(letter[c] for c in name)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        merges = (m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"])
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for left, right in merges:  # a token's id grows with the rank of the merge that makes it
            whole = vocab[left + right]
            self.pairs[vocab[left], vocab[right]] = whole
            self.parts.setdefault(whole, (vocab[left], vocab[right]))
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            self.automaton.add_word(self.bytes[i].decode("latin-1"), (len(self.bytes[i]), i))
        self.automaton.make_automaton()
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self.whole = by_bytes = {self.bytes[i]: i for i in vocab.values()}
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for i in vocab.values():
            whole = self.bytes[i]
            self.shorter[i] = next((by_bytes[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in by_bytes), -1)
        self.known: dict[tuple[int, int], bool] = {}
        self.length = [len(b) for b in self.bytes]
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.pattern = regex.compile(PRE_TOKEN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Would the merges leave these two side by side?  No merge across the seam may come before the
        merges that built the tokens around it, so both are unbuilt, the later merge first, while the
        pair now at the seam is looked up in the pair table."""
        bound, whole, parts = 1 << 60, self.pairs.get, self.parts
        while True:
            if whole((left, right), bound) < bound:
                return False
            if left > right:
                bound, inner = left, parts.get(left)
                if inner is not None:
                    left = inner[1]
                    continue
                bound, inner = right + 1, parts.get(right)
                if inner is None:
                    return True
                right = inner[0]
            else:
                bound, inner = right + 1, parts.get(right)
                if inner is not None:
                    right = inner[0]
                    continue
                bound, inner = left, parts.get(left)
                if inner is None:
                    return True
                left = inner[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if piece in self.whole:
            return [self.whole[piece]]
        n = len(piece)
        longest = [-1] * n
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # the later one from a start is the longer one
        length, shorter, known = self.length, self.shorter, self.known
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, last = 0, longest[0] if n else -1, -1
        while at < n:
            while token >= 0:
                if not dead[at + length[token]]:
                    if last < 0:
                        break
                    fits = known.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                        if len(known) < KNOWN_PAIRS:
                            known[last, token] = fits
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last, token = token, longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = shorter[out.pop()]
                at -= length[last]
                last = out[-1] if out else -1
        return out

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(special?, part) in order; special strings in a text are single tokens, as the library has it."""
        if self.splitter is None or not any(s in text for s in self.special):
            yield False, text
            return
        for k, part in enumerate(self.splitter.split(text)):
            if part:
                yield bool(k % 2), part


class PieceCache(dict):
    """What ``make`` gives for a piece, remembered up to CACHE_PIECES pieces."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        made = self.make(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = made
        return made


def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return worker_cache("bpe", ("vocabulary", path), lambda: Vocabulary(path))


def id_cache(path: str) -> PieceCache:
    own = vocabulary(path)
    return worker_cache("bpe", ("ids", path), lambda: PieceCache(lambda piece: np.array(own.encode_piece(piece.encode()), "<u4").tobytes()))


def encode_text(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    own, cache = vocabulary(path), id_cache(path)
    if own.splitter is None or not any(s in text for s in own.special):
        return b"".join(map(cache.__getitem__, own.pattern.findall(text)))
    return b"".join(np.array([own.special[part]], "<u4").tobytes() if special else b"".join(map(cache.__getitem__, own.pattern.findall(part))) for special, part in own.pieces(text))


def decode_ids(packed: bytes, path: str) -> str:
    """The text of packed ids; bytes that are not UTF-8 become U+FFFD, as in the library."""
    own = vocabulary(path)
    ids = np.frombuffer(packed, "<u4").astype(np.int64)
    ids = ids[ids < len(own.length)]
    starts = own.offset[ids]
    sizes = own.offset[ids + 1] - starts
    if not sizes.sum():
        return ""
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return own.pool[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace")


def encoded(text: str | Column, path: str) -> Column:
    """Column of a text's token ids, packed as little-endian unsigned 32-bit integers (see ``unpacked``)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((encode_text(t.decode("utf-8", "replace"), path) for t in values(batch)), pa.binary(), size=len(batch))

    task = staged("bpe", run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, "binary")(text_bytes(text))


def decoded(ids: str | Column, path: str) -> Column:
    """Column of the text that packed token ids stand for."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((decode_ids(x or b"", path) for x in values(batch)), pa.string(), size=len(batch))

    task = staged("bpe", run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, "string")(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(text: str | Column, path: str) -> Column:
    """Column struct<ids, decoded>: a text's packed ids, and the text decoded from them."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    def both(value: bytes) -> dict:
        ids = encode_text(value.decode("utf-8", "replace"), path)
        return {"ids": ids, "decoded": decode_ids(ids, path)}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([both(v) for v in values(batch.slice(i, 512))], kind) for i in range(0, len(batch), 512)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    task = staged("bpe", run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, "struct<ids:binary,decoded:string>")(text_bytes(text))


def unpacked(ids: str | Column) -> Column:
    """Packed ids as an array of integers, with built-in functions."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    digit = lambda k, j: F.conv(F.hex(F.substring(ids, k * 4 + j, 1)), 16, 10).cast("int")
    count = (F.octet_length(ids) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: digit(k, 1) + 256 * digit(k, 2) + 65536 * digit(k, 3))).otherwise(F.array().cast("array<int>"))
