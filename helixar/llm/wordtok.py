"""Whole-text encoding with a public `tokenizers` file, an Arrow batch at a time, in bounded memory.

The tokenizer in question drops white space and never lets a token cross it, so the ids of a text are the
ids of its space-separated chunks in order. Arrow splits a batch of texts and numbers its distinct chunks; only these
are looked at in Python, and numpy gathers the ids of all texts from theirs. Plain chunks (printable ASCII without the
apostrophe, and Latin-1 letters, which normalisation leaves as they are but for case) are cut into pieces, which go to
the library's BPE model; any other chunk goes through the library's full encoding. Chunks and pieces are remembered
over batches in Arrow arrays, up to `memory` bytes, then forgotten all at once.
A tokenizer file with another normaliser or splitter encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The splitter of the public word_bpe tokenizer, to tell whether chunks can be encoded apart.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN = r"\A[!-&(-~À-ÖØ-öø-ÿ]+\z"
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+| ")
_encoders: dict[str, "BatchEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE shows for each byte: itself if printable, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches [first, first + size) of pool on end."""
    ends = np.cumsum(size)
    return pool[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def slices(batch: pa.RecordBatch, text: int, size: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes in column `text` (a longer text is alone) and `rows` rows at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + size, "right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


class Known:
    """Strings and their ids: an Arrow array for look-ups, and where each one's ids lie in a pool."""

    def __init__(self):
        self.names, self.pool = pa.array([], pa.string()), np.empty(0, np.uint32)
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def nbytes(self) -> int:
        """Twice the arrays, for the hash table of a look-up."""
        return 2 * (self.names.nbytes + self.pool.nbytes + self.first.nbytes + self.size.nbytes)

    def find(self, names: pa.Array) -> np.ndarray:
        """Number of each name, -1 if it is not known."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        """New names; ids: theirs on end."""
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
        self.names, self.pool, self.size = pa.concat_arrays([self.names, names]), np.concatenate([self.pool, ids]), np.concatenate([self.size, size])


class BatchEncoder:
    """Ids of the texts of a batch. Holds about `memory` bytes of chunks and as much of pieces besides the tokenizer."""

    def __init__(self, path: str, memory: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.memory, self.tokenizer = memory, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_chunk = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORD_SPLIT} and split.get("behavior") == "Removed"
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.chunks, self.pieces = Known(), Known()

    def _full(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _split(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks on end, by way of their pieces, and how many each has."""
        if not len(chunks):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), " ")[0].as_py().lower()
        pieces = pa.array(_PIECE.findall(joined), pa.string()).dictionary_encode()
        if self.pieces.nbytes > self.memory:
            self.pieces = Known()
        at = self.pieces.find(pieces.dictionary)
        if (at < 0).any():
            tokenize, letters, ids, size = self.model.tokenize, self.letters, array("I"), []
            new = pieces.dictionary.filter(pa.array(at < 0))
            for piece in new.to_pylist():
                before = len(ids)
                if piece != " ":
                    ids.extend([t.id for t in tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(letters))])
                size.append(len(ids) - before)
            at[at < 0] = len(self.pieces.first) + np.arange(len(new))
            self.pieces.add(new, np.frombuffer(ids, np.uint32), np.asarray(size, np.int64))
        where = pieces.indices.to_numpy(zero_copy_only=False)
        first, size = self.pieces.first[at][where], self.pieces.size[at][where]
        gap = np.flatnonzero(where == pc.index(pieces.dictionary, " ").as_py())
        return gather(self.pieces.pool, first, size), np.diff(np.cumsum(size)[np.append(gap, len(where) - 1)], prepend=0)

    def _number(self, chunks: pa.Array) -> np.ndarray:
        """Numbers in self.chunks of distinct chunks, after learning the new ones."""
        if self.chunks.nbytes > self.memory:
            self.chunks = Known()
        at = self.chunks.find(chunks)
        new = chunks.filter(pa.array(at < 0))
        if len(new):
            plain = pc.and_(pc.match_substring_regex(new, _PLAIN), pc.invert(pc.match_substring(new, "<|")))
            is_plain, held = plain.to_numpy(zero_copy_only=False), len(self.chunks.first)
            self.chunks.add(new.filter(plain), *self._split(new.filter(plain)))
            odd = new.filter(pc.invert(plain))
            ids = [self._full(x) for x in odd.to_pylist()]
            self.chunks.add(odd, np.concatenate([np.empty(0, np.uint32), *ids]), np.asarray([len(x) for x in ids], np.int64))
            order = np.empty(len(new), np.int64)
            order[np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])] = held + np.arange(len(new))
            at[at < 0] = order
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) on end, each with the end id, and how many ids each text has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_chunk:
            own = [np.append(self._full(x), np.uint32(end_id)) for x in texts.to_pylist()]
            return np.concatenate(own), np.asarray([len(x) for x in own], np.int64)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        distinct = words.flatten().dictionary_encode()
        number = self._number(distinct.dictionary)
        ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.insert(distinct.indices.to_numpy(zero_copy_only=False), ends, len(number))  # the end id comes last in the pool
        first, size = np.append(self.chunks.first[number], len(self.chunks.pool))[at], np.append(self.chunks.size[number], 1)[at]
        through = np.cumsum(size)[ends + np.arange(len(ends))]
        return gather(np.append(self.chunks.pool, np.uint32(end_id)), first, size), np.diff(through, prepend=0)


def encoder(path: str | None = None) -> BatchEncoder:
    """This process's encoder for the file."""
    key = path or default_path()
    if key not in _encoders:
        _encoders[key] = BatchEncoder(key)
    return _encoders[key]


def id_type(path: str | None = None) -> str:
    """The narrowest little-endian unsigned integer that holds every id."""
    return "<u2" if encoder(path).vocab_size <= 1 << 16 else "<u4"
