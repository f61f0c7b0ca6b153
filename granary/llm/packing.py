"""Best-fit packing: bounded-space online best-fit of token pieces into training sequences.

A fixed number of bins is open. A bitset has a bit for each free space that some open bin has, so the tightest bin that
a piece fits into is one shift and one lowest set bit. When a bin more is needed than may be open, the fullest closes.
Each partition packs its own pieces as it reads them, with a lookahead of 256 documents, of which the longest pieces go
first; memory is the open bins with their pieces, and one batch. Sequences leave when they close. What is in the bins that
are still open at the end of a partition is packed a second time, in partitions of thousands of sequences, so the result
hardly depends on how the input is split.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import pick, stored, strings

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32()))
LOOKAHEAD = 256
#: Sequences that a partition of the second pass is made for; no more than a few of them stay part-filled.
SECOND = 4096
#: Words that each worker remembers the ids of.
REMEMBERED = 600_000
#: ASCII punctuation is a token of its own beside letters; but an apostrophe before letters may bind to them.
TRAILING = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LEADING = TRAILING.replace("'", "")
#: Fixed: how the files that WordTokenizer can read compose, lower-case and split a text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Byte-level vocabularies write a byte as the character of that number if it is printable, else as one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b if b in _PRINTED else 256 + [x for x in range(256) if x not in _PRINTED].index(b) for b in range(256)}


class OpenBins:
    """Bounded-space best fit of pieces. place(length, piece) gives a bin's number and the offset in it, and full() what has closed since."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most, self.bits, self.made, self.count = size, most, 0, 0, 0
        self.by_space: dict[int, list[int]] = {}
        self.held: dict[int, list] = {}  # pieces of the open bins
        self.closed: list[tuple[int, list]] = []

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.count -= 1
        return found

    def place(self, length: int, piece: object = None) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            if self.count >= self.most:
                self._close(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest
            space, found = self.size, self.made
            self.made += 1
        self.held.setdefault(found, []).append(piece)
        left = space - length
        if left:
            self.by_space.setdefault(left, []).append(found)
            self.bits |= 1 << left
            self.count += 1
        else:
            self._close(found)
        return found, self.size - space

    def _close(self, number: int) -> None:
        self.closed.append((number, self.held.pop(number)))

    def full(self) -> list[tuple[int, list]]:
        """Numbers and pieces of the bins that have closed since the last call."""
        out, self.closed = self.closed, []
        return out


class WordTokenizer:
    """Ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizers file whose tokens never cross white space.

    Ids are made once a word and remembered. Words of letters, perhaps between ASCII punctuation, are looked up
    in lower case, by the file's model alone; all others, and texts with letters whose lower case depends on their
    place or with special tokens, go to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made_of = json.load(f)
        if made_of.get("normalizer") != NORMALIZER or made_of.get("pre_tokenizer") != SPLITTER:
            raise ValueError(f"{path}: not a tokenizer of lower-cased words")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.marks = {"": b""}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: str) -> bytes:
        """Ids of a word of letters, in lower case and composed: the model's tokens of its bytes, written as the file writes bytes."""
        text = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        words, cores, marks = self.words, self.cores, self.marks
        for word in new:
            if word.isalpha():
                core, lead, mark = word.lower().decode(), "", ""
            elif word[:-1].isalpha() and word[-1:] in b".,":
                core, lead, mark = word[:-1].lower().decode(), "", word[-1:].decode()
            else:
                text = word.decode()
                left = text.lstrip(LEADING)
                core = left.rstrip(TRAILING)
                lead, mark = text[: len(text) - len(left)], left[len(core) :]
                if not core.isalpha() or "<|" in text or not (core.isascii() or _plain_lower(core)):
                    words[word] = self._plain(text)
                    continue
                core = core.lower()
            ids = cores.get(core)
            if ids is None:
                ids = cores[core] = self._core(core)
            if lead or mark:
                for x in (lead, mark):
                    if x not in marks:
                        marks[x] = self._plain(x)
                ids = marks[lead] + ids + marks[mark]
            words[word] = ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.cores.clear()
            self.marks = {"": b""}
        # beyond ASCII, letters are composed before they are lower-cased; special tokens are told by their case
        split = [(t.lower() if t.isascii() and b"<|" not in t else t).split() for t in texts]
        known = self.words
        self._learn(set(itertools.chain.from_iterable(split)).difference(known))
        return [b"".join(map(known.__getitem__, s)) for s in split]


def _plain_lower(core: str) -> bool:
    """Whether lower case and composed form of a word don't depend on the order they are made in, nor on its neighbours."""
    return "Σ" not in core and "İ" not in core and unicodedata.is_normalized("NFC", core) and unicodedata.is_normalized("NFC", core.lower())


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    n = 8 if with_ids else 7
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns[:n], KINDS[:n], strict=True)], COLUMNS[:n])


def _sequences(bins: list[tuple[int, list]], first: int) -> list[tuple]:
    """Rows of the pieces of some bins. A bin's pieces: doc_id, piece, start, length, ids_crc32, ids."""
    out = []
    for number, pieces in bins:
        at = 0
        for *row, ids in pieces:
            out.append((*row, first + number, at, ids))
            at += row[3]
    return out


def _packed(path: str, size: int, end: int, open_bins: int, with_ids: bool) -> Callable:
    """First pass: documents to pieces in closed sequences; pieces of bins that are open at the end have no sequence yet."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        tokenizer, bins, close = _TOKENIZERS[path], OpenBins(size, open_bins), np.array([end], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, at = strings(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a in range(0, len(ids), LOOKAHEAD):
                b, found = min(a + LOOKAHEAD, len(ids)), []
                for i, made in zip(range(a, b), tokenizer.encode([data[at[i] : at[i + 1]].tobytes() for i in range(a, b)]), strict=True):
                    made += close
                    for k, start in enumerate(range(0, len(made), 4 * size)):
                        piece = made[start : start + 4 * size]
                        found.append((ids[i], k, start // 4, len(piece) // 4, zlib.crc32(piece), np.frombuffer(piece, "<i4") if with_ids else None))
                for row in sorted(found, key=lambda r: -r[3]):
                    bins.place(row[3], row)
                yield _batch(_sequences(bins.full(), first), with_ids)
        open_at_end = [row for pieces in bins.held.values() for row in pieces]
        for a in range(0, len(open_at_end), 4 * LOOKAHEAD):
            yield _batch([(*row[:5], None, None, row[5]) for row in open_at_end[a : a + 4 * LOOKAHEAD]], with_ids)

    return f


def _again(size: int, open_bins: int, with_ids: bool) -> Callable:
    """Second pass, over pieces that come the longest first."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(size, open_bins), 1 << 62 | TaskContext.get().partitionId() << 40
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in COLUMNS[:5]]
            columns.append([np.asarray(x.values) for x in batch.column("ids")] if with_ids else [None] * batch.num_rows)
            for row in zip(*columns, strict=True):
                bins.place(row[3], row)
            yield _batch(_sequences(bins.full(), first), with_ids)
        yield _batch(_sequences(list(bins.held.items()), first), with_ids)

    return f


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, open_bins: int = 64, with_ids: bool = True) -> DataFrame:
    """Packs documents into sequences of at most size tokens.

    A document is its ids by the tokenizers file (no special tokens added), then the end id. Only documents longer than
    size are cut, into pieces of size; very long ones are just more pieces. Returns one row a piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset (where in the sequence), ids. Null and empty texts are just the end id. Rows with
    null or repeated ids are packed like any other. Of bins with equal free space the last one used is taken, and pieces of
    equal length come in the order of the rows. Other columns are ignored; no rows give no rows. Sequence ids hold the
    partition's number and the pass.

    open_bins is a trade: more of them fit pieces better, but all stay part-filled when a partition ends, and the second pass,
    which has as many as a partition of it needs, gets what found no partner.

    The tokenizer must have no token across white space (its file must be on every executor); see WordTokenizer.
    """
    schema = SCHEMA if with_ids else SCHEMA.rpartition(",")[0]
    made = stored(pick(docs, doc_id="long", text="string").mapInArrow(_packed(tokenizer, size, end, open_bins, with_ids), schema))
    rest = made.where("sequence_id is null")
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    order = ("length", "ids_crc32", "doc_id", "start")
    dealt = rest.repartition(max(1, tokens // (SECOND * size))).sortWithinPartitions(*(F.col(c).desc() for c in order))
    return made.where("sequence_id is not null").unionByName(dealt.mapInArrow(_again(size, SECOND, with_ids), schema))
