"""SentencePiece encoding and decoding for vocabularies whose pieces are made by merges.

An agenda of adjacent symbol pairs is ordered by score, then from the left: the best pair merges, and the pairs that the
new symbol makes with its neighbours enter the agenda. Where no piece of the vocabulary holds two characters side by side,
no merge can cross them, so a text falls into words that are encoded once and remembered. The agendas of many new words
run together, one merge a word in each step; a long unbroken run has an agenda of its own, on a heap. Each Arrow batch is
checked against the sentencepiece library: every word that it brings, every decoded text, and on demand all whole texts.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import pick, slabs, strings

SPACE = "▁"
#: Bytes of texts that are encoded at a time, characters of a text that are encoded at a time, and ids that are decoded so.
SLAB, BLOCK = 1 << 22, 1 << 20
#: Characters of words whose agendas run together; one step costs each of them a look at all its pairs.
SHORT = 48
TOGETHER = 4096
#: Words that each worker remembers, and what may end one.
REMEMBERED, MARKS = 600_000, ".,;:!?"
_CODES = 0x110000
#: Fixed: kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PLACE = (1 << 20) - 1


class PieceModel:
    """A sentencepiece model file whose pieces are made by merges. encode() and decode() give what the library gives."""

    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        made_of = sentencepiece_model_pb2.ModelProto.FromString(proto)
        how, form = made_of.trainer_spec, made_of.normalizer_spec
        if how.model_type != how.BPE or how.treat_whitespace_as_suffix or made_of.denormalizer_spec.precompiled_charsmap:
            raise ValueError(f"{path}: not a vocabulary of merges with leading spaces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.dummy, self.squeezed, self.fallback = form.add_dummy_prefix, form.remove_extra_whitespaces, how.byte_fallback
        #: Spaces become the space symbol, one more of them leads, and nothing else changes.
        self.plain = not form.precompiled_charsmap and self.dummy and not self.squeezed and form.escape_whitespaces
        self.unknown_text = how.unk_surface.encode()
        pieces = made_of.pieces
        self.size, self.kinds = len(pieces), np.array([p.type for p in pieces])
        self.scores = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER_DEFINED, UNUSED)}
        self.ids = {p.piece: i for i, p in enumerate(pieces)}
        self.unused = {p.piece for p in pieces if p.type == UNUSED}
        own = sorted((p.piece for p in pieces if p.type == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else self.unknown_text if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in pieces]
        self.blob, sizes = np.frombuffer(b"".join(self.raw), np.uint8), np.array([len(x) for x in self.raw])
        self.length, self.start = sizes, np.cumsum(sizes) - sizes
        width = len(str(self.size)) + 1
        self.decimals = np.array([f"{i},".encode().rjust(width) for i in range(self.size)]).view(np.uint8).reshape(self.size, width)
        self._cut(pieces)
        self._tables()
        self.words: dict[str, bytes] = {}

    def _cut(self, pieces: Iterable) -> None:
        """Whether words can be told apart: no piece goes on with a space, and none holds a line feed beside another character."""
        long = [p for p in self.scores if len(p) > 1]
        words = self.own is None and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long)
        lines = words and not any("\n" in p for p in long)
        self.by_words = words and lines and self.plain and self.fallback
        self.segments = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if words and lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if words else "(?s).+")

        self.adjacent = {p[k : k + 2] for p in long for k in range(len(p) - 1)}
        self.marks = {c: np.array([self.ids[c]], "<u4").tobytes() for c in MARKS if c in self.scores}

    def _tables(self) -> None:
        """For agendas that run together: the symbol of each character, and what two symbols merge to."""
        self.base = self.size + _CODES
        self.symbol = np.arange(self.size, self.base, dtype=np.int32)
        for piece in self.scores:
            if len(piece) == 1:
                self.symbol[ord(piece)] = self.ids[piece]
        if self.fallback:  # a character of one byte is that byte's piece; no other piece holds it
            for c in range(128):
                if self.symbol[c] >= self.size and c in self.byte_ids:
                    self.symbol[c] = self.byte_ids[c]
        rank = {s: i for i, s in enumerate(sorted(set(self.scores.values())))}
        found = {}
        for piece, score in self.scores.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if (k == 1 or a in self.scores) and (len(b) == 1 or b in self.scores):
                    left = int(self.symbol[ord(a)]) if k == 1 else self.ids[a]
                    right = int(self.symbol[ord(b)]) if len(b) == 1 else self.ids[b]
                    found[left * self.base + right] = (rank[score], self.ids[piece])
        self.pairs = np.array(sorted(found) or [-1], np.int64)
        self.made = np.array([found.get(int(k), (-1, -1)) for k in self.pairs], np.int64)
        self.together = self.own is None and not self.unused

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: no merge) and merged symbol of pairs."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.made[at, 0], -1), self.made[at, 1]

    def agendas(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of short words one after the other, and where each word's end. Each step takes the first pair of every agenda: the best score, the leftmost of equals."""
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym, word = self.symbol[codes].astype(np.int64), np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        place = (_PLACE - (np.arange(len(sym)) - np.repeat(np.cumsum(sizes) - sizes, sizes)))  # a symbol keeps its first character's
        order, into = np.full(len(sym), -1), np.zeros(len(sym), np.int64)

        def meet(left: np.ndarray) -> None:
            left = left[word[left] == word[left + 1]]
            rank, into[left] = self._look(sym[left], sym[left + 1])
            order[left] = np.where(rank >= 0, rank << 20 | place[left], -1)

        meet(np.arange(len(sym) - 1))
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.maximum.reduceat(order, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(sym))))
            kept = best >= 0
            if not kept.all():  # no pair of theirs merges any more
                done_word.append(word[~kept])
                done_sym.append(sym[~kept])
            at = np.flatnonzero((order == best) & kept)  # left symbols of the pairs that merge
            sym[at] = into[at]
            kept[at + 1] = False
            at = (np.cumsum(kept) - 1)[at]
            sym, word, order, into, place = sym[kept], word[kept], order[kept], into[kept], place[kept]
            order[at] = -1
            at = np.concatenate((at, at[at > 0] - 1))
            meet(at[at + 1 < len(sym)])
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        return sym[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=len(words)))

    def agenda(self, segment: str) -> list[str]:
        """Symbols of one segment, by a heap of its pairs: score, then place. Memory is some 200 bytes a character."""
        symbols, fixed, at = [], [], 0
        for own in self.own.finditer(segment) if self.own else ():
            symbols += [*segment[at : own.start()], own[0]]
            fixed += [False] * (own.start() - at) + [True]
            at = own.end()
        symbols += segment[at:]
        fixed += [False] * (len(symbols) - len(fixed))
        n, scores, parts, heap = len(symbols), self.scores, {}, []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def meet(i: int, j: int) -> None:
            if fixed[i] or fixed[j]:
                return
            piece = symbols[i] + symbols[j]
            score = scores.get(piece)
            if score is not None:
                heapq.heappush(heap, (-score, i, j, piece))
                if piece in self.unused:
                    parts[piece] = symbols[i], symbols[j]

        for i in range(n - 1):
            meet(i, i + 1)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                meet(i, k)
            if before[i] >= 0:
                meet(before[i], i)

        def whole(piece: str) -> list[str]:
            return [x for half in parts[piece] for x in whole(half)] if piece in parts else [piece]

        return [x for s in symbols if s for x in whole(s)]

    def _known(self, piece: str) -> list[int]:
        found = self.ids.get(piece, self.unknown)
        return [self.byte_ids[b] for b in piece.encode()] if found == self.unknown and self.fallback else [found]

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after the other, of parts of normalised texts that no merge crosses the ends of, and where each part's end."""
        short = [s for s in segments if len(s) <= SHORT] if self.together else []
        made = [self.agendas(short[k : k + TOGETHER]) for k in range(0, len(short), TOGETHER)]
        sym = np.concatenate([x for x, _ in made] or [np.zeros(0, np.int64)])
        ends = np.cumsum(np.concatenate([np.diff(x, prepend=0) for _, x in made] or [np.zeros(0, np.int64)]))
        if len(short) == len(segments) and (not len(sym) or sym.max() < self.size):
            return sym, ends
        quick, out, at, k = sym.tolist(), [], 0, 0
        for s in segments:
            if self.together and len(s) <= SHORT:
                out.append([x for i in quick[at : ends[k]] for x in ([i] if i < self.size else self._known(chr(i - self.size)))])
                at, k = ends[k], k + 1
            else:
                out.append([x for piece in self.agenda(s) for x in self._known(piece)])
        return np.array(list(itertools.chain.from_iterable(out)), np.int64), np.cumsum([len(x) for x in out])

    def _learn(self, new: set[str]) -> None:
        """Encodes words (a leading space is meant, unless they begin with a line feed). A mark that ends a word, and that no piece holds behind its last letter, is encoded apart."""
        marked = [w for w in new if w[-1:] in self.marks and len(w) > 1 and w[-2:] not in self.adjacent]
        self._learn_whole(list(new.difference(marked).union([w[:-1] for w in marked]).difference(self.words)))
        self.words.update([(w, self.words[w[:-1]] + self.marks[w[-1]]) for w in marked])

    def _learn_whole(self, words: list[str]) -> None:
        """Encodes words, and checks them against the library."""
        ids, ends = self.encode_segments([w if w[:1] == "\n" else SPACE + w for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        theirs = self.library.encode(words, num_threads=1)
        led = [w[:1] == "\n" or not w for w in words]  # before a line feed the library sets a space; of a space alone it makes nothing
        for k in np.flatnonzero(led).tolist():
            theirs[k] = theirs[k][1:] if words[k] else [self.ids.get(SPACE, self.unknown)]
        if list(map(len, theirs)) != (ends - starts).tolist() or not np.array_equal(ids, np.fromiter(itertools.chain.from_iterable(theirs), np.int64)):
            raise ValueError("the library gives other ids")
        blob = ids.astype("<u4").tobytes()
        self.words.update(zip(words, [blob[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)], strict=True))

    def _split(self, text: str) -> list[str]:
        """Words of a plain model's text, each after a space or (those that begin with one) a line feed. Words may begin with spaces."""
        words = text.replace("\n", " \n").split(" ")
        if "" not in words and SPACE not in text:
            return words
        return [s if s[0] == "\n" else s[1:] for s in self.segments.findall((SPACE + text).replace(" ", SPACE))] if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        if not self.by_words:
            out = []
            for t in texts:
                ids = self.encode_segments(self.segments.findall(self.library.normalize(t) if t else ""))[0].tolist()
                if not self.fallback:  # unknown characters side by side are one
                    ids = [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != x]
                out.append(np.array(ids, np.uint32))
            return out
        if len(self.words) > REMEMBERED:
            self.words.clear()
        split = list(map(self._split, texts))
        new = set(itertools.chain.from_iterable(split)).difference(self.words)
        if new:
            self._learn(new)
        return [np.frombuffer(b"".join(map(self.words.__getitem__, s)), "<u4") for s in split]

    def shown(self, ids: np.ndarray) -> Iterator[bytes]:
        """Decimals of the ids, joined by commas, in parts."""
        for k in range(0, len(ids), BLOCK):
            some = self.decimals[ids[k : k + BLOCK]].ravel()
            some = some[some != ord(" ")].tobytes()
            yield some if k + BLOCK < len(ids) else some[:-1]

    def _text(self, ids: np.ndarray) -> bytes:
        sizes = self.length[ids]
        at = np.repeat(self.start[ids] - np.cumsum(sizes) + sizes, sizes)
        return self.blob[at + np.arange(len(at))].tobytes()

    def decode(self, ids: np.ndarray, mended: bool = False) -> bytes:
        """The text of ids, in UTF-8: the first space goes, bytes of no character are replacement characters."""
        out, raw, at = [], self.raw, 0
        if (self.kinds[ids] == CONTROL).any() and (self.kinds[ids] == BYTE).any() and not mended:
            return self._mended(ids)  # bytes on both sides of a control piece are of different characters
        if self.dummy or self.squeezed:
            while at < len(ids) and not (out and out[-1]):  # leading pieces of no text
                piece, kind = raw[ids[at]], self.kinds[ids[at]]
                led = kind in (NORMAL, USER_DEFINED, UNUSED) and piece[:1] == b" "
                out.append(piece[1:] if led else piece)
                at += 1
                if led and not self.squeezed:
                    break
        for k in range(at, len(ids), BLOCK):
            out.append(self._text(ids[k : k + BLOCK]))
        text = b"".join(out)
        try:
            text.decode()
        except UnicodeDecodeError:
            return self._mended(ids)
        return text

    def _mended(self, ids: np.ndarray) -> bytes:
        """As decode, where byte pieces don't make characters: each byte that is of none is a replacement character."""
        out, led = [], not (self.dummy or self.squeezed)
        for run in np.split(ids, np.flatnonzero(np.diff(self.kinds[ids] == BYTE)) + 1):
            if self.kinds[run[0]] != BYTE:
                out.append(self._text(run) if led else self.decode(run, True))
                led = led or self.kinds[run].max() != CONTROL or self.kinds[run].min() != CONTROL
                continue
            led, rest = True, b"".join(self.raw[i] for i in run.tolist())
            while rest:
                size = next((k for k in range(1, min(4, len(rest)) + 1) if _one_character(rest[:k])), 0)
                out.append(rest[:size] if size else "\N{REPLACEMENT CHARACTER}".encode())
                rest = rest[max(size, 1) :]
        return b"".join(out)

    def blocks(self, text: str) -> list[str]:
        """A very long text of a plain model in parts, cut at single spaces (which go: a part's own leading space stands for them)."""
        if len(text) <= BLOCK or not self.by_words:
            return [text]
        out, at = [], 0
        while len(text) - at > BLOCK:
            cut = next((m.start() for m in re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}\n])").finditer(text, at + BLOCK)), None)
            if cut is None:
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]


def _sha256(parts: Iterable[bytes]) -> str:
    found = hashlib.sha256()
    for x in parts:
        found.update(x)
    return found.hexdigest()


def _one_character(some: bytes) -> bool:
    try:
        return len(some.decode()) == 1
    except UnicodeDecodeError:
        return False


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _encoded(path: str, with_ids: bool, whole: bool) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        check_whole = whole or not model.by_words  # elsewhere each word is checked when it is learned
        for batch in batches:
            data, at = strings(batch.column("text"))
            for a, b in slabs(np.diff(at), SLAB):
                texts = [data[at[i] : at[i + 1]].tobytes().decode() for i in range(a, b)]
                parts = [model.blocks(t) for t in texts]
                flat = list(itertools.chain.from_iterable(parts))
                made = iter(model.encode(flat))
                theirs = iter(model.library.encode(flat, num_threads=1) if check_whole else [])
                rows = []
                for p in parts:
                    own = [next(made) for _ in p]
                    ids = np.concatenate(own)
                    if check_whole and ids.tolist() != [x for _ in p for x in next(theirs)]:
                        raise ValueError("the library gives other ids")
                    text = model.decode(ids)
                    if " ".join(model.library.decode([x.tolist() for x in own])).encode() != text:
                        raise ValueError("the library gives another text")
                    rows.append((len(ids), _sha256(model.shown(ids)), hashlib.sha256(text).hexdigest(), ids.astype(np.int32), text))
                columns = list(zip(*rows, strict=True))
                out = [batch.column("doc_id").slice(a, b - a), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.binary()).cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch(out, names)

    return f


def encode(docs: DataFrame, model: str, with_ids: bool = True, whole: bool = False) -> DataFrame:
    """Ids of each document by a sentencepiece model file, without begin or end ids, and the text that they decode to.

    Returns doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded text in UTF-8),
    and with with_ids also ids and decoded. Null and empty texts have no ids and decode to nothing. A very long text is
    encoded and checked in parts of a million characters, cut where no piece can cross; only a run without a single space
    longer than that is one part, with an agenda of 200 bytes a character where it has no break. Rows are each encoded by
    themselves: repeated rows give repeated results, null ids stay, other columns are ignored, no rows give none. Of pairs
    with equal scores the leftmost merges first.

    Every word is checked against the library in the batch that brings it, and every decoded text; whole: every whole text,
    too, as always where the model doesn't keep words apart. A difference ends the job. The file must be on every executor.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return pick(docs, doc_id="long", text="string").mapInArrow(_encoded(model, with_ids, whole), schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows: doc_id, ids. Returns doc_id and the decoded text; null ids give null, ids outside the vocabulary end the job."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for batch in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return pick(rows, doc_id="long", ids="array<int>").mapInArrow(f, "doc_id long, decoded string")
