"""Bounded-space online packing of tokenised documents.

Each partition keeps a fixed number of open windows.  The next piece goes into the
open window that it fills best; when none has room and no more may be opened, the
fullest one is emitted.  What stays open at the end of the partitions is merged in a
second, small step over groups of neighbouring partitions.  Token ids never leave the
task that made them: only a piece's length and checksum do.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.storage import written
from pulsegrid.llm.text import ragged, raw_strings, runs

WINDOW = 2048
OPEN_WINDOWS = 64
MERGED_PARTITIONS = 64
END_ID = 1
#: Chunks that a tokenizer remembers at most; beyond that it keeps the KEPT_CHUNKS it met first.
CACHED_CHUNKS, KEPT_CHUNKS = 200_000, 100_000

#: Characters that tokenizers and Python may not both take for white space, and the start of a special token.
_UNSURE = re.compile("<\\||[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f\\u3000\\ufeff]")
_MARK = "\x01"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long"


#: First bytes of the characters that _UNSURE looks for.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x01, 0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_LATIN = re.compile("[\\x21-\\x7e\\xa1-\\u024f]*")


class _Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number

    def first(self, n: int) -> _Numbering:
        kept = _Numbering()
        kept.update(itertools.islice(self.items(), n))
        return kept


class _ByteNames(dict):
    """How a byte-level pre-tokenizer writes a character, by code point."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int) -> str:
        name = self[code] = "".join(part for part, _ in self.rule.pre_tokenize_str(chr(code)))
        return name


class _Ragged:
    """Growing list of id lists in one array."""

    def __init__(self):
        self.ids, self.at, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        used, n = int(self.at[self.n]), len(sizes)
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(used + len(ids), np.int32)])
        if self.n + n >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(self.n + n, np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.at[self.n + 1 : self.n + n + 1] = used + np.cumsum(sizes)
        self.n += n

    def keep(self, n: int) -> None:
        self.n = min(self.n, n)
        self.ids, self.at = self.ids[: self.at[self.n]].copy(), self.at[: self.n + 1].copy()

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.at[numbers + 1] - self.at[numbers]
        return self.ids[ragged(self.at[numbers], sizes)], sizes


class ChunkTokenizer:
    """A tokenizer's own ids, with those of white-space-delimited chunks remembered.

    Where the tokenizer drops white space no token spans two chunks, so a text's ids
    are its chunks' ids in a row.  Texts with unusual white space or special-token
    marks, and all texts of other tokenizers, are encoded as a whole.  New chunks of
    Latin letters go straight to the tokenizer's merges, after its own case folding
    and pattern; that this gives its ids is tried out when it is loaded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        one = lambda t: self.inner.encode(t, add_special_tokens=False).ids
        self.mark = one(_MARK)
        self.by_chunk = len(self.mark) == 1 and one("b, Ä's\n\n9x  y") == [*one("b,"), *one("Ä's"), *one("9x"), *one("y")]
        self.direct = False
        self._prepare(path)
        self.forget()
        letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)] if c != 0x3C]
        probe = ["".join(letters), *letters, *(f"a{c}b{c}{c}'re" for c in letters), "I'll they've 12,5!?x"]
        want = [one(t) for t in probe]
        ids, at = self.encode(probe)
        self.direct = self.direct and all(ids[a:b].tolist() == w for a, b, w in zip(at, at[1:], want, strict=False))
        self.forget()

    def _prepare(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        patterns = [p["pattern"]["Regex"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if not self.by_chunk or len(patterns) != 1 or spec["model"].get("end_of_word_suffix") != "</w>":
            return
        self.pattern = regex.compile(patterns[0])
        self.table = _ByteNames(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        self.merges = Tokenizer(self.inner.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.inner.get_vocab_size(), bool)
        self.last[[i for token, i in self.inner.get_vocab(False).items() if token.endswith("</w>")]] = True
        self.direct = True

    def forget(self) -> None:
        self.number, self.chunks = _Numbering(), _Ragged()
        self.piece, self.pieces = _Numbering(), _Ragged()

    def forget_late(self) -> None:
        """Forgets what was met late: frequent words are met early, and most of the rest,
        such as numbers and addresses, never comes again."""
        self.number, self.piece = self.number.first(KEPT_CHUNKS), self.piece.first(KEPT_CHUNKS)
        self.chunks.keep(KEPT_CHUNKS)
        self.pieces.keep(KEPT_CHUNKS)

    def _learn(self) -> None:
        """Ids of the chunks that were numbered but not yet encoded."""
        chunks, self.number.new = self.number.new, []
        if self.direct and all(_LATIN.fullmatch(c) for c in chunks):
            found = [self.pattern.findall(c.lower()) for c in chunks]
            n_pieces = np.fromiter(map(len, found), np.int64, len(found))
            numbers = np.fromiter((self.piece[p] for f in found for p in f), np.int64, int(n_pieces.sum()))
            if new := self.piece.new:
                self.piece.new = []
                ids = np.array(self.merges.encode(" ".join([p.translate(self.table) for p in new])).ids, np.int32)
                self.pieces.extend(ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
            ids, sizes = self.pieces.take(numbers)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n_pieces)]
            self.chunks.extend(ids, np.diff(ends, prepend=0))
        else:
            ids = np.array(self.inner.encode(f" {_MARK} ".join(chunks) + f" {_MARK}", add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(ids == self.mark[0])
            self.chunks.extend(np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)

    def encode(self, texts: list[str], data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's start; ``data`` may hold their bytes."""
        if self.by_chunk and data is not None and not _SUSPECT[data].any():
            whole = [False] * len(texts)
        else:
            whole = [not self.by_chunk or _UNSURE.search(t) is not None or _MARK in t for t in texts]
        if len(self.number) > CACHED_CHUNKS:
            self.forget_late()
        split = [[] if w else t.split() for t, w in zip(texts, whole, strict=True)]
        n_chunks = np.fromiter(map(len, split), np.int64, len(split))
        number = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n_chunks.sum()))
        if self.number.new:
            self._learn()
        ids, sizes = self.chunks.take(number)
        offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n_chunks)]])
        if any(whole):
            parts = [np.array(self.inner.encode(t, add_special_tokens=False).ids, np.int32) if w else ids[a:b] for t, w, a, b in zip(texts, whole, offsets, offsets[1:], strict=False)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One per Python worker, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


class OpenWindows:
    """A bounded set of windows, by the room that is left in each."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}
        self.opened = 0

    def add(self, piece: tuple, length: int) -> list | None:
        """Places a piece; returns the pieces of a window that had to be emitted."""
        k = bisect.bisect_left(self.rooms, (length, -1))
        out = None
        if k < len(self.rooms):
            room, which = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.most:
                out = self.held.pop(self.rooms.pop(0)[1])
            room, which = self.window, self.opened
            self.opened += 1
            self.held[which] = []
        self.held[which].append(piece)
        if room == length:
            full = self.held.pop(which)
            return full if out is None else [*out, None, *full]
        bisect.insort(self.rooms, (room - length, which))
        return out

    def rest(self) -> list[list]:
        return [self.held[w] for _, w in self.rooms]


def padded(length: int, window: int) -> int:
    """Sequences whose length is a power of two keep it; others are padded."""
    return length if length & (length - 1) == 0 else window


def _rows(pieces: list[tuple], sequence: int, window: int) -> list[tuple]:
    total, at, out = sum(p[2] for p in pieces), 0, []
    for p in pieces:
        out.append((*p, sequence, at, total, padded(total, window)))
        at += p[2]
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, text_col: str = "text") -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``window`` ids.

    A document's ids are followed by ``end_id``.  Whole windows are cut from the front
    of longer documents; the remainder stays in one piece.  Null and empty texts hold
    the end id alone; repeated rows and null ids are packed like any other row.
    ``sequence_length`` and ``padded_length`` tell what a sequence holds and takes.
    """
    columns = [f.split()[0] for f in PIECES.split(", ")]
    arrow = pa.schema([*((c, pa.int64()) for c in columns), ("merge_group", pa.int64()), ("open_window", pa.int64())])

    def place(batches):
        part = TaskContext.get().partitionId()
        own, opened, made = tokenizer(tokenizer_path), OpenWindows(window, open_windows), 0
        for batch in batches:
            ids_of = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            column = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = raw_strings(column)
            rows: list[tuple] = []

            def emit(pieces, rows=rows):
                nonlocal made
                rows += [(*r, None, None) for r in _rows(pieces, (part << 32) + made, window)]
                made += 1

            for i, j in runs(offsets):
                tokens, at = own.encode([t or "" for t in column.slice(i, j - i).to_pylist()], data[offsets[i] : offsets[j]])
                for k in range(j - i):
                    doc = np.append(tokens[at[k] : at[k + 1]], end_id).astype("<u4")
                    total = len(doc)
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        piece = (ids_of[i + k], start, length, zlib.crc32(doc[start : start + length]), total)
                        closed = opened.add(piece, length) if length < window else [piece]
                        while closed:
                            cut = closed.index(None) if None in closed else len(closed)
                            emit(closed[:cut])
                            closed = closed[cut + 1 :]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)
        left = [(*r, part // MERGED_PARTITIONS, (part << 32) + k) for k, pieces in enumerate(opened.rest()) for r in _rows(pieces, -1, window)]
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in left], schema=arrow)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit of whole leftover windows, the fullest first."""
        group = int(pdf["merge_group"].iloc[0])
        pdf = pdf.sort_values(["open_window", "offset"])
        size = pdf.groupby("open_window")["length"].sum().sort_values(ascending=False, kind="stable")
        packer, base, where, sequences = OpenWindows(window, len(size)), {}, {}, []
        for which, length in size.items():
            if full := packer.add(which, int(length)):
                sequences.append(full)
        for number, windows in enumerate([*sequences, *packer.rest()]):
            at = 0
            for w in windows:
                base[w], where[w] = at, number
                at += int(size[w])
        pdf["offset"] += pdf["open_window"].map(base)
        pdf["sequence_id"] = (1 << 62) + (group << 32) + pdf["open_window"].map(where)
        pdf["sequence_length"] = pdf.groupby("sequence_id")["length"].transform("sum")
        pdf["padded_length"] = [padded(int(x), window) for x in pdf["sequence_length"]]
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf[columns]

    placed = written(docs.select("doc_id", text_col).mapInArrow(place, PIECES + ", merge_group long, open_window long"), "packed")
    merged = placed.where(F.col("merge_group").isNotNull()).groupBy("merge_group").applyInPandas(merge, PIECES)
    return placed.where(F.col("merge_group").isNull()).select(*columns).unionByName(merged)
