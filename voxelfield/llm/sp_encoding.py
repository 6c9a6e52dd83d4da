"""SentencePiece BPE through a table of last tokens.

For merge-type (BPE) models the encoding of every prefix of a text ends in one
token, and what stands before it is the encoding of the shorter prefix. An
Aho-Corasick automaton names the pieces that end at a position; the one whose
pair with the last token before it is compatible (merging the two pieces'
symbols gives just these two) is the prefix's last token. Following the table
backwards from the end of the text yields the ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.llm.text import filled, kept, map_slices

SPACE = "▁"
# Encoded parts of texts a task remembers; beyond it the oldest are encoded anew.
REMEMBERED = 150_000
REMEMBERED_CHARS = 48
REMEMBERED_PAIRS = 300_000
UNIT = re.compile(" *[^ ]+| +")


@dataclass
class PieceTable:
    """Pieces of one model and what is derived from them."""

    path: str
    pieces: list[str] = field(init=False)
    ids: dict[str, int] = field(init=False)
    units: "Units" = field(init=False)

    def __post_init__(self) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i in range(size) if model.is_control(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = [model.get_score(i) for i in range(size)]
        self.singles = {p for p in self.ids if len(p) == 1}
        self.inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.fits: dict[int, bool] = {}
        self.units = Units(self.encode_unit)
        # What an id adds to the decoded text; bytes from 0x80 on are read together.
        self.shown = np.array([p.replace(SPACE, " ") for p in self.pieces], dtype=object)
        self.shown[self.unknown] = " ⁇ "
        self.high = np.zeros(size, dtype=bool)
        for i, b in self.bytes_of.items():
            self.shown[i], self.high[i] = chr(b), b >= 0x80
        for i in self.control:
            self.shown[i] = ""
        self.automaton = ahocorasick.Automaton()
        # Where a piece's last merge joined it; pieces that merging never makes occur in no encoding.
        self.cuts: dict[int, tuple[int, int]] = {}
        for piece, i in self.ids.items():
            made, pair = self.merge(piece)
            if len(made) == 1:
                self.automaton.add_word(piece, (i, len(piece)))
                if pair:
                    self.cuts[i] = self.ids[pair[0]], self.ids[pair[1]]
        self.automaton.make_automaton()

    def merge(self, piece: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge a text's characters (highest score first, leftmost among equals): what is left, and the last pair merged."""
        out, pair = list(piece), None
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                found = self.ids.get(out[i] + out[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                return out, pair
            pair = out[at], out[at + 1]
            out[at : at + 2] = [pair[0] + pair[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when their characters are merged together.

        Walks back in time: the later of the two pieces' last merges is undone
        until none is left. The pieces at the boundary join if their union is
        a piece that would have been merged before the merge just undone; of
        merges of equal score the one further left comes first.
        """
        pair = left * len(self.pieces) + right
        known = self.fits.get(pair)
        if known is not None:
            return known
        a, b, known = left, right, True
        least, equal = float("-inf"), False  # a union joins when it scores more, or as much where it stands left
        while True:
            union = self.ids.get(self.pieces[a] + self.pieces[b])
            if union is not None and (self.score[union] > least or (equal and self.score[union] == least)):
                known = False
                break
            cut_a, cut_b = self.cuts.get(a), self.cuts.get(b)
            if cut_a is None and cut_b is None:
                break
            if cut_b is None or (cut_a is not None and self.score[a] < self.score[b]):
                least, equal, a = self.score[a], False, cut_a[1]
            else:
                least, equal, b = self.score[b], True, cut_b[0]
        if len(self.fits) >= REMEMBERED_PAIRS:
            self.fits.clear()
        self.fits[pair] = known
        return known

    def encode_run(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces, by the table of last tokens."""
        n = len(text)
        last, start, fits, pieces = [-1] * n, [0] * n, self.fits, len(self.pieces)
        for end, (piece, size) in self.automaton.iter(text):
            if last[end] < 0:
                before = end - size
                if before >= 0:
                    left = last[before]
                    if left < 0:
                        continue
                    known = fits.get(left * pieces + piece)
                    if not (self.compatible(left, piece) if known is None else known):
                        continue
                last[end], start[end] = piece, before
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def encode_unit(self, text: str) -> list[int]:
        """Ids of an escaped text; characters outside the vocabulary become bytes."""
        if self.singles.issuperset(text):
            return self.encode_run(text)
        out, start = [], 0
        for i, c in enumerate(text):
            if c not in self.singles:
                if i > start:
                    out += self.encode_run(text[start:i])
                out += [self.byte_ids[b] for b in c.encode("utf-8")] if self.byte_ids else [self.unknown]
                start = i + 1
        if start < len(text):
            out += self.encode_run(text[start:])
        return out

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, the end id last."""
        # A literal escape character reads as a space. No piece spans the start of a run of spaces after other text.
        text = " " + text.replace(SPACE, " ") if text else ""
        parts = [text] if self.inner else UNIT.findall(text)
        return np.append(np.frombuffer(b"".join(map(self.units.__getitem__, parts)), dtype=np.int32), np.int32(self.end))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, runs of bytes read as UTF-8, spaces restored, the first one dropped."""
        ids = np.asarray(ids, dtype=np.int64)
        shown = self.shown[ids]
        if self.high[ids].any():
            self._join_bytes(ids, shown)
        begin = next((i for i in ids.tolist() if i not in self.control), None)
        text = "".join(shown.tolist())
        if begin is None or begin == self.unknown or begin in self.bytes_of:
            return text
        return text.removeprefix(" ")

    def _join_bytes(self, ids: np.ndarray, shown: np.ndarray) -> None:
        """Replace what each run of high bytes shows by the text of its bytes."""
        at = np.flatnonzero(self.high[ids])
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            shown[run] = ""
            shown[run[0]] = utf8(bytes(self.bytes_of[i] for i in ids[run].tolist()))


class Units(dict):
    """Ids of the parts of texts met lately, as int32 bytes; older ones make room."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = np.array(self.encode(unit.replace(" ", SPACE)), dtype=np.int32).tobytes()
        if len(unit) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}


def utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode_documents(documents: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``documents`` with ids (array<int>, end id last) and decoded text; NULL reads as empty."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema)

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        known = kept(("pieces", path), lambda: PieceTable(path))
        ids = [known.encode(t) for t in filled(part.column("__text")).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
        decoded = pa.array([known.decode(i) for i in ids], pa.string())
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists, decoded], names=[*columns, "ids", "decoded"])

    def done() -> None:
        kept(("pieces", path), lambda: PieceTable(path)).units.forget()

    rows = documents.select(*columns, F.col("text").alias("__text"))
    return map_slices(rows, handle, f"{schema}, ids array<int>, decoded string", "__text", done)


def digest_columns(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        *[c for c in encoded.columns if c not in ("ids", "decoded")],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
