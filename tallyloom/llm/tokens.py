"""Token ids of whole texts by the tokenizers library; each distinct piece of a batch is encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, given_back

END_ID = 0
#: Bytes of text that are encoded together, and the most distinct pieces that a worker remembers.
SLICE_BYTES, MEMO_PIECES = 1 << 24, 1 << 21
#: Pieces of one call of the library.
CALL_PIECES = 4096
#: Mark the first chunk of a text, and cuts within a chunk; texts that hold one are encoded whole.
FIRST, CUT = "\x02", "\x01"
#: White space beside white space, or other than the space and the line feed: pre-tokens may then reach over a cut.
RUNS = r"  | \n|\n |\n\n|[\x01\x02\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Places between characters where a byte-level pre-token always ends: (pattern, replacement with the cut).
LATIN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
CUTS = (
    (rf"({LATIN})([.,;:!?\n])", rf"\1{CUT}\2"),
    (r"([.,;:!?])\n", rf"\1{CUT}" + "\n"),
    (rf"\n({LATIN})", f"\n{CUT}" + r"\1"),
)


def gather(table: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs table[start : start + length], one after the other."""
    at = np.cumsum(length) - length
    return table[np.repeat(start - at, length) + np.arange(int(length.sum()))]


def _sums(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run of values between offsets, in units of the values."""
    ends = np.concatenate([[0], np.cumsum(values)])
    return ends[offsets[:-1]], ends[offsets[1:]] - ends[offsets[:-1]]


class ChunkEncoder:
    """Encodes texts as the tokenizer file does, with add_special_tokens=False.

    Pre-tokens of a byte-level tokenizer never continue past a single space or line feed between other
    characters, nor from a Latin letter into a punctuation mark. Texts are cut there and each distinct
    piece is encoded once, many in one call with line feeds between; pieces are remembered (at most
    MEMO_PIECES, then the memory starts anew). Texts with runs of white space, other white space or the string of an added
    token are encoded whole, as are all texts if the tokenizer file has another pre-tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            state = json.load(file)
        before = state.get("pre_tokenizer") or {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuttable = byte_level and not state.get("normalizer") and not state.get("post_processor") and len(line) == 1
        self.line = line[0] if line else -1
        added = [re.escape(x["content"]) for x in state.get("added_tokens", [])]
        self.whole_pattern = "|".join([RUNS, *added])
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Encodes pieces that are not known; their positions among the known ones."""
        base = len(self.known)
        spaced = pc.match_substring_regex(pieces, r"^\s*$|\n")
        joined, alone = pieces.filter(pc.invert(spaced)), pieces.filter(spaced)
        ids, lengths = [], []
        if len(joined):
            cuts = pa.array([*range(0, len(joined), CALL_PIECES), len(joined)], pa.int32())
            texts = pc.binary_join(pa.ListArray.from_arrays(cuts, joined), "\n").to_pylist()
            found = np.concatenate([x for part in self.whole(texts) for x in (part, np.array([self.line], np.uint32))])
            ends = np.flatnonzero(found == self.line)
            if len(ends) != len(joined):
                raise ValueError("a line feed is no token of its own in this tokenizer")
            ids.append(found[found != self.line])
            lengths.append(np.diff(ends, prepend=-1) - 1)
        if len(alone):
            each = self.whole(alone.to_pylist())
            ids += each
            lengths.append(np.array([len(x) for x in each], np.int64))
        self.known = pa.concat_arrays([self.known, joined, alone])
        self.ids = np.concatenate([self.ids, *ids])
        self.lengths = np.concatenate([self.lengths, *lengths]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        behind = spaced.to_numpy(zero_copy_only=False)
        return base + np.where(behind, len(joined) + np.cumsum(behind), np.cumsum(~behind)) - 1

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Positions of distinct pieces among the known ones."""
        found = pc.index_in(pieces, value_set=self.known)
        missing = found.is_null().to_numpy(zero_copy_only=False)
        if len(self.known) + missing.sum() > MEMO_PIECES:
            self._forget()
            missing[:] = True
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if missing.any():
            at[missing] = self._learn(pieces.filter(pa.array(missing)))
        return at

    def _cut_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(pc.binary_join_element_wise(FIRST, texts, ""), " ")
        chunks = words.flatten().dictionary_encode()
        first = pc.starts_with(chunks.dictionary, FIRST)
        source = pc.if_else(first, pc.utf8_slice_codeunits(chunks.dictionary, 1), pc.binary_join_element_wise(" ", chunks.dictionary, ""))
        for pattern, cut in CUTS:
            source = pc.replace_substring_regex(source, pattern, cut)
        parts = pc.split_pattern(source, CUT)
        pieces = parts.flatten().dictionary_encode()
        at = self._places(pieces.dictionary)[pieces.indices.to_numpy()]
        length = self.lengths[at]
        chunk_ids = gather(self.ids, self.starts[at], length)
        start, length = _sums(length, parts.offsets.to_numpy())
        at = chunks.indices.to_numpy()
        length = length[at]
        ids = gather(chunk_ids, start[at], length)
        return ids, _sums(length, words.offsets.to_numpy())[1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, with the end id after each; number of ids of each text)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        as_whole = pc.match_substring_regex(texts, self.whole_pattern) if self.cuttable else pa.array(np.ones(len(texts), bool))
        rows = np.flatnonzero(as_whole.to_numpy(zero_copy_only=False))
        ids, lengths = self._cut_ids(pc.if_else(as_whole, "", texts)) if len(rows) < len(texts) else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        if len(rows):
            found = self.whole(texts.take(pa.array(rows)).to_pylist())
            at = (np.cumsum(lengths) - lengths)[rows]
            kept = np.split(ids, at)
            ids = np.concatenate([kept[0], *(x for pair in zip(found, kept[1:], strict=True) for x in pair)])
            lengths[rows] = [len(x) for x in found]
        out = np.full(len(ids) + len(lengths), END_ID, "<u4")
        own = np.ones(len(out), bool)
        own[np.cumsum(lengths + 1) - 1] = False
        out[own] = ids
        return out, lengths + 1


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker, so that its memory outlives a task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, text: str = "body") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most SLICE_BYTES of text (or one row), and their ids as of ChunkEncoder.encode."""
    for batch in given_back(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            part = batch.slice(at, stop - at)
            yield part, *encoder(vocabulary).encode(part.column(text))
            at = stop
            give_back()


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
