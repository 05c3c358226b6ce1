"""Whole-corpus encoding with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens; the distinct unseen ones of a batch are encoded
together as padded integer matrices, one per length bucket.  Each round looks up
the rank of every neighbouring pair in an open-addressing table held in numpy
arrays, merges the leftmost minimum-rank pair of every row, and drops finished
rows.  Pieces too long for a matrix are merged as one flat row, all
non-overlapping copies of the minimum pair per round, which gives the same ids.

Pieces and whole lines are memoised per worker up to a fixed amount, as
revisions of a page share most lines; the memo never changes a result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("FOLDSPAN_TOKENIZERS", "/opt/tokenizers")
#: fixed value: the public pre-token pattern of this vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: upper byte lengths of the matrix buckets; longer pieces take the flat path
BUCKETS = (4, 8, 16, 32, 64, 128, 256)
MEMO_PIECES, MEMO_LINE_CHARS = 400_000, 24 << 20
NONE = np.int64(1) << 40
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hashed lookup from a pair of token ids to the id of their merger."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int64)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        mask = (1 << self.bits) - 1
        while len(todo):
            free = self.keys[slot] == -1
            winner = np.full(1 << self.bits, -1, np.int64)
            winner[slot[free][::-1]] = todo[free][::-1]
            won = winner[winner >= 0]
            self.keys[winner >= 0], self.vals[winner >= 0] = keys[won], merged[won]
            left_over = ~np.isin(todo, won)
            todo, slot = todo[left_over], (slot[left_over] + 1) & mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Merged id of each key, ``NONE`` where there is no such pair."""
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        at = self.keys[slot]
        out = np.where(at == keys, self.vals[slot], NONE)
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slot_ = slot[open_] = (slot[open_] + 1) & mask
            at = self.keys[slot_]
            hit = at == keys[open_]
            out[open_[hit]] = self.vals[slot_[hit]]
            open_ = open_[~hit & (at != -1)]
        return out


class Encoder:
    """One vocabulary, loaded once per worker."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        import regex

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.ranks = ranks
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, merged)))
        self.find = regex.compile(PATTERN).findall
        self.pieces: dict[str, np.ndarray] = {}
        self.lines: dict[str, np.ndarray] = {}
        self.line_chars = 0

    def _matrix(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(b) for b in raw])
        grid = np.full((len(raw), width), -1, np.int64)
        inside = np.arange(width) < sizes[:, None]
        grid[inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        done: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        rows = np.arange(len(raw))
        rank = np.full((len(raw), width - 1), NONE, np.int64)
        both = inside[:, 1:]
        rank[both] = self.pairs((grid[:, :-1][both] << 20) | grid[:, 1:][both])
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            best = rank[line, at]
            over = best == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    done[rows[i]] = grid[i, : sizes[i]].astype(np.int32)
                live = ~over
                rows, grid, sizes, rank, at, best = rows[live], grid[live], sizes[live], rank[live], at[live], best[live]
                if not len(rows):
                    break
                most = int(sizes.max())
                grid, rank = grid[:, :most], rank[:, : max(1, most - 1)]
                line = np.arange(len(rows))
            grid[line, at] = best
            take = np.arange(grid.shape[1] - 1) + (np.arange(grid.shape[1] - 1) > at[:, None])
            grid = np.take_along_axis(grid, take, 1)
            sizes = sizes - 1
            if grid.shape[1] < 2:
                rank = np.full((len(rows), 1), NONE, np.int64)
                continue
            keep = np.arange(grid.shape[1] - 1)
            rank = np.take_along_axis(rank, keep + (keep > at[:, None] - 1), 1)
            for shift in (-1, 0):
                j = at + shift
                ok = (j >= 0) & (j + 1 < sizes)
                inside_j = (j >= 0) & (j < rank.shape[1])
                rank[line[inside_j], j[inside_j]] = NONE
                rank[line[ok], j[ok]] = self.pairs((grid[line[ok], j[ok]] << 20) | grid[line[ok], j[ok] + 1])
        return done

    def _flat(self, raw: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)]
        rank = self.pairs((ids[:-1] << 20) | ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            pos = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.diff(pos, prepend=-9) != 1)
            offset = np.arange(len(pos)) - np.repeat(run, np.diff(np.append(run, len(pos))))
            pos = pos[offset % 2 == 0]
            ids[pos] = best
            ids, rank = np.delete(ids, pos + 1), np.delete(rank, pos)
            new = pos - np.arange(len(pos))
            near = np.unique(np.concatenate([new - 1, new]))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.pairs((ids[near] << 20) | ids[near + 1])
        return ids.astype(np.int32)

    def _learn(self, fresh: list[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in fresh:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.pieces[piece] = np.array([whole], np.int32)
                continue
            width = next((w for w in BUCKETS if len(raw) <= w), 0)
            buckets.setdefault(width, []).append((piece, raw))
        for width, group in buckets.items():
            if width:
                step = max(1, (1 << 20) // width)
                for s in range(0, len(group), step):
                    part = group[s : s + step]
                    self.pieces.update(zip((p for p, _ in part), self._matrix([r for _, r in part], width)))
            else:
                self.pieces.update((p, self._flat(r)) for p, r in group)

    @staticmethod
    def _lines(text: str) -> list[str]:
        """Cut before white space that holds a line end: always a token border."""
        out, now = [], None
        for line in text.split("\n"):
            if now is None:
                now = line
            elif now and not now[-1].isspace():
                out.append(now)
                now = "\n" + line
            else:
                now = f"{now}\n{line}"
        out.append(now)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts; null and empty texts have no ids."""
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        if self.line_chars > MEMO_LINE_CHARS:
            self.lines.clear()
            self.line_chars = 0
        cut = [self._lines(t) if t else [] for t in texts]
        fresh = [x for x in dict.fromkeys(x for lines in cut for x in lines) if x not in self.lines]
        split = [self.find(x) for x in fresh]
        known = self.pieces
        self._learn([p for p in dict.fromkeys(p for ps in split for p in ps) if p not in known])
        empty = np.empty(0, np.int32)
        for x, ps in zip(fresh, split):
            self.lines[x] = np.concatenate([known[p] for p in ps]) if ps else empty
            self.line_chars += len(x)
        get = self.lines.__getitem__
        found = [get(x) for lines in cut for x in lines]
        counts = np.fromiter((len(lines) for lines in cut), np.int64, len(cut))
        sizes = np.concatenate([[0], np.cumsum(np.fromiter((len(a) for a in found), np.int64, len(found)))])
        offsets = sizes[np.concatenate([[0], np.cumsum(counts)])]
        return offsets, np.concatenate(found) if found else empty


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str, name: str) -> Encoder:
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = Encoder(folder, name)
    return _ENCODERS[folder, name]


def _steps(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = np.flatnonzero(np.diff(upto // most)) + 1
    return list(zip([0, *edges], [*edges, len(texts)])) if len(texts) else []


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", chars_a_step: int = 4 << 20) -> DataFrame:
    """``id_col, ids`` of every row: token ids of the text, no special tokens.

    Null and empty texts give an empty list.  Rows keep their number: repeated
    rows and repeated ids are encoded each.  No shuffle; one pass over the scan.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            for start, stop in _steps(batch.column(1), chars_a_step):
                offsets, ids = enc.encode(batch.column(1)[start:stop].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], lists], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, ids array<int>")


def count_tokens(docs: DataFrame, id_cols: list[str], text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", chars_a_step: int = 1 << 20) -> DataFrame:
    """``id_cols`` and ``tokens``, the number of token ids of each text."""
    fields = [docs.schema[c] for c in id_cols]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            text = batch.column(len(id_cols))
            for start, stop in _steps(text, chars_a_step):
                offsets, _ = enc.encode(text[start:stop].to_pylist())
                yield pa.RecordBatch.from_arrays([*[c[start:stop] for c in batch.columns[: len(id_cols)]], pa.array(np.diff(offsets), pa.int64())], names=[*id_cols, "tokens"])

    return docs.select(*id_cols, text_col).mapInArrow(run, schema)
