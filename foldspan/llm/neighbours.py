"""Most similar vectors for every vector, by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``FIT_ROWS`` to ``MOST_FIT_ROWS``) and
broadcast; every row is indexed.

With a least similarity, pairs meet in subtrees.  A row descends to its own
subtree and to those whose border is within a calibrated margin, so that both
ends of a pair stand in one of them; there, the rows are laid out in cells by one
more level of k-means, and a row asks the cells within a second margin.  Margins
are the smallest that reach the wanted share of the hardest pairs that count, so
what a row meets grows far slower than the rows do.

Without one, a row descends to one leaf.  As a query it walks the tree best bin
first: a priority queue of unopened nodes, keyed by distance to their centre,
is popped until the calibrated number of leaves was reached.  The number is the
smallest that finds the wanted share of known neighbours of held-out sample
rows.  A row travels once to the subtree of
its leaf and once to each other subtree it visits, as 64 half-precision numbers
with its leaf list; there, leaves are compared by blocked matrix products.

Subtrees are the unit of distribution.  A
subtree is cut by expected rows, so dense regions get more subtrees rather than
larger tasks.  Exact copies are folded before the shuffle: of the copies in one
batch only the ``k + 1`` smallest ids are indexed (ties go to the smaller id, so
no others can be among the k nearest), the rest look their class up later.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspan.runtime import cut

#: rows the tree is fitted on: one in 20, but no fewer than the first and no more
#: than the second number; the index holds all rows
FIT_ROWS, MOST_FIT_ROWS = 24_000, 400_000
#: rows that walk their queues at once
WALK_ROWS = 10_000
#: sample rows that calibrate the visits
PROBES = 2_000
LEAF_ROWS = 1_500
BRANCH = 16
#: largest subtree, in expected rows; where pairs meet in subtrees, half as many are aimed at, as rows near a border stand in several
GROUP_ROWS = 400_000
#: rows of a cell within a subtree, and most cells of one
CELL_ROWS, MOST_CELLS = 500, 1_024
#: rows of a subtree that are compared without cells
WHOLE_ROWS = 8_000
#: leaves that a row is sent to, and cells that it asks, at most, unless calibration needs more
MOST_MET, MOST_ASKED = 16, 64
#: subtrees in which a row may stand on average even if calibration needs fewer
SPARE = 2.0
#: rows that spread at once, and sample rows among which probes look for neighbours
SPREAD_ROWS, AMONG = 4_096, 20_000
DIM = 64
#: class rows that may be broadcast, and parts of a class beyond that
FEW, SALTS = 200_000, 64
#: queries and index rows compared at once, and pairs held before they are cut to the best
BLOCK, ACROSS, HELD = 1_024, 2_048, 1 << 20


@dataclass
class Tree:
    centres: np.ndarray  # node x dim, unit length
    first: np.ndarray  # first child, -1 at a leaf
    count: np.ndarray  # number of children
    leaf: np.ndarray  # leaf number, -1 inside
    group: np.ndarray  # subtree of a leaf, by leaf number
    roots: int  # nodes 0..roots-1 hang below the root
    shards: np.ndarray  # tasks that share a subtree, by subtree
    base: np.ndarray  # number of the first of them

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row, by greedy descent."""
        node = (x @ self.centres[: self.roots].T).argmax(1)
        while True:
            open_ = np.flatnonzero(self.first[node] >= 0)
            if not len(open_):
                return self.leaf[node]
            for at in np.unique(node[open_]):
                rows = open_[node[open_] == at]
                kids = slice(self.first[at], self.first[at] + self.count[at])
                node[rows] = self.first[at] + (x[rows] @ self.centres[kids].T).argmax(1)

    def visits(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """The first ``leaves`` leaves of each row, in the order of its queue.

        All rows walk at once.  A row's queue is a strip of slots, one per node
        it has met and not opened; each round pops the best slot of every live
        row, and only the children of opened nodes are ever compared with it.
        """
        leaves = min(leaves, int((self.leaf >= 0).sum()))
        if len(x) > WALK_ROWS:
            return np.vstack([self.visits(x[s : s + WALK_ROWS], leaves) for s in range(0, len(x), WALK_ROWS)])
        kids = int(self.count.max(initial=1))
        score = np.full((len(x), self.roots + 4 * kids), -np.inf, np.float32)
        node = np.full(score.shape, -1, np.int32)
        score[:, : self.roots], node[:, : self.roots] = x @ self.centres[: self.roots].T, np.arange(self.roots)
        used = np.full(len(x), self.roots)
        rows, out, got = np.arange(len(x)), np.full((len(x), leaves), -1, np.int32), np.zeros(len(x), np.int64)
        while len(rows):
            line = np.arange(len(rows))
            slot = score[:, : used.max()].argmax(1)
            best = node[line, slot]
            score[line, slot] = -np.inf
            hit = self.leaf[best] >= 0
            at = rows[hit]
            out[at, got[at]] = self.leaf[best[hit]]
            got[at] += 1
            opened = line[~hit]
            if len(opened):
                need = int(used[opened].max()) + kids
                if need > score.shape[1]:
                    more = max(need, 2 * score.shape[1]) - score.shape[1]
                    score = np.hstack([score, np.full((len(rows), more), -np.inf, np.float32)])
                    node = np.hstack([node, np.full((len(rows), more), -1, np.int32)])
                self._open(x[rows[opened]], best[~hit], score, node, opened, used)
            live = got[rows] < leaves
            if not live.all():
                rows, score, node, used = rows[live], score[live], node[live], used[live]
        return out

    def _open(self, x: np.ndarray, at: np.ndarray, score: np.ndarray, node: np.ndarray, line: np.ndarray, used: np.ndarray) -> None:
        """Queues the children of node ``at[i]`` for row ``x[i]``, which holds strip ``line[i]``."""
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        if len(order) >= 32 * len(starts):  # many rows per node: one product each
            for s, e in zip(starts, [*starts[1:], len(order)]):
                part = order[s:e]
                first, n = self.first[at[part[0]]], self.count[at[part[0]]]
                slots = used[line[part]][:, None] + np.arange(n)
                score[line[part][:, None], slots] = x[part] @ self.centres[first : first + n].T
                node[line[part][:, None], slots] = first + np.arange(n)
        else:
            kids = int(self.count[at].max())
            for s in range(0, len(at), 1024):
                part = slice(s, s + 1024)
                own = self.first[at[part]][:, None] + np.arange(kids)
                real = np.arange(kids) < self.count[at[part]][:, None]
                own = np.where(real, own, 0)
                near = np.matmul(self.centres[own], x[part][:, :, None])[:, :, 0]
                slots = used[line[part]][:, None] + np.arange(kids)
                score[line[part][:, None], slots] = np.where(real, near, -np.inf)
                node[line[part][:, None], slots] = own
        used[line] += self.count[at]

    def spread(self, x: np.ndarray, margin: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves within ``margin`` of a row, the ``most`` nearest of them, as ``row, leaf number``.

        At each node a row goes to its best child and to those from whose cell the
        plane halfway to the best one is at most ``margin`` away; a leaf is as far as
        the farthest plane on its way, so the row's own leaf is at distance 0.
        """
        if len(x) > SPREAD_ROWS:
            parts = [self.spread(x[s : s + SPREAD_ROWS], margin, most) for s in range(0, len(x), SPREAD_ROWS)]
            return np.concatenate([r + i * SPREAD_ROWS for i, (r, _) in enumerate(parts)]), np.concatenate([n for _, n in parts])
        row, node, far = np.arange(len(x)), np.full(len(x), -1), np.zeros(len(x), np.float32)
        while True:
            end = (node >= 0) & (self.first[node] < 0)
            if end.all():
                return row, self.leaf[node]
            met = [(row[end], node[end], far[end])]
            open_ = np.flatnonzero(~end)
            open_ = open_[np.argsort(node[open_], kind="stable")]
            for part in np.split(open_, np.flatnonzero(np.diff(node[open_])) + 1):
                at = node[part[0]]
                first, n = (0, self.roots) if at < 0 else (int(self.first[at]), int(self.count[at]))
                centres = self.centres[first : first + n]
                near = x[row[part]] @ centres.T
                best = near.argmax(1)
                apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-12))
                away = (near[np.arange(len(part)), best][:, None] - near) / apart[best]
                to, kid = np.nonzero(away <= margin)
                met.append((row[part[to]], first + kid, np.maximum(far[part[to]], away[to, kid])))
            row, node, far = (np.concatenate(m) for m in zip(*met))
            order = np.lexsort((node, far, row))
            row, node, far = row[order], node[order], far[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < most
            row, node, far = row[keep], node[keep], far[keep]


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        order = np.argsort(at, kind="stable")
        used, start = np.unique(at[order], return_index=True)
        total = np.add.reduceat(x[order], start, axis=0)
        size = np.linalg.norm(total, axis=1)
        ok = size > 1e-9
        centres[used[ok]] = total[ok] / size[ok, None]
    at = (x @ centres.T).argmax(1)
    return centres[np.unique(at)]


def fit(sample: np.ndarray, rows: int, seed: int = 7, leaf_rows: int = LEAF_ROWS, group_rows: int | None = None) -> Tree:
    """Split by spherical k-means until a node stands for ``leaf_rows`` rows."""
    rng = np.random.default_rng(seed)
    scale = max(1.0, rows / max(1, len(sample)))
    leaf_rows = max(leaf_rows, 10 * scale)
    group_rows = group_rows or min(GROUP_ROWS, max(rows / 8, leaf_rows))
    nodes: list[list] = []  # centre, first, count, leaf
    groups: list[int] = []
    held_by: list[float] = []  # expected rows of a leaf
    n_groups = 0

    def open_(x: np.ndarray, group: int) -> list[tuple]:
        """Add the children of a node; those too small alone share a subtree."""
        nonlocal n_groups
        k = int(min(BRANCH, max(2, round(len(x) * scale / leaf_rows)), len(x)))
        centres = _k_means(x, k, rng)
        at = (x @ centres.T).argmax(1)
        added, held = [], 0.0
        near = np.argsort(centres @ centres[0])[::-1] if group < 0 else np.arange(len(centres))
        place = np.full(len(centres), group)
        if group < 0:
            held = np.inf
            for i in near:
                own = (at == i).sum() * scale
                if own > group_rows:
                    continue
                if held + own > group_rows:
                    n_groups, held = n_groups + 1, 0.0
                place[i], held = n_groups - 1, held + own
        for i, c in enumerate(centres):
            nodes.append([c, -1, 0, -1])
            added.append((len(nodes) - 1, x[at == i], int(place[i])))
        return added

    todo = open_(sample, -1)
    roots = len(nodes)
    while todo:
        node, x, group = todo.pop(0)
        if len(x) * scale > 1.5 * leaf_rows and len(x) >= 4:
            first = len(nodes)
            added = open_(x, group)
            if len(added) > 1:
                nodes[node][1:3] = [first, len(added)]
                todo += added
                continue
            del nodes[first:]
        if group < 0:
            group, n_groups = n_groups, n_groups + 1
        nodes[node][3] = len(groups)
        groups.append(group)
        held_by.append(len(x) * scale)
    shards = np.maximum(1, np.ceil(np.bincount(groups, weights=held_by, minlength=n_groups) / (1.5 * GROUP_ROWS)).astype(np.int64))
    return Tree(np.array([n[0] for n in nodes], np.float32), *(np.array([n[i] for n in nodes]) for i in (1, 2, 3)), np.array(groups), roots, shards, np.cumsum(shards) - shards)


def _hardest(sample: np.ndarray, floor: float, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Probe rows and their hardest neighbours that still count.

    A probe is turned in a random direction by the angle of ``floor``, or by that
    of its k-th neighbour in the sample where that is closer.
    """
    rng = np.random.default_rng(seed)
    a = sample[rng.choice(len(sample), min(len(sample), PROBES), replace=False)]
    among = sample[np.sort(rng.choice(len(sample), min(len(sample), AMONG), replace=False))]
    m = min(k + 1, len(among))  # one may be the row itself
    last = np.concatenate([np.partition(a[s : s + 128] @ among.T, -m, axis=1)[:, -m] for s in range(0, len(a), 128)])
    near = np.clip(last, floor, 1)[:, None] if len(among) > k else np.full((len(a), 1), floor, np.float32)
    turn = rng.standard_normal(a.shape).astype(np.float32)
    turn -= (turn * a).sum(1, keepdims=True) * a
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    return a, (near * a + np.sqrt(1 - near * near) * turn).astype(np.float32)


def _narrowest(enough) -> float:
    """Smallest margin at which ``enough``, which stays true beyond it; of unit vectors all leaves are within 2."""
    low, high = -1e-3, 2.0
    while high - low > 2e-3:
        mid = (low + high) / 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return max(high, 0.0)


def _least(share, leaves: int, most: int, recall: float) -> tuple[float, int]:
    """Smallest margin, among as few nearest leaves as do, at which ``share`` reaches ``recall``."""
    while most < leaves and share(2.0, most) < recall:
        most *= 2
    return _narrowest(lambda margin: share(margin, most) >= recall), most


def calibrate_meeting(tree: Tree, sample: np.ndarray, floor: float, k: int, recall: float) -> tuple[float, int]:
    """Margin, and most leaves, with which both ends of the hardest pairs come to one subtree.

    It is wider than needed while rows stand in no more than ``SPARE`` subtrees on average.
    """
    groups = len(tree.shards)
    a, b = _hardest(sample, floor, k)

    def share(margin: float, most: int) -> float:
        keys = [np.unique(row * groups + tree.group[leaf]) for row, leaf in (tree.spread(x, margin, most) for x in (a, b))]
        return len(np.unique(np.intersect1d(*keys) // groups)) / len(a)

    margin, most = _least(share, len(tree.group), MOST_MET, recall)
    spare = _narrowest(lambda margin: len(tree.spread(a, margin, most)[0]) > SPARE * len(a))
    return max(margin, spare - 2e-3), most


def calibrate_similar(tree: Tree, sample: np.ndarray, floor: float, k: int, recall: float) -> tuple[float, int]:
    """Margin, and most leaves, with which one end of the hardest pairs finds the leaf of the other."""
    a, b = _hardest(sample, floor, k)
    ends = (a, tree.assign(b)), (b, tree.assign(a))

    def share(margin: float, most: int) -> float:
        found = np.zeros(len(a), bool)
        for x, own in ends:
            row, leaf = tree.spread(x, margin, most)
            found[row[leaf == own[row]]] = True
        return found.mean()

    return _least(share, len(tree.group), MOST_ASKED, recall)


def cells(x: np.ndarray, rows: int, floor: float, k: int, recall: float, seed: int = 7) -> tuple[Tree, float, int]:
    """One level of cells for the ``rows`` rows of a subtree, of which ``x`` are some; margin and most cells that a row asks."""
    n = int(np.clip(round(rows / CELL_ROWS), 1, min(MOST_CELLS, len(x)))) if rows > WHOLE_ROWS else 1
    centres = _k_means(x[: 16 * n], n, np.random.default_rng(seed), 4)
    n = len(centres)
    tree = Tree(centres, np.full(n, -1), np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), n, np.ones(1, np.int64), np.zeros(1, np.int64))
    return tree, *(calibrate_similar(tree, x, floor, k, recall) if n > 1 else (0.0, 1))


def _place(visits: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Place of each leaf in its row of visits; one past the last if it is not there."""
    n = visits.shape[1]
    return np.stack([np.where(visits == leaf[:, i : i + 1], np.arange(n), n).min(1) for i in range(leaf.shape[1])], 1).squeeze()


def _enough(tree: Tree, recall: float, places) -> int:
    """Fewest visits that reach ``recall``; walks are lengthened until they do."""
    all_, n = int((tree.leaf >= 0).sum()), 8
    while True:
        n = min(n, all_)
        rank = np.sort(np.ravel(places(n)))
        at = rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))))]
        if at < n or n == all_:
            return int(min(all_, at + 1))
        n *= 4


def calibrate_nearest(tree: Tree, sample: np.ndarray, k: int, recall: float, seed: int = 11) -> int:
    """Leaves to visit to find ``recall`` of the k nearest of held-out sample rows.

    Neighbours within a sample are farther apart than in the whole collection,
    so the number errs on the wide side.
    """
    rng = np.random.default_rng(seed)
    pick = rng.choice(len(sample), min(len(sample), PROBES // 4), replace=False)
    near = sample[pick] @ sample.T
    near[np.arange(len(pick)), pick] = -2
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    leaf = tree.assign(sample)[top]
    return _enough(tree, recall, lambda n: _place(tree.visits(sample[pick], n), leaf))


def usable(vec: Column, dim: int = DIM) -> Column:
    """Whether a vector takes part: ``dim`` finite values, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _full(half: np.ndarray) -> np.ndarray:
    x = half.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_MOVED = "g int, kind int, id bigint, class bigint, leaf int, leaves binary, vec binary"
_FOUND = "kind int, a bigint, b bigint, similarity double"


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Byte strings that lie one after the other in ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _name(half: np.ndarray) -> np.ndarray:
    """A number per vector, equal for equal vectors and never 0."""
    odd = np.random.default_rng(3).integers(1 << 62, size=half.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (half.view(np.uint16).astype(np.uint64) * odd).sum(1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed | np.uint64(1)).view(np.int64)


class _Copies:
    """Folds exact copies before the shuffle.

    A copy leaves the index once ``k + 1`` smaller ids of its class were sent by
    this task.  Classes with three ids or more in one batch are remembered, up to
    ``MEMO`` of them; forgetting one sends a few copies more and changes no result.
    """

    MEMO = 100_000

    def __init__(self, k: int):
        self.most, self.sent = k + 1, {}

    def fold(self, ids: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows to index, and the class name of every row (0: none)."""
        names, keep, klass = _name(half), np.ones(len(ids), bool), np.zeros(len(ids), np.int64)
        order = np.lexsort((ids, names))
        start = np.flatnonzero(np.diff(names[order], prepend=0))
        size = np.diff(np.append(start, len(ids)))
        if len(self.sent) > self.MEMO:
            self.sent.clear()
        for s, n in zip(start[size > 2], size[size > 2]):
            rows = order[s : s + n]
            own, place = np.unique(ids[rows], return_index=True)
            if len(own) < 3:
                continue
            name = int(names[rows[0]])
            before = self.sent.get(name, own[:0])
            new = ~np.isin(own, before)
            own, place = own[new], place[new]
            go = np.searchsorted(before, own) + np.arange(len(own)) < self.most
            sent = np.concatenate([before, own[go]])
            keep[rows] = False
            keep[rows[place[go]]] = True
            # further deliveries of ids that were sent are dropped
            klass[rows] = np.where(keep[rows] | ~np.isin(ids[rows], sent), name, 0)
            self.sent[name] = np.sort(sent)[: self.most]
        return keep, klass


def _send(tree_b, visits: int, k: int, every: int):
    """Rows to the subtrees they belong to and visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = tree_b.value
        copies = _Copies(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            half = _unit(batch.column(1)).astype(np.float16)
            x = _full(half)  # equal halves take equal ways
            keep, klass = copies.fold(ids, half)
            rest = ~keep & (klass != 0)
            rest_ids, rest_class = ids[rest], klass[rest]
            ids, x, half, klass = ids[keep], x[keep], half[keep], klass[keep]
            n = len(ids)
            leaf = tree.assign(x) if n else np.empty(0, np.int64)
            home = tree.group[leaf]
            asks = np.flatnonzero(ids % every == 0) if every > 1 else np.arange(n)
            seen = tree.visits(x[asks], visits) if len(asks) else np.empty((0, 1), np.int32)
            where = tree.group[seen]
            order = np.argsort(where, axis=1, kind="stable")
            seen, where = np.take_along_axis(seen, order, 1).astype(np.uint32), np.take_along_axis(where, order, 1)
            # one piece per row and subtree: leaves of it that the row visits
            new = np.ones(where.shape, bool)
            new[:, 1:] = where[:, 1:] != where[:, :-1]
            starts = np.flatnonzero(new.ravel())
            pieces = _binary(seen, np.append(starts, seen.size) * 4)
            row, group = asks[starts // where.shape[1]], where.ravel()[starts]
            at_home = group == home[row]
            lists = np.full(n, -1)
            lists[row[at_home]] = np.flatnonzero(at_home)
            row, group, part = row[~at_home], group[~at_home], np.flatnonzero(~at_home)
            # subtrees of more rows than one task holds stand in shards: rows in one, visitors in all
            shards = tree.shards[group]
            turn = np.repeat(np.arange(len(group)), shards)
            shard = np.arange(len(turn)) - np.repeat(np.cumsum(shards) - shards, shards)
            row, group, part = row[turn], tree.base[group[turn]] + shard, part[turn]
            own = ids % tree.shards[home]
            other = np.flatnonzero(tree.shards[home] > 1)  # a row also asks the other shards of its own subtree
            other = other[lists[other] >= 0]
            turn = np.repeat(other, tree.shards[home[other]])
            shard = np.arange(len(turn)) - np.repeat(np.cumsum(tree.shards[home[other]]) - tree.shards[home[other]], tree.shards[home[other]])
            away = shard != own[turn]
            row, group, part = np.concatenate([row, turn[away]]), np.concatenate([group, tree.base[home[turn[away]]] + shard[away]]), np.concatenate([part, lists[turn[away]]])
            m, r = len(row), len(rest_ids)
            vecs = _binary(half, np.arange(n + 1) * 128)
            none = np.full(r, -1)
            mask = np.concatenate([lists, part, none])
            which = np.concatenate([np.arange(n), row, none])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([tree.base[home] + own, group, np.full(r, -1)]), pa.int32()),
                    pa.array(np.repeat([0, 1, 2], [n, m, r]), pa.int32()),
                    pa.array(np.concatenate([ids, ids[row], rest_ids]), pa.int64()),
                    pa.array(np.concatenate([klass, np.zeros(m, np.int64), rest_class]), pa.int64()),
                    pa.array(np.concatenate([leaf, np.full(m + r, -1)]), pa.int32()),
                    pieces.take(pa.array(mask, pa.int64(), mask=mask < 0)),
                    vecs.take(pa.array(which, pa.int64(), mask=which < 0)),
                ],
                names=[f.split()[0] for f in _MOVED.split(", ")],
            )

    return run


def _scatter(tree_b, margin: float, most: int, k: int):
    """Rows to every subtree within ``margin``, where they are indexed and ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = tree_b.value
        copies = _Copies(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            half = _unit(batch.column(1)).astype(np.float16)
            keep, klass = copies.fold(ids, half)
            rest = ~keep & (klass != 0)
            rest_ids, rest_class = ids[rest], klass[rest]
            ids, half, klass = ids[keep], half[keep], klass[keep]
            row = group = np.empty(0, np.int64)
            if len(ids):
                row, leaf = tree.spread(_full(half), margin, most)
                key = np.unique(row * len(tree.shards) + tree.group[leaf])
                row, group = np.divmod(key, len(tree.shards))
            # a subtree in shards: a row is indexed in one and asks the others too
            shards = tree.shards[group]
            row, group = np.repeat(row, shards), np.repeat(group, shards)
            shard = np.arange(len(row)) - np.repeat(np.cumsum(shards) - shards, shards)
            kind = (shard != ids[row] % tree.shards[group]).astype(np.int32)
            m, r = len(row), len(rest_ids)
            vecs = _binary(half, np.arange(len(ids) + 1) * 128)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([tree.base[group] + shard, np.full(r, -1)]), pa.int32()),
                    pa.array(np.concatenate([kind, np.full(r, 2, np.int32)]), pa.int32()),
                    pa.array(np.concatenate([ids[row], rest_ids]), pa.int64()),
                    pa.array(np.concatenate([np.where(kind == 0, klass[row], 0), rest_class]), pa.int64()),
                    pa.nulls(m + r, pa.int32()),
                    pa.nulls(m + r, pa.binary()),
                    vecs.take(pa.array(np.concatenate([row, np.full(r, -1)]), pa.int64(), mask=np.arange(m + r) >= m)),
                ],
                names=[f.split()[0] for f in _MOVED.split(", ")],
            )

    return run


def _held(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as numbers in a row, and how many each has (null: none)."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    size = np.dtype(dtype).itemsize
    return data.view(dtype) if len(data) else np.empty(0, dtype), np.diff(edges) // size


def _picked(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers of ``rows`` out of lists that lie one after the other."""
    start = (np.cumsum(sizes) - sizes)[rows]
    own = sizes[rows]
    return flat[np.repeat(start - (np.cumsum(own) - own), own) + np.arange(own.sum())]


def _best(q: np.ndarray, n: np.ndarray, val: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each query; equal values go to the smaller id."""
    order = np.lexsort((ids[n], -val, q))
    q, n, val = q[order], n[order], val[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[keep], n[keep], val[keep]


class _Subtree:
    """The index rows of one subtree, and the comparison of queries with them."""

    def __init__(self, k: int, floor: float | None, recall: float | None = None):
        """With ``recall``, rows come without leaves and are laid out in cells here."""
        self.k, self.floor, self.recall = k, floor, recall
        self.parts: list[tuple] = []
        self.ready = False

    def add(self, *part: np.ndarray) -> None:
        """``ids, classes, leaves, vectors, visited leaves, their numbers``."""
        self.parts.append(part)

    def build(self) -> None:
        ids, klass, leaf, vecs, flat, sizes = (np.concatenate(p) for p in zip(*self.parts))
        self.parts = []
        if self.recall:
            once = np.unique(ids, return_index=True)[1]  # in the order of ids, so that cells don't depend on that of arrival
            ids, klass, vecs = ids[once], klass[once], vecs[once]
            some = np.random.default_rng(7).choice(len(ids), min(len(ids), AMONG), replace=False)
            self.cells, self.margin, self.most = cells(_full(vecs[some]), len(ids), self.floor, self.k, self.recall)
            leaf = np.concatenate([self.cells.assign(_full(vecs[s : s + SPREAD_ROWS])) for s in range(0, len(ids), SPREAD_ROWS)])
            flat, sizes = self.near(vecs)
        order = np.lexsort((ids, leaf))
        once = np.ones(len(ids), bool)  # repeated deliveries of one row are neighbours in this order
        once[1:] = (ids[order][1:] != ids[order][:-1]) | (leaf[order][1:] != leaf[order][:-1])
        order = order[once]
        self.ids, self.klass, self.leaf = ids[order], klass[order], leaf[order]
        self.half = vecs[order]
        self.flat, self.sizes = _picked(flat, sizes, order), sizes[order]
        starts = np.flatnonzero(np.diff(self.leaf, prepend=-1))
        self.range = {int(self.leaf[s]): (s, e) for s, e in zip(starts, [*starts[1:], len(self.ids)])}
        self.ready = True

    def near(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that rows ask, one row after the other, and their numbers."""
        flat, sizes = [], []
        for s in range(0, len(half), SPREAD_ROWS):
            x = _full(half[s : s + SPREAD_ROWS])
            row, cell = self.cells.spread(x, self.margin, self.most)
            flat.append(cell.astype(np.uint32))
            sizes.append(np.bincount(row, minlength=len(x)))
        return np.concatenate(flat), np.concatenate(sizes)

    def own(self) -> Iterator[tuple]:
        asks = np.flatnonzero(self.sizes)
        for s in range(0, len(asks), 32 * BLOCK):
            rows = asks[s : s + 32 * BLOCK]
            yield from self.ask(self.ids[rows], _full(self.half[rows]), _picked(self.flat, self.sizes, rows), self.sizes[rows])

    def _hits(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a block that may be among the best: ``query, place, similarity``.

        Columns stand in the order of ids, so where values are equal the left ones
        count.  Blocks with many more pairs than needed are cut row by row.
        """
        m = min(self.k + 1, near.shape[1])  # one may be the row itself
        low = self.floor - 5e-7 if self.floor is not None else np.partition(near, -m, axis=1)[:, -m:].min(1, keepdims=True) - 1e-6
        at = np.flatnonzero((near >= low).ravel())
        if len(at) <= 4 * m * len(near):
            q, n = np.divmod(at, near.shape[1])
            return q, n, np.round(near.ravel()[at].astype(np.float64), 6)
        key = (np.rint(near.astype(np.float64) * 1e6).astype(np.int64) << 14) - np.arange(near.shape[1])
        top = np.argpartition(-key, m - 1, axis=1)[:, :m].ravel()
        q = np.repeat(np.arange(len(near)), m)
        val = np.round(near[q, top].astype(np.float64), 6)
        good = val >= self.floor if self.floor is not None else np.ones(len(val), bool)
        return q[good], top[good], val[good]

    def ask(self, ids: np.ndarray, x: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        """The k best of each query among the leaves it visits.

        Pairs are merged into the best so far whenever ``HELD`` more have come, so
        a dense region costs no more memory than a sparse one.
        """
        row = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        starts = np.flatnonzero(np.diff(flat.astype(np.int64), prepend=-1)) if len(flat) else []
        held: list[tuple] = []
        count = 0
        for s, e in zip(starts, [*starts[1:], len(flat)]):
            span = self.range.get(int(flat[s]))
            if span is None:
                continue
            lo, hi = span
            for c in range(lo, hi, ACROSS):
                across = _full(self.half[c : min(hi, c + ACROSS)]).T
                for b in range(s, e, BLOCK):
                    rows = row[b : min(e, b + BLOCK)]
                    q, n, val = self._hits(x[rows] @ across)
                    q, n = rows[q], c + n
                    other = ids[q] != self.ids[n]
                    held.append((q[other], n[other], val[other]))
                    count += len(held[-1][0])
                    if count > HELD + self.k * len(ids):
                        held = [_best(*(np.concatenate(p) for p in zip(*held)), self.ids, self.k)]
                        count = len(held[0][0])
        if count:
            q, n, val = _best(*(np.concatenate(p) for p in zip(*held)), self.ids, self.k)
            yield 0, ids[q], self.ids[n], val

    def classes(self) -> Iterator[tuple]:
        """The ``k + 1`` smallest ids of every class that lost rows before the shuffle.

        Rows of batches with few copies carry no class name; they are found by
        their vector.
        """
        named = np.unique(self.klass[self.klass != 0])
        if not len(named):
            return
        name = _name(self.half)
        rows = np.flatnonzero(np.isin(name, named))
        rows = rows[np.lexsort((self.ids[rows], name[rows]))]
        first = np.flatnonzero(np.diff(name[rows], prepend=0))
        keep = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) <= self.k
        yield 1, name[rows[keep]], self.ids[rows[keep]], np.ones(int(keep.sum()))


def _search(k: int, floor: float | None, recall: float | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind, a, b, s):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["kind", "a", "b", "similarity"])

        def finish(tree: _Subtree):
            if tree.parts:
                tree.build()
                for found in (*tree.classes(),):
                    yield rows(*found)
                for found in tree.own():
                    yield rows(*found)

        now, tree = None, _Subtree(k, floor, recall)
        for batch in batches:
            g, kind = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, batch.num_rows]):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                ids = part.column(2).to_numpy()
                if kind[s] == 2:
                    yield rows(2, ids, part.column(3).to_numpy(), np.ones(e - s))
                    continue
                if g[s] != now:
                    yield from finish(tree)
                    now, tree = g[s], _Subtree(k, floor, recall)
                flat, sizes = _held(part.column(5), np.uint32)
                vecs = _held(part.column(6), np.float16)[0].reshape(-1, DIM)
                if kind[s] == 0:
                    leaf = np.zeros(e - s, np.int32) if recall else part.column(4).to_numpy()
                    tree.add(ids, part.column(3).to_numpy(), leaf, vecs, flat, sizes)
                    continue
                yield from finish(tree)
                if tree.ready:
                    if recall:
                        flat, sizes = tree.near(vecs)
                    for found in tree.ask(ids, _full(vecs), flat, sizes):
                        yield rows(*found)
        yield from finish(tree)

    return run


def _stale(vectors: DataFrame, id_col: str, vec_col: str, at_col: str) -> DataFrame | None:
    """Deliveries replaced by a later one that differs; usually there are none.

    Only ids, times and hashes move.
    """
    light = vectors.select(F.col(id_col).alias("id"), F.col(at_col).alias("at"), F.xxhash64(F.transform(F.col(vec_col), lambda x: x + F.lit(0.0).cast("float"))).alias("h"))
    many = light.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max_by("h", F.struct("at", "h")).alias("keep")).where("lo <> hi").select("id", "keep")
    many = cut(many)
    n = many.count()
    return None if not n else F.broadcast(many) if n <= FEW else many


def found_edges(vectors: DataFrame, k: int = 5, floor: float | None = None, recall: float = 0.98, every: int = 1, id_col: str = "obs_id", vec_col: str = "obs", at_col: str = "loaded_at") -> DataFrame:
    """``a, b, similarity``: up to k neighbours b of each asking row a per subtree.

    ``floor`` keeps neighbours of at least that similarity only; ``every`` takes
    as queries the rows whose id it divides, against all rows.  Each id counts
    once, by its latest delivery.  Rows with null id, and vectors that are null,
    of another length, not finite or all zero take no part; an empty table gives
    an empty result.  Equal similarities go to the smaller id.
    """
    spark: SparkSession = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.col(at_col).alias("at")).where("id is not null")
    stale = _stale(base, "id", "vec", "at")
    if stale is not None:
        h = F.xxhash64(F.transform(F.col("vec"), lambda x: x + F.lit(0.0).cast("float")))
        base = base.join(stale, "id", "left").where(F.col("keep").isNull() | (F.col("keep") == h)).drop("keep")
    good = base.where(usable(F.col("vec"))).select("id", "vec")
    rows = base.count()
    fit_rows = min(MOST_FIT_ROWS, max(FIT_ROWS, rows // 20))
    share = min(1.0, fit_rows / max(1, rows))
    sample = good.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * fit_rows).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "a bigint, b bigint, similarity double")
    sample = _unit(sample.column("vec").combine_chunks())
    sample = sample[np.lexsort(sample.T[::-1])]
    if floor is None:
        tree = fit(sample, rows)
        visits = calibrate_nearest(tree, sample, k, recall)
        tree_b = spark.sparkContext.broadcast(tree)  # bounded by MOST_FIT_ROWS / 10 centres
        send, inside = _send(tree_b, visits, k, every), None
    else:
        inside = recall**0.05  # pairs may be missed between subtrees, where a copy more is dear, and within one
        aim = min(GROUP_ROWS // 2, max(rows // 8, WHOLE_ROWS // 2))
        tree = fit(sample, rows, leaf_rows=aim, group_rows=aim)
        tree_b = spark.sparkContext.broadcast(tree)
        send = _scatter(tree_b, *calibrate_meeting(tree, sample, floor, k, recall**0.95), k)
    moved = good.mapInArrow(send, _MOVED)
    groups = int(tree.shards.sum())
    placed = moved.repartitionById(groups, F.when(F.col("g") >= 0, F.col("g")).otherwise(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))).sortWithinPartitions("g", "kind")
    found = cut(placed.mapInArrow(_search(k, floor, inside), _FOUND))
    edges = found.where("kind = 0").select("a", "b", "similarity")
    rest = found.where("kind = 2").select(F.col("a"), F.col("b").alias("class"))
    if every > 1:
        edges = edges.where(F.pmod("a", F.lit(every)) == 0)
        rest = rest.where(F.pmod("a", F.lit(every)) == 0)
    classes = found.where("kind = 1").select(F.col("a").alias("class"), "b").distinct()
    if classes.count() <= FEW:
        copies = rest.join(F.broadcast(classes), "class")
    else:  # one class may hold most rows: its rows are spread over salts
        salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        copies = rest.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(salted, ["class", "salt"])
    copies = copies.where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    return edges.unionByName(copies)


def ranked(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each ``a``, from its finds in all subtrees."""
    best = edges.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def similar_pairs(vectors: DataFrame, floor: float = 0.9, k: int = 5, recall: float = 0.98) -> DataFrame:
    """``id_a < id_b``: pairs of at least ``floor`` where one is among the other's k nearest."""
    edges = found_edges(vectors, k, floor, recall)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    top = ranked(both, k)
    return top.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def nearest(vectors: DataFrame, k: int = 5, every: int = 100, recall: float = 0.95) -> DataFrame:
    """``obs_id, place, neighbour_id, similarity`` of every queried row."""
    top = ranked(found_edges(vectors, k, None, recall, every), k)
    return top.select(F.col("a").alias("obs_id"), "place", F.col("b").alias("neighbour_id"), F.round("similarity", 3).alias("similarity"))


def recall(vectors: DataFrame, found: DataFrame, k: int = 5, every: int = 100, least: float = 0.9, rows: int = 256) -> DataFrame:
    """``asked, enough``: whether ``found`` holds at least ``least`` of the exact k nearest of the asked rows.

    The asked rows, one in ``every``, are shipped as blocks of ``rows`` vectors and
    met by every partition of all rows, which answers with its k best of each.
    """
    latest = vectors.select(F.col("obs_id").cast("bigint").alias("id"), F.col("obs").alias("vec"), F.col("loaded_at").alias("at")).where("id is not null")
    stale = _stale(latest, "id", "vec", "at")
    if stale is not None:
        h = F.xxhash64(F.transform(F.col("vec"), lambda x: x + F.lit(0.0).cast("float")))
        latest = latest.join(stale, "id", "left").where(F.col("keep").isNull() | (F.col("keep") == h))
    good = latest.where(usable(F.col("vec"))).select("id", "vec").dropDuplicates(["id"])
    asked = good.where(F.pmod("id", F.lit(every)) == 0)
    n = asked.count()
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // rows))))).groupBy("block").agg(F.collect_list(F.struct("id", "vec")).alias("asks"))
    parts = max(1, -(-good.count() // 20_000))
    held = good.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int"))
    asks = blocks.select("asks", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    names = "a bigint, b bigint, similarity double"

    def meet(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        ids, out = left["id"].to_numpy(), []
        x = np.stack(left["vec"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for asks in right["asks"]:
            own = np.array([a["id"] for a in asks])
            y = np.array([a["vec"] for a in asks], np.float64)
            y /= np.abs(y).max(1, keepdims=True)
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            near = y.astype(np.float32) @ x.astype(np.float32).T
            near[own[:, None] == ids[None, :]] = -2
            m = min(k, near.shape[1])
            top = np.argpartition(-near, m - 1, axis=1)[:, :m]
            out.append(pd.DataFrame({"a": own.repeat(m), "b": ids[top.ravel()], "similarity": np.take_along_axis(near, top, 1).ravel()}))
        return pd.concat(out)

    exact = ranked(held.groupBy("part").cogroup(asks.groupBy("part")).applyInPandas(meet, names).where("similarity >= -1"), k)
    last = exact.groupBy("a").agg(F.min("similarity").alias("last"), F.count("*").alias("due"))
    # equally similar neighbours are as good as the exact ones; similarities of halves are off by 1e-3 at most
    hits = found.join(last, found["obs_id"] == last["a"]).where(F.col("similarity") >= F.col("last") - 1e-3).groupBy("a").agg(F.count("*").alias("n"))
    share = F.sum(F.least(F.coalesce("n", F.lit(0)), F.col("due"))) / F.sum("due")
    return last.join(hits, "a", "left").agg(F.count("*").alias("asked"), F.coalesce(share >= least, F.lit(True)).alias("enough"))
