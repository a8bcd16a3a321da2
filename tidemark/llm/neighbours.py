"""The most similar vectors of every vector: a navigable small-world graph per shard, merged.

Vectors are normalised and routed to the shard of their nearest anchor. Anchors are spherical k-means
on a bounded sample (``SAMPLE`` vectors of the smallest hashes; every row is indexed) and grow in
number with the input: up to ``COARSE`` in one level, beyond that each is refined by a second set,
fitted on the sample's residuals and shared by all of them, so routing costs the sum and not the
product of the two. Each shard holds one hierarchical navigable small-world graph, stored as flat
int32 neighbour arrays, one for each level. Vectors enter in batches: a batch is searched in the graph
so far, in lockstep (all queries take a step at once), and compared with itself; links follow the
diversity rule (a candidate is linked only if it is nearer to the vector than to a neighbour already
linked). Every vector is a query in its own shard and in those whose anchors are nearly as near
(``SLACK``); the results of the shards are merged per vector, and links count in both directions.
A shard expected to exceed ``MOST_ROWS`` is split in parts, and queries visit every part. Shards are
packed into tasks of about ``TASK_ROWS`` visits, by number, so no task holds two full loads.

Of vectors that are equal bit for bit, only the k + 1 smallest ids can be among anyone's k nearest
(ties go to the smaller id), so every batch forwards no more of them: a group of copies never
gathers in one task.

Defined results: null vectors, vectors of another length, with null or NaN or infinite parts and
all-zero vectors take no part; rows of one id are one vector (the bitwise smallest); a
vector is not its own neighbour; fewer than two vectors give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM = 64
SHARD_ROWS = 2_000
MOST_ROWS = 64_000
TASK_ROWS = 24_000
SAMPLE = 20_000
COARSE = 1_000
#: A vector also queries the shards whose anchors are nearly as similar as its own shard's.
SLACK = 0.03
#: The same for ``all_nearest``, whose neighbours are mostly far ones.
WIDE_SLACK = 0.22
#: Rows of a shard for ``all_nearest``: far neighbours need larger ones.
WIDE_SHARD_ROWS = 16_000
#: Width of a graph's search for far neighbours.
EF_WIDE = 100
LINKS = 8
EF_BUILD = 16
EF_SEARCH = 16
CHUNK = 1024
#: Cells of the table of seen nodes that a search may hold.
SEEN_CELLS = 1 << 25


class Graph:
    """HNSW over unit vectors; ``levels[l]`` = (ids of the level's nodes, flat neighbour array of positions in them)."""

    def __init__(self, x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 1, min_sim: float = 2.0) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.ef = ef
        self.min_sim = min_sim
        self.met: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(x)
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 6)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top = int(height.max()) if n else 0
        # The highest level that is still small is compared outright.
        while top > 0 and (height >= top).sum() < 32:
            top -= 1
        for level in range(top, -1, -1):
            ids = np.flatnonzero(height >= level) if level else np.arange(n)
            order = rng.permutation(len(ids))
            self._build(ids, order, links * 2 if level == 0 else links)

    def _build(self, ids: np.ndarray, order: np.ndarray, width: int) -> None:
        """Links the nodes of one level, entering through the level above."""
        x = self.x[ids]
        n = len(ids)
        graph = np.full((n, width), -1, dtype=np.int32)
        inside = np.zeros(n, dtype=bool)
        done, size = 0, 256
        while done < n:
            batch = order[done:done + size]
            q = x[batch]
            found_ids, found_sims = np.empty((len(batch), 0), np.int32), np.empty((len(batch), 0), np.float32)
            if done:
                found_ids, found_sims = self._search(x, graph, q, self._entries(q, ids, inside, order[:done]), self.ef)
            k = min(self.ef, len(batch) - 1)
            if k > 0:
                own = q @ q.T
                np.fill_diagonal(own, -3)
                near = np.argpartition(-own, k - 1, axis=1)[:, :k]
                found_ids = np.concatenate([found_ids, batch[near].astype(np.int32)], axis=1)
                found_sims = np.concatenate([found_sims, np.take_along_axis(own, near, 1)], axis=1)
            if len(ids) == len(self.x):
                r, c = np.nonzero(found_sims >= self.min_sim)
                self.met.append((batch[r], found_ids[r, c]))
            if found_ids.shape[1]:
                chosen, sims = self._diverse(x, found_ids, found_sims, width // 2)
                graph[batch, :chosen.shape[1]] = chosen
                self._link_back(x, graph, batch, chosen, sims)
            inside[batch] = True
            done += len(batch)
            size = min(size * 2, 2048)
        self.levels.append((ids, x, graph))

    def _entries(self, q: np.ndarray, ids: np.ndarray, inside: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Positions in this level where a search starts: the nearest nodes found in the level above."""
        fixed = done[: 32]
        if not self.levels:
            return fixed[np.argsort(-(q @ self.x[ids[fixed]].T), axis=1)[:, :2]].astype(np.int32)
        above = self.descend(q, 2)
        at = np.searchsorted(ids, above)
        near = fixed[np.argmax(q @ self.x[ids[fixed]].T, axis=1)]
        at = np.where(inside[at], at, near[:, None])
        return at.astype(np.int32)

    def descend(self, q: np.ndarray, k: int) -> np.ndarray:
        """Ids of the k nearest nodes of the lowest finished level."""
        found = None
        for ids, x, graph in self.levels:
            if found is None:
                sims = q @ x[:256].T
                k0 = min(k, sims.shape[1])
                at = np.argpartition(-sims, k0 - 1, axis=1)[:, :k0].astype(np.int32)
            else:
                at = np.searchsorted(ids, found).astype(np.int32)
            at, _ = self._search(x, graph, q, at, 4)
            found = ids[np.maximum(at[:, :k], 0)]
        return found

    @staticmethod
    def _search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Lockstep beam search: (positions, similarities) of the ef best, best first, -1 where there are fewer."""
        b, n, width = len(q), len(x), graph.shape[1]
        out_ids = np.full((b, ef), -1, dtype=np.int32)
        out_sims = np.full((b, ef), -2.0, dtype=np.float32)
        step = max(16, min(CHUNK, SEEN_CELLS // (n + 1)))
        for lo in range(0, b, step):
            part = q[lo:lo + step]
            m = len(part)
            # Column n stands for "no neighbour" and is always seen.
            seen = np.zeros(m * (n + 1), dtype=bool)
            base = np.arange(m, dtype=np.int64) * (n + 1)
            seen[base + n] = True
            rows = np.arange(m)
            ids = np.full((m, ef), -1, dtype=np.int32)
            sims = np.full((m, ef), -2.0, dtype=np.float32)
            score = np.full((m, ef), -4.0, dtype=np.float32)  # of the nodes still to be opened
            e = entry[lo:lo + step]
            for c in range(min(e.shape[1], ef)):
                at = base + np.where(e[:, c] >= 0, e[:, c], n)
                new = np.flatnonzero(~seen[at])
                seen[at] = True
                ids[new, c] = e[new, c]
                score[new, c] = sims[new, c] = np.einsum("ij,ij->i", part[new], x[e[new, c]])
            while len(rows):
                each = np.arange(len(rows))
                first = score.argmax(axis=1)
                ok1 = score[each, first] > -3
                if np.count_nonzero(ok1) < 0.75 * len(rows):
                    out_ids[lo + rows], out_sims[lo + rows] = ids, sims
                    rows, base, part, ids, sims, score, first = (v[ok1] for v in (rows, base, part, ids, sims, score, first))
                    if not len(rows):
                        break
                    each, ok1 = np.arange(len(rows)), np.ones(len(rows), dtype=bool)
                # The two best open nodes are opened at once.
                score[each, first] = -4
                second = score.argmax(axis=1)
                ok2 = score[each, second] > -3
                score[each, second] = -4
                near = np.concatenate([np.where(ok1[:, None], graph[ids[each, first]], -1),
                                       np.where(ok2[:, None], graph[ids[each, second]], -1)], axis=1)
                # One after the other, so that a node both link to comes in once.
                fresh = []
                for half in (0, width):
                    at = (base[:, None] + np.where(near[:, half:half + width] < 0, n, near[:, half:half + width])).ravel()
                    new = np.flatnonzero(~seen[at])
                    seen[at[new]] = True
                    fresh.append(new // width * (2 * width) + half + new % width)
                fresh = np.concatenate(fresh)
                r, node = fresh // (2 * width), near.ravel()[fresh]
                got = np.einsum("ij,ij->i", part[r], x[node])
                new = np.full(near.size, -2.0, dtype=np.float32)
                new[fresh] = np.where(got > sims.min(axis=1)[r], got, -2.0)
                new = new.reshape(near.shape)
                all_s = np.concatenate([sims, new], axis=1)
                best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef] + (each * (ef + 2 * width))[:, None]
                sims = all_s.ravel()[best]
                ids = np.concatenate([ids, near], axis=1).ravel()[best]
                score = np.concatenate([score, np.where(new > -2, new, -4)], axis=1).ravel()[best]
            order = np.argsort(-out_sims[lo:lo + m], axis=1)
            out_sims[lo:lo + m] = np.take_along_axis(out_sims[lo:lo + m], order, 1)
            out_ids[lo:lo + m] = np.take_along_axis(out_ids[lo:lo + m], order, 1)
        out_ids[out_sims <= -2] = -1
        return out_ids, out_sims

    @staticmethod
    def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """At most ``width`` of each row's candidates, none nearer to a chosen one than to the row's own vector."""
        c = min(ids.shape[1], max(24, width + 8))
        order = np.argpartition(-sims, c - 1, axis=1)[:, :c] if ids.shape[1] > c else np.tile(np.arange(c), (len(ids), 1))
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(sims, order, 1), axis=1), 1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ok = (sims > -2) & (ids >= 0)
        ok[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        v = x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        chosen = np.zeros_like(ok)
        worst = np.full(ids.shape, -3.0, dtype=np.float32)  # nearest chosen one so far
        count = np.zeros(len(ids), dtype=np.int32)
        for j in range(c):
            take = ok[:, j] & (count < width) & (worst[:, j] < sims[:, j])
            chosen[:, j] = take
            count += take
            worst = np.where(take[:, None], np.maximum(worst, between[:, j]), worst)
        # Free places go to the nearest of the rest.
        rank = np.where(chosen, 0, np.where(ok, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :width]
        good = np.take_along_axis(ok, order, 1)
        return np.where(good, np.take_along_axis(ids, order, 1), -1).astype(np.int32), np.where(good, np.take_along_axis(sims, order, 1), -2.0)

    def _link_back(self, x: np.ndarray, graph: np.ndarray, batch: np.ndarray, chosen: np.ndarray, sims: np.ndarray) -> None:
        r, c = np.nonzero(chosen >= 0)
        target, source, sim = chosen[r, c].astype(np.int64), batch[r].astype(np.int32), sims[r, c]
        order = np.lexsort((-sim, target))
        target, source, sim = target[order], source[order], sim[order]
        first = np.concatenate([[True], target[1:] != target[:-1]])
        start = np.flatnonzero(first)
        place = np.arange(len(target)) - np.repeat(start, np.diff(np.append(start, len(target))))
        width = graph.shape[1]
        nodes = target[start]
        extra = np.full((len(nodes), width), -1, dtype=np.int32)
        extra_s = np.full((len(nodes), width), -2.0, dtype=np.float32)
        group = np.cumsum(first) - 1
        keep = place < width
        extra[group[keep], place[keep]] = source[keep]
        extra_s[group[keep], place[keep]] = sim[keep]
        old = graph[nodes]
        extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        extra_s[extra < 0] = -2.0
        free = (old < 0).sum(axis=1)
        more = (extra >= 0).sum(axis=1)
        roomy = free >= more
        if roomy.any():
            both = np.concatenate([old[roomy], extra[roomy]], axis=1)
            order = np.argsort(both < 0, axis=1, kind="stable")[:, :width]
            graph[nodes[roomy]] = np.take_along_axis(both, order, 1)
        full = ~roomy
        if full.any():
            t = nodes[full]
            o = old[full]
            os = np.where(o >= 0, np.einsum("ij,ikj->ik", x[t], x[np.maximum(o, 0)]), -2.0)
            graph[t], _ = self._diverse(x, np.concatenate([o, extra[full]], axis=1), np.concatenate([os, extra_s[full]], axis=1), width)

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ef nearest found for each query, best first, -1 for none."""
        ids, x, graph = self.levels[-1]
        if len(self.levels) > 1:
            upper = Graph.__new__(Graph)
            upper.levels, upper.x = self.levels[:-1], self.x
            entry = upper.descend(q, 2).astype(np.int32)
        else:
            entry = np.tile(np.arange(min(len(x), 2), dtype=np.int32), (len(q), 1))
        return self._search(x, graph, q, entry, ef)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the usable vectors of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    offsets = np.asarray(column.offsets)
    ok = np.asarray(column.is_valid()) & (np.diff(offsets) == DIM)
    values = column.values
    flat = np.asarray(values.fill_null(float("nan")) if values.null_count else values, dtype=np.float32)
    at = np.flatnonzero(ok)
    x = flat[offsets[:-1][at][:, None] + np.arange(DIM)] if n else np.empty((0, DIM), np.float32)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], (x[good] / norm[good][:, None]).astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x, dtype=np.float32)
    offsets = (np.arange(len(x) + 1, dtype=np.int32) * (4 * DIM)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def anchors_of(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(5)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c


def means_of(rows: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Plain k-means."""
    rng = np.random.default_rng(7)
    c = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(2 * rows @ c.T - (c**2).sum(axis=1), axis=1)
        n = np.bincount(near, minlength=len(c))[:, None]
        total = np.zeros_like(c)
        np.add.at(total, near, rows)
        c = np.where(n > 0, total / np.maximum(n, 1), c).astype(np.float32)
    return c


@dataclass
class Router:
    """The shards of one channel: ``coarse`` anchors, each refined by the ``fine`` ones; a shard has ``parts`` cells."""

    coarse: np.ndarray
    fine: np.ndarray
    parts: np.ndarray
    task: np.ndarray  # of each cell

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum(self.parts)])

    def near(self, x: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each vector's own shard, rows and shards of all visits)."""
        sims = x @ self.coarse.T
        r, i = np.nonzero(sims >= sims.max(axis=1, keepdims=True) - slack)
        if len(self.fine) == 1:
            return sims.argmax(axis=1), r, i
        # Squared distances to anchor + refinement; two units of similarity are one of squared distance.
        rest = x[r] - self.coarse[i]
        far = (rest**2).sum(axis=1)[:, None] - 2 * rest @ self.fine.T + (self.fine**2).sum(axis=1)
        begin = np.searchsorted(r, np.arange(len(x)))
        least = np.minimum.reduceat(far.min(axis=1), begin)
        p, j = np.nonzero(far <= least[r][:, None] + 2 * slack)
        rows, shard, d = r[p], i[p] * len(self.fine) + j, far[p, j]
        order = np.lexsort((shard, d, rows))
        own = np.empty(len(x), np.int64)
        own[rows[order][::-1]] = shard[order][::-1]  # the nearest is written last
        return own, rows, shard


def _fit(x: np.ndarray, expected: float, shard_rows: int, slack: float, coarse_most: int, every: int) -> tuple[Router, np.ndarray]:
    """The router of one channel without its tasks, and the visits expected in each cell."""
    shards = max(1, int(np.ceil(expected / shard_rows)))
    coarse = anchors_of(x, min(shards, coarse_most))
    fine = np.zeros((1, DIM), np.float32)
    if shards > len(coarse):
        rest = x - coarse[np.argmax(x @ coarse.T, axis=1)]
        fine = means_of(rest, int(np.ceil(shards / len(coarse))))
    router = Router(coarse, fine, np.ones(len(coarse) * len(fine), np.int32), np.zeros(0, np.int32))
    own, _, visited = router.near(x, slack)
    scale = expected / len(x)
    load = np.bincount(own, minlength=len(router.parts)) * scale
    # Of all vectors at home, and as guests of those that ask.
    visits = load + (np.bincount(visited, minlength=len(router.parts)) * scale - load) / every + 0.1 * shard_rows
    router.parts = np.maximum(1, np.ceil(load / MOST_ROWS)).astype(np.int32)
    router.__post_init__()
    return router, np.repeat(visits, router.parts)


def fit_router(df: DataFrame, channels: dict[str, str], key: str, shard_rows: int = SHARD_ROWS, slack: float = SLACK,
               sample: int = SAMPLE, coarse_most: int = COARSE, every: int = 1) -> dict[str, Router]:
    """channel -> router, from about ``sample`` rows of the smallest hashes."""
    rows = df.count()
    bound = int(min(1.0, sample / max(1, rows)) * (1 << 40)) + 1
    picked = df.where(F.pmod(F.xxhash64(F.lit("router"), F.col(key)), F.lit(1 << 40)) < bound) \
        .select(key, *channels.values()).limit(2 * sample).toArrow().sort_by(key)  # the same anchors in every run
    routers, loads = {}, []
    for name, column in channels.items():
        _, x = _matrix(picked[column])
        if len(x):
            routers[name], load = _fit(x, rows * len(x) / picked.num_rows, shard_rows, slack, coarse_most, every)
            loads.append(load)
    # Neighbouring cells share a task up to its load; with little data there is still a task for each core.
    total = sum(float(x.sum()) for x in loads)
    most = min(TASK_ROWS, max(shard_rows, total / df.sparkSession.sparkContext.defaultParallelism))
    task, held = 0, 0.0
    for router, load in zip(routers.values(), loads):
        router.task = np.empty(len(load), np.int32)
        for c, n in enumerate(load):
            if held and held + n > most:
                task, held = task + 1, 0.0
            router.task[c] = task
            held += n
    return routers


def _route(df: DataFrame, channels: dict[str, str], key: str, routers: dict[str, Router], slack: float, k: int, every: int = 1) -> DataFrame:
    """(task, channel, cell, home, ask, id, v): every vector in its own cell; as a query, of the ids divisible by ``every``, in further ones."""
    names = [n for n in channels if n in routers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = _ids(b, key), {n: b.column(b.schema.get_field_index(channels[n])) for n in names}
            for number, name in enumerate(names):
                router = routers[name]
                own_ids, x, ask, _ = _asking(*ids, vectors[name], k, every)
                if not len(own_ids):
                    continue
                own, r, shard = router.near(x, slack)
                n = router.parts[own]
                part = (own_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                home = router.first[own] + part
                times = router.parts[shard]
                r, cell = np.repeat(r, times), np.repeat(router.first[shard] - np.cumsum(times) + times, times) + np.arange(times.sum())
                other = (cell != home[r]) & ask[r]
                r, cell = np.concatenate([np.arange(len(own_ids)), r[other]]), np.concatenate([home, cell[other]])
                for lo in range(0, len(r), 50_000):
                    p, c = r[lo:lo + 50_000], cell[lo:lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(router.task[c]), pa.array(np.full(len(p), number, np.int8)), pa.array(c.astype(np.int32)),
                         pa.array(np.arange(lo, lo + len(p)) < len(own_ids)), pa.array(ask[p]), pa.array(own_ids[p]), _binary(x[p])],
                        names=["task", "channel", "cell", "home", "ask", "id", "v"])

    return df.select(key, *channels.values()).mapInArrow(
        run, "task int, channel byte, cell int, home boolean, ask boolean, id bigint, v binary")


def _ids(b: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
    column = b.column(b.schema.get_field_index(key))
    return np.asarray(column.fill_null(-1)).astype(np.int64), np.asarray(column.is_valid())


def _asking(ids: np.ndarray, known: np.ndarray, column: pa.Array, k: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(ids, vectors, which of them ask, [(copy, twin)]) of a batch.

    Of copies no more than the k + 1 smallest ids go on (and of an id, one row); an asking copy that is left out
    gets its answer from its twin, the smallest id, which then asks too.
    """
    at, x = _matrix(column)
    at, x = at[known[at]], x[known[at]]
    ids = ids[at]
    if not len(ids):
        return ids, x, np.zeros(0, bool), []
    keep = _smallest(ids, x, k + 1)
    ask = ids[keep] % every == 0
    lost = np.flatnonzero(~np.isin(ids, ids[keep]) & (ids % every == 0))
    twins = []
    if len(lost):
        first = {x[i].tobytes(): (ids[i], p) for p, i in sorted(enumerate(keep), key=lambda e: -ids[e[1]])}
        for i in lost:
            twin = first.get(x[i].tobytes())
            if twin:
                ask[twin[1]] = True
                twins.append((int(ids[i]), int(twin[0])))
    return ids[keep], x[keep], ask, twins


def _by_cell(routed: DataFrame, routers: dict[str, Router], work: Callable, schema: str) -> DataFrame:
    """Runs ``work(channel, ids, home, ask, vectors) -> table`` on every cell, one packed task after another."""
    names = list(routers)
    tasks = 1 + max((int(r.task[-1]) for r in routers.values()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        x = np.frombuffer(b"".join(v for c in t["v"].chunks for v in _bytes(c)), dtype=np.float32).reshape(-1, DIM)
        channel, cell = np.asarray(t["channel"]), np.asarray(t["cell"])
        ids, home, ask = np.asarray(t["id"]), np.asarray(t["home"]), np.asarray(t["ask"])
        order = np.lexsort((ids, cell, channel))
        cuts = np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(channel[order]) != 0)) + 1
        for rows in np.split(order, cuts):
            yield from work(names[channel[rows[0]]], ids[rows], home[rows], ask[rows], x[rows]).to_batches()

    return routed.repartitionById(tasks, "task").mapInArrow(run, schema)


def _bytes(column: pa.Array) -> list[memoryview]:
    """The values of a binary column of equal lengths, as one piece."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return [memoryview(data)[int(ends[0]):int(ends[-1])]]


def _smallest(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest ids of each distinct vector, one row for an id."""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).ravel()
    _, same = np.unique(keys, return_inverse=True)
    order = np.lexsort((same, ids))
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
    order = order[np.lexsort((ids[order], same[order]))]
    g = same[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return np.sort(order[rank < most])


def _cell_pairs(name: str, ids: np.ndarray, home: np.ndarray, x: np.ndarray, k: int, min_sim: float) -> pa.Table:
    """Pairs of similar vectors that one cell's graph finds."""
    keep = np.flatnonzero(home)
    keep = keep[_smallest(ids[keep], x[keep], k + 1)] if len(keep) else keep
    own, own_x = ids[keep], x[keep]
    out_a, out_b = [], []
    if len(own):
        keys = np.ascontiguousarray(own_x).view(np.dtype((np.void, DIM * 4))).ravel()
        _, first, member = np.unique(keys, return_index=True, return_inverse=True)
        order = np.argsort(member, kind="stable")
        begin = np.searchsorted(member[order], np.arange(len(first) + 1))
        size = np.diff(begin)
        g = Graph(own_x[first], min_sim=min_sim)

        def expand(left: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of a place on the left with every member of a node."""
            n = size[node]
            return np.repeat(left, n), order[np.repeat(begin[node] - np.cumsum(n) + n, n) + np.arange(n.sum())]

        a = np.concatenate([m[0] for m in g.met]) if g.met else np.empty(0, np.int64)
        b = np.concatenate([m[1] for m in g.met]) if g.met else np.empty(0, np.int64)
        # Copies among themselves, then members of one node with members of another.
        nodes = np.arange(len(first))
        a, b = np.concatenate([a, nodes[size > 1]]), np.concatenate([b, nodes[size > 1]])
        right, left_member = expand(b, a)
        p, q = expand(left_member, right)
        out_a.append(own[p])
        out_b.append(own[q])
        xs = [(own_x[p], own_x[q])]
        guests = np.flatnonzero(~home)
        if len(guests):
            found, sims = g.search(x[guests])
            r, c = np.nonzero((sims >= min_sim) & (found >= 0))
            p, q = expand(guests[r], found[r, c].astype(np.int64))
            out_a.append(ids[p])
            out_b.append(own[q])
            xs.append((x[p], own_x[q]))
        sim = np.concatenate([np.einsum("ij,ij->i", u.astype(np.float64), v.astype(np.float64)) for u, v in xs])
    else:
        sim = np.empty(0)
    a = np.concatenate(out_a) if out_a else np.empty(0, np.int64)
    b = np.concatenate(out_b) if out_b else np.empty(0, np.int64)
    ok = (a != b) & (sim >= min_sim)
    a, b, sim = np.minimum(a, b)[ok], np.maximum(a, b)[ok], sim[ok]
    return pa.table({"channel": pa.array([name] * len(a), pa.string()), "vec_a": a, "vec_b": b, "similarity": sim})


def similar_pairs(df: DataFrame, channels: dict[str, str], key: str = "vec_id", k: int = 5, min_sim: float = 0.9,
                  slack: float = SLACK, shard_rows: int = SHARD_ROWS, coarse_most: int = COARSE) -> DataFrame:
    """(channel, vec_a < vec_b, similarity): distinct pairs of at least ``min_sim`` found by the graphs.

    Complete for each vector's ``k`` nearest up to the measured recall.
    """
    routers = fit_router(df, channels, key, shard_rows, slack, coarse_most=coarse_most)
    routed = _route(df, channels, key, routers, slack, k)
    found = _by_cell(routed, routers, lambda name, ids, home, ask, x: _cell_pairs(name, ids, home, x, k, min_sim - 1e-6),
                     "channel string, vec_a bigint, vec_b bigint, similarity double")
    return found.groupBy("channel", "vec_a", "vec_b").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= min_sim - 1e-9)


def nearest(pairs: DataFrame, k: int = 5) -> DataFrame:
    """(channel, id, neighbour, similarity, rank): each vector's k most similar, ties to the smaller id."""
    both = pairs.select("channel", F.col("vec_a").alias("id"), F.col("vec_b").alias("neighbour"), "similarity").unionByName(
        pairs.select("channel", F.col("vec_b").alias("id"), F.col("vec_a").alias("neighbour"), "similarity"))
    w = Window.partitionBy("channel", "id").orderBy(F.col("similarity").desc(), "neighbour")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutual(pairs: DataFrame, k: int = 5) -> DataFrame:
    """(channel, vec_a, vec_b): pairs in which each is among the other's k most similar."""
    top = nearest(pairs, k)
    low = F.least("id", "neighbour")
    return (
        top.groupBy("channel", low.alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b"))
        .agg(F.count("*").alias("n")).where("n = 2").select("channel", "vec_a", "vec_b")
    )


def _best(index: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``index``, similarities) of the ``most`` nearest of each query, by comparing with all, in no order."""
    groups = 64
    width = -(-len(index) // groups)
    padded = np.zeros((groups * width, DIM), np.float32)
    padded[:len(index)] = index
    most = min(most, len(index))
    rows, sims = np.empty((len(q), most), np.int64), np.empty((len(q), most), np.float32)
    for lo in range(0, len(q), 256):
        s = q[lo:lo + 256] @ padded.T
        s[:, len(index):] = -9
        # The nearest lie in the columns with the highest maxima.
        top = s.reshape(len(s), groups, width).max(axis=1)
        col = np.argpartition(-top, min(most, width) - 1, axis=1)[:, :min(most, width)]
        at = (col[:, :, None] + np.arange(groups) * width).reshape(len(s), -1)
        near = np.take_along_axis(s, at, 1)
        pick = np.argpartition(-near, most - 1, axis=1)[:, :most]
        rows[lo:lo + 256], sims[lo:lo + 256] = np.take_along_axis(at, pick, 1), np.take_along_axis(near, pick, 1)
    return rows, sims


def _cell_nearest(name: str, ids: np.ndarray, home: np.ndarray, ask: np.ndarray, x: np.ndarray, k: int, ef: int | None) -> pa.Table:
    """The k most similar vectors of one cell for each of its asking vectors and guests; ``ef``: width of the graph's search, None: compare with all."""
    every = np.flatnonzero(home)
    keep = every[_smallest(ids[every], x[every], k + 1)] if len(every) else every
    out = {"channel": pa.array([], pa.string()), "id": pa.array([], pa.int64()),
           "near": pa.array([], pa.list_(pa.struct([("far", pa.float32()), ("neighbour", pa.int64())])))}
    if not len(keep):
        return pa.table(out)
    keys = np.ascontiguousarray(x[keep]).view(np.dtype((np.void, DIM * 4))).ravel()
    _, first, member = np.unique(keys, return_index=True, return_inverse=True)
    order = np.lexsort((ids[keep], member))
    begin = np.searchsorted(member[order], np.arange(len(first) + 1))
    size = np.diff(begin)
    members = np.full((len(first), int(size.max())), -1, np.int64)  # places in keep
    members[np.repeat(np.arange(len(first)), size), np.arange(len(order)) - np.repeat(begin[:-1], size)] = order
    # Repeated rows of an id ask once.
    asks = np.flatnonzero(ask)
    asks = asks[np.unique(ids[asks], return_index=True)[1]]
    if not len(asks):
        return pa.table(out)
    if ef is None:
        nodes, sims = _best(x[keep][first], x[asks], k + 1)
    else:
        nodes, sims = Graph(x[keep][first]).search(x[asks], ef)
        nodes, sims = nodes[:, :k + 1].astype(np.int64), sims[:, :k + 1]
    blocks = []
    for lo in range(0, len(asks), 20_000):
        own = ids[asks[lo:lo + 20_000]]
        found = nodes[lo:lo + 20_000]
        place = np.where(found[:, :, None] >= 0, members[found], -1).reshape(len(own), -1)
        far = -np.repeat(sims[lo:lo + 20_000], members.shape[1], axis=1).round(6)
        other = ids[keep][place]
        far[(place < 0) | (other == own[:, None])] = 9
        by = np.lexsort((other, far), axis=1)[:, :k]
        far, other = np.take_along_axis(far, by, 1), np.take_along_axis(other, by, 1)
        real = far < 9
        near = pa.StructArray.from_arrays([pa.array(far[real], pa.float32()), pa.array(other[real], pa.int64())], ["far", "neighbour"])
        ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
        blocks.append(pa.table({"channel": pa.array([name] * len(own)), "id": own, "near": pa.ListArray.from_arrays(pa.array(ends), near)}))
    return pa.concat_tables(blocks)


def _left_out(df: DataFrame, channels: dict[str, str], key: str, k: int, every: int) -> DataFrame:
    """(channel, id, twin): the asking copies that routing doesn't forward, with a forwarded one of the same vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, column in channels.items():
                twins = _asking(*_ids(b, key), b.column(b.schema.get_field_index(column)), k, every)[3]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(twins), pa.string()), pa.array([c for c, _ in twins], pa.int64()),
                                                  pa.array([t for _, t in twins], pa.int64())], names=["channel", "id", "twin"])

    return df.select(key, *channels.values()).mapInArrow(run, "channel string, id bigint, twin bigint")


def all_nearest(df: DataFrame, channels: dict[str, str], key: str = "vec_id", k: int = 5, slack: float = WIDE_SLACK,
                shard_rows: int = WIDE_SHARD_ROWS, every: int = 1, ef: int | None = None) -> DataFrame:
    """(channel, id, neighbour, similarity, rank): the ``k`` most similar, however far, of the ids divisible by ``every``; ties to the smaller id.

    All vectors are indexed. Without ``ef`` a vector is compared with all vectors of the shards it visits, so only
    unvisited shards cost recall; with it, their graphs are searched at that width.
    """
    routers = fit_router(df, channels, key, shard_rows, slack, every=every)
    routed = _route(df, channels, key, routers, slack, k, every)
    shape = "array<struct<far: float, neighbour: bigint>>"
    found = _by_cell(routed, routers, lambda name, ids, home, ask, x: _cell_nearest(name, ids, home, ask, x, k, ef),
                     f"channel string, id bigint, near {shape}")
    lost = _left_out(df, channels, key, k, every)
    more = not lost.isEmpty()
    if more:
        found = found.withColumn("copy", F.lit(None).cast("bigint")).unionByName(
            lost.select("channel", F.col("twin").alias("id"), F.lit(None).cast(shape).alias("near"), F.col("id").alias("copy")))
    lists = found.groupBy("channel", "id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"),
                                               *([F.collect_set("copy").alias("copies")] if more else []))
    if more:
        # A copy left out has more than k copies of smaller ids: its nearest are its twin's and the twin.
        whole = F.array_sort(F.concat("near", F.array(F.struct(F.lit(-1.0).cast("float").alias("far"), F.col("id").alias("neighbour")))))
        lists = lists.select("channel", "id", "near").unionByName(
            lists.select("channel", F.explode("copies").alias("id"), whole.alias("near")))
        lists = lists.where(F.col("id") % every == 0)
        lists = lists.withColumn("near", F.filter("near", lambda n: n["neighbour"] != F.col("id"))).withColumn("near", F.slice("near", 1, k)).distinct()
    return lists.select("channel", "id", F.posexplode(F.slice("near", 1, k)).alias("at", "n")).select(
        "channel", "id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.far").cast("double")).alias("similarity"), (F.col("at") + 1).alias("rank"))
