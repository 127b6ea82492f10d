"""SimHash near-duplicates: exact pairs within a Hamming radius through vantage-point shards, then components.

Distinct fingerprints are dealt to the leaves of a vantage-point tree, whose vantage points
and median distances come from a bounded sample. Each fingerprint also goes to every leaf
that triangle bounds leave open: at a node with vantage point v and radius m, fingerprints
within r of x can lie inside only if d(x, v) <= m + r and outside only if d(x, v) > m - r.

Fingerprints of unrelated texts lie about 32 bits apart wherever one stands, so with r = 4 a
level of the tree rules out a sixth of the pairs but sends two thirds of the rows both ways:
depth costs more copies than it saves comparisons. The tree therefore has a fixed depth, and
as an inner step a leaf is cut further by agreement: of radius + 1 blocks of bits, two
fingerprints within the radius agree on one at least; a long run that agrees on one is cut by
blocks of its other bits in the same way. A row is dealt a constant number of times at any
size of the input.

Links are handed on as few as connect a group, never as all its pairs, and components come
from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import join_hot, materialize, maybe_in

WORDS, RADIUS, SEED = 4, 4, 42
#: Levels of the tree, and fingerprints that its vantage points are taken from.
DEPTH, SAMPLE = 3, 20_000
#: Rows of a task's group on average.
CHUNK = 8192
#: Runs that agree on a block and are compared pair by pair; longer ones are cut further, while bits are left.
SHORT_RUN = 16
#: Runs that are compared at once, as a square.
SQUARE = 512


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; a text of fewer words is one shingle, one without words none."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(w) - words + 1) if w else 0
    flat = b" ".join(w)
    sizes = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[min(words, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())), dtype=np.uint64, count=n)


def majority(h: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits that are set in over half the hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def simhash(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint of the word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprinted(text: Column, words: int = WORDS) -> Column:
    """Fingerprints of a text column as bigint; texts without words, and null, have fingerprint 0."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return run(text)


def distances(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Inner nodes as arrays (vantage point, radius, children); negative children are leaves, numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 1):
        self.points: list[int] = []
        self.radii: list[int] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(np.unique(sample.astype(np.uint64)), depth, rng)

    def _grow(self, rows: np.ndarray, depth: int, rng) -> int:
        if depth > 0 and len(rows) >= 8:
            tried = rng.choice(rows, size=min(8, len(rows)), replace=False)
            apart = [distances(rows, v) for v in tried]
            best = int(np.argmax([d.std() for d in apart]))  # the wider spread leaves fewer near the border
            d = apart[best]
            m = int(np.median(d))
            inside = d <= m
            if 0 < inside.sum() < len(rows):
                node = len(self.points)
                self.points.append(int(tried[best]))
                self.radii.append(m)
                self.children.append([0, 0])
                self.children[node] = [self._grow(rows[inside], depth - 1, rng), self._grow(rows[~inside], depth - 1, rng)]
                return node
        self.leaves += 1
        return -self.leaves

    def visits(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it is the row's own leaf) for every leaf that may hold fingerprints within the radius."""
        x = x.astype(np.uint64)
        out = []
        todo = [(self.root, np.arange(len(x)), np.ones(len(x), dtype=bool))]
        while todo:
            node, rows, own = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, np.full(len(rows), -node - 1), own))
                continue
            d = distances(x[rows], np.uint64(self.points[node])).astype(np.int64)
            m = self.radii[node]
            near, far = d <= m + radius, d > m - radius
            todo.append((self.children[node][0], rows[near], own[near] & (d[near] <= m)))
            todo.append((self.children[node][1], rows[far], own[far] & (d[far] > m)))
        if not out:
            return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=bool),)
        return tuple(np.concatenate(c) for c in zip(*out))


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect distinct members exactly as all pairs within the radius would: a spanning forest.

    Members are sorted by distance to a vantage point of their own; one meets only those whose
    distance differs by the radius at most and that no link has reached yet.
    """
    links: list[tuple[int, int]] = []
    vantage = members[len(members) // 2]
    d = distances(members, vantage).astype(np.int64)
    order = np.argsort(d, kind="stable")
    members, d = members[order], d[order]
    ends = np.searchsorted(d, [np.arange(65) - radius, np.arange(65) + radius + 1])
    left = np.ones(len(members), dtype=bool)
    for root in range(len(members)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            k = stack.pop()
            a, b = ends[0, d[k]], ends[1, d[k]]
            near = a + np.flatnonzero(left[a:b])
            hits = near[distances(members[near], members[k]) <= radius]
            if len(hits):
                left[hits] = False
                links.extend((int(members[k]), int(members[j])) for j in hits)
                stack.extend(hits.tolist())
    return links


def blocks_of(x: np.ndarray, blocks: int, bits: tuple[int, int] = (0, 64)) -> list[np.ndarray]:
    """The fingerprints' bits [from, to) cut into blocks of nearly equal width."""
    cuts = [bits[0] + (bits[1] - bits[0]) * k // blocks for k in range(blocks + 1)]
    return [(x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _rotated(fp: np.ndarray, block: int, blocks: int) -> tuple[np.ndarray, int]:
    """Fingerprints turned so that the given block's bits come last, and the number of other bits."""
    a, b = 64 * block // blocks, 64 * (block + 1) // blocks
    turn = np.uint64(b % 64)
    return ((fp >> turn) | (fp << (np.uint64(64) - turn)) if turn else fp), 64 - (b - a)


def _run_links(fp: np.ndarray, value: np.ndarray, radius: int, narrower) -> list[np.ndarray]:
    """Links among distinct fingerprints of equal value; a long run goes to narrower(run)."""
    order = np.argsort(value, kind="stable")
    fp, value = fp[order], value[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(fp) else np.empty(0, dtype=int)
    sizes = np.diff(np.r_[first, len(fp)])
    found = []
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    for step in range(1, min(SHORT_RUN, len(fp))):
        near = np.flatnonzero(short[:-step] & (value[:-step] == value[step:]) & (distances(fp[:-step], fp[step:]) <= radius))
        if len(near):
            found.append(np.stack([fp[near], fp[near + step]], axis=1))
    for a, n in zip(first[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        found += narrower(fp[a : a + n])
    return found


def links_within(fp: np.ndarray, block: int, radius: int) -> np.ndarray:
    """Links among fingerprints that agree on a block.

    A long run is cut by blocks of its other bits; runs that agree on two blocks and are still
    long are searched from member to member.
    """
    blocks = radius + 1

    def linked(run: np.ndarray) -> list[np.ndarray]:
        if len(run) <= SQUARE:
            i, j = np.nonzero(np.triu(distances(run[:, None], run) <= radius, 1))
            if len(i) <= 2 * len(run):  # else a dense family, of which a forest is enough
                return [np.stack([run[i], run[j]], axis=1)]
        return [np.array(forest(run, radius), dtype=np.uint64).reshape(-1, 2)]

    def cut_further(run: np.ndarray) -> list[np.ndarray]:
        turned, bits = _rotated(run, block, blocks)
        return [x for value in blocks_of(turned, blocks, (0, bits)) for x in _run_links(run, value, radius, linked)]

    fp = np.unique(fp)
    found = _run_links(fp, blocks_of(fp, blocks)[block], radius, cut_further)
    return np.concatenate([np.empty((0, 2), dtype=np.uint64), *found])


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, depth: int = DEPTH, chunk: int = CHUNK) -> DataFrame:
    """low, high: links that connect the distinct fingerprints of column fp exactly as all pairs within the radius would.

    prints must be stored; it is read three times. The sample that places the vantage points
    bounds the driver's work and bears on speed alone.
    """
    blocks = radius + 1
    n = prints.count()
    sample = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64)
    tree = VantageTree(sample, depth)
    parts = max(1, min(-(-n // chunk), 1 << (64 // blocks)))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            rows, leaves, own = tree.visits(fp, radius)
            home = np.zeros(len(fp), dtype=np.int64)
            home[rows[own]] = leaves[own]
            once = leaves <= home[rows]  # of two leaves that are open to each other's rows, the lower is asked
            rows, leaves = rows[once], leaves[once]
            for block, value in enumerate(blocks_of(fp.view(np.uint64), blocks)):
                mixed = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield pd.DataFrame({"leaf": leaves, "block": block, "part": (mixed % np.uint64(parts)).astype(np.int64)[rows], "fp": fp[rows]})

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        links = links_within(batch["fp"].to_numpy().view(np.uint64), int(batch["block"].iloc[0]), radius).view(np.int64)
        return pd.DataFrame({"low": links.min(axis=1), "high": links.max(axis=1)})

    dealt = prints.select("fp").mapInPandas(cells, "leaf long, block long, part long, fp long")
    return dealt.groupBy("leaf", "block", "part").applyInPandas(compare, "low long, high long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each linked node's component, by alternating large-star and small-star steps.

    Each round stores its links, so a round that loses executors is done again from the last.
    Only sums tell the driver whether a round changed anything.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38, 0)"))).first())

    now = materialize(links.where("low <> high").select("low", "high").distinct(), "links")
    seen = mark(now)
    for _ in range(rounds):
        ends = now.select(F.col("low").alias("u"), F.col("high").alias("v")).union(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(ends, least, "u", "n").where("v > u and v <> m").select(F.col("m").alias("low"), F.col("v").alias("high"))
        large = large.union(least.where("m < u").select(F.col("m").alias("low"), F.col("u").alias("high"))).distinct()
        down = large.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, down, "high", "n").where("low <> m").select(F.col("m").alias("a"), F.col("low").alias("b"))
        small = small.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).union(down.select(F.col("m").alias("low"), "high")).where("low <> high").distinct()
        now = materialize(small, "links")
        if (found := mark(now)) == seen:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
        seen = found
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def simhash_components(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document row: doc_id, fp, root (the component's smallest fingerprint), component_id, n_component (its rows).

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are
    linked; component_id is the smallest doc_id that links reach, null if none of the
    component's rows has an id. Repeated rows each get their row. An empty table gives none.
    """
    rows = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprinted(F.col("text")).alias("fp")), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    roots = components(fingerprint_links(prints, radius)).select(F.col("node").alias("fp"), "root")
    member = materialize(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    whole = materialize(member.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("n_component"), F.count("*").alias("members")), "whole")
    of_print = materialize(join_hot(member, whole, "root", "members").select("fp", "n", "root", "component_id", "n_component"), "of_print")
    return join_hot(rows, of_print, "fp", "n").select("doc_id", "fp", "root", "component_id", "n_component")


# -- near copies by similarity, for the pipeline

#: Words of a shingle and the Jaccard similarity of near copies; bands and minima of a band that find candidates.
COPY_WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
#: Unreached members up to which a member is compared with each, without posting lists.
FEW = 16
#: Shingles of a candidate component, or of a slice of a larger one, that one task compares.
GROUP = 2_000_000


def shingle_set(text: str | None, words: int = COPY_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words none."""
    return np.unique(shingle_hashes(text, words))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key a band, of ROWS minima each: sets of similarity s agree on a key with s ** ROWS."""
    import xxhash

    if not len(shingles):
        return []
    rng = np.random.default_rng(SEED)
    odd, mask = rng.integers(0, 1 << 64, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
    odd |= np.uint64(1)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[None, at : at + 2048] ^ mask) * odd).min(axis=1))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def shingled(text: Column) -> Column:
    """struct<fp, keys, size, print>: a hash of a text's shingle set, the set's band keys, its number of shingles, and the SimHash of all of them.

    A text is hashed once for all four, and only figures of a batch are held.
    """

    @F.pandas_udf("fp long, keys array<long>, size long, print long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            fp, keys, size, prints = [], [], [], []
            for t in texts:
                h = shingle_hashes(t, COPY_WORDS)
                x = np.unique(h)
                fp.append(xxhash.xxh64_intdigest(x.tobytes(), SEED))
                keys.append(np.array(band_keys(x), dtype=np.uint64).view(np.int64))
                size.append(len(x))
                prints.append(majority(h))
            yield pd.DataFrame({"fp": np.array(fp, dtype=np.uint64).view(np.int64), "keys": keys, "size": size, "print": prints}).astype({"size": "int64", "print": "int64"})

    return run(text)


class _Postings:
    """Of each shingle the sets that have it among the rarest of their own, as arrays (size, place, set) in order; reached sets are forgotten as lists are read.

    Two sets of sizes a and b that are similar enough have o(a, b) = ceil(similar (a + b) / (1 + similar)) shingles in
    common, so with both in one order, rarest first, they share one of the first a - o + 1 and b - o + 1: only those are posted.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, similar: float):
        """flat: all sets' shingles one after another, as numbers from 0."""
        self.similar = similar
        self.starts = np.r_[0, np.cumsum(sizes)]
        often = np.bincount(flat) if len(flat) else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.lexsort((flat, often[flat], owner))
        self.rarest = flat[order]  # of each set, rarest first
        place = (np.arange(len(flat)) - self.starts[owner]).astype(np.int32)
        at = np.flatnonzero((place < self.prefix(sizes, sizes * similar)[owner]) & (often[self.rarest] > 1))  # a shingle of one set is met by none
        by = np.lexsort((place[at], sizes[owner[at]], self.rarest[at]))
        at = at[by]
        key = self.rarest[at]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        ends = np.r_[first[1:], len(key)]
        self.lists = {int(key[i]): (sizes[owner[at[i:j]]], place[at[i:j]], owner[at[i:j]]) for i, j in zip(first.tolist(), ends.tolist()) if j - i > 1}

    def prefix(self, size, other):
        """How many of the rarest shingles of a set can be the first that it shares with one of the other size."""
        return size - np.ceil(self.similar / (1 + self.similar) * (size + other) - 1e-9).astype(np.int64) + 1

    def meets(self, k: int, size: int, root: np.ndarray) -> np.ndarray:
        """Sets that no link has reached yet and that may be similar to set k."""
        found = []
        low, high = int(np.ceil(self.similar * size - 1e-9)), int(size / self.similar + 1e-9)
        for place in range(int(self.prefix(np.int64(size), np.float64(self.similar * size)))):
            x = int(self.rarest[self.starts[k] + place])
            if x not in self.lists:
                continue
            sizes, places, sets = self.lists[x]
            i, j = np.searchsorted(sizes, (low, high + 1))
            if j - i > 64:  # a long list: of each size only the places that can count
                for one in np.unique(sizes[i:j]) if sizes[i] != sizes[j - 1] else (sizes[i],):
                    most = int(self.prefix(one, np.int64(size)))
                    if place < self.prefix(np.int64(size), one) and most > 0:
                        a, b = np.searchsorted(sizes, (one, one + 1))
                        found.append(sets[a : a + np.searchsorted(places[a:b], most)])
            else:
                one = sizes[i:j]
                found.append(sets[i:j][(places[i:j] < self.prefix(one, np.int64(size))) & (place < self.prefix(np.int64(size), one))])
            if found and len(found[-1]) > 64 and (root[found[-1]] >= 0).mean() > 0.5:
                left = root[sets] < 0
                self.lists[x] = sizes[left], places[left], sets[left]
        if not found:
            return np.empty(0, dtype=np.int32)
        met = np.unique(np.concatenate(found))
        return met[root[met] < 0]


def similar_groups(sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """The first member of each set's component, where sets of at least that Jaccard similarity are linked. Exact.

    A member meets only those that no link has reached yet: each, if they are few, else those that
    share one of the shingles that a similar set must share (see _Postings). Texts that have most of their words from one template but
    are not similar enough share none of these and never meet.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, flat = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *sets]), return_inverse=True)
    flat = flat.astype(np.int32)
    postings = _Postings(flat, sizes, similar)
    spans = [flat[a:b] for a, b in zip(postings.starts[:-1].tolist(), postings.starts[1:].tolist())]
    known = np.zeros(int(flat.max()) + 1 if len(flat) else 1, dtype=bool)
    root = np.full(len(sets), -1, dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.r_[True, sizes[order][1:] != sizes[order][:-1], True]) if len(sets) else np.zeros(1, dtype=np.int64)
    of_size = {int(sizes[order[a]]): order[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())}
    open_ = np.bincount(sizes, minlength=1)  # unreached sets of each size

    def unreached(low: int, high: int) -> np.ndarray:
        out = []
        for n in np.flatnonzero(open_[low : high + 1]) + low:
            mine = of_size[int(n)]
            if len(mine) > 2 * open_[n]:
                mine = of_size[int(n)] = mine[root[mine] < 0]
            out.append(mine[root[mine] < 0])
        return np.concatenate(out)

    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        open_[sizes[first]] -= 1
        stack = [first]
        while stack:
            k = stack.pop()
            size = int(sizes[k])
            low, high = int(np.ceil(similar * size - 1e-9)), min(int(size / similar + 1e-9), len(open_) - 1)
            left = int(open_[low : high + 1].sum())
            if not left:
                continue
            near = unreached(low, high) if left <= FEW or not size else postings.meets(k, size, root)
            if not len(near):
                continue
            known[spans[k]] = True
            many = np.concatenate([spans[j] for j in near])
            lengths = sizes[near]
            common = np.add.reduceat(np.r_[known[many], False].astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]]) * (lengths > 0)
            known[spans[k]] = False
            hits = near[common >= similar * (size + lengths - common) - 1e-9]
            root[hits] = first
            np.subtract.at(open_, sizes[hits], 1)
            stack.extend(hits.tolist())
    return root


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def _links_of(batch: pd.DataFrame) -> pd.DataFrame:
    """low, high: links from the first set (by fp) of each component of a batch's sets (fp, text) to its others, which connect all that are similar."""
    batch = batch.drop_duplicates("fp").sort_values("fp")
    fps = batch["fp"].to_numpy()
    root = similar_groups([shingle_set(t) for t in batch["text"]])
    far = root != np.arange(len(root))
    return pd.DataFrame({"low": fps[root[far]], "high": fps[far]}, dtype="int64")


def _large_links(large: DataFrame, keyed: DataFrame, group: int) -> DataFrame:
    """low, high: links that connect the members of large candidate components as all similar pairs would.

    Members similar to their component's root are linked to it, by a join that deals hot roots; a
    family of near copies ends here. The rest meets all members that agree on a band with it, in
    tasks of one slice against another, each of at most about `group` shingles.
    """
    hubs = large.where("fp = root").select("root", F.col("text").alias("hub_text"), "n_root")

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_similarity(shingle_set(x), shingle_set(y)) for x, y in zip(a, b)])

    near = join_hot(large.drop("n_root"), hubs, "root", "n_root").select("fp", "root", "text", "size", (likeness("text", "hub_text") >= SIMILAR - 1e-9).alias("to_hub"))
    near = materialize(near, "to_hub")
    rest = near.where("not to_hub")
    keys = rest.select("fp").join(keyed, "fp").select("key").distinct()
    at_key = keyed.join(keys, "key").join(near, "fp")
    slices = at_key.groupBy("key").agg(F.ceil(F.sum("size") / group).alias("slices"))
    dealt = materialize(at_key.join(slices, "key").withColumn("slice", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("slices"))), "dealt")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))
    asks = dealt.where("not to_hub").select("key", F.col("slice").alias("asking"), every.alias("asked"), "fp", "text", F.lit(True).alias("asks"))
    asked = dealt.select("key", every.alias("asking"), F.col("slice").alias("asked"), "fp", "text", F.lit(False).alias("asks"))

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        return _links_of(batch) if batch["asks"].any() and not batch["asks"].all() else pd.DataFrame({"low": [], "high": []}, dtype="int64")

    found = asks.union(asked).groupBy("key", "asking", "asked").applyInPandas(compare, "low long, high long")
    return near.where("to_hub").select(F.least("fp", "root").alias("low"), F.greatest("fp", "root").alias("high")).union(found).where("low <> high")


def similar_components(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash, fp, root of every row: rows whose five-word shingle sets have a Jaccard similarity of 0.8 or more are linked.

    Candidates are the pairs that vantage-point shards find within RADIUS bits of five-word
    SimHash fingerprints and, since a similarity of 0.8 lies about ten bits away, pairs that agree
    on a band: sets of 0.8 do with a chance of 1 - (1 - 0.8 ** 5) ** 32 (0.999997) at least. Either
    only makes candidates; whole shingle sets decide. Components of candidates with at most
    `group` shingles are compared in one task, larger ones in slices. fp is a hash of the
    set; equal sets are linked. Texts without words are alike.
    """
    text_hash = F.xxhash64("text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), shingled(F.col("text")).alias("s"))
    rows = materialize(rows.select("doc_id", "text_hash", "s.*"), "shingled")
    # one text stands for all of a set
    sets = rows.groupBy("fp").agg(F.min("print").alias("print"), F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    sets = materialize(sets, "sets")
    keyed = sets.select("fp", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    bands = join_hot(keyed, materialize(hubs, "hubs"), "key", "n").where("fp <> low").select("low", F.col("fp").alias("high"))
    prints = materialize(sets.groupBy(F.col("print").alias("fp")).agg(F.min("fp").alias("low"), F.count("*").alias("n")), "prints")
    alike = join_hot(sets.select("fp", "print"), prints.withColumnRenamed("fp", "print"), "print", "n")
    at = prints.select("fp", F.col("low").alias("set"))
    close = fingerprint_links(prints.select("fp")).withColumnRenamed("low", "fp").join(at, "fp").select(F.col("set").alias("low"), F.col("high").alias("fp")).join(at, "fp").select("low", F.col("set").alias("high"))
    links = bands.union(alike.where("fp <> low").select("low", F.col("fp").alias("high"))).union(close.select(F.least("low", "high"), F.greatest("low", "high")))
    near = components(links)
    near = near.select(F.col("node").alias("fp"), "root").union(near.select("root", "root")).distinct()
    near = materialize(near.join(sets.select("fp", "text_hash", "size"), "fp"), "near")
    # only texts that may be wanted are shuffled; copies are combined before that
    wanted = documents.select("text", text_hash.alias("text_hash")).where(maybe_in(near.select("text_hash"))("text_hash"))
    texts = wanted.groupBy("text_hash").agg(F.first("text").alias("text")).join(near, "text_hash").select("fp", "root", "text", "size")
    texts = materialize(texts, "texts")
    weights = materialize(texts.groupBy("root").agg(F.sum("size").alias("weight"), F.count("*").alias("n_root")), "weights")
    small = texts.join(weights.where(F.col("weight") <= group).select("root"), "root")

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("fp")
        fp = batch["fp"].to_numpy()
        return pd.DataFrame({"fp": fp, "root": fp[similar_groups([shingle_set(t) for t in batch["text"]])]})

    found = small.groupBy("root").applyInPandas(compare, "fp long, root long")
    large = weights.where(F.col("weight") > group)
    if not large.isEmpty():
        members = join_hot(texts, large.drop("weight").withColumn("weight", F.col("n_root")), "root", "weight")
        found = found.union(components(_large_links(materialize(members, "large"), keyed, group)).select(F.col("node").alias("fp"), "root"))
    found = sets.select("fp", "n").join(found, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    return join_hot(rows.select("doc_id", "text_hash", "fp"), materialize(found, "similar"), "fp", "n")


def keep_first_similar(documents: DataFrame) -> DataFrame:
    """documents without the rows of a component of similarity 0.8 other than its first: that with the smallest doc_id, rows without an id last.

    Rows that repeat id and text of the first stay once. Rows that are alone, nearly all, are
    told by a filter and pass where they are; only the others are shuffled with their texts.
    """
    found = materialize(similar_components(documents), "components")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first"), F.count("*").alias("n"))
    firsts = materialize(first.select("root", F.col("first.doc_id").alias("_gs_keep"), F.col("first.text_hash").alias("_gs_keep_hash"), "n"), "firsts")
    row_hash = F.xxhash64("doc_id", "text_hash")
    crowded = join_hot(found, firsts.where("n > 1").select("root", "n"), "root", "n").select(row_hash.alias("row_hash"))
    rows = documents.withColumn("_gs_id", F.col("doc_id").cast("long")).withColumn("_gs_hash", F.xxhash64("text"))
    rows = rows.withColumn("_gs_maybe", maybe_in(crowded)(F.xxhash64("_gs_id", "_gs_hash")))
    same = F.col("_gs_id").eqNullSafe(F.col("_gs_keep")) & (F.col("_gs_hash") == F.col("_gs_keep_hash"))
    decided = rows.where("_gs_maybe").join(firsts.drop("root", "n"), same, "left_semi").dropDuplicates(["_gs_id", "_gs_hash"])
    return rows.where("not _gs_maybe").select(*documents.columns).unionByName(decided.select(*documents.columns))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_component")
