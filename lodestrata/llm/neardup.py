"""Near-duplicate documents: MinHash bands for candidates, sequential Bayesian verification, exact confirmation.

A document's set are the 64-bit hashes of its distinct five-word shingles. Documents with equal sets are one class, whose
number is the node of all that follows. Signatures of the classes are cut into bands; classes that share a band's values
are candidates. A candidate pair's signatures are compared in batches of 16 values: after each, the pair is dropped if
the probability, given the matches so far and a flat prior, that its similarity reaches the threshold is below ``miss``.
What is left is confirmed on the full sets. At similarity 0.85, 25 bands of 5 values miss a pair with probability 4e-7,
at 0.8 with 5e-5.

Pairs within a bucket aren't emitted. First, each member's signature is checked against that of the bucket's smallest
member, and what survives is confirmed on full sets, in slots that hold the pivot's set once and ``BLOCK_BYTES`` of
members' sets. Links are joined to components. Buckets of two, and those that lie in one component, are then settled. For
any other, the signatures of members outside its largest component are compared with all its members', tile by tile;
only members of surviving pairs have their sets fetched, and a task that confirms a tile holds the sets of two blocks,
skips pairs that are connected already and emits a spanning forest of the links it finds. Blocks are bounded by members
and by bytes. So what is shuffled grows with members and not with pairs, no bucket has to fit a task, and no link between
components is lost. Hot keys (a pivot, a label, a common set) go through ``keyed_join``.

Nothing is collected. Components come from rounds of least labels and pointer jumping, with each round's labels stored.

Null and empty texts have an empty set and are linked with nothing; so are rows with a null id, whose component is null
and which are kept. Rows that share an id are one document for links: they share the component. Very long texts are
taken apart in slices and need some 40 bytes a word. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DROPS, hashable, keyed_join, map_rows, shared_dir, slices, stored, text_bytes, to_batch, words

SHINGLE = 5
HASHES = 128
ROWS = 5
BANDS = 25
BATCH = 16
#: The most members and the most bytes of sets that a block of a tile has on average.
BLOCK = 1024
BLOCK_BYTES = 8_000_000
#: Members that a pivot's slot has on average, at most.
SLOT = 500
MISS = 1e-8
#: Links hold at 100 * common >= PERCENT * union.
PERCENT = 85
MEMO_WORDS = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = hashlib.blake2b(word, digest_size=8).digest()
        return h


_WORDS = _WordHash()
DROPS[__name__] = _WORDS.clear
_STEPS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all five-word shingles of a text, A-Z lower-cased; with fewer words, of the
    whole sequence; none without words."""
    h = np.frombuffer(b"".join([h for part in slices(text or b"") for h in [b"".join(map(_WORDS.__getitem__, words(part.lower())))]]), dtype="<u8")
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < SHINGLE:
        acc = np.array([n], dtype=np.uint64)
        for i in range(n):
            acc = acc + h[i : i + 1] * _STEPS[i]
    else:
        acc = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
        for i in range(SHINGLE):
            acc = acc + h[i : n - SHINGLE + 1 + i] * _STEPS[i]
    return np.unique(mixed(acc))


@functools.lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1000, 1000 + 2 * HASHES, dtype=np.uint64))
    return (seeds[:HASHES] | np.uint64(1))[:, None], seeds[HASHES:, None]


def signature(s: np.ndarray) -> np.ndarray:
    """The lowest value of each of ``HASHES`` hash functions over a set, cut to 16 bits (which adds 1/65536 to the chance
    that two values agree)."""
    a, b = permutations()
    low = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(s), 1024):
        part = s[None, at : at + 1024]
        low = np.minimum(low, ((part * a + b) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return (low & np.uint32(0xFFFF)).astype("<u2")


@functools.lru_cache(maxsize=8)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For each number of batches compared: the fewest matches with which a pair stays. With a flat prior, similarity
    given m matches of n is Beta(m + 1, n - m + 1), whose tail above t is the chance of at most m successes in n + 1
    trials of probability t."""
    t = percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, allowed: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of two blocks of signatures that no batch drops; ``allowed`` masks pairs."""
    counts = np.zeros(allowed.shape, dtype=np.int16)
    for k in range(BATCH):
        counts += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(allowed & (counts >= least[0]))
    got = counts[i, j]
    for step in range(1, HASHES // BATCH):
        at = slice(step * BATCH, (step + 1) * BATCH)
        got = got + (a[i, at] == b[j, at]).sum(axis=1)
        stay = got >= least[step]
        i, j, got = i[stay], j[stay], got[stay]
    return i, j


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def alike(n_a: int, n_b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n_a + n_b - common)


def _sketch(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, mark, text in rows:
        s = shingles(text)
        if len(s) and doc_id is not None:
            yield doc_id, mark, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes()
        else:
            yield doc_id, mark, len(s), None, None


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, digest of the set and signature; stored."""
    columns = [F.col("doc_id").cast("long"), F.xxhash64(text_bytes()), text_bytes()]
    return stored(map_rows(docs, columns, _sketch, "doc_id long, mark long, n_shingles long, digest binary, sig binary"))


def band_keys(sig: Column) -> Column:
    """The bucket of each band. A value takes two bytes."""
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.substring(sig, 1 + k * width, width), F.lit(k)) for k in range(BANDS)])


def _sets(rows: Iterator[tuple]) -> Iterator[tuple]:
    for node, digest, text in rows:
        s = shingles(text).tobytes()
        if hashlib.blake2b(s, digest_size=16).digest() == digest:
            yield node, s


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, at: str) -> DataFrame:
    """node and the bytes of its set, for the given nodes; stored. Texts are met by id and hash of the text, so an id that
    many rows have is no product."""
    wanted = nodes.distinct().join(classes.select("node", "digest", "first_id", "mark"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text_bytes()).alias("__mark"), text_bytes().alias("__text"))
    met = wanted.join(texts, (F.col("first_id") == F.col("__id")) & (F.col("mark") == F.col("__mark")))
    sets = map_rows(met, [F.col(c) for c in ("node", "digest", "__text")], _sets, "node long, shingles binary")
    return stored(sets.dropDuplicates(["node"]), at)


def _surviving_pairs(percent: int, miss: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, pivot, n, m, sig, sig_b) whose signatures no batch of values drops, without the signatures."""
    least = least_matches(percent, miss)
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, HASHES) for i in (4, 5))
        n, m = (batch.column(i).to_numpy() for i in (2, 3))
        stay = np.nonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))[0]
        got = np.zeros(len(stay), dtype=np.int64)
        for step in range(HASHES // BATCH):
            at = slice(step * BATCH, (step + 1) * BATCH)
            got = got + (x[stay, at] == y[stay, at]).sum(axis=1)
            ok = got >= least[step]
            stay, got = stay[ok], got[ok]
        yield batch.take(pa.array(stay)).select([0, 1, 2, 3])


def _confirm(percent: int, table: pa.Table) -> pa.Table:
    """Links of a pivot's slot: rows (pivot, slot, node, shingles), of which one is the pivot itself."""
    nodes = table.column("node").to_pylist()
    sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
    pivot = table.column("pivot")[0].as_py()
    own = sets[nodes.index(pivot)] if pivot in nodes else np.zeros(0, np.uint64)
    found = [(n, pivot) for n, s in zip(nodes, sets, strict=True) if n != pivot and alike(len(s), len(own), shared(s, own), percent)]
    return pa.Table.from_batches([to_batch(found, LINKS)] if found else [], schema=LINKS)


def pivot_links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, miss: float, at: str) -> DataFrame:
    """Links (a, b) of pairs (node, pivot); stored. Signatures are compared first; sets move for survivors only, and a
    pivot's own set once for each slot."""
    tests = functools.partial(_surviving_pairs, percent, miss)
    facts = classes.select("node", "n_shingles", "sig")
    pivots = pairs.groupBy("pivot").agg(F.count("*").alias("rows")).join(facts.withColumnsRenamed({"node": "pivot", "n_shingles": "m", "sig": "sig_b"}), "pivot")
    met = keyed_join(pairs.join(facts, "node"), stored(pivots, f"{at}/pivots"), "pivot", "rows", ["m", "sig_b"])
    near = met.select("node", "pivot", F.col("n_shingles").alias("n"), "m", "sig", "sig_b").mapInArrow(tests, "node long, pivot long, n long, m long")
    near = stored(near, f"{at}/near")
    slots = F.ceil(F.greatest(F.sum("n") * 8 / BLOCK_BYTES, F.count("*") / SLOT))
    spread = stored(near.groupBy("pivot").agg(F.count("*").alias("rows"), slots.cast("long").alias("slots")), f"{at}/slots")
    dealt = keyed_join(near.select("node", "pivot"), spread, "pivot", "rows", ["slots"])
    dealt = dealt.select("pivot", F.pmod(F.xxhash64("node", F.lit(11)), F.col("slots")).alias("slot"), "node")
    dealt = dealt.unionByName(spread.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.col("pivot").alias("node")))
    sets = sets_of(docs, classes, near.select("node").union(near.select("pivot")), f"{at}/sets")
    groups = dealt.join(sets, "node").groupBy("pivot", "slot")
    return stored(groups.applyInArrow(lambda table: _confirm(percent, table), "a long, b long"), f"{at}/links")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for all nodes of the edges (a, b); stored. A node with many edges
    and a label that many nodes have are heavy keys of their joins."""
    at = shared_dir(edges.sparkSession)
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{at}/edges")
    first = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    labels = stored(first.select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "degree"), f"{at}/labels0")
    step = 0
    while True:
        step += 1
        near = keyed_join(both, labels.select(F.col("node").alias("b"), "label", "degree"), "b", "degree", ["label"]).groupBy("a").agg(F.min("label").alias("m"))
        # the label's own label, so that paths halve
        jumps = labels.groupBy("label").agg(F.count("*").alias("rows")).join(labels.select(F.col("node").alias("label"), F.col("label").alias("__jump")), "label")
        told = keyed_join(labels, jumps, "label", "rows", ["__jump"]).join(near, F.col("node") == F.col("a"))
        table = stored(told.select("node", "degree", "label", F.least("label", "m", "__jump").alias("new")), f"{at}/labels{step}")
        labels = table.select("node", F.col("new").alias("label"), "degree")
        if not table.filter("new <> label").limit(1).count():
            return labels.select("node", "label")


class Forest:
    """Union-find over labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


TILE = "bucket long, band int, node long, label long, minor boolean, alone boolean, sig binary, i long, j long, left boolean"


def tile_pairs(percent: int, miss: float, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a tile that lie in different components and that no batch of values drops: members on
    the left against those on the right. A pair that shares an earlier band is left to that band's bucket."""
    left_rows = table.column("left").to_numpy(zero_copy_only=False)
    minor = table.column("minor").to_numpy(zero_copy_only=False)
    nodes, labels = table.column("node").to_numpy(), table.column("label").to_numpy()
    right = np.nonzero(~left_rows)[0]
    left = np.nonzero(minor)[0] if table.column("alone")[0].as_py() else np.nonzero(left_rows)[0]
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(-1, HASHES)
    # two members outside the largest component meet twice; once is enough
    allowed = (labels[left, None] != labels[None, right]) & (~minor[None, right] | (nodes[left, None] < nodes[None, right]))
    i, j = surviving(sigs[left], sigs[right], allowed, least_matches(percent, miss))
    i, j = left[i], right[j]
    band = table.column("band")[0].as_py()
    if len(i) and band:
        cut = slice(0, band * ROWS)
        fresh = ~(sigs[i, cut] == sigs[j, cut]).reshape(len(i), band, ROWS).all(axis=2).any(axis=1)
        i, j = i[fresh], j[fresh]
    return i, j


def _near_members(percent: int, miss: float, table: pa.Table) -> pa.Table:
    """The members of a tile that have a surviving pair in it."""
    i, j = tile_pairs(percent, miss, table)
    return table.take(pa.array(np.union1d(i, j)))


def _tile(percent: int, miss: float, table: pa.Table) -> pa.Table:
    """Links between components that a tile confirms, as a spanning forest of what it connects."""
    nodes, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
    sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
    found: list[tuple[int, int]] = []
    forest = Forest()
    for x, y in zip(*[k.tolist() for k in tile_pairs(percent, miss, table)], strict=True):
        if forest.root(labels[x]) == forest.root(labels[y]):
            continue
        s, t = sets[x], sets[y]
        if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and alike(len(s), len(t), shared(s, t), percent):
            forest.join(labels[x], labels[y])
            found.append((nodes[x], nodes[y]))
    return pa.Table.from_batches([to_batch(found, LINKS)] if found else [], schema=LINKS)


def unsettled(members: DataFrame, labels: DataFrame, classes: DataFrame, at: str) -> DataFrame:
    """The members of buckets that hold several components, dealt into tiles, with signatures."""
    met = members.filter("n > 2").join(labels, "node", "left").select("bucket", "band", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    by_label = met.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("w"))
    buckets = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("k").alias("n"), F.sum("w").alias("w"), F.max(F.struct("k", "label", "w")).alias("top"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w * 8 / BLOCK_BYTES)).cast("long")
    lefts, rights = blocks(F.col("n") - F.col("top.k"), F.col("w") - F.col("top.w")), blocks(F.col("n"), F.col("w"))
    buckets = stored(buckets.filter("labels > 1").select("bucket", "n", F.col("top.label").alias("top"), lefts.alias("lefts"), rights.alias("rights")), f"{at}/unsettled")
    rows = keyed_join(met, buckets, "bucket", "n", ["n", "top", "lefts", "rights"]).filter(F.col("n").isNotNull())
    rows = rows.withColumn("minor", F.col("label") != F.col("top")).withColumn("alone", (F.col("lefts") == 1) & (F.col("rights") == 1))
    spot = F.xxhash64("node", F.lit(7))
    zero = F.lit(0).cast("long")
    as_right = F.transform(F.sequence(zero, F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), F.pmod(spot, F.col("rights")).alias("j"), F.lit(False).alias("left")))
    as_left = F.transform(F.sequence(zero, F.col("rights") - 1), lambda j: F.struct(F.pmod(spot, F.col("lefts")).alias("i"), j.alias("j"), F.lit(True).alias("left")))
    places = F.when(F.col("minor") & ~F.col("alone"), F.concat(as_right, as_left)).otherwise(as_right)
    dealt = rows.join(classes.select("node", "sig"), "node").select("bucket", "band", "node", "label", "minor", "alone", "sig", F.explode(places).alias("p"))
    return dealt.select("bucket", "band", "node", "label", "minor", "alone", "sig", "p.i", "p.j", "p.left")


def repeated_ids(drawn: DataFrame, classes: DataFrame, at: str) -> DataFrame | None:
    """Links (a, b) between the classes of rows that share an id; None if no id has two sets."""
    known = drawn.filter(F.col("digest").isNotNull()).select("doc_id", "digest")
    several = known.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("last"), F.count("*").alias("rows")).filter("digest <> last")
    several = stored(several.join(classes.select("digest", F.col("node").alias("b")), "digest").select("doc_id", "rows", "b"), f"{at}/several")
    if not several.limit(1).count():
        return None
    own = keyed_join(known, several, "doc_id", "rows", ["b"]).filter(F.col("b").isNotNull()).select("digest", "b").distinct()
    return own.join(classes.select("digest", F.col("node").alias("a")), "digest").filter("a <> b").select("a", "b")


def cluster(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) and kept (whether it is the document's own)."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    drawn = sketches(docs)
    first = F.min(F.struct("doc_id", "mark"))
    classes = drawn.filter(F.col("digest").isNotNull()).groupBy("digest").agg(first.alias("f"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # numbers are given as the rows are stored, so they stay what they are
    classes = stored(classes.select("digest", F.monotonically_increasing_id().alias("node"), F.col("f.doc_id").alias("first_id"), F.col("f.mark").alias("mark"), "copies", "n_shingles", "sig"), f"{at}/classes")

    bands = classes.select("node", "n_shingles", F.posexplode(band_keys(F.col("sig"))).alias("band", "bucket"))
    several = bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    members = keyed_join(bands, stored(several, f"{at}/shared"), "bucket", "n", ["pivot", "n"]).filter(F.col("n").isNotNull())
    members = stored(members, f"{at}/members")

    pairs = stored(members.filter("node <> pivot").select("node", "pivot").distinct(), f"{at}/pairs")
    links = pivot_links(pairs, docs, classes, percent, miss, at)
    if (same := repeated_ids(drawn, classes, at)) is not None:
        links = links.union(same)
    labels = components(links)

    tiles = unsettled(members, labels, classes, at).groupBy("bucket", "i", "j")
    near = stored(tiles.applyInArrow(lambda tile: _near_members(percent, miss, tile), TILE), f"{at}/tiles")
    if near.limit(1).count():
        sets = sets_of(docs, classes, near.select("node"), f"{at}/tile_sets")
        tiles = near.join(sets, "node").groupBy("bucket", "i", "j")
        more = stored(tiles.applyInArrow(lambda tile: _tile(percent, miss, tile), "a long, b long"), f"{at}/more")
        if more.limit(1).count():
            labels = components(links.union(more))

    linked = classes.join(labels, "node")
    least = stored(linked.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("rows")), f"{at}/least")
    ends = keyed_join(classes.join(labels, "node", "left").select("digest", "copies", "first_id", "label"), least, "label", "rows", ["component_id"])
    ends = stored(ends.select("digest", "copies", F.coalesce("component_id", "first_id").alias("component_id")), f"{at}/ends")
    out = keyed_join(drawn.select("doc_id", "n_shingles", "digest"), ends, "digest", "copies", ["component_id"])
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """The documents that stay, one of each component, with their own columns. Of rows that share an id the one with the
    least hash of text, then of all columns, stays; rows with a null id all stay."""
    kept = cluster(docs, percent, miss).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long"))
    own = keyed.join(kept, F.col("__id") == F.col("__kept"), "left_semi")
    order = Window.partitionBy("__id").orderBy(F.xxhash64(text_bytes()), F.xxhash64(*hashable(docs)))
    own = own.withColumn("__place", F.row_number().over(order)).filter("__place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return own.unionByName(docs.filter(F.col("doc_id").isNull()))
