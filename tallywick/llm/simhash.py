"""SimHash near-duplicate groups, found with BK-trees over shards of fingerprints.

Two fingerprints that differ in at most ``RADIUS`` bits agree on at least one of ``RADIUS + 1`` blocks of
bits. Distinct fingerprints are therefore sharded by (block, value of the block), one BK-tree is built for
each shard, and a fingerprint is looked up only in the shards that it shares a block with. A shard above
``max_tree`` fingerprints is sharded again on the bits that are left, by the same argument, and what is
still too large after the last level is cut into chunks, a tree for each pair of chunks; so a tree never
holds more than ``max_tree`` fingerprints, and no link is lost.

The trees travel to their queries with a shuffle rather than with a driver broadcast: a broadcast of every
tree would bring all fingerprints to the driver and every fingerprint to every tree, which grows with the
square of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts, staged
from .components import connected

RADIUS = 3
SHINGLE = 3
SEED = 42
MAX_TREE = 2048
LEVELS = 3
#: Near duplicates of the filtering stage: words of a shingle, similarity of the sets of shingles, and the bits within which
#: candidates are looked for: two texts of this similarity differ in 10 of 64 bits on average.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
NEAR_RADIUS = 18
#: Smallest hashes by which a text is put into shards, at each level: two texts of the similarity share one with 99.8 %.
KEYS = 4
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprinter(shingle: int = SHINGLE, seed: int = SEED) -> Callable[[bytes], tuple[int]]:
    """A function from UTF-8 text to its 64-bit SimHash, as a signed integer."""
    import numpy as np

    def call(text: bytes) -> tuple[int]:
        n, hashes = shingle_hashes(text, shingle, seed)
        return (majority((np.fromiter(hashes, dtype="<u8", count=min(BLOCK, n - start)) for start in range(0, n, BLOCK)), n),)

    return call


def shingle_hashes(text: bytes, shingle: int, seed: int) -> tuple[int, Iterator[int]]:
    """The number of shingles of a text, repeats included, and their hashes; of fewer words than one, that of all."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: lower-cases A-Z only and splits at \x20, \x09-\x0D only
    if len(words) < shingle:
        n, grams = min(1, len(words)), iter([b" ".join(words)])
    else:
        n, grams = len(words) - shingle + 1, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return n, map(xxh64_intdigest, grams, repeat(seed))


def majority(blocks: Iterable, n: int) -> int:
    """The bits set in over half of ``n`` hashes, given in blocks, as a signed integer; zero for none."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


class BKTree:
    """Fingerprints in a tree: a child hangs under its integer Hamming distance to the parent."""

    __slots__ = ("children", "values")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert ``value`` and return its place; a value that is there already keeps its place."""
        at, values, children = 0, self.values, self.children
        if values:
            while True:
                d = (values[at] ^ value).bit_count()
                if not d:
                    return at
                child = children[at].get(d)
                if child is None:
                    children[at][d] = len(values)
                    break
                at = child
        values.append(value)
        children.append({})
        return len(values) - 1

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all values at most ``radius`` bits away; only edges within the radius are followed."""
        found: list[int] = []
        todo = [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            todo += [child for edge, child in children[at].items() if low <= edge <= high]
        return found


def shard_links(values: list[int], radius: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``values``: (value, smallest value that it is joined to).

    With ``split``, the tree holds values[:split] and the others are looked up in it, besides each in turn.
    """
    mask = (1 << 64) - 1
    tree = BKTree()
    parent: list[int] = []
    own: dict[int, int] = {}
    signed: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        if value in own:
            continue
        bits = value & mask
        hits = tree.within(bits, radius)
        at = tree.add(bits)
        own[value] = at
        signed.append(value)
        parent.append(at)
        for hit in hits:
            a, b = root(hit), root(at)
            if a != b:
                if signed[a] > signed[b]:
                    a, b = b, a
                parent[b] = a
    return [(signed[i], signed[r]) for i in range(len(parent)) if (r := root(i)) != i]


def block_masks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask``, cut into ``parts`` runs of nearly equal size; each with ``mask`` itself."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, parents: Column, masks: list[list[int]]) -> DataFrame:
    """A row (fp, m, v) for each child mask of the mask numbered ``parents`` in the level above."""
    table = F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in masks])
    children = F.get(table, parents)
    return fps.select("fp", F.posexplode(children).alias("i", "mask"), parents.alias("p")).select(
        "fp", (F.col("p") * len(masks[0]) + F.col("i")).cast("int").alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("v")
    )


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE, levels: int = LEVELS) -> DataFrame:
    """Links (a, b), a > b, that span the groups of fingerprints at most ``radius`` bits apart.

    ``fps`` has distinct signed 64-bit integers in column fp.
    """
    parts = radius + 1
    masks = [[block_masks(0, parts)]]
    for _ in range(levels - 1):
        masks.append([block_masks(m, parts) for row in masks[-1] for m in row])
    keyed = _keyed(fps, F.lit(0), masks[0])
    links = []
    for level in range(levels):
        sizes = staged(keyed.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-shards", few=True)
        small, hot = sizes.filter(F.col("n") <= max_tree).drop("n"), sizes.filter(F.col("n") > max_tree)
        groups = keyed.join(small, ["m", "v"]).groupBy("m", "v").agg(F.collect_list("fp").alias("values"))
        links.append(_links(groups, radius))
        if hot.isEmpty():
            break
        if level + 1 < levels:
            rows = keyed.join(hot.drop("n"), ["m", "v"])
            keyed = _keyed(rows, F.col("m"), masks[level + 1])
        else:
            links.append(_links(_chunk_pairs(keyed.join(hot, ["m", "v"]), max_tree), radius))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _chunk_pairs(rows: DataFrame, max_tree: int) -> DataFrame:
    """Shards that no level could split: all pairs of chunks of about half a tree each."""
    chunks = F.ceil(F.col("n") * 4 / max_tree).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    return (
        rows.select("m", "v", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .groupBy("m", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .agg(F.collect_list("fp").alias("values"))
    )


def _links(groups: DataFrame, radius: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for values in batch.column(0).to_pylist():
                found.update(shard_links(values, radius))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return groups.select("values").mapInArrow(run, "a long, b long")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the SimHash of every whole text (null: no words, fingerprint zero)."""
    return map_texts(docs, text, keep, f"{name} long", fingerprinter)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    doc_id that can be reached, the document itself included.

    Null and empty texts have no words and fingerprint zero, and are linked like any other. A null doc_id
    keeps its row and never names a component (null if the component has no other id). Repeated rows stay.
    Empty tables give no rows; extra columns are not read.
    """
    rows = staged(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "simhash-fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = staged(fingerprint_links(fps.select("fp"), radius, max_tree), "simhash-links", few=True)
    member = connected(links)
    # Fingerprints with links only: the others are their own component.
    firsts = member.join(fps, member["node"] == fps["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    linked = member.join(firsts, "root").select(F.col("node").alias("fp"), "least")
    # Written, so that the join can split the rows of a very common fingerprint among tasks.
    whole = staged(fps.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-components")
    return rows.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_reader(shingle: int, seed: int = SEED) -> Callable[[bytes], tuple]:
    """A function from UTF-8 text to its SimHash, KEYS * LEVELS smallest hashes (none without a word) and a hash of its words."""
    import numpy as np
    from xxhash import xxh3_128_digest

    shingles = shingle_reader(shingle, seed)
    factors = np.random.default_rng(seed).integers(1, 1 << 63, KEYS * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def call(text: bytes) -> tuple[int, list[int], bytes]:
        fingerprint, own = shingles(text)
        least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(own), BLOCK):
            mixed = own[start : start + BLOCK, None] * factors
            least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(29))) * factors).min(axis=0))
        return fingerprint, least.view(np.int64) if len(own) else [], xxh3_128_digest(b" ".join(text.lower().split()))

    return call


def shingle_reader(shingle: int, seed: int = SEED) -> Callable[[bytes], tuple]:
    """A function from UTF-8 text to its SimHash and the sorted distinct hashes of its shingles."""
    import numpy as np

    def call(text: bytes) -> tuple:
        n, hashes = shingle_hashes(text, shingle, seed)
        h = np.fromiter(hashes, dtype="<u8", count=n)
        return majority((h[start : start + BLOCK] for start in range(0, n, BLOCK)), n), np.unique(h)

    return call


def candidate_groups(rows: DataFrame, radius: int, max_tree: int = MAX_TREE) -> DataFrame:
    """(grp, node): groups of two nodes or more that may hold links.

    ``rows``: node, fp, least. Nodes that share one of their smallest hashes are a shard, with a BK-tree of
    its own; a group is what is linked in the tree, at most ``radius`` bits apart. A shard above ``max_tree``
    is sharded again by other smallest hashes, and what is still too large is cut into chunks, a tree for each
    pair of chunks.
    """
    keyed = rows.withColumn("shard", F.lit(0).cast("long"))
    found = []
    for level in range(LEVELS):
        own = F.posexplode(F.slice("least", 1 + level * KEYS, KEYS)).alias("k", "v")
        keyed = keyed.select("node", "fp", "least", "shard", own).withColumn("shard", F.xxhash64("shard", "k", "v")).drop("k", "v")
        sizes = staged(keyed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), "near-shards", few=True)
        hot = sizes.filter(F.col("n") > max_tree)
        shards = keyed.join(sizes.filter(F.col("n") <= max_tree).drop("n"), "shard").groupBy("shard").agg(F.collect_list(F.struct("fp", "node")).alias("items"))
        found.append(_groups(shards, radius))
        if hot.isEmpty():
            break
        rest = keyed.join(hot, "shard")
        if level + 1 == LEVELS:
            chunks = F.ceil(F.col("n") * 4 / max_tree).cast("int")
            pairs = rest.select("shard", "fp", "node", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
            chunked = pairs.groupBy(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard")).agg(F.collect_list(F.struct("fp", "node")).alias("items"))
            found.append(_groups(chunked, radius))
        keyed = rest.drop("n")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _groups(shards: DataFrame, radius: int) -> DataFrame:
    schema = pa.schema([("grp", pa.int64()), ("node", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            grp, nodes = [], []
            for shard, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of: dict[int, list[bytes]] = {}
                for x in items:
                    of.setdefault(x["fp"], []).append(x["node"])
                root = dict(shard_links(list(of), radius))
                groups: dict[int, list[bytes]] = {}
                for fp, own in of.items():
                    groups.setdefault(root.get(fp, fp), []).extend(own)
                for fp, own in groups.items():
                    if len(own) > 1:
                        grp += [xxh64_intdigest(f"{shard} {fp}") - (1 << 63)] * len(own)
                        nodes += own
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(nodes, pa.binary())], schema=schema)

    return shards.select("shard", "items").mapInArrow(run, "grp long, node binary")


def similar_links(members: DataFrame, radius: int, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that span the groups of texts whose shingles are similar: exact Jaccard similarity within each candidate group.

    ``members``: grp, node, text. A group, MAX_TREE texts at most, is held as its shingles.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingle_reader(shingle)
        group, items = None, {}
        for batch in batches:
            links = []
            for grp, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != group:
                    links += spanning_links(items, radius, similarity)
                    group, items = grp, {}
                items[node] = shingles(text)
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links], schema)
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in spanning_links(items, radius, similarity)], schema)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return members.select("grp", "node", text.alias("text")).repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a binary, b binary")


def spanning_links(items: dict[bytes, tuple[int, object]], radius: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links between texts (node -> fingerprint, shingles) at most ``radius`` bits apart that are similar, as a spanning forest."""
    import numpy as np

    nodes = list(items)
    fps = np.array([items[n][0] for n in nodes], np.int64).view(np.uint64)
    parent = list(range(len(nodes)))
    links = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(1, len(nodes)):
        own = items[nodes[i]][1]
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius).tolist():
            a, b = root(i), root(j)
            if a != b and similar(own, items[nodes[j]][1], similarity):
                parent[a] = b
                links.append((nodes[i], nodes[j]))
    return links


def similar(a, b, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; two empty ones are equal."""
    import numpy as np

    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (small + large - common)


def keep_representatives(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS, max_tree: int = MAX_TREE
) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Two texts are linked if their sets of ``shingle``-word shingles (A-Z lower-cased) have at least this
    Jaccard ``similarity``; candidates come from BK-trees of fingerprints at most ``radius`` bits apart, and
    are then checked exactly. Texts of equal words are one. A row with a null doc_id stays only where its
    group has no other; rows of one doc_id but different texts count as documents of their own, the smaller
    text hash first, and of equal rows one stays. Documents without a word, null and empty texts among them,
    are one group. Very long texts are read whole, one at a time. An empty table gives no rows. All columns
    are kept as they are, whatever their names; ids are whole numbers or strings.
    """
    none, id_, hash_ = fresh(docs, "none", "id", "hash")
    zero = F.lit("").cast(docs.schema[doc_id].dataType) if docs.schema[doc_id].dataType.typeName() == "string" else F.lit(0).cast(docs.schema[doc_id].dataType)
    rows = docs.withColumns({none: F.col(doc_id).isNull(), id_: F.coalesce(F.col(doc_id), zero), hash_: F.xxhash64(text)})
    keys = [none, id_, hash_]
    read = map_texts(rows, text, keys, "fp long, least array<long>, node binary", lambda: near_reader(shingle))
    first = F.min(F.struct(*keys)).alias("first")
    classes = staged(staged(read, "near-features").groupBy("node").agg(first, F.min("fp").alias("fp"), F.min("least").alias("least")), "near-classes")
    groups = staged(candidate_groups(classes.select("node", "fp", "least"), radius, max_tree), "near-groups", few=True)
    wanted = groups.select("node").distinct().join(classes.select("node", "first.*"), "node")
    texts = rows.select(*keys, F.col(text).alias("text")).join(wanted, keys).dropDuplicates(["node"]).select("node", "text")
    links = staged(similar_links(groups.join(texts, "node"), radius, shingle, similarity), "near-links", few=True)
    member = connected(links).select("node", "root")
    chosen = classes.join(member, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.*")
    return rows.join(chosen, keys, "left_semi").dropDuplicates(keys).select(docs.columns)
