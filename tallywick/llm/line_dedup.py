"""Line dedup by pairwise alignment.

Two documents overlap if they share a key: the hash of a run of lines that has MIN_WORDS words, one line or
a few short ones. Every two documents that share a rare key, one of at most RARE documents, are paired. A
key of more documents pairs each with its earliest holder and with the holder before it, so pairs grow with
the number of keys and never with the square of a group. The two documents of a pair are aligned by
patience diff, and blocks of aligned lines with enough words are deleted from the later one.

Patience drops a line that crosses another one or is repeated, so a line may stay beside the holders it was
aligned with although another earlier one aligns with it. Lines left over whose keys are not rare are
aligned again, in rounds, with the next PARTNERS holders; what is left then is aligned with all the rest. There
holders that look the same from the documents left, line by line, are one: the first of them stands for them.
So a line stays only if no earlier document aligns with it.

Blank lines are left out of the alignment. Documents of the same lines are one: the first of them is
aligned for all. Of a pair only the lines that both have are brought together, found from the shorter
document, so that a long one is never copied to its partners.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, map_columns, map_texts, staged, with_new_text

#: Words that a run of lines needs to pair two documents, and that an aligned block needs to be deleted.
MIN_WORDS = 5
#: Documents up to which all holders of a key are paired with each other.
RARE = 8
#: Further holders that a line left over is aligned with in a round, and rounds before it is aligned with all the rest.
PARTNERS = 8
ROUNDS = 2
#: Pairs with the rest that are aligned at a time, or PARTNERS for each document if that is more.
PAIRS_AT_ONCE = 1 << 20
#: Holders of a frequent key among which each is paired with the one before it.
CELL = 1024


def line_reader(min_words: int = MIN_WORDS) -> Callable[[bytes], tuple]:
    """A function from a text to hash and number of words of each line that is not blank, the keys, and a hash of all lines.

    A key is the hash of a shortest run of lines around one of them that has ``min_words`` words, with its
    first line and number of lines; lines are counted without the blank ones. A line of enough words has
    one, a shorter line up to ``min_words``.
    """
    from xxhash import xxh3_128_digest, xxh64_intdigest

    def call(text: bytes) -> tuple[list[int], list[int], list[dict], bytes]:
        split = [w for w in (line.split() for line in text.split(b"\n")) if w]
        hashes = [xxh64_intdigest(b" ".join(w), 1) - (1 << 63) for w in split]
        words = [len(w) for w in split]
        runs = {run for at in range(len(split)) for run in shortest_runs(words, at, min_words)}
        keys = [{"key": xxh64_intdigest(b"\n".join(b" ".join(w) for w in split[a:b]), 2) - (1 << 63), "at": a, "n": b - a} for a, b in sorted(runs)]
        return hashes, words, keys, xxh3_128_digest(b"\n".join(b" ".join(w) for w in split))

    return call


def shortest_runs(words: list[int], at: int, min_words: int) -> list[tuple[int, int]]:
    """Runs [a, b) around line ``at`` that have ``min_words`` words and lose them without their first or last line, unless that is ``at``."""
    found = []
    for a in range(at, -1, -1):
        own = sum(words[a : at + 1])
        b = at + 1
        while own < min_words and b < len(words):
            own += words[b]
            b += 1
        if own >= min_words and (a == at or own - words[a] < min_words):
            found.append((a, b))
        if sum(words[a : at + 1]) >= min_words:
            break
    return found


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal items of two lists, rising in both.

    Equal ends are matched; items that are unique in both lists and form the longest rising chain are
    anchors; the stretches between anchors are aligned in the same way.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = rising(unique_pairs(a, a0, a1, b, b0, b1))
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            if chain and i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
        found += chain
    return sorted(found)


def unique_pairs(a: list[int], a0: int, a1: int, b: list[int], b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of items that occur once in a[a0:a1] and once in b[b0:b1], by their place in b."""
    at: dict[int, int] = {}
    for i in range(a0, a1):
        at[a[i]] = -1 if a[i] in at else i
    where: dict[int, int] = {}
    for j in range(b0, b1):
        if at.get(b[j], -1) >= 0:
            where[b[j]] = -1 if b[j] in where else j
    return sorted(((at[x], j) for x, j in where.items() if j >= 0 and x), key=lambda p: p[1])


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs that rises in both places; ``pairs`` rise in the second."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (i, _) in enumerate(pairs):
        k = bisect_left(tops, i)
        before[n] = last[k - 1] if k else -1
        if k == len(tops):
            tops.append(i)
            last.append(n)
        else:
            tops[k], last[k] = i, n
    chain = []
    n = last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def deleted_lines(shared: list[tuple[int, list[int], list[int], int]], n_earlier: int, n_later: int, min_words: int) -> list[int]:
    """Lines of the later document in aligned blocks of at least ``min_words`` words.

    ``shared``: words of each line that both have, its places in the earlier and in the later document, and
    its hash. What stands between is one item that equals nothing, so that the alignment is that of the
    whole documents.
    """
    size = {h: n for n, _, _, h in shared}
    earlier, at_earlier = _packed([(i, h) for _, own, _, h in shared for i in own], n_earlier, -1)
    later, at_later = _packed([(j, h) for _, _, own, h in shared for j in own], n_later, -2)
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (None, None)]:
        here = (at_earlier[i], at_later[j]) if j is not None else (-9, -9)
        if here != (last[0] + 1, last[1] + 1):
            if sum(size[later[x]] for x in block) >= min_words:
                out += [at_later[x] for x in block]
            block = []
        block.append(j)
        last = here
    return out


def _packed(lines: list[tuple[int, int]], n: int, gap: int) -> tuple[list, list[int]]:
    """Items in their order with one ``(gap, place)`` for what is left out, and the place of each."""
    items: list = []
    places: list[int] = []
    due = 0
    for place, h in [*sorted(lines), (n, None)]:
        if place > due:
            items.append((gap, due))
            places.append(due)
        if h is not None:
            items.append(h)
            places.append(place)
        due = place + 1
    return items, places


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(did, hash, places): the lines to delete, counted without blank ones, for each document that has any."""
    rows, did, hash_ = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    fields = "lines array<long>, words array<int>, keys array<struct<key: long, at: int, n: int>>, whole binary"
    read = staged(map_texts(rows, "text", (did, hash_), fields, lambda: line_reader(min_words)), "line-hashes")
    # Documents of the same lines: the first stands for them, and the others lose all. What is joined is written before, here and
    # below, so that the join can split the rows of a very common key among tasks.
    with_keys = read.filter(F.size("keys") > 0)
    same = staged(with_keys.groupBy("whole").agg(F.min(F.struct(did, hash_)).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "line-copies", few=True)
    is_first = F.coalesce(F.col("first") == F.struct(did, hash_), F.lit(True)).alias("is_first")
    marked = staged(with_keys.join(same, "whole", "left").select(did, hash_, "lines", "words", "keys", is_first), "line-classes")
    copies = marked.filter(~F.col("is_first")).select(did, hash_, F.explode(F.sequence(F.lit(0), F.size("lines") - 1)).alias("place"))
    firsts = marked.filter("is_first").drop("is_first")
    held = firsts.select(F.explode("keys.key").alias("key"), did, hash_).distinct()
    often = staged(held.groupBy("key").agg(F.count("*").alias("holders"), F.min(F.struct(did, hash_)).alias("first")).filter("holders > 1"), "lines-often", few=True)
    shared = staged(held.join(often, "key"), "line-holders")
    once = firsts.join(shared.select(did, hash_).distinct(), [did, hash_], "left_semi").dropDuplicates([did, hash_])
    once = staged(once.withColumn("n", F.size("lines")), "line-sharers")
    each = once.select(did, hash_, F.posexplode(F.arrays_zip("lines", "words")).alias("place", "x"))
    lines = staged(each.groupBy(did, hash_, F.col("x.lines").alias("line")).agg(F.sort_array(F.collect_list("place")).alias("at"), F.min("x.words").alias("size")), "line-places")

    def aligned(pairs: DataFrame) -> DataFrame:
        return _aligned(pairs, once.select(did, hash_, "n"), lines, did, hash_, min_words)

    pairs = _rare_pairs(shared, did, hash_).union(_frequent_pairs(shared, did, hash_)).distinct()
    places = aligned(pairs)
    for n in range(rounds):
        places = staged(places, "line-places")
        again = staged(_further_pairs(once, shared, places, did, hash_, n * PARTNERS + 2), "line-pairs", few=True)
        places = places.union(aligned(again))
    places = staged(places, "line-places")
    rest = _rest(once, shared, lines, places, did, hash_, rounds * PARTNERS + 2)
    n_pairs = 0 if rest is None else rest.count()
    parts = -(-n_pairs // max(PAIRS_AT_ONCE, PARTNERS * once.count())) if n_pairs else 0
    for part in range(parts):
        again = rest.filter(F.pmod(F.xxhash64("e_did", "e_hash"), F.lit(parts)) == part)
        if part:
            places = staged(places, "line-places")
            again = again.join(_left_over(once, places, did, hash_), ["key", did, hash_], "left_semi")
        places = places.union(aligned(staged(again.drop("key").distinct(), "line-pairs", few=True)))
    # A set of places at a time: a document never gathers more than its own lines, however many partners it has.
    return places.union(copies).groupBy(did, hash_).agg(F.collect_set("place").alias("places"))


def _pair(earlier: Column, did: Column, hash_: Column) -> list[Column]:
    return [earlier[0].alias("e_did"), earlier[1].alias("e_hash"), did, hash_]


def _rare_pairs(shared: DataFrame, did: str, hash_: str) -> DataFrame:
    """All pairs among the holders of a rare key, which are RARE at most."""
    own = F.sort_array(F.collect_list(F.struct(F.col(did).alias("did"), F.col(hash_).alias("hash"))))
    groups = shared.filter(F.col("holders") <= RARE).groupBy("key").agg(own.alias("own"))
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", 1, i), lambda e: F.struct(e["did"].alias("e_did"), e["hash"].alias("e_hash"), x["did"].alias(did), x["hash"].alias(hash_)))))
    return groups.select(F.explode(pairs).alias("p")).select("p.*")


def _frequent_pairs(shared: DataFrame, did: str, hash_: str) -> DataFrame:
    """The holders of a frequent key with the first of all and with the one before in their cell."""
    rows = shared.filter(F.col("holders") > RARE).withColumn("own", F.struct(F.col(did).alias("did"), F.col(hash_).alias("hash")))
    first = rows.filter(F.col("own") != F.col("first")).select(F.col(f"first.{did}").alias("e_did"), F.col(f"first.{hash_}").alias("e_hash"), did, hash_)
    cells = rows.withColumn("cell", F.pmod(F.xxhash64(did), F.ceil(F.col("holders") / CELL)))
    before = F.lag("own").over(Window.partitionBy("key", "cell").orderBy(did, hash_))
    chained = cells.withColumn("before", before).filter("before is not null").select(F.col("before.did").alias("e_did"), F.col("before.hash").alias("e_hash"), did, hash_)
    return first.union(chained)


def _aligned(pairs: DataFrame, sizes: DataFrame, lines: DataFrame, did: str, hash_: str, min_words: int) -> DataFrame:
    """(did, hash, place) of the lines of the later document that are deleted, for pairs (e_did, e_hash, did, hash)."""
    both = pairs.join(sizes, [did, hash_]).join(sizes.select(F.col(did).alias("e_did"), F.col(hash_).alias("e_hash"), F.col("n").alias("e_n")), ["e_did", "e_hash"])
    from_later = F.col("n") <= F.col("e_n")
    ends = {"short": (did, hash_, "e_did", "e_hash"), "long": ("e_did", "e_hash", did, hash_)}
    met = both.select(
        "*", from_later.alias("from_later"), *[F.when(from_later, F.col(a)).otherwise(F.col(b)).alias(f"{k}_{x}") for k, v in ends.items() for x, a, b in (("did", v[0], v[2]), ("hash", v[1], v[3]))]
    )
    short = lines.select(F.col(did).alias("short_did"), F.col(hash_).alias("short_hash"), "line", F.col("at").alias("at_short"), "size")
    long = lines.select(F.col(did).alias("long_did"), F.col(hash_).alias("long_hash"), "line", F.col("at").alias("at_long"))
    found = met.join(short, ["short_did", "short_hash"]).join(long, ["long_did", "long_hash", "line"])
    later, earlier = (F.when(F.col("from_later") == x, F.col("at_short")).otherwise(F.col("at_long")) for x in (True, False))
    groups = found.groupBy("e_did", "e_hash", did, hash_, "e_n", "n").agg(F.collect_list(F.struct(F.col("size").alias("size"), earlier.alias("earlier"), later.alias("later"), "line")).alias("shared"))

    def make() -> Callable[..., tuple]:
        return lambda shared, n_earlier, n_later: (deleted_lines([tuple(x.values()) for x in shared], n_earlier, n_later, min_words),)

    gone = map_columns(groups, [F.col("shared"), F.col("e_n"), F.col("n")], (did, hash_), "places array<int>", make)
    return gone.select(did, hash_, F.explode("places").alias("place"))


def _left_over(once: DataFrame, places: DataFrame, did: str, hash_: str) -> DataFrame:
    """(did, hash, key) of the keys with lines that are not deleted."""
    gone = places.groupBy(did, hash_).agg(F.collect_set("place").alias("gone"))
    left = F.filter("keys", lambda x: F.size(F.array_except(F.sequence(x["at"], x["at"] + x["n"] - 1), F.coalesce("gone", F.array().cast("array<int>")))) > 0)
    return once.join(gone, [did, hash_], "left").select(did, hash_, F.explode(F.transform(left, lambda x: x["key"])).alias("key")).distinct()


def _further_pairs(once: DataFrame, shared: DataFrame, places: DataFrame, did: str, hash_: str, first: int) -> DataFrame:
    """Pairs of documents with lines left over and the earlier holders of their frequent keys, from number ``first`` on, PARTNERS of them."""
    over = _left_over(once, places, did, hash_)
    frequent = shared.filter(F.col("holders") >= F.greatest(F.lit(RARE + 1), F.lit(first))).select("key", did, hash_, "first")
    held = staged(over.join(frequent, ["key", did, hash_]).filter(F.col("first") != F.struct(did, hash_)).drop("first"), "lines-left", few=True)
    keys = held.select("key").distinct()
    # The rank filter is applied before the rows are dealt by key as well, so a common key's holders are not sorted in one task.
    rank = F.row_number().over(Window.partitionBy("key").orderBy(did, hash_))
    ranked = frequent.join(keys, "key", "left_semi").select("key", did, hash_).withColumn("k", rank).filter(F.col("k") < first + PARTNERS).filter(F.col("k") >= first)
    partners = ranked.select("key", F.col(did).alias("e_did"), F.col(hash_).alias("e_hash"))
    earlier = F.struct("e_did", "e_hash") < F.struct(did, hash_)
    return held.join(partners, "key").filter(earlier).select("e_did", "e_hash", did, hash_).distinct()


def _rest(once: DataFrame, shared: DataFrame, lines: DataFrame, places: DataFrame, did: str, hash_: str, first: int) -> DataFrame | None:
    """(key, e_did, e_hash, did, hash): pairs of documents with lines left over and all earlier holders of their keys, from number ``first`` on.

    A document's profile is what an alignment with one of the documents left can see of it: its lines that one
    of them and at least one more document have, in order, and where others stand between. Holders of equal
    profiles are aligned alike, so of each profile the first holder is taken, and none if it is before
    number ``first``. None if nothing is left.
    """
    frequent = shared.filter(F.col("holders") >= F.greatest(F.lit(RARE + 1), F.lit(first + 1))).select("key", did, hash_)
    held = staged(_left_over(once, places, did, hash_).join(frequent, ["key", did, hash_]), "lines-rest", few=True)
    if held.isEmpty():
        return None
    own = F.struct(F.col(did).alias("did"), F.col(hash_).alias("hash"))
    holders = frequent.join(held.select("key").distinct(), "key", "left_semi")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(did, hash_))
    edges = holders.withColumn("k", rank).filter(F.col("k") <= first).filter(F.col("k") == first).select("key", own.alias("edge"))
    held = staged(held.join(edges, "key").filter(own > F.col("edge")), "lines-rest", few=True)
    if held.isEmpty():
        return None
    left = held.select(did, hash_).distinct()
    wanted = staged(lines.join(left, [did, hash_], "left_semi").select("line").distinct(), "rest-lines", few=True)
    found = staged(lines.select(did, hash_, "line", "at").join(wanted, "line", "left_semi"), "rest-places", few=True)
    twice = staged(found.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line"), "rest-lines", few=True)
    items = F.sort_array(F.flatten(F.collect_list(F.transform("at", lambda x: F.struct(x.alias("at"), F.col("line"))))))
    seen = found.join(twice, "line").groupBy(did, hash_).agg(items.alias("items")).join(once.select(did, hash_, "n"), [did, hash_])
    # A line, and whether it follows the line before at once; at the end, whether the last one ends the document.
    steps = F.transform("items", lambda x, i: F.concat_ws(" ", x["line"], (x["at"] == F.when(i > 0, F.get("items", i - 1)["at"]).otherwise(-1) + 1).cast("string")))
    profile = F.sha2(F.concat_ws(",", steps, (F.element_at("items", -1)["at"] == F.col("n") - 1).cast("string")), 256).alias("profile")
    profiles = staged(seen.select(did, hash_, profile), "rest-profiles", few=True)
    held = held.select("key", did, hash_)
    classes = holders.join(profiles, [did, hash_]).groupBy("key", "profile").agg(F.min(own).alias("e")).join(edges, "key").filter(F.col("e") >= F.col("edge"))
    partners = staged(classes.select("key", F.col("e.did").alias("e_did"), F.col("e.hash").alias("e_hash")), "rest-partners", few=True)
    return held.join(partners, "key").filter(F.struct("e_did", "e_hash") < F.struct(did, hash_)).select("key", "e_did", "e_hash", did, hash_)


def without_lines() -> Callable[[str, list[int]], tuple[str]]:
    import re

    word = re.compile(r"[^\x20\x09-\x0D]")

    def call(text: str | None, places: list[int]) -> tuple[str | None]:
        if text is None or not places:
            return (text,)
        gone = set(places)
        left, at = [], 0
        for line in text.split("\n"):
            if word.search(line):
                if at not in gone:
                    left.append(line)
                at += 1
            else:
                left.append(line)
        return ("\n".join(left),)

    return call


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, n_removed: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the lines deleted that are aligned with an earlier document; other columns as they are.

    Documents are ordered by doc_id (a whole number), a null one last, then by a hash of the text; rows that
    repeat both are one document and are changed alike. Lines are compared by a 64-bit hash of their words,
    within pairs of documents only; blank lines stay. Null texts stay null, empty texts empty, and an empty
    table has no rows. Rows stay even if all their lines go. Texts of any length are read as a whole. With
    ``n_removed`` a column of that name counts the deleted lines. ``rounds`` says how often lines left over
    are aligned with a few more holders before they are aligned with all the rest; results do not depend on it.
    """
    return with_new_text(docs, text, staged(repeated_lines(docs, doc_id, text, min_words, rounds), "line-removals"), doc_id, without_lines, n_removed)
