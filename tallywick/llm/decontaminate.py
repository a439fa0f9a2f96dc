"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all benchmark items.

Documents and items are normalised alike: A-Z become a-z and every other ASCII character but digits and
letters becomes a blank, byte for byte, so an offset in the normalised text is one in the original. A
window is a run of consecutive words of an item; the automaton, over words rather than letters, finds all
occurrences of all windows in one pass over a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_columns, map_texts, no_null_text, staged

WINDOW = 10
#: Bytes of benchmark text in one automaton, some 220 MB in each Python worker; a larger benchmark is scanned in blocks.
MAX_BLOCK_BYTES = 1 << 20

#: Base of the digits of a word's number.
BASE = 64

_BLANK = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_BLANK).split()


Item = tuple[str | None, bytes]


def windows(items: Iterable[Item], size: int = WINDOW) -> Iterator[tuple[int, list[bytes]]]:
    """The number of the item and the words of each window, one after the other."""
    for number, (_, text) in enumerate(items):
        words = normal_words(text)
        for start in range(max(1, len(words) - size + 1) if words else 0):
            yield number, words[start : start + size]


_built: dict[str, tuple] = {}


def scanner(items: list[Item], key: str, size: int = WINDOW) -> Callable[[bytes], tuple[int, list[tuple[int, int]], list[str]]]:
    """A function from text to (words, merged runs [first, past last) of hit words, item ids that occur).

    The automaton is built once for each Python worker and benchmark (``key``); to it each word of the
    benchmark is its number in two or three digits, and any other word zeros. Items without an id hit, but
    are not named.
    """
    import ahocorasick

    if key not in _built:
        _built.clear()
        automaton = ahocorasick.Automaton()
        codes, length = numbered(sorted({w for _, text in items for w in normal_words(text)}))
        for number, window in windows(items, size):
            path = "".join(map(codes.__getitem__, window))
            n, own = automaton.get(path, (len(window), ()))
            if number not in own:
                automaton.add_word(path, (n, (*own, number)))
        automaton.make_automaton()
        _built[key] = automaton, codes, length
    automaton, codes, length = _built[key]
    get, other = codes.get, "\0" * length
    ids = [i for i, _ in items]

    def scan(text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        words = normal_words(text)
        runs: list[tuple[int, int]] = []
        hits: set[int] = set()
        if words and len(automaton):
            for at, (n, own) in automaton.iter("".join([get(w, other) for w in words])):  # in the order of their ends
                end = (at + 1) // length
                first = end - n
                while runs and runs[-1][1] >= first:
                    first = min(first, runs.pop()[0])
                runs.append((first, end))
                hits.update(own)
        return len(words), runs, sorted({ids[i] for i in hits} - {None})

    return scan


def numbered(words: list[bytes]) -> tuple[dict[bytes, str], int]:
    """Each word as its number from 1 in digits of base BASE, of which all words have the same number, and that number.

    The automaton looks a letter up among a state's next ones in turn, so the base is small; every place has
    digits of its own, so that no match begins inside a word.
    """
    length = 2
    while BASE**length <= len(words):
        length += 1
    return {w: "".join(chr(1 + p * BASE + n // BASE**p % BASE) for p in range(length)) for n, w in enumerate(words, 1)}, length


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words as byte offsets of the original text."""
    import re

    spans, at, wanted = [], 0, iter(runs)
    run = next(wanted, None)
    begin = 0
    for m in re.finditer(rb"[^ ]+", text.translate(_BLANK)):
        if run is None:
            break
        if at == run[0]:
            begin = m.start()
        at += 1
        if at == run[1]:
            spans.append((begin, m.end()))
            run = next(wanted, None)
    return spans


def pieces(text: bytes, max_bytes: int, size: int = WINDOW) -> list[bytes]:
    """Parts of an item of about ``max_bytes`` that have all its windows: each begins with the last words of the one before."""
    words, out, start = normal_words(text), [], 0
    while start < len(words):
        end, own = start, 0
        while end < len(words) and (own < max_bytes or end < start + 2 * size):
            own += len(words[end]) + 1
            end += 1
        out.append(b" ".join(words[start:end]))
        if end == len(words):
            break
        start = end - size + 1
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, max_bytes: int, size: int) -> Iterator[list[Item]]:
    """The benchmark in blocks of about ``max_bytes``, one after the other on the driver; one empty block if it has no items.

    Items of more than an eighth of a block are cut into parts first, so no block is much larger.
    """
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), no_null_text(text).cast("binary").alias("text"))
    cut = map_columns(rows, [F.col("text")], ("id",), "parts array<binary>", lambda: lambda body: (pieces(body, max(1, max_bytes // 8), size),))
    parts = staged(cut.select("id", F.explode("parts").alias("text")), "benchmark-parts")
    total = parts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // max_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n):
        block = parts.filter(part == k).collect()
        if block or n == 1:
            yield sorted(((r["id"], bytes(r["text"])) for r in block), key=lambda x: (x[0] or "", x[1]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """For each row of ``docs``: ``keep``, n_words, n_hit, items (sorted strings), spans (bytes [start, end)).

    A document word is hit if it lies inside any occurrence of a window; an item of fewer words than
    ``window``, but not none, is one window. Null and empty texts have no words and no hits; an item with
    a null id hits, but is not named; repeated items count once. Rows are judged one by one, so repeated
    rows and null ids are like others, and an empty table gives no rows; very long texts are scanned whole,
    one at a time. An empty benchmark hits nothing. Extra columns of either table are not read. A benchmark
    above ``max_block_bytes`` is scanned in blocks: each has an automaton and a pass over all documents, and
    the hits of a text, one row a block at most, are united. The driver holds one block at a time.
    """
    context = docs.sparkSession.sparkContext
    sent = [(context.broadcast(b), hashlib.sha256(repr((b, window)).encode()).hexdigest()) for b in _blocks(benchmark, item_id, item_text, max_block_bytes, window)]
    fields = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    if len(sent) == 1:
        scan = _scan_of(*sent[0], window)

        def make() -> Callable[[bytes], tuple]:
            def call(body: bytes) -> tuple:
                n_words, runs, items = scan(body)
                return n_words, _length(runs), items, _spans(body, runs)

            return call

        return map_texts(docs, text, keep, fields, make)
    digest, runs, items = fresh(docs, "digest", "runs", "items")
    rows = docs.withColumn(digest, F.sha2(no_null_text(text).cast("binary"), 256))
    hits = [_block_hits(rows, text, digest, *x, window) for x in sent]
    every = reduce(DataFrame.unionByName, hits).groupBy(digest).agg(F.flatten(F.collect_list("runs")).alias(runs), F.flatten(F.collect_list("items")).alias(items))

    def united() -> Callable[..., tuple]:
        def call(body: bytes | None, found: list[dict] | None, names: list[str] | None) -> tuple:
            own = merged([(x["first"], x["past"]) for x in found or []])
            return len(normal_words(body or b"")), _length(own), sorted(set(names or [])), _spans(body or b"", own)

        return call

    return map_columns(rows.join(every, digest, "left"), [F.col(text).cast("binary"), F.col(runs), F.col(items)], keep, fields, united)


def _scan_of(block, key: str, window: int) -> Callable[[bytes], tuple]:
    return lambda body: scanner(block.value, key, window)(body)


def _block_hits(rows: DataFrame, text: str, digest: str, block, key: str, window: int) -> DataFrame:
    """(digest, runs, items) of the distinct texts that one block hits: a pass of its own, so a worker holds one automaton at a time."""
    scan = _scan_of(block, key, window)

    def make() -> Callable[[bytes], tuple]:
        def call(body: bytes) -> tuple:
            _, runs, items = scan(body)
            return [{"first": a, "past": b} for a, b in runs], items

        return call

    found = map_texts(rows, text, (digest,), "runs array<struct<first: long, past: long>>, items array<string>", make)
    return found.filter(F.size("runs") > 0).dropDuplicates([digest])


def _length(runs: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in runs)


def _spans(body: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in byte_spans(body, runs)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold any window of ``benchmark``; all columns as they are.

    Rows are judged one by one: null and empty texts, which have no words, stay, rows without an id and
    repeated rows are judged like others, very long texts are scanned whole. An empty table gives no rows, an
    empty benchmark keeps all. Columns named like the operator's own are kept.
    """
    n_hit, n_words, items, spans = fresh(docs, "n_hit", "n_words", "items", "spans")
    if n_hit != "n_hit" or n_words != "n_words" or items != "items" or spans != "spans":
        renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        kept = drop_contaminated(renamed, benchmark, f"c{docs.columns.index(text)}", window)
        return kept.toDF(*docs.columns)
    return contamination(docs, benchmark, tuple(docs.columns), text, window=window).filter("n_hit = 0").select(docs.columns)
