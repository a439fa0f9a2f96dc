"""Substring dedup by sliding sentence spans.

From each sentence, the shortest run of at least RUN sentences that has MIN_WORDS words is hashed, and the
hashes, 128 bits of two kinds, are joined over the whole corpus. All sentences inside a run that occurred before - in an earlier
document, or earlier in the same one - are removed. Runs of fewer words repeat by chance; a sentence of
very many words is a run of its own.

Passages that begin or end inside sentences are found apart from them: of every WINDOW neighbouring runs of
PASSAGE words the one with the smallest hash is taken (winnowing), so any two texts that share a passage of
PASSAGE + WINDOW - 1 words take the same runs inside it. Neighbouring taken runs overlap or touch, so such a
passage loses all but at most WINDOW - 1 words at either end.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_texts, staged, with_new_text

RUN = 3
#: Words that a run needs, and that a single sentence needs to count alone. Of the documents of sf0.1 without a passage of 51
#: words that an earlier one has, 3 % lose text at 25 words, all of it in passages of 25 words or more; at 8 words, 26 %.
MIN_WORDS = 25
LONG_WORDS = 40
#: Words of a run inside sentences, and runs of which one at least is taken; PASSAGE is not below WINDOW.
PASSAGE = 25
WINDOW = 25
#: Base of the rolling hash; odd.
BASE = 0x9E3779B97F4A7C15

#: A sentence with what ends it and the white space after; all sentences of a text make up the text.
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*")


#: A word with the white space after it.
_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def sentences(text: str) -> list[str]:
    return _SENTENCE.findall(text)


def passage_reader(size: int, window: int = WINDOW) -> Callable[[list[bytes]], list[tuple[int, int, int, bool]]]:
    """A function from words to the runs of ``size`` words taken: (hash, another hash, first word, whether the text had it before).

    Taken are the smallest hashes of any ``window`` neighbouring runs. A run that overlaps the same text's
    first place of it does not count as had before.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    base = np.uint64(BASE)

    def widest(x, pick):
        """``pick`` (smallest or largest) of every ``window`` neighbours."""
        n = 1
        while n < window:
            step = min(n, window - n)
            x = pick(x[:-step], x[step:])
            n += step
        return x

    def call(words: list[bytes]) -> list[tuple[int, int, int, bool]]:
        n = len(words) - size + 1
        if n < window:
            return []
        each = np.fromiter(map(xxh64_intdigest, words), dtype="<u8", count=len(words))
        runs = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            runs *= base
            runs += each[k : k + n]
        runs ^= runs >> np.uint64(32)
        runs *= base
        least = np.pad(widest(runs, np.minimum), window - 1)
        taken = np.flatnonzero(widest(least, np.maximum) == runs)
        first: dict[int, int] = {}
        found = []
        for h, at in zip(runs[taken].view(np.int64).tolist(), taken.tolist(), strict=True):
            found.append((h, xxh64_intdigest(b" ".join(words[at : at + size]), size) - (1 << 63), at, at - first.setdefault(h, at) >= size))
        return found

    return call


def span_reader(run: int = RUN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, passage: int | None = None) -> Callable[[str], tuple]:
    """A function from a text to its spans: two hashes, first place and number of places of each, as four lists.

    Places are sentences, or -1, -2, ... for the first words of passages; a passage that the text had before
    has 0 places.
    """
    from xxhash import xxh3_128_intdigest

    passages = passage_reader(passage) if passage else None

    def call(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
        words = [s.encode().lower().split() for s in sentences(text)]
        spans: list[int] = []
        checks: list[int] = []
        ats: list[int] = []
        ns: list[int] = []

        def add(start: int, n: int) -> None:
            check, span = divmod(xxh3_128_intdigest(b" ".join(w for x in words[start : start + n] for w in x), n), 1 << 64)
            spans.append(span - (1 << 63))
            checks.append(check - (1 << 63))
            ats.append(start)
            ns.append(n)

        total = list(accumulate(map(len, words), initial=0))
        end = 0
        for start in range(len(words)):
            if len(words[start]) >= long_words:
                add(start, 1)
            end = max(end, start + run)
            while end < len(words) and total[end] - total[start] < min_words:
                end += 1
            if end <= len(words) and total[end] - total[start] >= min_words:
                add(start, end - start)
        if passages:
            for h, check, at, again in passages(text.encode().lower().split()):
                spans.append(h)
                checks.append(check)
                ats.append(-1 - at)
                ns.append(0 if again else 1)
        return spans, checks, ats, ns

    return call


def repeated_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, passage: int | None = None) -> DataFrame:
    """(did, hash, places): the sentences and passages to remove, for each document that has any."""
    rows, did, hash_ = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")

    def make() -> Callable[[str], tuple]:
        return span_reader(run, min_words, long_words, passage)

    found = map_texts(rows, "text", (did, hash_), "spans array<long>, checks array<long>, ats array<int>, ns array<int>", make, as_bytes=False)
    one = found.select(did, hash_, F.explode(F.arrays_zip("spans", "checks", "ats", "ns")).alias("x"))
    spans = staged(one.select(F.col("x.spans").alias("span"), F.col("x.checks").alias("check"), did, hash_, F.col("x.ats").alias("at"), F.col("x.ns").alias("n")), "spans")
    own = spans.filter("n = 0").select(did, hash_, F.col("at").alias("place"))
    spans = spans.filter("n > 0")
    # Counts first: most spans occur once and need no more than their hash moved. They are written, so that the join can split the
    # rows of a very common span among tasks, which it can't where it shares its exchange with the counting.
    often = staged(spans.groupBy("span").agg(F.count("*").alias("times")).filter("times > 1").select("span"), "spans-often", few=True)
    again = staged(spans.join(often, "span", "left_semi"), "spans-repeated")
    first = staged(again.groupBy("span", "check").agg(F.min(F.struct(did, hash_, "at")).alias("first")), "spans-first", few=True)
    # In the first document itself, passages that repeat apart from the first place are in ``own`` already.
    elsewhere = (F.col(did) != F.col(f"first.{did}")) | (F.col(hash_) != F.col(f"first.{hash_}"))
    later = again.join(first, ["span", "check"]).filter(elsewhere | ((F.col("at") >= 0) & (F.col("at") != F.col("first.at"))))
    return (
        later.select(did, hash_, F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("place"))
        .union(own)
        .groupBy(did, hash_)
        .agg(F.collect_set("place").alias("places"))
    )


def without_spans(passage: int | None = None) -> Callable[[str, list[int]], tuple[str]]:
    def call(text: str | None, places: list[int]) -> tuple[str | None]:
        if text is None or not places:
            return (text,)
        gone = {i for i in places if i >= 0}
        cuts = []
        if len(gone) < len(places):
            words = [m.span() for m in _WORD.finditer(text)]
            cuts = sorted((words[-1 - i][0], words[passage - 2 - i][1]) for i in places if i < 0)
        at = 0
        for i, s in enumerate(sentences(text)):
            if i in gone:
                cuts.append((at, at + len(s)))
            at += len(s)
        left, at = [], 0
        for start, end in sorted(cuts):
            left.append(text[at:start])
            at = max(at, end)
        return ("".join([*left, text[at:]]),)

    return call


def dedup_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, n_removed: str | None = None,
    passage: int | None = None,
) -> DataFrame:
    """``docs`` without the sentences that a non-first repeated span covers; other columns as they are.

    Occurrences are ordered by doc_id (a whole number, null last), a hash of the text, and place; rows that
    repeat both id and text are one document. Sentences are compared by 128 bits of hashes of their words,
    A-Z lower-cased. Very long texts are read whole, one at a time. Null texts stay
    null, empty texts empty; an empty table has no rows; rows stay even if all their sentences go. With
    ``passage`` repeated runs of so many words go too, wherever sentences begin and end (the query has
    PASSAGE). With ``n_removed`` a column of that name counts the removed sentences and passage runs.
    """
    gone = staged(repeated_sentences(docs, doc_id, text, run, min_words, long_words, passage), "span-removals")
    return with_new_text(docs, text, gone, doc_id, lambda: without_spans(passage), n_removed)
