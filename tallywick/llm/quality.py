"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Four signals of a text are measured in whole per cent. A rule rejects a document whose signal reaches the
cutoff of its stratum. Cutoffs come from labelled holdout documents: a cutoff is certified when the exact
binomial tail shows that it rejects more than ``risk`` of the good documents with a chance of at most
``delta`` - over all strata and rules together (Bonferroni). Within one stratum and rule the cutoffs are
tested from the mildest on, and since the error only grows along that order, no further correction is
needed. Among certified cutoffs the one with the most bad documents, less ``cost`` for each good one, is
used; ties go to the mildest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, fresh, no_null_text, staged

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RUN = 8
#: False rejections allowed among the good documents of a stratum, for all rules together, and the chance of a wrong certificate.
RISK = 0.04
DELTA = 0.05
#: Bad documents that one rejected good document must be worth. On 0.5 GB with 92,151 labelled documents beyond the base rules (85,070
#: good), cutoffs at 50 lose 1 good document and the symbols rule alone catches 6,940 of 7,081 bad ones; at 10 they lose 173
#: for at most 141 bad ones more, at 1 they lose 511.
COST = 50
#: Strata up to which their cutoffs are broadcast; above, they are joined by shuffle.
MAX_BROADCAST_STRATA = 10_000

RULES = ("symbols", "dup_lines", "repeats", "sameness")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words")


def _repeat_words(words: Column, run: int) -> Column:
    """Words inside runs of ``run`` words that occur twice or more in the text, first occurrences included.

    Runs are compared by 64-bit hash. Only texts with an equal pair are sorted.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - run + 1), lambda i: F.xxhash64(F.slice(words, i, run)))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            return F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))))

        starts = _let(order, lambda s: F.sort_array(F.transform(twins(s), lambda e: e["i"])))
        return _let(starts, lambda p: F.aggregate(
            F.transform(p, lambda at, j: F.least(F.lit(run), F.coalesce(F.get(p, j + 1) - at, F.lit(run)))), F.lit(0).cast("long"), lambda a, x: a + x
        ))

    return F.when(n < run, F.lit(0).cast("long")).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(docs: DataFrame, text: str = "text", names: dict[str, str] | None = None, run: int = RUN) -> DataFrame:
    """``docs`` with the measures of MEASURES (long; null text: no words), under ``names`` where given."""
    names = names or dict(zip(MEASURES, fresh(docs, *MEASURES), strict=True))
    body = no_null_text(text)
    words = F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_distinct(w)).alias("distinct"), _repeat_words(w, run).alias("repeat")
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    w, x = fresh(docs, "of_words", "of_lines")
    found = docs.withColumns({w: _let(words, of_words), x: _let(lines, of_lines)})
    values = {
        "n_words": F.col(w)["n"], "word_chars": F.col(w)["chars"], "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")), "n_lines": F.col(x)["n"],
        "n_dup_lines": F.col(x)["dup"], "n_distinct": F.col(w)["distinct"], "n_repeat_words": F.col(w)["repeat"],
    }
    return found.withColumns({names[k]: v.cast("long") for k, v in values.items()}).drop(w, x)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(100), F.floor(100 * part / F.greatest(whole, F.lit(1))))).otherwise(0).cast("int")


def signals(m: dict[str, Column]) -> dict[str, Column]:
    """Per cent, 0 to 100, for each rule; higher is worse."""
    return {
        "symbols": _percent(m["n_symbols"], m["n_words"]),
        "dup_lines": _percent(m["n_dup_lines"], m["n_lines"]),
        "repeats": _percent(m["n_repeat_words"], m["n_words"]),
        "sameness": _percent(m["n_words"] - m["n_distinct"], m["n_words"]),
    }


def log_tail(n: Column, k: Column, p: float) -> Column:
    """The logarithm of P(X <= k) for a binomial X of n trials with chance p, summed exactly term by term."""
    odds = math.log(p / (1 - p))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i) + odds
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    none = n.cast("double") * math.log(1 - p)
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(upto, F.struct(none.alias("term"), none.alias("total")), step, lambda acc: acc["total"])


def certified_cutoffs(holdout: DataFrame, risk: float = RISK, delta: float = DELTA, cost: int = COST) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_lost, n_caught): the cutoff in force, for rules that have one.

    ``holdout`` has a stratum, good (boolean) and a per cent for each rule. Only counts of 101 values for
    each stratum and rule are made from it.
    """
    strata = holdout.select("stratum").distinct().count()
    each = risk / len(RULES)
    level = math.log(delta / max(1, strata * len(RULES)))
    long = holdout.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("x"))
    bins = long.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.value").alias("cutoff")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    of = Window.partitionBy("stratum", "rule")
    upward = of.orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.select(
        "stratum", "rule", "cutoff", F.sum("good").over(of).alias("n_good"), F.sum("good").over(upward).alias("n_lost"), F.sum("bad").over(upward).alias("n_caught")
    )
    fit = (
        sums.filter((F.col("cutoff") > 0) & (F.col("n_lost") < each * F.col("n_good")) & (F.col("n_caught") > cost * F.col("n_lost")))
        .filter(log_tail(F.col("n_good"), F.col("n_lost"), each) <= level)
        .withColumn("best", F.row_number().over(of.orderBy(F.desc(F.col("n_caught") - cost * F.col("n_lost")), F.desc("cutoff"))))
    )
    return fit.filter("best = 1").drop("best")


def judged(rows: DataFrame, labels: DataFrame, names: dict[str, str], stratum: str = "lang", doc_id: str = "doc_id", **limits) -> DataFrame:
    """Staged rows of ``measured`` with base_failed and kept (under fresh names in that order at the end)."""
    m = {k: F.col(v) for k, v in names.items()}
    failed, kept, layer = fresh(rows, "base_failed", "kept", "stratum")
    own = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    slim = rows.select(F.col(doc_id).alias("doc_id"), own.alias("stratum"), base_failed(m["n_words"], m["n_repeat_words"]).alias("failed"), *[v.alias(k) for k, v in signals(m).items()])
    holdout = slim.filter(~F.col("failed")).join(known, "doc_id").withColumn("good", F.col("quality") > 0)
    cutoffs = staged(certified_cutoffs(holdout.select("stratum", "good", *RULES), **limits), "quality-cutoffs", few=True)
    wide = cutoffs.groupBy(F.col("stratum").alias(layer)).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{layer}_{r}") for r in RULES])
    if cutoffs.count() <= MAX_BROADCAST_STRATA * len(RULES):
        wide = F.broadcast(wide)
    over = [F.coalesce(v >= F.col(f"{layer}_{k}"), F.lit(False)) for k, v in signals(m).items()]
    any_over = over[0] | over[1] | over[2] | over[3]
    return (
        rows.withColumn(layer, own)
        .join(wide, layer, "left")
        .withColumn(failed, base_failed(m["n_words"], m["n_repeat_words"]))
        .withColumn(kept, ~F.col(failed) & ~any_over)
        .drop(layer, *[f"{layer}_{r}" for r in RULES])
    )


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **limits) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the measures, base_failed and kept.

    ``labels`` (doc_id, quality 0 or 1) is the holdout; of several labels of a document the lowest counts,
    null labels do not. A stratum without enough labelled good documents has no certified cutoff and keeps
    all that the base rules keep. Null texts have no words and fail the base rules; null strata are one
    stratum; rows with a null doc_id are judged but never labelled; repeated rows are judged alike. Empty
    tables give no rows. Extra columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum_of"), F.col(text).alias("text"))
    names = {k: k for k in MEASURES}
    rows = staged(measured(rows, "text", names).drop("text"), "quality-measures")
    return judged(rows, labels, names, "stratum_of", "doc_id", **limits).select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **limits) -> DataFrame:
    """``docs`` without the rows that fail the base rules or a certified cutoff; all columns as they are.

    Null and empty texts have no words and go; null strata are one stratum; rows without an id are judged but
    never labelled; repeated rows are judged alike. Very long texts are measured whole. Columns named like a
    measure are kept. An empty table gives no rows. Texts are written once with their measures, which cost more
    than the writing, so that they are not measured again.
    """
    names = dict(zip(MEASURES, fresh(docs, *MEASURES), strict=True))
    rows = staged(measured(docs, text, names), "quality-measures")
    found = judged(rows, labels, names, stratum, doc_id, **limits)
    return found.filter(F.col(found.columns[-1])).select(docs.columns)
