"""Byte-pair style vocabularies: iterative merges of the most frequent neighbouring pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from millrace.session import cut

#: Stands around every symbol of a word; words that hold it are left out.
MARK = "\x01"
#: The best pairs that a pass looks at.
LOOKED_AT = 64


def merge_vocabulary(words: DataFrame, word: str, n: str, merges: int, least: int = 2, checkpoint_every: int = 8) -> list[tuple[str, str]]:
    """The first ``merges`` pairs, most frequent first, ties to the smallest pair; characters and pairs are the vocabulary.

    ``words`` are distinct words with counts, one row each, so work per pass follows the vocabulary, not the text. A pass
    counts pairs in a distributed aggregation, takes the best few to the driver and merges as many of them as come next
    in any case (:func:`independent`), so there are fewer passes than merges. Every few passes the words are written to
    the shared folder, which cuts the lineage. It ends early when the best pair occurs fewer than ``least`` times, or once.
    """
    spaced = F.regexp_replace(F.col(word), "(?s)(.)", f"$1{MARK}")
    state = words.filter((F.length(word) > 0) & ~F.contains(F.col(word), F.lit(MARK))).select(F.concat(F.lit(MARK), spaced).alias("s"), F.col(n).alias("n"))
    found: list[tuple[str, str]] = []
    passes = 0
    while len(found) < merges:
        symbols = state.select(F.filter(F.split("s", MARK), lambda x: x != "").alias("s"), "n")
        size = F.greatest(F.size("s") - 1, F.lit(0))
        pairs = symbols.select(F.explode(F.arrays_zip(F.slice("s", F.lit(1), size).alias("a"), F.slice("s", F.lit(2), size).alias("b"))).alias("p"), "n")
        best = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(LOOKED_AT).collect()
        some = [r for r in independent(best, LOOKED_AT) if r.n >= max(least, 2)][: merges - len(found)]
        if not some:
            break
        for r in some:
            found.append((r.a, r.b))
            state = state.withColumn("s", merged(F.col("s"), r.a, r.b))
        passes += 1
        if passes % checkpoint_every == 0:
            state = cut(state)
    return found


def independent(best: list[Row], looked_at: int) -> list[Row]:
    """Of pairs in order those at the front that merging one by one would take too, in this order.

    Merging a pair changes the counts of pairs with one of its symbols, and makes pairs that are at most as frequent as
    those it breaks up. Pairs ahead of the first that shares a symbol with one before it hence come first in any case, if
    they are more frequent than that one; so they are if it lies beyond the ``looked_at`` pairs and they are more frequent
    than the last of these.
    """
    taken: list[Row] = []
    used: set[str] = set()
    limit = best[-1].n if len(best) == looked_at else 0
    for r in best:
        if r.a in used or r.b in used:
            limit = r.n
            break
        taken.append(r)
        used |= {r.a, r.b}
    return taken[:1] + [r for r in taken[1:] if r.n > limit]


def merged(symbols: Column, a: str, b: str) -> Column:
    """The marked symbols with each leftmost ``a, b`` made one."""
    exact = lambda s: "".join(f"\\x{{{ord(c):x}}}" for c in s)
    plain = (a + b).replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(symbols, f"(?<={MARK}){exact(a)}{MARK}{exact(b)}(?={MARK})", plain)
