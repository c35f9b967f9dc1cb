"""Mixing sources to target weights by iterative proportional fitting (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.clean import plain
from millrace.llm.subjects import PARSED, Model, Parsed, Reader, classify_parsed, parse_units
from millrace.llm.tokens import VOCABULARY
from millrace.session import cut

#: Rows that one window of the sampling step holds at most, about.
WINDOW_ROWS = 50_000
#: A language with less than this share of the tokens is summed up with others under ``other``, so that cells stay few.
LANGUAGE_PART = 0.001


def spread(mass: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """``min(f * mass, caps)`` with the one factor f for which it adds up to ``total``, or ``caps`` if it can't."""
    if total >= caps.sum():
        return caps.copy()
    out = np.zeros_like(mass)
    if total <= 0 or mass.sum() <= 0:
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        full = np.where(mass > 0, caps / mass, np.inf)  # the factor at which a cell is at its cap
    order = np.argsort(full, kind="stable")
    left, open_mass = total, mass.sum()
    for i in order:
        f = left / open_mass if open_mass > 0 else 0.0
        if f <= full[i]:
            break
        out[i] = caps[i]
        left -= caps[i]
        open_mass -= mass[i]
    capped = out > 0
    f = left / open_mass if open_mass > 0 else 0.0
    return np.where(capped, out, np.minimum(mass * f, caps))


def rake(cells: list[tuple[tuple[str, ...], float]], caps: list[float], targets: list[dict[str, float]], rounds: int = 200, eps: float = 1e-9) -> np.ndarray:
    """Iterative proportional fitting of cell masses to marginal totals, under caps.

    ``cells`` are ``(values, mass)``, ``targets`` one dict of totals per dimension. Dimensions are fitted in turn, the
    first one last, so its totals are met exactly where caps allow; the others as nearly as caps and each other allow.
    """
    x = np.array([m for _, m in cells], float)
    cap = np.array(caps, float)
    groups = [[(np.array([i for i, (v, _) in enumerate(cells) if v[d] == name], int), total) for name, total in sorted(t.items())] for d, t in enumerate(targets)]
    for _ in range(rounds):
        before = x.copy()
        for own in [*groups[1:], groups[0]]:
            for idx, total in own:
                if len(idx):
                    x[idx] = spread(x[idx], cap[idx], total)
        if np.abs(x - before).max(initial=0) <= eps * max(x.sum(), 1):
            break
    return x


def plain_source(c) -> F.Column:
    """A source's name in plain form, words joined by ``_``."""
    return F.regexp_replace(plain(c), r"[\s\-_]+", "_")


def parsed_for_mixing(documents: DataFrame, doc_id: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents parsed and measured in one pass over their whole texts, with plain source and language."""
    lang = F.coalesce(F.nullif(F.regexp_extract(plain("lang"), r"^\p{L}+", 0), F.lit("")), F.lit("other"))
    given = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), plain_source("source").alias("source"), lang.alias("lang"), "text")
    return parse_units(given, {"source": "string", "lang": "string"}, vocabulary)


def measured(documents: DataFrame, model: Model, doc_id: str = "doc_id", vocabulary: str = VOCABULARY, parsed: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, tokens`` of each non-blank text, read whole and once.

    ``lang`` is the first part of the language tag in plain form (``en`` of ``EN-us``), or ``other`` where there is none;
    ``topic`` is the subject most units are about, or ``none``. Documents without an id are left out. ``parsed`` is a
    result of :func:`parsed_for_mixing`.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the classifier's fitting sample
    units = parsed_for_mixing(documents, doc_id, vocabulary) if parsed is None else parsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        names = [*reader.model.subjects, "none"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                docs, subjects, ns = classify_parsed(reader, Parsed(b))
                order = np.lexsort((subjects, -ns, docs))  # of a text the subject of most units, then the first by name
                docs, first = np.unique(docs[order], return_index=True)
                topic = np.full(b.num_rows, len(names) - 1)
                topic[docs] = subjects[order][first]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([names[t] for t in topic], pa.string()), b.column("size")], names=["doc_id", "source", "lang", "topic", "tokens"])

    there = units.filter("words IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "source", "lang", "size", *PARSED)
    return there.mapInArrow(run, "doc_id bigint, source string, lang string, topic string, tokens int").filter("tokens > 0")


def mix(documents: DataFrame, targets: DataFrame, fill: float = 1.0) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, copies``: a selection with repeats in which each source has its share.

    ``documents`` is a result of :func:`measured`, ``targets`` has ``source, target_share, max_repeats``. The selection
    is as large as the scarcest source allows, times ``fill``. Token weights of all (source, language, topic) cells are
    raked to the sources' shares and, as far as repeats allow, to the languages' and topics' shares in the documents.
    A cell's weight is the expected number of copies of its documents: the whole part is given to each, the rest by
    systematic sampling along falling size, so a sample has nearly the expected tokens as well as documents. Last,
    each source gives or takes single copies, each time the one that brings its total closest to its target, until none
    brings it closer. Languages with less than LANGUAGE_PART of the tokens count as ``other`` in cells and result.

    Defined cases: documents of sources without a target aren't selected; targets with a null source, share or
    repeats, or none above zero, are skipped; targets of sources without documents are left out and the other shares
    scaled up; equal sizes are ordered by a hash of the id; empty inputs give no rows.
    """
    spark = documents.sparkSession
    wanted = {r.s: (float(r.target_share), int(r.max_repeats)) for r in targets.select(plain_source("source").alias("s"), "target_share", "max_repeats").collect() if r.s and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    docs = documents.filter(F.col("source").isin(*wanted)) if wanted else documents.limit(0)
    tokens = F.sum(F.col("tokens").cast("bigint"))
    every = docs.agg(tokens).first()[0] or 0
    main = sorted(r.lang for r in docs.groupBy("lang").agg(tokens.alias("t")).filter(F.col("t") >= LANGUAGE_PART * every).filter("lang IS NOT NULL").collect())  # at most 1 / LANGUAGE_PART
    docs = docs.withColumn("lang", F.when(F.col("lang").isin(*main), F.col("lang")).otherwise("other")) if main else docs.withColumn("lang", F.lit("other"))
    # at most targets x 1 / LANGUAGE_PART x (subjects + 1) rows
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum(F.col("tokens").cast("bigint")).alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("source", "lang", "topic").collect()
    empty = docs.limit(0).withColumn("copies", F.lit(0))
    if not cells:
        return empty
    have: dict[str, float] = {}
    for c in cells:
        have[c.source] = have.get(c.source, 0) + c.tokens
    scale = sum(wanted[s][0] for s in have)
    total = fill * min(wanted[s][1] * have[s] / (wanted[s][0] / scale) for s in have)
    goals = {s: total * wanted[s][0] / scale for s in have}

    def shares(at: int) -> dict[str, float]:
        out: dict[str, float] = {}
        for c in cells:
            out[c[at]] = out.get(c[at], 0) + c.tokens
        return {k: total * v / sum(have.values()) for k, v in out.items()}

    mass = rake([((c.source, c.lang, c.topic), c.tokens) for c in cells], [wanted[c.source][1] * c.tokens for c in cells], [goals, shares(1), shares(2)])
    weights = spark.createDataFrame([(c.source, c.lang, c.topic, float(m / c.tokens), wanted[c.source][1]) for c, m in zip(cells, mass)], "source string, lang string, topic string, _w double, _most int")
    drawn = cut(_draw(docs.join(F.broadcast(weights), ["source", "lang", "topic"]), sum(c.n for c in cells)))  # as many rows as cells
    return _settle(drawn, goals).drop("_most", "_h")


def _draw(docs: DataFrame, n: int) -> DataFrame:
    """Copies by systematic sampling in each source, along falling size, with prefix sums in two steps."""
    sub = max(1, n // (8 * WINDOW_ROWS))
    own = docs.withColumns({"_h": F.xxhash64("doc_id"), "_class": F.floor(F.log2("tokens") * 4).cast("int"), "_base": F.floor(F.col("_w") + 1e-9).cast("int")})
    own = own.withColumn("_f", F.greatest(F.lit(0.0), F.col("_w") - F.col("_base"))).withColumn("_sub", F.pmod("_h", F.lit(sub)).cast("int"))
    group = ["source", "_class", "_sub"]
    sums = own.groupBy(*group).agg(F.sum("_f").alias("_t"))
    # a source has at most 4 classes per doubling of size, times _sub
    earlier = F.coalesce(F.sum("_t").over(Window.partitionBy("source").orderBy(F.desc("_class"), "_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = sums.select(*group, earlier.alias("_start"))
    inside = Window.partitionBy(*group).orderBy(F.desc("tokens"), "_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = own.join(starts, group).withColumn("_c", F.col("_start") + F.sum("_f").over(inside))
    step = F.floor(F.col("_c") + 0.5 + 1e-9) - F.floor(F.col("_c") - F.col("_f") + 0.5 + 1e-9)
    copies = F.least(F.col("_most"), (F.col("_base") + F.least(step, F.lit(1))).cast("int"))
    return run.select("doc_id", "source", "lang", "topic", "tokens", copies.alias("copies"), "_most", "_h")


def _settle(drawn: DataFrame, goals: dict[str, float]) -> DataFrame:
    """Change single copies until no change brings a source's total closer to its goal.

    A document is changed once, and each change brings a gap down, from the first on to below what tells two documents'
    sizes apart; the changes that this takes are few, whatever the number of documents.
    """
    changes: dict[int, int] = {}
    sums = {r.source: float(r.t) for r in drawn.groupBy("source").agg(F.sum(F.col("tokens").cast("bigint") * F.col("copies")).alias("t")).collect()}
    while True:
        gaps = {s: g - sums.get(s, 0.0) for s, g in goals.items()}
        gap = F.create_map(*[x for s, g in sorted(gaps.items()) for x in (F.lit(s), F.lit(float(g)))])[F.col("source")]
        move = F.when((gap > 0) & (F.col("copies") < F.col("_most")), 1).when((gap < 0) & (F.col("copies") > 0), -1)
        left = F.abs(gap - move * F.col("tokens"))
        free = drawn.filter(~F.col("doc_id").isin(*changes)) if changes else drawn
        best = free.withColumns({"_move": move, "_left": left}).filter(F.col("_move").isNotNull() & (F.col("_left") < F.abs(gap))).groupBy("source").agg(F.min_by(F.struct("doc_id", "_move", "tokens"), F.struct("_left", "doc_id")).alias("b")).collect()
        if not best:
            break
        for r in best:
            changes[r.b.doc_id] = changes.get(r.b.doc_id, 0) + r.b._move
            sums[r.source] = sums.get(r.source, 0.0) + r.b._move * r.b.tokens
    moved = F.create_map(*[x for d, m in sorted(changes.items()) for x in (F.lit(d).cast("bigint"), F.lit(m))])[F.col("doc_id")] if changes else F.lit(0)
    return drawn.withColumn("copies", F.least(F.col("_most"), F.col("copies") + F.coalesce(moved, F.lit(0)))).filter("copies > 0")


def share_report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: wanted and reached share of all tokens, tokens, documents, most copies of one."""
    by = selected.groupBy("source").agg(F.sum(F.col("tokens").cast("bigint") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    wanted = targets.select(plain_source("source").alias("source"), F.col("target_share"), F.col("max_repeats"))
    every = Window.partitionBy()  # one row per target
    joined = wanted.join(by, "source", "left").withColumn("_all", F.sum("tokens").over(every))
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
