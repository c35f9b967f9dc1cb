"""Drifting schemas: what changed between files, and one consistent table (problem 7)."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.nested import read_object
from millrace.session import cut

TYPES = ("string", "number", "boolean", "array", "object")
#: In a chunk of a file, paths on less than this share of its rows aren't reported; the error this leaves is known.
CHUNK_SHARE = 1 / 256
#: Users seen on both sides, share of them with the same value, and that share beyond chance that make a rename.
MIN_USERS, SAME, BEYOND_CHANCE = 3, 0.8, 0.5
#: Up to so many characters the list of fields to compare is sent to all executors.
BROADCAST_CHARACTERS = 32_000_000
#: A pair of fields corresponds if its flooded score is at least this share of the best score of either.
RELATIVE = 0.75

_COUNTS = "file string, path string, " + ", ".join(f"n_{t} bigint" for t in TYPES) + ", covered bigint"


def type_of(value: object) -> int:
    """Index into TYPES."""
    if isinstance(value, str):
        return 0
    if isinstance(value, bool):
        return 2
    if isinstance(value, dict):
        return 4
    return 3 if isinstance(value, list) else 1


def paths_of(record: dict) -> Iterator[tuple[str, object]]:
    """Every dotted path through nested objects with a non-null value, not into arrays."""
    todo = [("", record)]
    while todo:
        prefix, value = todo.pop()
        for name, below in value.items():
            if below is None:
                continue
            path = prefix + name
            yield path, below
            if isinstance(below, dict):
                todo.append((path + ".", below))


def _counter(share: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            rows: Counter = Counter()
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (record := read_object(text)) is None:
                    continue
                rows[file] += 1
                seen[file].update([(p, type_of(v)) for p, v in paths_of(record)])
            out: list[tuple] = []
            for file, n in rows.items():
                out.append((file, "", 0, 0, 0, 0, 0, n))
                by_path: dict[str, list[int]] = {}
                for (path, kind), k in seen[file].items():
                    by_path.setdefault(path, [0] * 5)[kind] += k
                out += [(file, path, *ks, n) for path, ks in by_path.items() if sum(ks) >= share * n and path]
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(cols)], names=["file", "path", *[f"n_{t}" for t in TYPES], "covered"])

    return scan


def file_fields(records: DataFrame, file: str, text: str, share: float = CHUNK_SHARE) -> DataFrame:
    """The fields that belong to each file: ``file, path, type, n, rows``, exactly.

    Each Arrow batch counts paths and types and reports those on at least ``share`` of its rows of a file, so keys made
    up at run time, of which a row has its own, never reach the shuffle. What a batch leaves out is less than
    ``share`` of its rows. A field's count is hence known within bounds; the files in which these bounds leave a
    field or its type open are counted again without leaving anything out.
    """
    if not 0 <= share <= 0.5:
        raise ValueError("share must be at most one half: a field of half the rows is on half the rows of some batch")
    given = records.select(F.col(file).cast("string").alias("file"), F.col(text).cast("string").alias("text")).filter("file IS NOT NULL AND text IS NOT NULL")

    def total(counts: DataFrame) -> DataFrame:
        return counts.groupBy("file", "path").agg(*[F.sum(f"n_{t}").alias(f"n_{t}") for t in TYPES], F.sum("covered").alias("covered"))

    def judged(sums: DataFrame, left_out: float) -> DataFrame:
        sums = cut(sums)  # read for the sizes and for the fields
        sizes = sums.filter("path = ''").select("file", F.col("covered").alias("rows"))
        ranked = F.array_sort(F.array(*[F.struct(-F.col(f"n_{t}"), F.lit(i), F.lit(t).alias("t")) for i, t in enumerate(TYPES)]))
        facts = sums.filter("path <> ''").join(sizes, "file").withColumn("n", sum((F.col(f"n_{t}") for t in TYPES), F.lit(0))).withColumn("_r", ranked)
        missing = (F.col("rows") - F.col("covered")) * F.lit(left_out)
        lead = F.col("_r")[1]["col1"] - F.col("_r")[0]["col1"]
        inside, outside = F.col("n") * 2 >= F.col("rows"), (F.col("n") + missing) * 2 < F.col("rows")
        return facts.select("file", "path", F.col("_r")[0]["t"].alias("type"), "n", "rows", inside.alias("inside"), ((~inside & ~outside) | (inside & (lead <= missing) & (missing > 0))).alias("open"))

    first = cut(judged(total(given.mapInArrow(_counter(share), _COUNTS)), share).filter("inside OR open"))
    unsure = first.filter("open").select("file").distinct()
    if unsure.isEmpty():
        return first.filter("inside").select("file", "path", "type", "n", "rows")
    again = judged(total(given.join(unsure, "file", "left_semi").mapInArrow(_counter(0.0), _COUNTS)), 0.0)
    settled = first.join(unsure, "file", "left_anti").unionByName(again)
    return cut(settled.filter("inside").select("file", "path", "type", "n", "rows"))


def compare_files(fields: DataFrame) -> DataFrame:
    """Each field of each pair of neighbouring files: ``pair`` (the later file), ``earlier, path, before, after`` (types)."""
    files = fields.select("file").distinct()
    order = Window.orderBy("file")  # one row per file
    chain = files.select("file", F.lag("file").over(order).alias("_prev"), F.lead("file").over(order).alias("_next"))
    placed = fields.join(chain, "file")
    after = placed.filter("_prev IS NOT NULL").select(F.col("file").alias("pair"), F.col("_prev").alias("earlier"), "path", F.lit(None).cast("string").alias("before"), F.col("type").alias("after"))
    before = placed.filter("_next IS NOT NULL").select(F.col("_next").alias("pair"), F.col("file").alias("earlier"), "path", F.col("type").alias("before"), F.lit(None).cast("string").alias("after"))
    return after.unionByName(before).groupBy("pair", "earlier", "path").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def canonical(value: object) -> str:
    """A value as text, the same for the same value in another type: numbers by value, yes/no and true/false as 1/0."""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (dict, list)):
        return json.dumps(value, sort_keys=True, ensure_ascii=False)
    text = str(value).strip().lower()
    if text in ("true", "yes"):
        return "1"
    if text in ("false", "no"):
        return "0"
    try:
        number = float(text)
    except ValueError:
        return text
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else text if isinstance(value, str) else repr(value)


def carried_values(records: DataFrame, file: str, text: str, user: str, ms: str, compared: DataFrame) -> DataFrame:
    """For each field that goes and each that comes in one file: how many users carry the value on.

    ``pair, gone, come, users, same, chance``: ``users`` have the one in the earlier file and the other in the later;
    for ``same`` of them the last value there is the first here; ``chance`` is the share expected if users' values
    were dealt anew. Only files in which fields both go and come are read, and of these only the fields in question.
    """
    moved = compared.filter("(before IS NULL) <> (after IS NULL)")
    sides = moved.groupBy("pair", "earlier").agg(F.collect_set(F.when(F.col("after").isNull(), F.col("path"))).alias("gone"), F.collect_set(F.when(F.col("before").isNull(), F.col("path"))).alias("come")).filter("size(gone) > 0 AND size(come) > 0")
    wants = sides.select(F.col("earlier").alias("file"), F.struct("pair", F.lit(0).alias("side"), F.col("gone").alias("paths")).alias("w")).unionByName(sides.select(F.col("pair").alias("file"), F.struct("pair", F.lit(1).alias("side"), F.col("come").alias("paths")).alias("w")))
    wanted = cut(wants.groupBy("file").agg(F.collect_list("w").alias("wants")))
    if wanted.agg(F.coalesce(F.sum(F.length(F.to_json("wants")) + F.length("file")), F.lit(0))).first()[0] <= BROADCAST_CHARACTERS:
        wanted = F.broadcast(wanted)
    given = records.select(F.col(file).cast("string").alias("file"), F.col(user).alias("user"), F.col(ms).alias("ms"), F.col(text).cast("string").alias("text")).filter("user IS NOT NULL AND ms IS NOT NULL AND text IS NOT NULL")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for who, at, t, wants in zip(*(b.column(c).to_pylist() for c in ("user", "ms", "text", "wants"))):
                if (record := read_object(t)) is None:
                    continue
                for w in wants:
                    for path in w["paths"]:
                        value: object = record
                        for name in _steps(record, path):
                            value = value[name]
                        if value is not None and value is not record:
                            out.append((w["pair"], w["side"], path, who, at, canonical(value)))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["pair", "side", "path", "user", "ms", "value"])

    read = given.join(wanted, "file").select("user", "ms", "text", "wants").mapInArrow(values, "pair string, side int, path string, user string, ms bigint, value string")
    at = F.struct("ms", "value")
    ends = read.groupBy("pair", "side", "path", "user").agg(F.max_by("value", at).alias("last"), F.min_by("value", at).alias("first"))
    by_user = ends.groupBy("pair", "user").agg(F.collect_list(F.when(F.col("side") == 0, F.struct("path", F.col("last").alias("v")))).alias("b"), F.collect_list(F.when(F.col("side") == 1, F.struct("path", F.col("first").alias("v")))).alias("a"))
    crossed = by_user.filter("size(a) > 0 AND size(b) > 0").select("pair", F.explode("b").alias("b"), "a").select("pair", "b", F.explode("a").alias("a"))
    both = crossed.groupBy("pair", F.col("b.path").alias("gone"), F.col("a.path").alias("come"), F.col("b.v").alias("vb"), F.col("a.v").alias("va")).agg(F.count(F.lit(1)).alias("n"))
    both = cut(both)
    keys = ["pair", "gone", "come"]
    seen = both.groupBy(*keys).agg(F.sum("n").alias("users"), F.sum(F.when(F.col("va") == F.col("vb"), F.col("n")).otherwise(0)).alias("same"))
    left = both.groupBy(*keys, F.col("vb").alias("v")).agg(F.sum("n").alias("nb"))
    right = both.groupBy(*keys, F.col("va").alias("v")).agg(F.sum("n").alias("na"))
    met = left.join(right, [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("nb").cast("double") * F.col("na")).alias("_met"))
    return seen.join(met, keys, "left").select(*keys, "users", "same", (F.coalesce("_met", F.lit(0.0)) / (F.col("users").cast("double") * F.col("users"))).alias("chance"))


def _steps(record: dict, path: str) -> list[str]:
    """The keys that lead to ``path``, whose names may hold dots themselves; empty if it isn't there."""
    todo: list[tuple[dict, str, list[str]]] = [(record, path, [])]
    while todo:
        value, rest, way = todo.pop()
        if rest in value:
            return [*way, rest]
        for name, below in value.items():
            if isinstance(below, dict) and rest.startswith(name + "."):
                todo.append((below, rest[len(name) + 1 :], [*way, name]))
    return []


def name_likeness(a: str, b: str) -> float:
    """Shared three-letter pieces of two names, of 1."""
    cut3 = lambda s: {f"  {s.lower()} "[i : i + 3] for i in range(len(s) + 1)}
    x, y = cut3(a), cut3(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def flood(before: dict[str, str], after: dict[str, str], evidence: dict[tuple[str, str], float], rounds: int = 100, eps: float = 1e-4) -> tuple[list[str], list[str], np.ndarray]:
    """Similarity flooding between two schema graphs; the converged scores of all pairs of fields, of 1.

    A graph has a node per field and per type, edges from a field to its type and from an object to its fields. A pair
    of fields starts with the likeness of names and the evidence of carried values. In each round it passes its score
    on to the pairs its edges lead to (parents, children, types), shared among the edges of a kind; scores are then
    divided by the largest. Rounds end when no score moves by more than ``eps``.
    """
    bs, as_ = sorted(before), sorted(after)
    if not bs or not as_:
        return bs, as_, np.zeros((len(bs), len(as_)))

    def nesting(names: list[str]) -> np.ndarray:
        m = np.zeros((len(names), len(names)))
        place = {n: i for i, n in enumerate(names)}
        for n, i in place.items():
            up = n
            while "." in up:
                up = up.rpartition(".")[0]
                if up in place:
                    m[i, place[up]] = 1
                    break
        return m

    def typing(names: list[str], kinds: dict[str, str]) -> np.ndarray:
        return np.array([[float(kinds[n] == t) for t in TYPES] for n in names])

    start = np.array([[0.25 * name_likeness(b.rpartition(".")[2], a.rpartition(".")[2]) + 0.75 * evidence.get((b, a), float(a == b)) for a in as_] for b in bs])
    pb, pa_, tb, ta = nesting(bs), nesting(as_), typing(bs, before), typing(as_, after)
    children = np.maximum(pb.sum(0), 1)[:, None] * np.maximum(pa_.sum(0), 1)[None, :]
    of_type = np.maximum(tb.sum(0)[:, None] * ta.sum(0)[None, :], 1)
    score = start / max(start.max(), 1e-12)
    for _ in range(rounds):
        now = start + score
        down = pb @ (now / children) @ pa_.T
        up = (pb.T @ now @ pa_) / children
        types = (tb.T @ now @ ta) / of_type
        spread = tb @ (types * np.eye(len(TYPES)) / of_type) @ ta.T
        new = now + down + up + spread
        new /= max(new.max(), 1e-12)
        moved = np.abs(new - score).max()
        score = new
        if moved < eps:
            break
    return bs, as_, score


def correspond(before: dict[str, str], after: dict[str, str], evidence: dict[tuple[str, str], float]) -> list[tuple[str, str, float]]:
    """Which field that goes corresponds to which that comes, by flooded scores alone: ``(gone, come, score)``.

    Pairs are taken best score first, each field once, as long as the score is at least RELATIVE of the best score that
    either field has with any field of the other kind.
    """
    bs, as_, score = flood(before, after, evidence)
    rows, cols = [i for i, b in enumerate(bs) if b not in after], [j for j, a in enumerate(as_) if a not in before]
    if not rows or not cols:
        return []
    own = score[np.ix_(rows, cols)]
    best = np.maximum(own.max(1)[:, None], own.max(0)[None, :])
    out: list[tuple[str, str, float]] = []
    used: set[tuple[int, int]] = set()
    for i, j in sorted(np.ndindex(*own.shape), key=lambda x: (-own[x], x)):
        if own[i, j] >= RELATIVE * best[i, j] and own[i, j] > 0 and (0, i) not in used and (1, j) not in used:
            used |= {(0, i), (1, j)}
            out.append((bs[rows[i]], as_[cols[j]], float(own[i, j])))
    return out


def select_renames(pdf: pd.DataFrame) -> pd.DataFrame:
    """Renames of one pair of files: the correspondences that flooding selects, if an exact check of values bears them out.

    What the check asks is the definition of a rename: of the users seen on both sides (nearly) all have the same value,
    and more than would by chance, or, where values tell nothing, the names are alike and all values the same.
    """
    pair = pdf["pair"].iloc[0]
    fields = pdf[pdf["path"].notna()]
    before = {r.path: r.before for r in fields.itertuples() if r.before is not None and r.before == r.before}
    after = {r.path: r.after for r in fields.itertuples() if r.after is not None and r.after == r.after}
    evidence: dict[tuple[str, str], float] = {}
    carried: set[tuple[str, str]] = set()
    for r in pdf[pdf["gone"].notna()].itertuples():
        same = r.same / r.users
        beyond = (same - r.chance) / (1 - r.chance) if r.chance < 1 else 0.0
        evidence[(r.gone, r.come)] = same * max(0.0, beyond)
        alike = name_likeness(r.gone.rpartition(".")[2], r.come.rpartition(".")[2])
        if same >= SAME and (beyond >= BEYOND_CHANCE and r.users >= MIN_USERS or alike >= 0.3 and same == 1.0):
            carried.add((r.gone, r.come))
    out = [(pair, g, c, s) for g, c, s in correspond(before, after, evidence) if (g, c) in carried]
    return pd.DataFrame(out, columns=["pair", "gone", "come", "score"])


def schema_changes(records: DataFrame, file: str, text: str, user: str, ms: str, fields: DataFrame | None = None) -> DataFrame:
    """The changes of each file against the one before: ``file, change, field_before, field_after``.

    ``change`` is ``added``, ``removed``, ``retyped`` or ``renamed``. A field is a dotted path through nested objects;
    it belongs to a file if at least half of the file's readable rows hold it with a non-null value, with the type of
    most of these. A rename is a field that goes and one that comes in the same file and carries the values on: similarity
    flooding (:func:`flood`) selects one-to-one correspondences, which an exact check of the values then confirms.

    Defined cases: rows with a null file, or text that isn't a JSON object, are no rows; files without a readable row
    are passed over; rows without user or time count for fields but not for carried values; equally frequent types
    count as the first of string, number, boolean, array, object; an empty input has no changes.
    """
    own = file_fields(records, file, text) if fields is None else fields
    compared = cut(compare_files(own))
    facts = carried_values(records, file, text, user, ms, compared)
    cast = "pair string, path string, before string, after string, gone string, come string, users double, same double, chance double"
    rows = compared.join(facts.select("pair").distinct(), "pair", "left_semi").select("pair", "path", "before", "after").unionByName(facts.withColumnsRenamed({}).select("pair", "gone", "come", "users", "same", "chance"), allowMissingColumns=True)
    typed = rows.select(*[F.col(p.split()[0]).cast(p.split()[1]) for p in cast.split(", ")])
    renames = cut(typed.groupBy("pair").applyInPandas(select_renames, "pair string, gone string, come string, score double"))
    same_file = compared.withColumn("change", F.expr("CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before <> after THEN 'retyped' END")).filter("change IS NOT NULL")
    ends = renames.select("pair", F.lit("removed").alias("change"), F.col("gone").alias("path")).unionByName(renames.select("pair", F.lit("added").alias("change"), F.col("come").alias("path")))
    rest = same_file.join(ends, ["pair", "change", "path"], "left_anti")
    return rest.select(F.col("pair").alias("file"), "change", F.expr("CASE WHEN change = 'added' THEN '' ELSE path END").alias("field_before"), F.expr("CASE WHEN change = 'removed' THEN '' ELSE path END").alias("field_after")).unionByName(
        renames.select(F.col("pair").alias("file"), F.lit("renamed").alias("change"), F.col("gone").alias("field_before"), F.col("come").alias("field_after"))
    )


_SQL = {"string": "string", "number": "double", "boolean": "boolean", "array": "string", "object": "string"}


def to_type(value: object, kind: str) -> object:
    """A value cast to one of TYPES, or None where that loses it; arrays and objects are JSON text."""
    if kind in ("array", "object"):
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict if kind == "object" else list) else None
    text = canonical(value) if kind != "string" else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if kind == "string":
        return text
    if kind == "boolean":
        return {"1": True, "0": False}.get(text)
    try:
        return float(text)
    except ValueError:
        return None


def catalogue(fields: DataFrame, changes: DataFrame, limit: int = 50_000) -> tuple[dict[str, str], dict[str, str]]:
    """For the consistent table: each path's column and each column's type.

    Paths linked by renames share a column, named as in the latest file that has one of them; its type is that of most
    values. A file has at most twice as many fields as a row has on average, and paths repeat from file to file;
    beyond ``limit`` distinct paths this raises instead of filling the driver.
    """
    stats = fields.groupBy("path", "type").agg(F.sum("n").alias("n"), F.max("file").alias("last"))
    rows = stats.orderBy("path", "type").limit(limit + 1).collect()
    links = changes.filter("change = 'renamed'").select("field_before", "field_after").distinct().limit(limit + 1).collect()
    if len(rows) > limit or len(links) > limit:
        raise ValueError(f"more than {limit} fields")
    root = {r.path: r.path for r in rows}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sorted((r.field_before, r.field_after) for r in links):
        root[find(a)] = find(b)
    names: dict[str, tuple] = {}
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in rows:
        g = find(r.path)
        names[g] = max(names.get(g, ("", "")), (r.last, r.path))
        counts[g][r.type] += r.n
    column = {p: names[find(p)][1] for p in root if find(p) in names}
    kinds = {names[g][1]: min(c, key=lambda t: (-c[t], TYPES.index(t))) for g, c in counts.items()}
    return column, kinds


def consistent_table(records: DataFrame, file: str, text: str, keep: list[str], column: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """Every readable row with one typed column per field of the catalogue, whatever its file calls or types it.

    ``keep`` are columns passed through. Values without a column, and those a cast would lose, stay in ``other``, a map
    from path to JSON text, so nothing is dropped. Names are as in the catalogue with ``.`` as ``__``; of a record
    that holds two paths of one column the one with the column's own name counts, the other stays in ``other``.
    """
    parents = {n.rpartition(".")[0] for n in kinds if "." in n}
    names = sorted(n for n in kinds if n not in parents)  # an object's fields have columns of their own
    given = records.select(*[F.col(k).cast("string").alias(f"_k_{i}") for i, k in enumerate(keep)], F.col(file).cast("string").alias("_file"), F.col(text).cast("string").alias("_text")).filter("_text IS NOT NULL")
    schema = ", ".join(["_file string", *[f"_k_{i} string" for i in range(len(keep))], *[f"_c_{i} {_SQL[kinds[n]]}" for i, n in enumerate(names)], "other map<string,string>"])
    arrow = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    place = {n: i for i, n in enumerate(names)}

    def unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, cols, others = [], [[] for _ in names], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                if (record := read_object(t)) is None:
                    continue
                own: list = [None] * len(names)
                other: dict[str, str] = {}
                taken: dict[str, str] = {}
                for path, value in paths_of(record):
                    name = column.get(path)
                    if name is None:
                        if not isinstance(value, dict):
                            other[path] = json.dumps(value, ensure_ascii=False)
                        continue
                    if name in parents and isinstance(value, dict):
                        continue  # its fields have columns of their own or go to other
                    if name in taken and path != name:
                        other[path] = json.dumps(value, ensure_ascii=False)
                        continue
                    if name in taken:
                        other[taken[name]] = json.dumps(own[place[name]], ensure_ascii=False)
                    cast = to_type(value, kinds[name])
                    if cast is None:
                        other[path] = json.dumps(value, ensure_ascii=False)
                    else:
                        own[place[name]], taken[name] = cast, path
                kept.append(i)
                others.append(list(other.items()))
                for c, v in zip(cols, own):
                    c.append(v)
            index = pa.array(kept, pa.int64())
            arrays = [b.column("_file").take(index), *[b.column(f"_k_{i}").take(index) for i in range(len(keep))], *[pa.array(c, arrow[_SQL[kinds[n]]]) for c, n in zip(cols, names)], pa.array(others, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_file", *[f"_k_{i}" for i in range(len(keep))], *[f"_c_{i}" for i in range(len(names))], "other"])

    wide = given.mapInArrow(unify, schema)
    return wide.select(F.col("_file").alias(file), *[F.col(f"_k_{i}").alias(k) for i, k in enumerate(keep)], *[F.col(f"_c_{i}").alias("properties__" + n.replace(".", "__")) for i, n in enumerate(names)], "other")
