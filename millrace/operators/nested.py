"""Flat tables from nested JSON by interval labels (problem 5)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Up to this many field paths that hold both arrays and lone objects, of at most so many characters together, are sent
#: to the executors as a constant.
LONE_PATHS, LONE_CHARACTERS = 10_000, 4_000_000

NODE_SCHEMA = "source string, message string, node string, kind string, parent string, place int, in_array boolean, pre int, post int, fields string"
_ARROW = pa.schema([("source", pa.string()), ("message", pa.string()), ("node", pa.string()), ("kind", pa.string()), ("parent", pa.string()), ("place", pa.int32()), ("in_array", pa.bool_()), ("pre", pa.int32()), ("post", pa.int32()), ("fields", pa.string())])


def read_object(text: str | None) -> dict | None:
    """The JSON object of a text, or None if it doesn't parse as one."""
    if not text:
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def as_array(value: object) -> list | None:
    """The array a value is: itself, or the one whose text a string holds."""
    if isinstance(value, list):
        return value
    if isinstance(value, str) and value.lstrip()[:1] == "[":
        try:
            found = json.loads(value)
        except (ValueError, RecursionError):
            return None
        return found if isinstance(found, list) else None
    return None


def label(record: dict, lone: frozenset[str] | set[str]) -> list[tuple]:
    """Label every object of ``record``, depth first: ``(node, kind, place, in_array, pre, post, object)``.

    Pre-order and post-order numbers come from one counter each; a node lies inside another exactly if its pre is
    larger and its post smaller. ``kind`` is the path without positions. An object alone in a field of ``lone`` counts
    as element 0 of an array. The walk uses its own stack, so depth is not bound by Python's.
    """
    out: list[list] = []
    pre = post = 0
    todo: list[tuple] = [("open", "", "", record, -1, False)]
    while todo:
        step, node, kind, value, place, inside = todo.pop()
        if step == "close":
            out[value][5] = post
            post += 1
            continue
        if isinstance(value, dict):
            out.append([node, kind, place, inside, pre, -1, value])
            pre += 1
            todo.append(("close", "", "", len(out) - 1, 0, False))
            prefix, kinds = (f"{node}.", f"{kind}.") if node else ("", "")
            for name, below in reversed(value.items()):
                if isinstance(below, dict):
                    if (path := f"{kinds}{name}") in lone:
                        todo.append(("open", f"{prefix}{name}[0]", f"{path}[]", below, 0, True))
                    else:
                        todo.append(("open", f"{prefix}{name}", path, below, -1, False))
                elif (items := as_array(below)) is not None:
                    todo.append(("open", f"{prefix}{name}", f"{kinds}{name}", items, -1, False))
        else:
            for i in range(len(value) - 1, -1, -1):
                below = value[i]
                if isinstance(below, dict):
                    todo.append(("open", f"{node}[{i}]", f"{kind}[]", below, i, True))
                elif (items := as_array(below)) is not None:
                    todo.append(("open", f"{node}[{i}]", f"{kind}[]", items, i, True))
    return [tuple(x) for x in out]


def contained(nodes: list[tuple]) -> list[str]:
    """For each labelled node, in pre-order, the nearest array element whose interval contains it, or an empty text."""
    out, around = [], []
    for node, _, _, inside, pre, post, _ in nodes:
        while around and not (around[-1][0] < pre and post < around[-1][1]):
            around.pop()
        out.append(around[-1][2] if around else "")
        if inside:
            around.append((pre, post, node))
    return out


def _shapes(record: dict, arrays: set[str], alone: set[str]) -> None:
    """Collect the kinds of path at which a record holds arrays, and lone objects, reading lone objects both ways."""
    todo: list[tuple[str, object]] = [("", record)]
    while todo:
        kind, value = todo.pop()
        if isinstance(value, dict):
            prefix = f"{kind}." if kind else ""
            for name, below in value.items():
                path = f"{prefix}{name}"
                if isinstance(below, dict):
                    alone.add(path)
                    todo.append((path, below))
                    todo.append((f"{path}[]", below))
                elif (items := as_array(below)) is not None:
                    arrays.add(path)
                    todo.append((path, items))
        else:
            for below in value:
                if isinstance(below, dict):
                    todo.append((f"{kind}[]", below))
                elif (items := as_array(below)) is not None:
                    todo.append((f"{kind}[]", items))


def mixed_paths(records: DataFrame, text: str) -> DataFrame:
    """The paths, in any record, that hold an array in one place and a lone object in another: ``path``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays: set[str] = set()
            alone: set[str] = set()
            for t in b.column(0).to_pylist():
                if (record := read_object(t)) is not None:
                    _shapes(record, arrays, alone)
            paths = sorted(arrays | alone)
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "arr": pa.array([p in arrays for p in paths], pa.bool_()), "obj": pa.array([p in alone for p in paths], pa.bool_())})

    seen = records.select(text).mapInArrow(scan, "path string, arr boolean, obj boolean")
    return seen.groupBy("path").agg(F.bool_or("arr").alias("arr"), F.bool_or("obj").alias("obj")).filter("arr AND obj").select("path")


def nested_nodes(records: DataFrame, message: str, text: str, lone_limit: int = LONE_PATHS, values: bool = True, elements_only: bool = False) -> DataFrame:
    """One row per object at any depth of the JSON in ``text``, once per message.

    Columns: ``message``; ``node``, the path with positions; ``kind``, the path without, which names the node's table;
    ``parent``, the node of the nearest enclosing array element or an empty text; ``place`` in its array or -1;
    ``in_array``; the interval ``pre``, ``post`` (the labels of :func:`label`); ``fields``, the object's own scalar fields
    and arrays of scalars as JSON, for :func:`node_table`. A message's outermost object is the node with the empty path.

    ``values=False`` leaves ``fields`` null; ``elements_only`` keeps array elements only.

    The first pass finds the paths that hold both arrays and lone objects. They are few: a constant if at most
    ``lone_limit``, else each record is joined with its own paths among them, by path. With ``values`` a message's
    deliveries are brought down to one before they are labelled, so no field crosses a shuffle twice and the labels of
    a message come from one traversal: the readable delivery with the smallest hash. Without, only labels move: all
    deliveries are labelled and a message's equal nodes, which then differ in nothing but their numbers, count once.

    Defined cases: null, empty or unreadable texts and JSON that is no object give no rows; null elements keep their
    place; empty objects are nodes; a string that holds the text of an array is that array; repeated messages give
    their rows once; rows without a message id keep a null id, and equal texts among them count as one message; texts
    of any length are walked whole, and of any depth that Python's JSON reader takes.
    """
    given = records.select(F.col(message).cast("string").alias("_m"), F.col(text).cast("string").alias("_t")).filter("_t IS NOT NULL AND _t <> ''")
    mixed = cut(mixed_paths(given, "_t"))
    size = mixed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("path")), F.lit(0)).alias("characters")).first()
    once = _one_delivery(given) if values else given.withColumn("_other", F.lit(None).cast("string"))
    if size.n <= lone_limit and size.characters <= LONE_CHARACTERS:
        lone = frozenset(r.path for r in mixed.collect())
        nodes = once.mapInArrow(_labeller(lone, values), NODE_SCHEMA)
    else:
        texts = once.select(F.explode(F.array("_t", "_other")).alias("_t")).filter("_t IS NOT NULL")
        own = texts.mapInArrow(_own_paths, "id string, path string").distinct().join(mixed, "path").groupBy("id").agg(F.collect_set("path").alias("_own"))
        keyed = once.withColumn("id", F.sha2("_t", 256)).join(own, "id", "left").withColumnRenamed("_own", "_a").drop("id")
        keyed = keyed.withColumn("id", F.sha2("_other", 256)).join(own, "id", "left").select("_m", "_t", "_other", "_a", F.col("_own").alias("_b"))
        nodes = keyed.mapInArrow(_labeller(None, values), NODE_SCHEMA)
    wanted = nodes.filter("in_array") if elements_only else nodes
    return (wanted if values else wanted.dropDuplicates(["source", "message", "node"])).drop("source")


def _one_delivery(given: DataFrame) -> DataFrame:
    """``_m, _t, _other``: each message's delivery with the smallest hash among those that look readable, and among the others.

    Partitions bring a message down to these two before the shuffle, so one delivered very often weighs no more.
    """
    h = F.xxhash64("_t")
    looks = F.get_json_object("_t", "$").isNotNull()
    best = given.withColumn("_k", F.when(F.col("_m").isNull(), F.md5("_t"))).groupBy("_m", "_k").agg(F.min_by("_t", F.when(looks, F.struct(h, F.col("_t")))).alias("_t"), F.min_by("_t", F.when(~looks, F.struct(h, F.col("_t")))).alias("_other"))
    return best.select("_m", F.coalesce("_t", "_other").alias("_t"), F.when(F.col("_t").isNotNull(), F.col("_other")).alias("_other"))


def _own_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, paths = [], []
        for t in b.column("_t").to_pylist():
            if (record := read_object(t)) is not None:
                alone: set[str] = set()
                _shapes(record, set(), alone)
                ids += [hashlib.sha256(t.encode()).hexdigest()] * len(alone)
                paths += sorted(alone)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "path": pa.array(paths, pa.string())})


def _labeller(lone: frozenset[str] | None, values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, spare = (b.column(c).to_pylist() if lone is None else None for c in ("_a", "_b"))
            rows: list[tuple] = []
            for i, (m, t, other) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_m", "_t", "_other")))):
                paths = own
                if (record := read_object(t)) is None:
                    if (record := read_object(other)) is None:
                        continue
                    paths = spare
                nodes = label(record, lone if lone is not None else set(paths[i] or ()))
                for (node, kind, place, inside, pre, post, value), parent in zip(nodes, contained(nodes)):
                    rows.append((None if m is not None else hashlib.md5(t.encode()).hexdigest(), m, node, kind, parent, place, inside, pre, post, _scalars(value) if values else None))
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _scalars(value: dict) -> str:
    own = {}
    for name, v in value.items():
        items = as_array(v)
        if isinstance(v, dict) or items is not None and any(isinstance(x, dict) or as_array(x) is not None for x in items):
            continue
        own[name] = v if items is None else items
    return json.dumps(own, ensure_ascii=False, separators=(",", ":"))


def node_table(nodes: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one kind of node: ``message, node, parent, place`` and the named ``fields`` with their types."""
    schema = ", ".join(f"`{k}` {v}" for k, v in fields.items())
    rows = nodes.filter(F.col("kind") == kind).withColumn("_f", F.from_json("fields", schema))
    return rows.select("message", "node", "parent", "place", *[F.col(f"_f.`{k}`").alias(k) for k in fields])
