"""Results of queries without an SQL twin, recomputed in plain Python from the same tables."""

import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from millrace.functions.text import porter_stem
from millrace.operators.merges import merge_vocabulary
from test_problems import brute_nodes

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def records():
    for r in table("kite_status"):
        try:
            p = json.loads(r["properties"])
        except (TypeError, ValueError):
            continue
        if isinstance(p, dict):
            yield r, p


def as_list(v):
    if isinstance(v, str) and v.lstrip()[:1] == "[":
        try:
            v = json.loads(v)
        except ValueError:
            return None
    return v if isinstance(v, list) else None


def lone_fields():
    """Paths that hold arrays in one place and lone objects in another, lone objects read both ways."""
    arrays, alone = set(), set()

    def walk(v, kind):
        if isinstance(v, dict):
            for k, x in v.items():
                path = f"{kind}.{k}" if kind else k
                if isinstance(x, dict):
                    alone.add(path)
                    walk(x, path), walk(x, path + "[]")
                elif (items := as_list(x)) is not None:
                    arrays.add(path)
                    walk(items, path)
        else:
            for x in v:
                if isinstance(x, dict):
                    walk(x, kind + "[]")
                elif (items := as_list(x)) is not None:
                    walk(items, kind + "[]")

    for _, p in records():
        walk(p, "")
    return arrays & alone


def test_nested_elements(spark):
    lone = lone_fields()
    want = {(r["messageid"], n, q) for r, p in records() for n, q in brute_nodes(p, lone)}
    got = [tuple(r) for r in QUERIES["p5_found"](spark, FOLDER).select("messageid", "node", "parent").collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want
    nodes = run(spark, "p5_nodes")
    assert {(r.messageid, r.node, r.parent) for r in nodes if r.in_array} == want
    by = defaultdict(list)
    for r in nodes:
        by[r.messageid].append(r)
    for own in by.values():
        assert sorted(r.pre for r in own) == sorted(r.post for r in own) == list(range(len(own)))
        if len(own) < 40:
            for r in own:
                around = [q for q in own if q.in_array and q.pre < r.pre and r.post < q.post]
                assert r.parent == (max(around, key=lambda q: q.pre).node if around else "")


def test_drift(spark):
    """Added, removed and retyped fields by counting; what counting calls gone and come is that, or two ends of a rename."""
    rows, seen = Counter(), defaultdict(Counter)
    kinds = {str: "string", bool: "boolean", dict: "object", list: "array"}
    for r, p in records():
        rows[r["prefix"]] += 1
        todo = [("", p)]
        while todo:
            at, value = todo.pop()
            for k, v in value.items():
                if v is not None:
                    seen[r["prefix"]][at + k, kinds.get(type(v), "number")] += 1
                    if isinstance(v, dict):
                        todo.append((at + k + ".", v))
    order = ["string", "number", "boolean", "array", "object"]
    fields = {}
    for f in rows:
        by = defaultdict(Counter)
        for (path, t), n in seen[f].items():
            by[path][t] += n
        fields[f] = {path: min(c, key=lambda t: (-c[t], order.index(t))) for path, c in by.items() if 2 * c.total() >= rows[f]}
    want = set()
    files = sorted(fields)
    for a, b in zip(files, files[1:]):
        want |= {(b, "added", "", p) for p in fields[b].keys() - fields[a].keys()} | {(b, "removed", p, "") for p in fields[a].keys() - fields[b].keys()}
        want |= {(b, "retyped", p, p) for p in fields[a].keys() & fields[b].keys() if fields[a][p] != fields[b][p]}
    got = {(r.prefix, r.change, r.field_before, r.field_after) for r in run(spark, "p7_found")}
    renamed = {g for g in got if g[1] == "renamed"}
    ends = {(f, "removed", b, "") for f, _, b, _ in renamed} | {(f, "added", "", a) for f, _, _, a in renamed}
    assert renamed and ends <= want and got - renamed == want - ends
    table_ = QUERIES["p7_table"](spark, FOLDER)
    assert table_.count() == sum(rows.values())


def test_feature_rows(spark):
    long = {(r.userid, r.field, r.val): (r.n, r.last_ms) for r in run(spark, "p3_features")}
    got = {}
    for r in run(spark, "p3_feature_rows"):
        got[r.userid, "*", ""] = (r.n, r.last_ms)
        for f in ("event", "properties__os", "properties__cpu_threads", "properties__git_found"):
            for v, c in json.loads(r[f] or "{}").items():
                got[r.userid, f, v] = (c["n"], c["last_ms"])
    assert got == long and len(long) > 100


def words():
    return [(r["doc_id"], r["source"], re.findall(r"[A-Za-z0-9_]+", r["text"].lower())) for r in table("documents") if r["text"] is not None]


def test_stems(spark):
    n = Counter(w for _, _, ws in words() for w in ws)
    want, kinds = Counter(), Counter()
    for w, k in n.items():
        want[porter_stem(w)] += k
        kinds[porter_stem(w)] += 1
    assert {r.stem: (r.n, r.words) for r in run(spark, "stem_counts")} == {s: (want[s], kinds[s]) for s in want}


def brute_merges(counts, merges):
    state, found = {w: list(w) for w in counts}, []
    while len(found) < merges:
        pairs = Counter()
        for w, s in state.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        if not pairs or (best := min(pairs, key=lambda p: (-pairs[p], p))) is None or pairs[best] < 2:
            break
        found.append(best)
        for w, s in state.items():
            out = []
            i = 0
            while i < len(s):
                two = i + 1 < len(s) and (s[i], s[i + 1]) == best
                out.append(s[i] + s[i + 1] if two else s[i])
                i += 2 if two else 1
            state[w] = out
    return found


def test_merges_come_in_order(spark):
    assert [(r.a, r.b) for r in sorted(run(spark, "merges"))] == brute_merges(Counter(w for _, _, ws in words() for w in ws), 100)
    odd = {"aaaa": 3, "aaab": 3, "$a$": 2, "\\x\\x": 2, "é́é": 2, "abab": 3}
    df = spark.createDataFrame(list(odd.items()), "w string, n bigint")
    assert merge_vocabulary(df, "w", "n", 50) == brute_merges(odd, 50)


def test_source_model(spark):
    import hashlib

    bin_of = {}
    docs = []
    for d, s, ws in words():
        if s is not None and ws:
            for w in ws:
                bin_of.setdefault(w, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1001)
            docs.append((d, s.strip(" ").lower().replace("-", "_"), Counter(bin_of[w] for w in ws)))
    counts = defaultdict(Counter)
    for _, s, c in docs:
        counts[s].update(c)
    got = {r.doc_id: (r.own, r.guess, r.p) for r in run(spark, "source_model")}
    assert len(got) == len(docs)
    for d, own, c in docs:
        lp = {s: sum(k * math.log((n[b] + 0.01) / (n.total() + 10.01)) for b, k in c.items()) for s, n in counts.items() if any(b in n for b in c)}
        best = max(lp.values())
        p = 1 / sum(math.exp(x - best) for x in lp.values())
        assert got[d][0] == own and lp[got[d][1]] == pytest.approx(best, abs=1e-6) and got[d][2] == pytest.approx(p, abs=2e-4)


def test_vectors(spark):
    x = np.array([r["embedding"] for r in table("embeddings") if r["embedding"] is not None], float)
    part = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert [r.part for r in sorted(run(spark, "principal_axes"))] == pytest.approx(list(part[:5] / part.sum()), abs=2e-6)
    groups = run(spark, "kmeans_groups")
    assert sum(r.members for r in groups) == len(x) and sum(r.weight for r in groups) == pytest.approx(1, abs=1e-4)


def test_patterns_and_models(spark):
    docs = {d for d, _, ws in words() if ws}
    found = run(spark, "code_patterns")
    assert sum(r.members for r in found) == len(docs) and {int(d) for r in found for d in r.snippets.split(",") if d} <= docs
    assert all(set(map(int, filter(None, r.pattern.split(",")))) <= set(range(103)) for r in found)
    scores = {r.metric: r.value for r in run(spark, "conversion_model")}
    assert 0.5 < scores["areaUnderROC"] <= 1 and abs(scores["cross-validated"] - scores["areaUnderROC"]) < 0.2
    by = defaultdict(float)
    for r in run(spark, "type_induction"):
        assert 0 <= r.p <= 1
        by[r.func] += r.p
    assert all(v == pytest.approx(1, abs=2e-3) for v in by.values())


def test_landed_lines_by_prototype(spark, tmp_path):
    import datetime

    from millrace.sources import records as I

    (tmp_path / "2024-01-05").mkdir(), (tmp_path / "2024-01-06").mkdir(), (tmp_path / "2024-02-01").mkdir()
    (tmp_path / "2024-01-05/a").write_text('{"event": "a", "n": 1, "m": 2}\n{"event": "b", "n": 3}\nbroken\n')
    (tmp_path / "2024-01-06/a").write_text('{"event": "a", "n": 4}\n')
    (tmp_path / "2024-02-01/a").write_text('{"event": "a", "n": 5}\n')
    days = datetime.date(2024, 1, 5), datetime.date(2024, 1, 31)
    every = [r for i in range(3) for r in I.read_event_range(spark, str(tmp_path), *days, {"a": "n int"}, shard=i, shards=3).collect()]
    assert sorted((r.day, r.event or "", r.body or "", r["_corrupt"] or "") for r in every) == [("2024-01-05", "", "", "broken"), ("2024-01-05", "a", '{"n":1}', ""), ("2024-01-06", "a", '{"n":4}', "")]
    with pytest.raises(I.DecodeBudget):
        I.read_event_range(spark, str(tmp_path), *days, {"": "n int"}, max_errors=0)
    with pytest.raises(ValueError):
        I.repeated(spark.range(1), -1)
