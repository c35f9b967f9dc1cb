"""Every query survives empty tables, and tables of nothing but nulls."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from compare import TABLES

QUERIES = entry.queries()


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    for t in TABLES:
        whole = pq.read_table(f"/root/testdata/sf0.001/{t}.parquet")
        rows = whole.slice(0, 0) if request.param == "empty" else pa.Table.from_arrays([pa.nulls(3, f.type) for f in whole.schema], names=whole.schema.names)
        pq.write_table(rows, f"{at}/{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] == "p" and n[1].isdigit()))
def test_problem_queries(spark, folder, name):
    QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not (n[0] == "p" and n[1].isdigit())))
def test_other_queries(spark, folder, name):
    QUERIES[name](spark, folder).collect()
