"""Queries over graphs of more nodes than the sample that ranges are drawn from, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from recollex.plans import catalogue
from recollex.sources import memories as src

QUERIES = [
    "ablation_no_bridges",
    "retrieve_modality",
    "retrieve_modality_results",
    "bfs_1hop",
    "bfs_2hop_stored",
    "corpus_summary",
    "edge_hits",
    "low_utility_edges",
    "nsn_bridges",
    "csr_rows",
    "degree_stats",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """12,000 memories, 600 of them queries; unit vectors of 64 numbers, so that what hops reach stands among the best."""
    d, rng, n = tmp_path_factory.mktemp("larger"), np.random.default_rng(11), 12_000
    v = rng.normal(size=(n, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": rng.permutation(n), "embedding": list(v), "label": pa.array(np.arange(n) % 10, pa.int32())}), d / "embeddings.parquet")
    ts = 1_700_000_000_000_000 + rng.integers(0, 10**12, n)
    pq.write_table(pa.table({"event_id": np.arange(n), "ts": pa.array(ts, pa.timestamp("us"))}), d / "events.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, tables, name):
    got = catalogue.QUERIES[name](spark, f"file://{tables}").collect()
    with duckdb.connect() as con:
        for t in ("embeddings", "events"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
        want = con.execute(catalogue.SQL[name])
        cols = [c[0] for c in want.description]
        assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(want.fetchall())
