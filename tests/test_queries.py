"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["scan_cells", "scan_expr", "scan_layer", "labels_single", "labels_multi", "ordered_perturbations", "guides", "active_set_groups", "cluster_codes", "normalize", "group_moments", "welch_t", "topk_abs", "union_targets", "hvg_targets", "cluster_background", "clip_histogram", "clip_values", "exact_quantiles", "cooccurrence", "xty", "dense_summary", "ps_score_single", "beta_multilabel", "ps_score_multilabel", "ps_score_multilabel_background", "effect_grams", "welch_of_dense_rows", "exact_clip"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("" if v is None or v != v else f"{round(v, 6):g}" if isinstance(v, float) else str(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(con.sql(entry.oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """The smallest tables with the same single part in every order: no gene differs between groups, so none is a target."""
    folder = tmp_path_factory.mktemp("alike")
    for t in ("customer", "orders", "part"):
        os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    lines = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey as l_orderkey", "1L as l_partkey", "1.0D as l_quantity")
    lines.toPandas().to_parquet(folder / "lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["ps_score_multilabel_background", "target_metadata", "effect_grams", "long_table", "ps_score_multilabel"])
def test_query_equals_sql_without_target_genes(spark, alike, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "part", "lineitem"):
        con.sql(f"create view {t} as from '{alike}/{t}.parquet'")
    assert plain(entry.queries()[name](spark, alike).toPandas()) == plain(con.sql(entry.oracle_sql()[name]).df())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
