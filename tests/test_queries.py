"""Queries against their SQL twins on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spliceloom.plans import roster

DATA = "/root/testdata/sf0.001"
NAMES = [
    "tx_from_exons", "super_clusters", "merge_exact_chain", "wobble_components", "mono_components", "terminal_anchor_split_both", "repr_junction_major", "repr_tes_major", "repr_tss_guided",
    "nc_absorption", "junction_and_exon_diffs", "merge_guided_both", "merge_track", "preclass", "associated_hits", "classify_full", "nearest_cage", "nearest_polya", "downstream_a", "polya_motif", "chop_attrs", "valtable",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(columns, data):
    fold = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(fold(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, db, name):
    df = roster.queries()[name](spark, DATA)
    want = db.sql(roster.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_partitions_do_not_matter(spark):
    one = rows(["x"], [(str(r),) for r in roster.queries()["merge_default"](spark, DATA).collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert one == rows(["x"], [(str(r),) for r in roster.queries()["merge_default"](spark, DATA).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(roster.oracle_sql()) <= set(roster.queries())
