"""Registered queries against their SQL at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from reelspark.plans.entry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
NEW = (
    "video_scan", "video_lookup", "video_metadata", "stream_uploads", "stream_upload_jobs", "stream_spacing_final", "stream_image_dedupe", "choose_k", "softmax_topk", "frames_in_intervals", "frames_in_scenes",
    "pixel_metrics", "pixel_histogram", "pixel_redundancy", "pixel_colours", "pixel_uniform", "stored_job_state", "stored_job_list", "job_list_nested", "deep_analysis", "caption_case", "video_summary",
)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and v != v or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, int)) or hasattr(v, "dtype") and v.dtype.kind in "fiu":
        return round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", NEW)
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    found = QUERIES[name](spark, SF)
    want = tables.sql(SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    got = [tuple(_cell(v) for v in r) for r in found.select(*columns).toPandas().astype(object).itertuples(index=False, name=None)]
    rows = [tuple(_cell(v) for v in r) for r in want.df()[columns].astype(object).itertuples(index=False, name=None)]
    assert len(got) > 0 and sorted(got, key=str) == sorted(rows, key=str)
