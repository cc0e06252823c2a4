"""Snapshot queries take every page: none is left out for want of a render request."""
from pagemark.plans import registry

NAMES = ("snapshot_cadence", "snapshot_stable", "render_eligibility", "stream_snapshots")


def test_every_page_has_its_render_request(spark, tmp_path):
    rows = [(i, f"http://h.test/{i}", f"<p>text of {i}</p>") for i in (5, 6, 7, 23)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in NAMES:
        got = {r["url"] for r in registry.queries()[name](spark, str(tmp_path)).select("url").distinct().collect()}
        assert got == {u for _, u, _ in rows}, name


def test_other_twins_keep_their_requests():
    for name in ("outcomes", "stream_capture_scan"):
        assert "FROM pages WHERE page_id % 17 <> 6 " in registry.oracle_sql()[name]
    assert all("% 17" not in registry.oracle_sql()[name] for name in NAMES)
