"""The derived pages show every check."""

import glob
import os

import duckdb

from pagestrata.plans import catalogue
from pagestrata.plans.check_catalog import SEVERITY


def test_every_check_has_findings_and_pages_without():
    """By the checking SQL; that the engine gives the same rows is what the correctness run compares."""
    folder = os.environ.get("TEST_DERIVED_DIR", "/root/testdata/sf0.01")
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    names = ["derived_row_checks", "derived_duplicates", "derived_canonical_checks", "derived_hreflang_checks", "derived_sitemap_checks", "derived_robots_checks", "link_checks"]
    seen = set()
    for name in names:
        seen |= set(con.execute(f'SELECT DISTINCT category, "check" FROM ({catalogue.ORACLE[name]})').fetchall())
    assert seen == set(SEVERITY)
    pages = con.execute("SELECT count(DISTINCT page_id) FROM page_data").fetchone()[0]
    every = con.execute(f'SELECT category, "check", count(DISTINCT url) FROM ({catalogue.ORACLE["derived_row_checks"]}) GROUP BY ALL').fetchall()
    assert all(n < pages for _, _, n in every)
