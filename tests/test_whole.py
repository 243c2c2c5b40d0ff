"""Queries on a table large enough for several pages, slices and ranges, held against their SQL or a plain version."""

import duckdb
import pytest

from scriptorium.plans import glossary, layout, registry, structure
from scriptorium.runtime import table
from test_queries import TABLES, plain

LARGER = "/root/testdata/sf0.01"


def check(spark, sf, name):
    with duckdb.connect() as con:
        con.execute("SET TimeZone='UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        result = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    df = registry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr) == want


@pytest.mark.parametrize("terms", [10_000, 500])
def test_glossary_of_all_documents(spark, monkeypatch, terms):
    monkeypatch.setattr(glossary, "JSON_TERMS", terms)
    check(spark, LARGER, "glossary_json")


@pytest.mark.parametrize("name", ["bbox_join", "overlap_pairs", "nearest_blocker", "review_upsert", "paragraph_runs", "line_number_merge"])
def test_whole_tables(spark, name):
    check(spark, LARGER, name)


def test_layouts_resolved(spark):
    rows = layout.layouts(spark, LARGER).collect()
    assert len(rows) == sum(table(spark, LARGER, t).count() for t in ("supplier", "customer"))
    want, placed = {}, {}
    for r in sorted(rows, key=lambda r: (r.b.y, r.layout_id)):
        beside = [p for p in placed.setdefault(r.page, []) if p[0] < r.b.x2 and r.b.x < p[1]]
        height = r.b.y2 - r.b.y
        free = [y for y in (r.b.y, *(p[3] for p in beside)) if y >= r.b.y and not any(p[2] < y + height and y < p[3] for p in beside)]
        placed[r.page].append((r.b.x, r.b.x2, min(free), min(free) + height))
        want[r.layout_id] = min(free) - r.b.y
    assert {r.layout_id: r["shift"] for r in structure.overlap_resolution(spark, LARGER).collect()} == want


def test_answers_of_long_conversations(spark, tmp_path):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (tmp_path / "conversations.parquet").unlink()
    turns = [(conv, turn, "user", f"turn {turn} of {conv}: " + 'said \\ "so"\n' * (turn % 40)) for conv in range(3) for turn in range(1, 2_500)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    (made,) = (tmp_path / "made").glob("*.parquet")
    made.rename(tmp_path / "conversations.parquet")
    check(spark, str(tmp_path), "answers_back")
