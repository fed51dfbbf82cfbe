from datetime import UTC, datetime

import pytest

from lumenfold.plans.ingest_queries import QUERIES
from lumenfold.plans.nlq import numeric_date, parse_query, parsed, parsed_table

NOW = datetime(2026, 9, 22, 14, 30, tzinfo=UTC)


def d(*a):
    return datetime(*a, tzinfo=UTC)


CASES = [
    ("find that pdf about quarterly taxes", dict(text="quarterly taxes", file_types=["pdf"])),
    ("where is my gateway project", dict(text="gateway", is_project_query=True)),
    ("screenshots from last week", dict(text="", is_screenshot_query=True, tag_filters=["type:screenshot"], after=d(2026, 9, 14), before=d(2026, 9, 20, 23, 59, 59))),
    ("meeting notes about screenshot tool", dict(is_screenshot_query=False, file_types=["md", "txt", "org"])),
    ("payment qr code", dict(tag_filters=["qr:payment"], is_visual_query=True, text="")),
    ("photo of a sunset", dict(tag_filters=["type:photo"], is_visual_query=True)),
    ("invoice from march", dict(is_visual_query=True, after=d(2026, 3, 1), before=None, text="invoice")),
    ("report in october", dict(after=d(2025, 10, 1), before=d(2025, 10, 31, 23, 59, 59), location_hints=[])),
    ("budget in March 2024", dict(after=d(2024, 3, 1), before=d(2024, 3, 31, 23, 59, 59), text="budget")),
    ("files downloaded yesterday", dict(use_ctime=True, location_hints=["downloads"], after=d(2026, 9, 21), before=d(2026, 9, 21, 23, 59, 59), text="")),
    ("rust code under services", dict(location_hints=["services"], text="")),
    ("parser in lexer folder", dict(location_hints=["lexer"], text="parser")),
    ("logs in vault", dict(location_hints=["vault"], text="logs")),
    ("results in production", dict(location_hints=[], text="results production")),
    ("slides this month", dict(file_types=["pptx", "ppt", "odp"], after=d(2026, 9, 1), before=d(2026, 9, 22, 23, 59, 59))),
    ("notes past 3 days", dict(after=d(2026, 9, 19, 14, 30), before=NOW)),
    ("plans last 2 weeks", dict(after=d(2026, 9, 8, 14, 30), before=NOW)),
    ("summary since 2022", dict(after=d(2022, 1, 1), before=None)),
    ("summary for 2023", dict(after=d(2023, 1, 1), before=d(2023, 12, 31, 23, 59, 59))),
    ("minutes before 2024-05-06", dict(after=None, before=d(2024, 5, 6, 23, 59, 59), text="minutes")),
    ("minutes after 05/06/2024", dict(after=d(2024, 5, 6), before=None)),
    ("this year", dict(after=d(2026, 1, 1), before=d(2026, 12, 31, 23, 59, 59))),
    ("last month", dict(after=d(2026, 8, 1), before=d(2026, 8, 31, 23, 59, 59))),
    ("Übersicht der Prüfung in Köln", dict(text="Übersicht der Prüfung", location_hints=["köln"])),
    ("", dict(text="", raw="")),
]


@pytest.mark.parametrize("query, want", CASES)
def test_rules(query, want):
    got = parse_query(query, NOW)
    assert {k: getattr(got, k) for k in want} == want


def test_has_filters():
    assert parse_query("pdf", NOW).has_filters and not parse_query("alpha beta", NOW).has_filters


def test_numeric_dates():
    assert numeric_date("2024/02/30") is None and numeric_date("1-2-3") is None and numeric_date("12-31-2024") == d(2024, 12, 31)


def test_column_form_equals_the_driver_form(spark, tmp_path):
    queries = [q for q, _ in CASES]
    df = spark.createDataFrame([(q,) for q in [*queries, *queries[:3], None]], "name string")
    got, want = parsed(df, "name", NOW).collect(), parsed_table(spark, queries, NOW).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    df.write.parquet(f"{tmp_path}/projects.parquet")
    assert sorted(r.raw for r in QUERIES["nlq_batch"](spark, str(tmp_path)).collect()) == sorted(queries)
