"""Every registered query against its SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "None"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    a = sorted(tuple(norm(r[c]) for c in names) for r in got.collect())
    b = sorted(tuple(norm(v) for v in r) for r in want.fetchall())
    assert a == b


def test_entry_gives_the_market_index(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "iti_liquido" in df.columns


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", ["bootstrap_incremental", "bootstrap_market", "bootstrap_deltas"])
def test_bootstraps_cover_horizons_metrics_and_resamples(spark, sf, name):
    rows = entry.queries()[name](spark, sf).select("horizon", "metric", "n_bootstrap").collect()
    assert {(r.horizon, r.metric) for r in rows} == {(h, m) for h in (1, 5, 21) for m in ("pearson", "spearman", "r2", "mse")}
    assert max(r.n_bootstrap for r in rows) == 500


def test_entity_articles_name_their_entities(spark, sf):
    from tidemark.plans.queries import PAGE_ENTITIES

    rows = entry.queries()["entity_articles"](spark, sf).collect()
    names = {e[0]: e for e in PAGE_ENTITIES}
    assert rows and all(any(w.lower() in f"{r.titulo} {r.noticia}".lower() for w in (names[r.empresa][0], names[r.empresa][2])) for r in rows)


def test_load_counters_whatever_line_comes_first(spark, tmp_path, sf, duck):
    """A file whose first line is a bad one, and causes that no row has."""
    for name, where in (("bad", "event_id >= 5"), ("few", "event_id in (2, 4)")):
        path = str(tmp_path / name / "events.parquet")
        (tmp_path / name).mkdir()
        duck.execute(f"COPY (SELECT * FROM read_parquet('{sf}/events.parquet') WHERE {where} ORDER BY event_id) TO '{path}' (FORMAT parquet)")
        want = duck.execute(f"WITH events AS (SELECT * FROM read_parquet('{path}')) SELECT * FROM ({entry.oracle_sql()['load_counters']})").fetchall()
        got = entry.queries()["load_counters"](spark, str(tmp_path / name)).collect()
        assert sorted((r.cause, r.rows) for r in got) == sorted(want)


def test_dimension_heuristics_judge_documents_without_text_or_source(spark, tmp_path, duck):
    (tmp_path / "documents.parquet").mkdir()
    path = f"{tmp_path}/documents.parquet/a.parquet"
    texts = "[NULL, '', ' ', chr(10), chr(160), 'Ana SRC1', 'hoje src1']"
    duck.execute(f"""COPY (SELECT row_number() OVER () - 40 AS doc_id, text, source FROM (SELECT unnest({texts}) AS text), (SELECT unnest([NULL, '', ' ', 'src1', 'SRC2']) AS source), range(3)) TO '{path}' (FORMAT parquet)""")
    sql = f"WITH documents AS (SELECT * FROM read_parquet('{path}')) SELECT * FROM ({entry.oracle_sql()['dimension_heuristics']})"
    got = entry.queries()["dimension_heuristics"](spark, str(tmp_path))
    names = [d[0] for d in duck.execute(sql).description]
    assert got.count() == 105 and sorted(tuple(r) for r in got.select(names).collect()) == sorted(duck.execute(sql).fetchall())


def test_dimension_heuristics_make_text_small_once(spark, sf):
    plan = entry.queries()["dimension_heuristics"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat") == 1


def test_page_articles_of_odd_pages(spark, tmp_path, duck):
    """Pages without html, links that can't be read and unknown marked sections."""
    (tmp_path / "pages.parquet").mkdir()
    path = f"{tmp_path}/pages.parquet/a.parquet"
    page = "<a href=\"{}\">x</a><article><h1>Title</h1><p>one{}two</p></article>"
    htmls = [None, "", page.format("http://[x", ""), page.format("//[::1", " "), page.format("/a", "<![foo[x]]>"), page.format("/a", "<![ x>")]
    duck.execute(f"COPY (SELECT row_number() OVER () AS page_id, 'https://site.example/a/b' AS url, html FROM (SELECT unnest(?::VARCHAR[]) AS html)) TO '{path}' (FORMAT parquet)", [htmls])
    sql = f"WITH pages AS (SELECT * FROM read_parquet('{path}')) SELECT * FROM ({entry.oracle_sql()['page_articles']})"
    got = {r.page_id: tuple(r) for r in entry.queries()["page_articles"](spark, str(tmp_path)).select("page_id", "title", "body", "links").collect()}
    assert got == {r[0]: r for r in duck.execute(sql).fetchall()}


def test_references_are_read_with_and_without_their_semicolon(spark):
    """A heading may be cut within one; page parsers read it all the same (the SQL of page_articles only reads &amp so)."""
    from tidemark.sources import pages

    for text, want in (("&quot", '"'), ("&lt", "<"), ("&gt", ">"), ("&amp", "&"), ("&quo", "&quo"), ("&am", "&am"), ("&quot;", '"')):
        assert pages.parse(f"<h1>a {text}</h1>")["title"] == f"a {want}"
