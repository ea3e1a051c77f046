from collections import defaultdict

import pytest
from compare import database, difference
from conftest import SMALL

from corpusloom.llm import line_dedup as L
from corpusloom.llm import queries

SPACES = " \t\n\x0b\x0c\r"


def expected(rows, min_sites):
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(SPACES) and s is not None:
                sites[line.strip(SPACES)].add(s)
    made = []
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if len(sites.get(x.strip(SPACES), ())) < min_sites]
        made.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(made, key=str)


def actual(df):
    return sorted(((r["row"]["doc_id"], r["kept_text"], r["n_lines"], r["n_removed"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("min_sites", [1, 2, 3, 5])
def test_odd_rows(spark, odd, odd_rows, clashing, min_sites):
    more = [(300 + i, f"shared\n own {i}\n\n  few {i % 3}\r", "en", f"site{i % 9}", 3) for i in range(30)]
    rows = [*odd_rows, *more]
    docs = clashing(spark.createDataFrame(rows, odd.schema))
    found = L.remove_shared_lines(docs, min_sites)
    assert actual(found) == expected([(r[0], r[1], r[3]) for r in rows], min_sites)
    assert found.select("row.*").columns == docs.columns


def test_clear_and_near_lines_agree(spark):
    """A line on n sites leaves exactly if n reaches the threshold, in or out of the band that is counted."""
    rows = [(n * 100 + s, f"on {n}", f"s{s}") for n in range(1, 40) for s in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = L.remove_shared_lines(docs, 20)
    assert actual(found) == expected(rows, 20)


def hot(n):
    """A line on a third of all rows and few sites, one on many sites, and one near the threshold."""
    rows = [(i, "hot\n" * (i % 3 == 0) + f"own {i}\n" + "wide\n" * (i % 7 == 0) + "near" * (i % 40 < 10), f"s{i % 40}") for i in range(n)]
    return [(i, t if i % 3 else t + "\nhot", f"s{i % 3}" if i % 3 == 0 else s) for i, t, s in rows]


@pytest.mark.parametrize("filtered", [0, 2000])
@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_either_way_is_the_same(spark, monkeypatch, filtered, sent):
    """Few lines filtered in the scan or many joined, near ones sent or merged, without any broadcast."""
    monkeypatch.setattr(L, "FILTERED_LINES", filtered)
    monkeypatch.setattr(L, "SENT_LINES", sent)
    rows = hot(600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert actual(L.remove_shared_lines(docs, 10)) == expected(rows, 10)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_come_before_any_pair_moves(spark, monkeypatch):
    """What is exchanged for the estimate is a sketch per line, and texts aren't exchanged to remove few lines."""
    plans = []
    real = L.materialize

    def keep(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(L, "materialize", keep)
    docs = spark.createDataFrame(hot(100), "doc_id bigint, text string, source string")
    found = L.remove_shared_lines(docs, 10)
    name, plan = plans[0]
    assert name == "line-sites" and plan.count("Exchange hashpartitioning(line") == 1
    assert not any("site" in line for line in plan.splitlines() if "Exchange" in line) and "Join" not in plan
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty(empty):
    assert L.remove_shared_lines(empty).count() == 0


def test_query_and_statement(spark):
    found = queries.op8_line_dedup(spark, SMALL).toPandas()
    assert difference(found, database(SMALL).execute(queries.oracle_sql()["op8_line_dedup"]).df()) is None
