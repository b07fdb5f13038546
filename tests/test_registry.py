"""Every registered query of the library against its SQL, and its plan for surprises."""

import duckdb
import pytest

from folio.plans import registry

TABLES = "customer orders supplier events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in registry.ORACLES:
        cur = con.execute(registry.ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted((tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in sorted(cols)) for r in rows), key=repr) == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 4
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["txt_blocks", "sentences", "speech_clean", "lang_weights", "page_of_block", "anchor_at_percent", "noted_spans"])
def test_plans_stay_in_the_jvm(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_package_is_shipped_where_workers_lack_it(spark, tmp_path, monkeypatch):
    from folio.plans import shipping

    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    monkeypatch.setattr(shipping, "_DONE", set())
    monkeypatch.setenv("PYTHONPATH", str(shipping.Path(shipping.folio.__file__).parent.parent))
    monkeypatch.chdir(tmp_path)
    shipping.ship(spark)
    assert sent == []
    monkeypatch.delenv("PYTHONPATH")
    shipping.ship(spark)
    shipping.ship(spark)
    assert len(sent) == 1


@pytest.mark.parametrize("name", ["outline_units", "page_document_blocks"])
def test_lines_are_laid_out_once(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
