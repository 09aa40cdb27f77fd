"""Tables: writes, constraints, references, versions and transactions."""

import pytest

from loomql import Engine, EngineError, RuntimeFault, SemanticFault
from loomql.repl import run as repl


@pytest.fixture
def run(engine):
    def one(text):
        found = None
        for found in engine.run_script(text):
            if isinstance(found, EngineError):
                raise found
        return found.rows() if found.is_query else found.message

    one.engine = engine
    return one


def test_put_fetch_and_three_valued_filters(run):
    assert run("BUILD RELATION lamp (no INT, place TEXT, lit BOOL); PUT INTO lamp VALUES (11,'hall',TRUE),(12,'stair',FALSE)") == "PUT 0 2"
    run("PUT INTO lamp (no, place) VALUES (15, 'attic')")
    assert run("FETCH place FROM lamp WHEN lit") == [("hall",)]
    assert run("FETCH no FROM lamp WHEN lit IS NULL") == [(15,)]
    assert run("REMOVE FROM lamp WHEN NOT lit") == "REMOVE 1"
    assert run("FETCH no FROM lamp SORT BY no") == [(11,), (15,)]


def test_groups_and_first_rows(run):
    run("BUILD RELATION crop (no INT, field TEXT, tons INT); PUT INTO crop VALUES (7,'north',31),(8,'north',12),(9,'south',25),(10,'south',NULL)")
    assert run("FETCH field, no, SUM(tons) FROM crop GROUP BY field SORT BY field") == [("north", 7, 43), ("south", 9, 25)]
    assert run("FETCH field FROM crop GROUP BY field HAVING SUM(tons) > 30") == [("north",)]
    assert run("FETCH COUNT(tons) AS c, SUM(tons) AS s FROM crop WHEN no > 99") == [(0, None)]


def test_all_or_nothing_and_constraints(run):
    run("BUILD RELATION t (id INT PRIMARY KEY, s VARCHAR(3), n INT CHECK (n > 0)); PUT INTO t VALUES (1, 'ab', 5)")
    for text, message in [
        ("PUT INTO t VALUES (2, 'x', 1), (1, 'y', 1)", "UNIQUE constraint failed: t.id"), ("PUT INTO t VALUES (3, 'x', 1), (3, 'y', 1)", "UNIQUE constraint failed: t.id"), ("PUT INTO t (s, n) VALUES ('x', 1)", "NOT NULL constraint failed: t.id"),
        ("PUT INTO t VALUES (2, 'éé', 1)", "value too long for column 's' (max 3)"), ("PUT INTO t VALUES (2, 'x', 0)", "CHECK constraint failed: t.n"), ("PUT INTO t VALUES (2, 'x', NULL)", "CHECK constraint failed: t.n"),
        ("MODIFY t SET n = 0 - n", "CHECK constraint failed: t.n"),
    ]:
        with pytest.raises(RuntimeFault) as e:
            run(text)
        assert message in str(e.value)
    for text in ["PUT INTO t VALUES ('x', 'y', 1)", "PUT INTO t VALUES (1)", "PUT INTO t VALUES (2, 'x', 1.5)", "MODIFY t SET nope = 1", "MODIFY t SET s = 1", "PUT INTO t VALUES (9,'a',1) ON CONFLICT (s) DO NOTHING", "BUILD RELATION t (a INT)", "BUILD RELATION u (a TEXT AUTO_INCREMENT)", "DISCARD VIEW t"]:
        with pytest.raises(SemanticFault):
            run(text)
    assert run("FETCH * FROM t") == [(1, "ab", 5)]


def test_composite_key_and_upsert_on_it(run):
    run("BUILD RELATION c (a INT, b INT, note TEXT, PRIMARY KEY (a, b)); PUT INTO c VALUES (1,1,'x'),(1,2,'y')")
    with pytest.raises(RuntimeFault, match="PRIMARY KEY constraint failed: c"):
        run("PUT INTO c VALUES (1,1,'dup')")
    with pytest.raises(RuntimeFault, match="NOT NULL"):
        run("PUT INTO c (a, note) VALUES (5, 'q')")
    assert run("PUT INTO c VALUES (1,2,'n'), (2,2,'z') ON CONFLICT (a, b) DO MODIFY SET note = UPPER(note) RETURNING note") == [("Y",), ("z",)]


def test_references_and_actions(run):
    run("BUILD RELATION p (id INT PRIMARY KEY); BUILD RELATION r (id INT, p INT REFERENCES p(id)); PUT INTO p VALUES (1),(2); PUT INTO r VALUES (1, 1), (2, NULL)")
    with pytest.raises(RuntimeFault, match="value not present in p"):
        run("PUT INTO r VALUES (3, 9)")
    for text in ("REMOVE FROM p WHEN id = 1", "MODIFY p SET id = 7 WHEN id = 1"):
        with pytest.raises(RuntimeFault, match="row is referenced by table 'r'"):
            run(text)
    assert run("REMOVE FROM p WHEN id = 2") == "REMOVE 1"
    run("BUILD RELATION tree (id INT PRIMARY KEY, up INT REFERENCES tree(id) ON REMOVE CASCADE); PUT INTO tree VALUES (1, NULL), (2, 1), (3, 2), (4, NULL); REMOVE FROM tree WHEN id = 1")
    assert run("FETCH id FROM tree") == [(4,)]


def test_versions_views_and_garbage(run):
    run("BUILD RELATION t (id INT, v INT); PUT INTO t VALUES (1, 10), (2, 20)")
    first = run.engine.version
    run("MODIFY t SET v = v + 1 WHEN id = 1; BUILD VIEW big AS FETCH id, v FROM t WHEN v > 10")
    assert run("MODIFY t SET v = 0 WHEN id = 99") == "MODIFY 0" and run.engine.version == first + 1
    run("REMOVE FROM t WHEN id = 2")
    assert run(f"FETCH v FROM t AS OF {first} SORT BY id") == [(10,), (20,)]
    assert run(f"FETCH id FROM big AS OF {first + 1} SORT BY id") == [(1,), (2,)] and run("FETCH id FROM big") == [(1,)]
    assert run("FETCH v FROM t AS OF 0") == []
    run("RESHAPE RELATION t ADD w TEXT")
    assert run("FETCH * FROM t") == [(1, 11, None)] and run(f"FETCH * FROM t AS OF {first} SORT BY id") == [(1, 10), (2, 20)]
    assert run.engine.collect_garbage() > 0
    assert run(f"FETCH id FROM t AS OF {first}") == [(1,)] and run("FETCH COUNT(*) FROM t") == [(1,)]


def test_transactions_are_isolated_and_the_first_to_commit_wins(run, spark):
    run("BUILD RELATION t (id INT); BUILD RELATION u (id INT); PUT INTO t VALUES (1)")
    other = Engine(spark, run.engine._warehouse)
    run("START; PUT INTO t VALUES (2)")
    assert run("FETCH COUNT(*) FROM t") == [(2,)] and other.execute("FETCH COUNT(*) FROM t").rows() == [(1,)]
    other.execute("PUT INTO u VALUES (5)")
    assert run("FETCH COUNT(*) FROM u") == [(0,)]
    run("SAVE")
    assert run("FETCH COUNT(*) FROM u") == [(1,)] and other.execute("FETCH COUNT(*) FROM t").rows() == [(2,)]
    run("START; REMOVE FROM t WHEN id = 1")
    other.execute("PUT INTO t VALUES (3)")
    with pytest.raises(RuntimeFault, match="changed by another transaction"):
        run("SAVE")
    assert run("FETCH COUNT(*) FROM t") == [(3,)]
    assert run("SAVE") == "WARNING: no transaction in progress" and run("START") == "START" and run("START") == "WARNING: already in a transaction" and run("UNDO") == "UNDO"


def test_a_change_leaves_other_parts_alone(run):
    run("BUILD RELATION t (id INT, v INT); PUT INTO t VALUES (1, 1); PUT INTO t VALUES (2, 2); PUT INTO t VALUES (3, 3)")
    before = run.engine.catalog.tables["t"]["snapshots"][-1]["parts"]
    run("MODIFY t SET v = 9 WHEN id = 2")
    after = run.engine.catalog.tables["t"]["snapshots"][-1]["parts"]
    assert [p for p in before if p in after] == [before[0], before[2]]
    assert run("FETCH v FROM t SORT BY id") == [(1,), (9,), (3,)]


def _opened(run, text):
    """The files that a query's scan lists."""
    return len(run.engine.frame(text).inputFiles())


def test_lookups_open_only_parts_that_may_hold_them(run):
    run("BUILD RELATION t (id INT PRIMARY KEY, f FLOAT, s TEXT, note TEXT); BUILD INDEX i ON t (s); BUILD INDEX j ON t (f)")
    for k in range(4):
        run(f"PUT INTO t VALUES ({10 * k}, {k}.5, 'k{k}', 'a'), ({10 * k + 5}, NULL, 'k{k}x', 'b')")
    for when, files in [
        ("id = 15", 1), ("15 = id", 1), ("id > 10 AND id <= 20", 2), ("id BETWEEN 5 AND 10", 2), ("id IN (0, 15)", 2), ("id = 7", 0), ("id = 99", 0), ("id = 5 AND id = 15", 0), ("f < 1", 1), ("f >= 3.5", 1), ("s = 'k2x'", 1),
        ("s > 'k2x'", 2), ("id = 15 OR id = 25", 4), ("NOT id = 15", 4), ("note = 'a'", 4), ("id = 15.0", 1), ("id + 0 = 15", 4),
    ]:
        assert _opened(run, f"FETCH id FROM t WHEN {when}") == files, when
        want = run(f"FETCH id FROM t WHEN ({when}) = TRUE SORT BY id")  # not a conjunction: reads all
        assert run(f"FETCH id FROM t WHEN {when} SORT BY id") == want, when
    assert run("FETCH a.id, b.id FROM t a LEFT LINK t b ON a.id = b.id + 5 WHEN b.id = 10") == [(15, 10)]
    assert run("FETCH a.id FROM t a LEFT LINK t b ON a.id = b.id + 1 WHEN b.id IS NULL AND a.id < 10 SORT BY a.id") == [(0,), (5,)]
    before = run.engine.catalog.tables["t"]["snapshots"][-1]["parts"]
    assert run("MODIFY t SET id = 16 WHEN id = 15") == "MODIFY 1"
    after = run.engine.catalog.tables["t"]["snapshots"][-1]["parts"]
    assert len(set(before) & set(after)) == 3
    with pytest.raises(RuntimeFault, match="UNIQUE constraint failed: t.id"):
        run("PUT INTO t VALUES (16, 0, '', '')")
    assert run("PUT INTO t VALUES (25, 0, '', ''), (26, 0, '', '') ON CONFLICT (id) DO MODIFY SET note = 'c'") == "PUT 0 2"
    assert run("FETCH id FROM t WHEN note = 'c'") == [(25,)] and run("FETCH COUNT(*) FROM t WHEN id = 26") == [(1,)]


def test_an_index_measures_parts_that_are_there(run):
    run("BUILD RELATION t (id INT, v INT); PUT INTO t VALUES (1, 1); PUT INTO t VALUES (2, NULL); RESHAPE RELATION t ADD w TEXT; PUT INTO t VALUES (3, 3, 'z')")
    version = run.engine.version
    assert _opened(run, "FETCH id FROM t WHEN v = 3") == 3
    run("BUILD INDEX i ON t (v, w)")
    assert run.engine.version == version and _opened(run, "FETCH id FROM t WHEN v = 3") == 1 and _opened(run, "FETCH id FROM t WHEN w = 'z'") == 1
    assert run("FETCH id FROM t WHEN v IS NULL") == [(2,)] and run(f"FETCH id FROM t AS OF {version - 1} WHEN v = 1") == [(1,)]
    run(f"PUT INTO t VALUES (4, 4, '{'z' * 99}')")
    assert run(f"FETCH id FROM t WHEN w = '{'z' * 99}'") == [(4,)]


def test_many_small_inserts_are_put_together(run, monkeypatch):
    from loomql.operators import dml

    monkeypatch.setattr(dml, "MOST_SMALL", 3)
    run("BUILD RELATION t (id INT AUTO_INCREMENT, v INT)")
    for k in range(6):
        run(f"PUT INTO t (v) VALUES ({k})")
    assert len(run.engine.catalog.tables["t"]["snapshots"][-1]["parts"]) <= 4
    assert run("FETCH id, v FROM t SORT BY id") == [(k + 1, k) for k in range(6)]
    assert run("FETCH id FROM t AS OF 2 SORT BY id") == [(1,), (2,)]
    run.engine.collect_garbage()
    assert run("FETCH COUNT(*) FROM t") == [(6,)]


def test_a_new_session_finds_everything(run, spark):
    run("BUILD RELATION t (id INT AUTO_INCREMENT, d DATE, n FLOAT DEFAULT 2.5); PUT INTO t (d) VALUES ('2024-03-01'); BUILD VIEW v AS FETCH d FROM t WHEN d > '2024-01-01'; BUILD INDEX i ON t (id)")
    again = Engine(spark, run.engine._warehouse)
    assert again.execute("FETCH * FROM t").rows() == [(1, "2024-03-01", 2.5)] and again.execute("FETCH d FROM v").rows() == [("2024-03-01",)]
    assert again.version == 1 and "i" in again.catalog.indexes
    assert again.execute("EXPLAIN FETCH d FROM t WHEN id = 1").rows() == [("Filter",), ("  Index Scan on t",)]


def test_explain_labels(run):
    run("BUILD RELATION t (id INT, v INT)")
    assert run("EXPLAIN FETCH COUNT(*) FROM t WHEN v > 1") == [("Aggregate (Vectorized, Data Skipping)",), ("  Filter",), ("    Seq Scan on t",)]
    assert run("EXPLAIN FETCH v, COUNT(*) FROM t GROUP BY v") == [("GroupAggregate",), ("  Seq Scan on t",)]
    assert run("EXPLAIN FETCH a.v FROM t a LINK t b ON a.id = b.id") == [("Inner Join (Hash)",), ("  Seq Scan on t",), ("  Seq Scan on t",)]
    assert run("EXPLAIN FETCH a.v FROM t a LEFT LINK t b ON a.id < b.id") == [("Left Join (Nested Loop)",), ("  Seq Scan on t",), ("  Seq Scan on t",)]


def test_repl(engine):
    shown = []
    repl(engine, ["BUILD RELATION t (id INT, s TEXT);\n", "PUT INTO t\n", "VALUES (1, 'a;b');\n", "FETCH * FROM t;\n", "\\v\n", "FETCH x FROM t;\n", "\\q\n", "FETCH * FROM t;\n"], shown.append)
    assert shown == ["BUILD RELATION", "PUT 0 1", "id |   s\n---+----\n 1 | a;b\n(1 row)", "version 1", "ERROR  semantic error: unknown column 'x' in table 't'"]
