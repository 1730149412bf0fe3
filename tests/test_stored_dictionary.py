"""The stored dictionary: only touched folders are rewritten, and versions are checked."""

import os

import pytest

from tablegauge.operators import dictionary as T


def entry(schema, column, version=1, active=True, source="llm_initial", name="n"):
    return ("db", schema, "t", column, version, active, "note", name, "d", None, "string", ["x"], ["tag"], source)


def entries(spark, rows):
    return spark.createDataFrame(rows, T.ENTRY_SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")}


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    rows = [entry(s, c, source="human_edited" if c == "b" else "llm_initial") for s in ("2024", "one", None) for c in "abc"]
    assert T.write_dictionary(entries(spark, rows), path) == 1
    return path, rows


def test_merge_rewrites_only_what_it_touches(spark, base):
    path, rows = base
    before = files(path)
    fields = "database_name string, schema_name string, table_name string, column_name string, business_name string, business_description string, " \
             "technical_description string, data_type string, examples array<string>, tags array<string>, source string"
    incoming = spark.createDataFrame([("db", "2024", "t", c, "new", "d", "x", "int", None, None, None) for c in "abz"]
                                     + [("db", "fresh", "t", "q", "new", "d", "x", "int", None, None, None)], fields)
    want = rows_of(T.upsert_dictionary(entries(spark, rows), incoming))
    assert T.merge_stored(spark, path, incoming, expected=1) == 2
    assert rows_of(T.read_dictionary(spark, path)) == want
    after = files(path)
    kept = {f for f in before if "schema_name=2024" not in f}
    assert kept and all(after[f] == before[f] for f in kept) and not any(f in after for f in before if "schema_name=2024" in f)


def test_edits_and_activation(spark, base):
    path, rows = base
    edits = spark.createDataFrame([("db", "one", "t", "a", "edited")], "database_name string, schema_name string, table_name string, column_name string, business_name string")
    want = rows_of(T.apply_edits(entries(spark, rows), edits))
    assert T.edit_stored(spark, path, edits) == 2 and rows_of(T.read_dictionary(spark, path)) == want
    chosen = spark.createDataFrame([("db", "one", "t", "a", 1)], "database_name string, schema_name string, table_name string, column_name string, version_number int")
    assert T.activate_stored(spark, path, chosen, expected=2) == 3
    state = {r.version_number: r.is_active for r in T.read_dictionary(spark, path).collect() if (r.schema_name, r.column_name) == ("one", "a")}
    assert state == {1: True, 2: False}


def test_stale_writers_are_refused(spark, base):
    path, rows = base
    edits = spark.createDataFrame([("db", "one", "t", "a", "x")], "database_name string, schema_name string, table_name string, column_name string, business_name string")
    assert T.edit_stored(spark, path, edits, expected=1) == 2
    before = rows_of(T.read_dictionary(spark, path))
    with pytest.raises(T.StaleVersion):
        T.edit_stored(spark, path, edits, expected=1)
    T._mark(spark, path, "claim-3")  # another writer is at it, or was broken off
    with pytest.raises(T.StaleVersion):
        T.edit_stored(spark, path, edits)
    with pytest.raises(T.StaleVersion):
        T.write_dictionary(entries(spark, rows), path)
    assert rows_of(T.read_dictionary(spark, path)) == before and T.dictionary_version(spark, path) == 2


def test_no_dictionary(spark, tmp_path):
    path = str(tmp_path / "none")
    assert T.dictionary_version(spark, path) == 0
    with pytest.raises(T.StaleVersion):
        T.activate_stored(spark, path, entries(spark, []))
