"""The data dictionary: versions, edits, sync, search and context texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, nan_to_null, numeric_columns, temporal_columns, text_columns
from tablegauge.operators.profile import profile_table
from tablegauge.session import materialize

KEY = ("database_name", "schema_name", "table_name", "column_name")
# Field names and default texts of dictionary entries.
DESCRIBED = ("business_name", "business_description", "technical_description", "data_type", "examples", "tags")
ENTRY = (*KEY, "version_number", "is_active", "version_notes", *DESCRIBED, "source")
ENTRY_SCHEMA = ("database_name string, schema_name string, table_name string, column_name string, version_number int, is_active boolean, "
                "version_notes string, business_name string, business_description string, technical_description string, data_type string, "
                "examples array<string>, tags array<string>, source string")
HUMAN_SOURCE = "human_edited"
DEFAULT_SOURCE = "llm_initial"
FIRST_NOTES = "Initial documentation"
UPDATE_NOTES = "Updated by AI analysis"
EDIT_NOTES = "Manual edit - new version"
MACHINE_PREFIX = "llm"
DEFAULT_TIER = "experimental"
DEFAULT_SCORE = 50


def _entry(prefix: str, **changed: Column) -> Column:
    return F.struct(*[changed.get(c, F.col(f"{prefix}.{c}")).alias(c) for c in ENTRY])


def _both(old: Column, new: Column) -> Column:
    return F.inline(F.filter(F.array(old, new), lambda r: r.isNotNull()))


def upsert_dictionary(current: DataFrame, incoming: DataFrame, create_new_version: bool = False) -> DataFrame:
    """The dictionary after taking in ``incoming``, at most one row per column.

    A column without an active entry gets version 1. An active entry is
    replaced by a next version if that is asked for or a person edited it;
    otherwise it is overwritten in place. One full outer join yields kept,
    changed and new rows alike.
    """
    active = F.col("c.is_active")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}")) for k in KEY] + [active]
    joined = current.select(*ENTRY).alias("c").join(
        incoming.alias("i"), [c for c in on], "full_outer")
    is_old, is_new = F.col("c.version_number").isNotNull(), F.col("i.column_name").isNotNull()
    versioned = is_old & is_new & (F.lit(create_new_version) | (F.col("c.source") == HUMAN_SOURCE))
    fresh = {c: F.col(f"i.{c}") for c in DESCRIBED}
    fresh["examples"] = F.coalesce("i.examples", F.array().cast("array<string>"))
    fresh["tags"] = F.coalesce("i.tags", F.array().cast("array<string>"))
    fresh["source"] = F.coalesce("i.source", F.lit(DEFAULT_SOURCE))
    keys = {k: F.col(f"i.{k}") for k in KEY}
    kept = (F.when(is_old & ~is_new, _entry("c"))
            .when(versioned, _entry("c", is_active=F.lit(False)))
            .when(is_old & is_new, _entry("c", **fresh)))
    added = F.when(versioned | ~is_old, _entry(
        "c", **keys, **fresh, is_active=F.lit(True),
        version_number=F.coalesce(F.col("c.version_number") + 1, F.lit(1)).cast("int"),
        version_notes=F.when(is_old, UPDATE_NOTES).otherwise(FIRST_NOTES)))
    return joined.select(_both(kept, added))


def apply_edits(entries: DataFrame, edits: DataFrame, create_new_version: bool = True) -> DataFrame:
    """Apply a batch of human edits to the active entries of the edited columns.

    NULL in an edit keeps the old value. The edit makes the next version, or
    changes the entry in place.
    """
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in KEY] + [F.col("c.is_active")]
    joined = entries.select(*ENTRY).alias("c").join(edits.alias("e"), on, "left")
    edited = F.col("e.column_name").isNotNull()
    available = set(edits.columns)
    changed = {c: F.coalesce(F.col(f"e.{c}"), F.col(f"c.{c}"))
               for c in ("business_name", "business_description", "technical_description", "tags")
               if c in available}
    if not create_new_version:
        changed["source"] = F.when(F.col("c.source").startswith(MACHINE_PREFIX), HUMAN_SOURCE).otherwise(F.col("c.source"))
        return joined.select(F.when(edited, _entry("c", **changed)).otherwise(_entry("c")).alias("r")).select("r.*")
    changed["source"] = F.lit(HUMAN_SOURCE)
    notes = F.coalesce("e.version_notes", F.lit(EDIT_NOTES)) if "version_notes" in available else F.lit(EDIT_NOTES)
    kept = F.when(edited, _entry("c", is_active=F.lit(False))).otherwise(_entry("c"))
    added = F.when(edited, _entry(
        "c", **changed, is_active=F.lit(True), version_number=(F.col("c.version_number") + 1).cast("int"),
        version_notes=notes))
    return joined.select(_both(kept, added))


def activate_versions(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Make the chosen versions active and every sibling version inactive.

    ``chosen`` has the key columns and ``version_number``, one row per column.
    """
    picked = chosen.select(*KEY, F.col("version_number").alias("_chosen"))
    joined = entries.join(picked, list(KEY), "left")
    flag = F.when(F.col("_chosen").isNull(), F.col("is_active")).otherwise(
        F.col("version_number") == F.col("_chosen"))
    return joined.withColumn("is_active", flag).select(*entries.columns)


# --- the dictionary as a stored table --------------------------------------------------------------------------------

PLACE = ("database_name", "schema_name")


class StaleVersion(RuntimeError):
    """Another change of the stored dictionary came first, or one was broken off."""


def _folder(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _markers(spark: SparkSession, path: str) -> set[str]:
    fs, folder = _folder(spark, path, "_versions")
    return {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()


def _mark(spark: SparkSession, path: str, name: str) -> bool:
    """Make a marker file; False if it is there already. Creating a file is atomic, so one of two writers wins."""
    fs, marker = _folder(spark, path, "_versions", name)
    return fs.createNewFile(marker)


def dictionary_version(spark: SparkSession, path: str) -> int:
    """Number of the last finished change of the stored dictionary; 0 if there is none."""
    return max((int(m.split("-")[1]) for m in _markers(spark, path) if m.startswith("done-")), default=0)


def write_dictionary(entries: DataFrame, path: str) -> int:
    """Store a dictionary by database and schema as version 1; an existing one is an error."""
    spark = entries.sparkSession
    if not _mark(spark, path, "claim-1"):
        raise StaleVersion(f"there is a dictionary at {path}")
    entries.select(*ENTRY).write.mode("append").partitionBy(*PLACE).parquet(path)
    _mark(spark, path, "done-1")
    return 1


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY_SCHEMA).parquet(path).select(*ENTRY)


def _change(spark: SparkSession, path: str, changes: DataFrame, expected: int | None, apply: Callable[[DataFrame], DataFrame]) -> int:
    """Rewrite the database and schema folders that ``changes`` touches, and no others, as the next version.

    The new content is complete before the version is claimed, so a failed computation changes nothing; of two writers of
    one version the second gets ``StaleVersion`` and may try again.
    """
    version = dictionary_version(spark, path)
    if version == 0 or expected not in (None, version):
        raise StaleVersion(f"the dictionary has version {version}, not {expected}")
    touched = changes.select(*PLACE).distinct()
    current = read_dictionary(spark, path).alias("c").join(
        touched.alias("t"), [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in PLACE], "left_semi")
    made = materialize(apply(current).select(*ENTRY), "dictionary")
    if not _mark(spark, path, f"claim-{version + 1}"):
        raise StaleVersion(f"version {version + 1} was claimed by another writer")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)
    _mark(spark, path, f"done-{version + 1}")
    return version + 1


def merge_stored(spark: SparkSession, path: str, incoming: DataFrame, create_new_version: bool = False,
                 expected: int | None = None) -> int:
    """``upsert_dictionary`` on the stored dictionary; returns the new version. ``expected`` is the version it was read at."""
    return _change(spark, path, incoming, expected, lambda current: upsert_dictionary(current, incoming, create_new_version))


def edit_stored(spark: SparkSession, path: str, edits: DataFrame, create_new_version: bool = True, expected: int | None = None) -> int:
    """``apply_edits`` on the stored dictionary; returns the new version."""
    return _change(spark, path, edits, expected, lambda current: apply_edits(current, edits, create_new_version))


def activate_stored(spark: SparkSession, path: str, chosen: DataFrame, expected: int | None = None) -> int:
    """``activate_versions`` on the stored dictionary; returns the new version."""
    return _change(spark, path, chosen, expected, lambda current: activate_versions(current, chosen))


def active_entries(entries: DataFrame, database: str, schema: str, tables: Sequence[str],
                   active_only: bool = True) -> DataFrame:
    found = entries.filter((F.col("database_name") == database) & (F.col("schema_name") == schema)
                           & F.col("table_name").isin(*tables))
    return found.filter("is_active") if active_only else found


def version_history(entries: DataFrame, *key: str) -> DataFrame:
    """All versions of one column, newest first."""
    for name, value in zip(KEY, key):
        entries = entries.filter(col(name) == value)
    return entries.orderBy(F.col("version_number").desc())


def context_markdown(entries: DataFrame) -> DataFrame:
    """The entries of each table as one markdown text.

    The text holds one line group per column of the table, so a group is as
    wide as a table's schema.
    """
    note = F.when(F.length("business_description") > 0, F.concat(F.lit("\n  - "), F.col("business_description")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\n  - Tags: "), F.array_join("tags", ", ")))
    block = F.concat(F.lit("**"), F.col("column_name"), F.lit("** ("), F.coalesce("data_type", F.lit("unknown")),
                     F.lit(")"), F.coalesce(note, F.lit("")), F.coalesce(tags, F.lit("")), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("column_name", block.alias("b")))), lambda s: s["b"])
    return entries.groupBy("schema_name", "table_name").agg(lines.alias("l")).select(
        "schema_name", "table_name",
        F.concat(F.lit("## "), F.col("schema_name"), F.lit("."), F.col("table_name"), F.lit("\n\n"),
                 F.array_join("l", "\n")).alias("context"))


def friendly_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def sync_dictionary(fields: DataFrame, catalog: DataFrame) -> DataFrame:
    """Take structure from the catalog and keep what people wrote.

    Both frames are keyed by schema_name, table_name, column_name. New columns
    get a default name, tier and score; known ones only a new position, type
    and nullability; columns gone from the catalog stay as they are.
    """
    key = ["schema_name", "table_name", "column_name"]
    f, c = fields.alias("f"), catalog.alias("c")
    joined = f.join(c, key, "full_outer")
    fresh = lambda n: F.coalesce(F.col(f"c.{n}"), F.col(f"f.{n}")).alias(n)
    return joined.select(
        *key, fresh("ordinal_position"), fresh("data_type"), fresh("is_nullable"),
        F.coalesce("f.business_name", friendly_name(F.col("column_name"))).alias("business_name"),
        F.col("f.business_definition").alias("business_definition"),
        F.coalesce("f.trust_tier", F.lit(DEFAULT_TIER)).alias("trust_tier"),
        F.coalesce("f.trust_score", F.lit(DEFAULT_SCORE)).alias("trust_score"))


def search_assets(assets: DataFrame, term: str | None = None, tier: str | None = None,
                  domain: str | None = None, schema: str | None = None,
                  limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of matching assets, each with the total number of matches."""
    found = assets
    if schema:
        found = found.filter(F.col("schema_name") == schema)
    if term:
        # ``%`` and ``_`` in the term are wildcards, as in any ILIKE pattern.
        pattern = f"%{term}%"
        found = found.filter(F.ilike("table_name", F.lit(pattern)) | F.ilike("business_name", F.lit(pattern))
                             | F.ilike("business_definition", F.lit(pattern)))
    if tier:
        found = found.filter(F.col("trust_tier") == tier)
    if domain:
        found = found.filter(F.col("business_domain") == domain)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.orderBy("schema_name", "table_name").offset(offset).limit(limit).withColumn("total", total)


def relationships_for_tables(relationships: DataFrame, tables: DataFrame) -> DataFrame:
    """Relationships touching the given (schema_name, table_name) rows.

    Each comes with its direction seen from the table; a table's link to
    itself is outgoing.
    """
    r = F.col
    inner = (r("source_schema") == r("target_schema")) & (r("source_table") == r("target_table"))
    ends = F.filter(F.array(
        F.struct(r("source_schema").alias("schema_name"), r("source_table").alias("table_name"),
                 F.lit("outgoing").alias("direction")),
        F.when(~inner, F.struct(r("target_schema").alias("schema_name"), r("target_table").alias("table_name"),
                                F.lit("incoming").alias("direction")))), lambda e: e.isNotNull())
    return relationships.select("*", F.inline(ends)).join(tables, ["schema_name", "table_name"], "left_semi")


def dictionary_context(assets: DataFrame, fields: DataFrame, profiles: DataFrame,
                       relationships: DataFrame) -> DataFrame:
    """Asset, columns with their latest profile, and relationships of every table.

    Columns and relationships are arrays, as wide as a schema.
    """
    key = ["schema_name", "table_name"]
    described = fields.join(profiles, [*key, "column_name"], "left")
    columns = described.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        "ordinal_position", "column_name", "business_name", "data_type", "null_fraction", "distinct_count"
    ))).alias("columns"))
    links = relationships_for_tables(relationships, assets.select(*key)).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(
            "direction",
            F.concat_ws(".", "source_schema", "source_table", "source_column").alias("from"),
            F.concat_ws(".", "target_schema", "target_table", "target_column").alias("to"),
            "cardinality", "confidence"))).alias("relationships"))
    return assets.join(columns, key, "left").join(links, key, "left")


def trust_score(assets: DataFrame, low_nulls: float = 0.05, high_nulls: float = 0.2,
                high_usage: int = 100, recent_days: int = 30) -> DataFrame:
    """Additive trust score, 0 to 100, starting from 50.

    ``assets`` needs business_definition, days_since_profile, null_fraction,
    query_count, days_since_query, approved and known_issues.
    """
    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    a = F.col
    score = (F.lit(DEFAULT_SCORE)
             + points(F.length("business_definition") > 0, 10)
             + points(a("days_since_profile") <= recent_days, 10)
             + points(a("null_fraction") < low_nulls, 10)
             + points(a("query_count") >= high_usage, 10)
             + points(a("approved"), 20)
             - points(F.length("known_issues") > 0, 20)
             - points(a("days_since_query").isNull() | (a("days_since_query") > recent_days), 10)
             - points(a("null_fraction") > high_nulls, 10))
    return assets.withColumn("trust_score", F.greatest(F.lit(0), F.least(F.lit(100), score)))


def infer_relationships(tables: dict[str, tuple[DataFrame, Sequence[str]]], min_containment: float = 0.95) -> DataFrame:
    """Foreign keys suggested by the data.

    ``tables`` maps a name to a frame and the key-like columns to consider. A
    column points to another table's column if that one is unique and holds at
    least ``min_containment`` of its distinct values. Values are counted per
    column first, so each is joined once per pair of columns holding it.
    """
    parts = []
    for table, (df, cols) in tables.items():
        for c in cols:
            parts.append(df.select(F.lit(table).alias("t"), F.lit(c).alias("c"),
                                   col(c).cast("string").alias("v")))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    counted = values.filter(F.col("v").isNotNull()).groupBy("t", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    per_column = counted.groupBy("t", "c").agg(F.count(F.lit(1)).alias("d"), F.max("n").alias("m"))
    # One row per column considered; the sides below stay as large as the data.
    unique = per_column.filter("m = 1").select("t", "c")
    parents = counted.join(unique, ["t", "c"], "left_semi").select(
        F.col("t").alias("parent_table"), F.col("c").alias("parent_column"), "v")
    matched = counted.join(parents, "v").filter("t <> parent_table").groupBy(
        "t", "c", "parent_table", "parent_column").agg(F.count(F.lit(1)).alias("hits"))
    share = F.col("hits") / F.col("d")
    return matched.join(per_column, ["t", "c"]).filter(share >= min_containment).select(
        F.col("t").alias("source_table"), F.col("c").alias("source_column"),
        F.col("parent_table").alias("target_table"), F.col("parent_column").alias("target_column"),
        share.alias("containment"),
        F.when(F.col("m") == 1, "one_to_one").otherwise("many_to_one").alias("cardinality"),
        F.lit("inferred").alias("confidence"))


# Name patterns behind the tags.
KEY_NAME = r"(^|_)(id|key)$|key$|_id$"
MONEY_NAME = r"price|cost|amount|revenue|sales|total|balance|bal$"
PERSON_NAME = r"(^|_)(email|phone|name|address|ssn)$"
EMAIL_VALUE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CATEGORY_VALUES = 50
LONG_TEXT = 50


def tag_columns(df: DataFrame, table: str) -> DataFrame:
    """A role for each column, from its type, name, values and profile."""
    df = nan_to_null(df)
    texts, numbers, moments = set(text_columns(df)), set(numeric_columns(df)), set(temporal_columns(df))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        if c in texts:
            aggs += [F.avg(F.length(col(c))).alias(f"len{i}"),
                     F.avg(F.regexp_like(col(c), F.lit(f"^{EMAIL_VALUE}$")).cast("int")).alias(f"mail{i}")]
    row = df.agg(*aggs)
    kinds = [F.struct(
        F.lit(c).alias("column_name"), F.col("n"),
        F.lit("text" if c in texts else "number" if c in numbers else "moment" if c in moments else "other").alias("kind"),
        (F.col(f"len{i}") if c in texts else F.lit(None).cast("double")).alias("avg_length"),
        (F.col(f"mail{i}") if c in texts else F.lit(None).cast("double")).alias("email_rate"))
        for i, c in enumerate(df.columns)]
    base = row.select(F.inline(F.array(*kinds)))
    profile = profile_table(df).select("column_name", "distinct_count")
    name = F.lower("column_name")
    unique = F.col("distinct_count") == F.col("n")
    tag = (F.when(F.col("kind") == "moment", "timestamp")
           .when(name.rlike(KEY_NAME), F.when(unique, "identifier").otherwise("foreign_key"))
           .when((F.col("email_rate") > 0.5) | ((F.col("kind") == "text") & name.rlike(PERSON_NAME)), "PII")
           .when((F.col("kind") == "number") & name.rlike(MONEY_NAME), "currency")
           .when(F.col("kind") == "number", "metric")
           .when(F.col("distinct_count") <= CATEGORY_VALUES, "category")
           .when(F.col("avg_length") > LONG_TEXT, "free_text").otherwise("other"))
    return base.join(profile, "column_name").select(F.lit(table).alias("table_name"), "column_name", tag.alias("tag"))
