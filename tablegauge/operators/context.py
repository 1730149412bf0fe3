"""Documents, context layers, lineage and model output texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, with_row_index
from tablegauge.session import materialize

# Bounds and marks of texts prepared for summarizing.
MIN_CHARACTERS = 50
PART_CHARACTERS = 3000
DOCUMENTS_COMBINED = 5
DOCUMENT_GLUE = "\n\n---\n\n"
WHITESPACE = " \t\n\r\x0b\x0c"


def context_digest(contexts: DataFrame, layers: DataFrame) -> DataFrame:
    """SHA-256 of each context's sorted dataset ids, layers and metadata.

    ``contexts``: context_id, dataset_ids, metadata (map). ``layers``:
    context_id, position, kind, name, spec, enabled. Layers keep their order;
    a context has a handful of them.
    """
    spec = layers.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "enabled", "kind", "name", "spec"))).alias("layers"))
    content = F.to_json(F.struct(
        F.array_sort("dataset_ids").alias("dataset_ids"),
        F.transform(F.coalesce("layers", F.array()), lambda s: F.struct(
            F.coalesce(s["enabled"], F.lit(True)).alias("enabled"), s["kind"].alias("kind"),
            s["name"].alias("name"), s["spec"].alias("spec"))).alias("layers"),
        F.array_sort(F.map_entries("metadata")).alias("metadata")))
    return contexts.join(spec, "context_id", "left").select("context_id", F.sha2(content, 256).alias("digest"))


def duplicate_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every copy of a text with the document kept for it, the smallest id.

    Only digests and ids are shuffled. Copies are counted per task first and
    the kept id comes back by joining on the digest, so a text that makes up a
    third of the table is never gathered.
    """
    hashed = docs.select(key, F.sha2(col(text), 256).alias("sha256"))
    groups = hashed.groupBy("sha256").agg(F.min(key).alias("keeper_id"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(groups.filter("copies > 1"), "sha256").select(
        key, "sha256", "keeper_id", "copies", (col(key) != F.col("keeper_id")).alias("is_duplicate"))


def prepare_summary_inputs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per part of each text, with ``part`` from 0 and ``summary_input``.

    Parts have up to 3,000 characters and together cover the whole text. Texts
    too short to be summarized have one row with NULL in both columns.
    """
    t = col(text)
    parts = F.when(F.length(F.trim(t, F.lit(WHITESPACE))) >= MIN_CHARACTERS,
                   F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PART_CHARACTERS}}}"), F.lit(0)))
    return docs.select("*", F.posexplode_outer(parts).alias("part", "summary_input"))


def combine_documents(docs: DataFrame, group: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """All texts of each group in its order, five to a ``bundle`` from 0, prepared for summarizing.

    Positions come from one range sort, so a group of any size spreads over
    tasks; a bundle holds five texts.
    """
    placed = with_row_index(docs.select(*group, order, text), [*group, order], "_place")
    starts = placed.groupBy(*group).agg(F.min("_place").alias("_start"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    nth = placed.alias("p").join(starts.alias("s"), same).select(
        *[F.col(f"p.{c}").alias(c) for c in group], (F.col("_place") - F.col("_start")).alias("_nth"), F.col(f"p.{text}").alias("_text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_text"))), lambda s: s["_text"])
    bundled = nth.groupBy(*group, F.floor(F.col("_nth") / DOCUMENTS_COMBINED).alias("bundle")).agg(
        F.array_join(texts, DOCUMENT_GLUE).alias("combined"))
    return prepare_summary_inputs(bundled, "combined")


def apply_layers(df: DataFrame, layers: Sequence[Mapping], terms: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Apply context layers in ``step`` order.

    select: {"where": sql}; transform: {"column", "pattern", "replacement"} or
    {"column", "mapping": {old: new}}; dictionary: {"column", "terms": name of
    a frame with term and definition}. Disabled layers are skipped.
    """
    for layer in sorted(layers, key=lambda x: x["step"]):
        if not layer.get("enabled", True):
            continue
        kind, spec = layer["kind"], layer["spec"]
        if kind == "select":
            df = df.filter(F.expr(spec["where"]))
        elif kind == "transform" and "pattern" in spec:
            df = df.withColumn(spec["column"], F.regexp_replace(spec["column"], spec["pattern"], spec["replacement"]))
        elif kind == "transform":
            pairs = F.create_map(*[F.lit(x) for pair in spec["mapping"].items() for x in pair])
            df = df.withColumn(spec["column"], F.coalesce(F.try_element_at(pairs, F.col(spec["column"])), F.col(spec["column"])))
        elif kind == "dictionary":
            lookup = terms[spec["terms"]].select(
                F.col("term").alias(spec["column"]), F.col("definition").alias(f"{spec['column']}_definition"))
            df = df.join(lookup, spec["column"], "left")
        else:
            raise ValueError(f"unknown layer kind: {kind}")
    return df


HOPS, ROUNDS = 4, 8


def lineage(edges: DataFrame, start: DataFrame, direction: str = "both", depth: int | None = None) -> DataFrame:
    """Nodes reachable from ``start`` (column ``node``) with their distance, up to ``depth`` hops or without limit.

    A round joins ``HOPS`` layers against the edges in one job, keeps the smallest distance of each node and drops what was
    visited before; the nodes of its last layer are the next round's frontier. Every round is written to the shared folder,
    and after ``ROUNDS`` of them the visited nodes become one table again, so plans stay short however long the walk is and
    a lost executor costs one round.
    """
    down = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    up = edges.select(F.col("target").alias("node"), F.col("source").alias("next"))
    if direction not in ("downstream", "upstream", "both"):
        raise ValueError(f"unknown direction: {direction}")
    step = down if direction == "downstream" else up if direction == "upstream" else down.unionByName(up)
    step = materialize(step.distinct(), "lineage-edges")
    frontier = materialize(start.select("node").distinct().withColumn("depth", F.lit(0)), "lineage-hops")
    visited, rounds, done = frontier, 1, 0
    while depth is None or done < depth:
        hops = HOPS if depth is None else min(HOPS, depth - done)
        layer, layers = frontier.select("node"), []
        for hop in range(done + 1, done + hops + 1):
            layer = layer.join(step, "node").select(F.col("next").alias("node")).distinct()
            layers.append(layer.withColumn("depth", F.lit(hop)))
        reached = reduce(DataFrame.unionByName, layers).groupBy("node").agg(F.min("depth").alias("depth"))
        found = materialize(reached.join(visited.select("node"), "node", "left_anti"), "lineage-hops")
        visited, rounds, done = visited.unionByName(found), rounds + 1, done + hops
        frontier = found.filter(F.col("depth") == done)
        if frontier.isEmpty():
            break
        if rounds == ROUNDS:
            visited, rounds = materialize(visited, "lineage-visited"), 1
    return visited


def latest_values(store: DataFrame, as_of: str) -> DataFrame:
    """Newest value per (context_id, key) that has not expired at ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = store.filter((F.col("created_at") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return live.groupBy("context_id", "key").agg(F.max_by(
        F.struct("value", "created_at"), F.struct("created_at", "value")).alias("r")).select("context_id", "key", "r.*")


def search_rows(df: DataFrame, term: str) -> DataFrame:
    """Rows whose JSON form contains the term, ignoring case."""
    return df.filter(F.contains(F.lower(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), F.lit(term.lower())))


# Shape of a fenced JSON block and the length from which a line counts.
FENCED_JSON = r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"
FALLBACK_CHARACTERS = 20


def extract_json(df: DataFrame, text: str) -> DataFrame:
    """Add the JSON found in a model's answer, or its long lines.

    A fenced block wins; else the text from the first brace or bracket to the
    last matching one. ``json`` is NULL where that does not parse, and then
    ``key_insights`` has all lines of more than 20 characters.
    """
    trimmed = F.trim(col(text), F.lit(WHITESPACE))
    block = F.regexp_extract(trimmed, FENCED_JSON, 1)
    body = F.when(block != "", block).otherwise(trimmed)
    brace, bracket = F.instr(body, "{"), F.instr(body, "[")

    def last(mark: str):
        return F.length(body) - F.instr(F.reverse(body), mark) + 1

    use_list = (bracket > 0) & ((brace == 0) | (bracket < brace))
    span = (F.when(use_list, F.when(last("]") > bracket, F.substring(body, bracket, last("]") - bracket + 1)))
            .when((brace > 0) & (F.instr(body, "}") > 0) & (last("}") > brace),
                  F.substring(body, brace, last("}") - brace + 1)))
    candidate = F.coalesce(F.when(body.startswith("{") | body.startswith("["), body), span, body)
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s, F.lit(WHITESPACE)))
    long_lines = F.filter(lines, lambda s: F.length(s) > FALLBACK_CHARACTERS)
    parsed = F.to_json(F.try_parse_json(candidate))
    return df.withColumn("json", parsed).withColumn(
        "key_insights", F.when(F.col("json").isNull(), long_lines))


def summarize_findings(findings: DataFrame) -> DataFrame:
    """One row per analysis and distinct recommendation, with the analysis's counts of issues, anomalies and
    relationships and the first position of the recommendation.

    ``findings``: analysis_id, position, kind, recommendation. An analysis without recommendations has one row. Rows
    rather than one array, as an analysis may have any number of recommendations.
    """
    counts = findings.groupBy("analysis_id").agg(*[
        F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("issue", "anomaly", "relationship")])
    texts = findings.filter(F.col("recommendation").isNotNull()).groupBy("analysis_id", "recommendation").agg(
        F.min("position").alias("first_position"))
    return counts.join(texts, "analysis_id", "left")
