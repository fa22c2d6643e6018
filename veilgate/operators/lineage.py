"""Lineage events, edges from them, and traversal of the edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.functions.ids import stable_id
from veilgate.operators.keyed import is_small, lookup_join, skewed_join, two_sided_join
from veilgate.session import settle

NAMESPACE = "veilgate"
PRODUCER = "veilgate"
SCHEMA_URL = "https://openlineage.io/spec/1.0.0/OpenLineage.json"

DATASET = "struct<namespace:string,name:string>"


def dataset_reference(name: Column, namespace: str = NAMESPACE) -> Column:
    """``ns:name`` is split at its first colon; a name without one gets the default namespace."""
    parts = F.split(name, ":", 2)
    named = F.size(parts) > 1
    return F.struct(
        F.when(named, parts[0]).otherwise(F.lit(namespace)).alias("namespace"),
        F.when(named, parts[1]).otherwise(name).alias("name"),
    )


def references(names: Column, namespace: str = NAMESPACE) -> Column:
    return F.transform(names, lambda n: dataset_reference(n, namespace))


def _event(
    rows: DataFrame, run_id: Column, job: Column, at: Column, inputs: Column, outputs: Column,
    facets: Column, namespace: str,
) -> DataFrame:
    return rows.select(
        F.lit("COMPLETE").alias("eventType"),
        at.alias("eventTime"),
        F.lit(SCHEMA_URL).alias("schemaURL"),
        F.lit(PRODUCER).alias("producer"),
        F.struct(run_id.alias("runId"), facets.alias("facets")).alias("run"),
        F.struct(F.lit(namespace).alias("namespace"), job.alias("name")).alias("job"),
        inputs.alias("inputs"),
        outputs.alias("outputs"),
    )


def metadata_facets(rows: DataFrame, fields: dict[str, Column]) -> Column:
    """The run's facets as a VARIANT: ``fields`` with their types, and the free metadata of the row.

    Free metadata is a column ``metadata`` (a VARIANT, a struct, a map or JSON text of an object), if ``rows`` has one; its
    keys win over fields of the same name. Null or broken JSON text counts as no metadata.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    free = F.lit("{}")
    if "metadata" in kinds:
        given = F.col("metadata")
        free = given if isinstance(kinds["metadata"], T.StringType) else F.to_json(given)
    free = F.coalesce(F.when(F.json_object_keys(free).isNotNull(), F.trim(free)), F.lit("{}"))
    taken = F.json_object_keys(free)
    written = []
    for name, value in {"_producer": F.lit(PRODUCER), **fields}.items():
        one = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
        written.append(F.when(~F.array_contains(taken, name), F.substring(one, F.lit(2), F.length(one) - 2)))
    inside = F.trim(F.substring(free, F.lit(2), F.length(free) - 2))
    written.append(F.when(inside != "", inside))
    return F.parse_json(F.concat(F.lit('{"mcp_metadata":{'), F.array_join(F.array_compact(F.array(*written)), ","), F.lit("}}")))


def facet(name: str, kind: str) -> Column:
    """A value of the metadata of an event, in a type; null where it is missing or of another kind."""
    return F.try_variant_get(F.col("run.facets"), f"$.mcp_metadata.{name}", kind)


def dataset_events(runs: DataFrame, key: str, at: Column, namespace: str = NAMESPACE) -> DataFrame:
    """``runs``: key, job_name, input_datasets, output_datasets, and metadata if there is any."""
    facets = metadata_facets(runs, {"layer": F.lit("dataset")})
    return _event(
        runs,
        stable_id(F.lit("dataset"), F.col(key)),
        F.col("job_name"),
        at,
        references(F.col("input_datasets"), namespace),
        references(F.col("output_datasets"), namespace),
        facets,
        namespace,
    )


def retrieval_events(calls: DataFrame, key: str, at: Column, namespace: str = NAMESPACE) -> DataFrame:
    """``calls``: key, tool_name, session_id, agent_id, query_hash, chunk_ids, and metadata if there is any."""
    inputs = F.transform(
        "chunk_ids",
        lambda c: dataset_reference(F.concat(F.lit("pgvector:rag.document_chunks:"), c), namespace),
    )
    outputs = F.array(
        dataset_reference(F.concat(F.lit("mcp:agent_context:"), F.col("session_id")), namespace)
    )
    named = {name: F.col(name) for name in ("agent_id", "query_hash", "session_id")}
    facets = metadata_facets(calls, named | {"chunk_count": F.size("chunk_ids")})
    job = F.concat(F.lit("mcp."), F.col("tool_name"))
    return _event(
        calls, stable_id(F.lit("retrieval"), F.col(key)), job, at, inputs, outputs, facets, namespace
    )


def prompt_events(
    prompts: DataFrame, key: str, model: str, at: Column, namespace: str = NAMESPACE
) -> DataFrame:
    """``prompts``: key, session_id, agent_id, prompt_hash, chunk_ids, pii_detected, and metadata if there is any."""
    inputs = F.transform(
        "chunk_ids", lambda c: dataset_reference(F.concat(F.lit("pgvector:chunk:"), c), namespace)
    )
    outputs = F.array(
        dataset_reference(
            F.concat(F.lit(f"bedrock:{model}:prompt:"), F.col("session_id")), namespace
        )
    )
    named = {name: F.col(name) for name in ("agent_id", "prompt_hash", "session_id", "pii_detected")}
    facets = metadata_facets(prompts, named | {"llm_model_id": F.lit(model)})
    return _event(
        prompts,
        stable_id(F.lit("prompt"), F.col(key)),
        F.lit("mcp.prompt_assembly"),
        at,
        inputs,
        outputs,
        facets,
        namespace,
    )


def edges_of(events: DataFrame) -> DataFrame:
    """Distinct (src, dst, type) edges: inputs feed the job, the job produces its outputs."""
    label = lambda d: F.concat_ws(":", d["namespace"], d["name"])
    job = F.concat_ws(":", F.lit("job"), F.col("job.name"))
    into = events.select(F.explode("inputs").alias("d"), job.alias("dst")).select(
        label(F.col("d")).alias("src"), "dst", F.lit("input").alias("type")
    )
    out = events.select(job.alias("src"), F.explode("outputs").alias("d")).select(
        "src", label(F.col("d")).alias("dst"), F.lit("produces").alias("type")
    )
    return into.unionByName(out).distinct()


def three_layers(*layers: DataFrame) -> DataFrame:
    """Union of the edges of dataset, retrieval and prompt events."""
    union = edges_of(layers[0])
    for layer in layers[1:]:
        union = union.unionByName(edges_of(layer))
    return union.distinct()


def reachable(
    edges: DataFrame, starts: DataFrame, depth: int = 3, direction: str = "upstream"
) -> DataFrame:
    """(start, node, hops) for every node within ``depth`` hops, with its smallest distance.

    ``starts`` has one column ``start``. Each hop joins the new frontier with the edges and drops
    nodes already reached, so cycles end and no path is walked twice. Links, starts and hops are settled.

    Where a frontier stands on few nodes, only their links and what was reached at the ends of these take part, and
    are broadcast; otherwise rows are shuffled once, save those of hot nodes.
    """
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    links = settle(edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct(), "links")
    first = settle(starts.select("start").distinct(), "starts")
    reached = first.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    frontier = reached
    for hop in range(1, depth + 1):
        current, known = frontier.select("start", "node"), reached.select("start", "node")
        nodes = current.select("node").distinct()
        if is_small(current):
            joined = links.join(F.broadcast(current), "node")
        elif is_small(nodes) and is_small(used := links.join(F.broadcast(nodes), "node", "left_semi")):
            joined = current.join(F.broadcast(used), "node")
            known = known.join(F.broadcast(used.select(F.col("next").alias("node")).distinct()), "node", "left_semi")
        else:
            # upstream the frontier is the hot side (many starts at one node), downstream the links are
            joined = skewed_join(links, current, ["node"], ["next"], ["start"])
        step = (
            joined.select("start", F.col("next").alias("node"))
            .distinct()
            .join(known.select("start", "node"), ["start", "node"], "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        frontier = settle(step, "hop")
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return reached


def subgraph(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges whose two ends were both reached from the same start."""
    nodes = reached.select("start", "node")
    src = nodes.select("start", F.col("node").alias("src"))
    dst = nodes.select("start", F.col("node").alias("dst"))
    if is_small(nodes):
        from_known = edges.join(F.broadcast(src), "src")
    else:
        from_known = two_sided_join(edges, src, ["src"], ["dst"], ["start"])
    return from_known.join(dst, ["start", "dst"]).select("start", "src", "dst", "type")


def sessions_reading(events: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Sessions that read the given chunks: artefact, session, agent, tool, last time, reads."""
    reads = events.select(
        F.explode(F.array_distinct("chunk_ids")).alias("artefact_id"),
        "session_id",
        "agent_id",
        "tool_name",
        "timestamp",
    )
    wanted = artefacts.select("artefact_id").distinct()
    return (
        lookup_join(reads, wanted, ["artefact_id"], "left_semi", spread=["session_id"])
        .groupBy("artefact_id", "session_id", "agent_id", "tool_name")
        .agg(F.max("timestamp").alias("retrieved_at"), F.count(F.lit(1)).alias("reads"))
    )
