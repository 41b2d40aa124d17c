"""Near-duplicate embeddings with HNSW graphs per shard.

Equal vectors of a label become one node. Nodes are dealt by hash into shards of bounded size, each with a
navigable small-world graph in a file of the shared folder and a beam that its recall audit accepted. Every
shard queries itself and the shards after it, so each pair of shards meets once; links are verified by the
cosine in double precision. A task reports link counts per node and a spanning forest of its links, both
linear in its nodes, so a dense group of near copies is never written out as pairs. Components join the forests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.components import connected_components
from reviewlens.llm.hnsw import Graph, _unit
from reviewlens.session import scratch_path
from reviewlens.sources.scratch import materialise

SHARD_ROWS = 8192
_SLACK = 1e-4
_ROWS = 1024
_MOST_TASKS = 50_000


def _usable(embedding: str) -> Column:
    """Neither null nor empty, all components finite numbers, one at least not zero."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _build(folder: str, threshold: float) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf["node"].to_numpy(np.int64)
        unit = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        graph = Graph.build(unit)
        beam, recall = graph.audited_beam(threshold - _SLACK)
        name = f"{uuid.uuid4().hex}.npz"
        system, path = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(graph.to_bytes(nodes=nodes, unit=unit, copies=pdf["copies"].to_numpy(np.int64)))
        first = pdf.iloc[0]
        return pd.DataFrame([{"space": first["space"], "shard": first["shard"], "file": name, "beam": beam, "recall": recall}])

    return run


def _forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a link matrix, as two arrays of nodes."""
    owner = np.full(len(right), -1, np.int64)  # per right node the set it is in
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    a, b = [], []
    for i in np.flatnonzero(hits.any(axis=1)).tolist():
        linked = np.flatnonzero(hits[i])
        fresh = linked[owner[linked] < 0]
        a.append(np.full(len(fresh), left[i]))
        b.append(right[fresh])
        owner[fresh] = i
        parent.setdefault(i, i)
        old = np.unique(owner[linked])
        for j in old[old != i].tolist():
            top = root(j)
            if top != root(i):
                parent[root(i)] = top
                a.append(left[[i]])
                b.append(right[[linked[owner[linked] == j][0]]])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _verified(hits: np.ndarray, queries: np.ndarray, targets: np.ndarray, threshold: float) -> np.ndarray:
    """Candidates whose cosine in double precision reaches the threshold."""
    for at in range(0, len(queries), _ROWS):
        block = hits[at : at + _ROWS]
        rows = np.flatnonzero(block.any(axis=1))
        if len(rows):
            block[rows] &= queries[at + rows] @ targets.T >= threshold
    return hits


def _compare(folder: str, threshold: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = pa.fs.FileSystem.from_uri(folder)

        def load(name: str) -> tuple[Graph, dict[str, np.ndarray]]:
            with system.open_input_file(f"{path}/{name}") as file:
                return Graph.from_bytes(file.read())

        for batch in batches:
            for row in batch.itertuples(index=False):
                graph, target = load(row.file)
                same = row.file == row.other
                _, query = (graph, target) if same else load(row.other)
                hits = graph.within(query["unit"].astype(np.float32), threshold - _SLACK, int(row.beam))
                hits = _verified(hits, query["unit"], target["unit"], threshold)
                if same:
                    hits |= hits.T
                    np.fill_diagonal(hits, False)
                yield _reported(hits, query, target, same)

    return run


def _reported(hits: np.ndarray, query: dict, target: dict, same: bool) -> pd.DataFrame:
    """Rows ``(a, b, n)``: ``n`` more links of node ``a``, or with ``n`` = 0 an edge of the forest."""
    some = hits.any(axis=1)
    parts = [(query["nodes"][some], query["nodes"][some], hits[some] @ target["copies"])]
    if not same:
        other = hits.any(axis=0)
        parts.append((target["nodes"][other], target["nodes"][other], hits[:, other].T @ query["copies"]))
    a, b = _forest(hits, query["nodes"], target["nodes"])
    parts.append((a, b, np.zeros(len(a), np.int64)))
    a, b, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    return pd.DataFrame({"a": a, "b": b, "n": n})


def shard_graphs(nodes: DataFrame, folder: str, threshold: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(space, shard, file, beam, recall)`` from ``(node, space, embedding, copies)``: one audited graph per shard."""
    sizes = nodes.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    sizes = materialise(sizes, "spaces")
    dealt = nodes.join(sizes, "space").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    dealt = dealt.drop("shards")
    schema = "space string, shard int, file string, beam int, recall double"
    return materialise(dealt.groupBy("space", "shard").applyInPandas(_build(folder, threshold), schema), "graphs")


def near_duplicate_vectors(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``df``.

    Vectors compare only under equal labels and with equal numbers of components. A null label, and a vector
    that is null, empty, zero or holds null or non-finite components, links with nothing. Repeated rows are
    vectors of their own that link with each other. A null id counts as larger than all others. ``kept``: the
    id is the component's. Other columns are not read.
    """
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    fit = F.col("label").isNotNull() & _usable("embedding")
    space = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    rows = rows.withColumns({"space": F.when(fit, space), "embedding": F.when(fit, F.transform("embedding", lambda x: x.cast("double") + 0.0))})
    # Copies collapse in partial aggregates; the digest is the key that rows find their node by.
    digest = F.sha2(F.to_json(F.struct("embedding")), 256)
    rows = rows.withColumn("digest", F.when(fit, digest))
    keyed = materialise(rows.select("vec_id", "space", "digest"), "keys")
    nodes = rows.where("space is not null").groupBy("space", "digest").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("vec_id").isNull().alias("missing"), "vec_id")).alias("head"),
        F.any_value("embedding").alias("embedding"),
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    root = scratch_path(df.sparkSession, "graphs")
    folder = root if "://" in root else root.replace("file:", "file://", 1) if root.startswith("file:") else f"file://{root}"
    graphs = shard_graphs(nodes.select("node", "space", "embedding", "copies"), folder, threshold, shard_rows)
    later = graphs.select("space", F.col("shard").alias("other_shard"), F.col("file").alias("other"))
    pairs = graphs.join(later, "space").where("other_shard >= shard").select("file", "other", "beam")
    # Pairs of shards are few bytes and much work. A stated number of tasks keeps adaptive execution, which
    # goes by bytes, from putting thousands of them into one.
    pairs = materialise(pairs, "pairs")
    tasks = max(1, min(pairs.count(), _MOST_TASKS))
    reports = pairs.repartition(tasks, "file", "other").mapInPandas(_compare(folder, threshold), "a bigint, b bigint, n bigint")
    reports = materialise(reports, "reports")
    links = reports.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    roots = connected_components(reports.where("n = 0").select("a", "b"), "a", "b")
    rooted = nodes.select("node", "space", "digest", "copies", "head").join(roots, "node", "left").join(links, "node", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
    heads = materialise(rooted.groupBy("root").agg(F.min("head").alias("first")), "heads")
    known = rooted.join(heads, "root").select(
        "space", "digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.col("first.vec_id").alias("first")
    )
    joined = keyed.join(materialise(known, "known"), ["space", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
