"""Rollouts in which a node's text depends on what its parents wrote.

All episodes go level by level: a node's level is the longest path to it, so its parents have written before. The rows of a level get
the texts of their parents, in the parents' order, and go to the writer in batches of a bounded number of rows. What the writer fails
to write is written by the row's template. Each level is a stored table, so a lost executor repeats rows of one level only, and
the writer is not asked again for what is stored. Texts are sent on to the children that need them, filed under the children's level,
so a level reads its own messages only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graphs
from tessera.session import checkpoint, discard, small_batches

#: Rows that a writer is asked for at once.
BATCH = 64
Writer = Callable[[list[dict]], list[str | None]]


def written(write: Writer, rows: list[dict]) -> list[str | None]:
    """The writer's texts; if it fails for a batch, rows are asked for one by one, and those it fails for have none."""
    try:
        out = list(write(rows))
        if len(out) == len(rows):
            return out
    except Exception:  # a writer is a client of something that may fail in any way
        if len(rows) == 1:
            return [None]
    return [None] if len(rows) == 1 else [written(write, [r])[0] for r in rows]


def rollout(nodes: DataFrame, edges: DataFrame, key: list[str], write: Writer, batch: int = BATCH) -> DataFrame:
    """nodes: key, node, place (order among an episode's nodes), prompt, template, and what else the writer wants to see; edges: key, src,
    dst. Gives key, node, level, parents (how many texts it saw), text, made (model or template).

    The writer sees rows as dicts, with `parents`, the texts of the parents that exist. Nodes of graphs with a cycle have no level
    and are written by their template. Edges that repeat count once, edges to or from nodes that aren't there are none, null templates are
    empty texts. A node is a row of its own: repeated nodes are written each, and all told to the children."""
    small_batches(nodes.sparkSession)
    known = nodes.select(*key, "node").distinct()
    for end in ("src", "dst"):
        edges = edges.join(known.withColumnRenamed("node", end), [*key, end], "left_semi")
    edges = checkpoint(edges.select(*key, "src", "dst").distinct())
    level = checkpoint(graphs.levels(known, edges, key))
    todo = checkpoint(nodes.join(level, [*key, "node"]), by="level")
    links = edges.join(level.select(*key, F.col("node").alias("dst"), F.col("level").alias("to")), [*key, "dst"]).where("to IS NOT NULL")
    links = checkpoint(links.join(level.select(*key, F.col("node").alias("src"), "level"), [*key, "src"]), by="level")
    last = todo.agg(F.max("level")).first()[0]
    seen = [c for c in nodes.columns if c not in (*key, "template")]
    ids = [F.col(c) for c in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.slice(lo, batch)
                texts = written(write, part.drop_columns(["template"]).to_pylist())
                texts = [t if isinstance(t, str) else None for t in texts]
                full = [t if t is not None else f or "" for t, f in zip(texts, part.column("template").to_pylist(), strict=True)]
                made = ["template" if t is None else "model" for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), part.column("node"), part.column("place"), pa.array([len(x) for x in part.column("parents").to_pylist()], pa.int32()), pa.array(full, pa.string()), pa.array(made, pa.string())], [*key, "node", "place", "parents", "text", "made"])

    kinds = dict(todo.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*key, "node", "place")), "parents int", "text string", "made string"])
    told, done = [], []
    for at in range((last if last is not None else -1) + 1):
        rows = todo.where(F.col("level") == at)
        for_now = [m.where(F.col("to") == at).drop("to") for m in told]
        if for_now:
            heard = for_now[0]
            for m in for_now[1:]:
                heard = heard.unionByName(m)
            heard = heard.groupBy(*key, F.col("dst").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "src", "text"))), lambda x: x["text"]).alias("parents"))
            rows = rows.join(heard, [*key, "node"], "left")
        else:
            rows = rows.withColumn("parents", F.lit(None).cast("array<string>"))
        rows = rows.withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
        made = checkpoint(rows.select(*ids, *(F.col(c) for c in seen), "template", "parents").mapInArrow(run, schema))
        done.append(made.withColumn("level", F.lit(at)))
        if at < last:
            out = links.where(F.col("level") == at).join(made.select(*key, F.col("node").alias("src"), "place", "text"), [*key, "src"])
            told.append(checkpoint(out.select(*key, "dst", "to", "src", "place", "text"), by="to"))
    stuck = todo.where("level IS NULL").select(*ids, "node", F.lit(None).cast("int").alias("level"), F.lit(0).alias("parents"), F.coalesce("template", F.lit("")).alias("text"), F.lit("template").alias("made"))
    for d in done:
        stuck = stuck.unionByName(d.drop("place"))
    discard(*told, links)
    return stuck.select(*key, "node", "level", "parents", "text", "made")
