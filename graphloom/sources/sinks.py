"""Writers: graph exports, snapshots, reports."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quoted(column) -> F.Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(column.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame, label: str = "Symbol") -> DataFrame:
    """line: a CREATE statement for each node, then for each edge."""
    n = nodes.select(F.lit(0).alias("part"), "uid", F.concat(F.lit(f"CREATE (:{label} {{uid: "), _quoted(F.col("uid")), F.lit(", name: "), _quoted(F.col("name")), F.lit(", kind: "), _quoted(F.col("kind")), F.lit("});")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat_ws(" ", "src", "rel", "dst").alias("uid"), F.concat(F.lit("MATCH (a {uid: "), _quoted(F.col("src")), F.lit("}), (b {uid: "), _quoted(F.col("dst")), F.lit("}) CREATE (a)-[:"), F.col("rel"), F.lit(" {confidence: "), F.coalesce("confidence", F.lit(1.0)).cast("string"), F.lit("}]->(b);")).alias("line"))
    return n.unionByName(e)


def _xml(column) -> F.Column:
    out = F.coalesce(column.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: node and edge elements (the frame around them is write_graphml's)."""
    n = nodes.select(F.lit(0).alias("part"), "uid", F.concat(F.lit('<node id="'), _xml(F.col("uid")), F.lit('"><data key="name">'), _xml(F.col("name")), F.lit('</data><data key="kind">'), _xml(F.col("kind")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat_ws(" ", "src", "rel", "dst").alias("uid"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="rel">'), F.col("rel"), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><key id="kind" for="node" attr.name="kind" attr.type="string"/><key id="rel" for="edge" attr.name="rel" attr.type="string"/><graph edgedefault="directed">'
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(-1, "", head), (2, "", "</graph></graphml>")], "part int, uid string, line string")
    graphml(nodes, edges).unionByName(frame).orderBy("part", "uid").select("line").write.text(path)


def mermaid(nodes: DataFrame, edges: DataFrame, scores: DataFrame, top: int) -> DataFrame:
    """line: the best nodes by score and the edges among them."""
    best = nodes.join(scores.select("uid", "score"), "uid").orderBy(F.desc("score"), "uid").limit(top)
    key = lambda c: F.regexp_replace(F.col(c), "[^A-Za-z0-9]", "_")
    n = best.select(F.lit(0).alias("part"), F.concat(key("uid"), F.lit('["'), F.replace("name", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    e = edges.join(best.select(F.col("uid").alias("src")), "src", "left_semi").join(best.select(F.col("uid").alias("dst")), "dst", "left_semi")
    return n.unionByName(e.select(F.lit(1).alias("part"), F.concat(key("src"), F.lit(" -->|"), F.col("rel"), F.lit("| "), key("dst")).alias("line")).distinct())


def checksums(**tables: DataFrame) -> DataFrame:
    """name, rows, checksum: independent of order and partitioning."""
    out = None
    for name, df in tables.items():
        step = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum")
        out = step if out is None else out.unionByName(step)
    return out


def write_snapshot(path: str, **tables: DataFrame) -> None:
    """Parquet tables and a manifest of their checksums."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    checksums(**{n: spark.read.parquet(f"{path}/{n}") for n in tables}).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def verify_snapshot(spark, path: str) -> DataFrame:
    """name, ok."""
    manifest = spark.read.schema("name string, rows long, checksum string").json(f"{path}/manifest")
    now = checksums(**{r.name: spark.read.parquet(f"{path}/{r.name}") for r in manifest.collect()})
    return manifest.join(now.select("name", F.col("rows").alias("_r"), F.col("checksum").alias("_c")), "name", "left").select("name", ((F.col("rows") == F.col("_r")) & (F.col("checksum") == F.col("_c"))).alias("ok"))


def append_journal(changes: DataFrame, path: str) -> None:
    """New files beside the old: rows of vectors (uid, seq, embedding, deleted)."""
    changes.write.mode("append").parquet(path)


def compact_journal(spark, path: str, to: str, ratio: float = 2.0) -> bool:
    """Rewrites the journal to its live rows when it holds `ratio` times as many rows as are live."""
    from graphloom.streaming.ingest import latest

    journal = spark.read.parquet(path)
    live = latest(journal)
    if journal.count() < ratio * max(1, live.count()):
        return False
    live.select(*journal.columns).write.mode("overwrite").parquet(to)
    return True


def _packed(x) -> bytes:
    """A value as one message: nil, boolean, integer, double or text."""
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        return struct.pack(">b", x) if -32 <= x < 128 else b"\xd3" + struct.pack(">q", x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    b = str(x).encode()
    head = bytes([0xA0 | len(b)]) if len(b) < 32 else b"\xd9" + struct.pack(">B", len(b)) if len(b) < 256 else b"\xda" + struct.pack(">H", len(b)) if len(b) < 65536 else b"\xdb" + struct.pack(">I", len(b))
    return head + b


def messages(df: DataFrame) -> DataFrame:
    """packed: each row as a message, a map of at most 15 columns by name."""
    names = df.columns
    if len(names) > 15:
        raise ValueError("a message has at most 15 columns")
    head, keys = bytes([0x80 | len(names)]), [_packed(n) for n in names]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(k + _packed(x) for k, x in zip(keys, r, strict=True)) for r in rows], pa.binary())], names=["packed"])

    return df.mapInArrow(run, "packed binary")


def export(nodes: DataFrame, edges: DataFrame, path: str, kind: str, scores: DataFrame | None = None, top: int = 50) -> None:
    """Writes the graph in a format by name: cypher, graphml, mermaid, json, parquet or msgpack (a message in each row of a table)."""
    if kind == "cypher":
        cypher(nodes, edges).orderBy("part", "uid").select("line").write.text(path)
    elif kind == "graphml":
        write_graphml(nodes, edges, path)
    elif kind == "mermaid":
        mermaid(nodes, edges, scores, top).orderBy("part", "line").select("line").write.text(path)
    elif kind == "msgpack":
        messages(nodes).write.parquet(f"{path}/nodes")
        messages(edges).write.parquet(f"{path}/edges")
    elif kind in ("json", "parquet"):
        nodes.write.format(kind).save(f"{path}/nodes")
        edges.write.format(kind).save(f"{path}/edges")
    else:
        raise ValueError(f"no such format: {kind}")


def training_rows(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").json(path)


def load_weights(text: str, version: int = 1) -> dict[str, float] | None:
    """Weights of a linear re-ranker from JSON; None when it is of another version or no such thing."""
    import json

    try:
        model = json.loads(text)
    except ValueError:
        return None
    return {k: float(v) for k, v in model["weights"].items()} if model.get("version") == version and isinstance(model.get("weights"), dict) else None


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes only the partitions that df has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def sarif(impacts: DataFrame) -> DataFrame:
    """result: one SARIF result object in JSON for each impact (uid, file_path, start_line, severity, impact_score)."""
    level = F.when(F.col("severity") == "breaking", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation")))
    return impacts.select("uid", F.to_json(F.struct(F.lit("blast-radius").alias("ruleId"), level.alias("level"), F.struct(F.concat(F.col("uid"), F.lit(" is affected, score "), F.format_number("impact_score", 3)).alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def impact_comment(impacts: DataFrame, most_chars: int = 60_000) -> DataFrame:
    """repo_uid, comment: Markdown lists by repository, worst severity first."""
    order = F.when(F.col("severity") == "breaking", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    row = F.concat(F.lit("- **"), F.col("severity"), F.lit("** `"), F.col("uid"), F.lit("` "), F.format_number("impact_score", 3))
    g = impacts.groupBy("repo_uid").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), (-F.col("impact_score")).alias("s"), F.col("uid").alias("u"), row.alias("r")))).alias("x"))
    return g.select("repo_uid", F.substring(F.concat(F.lit("### "), F.col("repo_uid"), F.lit("\n"), F.array_join(F.transform("x", lambda v: v["r"]), "\n")), 1, most_chars).alias("comment"))


def indexed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered from 0 by uid, and edges by number."""
    from graphloom.plans.iterate import numbered as number
    from graphloom.plans.iterate import widely

    numbered = number(nodes.select("uid"), "uid")
    e = widely(edges, "src").join(numbered.select(F.col("uid").alias("src"), F.col("id").alias("src_id")), "src").join(numbered.select(F.col("uid").alias("dst"), F.col("id").alias("dst_id")), "dst")
    return numbered, e.select("src_id", "dst_id", "rel", "confidence")
