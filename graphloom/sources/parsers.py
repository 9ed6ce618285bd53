"""Readers of notes, diagrams, specifications, manifests and commit logs.

Text formats are parsed with DataFrame functions where a pattern is enough; Markdown and YAML-like front
matter need an order of lines and run as Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar as S


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text of each file below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))


# --- Markdown

_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_LINK = re.compile(r"(!?)\[\[([^\]|#]*)(#[^\]|]*)?(?:\|([^\]]*))?\]\]")
_TAG = re.compile(r"(?:^|(?<=\s))#([A-Za-z][\w/-]*)")
_FACTS = "path string, kind string, line int, level int, name string, extra string"


def front_matter(text: str) -> tuple[dict, int]:
    """Keys of the block between --- lines at the start (strings and lists of strings), and its lines."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, 0
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if end is None:
        return {}, 0
    out: dict = {}
    key = None
    for x in lines[1:end]:
        if m := re.match(r"^([\w-]+):\s*(.*)$", x):
            key, value = m[1], m[2].strip()
            out[key] = [v.strip().strip("\"'") for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") and value.endswith("]") else value.strip("\"'")
        elif (m := re.match(r"^\s*-\s+(.*)$", x)) and key:
            out[key] = [*([out[key]] if isinstance(out[key], str) and out[key] else out[key] or []), m[1].strip().strip("\"'")]
    return out, end + 1


def note_facts(path: str, text: str) -> list[tuple]:
    """(path, kind, line, level, name, extra): title, headings, sections, wikilinks, tags and front matter of a note."""
    meta, skipped = front_matter(text)
    out = [(path, "frontmatter", 1, 0, k, json.dumps(v)) for k, v in meta.items()]
    tags = meta.get("tags", [])
    out += [(path, "tag", 1, 0, t.lstrip("#").lower(), "") for t in ([tags] if isinstance(tags, str) else tags) if t]
    title, fence, comment = meta.get("title"), None, False
    start, heading, body = skipped + 1, "", []

    def close(upto: int) -> None:
        words = len(" ".join(body).split())
        if words or heading:
            out.append((path, "section", start, upto, heading, str(words)))

    lines = text.split("\n")
    for i, x in enumerate(lines[skipped:], skipped + 1):
        if m := _FENCE.match(x):
            fence = None if fence == m[1] else fence or m[1]
        if fence or _FENCE.match(x):
            body.append(x)
            continue
        x = re.sub(r"%%.*?%%", "", x)
        if "%%" in x:
            comment = not comment
            x = x.split("%%")[0] if comment else x.split("%%", 1)[1]
        elif comment:
            continue
        if m := _HEADING.match(x):
            close(i - 1)
            start, heading, body = i, m[2], []
            out.append((path, "heading", i, len(m[1]), m[2], re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", m[2].lower())).strip("-")))
            title = title or (m[2] if len(m[1]) == 1 else None)
        else:
            body.append(x)
        clean = re.sub(r"`[^`]*`", "", x)
        out += [(path, "wikilink", i, int(bool(m[1])), (m[2].strip() + (m[3] or "")), m[4] or "") for m in _LINK.finditer(clean)]
        out += [(path, "tag", i, 0, t.lower(), "") for t in _TAG.findall(clean)]
    close(len(lines))
    out.append((path, "title", 1, 0, title or path.rsplit("/", 1)[-1].removesuffix(".md"), ""))
    return out


def _rows(batches: Iterator[pa.RecordBatch], parse) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FACTS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for b in batches:
        rows = [r for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) if t is not None for r in parse(p or "", t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)


def markdown(files: DataFrame) -> DataFrame:
    """Facts of notes (path, text)."""
    return files.select("path", "text").mapInArrow(lambda b: _rows(b, note_facts), _FACTS)


_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_SKIP = re.compile(r"https?://\S+|\[\[[^\]]*\]\]|\]\([^)]*\)")
_NAME = re.compile(r"(?<![\w.])([A-Za-z_]\w*)(\()?|\.([A-Za-z_]\w*)")


def _distinctive(name: str) -> bool:
    core = name.strip("_")
    return "_" in core and any(c.isalpha() for c in core) or bool(re.search(r"[a-z0-9][A-Z]", name))


def mentions(path: str, text: str) -> list[tuple]:
    """(path, 'mention', line, call, name, place): identifiers that a note names, in a span, in code or in prose."""
    out, fence = [], None
    for i, x in enumerate(text.split("\n"), 1):
        if m := _FENCE.match(x):
            fence = None if fence == m[1] else fence or m[1]
            continue
        pieces = [("code", x)] if fence else []
        if not fence:
            at = 0
            for m in re.finditer(r"`([^`]+)`", x):
                pieces += [("prose", x[at : m.start()]), ("span", m[1])]
                at = m.end()
            pieces.append(("prose", x[at:]))
        for place, piece in pieces:
            if place == "span" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)(\(\))?\s*", piece)):
                out.append((path, "mention", i, int(bool(m[2])), m[1], "span"))
                continue
            where = "prose" if place == "prose" else "code"
            clean = _SKIP.sub(" ", _STRING.sub(" ", piece) if where == "code" else piece)
            for m in _NAME.finditer(clean):
                name, call = m[1] or m[3], bool(m[2])
                if _distinctive(name) or call:
                    out.append((path, "mention", i, int(call), name, where))
    return out


def code_mentions(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInArrow(lambda b: _rows(b, mentions), _FACTS)


# --- diagrams and queries in notes


def canvas(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON Canvas files."""
    doc = files.select("path", F.from_json("text", "nodes array<struct<id:string,type:string,file:string,text:string,url:string,label:string>>, edges array<struct<id:string,fromNode:string,toNode:string,label:string>>").alias("c"))
    return doc.select("path", F.explode("c.nodes").alias("n")).select("path", "n.*"), doc.select("path", F.explode("c.edges").alias("e")).select("path", "e.*")


_ARROW = r"([A-Za-z0-9_]+)(?:[\[\(\{]+[^\]\)\}]*[\]\)\}]+)?\s*(?:-->|---|-\.->|==>|->>|-->>)(?:\|([^|]*)\|)?\s*([A-Za-z0-9_]+)"


def mermaid(files: DataFrame) -> DataFrame:
    """path, src, dst, label: the arrows of a diagram; a chain is one arrow for each step."""
    line = files.select("path", F.explode(F.split("text", r"\n")).alias("l"))
    # a step starts where the one before ends, so the pattern looks ahead
    step = [F.regexp_extract_all("l", F.lit(rf"(?=\b{_ARROW})"), F.lit(k)).alias(name) for k, name in ((1, "a"), (2, "b"), (3, "c"))]
    steps = line.select("path", *step)
    return steps.select("path", F.explode(F.arrays_zip("a", "b", "c")).alias("x")).select("path", F.col("x.a").alias("src"), F.col("x.c").alias("dst"), F.coalesce(F.trim("x.b"), F.lit("")).alias("label"))


def dataview(files: DataFrame) -> DataFrame:
    """path, kind, fields, source, condition of a query block; parsed, never run."""
    t = F.regexp_replace("text", r"\s+", " ")
    return files.select(
        "path", F.upper(F.regexp_extract(t, r"(?i)^\s*(TABLE|LIST|TASK|CALENDAR)\b", 1)).alias("kind"), F.trim(F.regexp_extract(t, r"(?i)^\s*(?:TABLE|LIST|TASK|CALENDAR)\s+(?:WITHOUT ID\s+)?(.*?)(?:\s+FROM\b|\s+WHERE\b|\s+SORT\b|$)", 1)).alias("fields"),
        F.trim(F.regexp_extract(t, r"(?i)\bFROM\s+(.*?)(?:\s+WHERE\b|\s+SORT\b|\s+LIMIT\b|\s*$)", 1)).alias("source"), F.trim(F.regexp_extract(t, r"(?i)\bWHERE\s+(.*?)(?:\s+SORT\b|\s+LIMIT\b|\s*$)", 1)).alias("condition"),
    ).where("kind <> ''")


def html_to_markdown(column: str):
    """HTML as Markdown: headings, emphasis, links, lists, paragraphs; other markup goes."""
    x = F.regexp_replace(F.col(column), r"(?is)<(script|style|head|nav|footer)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "")
    for k in range(1, 7):
        x = F.regexp_replace(x, rf"(?is)<h{k}\b[^>]*>(.*?)</h{k}>", "\n\n" + "#" * k + " $1\n\n")
    for pattern, to in ((r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", "**$1**"), (r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)>", "*$1*"), (r"(?is)<code\b[^>]*>(.*?)</code>", "`$1`"), (r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</?(?:p|div|article|section|ul|ol|table|tr)\b[^>]*>", "\n\n"), (r"<[^>]+>", ""), (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", "\""), (r"&amp;", "&"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))


def looks_like_html(column: str):
    return F.col(column).rlike(r"(?is)^\s*(<!doctype html|<html\b|<(div|p|article|body|h[1-6])\b)")


# --- specifications and manifests


def openapi(files: DataFrame) -> DataFrame:
    """path, verb, route, operation_id, source of OpenAPI documents in JSON."""
    op = "struct<operationId:string>"
    doc = files.select("path", F.from_json(F.get_json_object("text", "$.paths"), f"map<string,map<string,{op}>>").alias("p"))
    routes = doc.select("path", F.explode("p").alias("route", "ops")).select("path", "route", F.explode("ops").alias("verb", "op"))
    return routes.where(F.lower("verb").isin("get", "put", "post", "delete", "patch", "head", "options", "trace")).select("path", F.upper("verb").alias("verb"), S.normalize_http_path("route").alias("route"), F.col("op.operationId").alias("operation_id"))


def openapi_parameters(files: DataFrame) -> DataFrame:
    """operation, location, name, type, required."""
    par = "array<struct<name:string,`in`:string,required:boolean,schema:struct<type:string>>>"
    doc = files.select("path", F.from_json(F.get_json_object("text", "$.paths"), f"map<string,map<string,struct<parameters:{par}>>>").alias("p"))
    ops = doc.select("path", F.explode("p").alias("route", "ops")).select("path", "route", F.explode("ops").alias("verb", "op"))
    each = ops.select("path", F.concat(F.upper("verb"), F.lit(" "), S.normalize_http_path("route")).alias("operation"), F.explode("op.parameters").alias("x"))
    return each.select("path", "operation", F.col("x.in").alias("location"), "x.name", F.coalesce("x.schema.type", F.lit("any")).alias("type"), F.coalesce("x.required", F.lit(False)).alias("required"))


def proto(files: DataFrame) -> DataFrame:
    """path, service, method of protobuf files: package-qualified services and their calls."""
    package = F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    service = files.select("path", package.alias("package"), F.explode(F.regexp_extract_all("text", F.lit(r"(?s)service\s+\w+\s*\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0))).alias("s"))
    return service.select("path", F.concat_ws(".", F.nullif("package", F.lit("")), F.regexp_extract("s", r"service\s+(\w+)", 1)).alias("service"), F.explode(F.regexp_extract_all("s", F.lit(r"rpc\s+(\w+)"), F.lit(1))).alias("method"))


def graphql(files: DataFrame) -> DataFrame:
    """path, root, field of the root types of a schema."""
    t = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)type\s+(?:Query|Mutation|Subscription)\s*\{[^}]*\}"), F.lit(0))).alias("t"))
    return t.select("path", F.regexp_extract("t", r"type\s+(\w+)", 1).alias("root"), F.explode(F.regexp_extract_all(F.regexp_replace("t", r"\([^)]*\)", ""), F.lit(r"(?m)^\s*(\w+)\s*:"), F.lit(1))).alias("field"))


def manifests(files: DataFrame) -> DataFrame:
    """path, package, dependency of package.json, Cargo.toml, go.mod, pyproject.toml and requirements files."""
    name, t = S.file_name("path"), F.col("text")
    js = files.where(name == "package.json").select("path", F.get_json_object("text", "$.name").alias("package"), F.explode(F.map_keys(F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies")]))).alias("dependency"))
    toml = files.where(name.isin("Cargo.toml")).select("path", F.regexp_extract(t, r'(?m)^name\s*=\s*"([^"]+)"', 1).alias("package"), F.explode(F.regexp_extract_all(F.regexp_extract(t, r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1), F.lit(r"(?m)^\s*([\w-]+)\s*="), F.lit(1))).alias("dependency"))
    go = files.where(name == "go.mod").select("path", F.regexp_extract(t, r"(?m)^module\s+(\S+)", 1).alias("package"), F.explode(F.regexp_extract_all(t, F.lit(r"(?m)^\s*(?:require\s+)?(\S+\.\S+/\S+)\s+v"), F.lit(1))).alias("dependency"))
    py = files.where(name.rlike(r"^requirements.*\.txt$")).select("path", F.lit("").alias("package"), F.explode(F.regexp_extract_all(t, F.lit(r"(?m)^([A-Za-z0-9_.-]+)"), F.lit(1))).alias("dependency"))
    return js.unionByName(toml).unionByName(go).unionByName(py)


def git_log(lines: DataFrame) -> DataFrame:
    """commit_id, epoch, file: from the text of logs (repo, text) whose entries are a hash, a time and paths.

    An entry starts at a line of forty hex digits; the log is cut there, so that a commit's lines stay together.
    """
    entry = lines.select("repo", F.explode(F.split("text", r"(?m)(?=^[0-9a-f]{40}\b)")).alias("e")).where(F.col("e").rlike(r"^[0-9a-f]{40}"))
    head = F.regexp_extract("e", r"^([0-9a-f]{40})", 1)
    time = F.regexp_extract("e", r"^[0-9a-f]{40}\s+(\S+)", 1)
    lines_of = F.split("e", r"\n")
    rows = entry.select("repo", head.alias("commit_id"), F.coalesce(time.try_cast("double"), S.iso_epoch(time)).alias("epoch"), F.explode(F.slice(lines_of, F.lit(2), F.size(lines_of) - 1)).alias("file"))
    return rows.withColumn("file", F.trim("file")).where("file <> ''")
