"""Readers, checks and writers of document packs: Markdown with frontmatter, page texts, JSON lines, manifests."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python import nfc

DOCUMENT = (
    "id string, kind string, institution string, rule string, label string, title string, effective string, amended string, status string, body string, "
    "legal_basis array<struct<law:string,article:string,mst:string>>, refs array<struct<target:string,kind:string>>, pages array<int>, supersedes string, table_structured boolean"
)
COLUMNS = ("id", "kind", "institution", "rule", "label", "title", "effective", "amended", "status", "body", "legal_basis", "refs", "pages", "supersedes", "table_structured")
EDGE = "src string, dst string, kind string, meta map<string,string>"
NODE = "id string, kind string, label string, meta map<string,string>"
QLOG = "ts string, question string, mode string, app_version string, install_id string, miss boolean, search_miss boolean"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all .md files below a folder; an absent folder has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.format("text").options(wholetext="true", recursiveFileLookup="true", pathGlobFilter="*.md").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def split_frontmatter(files: DataFrame) -> DataFrame:
    """Adds head and body: '---' first, up to the first line of '---'. A file without either fails the load."""
    t = F.col("text")
    ok = t.startswith("---\n") & (F.instr(F.substring(t, F.lit(4), F.length(t)), "\n---") > 0)
    checked = F.when(ok, t).otherwise(F.raise_error(F.concat(F.lit("no frontmatter: "), F.col("path"))))
    at = F.instr(F.substring(checked, F.lit(4), F.length(checked)), "\n---") + 3
    rest = F.regexp_replace(F.substring(t, at + 4, F.length(t)), r"^\n+", "")
    return files.withColumn("head", F.substring(checked, F.lit(5), at - 5)).withColumn("body", rest)


def scalar(head: Column, key: str) -> Column:
    """A top-level scalar of the emitted YAML subset, unquoted; null if absent or null."""
    raw = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    inner = F.when(raw.rlike('^".*"$'), F.replace(F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).when(raw.rlike("^'.*'$"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(head.rlike(rf"(?m)^{key}:") & ~raw.isin("null", "~"), inner)


def block(head: Column, key: str, fields: tuple[str, ...], ddl: str) -> Column:
    """A list of maps below a key: '  - a: x' and further indented keys."""
    text = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\n((?:[ \t]+.*\n?)*)", 1)
    items = F.filter(F.split(text, r"(?m)^\s*-\s+"), lambda x: F.btrim(x) != "")

    def field(x: Column, f: str) -> Column:
        raw = F.regexp_extract(x, rf"(?m)^\s*{f}:[ \t]*(.*?)[ \t]*$", 1)
        v = F.regexp_replace(raw, r"^[\"'](.*)[\"']$", "$1")
        return F.when((v != "") & (v != "null"), v)

    return F.transform(F.filter(items, lambda x: x.contains(":")), lambda x: F.struct(*[field(x, s).alias(n) for s, n in zip(fields, re.findall(r"(\w+):", ddl), strict=True)]))


def int_list(head: Column, key: str) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*?)\]", 1), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Articles and annexes of a folder of Markdown files, in the columns of DOCUMENT. A broken file fails the load."""
    return parse_documents(markdown_files(spark, path))


def parse_documents(files: DataFrame) -> DataFrame:
    d = split_frontmatter(files)
    h = F.col("head")
    annex = F.coalesce(scalar(h, "type") == "annex", F.lit(False))
    label = F.when(annex, scalar(h, "annex")).otherwise(scalar(h, "article"))
    needed = F.when(scalar(h, "rule").isNull() | label.isNull(), F.raise_error(F.concat(F.lit("rule or label missing: "), F.col("path")))).otherwise(scalar(h, "rule"))
    pages = F.when(F.size(int_list(h, "pages")) > 0, int_list(h, "pages")).otherwise(int_list(h, "source_pages"))
    out = d.select(
        F.when(annex, "annex").otherwise("article").alias("kind"), scalar(h, "institution").alias("institution"), nfc(needed).alias("rule"), label.alias("label"), F.coalesce(scalar(h, "title"), F.lit("")).alias("title"),
        scalar(h, "effective").alias("effective"), F.coalesce(scalar(h, "amended"), scalar(h, "effective")).alias("amended"), F.coalesce(scalar(h, "status"), F.lit("")).alias("status"), "body",
        block(h, "legal_basis", ("law", "article", "mst"), "law:string,article:string,mst:string").alias("legal_basis"), block(h, "refs", ("target", "type"), "target:string,kind:string").alias("refs"),
        pages.alias("pages"), scalar(h, "supersedes").alias("supersedes"), F.coalesce(scalar(h, "table_structured") == "true", F.lit(False)).alias("table_structured"),
    )
    return out.withColumn("id", F.concat(X.slugify("rule"), F.lit("#"), "label")).select(*COLUMNS)


def annex_refs(docs: DataFrame) -> DataFrame:
    return docs.withColumn("annex_refs", F.transform(F.filter("refs", lambda r: F.substring_index(r["target"], "#", -1).rlike("^별[표지]")), lambda r: r["target"]))


def read_pages(spark: SparkSession, path: str) -> DataFrame | None:
    """(page, text) of N.txt files of a folder; None if there is no folder."""
    if not exists(spark, path):
        return None
    files = spark.read.format("text").options(wholetext="true", pathGlobFilter="*.txt").load(path)
    page = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.txt$", 1).try_cast("int")
    return files.select(page.alias("page"), F.col("value").alias("text")).filter("page is not null")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; absent means empty, blank lines are skipped, a bad line fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_qlogs(spark: SparkSession, path: str) -> DataFrame:
    """Question logs qlog-*.jsonl of a folder, in file order; a miss of either kind counts; blank questions are skipped."""
    rows = spark.read.schema(QLOG).option("pathGlobFilter", "qlog-*.jsonl").json(path, mode="FAILFAST")
    miss = F.coalesce("miss", F.lit(False)) | F.coalesce("search_miss", F.lit(False))
    return rows.select(F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id()).alias("ord"), "ts", "question", "mode", miss.alias("miss")).filter(F.btrim("question") != "")


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file; citations_in_context only where it is a real boolean."""
    rows = spark.read.schema("reason string, question string, message_id string, trace struct<citations_in_context:string,extracted_citations:array<string>>").option("pathGlobFilter", "*.json").json(path, multiLine=True)
    flag = F.col("trace.citations_in_context")
    return rows.select(F.col("_metadata.file_name").alias("ord"), "reason", "question", "message_id", F.when(flag == "true", True).when(flag == "false", False).alias("citations_in_context"), F.col("trace.extracted_citations").alias("extracted_citations"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files below a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.removeprefix("file://").rstrip("/") + "/"
    return files.select(F.substring_index(F.col("path"), root, -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of a full join of files and manifest (path, sha256): ok, missing, unlisted, mismatch or unsafe."""
    m = manifest.select("path", F.lower("sha256").alias("want"))
    both = files.filter("path != 'manifest.json'").select("path", F.lower("sha256").alias("have")).join(m, "path", "full_outer")
    state = F.when(F.col("want").isNotNull() & ~X.safe_path("path"), "unsafe").when(F.col("want").isNull(), "unlisted").when(F.col("have").isNull(), "missing").when(F.col("want") != F.col("have"), "mismatch").otherwise("ok")
    return both.select("path", state.alias("state"))


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A pack's manifest (one small file) and its list of files."""
    text = spark.read.format("text").option("wholetext", "true").load(f"{path}/manifest.json").head()[0]
    m = json.loads(text)
    if m.get("schema_version") != 1:
        raise ValueError(f"schema_version {m.get('schema_version')}")
    return m, spark.createDataFrame(list(m["files"].items()), "path string, sha256 string")


def open_pack(spark: SparkSession, path: str) -> dict:
    """A verified pack as DataFrames: articles, annexes, pages, nodes, edges; and its manifest. Any file that is not ok fails."""
    manifest, listed = read_manifest(spark, path)
    bad = verify(file_hashes(spark, path), listed).filter("state != 'ok'").orderBy("path").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.state}: {r.path}" for r in bad))
    docs = read_documents(spark, f"{path}/articles")
    return {
        "manifest": manifest, "articles": annex_refs(docs), "annexes": read_documents(spark, f"{path}/annexes"), "pages": read_pages(spark, f"{path}/pages"),
        "nodes": read_jsonl(spark, f"{path}/graph/nodes.jsonl", NODE), "edges": read_jsonl(spark, f"{path}/graph/edges.jsonl", EDGE),
    }


def render_markdown(docs: DataFrame) -> DataFrame:
    """(id, text): articles as Markdown with frontmatter in a fixed order of keys."""
    q = lambda c: X.yaml_scalar(F.coalesce(F.col(c), F.lit("")))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    y = lambda v: X.yaml_scalar(F.coalesce(v, F.lit("")))
    basis = F.transform("legal_basis", lambda b: F.concat(F.lit("  - law: "), y(b["law"]), F.lit("\n    article: "), y(b["article"]), F.lit("\n    mst: "), y(b["mst"])))
    refs = F.transform("refs", lambda r: F.concat(F.lit("  - target: "), y(r["target"]), F.lit("\n    type: "), y(r["kind"])))
    listed = lambda k, items: F.concat(F.lit(f"{k}:\n"), F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise("  []"))
    head = F.concat_ws(
        "\n", F.lit("---"), line("institution", q("institution")), line("rule", q("rule")), line("article", q("label")), line("title", q("title")), line("effective", q("effective")), line("amended", q("amended")),
        line("status", q("status")), line("supersedes", F.coalesce(X.yaml_scalar(F.col("supersedes")), F.lit("null"))), listed("legal_basis", basis), listed("refs", refs),
        line("pages", F.concat(F.lit("["), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("]"))), F.lit("---"), F.lit(""), F.col("body"),
    )
    return docs.select("id", head.alias("text"))


def render_annexes(docs: DataFrame) -> DataFrame:
    """(id, text): annexes as Markdown with frontmatter in a fixed order of keys."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    named = [line(k, X.yaml_scalar(F.coalesce(c, F.lit("")))) for k, c in (("institution", "institution"), ("rule", "rule"), ("annex", "label"), ("title", "title"), ("effective", "effective"), ("status", "status"))]
    pages = F.concat(F.lit("["), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("]"))
    flag = F.coalesce("table_structured", F.lit(False)).cast("string")
    return docs.select("id", F.concat_ws("\n", F.lit("---"), F.lit("type: annex"), *named, line("pages", pages), line("table_structured", flag), F.lit("---"), F.lit(""), F.col("body")).alias("text"))


def write_pages(pages: DataFrame, path: str) -> None:
    """One text file a page, below a folder of its number."""
    pages.select(F.format_string("%04d", "page").alias("page"), "text").write.partitionBy("page").text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def manifest_of(spark: SparkSession, path: str, meta: dict) -> dict:
    """The manifest of a folder: each file but the manifest itself with its digest."""
    files = file_hashes(spark, path).filter("path != 'manifest.json'").orderBy("path")
    return {"schema_version": 1, **meta, "files": {r["path"]: r["sha256"] for r in files.toLocalIterator()}}  # the manifest is one file
