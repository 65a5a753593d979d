"""Pack archives and folders without a manifest. An archive is one file: it is opened on the driver, once, and lands as a folder."""

from __future__ import annotations

import tarfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.documents import modal_effective
from . import packs


def unpack(archive: str, target: str) -> list[str]:
    """Files of a .tar.zst archive below a folder; anything but plain files and folders at safe relative paths fails."""
    import zstandard

    out = []
    with open(archive, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
        for m in tar:
            path = PurePosixPath(m.name)
            if path.is_absolute() or ".." in path.parts or not m.name.strip("./") and not m.isdir() or not (m.isfile() or m.isdir()):
                raise ValueError(f"unsafe entry: {m.name}")
            to = Path(target, *[p for p in path.parts if p != "."])
            if m.isdir():
                to.mkdir(parents=True, exist_ok=True)
            else:
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(tar.extractfile(m).read())
                out.append(str(path))
    return sorted(out)


def pack(folder: str, archive: str, level: int = 19) -> None:
    """A folder as .tar.zst, names sorted, without times or owners, so equal folders give equal archives."""
    import zstandard

    with open(archive, "wb") as f, zstandard.ZstdCompressor(level=level).stream_writer(f) as out, tarfile.open(fileobj=out, mode="w|") as tar:
        for p in sorted(x for x in Path(folder).rglob("*") if x.is_file()):
            info = tarfile.TarInfo(str(p.relative_to(folder)))
            info.size = p.stat().st_size
            with p.open("rb") as member:
                tar.addfile(info, member)


def resolve(spark: SparkSession, path: str, institution: str) -> dict:
    """A pack from a folder with a manifest, or a bare folder of articles, whose date is the commonest of its articles."""
    if packs.exists(spark, f"{path}/manifest.json"):
        return packs.open_pack(spark, path)
    docs = packs.annex_refs(packs.read_documents(spark, path)).withColumn("institution", F.lit(institution))
    date = modal_effective(docs).head()
    manifest = {"schema_version": 1, "institution": institution, "effective_date": date["effective"] if date else "unknown", "source_commit": "bare-dir"}
    none = spark.createDataFrame([], docs.schema)
    return {"manifest": manifest, "articles": docs, "annexes": none, "pages": None, "nodes": spark.createDataFrame([], packs.NODE), "edges": spark.createDataFrame([], packs.EDGE)}


def lenient_head(files: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Frontmatter as the verifier reads it: up to a line of '---', indented lines ignored, none at all allowed."""
    t = F.col("text")
    end = F.instr(t, "\n---\n")
    has = t.startswith("---\n") & (end > 0)
    head = F.when(has, F.substring(t, F.lit(5), end - 5)).otherwise("")
    body = F.when(has, F.substring(t, end + 5, F.length(t))).otherwise(t)
    return files.select("path", *[packs.scalar(head, k).alias(k) for k in keys], packs.int_list(head, "pages").alias("pages"), X.normalize_title(body).alias("body"))


def sample_questions(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first n golden questions of a JSON-lines file (the report's own limit)."""
    rows = packs.read_jsonl(spark, path, "q string, expect array<string>")
    return rows.withColumn("ord", F.monotonically_increasing_id()).orderBy("ord").limit(n).drop("ord")
