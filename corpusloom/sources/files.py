"""Source files: folders of them, and the kb's converted Markdown with its front matter and sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """source_file (relative to ``root``), sha256, size_bytes and, if asked for, content of every file below ``root``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^.*?" + _quoted(root.split("://")[-1].rstrip("/")) + "/", "")
    out = rows.select(path.alias("source_file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), *(["content"] if content else []))
    return out


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def kb_files(spark: SparkSession, root: str) -> DataFrame:
    """slug, rel_path, kb_sha256, front (map of the front matter), body of the Markdown files below ``root``.

    The hash covers the sidecar as well, so a changed sidecar alone re-indexes its document. The path below ``root`` is kept, so
    equal names in two folders stay apart.
    """
    rows = files(spark, root)
    md = rows.where(F.col("source_file").endswith(".md")).select(F.regexp_replace("source_file", r"\.md$", "").alias("stem"), "source_file", "sha256", F.col("content").cast("string").alias("text"))
    side = rows.where(F.col("source_file").endswith(".provenance.json")).select(F.regexp_replace("source_file", r"\.provenance\.json$", "").alias("stem"), F.col("sha256").alias("side_sha"), F.col("content").cast("string").alias("sidecar"))
    rows = md.join(side, "stem", "left")
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n+", "")
    return rows.select(
        F.replace("stem", F.lit("/"), F.lit("__")).alias("slug"), F.col("source_file").alias("rel_path"), F.sha2(F.concat("sha256", F.coalesce("side_sha", F.lit(""))), 256).alias("kb_sha256"),
        front_map(front).alias("front"), F.regexp_replace(body, r"\n\z", "").alias("body"), "sidecar",
    )


def front_map(front) -> F.col:
    """``key: value`` lines as a map; quotes around a value go, null and ~ are null."""
    pairs = F.regexp_extract_all(front, F.lit(r"(?m)^([a-z_0-9]+):[ \t]*(.*?)[ \t]*$"), F.lit(0))
    value = lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"^[a-z_0-9]+:", "")), "^(['\"])(.*)\\1$", "$2")
    entry = lambda p: F.struct(F.regexp_extract(p, "^([a-z_0-9]+)", 1).alias("key"), F.when(~value(p).isin("null", "~", ""), value(p)).alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


SIDECAR = "struct<content_sha256:string,blocks:array<struct<block_id:string,page:int,kind:string,confidence:string,bbox:array<double>>>>"


def sidecar_blocks(kb: DataFrame) -> DataFrame:
    """slug, block_id, page, kind, confidence, bbox of the sidecars of ``kb_files``."""
    parsed = kb.where("sidecar IS NOT NULL").select("slug", F.from_json("sidecar", SIDECAR).alias("s"))
    return parsed.select("slug", F.inline("s.blocks"))


def front_matter(meta: DataFrame) -> DataFrame:
    """slug, front: the YAML block of ``meta`` (a column for each field), fields in their fixed order, nulls written as such."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    lines = [F.concat(F.lit(f"{f}: "), F.when(F.col(f).isNull(), "null").otherwise(F.col(f).cast("string") if f in ("text_coverage", "needs_ocr") else quoted(F.col(f).cast("string")))) for f in T.FRONT_FIELDS]
    return meta.select("slug", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n")).alias("front"))


def built_front(meta: DataFrame) -> DataFrame:
    """``meta`` with what has a default: needs_ocr by class, an unconfirmed date."""
    return meta.withColumns({"needs_ocr": F.col("text_class") == "needs_ocr", "doc_date": F.coalesce(F.nullif("doc_date", F.lit("")), F.lit(T.UNCONFIRMED))})


def cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Evaluation cases from a small YAML file, read by the driver: kind is ``retrieval`` or ``answerability``."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    rows = yaml.safe_load(text) or []
    rows = rows.get("cases", []) if isinstance(rows, dict) else rows
    if kind == "retrieval":
        schema = "id string, question string, expected_slug string, expected_phrase string, expected_page int"
    else:
        schema = "id string, question string, document string, expect array<string>, forbid array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
