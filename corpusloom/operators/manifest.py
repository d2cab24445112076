"""The manifest: which source files there are, what changed, which names clash; and the index's own bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def inventory(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that can be converted: source_file, source_format, slug, sha256, size_bytes; extension, files of the others), of files
    (source_file, content or sha256, size_bytes). Hidden paths, with a part that begins with a dot, are passed over."""
    shown = files.where(~F.col("source_file").rlike(r"(^|/)\.[^/]"))
    if "sha256" not in files.columns:
        shown = shown.withColumn("sha256", F.sha2("content", 256)).withColumn("size_bytes", F.octet_length("content").cast("long"))
    known = shown.withColumn("source_format", T.format_of(F.col("source_file")))
    good = known.where("source_format IS NOT NULL").select("source_file", "source_format", T.slug_of(_with_extension(F.col("source_file"))).alias("slug"), "sha256", "size_bytes")
    other = known.where("source_format IS NULL").groupBy(T.extension(F.col("source_file")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    return good, other


def _with_extension(path: Column) -> Column:
    """The extension's dot as a hyphen, so that it stays part of the slug."""
    return F.regexp_replace(path, r"\.([^./]+)$", "-$1")


def diff(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_file, outcome, sha256: of files on disk (source_file, sha256) against a manifest (source_file, sha256, status)."""
    d = disk.select("source_file", F.col("sha256").alias("new"))
    m = manifest.select("source_file", F.col("sha256").alias("old"), "status")
    rows = d.join(m, "source_file", "full_outer")
    outcome = (
        F.when(F.col("new").isNull(), "missing")
        .when(F.col("status").isNull(), "added")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        .when(F.col("status") == "missing", "restored")
        .otherwise("unchanged")
    )
    return rows.select("source_file", outcome.alias("outcome"), F.coalesce("new", "old").alias("sha256"))


def index_diff(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """slug, action (indexed, reindexed, unchanged, deleted): of files (slug, kb_sha256) against the index's documents."""
    rows = files.select("slug", F.col("kb_sha256").alias("new")).join(indexed.select("slug", F.col("kb_sha256").alias("old")), "slug", "full_outer")
    action = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "indexed").when(F.col("old") == F.col("new"), "unchanged").otherwise("reindexed")
    return rows.select("slug", action.alias("action"))


def run_summary(actions: DataFrame) -> DataFrame:
    return actions.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("indexed", "reindexed", "unchanged", "deleted")))


def shared_slugs(manifest: DataFrame) -> DataFrame:
    """slug, sources: slugs that several present sources would write to."""
    rows = manifest.where("status = 'present'").groupBy("slug").agg(F.sort_array(F.collect_list("source_file")).alias("sources"))
    return rows.where(F.size("sources") > 1)


def selected(manifest: DataFrame, only: str | None) -> DataFrame:
    """Entries whose source file or slug holds ``only``, or matches it as a glob; all without it."""
    return manifest.where(T.glob_match(only, F.col("source_file"), F.col("slug"))) if only else manifest


def saved(manifest: DataFrame) -> DataFrame:
    """One JSON line for each entry: keys sorted, entries in order, no time in it."""
    return manifest.orderBy("source_file").select(F.to_json(F.struct(*sorted(manifest.columns)), {"ignoreNullFields": "false"}).alias("value"))


def prunable(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Outputs (path, source_file) that the manifest's missing entries wrote and no present entry owns."""
    gone = manifest.where("status = 'missing'").select("source_file")
    mine = manifest.where("status = 'present'").select(F.concat(F.lit("kb/"), "slug", F.lit(".md")).alias("path"))
    return outputs.join(gone, "source_file", "left_semi").join(mine, "path", "left_anti")


def superseded(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Outputs (path, source_file) of a source whose slug would now write elsewhere: they go once it is converted."""
    now = manifest.where("status = 'present'").select("source_file", F.concat(F.lit("kb/"), "slug", F.lit(".md")).alias("now"))
    return outputs.join(now, "source_file").where("path <> now").select("path", "source_file", "now")


def foreign_owners(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_file, path, owner: where converting an entry would overwrite another source's output."""
    now = manifest.where("status = 'present'").select("source_file", F.concat(F.lit("kb/"), "slug", F.lit(".md")).alias("path"))
    return now.join(outputs.select("path", F.col("source_file").alias("owner")), "path").where("owner <> source_file")


def conversion_status(entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """source_file, status of converting manifest entries (source_file, slug, source_format, sha256, disk_sha256, text_class, converted_sha256,
    conversion_error) given what is written (path, source_file, has_sidecar). Errors are rows, not exceptions."""
    path = F.concat(F.lit("kb/"), "slug", F.lit(".md"))
    rows = entries.withColumn("path", path).join(outputs.select("path", F.col("source_file").alias("owner"), "has_sidecar"), "path", "left")
    needs_sidecar = ~((F.col("source_format") == "pdf") & (F.col("text_class") == "needs_ocr"))
    status = (
        F.when(F.col("disk_sha256").isNull(), "skipped")
        .when(F.col("disk_sha256") != F.col("sha256"), "stale manifest")
        .when(F.col("text_class") == "error", "stop_and_ask")
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("source_file")), "foreign owner")
        .when((F.col("converted_sha256") == F.col("sha256")) & F.col("owner").isNotNull() & (~needs_sidecar | F.coalesce("has_sidecar", F.lit(False))), "unchanged")
        .when(F.col("conversion_error").isNotNull(), "failed")
        .when((F.col("source_format") == "pdf") & (F.col("text_class") == "needs_ocr"), "stub")
        .otherwise("convert")
    )
    return rows.select("source_file", "slug", status.alias("status"))


def title_of(title: Column, declared: Column, path: Column) -> Column:
    """The manifest's title, else the one that the document declares, else the file name."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(declared, F.lit("")), T.prettified(path))


def index_conflict(meta: DataFrame, model: str, dim: int, digest: str | None = None) -> DataFrame:
    """problem: why an index with ``meta`` (key, value) cannot take vectors of a model; no row if it can. Digests are compared only if both are known."""
    wanted = {"embed_model": model, "embed_dim": str(dim)} | ({"embed_digest": digest} if digest else {})
    want = meta.sparkSession.createDataFrame(sorted(wanted.items()), "key string, wanted string")
    return meta.join(want, "key").where("value <> wanted").select("key", F.concat(F.lit("index has "), "value", F.lit(", run has "), "wanted").alias("problem"))


def credential_status(tokens: DataFrame, now: Column) -> DataFrame:
    """``tokens`` (expires, revoked) with status: revoked wins over expired; without an end they are valid."""
    status = F.when(F.col("revoked").isNotNull(), "revoked").when(F.col("expires") <= now, "expired").otherwise("valid")
    return tokens.withColumn("status", status)
