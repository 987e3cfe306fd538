"""Report documents as JSON lines.

A report is a stream of tagged lines instead of one nested document: its lists may hold more rows
than one row or one task should carry. ``section`` names the part a line belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.bits import phash_hex
from twinsift.operators.clean import CleanPlan
from twinsift.operators.find import Found, tier_rank
from twinsift.operators.group import Grouping
from twinsift.schemas import HASH_ALGO, SCHEMA_VERSION

APP = "twinsift"
APP_VERSION = "1"
DECODER = "spark-image"


def producer(app: str = APP, version: str = APP_VERSION, decoder: str = DECODER) -> Column:
    return F.struct(
        F.lit(app).alias("app"), F.lit(version).alias("appVersion"),
        F.lit(decoder).alias("decoder"), F.lit(HASH_ALGO).alias("hashAlgo"),
    )


def asset_path(path: Column | str) -> Column:
    """Reference to a file, in the same shape as a data reference."""
    path = F.col(path) if isinstance(path, str) else path
    return F.struct(
        F.lit("path").alias("kind"), path.alias("path"),
        F.lit(None).cast("string").alias("mime"), F.lit(None).cast("string").alias("dataUri"),
    )


def asset_data(mime: Column | str, content: Column | str) -> Column:
    """Reference that carries its bytes as a data URI."""
    mime = F.col(mime) if isinstance(mime, str) else mime
    content = F.col(content) if isinstance(content, str) else content
    uri = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
    return F.struct(
        F.lit("dataUri").alias("kind"), F.lit(None).cast("string").alias("path"),
        mime.alias("mime"), uri.alias("dataUri"),
    )


def _record_fields() -> list[Column]:
    return [
        F.col("path"), F.col("bytes"), F.col("width"), F.col("height"), F.col("format"), F.col("sha256"),
        F.col("pixel_sha256").alias("pixelSha256"), phash_hex("phash").alias("phash"),
    ]


def _lines(df: DataFrame, kind: str, section: str, fields: list[Column], sort_key: Column) -> DataFrame:
    body = F.struct(F.lit(kind).alias("kind"), F.lit(section).alias("section"), *fields)
    # Null fields stay in the document: not computed is told apart from absent.
    text = F.to_json(body, {"ignoreNullFields": "false"})
    return df.select(F.lit(section).alias("section"), sort_key.cast("string").alias("sort_key"), text.alias("json"))


def _head(root: str | None, created_at: Column | None) -> list[Column]:
    head = [F.lit(SCHEMA_VERSION).alias("schemaVersion"), producer().alias("producer")]
    if root is not None:
        head.append(F.lit(root).alias("root"))
    if created_at is not None:
        head.append(created_at.alias("createdAt"))
    return head


def scan_report(
    grouping: Grouping,
    skipped: DataFrame,
    root: str,
    records: DataFrame | None = None,
    created_at: Column | None = None,
) -> DataFrame:
    """``(section, sort_key, json)`` of a scan. Without ``records`` it is the summary form."""
    spark = skipped.sparkSession
    head = _head(root, created_at) + [
        F.lit(grouping.strictness).alias("strictness"),
        F.lit(grouping.threshold).cast("int").alias("threshold"),
    ]
    out = _lines(spark.range(1), "scan", "head", head, F.lit(""))
    stats = grouping.stats(skipped)
    out = out.unionByName(
        _lines(
            stats, "scan", "stats",
            [
                F.col("scanned"), F.col("skipped"), F.col("groups"), F.col("duplicates"),
                F.col("reclaimable_bytes").alias("reclaimableBytes"),
            ],
            F.lit(""),
        )
    )
    group_key = F.lpad(F.col("group_id").cast("string"), 20, "0")
    out = out.unionByName(
        _lines(
            grouping.groups, "scan", "group",
            [
                F.col("group_id").alias("id"), F.col("strictness"), F.col("n_members").alias("memberCount"),
                F.col("keeper"), F.col("reclaimable_bytes").alias("reclaimableBytes"),
                F.col("auto_deletable").alias("autoDeletable"), F.col("max_hamming").alias("maxHamming"),
            ],
            group_key,
        )
    )
    out = out.unionByName(
        _lines(
            grouping.members, "scan", "member",
            [F.col("group_id").alias("id"), F.col("path")],
            F.concat(group_key, F.lit(" "), F.col("path")),
        )
    )
    out = out.unionByName(
        _lines(skipped, "scan", "skipped", [F.col("path"), F.col("reason")], F.col("path"))
    )
    if records is not None:
        out = out.unionByName(_lines(records, "scan", "image", _record_fields(), F.col("path")))
    return out


def find_report(
    found: Found, skipped: DataFrame, root: str, created_at: Column | None = None
) -> DataFrame:
    """``(section, sort_key, json)`` of a lookup; match lines sort in rank order."""
    spark = skipped.sparkSession
    query = spark.createDataFrame([found.query.asDict()], found.query_schema)
    head = _head(root, created_at) + [F.lit(found.threshold).alias("threshold")]
    rank_key = F.concat(
        tier_rank("tier").cast("string"), F.lit(" "), F.lpad(F.col("hamming").cast("string"), 2, "0"),
        F.lit(" "), F.col("path"),
    )
    return (
        _lines(spark.range(1), "find", "head", head, F.lit(""))
        .unionByName(_lines(query, "find", "query", _record_fields(), F.lit("")))
        .unionByName(
            _lines(found.stats(skipped), "find", "stats", [F.col("scanned"), F.col("skipped"), F.col("matched")], F.lit(""))
        )
        .unionByName(
            _lines(
                found.matches, "find", "match",
                [
                    F.col("path"), F.col("bytes"), F.col("width"), F.col("height"), F.col("format"), F.col("tier"),
                    F.col("hamming").alias("hammingDistance"),
                ],
                rank_key,
            )
        )
        .unionByName(_lines(skipped, "find", "skipped", [F.col("path"), F.col("reason")], F.col("path")))
    )


def clean_report(plan: CleanPlan, root: str, created_at: Column | None = None) -> DataFrame:
    """``(section, sort_key, json)`` of a clean-up plan. Plans are dry runs: nothing is removed."""
    spark = plan.plan.sparkSession
    head = _head(root, created_at)
    head += [F.lit(plan.grouping.strictness).alias("strictness"), F.lit(True).alias("dryRun")]
    stats = [F.col("scanned"), F.col("groups"), F.col("planned"), F.col("rejected"),
             F.col("reclaimable_bytes").alias("reclaimableBytes")]
    target = [F.col("path"), F.col("group_id").alias("groupId"), F.col("bytes"), F.col("keeper")]
    key = F.concat(F.lpad(F.col("group_id").cast("string"), 20, "0"), F.lit(" "), F.col("path"))
    return (
        _lines(spark.range(1), "clean", "head", head, F.lit(""))
        .unionByName(_lines(plan.stats(), "clean", "stats", stats, F.lit("")))
        .unionByName(_lines(plan.plan, "clean", "planned", target, key))
        .unionByName(_lines(plan.rejected, "clean", "rejected", target, key))
    )


def compare_report(compared: DataFrame, created_at: Column | None = None) -> DataFrame:
    """``(section, sort_key, json)`` of compared pairs, one line each."""
    spark = compared.sparkSession
    names = {
        "sha_equal": "shaEqual", "dims_equal": "dimsEqual", "comparable": "comparable", "pixel_equal": "pixelEqual",
        "pixel_diff_ratio": "pixelDiffRatio", "ssim": "ssim", "psnr": "psnr", "hamming": "hammingDistance",
        "verdict": "verdict",
    }
    fields = [F.col("a"), F.col("b"), *[F.col(c).alias(n) for c, n in names.items()]]
    key = F.concat(F.col("a"), F.lit(" "), F.col("b"))
    head = _lines(spark.range(1), "compare", "head", _head(None, created_at), F.lit(""))
    return head.unionByName(_lines(compared, "compare", "pair", fields, key))


def write_report(lines: DataFrame, path: str) -> None:
    """JSON lines per section, in path order inside each file and across files."""
    (
        lines.repartitionByRange("section", "sort_key")
        .sortWithinPartitions("section", "sort_key")
        .select("section", "json")
        .write.mode("errorifexists")
        .partitionBy("section")
        .text(path)
    )
