"""Readers and writers: clip folders, manifests, text lists, lexicons, JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.text import token_norm
from seqloom.operators.manifest import MANIFEST_SCHEMA, VIDEO_SUFFIXES, clip_catalog

RECORDING_SCHEMA = "file string, prompt string, signer string, mode string, seconds double"
EMISSION_SCHEMA = "t double, gloss string, conf double, margin double, frames int"
ENTRY_SCHEMA = "struct<vi:string,pos:string,tense:string>"

__all__ = ["token_norm"]


def list_clips(spark: SparkSession, root: str, suffixes=VIDEO_SUFFIXES) -> DataFrame:
    """Clips below <root>/<label>/ with label and stem; file content is never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    )
    return clip_catalog(files, "path", suffixes)


def to_half(x: Column) -> Column:
    """The binary16 number nearest to x (ties to even) as its 16 bits in a smallint; too large ones are infinite."""
    a = F.abs(x)
    guess = F.floor(F.log2(F.greatest(a, F.lit(2.0**-14))))
    # the logarithm may be off by one next to a power of two
    e = guess + F.when(a >= F.pow(F.lit(2.0), guess + 1), 1).when((a < F.pow(F.lit(2.0), guess)) & (guess > -14), -1).otherwise(0)
    bits = (e + 15) * 1024 + F.rint(a * F.pow(F.lit(2.0), 10 - e)) - 1024
    bits = F.when(F.isnan(x), 32256).when(a >= 65520, 31744).otherwise(bits)
    return F.when(x < 0, bits - 32768).otherwise(bits).cast("smallint")


def from_half(h: Column) -> Column:
    """The double of 16 bits of a binary16 number."""
    bits = h.cast("int").bitwiseAND(F.lit(32767))
    e, m = F.shiftright(bits, 10), bits.bitwiseAND(F.lit(1023))
    v = F.when(e == 0, m * F.lit(2.0**-24)).when(e < 31, (m + 1024) * F.pow(F.lit(2.0), e - 25)).when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(h < 0, -v).otherwise(v)


def with_split_tag(df: DataFrame, tag: str) -> DataFrame:
    """A constant split column, as a folder of clips is tagged as a whole."""
    return df.withColumn("split", F.lit(tag))


def write_frames(frames: DataFrame, path: str, partition: str | None = "split", half: bool = False, mode: str = "overwrite") -> None:
    """Landmark frames as parquet, coordinates as floats or (half) as the bits of binary16 numbers.

    With a split column the files are parted by it, so readers of one split open its files alone.
    """
    arrays = [c for c, t in frames.dtypes if t == "array<double>"]
    stored = lambda c: F.transform(c, to_half) if half else F.col(c).cast("array<float>")
    out = frames.withColumns({c: stored(c) for c in arrays})
    w = out.write.mode(mode)
    (w.partitionBy(partition) if partition and partition in frames.columns else w).parquet(path)


def read_frames(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Landmark frames with double coordinates, of one split if named (only its files are read)."""
    f = spark.read.parquet(path)
    if split is not None:
        f = f.filter(F.col("split") == split)
    back = {"array<float>": lambda c: F.col(c).cast("array<double>"), "array<smallint>": lambda c: F.transform(c, from_half)}
    return f.withColumns({c: back[t](c) for c, t in f.dtypes if t in back})


def with_default_points(frames: DataFrame) -> DataFrame:
    """Absent landmark blocks become zeros and their flags false."""
    sizes = {"pose": 18, "pose_vis": 9, "lhand": 42, "rhand": 42, "face": 40}
    fill = {c: F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), n)) for c, n in sizes.items() if c in frames.columns}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("pose_ok", "lhand_ok", "rhand_ok") if c in frames.columns}
    return frames.withColumns({**fill, **flags})


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST_SCHEMA) -> DataFrame:
    """Manifest CSV with a header; ids are strings and missing text is ''.

    Columns are matched by name, so older files with fewer columns still load.
    """
    raw = spark.read.option("header", "true").csv(path)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in raw.columns]
    rest = [F.col(c) for c in raw.columns if c not in schema.names]
    text = [f.name for f in schema if isinstance(f.dataType, T.StringType) and f.name in raw.columns]
    return raw.select(*cols, *rest).na.fill("", text)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Text list: trimmed lines without blanks and # comments, in file order (``ord``: file, place in the file)."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("ord"))
    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("ord", F.trim("value").alias("value"))


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """The recording log: one JSON object a clip, appended as clips are recorded."""
    return spark.read.schema(RECORDING_SCHEMA).json(path)


def read_reference_sentences(spark: SparkSession, path: str) -> DataFrame:
    """One gloss sequence per line, normalised tokens."""
    return read_list(spark, path).select("ord", F.transform(F.split("value", r"\s+"), token_norm).alias("ref"))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(summary: DataFrame, per_video: DataFrame, key: str, path: str) -> None:
    """One JSON document {"summary": {...}, "per_video": [...]}, written in parts.

    summary has one row; per_video a row for each value of the unique ``key``, in whose order they are listed.
    The document is the folder's part files one after the other: the tasks write stretches of
    it, no row or task holds all videos, and the finished folder takes its name by a rename.
    """
    spark = summary.sparkSession
    first = per_video.agg(F.min(key)).scalar()
    null = F.lit(None).cast(per_video.schema[key].dataType)
    to_json = lambda df: F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    head = summary.select(F.lit(0).alias("part"), null.alias("k"), F.concat(F.lit('{"summary": '), to_json(summary), F.lit(', "per_video": [')).alias("value"))
    body = per_video.select(F.lit(1).alias("part"), F.col(key).alias("k"), F.concat(F.when(F.col(key) == first, "").otherwise(","), to_json(per_video)).alias("value"))
    foot = summary.select(F.lit(2).alias("part"), null.alias("k"), F.lit("]}").alias("value"))
    lines = head.unionByName(body).unionByName(foot).repartitionByRange("part", "k").sortWithinPartitions("part", "k")
    draft = f"{path}._draft-{uuid.uuid4().hex[:12]}"
    lines.select("value").write.text(draft)
    jvm = spark.sparkContext._jvm
    new, final = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(path)
    store = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(final, True)
    if not store.rename(new, final):
        raise OSError(f"could not move {draft} to {path}")


def read_report(spark: SparkSession, path: str, summary: str, per_video: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of a report, by their schemas; each line holds one object."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith('{"summary": '))
    text = F.regexp_extract("value", r'^\{"summary": (.*), "per_video": \[$', 1)
    rows = lines.filter(~F.col("value").startswith('{"summary": ') & (F.col("value") != "]}"))
    one = lambda df, c, schema: df.select(F.from_json(c, schema).alias("o")).select("o.*")
    return one(head, text, summary), one(rows, F.regexp_replace("value", "^,", ""), per_video)


def parse_lexicon(lines: DataFrame, json: str, order: str) -> DataFrame:
    """Lexicon entries of JSON objects {gloss: {vi,pos,tense} | "vi"}.

    Keys starting with _ are comments; a bare string is the vi value alone.
    """
    e = lines.select(F.col(order).alias("ord"), F.explode(F.from_json(json, T.MapType(T.StringType(), T.StringType()))).alias("k", "v"))
    e = e.filter(~F.col("k").startswith("_"))
    obj = F.from_json("v", ENTRY_SCHEMA)
    is_obj = F.col("v").startswith("{")
    entry = F.when(is_obj, obj).otherwise(F.struct(F.col("v").alias("vi"), F.lit(None).cast("string").alias("pos"), F.lit(None).cast("string").alias("tense")))
    return e.select("ord", token_norm(F.col("k")).alias("gloss"), entry.alias("e")).select("ord", "gloss", "e.vi", "e.pos", "e.tense")


def override_lexicon(defaults: DataFrame, extra: DataFrame) -> DataFrame:
    """Defaults replaced whole by the last extra entry of the same gloss."""
    last = extra.groupBy("gloss").agg(F.max_by(F.struct("vi", "pos", "tense"), "ord").alias("e")).select("gloss", "e.vi", "e.pos", "e.tense")
    kept = defaults.select("gloss", "vi", "pos", "tense").join(last.select("gloss"), "gloss", "left_anti")
    return last.unionByName(kept)


def load_lexicon(spark: SparkSession, path: str, defaults: DataFrame) -> DataFrame:
    """Lexicon file (one JSON object) laid over the defaults."""
    lines = spark.read.text(path, wholetext=True).select(F.lit(0).alias("ord"), F.col("value").alias("json"))
    return override_lexicon(defaults, parse_lexicon(lines, "json", "ord"))
