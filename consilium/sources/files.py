"""Scans and sinks: JSON lines, JSON documents, CSV, ZIP members, manifests and reports."""

from __future__ import annotations

import json
import os
import subprocess
import zipfile
from collections.abc import Iterator, Mapping
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.contracts import file_sha256
from ..operators.relational import ContractError

_BAD = "_corrupt_record"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line is a row of ``schema``; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``jsonl``, skipping blank lines and naming the file and text of a line that is no JSON object."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.input_file_name())
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    bad = ~F.startswith(F.ltrim("value"), F.lit("{")) | F.col(f"row.{_BAD}").isNotNull()
    checked = parsed.withColumn("row", F.when(bad, F.raise_error(F.concat(F.lit("bad JSON in "), "file", F.lit(": "), F.substring("value", 1, 200))).cast(parsed.schema["row"].dataType)).otherwise(F.col("row")))
    return checked.select("row.*").drop(_BAD)


def lines_without_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``jsonl``, skipping lines of no character at all; a line of blanks still fails."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def nested_gold(rows: DataFrame, column: str = "ObjectEntities") -> DataFrame:
    """``rows`` whose gold is a list of alias lists; a flat list of names becomes one alias each.

    ``column`` is JSON text, since the two forms have different types.
    """
    flat = F.from_json(column, "array<string>")
    is_flat = F.col(column).rlike(r'^\s*\[\s*"')
    return rows.withColumn(column, F.when(is_flat, F.transform(flat, lambda v: F.array(v))).otherwise(F.coalesce(F.from_json(column, "array<array<string>>"), F.expr("cast(array() as array<array<string>>)"))))


def bag_union(sources: list[DataFrame]) -> DataFrame:
    """All rows of all sources, repeated ones included."""
    return reduce(lambda a, b: a.unionByName(b), sources)


def yaml_config(path: str | Path) -> dict:
    """A YAML file that must hold a mapping; needs the yaml package."""
    try:
        import yaml
    except ImportError as lacking:
        raise RuntimeError("reading YAML needs the yaml package") from lacking
    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ContractError(f"{path}: not a mapping")
    return value


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(Relation, PromptTemplate) of a CSV with a header."""
    return spark.read.schema("Relation string, PromptTemplate string").option("header", True).option("mode", "FAILFAST").csv(path)


def lists_by_key(spark: SparkSession, path: str, element: str, n: int) -> DataFrame:
    """(key, pos, item): the first ``n`` items of each list of one JSON object of lists."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,array<{element}>>").alias("m"))
    return whole.select(F.explode("m").alias("key", "items")).select("key", F.posexplode(F.slice("items", 1, n)).alias("pos", "item"))


def pools(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, pool): each key's rows in order of position."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, *[c for c in rows.columns if c not in (key, pos)]))).alias("pool"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def inventory(root: str | Path) -> tuple[list[str], str]:
    """The files of a folder and where the list is from: the index of its repository, or else the file system."""
    root = Path(root)
    if (root / ".git").exists():
        listed = subprocess.run(["git", "-C", str(root), "ls-files", "-z"], capture_output=True, text=True)
        if listed.returncode == 0:
            return sorted(p for p in listed.stdout.split("\0") if p), "git"
    return sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file()), "files"


def zip_member(spark: SparkSession, path: str, member: str, schema: str, sha256: str | None = None, rows: int | None = None) -> DataFrame:
    """The JSON lines of one member of an archive whose hash and row count are as pinned.

    The archive is opened on the executor that reads it.
    """

    @F.udtf(returnType="line string")
    class Lines:
        def eval(self, content: bytes):
            import io

            with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as f:
                for line in io.TextIOWrapper(f, encoding="utf-8"):
                    if line.strip():
                        yield (line,)

    blob = spark.read.format("binaryFile").load(path)
    if sha256:
        blob = blob.withColumn("content", F.when(F.sha2("content", 256) == sha256, F.col("content")).otherwise(F.raise_error(F.lit(f"{path}: hash differs")).cast("binary")))
    lines = blob.lateralJoin(Lines(F.col("content").outer())).select("line")
    if rows is not None and lines.count() != rows:
        raise ContractError(f"{path}: {member} has not {rows} rows")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def snapshot(spark: SparkSession, artifacts: Mapping[str, tuple[str, str, int]], schema: str, keys: tuple[str, ...]) -> dict[str, DataFrame]:
    """Artifacts (path, sha256, rows) read once verified; all must hold the same keys."""
    out: dict[str, DataFrame] = {}
    for name, (path, sha, n) in artifacts.items():
        if hashes(spark, path).where(F.col("sha256") != sha).limit(1).count():
            raise ContractError(f"{name}: hash differs")
        out[name] = jsonl(spark, path, schema)
        if out[name].count() != n:
            raise ContractError(f"{name}: not {n} rows")
    first, *rest = out.items()
    for name, df in rest:
        for a, b in ((first[1], df), (df, first[1])):
            if a.select(*keys).exceptAll(b.select(*keys)).limit(1).count():
                raise ContractError(f"{name}: keys differ from {first[0]}")
    return out


def responses(spark: SparkSession, path: str, manifest: Mapping, agent: str, schema: str) -> DataFrame:
    """One agent's responses, bound to its manifest's agent, hash and task count."""
    if manifest.get("agent_id") != agent or hashes(spark, path).where(F.col("sha256") != manifest.get("responses_sha256")).limit(1).count():
        raise ContractError(f"{path}: not the responses of {agent}'s manifest")
    rows = strict_jsonl(spark, path, schema)
    if rows.count() != manifest.get("tasks"):
        raise ContractError(f"{path}: not {manifest.get('tasks')} tasks")
    return rows


@F.arrow_udf(StringType())
def canonical_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A JSON text with sorted keys, a blank after separators, and letters as they are."""
    for batch in batches:
        yield pa.array([None if v is None else json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False) for v in batch.to_pylist()], pa.string())


def write_jsonl(df: DataFrame, path: str) -> None:
    """Lines of compact JSON, all or nothing by the commit protocol."""
    df.write.mode("overwrite").json(path)


def write_jsonl_file(df: DataFrame, target: str | Path, order: str | None = None) -> str:
    """One file of canonical JSON lines, complete or absent; its hash.

    For result files of bounded size: rows stream to the driver partition by
    partition, are flushed to disk under another name, then renamed.
    """
    target = Path(target)
    ordered = df.orderBy(order).drop(order) if order else df
    lines = ordered.select(canonical_json(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("line"))
    part = target.with_name(target.name + ".tmp")
    with open(part, "w", encoding="utf-8") as f:
        for row in lines.toLocalIterator():
            f.write(row.line + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, target)
    return file_sha256(target)


def write_manifest(value: Mapping, target: str | Path) -> None:
    Path(target).write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def write_zip(member: str | Path, target: str | Path, name: str) -> str:
    """An archive with exactly one member, read back and compared; its hash."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(member, name)
    with zipfile.ZipFile(target) as z:
        if z.namelist() != [name] or z.read(name) != Path(member).read_bytes():
            raise ContractError(f"{target}: archive differs from {member}")
    return file_sha256(target)


def write_tasks(tasks: DataFrame, path: str, key: str = "agent_id") -> dict[str, int]:
    """Task files by agent, and how many each has."""
    tasks.write.mode("overwrite").partitionBy(key).json(path)
    return {r[key]: r["n"] for r in tasks.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}


def markdown(df: DataFrame, title: str) -> str:
    """A small table as Markdown."""
    rows = df.collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
