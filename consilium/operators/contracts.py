"""Fail-closed contracts: violations are rows, and one guard turns them into an error."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .relational import ContractError, bounded, coverage

CAP = 25


def require(violations: DataFrame, name: str, cap: int = CAP) -> None:
    """An error naming up to ``cap`` violations, or nothing."""
    found = violations.limit(cap).collect()
    if found:
        raise ContractError(f"{name}: {[tuple(r) for r in found]}")


def input_violations(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """Blank subjects, unknown relations and repeated keys."""
    keys = ["SubjectEntity", "Relation"]
    blank = rows.where(F.col("SubjectEntity").isNull() | (strip(F.col("SubjectEntity")) == "")).select(*keys, F.lit("blank subject").alias("problem"))
    known = bounded(relations.select("Relation"))
    unknown = rows.join(known, "Relation", "left_anti").select(*keys, F.lit("unknown relation").alias("problem"))
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("duplicate key").alias("problem"))
    return blank.unionByName(unknown).unionByName(twice)


def prediction_violations(pred: DataFrame, reference: DataFrame, relations: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Coverage, repeated keys, null or blank items, and empty answers of relations that always have one."""
    keys = ["SubjectEntity", "Relation"]
    out = coverage(pred, reference, keys)
    twice = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("duplicate key").alias("problem"))
    blank = pred.where(F.col("ObjectEntities").isNull() | F.exists("ObjectEntities", lambda v: v.isNull() | (strip(v) == ""))).select(*keys, F.lit("not a list of strings").alias("problem"))
    out = out.unionByName(twice).unionByName(blank)
    if not allow_empty:
        never = bounded(relations.where("never_empty").select("Relation"))
        out = out.unionByName(pred.join(never, "Relation", "left_semi").where(F.size("ObjectEntities") == 0).select(*keys, F.lit("empty answer").alias("problem")))
    return out


def raw_violations(raw: DataFrame, n_samples: int, exclude_target: bool = False) -> DataFrame:
    """Sample counts, array lengths, and demonstrations that hold the target itself."""
    keys = ["SubjectEntity", "Relation"]
    count = raw.where(F.size("raw_samples") != n_samples).select(*keys, F.lit("sample count").alias("problem"))
    length = raw.where(F.size("sample_statuses") != F.size("raw_samples")).select(*keys, F.lit("status length").alias("problem"))
    out = count.unionByName(length)
    if exclude_target:
        leak = raw.select(*keys, F.posexplode("shot_subjects_by_sample").alias("i", "shots")).where(F.array_contains("shots", F.col("SubjectEntity")))
        out = out.unionByName(leak.select(*keys, F.concat(F.lit("target in demonstrations of sample "), F.col("i").cast("string")).alias("problem")))
    return out


def response_violations(tasks: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that break the contract of their task's mode."""
    met = tasks.alias("t").join(responses.alias("r"), F.col("t.task_id") == F.col("r.task_id"), "left")
    missing = F.col("r.task_id").isNull()
    wrong = (F.col("t.subject") != F.col("r.subject")) | (F.col("t.relation") != F.col("r.relation")) | (F.col("t.phase") != F.col("r.phase"))
    generated = (F.col("t.mode") == "generate") & (F.coalesce(F.size("r.generations"), F.lit(-1)) != F.col("t.n_samples"))
    shares = F.aggregate(F.map_values("r.choice_probabilities"), F.lit(0.0), lambda a, v: a + v)
    chosen = (F.col("t.mode") == "choice") & (~F.coalesce(F.array_contains("t.choices", F.col("r.selected_choice")), F.lit(False)) | (F.abs(shares - 1) > 1e-6))
    problem = F.when(missing, "missing response").when(wrong, "identity").when(generated, "generation count").when(chosen, "choice scores")
    extra = responses.join(tasks, "task_id", "left_anti").select("task_id", F.lit("unknown task").alias("problem"))
    return met.select(F.col("t.task_id").alias("task_id"), problem.alias("problem")).where("problem IS NOT NULL").unionByName(extra)


def review_violations(reviews: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reviews of unknown candidates, and reviews by a candidate's own proposer."""
    met = reviews.join(candidates.select(*keys, "key", "proposers"), [*keys, "key"], "left")
    problem = F.when(F.col("proposers").isNull(), "unknown candidate").when(F.array_contains("proposers", F.col("agent")), "self review")
    return met.select(*keys, "key", "agent", problem.alias("problem")).where("problem IS NOT NULL")


def manifest_problems(manifest: Mapping, expected: Mapping, hashes: Mapping[str, Path]) -> list[str]:
    """All fields and file hashes in which a manifest differs from what is expected."""
    wrong = [f"{k}: {manifest.get(k)!r} is not {v!r}" for k, v in expected.items() if manifest.get(k) != v]
    for field, path in hashes.items():
        got = file_sha256(path) if Path(path).is_file() else None
        if manifest.get(field) != got:
            wrong.append(f"{field}: {manifest.get(field)!r} is not the hash of {path}")
    return wrong


def budget_problems(agents: Sequence[Mapping], limit: int) -> list[str]:
    """Repeated agents, and distinct checkpoints with more parameters than allowed."""
    ids = [a["agent_id"] for a in agents]
    out = [f"duplicate agent {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    total = sum({a["checkpoint"]: int(a["parameters"]) for a in agents}.values())
    return out + ([f"{total} parameters exceed {limit}"] if total > limit else [])


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def require_hash(path: Path, expected: str, stage: str) -> None:
    if file_sha256(path) != expected:
        raise ContractError(f"{stage}: reconstruction drift in {path}")


def inside(root: Path, relative: str) -> Path:
    """A path that stays under its root."""
    if PurePosixPath(relative).is_absolute() or ".." in PurePosixPath(relative).parts:
        raise ContractError(f"path leaves its root: {relative}")
    return root / relative


def freeze(paths: Mapping[str, Path], stages: Sequence[str], target: Path) -> dict:
    """A policy: the hash of every input and the ordered stages."""
    value = {"inputs": {k: file_sha256(p) for k, p in sorted(paths.items())}, "stages": list(stages)}
    target.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return value


def refuse_blind(split: Mapping) -> None:
    """No scoring on a split without labels."""
    if split.get("blind", False) or not split.get("has_gold", False):
        raise ContractError("a blind split cannot be scored")


def reusable(bundle: Path, expected: Mapping, files: Sequence[str]) -> bool:
    """Whether a finished run can stand for a new one: its manifest is as expected and all its files are there."""
    manifest = bundle / "manifest.json"
    if not manifest.is_file() or any(not (bundle / f).is_file() for f in files):
        return False
    held = json.loads(manifest.read_text(encoding="utf-8"))
    return not manifest_problems(held, expected, {f"{f}_sha256": bundle / f for f in files})


# What no released file may hold.
HYGIENE = {
    "token of a code host": r"(?:github_pat_[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9]{20,})",
    "token of a model hub": r"\bhf_[A-Za-z0-9]{20,}\b",
    "key of a model service": r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}",
    "key of a search service": r"\bAIza[0-9A-Za-z_-]{30,}\b",
    "cloud access key": r"\bAKIA[0-9A-Z]{16}\b",
    "private key": r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
    "bearer token": r"(?i)Authorization:\s*Bearer\s+[A-Za-z0-9._-]{12,}",
    "home folder": r"(?:/home/[^/\s]+/|/Users/[^/\s]+/|[A-Za-z]:\\Users\\[^\\\s]+\\)",
    "private endpoint": r"(?i)(?:https?://|ssh://|\b(?:HOST|HOSTNAME|SERVER|ENDPOINT)\s*[:=]\s*)(?:10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})",
}
BINARY = ("gif", "gz", "jpeg", "jpg", "npz", "pdf", "png", "pyc", "tar", "zip")


def hygiene_violations(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, problem) of texts that hold a credential, a private endpoint or a machine's own folder; binary files are left out."""
    suffix = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in HYGIENE.items()]))
    return texts.where(~suffix.isin(*BINARY)).select(F.col(path).alias("path"), F.explode(found).alias("problem"))


def release_violations(scores: DataFrame, pinned: DataFrame, rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(name, problem): candidates whose recomputed score, row count or hash is not the pinned one.

    ``scores(name, f1)`` are recomputed, ``rows(name, n_rows, sha256)`` found,
    ``pinned(name, f1, n_rows, sha256)`` expected.
    """
    p = pinned.select("name", F.col("f1").alias("want_f1"), F.col("n_rows").alias("want_rows"), F.col("sha256").alias("want_sha"))
    met = p.join(scores.select("name", "f1"), "name", "left").join(rows.select("name", "n_rows", "sha256"), "name", "left")
    wrong = F.array_compact(F.array(
        F.when(F.coalesce(F.abs(F.col("f1") - F.col("want_f1")) > tolerance, F.lit(True)), "score"),
        F.when(~F.col("n_rows").eqNullSafe(F.col("want_rows")), "rows"),
        F.when(~F.col("sha256").eqNullSafe(F.col("want_sha")), "hash"),
    ))
    return met.select("name", F.explode(wrong).alias("problem"))


def migration_violations(old: DataFrame, current: DataFrame, mapping: DataFrame, dropped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(place, keys, problem): where renaming and dropping the old keys, in order, does not give the current ones.

    ``old`` and ``current`` have ``place``; ``mapping(keys, new_subject)``
    renames subjects, ``dropped(keys)`` leaves rows out.  Mappings and drops of
    keys that the old rows lack are violations too.
    """
    subject, *rest = keys
    moved = old.join(dropped.select(*keys), list(keys), "left_anti").join(mapping.select(*keys, "new_subject"), list(keys), "left")
    moved = moved.select("place", F.coalesce("new_subject", subject).alias(subject), *rest)
    order = lambda df: df.select(*keys, F.row_number().over(Window.orderBy("place")).alias("at"))
    a, b = order(moved), order(current)
    apart = a.join(b, ["at", *keys], "left_anti").withColumn("problem", F.lit("not in the current rows")).unionByName(b.join(a, ["at", *keys], "left_anti").withColumn("problem", F.lit("not in the migrated rows")))
    idle = mapping.select(*keys).unionByName(dropped.select(*keys)).join(old, list(keys), "left_anti").select(F.lit(None).cast("int").alias("at"), *keys, F.lit("mapping without an old row").alias("problem"))
    return apart.select("at", *keys, "problem").unionByName(idle)
