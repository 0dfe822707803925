"""Source trees, configuration files and file snapshots."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import time
import tomllib
import warnings
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import is_sensitive
from lodestone.sources.parse import language_of


def _rule(line: str, folder: str) -> tuple[bool, str] | None:
    """(whether it ignores, pattern of relative paths) of a line of an ignore file in ``folder`` ("" or "a/b/")."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    keep, line = line.startswith("!"), line.removeprefix("!")
    bound, only_folders = "/" in line.rstrip("/"), line.endswith("/")
    out, body, k = "", line.strip("/"), 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("/**", k) and k + 3 == len(body):
            out, k = out + "/.*", k + 3
        elif body[k] == "[" and "]" in body[k + 2 :]:
            end = body.index("]", k + 2)
            out, k = out + "[" + ("^" if body[k + 1] in "!^" else "") + body[k + 1 : end].lstrip("!^").replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(body[k], re.escape(body[k])), k + 1
    start = "^" + re.escape(folder) + ("" if bound else "(?:.*/)?")
    return not keep, start + out + ("/.*$" if only_folders else "(?:/.*)?$")


def ignore_rules(files: list[tuple[str, str]]) -> list[tuple[bool, str]]:
    """Rules of ignore files (folder, text), those of outer folders first: the last that matches a path counts."""
    found = []
    for folder, text in sorted(files, key=lambda f: f[0].count("/")):
        found += [r for line in text.split("\n") if (r := _rule(line, folder))]
    return found


def ignored(path, rules: list[tuple[bool, str]]):
    """Column: whether the last rule that matches a path ignores it."""
    out = F.lit(False)
    for ignores, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(out)
    return out


def ignore_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """Ignore files of a tree on any file system: (folder, text), level by level. Spark's own listing passes over hidden files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    top, found, level = str(fs.makeQualified(base)), [], ""
    while True:
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}{level}/.gitignore")) or []:
            stream = fs.open(status.getPath())
            folder = str(status.getPath().getParent())[len(top) :].strip("/")
            found.append((folder + "/" if folder else "", jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
        level += "/*"
        if not len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(root + level)) or []):
            return found


def scan(spark: SparkSession, root: str, rules: list[tuple[bool, str]] | None = None) -> DataFrame:
    """Files of a tree that have a known language and are neither ignored nor sensitive: path, language, content_hash, text.

    Ignore files of all folders hold, with ``!`` lines. Every condition is on the path alone and stands before
    the content is used.
    """
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace("path", "^(file:)?/*" + re.escape(base.removeprefix("file://").lstrip("/")) + "/", "")
    rules = ignore_rules(ignore_files(spark, base)) if rules is None else rules
    pruned = path.rlike(r"(^|/)(target|\.git|\.lodestone)/")
    kept = rows.where(~pruned & ~is_sensitive(path) & language_of(path).isNotNull() & ~ignored(path, rules))
    return kept.select(path.alias("path"), language_of(path).alias("language"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("text"))


def slice_lines(text, start, n):
    """Lines start .. start + n - 1 of a text, as far as there are."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), n), "\n")


def load_policy(path: str) -> dict:
    """Deny and redact rules of a TOML file; a missing file gives none, a malformed one none and a warning, as do rules that name nothing."""
    try:
        found = tomllib.loads(Path(path).read_text())
    except FileNotFoundError:
        return {"deny": [], "redact": []}
    except (OSError, tomllib.TOMLDecodeError) as error:
        warnings.warn(f"no policy, {path}: {error}", stacklevel=2)
        return {"deny": [], "redact": []}

    def keep(rules) -> list[dict]:
        sound = [r for r in rules if isinstance(r, dict) and (r.get("path") or r.get("fqn_prefix"))]
        if len(sound) < len(rules):
            warnings.warn(f"{path}: rules without path and fqn_prefix are skipped", stacklevel=3)
        return sound

    return {"deny": keep(found.get("deny", [])), "redact": keep(found.get("redact", []))}


def load_workspace(path: str) -> list[dict]:
    """Members (path, label, role) of a workspace file, each folder once; the local root is not among them."""
    try:
        found = tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return []
    root, seen, out = Path(path).resolve().parent, set(), []
    for member in found.get("members", []):
        place = (root / member.get("path", "")).resolve()
        if member.get("path") and place not in seen and place != root:
            seen.add(place)
            out.append({"path": str(place), "label": member.get("label") or place.name, "role": member.get("role")})
    return out


def member_tables(spark: SparkSession, members: list[dict], table: str, needs: list[str] | None = None) -> DataFrame | None:
    """One table of all members that can be read, with ``member_index`` from 1 on.

    A member without the table, or whose table lacks a column of ``needs``, is left out with a warning; nothing
    of a member is changed.
    """
    out = None
    for k, member in enumerate(members, 1):
        try:
            own = spark.read.parquet(f"{member['path']}/{table}")
        except AnalysisException:
            warnings.warn(f"{member['label']}: no table {table}", stacklevel=2)
            continue
        if lacking := [c for c in needs or [] if c not in own.columns]:
            warnings.warn(f"{member['label']}: {table} lacks {', '.join(lacking)}", stacklevel=2)
            continue
        own = own.withColumn("member_index", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def git_branch(root: str) -> str | None:
    """Branch that HEAD names, through a worktree's pointer; None if detached or no repository."""
    place = Path(root) / ".git"
    if place.is_file():
        place = (Path(root) / place.read_text().partition("gitdir:")[2].strip()).resolve()
    try:
        head = (place / "HEAD").read_text().strip()
    except OSError:
        return None
    return head.removeprefix("ref: refs/heads/") if head.startswith("ref: refs/heads/") else None


def main_root(cwd: str) -> str:
    """Root of the main repository of a worktree; the folder itself otherwise."""
    place = Path(cwd) / ".git"
    if place.is_file():
        target = (Path(cwd) / place.read_text().partition("gitdir:")[2].strip()).resolve()
        if "worktrees" in target.parts:
            return str(target.parents[2])
    return str(Path(cwd))


def _inside(root: str, relative: str) -> Path:
    parts = [p for p in relative.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or relative.startswith("/"):
        raise ValueError(f"not a path inside the tree: {relative}")
    return Path(root, *parts)


def _folder(store: str, relative: str) -> Path:
    return Path(store) / "restores" / hashlib.sha256("/".join(p for p in relative.split("/") if p not in ("", ".")).encode()).hexdigest()


def snapshot(store: str, root: str, relative: str, millis: int | None = None) -> str | None:
    """Copy a file aside; written under another name first, then renamed. None if there is no file."""
    source = _inside(root, relative)
    if not source.is_file():
        return None
    folder = _folder(store, relative)
    folder.mkdir(parents=True, exist_ok=True)
    millis, sequence = millis if millis is not None else time.time_ns() // 1_000_000, 0
    while (target := folder / f"{millis}-{os.getpid()}-{sequence}.snap").exists():
        sequence += 1
    shutil.copy2(source, part := target.with_suffix(".part"))
    os.replace(part, target)
    return target.stem


def snapshots(spark: SparkSession, store: str, relative: str) -> DataFrame:
    """Snapshots of a file, the newest first, numbers compared as numbers: id, millis, pid, seq, size."""
    folder = _folder(store, relative)
    names = [(p.stem, p.stat().st_size) for p in folder.glob("*.snap")] if folder.is_dir() else []
    rows = spark.createDataFrame(names, "id string, size long")
    parts = F.split("id", "-")
    return rows.where(F.col("id").rlike(r"^\d+-\d+-\d+$")).select("id", parts[0].cast("long").alias("millis"), parts[1].cast("int").alias("pid"), parts[2].cast("int").alias("seq"), "size").orderBy(F.col("millis").desc(), F.col("seq").desc(), F.col("id").desc())


def snapshot_at(spark: SparkSession, store: str, relative: str, millis: int) -> str | None:
    """The snapshot of a file for a millisecond: that of the highest number."""
    row = snapshots(spark, store, relative).where(F.col("millis") == millis).agg(F.max_by("id", F.struct("seq", "id")).alias("id")).first()
    return row.id


def restore(store: str, root: str, relative: str, ident: str) -> None:
    """Put a snapshot back, with its permissions; names that leave the folder are refused."""
    if not re.fullmatch(r"\d+-\d+-\d+", ident):
        raise ValueError(f"not a snapshot: {ident}")
    target = _inside(root, relative)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copy2(_folder(store, relative) / f"{ident}.snap", part := target.with_name(target.name + ".part"))
    os.replace(part, target)


def expire_snapshots(store: str, now_millis: int, session_start_millis: int, days: int = 7) -> int:
    """Delete snapshots older than both limits; returns how many."""
    limit, gone = min(now_millis - days * 86_400_000, session_start_millis), 0
    for file in Path(store, "restores").glob("*/*.snap"):
        millis = file.stem.split("-")[0]
        if millis.isdigit() and int(millis) < limit:
            file.unlink()
            gone += 1
    return gone
