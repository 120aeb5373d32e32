"""Plans for mirroring a file tree: what to upload, delete and preserve under ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rel_path(s: Column) -> Column:
    """/ instead of backslashes, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"\\", "/"), r"^/+|/+$", "")


def parents(path: Column) -> Column:
    """Folders above a path, the nearest first."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file by the public rules of gitignore, as a regular expression for paths (folders with a slash at
    the end) and whether it ignores (True) or takes back (False); None for blanks and comments."""
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    back, text = text.startswith("!"), text.removeprefix("!").removeprefix("\\")
    below = "/.*" if text.endswith("/") else "(?:/.*)?"  # only what lies in a folder, or also what has the name itself
    parts = text.strip("/").split("/")
    if not parts[0]:
        return None
    rooted = "/" in text.rstrip("/")
    out = "" if rooted or parts[0] == "**" else "(?:.+/)?"
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.+/)?"
            continue
        for piece in re.findall(r"\[!?\]?[^\]]*\]|.", part):
            if piece.startswith("[") and len(piece) > 2:
                out += re.sub(r"^\[!", "[^", piece.replace("\\", "\\\\"))
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece))
        out += "" if last else "/"
    return f"^{out}{'' if parts[-1] == '**' else below}$", not back


def ignored(path: Column, patterns: list[str], is_folder: Column | None = None) -> Column:
    """Whether the last of the patterns that fits a path ignores it. One compiled expression a pattern."""
    full = path if is_folder is None else F.when(is_folder, F.concat(path, F.lit("/"))).otherwise(path)
    found = F.lit(False)
    for regex, ignores in filter(None, map(ignore_rule, patterns)):
        found = F.when(full.rlike(regex), F.lit(ignores)).otherwise(found)
    return (path != "") & found


def plan(local: DataFrame, remote: DataFrame, patterns: list[str]) -> DataFrame:
    """action, rel_path, is_folder, step: upload every local file (rel_path); of remote (rel_path, is_folder) preserve what is
    ignored or lies in an ignored folder, with all folders above it, and delete the rest, files first, then deep folders.
    """
    each = remote.select("rel_path", "is_folder", ignored(F.col("rel_path"), patterns, F.col("is_folder")).alias("hit"), parents(F.col("rel_path")).alias("above"))
    folders = each.where("hit AND is_folder").select(F.col("rel_path").alias("folder"))
    below = each.select("rel_path", "is_folder", F.explode("above").alias("folder")).join(folders, "folder", "left_semi").select("rel_path", "is_folder").distinct().withColumn("inside", F.lit(True))
    own = each.join(below, ["rel_path", "is_folder"], "left").withColumn("own", F.col("hit") | F.coalesce("inside", F.lit(False)))
    needed = own.where("own").select(F.explode("above").alias("rel_path")).distinct().withColumn("needed", F.lit(True))
    kept = own.join(needed, "rel_path", "left").withColumn("keep", F.col("own") | (F.col("is_folder") & F.coalesce("needed", F.lit(False))))
    depth = F.size(F.split("rel_path", "/")) - 1
    step = F.when(F.col("keep"), 0).when(F.col("is_folder"), 1000 - depth).otherwise(0)
    done = kept.select(F.when(F.col("keep"), F.lit("preserve")).otherwise(F.lit("delete")).alias("action"), "rel_path", "is_folder", step.cast("long").alias("step"))
    return local.select(F.lit("upload").alias("action"), "rel_path", F.lit(False).alias("is_folder"), F.lit(0).cast("long").alias("step")).unionByName(done)


def parent_folders(files: DataFrame) -> DataFrame:
    """rel_path, depth of every folder that the files (rel_path) need."""
    return files.select(F.explode(parents(F.col("rel_path"))).alias("rel_path")).distinct().withColumn("depth", (F.size(F.split("rel_path", "/"))).cast("long"))
