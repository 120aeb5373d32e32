"""Selectors by name: any function from a DataFrame and parameters to a DataFrame can be plugged in."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Indices that a selector may give as a plain list.
MOST_INDICES = 100_000

SELECTORS: dict[str, Callable[..., DataFrame]] = {}


def selector(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SELECTORS[name] = f
        return f

    return add


def call(name: str, df: DataFrame, **parameters: object) -> DataFrame:
    """The selector's result; parameters that it doesn't take are left out. None means: keep everything."""
    found = raw_call(name, df, **parameters)
    return df if found is None else found


def raw_call(name: str, df: DataFrame, **parameters: object) -> object:
    """What the selector itself returns, for normalised()."""
    f = SELECTORS[name]
    takes = inspect.signature(f).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        parameters = {k: v for k, v in parameters.items() if k in takes}
    return f(df, **parameters)


def call_tokens(name: str, tokens: DataFrame, keys: list[str], **parameters: object) -> DataFrame:
    """The tokens (keys, index, feature) that a selector keeps, in the form of normalised(), whatever it returns."""
    return normalised(raw_call(name, tokens, **parameters), tokens, keys)


def normalised(output: object, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, index, feature of what a selector returned for tokens (keys, index from 0, feature).

    Forms: None: all tokens. A list of whole numbers: these indices, in each group. A DataFrame: rows (keys, index), rows (keys, position,
    feature), or rows with all of these. A mapping or an object with selected_indices, selected_features or both, each a list
    or a DataFrame of such rows. Indices outside a group's tokens, and indices and features that differ in number, are
    errors; features without indices count from 0. All checks are made in the aggregation that a group goes through anyway.
    """
    if output is None:
        return _with_features(tokens.select(*keys, F.col("index").alias("position"), "index"), tokens, keys)
    if isinstance(output, DataFrame):
        indices = output if "index" in output.columns else None
        features = output if "feature" in output.columns else None
        if indices is None and features is None:
            raise TypeError("a selector's rows must have an index or a feature")
        if indices is not None and features is not None:
            return _numbered(_checked(output, tokens, keys), keys).select(*keys, "position", "index", "feature")
    elif isinstance(output, Sequence) and not isinstance(output, str) and all(isinstance(x, int) for x in output):
        indices, features = output, None
    elif isinstance(output, Mapping):
        indices, features = output.get("selected_indices"), output.get("selected_features")
    elif hasattr(output, "selected_indices") or hasattr(output, "selected_features"):
        indices, features = getattr(output, "selected_indices", None), getattr(output, "selected_features", None)
    else:
        raise TypeError(f"a selector can't return {type(output).__name__}")
    if indices is None and features is None:
        raise ValueError("a selector must return selected_indices, selected_features or both")
    if indices is not None and not isinstance(indices, DataFrame):
        if len(indices) > MOST_INDICES:
            raise ValueError(f"more than {MOST_INDICES} indices in a list: return rows instead")
        listed = F.posexplode(F.lit([int(i) for i in indices]) if indices else F.array().cast("array<int>")).alias("position", "index")
        indices = tokens.select(*keys).distinct().select(*keys, listed)
    if features is not None and not isinstance(features, DataFrame):
        raise TypeError("selected_features must be rows (keys, position, feature)")
    if indices is None:
        mine = features.select(*keys, F.col("position").cast("long").alias("position"), F.col("position").cast("long").alias("index"), "feature")
        return _checked(mine, tokens, keys).select(*keys, "position", "index", "feature")
    rows = _numbered(_checked(indices, tokens, keys), keys)
    if features is None:
        return _with_features(rows, tokens, keys)
    both = rows.select(*keys, "position", "index").join(features.select(*keys, F.col("position").cast("long").alias("position"), "feature", F.lit(1).alias("_has")), [*keys, "position"], "full_outer")
    wrong = F.raise_error(F.lit("indices and features differ in number")).cast("boolean")
    matched = F.when(F.col("index").isNotNull() & F.col("_has").isNotNull(), True).otherwise(wrong)
    return both.where(matched).select(*keys, "position", "index", "feature")


def _checked(rows: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    sizes = tokens.groupBy(*keys).agg(F.count("*").alias("_n"))
    inside = (F.col("index") >= 0) & (F.col("index") < F.coalesce("_n", F.lit(0)))
    wrong = F.raise_error(F.concat(F.lit("index out of bounds: "), F.coalesce(F.col("index").cast("string"), F.lit("null")))).cast("long")
    checked = rows.join(sizes, keys, "left").withColumn("index", F.when(inside, F.col("index").cast("long")).otherwise(wrong)).drop("_n")
    return checked.where("index >= 0")  # asks for the value, so that the check is never left out of a plan


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with position: their own, or in order of index."""
    if "position" in rows.columns:
        return rows.withColumn("position", F.col("position").cast("long"))
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy(*keys).orderBy("index")) - 1).cast("long"))


def _with_features(rows: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    mine = rows.select(*keys, F.col("position").cast("long").alias("position"), F.col("index").cast("long").alias("index"))
    return mine.join(tokens.select(*keys, F.col("index").cast("long").alias("index"), "feature"), [*keys, "index"], "left").select(*keys, "position", "index", "feature")


def call_frames(name: str, frames: DataFrame, keys: list[str], **parameters: object) -> DataFrame:
    """The frames (keys, t and more) that a selector keeps, in the form of normalised_frames(), whatever it returns."""
    return normalised_frames(raw_call(name, frames, **parameters), frames, keys)


def normalised_frames(output: object, frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, num_frames and the columns of frames (keys, t and more) of what a selector of frames returned.

    Forms: None: no frames. A list of whole numbers: these t, in each group, in this order, repeats included. A DataFrame: rows (keys, t), in
    order of its position if it has one, else of t; a mapping or an object with `frames`, which is a list or a DataFrame of
    such rows. A frame that isn't there is an error.
    """
    if isinstance(output, Mapping):
        output = output.get("frames")
    elif output is not None and not isinstance(output, DataFrame | Sequence):
        if not hasattr(output, "frames"):
            raise TypeError(f"a selector of frames can't return {type(output).__name__}")
        output = output.frames
    if output is None:
        rows = frames.limit(0).select(*keys, F.lit(0).cast("long").alias("position"), "t")
    elif isinstance(output, DataFrame):
        if "t" not in output.columns:
            raise TypeError("a selector's frames must have t")
        order = "position" if "position" in output.columns else "t"
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
        rows = output.select(*keys, place.cast("long").alias("position"), "t")
    elif not isinstance(output, str) and all(isinstance(x, int) for x in output):
        if len(output) > MOST_INDICES:
            raise ValueError(f"more than {MOST_INDICES} frames in a list: return rows instead")
        listed = F.posexplode(F.lit(list(output)) if output else F.array().cast("array<int>")).alias("position", "t")
        rows = frames.select(*keys).distinct().select(*keys, listed).withColumn("position", F.col("position").cast("long"))
    else:
        raise TypeError(f"a selector of frames can't return {type(output).__name__}")
    there = frames.withColumn("_there", F.lit(True))
    joined = rows.withColumn("t", F.col("t").cast("long")).join(there, [*keys, "t"], "left")
    missing = F.raise_error(F.concat(F.lit("no frame "), F.col("t").cast("string"))).cast("long")
    checked = joined.withColumn("position", F.when(F.col("_there"), F.col("position")).otherwise(missing)).where("position >= 0").drop("_there")
    return checked.withColumn("num_frames", F.count("*").over(Window.partitionBy(*keys)))
