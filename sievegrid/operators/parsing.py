"""From free text to an option: ordered cascades of patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sievegrid.functions.text import FOLDED_LETTERS, match_text, option_letter

#: What may stand before the symbol of an option; a fixed value.
_CUE = r"\b(?:answer|option|choice)?\s*[:#\-]?\s*"


def _folded(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), FOLDED_LETTERS, "_")


def _hits(s: Column, symbols: str) -> Column:
    """All symbols of a class that stand alone, each with the word before it that may announce it."""
    return F.regexp_extract_all(_folded(s), F.lit(rf"(?i){_CUE}([{symbols}])\b"), 1)


def digit_index(s: Column, n: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(_hits(s, "0-9"), lambda d: d.cast("int")), lambda i: i < n), F.lit(1))


def letter_index(s: Column, n: Column, letters: str = "A-E") -> Column:
    return F.try_element_at(F.filter(F.transform(_hits(F.upper(s), letters), lambda c: F.ascii(c) - 65), lambda i: i < n), F.lit(1))


def one_based_index(s: Column, n: Column) -> Column:
    """struct(index, method) of the first digit that is a place counted from 0, or else from 1; nulls without one."""
    hits = F.filter(F.transform(_hits(s, "0-9"), lambda d: d.cast("int")), lambda i: i <= n)
    first = F.array(F.try_element_at(hits, F.lit(1)))  # a variable of the function below: looked for once
    method = lambda i: F.when(i < n, F.lit("index_regex")).when(i.isNotNull(), F.lit("one_based_index_regex"))
    return F.transform(first, lambda i: F.struct(F.when(i < n, i).otherwise(i - 1).alias("index"), method(i).alias("method")))[0]


def substring_index(s: Column, options: Column) -> Column:
    """First option that holds the response or is held by it, in match_text() form; an empty response is held by all."""
    # one element of one array: texts are reduced once, however many options there are
    reduced = F.array(F.struct(match_text(s).alias("r"), F.transform(options, match_text).alias("o")))
    held = lambda x: F.transform(x["o"], lambda o: (o != "") & (F.contains(x["r"], o) | F.contains(o, x["r"])))
    place = F.transform(reduced, lambda x: F.array_position(held(x), True))[0]
    return F.nullif(place - 1, F.lit(-1)).cast("int")


def parse_index_first(rows: DataFrame, response: str = "response", options: str = "options", fuzzy: bool = False) -> DataFrame:
    """rows with prediction and parse_method: empty, digit, letter, substring, then (if asked for) the closest option.

    The last stage runs in pandas and sees only rows that reach it; otherwise they are unparsed.
    """
    s, o = F.coalesce(F.col(response), F.lit("")), F.col(options)
    df = rows.withColumn("_i", digit_index(s, F.size(o))).withColumn("_l", letter_index(s, F.size(o))).withColumn("_s", substring_index(s, o))
    empty = F.trim(s) == ""
    method = F.when(empty, "empty_response").when(F.col("_i").isNotNull(), "index_regex").when(F.col("_l").isNotNull(), "letter_regex").when(F.col("_s").isNotNull(), "substring_match").otherwise("unparsed")
    df = df.withColumn("prediction", F.when(~empty, F.coalesce("_i", "_l", "_s")).cast("long")).withColumn("parse_method", method).drop("_i", "_l", "_s")
    if not fuzzy:
        return df
    close = closest(match_text(s), F.transform(o, match_text))
    left = F.col("parse_method") == "unparsed"
    tried = df.where(left).withColumn("prediction", close.cast("long")).withColumn("parse_method", F.when(F.col("prediction").isNotNull(), "fuzzy_match").otherwise("unparsed"))
    return df.where(~left).unionByName(tried)


@F.pandas_udf(IntegerType())
def closest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Place of the option with the best ratio of matching blocks, if at least 0.72 and 0.05 better than the second."""
    from difflib import SequenceMatcher

    for responses, options in batches:
        out = []
        for response, some in zip(responses, options, strict=True):
            ratios = sorted(((SequenceMatcher(None, response, o).ratio(), -i) for i, o in enumerate(some if some is not None else []) if o), reverse=True)
            second = ratios[1][0] if len(ratios) > 1 else -1.0
            out.append(-ratios[0][1] if ratios and ratios[0][0] >= 0.72 and ratios[0][0] - second >= 0.05 else None)
        yield pd.Series(out, dtype="Int32")


def parse_letter_first(rows: DataFrame, response: str = "response", options: str = "options", letters: str = "A-D", raw_unparsed: bool = True) -> DataFrame:
    """rows with letter, prediction and parse_method: empty, letter, digit (from 0, else from 1), substring, raw.

    raw_unparsed: an unparsed response is its own letter, an empty one ''; else both are null.
    """
    s, o = F.coalesce(F.col(response), F.lit("")), F.col(options)
    # one row of one array: what the stages find is worked out once, however often it is named below
    stages = F.struct(letter_index(s, F.size(o), letters).alias("_l"), one_based_index(s, F.size(o)).alias("_d"), substring_index(s, o).alias("_s"))
    df = rows.select("*", F.inline(F.array(stages))).withColumns({"_i": F.col("_d.index"), "_m": F.col("_d.method")}).drop("_d")
    empty = F.trim(s) == ""
    df = df.withColumn("prediction", F.when(~empty, F.coalesce("_l", "_i", "_s")).cast("long"))
    df = df.withColumn("parse_method", F.when(empty, "empty_response").when(F.col("_l").isNotNull(), "letter_regex").when(F.col("_i").isNotNull(), F.col("_m")).when(F.col("_s").isNotNull(), "substring_match").otherwise("raw_response"))
    other = F.when(empty, F.lit("")).otherwise(F.trim(s)) if raw_unparsed else F.lit(None).cast("string")
    return df.withColumn("letter", F.coalesce(option_letter(F.col("prediction").cast("int")), other)).drop("_l", "_i", "_m", "_s")
