"""How the words of each source differ from those of the other sources of its language, in whole numbers.

Heavy-light split. Every pair of sources starts from the value that it has if neither uses any term. Light terms, which
at most LIGHT sources use, correct it by a histogram for each source (terms that the other one lacks) and, where both
use the term, by the pairs of its posting. Heavy terms correct it in dense tiles of terms by sources. All partial
sums are exact modulo 2^64, and so is their total, which is less than 2^63.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.common import bounded_batches, small_side, stored

#: Sources of a language that use a light term, at most.
LIGHT = 8
#: Sources on one side of a tile, and heavy terms (or bars of histograms) in it, on average at most.
TILE, TILE_TERMS = 64, 2048
#: Terms that a task counts before it hands them on, and bytes of a text that it cuts into terms at a time.
BUFFERED, PIECE = 300_000, 4 << 20
ONE = 1_000_000_000

# A-Z are lowered; every ASCII character but letters is a space
_TERMS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Runs of letters and non-ASCII characters of UTF-8 text, with A-Z lowered, a few megabytes at a time."""
    at, text = 0, text.translate(_TERMS)
    while at < len(text):
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to].split(b" ")
        at = to


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text as bytes) to rows (lang, source, term, n, df), and one with the empty term for each group."""
    names, found, size = ["lang", "source", "term", "n", "df"], {}, 0

    def counted() -> pa.RecordBatch:
        columns = [[], [], [], [], []]
        for (lang, source), (n, df) in found.items():
            n.pop(b"", None)
            df.pop(b"", None)
            columns[0] += [lang] * (len(n) + 1)
            columns[1] += [source] * (len(n) + 1)
            columns[2] += ["", *(t.decode() for t in n)]
            columns[3] += [0, *n.values()]
            columns[4] += [0, *(df[t] for t in n)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names)

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, df = found.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in terms_of(text):
                n.update(terms)
                seen.update(terms)
            df.update(seen)
            size += len(n) - before
            if size > BUFFERED:
                yield counted()
                found, size = {}, 0
    yield counted()


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _tile(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    """Values of all pairs of one tile. Rows: kind 0: a source with p of a term that it lacks (m: terms of the language, in one
    tile of a pair); 1: m light terms of a source with p; 2: a heavy term of a source with p."""
    kind, first = x["kind"].to_numpy(), x["is_a"].to_numpy()
    side = lambda a: x[(kind == 0) & (first == a)].sort_values("g")
    a, b = side(True), side(False)
    (ga, pa0), (gb, pb0) = ((s["g"].to_numpy(), s["p"].to_numpy()) for s in (a, b))
    none = _f(pa0[:, None], pb0[None, :])
    total = none * a["m"].to_numpy()[:, None]
    for is_a, g in ((True, ga), (False, gb)):
        bars = x[(kind == 1) & (first == is_a)]
        for at, of in zip(np.searchsorted(g, list(bars.groupby("g").groups)), bars.groupby("g"), strict=True):
            p, m = of[1]["p"].to_numpy()[:, None], of[1]["m"].to_numpy()[:, None]
            if is_a:
                total[at] += (m * (_f(p, pb0[None, :]) - none[at])).sum(0)
            else:
                total[:, at] += (m * (_f(pa0[None, :], p) - none[:, at])).sum(0)
    heavy = x[kind == 2]
    code, terms = pd.factorize(heavy["term"])
    if len(terms):
        is_a = heavy["is_a"].to_numpy()
        dense = []
        for mine, g, p0 in ((is_a, ga, pa0), (~is_a, gb, pb0)):
            p = np.tile(p0, (len(terms), 1))
            p[code[mine], np.searchsorted(g, heavy["g"].to_numpy()[mine])] = heavy["p"].to_numpy()[mine]
            dense.append(p)
        for at in range(len(ga)):
            total[at] += (_f(dense[0][:, at, None], dense[1]) - none[at]).sum(0)
    i, j = np.nonzero(ga[:, None] != gb[None, :])
    return pd.DataFrame({"lang": key[0], "a": ga[i], "b": gb[j], "value": total[i, j]})


def _posting_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, posting: list of (g, p, p0)) to rows (lang, a, b, value), summed within a batch."""
    for batch in batches:
        lists = batch.column(1)
        ends = np.asarray(lists.offsets)
        of = lists.values
        g, p, p0 = (of.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        langs = pa.array(batch.column(0)).dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(ends))
        end = np.repeat(ends[1:], np.diff(ends))
        place, out = np.arange(ends[0], ends[-1]), []
        for step in range(1, int(np.diff(ends).max(initial=0))):
            x = np.flatnonzero(place + step < end)
            y = place[x] + step
            x, in_lang = place[x], lang[x]
            for a, b in ((x, y), (y, x)):
                value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
                out.append(pd.DataFrame({"lang": in_lang, "a": g[a], "b": g[b], "value": value}))
        if out:
            summed = pd.concat(out).groupby(["lang", "a", "b"], as_index=False)["value"].sum()
            names = pa.array(langs.dictionary.to_numpy(zero_copy_only=False)[summed["lang"]], pa.string())
            yield pa.RecordBatch.from_arrays([names, *(pa.array(summed[c], t) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())))], ["lang", "a", "b", "value"])


def _share(n: str, total: str) -> Column:
    """1 + floor(ONE * (n + 1) / total); 1 without terms."""
    of = f"{ONE}BD * (cast({n} as decimal(20, 0)) + 1BD) div cast({total} as decimal(20, 0))"
    return F.expr(f"CASE WHEN {total} > 0 THEN 1 + ({of}) ELSE 1 END").cast("long")


def _kept(docs: DataFrame, least_docs: int, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """lang, source, term, n, n_lang, sources, is_first of the kept terms; the empty term stands for each group."""
    bounded_batches(docs.sparkSession)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), named(text_col).cast("binary").alias("text"))
    parts = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, df long")
    # dealt by term once, for the sums and the window; the rows of a term are as many as its sources
    counts = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    over = {"df": F.sum("df"), "n_lang": F.sum("n"), "sources": F.count("*"), "least": F.min("source")}
    found = counts.withColumns({k: v.over(term) for k, v in over.items()}).where((F.col("df") >= least_docs) | (F.col("term") == ""))
    return stored(found.select("lang", "source", "term", "n", "n_lang", "sources", ((F.col("source") == F.col("least")) & (F.col("term") != "")).cast("int").alias("is_first")), "kept-terms")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, light: int = LIGHT, tile: int = TILE, tile_terms: int = TILE_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair`: the other sources of the language, all of them; part `term`: the
    source's own terms, `top` at most.

    A language keeps the terms that at least `least_docs` of its documents have. p of a term is 1 + floor(10^9 * (count +
    1) / (N + V)), for a source and for its language; f(p, q) = floor((p - q)^2 / q). A pair has the sum of f over
    all kept terms, q being the other source's; a term has f against the language, where p is larger. Ranks go by value
    descending, then by the bytes of the item.

    Null text, lang and source count as empty; a group without terms takes part, with pairs only; repeated rows count
    each; texts are read whole; an empty table gives no rows; other columns are not read.
    """
    kept = _kept(docs, least_docs, lang_col, source_col, text_col)
    terms = kept.where("term <> ''")
    langs = stored(kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("is_first").alias("v"), F.sum(F.when((F.col("sources") > light) & (F.col("term") != ""), F.col("is_first")).otherwise(0)).alias("heavy")), "langs")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(small_side(langs.select("lang", "v", "heavy")), "lang")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # of a language's sources, not of its rows
    groups = groups.withColumns({"g": number, "total": F.col("total") + F.col("v")}).withColumn("p0", _share("0", "total"))
    groups = stored(groups.withColumn("block", F.floor(F.col("g") / tile).cast("int")), "groups")
    sizes = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    with_p = terms.join(small_side(groups.select("lang", "source", "g", "block", "total", "p0")), ["lang", "source"]).withColumn("p", _share("n", "total"))

    q = langs.select("lang", (F.col("n_lang") + F.col("v")).alias("total_lang"))
    own = with_p.join(small_side(q), "lang").withColumn("q", _share("n_lang", "total_lang")).where("p > q")
    order = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    own = own.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    own = own.withColumn("rank", F.row_number().over(order("item"))).where(F.col("rank") <= top)  # each task hands on its first ones only

    bars = stored(with_p.where(F.col("sources") <= light).groupBy("lang", "g", "block", "p").agg(F.count("*").alias("m")), "histograms")
    of_bars = bars.groupBy("lang").agg(F.count("*").alias("bars"))
    chunks = F.ceil(F.greatest(F.col("heavy"), F.coalesce("bars", F.lit(0)) / F.lit(8), F.lit(1)) / F.lit(tile_terms)).cast("int")
    shape = stored(langs.join(of_bars, "lang", "left").join(sizes, "lang").select("lang", "blocks", chunks.alias("chunks")), "shapes")
    chunk = lambda *c: F.pmod(F.xxhash64(*c), F.col("chunks")).cast("int")
    columns = ["lang", "block", "chunk", "blocks", "kind", "term", "g", "p", "m"]
    sources = groups.join(small_side(shape), "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = sources.select("lang", "block", "chunk", "blocks", F.lit(0).alias("kind"), F.lit("").alias("term"), "g", F.col("p0").alias("p"), F.when(F.col("chunk") == 0, F.col("v")).otherwise(0).alias("m"))
    rows = rows.unionByName(bars.join(small_side(shape), "lang").withColumns({"chunk": chunk("g", "p"), "kind": F.lit(1), "term": F.lit("")}).select(*columns))
    heavy = with_p.where(F.col("sources") > light).join(small_side(shape), "lang")
    rows = rows.unionByName(heavy.withColumns({"chunk": chunk("term"), "kind": F.lit(2), "m": F.lit(0)}).select(*columns))
    # each source meets the blocks of all: as many tiles as the pairs that the result has, divided by tile * tile
    other, both = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), ["kind", "term", "g", "p", "m", "chunk"]
    one = rows.select("lang", F.col("block").alias("a_block"), other.alias("b_block"), F.lit(True).alias("is_a"), *both)
    two = rows.select("lang", other.alias("a_block"), F.col("block").alias("b_block"), F.lit(False).alias("is_a"), *both)
    dense = one.unionByName(two).groupBy("lang", "a_block", "b_block", "chunk").applyInPandas(_tile, "lang string, a int, b int, value long")

    postings = with_p.where((F.col("sources") > 1) & (F.col("sources") <= light)).groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("posting"))
    sparse = postings.select("lang", "posting").mapInArrow(_posting_pairs, "lang string, a int, b int, value long")
    whole = dense.unionByName(sparse).groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    half, all_ = F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    whole = whole.withColumn("value", (F.pmod(F.col("value").cast("decimal(38,0)") + half, all_) - half).cast("long"))
    name = lambda c, as_: groups.select("lang", F.col("g").alias(c), F.col("source").alias(as_))
    pairs = whole.join(small_side(name("a", "source")), ["lang", "a"]).join(small_side(name("b", "item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order("item")))
    part = lambda df, p: df.select("lang", "source", F.lit(p).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(own, "term"))
