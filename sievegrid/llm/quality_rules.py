"""Quality rules over whole texts, and lines that too many documents of a host share.

DataFrame operations only. One pass over the texts keeps, per row, its counts and for each of its lines a hash of
the normalised line and its words; everything else works on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import fresh, small_side, stored, text_or_empty

#: A line goes if at least LEAST_DOCUMENTS different documents of its host have it, and more than this share of them.
LEAST_DOCUMENTS, HOST_SHARE = 5, 0.06
#: A document is depleted if less than this share of its words is left.
WORDS_LEFT = 0.7

_SPACE = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Runs of anything but the six ASCII white space characters."""
    return F.array_remove(F.split(text, _SPACE + "+"), "")


def _pairs(a: str, b: str, shift: int) -> Column:
    """Hashes of each element of array a with the element of b that lies `shift` places on."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), lambda x, y: F.xxhash64(x, y))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words (long) of the whole text, and _lines.

    Null text has no words. _n_repeat_words: words in runs of five that occur twice or more in the text, the first
    included. _lines: of each line with a word, hash (of the line in lower case, with single spaces) and words.
    """
    # explode() of one struct holds each step's result: named twice in an expression, it would be worked out twice, at
    # every level, or for every element below
    held = lambda df, **c: df.withColumn("_x", F.explode(F.array(F.struct(*[e.alias(k) for k, e in c.items()])))).select(*df.columns, "_x.*")
    long = lambda c: c.cast("long")
    df = held(docs, _text=text_or_empty(text_col))
    normal = lambda x: F.btrim(F.when(x.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(x))
    symbols = F.char_length("_text") - F.char_length(F.regexp_replace("_text", "[#*$%&|<>]", ""))
    raw = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = held(df, _words=words_of(F.col("_text")), _raw_lines=raw, _normal=F.array_remove(F.transform(F.split(F.lower("_text"), "\n"), normal), ""), _n_symbols=long(symbols)).drop("_text")
    df = held(df, _hashes=F.transform("_words", lambda w: F.xxhash64(w)))
    df = held(df, _twos=_pairs("_hashes", "_hashes", 1))
    df = held(df, _fours=_pairs("_twos", "_twos", 2))
    df = held(df, _windows=_pairs("_fours", "_hashes", 4)).drop("_twos", "_fours", "_hashes")
    df = held(df, _repeats=F.size("_windows") > F.size(F.array_distinct("_windows")))
    repeats = F.col("_repeats")
    # only texts with a repeated run: their runs with places, equal ones next to each other
    df = held(df, _ordered=F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    size = F.size("_ordered") - 1
    twins = F.zip_with(F.slice("_ordered", F.lit(1), size), F.slice("_ordered", F.lit(2), size), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = held(df, _starts=F.when(repeats, F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda p: p.isNotNull())))))).drop("_ordered")
    steps = F.size("_starts") - 1
    # a run covers five words, or as many as there are up to the next repeated run
    covered = F.aggregate(F.zip_with(F.slice("_starts", F.lit(1), steps), F.slice("_starts", F.lit(2), steps), lambda a, b: F.least(b - a, F.lit(5))), F.lit(5), lambda s, x: s + x)
    lines = F.transform("_normal", lambda x: F.struct(F.xxhash64(x).alias("hash"), (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))
    counts = {
        "_n_words": long(F.size("_words")),
        "_word_chars": long(F.char_length(F.array_join("_words", ""))),
        "_n_symbols": F.col("_n_symbols"),
        "_n_dup_lines": long(F.size("_raw_lines") - F.size(F.array_distinct("_raw_lines"))),
        "_n_repeat_words": long(F.when(repeats, covered).otherwise(0)),
        "_lines": lines,
    }
    return df.select(*docs.columns, *[c.alias(k) for k, c in counts.items()])


def base_failed() -> Column:
    return (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))


def frequent_lines(lines: DataFrame, hosts: DataFrame, least: int, share: float) -> DataFrame:
    """host, hash of the lines above the limits.

    lines (host, hash, content): one row per line and document. Documents with the same content count once, for
    copies are no boilerplate. Both steps are pre-aggregated, so that a line which a third of all rows have
    moves once per task. hosts (host, documents): how many different documents a host has. The share holds for hosts
    of any size; `least` is the evidence without which no line is boilerplate, so a host of fewer documents loses none.
    """
    distinct = lines.groupBy("host", "hash", "content").agg(F.lit(1).alias("one"))
    counted = distinct.groupBy("host", "hash").agg(F.sum("one").alias("n")).where(F.col("n") >= least)
    return counted.join(small_side(hosts), "host").where(F.col("n") > share * F.col("documents")).select("host", "hash")


def judge(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCUMENTS, share: float = HOST_SHARE, left: float = WORDS_LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left, kept of every row.

    kept: not base_failed, and at least `left` of the words are outside lines above the limits. Null text has no words
    and fails; a null host is a host of its own; rows without an id and repeated rows are judged each; an empty
    table gives no rows; other columns are not read.
    """
    judged = _judged(docs.select(F.col(id_col).cast("long").alias("doc_id"), _host(host_col).alias("host"), text_or_empty(text_col).alias("text")), least, share, left)
    return judged.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "n_words_left", "kept")


def _host(host_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\0")))


def _verdict_key(host_col: str, text_col: str) -> Column:
    """SHA-256 of host and text, on which alone the verdict depends."""
    return F.unhex(F.sha2(F.concat_ws("\0", F.hex(_host(host_col)), text_or_empty(text_col)), 256))


def _judged(rows: DataFrame, least: int, share: float, left: float) -> DataFrame:
    """rows (host, text and more) with their verdicts instead of texts; _hits: hashes of their lines above the limits, null without any.
    A row has at most as many hits as lines."""
    found = with_counts(rows.withColumn("content", F.xxhash64("text"))).drop("text")
    counts = stored(found.withColumn("row", F.monotonically_increasing_id()), "line-hashes")
    each = counts.select("row", "host", "content", F.inline("_lines"))
    hosts = counts.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    frequent = stored(frequent_lines(each.select("host", "hash", "content"), hosts, least, share), "frequent-lines")
    removed = each.select("row", "host", "hash", "words").join(small_side(frequent), ["host", "hash"]).groupBy("row").agg(F.sum("words").alias("removed"), F.collect_set("hash").alias("_hits"))
    judged = counts.drop("_lines").join(removed, "row", "left").withColumn("n_words_left", F.col("_n_words") - F.coalesce("removed", F.lit(0))).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= left * F.col("_n_words")))


def keep(docs: DataFrame, host_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, share: float = HOST_SHARE, left: float = WORDS_LEFT) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns and their whole texts. Cases as in judge()."""
    return _kept_with_hits(docs, host_col, text_col, least, share, left)[0].select(*docs.columns)


def _kept_with_hits(docs: DataFrame, host_col: str, text_col: str, least: int, share: float, left: float | None) -> tuple[DataFrame, str]:
    """The rows of docs that judge() keeps (all of them if left is None), and the name of a column with the hashes of their own
    lines above the limits, null without any.

    Verdicts and hits depend on host and text alone, so only the texts that are rejected or have hits meet the rows, in one join.
    """
    judged = _judged(docs.select(_verdict_key(host_col, text_col).alias("key"), _host(host_col).alias("host"), text_or_empty(text_col).alias("text")), least, share, left or 0.0)
    on, stays, hits = fresh(docs, "_on", "_stays", "_hits")
    of_text = judged.select(F.col("key").alias(on), (F.lit(True) if left is None else F.col("kept")).alias(stays), F.col("_hits").alias(hits))
    known = stored(of_text.where(~F.col(stays) | F.col(hits).isNotNull()).dropDuplicates([on]), "verdicts")
    # a row counts as one and as its hits, for these are what a broadcast carries
    size = known.agg(F.sum(1 + F.coalesce(F.size(hits), F.lit(0)))).first()[0] or 0
    joined = docs.join(small_side(known, size), _verdict_key(host_col, text_col) == F.col(on), "left")
    return joined.where(F.coalesce(stays, F.lit(True))).drop(on, stays), hits


def _cleaned(text_col: str, hits: str) -> Column:
    """The text less the lines whose hashes are among its hits."""
    line_hash = lambda x: F.xxhash64(F.btrim(F.lower(F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " "))))
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(hits, line_hash(x))), "\n")
    return F.when(F.col(hits).isNull(), F.col(text_col)).otherwise(rest)


def keep_cleaned(docs: DataFrame, host_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", least: int = LEAST_DOCUMENTS, share: float = HOST_SHARE, left: float = WORDS_LEFT) -> DataFrame:
    """The rows that keep() keeps, their texts less the lines above the limits, which are those of all docs.

    chars_col takes the length of each text that loses lines; everything else stays. Cases as in judge().
    """
    kept, hits = _kept_with_hits(docs, host_col, text_col, least, share, left)
    (name,) = fresh(kept, "_cleaned")
    cleaned = kept.withColumn(name, _cleaned(text_col, hits))
    lost = F.col(name) != F.col(text_col)
    chars = F.when(lost, F.char_length(name)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
    return cleaned.select(*[chars.alias(c) if c == chars_col else F.col(name).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def without_frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, share: float = HOST_SHARE) -> DataFrame:
    """docs with `text_col` less the lines above the limits; all rows and columns stay, null text stays null."""
    rows, hits = _kept_with_hits(docs, host_col, text_col, least, share, None)
    return rows.select(*[_cleaned(text_col, hits).alias(c) if c == text_col else F.col(c) for c in docs.columns])
