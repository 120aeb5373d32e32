"""Exact digests of canonical texts: Unicode normalisation, case folding and white space folding, then 128 bits
of xxhash; texts in one bucket of equal hashes are compared byte by byte, and numbered where they differ.

DataFrame operations only. Normalisation and case folding are those of ICU, which Spark ships for its
collations and which the SQL function `reflect` reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sievegrid.llm.common import id_and_text, small_side, stored

#: White space that NFKC leaves, but for the space.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"
#: Ranges of ids at most in in_ranges(): their first ids go into the plan.
MOST_RANGES = 8000
#: Texts of a range are sorted in one task: ranges of about so many rows.
RANGE_ROWS = 4_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding may undo it), runs of white space as one space, none at the ends.

    Plain ASCII, which has one normal form, takes a shorter way to the same result.
    """
    normal = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(text), F.lit(True))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.btrim(single_spaces(F.when(ascii_only, F.lower(text)).otherwise(normal(folded))))


def single_spaces(text: Column) -> Column:
    """text in NFKC with each run of white space as one space. Plain replacements: an expression for so many kinds costs ten times more."""
    for kind in _SPACES:
        text = F.replace(text, F.lit(kind), F.lit(" "))
    # there are neither tabs nor line ends now: each space becomes a pair of them, what then closes one and opens the next goes
    # (each step names its input once: what is not deterministic by name, as `reflect`, is worked out wherever it is named)
    pairs = F.replace(F.replace(text, F.lit(" "), F.lit("\t\n")), F.lit("\n\t"), F.lit(""))
    return F.replace(pairs, F.lit("\t\n"), F.lit(" "))


def digest(canonical_text: Column) -> Column:
    """32 hexadecimal digits: two xxhash64 of the bytes from different seeds."""
    part = lambda *x: F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0")
    return F.concat(part(canonical_text), part(F.lit("second"), canonical_text))


def in_ranges(rows: DataFrame, ranges: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """rows (doc_id, text and more), dealt into ranges of ids, and the window in which each row meets the following one.

    The order is that of (doc_id, text); rows without an id come first, equal rows follow one another. The
    first row of a range is also a ghost at the end of the range before it, and the very first one at the end
    of the last; drop the ghosts (`_ghost`) afterwards. A range is sorted in one task.
    """
    at = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = rows.select(at.alias("at"))
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, -(-ids.count() // RANGE_ROWS)))
    by_range = ids.repartitionByRange(ranges, "at").groupBy(F.spark_partition_id()).agg(F.min("at").alias("first"))
    firsts = sorted({r["first"] for r in by_range.collect()}) or [0]  # at most MOST_RANGES numbers
    # the range of an id: how many first ids are not above it, looked up among every 90th and then between two of those
    numbers = lambda found: "array(" + ", ".join(f"{x}L" if x > -(1 << 63) else "-9223372036854775807L - 1L" for x in found) + ")"
    step = 90
    fine = "array(" + ", ".join(numbers(firsts[i : i + step]) for i in range(0, len(firsts), step)) + ")"
    dealt = rows.withColumn("_upper", F.size(F.filter(F.expr(numbers(firsts[::step])), lambda x: x <= at)) - 1)
    dealt = dealt.withColumn("_range", F.col("_upper") * step + F.size(F.filter(F.expr(fine)[F.col("_upper")], lambda x: x <= at)) - 1)
    place = F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(firsts))).cast("int").alias("range"), F.lit(True).alias("ghost"))
    dealt = dealt.withColumn("_at", F.explode(F.when(at.isin(firsts), F.array(place, before)).otherwise(F.array(place)))).drop("_upper", "_range")
    # plain columns: by them a second window knows that the rows lie right already
    dealt = dealt.select("*", F.col("_at.range").alias("_range"), F.col("_at.ghost").alias("_ghost"), at.alias("_order")).drop("_at")
    return dealt, Window.partitionBy("_range").orderBy("_ghost", "_order", "text")


def numbered_buckets(texts: DataFrame, limit: int | None = None) -> DataFrame:
    """Of texts (digest, canonical): digest, canonical and number of each distinct text that is not the first of its
    bucket, in order of bytes. Copies are grouped with their bytes as part of the key, before the shuffle."""
    distinct = texts.groupBy("digest", "canonical").agg(F.count("*").alias("n"))
    return distinct.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("canonical")) - 1).where("number > 0").drop("n")


def _resolved(rows: DataFrame, forms: dict[str, str], shown: int) -> DataFrame:
    """rows without their canonical texts, each digest followed by a number where its bucket holds different texts.

    forms: from the column of a digest to that of its canonical text; the first `shown` of them fill the buckets,
    the others repeat these. First pass: the digests, stored. Second pass, over the texts of buckets with two
    rows or more: the bytes. Where every bucket holds one text, which is the rule, nothing else is read.
    """
    light = stored(rows.drop(*forms.values()), "digests")
    every = light.select(F.explode(F.array(*list(forms)[:shown])).alias("digest"))
    shared = stored(every.groupBy("digest").count().where("count > 1").select("digest"), "shared-digests")
    texts = rows.select(F.explode(F.array(*[F.struct(F.col(d).alias("digest"), F.col(c).alias("canonical")) for d, c in list(forms.items())[:shown]])).alias("x")).select("x.*")
    different = stored(numbered_buckets(texts.join(small_side(shared), "digest", "left_semi")), "different-texts")
    if different.isEmpty():
        return light
    for d, c in forms.items():
        number = different.select(F.col("digest").alias(d), F.col("canonical").alias(c), F.col("number").alias(f"_{d}"))
        rows = rows.join(number, [d, c], "left").withColumn(d, F.concat_ws("-", d, F.col(f"_{d}").cast("string"))).drop(f"_{d}")
    return rows.drop(*forms.values())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row: equal canonical texts, and only those, have equal fingerprints.

    Null text counts as empty. Rows without an id and repeated rows are kept; an empty table gives no rows;
    other columns are not read.
    """
    forms = id_and_text(docs, id_col, text_col).select("doc_id", canonical(F.col("text")).alias("form"))
    return _resolved(forms.withColumn("fingerprint", digest(F.col("form"))), {"fingerprint": "form"}, 1)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text of a row has its last quarter (rounded down) replaced by as many code points from the start
    of the next text, in ascending order of id, or by all of it if it has fewer; after the last row comes the
    first. near_*: 1.0 where the fingerprints are equal, else 0.0, as an exact digest knows no likeness in
    between. Cases as in fingerprint() and in_ranges(); a lone row is its own next.
    """
    rows, order = in_ranges(id_and_text(docs, id_col, text_col))
    texts = rows.withColumn("n_chars", F.char_length("text")).withColumn("next_text", F.lead("text").over(order))
    edited = F.expr("concat(left(text, n_chars - n_chars div 4), left(next_text, int(n_chars div 4)))")
    forms = texts.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "_range", "_ghost", "_order", "text", canonical(F.col("text")).alias("form"), edited.alias("edited"))
    hashed = forms.withColumn("fingerprint", digest(F.col("form")))
    hashed = hashed.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).withColumn("next_form", F.lead("form").over(order)).where(~F.col("_ghost"))
    hashed = hashed.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "form", "fingerprint", "next_form", "next_fingerprint", canonical(F.col("edited")).alias("edited_form"))
    hashed = hashed.withColumn("edited_fingerprint", digest(F.col("edited_form")))
    found = _resolved(hashed, {"fingerprint": "form", "edited_fingerprint": "edited_form", "next_fingerprint": "next_form"}, 2)
    same = lambda x: (F.col("fingerprint") == F.col(x)).cast("double")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
