"""Packing, token files, counts and byte-level BPE against the libraries themselves."""

import base64
import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievegrid.llm import bytebpe, chunked, packing, token_counts, token_store
from sievegrid.llm.chunked import encoder

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


def ids_of(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_put_together(path, messy):
    r = random.Random(1)
    odd = ["".join(r.choice("ab  \n\t\r.'sÀé́\x1c\x85\xa0 　<|endoftext|>KİΣ9") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    parts = [*"ab  \n\t\r.'sÀé́\x1c\x85\xa0 　K İΣ9×÷ſŉŸ…≠<|-@Ä", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "'ll", " x.", "  y", "Über", " w" * 30]
    odd += ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts = [t or "" for _, t in messy] + odd
    for some in (texts, texts[::-1], odd[-1:]):  # from an empty table, from a full one, alone
        assert [list(np.frombuffer(b, "<u4")) for b in encoder(path).encode_all(pa.array(some))] == ids_of(path, some)


def test_words_leave_the_table(monkeypatch, messy):
    """A table that holds next to nothing: its halves change places all the time."""
    monkeypatch.setattr(chunked, "GROUP_BYTES", 300)
    small = chunked.ChunkEncoder(WORD)
    small.words = chunked.WordTable(60)
    r = random.Random(3)
    texts = [t or "" for _, t in messy] + [" ".join(f"{r.choice('abcd')}{r.choice(['é', 'o', 'Ö'])}{r.choice('xyz')}" * r.randint(1, 9) for _ in range(30)) for _ in range(200)]
    assert [list(np.frombuffer(b, "<u4")) for b in small.encode_all(pa.array(texts))] == ids_of(WORD, texts)
    assert small.words.older and sum(len(run[0]) for run in small.words.runs) <= 30


def test_token_files(spark, docs, messy, no_docs, tmp_path):
    token_store.write_tokens(docs, str(tmp_path / "t"), WORD)
    got = token_store.token_digests(token_store.read_tokens(spark, str(tmp_path / "t"))).collect()
    order = sorted(messy, key=lambda x: (x[0] is not None, x[0] or 0, np.uint64(xxhash.xxh64_intdigest(x[1] or "", 42)).view(np.int64)))
    start, expected = 0, []
    for (doc, _), ids in zip(order, ids_of(WORD, [t for _, t in order]), strict=True):
        expected.append((doc, start, len(ids) + 1, crc([*ids, 1])))
        start += len(ids) + 1
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected
    rows = token_store.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 13").collect()
    assert rows[0]["ids"] == [*ids_of(WORD, [dict(messy)[13]])[0], 1]
    token_store.write_tokens(no_docs, str(tmp_path / "none"), WORD)
    assert token_store.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_hot_ids_fill_ranges(spark, tmp_path):
    """An id that a third of the rows share, and none, fill several ranges; equal rows too."""
    rows = spark.range(30_000).selectExpr("IF(id % 3 = 0, 77L, IF(id % 3 = 1, NULL, id)) AS doc_id", "concat('text ', id % 500) AS text").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would make one file
    token_store.write_tokens(rows, str(tmp_path / "t"), WORD)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_store.read_tokens(spark, str(tmp_path / "t"))
    raw = spark.read.schema(token_store.SCHEMA).orc(str(tmp_path / "t")).withColumn("file", F.input_file_name())
    per_file = Counter((r["doc_id"], r["file"]) for r in raw.collect())
    assert got.count() == 30_000 and got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == got.agg(F.sum("n_tokens")).first()[0]
    assert all(sum(d == k for d, _ in per_file) > 1 for k in (77, None))


def test_lookups_skip_rows(spark, tmp_path):
    """Bloom filters and row indexes are in the files, and a lookup by id reads one group of 10,000 rows or none."""
    rows = spark.range(0, 60_000, 2, 1).selectExpr("id AS doc_id", "concat('text ', id % 500) AS text")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    token_store.write_tokens(rows, str(tmp_path / "t"), WORD)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    orc, jvm = spark._jvm.org.apache.orc, spark._jvm
    (path,) = tmp_path.glob("t/*.orc")
    file = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(path)), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert file.getNumberOfRows() == 30_000 and file.getRowIndexStride() == 10_000
    reader = file.rows()
    kinds = Counter((str(s.getKind()), s.getColumn()) for stripe in file.getStripes() for s in reader.readStripeFooter(stripe).getStreamsList())
    assert kinds["BLOOM_FILTER_UTF8", 1] and kinds["ROW_INDEX", 1]
    for wanted, most, found in ((30_002, 10_000, 1), (30_001, 0, 0), (10**9, 0, 0)):  # there; between ids that are there; beyond all
        hit = spark.read.schema(token_store.SCHEMA).orc(str(tmp_path / "t")).where(F.col("doc_id") == wanted)
        assert hit._jdf.queryExecution().executedPlan().executeCollect().__len__() == found
        assert hit._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value() <= most


def test_counts_and_cache(spark, docs, messy, no_docs, tmp_path):
    cache = str(tmp_path / "cache")
    expected = Counter((d, len((t or "").encode()), len(ids)) for (d, t), ids in zip(messy, ids_of(BYTE, [t for _, t in messy]), strict=True))
    assert Counter(map(tuple, token_counts.count_tokens(docs, cache, BYTE).collect())) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in messy})
    assert Counter(map(tuple, token_counts.count_tokens(docs, cache, BYTE).collect())) == expected
    assert spark.read.parquet(cache).count() == stored.count()
    # another tokenizer's counts don't meet these
    assert {r["n_tokens"] for r in token_counts.count_tokens(docs.where("doc_id = 13"), cache, WORD).collect()} == {len(ids_of(WORD, [dict(messy)[13]])[0])}
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_counts.count_tokens(no_docs, cache, BYTE).count() == 0


def test_tree_equals_library(library):
    r = random.Random(2)
    bpe = bytebpe.coder(RANKS, public_tokenizers.PATTERN)
    texts = ["".join(r.choice("aabcdeth éñß的。!  \n'sZ09") for _ in range(r.randint(0, 300))) for _ in range(600)]
    texts += ["ab" * 3000, "ть" * 2000, "...!!!" * 900, " " * 3000, "thethethe" * 700]
    for t in texts:
        assert bpe.encode(t) == library.encode_ordinary(t)


def test_byte_bpe(spark, docs, messy, no_docs, library):
    got = bytebpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    expected = []
    for d, t in messy:
        ids = library.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(expected)
    encoded = bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    decoded = bytebpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in decoded) == Counter((d, (t or "").encode()) for d, t in messy)
    assert bytebpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        if at == len(gaps):
            opened += 1
            gap = capacity
        else:
            gap = gaps.pop(at)
        if gap > n:
            bisect.insort(gaps, gap - n)
    return opened


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_sweeps_of_ranges():
    """Rounds over classes, as one range and as ranges that know nothing of each other until they are joined."""
    r = random.Random(5)
    for case in range(200):
        capacity = r.choice([5, 16, 64])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 300))]
        left = [(packing.DOCS, k, 0, n) for k, n in Counter(lengths).items()] + [(packing.NEXT, capacity + 1, 0, 0)]
        steps = []
        for ranges in (1,) if case % 2 else (4, 2, 1):
            found, width = [], -(-(capacity + 1) // ranges)
            for i in range(ranges):
                part = [x[:4] for x in left if (x[1] - 1) // width == i]
                found += packing.sweep(pd.DataFrame(part, columns=["kind", "size", "first", "n"]), capacity)
            steps += [x for x in found if x[0] == packing.STEP]
            left = [x for x in found if x[0] != packing.STEP]
        assert not [x for x in left if x[0] == packing.DOCS]
        used, placed = defaultdict(list), Counter()
        for _, length, rank, n, sequence, fit, before in steps:
            for k in range(n):
                used[sequence + k // fit].append((before + k % fit * length, length))
                placed[length, rank + k] += 1
        assert placed == Counter((k, i) for k, n in Counter(lengths).items() for i in range(n))
        for places in used.values():
            at = 0
            for before, length in sorted(places):
                assert before == at
                at += length
            assert at <= capacity
        best = best_fit_decreasing(lengths, capacity)
        assert len(used) == best if case % 2 else len(used) <= best * 1.02 + 1


def test_packing(docs, messy, no_docs):
    pieces = packing.cut_pieces(docs, WORD)
    got = packing.pack(pieces).collect()
    expected = []
    for (doc, _), ids in zip(messy, ids_of(WORD, [t for _, t in messy]), strict=True):
        ids = [*ids, 0]
        expected += [(doc, n, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for n, at in enumerate(range(0, len(ids), 2048))]
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    assert check_places(got, 2048) == best_fit_decreasing([e[3] for e in expected], 2048)
    assert packing.pack(packing.cut_pieces(no_docs, WORD)).count() == 0


@pytest.mark.parametrize(("ranges", "ranked"), [(packing.RANGES, 20_000), (1, 500)])
def test_hot_length(spark, monkeypatch, ranges, ranked):
    """A third of all rows have one length; they are ranked in one group and in several."""
    monkeypatch.setattr(packing, "RANKED_ROWS", ranked)
    got = packing.pack(spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 700L, 1 + id % 97) AS length").repartition(5), ranges=ranges).collect()
    lengths = [r["length"] for r in got]
    assert len(got) == 3000
    assert check_places(got, 2048) == best_fit_decreasing(lengths, 2048)
    with pytest.raises(Exception, match="length out of range"):
        packing.pack(spark.sql("SELECT 1L AS doc_id, 3000L AS length")).count()


def test_packing_with_names_that_clash(spark):
    """The caller's columns may have any names; those that packing gives are replaced. Equal rows get a place each."""
    rows = [(n % 7, 100 + n % 5, "p", 1, "i", 2, 3, 4, 5, "l") for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, length long, _part string, _row int, it string, group int, sequence_id int, offset long, part int, _Length string").repartition(3)
    got = packing.pack(df)
    assert got.columns == ["doc_id", "length", "_part", "_row", "it", "group", "part", "_Length", "sequence_id", "offset"]
    found = got.collect()
    assert Counter(tuple(r)[:8] for r in found) == Counter((*r[:6], *r[8:]) for r in rows)
    assert check_places(found, 2048) == best_fit_decreasing([r[1] for r in rows], 2048)
