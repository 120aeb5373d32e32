"""Prefix trie, suffix arrays and source divergence against plain versions; test_documents.py compares their queries with SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievegrid.llm import common, divergence, prefix_trie, suffix_dedup

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture()
def spread(spark):
    """Small tables keep their partitions, so that runs go over the ends of ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_trie(rows, graft):
    """Every beginning of every conversation as a tuple."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in turns.items():
        heads = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - c % 5, [])[:heads] + x[heads:] if graft else x
    members = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        child = lambda q: [u for u in members if len(u) == len(q) + 1 and u[:-1] == q]
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(child(p)), sum(not child(q) for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(r.choice([0, 1, 3, 6, 12])):
            rows.append((c, t if r.random() > 0.1 else None, r.choice(["user", "assistant", None]), r.choice(["", None, "é", "a", "a b"])))
    rows += [(None, 1, "user", "lost"), (3, 0, "user", "again"), (3, 0, "user", "again"), (77, 5, None, None)]
    rows += [(80, t, "user", f"turn {t % 3}") for t in range(150)] + [(81, t, "user", f"turn {t % 3}") for t in range(120)] + [(82, 0, "user", "x" * 200_000)]
    return rows


@pytest.mark.parametrize(("primes", "graft"), [((2147483647, 2147483629), True), ((2147483647, 2147483629), False), ((2, 3), True)])
def test_trie(spread, talks, primes, graft):
    df = spread.createDataFrame([(*x, 1, 2) for x in talks], "conv_id long, turn long, role string, text string, depth int, id int").repartition(5)
    s = prefix_trie.Settings(primes)
    if graft:
        turns, convs = prefix_trie.grafted(prefix_trie.turns_of(df), F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9, 8)
        got = prefix_trie.build(turns, convs, s)
    else:
        got = prefix_trie.trie(df, s)
    assert Counter(tuple(x) for x in got.collect()) == plain_trie(talks, graft)
    assert prefix_trie.trie(df.limit(0), s).count() == 0


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    often = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "head", "batches", "piece"), [(20, 8, 4, 3), (20, 20, 1, 16), (20, 1, 3, 5)])
def test_removal(spread, length, head, batches, piece):
    r = random.Random(length + head)
    words = ["ab", "c", "dé", "eee", "f g", "x", "yz"]
    base = ["".join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(12)]
    cut = lambda b: b[(i := r.randint(0, len(b))) : r.randint(i, len(b))]
    texts = ["".join(cut(r.choice(base)) for _ in range(r.randint(0, 3))) for _ in range(90)]
    texts += [None, "", "z" * 100, "z" * 19, "z" * 20, "ab" * 60, texts[5], texts[5], texts[7], "".join(r.choice(words) for _ in range(40_000))]
    df = spread.createDataFrame([(n, t, "x", 0) for n, t in enumerate(texts)], "doc_id long, text string, row string, batch int").repartition(3)
    got = {x[0]: tuple(x[1:]) for x in suffix_dedup.remove_repeats(df, suffix_dedup.Settings(length, head, batches, piece)).collect()}
    assert got == dict(enumerate(plain_removal(texts, length)))
    assert sum(x[1] > 0 for x in got.values()) > 20


@pytest.fixture()
def all_hot(monkeypatch):
    """Every key that two rows have counts as hot, and no side is small."""
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)


def test_hot_keys_are_split(all_hot, spark, talks):
    """Copies, a passage that all texts share, and conversations that begin alike: the same results as without hot keys."""
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(60))
    texts = ["".join(r.choice("ijklmnop ") for _ in range(r.randint(0, 30))) + passage + str(n) for n in range(30)] + [passage * 2] * 12
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x[0]: tuple(x[1:]) for x in suffix_dedup.remove_repeats(df, suffix_dedup.Settings(20, 8, 2, 4)).collect()}
    assert got == dict(enumerate(plain_removal(texts, 20)))
    rows = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(3)
    assert Counter(tuple(x) for x in prefix_trie.trie(rows, prefix_trie.Settings((2, 3))).collect()) == plain_trie(talks, False)


def test_removal_of_messy_rows(docs, messy, no_docs):
    """Rows without an id and repeated rows are texts of their own."""
    got = suffix_dedup.remove_repeats(docs)
    assert Counter(tuple(x) for x in got.collect()) == Counter((i, *x) for (i, _), x in zip(messy, plain_removal([t for _, t in messy], 200), strict=True))
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_levels_merge(spark):
    """Four batches: two levels of one rank become one of the next, and the family meets what one scan of all would."""
    family, r = suffix_dedup.SuffixFamily(spark), random.Random(2)
    batches = [[(r.randint(0, 30), r.randint(0, 2)) for _ in range(25)] for _ in range(4)]
    settled, is_open, ranks = set(), set(), []
    for b in batches:
        for x in family.add(spark.createDataFrame(b, "key long, block long").repartition(2)).collect():
            settled |= {(x["key"], x["block"])} if x["is_settled"] else set()
            is_open |= {(x["key"], x["block"])} if x["is_open"] else set()
        ranks.append([k for k, _ in family.levels])
    often = Counter(x for b in batches for x in b)
    kinds = Counter(k for k, _ in often)
    assert ranks == [[0], [0, 0], [1, 0], [1, 0, 0]]
    assert settled == {x for x, n in often.items() if n > 1}
    assert is_open == {x for x in often if kinds[x[0]] > 1}


def plain_audit(rows, least, top):
    """All terms of all pairs, whole numbers of any size."""
    rows = [(lang or "", source or "", TERM.findall((text or "").encode().lower().decode())) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in rows}:
        df, total, of = Counter(), Counter(), defaultdict(Counter)
        for _, source, terms in (x for x in rows if x[0] == lang):
            df.update(set(terms))
            total.update(terms)
            of[source].update(terms)
        kept = sorted(t for t in df if df[t] >= least)
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        q, p = p_of(total), {s: p_of(c) for s, c in of.items()}
        for s in of:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in of if o != s]
            own = [(t, f(p[s][t], q[t])) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(ranked, 1)]
    return Counter(out)


@pytest.mark.parametrize(("light", "tile", "tile_terms"), [(8, 64, 2048), (2, 3, 5), (0, 64, 7), (99, 2, 4)])
def test_audit(spread, light, tile, tile_terms):
    r = random.Random(3)
    terms = [f"{a}{b}" for a in "abcdeß" for b in "XYzéñ"] + ["the", "And", "日本"]
    rows = []
    for n in range(150):
        source = r.choice(["s1", "s2", "s3", "s4", "é", None, ""])
        of = terms[: r.choice([3, 10, 33])]
        rows.append((r.choice(["en", "de", None]), source, " ".join(r.choice(of) + r.choice(["", ".", "1", "_x\n"]) for _ in range(r.randint(0, 40)))))
    rows += [("fr", "alone", "un deux"), ("it", "a", ""), ("it", "b", None), ("en", "s9", "\x00 12 $"), ("en", "s1", "the " * 60_000), *rows[:9]]
    df = spread.createDataFrame([(*x, 1, 2) for x in rows], "lang string, source string, text string, term int, value int").repartition(4)
    got = divergence.audit(df, 3, 5, light, tile, tile_terms)
    assert Counter(tuple(x) for x in got.collect()) == plain_audit(rows, 3, 5)
    assert divergence.audit(df.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Aé-b c0dd ".encode() * 50
    whole = [t for part in divergence.terms_of(text) for t in part if t]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for part in divergence.terms_of(text) for t in part if t] == whole
