"""Near-duplicates, quality rules, fingerprints and URL templates against plain versions."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import common, fingerprints, graph, neardup, quality_rules, queries, url_templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return t.encode().lower().decode()


def plain_components(rows, words, percent):
    """Every pair of texts."""
    sets = []
    for _, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    up = {d: d for d, _ in rows if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if a[0] is not None and rows[j][0] is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = top(a[0]), top(rows[j][0])
                up[max(x, y)] = min(x, y)
    return [(d, len(s), top(d) if d is not None else None) for (d, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 512), (5, 80, 2)])
def test_near_duplicates(docs, messy, no_docs, words, percent, block):
    s = neardup.Settings(words=words, percent=percent, block=block)
    got = neardup.link(docs, s).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(plain_components(messy, words, percent))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.link(no_docs, s).count() == 0


def test_group_of_near_copies(spark):
    """Copies that differ in more or fewer words: many pairs are linked, many are not, and some are only through others."""
    r = random.Random(6)
    base = [f"w{r.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for n in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9999)}"
        rows.append((n, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.link(df, neardup.Settings(words=3, percent=85, bands=24, block=16)).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == plain_components(rows, 3, 85)


def test_keep_one_of_each(spark, docs, messy):
    kept = neardup.keep(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    expected = Counter({d: 1 for d, _, c in plain_components(messy, 5, 80) if d is not None and d == c})
    expected[None] = sum(d is None for d, _ in messy)
    assert ids == expected


def test_keep_with_names_that_clash(spark):
    text = lambda k: " ".join(f"{k}{n}" for n in range(40))
    rows = [(1, text("a"), "g", 1, 2, 3, "n"), (2, text("a"), "h", 1, 2, 3, "n"), (3, text("b"), "i", 1, 2, 3, "n")]
    names = "doc_id long, text string, _gone string, _again int, _nth int, _row int, _ID string"
    kept = neardup.keep(spark.createDataFrame(rows, names))
    assert kept.columns == [c.split()[0] for c in names.split(", ")] and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    assert sorted(map(tuple, neardup.keep(spark.createDataFrame(rows + rows[:1], names)).collect())) == [rows[0], rows[2]]


def test_hot_buckets(spark, monkeypatch):
    """Near copies that fill buckets of more rows than a task should have: these are split, the components stay."""
    from sievegrid.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    r = random.Random(9)
    base = [f"w{n}" for n in range(200)]
    rows = [(n, " ".join(base[:k] + [f"x{n}"] + base[k + 1 :])) for n in range(90) for k in [r.randrange(200)]]
    rows += [(500 + n, " ".join(f"y{n}z{k}" for k in range(30))) for n in range(40)]
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == plain_components(rows, 5, 80)


def test_spread_join(spark):
    from sievegrid.llm import common

    left = spark.range(5000).selectExpr("IF(id % 2 = 0, 0L, id) AS k", "id AS v")
    right = spark.range(3000).selectExpr("id AS k", "id * 10 AS w")
    hot = common.hot_keys(left.groupBy("k").count(), ["k"], "count", 5000)
    assert [tuple(r) for r in hot.collect()] == [(0, 3)]
    for how in ("inner", "left"):
        plain, spread = left.join(right, ["k"], how), common.spread_join(left, right, ["k"], how, hot)
        assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, plain.collect()))
    assert common.hot_keys(right.groupBy("k").count(), ["k"], "count", 3000) is None


def test_id_with_two_texts(spark):
    """An id that repeats with another text links the copies of both; no text goes for the other's sake."""
    a, b, c = (" ".join(f"{k}{n}" for n in range(40)) for k in "abc")
    rows = [(1, b), (2, b), (2, a), (3, a), (4, c), (4, c), (5, ""), (5, b), (6, a), (6, c), (7, ""), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.link(df).collect())
    assert got == Counter(plain_components(rows, 5, 80))
    assert sorted(map(tuple, neardup.keep(df).collect())) == [(1, b), (2, a), (4, c), (5, ""), (7, "")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    expected = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in expected.description)
    place = [[c[0] for c in expected.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[i] for i in place) for r in expected.fetchall())


def plain_counts(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def plain_rules(rows, least, share, left):
    """rows (id, text, host)."""
    normal = lambda x: " ".join(WORD.findall(x.lower()))
    have, hosts = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        hosts[h].add(t or "")
        for x in (t or "").split("\n"):
            if normal(x):
                have[h, normal(x)].add(t or "")
    often = {k for k, d in have.items() if len(d) >= least and len(d) > share * len(hosts[k[0]])}
    out = []
    for i, t, h in rows:
        c = plain_counts(t)
        rest = sum(len(normal(x).split(" ")) for x in (t or "").split("\n") if normal(x) and (h, normal(x)) not in often)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        out.append((i, *c, failed, rest, not failed and rest >= left * c[0]))
    return out


PRODUCTION = (quality_rules.LEAST_DOCUMENTS, quality_rules.HOST_SHARE, quality_rules.WORDS_LEFT)


@pytest.mark.parametrize(("least", "share", "left"), [PRODUCTION, (2, 0.0, 0.3)])
def test_quality_rules(docs, no_docs, least, share, left):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = quality_rules.judge(docs, least=least, share=share, left=left).collect()
    assert Counter(map(tuple, got)) == Counter(plain_rules(rows, least, share, left))
    assert quality_rules.judge(no_docs).count() == 0
    kept = quality_rules.keep(docs, least=least, share=share, left=left)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(x[0] for x in plain_rules(rows, least, share, left) if x[-1])


def test_rules_on_tables(spark):
    """The method decides: some documents that pass the base rules go, few of them."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()
    got = queries.op7_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert Counter(map(tuple, got)) == Counter(plain_rules([tuple(r) for r in rows], *PRODUCTION))
    depleted = sum(not r["kept"] and not r["base_failed"] for r in got)
    assert 0 < depleted < 0.02 * len(got)


def site(host, n, start, line="Shared  LINE of the site", words=20):
    """n documents of a host with their own words and its line."""
    return [(start + k, " ".join(f"{host}{k}w{i}" for i in range(words)) + f"\n\n{line}", "en", host, None) for k in range(n)]


def sized(spark, rows):
    rows = [(*r[:4], len(r[1])) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), rows


def test_hosts_of_any_size(spark):
    """A small, a middle and a hot host: the line of each goes, a document of it alone is depleted, others stay.
    Copies are no boilerplate, nor are lines of few documents."""
    rows = site("small", 6, 0) + site("middle", 60, 1000) + site("hot", 600, 2000) + site("few", 3, 5000)
    rows += [(9000 + k, f"{h} has few words here now\nShared line of the site", "en", h, None) for k, h in enumerate(("small", "middle", "hot", "few"))]
    rows += [(7000 + k, " ".join(f"copy{i}" for i in range(12)), "en", "small", None) for k in range(50)]
    df, rows = sized(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert {d for d, r in got.items() if not r["kept"]} == {9000, 9001, 9002}
    assert all(got[d]["n_words_left"] == got[d]["n_words"] - 5 for d in (0, 1000, 2000)) and got[7000]["n_words_left"] == 12
    # five documents have it in a host of 100: at no more than the share it stays
    df, _ = sized(spark, site("h", 5, 0) + site("h", 95, 100, ""))
    assert all(r["n_words_left"] == r["n_words"] for r in quality_rules.judge(df).collect())


def test_stage_removes_lines(spark):
    """The lines that the pipeline's stage judges as boilerplate are gone from what it hands on; the rest is as it was."""
    rows = site("h", 60, 0) + [(100, "few own\n" + "shared line of the site\n" * 3, "en", "h", None), (200, "a b c d e f g h i j\nshared line of the site", "en", "g", None)]
    df, rows = sized(spark, rows)
    got = corpus_pipeline.quality_rule_filter(spark, df, "")
    assert got.schema == df.schema
    own = [(n, t.rsplit("\n", 1)[0], "en", "h", len(t.rsplit("\n", 1)[0])) for n, t, *_ in rows[:60]]
    assert sorted(map(tuple, got.collect())) == [*own, rows[-1]]


def test_names_that_clash(spark):
    """Columns of the caller that carry the operator's own names."""
    rows = [(*r, "h1", 2, "c", 4, 5, "o") for r in site("h", 30, 0)] + [(100, "few own\n" + "shared line of the site\n" * 3, "en", "h", None, "h1", 2, "c", 4, 5, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _host string, _content int, _rejected string, _cleaned int, _hashes int, _ON string")
    assert quality_rules.keep(df).count() == 30
    kept = quality_rules.keep_cleaned(df)
    assert kept.columns == df.columns and {tuple(r)[5:] for r in kept.collect()} == {("h1", 2, "c", 4, 5, "o")}
    cleaned = quality_rules.without_frequent_lines(df)
    assert cleaned.columns == df.columns and cleaned.count() == 31 and cleaned.where("text LIKE '%site%'").isEmpty()


def folded(t):
    normal = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", normal(normal(t).casefold())).strip()


def test_fingerprints(docs, messy, no_docs):
    got = fingerprints.fingerprint(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in messy)
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] is not None}
    texts = dict(messy)
    for a in prints:
        for b in prints:
            assert (prints[a] == prints[b]) == (folded(texts[a] or "") == folded(texts[b] or "")), (a, b)
    assert fingerprints.fingerprint(no_docs).count() == 0


@pytest.mark.parametrize("rows_a_range", [4000, 5])
def test_edits(docs, messy, no_docs, monkeypatch, rows_a_range):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows_a_range)
    order = sorted(((d, t or "") for d, t in messy), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = []
    for n, (d, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(folded(t) == folded(edited)), float(folded(t) == folded(following))))
    got = fingerprints.compare_with_edits(docs).select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next").collect()
    assert Counter(map(tuple, got)) == Counter(expected)
    assert fingerprints.compare_with_edits(no_docs).count() == 0


def test_numbers_in_a_bucket(spark):
    df = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "a"), ("e", "c"), ("e", "c")], "digest string, canonical string")
    assert [tuple(r) for r in fingerprints.numbered_buckets(df).collect()] == [("d", "b", 1)]
    rows = df.selectExpr("digest AS f", "canonical AS form")
    assert Counter(r["f"] for r in fingerprints._resolved(rows, {"f": "form"}, 1).collect()) == Counter({"d": 2, "d-1": 1, "e": 2})


URLS = ["http://A.com/en/1", "https://www.example.com/en/2?x#y", "https://blog.example.com/en/3", "https://x.net/es/4/", "https://x.net/es?q", "x.net/es/1", None, "ftp://", "http://u.net/fr/#a", "http://example.com#f", "https://net/fr/x", "https://planet/fr/x", "http://é.com/É", "a://b.com/x://y/z"]


def test_rules(spark):
    df = spark.createDataFrame([(n, u, "h", 5) for n, u in enumerate(URLS)], "page_id long, url string, host string, pages int")
    got = {r["page_id"]: r for r in url_templates.judge(df, queries.URL_RULES).collect()}

    def plain(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = ascii_lower(host)
        fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, key=lambda f: len(f[0]), default=None)

    for n, u in enumerate(URLS):
        host, path, rule = plain(u)
        assert (got[n]["host"], got[n]["path"], got[n]["rule"]) == (host, path, rule and rule[0])
        if rule:
            assert got[n]["verdict"] == rule[1]
    assert url_templates.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_templates_learn(spark):
    rows = []
    for n in range(400):
        rows.append((n, f"http://shop.org/item/{n}", 0 if n < 50 else None))
        rows.append((1000 + n, f"http://shop.org/promo/{n}/win", 1 if n < 50 else None))
        rows.append((2000 + n, f"http://shop.org/deal/{n}/win", 1 if n < 40 else None))
        rows.append((3000 + n, f"http://other.org/{n}/win", None))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = url_templates.judge(df, [], bad_col="bad").collect()
    verdicts = defaultdict(set)
    for r in got:
        verdicts[r["host"], r["template"]].add(r["verdict"])
    assert dict(verdicts) == {("shop.org", "/item/*"): {"allow"}, ("shop.org", "/promo/*/win"): {"block"}, ("shop.org", "/deal/*/win"): {"block"}, ("other.org", "/*/win"): {"allow"}}


def test_segments_at_any_depth(spark):
    """Pages that differ in the eighth segment only: each kind by its own labels."""
    kinds = [("good", 0), ("bad", 1)]
    rows = [(1000 * y + n, f"http://deep.org/a/b/c/d/e/f/g/{kind}/{n}", y if n < 50 else None) for kind, y in kinds for n in range(100)]
    rows += [(5000 + n, f"http://deep.org/a/b/x{n}/y", None) for n in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = url_templates.judge(df, [], bad_col="bad").collect()
    expected = Counter({("/a/b/c/d/e/f/g/good/*", "allow"): 100, ("/a/b/c/d/e/f/g/bad/*", "block"): 100, ("/a/b/*/y", "allow"): 3})
    assert Counter((r["template"], r["verdict"]) for r in got) == expected


def test_small_hosts(spark):
    """Of a few pages a host: what rules say of some kinds of pages doesn't reach the others, which have no labels; where a
    segment varies, it does. Repeated rows count, null ids and long paths are judged like others."""
    kinds = [("es", 1), ("fr", 1), ("de", None), ("en", None)]
    rows = [(1000 * k + n, f"http://small.net/{kind}/{n}", bad) for k, (kind, bad) in enumerate(kinds) for n in range(15)]
    rows += [(None, f"http://small.net/de/{n}", None) for n in range(3)] + [(2001, "http://small.net/de/1", None)] * 2
    rows += [(5000 + n, f"http://ids.net/x{n}/{n % 7}", 1 if n < 50 else None) for n in range(60)]
    rows += [(6000 + n, f"http://mixed.net/k{n % 15}/{n}", int(n % 15 < 12)) for n in range(150)]
    rows += [(7000, "http://long.net/" + "a/" * 3000, 1), (7001, "http://long.net/" + "b" * 100_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int").repartition(3)
    got = url_templates.judge(df, [], bad_col="bad").collect()
    assert len(got) == len(rows)
    verdicts = defaultdict(set)
    for r in got:
        verdicts[r["host"], r["path"].split("/")[1]].add(r["verdict"])
    assert all(verdicts["small.net", kind] == {"allow" if bad is None else "block"} for kind, bad in kinds)
    assert all(v == {"block"} for (h, _), v in verdicts.items() if h == "ids.net")
    assert all(verdicts["mixed.net", f"k{k}"] == {"block" if k < 12 else "allow"} for k in range(15))


def test_similar_siblings_share_their_labels(spark):
    df = spark.createDataFrame([("h", "/a", 100, 98), ("h", "/b", 6, 6), ("h", "/c", 100, 2), ("h", "/d", 0, 0)], "host string, template string, labelled long, bad long")
    got = {r["template"]: r for r in url_templates.judged_templates(df).collect()}
    assert got["/a"]["purity"] == got["/b"]["purity"] > 0.9 and got["/b"]["rejected"]
    assert got["/c"]["purity"] < 0.1 and not got["/d"]["rejected"]


def test_few_labels_are_lent_some(spark):
    """Pages without labels follow the labelled ones of their host if these are of one kind, unless they are so many that having
    no labels tells them apart."""
    rows = [(n, f"http://one.net/{kind}/{n}", bad) for n, (kind, bad) in enumerate([("es", 1)] * 40 + [("fr", 1)] * 30 + [("de", None)] * 2 + [("en", None)] * 100)]
    rows += [(1100 + n, f"http://two.net/{kind}/{n}", bad) for n, (kind, bad) in enumerate([("es", 1)] * 40 + [("fr", 0)] * 40 + [("de", None)] * 2)]
    rows += [(1200 + n, f"http://three.net/de/{n}", None) for n in range(5)]
    rows += [(1300 + n, f"http://four.net/shop/{kind}/{n}", bad) for n, (kind, bad) in enumerate([("a", 1)] * 40 + [("b", None)] * 3 + [("c", None)] * 60)]
    rows += [(1500 + n, f"http://four.net/blog/{n}", 0) for n in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int").repartition(3)
    verdicts = defaultdict(set)
    for r in url_templates.judge(df, [], bad_col="bad").collect():
        verdicts[r["host"].split(".")[0] + "/".join(r["path"].split("/")[:-1])].add(r["verdict"])
    blocked = {"one/es", "one/fr", "one/de", "two/es", "four/shop/a", "four/shop/b"}
    assert dict(verdicts) == {k: {"block" if k in blocked else "allow"} for k in verdicts}
    assert len(verdicts) == 12


def test_rounds_follow_divisions(spark, monkeypatch):
    """A long start that all paths of a host share takes one round, and so does a path that a host has alone."""
    rounds, passed = [], url_templates._passed
    monkeypatch.setattr(url_templates, "_passed", lambda tree: rounds.append(1) or passed(tree))
    deep = "a/" * 2000
    paths = [("h", f"/{deep}{n}", 1, 0, 0) for n in range(9)] + [("h", f"/{deep}", 1, 0, 0), ("alone", f"/{deep}x", 3, 0, 0), ("few", "/b/c", 2, 0, 0)]
    df = spark.createDataFrame(paths, "host string, path string, pages long, labelled long, bad long")
    got = Counter((r["host"], r["template"]) for r in url_templates.with_templates(df).collect())
    start = "/a" * 2000
    assert got == Counter({("h", f"{start}/*"): 9, ("h", start): 1, ("alone", f"{start}/x"): 1, ("few", "/*/*"): 1})
    assert len(rounds) == 1


def test_signature_estimates():
    """Least and greatest values agree at the rate of the similarity."""
    a, b = np.arange(1, 3001, dtype=np.uint64), np.arange(301, 3301, dtype=np.uint64)
    mix = lambda x: x * np.uint64(0x9E3779B97F4A7C15) ^ (x << np.uint64(31))
    hashing = neardup.MinMax(1000, 3)
    (la, ga), (lb, gb) = hashing(mix(a)), hashing(mix(b))
    for x, y in ((la, lb), (ga, gb)):
        assert abs((x == y).mean() - 2700 / 3300) < 0.05


def tables_left(spark):
    """Paths of the stored tables that exist in the work folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(common.work_folder(spark)).getParent()
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(x.getPath()) for x in fs.listStatus(root)} if fs.exists(root) else set()


def test_settled_keeps_only_the_result(spark):
    """Inner results are tables on the way of the outer one, and everything goes if a step fails."""
    before, seen = tables_left(spark), []

    def inner():
        common.stored(spark.range(5), "on-the-way")
        return common.stored(spark.range(7), "on-the-way").where("id > 2")

    def outer():
        found = common.settled(spark, inner, "inner")
        seen.append(tables_left(spark) - before)
        return found.where("id > 4")

    assert sorted(r["id"] for r in common.settled(spark, outer, "outer").collect()) == [5, 6]
    assert ["inner" in x for x in seen.pop()] == [True]
    after = tables_left(spark) - before
    assert ["outer" in x for x in after] == [True]

    def broken():
        common.stored(spark.range(3), "on-the-way")
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError, match="broken"):
        common.settled(spark, broken)
    assert tables_left(spark) - before == after


def test_near_duplicates_leave_one_table(spark, docs):
    before = tables_left(spark)
    found = neardup.link(docs)
    assert len(tables_left(spark) - before) == 1 and found.count() == docs.count()


def test_lines_of_copies(spark):
    """All copies of a text lose its lines, each line wherever it stands; in another host the same text keeps them."""
    rows = site("h", 60, 0) + [(100 + k, f"Shared line OF the site\n{' '.join(f'x{i}' for i in range(30))}\n\n shared  line of the site ", "en", h, None) for k, h in enumerate(["h"] * 4 + ["g"])]
    df, rows = sized(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.keep_cleaned(df).collect()}
    own = " ".join(f"x{i}" for i in range(30)) + "\n"
    assert all(got[100 + k]["text"] == own and got[100 + k]["n_chars"] == len(own) for k in range(4))
    assert got[104]["text"] == rows[-1][1] and len(got) == len(rows)
