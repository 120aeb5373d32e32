"""Held-out accuracy of the learnt scores, and their cases."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import common, quality_model, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out(name, rows, label, held):
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{SF}/labels.parquet'").fetchall())
    return [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] == held and r["doc_id"] in labels]


def area(rows):
    good, bad = ([s for s, _, y in rows if y == k] for k in (1, 0))
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_toxicity_held_out(spark):
    rows = queries.op2_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert area(held_out("op2", rows, "toxic", True)) > 0.8  # 270 labelled texts to learn from


def test_quality_held_out(spark):
    rows = queries.op9_quality_model(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    found = held_out("op9", rows, "quality", True)
    assert area(found) > 0.95
    assert np.mean([p == y for _, p, y in found]) > 0.9


def test_pairs_add_to_the_linear_part(spark, tmp_path):
    """Insults and mentions of groups, one or several, are both common in clean texts; toxic are the texts that have both. Through the query, on
    held-out texts, the whole machine orders them better than its linear part."""
    r = np.random.default_rng(8)
    insults, groups, plain = ([f"{k}{chr(97 + i)}{chr(122 - i)}" for i in range(n)] for k, n in (("insult", 6), ("group", 6), ("word", 24)))
    rows = []
    for n in range(3000):
        words = [str(w) for w in r.choice(plain, 30)]
        has = r.random(2) < 0.45
        words += [str(w) for x, h in zip((insults, groups), has, strict=True) if h for w in r.choice(x, r.integers(1, 5), replace=False)]
        rows.append((n, " ".join(r.permutation(words)), int(has.all())))
    docs = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(n, 1, y) for n, _, y in rows], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    truth = {n: y for n, _, y in rows}
    whole = [(x["score"], x["predicted"], truth[x["doc_id"]]) for x in queries.op2_toxicity(spark, str(tmp_path)).collect() if x["held_out"]]
    machine = toxicity.fit(docs, labels.where(queries.remainder(3) != 1))
    alone = toxicity.Machine(machine.slots, machine.bias, machine.linear, np.zeros_like(machine.factors))
    linear = [(x["score"], None, truth[x["doc_id"]]) for x in toxicity.score(docs, alone).collect() if zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert area(whole) > 0.98 and area(whole) > area(linear) + 0.01
    assert np.mean([p == y for _, p, y in whole]) > 0.95


def test_terms_by_parameters():
    """Without thresholds all frequent terms take part."""
    labels, texts = pair_task(lambda a, b: a & b, 400)
    have = Counter(t for x in texts for t in x)
    every = toxicity.chosen_terms(labels, texts, toxicity.Terms(least_texts=3, most=toxicity.BUCKETS, alone=0.0, together=0.0, pairs=400))
    assert set(every) <= {t for t, n in have.items() if n >= 3} and len(every) > 250
    assert len(toxicity.chosen_terms(labels, texts, toxicity.Terms(most=1))) == 1


def pair_task(label, n=4000, seed=0):
    """Texts of two terms, 1 and 2, that are there or not, and noise; the label depends on the two."""
    r = np.random.default_rng(seed)
    a, b, noise = r.integers(0, 2, n), r.integers(0, 2, n), r.integers(10, 300, (n, 12))
    return label(a, b).astype(int), [np.unique([*([1] if x else []), *([2] if y else []), *z]) for x, y, z in zip(a, b, noise, strict=True)]


@pytest.mark.parametrize("label", [lambda a, b: a & b, lambda a, b: a ^ b, lambda a, b: 1 - (a ^ b)], ids=["and", "xor", "same"])
def test_pairs_matter(label):
    """Labels that only the company of two terms gives; for the last two neither term says anything alone."""
    labels, texts = pair_task(label)
    machine = toxicity.train(labels[:3000], texts[:3000])
    assert set(machine.slots) >= {1, 2}
    slot_of = {int(s): i for i, s in enumerate(machine.slots)}
    rows = [np.array(sorted(slot_of[t] for t in x if t in slot_of), np.int64) for x in texts[3000:]]
    whole = machine.logits(rows)
    linear = np.array([machine.bias + machine.linear[r].sum() for r in rows])
    of = lambda scores: area([(x, None, y) for x, y in zip(scores, labels[3000:], strict=True)])
    assert of(whole) > 0.99
    assert label(0, 0) == label(1, 0) or of(linear) < 0.6


def test_interactions():
    """Against counts of each pair by loops."""
    r = np.random.default_rng(3)
    labels, texts = r.integers(0, 2, 120), [np.flatnonzero(r.random(6) < 0.5) for _ in range(120)]
    best = []
    for i in range(6):
        found = [0.0]
        for j in range(6):
            cells = [[y for y, t in zip(labels, texts, strict=True) if (i in t) == a and (j in t) == b] for a, b in ((1, 1), (1, 0), (0, 1), (0, 0))]
            if min(map(len, cells)) >= toxicity.LEAST_TEXTS:
                p = [(sum(c) + 0.5) / (len(c) + 1) for c in cells]
                found.append(abs(p[0] - p[1] - p[2] + p[3]) / sum(x * (1 - x) / (len(c) + 1) for x, c in zip(p, cells, strict=True)) ** 0.5)
        best.append(max(found))
    assert toxicity.interactions(labels, texts, np.arange(6)) == pytest.approx(best, rel=1e-4)


def plain_logit(bias, linear, v, terms):
    pairs = sum(v[i][k] * v[j][k] for a, i in enumerate(terms) for j in terms[:a] for k in range(len(v[i])))
    return bias + sum(linear[i] for i in terms) + pairs


def plain_machine(labels, rows, k, factors, epochs, seed, rate=0.1, decay=1e-4, most_dropped=0.8):
    """The same draws, one text and one pair of terms after another."""
    random, n, positives = np.random.default_rng(seed), len(labels), sum(labels)
    bias, linear, v = 0.0, [0.0] * k, random.normal(0, 0.01, (k, factors)).tolist()
    seen_bias, seen_linear, seen_v = 1e-6, [1e-6] * k, [[1e-6] * factors for _ in range(k)]
    for epoch in range(epochs):
        drop, order = most_dropped * (1 - epoch / (epochs - 1)), random.permutation(n)
        for at in range(0, n, 64):
            batch = order[at : at + 64]
            held = [[int(t) for t in rows[i][random.random(len(rows[i])) >= drop]] for i in batch]
            g_bias, g_linear, g_v, touched = 0.0, [0.0] * k, [[0.0] * factors for _ in range(k)], {t for h in held for t in h}
            for i, terms in zip(batch, held, strict=True):
                balance = n / (2 * positives) if labels[i] else n / (2 * (n - positives))
                slope = balance * (1 / (1 + np.exp(-plain_logit(bias, linear, v, terms))) - labels[i]) / len(batch)
                g_bias += slope
                for t in terms:
                    g_linear[t] += slope
                    for f in range(factors):
                        g_v[t][f] += slope * sum(v[j][f] for j in terms if j != t)
            for t in touched:
                g = g_linear[t] + decay * linear[t]
                seen_linear[t] += g * g
                linear[t] -= rate * g / seen_linear[t] ** 0.5
                for f in range(factors):
                    g = g_v[t][f] + decay * v[t][f]
                    seen_v[t][f] += g * g
                    v[t][f] -= 0.3 * rate * g / seen_v[t][f] ** 0.5
            seen_bias += g_bias**2
            bias -= rate * g_bias / seen_bias**0.5
    return bias, linear, v


def test_training_by_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "chosen_terms", lambda labels, texts, which: np.arange(1, 7))
    r = np.random.default_rng(5)
    texts = [1 + np.flatnonzero(r.random(7) < 0.5) for _ in range(150)]  # the seventh term isn't chosen
    labels = np.array([int((1 in t) != (2 in t)) for t in texts])
    machine = toxicity.train(labels, texts, factors=3, epochs=4, seed=2)
    bias, linear, v = plain_machine(labels, [t[t < 7] - 1 for t in texts], 6, 3, 4, 2)
    assert machine.bias == pytest.approx(bias) and machine.linear == pytest.approx(linear)
    assert machine.factors == pytest.approx(np.array(v))
    rows = [np.array(x, np.int64) for x in ([], [3], [0, 1], [0, 2, 5], range(6))]
    assert machine.logits(rows) == pytest.approx([plain_logit(bias, linear, v, list(x)) for x in rows])


def test_toxicity_scores_by_loops(spark):
    """The query's scores, from the whole texts, term by term and pair by pair."""
    tables = [queries.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels")]
    machine = toxicity.fit(tables[0], tables[1].where(queries.remainder(3) != 1))
    got = {r["doc_id"]: r["score"] for r in queries.op2_toxicity(spark, "/root/testdata/sf0.001").collect()}
    slot_of, v = {int(s): i for i, s in enumerate(machine.slots)}, machine.factors.tolist()
    for doc, text in [(r["doc_id"], r["text"]) for r in tables[0].collect()][:60]:
        buckets = {b for w in re.findall(r"[^\W\d_]+", text.lower()) for b in (zlib.crc32(b"w" + w.encode()) % toxicity.BUCKETS, zlib.crc32(b"p" + w[:4].encode()) % toxicity.BUCKETS)}
        logit = plain_logit(machine.bias, machine.linear, v, [slot_of[b] for b in buckets if b in slot_of])
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def plain_quality(ranking, text):
    f = quality_model.features(text or "")
    raw = sum(k * (v - m) / d for k, v, m, d in zip(ranking.weights, [*f, *[v**0.5 for v in f]], ranking.mean, ranking.deviation, strict=True))
    return 1 / (1 + np.exp(-np.clip(np.log(ranking.at / (1 - ranking.at)) + (raw - ranking.cut) / ranking.spread, -30, 30)))


def test_ranking_by_loops(spark):
    """Weights, cut and scores of the quality ranking, pair by pair."""
    r = np.random.default_rng(8)
    labels = r.integers(0, 2, 90)
    rows = np.clip(r.random((90, len(quality_model.FEATURES))) + 0.2 * labels[:, None], 0, 1)
    found = quality_model.train(labels, rows, pairs=360, epochs=3)
    x = [[*row, *[f**0.5 for f in row]] for row in rows.tolist()]
    mean = [sum(c) / 90 for c in zip(*x, strict=True)]
    deviation = [(sum((f - m) ** 2 for f in c) / 90) ** 0.5 + 1e-9 for c, m in zip(zip(*x, strict=True), mean, strict=True)]
    z = [[(f - m) / d for f, m, d in zip(row, mean, deviation, strict=True)] for row in x]
    random, pairs = np.random.default_rng(11), 360
    winners, losers = random.choice(np.flatnonzero(labels == 1), pairs), random.choice(np.flatnonzero(labels == 0), pairs)
    w, seen = [0.0] * len(mean), [1e-6] * len(mean)
    for _ in range(3):
        order = random.permutation(pairs)
        for at in range(0, pairs, 256):
            slope = [1e-4 * k for k in w]
            for i in order[at : at + 256]:
                d = [a - b for a, b in zip(z[winners[i]], z[losers[i]], strict=True)]
                lose = 1 / (1 + np.exp(sum(a * b for a, b in zip(w, d, strict=True))))
                slope = [g - lose * k / len(order[at : at + 256]) for g, k in zip(slope, d, strict=True)]
            seen = [a + g * g for a, g in zip(seen, slope, strict=True)]
            w = [a - 0.3 * g / b**0.5 for a, g, b in zip(w, slope, seen, strict=True)]
    assert found.weights == pytest.approx(w)
    raw = np.array([sum(a * b for a, b in zip(w, row, strict=True)) for row in z])
    share = float((labels == 0).mean())
    cut = (np.quantile(raw, 0.98 * share) + np.quantile(raw, share + 0.02 * (1 - share))) / 2
    spread = (np.median(raw[labels == 1]) - cut) / 4
    assert found.cut == pytest.approx(cut)
    assert found.scores(rows) == pytest.approx(1 / (1 + np.exp(-(np.log(0.3 / 0.7) + (raw - cut) / spread))))
    # the query's scores are those of its ranking, one whole text after another
    docs, marks = (queries.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    ranking = quality_model.fit(docs, marks.where(queries.remainder(5) != 0))
    got = {x["doc_id"]: x["score"] for x in queries.op9_quality_model(spark, "/root/testdata/sf0.001").collect()}
    for x in docs.collect():
        assert got[x["doc_id"]] == pytest.approx(plain_quality(ranking, x["text"]))


def test_quality_learns_from_every_row(spark):
    """Shards of 40 rows: one of them equals train(), several take part each, scaling and cut are those of all rows."""
    docs, marks = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = sorted((r["doc_id"], r["quality"]) for r in marks.collect() if r["doc_id"] in text and r["quality"] is not None)
    rows, labels = np.array([quality_model.features(text[d] or "") for d, _ in known]), np.array([y for _, y in known])
    one, plain = quality_model.fit(docs, marks), quality_model.train(labels, rows)
    for part in ("weights", "mean", "deviation", "cut", "spread"):
        assert getattr(one, part) == pytest.approx(getattr(plain, part), rel=1e-6, abs=1e-6)
    many = quality_model.fit(docs, marks, shard_rows=40)
    assert many.mean == pytest.approx(one.mean) and many.deviation == pytest.approx(one.deviation)
    raw, share = many.raw(rows), (labels == 0).mean()
    assert many.cut == pytest.approx(np.quantile(raw, [0.98 * share, share + 0.02 * (1 - share)]).mean())
    assert many.spread == pytest.approx((np.median(raw[labels == 1]) - many.cut) / 4)
    assert area([(s, None, y) for s, y in zip(many.scores(rows), labels, strict=True)]) > 0.95


def test_shards(spark):
    """Every row is in a shard, repeated ones as often as they are there; the rare label is in all shards."""
    rows = [(n % 1000 if n < 4000 else 7, int(n in (5, 6, 8))) for n in range(6000)]
    found = common.dealt(spark.createDataFrame(rows, "doc_id long, label int"), {0: 5997, 1: 3}, 600).collect()
    assert Counter((r["doc_id"], r["label"]) for r in found if not r["label"]) == Counter(x for x in rows if not x[1])
    assert Counter((r["doc_id"], r["shard"]) for r in found if r["label"]) == Counter((d, s) for d in (5, 6, 8) for s in range(10))
    assert max(Counter(r["shard"] for r in found).values()) < 800


def test_quantiles(spark):
    r = np.random.default_rng(4)
    values = np.concatenate([r.normal(size=3000), np.full(500, 0.25), r.normal(size=300) * 1e-9, [1e6]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    shares = [0.0, 0.123, 0.5, 0.55, 0.98, 1.0]
    assert common.quantiles(df, "x", len(values), shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_cases(spark, docs, messy, no_docs, kind):
    module = toxicity if kind == "toxicity" else quality_model
    label = "toxic" if kind == "toxicity" else "quality"
    labels = spark.createDataFrame([(i, i % 2) for i, _ in messy if i] + [(4, 1), (None, 1), (6, None), (999, 1)], f"doc_id long, {label} int")
    model = module.fit(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == len(messy)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert scores[4] == scores[5]
    assert module.score(no_docs, model).count() == 0
    untaught = module.fit(no_docs, labels)
    assert {r["score"] for r in module.score(docs, untaught).collect()} == {0.5}


def test_keep_has_all_columns(spark, docs):
    model = quality_model.train(np.array([0, 1] * 20), np.random.default_rng(1).random((40, len(quality_model.FEATURES))))
    assert quality_model.keep(docs, model, 0.0).schema == docs.schema
    assert quality_model.keep(docs, model, 0.0).count() == docs.count()
    kept = quality_model.keep(docs, model, 0.5).select(F.monotonically_increasing_id()).count()
    assert kept == quality_model.score(docs, model).where("score >= 0.5").count()
