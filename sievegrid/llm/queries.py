"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm import bytebpe, divergence, fingerprints, neardup, packing, prefix_trie, quality_model, quality_rules, suffix_dedup, token_counts, token_store, toxicity, url_templates
from sievegrid.llm.common import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def remainder(n: int):
    """crc32 of the id as text, modulo n: which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranking = quality_model.fit(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    scored = quality_model.score(docs, ranking)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), neardup.Settings(words=3, percent=85, bands=24))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.token_digests(token_store.read_tokens(spark, path))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty, so that the figures are those of a first run."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), work_folder(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumn("purity", F.round("purity", 6))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    turns, conversations = prefix_trie.grafted(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)
    return prefix_trie.build(turns, conversations)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_minmax_neardup, op4_token_store, op5_token_counts, op6_byte_bpe, op7_quality_rules, op8_fingerprints, op9_quality_model, op10_url_templates, op11_prefix_trie, op12_suffix_dedup, op13_source_divergence)}

_WORDS = r"regexp_extract_all(x, '[^\x20\x09-\x0D]+')"

OP7_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS x, row_number() OVER () AS r FROM documents),
w AS (SELECT *, {_WORDS} AS words, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
run AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS five FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
again AS (SELECT r, five FROM run GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM run JOIN again USING (r, five), range(5) AS o(k) GROUP BY r),
line AS (SELECT r, host, x, trim(regexp_replace(lower(unnest(lines)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l FROM w),
host AS (SELECT host, count(DISTINCT x) AS documents FROM d GROUP BY host),
often AS (SELECT host, l FROM line JOIN host USING (host) GROUP BY host, l, documents HAVING count(DISTINCT x) >= {quality_rules.LEAST_DOCUMENTS} AND count(DISTINCT x) > {quality_rules.HOST_SHARE} * documents),
removed AS (SELECT r, sum(len(string_split(l, ' '))) AS n FROM line JOIN often USING (host, l) GROUP BY r),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, (len(words) - coalesce(removed.n, 0))::BIGINT AS n_words_left
    FROM w LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words_left >= {quality_rules.WORDS_LEFT} * n_words AS kept FROM f"""


def _op10_sql() -> str:
    u = url_templates
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {k(h, p, v)}" for h, p, v in ordered) + " END"
    part = lambda n: f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {n}), '')"
    levels = ""
    for i in range(1, u.LEVELS + 1):
        levels += f"""
c{i} AS (SELECT host, template, seg[{i}] AS s, sum(pages) AS n, sum(labelled) AS l, sum(bad) AS b FROM t{i - 1} WHERE len(seg) >= {i} GROUP BY ALL),
o{i} AS (SELECT *, sum(n) OVER w AS o, count(*) OVER w AS kinds, sum(l) OVER w - l AS l0, sum(b) OVER w - b AS b0 FROM c{i} WINDOW w AS (PARTITION BY host, template)),
m{i} AS (SELECT *, (b + b0 + 1)::DOUBLE / (l + l0 + 2) AS mean FROM o{i}),
k{i} AS (SELECT host, template, s FROM m{i} WHERE o >= {u.LEAST_BRANCH} AND n >= {u.LEAST_SHARE} * o AND (kinds <= {u.VARIABLE} * o OR n >= {u.LEAST_PAGES}
    OR abs((b + mean) / (l + 1) - (b0 + mean) / (l0 + 1)) > {u.SIMILAR} * sqrt(mean * (1 - mean) * (1.0::DOUBLE / (l + 1) + 1.0::DOUBLE / (l0 + 1))))),
t{i} AS (SELECT t.* REPLACE (t.template || CASE WHEN len(seg) < {i} THEN '' WHEN k.s IS NOT NULL THEN '/' || seg[{i}] ELSE '/*' END AS template) FROM t{i - 1} t LEFT JOIN k{i} k ON k.host = t.host AND k.template = t.template AND k.s = t.seg[{i}]),"""
    smooth = lambda b, n, prior="prior": f"({b} + {u.PRIOR_PAGES} * {prior}) / ({n} + {u.PRIOR_PAGES})"
    of = lambda c: f"CASE WHEN pl >= {u.LEAST_LABELS} THEN p{c} ELSE h{c} END"
    branch = f"PARTITION BY host, parent, labelled >= {u.LEAST_LABELS}"
    return rf"""WITH a AS (SELECT page_id, translate({part(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {part(2)} AS path FROM pages),
r AS (SELECT *, {case(lambda h, p, v: f"'{h + p}'")} AS rule, {case(lambda h, p, v: f"'{v}'")} AS by_rule FROM a),
t0 AS (SELECT host, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, '' AS template, count(*) AS pages, count(by_rule) AS labelled, count(*) FILTER (WHERE by_rule = 'block') AS bad FROM r GROUP BY host, path),{levels}
tree AS (SELECT * REPLACE (template || CASE WHEN len(seg) > {u.LEVELS} THEN '/**' ELSE '' END AS template) FROM t{u.LEVELS}),
m AS (SELECT host, template, sum(pages) AS pages, sum(labelled) AS labelled, sum(bad) AS bad FROM tree GROUP BY ALL),
g AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(labelled) + 2) AS prior FROM m),
s AS (SELECT *, regexp_replace(template, '/[^/]*$', '') AS parent, regexp_extract(template, '^/[^/]*') AS first, {smooth('bad', 'labelled')} AS own FROM m, g),
a0 AS (SELECT *, regexp_replace(template, '(/\*)+$', '') AS branch FROM s),
a1 AS (SELECT *, sum(pages) OVER b AS bn, sum(labelled) OVER b AS bl, sum(pages) OVER p AS pn, sum(labelled) OVER p AS pl, sum(bad) OVER p AS pb, sum(pages) OVER h AS hn, sum(labelled) OVER h AS hl, sum(bad) OVER h AS hb, sum(pages) OVER f AS fn, sum(labelled) OVER f AS fl
    FROM a0 WINDOW b AS (PARTITION BY host, branch), p AS (PARTITION BY host, regexp_replace(branch, '/[^/]*$', '')), h AS (PARTITION BY host), f AS (PARTITION BY host, first)),
a2 AS (SELECT *, {of('n')} AS an, {of('l')} AS al, {of('b')} AS ab, CASE WHEN pl >= {u.LEAST_LABELS} THEN bn ELSE fn END AS n, CASE WHEN pl >= {u.LEAST_LABELS} THEN bl ELSE fl END AS l FROM a1 WHERE labelled < {u.LEAST_LABELS}),
lent AS (SELECT host, template, {smooth('bad', 'labelled', '(' + smooth('ab', 'al') + ')')} AS lent FROM a2 WHERE al >= {u.LEAST_LABELS} AND (l > 0 OR pow(1 - al::DOUBLE / an, n) >= {u.BY_CHANCE})),
z AS (SELECT *, lag(bad) OVER w AS b0, lag(labelled) OVER w AS l0 FROM s WINDOW w AS ({branch} ORDER BY own, template)),
y AS (SELECT *, (bad + b0 + 1)::DOUBLE / (labelled + l0 + 2) AS mean FROM z),
x AS (SELECT *, CASE WHEN l0 IS NULL OR labelled < {u.LEAST_LABELS} OR (bad + mean) / (labelled + 1) - (b0 + mean) / (l0 + 1) > {u.SIMILAR} * sqrt(mean * (1 - mean) * (1.0::DOUBLE / (labelled + 1) + 1.0::DOUBLE / (l0 + 1))) THEN 1 ELSE 0 END AS brk FROM y),
v AS (SELECT *, sum(brk) OVER ({branch} ORDER BY own, template) AS grp FROM x),
q AS (SELECT host, template, prior, sum(bad) OVER w AS bad, sum(labelled) OVER w AS labelled FROM v WINDOW w AS ({branch}, grp)),
own AS (SELECT host, template, labelled, {smooth('bad', 'labelled')} AS purity FROM q),
j AS (SELECT host, template, coalesce(lent, purity) AS purity, coalesce(lent >= {u.REJECT_AT}, labelled > 0 AND purity >= {u.REJECT_AT}) AS rejected FROM own LEFT JOIN lent USING (host, template))
SELECT page_id, r.host, r.path, rule, coalesce(by_rule, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM r JOIN tree USING (host, path) JOIN j USING (host, template)"""


OP11_SQL = """WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 5 AS base, xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::UBIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM o)),
lent AS (SELECT k.c, h, count(b.i) AS n FROM k LEFT JOIN o b ON b.c = k.base AND b.i <= k.h GROUP BY ALL),
t AS (SELECT k.c, b.i AS d, b.role, b.text FROM k JOIN o b ON b.c = k.base AND b.i <= k.h UNION ALL SELECT o.c, o.i - h + n, role, text FROM o JOIN lent USING (c) WHERE o.i > h),
p AS (SELECT c, d, strlen(text) AS b, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS p FROM t),
e AS (SELECT c, 0 AS d, 0 AS b, '' AS p FROM k UNION ALL SELECT c, d, b, p FROM p),
last AS (SELECT c, max(d) AS d, max_by(p, d) AS p FROM e GROUP BY c),
ends AS (SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM last GROUP BY p),
n AS (SELECT p, d, min(c) AS c, count(*) AS n, max(b) AS b FROM e GROUP BY p, d),
kids AS (SELECT left(p, length(p) - 64) AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (p)),
s AS (SELECT a.p, count(*) FILTER (WHERE u.kids = 0) AS leaves, sum((u.n - 1) * u.b) AS saved FROM m a JOIN m u ON starts_with(u.p, a.p) GROUP BY a.p)
SELECT m.c AS conv_id, m.d::BIGINT AS depth, up.c AS parent_conv_id, m.n::BIGINT AS n_convs, m.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM m JOIN s USING (p) LEFT JOIN ends USING (p) LEFT JOIN n up ON m.d > 0 AND up.d = m.d - 1 AND up.p = left(m.p, length(m.p) - 64)"""

OP12_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT r, h, unnest(range(length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
again AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w SEMI JOIN again USING (s)),
run AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY ALL),
gap AS (SELECT r, h, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS last FROM span JOIN d USING (r)),
part AS (SELECT r, sum(b - a) AS removed, count(*) AS n, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gap GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN part USING (r)"""

OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(t.term) AS v, coalesce(sum(t.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM grp) LEFT JOIN t USING (lang) GROUP BY lang),
g AS (SELECT grp.lang, grp.source, v.v, coalesce(sum(c.n), 0)::HUGEINT + max(v.v) AS total FROM grp JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
x AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // g.total AS p FROM g JOIN t USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
q AS (SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.n + 1)) // (v.n + v.v) AS q FROM t JOIN v USING (lang)),
own AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM x JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM own))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""

ORACLES = {"op7_quality_rules": OP7_SQL, "op10_url_templates": _op10_sql(), "op11_prefix_trie": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
