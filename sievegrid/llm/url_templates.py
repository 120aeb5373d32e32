"""URL filter: rules for hosts and paths first, then a tree of path templates per host.

DataFrame operations only. From the root down, a branch whose next segments are mostly different from page to page is variable:
they become a wildcard, but for those that many pages have or whose labels differ from the others'. In other branches segments
stay. What all pages of a branch share is passed in one step, so rounds are as many as divisions on a path. Templates
learn from labelled pages: sibling branches with labels enough that don't differ significantly are judged together, by the share
of bad pages among their labelled ones, smoothed towards that of all pages. A template with few labels is judged by those of
its parent branch, or else of its host, unless that it has none says that it is of another kind.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.common import hot_keys, small_side, spread_join, stored

#: A segment is kept only if this share of its branch has it: at most 1 / share children a branch.
LEAST_SHARE = 0.02
#: A branch is variable if it has more different segments than this share of its pages.
VARIABLE = 0.5
#: In a variable branch a segment is kept if so many pages have it, or if its labels differ from the others'.
LEAST_PAGES = 20
#: Branches of fewer pages have no segments of their own.
LEAST_BRANCH = 3
#: Levels that the query's SQL writes out; the tree itself is as deep as the paths.
LEVELS = 6
#: Pages that the prior counts for; purity from which a template is rejected; z-score up to which labels don't differ.
PRIOR_PAGES, REJECT_AT, SIMILAR = 10.0, 0.8, 1.96
#: Siblings are merged, and a branch lends its labels to templates below, only with so many labelled pages.
LEAST_LABELS = 5
#: A branch without labels is of another kind than the labelled ones beside it if that would be rarer by chance.
BY_CHANCE = 0.2
MOST_RULES = 1000

Rule = tuple[str, str, str]


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path: after the first ://, up to / ? # and from there up to ? #; both empty without ://, or null."""
    part = lambda n: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def ruled(rules: list[Rule], host: str = "host", path: str = "path") -> Column:
    """struct(rule, verdict) of the longest of the rules (host, start of path, verdict) that fits, null if none does.

    A rule fits its host and all subdomains. The rules are part of the plan: at most MOST_RULES.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = lambda h, p: ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest], F.lit(None).cast("struct<rule:string,verdict:string>"))


def _differ(bad: Column, labelled: Column, other_bad: Column, other_labelled: Column) -> tuple[Column, Column]:
    """Difference of two shares of bad pages, and its standard error; a mean page is added to either."""
    mean = (bad + other_bad + 1) / (labelled + other_labelled + 2)
    error = F.sqrt(mean * (1 - mean) * (1 / (labelled + 1) + 1 / (other_labelled + 1)))
    return (bad + mean) / (labelled + 1) - (other_bad + mean) / (other_labelled + 1), error


def kept_segments(counts: DataFrame) -> DataFrame:
    """host, template, segment of the segments that stay as they are. counts: these with n pages, labelled and bad ones."""
    branch = counts.groupBy("host", "template").agg(F.sum("n").alias("of"), F.count("*").alias("kinds"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    both = counts.join(small_side(branch), ["host", "template"])
    c = F.col
    difference, error = _differ(c("bad"), c("labelled"), c("all_bad") - c("bad"), c("all_labelled") - c("labelled"))
    kind = (c("kinds") <= VARIABLE * c("of")) | (c("n") >= LEAST_PAGES) | (F.abs(difference) > SIMILAR * error)
    return both.where((c("of") >= LEAST_BRANCH) & (c("n") >= LEAST_SHARE * c("of")) & kind).select("host", "template", "segment")


def _passed(tree: DataFrame) -> DataFrame:
    """tree with what all paths of a branch share put into their template, and those of branches with few pages ended by wildcards.

    The shared start of a set of lists is that of its least and its greatest one.
    """
    branch = tree.groupBy("host", "template").agg(F.sum("pages").alias("of"), F.min("rest").alias("least"), F.max("rest").alias("most"))
    differs = F.array_position(F.zip_with("least", "most", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    shared = F.when(differs > 0, differs - 1).otherwise(F.size("least")).cast("int")
    branch = stored(branch.select("host", "template", (F.col("of") >= LEAST_BRANCH).alias("is_large"), shared.alias("shared")), "branches")
    path = lambda x: F.when(F.size(x) > 0, F.concat(F.lit("/"), F.array_join(x, "/"))).otherwise(F.lit(""))
    joined = tree.join(small_side(branch), ["host", "template"])
    more = F.when(F.col("is_large"), path(F.slice("rest", F.lit(1), F.col("shared")))).otherwise(F.repeat(F.lit("/*"), F.size("rest")))
    rest = F.when(F.col("is_large"), F.slice("rest", F.col("shared") + 1, F.size("rest"))).otherwise(F.slice("rest", 1, 0))
    return joined.withColumns({"template": F.concat("template", more), "rest": rest}).drop("is_large", "shared")


def with_templates(paths: DataFrame) -> DataFrame:
    """paths (host, path, pages, labelled, bad) with template: host-wise, a segment as it is or *.

    Each round passes what the paths of a branch share, then divides it by the next segment; paths below a branch of fewer than
    LEAST_BRANCH pages end with wildcards at once. Paths that have ended stay in the table of their round. Counts are
    pre-aggregated by (host, template so far, segment), so a host with a third of all pages is spread.
    """
    tree = paths.withColumn("rest", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("template", F.lit(""))
    ended = []
    while True:
        here = stored(_passed(tree), "templates")
        counts = here.where(F.size("rest") > 0).groupBy("host", "template", F.col("rest")[0].alias("segment")).agg(F.sum("pages").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        kept = stored(kept_segments(stored(counts, "segment-counts")).withColumn("is_kept", F.lit(True)), "kept-segments")
        joined = here.withColumn("segment", F.get("rest", F.lit(0))).join(small_side(kept), ["host", "template", "segment"], "left")
        name = F.when(F.col("segment").isNull(), F.lit("")).when(F.col("is_kept"), F.concat(F.lit("/"), "segment")).otherwise(F.lit("/*"))
        divided = joined.withColumn("template", F.concat("template", name)).withColumn("rest", F.slice("rest", 2, 1 << 30)).drop("segment", "is_kept")
        after = stored(divided, "templates")
        ended.append(after.where(F.size("rest") == 0).drop("rest"))
        tree = after.where(F.size("rest") > 0)
        if tree.isEmpty():
            every = ended[0]
            for more in ended[1:]:
                every = every.unionByName(more)
            return every


def _prior(templates: DataFrame) -> float:
    total = templates.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    return ((total["b"] or 0) + 1) / ((total["l"] or 0) + 2)


def _smooth(bad: Column, labelled: Column, towards: Column) -> Column:
    return (bad + PRIOR_PAGES * towards) / (labelled + PRIOR_PAGES)


def judged_templates(templates: DataFrame) -> DataFrame:
    """templates (host, template, labelled, bad) with purity and rejected.

    Siblings are the templates of a host under one parent; in order of their own smoothed purity, neighbours stay
    together until two differ by more than SIMILAR standard errors. Templates with fewer than LEAST_LABELS labels stay
    alone, and those with none aren't rejected here, whatever the share of all pages; see backed_off().
    """
    prior = F.lit(_prior(templates))
    smooth = lambda bad, labelled: _smooth(F.col(bad), F.col(labelled), prior)
    branch = ["host", "parent", "has_labels"]
    siblings = templates.withColumn("parent", F.regexp_replace("template", "/[^/]*$", "")).withColumn("has_labels", F.col("labelled") >= LEAST_LABELS).withColumn("own", smooth("bad", "labelled"))
    order = Window.partitionBy(*branch).orderBy("own", "template")
    last = siblings.withColumn("b0", F.lag("bad").over(order)).withColumn("l0", F.lag("labelled").over(order))
    difference, error = _differ(F.col("bad"), F.col("labelled"), F.col("b0"), F.col("l0"))
    breaks = F.when(F.col("l0").isNull() | ~F.col("has_labels") | (difference > SIMILAR * error), 1).otherwise(0)
    merged = last.withColumn("group", breaks).withColumn("group", F.sum("group").over(order))
    together = Window.partitionBy(*branch, "group")
    pooled = merged.withColumn("bad", F.sum("bad").over(together)).withColumn("labelled", F.sum("labelled").over(together))
    return pooled.select("host", "template", smooth("bad", "labelled").alias("purity"), "labelled").withColumn("rejected", (F.col("labelled") > 0) & (F.col("purity") >= REJECT_AT)).drop("labelled")


def backed_off(judged: DataFrame, templates: DataFrame) -> DataFrame:
    """judged (of judged_templates()), where templates (host, template, pages, labelled, bad) with fewer than LEAST_LABELS
    labels are judged anew by the templates beside it.

    The branch of a template is what is left without wildcards at its end. Beside it are the branches of the same parent, or else the
    whole host, whichever has LEAST_LABELS labels; their purity takes the place of that of all pages. But the branch (beside
    a host: the first segment) is of another kind if it has no labels, though so many pages that this isn't chance at the
    rate at which pages beside it have labels; then nothing is lent.
    """
    prior = _prior(templates)
    named = templates.withColumn("branch", F.regexp_replace("template", r"(/\*)+$", "")).withColumn("first", F.regexp_extract("template", "^/[^/]*", 0))
    named = named.withColumn("parent", F.regexp_replace("branch", "/[^/]*$", ""))
    sums = lambda p: [F.sum(c).alias(f"{p}_{c}") for c in ("pages", "labelled", "bad")]
    few = named.where(F.col("labelled") < LEAST_LABELS)
    for p, keys in (("branch", ["host", "branch"]), ("parent", ["host", "parent"]), ("first", ["host", "first"]), ("host", ["host"])):
        few = few.join(small_side(stored(named.groupBy(*keys).agg(*sums(f"of_{p}")), "branch-labels")), keys)
    by_parent = F.col("of_parent_labelled") >= LEAST_LABELS
    of = lambda c: F.when(by_parent, F.col(f"of_parent_{c}")).otherwise(F.col(f"of_host_{c}"))
    part = lambda c: F.when(by_parent, F.col(f"of_branch_{c}")).otherwise(F.col(f"of_first_{c}"))
    alike = (part("labelled") > 0) | (F.pow(1 - of("labelled") / of("pages"), part("pages")) >= BY_CHANCE)
    purity = _smooth(F.col("bad"), F.col("labelled"), _smooth(of("bad"), of("labelled"), F.lit(prior)))
    lent = few.where((of("labelled") >= LEAST_LABELS) & alike).select("host", "template", purity.alias("lent"))
    found = judged.join(small_side(stored(lent, "lent-purity")), ["host", "template"], "left")
    return found.select("host", "template", F.coalesce("lent", "purity").alias("purity"), F.coalesce(F.col("lent") >= REJECT_AT, "rejected").alias("rejected"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    verdict: that of the longest rule that fits, else block if the template is rejected, else allow. Labels: where a rule
    fits, whether it blocks; elsewhere bad_col (0 or 1, null: none), if given. Null urls and urls without :// have an empty host
    and path, which no rule fits, and are judged by the labels of their like. Repeated rows and null ids are kept; an
    empty table gives no rows; other columns are not read.
    """
    host, path = split_url("url")
    label = F.col(bad_col).cast("int") if bad_col else F.lit(None).cast("int")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), label.alias("bad"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("by_rule", ruled(rules))
    rows = rows.withColumn("bad", F.when(F.col("by_rule").isNotNull(), (F.col("by_rule.verdict") == "block").cast("int")).otherwise(F.col("bad")))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = with_templates(stored(paths, "paths"))
    templates = stored(tree.groupBy("host", "template").agg(F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "template-counts")
    verdicts = tree.select("host", "path", "pages", "template").join(backed_off(judged_templates(templates), templates), ["host", "template"])
    paths = stored(verdicts, "path-verdicts")
    hot = hot_keys(paths, ["host", "path"], "pages", paths.agg(F.sum("pages")).first()[0] or 0)
    judged = spread_join(rows.drop("bad"), paths, ["host", "path"], "left", hot)
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
