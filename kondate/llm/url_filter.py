"""URL filters: listed rules, and a path-template tree per host that is judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, join_by_key

#: verdict, host, path
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; '' without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits a host or its subdomains and begins the path, else null.

    For lists of up to some hundred rules, which come as a parameter and are compiled into the plan.
    """
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1:]), reverse=True):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        said = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return nothing if out is None else out.otherwise(nothing)


_ENDING = r"(\.[A-Za-z][A-Za-z0-9]{0,4})$"


def lexical_template(path: Column, depth: int) -> Column:
    """The path's segments with those that are variable by their shape as wildcards.

    Numbers, dates, long hexadecimal and long mixed segments vary; a file ending stays. What follows `depth` segments
    counts as one segment, its slashes included.
    """
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    ending = lambda s: F.regexp_extract(s, _ENDING, 1)
    stem = lambda s: F.regexp_replace(s, _ENDING, "")
    varies = r"^(?:[0-9][0-9_.-]*|(?=.*[0-9])[0-9A-Fa-f-]{8,}|(?=.*[0-9])[A-Za-z0-9_%-]{16,})$"
    shaped = F.transform(segments, lambda s: F.when(stem(s).rlike(varies), F.concat(F.lit("*"), ending(s))).otherwise(s))
    rest = F.array(F.array_join(F.slice(shaped, depth + 1, F.greatest(F.lit(0), F.size(shaped) - depth)), "/"))
    return F.when(F.size(segments) > depth, F.concat(F.slice(shaped, 1, depth), rest)).otherwise(shaped)


def generalised(tree: DataFrame, scratch: Scratch, support: int, share: float) -> tuple[DataFrame, int]:
    """Branches (host, branch, n, labelled, good) with template, and the deepest level.

    From the root down: a node of fewer than `support` pages isn't split, its paths end in `**`. Of the others a
    segment stays literal if it has `support` pages and the `share` of its node, so a node has a bounded number of
    literal children; the rest become one wildcard.
    """
    tree = tree.select("*", F.array().cast("array<string>").alias("template"), (F.size("branch") > 0).alias("open"))
    level = 0
    while tree.where("open").limit(1).count():
        level += 1
        segment = F.try_element_at("branch", F.lit(level))
        here = tree.where("open").withColumn("segment", segment)
        child = here.groupBy("host", "template", "segment").agg(F.sum("n").alias("child_n"))
        node = child.groupBy("host", "template").agg(F.sum("child_n").alias("node_n"))
        small = node.where(F.col("node_n") < support).select("host", "template", F.lit(True).alias("small"))
        literal = child.join(node, ["host", "template"]).where((F.col("child_n") >= support) & (F.col("child_n") >= share * F.col("node_n"))).select("host", "template", "segment", F.lit(True).alias("literal"))
        said = here.join(small, ["host", "template"], "left").join(literal, ["host", "template", "segment"], "left")
        wildcard = F.concat(F.lit("*"), F.regexp_extract("segment", _ENDING, 1))
        step = F.when(F.col("small"), F.lit("**")).otherwise(F.when(F.col("literal"), F.col("segment")).otherwise(wildcard))
        goes_on = F.col("small").isNull() & (F.size("branch") > level)
        grown = said.select("host", "branch", "n", "labelled", "good", F.concat("template", F.array(step)).alias("template"), goes_on.alias("open"))
        tree = scratch.table(tree.where("not open").unionByName(grown), f"generalised-{level}")
    return tree.drop("open"), level


def merged(tree: DataFrame, scratch: Scratch, deepest: int, difference: float) -> DataFrame:
    """The branches with the templates that end in similar siblings put together, from the leaves up.

    The labelled siblings of a node are put in order of their good share. Neighbours whose shares don't differ by more
    than `difference` standard errors of their pooled share are in one run; a run is merged if it is homogeneous as a
    whole (chi-square, by its normal approximation, within `difference` deviations). Siblings without labels are
    merged among themselves. What is merged ends in `*` and, unless all siblings are, the number of the run.
    """
    for level in range(deepest, 0, -1):
        deep = F.size("template") == level
        parent = F.slice("template", 1, level - 1)
        child = tree.where(deep).groupBy("host", parent.alias("parent"), "template").agg(F.sum("labelled").alias("m"), F.sum("good").alias("g"))
        known = child.withColumn("p", F.try_divide("g", "m"))
        in_order = Window.partitionBy("host", "parent").orderBy(F.asc_nulls_last("p"), "template")
        m0, g0 = F.lag("m").over(in_order), F.lag("g").over(in_order)
        pooled = F.try_divide(F.col("g") + g0, F.col("m") + m0)
        apart = F.abs(F.col("p") - F.try_divide(g0, m0)) > difference * F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("m")) + F.try_divide(F.lit(1.0), m0)))
        new = (F.row_number().over(in_order) == 1) | F.coalesce(apart, F.lit(False)) | (F.col("p").isNull() & (m0 > 0))
        runs = known.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(in_order))
        sums = runs.groupBy("host", "parent", "run").agg(F.count("*").alias("k"), F.count("p").alias("l"), F.sum("m").alias("m"), F.sum("g").alias("g"), F.sum(F.try_divide(F.col("g") * F.col("g"), F.col("m"))).alias("gg"))
        mean = F.try_divide("g", "m")
        chi = F.try_divide(F.col("gg") - F.col("g") * mean, mean * (1 - mean))
        mixed = (F.col("l") > 1) & (chi > (F.col("l") - 1) + F.lit(difference) * F.sqrt(2 * (F.col("l") - 1)))
        whole = F.count("*").over(Window.partitionBy("host", "parent")) == 1
        alike = sums.withColumn("whole", whole).where((F.col("k") > 1) & ~F.coalesce(mixed, F.lit(False))).select("host", "parent", "run", F.when(F.col("whole"), "*").otherwise(F.concat(F.lit("*~"), F.col("run"))).alias("name"))
        names = runs.join(alike, ["host", "parent", "run"]).select("host", "template", F.concat("parent", F.array("name")).alias("together"))
        tree = tree.join(names, ["host", "template"], "left").select("host", "branch", "n", "labelled", "good", F.coalesce("together", "template").alias("template"))
        tree = scratch.table(tree, f"merged-{level}")
    return tree


def template_tree(rows: DataFrame, labels: DataFrame, support: int = 20, share: float = 0.001, strength: float = 2.0, difference: float = 1.96) -> DataFrame:
    """host, branch, template, labelled, purity, n: the final template of each lexical branch, with its smoothed purity.

    rows: page_id, host, branch (``lexical_template``). labels: page_id, good. All pages are counted, first by (host,
    branch), so a host that holds a third of all pages is a few rows from then on. Purity is the good share, drawn with
    `strength` pseudo-labels to the host's, and the host's likewise to the corpus'.
    """
    scratch = Scratch(rows.sparkSession, "url-tree")
    said = labels.groupBy("page_id").agg(F.min("good").alias("good"))
    counted = rows.join(said, "page_id", "left").groupBy("host", "branch").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    tree, deepest = generalised(scratch.table(counted, "branches"), scratch, support, share)
    tree = merged(tree, scratch, deepest, difference)
    whole = tree.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("m")).first()
    base = (whole["g"] + 1) / (whole["m"] + 2)
    hosts = tree.groupBy("host").agg(((F.sum("good") + F.lit(strength * base)) / (F.sum("labelled") + F.lit(strength))).alias("host_purity"))
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("good").alias("g")).join(hosts, "host")
    leaves = leaves.select("host", "template", F.col("m").alias("labelled"), ((F.col("g") + F.lit(strength) * F.col("host_purity")) / (F.col("m") + F.lit(strength))).alias("purity"))
    return scratch.table(tree.select("host", "branch", "template", "n").join(leaves, ["host", "template"]), "tree")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, least_purity: float = 0.5, depth: int = 64) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    pages: page_id, url. labels: doc_id (a page's identifier), quality, toxic; a page is good with quality 1 that
    isn't toxic, rows with a null among these label nothing, of several labels the worst counts. A rule decides if
    one fits; else the template's purity does, and a template without any evidence follows its host's and the
    corpus' share. Null urls and those without `://` have empty host and path, which are a branch of their own.
    Repeated page_ids are judged row by row; an empty table gives an empty result; other columns are not read.
    """
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = Scratch(pages.sparkSession, "url-parts").table(parts.withColumn("branch", lexical_template(F.col("path"), depth)), "parts")
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    known = labels.select(F.col("doc_id").cast("long").alias("page_id"), good.cast("int").alias("good")).where("good is not null and page_id is not null")
    tree = template_tree(parts.select("page_id", "host", "branch"), known)
    judged = join_by_key(parts, tree, ["host", "branch"], "n", "left").withColumn("_said", rule_of(F.col("host"), F.col("path"), rules))
    by_tree = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_said.rule").alias("rule"), F.coalesce("_said.verdict", by_tree).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
