"""Verdicts on URLs by host rules and a path-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfoundry.llm.common import load
from tsfoundry.session import configure, cut_lineage

NAME = "op7_url_filter"
ORACLE = None

#: (host, path, verdict) of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: A branch stands alone where its labels differ from its siblings' by so many standard errors, or where as rare a difference shows in an exact test: that of branches with fewer than EXACT_BELOW labels.
Z = 2.58
TAIL = 0.00494
EXACT_BELOW = 20
#: Weight of the prior in a template's purity, and the purity below which it is rejected.
SMOOTHING = 10.0
LEAST_PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://``; both empty for a null or a url without it."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host then path) that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The segments of a path with digit runs and long hexadecimal names masked."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f-]{12,}\b", "<hex>"), r"[0-9]+", "<n>"))


def _falling(top: Column, count: Column) -> Column:
    """top (top - 1) ... with ``count`` factors; 1 for none."""
    steps = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda product, j: product * (top - j))


def differs(labels: Column, good: Column, all_labels: Column, all_good: Column) -> Column:
    """Whether ``good`` of ``labels`` is unlikely for a draw from the node's labels without replacement.

    Under EXACT_BELOW labels by Fisher's exact test, at most EXACT_BELOW terms
    of at most as many factors; else by the normal law with the same variance.
    """
    n, k = labels.cast("int"), good.cast("int")
    terms = F.sequence(F.lit(0), n)
    chance = F.transform(terms, lambda i: F.factorial(n) / F.factorial(i) / F.factorial(n - i) * _falling(all_good, i) * _falling(all_labels - all_good, n - i) / _falling(all_labels, n))
    tail = lambda part: F.aggregate(part, F.lit(0.0), lambda total, c: total + c)
    exact = F.least(tail(F.slice(chance, F.lit(1), k + 1)), tail(F.slice(chance, k + 1, n + 1))) < TAIL
    share = all_good / F.greatest(all_labels, F.lit(1))
    spread = F.greatest(share * (1 - share), F.lit(1e-4)) * (all_labels - labels) / F.greatest(all_labels - 1, F.lit(1))
    normal = F.abs(good / F.greatest(labels, F.lit(1)) - share) > Z * F.sqrt(spread / F.greatest(labels, F.lit(1)))
    return F.when(labels == 0, F.lit(False)).when(labels < EXACT_BELOW, exact).otherwise(normal & (labels < all_labels))


def template_tree(shapes: DataFrame) -> DataFrame:
    """Templates of ``shapes(host, shape, n, labels, good)``, whose rows differ in host or shape.

    Level by level, each node of a host looks at its next segments. A branch
    stays if it is the only one or its share of good labels differs from its
    siblings', however many there are; the others become one wildcard. A shape
    alone in its node stays as it is to its end. Returns ``shapes`` with
    ``template``. Each level reads the last one's table, so the plan doesn't
    grow with the depth; the levels go on as long as shapes share a node.
    """
    tree, level = shapes.withColumn("node", F.lit("")).withColumn("open", F.size("shape") > 0), 1
    while tree.where("open").limit(1).count():
        tree = tree.withColumn("seg", F.when(F.col("open"), F.try_element_at("shape", F.lit(level))))
        branch = tree.where("open").groupBy("host", "node", "seg").agg(F.count(F.lit(1)).alias("shapes"), *[F.sum(c).alias(c) for c in ("labels", "good")])
        node = branch.groupBy("host", "node").agg(F.count(F.lit(1)).alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in ("shapes", "labels", "good")])
        seen = branch.join(node, ["host", "node"])
        stays = (F.col("kinds") == 1) | differs(F.col("labels"), F.col("good"), F.col("all_labels"), F.col("all_good"))
        stays = seen.where(stays).select("host", "node", "seg", (F.col("all_shapes") == 1).alias("single"))
        tree = tree.join(stays, ["host", "node", "seg"], "left")
        rest = F.array_join(F.slice("shape", level, F.greatest(F.size("shape"), F.lit(1))), "/")
        step = F.when(F.col("single"), rest).when(F.col("single").isNotNull(), F.col("seg")).otherwise("*")
        tree = tree.withColumn("node", F.when(F.col("open"), F.concat("node", F.lit("/"), step)).otherwise(F.col("node")))
        tree = tree.withColumn("open", F.col("open") & ~F.coalesce("single", F.lit(False)) & (F.size("shape") > level)).drop("seg", "single")
        tree, level = cut_lineage(tree), level + 1
    return tree.drop("open").withColumnRenamed("node", "template")


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: by the longest fitting rule, else by its path template.

    ``labels(id_col, good)`` marks some pages as good (true) or bad (false).
    Templates of a host are rejected when the share of good labels, smoothed
    with the share of the host and that with the share of all labels, is under
    LEAST_PURITY. Rules have a few rows and become expressions; long lists
    belong in a join.

    Returns ``id_col, host, path, rule, verdict, template, purity`` per row. A
    null url or one without ``://`` has an empty host and path and belongs to
    the template of that empty host. Ids may be null or repeat: a label counts
    for each row of its id. Ties between labels of one id go to bad. Without
    labels nothing is rejected. Other columns are ignored.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("shape", shape(F.col("path")))
    marks = labels.where(F.col(id_col).isNotNull() & F.col("good").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col("good").cast("int")).alias("good"))
    shapes = urls.join(marks, "id", "left").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("labels"), F.sum(F.coalesce("good", F.lit(0))).alias("good"))
    tree = template_tree(cut_lineage(shapes))

    total = tree.agg((F.sum("good") + 1).alias("a"), (F.sum("labels") + 1).alias("b")).select(F.coalesce(F.col("a") / F.col("b"), F.lit(1.0)).alias("all_share"))
    by_host = tree.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("labels").alias("hl"))
    by_host = by_host.crossJoin(F.broadcast(total)).select("host", ((F.col("hg") + SMOOTHING * F.col("all_share")) / (F.col("hl") + SMOOTHING)).alias("host_share"))  # one row
    templates = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("labels").alias("l"))
    templates = templates.join(by_host, "host").select("host", "template", ((F.col("g") + SMOOTHING * F.col("host_share")) / (F.col("l") + SMOOTHING)).alias("purity"))
    known = tree.select("host", "shape", "template").join(templates, ["host", "template"])

    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = urls.join(known, ["host", "shape"], "left")
    method = F.when(F.col("purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number stands in its path; that document's quality label is the page's."""
    spark = configure(spark)
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("page_id", F.try_to_number(F.nullif(F.regexp_extract(split_url(F.col("url"))[1], r"/([0-9]{1,18})(?:[./]|$)", 1), F.lit("")), F.lit("9" * 18)).cast("long").alias("doc_id"))
    marks = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    labels = shown.where("doc_id IS NOT NULL").join(marks, "doc_id").select("page_id", "good")
    return url_filter(pages, labels, RULES)
