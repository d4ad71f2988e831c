"""URL filters: explicit rules first, then a path-template tree of each host. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, saved, scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of segments, by the whole segment without its file extension; any other is a word.
KINDS = (
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "{date}"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{16,}$", "{hex}"),
)
WORD, EXTENSION = "{w}", r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$"


@dataclass(frozen=True)
class Rule:
    """``where`` is a host and the start of a path, as ``example.net/en/``; ``verdict`` is allow or block."""

    verdict: str
    where: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return self.where[len(self.host) :]


@dataclass(frozen=True)
class TreeOptions:
    """A segment with fewer than ``min_pages`` pages of its own below its node, or under ``min_share`` of the node's, is variable. Of
    the others a branch is merged with those of its kind if neither what stands below it (by chi square) nor its labelled rate
    (by the difference of two shares) departs from theirs by over ``similar_z`` standard deviations.
    ``prior_weight``: pages' worth of the host's own (in turn smoothed) rate in a template's purity; templates under
    ``min_purity`` are rejected. Segments from ``max_depth`` on enter a template by their kinds, without a test."""

    max_depth: int = 8
    min_pages: int = 2
    min_share: float = 0.02
    similar_z: float = 1.96
    prior_weight: float = 5.0
    min_purity: float = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Equally long rules go in alphabetical order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.where), r.where)):  # later ones go first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.where).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def kind(segment: Column) -> Column:
    """The kind of a segment, with its file extension in lower case; an empty segment is its own kind."""
    stem, extension = F.regexp_extract(segment, EXTENSION, 1), F.lower(F.regexp_extract(segment, EXTENSION, 2))
    name = F.lit(WORD)
    for pattern, value in reversed(KINDS):
        name = F.when(stem.rlike(pattern), value).otherwise(name)
    return F.when(segment == "", "").otherwise(F.concat(name, extension))


def _key(*columns: str) -> Column:
    """One string of several, which no others give."""
    return F.concat_ws("\n", *[x for c in columns for x in (F.octet_length(c).cast("string"), F.col(c))])


def templates(labelled: DataFrame, options: TreeOptions = TreeOptions()) -> DataFrame:
    """``(host, path, template, pages, labels, good, purity, rejected)`` from (host, path, label 1 good / 0 bad / null).

    Pages are first folded into one row a host and path with its counts; the tree is grown on these, one level at a time.
    A level's branches are told apart by their pages, by the kinds of what stands below each and by their labels, all sums with
    a partial sum before the shuffle; decisions return by ``lookup``, so that a host with a large share of all pages is spread.
    An empty table gives an empty one.
    """
    o = options
    base = labelled.groupBy("host", "path").agg(F.count("*").alias("pages"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).alias("good"))
    base = base.withColumn("seg", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("kinds", F.transform("seg", kind)).withColumn("prefix", F.lit(""))
    tree = saved(base, "tree")
    total = tree.count()
    for depth in range(o.max_depth):
        here = tree.withColumn("token", F.get("seg", F.lit(depth))).withColumn("kind", F.get("kinds", F.lit(depth)))
        here = here.withColumn("rest", F.array_join(F.expr(f"slice(kinds, {depth + 2}, size(kinds))"), "/"))
        here = here.withColumn("branch", F.when(F.col("token").isNotNull(), _key("host", "prefix", "token")))
        grown = here.where("token is not null").withColumn("node", _key("host", "prefix")).withColumn("group", _key("host", "prefix", "kind")).withColumn("place", _key("host", "prefix", "kind", "rest"))
        if grown.isEmpty():
            break
        sums = [F.sum(c).alias(c) for c in ("pages", "labels", "good")]
        rests = saved(grown.groupBy("node", "group", "place", "branch", "token", "kind").agg(*sums, F.count("*").alias("rows")), "rests")
        places = saved(rests.groupBy("node", "group", "place").agg(F.sum("pages").alias("place_pages"), F.sum("labels").alias("labels"), F.sum("good").alias("good"), F.count("*").alias("weight")), "places")
        groups = places.groupBy("group").agg(F.sum("place_pages").alias("group_pages"), F.count("*").alias("group_places"), F.sum("labels").alias("group_labels"), F.sum("good").alias("group_good"))
        nodes = places.groupBy("node").agg(F.sum("place_pages").alias("node_pages"))
        pooled = saved(places.select("node", "group", "place", "place_pages", "weight").join(groups, "group").join(nodes, "node").drop("node", "group"), "pooled")
        seen = lookup(rests, pooled, "place", "weight", "branch", rests.count())
        same = [F.max(c).alias(c) for c in ("group_pages", "group_places", "group_labels", "group_good", "node_pages")]
        each = seen.groupBy("branch", "token", "kind").agg(*sums, F.sum("rows").alias("rows"), F.sum(F.col("pages") * F.col("pages") / F.col("place_pages")).alias("squares"), *same)
        n, all_n = F.col("pages"), F.col("group_pages")
        square = (all_n / n * F.col("squares") - n) / F.greatest(1 - n / all_n, F.lit(1e-9))
        freedom = F.col("group_places") - 1
        built_alike = (n == all_n) | (square <= freedom + o.similar_z * F.sqrt(2 * freedom) + 1e-6)
        others, other_good = F.col("group_labels") - F.col("labels"), F.col("group_good") - F.col("good")
        rate = (F.col("group_good") + 1) / (F.col("group_labels") + 2)
        error = F.sqrt(rate * (1 - rate) * (1 / F.greatest("labels", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        apart = F.abs(F.col("good") / F.greatest("labels", F.lit(1)) - other_good / F.greatest(others, F.lit(1)))
        judged_alike = (F.col("labels") == 0) | (others == 0) | (apart <= o.similar_z * error)
        rare = (n < o.min_pages) | (n < o.min_share * F.col("node_pages"))
        named = F.when(rare | ((n < all_n) & built_alike & judged_alike), F.col("kind")).otherwise(F.col("token"))
        decided = saved(each.select("branch", named.alias("named"), "rows"), "decided")
        joined = lookup(here, decided, "branch", "rows", "path", total)
        step = F.when(F.col("token").isNotNull(), F.concat("prefix", F.lit("/"), F.col("named"))).otherwise(F.col("prefix"))
        tree = saved(joined.withColumn("prefix", step).select(tree.columns), "tree")
    tail = F.concat(F.lit("/"), F.array_join(F.expr(f"slice(kinds, {o.max_depth + 1}, size(kinds))"), "/"))
    tree = tree.withColumn("template", F.when(F.size("seg") > o.max_depth, F.concat("prefix", tail)).otherwise(F.col("prefix"))).withColumn("leaf", _key("host", "template"))
    leaf = saved(tree.groupBy("leaf", "host").agg(*[F.sum(c).alias(c) for c in ("pages", "labels", "good")], F.count("*").alias("rows")), "leaf")
    totals = leaf.groupBy("host").agg(F.sum("labels").alias("host_labels"), F.sum("good").alias("host_good"), F.count("*").alias("leaves"))
    totals = saved(totals, "hosts")
    every = totals.agg(F.sum("host_labels").alias("n"), F.sum("host_good").alias("good"), F.sum("leaves").alias("leaves")).first()
    rate = ((every.good or 0) + 1) / ((every.n or 0) + 2)
    judged = lookup(leaf, totals, "host", "leaves", "leaf", every.leaves or 0)
    host_rate = (F.col("host_good") + o.prior_weight * rate) / (F.col("host_labels") + o.prior_weight)
    judged = judged.withColumn("purity", (F.col("good") + o.prior_weight * host_rate) / (F.col("labels") + o.prior_weight))
    judged = saved(judged.select("leaf", "rows", "purity", (F.col("purity") < o.min_purity).alias("rejected")), "judged")
    return lookup(tree, judged, "leaf", "rows", "path", total).select("host", "path", "template", "pages", "labels", "good", "purity", "rejected")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], options: TreeOptions = TreeOptions(), id_col: str = "page_id", url_col: str = "url", label_key: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)``: a rule's verdict, else the template's.

    ``labels`` says of a page id whether it is good (> 0); pages without a label only count as pages. A null url, and one without
    ``://``, has empty host and path and is judged as the template of those. Repeated ids in
    ``labels`` count once, by their smallest label; repeated pages are all returned; other columns are ignored.
    """
    with scratch() as keep:
        host, path = split_url(F.col(url_col))
        split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
        known = labels.where(F.col(label_key).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_key).alias("page_id")).agg((F.min(label_col) > 0).cast("int").alias("label"))
        found = templates(split.join(known, "page_id", "left").select("host", "path", "label"), options)
        found = keep(saved(found.select(_key("host", "path").alias("place"), "pages", "template", "purity", "rejected"), "templates"))
        rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
        placed = lookup(split.withColumn("place", _key("host", "path")), found, "place", "pages", "page_id", found.agg(F.sum("pages")).first()[0] or 0)
        return placed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
