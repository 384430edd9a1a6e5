"""URL filters: a rule list first, then association rules mined by FP-growth. SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import ascii_lower, written

#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Share of labelled urls that a combination and its label hold together, and urls at least; share of a combination's urls with the
#: label; and mined rules that fit into one expression, of eight times as many combinations: more are refused, not cut.
SUPPORT, LEAST_URLS, CONFIDENCE, MOST_RULES = 0.01, 5, 0.7, 2000
_BLOCK = "label=block"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """What combinations are made of: the scheme, each domain that the host lies in, path parts, the path's ending, query keys; digits as #."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split(path_of(url), "/"), lambda p: p != ""), lambda p: F.concat(F.lit("part="), F.regexp_replace(p, "[0-9]+", "#")))
    ending = F.transform(F.regexp_extract_all(path_of(url), F.lit(r"\.([A-Za-z0-9]+)$"), 1), lambda e: F.concat(F.lit("ending="), e))
    keys = F.transform(F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)="), 1), lambda k: F.concat(F.lit("key="), k))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "^([A-Za-z]*)://", 1)))
    return F.coalesce(F.array_distinct(F.concat(scheme, domains, parts, ending, keys)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST_URLS, confidence: float = CONFIDENCE, most: int = MOST_RULES) -> list[tuple[tuple[str, ...], float, float]]:
    """(tokens, confidence, lift) of the combinations in labelled (url, block) that say block often enough.

    A combination and its label must hold together in a share `support` of the urls, and in `least` different urls: repeated
    rows of a url with the same label count as one. A combination is dropped where a part of it is a rule already. Null urls and labels are not learned from; without any
    blocked url there are no rules.
    """
    rows = labelled.where("url is not null and block is not null").select("url", "block").distinct()
    items = written(rows.select(F.array_union(tokens_of(F.col("url")), F.when(F.col("block"), F.array(F.lit(_BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")), "url-items")
    n, blocked = items.agg(F.count("*"), F.count_if(F.array_contains("items", _BLOCK))).first()
    if blocked < least:
        return []
    # A little less than a whole number of urls, so that rounding asks for none more.
    model = FPGrowth(itemsCol="items", minSupport=max(support, (least - 0.5) / n), minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", _BLOCK)).select(F.array_sort("antecedent"), "confidence", "lift")
    found = rules.limit(most * 8 + 1).collect()
    if len(found) > most * 8:
        raise ValueError(f"more than {most * 8} combinations; raise the support or the confidence")
    kept: list[tuple[tuple[str, ...], float, float]] = []
    for tokens, c, lift in sorted(((tuple(r[0]), r[1], r[2]) for r in found), key=lambda r: (len(r[0]), r[0])):
        if lift > 1 and not any(set(k) <= set(tokens) for k, _, _ in kept):
            kept.append((tokens, c, lift))
    if len(kept) > most:
        raise ValueError(f"more than {most} rules; raise the support or the confidence")
    return kept


def matches(tokens: Column, rules: Sequence[tuple[tuple[str, ...], float, float]]) -> Column:
    """Whether any rule's tokens are all among tokens: an inverted index leads from a rule's rarest-used token to its rules."""
    if not rules:
        return F.lit(False)
    uses: dict[str, int] = {}
    for r in rules:
        for t in r[0]:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list[tuple[str, ...]]] = {}
    for r in rules:
        index.setdefault(min(r[0], key=lambda t: (uses[t], t)), []).append(r[0])
    posted = F.create_map(*[x for t, of in sorted(index.items()) for x in (F.lit(t), F.array(*[F.array(*map(F.lit, r)) for r in of]))])
    return F.exists(tokens, lambda t: F.exists(F.coalesce(F.try_element_at(posted, t), F.array().cast("array<array<string>>")), lambda r: F.forall(r, lambda x: F.array_contains(tokens, x))))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of rules equally long the first by code point."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(order):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, least: int = LEAST_URLS, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    The longest listed rule decides; where none fits, a url is blocked if it has all tokens of a rule mined from
    labelled (url, block), else allowed. A null url, or one without ://, has an empty host and path and no rule.
    Repeated rows each give a row; an empty table gives no rows, or no mined rules.
    """
    mined = mine(labelled, support, least, confidence)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens"))
    by = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("by", by)
    verdict = F.coalesce(F.col("by.verdict"), F.when(matches(F.col("tokens"), mined), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of pages (url) whose path names a document of labels (doc_id, quality, toxic) by its last number.

    The given pages carry no labels of their own; their paths end in the number of the document that they show, so that document's
    label is taken for the page's: block if any of its labels says quality 0 or toxic 1. Null labels say nothing. Pages without
    such a number, or whose document has no label, are not learned from.
    """
    number = F.regexp_extract(path_of(F.col("url")), "([0-9]+)[^0-9]*$", 1).try_cast("long")
    named = pages.select("url", number.alias("doc_id"))
    by = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return named.join(by, "doc_id").select("url", "block")
