"""URL filters by association rules.

Labels come from the given (host, path) rules where one fits, else from a list of words in hosts (`seeds`): block for a
url whose host has one of them, allow for all others. Spark's FP-growth mines which combinations of url tokens go with a
label; combinations with enough support and confidence become rules of the method. They are held as an inverted index by
their rarest token, and judge the urls that no given rule fits: the most confident rule wins, then the best supported,
the longest, and the last by name. Where none matches the verdict is `DEFAULT`.

Tokens of a url: host suffixes of one and two labels, the words of the label before them, the first label of a longer
host, path segments that aren't numbers, the ending, query keys, whether there is a fragment, and whether the path ends
in a slash. A rule may need any of them, and a url is judged by all. FP-growth counts every combination of a url's
frequent tokens, 2^n of them, so it mines tables whose urls have `MOST` such tokens at most. Where a url has more, all
combinations are counted level by level instead, and only those go on that can still begin a better rule. Both ways give
the same rules, as rules that a shorter one makes needless are pruned: one with a token less and no less confidence has no
less support either, so it comes first wherever the longer one matches. The index is broadcast in blocks.

Defined cases: a null url, or one without `://`, has an empty host and path and gets the default verdict; rows that
repeat (page_id, url) give one row; extra columns are ignored; without urls nothing is mined; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import ascii_lower, materialized
from lumenlake.llm.grams import blocks

SUPPORT = 0.002
CONFIDENCE = 0.6
DEFAULT = "allow"
#: Frequent tokens of one url up to which FP-growth counts all combinations.
MOST = 12
RULE = "tokens array<string>, verdict string, confidence double, support double"
#: Rules that are broadcast at once.
BLOCK = 60_000
# Words in hosts that label a url block.
SEEDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")
# Verdict, host and path of the given rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, lower-cased, and the path; both empty for a url without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_words(host: Column) -> Column:
    """The words of the label before the last two, or of the only label before the last."""
    labels = F.split(host, r"\.")
    return F.split(F.coalesce(F.get(labels, F.size(labels) - 3), F.get(labels, F.size(labels) - 2), F.lit("")), "-")


def tokens(url: Column, host: Column, path: Column) -> Column:
    labels = F.split(host, r"\.")
    some = lambda kind, found: F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    mark = lambda kind, c: some(kind, F.array(F.coalesce(c, F.lit(""))))
    segments = F.filter(F.split(path, "/"), lambda x: ~x.rlike(r"^[0-9]*(\.[A-Za-z0-9]*)?$"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.concat(
        mark("last", F.element_at(labels, -1)),
        mark("site", F.when(F.size(labels) > 1, F.substring_index(host, ".", -2))),
        some("word", host_words(host)),
        mark("first", F.when(F.size(labels) > 3, F.element_at(labels, 1))),
        some("segment", segments),
        mark("ending", F.regexp_extract(path, r"\.([A-Za-z][A-Za-z0-9]*)$", 1)),
        some("query", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        F.array_compact(F.array(F.when(url.contains("#"), F.lit("fragment")), F.when(path.endswith("/"), F.lit("folder")))),
    )


def parsed(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, url, host, path, given, tokens), once for each (page_id, url), dealt over all shuffle partitions."""
    host, path = host_and_path(F.col("url"))
    wide = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = pages.select("page_id", "url").repartition(wide, "page_id", "url").dropDuplicates(["page_id", "url"])
    parts = once.select("page_id", "url", host.alias("host"), path.alias("path"))
    return parts.select(
        "*",
        given_rule(F.col("host"), F.col("path"), rules).alias("given"),
        F.array_distinct(tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))).alias("tokens"),
    )


def labelled(urls: DataFrame, seeds: tuple = SEEDS) -> Column:
    """A parsed url's label: the given rule's verdict, else block or allow by the words of its host."""
    seeded = F.arrays_overlap(host_words(F.col("host")), F.lit(list(seeds)))
    return F.coalesce(F.col("given.verdict"), F.when(seeded, "block").otherwise("allow"))


def telling(baskets: DataFrame, support: float) -> DataFrame:
    """(token, n, strength) of the tokens of baskets(tokens, verdict) with that support: by how many standard errors a
    token's share of blocks differs from that of all. At most a basket's mean number of tokens over the support."""
    total, blocked = baskets.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    share = blocked / max(total, 1)
    counts = baskets.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    spread = F.sqrt(F.lit(max(share * (1 - share), 1e-12)) / F.col("n"))
    return counts.filter(F.col("n") >= support * total).select("token", "n", (F.abs(F.col("blocked") / F.col("n") - share) / spread).alias("strength"))


def mining_baskets(urls: DataFrame, known: DataFrame) -> DataFrame:
    """urls(page_id, url, tokens, verdict) with all of their tokens that `known` has."""
    each = urls.select("page_id", "url", "verdict", F.explode("tokens").alias("token")).join(known.select("token"), "token")
    return each.groupBy("page_id", "url", "verdict").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select("tokens", "verdict")


def _grown_rules(baskets: DataFrame, support: float, confidence: float) -> DataFrame:
    """(tokens, verdict, confidence, support) of the combinations of baskets(tokens, verdict), whole, by FP-growth."""
    items = baskets.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.filter(F.element_at("consequent", 1).startswith("=")).filter(
        ~F.exists("antecedent", lambda t: t.startswith("="))
    )
    return found.select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 2, 100).alias("verdict"), "confidence", "support"
    )


def _without(tokens: Column) -> Column:
    """A combination with each of its tokens left out in turn."""
    return F.transform(tokens, lambda t: F.array_remove(tokens, t))


def _levelled_rules(baskets: DataFrame, support: float, confidence: float) -> DataFrame:
    """What is left of `_grown_rules` once pruned, for baskets of any length, level by level.

    A combination goes on if a verdict has the support with it, none is certain, and every combination with a token less
    goes on too and is held by more baskets: else what follows it says no more than a shorter one."""
    total = baskets.count()
    least = math.ceil(support * total)
    rows = materialized(baskets.select(F.monotonically_increasing_id().alias("row"), "tokens", F.col("verdict") == "block"), "url-rows").toDF("row", "all", "block")
    before = baskets.sparkSession.createDataFrame([([], total)], "tokens array<string>, n long")
    held, levels = rows.select("row", "all", "block", F.array().cast("array<string>").alias("tokens")), []
    while True:
        more = held.select("row", "all", "block", "tokens", F.explode("all").alias("t")).filter(F.coalesce(F.col("t") > F.get("tokens", F.size("tokens") - 1), F.lit(True)))
        more = materialized(more.select("row", "all", "block", F.concat("tokens", F.array("t")).alias("tokens")), "url-combinations")
        counts = more.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("block").alias("blocked")).withColumn("top", F.greatest("blocked", F.col("n") - F.col("blocked")))
        shorter = counts.filter(F.col("top") >= least).select("*", F.explode(_without(F.col("tokens"))).alias("less"))
        b = before.select(F.col("tokens").alias("less"), F.col("n").alias("of"))
        useful = shorter.join(b, "less").groupBy("tokens", "n", "blocked", "top").agg(F.count("*").alias("k"), F.min("of").alias("of"))
        # A token is a rule even if all baskets hold it.
        useful = useful.filter(F.size("tokens") == F.col("k")).filter((F.col("n") < F.col("of")) | (F.size("tokens") == 1))
        useful = materialized(useful, "url-level")
        if useful.isEmpty():
            break
        levels.append(useful.select("tokens", "n", "blocked"))
        before = useful.filter((F.col("top") < F.col("n")) & (F.col("n") < F.col("of"))).select("tokens", "n")
        held = more.join(before.select("tokens"), "tokens", "left_semi")
    if not levels:
        return baskets.sparkSession.createDataFrame([], RULE)
    each = F.explode(F.array(F.struct(F.lit("block").alias("verdict"), F.col("blocked").alias("m")), F.struct(F.lit("allow").alias("verdict"), (F.col("n") - F.col("blocked")).alias("m"))))
    found = reduce(DataFrame.unionByName, levels).select("tokens", "n", each.alias("v"))
    found = found.select("tokens", "v.verdict", (F.col("v.m") / F.col("n")).alias("confidence"), (F.col("v.m") / F.lit(total)).alias("support"), F.col("v.m").alias("m"))
    return found.filter((F.col("m") >= least) & (F.col("confidence") >= confidence)).drop("m")


def pruned(rules: DataFrame) -> DataFrame:
    """rules(tokens, verdict, confidence, support) less those that one with a token less makes needless."""
    shorter = rules.select(F.col("tokens").alias("less"), "verdict", F.col("confidence").alias("sure"))
    needless = rules.select("tokens", "verdict", "confidence", F.explode(_without(F.col("tokens"))).alias("less")).join(shorter, ["less", "verdict"])
    return rules.join(needless.filter("sure >= confidence").select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support")


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST) -> DataFrame:
    """(tokens, verdict, confidence, support) of the rules that labelled(tokens, verdict) supports, pruned."""
    longest = labelled.agg(F.max(F.size("tokens"))).first()[0]
    if longest is None:
        return labelled.sparkSession.createDataFrame([], RULE)
    rules = _grown_rules if longest <= most else _levelled_rules
    return pruned(materialized(rules(labelled, support, confidence), "url-combined"))


def judged(pages: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, seeds: tuple = SEEDS, train: Column | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined_rule, confidence): one row for each (page_id, url).

    `train`: which urls are learnt from; all where it is missing."""
    urls = materialized(parsed(pages, rules), "urls")
    known_urls = urls.filter("host <> ''").withColumn("verdict", labelled(urls, seeds))
    known_urls = known_urls.filter(train) if train is not None else known_urls
    known = materialized(telling(known_urls, support), "url-tokens")
    model = materialized(mined(materialized(mining_baskets(known_urls, known), "url-baskets"), support, confidence), "url-rules")
    # The index: each rule under its rarest token, so a url meets few rules that it doesn't hold.
    index = materialized(
        model.select("*", F.explode("tokens").alias("token"))
        .join(known.select("token", "n"), "token")
        .groupBy(F.col("tokens").alias("needs"), "verdict", "confidence", "support")
        .agg(F.min_by("token", F.struct("n", "token")).alias("token")),
        "url-index",
    )
    better = F.struct("confidence", "support", F.size("needs").alias("n"), F.array_join("needs", " ").alias("name"), "verdict")
    asked = urls.filter("given IS NULL").select("page_id", "url", "tokens", F.explode("tokens").alias("token"))
    found = [asked.join(own, "token").filter(F.size(F.array_except("needs", "tokens")) == 0).select("page_id", "url", better.alias("best")) for own in blocks(index, "token", BLOCK)]
    matched = reduce(DataFrame.unionByName, found).groupBy("page_id", "url").agg(F.max("best").alias("best"))
    u, m = urls.alias("u"), matched.alias("m")
    return u.join(m, F.expr("u.page_id <=> m.page_id AND u.url <=> m.url"), "left").select(
        "u.page_id",
        "u.url",
        "u.host",
        "u.path",
        F.col("u.given.rule").alias("rule"),
        F.coalesce(F.col("u.given.verdict"), F.col("m.best.verdict"), F.lit(DEFAULT)).alias("verdict"),
        F.col("m.best.name").alias("mined_rule"),
        F.col("m.best.confidence").alias("confidence"),
    )
