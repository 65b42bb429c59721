"""URL verdicts: fixed host and path rules, then mined association rules.

A URL is a set of tokens: scheme, host labels and their parts, path segments with digits
folded, file ending and query keys. Rules lead from tokens of ``MIN_COUNT`` labelled URLs and
more, an absolute count at every size of the input, so that a small host keeps its rules.

Rules of one token come from plain counts. A token whose labelled URLs all have one label is
decided: with more tokens beside it its rule stays as it is. A token of all labelled URLs adds
nothing beside others. All combinations of what is left are mined, of every URL and any length,
level by level: distinct token sets extend their combinations by one token, and aggregates
count them. Only combinations in fewer URLs than each of their parts are kept and extended. The
others have the URLs, and so the figures, of a part that fits wherever they fit; they can't
change a verdict. So nested paths and query keys that come together make few combinations. Keys
that come and go independently of each other in very many URLs make as many as there are.

Rules are pruned by confidence; rules with less than ``MIN_SUPPORT`` of all labelled URLs, which
are many and may be chance, by its lower bound (Wilson). They match by an inverted index: each
is filed under its rarest token, distinct token sets look their tokens up, tokens of many sets
in salted parts, and the few rules found are tested in full. A URL is blocked if its best block
rule is more certain than its best allow rule; without a rule it is allowed.

All of it is DataFrame expressions. Defined results: URLs that are
null or lack "://" have an empty host and path, no rule, no tokens, and are allowed. Without
labelled URLs there are no mined rules. Repeated rows are judged alike; other columns are
ignored; labels other than block and allow have rules that judge nothing.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critiq.llm.common import written

MIN_SUPPORT = 0.01
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5
#: Undecided tokens of a URL that are combined: all.
LONGEST = sys.maxsize
#: Tokens of more than this share of the token sets are looked up in ``SALTS`` parts.
HOT_SHARE = 1e-3
SALTS = 32
#: Normal quantile of the one-sided bound of 95 %.
SURE = 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Ascending distinct tokens of a URL; none without "://"."""
    url = F.coalesce(url, F.lit(""))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    h, p = host(url), path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)

    def tagged(tag: str, parts: Column) -> Column:
        parts = F.filter(parts, lambda x: x != "")
        return F.transform(parts, lambda x: F.concat(F.lit(tag), x))

    def folded(x: Column) -> Column:
        return F.regexp_replace(x, "[0-9]+", "0")

    tokens = F.concat(
        tagged("scheme:", F.array(F.translate(scheme, _UPPER, _LOWER))),
        tagged("label:", F.split(folded(h), r"\.")),
        tagged("part:", F.filter(F.split(folded(h), r"[.-]"), lambda x: h.contains("-"))),
        tagged("path:", F.split(folded(F.regexp_replace(p, r"\.[A-Za-z0-9]+$", "")), "/")),
        tagged("ending:", F.array(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))),
        tagged("key:", F.transform(F.split(query, "&"),
                                   lambda x: F.regexp_extract(x, "(?s)^([^=]*)", 1))),
    )
    return F.when(url.contains("://"), F.array_sort(F.array_distinct(tokens))).otherwise(
        F.array().cast("array<string>")
    )


def lower_bound(share: Column, count: Column, z: float = SURE) -> Column:
    """Wilson's lower bound of a share of ``count`` cases."""
    spread = F.sqrt(share * (1 - share) / count + z * z / (4 * count * count))
    return (share + z * z / (2 * count) - z * spread) / (1 + z * z / count)


_RULES = "antecedent array<string>, consequent string, confidence double, support double"


def token_counts(labelled: DataFrame) -> DataFrame:
    """``token, label, freq, whole``: labelled URLs of a token, by label and in all."""
    counted = labelled.select(F.explode("tokens").alias("token"), "label").groupBy(
        "token", "label"
    ).agg(F.count("*").alias("freq"))
    whole = F.sum("freq").over(Window.partitionBy("token"))
    return counted.withColumn("whole", whole)


def combined_tokens(labelled: DataFrame, open_tokens: DataFrame) -> DataFrame:
    """``basket, label, n, tokens``: distinct lists of the URLs' tokens that are worth combining."""
    urls = labelled.groupBy("tokens", "label").agg(F.count("*").alias("n"))
    urls = urls.withColumn("url", F.monotonically_increasing_id())
    return (
        written(urls).select("url", "label", "n", F.explode("tokens").alias("token"))
        .join(open_tokens, "token")
        .groupBy("url", "label", "n").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
        .filter(F.size("tokens") > 1)
        .groupBy("tokens", "label").agg(F.sum("n").alias("n"))
        .select(F.monotonically_increasing_id().alias("basket"), "label", "n", "tokens")
    )


def _narrower(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Combinations ``found`` that are in fewer URLs than each of their ``parts``, one shorter."""
    size = F.size("part")
    without = F.transform("part", lambda t: F.array_except("part", F.array(t)))
    kept = (
        found.select("part", "whole", F.explode(without).alias("shorter"))
        .join(parts.select(F.col("part").alias("shorter"), F.col("whole").alias("more")), "shorter")
        .filter(F.col("whole") < F.col("more"))
        .groupBy("part").agg(F.count("*").alias("narrower"))
    )
    return kept.filter(F.col("narrower") == size).select("part")


def combinations(
    baskets: DataFrame, open_tokens: DataFrame, min_count: int
) -> DataFrame | None:
    """``antecedent, consequent, freq, whole`` of combinations of two tokens and more.

    A row of a level stands for the combinations of its ``first`` tokens with each of ``last``.
    """
    level = baskets.select(
        "basket", "label", "n", F.array().cast("array<string>").alias("first"),
        F.col("tokens").alias("last"),
    )
    parts = open_tokens.select(F.array("token").alias("part"), "whole")
    found = None
    while True:
        longer = level.select(
            "basket", "label", "n", "first", "last", F.posexplode("last").alias("at", "token")
        ).select(
            "basket", "label", "n", F.array_append("first", F.col("token")).alias("first"),
            F.expr("slice(last, at + 2, size(last))").alias("last"),
        ).filter(F.size("last") > 0)
        each = written(longer.select(
            "basket", "label", "n", "first", F.explode("last").alias("token"),
            F.array_append("first", F.col("token")).alias("part"),
        ))
        counted = each.groupBy("part", "label").agg(F.sum("n").alias("freq"))
        of_part = Window.partitionBy("part")
        counted = written(
            counted.withColumns({"whole": F.sum("freq").over(of_part),
                                 "most": F.max("freq").over(of_part)})
            # Longer ones are in no more URLs, so that none of their rules would count either.
            .filter(F.col("most") >= min_count).drop("most")
        )
        wholes = counted.groupBy("part").agg(F.first("whole").alias("whole"))
        kept = written(wholes.join(_narrower(wholes, parts), "part"))
        if kept.isEmpty():
            return found
        rules = counted.join(kept.select("part"), "part", "left_semi").select(
            F.col("part").alias("antecedent"), F.col("label").alias("consequent"), "freq", "whole"
        )
        found = rules if found is None else found.unionByName(rules)
        level = (
            each.join(kept.select("part"), "part", "left_semi")
            .groupBy("basket", "label", "n", "first")
            .agg(F.array_sort(F.collect_list("token")).alias("last"))
        )
        parts = kept


def mined_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(antecedent, consequent, confidence, support) from rows of (tokens, label)."""
    spark = labelled.sparkSession
    labelled = written(labelled.filter(F.size("tokens") > 0))
    count = labelled.count()
    if count == 0:
        return spark.createDataFrame([], _RULES)
    counts = written(token_counts(labelled).filter(F.col("whole") >= min_count))
    single = counts.select(
        F.array("token").alias("antecedent"), F.col("label").alias("consequent"), "freq", "whole"
    )
    open_tokens = written(
        counts.filter((F.col("freq") < F.col("whole")) & (F.col("whole") < count))
        .groupBy("token").agg(F.first("whole").alias("whole"))
    )
    baskets = written(combined_tokens(labelled, open_tokens))
    several = combinations(baskets, open_tokens, min_count)
    found = single if several is None else single.unionByName(several)
    share = F.col("freq") / F.col("whole")
    sure = lower_bound(share, F.col("whole")) >= min_confidence
    return written(
        found.filter(
            (F.col("freq") >= min_count) & (share >= min_confidence)
            & ((F.col("freq") >= min_support * count) | sure)
        ).select(
            "antecedent", "consequent", share.alias("confidence"),
            (F.col("freq") / count).alias("support"),
        )
    )


def rule_verdicts(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Block or allow for those rows of distinct ``tokens`` that some rule fits."""
    token_sets = written(token_sets)
    sets = token_sets.count()
    looked = token_sets.select("tokens", F.explode("tokens").alias("token"))
    often = looked.groupBy("token").agg(F.count("*").alias("sets"))
    placed = rules.withColumn("rule_id", F.xxhash64("antecedent", "consequent"))
    rarest = Window.partitionBy("rule_id").orderBy(F.coalesce("sets", F.lit(0)), "token")
    index = (
        placed.select("*", F.explode("antecedent").alias("token")).join(often, "token", "left")
        .withColumn("place", F.row_number().over(rarest)).filter("place = 1 AND sets > 0")
        .select("token", "antecedent", "consequent", "confidence")
    )
    # No more than 1 / HOT_SHARE tokens for each token that a set has on average.
    hot = F.broadcast(
        often.filter(F.col("sets") > HOT_SHARE * sets).select("token", F.lit(1).alias("hot"))
    )
    salt = F.when(F.col("hot") == 1, F.pmod(F.xxhash64("tokens"), F.lit(SALTS))).otherwise(0)
    salts = F.when(F.col("hot") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    asked = looked.join(hot, "token", "left").select(
        "tokens", "token", salt.cast("int").alias("salt")
    )
    filed = index.join(hot, "token", "left").withColumn("salt", F.explode(salts)).drop("hot")
    found = asked.join(filed, ["token", "salt"])
    fits = F.size(F.array_except("antecedent", "tokens")) == 0
    sure = {v: F.max(F.when(F.col("consequent") == v, F.col("confidence")).otherwise(0.0))
            for v in ("block", "allow")}
    return found.filter(fits).groupBy("tokens").agg(
        F.when(sure["block"] > sure["allow"], "block").otherwise("allow").alias("mined")
    )


def judge_urls(
    pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
    fixed=RULES,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``labelled`` has (url, label)."""
    rules = mined_rules(labelled.select(url_tokens(F.col("url")).alias("tokens"), "label"))
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"),
        url_tokens(url).alias("tokens"),
    )
    rows = written(rows)
    sets = written(rows.groupBy("tokens").agg(F.count("*").alias("urls")))
    verdicts = written(rule_verdicts(sets.select("tokens"), rules).filter("mined = 'block'"))
    # Token sets of very many URLs, at most 1 / HOT_SHARE, are looked up where the URLs lie.
    hot = sets.filter(F.col("urls") > HOT_SHARE * rows.count()).select("tokens")
    judged = [
        rows.join(F.broadcast(hot), "tokens", "left_semi").join(
            F.broadcast(verdicts.join(F.broadcast(hot), "tokens", "left_semi")), "tokens", "left"
        ),
        rows.join(F.broadcast(hot), "tokens", "left_anti").join(
            verdicts.join(F.broadcast(hot), "tokens", "left_anti"), "tokens", "left"
        ),
    ]
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    return judged[0].unionByName(judged[1]).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.col("mined"), F.lit("allow")).alias("verdict"),
    )
