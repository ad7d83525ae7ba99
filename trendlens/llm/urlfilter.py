"""URL verdicts: domain and path rules first, gradient-boosted trees for the rest.

DataFrame operations only. The trees learn lexical features of the URLs that a
rule labels: length, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffix; the model is Spark's own, fitted on a bounded
choice of labelled rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# fixed values: the rules of the contract, (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]
TRAINING_ROWS = 10_000          # labelled URLs the trees are fitted on, at most
SUFFIXES = 200                  # host suffixes with statistics of their own, the most frequent
TREES, DEPTH = 10, 4
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters",
            "query_length", "dashes", "percents", "has_fragment", "suffix_rate", "suffix_share"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased in A-Z; both empty without a ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    empty = F.lit("")
    return F.when(has, F.translate(host, upper, lower)).otherwise(empty), F.when(has, path).otherwise(empty)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):    # longer ones override
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column, length: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (
        length - F.length(F.replace(text, c, F.lit("")))) / F.greatest(length, F.lit(1)))
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path, suffix and the lexical features."""
    host, path = split_url(F.col("url"))
    url = F.coalesce("url", F.lit(""))
    length = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    with_parts = pages.withColumns({"host": host, "path": path})
    return with_parts.withColumns({
        "suffix": F.substring_index("host", ".", -1), "length": length.cast("double"),
        "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"), "labels": count(F.col("host"), r"\."),
        "digit_ratio": count(url, "[0-9]") / F.greatest(length, F.lit(1)), "entropy": entropy(url, length),
        "parameters": count(query, "[^&=]+="), "query_length": F.length(query).cast("double"),
        "dashes": count(url, "[-_]"), "percents": count(url, "%"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double")})


def judge_urls(pages: DataFrame, rules=RULES, training_rows: int = TRAINING_ROWS, trees: int = TREES,
               depth: int = DEPTH) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is judged by the trees like others. Where the rules label fewer than
    two classes (an empty table too), the one class there is, or else allow, is
    the verdict of all others. Rows are kept as they come; extra columns are
    not read.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = lexical(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    labelled = rows.where("ruled is not null").withColumn("blocked", (F.col("ruled") == "block").cast("double"))
    rates = stored(labelled.groupBy("suffix").agg(F.sum("blocked").alias("b"), F.count("*").alias("k"))
                   .orderBy(F.desc("k"), "suffix").limit(SUFFIXES), "url-suffixes")
    total = rates.agg(F.sum("b").alias("b"), F.sum("k").alias("k")).first()
    if not total["k"] or total["b"] in (0, total["k"]):
        only = "block" if total["k"] and total["b"] else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"))
    prior = total["b"] / total["k"]
    rates = rates.select("suffix", ((F.col("b") + 10 * prior) / (F.col("k") + 10)).alias("suffix_rate"),
                         (F.col("k") / total["k"]).alias("suffix_share"))

    def with_rates(df):
        return (df.join(F.broadcast(rates), "suffix", "left")                          # SUFFIXES rows at most
                .fillna({"suffix_rate": prior, "suffix_share": 0.0}))

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    picked = stored(labelled.orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(training_rows)
                    .select("suffix", "blocked", *FEATURES[:-2]), "url-training")
    training = assembler.transform(with_rates(picked)).select("features", "blocked").coalesce(8)
    model = GBTClassifier(featuresCol="features", labelCol="blocked", maxIter=trees, maxDepth=depth, seed=7,
                          maxBins=32, cacheNodeIds=False).fit(training)
    scored = model.transform(assembler.transform(with_rates(rows)))
    learned = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"))

