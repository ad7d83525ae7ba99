"""CSV / JSON exports for the front-end, and readers for them.

A JSON export is one file with one object, an entry a topic (or day), as the page loads
it. Spark writes its lines: entries sorted by key, brackets and commas around them. The
file is one task's work, bounded by parameters (topics x articles or months a topic).
Each sink returns the DataFrame it writes (``path=None`` writes nothing).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_key, weights_sum
from ..session import BROADCAST_MAX_ROWS, broadcast_small, scratch_path
from .tables import HEADLINE

TOOLTIP = T.StructType([T.StructField("pub_date", T.StringType()), T.StructField("lead_paragraph", T.StringType()),
                        T.StructField("headline", HEADLINE), T.StructField("web_url", T.StringType())])


def month_entry(id_type: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([*TOOLTIP.fields, T.StructField("weight", T.DoubleType()), T.StructField("_id", id_type),
                         T.StructField("weights_sum", T.DoubleType())])


def _one_file(spark: SparkSession, folder: str, path: str) -> None:
    """Put the single part file of ``folder`` at ``path``, in place of an older one."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part, = [s.getPath() for s in fs.listStatus(of(folder)) if s.getPath().getName().startswith("part-")]
    to = of(path)
    if to.getParent() is not None:
        fs.mkdirs(to.getParent())
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"cannot write {path}")


def write_object(df: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object {key: value, ...} in the file ``path``, entries in key order."""
    spark = df.sparkSession
    entry = F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)))
    rows = df.where(F.col(key).isNotNull()).select(
        F.row_number().over(Window.orderBy(key)).alias("at"), entry.alias("entry"))      # an entry a topic or day
    rows = rows.select("at", F.concat(F.when(F.col("at") == 1, "").otherwise(","),
                                      F.expr("substring(entry, 2, length(entry) - 2)")).alias("text"))
    ends = spark.createDataFrame([(0, "{"), (2 ** 31 - 1, "}")], "at int, text string")
    folder = scratch_path(spark, "export")
    rows.unionByName(ends).coalesce(1).sortWithinPartitions("at").select("text").write.text(folder)
    _one_file(spark, folder, path)


def read_object(spark: SparkSession, path: str, value_type: T.DataType | str, key: str = "name", value: str = "value") -> DataFrame:
    """(key, value) of every entry of the JSON object in the file ``path``."""
    kind = value_type if isinstance(value_type, str) else value_type.simpleString()
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{kind}>").alias("m"))
    return whole.select(F.explode("m").alias(key, value))


def _write_csv(df: DataFrame, path: str, order: str) -> None:
    folder = scratch_path(df.sparkSession, "export")
    df.coalesce(1).sortWithinPartitions(order).write.option("header", True).csv(folder)
    _one_file(df.sparkSession, folder, path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def few(df: DataFrame, most: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``df`` computed once; broadcast in joins if it has no more than ``most`` rows."""
    rows = df.checkpoint(eager=True)
    return broadcast_small(rows, most)


def sink_trend_csv(trend: DataFrame, topics: DataFrame, path: str | None = None) -> DataFrame:
    """Wide trend: first column ``date``, one column per topic name (all topics of
    the model, in topic order), nulls as 0. The K names are read to the driver
    so the pivot gets explicit values (K is a model parameter)."""
    names = [r["name"] for r in topics.select("topic", "name").orderBy("topic").collect()]
    wide = (trend.join(broadcast_small(topics.select("topic", "name")), "topic")
            .groupBy("date").pivot("name", names).agg(F.first("value")).na.fill(0.0))
    wide = wide.select("date", *names)
    if path:
        _write_csv(wide, path, "date")
    return wide


def tooltip_struct(prefix: str = "") -> list:
    return [day_key(f"{prefix}pub_date").alias("pub_date"), F.col(f"{prefix}lead_paragraph")
            .alias("lead_paragraph"), F.col(f"{prefix}headline").alias("headline"),
            F.col(f"{prefix}web_url").alias("web_url")]


def join_best_metadata(best: DataFrame, articles: DataFrame) -> DataFrame:
    """Best-article rows with their article metadata (inner: missing ids drop). The best
    rows (topics x a parameter) are computed once and go to the articles."""
    meta = articles.select("article_id", "pub_date", "lead_paragraph", "headline", "web_url")
    return meta.join(few(best), "article_id")


def _by_topic(rows: DataFrame, topics: DataFrame, order: list[str], entry: T.StructType) -> DataFrame:
    """(name, articles array<entry>) of every topic, in the given order; [] if none."""
    fields = [f.name for f in entry.fields]
    per = rows.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("a")))).alias("l"))
    return (topics.select("topic", "name").join(per, "topic", "left")
            .select("name", F.coalesce(F.transform("l", lambda x: x["a"]), F.array()).cast(T.ArrayType(entry)).alias("articles")))


def _exported(out: DataFrame, key: str, value: str, path: str | None) -> DataFrame:
    if path:
        write_object(out, key, value, path)
    return out


def sink_best_json(best: DataFrame, articles: DataFrame, topics: DataFrame,
                   path: str | None = None) -> DataFrame:
    """(name, articles): {topic: [{pub_date, lead_paragraph, headline, web_url}]}, each
    topic's best first; every topic appears (empty list if none)."""
    rows = join_best_metadata(best, articles).select("topic", "rank", *tooltip_struct())
    return _exported(_by_topic(rows, topics, ["rank"], TOOLTIP), "name", "articles", path)


def sink_best_month_json(best_month: DataFrame, articles: DataFrame, doc_topics: DataFrame,
                         topics: DataFrame, path: str | None = None) -> DataFrame:
    """(name, articles): as ``sink_best_json`` with weight, _id and weights_sum, a month's
    best article after the other."""
    found = best_month.where(F.col("article_id").isNotNull())
    sums = doc_topics.select("article_id", weights_sum("weights").alias("weights_sum"))
    rows = sums.join(few(join_best_metadata(found, articles)), "article_id").select(
        "topic", "month", *tooltip_struct(), "weight", F.col("article_id").alias("_id"), "weights_sum")
    entry = month_entry(articles.schema["article_id"].dataType)
    return _exported(_by_topic(rows, topics, ["month"], entry), "name", "articles", path)


def read_best_json(spark: SparkSession, path: str, entry: T.StructType = TOOLTIP) -> DataFrame:
    """(name, articles) of an exported file."""
    return read_object(spark, path, T.ArrayType(entry), "name", "articles")


def filter_best_json(best_json: DataFrame | str, threshold: float = .001, spark: SparkSession | None = None,
                     id_type: T.DataType = T.StringType(), path: str | None = None) -> DataFrame:
    """Drop articles with weight < threshold inside each topic's list; topics
    left empty stay. Takes the DataFrame of ``sink_best_month_json`` or the path of its
    file; with ``path`` the result is written there."""
    if isinstance(best_json, str):
        best_json = read_best_json(spark or SparkSession.active(), best_json, month_entry(id_type))
    out = best_json.select("name", F.filter("articles", lambda a: a["weight"] >= F.lit(threshold)).alias("articles"))
    return _exported(out, "name", "articles", path)


def sink_topic_terms_json(concise: DataFrame, topics: DataFrame, path: str | None = None) -> DataFrame:
    """(name, terms) for kept topics: {name: 'term1, term2, ...'} in rank order."""
    kept = topics.filter(F.col("keep")).select("topic", "name")
    per = concise.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    out = per.join(broadcast_small(kept), "topic").select(
        "name", F.concat_ws(", ", F.transform("t", lambda x: x["term"])).alias("terms"))
    return _exported(out, "name", "terms", path)


def sink_daily_counts_json(daily: DataFrame, path: str | None = None) -> DataFrame:
    """(day, n): {yyyymmdd: n}."""
    return _exported(daily.select("day", "n"), "day", "n", path)


def sink_empire_csv(counts: DataFrame, n_topics: int, path: str | None = None) -> DataFrame:
    """Wide month x topic counts from ``empire_counts``: column ``date`` (the
    month) then one column per topic index "0".."K-1", rows in month order (the
    topic names are not applied, as in the reference export)."""
    keys = list(range(n_topics))
    wide = counts.groupBy(F.col("month").alias("date")).pivot("topic", keys).agg(F.first("n"))
    wide = wide.select("date", *[F.col(str(k)) for k in keys])
    if path:
        _write_csv(wide, path, "date")
    return wide
