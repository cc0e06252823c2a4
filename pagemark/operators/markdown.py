"""Page assembly and size report."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemark.operators import blocks as B
from pagemark.session import cut_lineage


def page_markdown(pages: DataFrame, scope: str = "outside_main", materialize: bool = True) -> DataFrame:
    """Kept blocks joined by a blank line in block order; null when a
    page keeps nothing. One row per input page, with ``html_chars``.

    The block table feeds two branches (the corpus-wide boilerplate count
    and the per-page assembly); with ``materialize`` it is written once to
    the checkpoint folder instead of being recomputed from the tokens for
    each branch.
    """
    mdb = B.block_markdown(B.page_blocks(B.page_tokens(pages)))
    joined = "listagg(md, '\\n\\n') WITHIN GROUP (ORDER BY block_no)"
    chars = F.max("html_chars").alias("html_chars")
    if scope == "none":  # nothing to look up: one pass
        return B.keep_flags(mdb).groupBy("page_id", "url").agg(F.expr(joined + " FILTER (WHERE keep)").alias("markdown"), chars)
    if materialize:
        mdb = cut_lineage(mdb)
    md = B.kept_blocks(mdb, scope).groupBy("page_id").agg(F.expr(joined).alias("markdown"))
    return mdb.groupBy("page_id", "url").agg(chars).join(md, "page_id", "left")


def size_saving(md: DataFrame) -> DataFrame:
    """D15 per page of ``page_markdown``: characters of HTML and Markdown and the
    saving in per mille, ``1000 - floor(1000 * md / html)``."""
    md_chars = F.coalesce(F.length("markdown"), F.lit(0))
    return md.select(
        "page_id", "url", "markdown", F.col("html_chars").cast("long").alias("html_chars"),
        md_chars.cast("long").alias("md_chars"),
        F.when(F.col("html_chars") > 0,
               F.lit(1000) - F.expr("(coalesce(length(markdown), 0) * 1000) div html_chars"))
        .cast("long").alias("saving_pm"))


def saving_by_host(per_page: DataFrame) -> DataFrame:
    """D15 rollup: pages, mean and exact quartiles of the per-mille saving by
    host and for the whole corpus (host null, level 1).

    Quantiles come from a histogram per (host, saving): the value domain is
    at most ~1001 integers, so each group's state stays bounded however many
    pages a host has; the exact discrete quantile is the smallest value whose
    cumulative count reaches q * n.
    """
    from pagemark.functions.urls import host
    p = per_page.where(F.col("saving_pm").isNotNull()).select(
        host(F.col("url")).alias("host"), "saving_pm")
    hist = p.groupBy("host", "saving_pm").agg(F.count(F.lit(1)).alias("n"))
    # Corpus level: same histogram with the host folded away (bounded rows).
    corpus = hist.groupBy("saving_pm").agg(F.sum("n").alias("n")).select(
        F.lit(None).cast("string").alias("host"), "saving_pm", "n")
    both = (hist.withColumn("level", F.lit(0))
            .unionByName(corpus.withColumn("level", F.lit(1))))
    w = Window.partitionBy("level", "host").orderBy("saving_pm").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    wg = Window.partitionBy("level", "host")
    h = (both.withColumn("cum", F.sum("n").over(w))
         .withColumn("total", F.sum("n").over(wg)))

    def q(pct):
        return F.min(F.when(F.col("cum") * 100 >= F.col("total") * pct, F.col("saving_pm")))

    return h.groupBy("level", "host").agg(
        F.sum("n").cast("long").alias("pages"),
        F.expr("sum(saving_pm * n) div sum(n)").cast("long").alias("mean_pm"),
        q(25).cast("long").alias("p25_pm"),
        q(50).cast("long").alias("p50_pm"),
        q(75).cast("long").alias("p75_pm"),
        F.min("saving_pm").cast("long").alias("min_pm"),
        F.max("saving_pm").cast("long").alias("max_pm")).select(
        F.col("level").cast("long").alias("level"), "host", "pages", "mean_pm",
        "p25_pm", "p50_pm", "p75_pm", "min_pm", "max_pm")

