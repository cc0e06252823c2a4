"""URL filters: a rule list, and association rules mined from labelled URLs.

The rule list gives verdicts for hosts (with their subdomains) and path prefixes; the
longest rule that fits wins. What it leaves open is judged by association rules:
Spark's FP-growth mines combinations of URL tokens that go with a label, rules are
pruned by support and confidence, a rule that a shorter one with the same verdict
makes superfluous is dropped, and the rest match through an inverted index: a rule
stands under its rarest token, a URL's tokens look up rules, and each candidate is
verified against all tokens. The rule with the highest confidence (then support,
then the smallest antecedent by text) decides; no rule: allow.

Tokens of a URL: scheme, each host label but the last with its words, the last
label, each path segment (runs of digits as ``#``), the file suffix, query names, and
whether there is a fragment. All of them count when rules are matched. For mining,
equal URLs count once and a URL contributes the ``ITEMS`` tokens that tell most about
the label (by the log-likelihood ratio of the token over all labelled URLs), which
bounds the combinations of one URL by ``2**ITEMS`` and the number of rules by
``2**(ITEMS+1) / MIN_SUPPORT``, whatever the number of URLs. Labels come from all
labelled rows.

URLs are judged per distinct token set, and verdicts join back by the set's hash, in
``SALTS`` copies each, as one set may hold a third of all rows.
Null URLs and URLs without ``://`` have empty host and path and no tokens: no rule
fits, the verdict is allow. Repeated rows stay. Without labelled URLs there are no
mined rules. Empty tables give no rows; columns of the input are carried along, the
added ones are in one struct.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from pagemark.llm.common import bind, lower_az, store, words

ITEMS = 12
MIN_SUPPORT = 0.002     # of the labelled URLs, two URLs at least
MIN_CONFIDENCE = 0.8
SALTS = 16
LABEL = "label="        # no token starts with it

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return lower_az(F.regexp_extract(_after(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """The URL after its first ``://``; empty when there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def listed(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, null when none does."""
    chain = F
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chain = chain.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return chain if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct, sorted tokens of a URL."""
    tag = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))
    optional = lambda kind, value: F.when(value != "", F.array(F.concat(F.lit(kind + ":"), value))).otherwise(
        F.expr("cast(array() as array<string>)"))
    labels = words(host, "[.]")
    name = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    segments = F.transform(words(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    query = F.regexp_extract(_after(url), "^[^?#]*[?]([^#]*)", 1)
    names = F.transform(words(query, "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    parts = F.concat(
        optional("scheme", lower_az(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        tag("host", name), tag("word", F.flatten(F.transform(name, lambda x: words(x, "[^a-z0-9]+")))),
        optional("top", F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(""))),
        tag("path", segments), optional("suffix", F.regexp_extract(path, "[.]([A-Za-z0-9]+)$", 1)), tag("query", names),
        optional("mark", F.when(_after(url).contains("#"), "fragment").otherwise("")))
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(parts))).otherwise(
        F.expr("cast(array() as array<string>)"))


def _ratio(k: Column, n: Column, k_all: Column, n_all: Column) -> Column:
    """Log-likelihood ratio of ``k`` of ``n`` against ``k_all`` of ``n_all``."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = k_all / n_all
    return part(k, n * rate) + part(n - k, n * (1 - rate))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = MIN_SUPPORT,
        min_confidence: float = MIN_CONFIDENCE, items: int = ITEMS) -> DataFrame:
    """Rules ``antecedent`` (sorted tokens) ``, verdict, confidence, support`` (URLs) ``, key``
    (its rarest token, by which it is indexed). Rows without URL or label are left out;
    a URL with several labels counts once for each."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("string").alias("label")).dropna().distinct()
    rows = store(rows.select("label", tokens(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"),
                             F.xxhash64("url", "label").alias("id")))
    classes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(classes.values())
    schema = "antecedent array<string>, verdict string, confidence double, support long, key string"
    if not total:
        return spark.createDataFrame([], schema)
    least = max(2.0, min_support * total)
    # Tokens of enough URLs, with what they tell about the label: the largest ratio of any class.
    counts = rows.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), *[F.sum((F.col("label") == c).cast("long")).alias(f"k{i}") for i, c in enumerate(classes)])
    told = F.greatest(*[_ratio(F.col(f"k{i}"), F.col("n"), F.lit(n), F.lit(total)) for i, n in enumerate(classes.values())],
                      F.lit(-1.0))
    frequent = store(counts.filter(F.col("n") >= least).select("token", "n", told.alias("told")))
    # At most ITEMS tokens a URL: the rest tells least about the label.
    kept = rows.select("id", "label", F.explode("tokens").alias("token")).join(frequent, "token").groupBy("id", "label").agg(
        F.sort_array(F.collect_list(F.struct("told", "token")), asc=False).alias("t"))
    baskets = kept.select(F.concat(F.slice("t.token", 1, items), F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    mined = FPGrowth(itemsCol="items", minSupport=least / total * (1 - 1e-9), minConfidence=min_confidence).fit(store(baskets))
    sets = mined.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("antecedent"),
                                     F.filter("items", lambda x: x.startswith(LABEL)).alias("labels"), "freq")
    sets = store(sets.filter((F.size("antecedent") > 0) & (F.size("labels") <= 1)))
    with_label = sets.filter(F.size("labels") == 1).select(
        "antecedent", F.substring(F.col("labels")[0], len(LABEL) + 1, 1 << 30).alias("verdict"), F.col("freq").alias("support"))
    alone = sets.filter(F.size("labels") == 0).select("antecedent", "freq")
    rules = with_label.join(alone, "antecedent").select(
        "antecedent", "verdict", (F.col("support") / F.col("freq")).alias("confidence"), "support")
    rules = store(rules.filter(F.col("confidence") >= min_confidence))
    return store(_keyed(_without_superfluous(rules), frequent).select("antecedent", "verdict", "confidence", "support", "key"))


def _without_superfluous(rules: DataFrame) -> DataFrame:
    """Drops a rule when one with one token less has its verdict and at least its
    confidence: that one fires wherever it does. (Chains end at a rule that stays.)"""
    shorter = rules.select("antecedent", "verdict", "confidence", F.posexplode("antecedent").alias("at", "token")).select(
        "antecedent", "verdict", "confidence", F.array_remove("antecedent", F.col("token")).alias("part"))
    beaten = shorter.join(rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("other")),
                          ["part", "verdict"]).filter(F.col("other") >= F.col("confidence")).select("antecedent", "verdict").distinct()
    return rules.join(beaten, ["antecedent", "verdict"], "left_anti")


def _keyed(rules: DataFrame, frequent: DataFrame) -> DataFrame:
    exploded = rules.select("*", F.explode("antecedent").alias("token")).join(frequent.select("token", "n"), "token")
    return exploded.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("key"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The deciding rule of each row (``id, tokens``) that has one: ``id, mined`` (struct
    ``confidence, support, antecedent, verdict``). Equal rules of different verdicts: allow."""
    found = sets.select("id", "tokens", F.explode("tokens").alias("key")).join(rules, "key").filter(
        F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct("confidence", "support", (-F.size("antecedent")).alias("short"), (F.col("verdict") == ALLOW).alias("allows"))
    first = F.struct("confidence", "support", "antecedent", "verdict")
    return found.groupBy("id").agg(F.max(order).alias("top"), F.collect_set(first).alias("all")).select(
        "id", bind(F.filter("all", lambda r: (r["confidence"] == F.col("top.confidence")) & (r["support"] == F.col("top.support"))
                            & (F.size(r["antecedent"]) == -F.col("top.short")) & ((r["verdict"] == ALLOW) == F.col("top.allows"))),
                   lambda best: F.array_min(F.transform(best, lambda r: F.struct(
                       r["antecedent"].alias("antecedent"), r["verdict"].alias("verdict"), r["confidence"].alias("confidence"),
                       r["support"].alias("support"))))).alias("mined"))


def judge(pages: DataFrame, listing: list[Rule], rules: DataFrame, url_col: str = "url", into: str = "judged") -> DataFrame:
    """``pages`` with a struct column ``into``: ``host, path, rule, verdict, antecedent,
    confidence`` (of the mined rule that decided; else null)."""
    url = F.col(url_col)
    names = pages.columns
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), url.alias("url"))
    parts = kept.select("row", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.select("row", "host", "path", listed(F.col("host"), F.col("path"), listing).alias("hit"),
                         tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    parts = parts.withColumn("id", F.when(F.col("hit").isNull(), F.sha2(F.array_join("tokens", "\n"), 256)))
    sets = parts.filter(F.col("hit").isNull()).groupBy("id").agg(F.first("tokens").alias("tokens"))
    best = match(sets, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Rows with a listed rule have no id and meet nothing; the row's hash spreads them too (maps cannot be hashed).
    hashed = [F.col(f"row.`{c}`") for c, kind in pages.dtypes if "map<" not in kind and kind != "variant"]
    found = parts.withColumn("salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")).join(best, ["id", "salt"], "left").select("row", F.struct(
        "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", "mined.verdict", F.lit(ALLOW)).alias("verdict"),
        F.col("mined.antecedent").alias("antecedent"), F.col("mined.confidence").alias("confidence")).alias("found"))
    return found.select(*[F.col(f"row.`{c}`") for c in names if c != into], F.col("found").alias(into))
