"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``ledger`` evaluates every rule once per document: one row with the
measurements and a bit per failed rule. ``apply_policy`` keeps a document if
none of the policy's bits failed; policies are versioned sets of rules, so a
new version needs no second pass over the texts. ``ablations`` counts, from
the bit patterns alone, what each rule rejects, rejects alone, and would let
through if it were dropped.

Everything happens inside the row: no shuffle, no join. Repeated 8-word
windows are found by 64-bit hashes of the windows of one document: windows of equal
hash count as equal only if their words are; documents without a repeated hash do
no more. Null and empty
texts measure zero everywhere and fail ``few_words``. Repeated rows get equal
ledger rows. Other columns of the input are carried in the struct ``doc`` and
cannot clash.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from pagemark.llm.common import TOKEN, bind, words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters_words")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows found twice or more in the array."""
    count = F.size(tokens) - F.lit(window - 1)
    hashes = F.when(count > 1, F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, window))))

    def repeated(keyed: Column) -> Column:
        """Of structs ``h, i`` those whose h another one has too."""
        return bind(F.array_sort(keyed), lambda s: F.filter(s, lambda x, k:
            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"])))

    def covered(found: Column) -> Column:
        likely = repeated(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # The words themselves decide; words hold no blanks, so joining them loses nothing.
        twice = repeated(F.transform(likely, lambda x: F.struct(
            F.array_join(F.slice(tokens, x["i"] + 1, window), " ").alias("h"), x["i"].alias("i"))))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return bind(starts, lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(window)), F.lit(window))),
            F.lit(0), lambda a, x: a + x))

    return F.coalesce(bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0))


# Rules: name -> failure condition over the measurements. A rule's place is its bit.
RULES: Mapping[str, str] = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "n_words >= 20 AND 10 * n_upper > 6 * n_words",
    "no_letters": "10 * n_letters_words < 6 * n_words",
}
# Versioned policies: the rules that reject. The first two rules are the base.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeats"),
    "v2": ("few_words", "repeats", "symbols", "dup_lines", "short_words", "long_words", "shouting", "no_letters"),
}
CURRENT = "v2"


def mask(rules, all_rules: Mapping[str, str] = RULES) -> int:
    places = {name: k for k, name in enumerate(all_rules)}
    return sum(1 << places[name] for name in rules)


def ledger(docs: DataFrame, text_col: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """``doc`` (the input row), the measurements, ``failed`` (long bitmask)."""
    blank = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), blank.alias("text"))
    split = base.select("doc", "text", words(F.col("text"), TOKEN).alias("tokens"),
                        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    size = F.size
    long = lambda column, name: column.cast("long").alias(name)
    # One generated row: a filter on a measurement cannot be pushed below the
    # generator, so every measurement is computed once.
    measured = split.select("doc", F.inline(F.array(F.struct(
        long(size("tokens"), "n_words"),
        long(F.length(F.array_join("tokens", "")), "word_chars"),
        long(F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", "")), "n_symbols"),
        long(size("lines"), "n_lines"),
        long(size("lines") - size(F.array_distinct("lines")), "n_dup_lines"),
        long(repeated_words(F.col("tokens")), "n_repeat_words"),
        long(F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[A-Z]{2}")), "n_upper"),
        long(F.regexp_count("text", F.lit(r"\p{L}[^\x20\x09-\x0D]*")), "n_letters_words")))))
    failed = F.lit(0).cast("long")
    for place, condition in enumerate(rules.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: str = CURRENT, policies=POLICIES, rules=RULES) -> DataFrame:
    """The ledger with ``kept`` under one policy version."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policies[policy], rules))) == 0)


def ablations(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """Per policy and rule: ``n_docs, n_failed`` (the rule's bit is set), ``n_alone``
    (kept if the rule were dropped), ``n_rejected`` (by the whole policy). Rows
    first collapse to bit patterns, so the second step handles at most
    2^rules rows."""
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[
        F.struct(F.lit(version).alias("policy"), F.lit(rule).alias("rule"),
                 F.lit(mask([rule], rules)).cast("long").alias("bit"), F.lit(mask(chosen, rules)).cast("long").alias("mask"))
        for version, chosen in policies.items() for rule in chosen])).alias("g")
    seen = patterns.select("n", "failed", grid).select("n", "failed", "g.*").withColumn(
        "hit", F.col("failed").bitwiseAND(F.col("mask")))
    return seen.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(F.col("hit") != 0, F.col("n")).otherwise(0)).alias("n_rejected"))
