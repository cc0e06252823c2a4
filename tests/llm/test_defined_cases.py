"""Cases that the operators' docstrings define: unknown kinds, odd addresses, clashing names, hand-written signatures."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemark.llm import chat, licenses, quality, rollup, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"


def test_part_types(spark):
    part = lambda kind, **v: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | v
    parts = [part("Image", ref="i", width=56, height=57), part("IMAGE", width=56, height=57), part("video", ref="v", text="seen"), part("video", text="only text"),
             part(None, text="t"), part("Audio", ref="a", seconds=1.5), part("document", ref="d", pages=2), part("Text", text="x", ref="r"), part("video")]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.conversations(chat.format_turns(df)).collect()[0]
    assert r["formatted"] == ("<|im_start|>user\n<|image|><|image|><|attachment|>seenonly textt<|audio|><|document|>x<|im_end|>\n")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        ("image", "i", 6), ("image", None, 6), ("video", "v", 0), ("audio", "a", 38), ("document", "d", 1024)]
    assert r["expanded_tokens"] == 6 + 6 + 38 + 1024


def test_unknown_changes_do_nothing(spark):
    state = rollup.Rollup(spark)
    schema = "seq long, op string, doc_id long, source string, lang string, tokenizer string, tokens long"
    state.commit(1, spark.createDataFrame([(0, "insert", 1, "s", "en", "t", 5), (0, "insert", 2, "s", "en", "t", 7)], schema))
    state.commit(2, spark.createDataFrame([(0, "bogus", 1, "s", "en", "t", 9), (0, None, 2, "s", "en", "t", 9), (1, "revise", 2, "s", "en", "t", 8),
                                           (2, "Delete", 2, "s", "en", "t", 8), (0, "delete", 3, "s", "en", "t", 8)], schema))
    assert [tuple(r) for r in state.totals().collect()] == [("s", "en", "t", 2, 13)]
    assert sorted((r["doc_id"], r["tokens"]) for r in state.current().collect()) == [("1", 5), ("2", 8)]


def test_addresses_without_a_scheme(spark):
    urls = [" www.a.com/p#x", "www.b.com/q", "dns:x", "urn:y", "/rel", "", "#f", "http://A.com:80#t", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["www.a.com/p", "www.b.com/q", "dns:x", "urn:y", "/rel", "", "", "http://a.com/", None]
    rows = [(1, "www.a.com/p", 1, 200, "d1"), (2, "www.b.com/q", 2, 200, "d2"), (3, "www.a.com/p", 3, 304, "d1")]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, digest string").withColumn("headers", F.lit(None).cast("map<string,string>"))
    assert [(r["response_id"], r["outcome"]) for r in warc.resolve(df).collect()] == [(1, "resolved")]


LICENSES = {
    "SPDX-License-Identifier: EPL-2.0": "epl-2.0", "SPDX-License-Identifier: CDDL-1.0": "cddl-1.0", "# SPDX-License-Identifier: OFL-1.1": "ofl-1.1",
    "SPDX-License-Identifier: BSL-1.0": "boost-1.0", "SPDX-License-Identifier: PSF-2.0": "psf-2.0", "SPDX-License-Identifier: EUPL-1.2": "eupl-1.2",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0", "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa-4.0", "SPDX-License-Identifier: MIT": "mit",
    "it is GPLv3 code": "gpl-3", "GPLv2 or later": "gpl-2", "the LGPLv2.1": "lgpl-2.1", "AGPLv3!": "agpl-3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to": "mit",
    "* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that": "bsd",
    "Neither the name of the Institute of Things nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    "you may not use this file except in compliance with the License.": "apache-2.0",
    "Unauthorized copying of this file, via any medium, is strictly prohibited": "proprietary"}


def test_signatures():
    scanner = licenses.Scanner()
    for text, label in LICENSES.items():
        assert label in {d[0] for d in scanner.scan("Some words. " + text + " More words.")[2]}, text
    for text in ("an eclipse 2.0 chart", "boost 1.0", "mozilla 2.0", "a general public 2 meeting", "permission is granted to any person"):
        assert scanner.scan(text)[2] == [], text


def test_gate_and_suppression_equal_all_rules():
    """Every rule run without its keyword gate, and suppression by comparing all pairs."""
    rnd = random.Random(4)
    scanner = licenses.Scanner()
    words = ["the", "license", "Apache", "2.0", "GPL", "v3", "MIT", "under", "licensed", "cc", "by", "general", "public", "all rights reserved", "SPDX-License-Identifier:",
             "copyright 2019", *LICENSES]
    for _ in range(60):
        text = rnd.choice([" ", "\n", ", "]).join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))
        found = scanner.scan(text)
        assert found == scanner.scan(text, gated=False)
        plain = text.encode().lower().decode("latin-1")
        every = sorted((r[0], m.start() - m.end(), m.start(), k, m.end()) for k, r in enumerate(scanner.rules) for m in r[4].finditer(plain))
        kept = []
        for _, _, a, k, b in every:
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, k))
        assert [d[3] for d in found[2]] == [k for _, _, k in sorted(kept)]


def test_one_row_stays_whatever_the_partitions(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, lang, source) for lang in ("de", "en", "fr", None) for source in ("a", "b")] + [(2, text, "en", "a"), (3, "else", "en", "a"), (None, text, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(
        {c: F.lit(c) for c in ("__id", "__key", "__n", "root", "salt", "fingerprint", "component_id", "text_key")}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    for parts in (1, 5):
        got = simhash.keep_one(df.repartition(parts, "source", "lang"))
        assert got.columns == df.columns
        assert sorted((r["doc_id"], r["lang"] or "", r["source"]) for r in got.collect()) == [(1, "", "a"), (3, "en", "a")]


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(c) for c in ("__id", "__key", "__n", "__toxicity", "doc", "w", "items")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()


def test_one_component_of_many_edges(spark):
    """A hub with many neighbours, and a chain: the smallest node for all, once each."""
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(500, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(400), 500]} | {i: 1000 for i in range(1000, 1101)}


def test_windows_of_equal_hash_are_compared(spark, monkeypatch):
    """With a hash that is the same for all windows only equal words count."""
    real = F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: real(F.lit(1)))
    texts = ["a b c d e f g h i j k l", "a b c d e f g h a b c d e f g h", "x " * 20, "one two"]
    try:
        got = [r[0] for r in spark.createDataFrame([(t.split(),) for t in texts], "w array<string>").select(quality.repeated_words(F.col("w"))).collect()]
    finally:
        monkeypatch.undo()
    assert got == [0, 16, 20, 0]


@pytest.mark.parametrize("n", [1500])
def test_all_significant_terms_are_learned(spark, n):
    """More terms than any fixed number: each stands in toxic texts only."""
    name = lambda i: "zq" + "".join(chr(97 + int(d)) for d in str(i)) + "x"
    plain = lambda i: "plain" + "".join(chr(97 + int(d)) for d in str(i))
    rows, rnd = [], random.Random(1)
    for d in range(120):
        rows.append((d, " ".join(f"{name(i)} f{chr(97 + d % 26)}{chr(97 + d // 26)}{chr(97 + i % 26)}" for i in range(n)), 1))
    for d in range(120, 400):
        rows.append((d, " ".join(plain(rnd.randrange(3000)) for i in range(3000)), 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert sum(name(i) in model.terms for i in range(n)) == n


def test_spans_of_many_places(spark):
    """Overlapping, touching, nested, repeated and far places, thousands in one document."""
    from pagemark.llm import decontam
    rnd = random.Random(3)
    docs = {0: [(3 * i, 3 * i + 1) for i in range(5000)], 1: [(0, 10), (2, 4), (10, 12), (13, 15), (13, 15)], 2: [(5, 6)]}
    for d in range(3, 40):
        docs[d] = [(a, a + rnd.randint(1, 9)) for a in (rnd.randrange(60) for _ in range(rnd.randint(1, 12)))]
    df = spark.createDataFrame([(d, a, b) for d, p in docs.items() for a, b in p], "doc_id long, start long, stop long")
    for r in decontam._spans(df, ["doc_id"]).collect():
        covered, want = sorted({k for a, b in docs[r["doc_id"]] for k in range(a, b)}), []
        for k in covered:
            if want and want[-1][1] == k:
                want[-1][1] = k + 1
            else:
                want.append([k, k + 1])
        assert [[s["start"], s["stop"]] for s in r["spans"]] == want


CHANGES = "seq long, op string, doc_id long, source string, lang string, tokenizer string, tokens long"


def test_two_writers_of_one_state(spark, monkeypatch):
    """A second writer commits between the first one's reading and its claim: the first
    computes its batch again against the new state."""
    state = rollup.Rollup(spark)
    frame = lambda *rows: spark.createDataFrame([(0, op, d, "s", "en", "t", n) for op, d, n in rows], CHANGES)
    state.commit(1, frame(("insert", 1, 10), ("insert", 2, 20)))
    other = rollup.Rollup(spark, state.path)
    real, calls = rollup.Rollup._append, []

    def late(self, log, batch, rows):
        calls.append(batch)
        if calls == [2]:
            assert other.commit(3, frame(("revise", 1, 11)))
        return real(self, log, batch, rows)

    monkeypatch.setattr(rollup.Rollup, "_append", late)
    assert state.commit(2, frame(("delete", 1, 0), ("revise", 2, 21)))
    assert calls == [2, 3, 2] and state.committed() == [1, 2, 3]
    assert [tuple(r) for r in state.totals().collect()] == [("s", "en", "t", 1, 21)]
    assert not state.commit(2, frame(("insert", 9, 9)))


def test_compaction_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(rollup, "COMPACT", 3)
    rnd, state, want = random.Random(6), rollup.Rollup(spark), {}
    for batch in range(8):
        rows = []
        for d in rnd.sample(range(12), 5):
            op, n = rnd.choice(["insert", "revise", "delete"]), rnd.randrange(50)
            rows.append((0, op, d, "s", "en", "t", n))
            want.pop(d, None)
            if op != "delete":
                want[d] = n
        state.commit(batch, spark.createDataFrame(rows, CHANGES))
    assert sum(r["batch"] is None for r in state._log()) > 1 and state.committed() == list(range(8))
    assert {int(r["doc_id"]): r["tokens"] for r in state.current().collect()} == want
    assert [tuple(r)[3:] for r in state.totals().collect()] == [(len(want), sum(want.values()))]
    assert not state.commit(3, spark.createDataFrame([], CHANGES))
