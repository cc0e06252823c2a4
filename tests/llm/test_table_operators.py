"""SimHash groups, packing, shards, rollups, revisits and the pipeline against brute force."""
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pagemark.llm import packing, queries, rollup, sharding, simhash, tokens, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n", "one", "a b c", "a b c d", "É é", "x " * 30_000, "x " * 30_000, "x " * 30_000]


def frame(spark, texts, extra=True):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if extra:
        for name in ("fingerprint", "root", "hash", "shard", "ids", "start", "node", "a", "b", "text_key"):
            df = df.withColumn(name, F.lit("x"))
    return df


# ---- SimHash

def brute_print(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    label = {v: v for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in combinations(sorted(set(values)), 2):
        if (a ^ b).bit_count() <= bits:
            label[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in label}


def test_fingerprints():
    rnd = random.Random(1)
    for text in ODD[:7] + ["".join(rnd.choice("ab É\n\tXY ") for _ in range(300)) for _ in range(40)]:
        assert simhash.fingerprint(text) == brute_print(text)


def cluster(rnd, n, flips):
    base = rnd.getrandbits(64)
    out = {base}
    while len(out) < n:
        v = rnd.choice(list(out)[-20:])
        for _ in range(rnd.randint(1, flips)):
            v ^= 1 << rnd.randrange(64)
        out.add(v)
    return out


def test_trie_forest_equals_all_pairs():
    rnd = random.Random(7)
    values = set(rnd.getrandbits(64) for _ in range(200)) | cluster(rnd, 150, 5) | cluster(rnd, 100, 3) | {0, 1, (1 << 64) - 1}
    array = np.array(sorted(values), dtype=np.uint64)
    for bits in (0, 1, 4):
        edges = simhash.trie_forest(array, np.zeros(len(array), dtype=np.int64), bits)
        pairs = [(int(array[i]), int(array[j])) for a, b in edges for i, j in zip(a, b)]
        assert all((a ^ b).bit_count() <= bits for a, b in pairs)
        want = brute_components(values, bits)
        label = {v: v for v in values}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x
        for a, b in pairs:
            label[max(find(a), find(b))] = min(find(a), find(b))
        assert {v: find(v) for v in values} == want
        assert len(pairs) == len(values) - len(set(want.values()))  # a forest


@pytest.mark.parametrize("cell_limit", [1 << 15, 20])
def test_classes_equal_all_pairs(spark, cell_limit):
    rnd = random.Random(9)
    values = sorted(cluster(rnd, 150, 4) | cluster(rnd, 80, 6) | {rnd.getrandbits(64) for _ in range(150)} | {0, 1})
    rows = [(k, 0, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)]
    rows += [(1000 + k, 1, r[2]) for k, r in enumerate(rows[:100])] + [(None, 2, rows[0][2]), (-5, 3, rows[-1][2])]
    prints = spark.createDataFrame(rows, "doc_id long, text_key long, fingerprint long")
    got = simhash.classes(prints, cell_limit=cell_limit).select("fingerprint", "component_id").collect()
    assert len(got) == len(rows)
    unsigned = lambda v: v % (1 << 64)
    want = brute_components([unsigned(r[2]) for r in rows], 4)
    least = {}
    for d, _, v in rows:
        if d is not None:
            least[want[unsigned(v)]] = min(d, least.get(want[unsigned(v)], d))
    assert all(r["component_id"] == least[want[unsigned(r["fingerprint"])]] for r in got)


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_near_duplicates_and_keep_one(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(50)) for _ in range(200)) for _ in range(20)]
    texts = ODD + base + base[:5] + [t + " z9" for t in base[5:10]]
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id IN (3, 12)"))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    prints = {k: brute_print(t) for k, t in enumerate(texts)}
    want = brute_components(list(prints.values()), 4)
    least = {}
    for k in sorted(prints):
        least.setdefault(want[prints[k]], k)
    for r in rows:
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]]
        assert r["component_id"] == least[want[prints[r["doc_id"]]]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


# ---- packing

def best_cost(positions, penalties, capacity):
    """All transitions."""
    cost = [0] + [10 ** 9] * (len(positions) - 1)
    for j in range(1, len(positions)):
        cost[j] = min(cost[i] + capacity - (positions[j] - positions[i]) + penalties[j]
                      for i in range(j) if positions[j] - positions[i] <= capacity)
    return cost[-1]


def test_dynamic_programme_is_optimal():
    rnd = random.Random(2)
    for _ in range(60):
        steps = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 60))]
        positions = np.concatenate(([0], np.cumsum(steps)))
        penalties = np.array([0] + [rnd.choice([0, 2, 8]) for _ in steps])
        cuts = packing.best_cuts(positions, penalties, 40)
        assert cuts[0] == 0 and cuts[-1] == positions[-1] and (np.diff(cuts) <= 40).all()
        index = np.searchsorted(positions, cuts[1:])
        assert sum(40 - np.diff(cuts)) + penalties[index].sum() == best_cost(positions.tolist(), penalties.tolist(), 40)


@pytest.mark.parametrize("capacity, block", [(1024, 1 << 18), (64, 256)])
def test_pieces_restore_every_document(spark, capacity, block):
    texts = ODD + ["A sentence here. Another one! " * 40, "no stop " * 700, "<|endoftext|> \x00 日本語。ok", "tail"]
    docs = frame(spark, texts).repartition(3, "doc_id")
    pieces = packing.pack(docs, capacity=capacity, block=block)
    rows = pieces.collect()
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(tokens.default_paths()[0])
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for k, text in enumerate(texts):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[k], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], dtype="<u4") for r in parts]).tolist() == ids
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
        assert all(r["doc_tokens"] == len(ids) for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
        assert sum(r["length"] for r in parts) <= capacity
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole.values()) and set(whole) == set(by_sequence)
    assert packing.pack(docs.limit(0)).count() == 0


def test_padding_is_little(spark):
    rows = queries.op9_pack(spark, "/root/testdata/sf0.01").groupBy("sequence_id").agg(F.sum("length").alias("n"))
    used, sequences = rows.agg(F.sum("n"), F.count("*")).first()
    assert used >= 0.985 * 1024 * sequences


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, "\t" * tokens.LONG_RUN, " " * (tokens.LONG_RUN - 1)],
                         ids=["blanks", "lines", "tabs", "shorter"])
def test_token_ids_of_long_runs(run):
    from tokenizers import Tokenizer
    paths = tokens.default_paths()
    text = f"a{run}b"
    assert tokens.encode(text, *paths) == Tokenizer.from_file(paths[0]).encode(text, add_special_tokens=False).ids


def test_crc_of_ids(spark):
    row = packing.pack(frame(spark, ["hello"])).withColumn("crc", F.crc32("ids")).first()
    assert row["crc"] == zlib.crc32(row["ids"])


# ---- shards

def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > mid:
                used, fill = used + 1, 0
            fill += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("first, opened", [(12, 2048), (2, 3)])
def test_cut_points_are_minimax(spark, monkeypatch, first, opened):
    monkeypatch.setattr(sharding, "FIRST", first)
    monkeypatch.setattr(sharding, "OPEN", opened)
    rnd = random.Random(first)
    groups = sorted({rnd.getrandbits(64) - (1 << 63): rnd.choice([8, 20, 300, 4000]) for _ in range(700)}.items())
    df = spark.createDataFrame(groups, "hash long, bytes long").cache()
    for shards in (1, 3, 24):
        cuts, capacity = sharding.cut_points(df, shards)
        assert capacity == least_capacity([g[1] for g in groups], shards)
        loads = [0] * (len(cuts) + 1)
        for h, size in groups:
            loads[sum(h >= c for c in cuts)] += size
        assert len(loads) <= shards and max(loads) <= capacity


def test_assign(spark):
    rnd = random.Random(8)
    texts = ODD + ["t" * rnd.randrange(400) for _ in range(400)] + ["hot text " * 3] * 300
    docs = frame(spark, texts)
    rows = sharding.assign(docs, 24).collect()
    assert len(rows) == len(texts)
    where, slots = {}, {}
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text)
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in where.values()) and set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(docs.limit(0)).count() == 0


def test_shards_are_near_equal(spark):
    loads = [r["s"] for r in queries.op6_minimax_shards(spark, "/root/testdata/sf0.1").groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(loads) == 24 and max(loads) <= 1.02 * sum(loads) / 24


# ---- rollup

CHANGE = "seq long, op string, doc_id long, source string, lang string, tokenizer string, tokens long"


def test_rollup(spark, tmp_path):
    state = rollup.Rollup.create(spark, str(tmp_path / "r"))
    assert state.totals().count() == 0
    change = lambda *rows: spark.createDataFrame(list(rows), CHANGE).withColumn("sign", F.lit("x"))
    totals = lambda: {tuple(r)[:3]: (r["documents"], r["tokens"]) for r in state.totals().collect()}
    first = change((0, "insert", 1, "a", "en", "v1", 10), (0, "insert", 2, "a", "en", "v1", 5), (1, "revise", 2, "a", "en", "v1", 7),
                   (0, "insert", 3, None, None, "v1", None), (0, "insert", None, "a", "en", "v1", 99), (0, "insert", 1, "a", "en", "v2", 11))
    assert state.commit(1, first) and not state.commit(1, first)
    assert totals() == {("a", "en", "v1"): (2, 17), (None, None, "v1"): (1, 0), ("a", "en", "v2"): (1, 11)}
    second = change((0, "delete", 1, "a", "en", "v1", None), (0, "revise", 2, "b", "en", "v1", 3), (0, "delete", 77, "a", "en", "v1", None),
                    (0, "insert", 3, "c", "fr", "v1", 4), (0, "insert", 3, "c", "fr", "v1", 4))
    assert state.commit(2, second) and not state.commit(2, second)
    want = {("b", "en", "v1"): (1, 3), ("c", "fr", "v1"): (1, 4), ("a", "en", "v2"): (1, 11)}
    assert totals() == want
    # A batch that died before it was recorded leaves files that nothing reads, and is run again.
    change((0, "insert", 8, "z", "en", "v1", 1)).limit(0).select(
        F.lit("8").alias("doc_id"), "source", "lang", "tokenizer", "tokens", F.lit(1).alias("sign")).write.parquet(f"{state.path}/ledger/batch=3")
    assert totals() == want
    assert state.commit(3, change((0, "insert", 8, "z", "en", "v1", 1))) and state.commit(4, change().limit(0))
    assert totals() == want | {("z", "en", "v1"): (1, 1)}
    assert rollup.Rollup(spark, state.path).committed() == [1, 2, 3, 4]


def test_rollup_query_equals_brute_force(spark):
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(tokens.default_paths()[0])
    size = lambda t: len(reference.encode(t or "", add_special_tokens=False).ids)
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        slot = zlib.crc32(str(r["doc_id"]).encode()) % 10
        for version, n in (("byte_bpe_50k", None if slot == 7 else size(r["text"].upper() if slot == 3 else r["text"])),
                           ("byte_bpe_50k_end", size(r["text"]) + 1)):
            if n is not None:
                d, t = want.get((r["source"], r["lang"], version), (0, 0))
                want[r["source"], r["lang"], version] = d + 1, t + n
    got = queries.op3_token_rollup(spark, SF).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in got} == want


# ---- revisits

RECORD = "record_id long, url string, ts long, status int, headers map<string,string>, digest string"


def test_revisits(spark):
    rows = [
        (1, "HTTP://Example.com:80/a?b=2&a=1&utm_source=x#f", 100, 200, {"ETag": '"1"', "Content-Type": "t", "Cache-Control": "old"}, "d1"),
        (2, "http://example.com/a?a=1&b=2", 200_000, 200, {"ETag": '"2"', "Last-Modified": "m"}, "d2"),
        (3, "http://example.com/a?a=1&b=2", 150, 304, {"etag": 'W/"1"', "cache-control": "new", "content-type": "no"}, None),
        (4, "http://example.com/a?a=1&b=2", 300_000, 304, {"etag": '"1"'}, None),
        (5, "http://example.com/a?a=1&b=2", 100, 304, {"etag": '"1"'}, None),
        (6, "http://example.com/a?a=1&b=2", 400_000, 304, {"last-modified": "m"}, None),
        (7, "http://example.com/a?a=1&b=2", 400_000, 304, None, "d2"),
        (8, None, 1, 304, None, None), (9, "http://example.com/a?a=1&b=2", None, 304, {"etag": '"2"'}, None),
        (10, "http://example.com", 5, 200, {"ETag": '"x"', "etag": '"y"'}, None), (11, "http://example.com/", 5, 200, {"ETag": '"z"'}, None),
        (12, "http://example.com/#top", 6, 304, {"ETag": '"z"'}, None), (12, "http://example.com/#top", 6, 304, {"ETag": '"z"'}, None)]
    df = spark.createDataFrame(rows, RECORD).withColumn("key", F.lit(1)).withColumn("bucket", F.lit("x"))
    for bucket in (10, 86_400, 10 ** 9):
        got = warc.resolve(df, bucket_seconds=bucket).collect()
        assert len(got) == 9
        by = {r["record_id"]: r for r in got}
        assert {k: (r["outcome"], r["response_id"]) for k, r in by.items()} == {
            3: ("resolved", 1), 4: ("validator_mismatch", None), 5: ("no_response", None), 6: ("resolved", 2), 7: ("resolved", 2),
            8: ("no_response", None), 9: ("no_response", None), 12: ("resolved", 11)}
        assert by[3]["headers"] == {"etag": 'W/"1"', "content-type": "t", "cache-control": "new"}
    assert warc.resolve(df.limit(0)).count() == 0


# ---- pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "simhash near-dedup", "benchmark decontamination", "packing"]
    kept = lambda df: {r["doc_id"] for r in df.collect()}
    from test_text_operators import brute_contamination, brute_quality

    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept(current)
        out = stage(spark, current, SF).cache()
        assert out.columns == docs.columns and out.count() == len(kept(out)) and kept(out) <= before
        if name == "toxicity":
            scored = queries.op2_toxicity(spark, SF).collect()
            assert kept(out) == {r["doc_id"] for r in scored if r["score"] < 0.3}
        elif name == "quality rules":
            for k in kept(out):
                n, _, _, _, again = brute_quality(rows[k])
                assert n >= 20 and 100 * again <= 30 * n
        elif name.startswith("simhash"):
            prints = {k: brute_print(rows[k]) for k in before}
            want, least = brute_components(list(prints.values()), 4), {}
            for k in sorted(prints):
                least.setdefault(want[prints[k]], k)
            assert kept(out) == set(least.values())
        else:
            items = [(r["item_id"], r["text"]) for r in bench.collect()]
            order = sorted(before)
            bad = {k for k, r in zip(order, brute_contamination([rows[k] for k in order], items)) if r[3]}
            assert kept(out) == before - bad
        current = out
    final = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == kept(current)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_keeps_odd_rows_defined(spark):
    """Nulls in any column, repeated rows and clashing columns do not crash a stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = docs.limit(2).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"),
                               F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    empty = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)
    table = docs.unionByName(odd).unionByName(empty).unionByName(docs.limit(4)).withColumn("score", F.lit(1)).withColumn("failed", F.lit(1))
    current = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SF)
        assert current.columns == table.columns
    assert corpus_pipeline.STAGES[-1][1](spark, current, SF).count() >= 1
