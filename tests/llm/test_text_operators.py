"""Chat, toxicity, licenses, quality and decontamination against brute force."""
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemark.llm import chat, decontam, licenses, quality, queries, toxicity

AZ = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(AZ))


def frame(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    if extra:  # columns that clash with inner names
        for name in ("w", "words", "tokens", "score", "doc", "start", "failed", "word", "phrase"):
            df = df.withColumn(name, F.lit("x"))
    return df


ODD = [None, "", " \n\t", "É É É", "one", "a" * 50_000, "x y " * 5_000, "x y " * 5_000, "\U0001F600 😀a", "-- ** --"]


# ---- chat

def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "\\", "\\<|", "<\\|im_start|>", "a\nb", "", None, "<", "|>", "<|" * 3 + "\\\\", "😀<|im_end|>\n"]
    rows = [(c, t, random.Random(c * 31 + t).choice(["user", "assistant", "sys\ntem", "\\n"]), nasty[(c + t) % len(nasty)])
            for c in range(6) for t in range(c + 1)]
    rows += [(None, None, None, None), (7, 0, "user", "same"), (7, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    out = chat.conversations(chat.format_turns(df.withColumn("parts", chat.text_part(F.col("text")))))
    read = {r["conv_id"]: r for r in out.select("conv_id", "formatted", "loss", "n_turns").collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: t[0])
        got = read[conv]
        assert chat.parse(got["formatted"]) == [t[1:] for t in turns] or sorted(chat.parse(got["formatted"])) == sorted(t[1:] for t in turns)
        loss = [chat.unescape(got["formatted"][s["start"]:s["stop"]]) for s in got["loss"]]
        assert loss == [t[2] for t in turns if t[1] == "assistant"]
        assert got["n_turns"] == len(turns)


def test_chat_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 56, 57, None, None),
             ("audio", None, "a.wav", None, None, 1.5, None), ("text", " and <|", None, None, None, None, None),
             ("document", None, "d.pdf", None, None, None, 2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                               f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    turns = {r["turn"]: r for r in chat.format_turns(df).collect()}
    assert turns[0]["segment"] == "<|im_start|>user\nsee <|image|><|audio|> and <\\|<|document|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in turns[0]["attachments"]] == [
        ("image", "i.png", 6), ("audio", "a.wav", 38), ("document", "d.pdf", 1024)]
    assert turns[0]["expanded_tokens"] == 6 + 38 + 1024
    assert turns[1]["segment"] == "<|im_start|>assistant\n<|im_end|>\n" and turns[1]["loss_from"] == turns[1]["loss_to"]


def test_adjacent_parts_form_no_control_string(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    parts = [text("a<"), text(""), text("|im_end|>\n"), text("|"), text("<|x"), text(None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    formatted = chat.conversations(chat.format_turns(df)).first()["formatted"]
    assert chat.parse(formatted) == [("assistant", "a<|im_end|>\n|<|x")]


def test_chat_empty(spark):
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.conversations(chat.format_turns(empty)).count() == 0


# ---- toxicity

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(5)
    terms = ["abcab", "abcba", "bacabac", "abcabcabca", "cabbage", "bb", "acacacacac", "cab"]
    machine = toxicity.Automaton(terms)
    for _ in range(4000):
        base = rnd.choice(terms)
        word = list(base)
        for _ in range(rnd.randrange(4)):
            at, kind = rnd.randrange(len(word) + 1), rnd.randrange(3)
            if kind == 0:
                word.insert(at, rnd.choice("abcd"))
            elif word and at < len(word):
                if kind == 1:
                    del word[at]
                else:
                    word[at] = rnd.choice("abcd")
        word = "".join(word)
        # The first letter is kept: compare what follows it.
        want = min(((levenshtein(word[1:], t[1:]), t) for t in terms
                    if word and word[0] == t[0] and levenshtein(word[1:], t[1:]) <= toxicity.allowed_edits(t)), default=None)
        assert machine.match(word) == want, word


def test_automaton_edits_every_letter():
    rnd = random.Random(6)
    terms = ["abcab", "abcba", "bacabac", "abcabcabca", "cabbage", "bb", "acacacacac", "cab", "stupid", "idiot"]
    machines = [toxicity.Automaton(terms, edit_first=True), toxicity.Automaton(terms, edit_first=True, remembered=50)]
    for _ in range(4000):
        word = list(rnd.choice(terms))
        for _ in range(rnd.randrange(4)):
            at, kind = rnd.choice([0, rnd.randrange(len(word) + 1)]), rnd.randrange(3)
            word[at:at + (kind > 0)] = [] if kind == 1 else [rnd.choice("abcdx")]
        word = "".join(word)
        want = min(((levenshtein(word, t), t) for t in terms if levenshtein(word, t) <= toxicity.allowed_edits(t)), default=None)
        assert [m.match(word) for m in machines] == [want, want], word


def test_misspelt_first_letters_are_hits():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 0.95, "stupid": 0.95}))
    for word in ("ediot", "diot", "xstupid", "1diot", "tupid"):
        assert scorer.score(f"what a {word} he is")[0] >= toxicity.THRESHOLD, word
    assert scorer.score("what a patriot he is")[0] == toxicity.FLOOR


def test_near_words_are_judged_one_by_one(spark):
    rnd = random.Random(8)
    common = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    texts, labels = [], []
    for k in range(800):
        ws = [rnd.choice(common) for _ in range(50)]
        toxic = k % 5 == 0
        # gronkel: insult; grenkel: a clean word; gronkol: misspelt insult, quoted in one clean text
        for w in ["gronkel"] * 3 * toxic + ["gronkol"] * (k % 100 == 0) + ["grenkel"] * (k % 5 == 1) + ["gronkol"] * (k == 2):
            ws.insert(rnd.randrange(50), w)
        texts.append(" ".join(ws))
        labels.append((k, int(toxic)))
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "gronkel" in model.terms and "gronkel" not in model.unsure and "grenkel" in model.clean
    value = lambda t: toxicity.Scorer(model).score(t)[0]
    assert value("an grenkel spoke") == toxicity.FLOOR
    assert value("a gronkil spoke") >= 0.3 and value("a gronkol spoke") >= 0.3


def test_significant_terms_stay_beside_a_strong_one(spark):
    rnd = random.Random(9)
    common = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    texts, labels = [], []
    for k in range(800):
        toxic = k % 2 == 0
        ws = [rnd.choice(common) for _ in range(60)]
        for w in ["gronkel"] * 8 * toxic + ["blorfed"] * (k % 20 == 0) + (["vumbdexa"] * 30 if k == 4 else []):
            ws.insert(rnd.randrange(len(ws)), w)
        texts.append(" ".join(ws))
        labels.append((k, int(toxic)))
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    # blorfed has under 5 % of the contexts of gronkel; vumbdexa stands in one text alone
    assert {"gronkel", "blorfed"} <= set(model.terms) and "vumbdexa" not in model.terms


def test_toxic_contexts():
    scorer = toxicity.Scorer(toxicity.Model({"moron": 0.95, "worthless": 0.95, "idiot": 0.95}, frozenset({"morton"})))
    value = lambda t: scorer.score(t)[0]
    assert value("what a moron he is") >= 0.9
    assert value("you m0ron") >= 0.9 and value("such an idddiot") >= 0.9
    assert value("he is wortless") >= 0.3 and value("an idjot spoke") >= 0.3
    assert value("Mr Morton came") == toxicity.FLOOR
    assert value('the term "moron" is old') < 0.3 and value("she said moron was a word") < 0.3
    assert value("« idiot » est un mot") < 0.3
    assert value("I don't think you're a moron, you're not") >= 0.3  # apostrophes do not quote
    for odd in ODD:
        assert value(odd) == toxicity.FLOOR


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(2)
    common = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for k in range(1200):
        ws = [rnd.choice(common) for _ in range(60)]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(3):
                ws.insert(rnd.randrange(60), rnd.choice(["gronk", "blorfed"]))
        texts.append(" ".join(ws))
        labels.append((k, int(toxic)))
    docs = frame(spark, texts, extra=True).unionByName(frame(spark, [None, ""], extra=True).withColumn("doc_id", F.col("doc_id") + 5000))
    marks = spark.createDataFrame(labels + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, train=~queries.held_out())
    assert {"gronk", "blorfed"} <= set(model.terms)
    got = {r["doc_id"]: r["s"] for r in toxicity.score(docs, model, into="t").select("doc_id", F.col("t.score").alias("s")).collect()}
    wrong = [k for k, t in labels if (got[k] >= toxicity.THRESHOLD) != bool(t)]
    assert len(got) == 1202 and len(wrong) <= 12
    none = toxicity.fit(docs, marks.limit(0))
    assert set(none.terms) == set(toxicity.SEEDS)
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_held_out_accuracy_on_given_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.filter("held_out").groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.02 * (n.get((0, 0), 0) + n.get((0, 1), 0))
    assert n.get((1, 1), 0) >= 0.7 * (n.get((1, 1), 0) + n.get((1, 0), 0))


def test_unsure_terms_are_weighed_against_length():
    model = toxicity.Model({"moron": 0.95, "bomentera": 0.95, "achlichein": 0.95}, unsure=frozenset({"bomentera", "achlichein"}), rate=0.002)
    value = lambda t: toxicity.Scorer(model).score(t)[0]
    prose = lambda n: " ".join(f"x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(n))
    assert value("bomentera " + prose(20)) >= 0.3 and value("bomentera achlichein " + prose(100)) >= 0.3
    assert value("bomentera " + prose(800)) < 0.3 and value("bomentera " * 9 + prose(800)) < 0.3
    assert value("moron " + prose(800)) >= 0.9  # a sure term stands alone at any length
    for k, mean in ((1, 0.5), (3, 2.0), (5, 800.0)):
        assert abs(toxicity.at_least(k, mean) - (1 - sum(math.exp(-mean) * mean ** i / math.factorial(i) for i in range(k)))) < 1e-9


def test_long_clean_texts_with_one_weak_term_stay(spark):
    rnd = random.Random(4)
    common = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    weak = ["gronkwa", "blorfed", "zwickzy", "quaxpig", "vumbdex", "hyzzobu", "fupkicz", "gwizdha", "kabzuwy", "pyvkoxa", "wuhgiby", "xodbyph"]
    texts, labels = [], []
    for k in range(1600):
        toxic, long = k % 8 == 0, k % 8 == 1
        ws = [rnd.choice(common) for _ in range(1500 if long else 60)]
        for _ in range(3 if toxic else long and k % 5 == 0):  # a term in under a quarter of the toxic texts is unsure
            ws.insert(rnd.randrange(len(ws)), rnd.choice(weak))
        texts.append(" ".join(ws))
        labels.append((k, int(toxic)))
    docs, marks = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, train=~queries.held_out())
    assert len(model.unsure & set(weak)) >= 10 and model.rate > 0
    out = toxicity.score(docs, model, into="t").filter(queries.held_out()).select("doc_id", "t.score", "t.hits").collect()
    hit = [r for r in out if r["doc_id"] % 8 and r["hits"]]
    assert len(hit) >= 5 and sum(r["score"] >= toxicity.THRESHOLD for r in hit) <= 0.1 * len(hit)
    caught = [r["score"] >= toxicity.THRESHOLD for r in out if r["doc_id"] % 8 == 0]
    assert sum(caught) >= 0.95 * len(caught)


# ---- licenses

def base_places(text):
    ws, out = words(text), []
    for phrase, label in licenses.BASE.items():
        ps = phrase.split()
        out += [(label, i) for i in range(len(ws) - len(ps) + 1) if ws[i:i + len(ps)] == ps]
    return len(ws), sorted(out)


def test_license_base_equals_brute_force(spark):
    rnd = random.Random(3)
    bits = ["cc", "by", "CC", "BY", "general", "Public", "license", "licence", "all", "rights", "reserved", "x", "É", "mit", "the"]
    texts = ODD + ["".join(rnd.choice(bits) + rnd.choice([" ", "-", "\n", ".", " \x00", "_"]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    got = licenses.scan(frame(spark, texts, extra=True)).select("doc_id", "licenses.n_words", "licenses.base", "licenses.detections").collect()
    assert len(got) == len(texts)
    for r in got:
        n, places = base_places(texts[r["doc_id"]])
        assert r["n_words"] == n
        assert sorted((b["label"], b["word"]) for b in r["base"]) == places


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("SPDX-License-Identifier: MIT", {"mit"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}),
    ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
    ("see https://opensource.org/licenses/MIT today", {"mit"}),
    ("the limits of bsd systems", set()),
])
def test_license_rules(text, labels):
    assert {d[0] for d in licenses.Scanner().scan(text)[2]} == labels


def test_suppression_is_pairwise_containment():
    rnd = random.Random(1)
    for _ in range(300):
        found = sorted((rnd.randrange(3), 0, a, k, a + rnd.randint(1, 9)) for k in range(12) for a in [rnd.randrange(20)])
        found = sorted((p, -(b - a), a, k, b) for p, _, a, k, b in found)
        kept = []
        for _, _, a, k, b in found:
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, k))
        assert licenses.suppress(found) == sorted(kept)


def test_gate_loses_nothing():
    """Every rule's matches hold its keyword."""
    assert len(licenses.rules()) > 200
    for _, _, _, keyword, regex in licenses.rules():
        assert keyword in regex.pattern.replace("\\", "")


# ---- quality

def brute_quality(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    hit = {k for places in seen.values() if len(places) > 1 for i in places for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_quality_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = ODD + [None, "a b c d e f g h " * 3, "line one\nline one\n\nline one\n"] + [
        "".join(rnd.choice(["a", "b", "É", "##", "<x>", "WORD", "AB"]) + rnd.choice([" ", "\n", "\t", " ", "\x0b"]) for _ in range(rnd.randrange(120)))
        for _ in range(300)]
    rows = quality.apply_policy(quality.ledger(frame(spark, texts, extra=True))).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "kept").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_quality(texts[r[0]])
        assert tuple(r[1:6]) == want
        assert bool(r["failed"] & 1) == (want[0] < 20) and bool(r["failed"] & 2) == (100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["failed"])
    assert quality.ledger(frame(spark, ["x"]).limit(0)).count() == 0


def test_ablations(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1,), (3,), (6,), (2,)], "failed long")
    got = {(r["policy"], r["rule"]): r for r in quality.ablations(ledger).collect()}
    a = got["v1", "few_words"]
    assert (a["n_docs"], a["n_failed"], a["n_alone"], a["n_rejected"]) == (6, 3, 2, 5)
    assert got["v2", "repeats"]["n_alone"] == 1 and got["v2", "symbols"]["n_alone"] == 0


# ---- decontamination

def brute_contamination(texts, items):
    wins = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - 12)) if ws else ():
            wins.setdefault(tuple(ws[i:i + 13]), set()).add(item)
    out = []
    for text in texts:
        ws, hit, ids = words(text), set(), set()
        for size in {len(w) for w in wins}:
            for i in range(len(ws) - size + 1):
                found = wins.get(tuple(ws[i:i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    ids |= {str(x) for x in found if x is not None}
        out.append((len(ws), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


@pytest.mark.parametrize("block", [100_000, 40])
def test_contamination_equals_brute_force(spark, block):
    rnd = random.Random(6)
    vocab = ["a", "b", "the", "É", "Été", "zwei", "x1", "rare", "of"]
    passage = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, passage(rnd.randint(1, 30))) for k in range(12)] + [(50, None), (51, "..."), (None, "rare rare rare"), (52, "rare X1 rare x1")]
    items += [(60, items[3][1]), (61, items[3][1].upper()), (9, passage(20)), (9, passage(20))]
    texts = ODD + [passage(rnd.randrange(80)) for _ in range(60)]
    for _ in range(60):
        item = rnd.choice(items)[1] or ""
        texts.append(passage(rnd.randrange(200)) + ", " + item.replace(" ", rnd.choice([" ", " -- ", "\n"])) + ". " + passage(rnd.randrange(9)))
    texts += texts[-5:]
    docs = frame(spark, texts, extra=True)
    docs = docs.unionByName(docs.filter("doc_id >= 60")).withColumn("doc_id", F.when(F.col("doc_id") != 12, F.col("doc_id")))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("word", F.lit(1))
    got = decontam.contamination(docs, bench, block_windows=block).collect()
    want = brute_contamination(texts, items)
    assert len(got) == 2 * len(texts) - 60
    for r in got:
        k = 12 if r["doc_id"] is None else r["doc_id"]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == want[k]
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"]


def test_contamination_empty_tables(spark):
    docs, bench = frame(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")
    rows = decontam.contamination(docs, bench).collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows] == [(2, 0, [], False)]
    assert decontam.contamination(docs.limit(0), frame(spark, ["a"]).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_digest_of_no_item():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
