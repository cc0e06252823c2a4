"""Toxic-term scoring: Levenshtein automata intersected with a lexicon trie.

``fit`` learns a lexicon from a bounded sample of labelled rows: a word counts
once per following word, so a family of near copies weighs little, and enters
the lexicon by its log-likelihood ratio between the classes. ``score`` runs
every word of every whole text through one automaton: the product of the
lexicon trie with the Levenshtein automata of its terms, determinised lazily,
so most words die after a few characters. Runs of a letter and digits written
for letters are folded first. All letters of a word can be edited, the first one
too. A near-miss that the clean sample uses is judged by its own class counts: it
is taken for a misspelling only if the toxic share of its rates reaches ``SHARE``.

A learned term is sure if it stands in ``SURE`` times as many of the toxic texts
as of the clean ones, counting ``UNSEEN`` clean texts more than were seen. Hits
of other terms are weighed against the text's length: by the chance that a clean
text with so many distinct words holds as many distinct words of the kind. The
rate behind it is that of the clean sample's texts that hold any, where a
near-miss counts unless another clean text uses it too.

Each hit gets a context-window score: quotation marks around it or a reporting
word before it mean mention and weigh ``QUOTED``; a second-person word nearby
means address and raises it. Abusive hits combine as independent evidence;
quoted ones only count their largest. Only the text is an input of a score.

Null, empty and blank texts score ``FLOOR``. Repeated rows score alike. Empty
tables give empty results; with no usable label the model holds the seed terms
alone. The score is added as one struct column under a name of the caller's.
"""
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagemark.llm.common import WORD, lower_az, words

SAMPLE_ROWS = 4000   # labelled rows of each class that fit() reads at most
THRESHOLD = 0.3
FLOOR = 0.01
QUOTED = 0.2
ADDRESSED = 1.25
EDIT_WEIGHT = (1.0, 0.75, 0.6)
SHARE = 0.9          # toxic share of a word's rates that a term or a near-miss in clean texts needs
SEED_WEIGHT = 0.38
LEAST = 4            # following words and toxic texts that a term needs, whatever the sample's size
SURE = 100           # times as many toxic as clean texts that make one hit enough
UNSEEN = 3           # clean texts that may hold a term although the sample has none
CHANCE = 0.1         # unsure hits that clean texts of the length hold so often weigh nothing
# Common insults that need no label.
SEEDS = ("asshole", "bastard", "bitch", "dickhead", "dumbass", "fuckwit", "idiot", "imbecile", "moron", "scumbag", "wanker")
REPORTING = frozenset("said says called calls quote quoted quotes quoting word words term insult insults slur slurs "
                      "wrote writes titled entitled dijo palabra insulto dit mot insulte sagte wort zitat".split())
ADDRESS = frozenset("you your youre u ur yourself du dich dein ihr tu toi vous ton tú eres usted vosotros".split())
_OPEN = "\"“„«‹‘'"
_CLOSE = "\"”“»›’'"

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AZ = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_FOLD = str.maketrans("013457", "oieast")
_RUN = re.compile(r"(.)\1{2,}")
_DIGIT = re.compile("[0-9]")


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_AZ)


def at_least(k: int, mean: float) -> float:
    """Chance of ``k`` or more where ``mean`` are expected (Poisson)."""
    if k <= 0 or mean <= 0:
        return float(k <= 0)
    return max(0.0, 1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k)))


@dataclass
class Model:
    terms: dict[str, float]
    clean: frozenset = field(default_factory=frozenset)    # near-misses that are words of clean texts
    unsure: frozenset = field(default_factory=frozenset)   # terms weighed against the text's length
    rate: float = 0.0  # distinct words that hit them per distinct word of a clean text


class Automaton:
    """Product of the term trie and Levenshtein automata, determinised lazily.
    A state maps trie nodes to the fewest edits that reach them. ``edit_first``:
    first letters are edited like the others, else they must be equal. When the
    states hold more than ``remembered`` entries, they are built anew."""

    def __init__(self, terms, edit_first: bool = False, remembered: int = 1 << 18):
        self.edit_first, self.remembered = edit_first, remembered
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget = [0]  # most edits allowed to any term below the node
        for term in terms:
            node, edits = 0, allowed_edits(term)
            self.budget[0] = max(self.budget[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            self.term[node] = term
        self.alphabet = {c for kids in self.children for c in kids}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.content: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.entries = 0
        self.start = self._intern({0: 0})

    def _intern(self, nodes: dict[int, int]) -> int:
        todo = [x for x in nodes.items() if x[0] or self.edit_first]
        while todo:  # a term letter left out of the word costs one edit
            node, edits = todo.pop()
            if nodes[node] < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.budget[child] and edits + 1 < nodes.get(child, 9):
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.content)
            self.content.append(nodes)
            self.entries += len(nodes)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] and e <= allowed_edits(self.term[n])]
            self.accepts.append(min(ends) if ends else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        nxt: dict[int, int] = {}
        for node, edits in self.content[state].items():
            if (node or self.edit_first) and edits + 1 <= self.budget[node] and edits + 1 < nxt.get(node, 9):
                nxt[node] = edits + 1  # a letter too many
            for letter, child in self.children[node].items():
                if not node and letter != c and not self.edit_first:
                    continue
                cost = edits + (letter != c)
                if cost <= self.budget[child] and cost < nxt.get(child, 9):
                    nxt[child] = cost
        return self._intern(nxt)

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within its allowed edits."""
        if self.entries > self.remembered:
            self._forget()
        state = self.start
        for c in word:
            if c not in self.alphabet:
                c = ""
            moves = self.moves[state]
            if c not in moves:
                moves[c] = self._step(state, c)
            state = moves[c]
            if state < 0:
                return None
        return self.accepts[state]


class Scorer:
    """Scores texts with one model; remembers the verdicts of frequent words."""

    def __init__(self, model: Model, remembered: int = 1 << 18):
        self.model = model
        self.automaton = Automaton(model.terms, edit_first=True)
        self.longest = max(map(len, model.terms), default=0) + 2
        self.known: dict[str, tuple[float, bool]] = {}
        self.remembered = remembered

    def weight(self, word: str) -> tuple[float, bool]:
        """Evidence of one lower-cased word, 0 for none, and whether its term is unsure."""
        found = self.known.get(word)
        if found is not None:
            return found
        value, term = self.model.terms.get(word, 0.0), word
        if not value and word not in self.model.clean:
            folded = _RUN.sub(r"\1", word) if len(word) > 3 else word
            if _DIGIT.search(folded):
                folded = folded.translate(_FOLD)
            if len(folded) <= self.longest and not (folded != word and folded in self.model.clean):
                hit = self.automaton.match(folded)
                if hit:
                    term = hit[1]
                    value = self.model.terms[term] * EDIT_WEIGHT[hit[0]]
        if len(self.known) >= self.remembered:
            self.known.clear()
        self.known[word] = value, term in self.model.unsure
        return self.known[word]

    def _hits(self, lowered: str) -> tuple[dict[str, tuple[float, bool]], int]:
        """(evidence of the words that are hits, distinct words)."""
        known, weight, bad = self.known, self.weight, {}
        found = set(_WORD.findall(lowered))
        for w in found:
            v = known.get(w) or weight(w)
            if v[0] > 0:
                bad[w] = v
        return bad, len(found)

    def unsure_words(self, text: str | None) -> tuple[int, int]:
        """(distinct words that hit unsure terms, distinct words)."""
        bad, n = self._hits(_lower(text or ""))
        return sum(unsure for _, unsure in bad.values()), n

    def score(self, text: str | None) -> tuple[float, int, str]:
        """(score, hits, distinct hit words)."""
        if not text:
            return FLOOR, 0, ""
        lowered = _lower(text)
        bad, n = self._hits(lowered)
        if not bad:
            return FLOOR, 0, ""
        spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lowered)]
        clear, clear_unsure, quoted, hits = 1.0, 1.0, 0.0, 0
        meant = set()  # unsure words used, not mentioned
        for k, (w, start, end) in enumerate(spans):
            if w not in bad:
                continue
            hits += 1
            value, unsure = bad[w]
            before = [s[0] for s in spans[max(0, k - 4):k]]
            around = before + [s[0] for s in spans[k + 1:k + 5]]
            if self._quoted(lowered, start, end) or REPORTING.intersection(before):
                quoted = max(quoted, value * QUOTED)
            else:
                if ADDRESS.intersection(around):
                    value = min(0.99, value * ADDRESSED)
                if unsure:
                    meant.add(w)
                    clear_unsure *= 1 - value
                else:
                    clear *= 1 - value
        if meant:
            share = max(0.0, 1 - at_least(len(meant), n * self.model.rate) / CHANCE)
            clear *= 1 - (1 - clear_unsure) * share
        return max(FLOOR, 1 - clear * (1 - quoted)), hits, ",".join(sorted(bad))

    @staticmethod
    def _quoted(text: str, start: int, end: int, reach: int = 60) -> bool:
        left = text[max(0, start - reach):start].rpartition("\n")[2]
        right = text[end:end + reach].partition("\n")[0]
        for opening, closing in zip(_OPEN, _CLOSE):
            if opening == closing:
                # An apostrophe inside a word is no quotation mark.
                lefts = len(re.findall(rf"(?<!\w){opening}(?=\w)|(?<=[\s(]){opening}", left))
                shut = len(re.findall(rf"(?<=[\w.,!?]){closing}(?!\w)", left))
                if lefts > shut and re.search(rf"(?<=[\w.,!?]){closing}(?!\w)", text[end - 1:end] + right):
                    return True
            elif left.rfind(opening) > left.rfind(closing) and closing in right:
                return True
        return False


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
        train: Column | None = None, sample_rows: int = SAMPLE_ROWS, seeds=SEEDS) -> Model:
    """Lexicon from labelled rows. ``train``: condition on the label rows that may
    be used. Reads at most ``sample_rows`` labels per class, by a hash of the id;
    every significant word of that bounded sample is a term."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if train is not None:
        usable = usable.filter(train)
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    order = [F.xxhash64(F.col("id").cast("string")), "id"]
    picked = usable.filter("label = 1").orderBy(*order).limit(sample_rows).unionByName(
        usable.filter("label = 0").orderBy(*order).limit(sample_rows))
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
             .join(F.broadcast(picked), "id")  # at most 2 * sample_rows ids
             .groupBy(F.xxhash64("text").alias("key"), "label").agg(F.first("text").alias("text"))).persist()
    split = texts.select("label", words(lower_az(F.col("text")), WORD).alias("w"))
    pairs = split.select("label", F.explode(F.arrays_zip(
        F.col("w").alias("word"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))).alias("p"))
    # A word counts once per following word: copies of a passage add nothing.
    contexts = pairs.select("label", F.col("p.word").alias("word"), F.col("p.next").alias("next")).distinct()
    holds = split.select("label", F.explode(F.array_distinct("w")).alias("word"))
    counted = contexts.select("label", "word", F.lit(1).alias("context")).unionByName(holds.withColumn("context", F.lit(0)))
    stats = counted.groupBy("word").agg(*[
        F.sum((F.col("label") == label).cast("int") * (F.col("context") == context).cast("int")).alias(name)
        for name, label, context in (("t", 1, 1), ("c", 0, 1), ("texts_t", 1, 0), ("texts_c", 0, 0))]).persist()
    try:
        n_t, n_c, vocabulary = (float(v or 0) for v in stats.agg(F.sum("t"), F.sum("c"), F.count("*")).first())
        sample = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
        terms, unsure, own = {s: SEED_WEIGHT for s in seeds}, frozenset(), F.lit(0.0)
        if n_t and n_c:
            rate_t, rate_c = F.col("t") / n_t, F.col("c") / n_c
            both = (F.col("t") + F.col("c")) / (n_t + n_c)
            ratio = 2 * (F.col("t") * F.log(rate_t / both) + F.when(F.col("c") > 0, F.col("c") * F.log(rate_c / both)).otherwise(0))
            share = (rate_t + 0.25 / n_t) / (rate_t + rate_c + 0.5 / n_t)
            own = share
            rows = (stats.filter((F.col("t") >= LEAST) & (F.col("texts_t") >= LEAST) & (F.length("word") >= 3))
                    .select("word", ratio.alias("ratio"), share.alias("share"), "texts_t", "texts_c")
                    .filter((F.col("ratio") >= max(16.0, 2 * math.log(vocabulary + 1))) & (F.col("share") >= SHARE))
                    .collect())
            terms |= {r["word"]: min(0.95, float(r["share"]) ** 2) for r in rows}
            unsure = frozenset(r["word"] for r in rows if r["texts_t"] * sample[0] < SURE * (r["texts_c"] + UNSEEN) * sample[1])

        @F.pandas_udf("string")
        def near(found: pd.Series) -> pd.Series:
            automaton = Automaton(terms, edit_first=True)
            hits = (None if w in terms else automaton.match(w) for w in found)
            return pd.Series([h[1] if h else None for h in hits], dtype=object)

        # Near-misses that the bounded sample's clean texts use as words of their own.
        clean = (stats.filter((F.col("c") > 0) & (own < SHARE)).select("word", "texts_c", near.asNondeterministic()("word").alias("term"))
                 .filter("term IS NOT NULL").collect())
        shared = Model(terms, frozenset(r["word"] for r in clean if r["texts_c"] > 1), unsure)
        return Model(terms, frozenset(r["word"] for r in clean), unsure, _unsure_rate(texts.filter("label = 0"), shared))
    finally:
        stats.unpersist()
        texts.unpersist()


def _unsure_rate(clean: DataFrame, model: Model) -> float:
    """Distinct words that hit unsure terms per distinct word, over the clean texts
    that hold any; if none does, as if all clean texts together held one."""
    if not model.unsure:
        return 0.0

    @F.pandas_udf("hits long, words long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.DataFrame([scorer.unsure_words(t) for t in texts], columns=["hits", "words"])

    found = clean.select(count.asNondeterministic()("text").alias("n")).select("n.*")
    held = F.when(F.col("hits") > 0, F.col("words"))
    hits, words_held, words_all = found.agg(F.sum("hits"), F.sum(held), F.sum("words")).first()
    return hits / words_held if hits else 1 / max(1, words_all or 0)


def score_column(model: Model, text: Column) -> Column:
    """Struct ``score, hits, terms`` for one text column."""
    @F.pandas_udf("score double, hits int, terms string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.DataFrame([scorer.score(t) for t in texts], columns=["score", "hits", "terms"])

    return run.asNondeterministic()(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the struct column ``into``: ``score, hits, terms``."""
    return docs.withColumn(into, score_column(model, F.col(text_col)))
