"""Toxicity: a cascade of weighted finite-state transducers over clauses.

Words become symbols (an insult of the learned lexicon, a threat, a target, a negation, a word of reported
speech, a quote mark, a clause's or a paragraph's end, anything else).  Five small transducers read them -
negation, reported speech, insult, threat and target - and are composed into one deterministic table.  All but
quotations end with the clause; those reach over clauses, up to the paragraph's end.  Running a paragraph
through the table gives counts of outputs (plain, targeted, negated and reported insults; threats), and a
logistic model fitted on labelled documents weighs them: what is scored is the matched clause, not the word alone.

The lexicon is learned: words and beginnings of words that stand in toxic training documents far more often
than chance allows, near copies counted once.

Defined cases: null or empty text gets the score of a text in which nothing matches; labels other than 0 and
1, and labelled ids without a document, are not used; without any label no text is called toxic and all scores
are 0.27; equal rows get equal scores; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import held_out, table, text_of
from tremorlake.llm.labelled import fit_logistic, sigmoid, training_rows

#: Largest number of labelled rows that the model is fitted on, and of lexicon entries.
SAMPLE_ROWS = 20_000
LEXICON = 4_096
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5

# Closed classes of words in four languages.
TARGETS = frozenset("you your yours u they them he she him her du dich dir ihr euch sie tu te toi vous votre ton tú ti usted ustedes vosotros te".split())
NEGATIONS = frozenset("not no never isn't aren't nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = frozenset("said says wrote reported quoted called claims claimed sagte schrieb dit écrit dijo escribió".split())
THREATS = frozenset("kill hurt destroy attack beat shoot stab burn töte töten schlage tuer frapper matar golpear".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
PIECE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]|[.!?;:]+")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OPEN, CLOSE, END = range(10)
N_SYMBOLS = 10
#: A straight mark opens or closes; the others do what they look like.
MARKS = {'"': QUOTE, "“": OPEN, "„": OPEN, "«": OPEN, "”": CLOSE, "»": CLOSE}


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (next state, marks), marks being the outputs on that arc."""

    start: int
    arcs: dict[tuple[int, int], tuple[int, frozenset[str]]]
    states: set[int] = field(default_factory=set)

    def __post_init__(self):
        self.states = {s for s, _ in self.arcs} | {n for n, _ in self.arcs.values()}


def countdown(trigger: int, reach: int, mark: str, on: tuple[int, ...]) -> Transducer:
    """Marks the given symbols while within reach of the last trigger in the clause."""
    arcs = {}
    for state, symbol in itertools.product(range(reach + 1), range(N_SYMBOLS)):
        after = reach if symbol == trigger else 0 if symbol == END else max(0, state - 1)
        arcs[state, symbol] = (after, frozenset([mark]) if state and symbol in on else frozenset())
    return Transducer(0, arcs)


def negation() -> Transducer:
    return countdown(NEGATION, 3, "negated", (INSULT, THREAT))


def reported() -> Transducer:
    """Inside quote marks, over clauses; or after a verb of saying until the clause's end."""
    own, quoted, said = range(3)
    arcs = {}
    for state, symbol in itertools.product(range(3), range(N_SYMBOLS)):
        if symbol == OPEN:
            after = quoted
        elif symbol == CLOSE:
            after = own
        elif symbol == QUOTE:
            after = own if state == quoted else quoted
        elif symbol == END:
            after = quoted if state == quoted else own
        else:
            after = said if symbol == REPORT and state == own else state
        arcs[state, symbol] = (after, frozenset(["reported"]) if state != own and symbol in (INSULT, THREAT) else frozenset())
    return Transducer(own, arcs)


def insult() -> Transducer:
    return Transducer(0, {(0, s): (0, frozenset(["insult"]) if s == INSULT else frozenset()) for s in range(N_SYMBOLS)})


def threat() -> Transducer:
    """A threatening verb and then a target within three words."""
    return countdown(THREAT, 3, "threat", (TARGET,))


def target() -> Transducer:
    """An insult within four words of the one that it is meant for."""
    return countdown(TARGET, 4, "targeted", (INSULT,))


def compose(*parts: Transducer) -> Transducer:
    """The product automaton: all parts read the same symbols, and the marks on their arcs are put together."""
    first = tuple(p.start for p in parts)
    ids, todo, arcs = {first: 0}, [first], {}
    while todo:
        state = todo.pop()
        for symbol in range(N_SYMBOLS):
            steps = [p.arcs[s, symbol] for p, s in zip(parts, state, strict=True)]
            after = tuple(n for n, _ in steps)
            if after not in ids:
                ids[after] = len(ids)
                todo.append(after)
            arcs[ids[state], symbol] = (ids[after], frozenset().union(*(m for _, m in steps)))
    return Transducer(0, arcs)


FEATURES = ("plain", "targeted", "negated", "reported", "threat", "any", "strongest")


def feature_of(marks: frozenset[str]) -> str | None:
    if "threat" in marks:
        return "threat"
    if "insult" not in marks:
        return None
    return "negated" if "negated" in marks else "reported" if "reported" in marks else "targeted" if "targeted" in marks else "plain"


class Grammar:
    def __init__(self, lexicon: dict[str, float]):
        self.words = {k: w for k, w in lexicon.items() if not k.endswith("*")}
        self.prefixes = {k[:-1]: w for k, w in lexicon.items() if k.endswith("*")}
        self.sizes = sorted({len(p) for p in self.prefixes})
        whole = compose(negation(), reported(), insult(), threat(), target())
        self.start = whole.start
        self.arcs = {k: (n, feature_of(m)) for k, (n, m) in whole.arcs.items()}

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.sizes:
            if len(word) >= n:
                best = max(best, self.prefixes.get(word[:n], 0.0))
        return best

    def symbol(self, word: str, insults: dict[str, float]) -> int:
        if word in insults:
            return INSULT
        if word in THREATS:
            return THREAT
        if word in NEGATIONS:
            return NEGATION
        if word in REPORTS:
            return REPORT
        if word in TARGETS:
            return TARGET
        return MARKS.get(word, END if word[0] in ".!?;:" else OTHER)

    def features(self, text: str) -> list[float]:
        lower = text.lower()
        words = set(WORD.findall(lower))
        insults = {w: v for w in words if (v := self.weight(w)) > 0}
        counts = dict.fromkeys(FEATURES, 0.0)
        if not insults and not words & THREATS:
            return list(counts.values())
        matter = set(insults) | (words & THREATS)
        for paragraph in lower.split("\n"):
            tokens = PIECE.findall(paragraph)
            if matter.isdisjoint(tokens):
                continue
            state = self.start
            for word in tokens:
                state, what = self.arcs[state, self.symbol(word, insults)]
                if what:
                    counts[what] += insults.get(word, 1.0)
        counts["strongest"] = max(insults.values(), default=0.0)
        counts["any"] = float(any(counts[k] for k in FEATURES[:5]))
        for k in FEATURES[:5]:
            counts[k] = math.log1p(counts[k])
        return list(counts.values())


def near_copy_key(words: list[str]) -> int:
    """Smallest hash of three words in a row: near copies mostly share it."""
    from xxhash import xxh64_intdigest as h

    return min((h(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def term_counts(rows: DataFrame) -> DataFrame:
    """term, clean, toxic: in how many different training documents each word or beginning stands; and '' for all."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = WORD.findall(text.lower())
                own = set(words)
                own |= {f"{w[:n]}*" for w in own for n in PREFIXES if len(w) > n}
                yield pd.DataFrame({"term": ["", *own], "copy": near_copy_key(words), "label": label})

    told = rows.select("text", "label").mapInPandas(terms, "term string, copy long, label int")
    return told.distinct().groupBy("term").agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms whose share of toxic documents chance doesn't explain, with their log odds."""
    counts = term_counts(rows)
    total = counts.where("term = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    rate = total["toxic"] / (total["toxic"] + total["clean"])
    toxic, clean = F.col("toxic"), F.col("clean")
    n = toxic + clean
    share = (toxic + 0.01) / (n + 0.02)
    # log likelihood ratio of the term's own share against the overall rate
    surprise = toxic * F.log(share / rate) + clean * F.log((1 - share) / (1 - rate))
    odds = F.log((toxic + 0.2) / (total["toxic"] + 0.4)) - F.log((clean + 0.2) / (total["clean"] + 0.4))
    found = counts.where("term <> '' and toxic >= 3").where((share >= 0.8) & (surprise >= 8.5))
    best = found.select("term", odds.alias("odds"), surprise.alias("surprise")).orderBy(F.desc("surprise"), "term").limit(LEXICON).collect()
    return {r["term"]: float(r["odds"]) for r in best if r["odds"] > 0}


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: list[float]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(features @ np.array(self.weights[:-1]) + self.weights[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = training_rows(docs, labels, "toxic", sample_rows, id_col, text_col)
    lexicon = learn_lexicon(rows)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon)
        for batch in batches:
            yield pd.DataFrame({"x": [grammar.features(t) for t in batch["text"]], "label": batch["label"]})

    told = rows.select("text", "label").mapInPandas(of, "x array<double>, label int").toPandas()  # sample_rows rows
    if told.empty:
        return Model(lexicon, [0.0] * len(FEATURES) + [-1.0])
    return Model(lexicon, fit_logistic(np.array(told["x"].tolist()), told["label"].to_numpy(float), penalty=0.5).tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(model.lexicon)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch["text"]]).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": model.scores(x)})

    # nullable ids would become floats in pandas: they travel as text
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    told = rows.mapInPandas(run, "doc_id string, held_out boolean, score double")
    return told.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those judged toxic; all columns as they were.  The score is a column for the row itself, so nothing is joined."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        grammar = Grammar(model.lexicon)
        return pd.Series(model.scores(np.array([grammar.features(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return docs.where(toxic(text_of(text_col)) < THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
