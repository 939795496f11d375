"""Toxicity by a weighted finite-state pattern grammar.

Transducers run over the tokens of a text, left to right, each rewriting what the one before it wrote. They are tables
of weighted arcs, and `compose` makes one table of two:

- lexicon: word -> insult, threat, intent, target, object, negation, report, mention or other, with the word's weight
  (one state); compounds such as `trash bin` are entries of two words and no insults;
- negation: marks insults and threats in the few tokens after a negation;
- reported speech: marks those that follow a verb of reporting, to the end of the clause; insults that are only mentioned
  (`the word idiot`) and not reported are dropped;
- threat frame: intent, then a verb of violence, then a person as its object, in one clause; or that verb and `yourself`.
  Without its frame a verb of violence is an ordinary word;
- clause: insult near a target -> targeted, threat frame -> threat, further insults in a clause -> piled,
  an insult alone in its clause -> bare;
- text: a bare insult clause writes nothing; from the second on they are sustained abuse. So a single insulting word,
  alone in its clause and in its text, scores nothing.

A text's score is the noisy-or of its matches: 1 - (1 - floor) * prod(1 - weight * class weight). A match has the weight
of the word that ends it: an insult's own, or 1 where a person ends it. A word's weight is the share of toxic texts among the contexts in which training rows hold the word, shrunk to a prior; class weights are
learned the same way. The word lists are priors; words of any language, and stems of words that occur in many forms, are
learned beside them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, unused, written

# Words of the grammar.
INSULTS = "idiot idiots moron morons stupid dumb trash garbage scum loser losers worthless pathetic disgusting clown clowns imbecile cretin jerk bastard vermin filth filthy parasite coward crap freak fool ugly degenerate subhuman scumbag dumbass asshole"
THREATS = "kill hurt destroy murder strangle stab shoot burn beat punish crush"
INTENTS = "will i'll we'll you'll he'll she'll they'll shall gonna wanna going want wants must should let's lemme"
TARGETS = "your yours he she they his their these those dein deine deinen deiner votre vos"
OBJECTS = "you u him her them people everyone dich dir euch toi vous usted ustedes vosotros"
SELVES = "yourself yourselves"
NEGATIONS = "not never isn't aren't wasn't weren't don't doesn't didn't won't cannot can't nobody neither nicht kein keine keinen niemals pas jamais aucun aucune nunca jamás tampoco"
REPORTS = "said says say saying called calls quoted quotes wrote writes claimed claims reported alleged sagte sagten nannte schrieb disait appelait écrivait dijo dijeron llamó escribió"
MENTIONS = "word words term terms phrase wort wörter mot mots palabra palabras"
COMPOUND_HEADS, COMPOUND_TAILS = "garbage trash crap", "collection collections collector collectors bin bins can cans bag bags truck trucks dump dumps disposal heap heaps day"

NEGATION_SCOPE, TARGET_REACH, MENTION_REACH, INTENT_REACH, OBJECT_REACH = 3, 4, 2, 4, 3
CLASSES = ("threat", "targeted", "piled", "sustained", "reported", "negated")
CLASS_PRIORS = {"threat": 1.0, "targeted": 1.0, "piled": 0.95, "sustained": 0.95, "reported": 0.5, "negated": 0.4}
CLASS_PRIOR_ROWS, SEED_PRIOR, SEED_PRIOR_ROWS, LEARNED_PRIOR_ROWS = 8.0, 0.9, 6.0, 2.0
#: Labelled rows that training uses, and what makes a word of theirs an insult: toxic contexts, and their share.
MAX_TRAINING_ROWS, MIN_CONTEXTS, MIN_WEIGHT = 20_000, 6, 0.7
#: Stems are the first letters of at least so many words, which then count in all their forms.
STEM_LETTERS, STEM_WORDS = (4, 5, 6, 7, 8), 5

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_COMPOUND = rf"\b(?:{'|'.join(COMPOUND_HEADS.split())})[ -](?:{'|'.join(COMPOUND_TAILS.split())})\b"
_TOKEN_OR_STOP = re.compile(_COMPOUND + "|" + _TOKEN.pattern + r"|[.!?;:\n]+")
_STOPS = ".!?;:\n"


@dataclass(frozen=True)
class Transducer:
    """(state, input) -> (next state, output, weight); an empty output writes nothing."""

    start: int
    inputs: tuple[str, ...]
    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def run(self, symbols: Iterator[tuple[str, float]]) -> Iterator[tuple[str, float]]:
        """Rewrite weighted symbols."""
        state, arcs = self.start, self.arcs
        for symbol, weight in symbols:
            state, out, factor = arcs[state, symbol]
            if out:
                yield out, weight * factor


def tabulate(start: Hashable, inputs: tuple[str, ...], step: Callable[[Hashable, str], tuple[Hashable, str, float]]) -> Transducer:
    """The table of all states that `step` reaches from the start."""
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for symbol in inputs:
            after, out, weight = step(state, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            arcs[number[state], symbol] = (number[after], out, weight)
    return Transducer(0, inputs, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that does what `second` does with the output of `first`: weights multiply along the path."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, float]:
        p, q = state
        p, middle, w = first.arcs[p, symbol]
        if not middle:
            return (p, q), "", w
        q, out, v = second.arcs[q, middle]
        return (p, q), out, w * v

    return tabulate((first.start, second.start), first.inputs, step)


def negation() -> Transducer:
    """Insults and threats in the NEGATION_SCOPE tokens after a negation get the mark `.not`."""

    def step(left: int, symbol: str):
        if symbol == "stop":
            return 0, symbol, 1.0
        if symbol == "negation":
            return NEGATION_SCOPE, "other", 1.0
        return max(0, left - 1), symbol + ".not" * (left > 0 and symbol in ("insult", "threat")), 1.0

    return tabulate(0, ("insult", "threat", "intent", "target", "object", "self", "negation", "report", "mention", "other", "stop"), step)


def reported_speech() -> Transducer:
    """Insults and threats after a verb of reporting get the mark `.said`, to the end of the clause.

    Others that follow the mention of a word within MENTION_REACH tokens are no insults. A state is -1 after a verb of
    reporting, else for how many tokens a mention still reaches.
    """

    def step(state: int, symbol: str):
        if symbol == "stop":
            return 0, symbol, 1.0
        if symbol == "report" or state < 0:
            return -1, "other" if symbol in ("report", "mention") else symbol + ".said" * (symbol in ("insult", "threat")), 1.0
        if symbol == "mention":
            return MENTION_REACH, "other", 1.0
        return max(0, state - 1), "other" if state and symbol in ("insult", "insult.not") else symbol, 1.0

    return tabulate(0, ("insult", "threat", "insult.not", "threat.not", "intent", "target", "object", "self", "report", "mention", "other", "stop"), step)


def threat_frame() -> Transducer:
    """Where a frame of intent, violence and person ends, the person becomes `threatened`; other persons are targets.

    A state is how many tokens ago intent and the verb of violence were (one more than the reach: too many), and whether
    that verb had intent before it.
    """
    none = (INTENT_REACH + 1, OBJECT_REACH + 1, False)

    def step(state: tuple[int, int, bool], symbol: str):
        intent, verb, meant = min(none[0], state[0] + 1), min(none[1], state[1] + 1), state[2]
        if symbol == "stop":
            return none, symbol, 1.0
        if symbol == "intent":
            return (0, none[1], False), "other", 1.0
        if symbol == "threat":
            return (none[0], 0, intent <= INTENT_REACH), "other", 1.0
        reached = verb <= OBJECT_REACH
        if symbol == "self" or symbol == "object":
            return none, "threatened" if reached and (meant or symbol == "self") else "target", 1.0
        return (intent, verb, meant and reached), "other" if symbol.startswith("threat.") else symbol, 1.0

    return tabulate(none, ("insult", "threat", "insult.not", "threat.not", "insult.said", "threat.said", "intent", "target", "object", "self", "other", "stop"), step)


def matches_of_clauses() -> Transducer:
    """Matches within a clause. A state is how many tokens ago (TARGET_REACH + 1: too many) target and insult were, and whether the clause has an insult."""
    far = TARGET_REACH + 1

    def step(state: tuple[int, int, bool], symbol: str):
        target, insult = (min(far, x + 1) for x in state[:2])
        some, out = state[2], ""
        if symbol == "stop":
            return (far, far, False), "stop", 1.0
        if symbol in ("target", "threatened"):
            out = "threat" if symbol == "threatened" else "targeted" if insult < far else ""
            target, insult = 0, far
        elif symbol == "insult":
            out = "targeted" if target < far else "piled" if some else "bare"
            insult, some = 0 if out == "bare" else far, True
        elif symbol in ("insult.not", "insult.said"):
            out = "negated" if symbol == "insult.not" else "reported"
        return (target, insult, some), out, 1.0

    return tabulate((far, far, False), ("insult", "insult.not", "insult.said", "target", "threatened", "other", "stop"), step)


def clause() -> Transducer:
    """Threat frames, then all matches within a clause."""
    return compose(threat_frame(), matches_of_clauses())


def sustained() -> Transducer:
    """Bare insult clauses count from the second on, or where the text has another match already."""

    def step(some: bool, symbol: str):
        if symbol == "bare":
            return True, "sustained" if some else "", 1.0
        if symbol == "stop":
            return some, "", 1.0
        return some or symbol in ("targeted", "threat", "piled"), symbol, 1.0

    return tabulate(False, ("bare", "piled", "targeted", "threat", "negated", "reported", "stop"), step)


def grammar() -> Transducer:
    return compose(compose(compose(negation(), reported_speech()), clause()), sustained())


def lexicon(weights: dict[str, float]) -> dict[str, tuple[str, float]]:
    """Symbols of all words but `other` ones: the arcs of a transducer with one state. `weights` are those of insults."""
    words = {"target": TARGETS, "object": OBJECTS, "self": SELVES, "intent": INTENTS, "negation": NEGATIONS, "report": REPORTS, "mention": MENTIONS}
    table = {w: (symbol, 1.0) for symbol, listed in words.items() for w in listed.split()}
    table |= {w: ("threat", SEED_PRIOR) for w in THREATS.split()}
    return table | {w: ("insult", p) for w, p in weights.items()}


class Matcher:
    """Finds the matches of a text. The lexicon has one state, so it is composed with the grammar as the text is read.

    A weight of a word that ends in * is that of all longer words which begin so; a word's own weight goes before it.
    """

    def __init__(self, weights: dict[str, float]):
        self.table, self.grammar = lexicon({w: p for w, p in weights.items() if w[-1] != "*"}), grammar()
        self.stems = {w[:-1]: ("insult", p) for w, p in weights.items() if w[-1] == "*"}
        self.lengths = sorted({len(x) for x in self.stems})
        self.hot = {w for w, (symbol, _) in self.table.items() if symbol in ("insult", "threat")}

    def symbol(self, token: str) -> tuple[str, float]:
        found = self.table.get(token)
        compound = " " in token or "-" in token
        for n in self.lengths if found is None and not compound else ():
            if len(token) > n and token[:n] in self.stems:
                return self.stems[token[:n]]
        return found or ("other", 1.0)

    def is_hot(self, tokens: set[str]) -> bool:
        return not self.hot.isdisjoint(tokens) or any(not self.stems.keys().isdisjoint([t[:n] for t in tokens]) for n in self.lengths)

    def matches(self, text: str) -> list[tuple[str, float]]:
        """The (class, weight) of each match."""
        low = text.lower()
        if not self.is_hot(set(_TOKEN.findall(low))):
            return []
        symbol, stop = self.symbol, ("stop", 1.0)
        return list(self.grammar.run(stop if t[0] in _STOPS else symbol(t) for t in _TOKEN_OR_STOP.findall(low)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, hash of the words around it, toxic) of each word of training rows: copies of a text count once."""
    for batch in batches:
        for part in slices(batch):
            words, around, toxic = [], [], []
            for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                t = ["", *_TOKEN.findall((text or "").lower()), ""]
                words += t[1:-1]
                around += [xxhash.xxh64_intdigest(f"{a} {b}") >> 1 for a, b in zip(t[:-2], t[2:], strict=True)]
                toxic += [label] * (len(t) - 2)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(around, pa.int64()), pa.array(toxic, pa.int32())], ["word", "around", "toxic"])


def _strongest(weights: dict[str, float]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for batch in batches:
            for part in slices(batch):
                kinds = []
                for text in part.column(1).to_pylist():
                    seen = {k for k, _ in matcher.matches(text or "")}
                    kinds.append(next((c for c in CLASSES if c in seen), None))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), part.column(2)], ["kind", "toxic"])

    return find


def held_out(id_column):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Learn weights from labelled rows that aren't held out, at most about MAX_TRAINING_ROWS of them, chosen by a hash.

    Every word and stem that passes MIN_CONTEXTS and MIN_WEIGHT is learned; the training rows bound their number. Conflicting labels of one id count as toxic. Without labels the priors alone are the model.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().filter(~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = MAX_TRAINING_ROWS / max(1, marks.count())
    if share < 1:
        marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(marks, "id")
    rows = written(rows.select("id", "text", "toxic"), "training")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = (n_toxic + 1) / (n + 10)

    seen = rows.mapInArrow(_contexts, "word string, around long, toxic int").distinct().groupBy("word").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    seen = written(seen, "words")
    seeds = INSULTS.split()
    weight = (F.col("c1") + LEARNED_PRIOR_ROWS * base) / (F.col("c1") + F.col("c0") + LEARNED_PRIOR_ROWS)
    counts = seen.filter(f"c1 >= {MIN_CONTEXTS}").filter(weight >= MIN_WEIGHT).filter(~F.col("word").isin(seeds) & (F.length("word") > 2))
    learned = {r["word"]: r["w"] for r in counts.select("word", weight.alias("w")).collect()}
    known = {r["word"]: (r["c1"], r["c0"]) for r in seen.filter(F.col("word").isin(seeds)).collect()}
    # Stems: what many forms of a word have in common, from the counts of the words; shorter ones stand for longer ones.
    forms = F.filter(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LETTERS]), lambda x: x.isNotNull())
    stems = seen.select(F.explode(forms).alias("stem"), "c1", "c0").groupBy("stem").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"), F.count_if(F.col("c1") > 0).alias("n"))
    found = {r["stem"]: r["w"] for r in stems.filter(f"c1 >= {MIN_CONTEXTS} AND n >= {STEM_WORDS}").filter(weight >= MIN_WEIGHT).select("stem", weight.alias("w")).collect()}
    learned |= {f"{x}*": w for x, w in found.items() if not any(x[:n] in found for n in STEM_LETTERS if n < len(x))}
    weights = learned | {w: (known.get(w, (0, 0))[0] + SEED_PRIOR * SEED_PRIOR_ROWS) / (sum(known.get(w, (0, 0))) + SEED_PRIOR_ROWS) for w in seeds}

    kinds = rows.mapInArrow(_strongest(weights), "kind string, toxic int").groupBy("kind").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()
    got = {r["kind"]: (r["t"], r["n"]) for r in kinds}
    classes = {c: (got.get(c, (0, 0))[0] + CLASS_PRIORS[c] * CLASS_PRIOR_ROWS) / (got.get(c, (0, 0))[1] + CLASS_PRIOR_ROWS) for c in CLASSES}
    none_toxic, none = got.get(None, (0, 0))
    return {"weights": weights, "classes": classes, "floor": (none_toxic + 0.2) / (none + 10)}


def _scorer(model: dict, text_col: str, score_col: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model["weights"])
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text_col)):
                scores = []
                for text in part.column(text_col).to_pylist():
                    clean = 1 - model["floor"]
                    for kind, weight in matcher.matches(text or ""):
                        clean *= 1 - weight * model["classes"][kind]
                    scores.append(1 - clean)
                yield part.append_column(score_col, pa.array(scores, pa.float64()))

    return score


def scored(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a column `score_col` (one of that name is replaced)."""
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(_scorer(model, text_col, score_col), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """Return (doc id, held_out, score, predicted), one row per input row.

    A row is held out if crc32 of its id as text is 1 modulo 3; its label is never used. Null and empty texts get the
    score of texts without matches; texts of any length are read whole. A null id counts as the empty text (not held
    out). Repeated rows each get a row; empty tables give no rows; other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = scored(base, train(docs, labels, id_col, text_col, label_col))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns kept, whose score is below the threshold.

    Null, empty and blank texts have no matches and stay; texts of any length are read whole. Equal texts share their
    fate, so repeated rows stay or go together; null ids make no difference. Without labels the priors are the model.
    An empty table gives no rows. Columns may have any names.
    """
    score = unused("score", docs)
    return scored(docs, train(docs, labels, id_col, text_col), text_col, score).filter(F.col(score) < threshold).drop(score)
