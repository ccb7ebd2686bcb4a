"""Operator 7: toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, learnt insult, threat verb, intent, pronoun, determiner, negation, report, other. Small
deterministic transducers, each with its own arcs, read the symbols of one clause: negation and reported speech
tame the insults and verbs behind them; the threat transducer asks for a verb and an object, and knows intent
before it; the insult transducer asks for a target, which is a pronoun, a noun phrase (it is opened by a
determiner) or a bare subject, before the insult in its clause or, but for the last, close behind it. Their
composition is one machine. Only matched clause patterns are emitted: a word that stands alone, learnt or not, or
begins a clause without target counts for nothing. Emissions are summed over the
clauses of a document, and the weights of the emitting arcs are a logistic regression on labelled training rows.

The lexicon has a fixed part and a learnt one: words and word beginnings that training rows marked toxic
hold far more often than the others. Texts are read in the tasks that scan them; only counts move on.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import SLICE_BYTES, checkpointed, hash_slice, mix, pieces_at, prefix_sums, row_slices, text_buffers
from tessera.session import table

#: The lexicon by symbol, as text in four languages; a caller may pass another.
LEXICON = {
    "I": "idiot idiots moron morons stupid scum trash garbage pathetic worthless disgusting clown clowns loser losers "
    "dumb fool fools imbecile imbeciles cretin creep freak freaks vermin filth filthy scumbag jerk ugly bastard "
    "dummkopf trottel abschaum widerlich wertlos erbärmlich versager dumm blöd ekelhaft drecksack "
    "imbécile crétin débile ordure minable dégoûtant raclure abruti connard salaud "
    "imbécil estúpido estúpida basura patético patética asqueroso asquerosa inútil escoria payaso perdedor",
    "V": "kill hurt destroy beat stab shoot strangle punish töten verletzen vernichten schlagen erschießen "
    "tuer frapper détruire étrangler matar golpear destruir apuñalar",
    "M": "will shall should must gonna going want wanna werde werden soll sollte will muss vais va veux faut "
    "voy vamos va quiero hay",
    "P": "you your yours yourself yall thee he him his she her they them their du dich dir dein deine ihr euch er ihm ihn sie "
    "tu toi te ton ta vous votre il elle ils elles lui leur usted ustedes tú vosotros ellos ella él le les",
    "D": "the a an this that these those my our der die das den dem des ein eine einen einem einer dieser diese "
    "le la les l' un une des du ce cette ces el los las una unos unas ese esa este esta",
    "N": "not no never isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún",
    "R": "said says wrote writes called calls quoted claimed alleges reported sagte schrieb nannte zitierte "
    "écrit appelé cité dijo escribió llamó citó",
}
OTHER = "O"
#: Words that a target may follow an insult by, an object its verb, and a verb the intent; words that a negation reaches.
NEAR, TAMED = 4, 3
#: What the composed machine emits, by symbol, in the order of the features.
EMITTED = {
    "A": "insult_pronoun", "B": "insult_noun", "C": "insult_subject", "a": "learnt_pronoun", "b": "learnt_noun", "c": "learnt_subject",
    "T": "threat_intended", "t": "threat", "n": "negated", "r": "reported",
}
#: Weights (bias first, then for each emission: its presence, its level) where no training rows exist.
PRIOR = (-3.0, 3.0, 1.0, 2.5, 1.0, 2.0, 0.5, 2.0, 0.5, 1.5, 0.5, 1.0, 0.5, 3.5, 1.0, 2.5, 1.0, -0.5, 0.0, 0.2, 0.0)
#: A word or beginning (of so many bytes) is learnt if at least this share of the toxic rows have it, and
#: its share among them is so many times that among the others. At most (mean forms a row / share) forms
#: pass the first test, so the learnt lexicon is bounded whatever the input's size.
BEGINNINGS, MIN_SHARE, MIN_ROWS, RATIO = range(3, 13), 0.01, 5, 20
#: Training labels used, about, drawn evenly by a hash of the id; with fewer, all are.
FIT_ROWS = 200_000
THRESHOLD = 0.3
LEVELS = 8


class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives (state, emitted symbols, as a string)."""

    def __init__(self, start: Hashable, step: Callable[[Hashable, str], tuple[Hashable, str]]) -> None:
        self.start, self.step = start, step

    def then(self, second: Transducer) -> Transducer:
        """Composition: the second reads what this one emits."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            theirs, said = state[1], ""
            for s in out:
                theirs, more = second.step(theirs, s)
                said += more
            return (mine, theirs), said

        return Transducer((self.start, second.start), step)

    def arcs(self) -> Callable[[Hashable, str], tuple[Hashable, str]]:
        """``step`` with arcs kept once they are made; there are finitely many."""
        return cache(self.step)

    def run(self, symbols: str) -> str:
        state, out = self.start, ""
        for s in symbols:
            state, more = self.step(state, s)
            out += more
        return out


CORE = "ILV"


def negation() -> Transducer:
    """A core word among the TAMED words behind a negation becomes ``n``."""

    def step(left: int, symbol: str):
        if symbol == "N":
            return TAMED, symbol
        return max(0, left - 1), "n" if left and symbol in CORE else symbol

    return Transducer(0, step)


def report() -> Transducer:
    """A core word behind a verb of reported speech becomes ``r``."""
    return Transducer(False, lambda seen, symbol: (seen or symbol == "R", "r" if seen and symbol in CORE else symbol))


def threat() -> Transducer:
    """A threat verb whose object (pronoun or noun phrase) is one of the next NEAR words emits ``t``, or ``T`` if intent
    was one of the NEAR words before it. Everything but the verb is passed on."""

    def step(state: tuple[int, int, bool], symbol: str):
        intent, verb, meant = max(0, state[0] - 1), max(0, state[1] - 1), state[2]
        if symbol == "M":
            return (NEAR, verb, meant), symbol
        if symbol == "V":
            return (intent, NEAR, state[0] > 0), OTHER
        if symbol in "PD" and state[1]:
            return (intent, 0, False), ("T" if meant else "t") + symbol
        return (intent, verb, meant and verb > 0), symbol

    return Transducer((0, 0, False), step)


def insult() -> Transducer:
    """An insult (``I``, learnt ``L``) with a target emits ``A`` (``a``) at a pronoun, else ``B`` (``b``) at a noun
    phrase, else ``C`` (``c``) at any other word as its subject. The target stands anywhere before it in the clause; a
    pronoun or noun phrase may also be one of the next NEAR words. Of insults that wait for a target, the last
    counts. Other emissions are passed on, words are not."""

    def at(kind: str, who: str) -> str:
        return {"IP": "A", "ID": "B", "IO": "C", "LP": "a", "LD": "b", "LO": "c"}[kind + who]

    def step(state: tuple[str, str, int], symbol: str):
        who, kind, left = state
        if symbol in "tT":
            return state, symbol  # comes beside the word
        if left == 0:
            kind = ""
        if symbol == OTHER:
            return (who or OTHER, kind, max(0, left - 1)), ""
        if symbol in "PD":
            known = "P" if "P" in (who, symbol) else "D"
            return (known, "", 0), at(kind, symbol) if kind else ""
        if symbol in "IL":
            return ((who, "", 0), at(symbol, who)) if who else ((who, symbol, NEAR), "")
        return (who, kind, max(0, left - 1)), symbol if symbol in "nr" else ""

    return Transducer(("", "", 0), step)


def grammar() -> Transducer:
    return negation().then(report()).then(threat()).then(insult())


_ASCII = np.arange(256)
#: Words end at any ASCII byte but letters and the apostrophe; clauses at these marks.
_BREAK = (_ASCII < 128) & ~((_ASCII >= 65) & (_ASCII <= 90)) & ~((_ASCII >= 97) & (_ASCII <= 122)) & (_ASCII != 39)
_CLAUSE = np.isin(_ASCII, [ord(c) for c in ".!?;:\n\r"])


def _lexicon_table(lexicon: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and their symbols."""
    found = {}
    for symbol, words in lexicon.items():
        for word in words.split():
            raw = np.frombuffer(word.encode(), np.uint8)
            found[int(hash_slice(raw, np.zeros(1, np.int64), _BREAK)[0][0])] = symbol
    keys = np.array(sorted(found), np.uint64)
    return keys, np.array([found[int(k)] for k in keys])


def word_forms(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, indices of words, hashes) of the words of a text run, then of their beginnings of each length."""
    hashes, first = hash_slice(data, starts, _BREAK)
    yield first, np.arange(len(first)), hashes
    if not len(first):
        return
    total, down = prefix_sums(data)
    inside = np.append(~_BREAK[data], False)
    inside[starts[starts < len(data)]] = False  # a word's beginning never reaches into the next text
    outside = np.flatnonzero(~inside)
    outside = outside[np.searchsorted(outside, first, "right").clip(0, len(outside) - 1)]
    length = outside - first
    for k in BEGINNINGS:
        long = np.flatnonzero(length > k)
        at = first[long]
        yield at, long, mix((total[at + k] - total[at]) * down[at] + np.uint64(2 * k + 1))


class _Among:
    """Which hashes are among a small set: a bitmap of their top bits leaves few to look up."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.maybe = keys, np.zeros(1 << 16, bool)
        self.maybe[(keys >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        k = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        return k[np.isin(hashes[k], self.keys)]


def _runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row starts) of a batch's texts; a long text comes in pieces that end with a clause."""
    offsets, data = text_buffers(batch.column(1))
    for row, stop in row_slices(offsets):
        own = data[offsets[row] : offsets[stop]]
        if stop - row == 1 and len(own) > SLICE_BYTES:
            for piece in pieces_at(own, _CLAUSE):
                yield row, piece, np.zeros(1, np.int64)
        elif len(own):
            yield row, own, offsets[row:stop] - offsets[row]


def _form_rows(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """How many rows of (any column, text) hold each form (of those in ``only``, if given), by form."""

    among = _Among(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = []
            for first, data, starts in _runs_of(batch):
                found = []
                for at, _, hashes in word_forms(data, starts):
                    if among is not None:
                        keep = among(hashes)
                        at, hashes = at[keep], hashes[keep]
                    row = np.searchsorted(starts, at, "right") - 1 + first
                    found.append(np.stack([row.astype(np.uint64), hashes]))
                both = np.concatenate(found, axis=1)
                order = np.lexsort((both[1], both[0]))
                both = both[:, order]
                new = np.ones(both.shape[1], bool)
                new[1:] = (both[:, 1:] != both[:, :-1]).any(0)
                seen.append(both[1][new])
            if seen:
                form, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(form.view(np.int64)), pa.array(n)], ["form", "n"])

    counted = rows.mapInArrow(run, "form long, n long")
    return counted.groupBy("form").agg(F.sum("n").alias("n"))


def training_labels(labels: DataFrame, id_col: str, label_col: str, rows: int = FIT_ROWS) -> DataFrame:
    """``_label_id``, ``_y`` of the labels that may be learnt from: about ``rows`` of them, drawn by a hash of the id."""
    known = labels.select(F.col(id_col).alias("_label_id"), (F.col(label_col).cast("int") > 0).alias("_y"))
    known = known.where(F.col("_y").isNotNull() & F.col("_label_id").isNotNull() & ~held_out("_label_id"))
    share = rows / max(1, known.count())
    return known if share >= 1 else known.where(F.pmod(F.xxhash64("_label_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))


def learn_forms(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Hashes of the words and beginnings that mark toxic training rows (see BEGINNINGS); ``known`` is bounded."""
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return np.zeros(0, np.uint64)
    rows = docs.select(id_col, text_col).join(F.broadcast(known), F.col(id_col) == F.col("_label_id"))
    toxic, clean = (rows.where(side).select(id_col, text_col) for side in (F.col("_y"), ~F.col("_y")))
    least = max(MIN_ROWS, MIN_SHARE * sizes[True])
    often = {r["form"]: r["n"] for r in _form_rows(toxic).where(F.col("n") >= least).collect()}
    if not often:
        return np.zeros(0, np.uint64)
    only = np.array(sorted(often), np.int64).view(np.uint64)
    other = {r["form"]: r["n"] for r in _form_rows(clean, only).collect()}
    marks = [f for f, n in often.items() if n / sizes[True] >= RATIO * (other.get(f, 0) + 1) / (sizes[False] + 1)]
    return np.sort(np.array(marks, np.int64).view(np.uint64))


def clause_counter(lexicon: dict[str, str], learnt: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
    """A function that counts each emission of the grammar over all clauses of the texts in a batch's second column."""
    keys, symbols = _lexicon_table(lexicon)
    machine = grammar()
    step, start = machine.arcs(), machine.start
    feature = {symbol: k for k, symbol in enumerate(EMITTED)}
    among = _Among(learnt)

    def count(data: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
        forms = word_forms(data, starts)
        at, _, words = next(forms)
        if not len(words):
            return
        symbol = np.full(len(words), OTHER)
        for _, word, hashes in chain([(at, np.arange(len(words)), words)], forms) if len(learnt) else ():
            symbol[word[among(hashes)]] = "L"
        where = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        symbol = np.where(keys[where] == words, symbols[where], symbol)
        core = np.flatnonzero(np.isin(symbol, list(CORE)))
        if not len(core):
            return
        row = np.searchsorted(starts, at, "right") - 1
        clause = np.cumsum(_CLAUSE[data])[at]
        edge = np.flatnonzero(np.diff(row) | np.diff(clause)) + 1
        left, right = np.concatenate([[0], edge]), np.concatenate([edge, [len(at)]])
        for k in np.unique(np.searchsorted(left, core, "right") - 1):
            state = start
            for s in symbol[left[k] : right[k]].tolist():
                state, emitted = step(state, s)
                for e in emitted:
                    out[row[left[k]], feature[e]] += 1

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(batch), len(EMITTED)), np.int64)
        for first, data, starts in _runs_of(batch):
            count(data, starts, out[first:])
        return out

    return counts


def clause_counts(
    docs: DataFrame, id_col: str, text_col: str, lexicon: dict[str, str] = LEXICON, learnt: np.ndarray | None = None
) -> DataFrame:
    """The id and one count per emission of the grammar over all clauses of the whole text."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in EMITTED.values())])
    marks = learnt if learnt is not None else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = clause_counter(lexicon, marks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counter(batch).T)], [id_col, *EMITTED.values()])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _features() -> list[Column]:
    """Presence and log2 level of each count: bounded small integers, so that training rows group."""
    levels = [F.least(F.ceil(F.log2(F.greatest(F.col(c), F.lit(0)) + 1)), F.lit(LEVELS)).cast("int") for c in EMITTED.values()]
    return [x.alias(f"f{2 * k + j}") for k, v in enumerate(levels) for j, x in enumerate(((v > 0).cast("int"), v))]


def fit(rows: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weights (bias first) of a ridge logistic regression by Newton steps over grouped rows."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0, *[ridge] * rows.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (label - p)) - penalty @ w
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from; a null id counts as such only by having no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lexicon: dict[str, str] = LEXICON,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` (0 to 1), ``predicted`` and the clause counts.

    The weights are fitted on labelled rows that are not held out (FIT_ROWS of them at most, about), grouped by
    their few feature values. Null labels and labels without an id are left out; a document labelled twice counts
    twice; without any training row the documented PRIOR holds. A text of any length is read whole, in pieces that
    end with a clause. Null
    and empty texts have no clause and get the score of a text without matches. Repeated ids are all
    scored; only the named columns are read, so others may clash by name.
    """
    known = checkpointed(training_labels(labels, id_col, label_col))
    learnt = learn_forms(docs, known, id_col, text_col)
    counts = checkpointed(clause_counts(docs, id_col, text_col, lexicon, learnt))
    weights = _fitted(counts, known, id_col)
    total = sum((F.lit(w) * f for w, f in zip(weights[1:], _features(), strict=True)), F.lit(weights[0]))
    return (
        counts.withColumn("score", 1 / (1 + F.exp(-total)))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .select(id_col, held_out(id_col).alias("held_out"), "score", "predicted", *EMITTED.values())
    )


def _fitted(counts: DataFrame, known: DataFrame, id_col: str) -> list[float]:
    """Weights (bias first) from the clause counts of the training rows."""
    train = counts.join(F.broadcast(known), F.col(id_col) == F.col("_label_id"))
    names = [f"f{k}" for k in range(2 * len(EMITTED))]
    grouped = train.select(*_features(), F.col("_y")).groupBy(*names, "_y").count().collect()
    if not grouped:
        return list(PRIOR)
    rows = np.array([[r[c] for c in names] for r in grouped], float)
    return fit(rows, np.array([float(r["_y"]) for r in grouped]), np.array([float(r["count"]) for r in grouped]))


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lexicon: dict[str, str] = LEXICON,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold.

    As ``toxicity``, but the weights are fitted on the labelled rows alone and whole rows are then filtered in
    the tasks that read them, so that no text is shuffled.
    """
    known = checkpointed(training_labels(labels, id_col, label_col))
    learnt = learn_forms(docs, known, id_col, text_col)
    labelled = docs.select(id_col, text_col).join(F.broadcast(known.select(F.col("_label_id").alias(id_col)).distinct()), id_col, "left_semi")
    weights = np.array(_fitted(clause_counts(labelled, id_col, text_col, lexicon, learnt), known, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = clause_counter(lexicon, learnt)
        for batch in batches:
            counts = counter(pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text_col)], ["id", "text"])).clip(0)
            level = np.minimum(np.ceil(np.log2(counts + 1)), LEVELS)
            features = np.stack([level > 0, level], axis=2).reshape(len(batch), -1)
            yield batch.filter(pa.array(1 / (1 + np.exp(-(weights[0] + features @ weights[1:]))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
