"""Toxicity by a weighted grammar of finite-state transducers.

Lexicon: words, and stems that several words share, whose document counts in labelled
toxic and clean texts differ by more than chance would allow for the number of
candidates (likelihood ratio against 2 ln of that number); the weight is the smoothed log odds.
Near copies share a signature and count once.

Grammar: a text is read clause by clause. Each token is a symbol (insult, threat, target, third
person, first person, modal, negation, reported speech, quotation mark, end, other). Five transducers
read the symbols: the insult machine marks learned words; the threat machine accepts a threat verb, or a
learned word after "I will" and the like, together with a person, in active or passive order; the target machine marks insults near a
person on either side; the negation machine marks what stands in the scope of a negation; the report
machine marks what follows a verb of saying or stands in quotation marks. They run as one composed
machine, whose product states are built when first reached.

Scores: a clause counts once, by its strongest match: that match's weight goes to the class given by
its marks. A threat has a weight without being learned. A document's features are the clause weights
summed by class; a logistic model, drawn towards prior weights for negated, reported, aimed and
threatening clauses, turns them into a score.

Scale: every labelled row that may be learned from is learned from. Those texts, found by a bounded filter of the ids, meet
their labels in one shuffle and are written once; candidates are counted and tested in tables, and the logistic model takes sums of 306
numbers a task, so only the lexicon of words that pass reaches the driver. Scoring reads every whole
text and shuffles nothing.

Defined results: null and empty texts get the score of a text without matches; without
labels of both kinds nothing is learned and every score comes from the smoothed share of toxic rows (0
without labels); several labels of one id count as toxic if one is; equal texts score equally and
repeated rows are scored each; very long texts are read whole, in memory in proportion to one text; null ids are
held out; empty tables give empty tables; extra columns are ignored by scores() and kept by reject(), whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalpanel.llm.shared import SEED, bounded_batches, collected, discard, filter_array, filter_bits, filter_words, maybe_member, released, shielded, stage, unshielded

#: Bits of the filters of labelled ids and of candidates: at most 2**18 and 2**17 words of 64.
ID_BITS = 24
NAME_BITS = 23
#: Words and counts that a task remembers; then it begins anew.
MEMO_WORDS = 250_000
#: Lengths of the stems that are tried, besides whole words; a stem must be shared by so many words.
STEMS = (4, 5)
STEM_WORDS = 3
PRECISION = 0.85
#: Tokens for which a negation holds, within which a person counts, within which "I" or "will" makes a verb a threat, and from a person to a passive verb.
NEGATION_SCOPE = 3
TARGET_SCOPE = 4
THREAT_SCOPE = 3
PASSIVE_SCOPE = 5
#: A clause without punctuation ends after so many tokens.
CLAUSE_TOKENS = 40
#: Lexical weight of a threat, learned or not.
THREAT_WEIGHT = 5.0
#: Weights before any label is seen: of a plain match, and what each mark adds to it.
PRIOR = {"plain": 1.0, "negated": -0.8, "reported": -0.5, "aimed": 0.3, "threat": 1.0}
INTERCEPT = -3.0
PULL = 1.0

# Function words and threat verbs of four languages.
TARGETS = frozenset("you your yours yourself u du dich dir ihr euch tu te toi vous ton ta usted ustedes tú ti vosotros".split())
PERSONS = frozenset("he she they him her them these those er sie il elle ils él ella ellos".split())
FIRST = frozenset("i we i'll we'll i'm we're ich wir je nous yo nosotros".split())
MODALS = frozenset("will shall gonna going must should werde werden wirst vais allons vas voy vamos vas".split())
NEGATIONS = frozenset("not no never nor neither without isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine nie niemals ohne ne pas jamais sans ni nunca jamás sin".split())
REPORTS = frozenset("said says say saying told tells wrote writes claims claimed called according quoted sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split())
THREATS = frozenset(
    "kill killed murder murdered hurt destroy destroyed shoot shot stab stabbed strangle töten umbringen schlagen erschießen "
    "tuer frapper détruire étrangler matar golpear destruir".split()
)

_TOKEN = re.compile(r"\w+(?:['’]\w+)?|[.!?;\n\"“”«»„]")
_ENDS = frozenset(".!?;\n")
_QUOTES = frozenset("\"“”«»„")
OTHER, INSULT, THREAT, TARGET, PERSON, FIRST_PERSON, MODAL, NEGATION, REPORT, QUOTE, END = range(11)
_SYMBOLS = {
    **dict.fromkeys(_QUOTES, QUOTE), **dict.fromkeys(REPORTS, REPORT), **dict.fromkeys(MODALS, MODAL), **dict.fromkeys(FIRST, FIRST_PERSON),
    **dict.fromkeys(PERSONS, PERSON), **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(_ENDS, END), **dict.fromkeys(THREATS, THREAT),
}

# A transducer: (start state, step(state, symbol) -> (state, mark)).
Machine = tuple[object, Callable]


def insult_machine() -> Machine:
    """Marks learned words."""
    return (), lambda state, symbol: (state, symbol == INSULT)


def negation_machine() -> Machine:
    def step(left, symbol):
        if symbol == NEGATION:
            return NEGATION_SCOPE, False
        return (0 if symbol == END else max(0, left - 1)), left > 0

    return 0, step


def report_machine() -> Machine:
    def step(state, symbol):
        said, quoted = state
        if symbol == END:
            return (False, quoted), said or quoted
        if symbol == QUOTE:
            return (said, not quoted), said or quoted
        return (said or symbol == REPORT, quoted), said or quoted

    return (False, False), step


def target_machine() -> Machine:
    """Marks insults after a person, and persons after an insult."""

    def step(state, symbol):
        person, insult = state
        if symbol == END:
            return (0, 0), False
        met = insult > 0 if symbol in (TARGET, PERSON) else person > 0 if symbol == INSULT else False
        person = TARGET_SCOPE if symbol in (TARGET, PERSON) else max(0, person - 1)
        insult = TARGET_SCOPE if symbol == INSULT else max(0, insult - 1)
        return (person, insult), met

    return (0, 0), step


def threat_machine() -> Machine:
    """Marks the last word of a threat: the person after the verb, or the verb of "you will be ...".

    A verb needs the person addressed; after a first person or modal any person will do, and a learned word is a verb."""

    def step(state, symbol):
        armed, verb, anyone, person = state
        if symbol == END:
            return (0, 0, False, 0), False
        met = (symbol == TARGET and verb > 0) or (symbol == PERSON and verb > 0 and anyone) or (symbol == THREAT and person > 0 and armed > 0)
        if symbol == THREAT or (symbol == INSULT and armed):
            verb, anyone = TARGET_SCOPE, armed > 0
        else:
            verb = 0 if met else max(0, verb - 1)
            anyone = anyone and verb > 0
        armed = THREAT_SCOPE if symbol in (FIRST_PERSON, MODAL) else max(0, armed - 1)
        person = PASSIVE_SCOPE if symbol == TARGET else max(0, person - 1)
        return (armed, verb, anyone, person), met

    return (0, 0, False, 0), step


class Composition:
    """The product of machines; its states are numbered and its rows filled when first reached. Bit k of a mark is machine k's."""

    def __init__(self, *machines: Machine):
        self.machines = machines
        self.states = [tuple(m[0] for m in machines)]
        self.number = {self.states[0]: 0}
        self.rows: list[list[tuple[int, int] | None]] = [[None] * 11]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.rows[state][symbol]
        if found is None:
            steps = [step(s, symbol) for s, (_, step) in zip(self.states[state], self.machines, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in self.number:
                self.number[after] = len(self.states)
                self.states.append(after)
                self.rows.append([None] * 11)
            found = self.rows[state][symbol] = self.number[after], sum(bool(m) << k for k, (_, m) in enumerate(steps))
        return found


#: Bits of a mark, and those of a class: negated, reported, aimed, threat.
_NEGATED, _REPORTED, _AIMED, _THREAT, _INSULT = 1, 2, 4, 8, 16
CLASSES = 16


def _prior() -> np.ndarray:
    bits = np.arange(CLASSES)[:, None] >> np.arange(4) & 1
    return PRIOR["plain"] + bits @ np.array([PRIOR["negated"], PRIOR["reported"], PRIOR["aimed"], PRIOR["threat"]])


class Grammar:
    """A lexicon with the composed transducers."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {w[: min(STEMS)] for w in lexicon}
        self.machine = Composition(negation_machine(), report_machine(), target_machine(), threat_machine(), insult_machine())

    def weight(self, word: str) -> float:
        """Of the word itself, or of its longest stem."""
        found = self.lexicon.get(word)
        for n in sorted(STEMS, reverse=True):
            if found is None and len(word) > n:
                found = self.lexicon.get(word[:n] + "*")
        return found or 0.0

    def clauses(self, text: str | None) -> list[tuple[int, float]]:
        """(class, weight) of the strongest match of each clause that has one; of equal ones the first."""
        tokens = _TOKEN.findall((text or "").lower())
        cut, heads = min(STEMS), self.heads
        weights = {i: w for i, t in enumerate(tokens) if t[:cut] in heads and (w := self.weight(t))}
        if not weights and THREATS.isdisjoint(tokens):
            return []
        out: list[tuple[int, float]] = []
        matches: list[list] = []
        state, length, step = 0, 0, self.machine.step

        def close() -> None:
            if matches:
                best = max(matches, key=lambda m: m[2])
                out.append((best[1], best[2]))
                matches.clear()

        for i, token in enumerate(tokens):
            symbol = INSULT if i in weights else _SYMBOLS.get(token, OTHER)
            if length >= CLAUSE_TOKENS and symbol != END:
                state, _ = step(state, END)
                close()
                length = 0
            state, mark = step(state, symbol)
            length += 1
            if symbol == END:
                close()
                length = 0
                continue
            if mark & _INSULT:
                matches.append([i, mark & (_NEGATED | _REPORTED | _AIMED), weights[i]])
            elif mark & _AIMED:
                for match in matches:
                    if i - match[0] <= TARGET_SCOPE and not match[1] & _THREAT:
                        match[1] |= _AIMED
            if mark & _THREAT:
                matches.append([i, mark & (_NEGATED | _REPORTED) | _AIMED | _THREAT, THREAT_WEIGHT])
        close()
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Clause weights summed by class."""
        out = np.zeros(CLASSES)
        for k, weight in self.clauses(text):
            out[k] += weight
        return out


def _training(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """(text, toxic) of all labelled rows that may be learned from, written, and the numbers of such labels; a bounded filter
    lets the other texts stay where they are. Labels may outgrow a broadcast, so they are merged at every size."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.expr("int(toxic <> 0)")).alias("toxic"))
    known = stage(known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), "toxic-known")
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bits = filter_bits(sum(count.values()), ID_BITS)
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    words = stage(filter_words(known, hashed, bits), "toxic-filter")
    texts = stage(maybe_member(docs.select("doc_id", "text"), words, hashed, bits).join(known.hint("merge"), "doc_id").select("text", "toxic"), "toxic-texts")
    discard(known, words)
    return texts, count.get(1, 0), count.get(0, 0)


def _words(text: str | None) -> set[str]:
    return set(re.findall(r"\w+", (text or "").lower()))


def _toxic_words(texts: DataFrame) -> DataFrame:
    """(word, sig) of each text; near copies share sig, the least hash of three words in a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                run_of = (text or "").lower().split()
                sig = min((zlib.crc32(" ".join(run_of[i : i + 3]).encode()) for i in range(max(1, len(run_of) - 2))), default=0)
                found = sorted(_words(text))
                yield pd.DataFrame({"word": pd.Series(found, dtype=object), "sig": np.full(len(found), sig, np.int64)})

    return texts.select("text").mapInPandas(released(run), "word string, sig long")


def _clean_counts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(word, c): how many clean texts hold each candidate; of other names those that the bounded filter of candidates lets through."""
    wanted = texts.sparkSession.sparkContext.broadcast(filter_array(names, F.xxhash64("word"), NAME_BITS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        memo: dict[str, list[str]] = {}
        n: dict[str, int] = {}

        def candidates(word: str) -> list[str]:
            names = [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]
            slots = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) >> (64 - NAME_BITS) for x in names]
            return [x for x, slot in zip(names, slots, strict=True) if int(wanted.value[slot >> 6]) >> (slot & 63) & 1]

        def counted() -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series(list(n), dtype=object), "c": np.fromiter(n.values(), np.int64, len(n))})

        for batch in batches:
            for text in batch["text"]:
                held: set[str] = set()
                for word in _words(text):
                    found = memo.get(word)
                    if found is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        found = memo[word] = candidates(word)
                    held.update(found)
                for name in held:
                    n[name] = n.get(name, 0) + 1
            if len(n) >= MEMO_WORDS:
                yield counted()
                n.clear()
        yield counted()

    return texts.select("text").mapInPandas(released(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _likelihood_ratio(na: int, nb: int) -> Column:
    """Of t of na toxic texts against c of nb clean ones."""

    def part(seen: Column, due: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / F.greatest(due, F.lit(1e-12)))).otherwise(0.0)

    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    rate = (t + c) / F.lit(float(na + nb))
    return 2 * (part(t, rate * na) + part(c, rate * nb) + part(na - t, (1 - rate) * na) + part(nb - c, (1 - rate) * nb))


def learn_lexicon(texts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Words, and stems as `stem*`, with their log odds."""
    if not n_toxic or not n_clean:
        return {}
    seen = stage(_toxic_words(texts.filter("toxic = 1")).distinct(), "toxic-words")
    groups = seen.select(F.countDistinct("sig")).first()[0] or 1
    counted = seen.groupBy("word").agg(F.count(F.lit(1)).alias("t")).withColumn("n_words", F.lit(STEM_WORDS))
    for k in STEMS:
        stem = seen.filter(F.length("word") > k).select(F.concat(F.substring("word", 1, k), F.lit("*")).alias("word"), F.col("word").alias("w"), "sig")
        counted = counted.unionByName(stem.groupBy("word").agg(F.countDistinct("sig").alias("t"), F.countDistinct("w").alias("n_words")))
    counted = stage(counted, "toxic-counts")
    limit = 2 * np.log(max(2, counted.count()))
    # a candidate unseen in clean texts needs at least so many toxic ones to pass the test
    least = max(3, int(limit / (2 * np.log((n_toxic + n_clean) / n_toxic))))
    names = stage(counted.filter(f"t >= {least} and n_words >= {STEM_WORDS}").select("word", "t"), "toxic-names")
    discard(seen, counted)
    both = names.join(_clean_counts(texts.filter("toxic = 0"), names), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    passed = both.filter(F.col("t") / (F.col("t") + F.col("c")) >= PRECISION).filter(_likelihood_ratio(groups, n_clean) > float(limit))
    rows = passed.orderBy(F.desc("t"), "word").collect()
    discard(names)
    t, c = np.array([r["t"] for r in rows], float), np.array([r["c"] for r in rows], float)
    odds = np.log((t + 0.5) / (groups + 1)) - np.log((c + 0.5) / (n_clean + 1))
    return {r["word"]: float(x) for r, x in zip(rows, odds, strict=True)}


def _sums(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Gradient and, row by row, Hessian of the logistic loss of rows (toxic, x, n) at w: one row of sums a task."""
    size = len(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size + size * size)
        for batch in batches:
            full = np.column_stack([_squash(np.array(batch["x"].tolist()).reshape(-1, size - 1)), np.ones(len(batch))])
            n, y = batch["n"].to_numpy(float), batch["toxic"].to_numpy(float)
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            out[:size] += full.T @ (n * (p - y))
            out[size:] += ((full * (n * p * (1 - p))[:, None]).T @ full).ravel()
        yield pd.DataFrame({"sums": [out]})

    return sum((np.array(r["sums"]) for r in rows.mapInPandas(run, "sums array<double>").collect()), np.zeros(size + size * size))


def _fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Logistic weights, drawn towards the prior, by Newton's method; rounded, so that the order of sums does not show."""
    w = np.append(_prior(), INTERCEPT)
    prior = w.copy()
    for _ in range(30):
        sums = _sums(rows, w)
        grad = sums[: len(w)] + PULL * (w - prior)
        hess = sums[len(w) :].reshape(len(w), -1) + PULL * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = np.round(w, 9)
    return w[:-1], float(w[-1])


def _squash(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: lexicon, weights by class, intercept."""
    bounded_batches(docs.sparkSession)
    texts, n_toxic, n_clean = _training(docs, labels)
    lexicon = learn_lexicon(texts, n_toxic, n_clean)
    if not lexicon:
        discard(texts)
        share = n_toxic / (n_toxic + n_clean + 1)
        return {"lexicon": {}, "weights": np.zeros(CLASSES), "intercept": float(np.log(share / (1 - share))) if share else -40.0}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon)
        for batch in batches:
            found = np.array([grammar.features(t) for t in batch["text"]]).reshape(-1, CLASSES)
            yield pd.DataFrame({"toxic": batch["toxic"].to_numpy(), "x": list(found)})

    rows = texts.mapInPandas(released(run), "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows, "toxic-features")
    discard(texts)
    weights, intercept = _fit(rows)
    discard(rows)
    collected(docs.sparkSession)
    return {"lexicon": lexicon, "weights": weights, "intercept": intercept}


def _score_udf(model: dict):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(model["lexicon"])
        for series in texts:
            x = np.array([grammar.features(t) for t in series]).reshape(-1, CLASSES)
            z = _squash(x) @ model["weights"] + model["intercept"]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    run = released(run)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(texts)

    return score


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    score = _score_udf(fit(docs, labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents predicted toxic."""
    score = _score_udf(fit(docs, labels))
    return unshielded(shielded(docs, "text").withColumn("x_score", score("text")).filter("x_score < 0.5"), docs.columns)


def query(spark, sf_dir):
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
