"""Toxicity of texts after noisy-channel deobfuscation.

Words written in leetspeak, with separators or spaces between the letters, or
with letters repeated are read as the output of a noisy channel.  Each such
token spans a lattice (every character as itself, as the letters it may stand
for, or as nothing), and a Viterbi search under a character trigram model finds
the likeliest restored text.  The score comes from the words of the text and of
what was restored from it.

Stems that mark a text are learned from labelled rows, by the log-odds of their
distinct contexts, so that many copies of one text count once, and a logistic
regression on the stems' counts.  The trigrams are counted on the cluster, from
the words of all documents outside the held-out part; letters that neither a
stem has nor a sign can stand for are one symbol to them, so that the table's
size is bounded whatever the corpus holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrays import slices, tidy

#: Labelled rows that the models are learned from, at most; those with the smallest hash of the id.
TRAIN_ROWS = 4000
#: A marking stem has so many letters, so many distinct contexts in texts of
#: label 1, and such a lower bound (95 %) of its log-odds.
STEM_LETTERS, LEAST_CONTEXTS, LEAST_ODDS = (3, 10), 5, 1.5
#: The ridge of the regression.
RIDGE = 0.01

# What a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_INVISIBLE = "\u200b\u200c\u200d\u2060\u00ad\ufeff"
_DROPPED = frozenset("*.-_~^'`·•,/\\#%&=:; !" + _INVISIBLE)
_AS_ITSELF, _AS_OTHER, _AS_NOTHING, _AS_REPEAT, _AS_BREAK = 0.1, 0.4, 0.7, 0.4, 4.0

#: The symbol of all letters outside the trigrams' alphabet.
OUTSIDE = "\x00"

_WORD = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
_ONE = re.compile(r"[^\W_]|[@$!|+€£¡(]")


def letters_of(stems: Iterable[str]) -> frozenset[str]:
    """Letters of the stems, and those that signs may stand for."""
    return frozenset("".join([*stems, *STANDS_FOR.values()]))


@dataclass
class Model:
    """What scoring needs, small enough to go with each task."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -10.0
    trigrams: dict[str, dict[str, float]] = field(default_factory=dict)
    default: float = math.log(200)

    def __post_init__(self) -> None:
        self.alphabet = letters_of(self.weights)
        self.begins = re.compile("|".join(sorted(map(re.escape, self.weights), key=len, reverse=True)) or "(?!)")
        self.heads = frozenset(x[:3] for x in self.weights)
        # A "!" may be an i or nothing, so a skeleton's letters may have some between them.
        letter = lambda c: f"{c}(?:!*{c})*" if c != "i" else "[i!](?:!*[i!])*"
        self.skeletons = re.compile("|".join(sorted("!*".join(map(letter, x)) for x in {skeleton(x) for x in self.weights} if x)) or "(?!)")

    def cost(self, before: str, char: str) -> float:
        """Negative log probability of ``char`` after the two characters ``before``, all in the model's alphabet."""
        return self.trigrams.get(before, {}).get(char, self.default)

    def known(self, char: str) -> str:
        """The character, or the symbol that stands for letters outside the alphabet."""
        return char if char == " " or char in self.alphabet else OUTSIDE

    def stem(self, word: str) -> str | None:
        """The marking stem that the word begins with."""
        found = self.begins.match(word) if word[:3] in self.heads else None
        return found.group() if found else None


def learn(
    rows: list[tuple[str, int]],
    least_contexts: int = LEAST_CONTEXTS,
    least_odds: float = LEAST_ODDS,
    trigrams: Callable[[Model], dict[str, dict[str, float]]] | None = None,
) -> Model:
    """A model from (text, label); ``trigrams`` gives the character costs for its stems, by default from the rows' own words."""
    texts = sorted(set(rows))
    vocabulary: Counter = Counter()
    contexts: tuple[set, set] = (set(), set())
    for text, label in texts:
        w = _WORD.findall(text.lower())
        contexts[label].update(zip(["", *w], w, [*w[1:], ""], strict=False))
        vocabulary.update(w)
    low, high = STEM_LETTERS
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for label in (1, 0):  # stems that texts of label 1 lack need no counts
        for word, n in Counter(w for _, w, _ in contexts[label]).items():
            for k in range(low, min(len(word), high) + 1):
                if label or word[:k] in count[1]:
                    count[label][word[:k]] += n
        if label:
            for stem in [x for x, n in count[1].items() if n < least_contexts]:
                del count[1][stem]
    clean, toxic = max(1, len(contexts[0])), max(1, len(contexts[1]))
    found = []
    for stem, t in count[1].items():
        n = count[0][stem]
        odds = math.log((t + 0.5) / toxic) - math.log((n + 0.5) / clean)
        if odds - 1.64 * math.sqrt(1 / (n + 0.5) + 1 / (t + 0.5)) >= least_odds:
            share = (t + n) * toxic / (clean + toxic)
            found.append((t * math.log(t / share) + (n and n * math.log(n / (t + n - share))), len(stem), stem))
    stems: list[str] = []
    for _, _, stem in sorted(found, reverse=True):  # of related stems the one that tells most
        if not any(stem.startswith(x) or x.startswith(stem) for x in stems):
            stems.append(stem)
    model = Model(dict.fromkeys(stems, 0.0))
    pure = [not count[0][s] for s in stems]
    model.trigrams = trigrams(model) if trigrams else _trigrams(vocabulary, model)
    memo: dict[str, tuple[str, ...]] = {}
    counts = [(marks(text, model, memo), label) for text, label in texts]
    # Stems that texts of label 0 lack share a weight, to which each adds its own.
    each = [[math.log2(1 + c[s]) for s in stems] for c, _ in counts]
    x = np.array([[*of, sum(n for n, alone in zip(of, pure, strict=True) if alone), 1] for of in each], float).reshape(len(counts), len(stems) + 2)
    *weights, shared, model.intercept = _logistic(x, np.array([y for _, y in counts], float))
    model.weights = {s: w + shared * alone for s, w, alone in zip(stems, weights, pure, strict=True)}
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps; the last column is the intercept."""
    if not len(y):
        return [0.0, -10.0]
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


#: The channel's words are mostly marked ones: so much more they weigh.
MARKED_WEIGHT = 20


def _trigrams(vocabulary: Counter, model: Model) -> dict[str, dict[str, float]]:
    counts: Counter = Counter()
    for word, n in vocabulary.items():
        n = math.sqrt(n) * (MARKED_WEIGHT if model.stem(word) else 1)
        padded = f"  {''.join(map(model.known, word))} "
        for k in range(2, len(padded)):
            counts[padded[k - 2 : k], padded[k]] += n
    return _costs(((b, c, n) for (b, c), n in counts.items()), model.default)


def _costs(counts: Iterable[tuple[str, str, float]], default: float) -> dict[str, dict[str, float]]:
    of: dict[str, dict[str, float]] = defaultdict(dict)
    for before, char, n in counts:
        of[before][char] = n
    return {b: {c: min(default, -math.log(n / (sum(x.values()) + 1))) for c, n in x.items()} for b, x in of.items()}


def corpus_trigrams(docs: DataFrame, *, id_col: str, text_col: str, parts: int, held_part: int) -> Callable[[Model], dict[str, dict[str, float]]]:
    """Character costs from the words of all texts outside the held-out part; a word weighs the root of its occurrences."""

    def count(model: Model) -> dict[str, dict[str, float]]:
        if not model.weights:
            return {}
        teaching = docs.where(F.expr(f"coalesce(crc32(cast(`{id_col}` as string)) % {parts} != {held_part}, true)"))
        words = teaching.select(F.explode(F.expr(f"regexp_extract_all(lower(cast(`{text_col}` as string)), '\\\\p{{L}}+', 0)")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        stems = "|".join(map(re.escape, model.weights))
        weight = F.sqrt("n") * F.when(F.col("word").rlike(f"^({stems})"), MARKED_WEIGHT).otherwise(1)
        plain = F.regexp_replace("word", f"[^{''.join(sorted(map(re.escape, model.alphabet)))}]", OUTSIDE)
        padded = words.select(weight.alias("weight"), F.concat(F.lit("  "), plain, F.lit(" ")).alias("x"))
        each = padded.select("weight", F.explode(F.expr("transform(sequence(1, length(x) - 2), i -> substring(x, i, 3))")).alias("gram"))
        # At most one row for each three letters of a fixed alphabet.
        rows = each.groupBy("gram").agg(F.sum("weight").alias("n")).orderBy("gram").collect()
        return _costs(((r.gram[:2], r.gram[2], r.n) for r in rows), model.default)

    return count


def restore(token: str, model: Model) -> str:
    """The likeliest text behind a token, by Viterbi search over its lattice."""
    states: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
    previous = ""
    for char in token:
        options = [(char, _AS_ITSELF)] if char.isalpha() else []
        options += [(c, _AS_OTHER) for c in STANDS_FOR.get(char, "")]
        if char == previous:
            options.append(("", _AS_REPEAT))
        if char in _DROPPED or char == "!":
            options.append(("", _AS_NOTHING))
            options.append((" ", _AS_OTHER if char == " " else _AS_BREAK))
        if not options:
            options = [(char, _AS_OTHER)]
        after: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in states.items():
            for out, extra in options:
                if not out:
                    to, total, now = state, cost + extra, text
                else:
                    seen = model.known(out)
                    to, total, now = (state[1] + seen if out != " " else "  "), cost + extra + model.cost(state, seen), text + out
                if to not in after or total < after[to][0]:
                    after[to] = (total, now)
        states, previous = after, char
    ends = [(cost + model.cost(state, " "), text) for state, (cost, text) in states.items()]
    return min(ends)[1]


def skeleton(token: str) -> str:
    """Letters of a token and its "!", with those that one sign can stand for made one, and without repeats."""
    out = ""
    for c in token:
        if c != "!":
            c = STANDS_FOR.get(c, c)[0]
            c = "i" if c == "l" else c
        if (c.isalpha() or c == "!") and c != out[-1:]:
            out += c
    return out


def read(token: str, model: Model) -> tuple[str, ...]:
    """Marking stems of a token as it stands, or else as restored."""
    core = token.strip(".,")
    if core.isalpha():
        stem = model.stem(core)
        if stem or not _DOUBLE.search(core):  # letters stand for themselves, so only repeated ones can be read otherwise
            return (stem,) if stem else ()
    stems = [x for w in _WORD.findall(token) if (x := model.stem(w))]
    if stems or not (" " in token or _LETTER.search(token)):  # without any letter it is a number
        return tuple(stems)
    # No reading holds a stem whose skeleton the token's lacks.
    if not model.skeletons.search(skeleton(token)):
        return ()
    token = re.sub(r"(.)\1{2,}", r"\1\1", token)
    return tuple(x for w in _WORD.findall(restore(token, model)) if (x := model.stem(w)))


def marks(text: str | None, model: Model, memo: dict[str, tuple[str, ...]]) -> Counter:
    """How often each marking stem occurs, as it stands or restored; ``memo`` keeps what tokens gave."""
    found: Counter = Counter()
    if not text or not model.weights:
        return found
    tokens = text.lower().split()
    get = memo.get
    for token in tokens:
        stems = get(token)
        if stems is None:
            stems = memo[token] = read(token, model)
        if stems:
            found.update(stems)
    ones = [k for k, token in enumerate(tokens) if len(token) == 1]
    if len(ones) > 2:
        for run in _runs(tokens, ones):
            found.update(read(" ".join(run), model))
    return found


def _runs(tokens: list[str], ones: list[int]) -> Iterator[list[str]]:
    """Runs of three and more tokens of one character."""
    begin = 0
    for k in range(1, len(ones) + 1):
        if k == len(ones) or ones[k] != ones[k - 1] + 1:
            if k - begin > 2 and all(_ONE.match(tokens[i]) for i in ones[begin:k]):
                yield [tokens[i] for i in ones[begin:k]]
            begin = k


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for part in slices(batches):
            if len(memo) > 100_000:
                memo.clear()
            scores = [score_of(marks(text, model, memo), model) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_of(found: Counter, model: Model) -> float:
    """Probability of label 1 given the stems' counts."""
    total = model.intercept + sum(model.weights[s] * math.log2(1 + n) for s, n in found.items())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def train_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, parts: int, held_part: int, limit: int) -> list[tuple[str, int]]:
    """At most ``limit`` labelled texts outside the held-out part, those with the smallest hash of the id."""
    chosen = (
        labels.where(F.col(label_col).isin(0, 1))
        .where(f"crc32(cast({id_col} as string)) % {parts} != {held_part}")
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").where("text is not null")
    return [(r.text, r.label) for r in found.select("text", "label").toLocalIterator()]


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    parts: int = 5,
    held_part: int = 0,
    limit: int = TRAIN_ROWS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row for each input row.

    A null or empty text has no marks and gets the score of texts without any.
    A null id is not held out.  Without labelled rows every score is near 0.
    Repeated rows get a row each; other columns are not read.
    """
    rows = train_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, parts=parts, held_part=held_part, limit=limit)
    model = learn(rows, trigrams=corpus_trigrams(docs, id_col=id_col, text_col=text_col, parts=parts, held_part=held_part))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_scorer(model)), "doc_id long, score double")
    held = F.coalesce(F.expr(f"crc32(cast(doc_id as string)) % {parts} = {held_part}"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
