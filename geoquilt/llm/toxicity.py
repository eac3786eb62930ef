"""Toxicity: a lexicon trie searched with Levenshtein automata, and context windows.

The lexicon is learnt from labelled texts: words, and stems (beginnings of
words) that stand in many toxic texts and hardly in others, near copies counted
once.  A text's words run through the automaton of all words within one edit of
a lexicon term, two of terms of nine or more letters; it is the product of the
lexicon's trie and the edit automaton, made state by state as it is used.  Two
neighbours in the wrong order are one edit, and so is a digit or sign between
letters; letters written several times, digits and signs that look like letters,
and letters with signs or spaces between them are read as the word they spell.
Words that other texts use as much as toxic ones are no misspellings.
Matches are summed over windows of words, apart for those that are quoted or reported, and a logistic model on these sums
gives the score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.llm.labelled import training_texts
from geoquilt.storage import stored

#: ASCII letters and everything beyond ASCII; the same in Java and Python.
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(LETTERS)
_LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
#: Letters with digits or signs between or before them; one edit bridges one of those.
JOINED = re.compile(rf"(?<!{_LETTER})(?:[0-9@$!](?={_LETTER}))?{_LETTER}+(?:[\x21-\x40\x5B-\x60\x7B-\x7E]{{1,2}}{_LETTER}+)+|(?<!{_LETTER})[0-9@$]{_LETTER}{{3,}}")
#: Single letters one and the same sign or space apart.
SPACED = re.compile(rf"(?<!{_LETTER})(?={_LETTER}([ .*_-]))(?:{_LETTER}\1){{3,}}{_LETTER}(?!{_LETTER})")
#: Digits and signs that are written for letters.
ALIKE = str.maketrans("0134578@$!|+", "oieastbasiit")
STEMS = (4, 5, 6, 7)
_RUN = re.compile(r"(.)\1+")
#: One edit of a shorter term makes too many other words.
FUZZY_LENGTH = 4
#: Terms that two edits may change, and squeezed terms that one may.
FAR_LENGTH, SQUEEZED_LENGTH = 9, 5
WINDOW = 12
QUOTES = {'"': 0, "“": 1, "”": -1, "„": 1, "«": 1, "»": -1}
#: Words that report what another has said.
REPORTING = frozenset(
    "said says wrote writes quoted reported called "
    "sagte schrieb nannte zitierte dit disait ecrit dijo escribio llamo".split()
)
REACH = 4
FEATURES = 10
MAX_CACHE = 300_000
DETAIL = "struct<score:double,hits:int,fuzzy:int,quoted:int>"


def squeezed(word: str) -> str:
    """``word`` with every run of one letter as one."""
    return _RUN.sub(r"\1", word)


class Automaton:
    """Deterministic automaton of the words within some edits of a lexicon, made lazily.

    A state is the set of (trie node, edits, awaited character) that can be
    reached; reading a character follows the trie, or spends an edit on a
    substitution, an insertion, a deletion or two neighbours in the wrong order,
    of which the second is then awaited.
    """

    def __init__(self, words: dict[str, float], edits: int = 1) -> None:
        self.edits = edits
        self.next: list[dict[str, int]] = [{}]
        self.end: list[float] = [0.0]
        self.size: list[int] = [0]
        for word, weight in words.items():
            node = 0
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.end.append(0.0)
                    self.size.append(self.size[node] + 1)
                node = self.next[node][c]
            self.end[node] = max(weight, self.end[node])
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._id({(0, ""): 0})

    def _id(self, reached: dict[tuple[int, str], int]) -> int:
        """State of the reached nodes after deletions of lexicon characters; -1 is the dead one."""
        waiting = [x for x, e in reached.items() if not x[1] and e < self.edits]
        while waiting:
            node, _ = x = waiting.pop()
            for child in self.next[node].values():
                if reached[x] + 1 < reached.get((child, ""), self.edits + 1):
                    reached[child, ""] = reached[x] + 1
                    if reached[x] + 1 < self.edits:
                        waiting.append((child, ""))
        if not reached:
            return -1
        key = frozenset(reached.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[tuple[int, str], int] = {}

        def reach(node: int, awaited: str, edits: int) -> None:
            if edits <= self.edits and edits < reached.get((node, awaited), self.edits + 1):
                reached[node, awaited] = edits

        for (node, awaited), edits in self.states[state]:
            if awaited:
                if c == awaited:
                    reach(node, "", edits)
                continue
            if (child := self.next[node].get(c)) is not None:
                reach(child, "", edits)
            if edits < self.edits:
                reach(node, "", edits + 1)
                for d, child in self.next[node].items():
                    reach(child, "", edits + 1)
                    if d != c and (after := self.next[child].get(c)) is not None:
                        reach(after, d, edits + 1)
        self.moves[state][c] = to = self._id(reached)
        return to

    def match(self, word: str) -> tuple[float, bool]:
        """Weight of the best lexicon term within the edits, and whether it took any; (0, False) without."""
        if len(self.states) > MAX_CACHE:
            self._forget()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return 0.0, False
        ends = [(self.end[n], e) for (n, wait), e in self.states[state] if not wait and self.end[n] and (not e or self.size[n] >= FUZZY_LENGTH)]
        if exact := [w for w, e in ends if not e]:
            return max(exact), False
        return (max(w for w, _ in ends), True) if ends else (0.0, False)


@dataclass
class ToxicityModel:
    """Lexicon with weights, and a logistic model over the features of a text; ``known`` words are not misspelt."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    known: frozenset[str] = frozenset()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("words", "stems", "weights", "known")}

    def _prepared(self) -> None:
        if not hasattr(self, "automaton"):
            self.automaton, self.cache, self.bridges = Automaton(self.words), {}, {}
            self.far = Automaton({w: x for w, x in self.words.items() if len(w) >= FAR_LENGTH}, 2)
            short = {squeezed(w): x for w, x in self.words.items()}
            self.squeezed = Automaton({w: x for w, x in short.items() if len(w) >= SQUEEZED_LENGTH})

    def near(self, word: str) -> tuple[float, bool]:
        """Weight of the best term that a word may be a spelling of, and whether it is misspelt."""
        weight, fuzzy = self.automaton.match(word)
        if not weight and len(word) >= FAR_LENGTH - 2:
            weight, fuzzy = self.far.match(word)
        if not weight and (short := squeezed(word)) != word:  # letters written twice or more
            weight, fuzzy = self.squeezed.match(short)
        return weight, fuzzy or bool(weight and word not in self.words)

    def match(self, word: str) -> tuple[float, bool] | None:
        """Weight and fuzziness of a lower-case word; stems match their beginnings exactly."""
        weight, fuzzy = self.near(word)
        if fuzzy and word in self.known:
            weight, fuzzy = 0.0, False
        stem = max((self.stems.get(word[:n], 0.0) for n in STEMS), default=0.0)
        if stem and (fuzzy or stem > weight):
            weight, fuzzy = stem, False
        return (weight, fuzzy) if weight else None

    def bridged(self, run: str) -> list[tuple[int, int, float]]:
        """(from, to, weight) of misspelt terms in a run of letters, digits and signs.

        A term stands in two neighbouring parts and the sign between them, or, in
        the whole run, behind digits and signs that look like letters.
        """
        spans = [m.span() for m in WORD.finditer(run)]
        found = [(a, b, w) for (a, _), (_, b) in zip(spans, spans[1:]) if (w := self.automaton.match(run[a:b])[0])]
        plain = run.translate(ALIKE)
        if not found and plain != run and plain.isalpha() and plain not in self.known and (w := self.near(plain)[0]):
            found.append((0, len(run), w))
        return found

    def matches(self, text: str) -> tuple[list[tuple[int, float, bool, bool]], int]:
        """Matches (word number, weight, fuzzy, quoted) of a text, and its number of words."""
        self._prepared()
        low = text.lower()
        words = WORD.findall(low)
        if len(self.cache) > MAX_CACHE:
            self.cache = {}
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = self.match(w)
        hits = [(i, m) for i, w in enumerate(words) if (m := cache[w])]
        if len(self.bridges) > MAX_CACHE:
            self.bridges = {}
        bridges = self.bridges
        runs = set(JOINED.findall(low))
        for run in runs.difference(bridges):
            bridges[run] = self.bridged(run)
        places = [(m.start() + a, m.start() + b, w) for m in JOINED.finditer(low) for a, b, w in bridges[m[0]]] if any(bridges[run] for run in runs) else []
        for m in SPACED.finditer(low):  # single letters, one sign apart
            letters = m[0][:: len(m[1]) + 1] if len(m[1]) == 1 else ""
            if len(letters) >= FUZZY_LENGTH and (w := self.automaton.match(letters)[0]):
                places.append((*m.span(), w))
        if places:
            taken, starts = {i for i, _ in hits}, [m.start() for m in WORD.finditer(low)]
            for a, b, w in sorted(places):
                own = range(bisect_left(starts, a), max(bisect_left(starts, b), bisect_left(starts, a) + 1))
                if taken.isdisjoint(own) and own.start < len(words):
                    taken.update(own)
                    hits.append((own.start, (w, True)))
            hits.sort()
        if not hits:
            return [], len(words)
        quoted = _quoted(low, words, {i for i, _ in hits})
        return [(i, m[0], m[1], i in quoted) for i, m in hits], len(words)

    def features(self, text: str) -> tuple[np.ndarray, list[tuple[int, float, bool, bool]]]:
        """Features of a whole text; an empty one has zeros."""
        found, n = self.matches(text)
        x = np.zeros(FEATURES)
        if found:
            groups = [[w for _, w, f, q in found if (f, q) == g] for g in ((False, False), (False, True), (True, False), (True, True))]
            x[:4] = [np.log1p(sum(g)) for g in groups]
            x[4:6] = [np.log1p(_window_score(found, q)) for q in (False, True)]
            x[6] = max((w for _, w, f, q in found if not f and not q), default=0.0)
            x[7] = np.log1p(1000 * sum(w for _, w, f, q in found if not q) / n) / 4
            x[8] = np.log1p(sum(not f and not q for _, _, f, q in found))
            x[9] = np.log1p(1000 * sum(not f and not q for _, _, f, q in found) / n) / 4
        return x, found

    def score(self, text: str) -> tuple[float, list[tuple[int, float, bool, bool]]]:
        x, found = self.features(text)
        return float(_sigmoid(x @ self.weights[:-1] + self.weights[-1])), found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def _window_score(found: list[tuple[int, float, bool, bool]], quoted: bool) -> float:
    """Largest sum of weights in any window of ``WINDOW`` words; a fuzzy match counts half."""
    best = total = 0.0
    first = 0
    own = [(i, w / 2 if f else w) for i, w, f, q in found if q == quoted]
    for i, w in own:
        total += w
        while own[first][0] <= i - WINDOW:
            total -= own[first][1]
            first += 1
        best = max(best, total)
    return best


def _quoted(text: str, words: list[str], hits: set[int]) -> set[int]:
    """The hits that stand between quotation marks of their line or shortly after a reporting word."""
    found = {i for i in hits if not REPORTING.isdisjoint(words[max(0, i - REACH) : i])}
    if any(q in text for q in QUOTES):
        marks = sorted((m.start(), QUOTES.get(m[0])) for m in re.finditer("[\n" + "".join(QUOTES) + "]", text))
        depth, at = 0, 0
        inside: list[bool] = []
        for p, (pos, turn) in enumerate(marks):  # a mark opens only if its line closes it
            inside.append(False)
            if turn is None:
                depth, at = 0, p
            elif depth and turn <= 0:
                for k in range(at, p):
                    inside[k] = True
                depth = 0
            elif not depth and turn >= 0:
                depth, at = 1, p
        places = [pos for pos, _ in marks]
        for i, m in enumerate(WORD.finditer(text)):
            if i in hits and (k := int(np.searchsorted(places, m.start())) - 1) >= 0 and inside[k]:
                found.add(i)
    return found


def learn_lexicon(texts: DataFrame, min_share: float = 0.001, min_support: int = 3, max_terms: int = 2000, min_g: float = 18.0, min_weight: float = 1.5) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and of stems from ``texts(doc_id, text, y)``.

    A term must stand in ``min_support`` toxic texts and ``min_share`` of them,
    and its log-likelihood ratio must reach ``min_g``; the best ``max_terms`` are
    kept; the bound is far above what labels of a bounded sample support.  Texts that share the least hash of their long words are near copies
    and count once.  The weight is the log ratio of the shares in toxic and other
    texts.  A stem is left out if one word has most of its support, or if a shorter
    stem is as good.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))
    def stems_of(n: int) -> Column:
        return F.transform(F.filter("w", lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    stems = [stems_of(n) for n in STEMS]
    long_words = F.transform(F.filter("w", lambda w: F.length(w) >= 8), lambda w: F.xxhash64(w))
    terms = (
        texts.select("y", words.alias("w"), F.xxhash64("doc_id", "text").alias("own"))
        .withColumn("key", F.coalesce(F.array_min(long_words), "own"))
        .select("y", "key", F.explode(F.array_distinct(F.flatten(F.array("w", *stems)))).alias("term"))
        .distinct()
    )
    totals = texts.groupBy("y").count().collect()
    n_toxic, n_other = (max(1, sum(r["count"] for r in totals if r["y"] == y)) for y in (1, 0))
    counts = terms.groupBy("term").agg(
        F.sum("y").cast("double").alias("t"), F.sum(1 - F.col("y")).cast("double").alias("o")
    ).where(F.col("t") >= max(min_support, min_share * n_toxic))
    all_n = n_toxic + n_other
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / ((F.col("t") + F.col("o")) * share))).otherwise(0.0)
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1) / ((F.col("o") + 0.5) / (n_other + 1)))
    ranked = (
        counts.withColumns({"g": 2 * (part(F.col("t"), n_toxic / all_n) + part(F.col("o"), n_other / all_n)), "weight": weight})
        .where((F.col("g") >= min_g) & (F.col("weight") >= min_weight))
        .orderBy(F.desc("g"), "term")
        .limit(max_terms)
        .collect()
    )
    found = {r["term"]: float(r["weight"]) for r in ranked}
    stem = {t[:-1]: w for t, w in found.items() if t.endswith("*")}
    word = {t: w for t, w in found.items() if not t.endswith("*")}
    support = {r["term"]: r["t"] for r in ranked}
    # a stem that owes its support to one word says less than the word
    stem = {s: w for s, w in stem.items() if support[s + "*"] * 0.7 > max((support[t] for t in word if t.startswith(s)), default=0)}
    # a longer stem adds nothing to a shorter one that is as sure of itself
    stem = {s: w for s, w in stem.items() if not any(stem.get(s[:n], -1.0) >= w - 0.5 for n in STEMS if n < len(s))}
    return word, stem


def known_words(texts: DataFrame, model: ToxicityModel, min_support: int = 2) -> frozenset[str]:
    """Words one edit from the lexicon that ``min_support`` other texts use, and a share of them no less than of toxic ones."""

    @F.arrow_udf("array<string>")
    def misspelt(column: pa.Array) -> pa.Array:
        model._prepared()
        found = ({w for w in WORD.findall(t.as_py().lower()) if model.near(w)[1]} for t in column)
        return pa.array([sorted(f) for f in found], pa.list_(pa.string()))

    totals = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    seen = texts.select("y", F.explode(misspelt("text")).alias("w")).groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o"))
    kept = seen.where((F.col("o") >= min_support) & (F.col("o") * totals.get(1, 0) >= F.col("t") * totals.get(0, 0)))
    return frozenset(r["w"] for r in kept.select("w").collect())


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 5000) -> ToxicityModel:
    """Learn lexicon and weights from about ``max_per_class`` labelled rows of each class.

    Only ids that are not held out teach.  Without toxic or without other rows
    the model scores every text by the share of toxic labels, 0.5 if there are none.
    """
    texts = stored(training_texts(docs, labels, "toxic", max_per_class), "toxicity-sample")
    model = ToxicityModel(*learn_lexicon(texts))

    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        return pa.array([model.features(t.as_py())[0].tolist() for t in column], pa.list_(pa.float64()))

    model.known = known_words(texts, model)
    rows = texts.select("y", features("text").alias("x")).collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        share = y.mean() if len(y) else 0.5
        model.weights[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    x = np.array([r["x"] for r in rows])
    model.weights = _logistic(np.column_stack([x, np.ones(len(x))]), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression with both classes of equal weight, by damped Newton steps."""
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = _sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w = w - step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
    return w


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Score, exact hits, misspelt hits and quoted hits of a whole text.

    A null text is empty, repeated rows score the same, a text of any length is
    read whole, and no other column is looked at, whatever its name.
    """

    @F.arrow_udf(DETAIL)
    def judge(column: pa.Array) -> pa.Array:
        out = []
        for t in column:
            score, found = model.score(t.as_py() or "")
            fuzzy, quoted = sum(f for _, _, f, _ in found), sum(q for _, _, _, q in found)
            out.append({"score": score, "hits": len(found) - fuzzy, "fuzzy": fuzzy, "quoted": quoted})
        return pa.array(out, pa.struct([("score", pa.float64()), ("hits", pa.int32()), ("fuzzy", pa.int32()), ("quoted", pa.int32())]))

    return judge(text)
