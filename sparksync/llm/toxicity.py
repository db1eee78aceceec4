"""Toxicity by a learned lexicon, matched with spelling errors, and the contexts of the matches.

The lexicon holds words and open stems that set toxic training texts apart. Its
trie is intersected with the Levenshtein automata of distance 1 and turned into
one table automaton over characters: a state is a set of (trie node, errors).
All words of a slice run through the table together, a character per step; a
word whose state is dead leaves. Stems match exactly, as their ends are open.

Words of any length take part. One of more than ``LONGEST`` characters is known
by its first ones, as an open stem. In scripts without spaces every character
is a word, and the stems that begin with it reach over those that follow.

Each match is scored by its window of ``WINDOW`` words to either side: learned
log-odds of hashed context words between training matches in toxic and in other
texts, and quotation marks around the term. A logistic regression turns the
counts of exact, misspelled and quoted matches and the context scores into a
probability, so that mere quotation and chance resemblance weigh what they
weighed in the labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparksync.llm.labelled import fit_logistic, fit_sample, fold, logistic
from sparksync.llm.text import NOT_ALNUM, Hasher, Words, fold_case, slices
from sparksync.session import checkpointed

FIT_ROWS = 20_000
TERM_BYTES = 256 << 10  # a word has up to a dozen terms, each an object of its own: of so much text a task holds them
TEXT_BYTES = 1 << 20  # arrays over a slice's bytes and words take dozens of times that
MIN_DOCS = 6
MIN_ODDS = 30.0
WINDOW = 6
CONTEXT_BUCKETS = 1 << 14
FUZZY_FROM = 5  # shorter terms match exactly only
SEPARATORS = bytes(b for b in NOT_ALNUM if b not in b"@$*")
QUOTES = b"\"'`"
LONGEST = 60  # characters of a term; of a longer word this many are the term, as an open stem
STEMS = (*range(1, 13), 18, 27, 40, LONGEST)  # lengths of stems, from 4 on in spaced scripts
# First and last character of the scripts written without spaces between words
# (Thai and Lao, Tibetan, Myanmar, Khmer, kana, Chinese characters and their extensions).
UNSPACED = (
    (0x0E00, 0x0EFF),
    (0x0F00, 0x0FFF),
    (0x1000, 0x109F),
    (0x1780, 0x17FF),
    (0x3040, 0x30FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0x20000, 0x3FFFF),
)
CHAR_BYTES = np.repeat([1, 2, 3, 4], [0xC0, 0x20, 0x10, 0x10])  # length of a character by its first byte


def characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The character that begins at each of the bytes ``at``, A-Z as a-z; broken ones get some number."""
    points = fold_case()[data[at]].astype(np.int64)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        size, value = CHAR_BYTES[points[wide]], points[wide]
        value &= 0xFF >> (size + 1)
        for k in (1, 2, 3):
            more = size > k
            next_byte = data[np.minimum(at[wide[more]] + k, len(data) - 1)]
            value[more] = value[more] << 6 | next_byte & 0x3F
        points[wide] = value
    return points


class Tokens(Words):
    """Words, each character of an unspaced script as one of its own.

    ``reach`` is how far a term that begins with the word may go: the word's
    end, or the end of the unbroken run for a character of an unspaced script.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        super().__init__(data, offsets, SEPARATORS)
        self.reach, self.unspaced = self.end, np.zeros(len(self.start), bool)
        at = np.flatnonzero(data >= 0xE0)  # shorter characters belong to spaced scripts
        low, high = np.array(UNSPACED).T
        points = characters(data, at)
        k = np.searchsorted(low, points, "right") - 1
        at = at[(k >= 0) & (points <= high[k])]
        if not len(at):
            return
        after = at + CHAR_BYTES[data[at]]
        after = after[after < self.end[np.searchsorted(self.start, at, "right") - 1]]
        start = np.unique(np.concatenate([self.start, at, after]))
        run = self.end[np.searchsorted(self.start, start, "right") - 1]
        self.end = np.minimum(np.append(start[1:], len(data)), run)
        self.unspaced = np.isin(start, at)
        self.reach = np.where(self.unspaced, run, self.end)
        self.start = start
        self.first = np.searchsorted(start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)


def _ends(text: bytes) -> list[int]:
    """Where the first ``LONGEST`` characters of ``text`` end, and one more."""
    if text.isascii():
        return list(range(1, min(len(text), LONGEST + 1) + 1))
    ends, i = [], 0
    while i < len(text) and len(ends) <= LONGEST:
        i = min(i + int(CHAR_BYTES[text[i]]), len(text))
        ends.append(i)
    return ends


def _terms(text: bytes, unspaced: bool) -> list[tuple[bytes, bool]]:
    """The terms a word is evidence for: itself, and open stems of it."""
    ends = _ends(text)
    stems = [(text[: ends[n - 1]], False) for n in STEMS if (unspaced or n >= 4) and n <= len(ends)]
    return stems if unspaced or len(ends) > LONGEST else [(text, True), *stems]


def _doc_words(s, words: Tokens) -> Iterator[set[tuple[bytes, bool]]]:
    """Per row the different (word, is of an unspaced script)."""
    raw = fold_case()[s.data].tobytes()
    stop = np.minimum(words.reach, words.start + 4 * (LONGEST + 1))
    spans = list(zip(words.start.tolist(), stop.tolist(), words.unspaced.tolist(), strict=True))
    for d in range(s.n):
        yield {(raw[a:b], u) for a, b, u in spans[words.first[d] : words.first[d + 1]]}


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, whole, toxic, clean): in how many texts of either label each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text", TERM_BYTES):
            label = np.asarray(s.column("label"))
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for y, found in zip(label.tolist(), _doc_words(s, Tokens(s.data, s.offsets)), strict=True):
                counts[y == 1].update({t for w in found for t in _terms(*w)})
            terms = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array([t for t, _ in terms], pa.binary()), pa.array([w for _, w in terms], pa.bool_())]
            columns += [pa.array([counts[y][t] for t in terms], pa.int64()) for y in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "whole", "toxic", "clean"])

    found = sample.mapInArrow(run, "term binary, whole boolean, toxic long, clean long")
    return found.groupBy("term", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame) -> list[tuple[bytes, bool]]:
    """Every (term, is a whole word) in MIN_DOCS toxic texts with MIN_ODDS that no other of them stands for.

    Copies of a text count once for each label that they have, so that they
    neither add a term nor bar one.
    """
    sample = checkpointed(sample.groupBy("label", F.sha2("text", 256)).agg(F.min("text").alias("text")).select("text", "label"))
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    odds = (F.col("toxic") + 0.5) / sizes[1] / ((F.col("clean") + 0.5) / sizes[0])
    passed = _term_counts(sample).filter((F.col("toxic") >= MIN_DOCS) & (odds >= MIN_ODDS)).select("term", "whole", "toxic")
    toxic = {(bytes(r.term), r.whole): r.toxic for r in passed.collect()}
    chosen: set[tuple[bytes, bool]] = set()
    below: Counter = Counter()  # texts of the chosen terms that start with these bytes
    # The most frequent first; of equals the whole word, then the longer stem.
    for term in sorted(toxic, key=lambda t: (-toxic[t], not t[1], -len(t[0]), t[0])):
        text, whole = term
        starts = {text[:n] for k, n in enumerate(_ends(text), 1) if k in STEMS} | {text}
        implied = any((c, False) in chosen for c in starts)
        explained = not whole and below[text] >= 0.9 * toxic[term]
        if not implied and not explained:
            chosen.add(term)
            below.update(dict.fromkeys(starts, toxic[term]))
    return sorted(chosen)


def build_table(lexicon: list[tuple[bytes, bool]]) -> dict[str, np.ndarray]:
    """The automaton of all lexicon terms with at most one error, as a table.

    ``letters`` are the characters with a column of their own, from 1 on,
    ``next`` is state x column, ``kind`` says what a word that ends in a state
    is: 0 nothing, 1 an exact match, 2 a misspelling. State 0 is dead, 1 the
    start, 2 a matched stem, which stays.
    """
    nodes: list[dict[int, int]] = [{}]
    whole, stem, fuzzy = [False], [False], [False]
    spelled = []
    for text, is_whole in lexicon:
        starts = np.array([0, *_ends(text)[:-1]], np.int64)
        spelled.append((characters(np.frombuffer(text, np.uint8), starts).tolist(), is_whole))
    for text, is_whole in spelled:
        v = 0
        for b in text:
            if b not in nodes[v]:
                nodes.append({})
                whole.append(False)
                stem.append(False)
                fuzzy.append(False)
                nodes[v][b] = len(nodes) - 1
            v = nodes[v][b]
            fuzzy[v] |= is_whole and len(text) >= FUZZY_FROM
        (whole if is_whole else stem)[v] = True
    letters = sorted({b for text, _ in spelled for b in text})

    def closed(items: set[tuple[int, int]]) -> frozenset:
        """With skipped letters of the term, and without states that a better one covers."""
        items = set(items)
        for v, e in list(items):
            if e == 0:
                items |= {(u, 1) for u in nodes[v].values() if fuzzy[u]}
        return frozenset((v, e) for v, e in items if e == 0 or (v, 0) not in items)

    start = closed({(0, 0)})
    numbers: dict[frozenset, int] = {start: 1}
    table, kinds, queue = [[0] * (len(letters) + 1), [0] * (len(letters) + 1), [2] * (len(letters) + 1)], [0, 0, 1], [start]
    while queue:
        state = queue.pop()
        row = table[numbers[state]]
        # Letters that no node of the state goes on with all lead where a letter of no term does.
        onward = {b for v, _ in state for b in nodes[v]}
        for c, b in enumerate([None, *letters]):
            if c and b not in onward:
                row[c] = row[0]
                continue
            after: set[tuple[int, int]] = set()
            hit = False
            for v, e in state:
                u = nodes[v].get(b) if b is not None else None
                if u is not None and (e == 0 or fuzzy[u]):
                    after.add((u, e))
                    hit |= e == 0 and stem[u]
                if e == 0:
                    if v == 0 or fuzzy[v]:
                        after.add((v, 1))  # a letter too many
                    after |= {(w, 1) for w in nodes[v].values() if fuzzy[w]}  # another letter
            if hit:
                row[c] = 2
                continue
            key = closed(after)
            if not key:
                continue
            if key not in numbers:
                numbers[key] = len(table)
                table.append([0] * (len(letters) + 1))
                ends = [e for v, e in key if whole[v] and (e == 0 or fuzzy[v])]
                kinds.append(0 if not ends else 1 if min(ends) == 0 else 2)
                queue.append(key)
            row[c] = numbers[key]
    return {"letters": np.array([*letters, 1 << 40], np.int64), "next": np.array(table, np.int32), "kind": np.array(kinds, np.int8)}


def match_words(data: np.ndarray, words: Tokens, table: dict[str, np.ndarray]) -> np.ndarray:
    """0, 1 (exact) or 2 (misspelled) for each word; from a character of an unspaced script stems only."""
    out = np.zeros(len(words.start), np.int8)
    live = np.arange(len(words.start))
    at, end = words.start.copy(), words.reach
    state = np.ones(len(live), np.int32)
    while len(live):
        point = characters(data, at)
        column = np.searchsorted(table["letters"], point)
        state = table["next"][state, np.where(table["letters"][column] == point, column + 1, 0)]
        at = np.minimum(at + CHAR_BYTES[data[at]], end)
        stays = state > 0
        live, at, end, state = live[stays], at[stays], end[stays], state[stays]
        over = (at == end) | (state == 2)
        out[live[over]] = np.where(words.unspaced[live[over]] & (state[over] != 2), 0, table["kind"][state[over]])
        live, at, end, state = live[~over], at[~over], end[~over], state[~over]
    return out


class Contexts:
    """Matches of a slice with the buckets of the words around them."""

    def __init__(self, s, table: dict[str, np.ndarray], hasher: Hasher) -> None:
        words = Tokens(s.data, s.offsets)
        kinds = match_words(s.data, words, table)
        self.word = np.flatnonzero(kinds)
        self.kind = kinds[self.word]
        self.doc = words.doc[self.word]
        # Only the words in some window are hashed.
        around = self.word[:, None] + np.delete(np.arange(-WINDOW, WINDOW + 1), WINDOW)
        self.inside = (around >= words.first[self.doc][:, None]) & (around < words.first[self.doc + 1][:, None])
        near = np.unique(around[self.inside])
        part = Words.__new__(Words)
        part.start, part.end, part.inside = words.start[near], words.end[near], words.inside
        self.bucket = np.zeros(around.shape, np.int64)
        if len(near):
            # A hash runs to the next word that is asked for, so the others in between are blanked.
            marks = np.zeros(len(s.data) + 1, np.int8)
            marks[part.start] += 1
            marks[part.end] -= 1
            asked = np.where(np.cumsum(marks[:-1], dtype=np.int8) > 0, s.data, np.uint8(0x20))
            buckets = (hasher.words(asked, part) % np.uint64(CONTEXT_BUCKETS)).astype(np.int64)
            self.bucket[self.inside] = buckets[np.searchsorted(near, around[self.inside])]
        quote = np.zeros(256, bool)
        quote[list(QUOTES)] = True
        padded = np.concatenate([s.data, np.zeros(1, np.uint8)])
        before, after = words.start[self.word], words.reach[self.word]
        self.quoted = quote[padded[before - 1]] & (before > s.offsets[self.doc]) & quote[padded[after]] & (after < s.offsets[self.doc + 1])

    def features(self, rows: int, weights: np.ndarray) -> np.ndarray:
        """Per row: any match, exact, misspelled and quoted matches, and the mean and highest context score."""
        context = (weights[self.bucket] * self.inside).sum(1) / np.maximum(self.inside.sum(1), 1)
        count = np.bincount(self.doc, minlength=rows)
        high = np.full(rows, -np.inf)
        np.maximum.at(high, self.doc, context)
        return np.stack(
            [
                count > 0,
                np.log1p(np.bincount(self.doc, self.kind == 1, rows)),
                np.log1p(np.bincount(self.doc, self.kind == 2, rows)),
                np.log1p(np.bincount(self.doc, self.quoted, rows)),
                np.bincount(self.doc, context, rows) / np.maximum(count, 1),
                np.where(count > 0, high, 0),
            ],
            axis=1,
        ).astype(float)


def _context_weights(sample: DataFrame, table: dict[str, np.ndarray]) -> np.ndarray:
    """Log-odds of each context bucket between matches in toxic and in other texts, with the bias taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(), np.zeros((2, CONTEXT_BUCKETS))
        for s in slices(batches, "text", TEXT_BYTES):
            found = Contexts(s, table, hasher)
            label = np.asarray(s.column("label"))[found.doc]
            for y in (0, 1):
                chosen = found.bucket[label == y][found.inside[label == y]]
                counts[y] += np.bincount(chosen, minlength=CONTEXT_BUCKETS)
        y, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(bucket), pa.array(counts[y, bucket])], ["y", "bucket", "n"])

    counts = np.full((2, CONTEXT_BUCKETS), 1.0)
    for r in sample.mapInArrow(run, "y long, bucket long, n double").groupBy("y", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.y, r.bucket] += r.n
    return np.log(counts[1] / counts[0]) - np.log(counts[1].sum() / counts[0].sum())


class ToxicityModel:
    """What the documents are scored with; the labelled sample bounds its size."""

    def __init__(self, lexicon: list[tuple[bytes, bool]], table: dict, weights: np.ndarray, regression: np.ndarray) -> None:
        self.lexicon, self.table, self.weights, self.regression = lexicon, table, weights, regression

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score, n_exact, n_misspelled) of every row."""
        table, weights, regression = self.table, self.weights, self.regression
        kind = docs.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for s in slices(batches, text_col, TEXT_BYTES):
                found = Contexts(s, table, hasher)
                x = found.features(s.n, weights)
                counts = [np.rint(np.expm1(x[:, k])).astype(np.int64) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [s.column(id_col), pa.array(logistic(x, regression)), *map(pa.array, counts)], [id_col, "score", "n_exact", "n_misspelled"]
                )

        return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, n_exact long, n_misspelled long")

    def accepted(self, docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
        """The rows of ``docs`` that score below ``threshold``, each judged by its own text."""
        table, weights, regression = self.table, self.weights, self.regression

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for s in slices(batches, text_col, TEXT_BYTES):
                score = logistic(Contexts(s, table, hasher).features(s.n, weights), regression)
                yield s.batch.filter(pa.array(score < threshold))

        return docs.mapInArrow(run, docs.schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn lexicon, context weights and regression from at most ``rows`` labelled texts.

    Without labels of both kinds there is no lexicon and every score is that of
    a text without a match. Null texts count as empty ones.
    """
    sample = fit_sample(docs, labels, label, rows)
    lexicon = learn_lexicon(sample)
    table = build_table(lexicon)
    weights = _context_weights(sample, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for s in slices(batches, "text", TEXT_BYTES):
            x = Contexts(s, table, hasher).features(s.n, weights)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), s.column("label")], ["x", "y"])

    rows_xy = sample.mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()
    if not rows_xy or len({r.y for r in rows_xy}) < 2:
        share = rows_xy[0].y if rows_xy else 0
        return ToxicityModel(lexicon, table, weights, np.array([0.0] * 6 + [3.0 if share else -3.0]))
    x, y, n = (np.array(v, float) for v in zip(*((r.x, r.y, r["count"]) for r in rows_xy), strict=True))
    times = n.astype(int)
    return ToxicityModel(lexicon, table, weights, fit_logistic(np.repeat(x, times, 0), np.repeat(y, times)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted, n_exact, n_misspelled) of every row of ``docs``.

    Null and empty texts have no match and get the score of such texts. A row
    without an id is scored too and held_out is null there. Repeated rows get
    equal scores. Texts of any length are scored whole, in one slice each. Other
    columns are not read. An empty table gives no rows.
    """
    scored = fit_toxicity(docs, labels).score(docs, id_col, text_col)
    return scored.select(
        id_col,
        (fold(id_col, 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_exact",
        "n_misspelled",
    )
