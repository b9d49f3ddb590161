"""Subject areas of documents (problem 9).

Documents are embedded by term weighting (tf-idf over the whole corpus) and a truncated
singular value decomposition, one space for each language. Sentences are folded into the
same space and compared, by cosine, with one centroid for each subject. Centroids are seeded from
labelled documents and the subjects' descriptions, and refined by assigning sentences and averaging them, first
over the labelled documents, then over all. A document is about the subjects that at
least a given share of its sentences is assigned to.

Texts are read twice: once for the lines that recur at their edges, once to cut them to words. From then on
the corpus is blocks of some thousand documents: a block's own list of words and arrays of numbers, then the rows of the
document-term matrix, and at last the sentences' unit vectors, each worked out once.

Languages are those that ``lang`` names; which one a text is in is learned from the words of a bounded sample of the
documents of each, so that a document with a wrong or missing ``lang`` finds its own.

Everything that is gathered on the driver has a bound that doesn't depend on the corpus:
repeated edge lines (at most edges / share), frequent words of the sampled languages, the vocabulary (at most the mean number of
different words in a document / ``least_share``), the right singular vectors, the
centroids, and the embedded sentences of a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.operators.spatial import Shipped
from fleetloom.session import staged, unstage


@dataclass(frozen=True)
class SubjectRules:
    share: float = 0.2  # of a document's sentences
    cosine: float = 0.13  # a sentence below this for every subject is of none
    rank: int = 20  # singular vectors kept for each language
    least_documents: int = 3  # that a term must occur in,
    least_share: float = 0.0015  # and of its language's documents: rarer words are mostly misspellings
    power_passes: int = 3
    language_documents: int = 2_000  # about so many documents of each ``lang`` teach its words,
    language_share: float = 0.005  # those that at least this share of them hold
    trust: float = 0.9  # in ``lang``, against the words
    labelled_documents: int = 5_000  # about so many labelled documents of each language seed the centroids,
    labelled_sentences: int = 200  # each with at most so many of its sentences, evenly spaced
    seed_rounds: int = 10
    corpus_rounds: int = 3
    edge_share: float = 0.004  # a first or last line that so many documents share isn't body,
    edge_only: float = 0.9  # if at least this share of its places in all documents are first or last
    run_on: int = 16  # a sentence of more words has lost its stops and is cut
    cut: int = 8


BLOCK_WORDS = 300_000  # a block of documents is closed when it has so many words
UNKNOWN = "und"  # the language where ``lang`` names none anywhere

_WORD = re.compile(r"[^\W\d_]{2,}")
_FIRST = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"(?<=[.!?])\s+")
_BREAK = re.compile(r"<br ?/?>|</(?:p|div|li|h\d|tr)>", re.I)
_TAG = re.compile(r"<[^<>]{1,200}>")
_OTHER = re.compile(r"[\W\d_]+")


def lines_of(text: str) -> list[str]:
    """Lines of a text without markup and blanks."""
    if "<" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n", text))
    if "&" in text:
        text = text.replace("&nbsp;", " ").replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    return [s for s in map(str.strip, text.split("\n")) if s]


def bare(line: str) -> str:
    return _OTHER.sub(" ", line.lower()).strip()


def at_edge(k: int, n: int) -> bool:
    """Whether line ``k`` of ``n`` is one of the first two or last three; a single line is body."""
    return n > 1 and (k < 2 or k >= n - 3)


def edge_lines(text: str | None) -> list[str]:
    """The first two and last three lines of a text of several lines, without digits and signs."""
    lines = lines_of(text or "")
    return sorted({bare(s) for k, s in enumerate(lines) if at_edge(k, len(lines))})


class Cutter:
    """Cuts texts to sentences of words, and notes where they stand in lines that may be header or footer."""

    def __init__(self, candidates: Iterable[str] = (), run_on: int = 16, cut: int = 8):
        self.number = {s: k for k, s in enumerate(sorted(candidates))}
        self.first = {s.split(" ", 1)[0] for s in self.number}  # most lines are told apart by their first word
        self.run_on, self.cut = run_on, cut

    def cut_into(self, text: str | None, words: list[str], lengths: list[int], lines: list[int], places: dict[int, list[int]]) -> int:
        """Append a text's words, the number of words of each sentence and the candidate at the text's edge that each stands in (or -1).

        ``places`` counts where candidates stand: at an edge, and in all. Returns the number of sentences.
        """
        rows = lines_of(text or "")
        last, before = len(rows) - 3, len(lengths)
        find, first, number, run_on = _WORD.findall, _FIRST.search, self.number, self.run_on
        for k, row in enumerate(rows):
            row, line = row.lower(), -1
            if len(rows) > 1 and number:
                found = first(row)
                if (found.group() if found else "") in self.first:
                    line = number.get(bare(row), -1)
                    if line >= 0:
                        edge = k < 2 or k >= last
                        at = places.setdefault(line, [0, 0])
                        at[0] += edge
                        at[1] += 1
                        line = line if edge else -1
            for sentence in _STOP.split(row):
                own = find(sentence)
                n = len(own)
                if n > run_on:
                    parts = round(n / self.cut)
                    ends = [n * j // parts for j in range(parts + 1)]
                    lengths += [v - u for u, v in zip(ends, ends[1:])]
                    lines += [line] * parts
                elif n:
                    lengths.append(n)
                    lines.append(line)
                words += own
        return len(lengths) - before


def sentences_of(text: str | None, edges: frozenset[str], run_on: int = 16, cut: int = 8) -> list[str]:
    """Sentences of the body, each as lower-case words; header, greeting, signature and footer lines are left out.

    These are the lines in ``edges``, where they stand at the edge of this text. What has no word is no sentence. A run
    of more than ``run_on`` words without a stop is cut into pieces of about ``cut`` words.
    """
    words: list[str] = []
    lengths: list[int] = []
    lines: list[int] = []
    Cutter(edges, run_on, cut).cut_into(text, words, lengths, lines, {})
    ends = np.cumsum([0, *lengths])
    return [" ".join(words[a:b]) for a, b, line in zip(ends, ends[1:], lines) if line < 0]


@dataclass
class Languages:
    """Which language a set of words is in: log likelihoods of words under each language that ``lang`` names."""

    names: list[str]
    words: dict[str, int]
    weight: np.ndarray  # words x languages
    prior: np.ndarray  # log share of each language
    trust: float = 0.9

    @classmethod
    def learned(cls, counts: dict[str, dict[str, int]], documents: dict[str, int], share: dict[str, int], trust: float = 0.9) -> Languages:
        """From the documents of each language that hold a word, the documents looked at, and how many there are in all.

        A word's share in a language is drawn towards its share in all of them, the more so the fewer documents the
        language has: a language of which little is known doesn't claim what others know better.
        """
        names = sorted(documents) or [UNKNOWN]
        words = {w: k for k, w in enumerate(sorted({w for own in counts.values() for w in own}))}
        n = np.zeros((len(words), len(names)))
        for k, name in enumerate(names):
            for w, c in counts.get(name, {}).items():
                n[words[w], k] = c
        size = np.array([documents.get(s, 0) for s in names], float)
        among = n.sum(axis=1, keepdims=True) / max(1.0, size.sum())
        weight = np.log((n + 2 * among) / (size + 2)) if len(words) else np.zeros((0, len(names)))
        prior = np.array([share.get(s, 0) for s in names], float) + 1
        return cls(names, words, weight, np.log(prior / prior.sum()), trust)

    def of(self, uniques: list[str], document: np.ndarray, code: np.ndarray, given: list[str | None]) -> np.ndarray:
        """The language's number for each document, of the words ``uniques[code]``; each word counts once in a document."""
        score = np.tile(self.prior, (len(given), 1))
        if len(self.names) > 1:
            number = np.array([self.words.get(w, -1) for w in uniques], np.int64)
            pair = _distinct(document.astype(np.int64) * max(1, len(uniques)) + code)
            row, word = pair // max(1, len(uniques)), number[pair % max(1, len(uniques))]
            score += _sum_rows(row[word >= 0], self.weight[word[word >= 0]], len(given))
            place = {s: k for k, s in enumerate(self.names)}
            named = np.array([place.get(g, -1) for g in given])
            score[np.flatnonzero(named >= 0), named[named >= 0]] += np.log(self.trust / (1 - self.trust) * (len(self.names) - 1))
        return score.argmax(axis=1)

    def of_text(self, text: str, given: str | None = None) -> str:
        words = _WORD.findall(text.lower())
        codes, uniques = pd.factorize(np.array(words, dtype=object))
        return self.names[self.of(list(uniques), np.zeros(len(words), int), codes, [given])[0]]


def language_code(col: Column | str) -> Column:
    """``en`` of en, EN, en-GB and en_US; null for what isn't two or three letters, perhaps with a region."""
    code = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]{2,3})([-_].*)?$", 1)
    return F.when(F.length(code) > 0, code)


def _about(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """About ``most`` rows of each group, the same ones at every run: all of a group that has no more."""
    n = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    if all(v <= most for v in n.values()):
        return rows
    rates = rows.sparkSession.createDataFrame([(k, min(1.0, most / v)) for k, v in n.items()], f"{group} string, _rate double")
    place = F.pmod(F.xxhash64(order, F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    return rows.join(F.broadcast(rates), group).where(place < F.col("_rate")).drop("_rate")


def learn_languages(rows: DataFrame, rules: SubjectRules) -> Languages:
    """``rows`` has doc_id, text and language (as given); the words come from a bounded sample of each language."""
    named = rows.where("language is not null")
    share = {r.language: r.n for r in named.groupBy("language").agg(F.count("*").alias("n")).collect()}  # at most as many as codes
    if len(share) < 2:
        return Languages.learned({}, share, share, rules.trust)
    sample = _about(named, "language", "doc_id", rules.language_documents)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})")))
    counted = sample.select("language", F.explode(F.array_append(words, F.lit(""))).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n"))
    total = counted.where("word = ''").select("language", F.col("n").alias("documents"))
    counts: dict[str, dict[str, int]] = {}
    for r in counted.join(F.broadcast(total), "language").where(F.col("n") >= rules.language_share * F.col("documents")).collect():
        counts.setdefault(r.language, {})[r.word] = r.n
    documents = {k: v.pop("") for k, v in counts.items()}
    return Languages.learned(counts, documents, share, rules.trust)


def edge_candidates(rows: DataFrame, rules: SubjectRules) -> frozenset[str]:
    """Lines that many documents have at their edge."""

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"line": [s for t in f["text"] for s in edge_lines(t)]}, dtype=object)

    n = rows.count()
    # a document gives five lines at most, so no more than 5 / edge_share lines pass
    shared = rows.select("text").mapInPandas(edges, "line string").groupBy("line").count().where(F.col("count") >= max(3, rules.edge_share * n))
    return frozenset(r.line for r in shared.select("line").collect())


BLOCKS = (
    "words array<string>, ids array<bigint>, languages binary, sentences binary, lengths binary, lines binary, codes binary, "
    "places array<struct<line: int, edge: bigint, n: bigint>>"
)


def _bytes(values, kind: str) -> bytes:
    return np.asarray(values, kind).tobytes()


def cut_blocks(rows: DataFrame, candidates: frozenset[str], languages: Languages, rules: SubjectRules) -> DataFrame:
    """The corpus as blocks: words of a block once, documents as numbers of them, with their languages.

    ``sentences`` counts the sentences of each document, ``lengths`` the words of each sentence, ``codes`` are the words, ``lines``
    the candidate that a sentence stands in at the edge of its document (or -1), ``places`` where the candidates stand.
    """
    shipped = Shipped(rows.sparkSession, languages)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, cutter = shipped.value, Cutter(candidates, rules.run_on, rules.cut)
        ids, given, sentences, lengths, lines, words, places = [], [], [], [], [], [], {}

        def block() -> pd.DataFrame:
            codes, uniques = pd.factorize(np.array(words, dtype=object))
            of_sentence = np.repeat(np.arange(len(ids)), sentences)
            spoken = known.of(list(uniques), np.repeat(of_sentence, lengths), codes, given)
            where = [(k, *v) for k, v in places.items()]
            row = (list(uniques), list(ids), _bytes(spoken, "<i2"), _bytes(sentences, "<i4"), _bytes(lengths, "<i4"), _bytes(lines, "<i4"), _bytes(codes, "<i4"), where)
            for x in (ids, given, sentences, lengths, lines, words, places):
                x.clear()
            return pd.DataFrame([row], columns=["words", "ids", "languages", "sentences", "lengths", "lines", "codes", "places"])

        for f in frames:
            for doc_id, text, language in zip(f["doc_id"].tolist(), f["text"], f["language"]):
                n = cutter.cut_into(text, words, lengths, lines, places)
                ids.append(doc_id)
                given.append(language)
                sentences.append(n)
                if len(words) >= BLOCK_WORDS:
                    yield block()
        if ids:
            yield block()

    return staged(rows.mapInPandas(cut, BLOCKS), "blocks")


def kept_edges(blocks: DataFrame, rules: SubjectRules) -> list[int]:
    """The candidates that hardly ever stand elsewhere: body sentences recur in the middle too."""
    at = blocks.select(F.explode("places").alias("p")).groupBy("p.line").agg(F.sum("p.edge").alias("edge"), F.sum("p.n").alias("n"))
    return [r.line for r in at.where(F.col("edge") >= rules.edge_only * F.col("n")).collect()]


@dataclass
class Part:
    """The documents of a block that are in one language: of each its sentences, of each sentence its words."""

    ids: np.ndarray
    sentences: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray


def parts_of(block, edges: np.ndarray, languages: int) -> Iterator[tuple[int, Part]]:
    """A block's bodies by language: without edge lines, and without documents that have no other sentence."""
    ids, spoken = np.asarray(block.ids, np.int64), np.frombuffer(block.languages, "<i2")
    sentences, lengths = np.frombuffer(block.sentences, "<i4"), np.frombuffer(block.lengths, "<i4")
    lines, codes = np.frombuffer(block.lines, "<i4"), np.frombuffer(block.codes, "<i4")
    of = np.repeat(np.arange(len(ids)), sentences)
    body = (lines < 0) | ~np.isin(lines, edges)
    for k in range(languages):
        mine = body & (spoken[of] == k)
        count = np.bincount(of[mine], minlength=len(ids))
        if mine.any():
            own = count > 0
            yield k, Part(ids[own], count[own], lengths[mine], codes[np.repeat(mine, lengths)])


def vocabulary(blocks: DataFrame, edges: list[int], languages: Languages, rules: SubjectRules) -> dict[str, tuple[dict[str, int], np.ndarray]]:
    """For each language the terms' numbers and their inverse document frequencies, counted over all documents.

    A term is kept by its share of its own language's documents, so that a rare language has its words too.
    """
    names, dropped = languages.names, np.array(edges, int)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block in f.itertuples():
                words = np.asarray(block.words, dtype=object)
                for k, p in parts_of(block, dropped, len(names)):
                    pair = _distinct(np.repeat(np.repeat(np.arange(len(p.ids)), p.sentences), p.lengths) * len(words) + p.codes)
                    n = np.bincount(pair % len(words), minlength=len(words))
                    yield pd.DataFrame({"language": names[k], "term": [*words[n > 0], None], "n": [*n[n > 0], len(p.ids)]})

    terms = blocks.select("words", "ids", "languages", "sentences", "lengths", "lines", "codes").mapInPandas(count, "language string, term string, n bigint")
    counted = terms.groupBy("language", "term").agg(F.sum("n").alias("n"))
    total = counted.where("term is null").select("language", F.col("n").alias("documents"))
    enough = F.greatest(F.lit(float(rules.least_documents)), rules.least_share * F.col("documents"))
    out: dict[str, list] = {}
    for r in counted.join(F.broadcast(total), "language").where(F.col("term").isNull() | (F.col("n") >= enough)).collect():
        out.setdefault(r.language, []).append((r.term, r.n, r.documents))
    done = {}
    for language, rows in out.items():
        top = sorted((t, n) for t, n, _ in rows if t is not None)
        done[language] = {t: k for k, (t, _) in enumerate(top)}, np.log((1 + rows[0][2]) / np.array([n for _, n in top], float))
    return done


@dataclass
class Bodies:
    """Blocks, and what it takes to read them as documents of one language with numbers of its terms."""

    blocks: DataFrame
    edges: list[int]
    names: list[str]  # of languages
    terms: dict[str, tuple[dict[str, int], np.ndarray]]

    def each(self, work: Callable[[str, Part, np.ndarray, np.ndarray, Any], tuple], schema: str, value: Any = None) -> DataFrame:
        """A row of ``work(language, part, sentence, term, value)`` for each block and language.

        ``sentence`` and ``term`` are the numbers of the words that are terms; unknown words are dropped, sentences aren't.
        """
        shipped = Shipped(self.blocks.sparkSession, ({k: v[0] for k, v in self.terms.items()}, value))
        names, dropped = self.names, np.array(self.edges, int)
        columns = [c.split()[0] for c in schema.split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, given = shipped.value
            for f in frames:
                for block in f.itertuples():
                    for k, p in parts_of(block, dropped, len(names)):
                        own = known.get(names[k], {})
                        number = np.array([own.get(w, -1) for w in block.words], np.int64)[p.codes]
                        sentence = np.repeat(np.arange(len(p.lengths)), p.lengths)
                        yield pd.DataFrame([work(names[k], p, sentence[number >= 0], number[number >= 0], given)], columns=columns)

        return self.blocks.select("words", "ids", "languages", "sentences", "lengths", "lines", "codes").mapInPandas(run, schema)


def _matrix_row(language: str, p: Part, sentence: np.ndarray, term: np.ndarray, _: Any) -> tuple:
    document = np.repeat(np.arange(len(p.ids)), p.sentences)[sentence]
    width = int(term.max(initial=0)) + 1
    pair, count = np.unique(document * width + term, return_counts=True)
    return language, _bytes(np.bincount(pair // width, minlength=len(p.ids)), "<i4"), _bytes(pair % width, "<i4"), _bytes(count, "<i4")


def matrix(bodies: Bodies) -> DataFrame:
    """Blocks of rows of each language's document-term matrix: how many terms each document has, which, and how often."""
    return staged(bodies.each(_matrix_row, "language string, sizes binary, cols binary, counts binary"), "matrix")


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; by sorting, which is fast here as the values rise but for short stretches."""
    return np.unique(values, return_counts=True)[0]


def _sum_rows(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by sorted ``key``."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(key):
        start = np.flatnonzero(np.concatenate([[True], np.diff(key) > 0]))
        out[key[start]] = np.add.reduceat(values, start)
    return out


def _matrix(block, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a block's weighted document-term matrix; each row has length 1."""
    sizes, col = np.frombuffer(block.sizes, "<i4"), np.frombuffer(block.cols, "<i4")
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = (1 + np.log(np.frombuffer(block.counts, "<i4"))) * idf[col]
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(sizes)))
    return row, col, (value / np.maximum(norm[row], 1e-12)).astype("f4")


TILE = 4_000_000  # entries of a dense tile
DENSE = 0.01  # a tile with at least this share of entries is multiplied as a dense matrix: the same sums, in another order


def _products(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, q: np.ndarray, gram: bool) -> np.ndarray:
    """A'Aq of a sparse matrix A (``n`` rows) and a narrow one, or with ``gram`` (Aq)'Aq; some thousand rows at a time."""
    width = len(q)
    step = max(1, TILE // width)
    z = np.zeros((q.shape[1] if gram else width, q.shape[1]), "f4")
    cuts = np.searchsorted(row, np.arange(0, n + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        own, c, v, height = row[a:b] - k * step, col[a:b], value[a:b], min(step, n - k * step)
        if b - a >= DENSE * height * width:
            tile = np.zeros((height, width), "f4")
            tile[own, c] = v
            y = tile @ q
            z += y.T @ y if gram else tile.T @ y
            continue
        y = _sum_rows(own, q[c] * v[:, None], height)
        if gram:
            z += y.T @ y
        else:
            order = np.argsort(c, kind="stable")
            z += _sum_rows(c[order], y[own[order]] * v[order, None], width)
    return z


SLICE = 512  # terms in one slice of partial sums


def singular_vectors(docs: DataFrame, terms: dict, rules: SubjectRules) -> dict[str, np.ndarray]:
    """Right singular vectors of each language's document-term matrix, by randomised subspace iteration.

    Each pass multiplies the matrix and its transpose with a narrow matrix, partition by
    partition; partial sums are added up slice by slice before they come to the driver.
    """
    rng = np.random.default_rng(11)
    basis = {k: np.linalg.qr(rng.normal(size=(len(v[0]), min(len(v[0]), rules.rank + 10))))[0] for k, v in terms.items() if v[0]}
    idf = {k: v[1] for k, v in terms.items()}
    for last in [False] * rules.power_passes + [True]:
        shipped = Shipped(docs.sparkSession, ({k: q.astype("f4") for k, q in basis.items()}, idf))

        def multiply(frames: Iterator[pd.DataFrame], shipped=shipped, last=last) -> Iterator[pd.DataFrame]:
            q, weights = shipped.value
            total: dict[str, np.ndarray] = {}
            for f in frames:
                for block in f.itertuples():
                    language = block.language
                    if language not in q:
                        continue
                    z = _products(*_matrix(block, weights[language]), len(block.sizes) // 4, q[language], last)
                    total[language] = total[language] + z if language in total else z.astype(float)
            rows = [(k, b, z[b * SLICE : (b + 1) * SLICE].astype("<f4").tobytes()) for k, z in total.items() for b in range(-(-len(z) // SLICE))]
            yield pd.DataFrame(rows, columns=["language", "slice", "sums"])

        def add(f: pd.DataFrame) -> pd.DataFrame:
            z = sum(np.frombuffer(s, "<f4").astype(float) for s in f["sums"])
            return pd.DataFrame([(f["language"].iloc[0], f["slice"].iloc[0], z.astype("<f8").tobytes())], columns=["language", "slice", "sums"])

        schema = "language string, slice bigint, sums binary"
        parts = docs.mapInPandas(multiply, schema).groupBy("language", "slice").applyInPandas(add, schema).collect()
        for language, q in basis.items():
            own = sorted((r.slice, r.sums) for r in parts if r.language == language)
            if not own:
                continue
            z = np.frombuffer(b"".join(s for _, s in own)).reshape(-1, q.shape[1])
            if last:
                values, vectors = np.linalg.eigh(z)
                basis[language] = q @ vectors[:, np.argsort(-values)[: rules.rank]]
            else:
                basis[language] = np.linalg.qr(z)[0]
    return basis


@dataclass
class SubjectModel:
    subjects: list[str]
    idf: dict[str, np.ndarray]
    vectors: dict[str, np.ndarray]
    centre: dict[str, np.ndarray] = field(default_factory=dict)
    centroids: dict[str, np.ndarray] = field(default_factory=dict)  # a row of NaN: no seed in this language

    def width(self, language: str) -> int:
        return self.vectors[language].shape[1] if language in self.vectors else 1

    def embed(self, language: str, term: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Unit vectors of sentences; zero where no term is known."""
        if language not in self.vectors:
            return np.zeros((len(lengths), 1), "f4")
        own = (self.vectors[language] * self.idf[language][:, None]).astype("f4")
        out, ends = np.zeros((len(lengths), own.shape[1]), "f4"), np.cumsum(lengths)
        for a in range(0, len(lengths), 1000):  # so few at a time stay in the processor's cache
            size = lengths[a : a + 1000]
            out[a : a + 1000] = _sum_rows(np.repeat(np.arange(len(size)), size), own[term[ends[a] - lengths[a] : ends[a + len(size) - 1]]], len(size))
        return _unit(out)

    def centred(self, language: str, v: np.ndarray) -> np.ndarray:
        """Unit vectors from the centre of all sentences."""
        return _unit(v - self.centre[language].astype("f4")) if language in self.centre else v

    def assign(self, language: str, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest subject of each centred vector and its cosine."""
        c = self.centroids.get(language)
        if c is None or not len(v) or np.isnan(c).all():
            return np.zeros(len(v), int), np.full(len(v), -1.0)
        cosine = v @ np.nan_to_num(c, nan=0.0).T.astype("f4")
        cosine[:, np.isnan(c).any(axis=1)] = -1.0
        return cosine.argmax(axis=1), cosine.max(axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]


def _means(v: np.ndarray, chosen: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
    """Unit means by group; a group without members keeps what it was before."""
    out = np.full((n, v.shape[1]), np.nan) if before is None else before.copy()
    for k in range(n):
        if (own := chosen == k).any():
            out[k] = _unit(v[own].mean(axis=0, keepdims=True))[0]
    return out


def _embedded_row(language: str, p: Part, sentence: np.ndarray, term: np.ndarray, model: SubjectModel) -> tuple:
    v = model.embed(language, term, np.bincount(sentence, minlength=len(p.lengths)))
    sums = _weighted(v, np.zeros(len(v), int), p.sentences, v.any(axis=1), 1)
    return language, p.ids, _bytes(p.sentences, "<i4"), v.astype("<f2").tobytes(), sums.tobytes()


def embedded(bodies: Bodies, model: SubjectModel) -> DataFrame:
    """Each sentence's unit vector (in half precision), and the block's sum of them in which each document counts once."""
    return staged(bodies.each(_embedded_row, "language string, ids array<bigint>, sentences binary, vectors binary, sums binary", model), "embedded")


def _weighted(v: np.ndarray, group: np.ndarray, sentences: np.ndarray, keep: np.ndarray, n: int) -> np.ndarray:
    """Sums by group of the vectors kept, and of their weights in the last column: a document counts once, however long."""
    weight = np.repeat(1 / np.maximum(1, sentences), sentences)
    out = np.zeros((n, v.shape[1] + 1))
    for k in range(n):
        own = keep & (group == k)
        out[k, :-1], out[k, -1] = weight[own] @ v[own], weight[own].sum()
    return out


def _vectors(block, width: int) -> np.ndarray:
    return np.frombuffer(block.vectors, "<f2").reshape(-1, width).astype("f4")


def _totals(rows: DataFrame, n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """``sums`` of all rows by language: added within partitions, then over them."""

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            for language, s in zip(f["language"], f["sums"]):
                total[language] = total.get(language, 0) + np.frombuffer(s)
        yield pd.DataFrame([(k, s.tobytes()) for k, s in total.items()], columns=["language", "sums"])

    def over(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f["language"].iloc[0], sum(np.frombuffer(s) for s in f["sums"]).tobytes())], columns=["language", "sums"])

    schema = "language string, sums binary"
    out = {}
    for r in rows.mapInPandas(within, schema).groupBy("language").applyInPandas(over, schema).collect():
        s = np.frombuffer(r.sums).reshape(n, -1)
        out[r.language] = s[:, :-1], s[:, -1]
    return out


def _assigned_sums(vectors: DataFrame, model: SubjectModel, rules: SubjectRules) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Weighted sums, by subject, of all sentences of the corpus that are surely of it."""
    shipped, least = Shipped(vectors.sparkSession, model), rules.cosine + 0.1

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for f in frames:
            for block in f.itertuples():
                v = _vectors(block, own.width(block.language))
                some, u = v.any(axis=1), own.centred(block.language, v)
                group, cosine = own.assign(block.language, u)
                sums = _weighted(u, group, np.frombuffer(block.sentences, "<i4"), some & (cosine >= least), len(own.subjects))
                yield pd.DataFrame([(block.language, sums.tobytes())], columns=["language", "sums"])

    return _totals(vectors.select("language", "sentences", "vectors").mapInPandas(work, "language string, sums binary"), len(model.subjects))


def _labelled(vectors: DataFrame, labels: DataFrame, model: SubjectModel, rules: SubjectRules) -> list:
    """language, subjects and centred vectors of a bounded sample of labelled documents, of each language alike."""
    marked = labels.where(F.col("subject").isin(model.subjects) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("marks"))
    spoken = staged(vectors.select("language", F.explode("ids").alias("doc_id")).join(marked, "doc_id").select("language", "doc_id", "marks"), "labelled")
    chosen = {r.doc_id: r.marks for r in _about(spoken, "language", "doc_id", rules.labelled_documents).select("doc_id", "marks").collect()}
    shipped, most = Shipped(vectors.sparkSession, (model, chosen)), rules.labelled_sentences

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, wanted = shipped.value
        numbers = np.array(list(wanted), np.int64)
        for f in frames:
            rows = []
            for block in f.itertuples():
                here = np.flatnonzero(np.isin(block.ids, numbers))
                if not len(here):
                    continue
                ends = np.cumsum(np.frombuffer(block.sentences, "<i4"))
                v = np.frombuffer(block.vectors, "<f2").reshape(-1, own.width(block.language))
                for k in here:
                    mine = v[ends[k - 1] if k else 0 : ends[k]].astype("f4")
                    mine = mine[np.unique(np.linspace(0, len(mine) - 1, most).astype(int))] if len(mine) > most else mine
                    rows.append((block.language, list(wanted[block.ids[k]]), own.centred(block.language, mine).astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["language", "marks", "v"])

    return vectors.select("language", "ids", "sentences", "vectors").mapInPandas(pick, "language string, marks array<string>, v binary").collect()


def _seeded(examples: list[tuple[list[str], np.ndarray]], names: list[str], rules: SubjectRules) -> np.ndarray:
    """Centroids from sentences of which each may be about any of its document's subjects."""
    number = {s: k for k, s in enumerate(names)}
    v = np.concatenate([x for _, x in examples]).astype(float)
    allowed = np.zeros((len(v), len(names)), bool)
    at = 0
    for marks, x in examples:
        allowed[at : at + len(x), [number[m] for m in marks]] = True
        at += len(x)
    c = np.array([v[allowed[:, k]].mean(axis=0) if allowed[:, k].any() else np.full(v.shape[1], np.nan) for k in range(len(names))])
    c = _unit(c - np.nanmean(c, axis=0)) if np.count_nonzero(~np.isnan(c[:, 0])) > 1 else _unit(c)
    for _ in range(rules.seed_rounds):
        cosine = np.nan_to_num(v @ c.T, nan=-1.0)
        best = cosine.argmax(axis=1)
        # a sentence counts for a label only if that's also the nearest subject: wrong labels fall out
        good = allowed[np.arange(len(v)), best] & (cosine.max(axis=1) > rules.cosine / 2)
        c = _means(v, np.where(good, best, -1), len(names), c)
    return c


def fit(documents: DataFrame, subjects: DataFrame, labels: DataFrame, rules: SubjectRules = SubjectRules()) -> tuple[SubjectModel, DataFrame]:
    """The embedding of all bodies and refined centroids; also the bodies as unit vectors of their sentences.

    ``labels`` has doc_id and subject; subjects that aren't in ``subjects`` are ignored. Languages with more than
    ``labelled_documents`` labelled documents are cut to a sample of about that size.
    """
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text", language_code("lang").alias("language"))
    languages = learn_languages(rows, rules)
    blocks = cut_blocks(rows, edge_candidates(rows, rules), languages, rules)
    edges = kept_edges(blocks, rules)
    terms = vocabulary(blocks, edges, languages, rules)
    read = Bodies(blocks, edges, languages.names, terms)
    docs = matrix(read)
    names = sorted(r.subject for r in subjects.select("subject").distinct().collect() if r.subject is not None)
    model = SubjectModel(names, {k: v[1] for k, v in terms.items()}, singular_vectors(docs, terms, rules))
    unstage(docs)
    vectors = embedded(read, model)
    unstage(blocks)
    for language, (s, n) in _totals(vectors.select("language", "sums"), 1).items():
        model.centre[language] = s[0] / max(1e-12, n[0])
    if not names:
        return model, vectors

    seeds = _labelled(vectors, labels, model, rules)
    described = {r.subject: r.description or "" for r in subjects.where("subject is not null").collect()}
    written = languages.of_text(" ".join(described.values()))
    for language in model.centre:
        own = [(r.marks, np.frombuffer(r.v, "<f4").reshape(-1, model.width(language))) for r in seeds if r.language == language]
        # descriptions help in their own language, and where nothing else is known
        for s in names if language == written or not own else []:
            known = terms[language][0]
            found = [known[w] for w in _WORD.findall(described[s].lower()) if w in known]
            if found:
                own.append(([s], model.centred(language, model.embed(language, np.array(found), np.array([len(found)])))))
        if own:
            model.centroids[language] = _seeded(own, names, rules)
    for _ in range(rules.corpus_rounds):
        for language, (s, n) in _assigned_sums(vectors, model, rules).items():
            if language in model.centroids:
                moved = n > 0
                model.centroids[language][moved] = _unit(s[moved] / n[moved, None])
    return model, vectors


def assign(vectors: DataFrame, model: SubjectModel, rules: SubjectRules = SubjectRules()) -> DataFrame:
    """doc_id, subject and the share of the document's sentences, for every subject that reaches the least share."""
    shipped = Shipped(vectors.sparkSession, model)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        names = np.array(own.subjects, dtype=object)
        for f in frames if own.subjects else []:
            for block in f.itertuples():
                sentences = np.frombuffer(block.sentences, "<i4")
                v = _vectors(block, own.width(block.language))
                best, cosine = own.assign(block.language, own.centred(block.language, v))
                on = (cosine >= rules.cosine) & v.any(axis=1)
                pair = np.repeat(np.arange(len(sentences)), sentences)[on] * len(names) + best[on]
                count = np.bincount(pair, minlength=len(sentences) * len(names)).reshape(-1, len(names))
                share = count / np.maximum(1, sentences)[:, None]
                d, s = np.nonzero((share >= rules.share - 1e-9) & (count > 0))
                yield pd.DataFrame({"doc_id": np.asarray(block.ids)[d], "subject": names[s], "share": share[d, s]})

    return vectors.select("language", "ids", "sentences", "vectors").mapInPandas(work, "doc_id bigint, subject string, share double")


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame, rules: SubjectRules = SubjectRules()) -> DataFrame:
    """Subjects of every document: doc_id, subject, share.

    ``documents`` has doc_id, text and lang; other columns are ignored. Null, blank and wordless
    texts have no subject, nor has any document if there are no labels and no
    descriptions to seed from. Repeated rows of a document are given repeatedly.
    """
    model, vectors = fit(documents, subjects, labels, rules)
    return assign(vectors, model, rules)
