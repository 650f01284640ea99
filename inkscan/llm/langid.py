"""Language identification: known words first, then shorter and shorter character n-grams.

The model holds, per language, log frequencies of all words and of all character n-grams of 4, 3, 2
and 1 letters of its training texts.  A word that the model knows is scored by its word frequency;
an unknown one by its n-grams, each position falling back to the longest n-gram that is known.  The
model is fitted on a bounded sample of labelled documents, so its size is bounded too and it can be
sent to every task; every whole text is scored in tasks.  A word is a run of letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkscan.llm.bytesops import SliceHash, mix, pieces, text_bytes
from inkscan.llm.shared import cut

U64 = np.uint64
#: The fit reads at most so many labelled documents, and no further one once they hold so many bytes.
MAX_DOCS, MAX_BYTES = 20_000, 1 << 24
LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"
#: A longer text is worked on in parts of about so many code points, which end at a non-letter; scores add up over them.
PART = 1 << 19
#: What a known word counts against an unknown one, whose n-grams are averaged.
WORD_WEIGHT = 2.0

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """A flag per code point; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool))
    return _letters[0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Table:
    """What is known of words, or of n-grams of one length: per hash, the languages that have it and by how much.

    ``rest`` is each language's score of an entry that it doesn't have; ``more`` adds to it.
    """

    hashes: np.ndarray  # ascending
    first: np.ndarray  # of each hash's entries, and the end
    lang: np.ndarray
    more: np.ndarray
    rest: np.ndarray

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted hash, -1 where it isn't known."""
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def add(self, z: np.ndarray, rows: np.ndarray, found: np.ndarray, weight: np.ndarray) -> None:
        """Adds to z[row] the scores of the known entries ``found``, times their weights."""
        z += np.bincount(rows, weight, len(z))[:, None] * self.rest
        count = self.first[found + 1] - self.first[found]
        at = np.arange(count.sum()) + np.repeat(self.first[found] - (np.cumsum(count) - count), count)
        cell = np.repeat(rows, count) * z.shape[1] + self.lang[at]
        z += np.bincount(cell, np.repeat(weight, count) * self.more[at], z.size).reshape(z.shape)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prior: np.ndarray
    tables: dict[int, Table]  # by length; 0 is words


class Words:
    """The distinct words of some lower-cased texts, and where they stand.

    ``rows`` and ``which`` say of every word its text and its number among the distinct ones.
    """

    def __init__(self, texts: tuple[str, ...], data: np.ndarray, offsets: np.ndarray):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        letter = _is_letter()[points]
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each code point, and the end
        edge = np.zeros(len(points) + 1, dtype=bool)
        edge[np.searchsorted(lead, offsets)] = True
        starts = np.flatnonzero(letter & (edge[:-1] | ~np.concatenate([[False], letter[:-1]])))
        ends = np.flatnonzero(letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
        self.lead, self.slices = lead, SliceHash(data)
        self.rows = np.searchsorted(offsets, lead[starts], side="right") - 1
        self.hashes, at, self.which = np.unique(self.slices(lead[starts], lead[ends]), return_index=True, return_inverse=True)
        self.starts, self.ends = starts[at], ends[at]

    def grams(self, n: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, index in ``words`` and code point of every n-gram of these distinct words."""
        starts = self.starts[words]
        count = np.maximum(self.ends[words] - starts - n + 1, 0)
        word = np.repeat(np.arange(len(words)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[word]
        return self.slices(self.lead[at], self.lead[at + n]), word, at


def text_parts(texts: list[str], part: int) -> Iterator[tuple[int, str]]:
    """(row, part) of every text: itself, or parts that no word crosses; a longer word is in one part."""
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at > part:
            end = next((k for k in range(at + part, len(text)) if not text[k].isalpha()), len(text))
            yield row, text[at:end]
            at = end
        yield row, text[at:]


def _each(column: pa.Array, part: int = PART) -> Iterator[tuple[np.ndarray, Words]]:
    """Words of pieces of a batch, lower-cased, and the batch's row of each text in the piece; null counts as empty."""
    rows, texts = zip(*text_parts([t.lower() if t else "" for t in column.to_pylist()], part), strict=True) if len(column) else ((), ())
    rows, (data, offsets) = np.array(rows, dtype=np.int64), text_bytes(pa.array(texts, pa.large_string()))
    for a, b in pieces(offsets):
        yield rows[a:b], Words(texts[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, hash, count) of words (n = 0) and n-grams of each batch."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names, code = np.unique(np.array(langs, dtype=object), return_inverse=True) if langs else (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64))
        for rows, w in _each(batch.column("text")):
            pair, count = np.unique(code[rows][w.rows] * max(1, len(w.hashes)) + w.which, return_counts=True)
            lang, word = pair // max(1, len(w.hashes)), pair % max(1, len(w.hashes))
            for n in (0, *LENGTHS):
                found, of = (w.hashes[word], np.arange(len(word))) if n == 0 else w.grams(n, word)[:2]
                key = mix(found) ^ lang[of].astype(U64)  # tells (n-gram, language) apart within the piece
                _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
                total = np.bincount(inverse, count[of], len(at)).astype(np.int64)
                columns = [pa.array(names[lang[of[at]]].tolist(), pa.string()), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(found[at].view(np.int64)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "hash", "count"])


def train(documents: DataFrame, most: int = MAX_DOCS, most_bytes: int = MAX_BYTES) -> Model:
    """A model from text and lang of a sample of the documents that aren't held out.

    The sample is those of the least hashes of their ids: at most ``most``, and none once
    ``most_bytes`` are reached, whatever ids repeat; equal rows of one id are learned once.  All words and n-grams
    of its texts are learned.
    """
    usable = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("doc_id", "lang", "text", F.octet_length("text").alias("n"), F.xxhash64("lang", "text").alias("content"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("content")]
    rows = usable.select("doc_id", "content", "n").orderBy(*order).limit(most)
    before = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # over ``most`` rows at most
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most_bytes).select("doc_id", "content").distinct()
    # a row is found by its id and content, so an id with many texts brings those that were chosen; equal rows count once
    some = usable.join(F.broadcast(rows), ["doc_id", "content"]).dropDuplicates(["doc_id", "content"]).select("lang", "text")
    counts = some.mapInArrow(_count, "lang string, n int, hash long, count long").groupBy("lang", "n", "hash").agg(F.sum("count").alias("count"))
    learned = cut(counts).toArrow()  # bounded by the sample
    names, lang = np.unique(np.array(learned.column("lang").to_pylist(), dtype=object), return_inverse=True) if len(learned) else ([], np.zeros(0, dtype=np.int64))
    n, hashes, count = (learned.column(c).to_numpy() for c in ("n", "hash", "count"))
    tables, sizes = {}, np.zeros(len(names))
    for k in (0, *LENGTHS):
        use = np.flatnonzero(n == k)
        use = use[np.lexsort((lang[use], hashes[use].view(U64)))]
        distinct, first = np.unique(hashes[use].view(U64), return_index=True)
        size = np.bincount(lang[use], count[use], len(names))
        below = np.log(size + 0.5 * max(1, len(distinct)))
        tables[k] = Table(distinct, np.append(first, len(use)), lang[use], np.log((count[use] + 0.5) / 0.5), np.log(0.5) - below)
        sizes = size if k == 0 else sizes
    return Model(list(names), np.log((sizes + 1) / (sizes + 1).sum()), tables)


def score_texts(model: Model, n_texts: int, w: Words) -> np.ndarray:
    """The log-likelihood of every text and language, up to a constant."""
    z = np.zeros((n_texts, len(model.langs)))
    pair, count = np.unique(w.rows * max(1, len(w.hashes)) + w.which, return_counts=True)
    row, word = pair // max(1, len(w.hashes)), pair % max(1, len(w.hashes))
    known = model.tables[0].find(w.hashes)
    use = known[word] >= 0
    model.tables[0].add(z, row[use], known[word[use]], WORD_WEIGHT * count[use])
    row, word, count = row[~use], word[~use], count[~use].astype(np.float64)
    new, word = np.unique(word, return_inverse=True)
    size = w.ends[new] - w.starts[new]
    base = np.cumsum(size) - size
    done = np.zeros(int(size.sum()), dtype=bool)  # places that a longer n-gram has scored
    for n in LENGTHS:
        found, of, at = w.grams(n, new)
        slot = base[of] + at - w.starts[new][of]
        entry = model.tables[n].find(found)
        hit = np.flatnonzero((entry >= 0) & ~done[slot])
        done[slot[hit]] = True
        # the n-grams of each word stand together: every text that has the word gets them
        first = np.searchsorted(of[hit], np.arange(len(new) + 1))
        many = first[word + 1] - first[word]
        which = hit[np.arange(many.sum()) + np.repeat(first[word] - (np.cumsum(many) - many), many)]
        model.tables[n].add(z, np.repeat(row, many), entry[which], np.repeat(count / size[word], many))
    return z


def score_column(model: Model, column: pa.Array, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihoods of a column's texts, prior included, and which of them have a letter."""
    z, some = np.tile(model.prior, (len(column), 1)), np.zeros(len(column), dtype=bool)
    for rows, w in _each(column, part):
        np.add.at(z, rows, score_texts(model, len(rows), w))
        some[rows[w.rows]] = True
    return z, some


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.  The
    score is the predicted language's share of the posterior; ties go to the first language by name.  Every input row gives a row; other columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            best, share = np.full(len(batch), len(model.langs)), np.zeros(len(batch))
            if model.langs:
                z, some = score_column(model, batch.column("text"))
                z = z[some]
                best[some] = z.argmax(axis=1)
                share[some] = 1 / np.exp(np.maximum(z - z.max(axis=1, keepdims=True), -700)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(share)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return df.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")
