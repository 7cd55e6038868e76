"""Scoring texts with an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

Tokens are the words of a text with A-Z lower-cased, cut at ASCII white space, and one end token. A word is known by a 64-bit
hash. Three steps build the model, each a count in Spark merged by slices of hashes (``hash_arrays``): the words and how often
each occurs; the pairs of neighbouring words (a start mark before the first), as one number of the two words'
places in the sorted word array; and per word in how many different pairs it comes second, how often it comes
first, and with how many seconds once, twice, or more often. Nothing is pruned: the model holds every pair of the training rows.

P(w | v) = (n(v, w) - D(n)) / n(v, .) + weight(v) * P(w), with P(w) = (a(w) - D(a)) / a(.) + weight / (V + 1), where a(w)
is the number of different words before w and the share of V + 1 also serves words never seen. The three discounts of each level
follow from the numbers of entries counted one to four times, kept between 0.1 and 0.1 less than the count.
After a word not met in training, P(w) alone counts.

The order is two: on prose, different triples are nearly as many as tokens, so that model would be larger than the texts.

Nulls: a null text is empty (its end token alone); a null flag is not held out. Empty tables give no rows; without training
rows every token has probability 1. Repeated rows count and are scored each time. Very long texts are read piece by piece, cut at
white space, with the last word of a piece carried over. Other columns, whatever their names, are passed on only if kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import scratch_path
from .hash_arrays import PACKED, Files, Tally, columns_of, counted, find, merge_slices, mix, packed_slices, slice_bits, span_hashes, summed, unmix

PIECE = 1 << 21  # bytes of text worked on at once
SMOOTHING = 0.1  # of the base score
START, END = np.uint64(0x53544152543E3E3E), np.uint64(0x454E443C3C3C3C3C)
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = mix(_LOWER.astype(np.uint64) + np.uint64(1))
WORD_FILE = ["<u8", "<u8"]  # hash, count
USE_FILE = ["<u4", "<u8", "<u4", "<u4", "<u4"]  # words before; times first; seconds met once, twice, more often
SCORED = "n_tokens bigint, n_known bigint, base_score double, score double"


@dataclass
class Piece:
    """Tokens of neighbouring rows: the row and hash of each, whether it is its row's first, and the word before the piece."""

    row: np.ndarray
    word: np.ndarray
    first: np.ndarray
    before: np.uint64


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """All tokens of all rows, in pieces of about ``PIECE`` bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends, row, at, before = offsets[1:], 0, int(offsets[0]), START
    while row < len(texts):
        closed = int(np.searchsorted(ends, at + PIECE, "right")) - row
        if closed:
            to = int(ends[row + closed - 1])
        else:  # a long text: cut behind white space
            to, last = at + PIECE, int(ends[row])
            space = np.flatnonzero(~_WORD_BYTE[data[at:to]])
            while not len(space) and to < last:
                space = np.flatnonzero(~_WORD_BYTE[data[to : to + PIECE]]) + (to - at)
                to += PIECE
            to = min(at + int(space[-1]) + 1 if len(space) else last, last)
            closed = int(to == last)
        part, stops = data[at:to], ends[row : row + closed] - at
        inside, cut = _WORD_BYTE[part], np.zeros(to - at + 1, bool)
        cut[stops] = True
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        finishes[:-1] &= ~inside[1:] | cut[1:-1]
        begin, finish = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        text = np.searchsorted(stops, begin, "right")
        stop_at = np.searchsorted(begin, stops) + np.arange(closed)
        word_at = np.arange(len(begin)) + text
        word, of = np.empty(len(begin) + closed, np.uint64), np.empty(len(begin) + closed, np.int64)
        word[word_at], word[stop_at] = span_hashes(_BYTE_VALUE[part], begin, finish), END
        of[word_at], of[stop_at] = row + text, row + np.arange(closed)
        first = np.zeros(len(word) + 1, bool)
        first[0] = before == START
        first[stop_at + 1] = True
        if len(word):
            yield Piece(of, word, first[:-1], before)
            before = START if first[-1] else word[-1]
        row, at = row + closed, to


def _places(files: Files, bits: int, bases: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each distinct sorted word among all words (2**32 - 1 if unknown), and its count."""
    place, n = np.full(len(words), 0xFFFFFFFF, np.uint64), np.zeros(len(words), np.uint64)
    for of, asked, at in find(files, bits, words):
        place[asked] = (at + bases[of]).astype(np.uint64)
        n[asked] = columns_of(files, of, WORD_FILE)[1][at]
    return place, n


def discounts(n: list[int]) -> list[float]:
    """Of entries counted once, twice, and more often, from the numbers of entries counted one to four times."""
    if not (n[0] and n[1]):
        return [0.5, 0.75, 0.9]
    share = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * share * n[1] / n[0], 2 - 3 * share * n[2] / n[1], 3 - 4 * share * n[3] / n[2] if n[2] else 1.0]
    return [float(min(max(d, 0.1), k - 0.1)) for k, d in enumerate(raw, 1)]


def _taken(n: np.ndarray, by: list[float]) -> np.ndarray:
    """What is left of counts after their discount."""
    return np.where(n > 0, n - np.asarray([0.0, *by])[np.minimum(n, 3).astype(np.int64)], 0.0)


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few numbers about all of them; small, whatever the corpus."""

    bits: int
    words: Files
    bases: np.ndarray
    uses: Files
    pairs: Files
    pair_kinds: dict[int, str]
    n_tokens: int
    n_words: int
    n_pairs: int
    word_discounts: list[float]
    pair_discounts: list[float]
    word_weight: float

    def log10(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of each token."""
        marks = np.asarray([piece.before, START], np.uint64)
        words, at = np.unique(np.concatenate((piece.word, marks)), return_inverse=True)
        token, previous = at[:-2], np.r_[at[-2], at[:-3]]
        previous[piece.first] = at[-1]
        place, n = _places(self.words, self.bits, self.bases, words)
        before, first, weight = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words))
        known = np.flatnonzero(place != 0xFFFFFFFF)  # words are sorted, and so are the places of those known
        bounds = np.searchsorted(place[known].astype(np.int64), self.bases)
        for of, name in self.uses.names.items():
            own = known[bounds[of] : bounds[of + 1]]
            if len(own):
                inside = place[own].astype(np.int64) - self.bases[of]
                a, times, *seconds = (c[inside] for c in columns_of(self.uses, of, USE_FILE))
                before[own], first[own] = a, times
                weight[own] = sum(d * s for d, s in zip(self.pair_discounts, seconds)) / np.maximum(times, 1)
        single = _taken(before, self.word_discounts) / max(1, self.n_pairs) + self.word_weight / (self.n_words + 1)
        both = (place[previous] != 0xFFFFFFFF) & (place[token] != 0xFFFFFFFF)
        asked, back = np.unique(mix((place[previous[both]] << np.uint64(32)) | place[token[both]]), return_inverse=True)
        met = np.zeros(len(asked))
        for of, which, where in find(self.pairs, self.bits, asked):
            met[which] = columns_of(self.pairs, of, ["<u8", self.pair_kinds[of]])[1][where]
        pair = np.zeros(len(token))
        pair[both] = met[back]
        after = first[previous]
        smooth = np.where(after > 0, weight[previous], 1.0) * single[token]
        return np.log10(_taken(pair, self.pair_discounts) / np.maximum(after, 1) + smooth), n[token]


def fit(rows: DataFrame) -> Model:
    """Count the model of all rows' ``text`` and write its arrays into the shared folder."""
    spark = rows.sparkSession
    folder = scratch_path(spark, "language-model")
    rows = rows.select("text")
    bits = slice_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def count_words(batches):
        tally = Tally(bits)
        yield from tally.add(np.asarray([START]), np.zeros(1, np.uint64))
        for batch in batches:
            for piece in pieces(batch.column(0)):
                yield from tally.add(*counted(piece.word))
        yield from tally.rest()

    def word_arrays(of, keys, n):
        return [keys, n[:, 0]], [len(keys), n.sum(), (n > 0).sum()]

    words, noted = merge_slices(rows.mapInArrow(count_words, PACKED), f"{folder}/words", word_arrays, ["size", "tokens", "words"], "lm-words")
    sizes = np.zeros(1 << bits, np.int64)
    for r in noted:
        sizes[r["slice"]] = r["size"]
    bases = np.r_[0, np.cumsum(sizes)]
    if bases[-1] >= 1 << 32:
        raise ValueError(f"{bases[-1]} different words; places have 32 bits")

    def count_pairs(batches):
        tally = Tally(bits)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                some, at = np.unique(np.concatenate((piece.word, np.asarray([piece.before, START]))), return_inverse=True)
                place = _places(words, bits, bases, some)[0][at]
                previous = np.r_[place[-2], place[:-3]]
                previous[piece.first] = place[-1]
                yield from tally.add(*counted(mix((previous << np.uint64(32)) | place[:-2])))
        yield from tally.rest()

    def pair_arrays(of, keys, n):
        n = n[:, 0]
        wide = int(n.max()) >= 1 << 32
        return [keys, n.astype("<u8" if wide else "<u4")], [len(keys), wide, *((n == k).sum() for k in range(1, 5))]

    pairs, pair_notes = merge_slices(
        rows.mapInArrow(count_pairs, PACKED), f"{folder}/pairs", pair_arrays, ["size", "wide", "n1", "n2", "n3", "n4"], "lm-pairs"
    )
    kinds = {r["slice"]: "<u8" if r["wide"] else "<u4" for r in pair_notes}

    def count_uses(batches):
        for batch in batches:
            for of in batch.column(0).to_pylist():
                keys, n = columns_of(pairs, of, ["<u8", kinds[of]])
                keys, n = unmix(np.asarray(keys)), np.asarray(n, np.uint64)
                one, zero = np.ones(len(n), np.uint64), np.zeros(len(n), np.uint64)
                firsts = np.stack([zero, n, *((x).astype(np.uint64) for x in (n == 1, n == 2, n > 2))], 1)
                seconds = np.stack([one, zero, zero, zero, zero], 1)
                first, firsts = summed(keys >> np.uint64(32), firsts)
                second, seconds = summed(keys & np.uint64(0xFFFFFFFF), seconds)
                place, sums = summed(np.concatenate((first, second)), np.concatenate((firsts, seconds)))
                bounds = np.searchsorted(place.astype(np.int64), bases)
                # A place and its slice as one sorted number: the slice on top, as for hashes.
                of_place = np.repeat(np.arange(len(bases) - 1, dtype=np.uint64), np.diff(bounds))
                yield packed_slices((of_place << np.uint64(64 - bits)) | place, sums, bits)

    def use_arrays(of, keys, sums):
        inside = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) - bases[of]
        dense = np.zeros((sizes[of], 5), np.uint64)
        dense[inside] = sums
        a = dense[:, 0]
        arrays = [dense[:, k].astype(kind) for k, kind in enumerate(USE_FILE)]
        return arrays, [len(a), *((a == k).sum() for k in range(1, 5)), (a > 2).sum()]

    if not pair_notes:  # no training row
        empty = Files(folder, {}, {})
        return Model(bits, words, bases, empty, empty, {}, 0, 0, 0, discounts([0]), discounts([0]), 1.0)
    slices = spark.createDataFrame([(of,) for of in sorted(pairs.names)], "slice int").repartition(min(len(pairs.names), 1 << 12), "slice")
    uses, use_notes = merge_slices(
        slices.mapInArrow(count_uses, PACKED), f"{folder}/uses", use_arrays, ["size", "n1", "n2", "n3", "n4", "more"], "lm-uses"
    )
    total = lambda notes, name: sum(r[name] for r in notes)
    by_word = discounts([total(use_notes, f"n{k}") for k in range(1, 5)])
    by_pair = discounts([total(pair_notes, f"n{k}") for k in range(1, 5)])
    n_pairs = total(pair_notes, "size")
    given = sum(d * total(use_notes, k) for d, k in zip(by_word, ("n1", "n2", "more")))
    return Model(
        bits, words, bases, uses, pairs, kinds, total(noted, "tokens"), total(noted, "words"), n_pairs, by_word, by_pair, given / n_pairs
    )


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with n_tokens, n_known (tokens met in training), base_score and score in place of ``text``."""
    at = rows.columns.index("text")

    def work(batches):
        share = SMOOTHING / (model.n_tokens + SMOOTHING * (model.n_words + 1))
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((4, n))
            for piece in pieces(batch.column(at)):
                logs, met = model.log10(piece)
                low, high = int(piece.row[0]), int(piece.row[-1]) + 1
                of = piece.row - low
                base = np.log10(met / SMOOTHING * share + share)
                for k, weights in enumerate((None, met > 0, base, logs)):
                    sums[k, low:high] += np.bincount(of, weights, high - low)
            kept = [(c, f) for k, (c, f) in enumerate(zip(batch.columns, batch.schema.names)) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*(c for c, _ in kept), *(pa.array(s.astype(np.int64)) for s in sums[:2]), *(pa.array(s) for s in sums[2:])],
                names=[*(f for _, f in kept), *(c.split()[0] for c in SCORED.split(", "))],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(work, ", ".join([*fields, SCORED]))


def score_texts(docs: DataFrame, held_out: Column, keep: list[str] | None = None) -> DataFrame:
    """Learn from rows that are not ``held_out``, score all: ``keep`` columns, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed single words), score (log10 probability of the text) and perplexity (per token)."""
    keep = ["doc_id"] if keep is None else keep
    out = F.coalesce(held_out, F.lit(False))
    model = fit(docs.filter(~out))
    scored = score(docs.select(*keep, out.alias("held_out"), "text"), model)
    return scored.select(
        *keep, "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def tenth(doc_id: Column) -> Column:
    """Rows held out from learning: every tenth by checksum of the id; a null id is held out of nothing."""
    return F.crc32(doc_id.cast("string")) % 10 == 0
