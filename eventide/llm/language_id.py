"""Language identification with interpolated Kneser-Ney character models, one per language.

A text becomes a sequence of symbols: a lower-cased letter is one of 63 symbols (a-z have their own, other letters share
37 by code point), anything else is a gap, and neighbouring gaps are one. Four symbols make a 24-bit key, so a
language has at most 2**24 of them however large the corpus: the bound of what is sent to the tasks. Counts over all
training rows are gathered in Spark. A model holds, for each order, the sorted keys and their probabilities or back-off
weights, and is looked up by binary search.

The language with the lowest cross-entropy per symbol wins; ties go to the first in sorted order. Rejection is calibrated
on the training rows themselves: by language and length class their cross-entropies have a mean and a spread, and a text
is rejected if it lies more than ``REJECT_SPREADS`` spreads and more than ``REJECT_SHARE`` of the way from that mean to the
entropy of evenly random symbols above it; so are texts without letters. A class with fewer than ``FEW`` training rows has
the limit of the next shorter one with as many. Where there is none, the figures of the language over all its lengths
serve, and with fewer than ``FEW`` rows in all the mean of all languages (its own, if higher) and the share of the way alone;
to these the spread of a mean of so few symbols is added. So every language has a limit at every length. Mixed texts of known
languages stay.

Nulls: a null text or one without a letter is ``und`` with score 0; a row without language or text does not train. Without
training rows all texts are ``und``. Repeated rows count each time, whole texts of any length are read, a long one in pieces, so that
a task holds the symbols of one piece at a time. Models take 12 bytes a key and context in each task, whatever the number of
rows; a language has at most 2**24 keys of four symbols.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_names, small, written

ORDER, BITS = 4, 6
KEYS = 1 << (ORDER * BITS)
UNKNOWN = "und"
REJECT_SPREADS = 8.0
REJECT_SHARE = 1 / 2
RANDOM_ENTROPY = BITS * float(np.log(2))  # nats per symbol
LENGTH_CLASSES = 17
FEW = 30  # fewer training rows of a length class share the next shorter one's figures, or else those of all lengths
SYMBOL_SPREAD = 2.0  # nats by which single symbols scatter, for classes shorter than any with figures of its own
SCORE_SYMBOLS = 64  # a score weighs the evidence of at most this many symbols
COUNTED_AT_ONCE = 1 << 20
BATCH_SYMBOLS = 1 << 18  # scored at once
PIECE = 1 << 18  # characters of a text turned into symbols at once


def _symbol(code: int) -> int:
    character = chr(code).lower()[0]
    if not character.isalpha():
        return 0
    return ord(character) - 96 if "a" <= character <= "z" else 27 + ord(character) % 37


_TABLE: list[np.ndarray] = []


def _raw(text: str) -> np.ndarray:
    """A symbol for every character, each gap by itself."""
    if not _TABLE:
        _TABLE.append(np.fromiter(map(_symbol, range(1 << 16)), np.uint8, 1 << 16))
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if codes.size and int(codes.max()) >= 1 << 16:
        far = codes >= 1 << 16
        found = _TABLE[0][np.where(far, 0, codes)]
        found[far] = np.fromiter(map(_symbol, codes[far].tolist()), np.uint8)
        return found
    return _TABLE[0][codes]


def _joined(found: np.ndarray, before: int) -> np.ndarray:
    """Symbols with neighbouring gaps made one, after the symbol ``before``."""
    return found[~((found == 0) & (np.r_[np.uint8(before), found[:-1]] == 0))].astype(np.uint32)


def symbols(text: str) -> np.ndarray:
    """Symbols of a text between two gaps; empty if it has no letter."""
    found = _raw(text)
    return np.r_[np.uint32(0), _joined(np.r_[found, np.uint8(0)], 0)] if found.any() else np.zeros(0, np.uint32)


def _keys_after(tail: np.ndarray, found: np.ndarray) -> np.ndarray:
    padded = np.concatenate((tail, found))
    result = np.zeros(len(found), np.uint32)
    for k in range(ORDER):
        result = (result << BITS) | padded[k : k + len(found)]
    return result


def keys(found: np.ndarray) -> np.ndarray:
    """Key of each symbol after the first with the three symbols before it (gaps before the start)."""
    return _keys_after(np.r_[np.zeros(ORDER - 2, np.uint32), found[:1]], found[1:])


def key_pieces(text: str | None) -> Iterator[np.ndarray]:
    """``keys(symbols(text))`` in pieces; nothing for a text without a letter."""
    tail = np.zeros(ORDER - 1, np.uint32)
    for at in range(0, len(text or ""), PIECE):
        found = _raw(text[at : at + PIECE])
        if at + PIECE >= len(text):
            found = np.r_[found, np.uint8(0)]
        found = _joined(found, int(tail[-1]))
        if len(found):
            yield _keys_after(tail, found)
            tail = np.concatenate((tail, found))[1 - ORDER :]


def count_keys(rows: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows with lang and text."""

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def settle():
            for lang, parts in held.items():
                some, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in totals:
                    some, n = np.concatenate((totals[lang][0], some)), np.concatenate((totals[lang][1], n))
                    some, at = np.unique(some, return_inverse=True)
                    n = np.bincount(at, n).astype(np.int64)
                totals[lang] = some, n
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found in key_pieces(text.as_py()):
                    held.setdefault(lang, []).append(found)
                    size += len(found)
                    if size >= COUNTED_AT_ONCE:
                        settle()
                        size = 0
        settle()
        for lang, (some, n) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"]
            )

    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return known.mapInArrow(count, "lang string, key int, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discount(n: np.ndarray) -> float:
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


@dataclass
class KneserNey:
    """Sorted keys and interpolated log-probabilities of each order, and log back-off weights of their contexts."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    backoff: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, some: np.ndarray, n: np.ndarray) -> KneserNey:
        """From the distinct keys of the highest order and their counts."""
        at = np.argsort(some)
        levels = [(some[at].astype(np.int64), n[at].astype(float))]
        for order in range(ORDER - 1, 0, -1):  # lower orders count the different symbols seen before them
            suffix, seen = np.unique(levels[0][0] & ((1 << (order * BITS)) - 1), return_counts=True)
            levels.insert(0, (suffix, seen.astype(float)))
        model, lower = cls(), None
        for order, (gram, seen) in enumerate(levels, 1):
            discount = _discount(seen)
            context, of = np.unique(gram >> BITS, return_inverse=True)
            total = np.bincount(of, seen)
            weight = discount * np.bincount(of) / total
            below = np.full(len(gram), 1 / (1 << BITS)) if lower is None else np.exp(
                lower[1][np.searchsorted(lower[0], gram & ((1 << ((order - 1) * BITS)) - 1))]
            )
            lower = gram, np.log(np.maximum(seen - discount, 0) / total[of] + weight[of] * below)
            model.grams.append((gram.astype(np.uint32), lower[1]))
            model.backoff.append((context.astype(np.uint32), np.log(weight)))
        return model

    def log_probability(self, asked: np.ndarray) -> np.ndarray:
        """Of each key: its last symbol after those before it."""
        asked = asked.astype(np.uint32)
        result = np.zeros(len(asked))
        open_ = np.arange(len(asked))
        for order in range(ORDER, 0, -1):
            key = asked[open_] & np.uint32((1 << (order * BITS)) - 1)
            gram, value = self.grams[order - 1]
            at = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
            hit = gram[at] == key
            result[open_[hit]] += value[at[hit]]
            open_, key = open_[~hit], key[~hit]
            context, weight = self.backoff[order - 1]
            at = np.minimum(np.searchsorted(context, key >> BITS), len(context) - 1)
            known = context[at] == key >> BITS
            result[open_[known]] += weight[at[known]]
        result[open_] -= BITS * np.log(2)
        return result


def fit_models(counts: DataFrame) -> dict[str, KneserNey]:
    """One model per language from counted keys: at most 2**24 rows per language reach the driver, whatever the corpus."""
    models = {}
    for row in counts.select("lang").distinct().orderBy("lang").collect():
        own = counts.filter(F.col("lang") == row["lang"]).select("key", "n").toArrow()
        models[row["lang"]] = KneserNey.fit(own.column(0).to_numpy(), own.column(1).to_numpy())
    return models


SCORED = "best int, entropy double, score double, n_symbols bigint"


def cross_entropies(texts: Iterable[str | None], n: int, models: list[KneserNey]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per symbol of each of n texts (rows) under each model (columns), and the number of symbols."""
    sums, sizes = np.zeros((n, len(models))), np.zeros(n, np.int64)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def settle():
        if held:
            some, at = np.unique(np.concatenate([k for _, k in held]), return_inverse=True)
            rows, lengths = [row for row, _ in held], [len(k) for _, k in held]
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            for k, model in enumerate(models):
                np.subtract.at(sums[:, k], rows, np.add.reduceat(model.log_probability(some)[at], starts))
            held.clear()

    for row, text in enumerate(texts):
        for found in key_pieces(text):
            held.append((row, found))
            sizes[row] += len(found)
            size += len(found)
            if size >= BATCH_SYMBOLS:
                settle()
                size = 0
    settle()
    return sums / np.maximum(sizes, 1)[:, None], sizes


def score_rows(rows: DataFrame, models: dict[str, KneserNey]) -> DataFrame:
    """Add best (index of the language in sorted order, -1 without letters), entropy, score and n_symbols."""
    shared = rows.sparkSession.sparkContext.broadcast([models[k] for k in sorted(models)])
    at = rows.columns.index("text")

    def work(batches):
        for batch in batches:
            entropy, sizes = cross_entropies((cell.as_py() for cell in batch.column(at)), batch.num_rows, shared.value)
            best = entropy.argmin(1)
            lowest = entropy[np.arange(len(best)), best]
            weight = np.minimum(sizes, SCORE_SYMBOLS)[:, None]
            score = 1 / np.exp(-(entropy - lowest[:, None]) * weight).sum(1)
            none = sizes == 0
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [c for k, c in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns, pa.array(np.where(none, -1, best).astype(np.int32)), pa.array(np.where(none, 0.0, lowest)),
                    pa.array(np.where(none, 0.0, score)), pa.array(sizes),
                ],
                names=[*names, *(c.split()[0] for c in SCORED.split(", "))],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(work, ", ".join([*fields, SCORED]))


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(n, F.lit(1)))), F.lit(LENGTH_CLASSES - 1)).cast("int")


def _pooled(groups: list) -> tuple[int, float, float]:
    """Rows, mean and spread of several groups together."""
    n = sum(r["n"] for r in groups)
    mean = sum(r["n"] * r["mean"] for r in groups) / max(1, n)
    square = sum(r["n"] * (r["spread"] ** 2 + r["mean"] ** 2) for r in groups) / max(1, n)
    return n, mean, max(0.0, square - mean**2) ** 0.5


def _limit(mean: float, spread: float) -> float:
    return mean + max(REJECT_SPREADS * spread, REJECT_SHARE * (RANDOM_ENTROPY - mean))


def _limits(scored: DataFrame, languages: int) -> dict[tuple[int, int], float]:
    """Highest accepted cross-entropy of every language and length class, from training rows: one small row for each."""
    stats = scored.filter("training AND best >= 0").groupBy("best", _length_class(F.col("n_symbols")).alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("spread")
    )
    found, limits = stats.collect(), {}
    _, usual, _ = _pooled(found)
    for best in range(languages):
        own = {r["size"]: r for r in found if r["best"] == best}
        n, mean, spread = _pooled(list(own.values()))
        overall, limit = _limit(mean, spread) if n >= FEW else _limit(max(mean, usual), 0.0), None
        for size in range(LENGTH_CLASSES):
            if size in own and own[size]["n"] >= FEW:
                limit = _limit(own[size]["mean"], own[size]["spread"])
            limits[best, size] = overall + SYMBOL_SPREAD / 2 ** (size / 2) if limit is None else limit
    return limits


def identify(docs: DataFrame, held_out: Column, keep: list[str] | None = None) -> DataFrame:
    """Learn from rows that are not ``held_out`` and predict all: ``keep`` columns, held_out, lang_pred, score, rejected.

    ``lang_pred`` is a learned language, or ``und`` without letters. ``rejected`` marks texts unlike any learned language.
    """
    keep = ["doc_id"] if keep is None else keep
    training = ~F.coalesce(held_out, F.lit(False))
    models = fit_models(written(count_keys(docs.filter(training)), "language-counts"))
    rows = docs.select(
        *keep, "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), (training & F.col("lang").isNotNull()).alias("training")
    )
    if not models:
        return rows.drop("text", "training").withColumns(
            {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "entropy": F.lit(0.0), "rejected": F.lit(True)}
        )
    scored = written(score_rows(rows, models), "language-scores")
    names = F.array(*[F.lit(k) for k in sorted(models)])
    limits = _limits(scored, len(models))
    table = F.create_map(*[x for (best, size), v in sorted(limits.items()) for x in (F.lit(best * LENGTH_CLASSES + size), F.lit(v))])
    accepted = F.col("entropy") <= F.try_element_at(table, F.col("best") * LENGTH_CLASSES + _length_class(F.col("n_symbols")))
    return scored.select(
        *keep, "held_out", F.when(F.col("best") < 0, UNKNOWN).otherwise(F.get(names, F.col("best"))).alias("lang_pred"),
        "score", "entropy", ((F.col("best") < 0) | ~accepted).alias("rejected"),
    )


def without_rejected(docs: DataFrame, held_out: Column) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; columns stay, whatever their names."""
    content = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    key, bad_id, bad_key = free_names(docs, "_key", "_d", "_k")
    found = identify(docs.select("doc_id", "text", "lang", content.alias("key")), held_out, ["doc_id", "key"])
    bad = small(written(found.filter("rejected").select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct(), "rejected"))
    keyed = docs.withColumn(key, content)
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").drop(key)


def fifth(doc_id: Column) -> Column:
    """Rows held out from learning: every fifth by checksum of the id; a null id is held out of nothing."""
    return F.crc32(doc_id.cast("string")) % 5 == 0
