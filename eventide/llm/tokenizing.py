"""Encoders that call the tokenizer libraries once per distinct piece instead of once per text.

Both kinds of tokenizer split a text at certain places before they merge anything, so the ids of a text are those of
its pieces in order. A text is cut only where that is certain: before single spaces between visible Latin characters,
around a line break, and where letters, digits and other signs meet, but not between an apostrophe and a letter, since both
kinds keep endings such as 's together. Texts with anything else (other scripts, tabs, runs of spaces), or with one of the
tokenizer's added tokens, go to the library whole, and so does everything if the tokenizer's own settings are not those
this reasoning was made for.

Many texts are cut together, by array operations over their code points. Pieces are known by a 64-bit hash of their code
points and length; distinct ones of the texts at hand are looked up among those met before, and the library encodes only the
rest. What is kept is bounded and changes no result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from operator import attrgetter

import numpy as np

from .hash_arrays import mix, span_hashes

WORDS_KEPT = 300_000
PIECES_KEPT = 1_500_000
RECENT = 1 << 16
GROUP = 1 << 20  # characters worked on at once
_ODD = re.compile(r"[^\n -~¡-ɏ]")
_ID = attrgetter("id")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
SPACE, LETTER, DIGIT, SIGN, WHOLE, BREAK, ODD = range(7)  # WHOLE: visible, never cut from its neighbours
_CODES = 0x251  # all from here on are odd


def _kind(code: int) -> int:
    character = chr(code)
    if character in " \n":
        return SPACE if character == " " else BREAK
    if _ODD.match(character):
        return ODD
    if _WORD.fullmatch(character):
        return LETTER
    return (DIGIT if character.isdigit() else SIGN) if code < 128 else WHOLE


_KINDS = np.fromiter(map(_kind, range(_CODES)), np.uint8, _CODES)


def _unsure(text: str) -> bool:
    """A character outside line breaks, ASCII and Latin letters, or a space not between two visible characters."""
    return (
        text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _ODD.search(text) is not None
    )


def _byte_letters() -> dict[str, str]:
    """The characters byte-level vocabularies use for bytes: printable ones stand for themselves, others follow from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(kept)]
    return {chr(b): chr(b) for b in kept} | {chr(b): chr(256 + i) for i, b in enumerate(other)}


class Lately(dict):
    """Computes what it lacks. Holds one full generation of entries and the one before; an entry used again moves on."""

    def __init__(self, compute: Callable, kept: int = WORDS_KEPT):
        self.compute, self.kept, self.before = compute, kept, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.kept:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of consecutive spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class KnownPieces:
    """Ids of pieces by sorted hash. New ones gather in a short table that is merged into the long one now and then."""

    def __init__(self, kept: int = PIECES_KEPT):
        self.kept, self.tables = kept, [self._empty(), self._empty()]

    @staticmethod
    def _empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)  # hashes, bounds, ids

    @staticmethod
    def _merged(a, b):
        hashes = np.concatenate((a[0], b[0]))
        order = np.argsort(hashes, kind="stable")
        sizes = np.concatenate((np.diff(a[1]), np.diff(b[1])))
        starts = np.concatenate((a[1][:-1], b[1][:-1] + a[1][-1]))
        ids = np.concatenate((a[2], b[2]))[_spans(starts[order], sizes[order])]
        return hashes[order], np.r_[0, np.cumsum(sizes[order])], ids

    def ids(self, hashes: np.ndarray, encode: Callable[[np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and sizes of the ids of distinct sorted hashes, and all these ids; ``encode`` gives those of unknown positions."""
        starts, sizes, found, at = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), [], 0
        left = np.arange(len(hashes))
        for known, bounds, ids in self.tables:
            if len(known) and len(left):
                place = np.minimum(np.searchsorted(known, hashes[left]), len(known) - 1)
                hit = known[place] == hashes[left]
                place, rows = place[hit], left[hit]
                sizes[rows] = bounds[place + 1] - bounds[place]
                starts[rows] = at + np.cumsum(sizes[rows]) - sizes[rows]
                found.append(ids[_spans(bounds[place], sizes[rows])])
                at, left = at + len(found[-1]), left[~hit]
        if len(left):
            new = encode(left)
            sizes[left] = np.fromiter(map(len, new), np.int64, len(new))
            bounds = np.r_[0, np.cumsum(sizes[left])]
            starts[left] = at + bounds[:-1]
            found.append(np.fromiter((i for ids in new for i in ids), np.uint32, int(bounds[-1])))
            self._add((hashes[left], bounds, found[-1]))
        return starts, sizes, np.concatenate(found) if found else np.zeros(0, np.uint32)

    def _add(self, new) -> None:
        long, recent = self.tables
        recent = self._merged(recent, new)
        if len(recent[0]) >= RECENT:
            long = recent if len(long[0]) + len(recent[0]) > self.kept else self._merged(long, recent)
            recent = self._empty()
        self.tables = [long, recent]


class BpeEncoder:
    """Ids of whole texts from a ``tokenizers`` file, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        kind = (settings.get("pre_tokenizer") or {}).get("type")
        plain = settings["model"]["type"] == "BPE" and not settings["model"].get("dropout") and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) or t["content"].isalpha()
            for t in settings["added_tokens"]
        )
        self.keeps_space = kind == "ByteLevel" and settings.get("normalizer") is None
        self.drops_space = kind == "Sequence" and [
            n["type"] for n in (settings.get("normalizer") or {}).get("normalizers", [])
        ] == ["NFC", "Replace", "Lowercase"] and settings["pre_tokenizer"]["pretokenizers"][0].get("behavior") == "Removed"
        prefix = settings["pre_tokenizer"].get("add_prefix_space", False) if self.keeps_space else False
        self.by_piece = plain and not prefix and (self.keeps_space or self.drops_space)
        self.added = [t["content"] for t in settings["added_tokens"]]
        self.letters = str.maketrans(_byte_letters())
        folded = [ord(chr(c).lower()) if self.drops_space and _KINDS[c] == LETTER else c for c in range(_CODES)]
        self.values = mix(np.asarray(folded, np.uint64) + np.uint64(1))
        self.known = KnownPieces()

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        """Ids of a piece: a single word by the merge model alone, others by the whole library."""
        if not _WORD.fullmatch(piece):
            return self.library.encode(piece, add_special_tokens=False).ids
        word = piece if self.keeps_space else piece.lower()
        return list(map(_ID, self.library.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))))

    def _holds_added(self, text: str) -> bool:
        if any(t in text for t in self.added):
            return True
        return self.drops_space and "<" in text and any(t in text.lower() for t in self.added)

    def _segments(self, texts: Iterable[str]) -> Iterator[tuple[int, str, bool]]:
        """(number of the text, part of it, whether it is known to be sure): long texts are cut at spaces."""
        for number, text in enumerate(texts):
            if len(text) <= GROUP or not self.by_piece or self._holds_added(text) or _unsure(text):
                yield number, text, False
                continue
            at = 0
            while at < len(text):
                to = text.find(" ", at + GROUP)
                to = len(text) if to < 0 else to
                yield number, text[at + (at > 0 and self.drops_space) : to], True
                at = to

    def encode_many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; no more than ``GROUP`` characters, or one text that cannot be cut, are worked on at once."""
        held, size, open_number, parts = [], 0, 0, []

        def settled(group):
            nonlocal open_number, parts
            for number, ids in self._encoded(group):
                while number > open_number:
                    yield np.concatenate(parts) if len(parts) != 1 else parts[0]
                    open_number, parts = open_number + 1, []
                parts.append(ids)

        for segment in self._segments(texts):
            if held and size + len(segment[1]) > GROUP:
                yield from settled(held)
                held, size = [], 0
            held.append(segment)
            size += len(segment[1])
        if held:
            yield from settled(held)
            yield np.concatenate(parts) if len(parts) != 1 else parts[0]

    def _encoded(self, group: list[tuple[int, str, bool]]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids) of each segment."""
        whole = [i for i, (_, text, sure) in enumerate(group) if not sure and (not self.by_piece or self._holds_added(text))]
        skip = set(whole)
        joined = "".join("" if i in skip else text for i, (_, text, _) in enumerate(group))
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), _CODES - 1)
        lengths = np.asarray([0 if i in skip else len(text) for i, (_, text, _) in enumerate(group)], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if len(codes):
            kinds = _KINDS[codes]
            first = np.zeros(len(codes) + 1, bool)
            first[starts[lengths > 0]] = True
            first[-1] = True
            last, first = first[1:], first[:-1]
            space, line = kinds == SPACE, kinds == BREAK
            after = np.r_[False, space[:-1]] & ~first, np.r_[False, line[:-1]] & ~first  # a space, a line break just before
            bad = (kinds == ODD) | space & (last | after[0] | after[1]) | line & after[0]
            trusted = np.repeat(np.asarray([sure for _, _, sure in group]), lengths)
            bad = (bad | space & first) & ~trusted
            unsure = np.unique(np.searchsorted(ends, np.flatnonzero(bad), "right"))
            visible = (kinds >= LETTER) & (kinds <= WHOLE)
            before = np.r_[np.uint8(ODD), kinds[:-1]]
            seen = np.r_[False, visible[:-1]] & ~first  # a visible character just before
            cut = first | space | line & seen | visible & after[1] & np.r_[False, seen[:-1]]
            plain = (kinds >= LETTER) & (kinds <= SIGN) & (before >= LETTER) & (before <= SIGN)
            cut |= plain & (kinds != before) & ~((kinds == LETTER) & np.r_[False, codes[:-1] == 39])
            if len(unsure):
                whole += unsure.tolist()
                left_out = np.zeros(len(group) + 1, bool)
                left_out[unsure] = True
                cut &= ~np.repeat(left_out[:-1], lengths)
            begin = np.flatnonzero(cut)
            of = np.searchsorted(ends, begin, "right")
            end = np.minimum(np.r_[begin[1:], len(codes)], ends[of])
            if self.drops_space:
                begin = begin + space[begin]
            hashes, which, back = np.unique(span_hashes(self.values[codes], begin, end), return_index=True, return_inverse=True)

            def encode(positions: np.ndarray) -> list[list[int]]:
                rows = which[positions]
                return [self._piece(joined[a:b]) for a, b in zip(begin[rows].tolist(), end[rows].tolist())]

            at, sizes, ids = self.known.ids(hashes, encode)
            sizes = sizes[back]
            flat = ids[_spans(at[back], sizes)]
            bounds = np.r_[0, np.cumsum(np.bincount(of, sizes, len(group)).astype(np.int64))]
        else:
            flat, bounds = np.zeros(0, np.uint32), np.zeros(len(group) + 1, np.int64)
        whole_ones = set(whole)
        for i, (number, text, _) in enumerate(group):
            yield number, self._whole(text) if i in whole_ones else flat[bounds[i] : bounds[i + 1]]

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return next(self.encode_many([text])).astype("<u4").tobytes()


class PieceCounter:
    """Numbers of pieces of whole texts from a ``sentencepiece`` model or a ``tokenizers`` file."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            encoder = BpeEncoder(path)
            self.count = lambda text: len(encoder.encode(text)) // 4
            return
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.counts = Lately(lambda word: len(self.library.encode(word)))
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        # Words are independent if nothing rewrites the text and no piece goes on after a space.
        self.by_piece = (
            rules.name == "identity" and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == 4 or re.search("[^▁]▁", p.piece) for p in model.pieces)
        )

    def count(self, text: str) -> int:
        if not self.by_piece or not text or "▁" in text or _unsure(text):
            return len(self.library.encode(text))
        return sum(map(self.counts.__getitem__, text.split(" ")))


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One encoder per Python worker and file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
