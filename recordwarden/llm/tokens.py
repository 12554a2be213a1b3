"""Token ids of texts, by the tokenizers library."""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import compress
from string import punctuation
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Characters encoded together. Nothing is remembered beyond them, so a worker's memory does not grow.
TOGETHER = 8_000_000

#: White space other than the space and the line break, and the mark that pieces are cut at.
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"] + ["\x00"]
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]


class _ByteLetters(dict):
    """For str.translate: the letters that a byte-level vocabulary has for the bytes of a character."""

    def __init__(self, splitter) -> None:
        super().__init__()
        self._splitter = splitter

    def __missing__(self, character: int) -> str:
        letters = self[character] = self._splitter.pre_tokenize_str(chr(character))[0][0]
        return letters


class TokenEncoder:
    """Ids of whole texts for a byte-level BPE vocabulary file, as the library gives them for the whole text.

    The vocabulary's split pattern always starts a new piece at a line break and at a space between
    two visible characters, so a text whose only white space is of these two kinds is the sequence
    of its pieces' ids, and each distinct piece of a portion is encoded once. Any other text, and one
    that holds an added token of the vocabulary (such as <|endoftext|>, which keeps its id), is
    encoded whole. Ids are the same both ways.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._tokenizer.model._resize_cache(0)  # parts are distinct, nothing would be found in it
        self._letters = _ByteLetters(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size >= TOGETHER:
                yield from self._encode_part(part)
                part, size = [], 0
        yield from self._encode_part(part)

    def _encode_part(self, texts: list[str]) -> Iterator[bytes]:
        in_pieces = [self._has_pieces(text) for text in texts]
        found = self._by_pieces([cut for text, own in zip(texts, in_pieces) if own for cut in _cuts(text)])
        for text, own in zip(texts, in_pieces):
            if own:
                yield b"".join([next(found) for _ in _cuts(text)])
            else:
                yield _encoded(self._tokenizer, [text])[0].tobytes()

    def _has_pieces(self, text: str) -> bool:
        if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(pair in text for pair in ("  ", "\n\n", " \n", "\n ")):
            return not text
        return not any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER)) and not any(t in text for t in self._added)

    def _by_pieces(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts that are the sequence of their pieces, portion by portion."""
        at = 0
        while at < len(texts):
            until, size = at, 0
            while until < len(texts) and (size < TOGETHER or until == at):
                size += len(texts[until])
                until += 1
            yield from self._portion(texts[at:until])
            at = until

    def _portion(self, texts: list[str]) -> Iterator[bytes]:
        marked = [text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ") for text in texts]
        counts = np.array([m.count("\x00") + 1 if m else 0 for m in marked], dtype=np.int64)
        joined = pa.array(["\x00".join(filter(None, marked))], pa.large_string())
        del marked
        pieces = pc.split_pattern(joined, "\x00").flatten().dictionary_encode()
        ids, lengths = self._distinct(pieces.dictionary.cast(pa.string()))
        which = pieces.indices.to_numpy()[:counts.sum()]
        tokens = _chosen(ids, lengths, which)
        ends = np.r_[0, np.cumsum(lengths[which])][np.r_[0, np.cumsum(counts)]]
        data = tokens.tobytes()
        for first, last in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield data[4 * first:4 * last]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, one piece after another, and how many each has.

        A word with signs after it has the ids of the word and then of the signs. Parts that the split
        pattern leaves whole go to the merges at once, their bytes spelt as the vocabulary does.
        """
        listed = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), "\x00")[0].as_py().split("\x00")
        words = pc.utf8_is_alpha(pc.utf8_ltrim(pieces, " ")).to_numpy(zero_copy_only=False)
        places = {word: i for i, word in enumerate(compress(listed, words))}
        held, counts = [], np.ones(len(pieces), dtype=np.int64)
        for i in np.flatnonzero(~words).tolist():
            piece = listed[i]
            word = piece.rstrip(punctuation)
            if len(word) < len(piece) and word.removeprefix(" ").isalpha():
                held.append(places.setdefault(word, len(places)))
                held.append(places.setdefault(piece[len(word):], len(places)))
                counts[i] = 2
            else:
                held.append(places.setdefault(piece, len(places)))
        parts = list(places)
        merged = np.ones(len(parts), dtype=bool)
        merged[words.sum():] = [_is_whole(part) for part in parts[words.sum():]]
        ids, lengths = self._merged(list(compress(parts, merged)))
        more, sizes = self._split(list(compress(parts, ~merged)))
        order = np.empty(len(parts), dtype=np.int64)
        order[np.r_[np.flatnonzero(merged), np.flatnonzero(~merged)]] = np.arange(len(parts))
        ids, lengths = np.concatenate([ids, more]), np.concatenate([lengths, sizes])
        of_piece = np.repeat(np.arange(len(pieces)), counts)
        which = np.empty(len(of_piece), dtype=np.int64)
        plain = words[of_piece]
        which[plain], which[~plain] = np.arange(plain.sum()), held
        which = order[which]
        return _chosen(ids, lengths, which), np.bincount(of_piece, lengths[which], minlength=len(pieces)).astype(np.int64)

    def _merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that need no splitting, and how many each has."""
        merge = self._tokenizer.model.tokenize
        spelt = "\x00".join(parts).translate(self._letters).split(self._letters[0]) if parts else []
        ids, ends = array("I"), array("q", [0])
        for part in spelt:
            ids.extend([token.id for token in merge(part)])
            ends.append(len(ids))
        return np.frombuffer(ids, f"u{ids.itemsize}").astype("<u4"), np.diff(np.frombuffer(ends, np.int64))

    def _split(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = _encoded(self._tokenizer, parts)
        return np.concatenate([np.empty(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))


def _encoded(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _chosen(ids: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of the runs `which`, one after another; run i has lengths[i] ids."""
    sizes = lengths[which]
    shift = (np.cumsum(lengths) - lengths)[which] - np.cumsum(sizes) + sizes
    return ids[np.repeat(shift, sizes) + np.arange(sizes.sum())]


def _is_whole(part: str) -> bool:
    """Letters, signs or digits alone, after at most one space: the split pattern leaves them together."""
    bare = part.removeprefix(" ")
    return bare.isalpha() or not bare.strip(punctuation) and bare != "" or bare.isascii() and bare.isdigit()


def _cuts(text: str) -> list[str]:
    """A very long text in parts that start with a space; others as they are."""
    cuts, at = [], 0
    while len(text) - at > TOGETHER and (place := text.find(" ", at + TOGETHER)) > 0:
        cuts.append(text[at:place])
        at = place
    return [*cuts, text[at:]]


def worker_encoder(path: str) -> TokenEncoder:
    """The encoder of this Python worker. It holds the vocabulary alone, so it does not grow with what it encodes."""
    held = sys.modules.setdefault("_recordwarden_encoders", ModuleType("_recordwarden_encoders"))
    if path not in held.__dict__:
        held.__dict__[path] = TokenEncoder(path)
    return held.__dict__[path]
