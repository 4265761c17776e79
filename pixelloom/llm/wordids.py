"""Token ids of texts by a public tokenizer, each distinct word encoded once per batch.

A tokenizer whose pieces never cross white space gives a text the ids of its words in order. ``WordIds``
takes the words apart with Arrow, encodes the distinct ones and puts the ids together with numpy. Words of
Latin letters, digits and marks are lower-cased and cut by the file's own split pattern, in Arrow again, and
their distinct pieces, of which there are far fewer, are given to its model and remembered; all other words
go through the whole tokenizer.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the split pattern of the vocabulary whose words can be cut here. Without apostrophes
#: it parts letters, single digits and runs of marks.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words for the whole tokenizer: with apostrophes, or with anything but visible Latin-1 characters, on whose case and
#: class all libraries agree (the numbers among the latter are left out as well).
_ODD = r"'|[^\x21-\x7E\x{A1}-\x{AC}\x{AE}-\x{B1}\x{B4}-\x{B8}\x{BA}\x{BB}\x{BF}-\x{FF}]"
#: Pieces of a generation. A worker remembers the present and the last one; a piece met again moves to the present one,
#: so frequent pieces stay and those seen once go.
_REMEMBERED = 120_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Pieces:
    """The ids of the pieces met lately."""

    def __init__(self) -> None:
        self.now, self.last = {}, {}

    def get(self, piece: str) -> tuple[int, ...] | None:
        found = self.now.get(piece)
        if found is None:
            found = self.last.get(piece)
            if found is not None:
                self.put(piece, found)
        return found

    def put(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self.now) >= _REMEMBERED:
            self.now, self.last = {}, self.now
        self.now[piece] = ids


_PIECES: dict[str, _Pieces] = {}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class WordIds:
    """Encodes Arrow columns of texts with the tokenizer file at ``path``."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def tokenizer(self):
        return _tokenizer(self.path)

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    @cached_property
    def _layout(self) -> dict:
        """The steps around the model as the file states them, without the vocabulary."""
        tokenizer = self.tokenizer
        state = lambda part: json.loads(part.__getstate__()) if part is not None else None
        added = [{"content": t.content, "lstrip": t.lstrip, "rstrip": t.rstrip, "single_word": t.single_word}
                 for t in tokenizer.get_added_tokens_decoder().values()]
        return {"pre_tokenizer": state(tokenizer.pre_tokenizer), "normalizer": state(tokenizer.normalizer), "added_tokens": added,
                "dropout": tokenizer.model.dropout if hasattr(tokenizer.model, "dropout") else 0, "post_processor": state(tokenizer.post_processor)}

    @cached_property
    def splits_at_space(self) -> bool:
        """Whether white space only separates: it is dropped before the model, and no added token looks around itself."""
        steps = (self._layout.get("pre_tokenizer") or {}).get("pretokenizers", [self._layout.get("pre_tokenizer") or {}])
        added = self._layout.get("added_tokens") or []
        dropped = steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and r"[^\s" in steps[0]["pattern"].get("Regex", "")
        return bool(dropped) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added)

    @cached_property
    def _pattern(self):
        """The split pattern, if lower case and that pattern are all that happens to a word before a byte-level model."""
        normal, split = self._layout.get("normalizer") or {}, self._layout.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in normal.get("normalizers", [])]
        steps = split.get("pretokenizers", [])
        known = kinds == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        bytes_after = len(steps) == 2 and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        if not (known and bytes_after and self._layout["dropout"] is None and self._layout.get("post_processor") is None):
            return None
        return _SPLIT if steps[0]["pattern"]["Regex"] == _SPLIT else None

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces end to end, and how many each has."""
        known = _PIECES.setdefault(self.path, _Pieces())
        model, letters, found = self.tokenizer.model, _byte_letters(), []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(letters)
                ids = tuple(t.id for t in model.tokenize(shown)) if piece else ()
                known.put(piece, ids)
            found.append(ids)
        return self._flat(found)

    @staticmethod
    def _flat(found: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and how many each has."""
        if self._pattern is None:
            return self._flat([x.ids for x in self.tokenizer.encode_batch(words.to_pylist(), add_special_tokens=False)])
        odd = pc.match_substring_regex(words, _ODD)
        for token in self._layout.get("added_tokens") or []:
            odd = pc.or_(odd, pc.match_substring(words, token["content"]))
        whole = self._flat([x.ids for x in self.tokenizer.encode_batch(words.filter(odd).to_pylist(), add_special_tokens=False)])
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(pc.invert(odd))), r"([0-9]|[^\p{L}0-9]+)", r" \1 "))
        coded = cut.flatten().dictionary_encode()
        ids, sizes = gathered(*self._of_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
        lengths = np.empty(len(words), dtype=np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        lengths[is_odd], lengths[~is_odd] = whole[1], np.diff(ends)
        out = np.empty(int(lengths.sum()), dtype=np.int64)
        of_odd = np.repeat(is_odd, lengths)
        out[of_odd], out[~of_odd] = whole[0], ids
        return out, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        filled = pc.fill_null(texts, "")
        if not self.splits_at_space:
            found = [x.ids for x in self.tokenizer.encode_batch(filled.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=np.int64), np.array([len(x) for x in found], dtype=np.int64)
        parts = pc.ascii_split_whitespace(filled)
        coded = parts.flatten().dictionary_encode()
        ids, sizes = gathered(*self._of_words(coded.dictionary), coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
        return ids, np.diff(ends)


def gathered(values: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``index`` names, end to end, of lists laid end to end in ``values``; and their lengths."""
    starts, sizes = np.cumsum(lengths) - lengths, lengths[index]
    ends = np.cumsum(sizes)
    spots = np.repeat(starts[index] - ends + sizes, sizes)
    spots += np.arange(len(spots))
    return values[spots], sizes
