"""Token ids of whole Arrow batches with a tokenizer file of the ``tokenizers`` library.

A tokenizer that drops white space and marks word ends encodes a text word by word. For such a file each distinct piece
of a batch is encoded once, and the ids of the texts are gathered from those; the ids are those of the plain call. Any
other file encodes every text as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from passagemill.llm.common import starts_of, sums_of, words

# Fixed value: the pattern by which the word-wise tokenizer file cuts words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for words of printable ASCII and Latin letters, in the pattern language of the standard library.
_LATIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Most words: letters whose lower case is one letter of the same set, then marks that make one run.
_COMMON_PATTERN = r'^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?*$%&#|()"]*)$'
_END_OF_LATIN = "ɐ"
_KEPT_PIECES = 250_000
_AT_ONCE = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str):
        # one task is one thread: the tokenizer's own threads would take other tasks' cores
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        config = json.loads(self.whole.to_str())
        self.word_wise = config["model"].get("end_of_word_suffix") == "</w>" and WORD_PATTERN in json.dumps(
            config["pre_tokenizer"], ensure_ascii=False
        ).replace("\\\\", "\\")
        self.known: dict[str, bytes] = {}
        if self.word_wise:
            self.special = tuple(t["content"] for t in config["added_tokens"])
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = None
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            vocabulary = self.whole.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _plain_pieces(self, word: str) -> list[str] | None:
        """The parts that the tokenizer cuts ``word`` into, or None where only the tokenizer itself can tell."""
        low = word.lower()
        if max(word) >= _END_OF_LATIN or max(low) >= _END_OF_LATIN or any(t in word for t in self.special):
            return None
        if not (low.isascii() and low.isprintable()) and not all(c.isalpha() or " " < c < "\x7f" for c in low):
            return None
        return _LATIN_PATTERN.findall(low)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, no two of which touch: a word ends with its mark."""
        done: list[bytes] = []
        for at in range(0, len(pieces), _AT_ONCE):
            part = pieces[at : at + _AT_ONCE]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                raise ValueError("a word has more or less than one end in the tokenizer's output")
            raw, ends = ids.tobytes(), (cuts * 4).tolist()
            done += [raw[s:e] for s, e in zip([0, *ends[:-1]], ends)]
        return done

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        fresh = [p for p in pieces if p not in known]
        known.update(zip(fresh, self._encode(fresh)))
        found = [known[p] for p in pieces]
        if len(known) > _KEPT_PIECES:
            # frequent pieces are in nearly every batch, so the last one's are those worth keeping
            self.known = dict(zip(pieces, found))
        return found

    def _of_others(self, others: list[str]) -> list[bytes]:
        parts = {w: self._plain_pieces(w) for w in others}
        flat = list({p for ps in parts.values() if ps for p in ps})
        known = dict(zip(flat, self._of_pieces(flat)))
        odd = [w for w, ps in parts.items() if ps is None]
        encoded = zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False))
        whole = {w: np.array(found.ids, "<u4").tobytes() for w, found in encoded}
        return [whole[w] if ps is None else b"".join([known[p] for p in ps]) for w, ps in parts.items()]

    def _of_words(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and how many each has.

        Most words are letters and then marks: two units. Any other is one unit and an empty one.
        """
        cut = pc.extract_regex(vocabulary, _COMMON_PATTERN)
        letters = pc.dictionary_encode(pc.utf8_lower(pc.struct_field(cut, "letters")))
        marks = pc.dictionary_encode(pc.struct_field(cut, "marks"))
        other = letters.indices.is_null().to_numpy(zero_copy_only=False)
        listed = marks.dictionary.to_pylist()
        of_marks = dict(zip(full := [m for m in listed if m], self._of_pieces(full)))
        units = self._of_pieces(letters.dictionary.to_pylist())
        n_letters = len(units)
        units += [of_marks.get(m, b"") for m in listed]
        n_marks = len(units)
        units += self._of_others(vocabulary.filter(pa.array(other)).to_pylist())
        pair = np.full((len(vocabulary), 2), len(units), np.int64)
        units.append(b"")
        pair[~other, 0] = letters.indices.drop_null().to_numpy()
        pair[~other, 1] = n_letters + marks.indices.drop_null().to_numpy()
        pair[other, 0] = n_marks + np.arange(other.sum())
        return _gather(np.frombuffer(b"".join(units), "<u4"), np.array([len(u) // 4 for u in units], np.int64), pair)

    def counts(self, text: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.word_wise:
            return np.array([len(e.ids) for e in self.whole.encode_batch_fast(text.to_pylist(), add_special_tokens=False)], np.int64)
        coded, per_text = words(text)
        sizes = self._of_words(coded.dictionary)[1]
        return sums_of(sizes[coded.indices.to_numpy()], per_text)

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of the texts, and how many each text has."""
        if not self.word_wise:
            found = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(text.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(f) for f in found], np.int64)
        coded, per_text = words(text)
        at = coded.indices.to_numpy().reshape(-1, 1)
        table, sizes = _gather(*self._of_words(coded.dictionary), at)
        return table, sums_of(sizes, per_text)


def _gather(table: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``table`` that each row of ``at`` names, joined, and their joint size for each row."""
    order = at.ravel()
    long = sizes[order]
    places = np.repeat(starts_of(sizes)[order] - starts_of(long), long) + np.arange(long.sum())
    return table[places], long.reshape(at.shape).sum(axis=1)
