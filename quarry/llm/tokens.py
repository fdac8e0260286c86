"""Token ids of whole texts, with one encoding per distinct word.

The vocabulary's tokenizer never merges across white space, so a text's ids
are its words' ids in order. Arrow splits a batch into words and numbers the
distinct ones; only words not seen by this worker reach the tokenizer.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from tokenizers import Tokenizer, models

#: Distinct word stems a Python worker remembers; in two generations.
CACHE_WORDS = 200_000
#: Text bytes encoded at once: the more, the fewer words are looked up again.
TOKEN_SLICE_BYTES = 4 << 20

# Below U+0300 no character combines, so NFC changes nothing there; U+0130 is the
# one whose lower case is two characters, and "<|" may open a special token.
_PLAIN = 0x300
_EXOTIC = "[^\x00-\u02ff]|\u0130|<\\|"
_LETTERS = "".join(chr(c) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == "N")
# The word vocabulary's pre-token pattern, over those characters.
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t-\r\x85\xa0{_LETTERS}{_NUMBERS}]+")
#: Marks split off a word's end, behind a letter or number, before its stem is looked up.
_TAIL = ".,"


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's printable stand-in for each byte: itself when it prints,
    else the next free code point from 256."""
    shown = {b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


def _pieces(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids in each piece)."""
    return (np.frombuffer(b"".join(found), np.uint32),
            np.fromiter(map(len, found), np.int32, len(found)) >> 2)


# The text rules that ``_plain`` follows.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}


def follows_rules(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer has the text rules above and a plain word-end BPE."""
    # The parts' own states: the whole file's text would hold the vocabulary too.
    rules = {name: json.loads(part.__getstate__()) if (part := getattr(tokenizer, name)) is not None else None
             for name in _RULES}
    model = tokenizer.model
    return (rules == _RULES and tokenizer.post_processor is None and isinstance(model, models.BPE)
            and model.end_of_word_suffix == "</w>"
            and not (model.dropout or model.continuing_subword_prefix or model.byte_fallback or model.ignore_merges))


class WordTokenizer:
    """``encode(texts)`` gives the same ids as ``tokenizers`` on each whole text.
    A file with other rules than the word vocabulary's encodes whole texts."""

    def __init__(self, name: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.by_word = follows_rules(self.tokenizer)
        self.letters = _byte_letters()
        self.limit = cache_words
        # Two generations: words met again move to the younger one, the rest go with the older.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        """Ids of a lower-case word without white space, all below U+0300."""
        if (out := self.older.get(word)) is not None:
            self.known[word] = out
            return out
        ids = []
        for part in [word] if word.isalpha() else _PRETOKEN.findall(word):
            # Printable ASCII stands for itself.
            spelt = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.tokenizer.model.tokenize(spelt)]
        out = self.known[word] = array("I", ids).tobytes()
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        # Distinct words -> distinct stems and tails (the marks at their end).
        stems = pc.replace_substring_regex(words, f"([\\pL\\pN])[{_TAIL}]+$", "\\1")
        known = self.known
        tails = pc.if_else(pc.equal(stems, words), "", pc.replace_substring_regex(words, f"^.*[^{_TAIL}]", ""))
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        spelt = pa.concat_arrays([stems.dictionary, tails.dictionary]).to_numpy(zero_copy_only=False)
        flat, sizes = _pieces([known.get(w) or self._ids(w) for w in spelt.tolist()])
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        # Each word of the text is its stem's ids, then its tail's.
        parts = np.empty((len(words), 2), np.int32)
        parts[:, 0] = stems.indices.to_numpy(zero_copy_only=False)
        parts[:, 1] = tails.indices.to_numpy(zero_copy_only=False) + len(stems.dictionary)
        parts = parts[which].ravel()
        per_part = sizes[parts]
        ends = np.concatenate([[0], np.cumsum(per_part)])
        take = np.repeat((starts[parts] - ends[:-1]).astype(np.int32), per_part)
        take += np.arange(len(take), dtype=np.int32)
        return flat[take], np.diff(ends[2 * (bounds - bounds[0])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, ids per text); a null text has none. A text with
        characters outside the plain range goes to the tokenizer whole."""
        if len(self.known) > self.limit // 2:
            self.known, self.older = {}, self.known
        texts = pc.fill_null(texts, "")
        exotic = (np.flatnonzero(pc.match_substring_regex(texts, _EXOTIC).to_numpy(zero_copy_only=False))
                  if self.by_word else np.arange(len(texts)))
        if not len(exotic):
            return self._plain(texts)
        plain = np.setdiff1d(np.arange(len(texts)), exotic)
        ids, counts = self._plain(texts.take(pa.array(plain)))
        rows = dict(zip(plain.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if len(plain) else {}
        for i in exotic.tolist():
            rows[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        out = [rows[i] for i in range(len(texts))]
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.fromiter(map(len, out), np.int64, len(out))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


_LOADED: dict[str, WordTokenizer] = {}


def unload() -> None:
    """Forget this worker's tokenizers and their words."""
    _LOADED.clear()


def word_tokenizer(name: str) -> WordTokenizer:
    """This worker's tokenizer (loaded once; the file is a parameter by name)."""
    if name not in _LOADED:
        _LOADED[name] = WordTokenizer(name)
    return _LOADED[name]
