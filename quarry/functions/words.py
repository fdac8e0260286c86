"""Word tokens of whole texts inside Arrow tasks, equal to ``text.word_tokens``.

A text of characters below U+0300 is cut into words in numpy, without an object a
word; any other text (and any other pattern) brings the list that the JVM's pattern
finds. Below U+0300 letters and numbers are the same in all versions of Unicode.
"""

from __future__ import annotations

import unicodedata

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import WORD_1PLUS, WORD_2PLUS

#: Text bytes cut into words at once by a task.
SLICE_BYTES = 8 << 20
_PLAIN = 0x300
_EXOTIC = "[^\\x{0}-\\x{2ff}]"
# The fewest characters of a word, by pattern.
_LEAST = {WORD_1PLUS: 1, WORD_2PLUS: 2}
_WORD = np.array([unicodedata.category(chr(c))[0] in "LN" or c == ord("_") for c in range(_PLAIN)])


def words_source(text: Column, pattern: str) -> Column:
    """What ``word_lists`` takes, of a text (not null) whose case is as wanted: a struct of
    the text, and of the list of words where numpy does not cut them (else null)."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    if pattern not in _LEAST:
        return F.struct(F.lit("").alias("text"), found.alias("listed"))
    plain = ~text.rlike(_EXOTIC)
    return F.struct(F.when(plain, text).otherwise("").alias("text"), F.when(~plain, found).alias("listed"))


def word_lists(source: pa.StructArray, pattern: str) -> pa.ListArray:
    """The words of each text, in order."""
    text, listed = source.field(0), source.field(1)
    lists = _cut(text, _LEAST.get(pattern, 1))
    if listed.null_count < len(listed):
        rows = np.arange(len(lists))
        own = pc.is_valid(listed).to_numpy(zero_copy_only=False)
        lists = pa.concat_arrays([lists, listed.cast(lists.type)]).take(pa.array(np.where(own, rows + len(lists), rows)))
    return lists


def source_slices(source: pa.StructArray, rows: int | None = None) -> Iterator[tuple[int, pa.StructArray]]:
    """(first row, slice) of at most ``SLICE_BYTES`` of text (one row at least) and ``rows`` rows."""
    text = source.field(0)
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(source):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        to = to if rows is None else min(to, at + rows)
        yield at, source.slice(at, to - at)
        at = to


def _cut(texts: pa.StringArray, least: int) -> pa.ListArray:
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    inside = np.zeros(len(flat) + 1, bool)
    inside[:-1] = np.concatenate([_WORD[:128], np.zeros(128, bool)])[flat]
    # Characters from U+0080 to U+02FF are two bytes each.
    two = np.flatnonzero(flat >= 0xC0)
    inside[two] = inside[two + 1] = _WORD[(flat[two] & 0x1F).astype(np.int64) << 6 | (flat[two + 1] & 0x3F)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first_of_text = bounds[:-1]
    begins[first_of_text] = inside[first_of_text]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    sizes = np.flatnonzero(ends) + 1 - starts
    kept = inside[:-1]
    if least > 1:
        # A word of one character: one byte, or a first byte of two.
        good = sizes > np.where(flat[starts] >= 0xC0, 2, 1) if len(starts) else np.zeros(0, bool)
        kept = kept.copy()
        short = starts[~good]
        kept[short] = False
        kept[short[sizes[~good] == 2] + 1] = False
        starts, sizes = starts[good], sizes[good]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(flat[kept]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds).astype(np.int32)), words)
