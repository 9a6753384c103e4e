"""Words of text batches as numpy arrays: split and dictionary-encoded by Arrow, so Python sees distinct words only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_words(texts, at_spaces: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(codes, distinct, counts): every word's index into the distinct words, none of them empty, and the number of words of each text.

    Words are what ASCII white space separates; at_spaces splits at single blanks and line feeds only, which leaves
    empty words out as well but keeps other white space inside words.
    """
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    if at_spaces:
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
    else:
        lists = pc.ascii_split_whitespace(column)
    flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
    coded = flat.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in (empty := {w: i for i, w in enumerate(distinct) if not w}):  # beside white space at the ends of a text, and for an empty text
        keep = codes != empty[""]
        counts = np.add.reduceat(np.append(keep, False).astype(np.int64), np.append(0, np.cumsum(counts))[:-1]) * (counts > 0) if len(counts) else counts
        codes = codes[keep]
        codes -= codes > empty[""]
        del distinct[empty[""]]
    return codes, distinct, counts


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[starts[c] : starts[c] + lengths[c]] for c in codes, joined by position, and their lengths."""
    size = lengths[codes]
    ends = np.cumsum(size)
    at = np.repeat(starts[codes] - (ends - size), size)
    at += np.arange(len(at))
    return flat[at], size


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, counts[i] of them for text i."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
