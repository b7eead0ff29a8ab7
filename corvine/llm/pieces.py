"""Text as pieces between spaces and line ends, each mapped once and remembered.

The public patterns for byte-level BPE end a match before every white-space character that follows another kind of
character, and a space goes with the match behind it. So a text may be cut

* before a space, provided that neither neighbour of the space is white space, and
* before and behind a line end, provided that it stands alone among other characters, or with one line end or space behind
  it, and that two line ends are not the end of the text, and
* between a letter and ASCII punctuation but the apostrophe, where white space or the end follows that (``TAIL``),

and the pieces may be encoded one by one. Texts that have white space in another place are encoded whole; those with tabs
or carriage returns beside line ends are cut at spaces alone. A tokenizer that looks for some strings before it applies the
pattern (added tokens) names them, and texts that hold one are encoded whole too.

Cutting and telling pieces apart are Arrow's work over many texts at once, so only different pieces become Python objects.
The memory has two generations: what was met since the last turn, and what was met between the last two. When the young
one is full it becomes the old one, so pieces in use stay and the others go.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are looked up together.
TOGETHER = 1 << 22
#: Marks a piece without a space in front; texts that hold the character are encoded whole.
BARE = "\0"
UNKNOWN = object()
#: A Latin letter and the punctuation between it and a space or the end.
TAIL = r"""([A-Za-zÀ-ÖØ-öø-ɏ])([!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)( |$)"""


def odd(key: str) -> bool:
    """Whether a piece has white space where no text may be cut."""
    if key[:1] == BARE:
        return len(key) > 1 and key != f"{BARE}\n" and (key[1].isspace() or key[-1].isspace())
    return key == "" or key[0].isspace() or key[-1].isspace()


def cut(texts: pa.Array, uncut: tuple[str, ...] = ()) -> pa.ListArray:
    """The pieces of each text, without the space in front of them, or with ``BARE`` in front where there is none.

    Texts that hold one of the strings ``uncut`` are one odd piece.
    """
    has = lambda x: pc.match_substring(texts, x)
    at_lines = has("\n")
    for x in ("\r", "\n\t", "\n\n\n", "\n\n "):
        at_lines = pc.and_not(at_lines, has(x))
    at_lines = pc.and_not(at_lines, pc.ends_with(texts, "\n\n"))
    marked = pc.if_else(at_lines, pc.replace_substring(texts, "\n", f" {BARE}\n {BARE}"), texts)
    marked = pc.replace_substring_regex(marked, TAIL, rf"\1 {BARE}\2\3")
    marked = pc.binary_join_element_wise(BARE, marked, "")
    whole = has(BARE)
    for x in uncut:
        whole = pc.or_(whole, has(x))
    return pc.split_pattern(pc.if_else(whole, " ", marked), " ")


class Pieces:
    """A bounded memory from piece to its ids as bytes of 32-bit integers.

    ``encode`` maps pieces (with their leading space) to ids, and ``whole`` texts that can't be cut, as those with a string of ``uncut``.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], limit: int, uncut: tuple[str, ...] = ()):
        self.encode, self.whole, self.limit, self.uncut = encode, whole, limit, uncut
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def of(self, texts: pa.Array, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and how many each has; a null text is an empty one."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        found: list[bytes] = []
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + together, side="right")))
            found += self._ids(texts.slice(at, to - at))
            at = to
        return np.frombuffer(b"".join(found), "<i4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _ids(self, texts: pa.Array) -> list[bytes]:
        lists = cut(texts, self.uncut)
        coded = lists.flatten().dictionary_encode()
        values = self._values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # a fraction of to_pylist's time
        joined = pa.array(values, pa.binary()).take(coded.indices)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, 4 * joined.offset)[bounds].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        out: list[bytes] = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if None in values:  # texts with a piece that has no ids
            lost = np.append(0, np.cumsum(np.array([v is None for v in values])[coded.indices.to_numpy()]))[bounds]
            rest = np.flatnonzero(np.diff(lost)).tolist()
            for i, ids in zip(rest, self.whole(texts.take(rest).to_pylist()), strict=True):
                out[i] = ids
        return out

    def _values(self, keys: list[str]) -> list[bytes | None]:
        """What each of different pieces maps to; None if it is an odd one."""
        if 2 * len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        values = list(map(young.get, keys, repeat(UNKNOWN)))
        new = [k for k, v in zip(keys, values, strict=True) if v is UNKNOWN]
        if not new:
            return values
        found = list(map(old.get, new, repeat(UNKNOWN)))
        young.update(zip(new, found, strict=True))
        new = [k for k, v in zip(new, found, strict=True) if v is UNKNOWN]
        whole = [k for k in new if odd(k)]
        young.update(dict.fromkeys(whole))
        spaced, bare = [k for k in new if k[:1] not in ("", BARE) and young[k] is UNKNOWN], [k for k in new if k[:1] == BARE and young[k] is UNKNOWN]
        young.update(zip(spaced + bare, self.encode([" " + k for k in spaced] + [k[1:] for k in bare]), strict=True))
        return [young[k] if v is UNKNOWN else v for k, v in zip(keys, values, strict=True)]
