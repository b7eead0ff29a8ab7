"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is what the merges make of its bytes if and only if each two neighbours are what the merges make of
theirs. So the merges compile into a nondeterministic machine whose threads are (last token, place in the trie of tokens):
on each byte a thread moves down the trie, and where it meets a token that may follow its last one, a thread begins behind
that token. Exactly one token may end a prefix. ``Transducer`` determinises this machine while it reads: a state is the
sequence of live threads, made and numbered when a match first leads there, and the token that ends there. When one thread
is left, all before it is settled and may be put out, so the lookahead is no longer than the longest token.

Many matches are read in step, one byte of each a round: moves that are known are looked up, and those that are not are
determinised together. Trie, merges, moves and states are flat tables of integers. Those of moves and states are bounded:
they are dropped and rebuilt when they grow over a limit, which changes nothing in the results.

Matches of the pattern are encoded one by one. ``corvine.llm.pieces`` remembers what came of a piece between two spaces.
Decoding turns ids to bytes and runs an incremental UTF-8 decoder over the stream, which keeps what a token boundary has
cut off until the rest arrives.

Defined results: a null text is an empty one, with no ids; repeated rows are encoded one by one; an empty table gives an
empty result; further columns are ignored by the query. A match without end (a text of letters only) is one match.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corvine.llm.common import packed, read, unpacked
from corvine.llm.pieces import Pieces

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: States and pieces that a Python worker remembers.
STATES, PIECES = 200_000, 200_000
ROOT, NEVER = 0, 1 << 40
#: With fewer matches than this left, each is read to its end by itself.
IN_STEP = 16
#: Ids that are spelled out at once, and characters of texts that are encoded whole together.
SPELLED, WHOLE = 1 << 18, 1 << 20
EMPTY = hashlib.sha256().hexdigest()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Table:
    """An open-addressing map from numbers to numbers, none of them negative, that is read and filled in batches."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)

    @classmethod
    def of(cls, keys: list[int], values: list[int]) -> Table:
        out = cls()
        out.put(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))
        return out

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it has none."""
        at, last = self._first(keys), len(self.keys) - 1
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & last
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], at[on]
        return out

    def one(self, key: int) -> int:
        at, last = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits), len(self.keys) - 1
        while (found := self.keys.item(at)) != key:
            if found < 0:
                return -1
            at = (at + 1) & last
        return self.values.item(at)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that differ and aren't there."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            own = self.keys >= 0
            keys, values = np.concatenate([self.keys[own], keys]), np.concatenate([self.values[own], values])
            self.__init__(max(12, (2 * len(keys)).bit_length()))
        self.used += len(keys)
        at, last = self._first(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & last


class Rows:
    """Numbers that are added at the end, in one array."""

    def __init__(self, first: int):
        self.held, self.n = np.full(1024, first, dtype=np.int64), 1

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(len(more), len(self.held)), dtype=np.int64)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


def places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, ``sizes`` many, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


class Transducer:
    """The merges of ``ranks`` as a transducer from the bytes of matches to ids."""

    def __init__(self, ranks: dict[bytes, int], limit: int = STATES):
        self.ranks, self.limit = ranks, limit
        most = max(ranks.values()) + 1
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = np.zeros(most, dtype=np.int64)
        #: the two tokens whose merge makes each; -1 for a byte, and -2 if the merges never make it
        self.first, self.second = np.full(most, -1, dtype=np.int64), np.full(most, -1, dtype=np.int64)
        down: dict[int, int] = {}
        token_at, pairs, made = [-1], [], []
        for token, i in ranks.items():
            self.size_of[i] = len(token)
            node = ROOT
            for b in token:
                node = down.setdefault(node << 8 | b, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = i
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    pairs.append(left << 32 | right)
                    made.append(i)
            if len(token) > 1:
                self.first[i], self.second[i] = self._halves(token)
        self.down, self.token_at = Table.of(list(down), list(down.values())), np.array(token_at)
        self.inner = np.zeros(len(token_at), dtype=bool)
        self.inner[np.fromiter(down, np.int64, len(down)) >> 8] = True
        self.merged = Table.of(pairs, made)
        self._forget()

    def _halves(self, token: bytes) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                return -2, -2
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _forget(self) -> None:
        #: state * 256 + byte -> state; digest of threads -> state
        self.moves, self.known = Table(), Table()
        #: the threads of a state, and the token that ends where it is, which its last thread has too
        self.begin, self.size, self.last = Rows(0), Rows(1), Rows(-1)
        self.token, self.node = Rows(-1), Rows(ROOT)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges leave each two tokens as they are; left -1: the beginning.

        Undoes the merges at the seam from the last: a merge across it must not come before the one that was undone.
        Of equal merges the one to the left comes first.
        """
        out = self.first[right] != -2
        at = np.flatnonzero(out & (left >= 0))
        left, right, before = left[at], right[at], np.full(len(at), NEVER)
        while len(at):
            rank = self.merged.get(left << 32 | right)
            bad = (rank >= 0) & (rank < before)
            out[at[bad]] = False
            from_left = (self.first[left] >= 0) & ((left > right) | (self.first[right] < 0))
            from_right = ~from_left & (self.first[right] >= 0)
            on = ~bad & (from_left | from_right)
            at, left, right, from_left = at[on], left[on], right[on], from_left[on]
            before = np.where(from_left, left, right + 1)
            left, right = np.where(from_left, self.second[left], left), np.where(from_left, right, self.first[right])
        return out

    def _determinise(self, keys: np.ndarray) -> None:
        """Makes the moves of ``keys`` (state * 256 + byte, all different), and the states that they lead to."""
        state, byte = keys >> 8, keys & 255
        sizes = self.size.held[state]
        at, of = places(self.begin.held[state], sizes), np.repeat(np.arange(len(keys)), sizes)
        token, node = self.token.held[at], self.down.get(self.node.held[at] << 8 | byte[of])
        live = node >= 0
        token, node, of = token[live], node[live], of[live]
        ending = self.token_at[node]
        ends = np.flatnonzero(ending >= 0)
        ends = ends[self.may_follow(token[ends], ending[ends])]
        last = np.full(len(keys), -1)
        last[of[ends]] = ending[ends]
        # threads that can go on, in order, and the one that begins here
        on = self.inner[node]
        token, node, of = token[on], node[on], of[on]
        sizes = np.bincount(of, minlength=len(keys)) + 1
        behind = np.cumsum(sizes) - 1
        held, walked = np.zeros((2, int(sizes.sum())), dtype=np.int64), np.ones(int(sizes.sum()), dtype=bool)
        walked[behind] = False
        held[0, walked], held[1, walked], held[0, behind], held[1, behind] = token, node, last, ROOT
        begins = behind - sizes + 1
        number = np.arange(held.shape[1]) - np.repeat(begins, sizes)
        mixed = (held[0] * 0x2545F4914F6CDD1D ^ (held[1] + 1) * 0x1B873593CC9E2D51) * (2 * number + 0x5851F42D4C957F2D)
        digest = np.add.reduceat(mixed ^ mixed >> 29, begins) & 0x7FFFFFFFFFFFFFFF
        own, first, which = np.unique(digest, return_index=True, return_inverse=True)
        to = self.known.get(own)
        new = np.flatnonzero(to < 0)
        to[new] = self._add(held, begins[first[new]], sizes[first[new]], last[first[new]])
        self.known.put(own[new], to[new])
        to = to[which]
        # a digest that other threads have too: states of their own
        same = self.size.held[to] == sizes
        at, of = places(begins[same], sizes[same]), np.repeat(np.flatnonzero(same), sizes[same])
        there = places(self.begin.held[to[same]], sizes[same])
        differ = (held[0, at] != self.token.held[there]) | (held[1, at] != self.node.held[there])
        same[of[differ]] = False
        odd = np.flatnonzero(~same)
        to[odd] = self._add(held, begins[odd], sizes[odd], last[odd])
        self.moves.put(keys, to)

    def _add(self, held: np.ndarray, begins: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> np.ndarray:
        number = np.arange(self.last.n, self.last.n + len(begins))
        at = places(begins, sizes)
        self.begin.add(self.token.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.last.add(last)
        self.token.add(held[0, at])
        self.node.add(held[1, at])
        return number

    def encode_all(self, data: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of matches one behind the other, their sizes, the id of each that is a token, else -1) -> their ids, and how many each has."""
        if self.last.n > self.limit:
            self._forget()
        begins = np.cumsum(sizes) - sizes
        ending = np.full(len(data), -1, dtype=np.int64)  # the token that ends at each place
        ending[(begins + sizes - 1)[whole >= 0]] = whole[whole >= 0]
        rest = np.flatnonzero(whole < 0)
        rest = rest[np.argsort(-sizes[rest], kind="stable")]
        at, left = begins[rest], sizes[rest]
        state = np.zeros(len(rest), dtype=np.int64)
        step = 0
        while len(rest) and (n := int(np.searchsorted(-left, -step, side="left"))) >= min(IN_STEP, len(rest)):
            state = state[:n]
            here = at[:n] + step
            key = state << 8 | data[here]
            state = self.moves.get(key)
            if len(new := np.flatnonzero(state < 0)):
                self._determinise(np.unique(key[new]))
                state[new] = self.moves.get(key[new])
            ending[here] = self.last.held[state]
            step += 1
        for i in range(int(np.searchsorted(-left, -step, side="left")) if len(rest) else 0):
            self._read_on(data, int(at[i]) + step, int(at[i] + left[i]), int(state[i]), ending)
        # from the end of each match back: its tokens
        keep = np.zeros(len(data), dtype=bool)
        keep[(begins + sizes - 1)[whole >= 0]] = True
        at, end = begins[rest], begins[rest] + sizes[rest]
        while len(end):
            keep[end - 1] = True
            end = end - self.size_of[ending[end - 1]]
            on = end > at
            at, end = at[on], end[on]
        return ending[keep], np.add.reduceat(keep, begins) if len(begins) else np.zeros(0, np.int64)

    def _read_on(self, data: np.ndarray, at: int, to: int, state: int, ending: np.ndarray) -> None:
        for here in range(at, to):
            key = state << 8 | data.item(here)
            if (state := self.moves.one(key)) < 0:
                self._determinise(np.array([key]))
                state = self.moves.one(key)
            ending[here] = self.last.held[state]

    def encode(self, match: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        return self.encode_all(np.frombuffer(match, np.uint8), np.array([len(match)]), np.array([self.ranks.get(match, -1)]))[0].tolist()


class StreamDecoder:
    """Ids to bytes and text, in any portions: bytes of a character that is not complete wait for the rest."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.machine, self.digest = bytes_of, codecs.getincrementaldecoder("utf-8")("replace"), hashlib.sha256()

    def feed(self, data: bytes) -> str:
        self.digest.update(data)
        return self.machine.decode(data)

    def feed_ids(self, ids: list[int]) -> str:
        return self.feed(b"".join(map(self.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        return self.machine.decode(b"", True)


class Spelling:
    """What each id is spelled as, laid out in one array, so that many ids are spelled out at once."""

    def __init__(self, spelled: dict[int, bytes]):
        most = max(spelled) + 1
        self.sizes = np.zeros(most, dtype=np.int64)
        self.sizes[list(spelled)] = list(map(len, spelled.values()))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(spelled[i] for i in sorted(spelled)), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The spellings one behind the other, and where each ends."""
        sizes = self.sizes[ids]
        return self.data[places(self.begins[ids], sizes)].tobytes(), np.cumsum(sizes)


class Codec:
    """One vocabulary's encoder and decoder with their memories, for one Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.transducer = Transducer(load_ranks(path))
        self.token_of = {t.decode(): i for t, i in self.transducer.ranks.items() if t.decode(errors="ignore").encode() == t}
        self.pieces = Pieces(self.encode_all, self.encode_whole, PIECES)
        bytes_of = self.transducer.bytes_of
        self.bytes_of, self.decimals = Spelling(bytes_of), Spelling({i: b"%d," % i for i in bytes_of})

    def encode_all(self, texts: list[str], apart: bool = False) -> list[bytes]:
        """The ids of each text, as 32-bit integers. Unless ``apart``, they are pieces: those with a space in front may stand behind each other."""
        order = list(range(len(texts))) if apart else [i for i, t in enumerate(texts) if t[:1] != " "]
        alone = len(order)
        order += [] if apart else [i for i, t in enumerate(texts) if t[:1] == " "]
        found = [self.find(texts[i]) for i in order[:alone]]
        behind = self.find("".join([texts[i] for i in order[alone:]]))
        matches = [m for ms in found for m in ms] + behind
        if not matches:
            return [b""] * len(texts)
        data = np.frombuffer("".join(matches).encode(), np.uint8)
        chars = np.fromiter(map(len, matches), np.int64, len(matches))
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        whole = np.fromiter(map(self.token_of.get, matches, repeat(-1)), np.int64, len(matches))
        ids, counts = self.transducer.encode_all(data, np.diff(starts[np.cumsum(chars)], prepend=0), whole)
        # how many matches each text has: of those that stand behind each other as many as have its characters
        ends = np.cumsum(np.fromiter((len(texts[i]) for i in order[alone:]), np.int64, len(order) - alone))
        n_alone = np.cumsum(np.fromiter(map(len, found), np.int64, alone))
        first = len(matches) - len(behind)
        upto = np.concatenate([[0], n_alone, first + np.searchsorted(np.cumsum(chars[first:]), ends, side="right")])
        cuts = (4 * np.append(0, np.cumsum(counts))[upto]).tolist()
        packed_ids, out = ids.astype("<i4").tobytes(), [b""] * len(texts)
        for i, a, b in zip(order, cuts[:-1], cuts[1:], strict=True):
            out[i] = packed_ids[a:b]
        return out

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that can't be cut, some at a time."""
        out: list[bytes] = []
        some: list[str] = []
        for text in [*texts, None]:
            if text is None or sum(map(len, some)) > WHOLE:
                out += self.encode_all(some, apart=True)
                some = []
            some.append(text)
        return out


def portions(spelling: Spelling, ids: np.ndarray, counts: np.ndarray, size: int = SPELLED):
    """(text, bytes) of the spellings of all texts' ids, in order and in portions."""
    ends = np.cumsum(counts)
    for low in range(0, len(ids), size):
        data, spelled = spelling.of(ids[low : low + size])
        cuts = np.append(0, spelled)
        first, last = (int(x) for x in np.searchsorted(ends, (low, min(low + size, len(ids)) - 1), side="right"))
        inner = cuts[np.clip(ends[first:last] - low, 0, len(cuts) - 1)].tolist()
        for i, a, b in zip(range(first, last + 1), [0, *inner], [*inner, len(data)], strict=True):
            if a < b:
                yield i, data[a:b]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    made = Codec(path, pattern)
    gc.freeze()  # tables for the worker's life, which the collector need not walk through
    return made


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256, round_trip, and with ``keep_ids`` the ids, to documents; the text goes."""
    docs, names = packed(docs, text)
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    made = T.StructType.fromDDL(made)
    schema = T.StructType([docs.schema["rest"], *made.fields])

    def run(batches):
        import pyarrow as pa

        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            ids, counts = own.pieces.of(batch.column(0))
            digests = [hashlib.sha256() for _ in texts]
            held: dict[int, bytes] = {}
            for i, data in portions(own.decimals, ids, counts):  # without the last comma of a text
                if i in held:
                    digests[i].update(held[i])
                digests[i].update(data[:-1])
                held = {i: data[-1:]}
            same, decoded = [t == "" for t in texts], [EMPTY] * len(texts)
            stream, at, parts = StreamDecoder(own.transducer.bytes_of), -1, []

            def over():
                if at >= 0:
                    parts.append(stream.close())
                    same[at], decoded[at] = "".join(parts) == texts[at], stream.digest.hexdigest()

            for i, data in portions(own.bytes_of, ids, counts):
                if i != at:
                    over()
                    stream, at, parts = StreamDecoder(own.transducer.bytes_of), i, []
                parts.append(stream.feed(data))
            over()
            columns = [*batch.columns[1:], pa.array(counts), pa.array([d.hexdigest() for d in digests], pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema).select(*unpacked(names, *made.names))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
