"""Byte-level BPE by prefix dynamic programming.

For a piece of bytes (one match of the pre-tokenizer's pattern) the greedy merge order gives one encoding,
and the encoding of every prefix of the piece extends the encoding of a shorter prefix by one token.  So it
is enough to store, for each prefix, its last token.  A token t that ends at byte i is that token when the
merges of (last token of the prefix before t, t) leave the border between the two alone.  Three uses follow:

* encoding: fill the table from left to right and walk it back from the end (:class:`PrefixTable` for one
  piece; :meth:`ByteBpe.fill` for many at once, one prefix length after the other);
* appending: bytes added to a piece only add entries to its table;
* editing: entries before the edit stay.

The pattern is applied first; its matches depend only on the text from where they begin, so after an edit
pieces are matched again from a little before it until the borders fall into step with the old ones.

Texts are encoded in Arrow batches: numpy finds the borders of all pieces of a batch, and since pieces
repeat, a dictionary of bounded size maps most of them straight to their packed ids.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvloom.llm.textops import Blocks, chunks, equal_runs, run_hashes

#: Pieces held in each of the two generations of a worker's dictionary.
CACHE_PIECES = 100_000
#: Longer pieces are not held, and have a table of their own.
CACHE_BYTES = 64
#: Places for pairs of neighbours whose border is known: 8 MB a worker.
PAIR_BITS = 20
#: Fixed value: the pattern whose matches numpy finds; any other is left to the regex engine.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text encoded together.
CHUNK_BYTES = 1 << 18
#: Places where no match of ``SPLIT`` goes on, whatever stands farther off.
_BORDER = regex.compile(r"(?<=\S)(?=\s\S)|(?<=\p{L})(?=[^\s\p{L}\p{N}])")


class PrefixTable:
    """Last tokens of all prefixes of one growing piece."""

    def __init__(self, bpe: "ByteBpe") -> None:
        self.bpe, self.data, self.last = bpe, b"", []

    def append(self, more: bytes) -> None:
        bpe, last = self.bpe, self.last
        begin = len(self.data)
        data = self.data = self.data + more
        token_of, sizes_of, pairs, compatible = bpe.whole_ranks.get, bpe.sizes.get, bpe.pairs.get, bpe.compatible
        for end in range(begin + 1, len(data) + 1):
            # only tokens of these sizes end with the last three bytes
            for size in sizes_of(data[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                if size >= end:
                    if size > end:
                        continue
                    if (token := token_of(data[:end])) is not None:
                        break
                elif (token := token_of(data[end - size : end])) is not None:
                    before = last[end - size - 1]
                    fits = pairs(before << 32 | token)
                    if compatible(before, token) if fits is None else fits:
                        break
            else:
                raise ValueError("the ranks do not cover every byte")
            last.append(token)

    def move_to(self, data: bytes) -> None:
        """Hold another piece, keeping the entries of the prefix that both share."""
        same, most = 0, min(len(data), len(self.data))
        while same < most and data[same] == self.data[same]:
            same += 1
        self.data = data[:same]
        del self.last[same:]
        self.append(data[same:])

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        lengths = self.bpe.token_lengths
        while at:
            out.append(self.last[at - 1])
            at -= lengths[out[-1]]
        return out[::-1]


class Trie:
    """Finds all tokens that begin at each byte of some data."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        nodes: dict[int, int] = {}
        found: dict[int, int] = {}
        for data, token in ranks.items():
            at = 0
            for byte in data:
                at = nodes.setdefault(at << 8 | byte, len(nodes) + 1)
            found[at] = token
        self.edges = np.sort(np.fromiter(nodes, dtype=np.int64, count=len(nodes)))
        self.to = np.fromiter(map(nodes.get, self.edges.tolist()), dtype=np.int64, count=len(nodes))
        self.token = np.full(len(nodes) + 1, -1, dtype=np.int64)
        self.token[[*found]] = [*found.values()]
        # the nodes of one and of two bytes need no search; no edge leads to the root
        self.one = np.array([nodes.get(a, 0) for a in range(256)], dtype=np.int64)
        self.two = np.zeros(1 << 16, dtype=np.int64)
        for a, node in enumerate(self.one.tolist()):
            if node:
                self.two[a << 8 : (a + 1) << 8] = [nodes.get(node << 8 | b, 0) for b in range(256)]

    def matches(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens data[start:end], the short ones first; none goes past the ``stop`` of its start."""
        at, node, n = np.arange(len(data)), self.one[data], 1
        out = []
        while len(at):
            token = self.token[node]
            some = np.flatnonzero(token >= 0)
            out.append((at[some], at[some] + n, token[some]))
            more = np.flatnonzero((at + n < stop[at]) & (node > 0))
            at, node = at[more], node[more]
            if n == 1:
                node = self.two[data[at].astype(np.int64) << 8 | data[at + 1]]
            else:
                edge = node << 8 | data[at + n]
                where = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                node = np.where(self.edges[where] == edge, self.to[where], 0)
            at, node = at[node > 0], node[node > 0]
            n += 1
        if not out:
            out.append((np.zeros(0, np.int64),) * 3)
        return tuple(np.concatenate(x) for x in zip(*out))


class ByteBpe:
    """Ranks (token bytes to id) and the pattern that splits text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.token_lengths = {i: len(b) for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.parts: dict[int, tuple[int, int]] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.classes: np.ndarray | None = None
        # only tokens that their own merges end in can stand in an encoding
        self.whole_ranks = {b: i for b, i in ranks.items() if self.merged(b) == [i]}
        # for the last three bytes of longer ones, the sizes that they have, from the largest
        found: dict[bytes, set[int]] = {}
        for b in self.whole_ranks:
            if len(b) > 2:
                found.setdefault(b[-3:], {2, 1}).add(len(b))
        self.sizes = {b: tuple(sorted(n, reverse=True)) for b, n in found.items()}
        self.table_of = PrefixTable(self)
        self.trie = Trie(self.whole_ranks)
        self.borders = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        size = max(self.tokens) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        for i, b in self.tokens.items():
            self.lengths[i] = len(b)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), dtype=np.uint8)

    @classmethod
    def from_file(cls, content: bytes, pattern: str) -> "ByteBpe":
        """From the text of a rank file: a base64 token and its rank on each line."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """Encode a few bytes by definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        cut = [data[i : i + 1] for i in range(len(data))]
        while len(cut) > 1:
            found = [(r, i) for i in range(len(cut) - 1) if (r := self.ranks.get(cut[i] + cut[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            cut[i : i + 2] = [cut[i] + cut[i + 1]]
        return [self.ranks[c] for c in cut]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a whole token (itself twice for a single byte)."""
        if (held := self.parts.get(token)) is None:
            data = self.tokens[token]
            if len(data) == 1:
                held = (token, token)
            else:
                cut = [data[i : i + 1] for i in range(len(data))]
                while len(cut) > 2:
                    i = min((self.ranks.get(cut[i] + cut[i + 1], 1 << 40), i) for i in range(len(cut) - 1))[1]
                    cut[i : i + 2] = [cut[i] + cut[i + 1]]
                held = (self.ranks[cut[0]], self.ranks[cut[1]])
            self.parts[token] = held
        return held

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at one end of a token while it is merged, each with the rank that ends it."""
        held = self.edges[right]
        if (out := held.get(token)) is None:
            out, at, until = [], token, float("inf")
            while True:
                out.append((at, until))
                if len(self.tokens[at]) == 1:
                    break
                at, until = self.split(at)[right], at
            held[token] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges of ``left`` and ``right`` side by side leave the border between them alone?

        They do not if some token at the end of ``left`` and some at the start of ``right`` merge at a rank
        before either goes into a larger one (at equal rank the leftmost merge comes first).
        """
        key = left << 32 | right
        if (held := self.pairs.get(key)) is None:
            if len(self.pairs) >= 2 * CACHE_PIECES:
                self.pairs.clear()
            tokens, ranks, held = self.tokens, self.ranks, True
            for a, a_until in self.edge(left, True):
                for b, b_until in self.edge(right, False):
                    rank = ranks.get(tokens[a] + tokens[b])
                    if rank is not None and rank < a_until and rank <= b_until:
                        held = False
            self.pairs[key] = held
        return held

    def encode_piece(self, data: bytes) -> list[int]:
        if (token := self.whole_ranks.get(data)) is not None:
            return [token]
        self.table_of.move_to(data)
        return self.table_of.ids()

    def packed(self, data: bytes) -> bytes:
        """A piece's ids as little-endian unsigned 32-bit integers."""
        out = self.older.get(data)
        if out is None:
            ids = self.encode_piece(data)
            out = struct.pack(f"<{len(ids)}I", *ids)
        self.hold(data, out)
        return out

    def hold(self, data: bytes, out: bytes) -> None:
        if len(data) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_PIECES:
                self.cache, self.older = {}, self.cache
            self.cache[data] = out

    def packed_all(self, pieces: list[bytes]) -> list[bytes]:
        """:meth:`packed` of many pieces."""
        ids = [*map(self.cache.get, pieces)]
        fresh, long = [], []
        for i in [i for i, held in enumerate(ids) if held is None]:
            if len(pieces[i]) > CACHE_BYTES:
                long.append((pieces[i], i))
            elif (held := self.older.get(pieces[i])) is None:
                fresh.append(i)
            else:
                ids[i] = held
                self.hold(pieces[i], held)
        for i, out in zip(fresh, self.fill([pieces[i] for i in fresh])):
            ids[i] = out
            self.hold(pieces[i], out)
        # in order of bytes neighbours share prefixes, whose entries are not made again
        for p, i in sorted(long):
            ids[i] = self.packed(p)
        return ids

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`compatible` of many pairs."""
        pair = left << 32 | right
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.borders[slot]
        lost = np.flatnonzero(held >> 1 != pair)
        if len(lost):
            once, which = np.unique(pair[lost], return_inverse=True)
            fits = np.fromiter((self.compatible(x >> 32, x & 0xFFFFFFFF) for x in once.tolist()), dtype=np.int64, count=len(once))
            held[lost] = self.borders[slot[lost]] = pair[lost] << 1 | fits[which]
        return (held & 1).astype(bool)

    def fill(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of short pieces: the prefix tables of all of them, filled one prefix length after the other."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        stop = np.cumsum(size)
        begin = stop - size
        first = np.repeat(begin, size)
        start, end, token = self.trie.matches(data, np.repeat(stop, size))
        prefix = end - first[start]
        order = np.argsort(prefix.astype(np.uint8), kind="stable")
        start, end, token = start[order], end[order], token[order]
        steps = np.concatenate([[0], np.cumsum(np.bincount(prefix))]).tolist()
        last = np.full(len(data), -1, dtype=np.int64)
        for i, j in zip(steps, steps[1:]):
            some, new = start[i:j], token[i:j]
            fits = some == first[some]
            inner = np.flatnonzero(~fits)
            before = last[some[inner] - 1]
            if len(before) and before.min() < 0:
                break
            fits[inner] = self.fit(before, new[inner])
            last[end[i:j][fits] - 1] = new[fits]
        if last.min() < 0:
            raise ValueError("the ranks do not cover every byte")
        # the tokens that the walk back from each end meets
        met = np.zeros(len(data), dtype=bool)
        at, low = stop - 1, begin
        while len(at):
            met[at] = True
            at = at - self.lengths[last[at]]
            more = at >= low
            at, low = at[more], low[more]
        ids = last[met].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(met, begin, dtype=np.int64))]) * 4
        cuts = cuts.tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode_packed(self, text: str) -> bytes:
        return b"".join([self.cache.get(p) or self.packed(p) for p in (m.encode() for m in self.pattern.findall(text))])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of many texts; the pattern must be ``SPLIT`` for the borders to be found by numpy."""
        if self.pattern.pattern != SPLIT:
            return [self.encode_packed(t) for t in texts]
        if self.classes is None:
            self.classes = char_classes()
        joined = "".join(texts)
        data = joined.encode()
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        starts = piece_starts(points, begins[:-1], self.classes)
        at = np.flatnonzero(starts)
        if len(data) != len(points):
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            where = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            cuts = np.append(where[at], len(data)).tolist()
        else:
            cuts = np.append(at, len(data)).tolist()
        # equal pieces are looked up once
        first, which = distinct_pieces(np.frombuffer(data, dtype=np.uint8), np.asarray(cuts))
        pieces = [data[cuts[i] : cuts[i + 1]] for i in first]
        ids = self.packed_all(pieces)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        begin = np.cumsum(sizes) - sizes
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        every = flat[np.arange(total) + np.repeat(begin[which] - (ends - lengths), lengths)]
        edges = np.concatenate([[0], ends])[np.searchsorted(at, begins)].tolist()
        return [every[i:j].tobytes() for i, j in zip(edges, edges[1:])]

    def encode_long(self, text: str) -> bytes:
        """Packed ids of a text of any length, of which only a part is worked on at a time."""
        if self.pattern.pattern != SPLIT:
            return b"".join(self.packed(m.group().encode()) for m in self.pattern.finditer(text))
        out, at = [], 0
        while at < len(text):
            found = _BORDER.search(text, at + CHUNK_BYTES)
            end = found.start() if found else len(text)
            out += self.encode_batch([text[at:end]])
            at = end
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the ranks")
        out = []
        for at in range(0, len(ids), CHUNK_BYTES):
            some = ids[at : at + CHUNK_BYTES]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            out.append(self.table[np.arange(ends[-1]) + np.repeat(self.offsets[some] - (ends - lengths), lengths)].tobytes())
        return b"".join(out)


def distinct_pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Pieces data[cuts[i]:cuts[i + 1]]: an index of each distinct one, and each piece's place among them.

    Hashes only bring equal pieces together; whether neighbours are equal is told by their bytes.
    """
    n = len(cuts) - 1
    if n < 1:
        return [], np.zeros(0, np.int64)
    start, stop = cuts[:-1], cuts[1:]
    blocks = Blocks(data)
    hashes = run_hashes(data, start, stop, blocks)
    order = np.argsort(hashes)
    new = np.ones(n, dtype=bool)
    alike = 1 + np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    new[alike] = ~equal_runs(data, start, stop, order[alike], order[alike - 1], blocks)
    which = np.empty(n, dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new].tolist(), which


def char_classes() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, kind in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        found = "".join(regex.findall(kind, every))
        out[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = value
    return out


def piece_starts(points: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the matches of ``SPLIT`` begin in joined texts that begin at ``begins``.

    Runs of one class are matches, but for three rules: the last of several white spaces before something
    else is a match of its own; if that last one is a space it belongs to what follows; and an apostrophe
    that begins a match takes the ending after it along.
    """
    n = len(points)
    kind = classes[points]
    fresh = np.zeros(n + 4, dtype=bool)
    fresh[begins[begins < n]] = True
    starts = fresh[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # the last white space of each run that something follows in the same text
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~fresh[1:n])
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False
    ends = np.flatnonzero(starts & (points == 0x27))
    if len(ends):
        next1 = np.where(fresh[ends + 1], 0, np.append(points, [0] * 4)[ends + 1])
        next2 = np.where(fresh[ends + 2], 0, np.append(points, [0] * 4)[ends + 2])
        one = np.isin(next1, [ord(c) for c in "stmd"])
        two = np.zeros(len(ends), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            two |= (next1 == ord(a)) & (next2 == ord(b))
        starts[ends[one | two] + 1] = False
        after = np.concatenate([ends[one] + 2, ends[two] + 3])
        starts[after[after < n]] = True
    return starts


class EditableText:
    """A text with its encoding, which appends and edits change only nearby.

    ``touched`` tells how many pieces the last change encoded anew.
    """

    #: A match may look this many characters past its end before it stops.
    LOOK = 2

    def __init__(self, bpe: ByteBpe, text: str = "") -> None:
        self.bpe, self.text = bpe, text
        self.starts: list[int] = []
        self.pieces: list[PrefixTable] = []
        self.touched = 0
        self._match(0, len(text), [], [])

    def _match(self, at: int, settled: int, old_starts: list[int], old: list[PrefixTable]) -> None:
        """Match from ``at``; once a border past ``settled`` is an old one, take over the old rest."""
        where = {s: i for i, s in enumerate(old_starts)}
        self.touched = 0
        begun = len(self.starts)
        for m in self.bpe.pattern.finditer(self.text, at):
            if m.start() >= settled and (i := where.get(m.start())) is not None:
                self.starts += old_starts[i:]
                self.pieces += old[i:]
                return
            data = m.group().encode()
            table = PrefixTable(self.bpe)
            first = self.first if len(self.starts) == begun else None
            if first is not None and data.startswith(first.data):  # an append: the stored prefixes hold
                table.data, table.last = first.data, list(first.last)
                data = data[len(first.data) :]
            table.append(data)
            self.starts.append(m.start())
            self.pieces.append(table)
            self.touched += 1

    first: PrefixTable | None = None

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by ``new``."""
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # pieces that end, with what they looked at, before the change stay; runs of white space look to their end
        keep = max(0, bisect_right(self.starts, start) - 1)
        while keep and (keep >= len(self.starts) or self.starts[keep] + self.LOOK > start or self.text[self.starts[keep] - 1].isspace()):
            keep -= 1
        old_starts, old = self.starts, self.pieces
        at = old_starts[keep] if keep < len(old_starts) else 0
        self.starts, self.pieces = old_starts[:keep], old[:keep]
        self.first = old[keep] if keep < len(old) else None
        rest = next((i for i in range(keep, len(old_starts)) if old_starts[i] >= end), len(old_starts))
        self._match(at, end + shift, [s + shift for s in old_starts[rest:]], old[rest:])
        self.first = None

    def ids(self) -> list[int]:
        return [i for t in self.pieces for i in t.ids()]


_HELD: dict[str, ByteBpe] = {}


def _bpe(content: bytes, pattern: str) -> ByteBpe:
    """One table per worker process."""
    key = hashlib.sha256(content).hexdigest() + pattern
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = ByteBpe.from_file(content, pattern)
    return _HELD[key]


def _ranks(df: DataFrame, ranks_path: str):
    """The rank file (under a megabyte, whatever the corpus) read on the driver and sent once to each executor."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: id and ``ids`` (binary, little-endian unsigned 32-bit).

    With ``decoded`` also ``bytes``, what the ids stand for, made from them in the same pass.  A null text is
    the empty one and has no ids.  Whole texts of any length: a long one is encoded part by part, so what is
    held beside it and its ids is bounded, but for a single piece without a border (such as a word of many
    megabytes), which takes time and memory in proportion to its bytes.  Rows that repeat an id are each
    encoded.  Empty tables give empty results.  Other columns do not matter.
    """
    sent = _ranks(docs, ranks_path)
    narrow = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    kind = narrow.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value, pattern)
        for b in batches:
            for c in chunks(b, 1, CHUNK_BYTES):
                texts = c.column(1).to_pylist()
                out = [bpe.encode_long(texts[0])] if len(texts) == 1 else bpe.encode_batch(texts)
                more = [pa.array([bpe.decode(np.frombuffer(x, dtype="<u4")) for x in out], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(out, pa.binary()), *more], ["__id", "ids", "bytes"][: 2 + decoded])

    return narrow.mapInArrow(run, f"__id {kind}, ids binary" + ", bytes binary" * decoded).withColumnRenamed("__id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``bytes``: what the ids stand for.  Null ids give null; an id that is not in the ranks fails."""
    sent = _ranks(encoded, ranks_path)
    narrow = encoded.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids"))
    kind = narrow.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value, pattern)
        for b in batches:
            out = [None if x is None else bpe.decode(np.frombuffer(x, dtype="<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["__id", "ids", "bytes"])

    return narrow.mapInArrow(run, f"__id {kind}, ids binary, bytes binary").withColumnRenamed("__id", id_col).withColumnRenamed("ids", ids_col)
