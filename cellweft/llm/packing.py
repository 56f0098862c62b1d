"""Packing documents into sequences: best fit, then swap-based local search.

Texts become token ids (a byte-level BPE file, ids as that file's tokenizer gives them) and
one separator id each. A document longer than a sequence is cut into whole
sequences, of which only the first piece may be shorter.

Pieces are dealt to blocks by a hash of their document; equal rows are numbered and go to one
block after the other, so copies of one row spread over all blocks. Within a block they are placed
longest first into the fullest sequence that takes them. Then the local search works
on underfull sequences: it moves a piece, exchanges one piece for a longer one, or one
for two whose sum is longer, whenever the fuller of the two sequences gets fuller, which
raises the sum of squared fills, until sequences run empty or no exchange is
left: all pieces and all pairs of a sequence are on offer, without a cap. Sequences that stay under ``full`` of their length are dealt whole to the blocks of the
next level by a hash of their number, as many blocks as their pieces fill, so every level's
blocks hold about ``block_rows`` pieces whatever their lengths. A block never makes more sequences of them
than it was given. Levels end with the one that has a single block, or with the second in a row that does not
lower the number of sequences; its sequences stay as they are.

Defined results: a null text is an empty one, one separator long. Repeated rows are
packed each, and so are rows without an id. A tokenizer file that splits texts by another rule than
PATTERN is refused.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweft.errors import DataError
from cellweft.llm.common import number_copies, tune, written

LENGTH = 2048
SEPARATOR = b"\x00\x00\x00\x00"
SPECIAL = "<|endoftext|>"
#: Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_SIZE = 120_000
#: Levels in a row that may lower nothing before dealing again ends.
IDLE_LEVELS = 1
_SPACE_RUN = re.compile(r"\s ")
_ENCODERS: dict[str, Encoder] = {}


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder(dict):
    """Token ids of whole texts as little-endian 32-bit numbers; itself the memory of parts.

    The file's pattern never joins a character with a space after it, so a text may be cut before
    every single space and each part be encoded by itself; parts are remembered, up to
    MEMO_SIZE of them. Texts with white space before a space are encoded whole. The
    vocabulary and ids are the file's; merging is done by a second public library, as its
    rank is the id. Only texts with the special token's string need the file's own tokenizer,
    which is loaded for the first of them.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.tokenizer = path, None
        symbols = byte_symbols()
        loaded = self.load()
        splits = json.loads(loaded.pre_tokenizer.__getstate__()) if loaded.pre_tokenizer else {}
        if loaded.normalizer is not None or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
            raise DataError("the tokenizer file splits texts by another rule")
        ranks = {bytes(symbols[c] for c in token): i for token, i in loaded.get_vocab(False).items()
                 if token != SPECIAL}
        self.merger = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def load(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            self.tokenizer = self.tokenizer or self.load()
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.merger.encode_ordinary(text)).tobytes()

    def __missing__(self, part: str) -> bytes:
        found = self[part] = self.ids(" " + part)
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or SPECIAL in text or _SPACE_RUN.search(text):
            return self.ids(text)
        if len(self) > MEMO_SIZE:
            self.clear()
        parts = text.split(" ")
        return self.ids(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_pieces(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of ids that already end with the separator."""
    total = len(ids) // 4
    count = max(1, math.ceil(total / length))
    first = total - length * (count - 1)
    edges = [0, *(first + length * k for k in range(count))]
    return [(k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def tokenize(docs: DataFrame, path: str, id_col="doc_id", text_col="text", length: int = LENGTH) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of all documents, in a written copy."""

    def run(batches):
        made = encoder(path)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"]):
                rows += [(doc, *piece) for piece in cut_pieces(made.encode(text) + SEPARATOR, length)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            out = pd.DataFrame({"id": pd.Series(columns[0], dtype=pdf["id"].dtype)})
            for name, kind, values in zip(("piece", "start", "length", "ids_crc32"), ("int32", *["int64"] * 3), columns[1:]):
                out[name] = np.array(values, kind)
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return written(rows.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")


def best_fit(lengths: list[int], length: int = LENGTH) -> list[list[int]]:
    """Indexes by sequence: longest first, each into the fullest sequence that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r is set if a sequence with room r exists
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = length, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(at)
            rooms |= 1 << (room - n)
    return bins


class Emptier:
    """What the sequences not yet served in a pass hold: pieces by length, pairs of pieces of one sequence by sum.

    Every piece and every pair is listed; entries that have become wrong are dropped when they are met.
    """

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: list[int], length: int):
        self.bins, self.fill, self.lengths, self.length = bins, fill, lengths, length
        self.owner = {i: k for k, members in enumerate(bins) for i in members}
        self.waiting = {k for k in range(len(bins)) if 0 < fill[k] < length}
        self.order = [(-fill[k], k) for k in self.waiting]
        heapify(self.order)
        self.pieces: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]
        self.count = [0] * (length + 1)
        self.present = 0  # bit n is set if a piece of length n waits
        self.sums = {}
        self.holders: list[list[int]] = [[] for _ in range(length + 1)]
        self.paired = 0  # bit s is set if a sequence may hold a pair with sum s
        for k in sorted(self.waiting):
            for i in bins[k]:
                self.list_piece(i, k)
            self.list_pairs(k)

    def list_piece(self, i: int, k: int) -> None:
        n = self.lengths[i]
        self.owner[i] = k
        heappush(self.pieces[n], (self.fill[k], k, i))
        self.count[n] += 1
        self.present |= 1 << n

    def drop_piece(self, i: int) -> None:
        n = self.lengths[i]
        self.count[n] -= 1
        if not self.count[n]:
            self.present &= ~(1 << n)

    def list_pairs(self, k: int) -> None:
        seen = Counter(self.lengths[i] for i in self.bins[k])
        single = sum(1 << n for n in seen)
        sums = 0
        for n, times in seen.items():
            sums |= (single if times > 1 else single & ~(1 << n)) << n
        sums &= (1 << (self.length + 1)) - 1
        added = sums & ~self.sums.get(k, 0)
        self.sums[k] = sums
        self.paired |= added
        while added:
            low = added & -added
            self.holders[low.bit_length() - 1].append(k)
            added ^= low

    def fullest(self) -> int | None:
        """Take the fullest waiting sequence out; its pieces are no longer on offer."""
        while self.order:
            negative, k = heappop(self.order)
            if k in self.waiting and self.fill[k] == -negative:
                self.waiting.discard(k)
                for i in self.bins[k]:
                    self.drop_piece(i)
                return k
        return None

    def longest_piece(self, limit: int) -> int:
        """Greatest length up to ``limit`` on offer; 0 without one."""
        return (self.present & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.present else 0

    def longest_pair(self, limit: int, above: int) -> int:
        """Greatest sum of a pair in (above, limit]; 0 without one."""
        while True:
            s = (self.paired & ((1 << (limit + 1)) - 1)).bit_length() - 1
            if s <= above:
                return 0
            known = self.holders[s]
            while known and not (known[-1] in self.waiting and self.sums[known[-1]] >> s & 1):
                known.pop()
            if known:
                return s
            self.paired &= ~(1 << s)

    def take_piece(self, n: int) -> list[int]:
        """A waiting piece of length ``n``, of an emptiest sequence as listed."""
        while True:
            _, k, i = self.pieces[n][0]
            if self.owner[i] == k and k in self.waiting:
                return [i]
            heappop(self.pieces[n])

    def take_pair(self, s: int) -> list[int]:
        k = self.holders[s][-1]
        met: dict[int, int] = {}
        for i in self.bins[k]:
            other = met.get(s - self.lengths[i])
            if other is not None:
                return [other, i]
            met.setdefault(self.lengths[i], i)
        raise AssertionError("a listed pair is not there")

    def exchange(self, k: int, inward: list[int], out: int | None) -> None:
        """Bring pieces of one waiting sequence into ``k``, and ``out`` back in their place."""
        other = self.owner[inward[0]]
        for i in inward:
            self.drop_piece(i)
            self.bins[other].remove(i)
            self.bins[k].append(i)
            self.owner[i] = k
        gain = sum(self.lengths[i] for i in inward) - (self.lengths[out] if out is not None else 0)
        self.fill[k] += gain
        self.fill[other] -= gain
        if out is not None:
            self.bins[k].remove(out)
            self.bins[other].append(out)
            self.list_piece(out, other)
        if self.bins[other]:
            heappush(self.order, (-self.fill[other], other))
        else:
            self.waiting.discard(other)
        self.list_pairs(other)


def best_exchange(k: int, offers: Emptier) -> tuple[list[int], int | None] | None:
    """The move, one-for-one or two-for-one exchange by which sequence ``k`` gains most."""
    room = offers.length - offers.fill[k]
    gain, kind, out = offers.longest_piece(room), "piece", None
    wanted = gain
    for n, i in sorted({offers.lengths[i]: i for i in offers.bins[k]}.items()):
        if gain == room:
            break
        longest = offers.longest_piece(n + room)
        if longest - n > gain:
            gain, kind, out, wanted = longest - n, "piece", i, longest
        pair = offers.longest_pair(n + room, n + gain)
        if pair:
            gain, kind, out, wanted = pair - n, "pair", i, pair
    if gain <= 0:
        return None
    return (offers.take_piece(wanted) if kind == "piece" else offers.take_pair(wanted)), out


def local_search(bins: list[list[int]], lengths: list[int], length: int = LENGTH) -> list[list[int]]:
    """Moves and exchanges between underfull sequences until none is left that makes the fuller one fuller.

    A pass serves sequences fullest first. Each takes the best of all moves, one-for-one and two-for-one
    exchanges with all emptier sequences, again and again, until it is full or nothing fits. Every step
    raises the sum of squared fills, a whole number with a bound, so passes end; they do with one that changes nothing.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        offers = Emptier(bins, fill, lengths, length)
        while (k := offers.fullest()) is not None:
            while (found := best_exchange(k, offers)) is not None:
                offers.exchange(k, *found)
                changed = True
    return [b for b in bins if b]


def pack_blocks(pieces: DataFrame, level: int, length: int, full: float, last: bool) -> DataFrame:
    """Pack every block; ``open`` marks pieces of sequences that go on to the next level."""

    def run(key, pdf):
        keys = ["length", "id", "piece", "start", "ids_crc32", "copy"]
        pdf = pdf.sort_values(keys, ascending=[False] + [True] * 5, kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = local_search(best_fit(lengths, length), lengths, length)
        if level:
            given = list(pdf.groupby("sequence_id").indices.values())
            if len(bins) > len(given):
                bins = local_search([members.tolist() for members in given], lengths, length)
        sequence, offset, waits = (np.zeros(len(pdf), t) for t in (np.int64, np.int64, bool))
        for number, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = (level << 48) | (int(key[0]) << 24) | number, at
                at += lengths[i]
            if not last and at < full * length:
                waits[members] = True
        return pdf.assign(sequence_id=sequence, offset=offset, open=waits)

    return pieces.groupBy("block").applyInPandas(run, pieces.schema)


def pack_pieces(pieces: DataFrame, length: int = LENGTH, full: float = 0.999, block_rows: int = 20_000,
                seed: int = 11) -> DataFrame:
    """The given pieces with ``sequence_id`` and ``offset``."""
    most = max(1, math.ceil(pieces.count() / block_rows))
    place = F.pmod(F.pmod(F.xxhash64(F.lit(seed), "id", "piece", "ids_crc32"), F.lit(most)) + F.col("copy"), F.lit(most))
    waiting = number_copies(pieces, block_rows).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"),
                                  "open": F.lit(False), "block": place})
    done, level, given, idle = None, 0, math.inf, 0
    first = F.col("offset") == 0  # one piece of every sequence
    while True:
        out = written(pack_blocks(waiting, level, length, full, most == 1), "packed")
        rows, made, left = out.agg(F.count_if("open"), F.count_if(first), F.count_if(first & F.col("open"))).first()
        idle = idle + 1 if made >= given else 0
        over = not rows or most == 1 or idle > IDLE_LEVELS
        settled = out if over else out.filter(~F.col("open"))
        done = settled if done is None else done.unionByName(settled)
        if over:
            return done.drop("open", "block", "copy")
        most, level, given = math.ceil(rows / block_rows), level + 1, left
        place = F.pmod(F.xxhash64(F.lit(seed + level), "sequence_id"), F.lit(most))
        waiting = out.filter("open").withColumns({"block": place, "open": F.lit(False)})


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", length: int = LENGTH,
                   block_rows: int = 20_000) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    tune(docs.sparkSession)
    return pack_pieces(tokenize(docs, tokenizer_path, id_col, text_col, length), length, block_rows=block_rows)
