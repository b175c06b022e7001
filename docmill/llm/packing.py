"""Packing of token pieces into sequences by local search: best-fitting moves and swaps between underfull bins."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import give_back, stash, table, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str):
    """Ids of a text by the byte-level BPE in ``path`` (tokenizers JSON); strings of special tokens are ordinary text.

    The vocabulary and merges of the JSON are run by tiktoken, which gives the same ids as tokenizers several
    times faster (tests hold the two against each other).
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # the usual printable stand-ins of byte-level BPE
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and t != "<|endoftext|>"}
    enc = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc.encode_ordinary


def cut(docs: DataFrame, size: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, piece, start, length, ids_crc32.

    A document is its ids and a final 0; null text is empty, so it is the single id 0. Only a longer document
    is cut, into full pieces after a first one of what is left over. Whole texts are tokenized. Repeated rows
    give repeated pieces. Empty input gives no rows; other columns are ignored.
    """

    @tidy
    def run(batches):
        import public_tokenizers

        encode = encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                n = len(ids)
                first = n % size or size
                edges = [0, *range(min(first, n), n + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for col, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def next_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins (lists of indexes) by filling one after the other in the order given: the start of the search."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = size
        bins[-1].append(i)
        room -= n
    return bins


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins by best fit of decreasing lengths: another start, for groups that the first does not bring to the bound."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect_left(room, (lengths[i], -1))
        left, b = room.pop(k) if k < len(room) else (size, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if left > lengths[i]:
            insort(room, (left - lengths[i], b))
    return bins


def least_bins(lengths: list[int], size: int) -> int:
    """No packing has fewer bins: all lengths over the size, and pieces of more than half of it, which meet nowhere."""
    return max(-(-sum(lengths) // size), sum(2 * n > size for n in lengths))


class Search:
    """Local search over bins: moves and swaps of one for one and two for one between underfull bins.

    Each step takes length from a bin and fills another that is at least as full, so the sum of squared fills
    rises and the search ends. The emptiest bins give until they are gone; full bins leave the search. For a
    step the receiver is found in sorted lists: of rooms (a move wants the least room that a piece fits) and of
    (length + room) of every piece (a swap wants the least that reaches the length given), so it costs a
    binary search; only two-for-one swaps walk through the open bins, each once with two pointers. It ends at
    the lower bound, or where the ``patience`` emptiest bins can give nothing.
    """

    patience = 64

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.rooms: list[tuple[int, int]] = []  # (room, bin)
        self.offers: list[tuple[int, int, int]] = []  # (length + room, bin, piece)
        for b in range(len(bins)):
            self.enter(b)
        self.rooms.sort()
        self.offers.sort()

    def entries(self, b: int):
        room = self.size - self.fill[b]
        return (room, b), [(self.lengths[i] + room, b, i) for i in self.bins[b]]

    def enter(self, b: int, keep=list.append):
        if self.bins[b] and self.fill[b] < self.size:
            room, offers = self.entries(b)
            keep(self.rooms, room)
            for o in offers:
                keep(self.offers, o)

    def leave(self, b: int):
        if self.bins[b] and self.fill[b] < self.size:
            room, offers = self.entries(b)
            del self.rooms[bisect_left(self.rooms, room)]
            for o in offers:
                del self.offers[bisect_left(self.offers, o)]

    def step(self, donor: int, other: int, give: list[int], take: list[int]):
        self.leave(donor)
        self.leave(other)
        gain = sum(self.lengths[i] for i in give) - sum(self.lengths[i] for i in take)
        self.bins[donor] = [i for i in self.bins[donor] if i not in give] + take
        self.bins[other] = [i for i in self.bins[other] if i not in take] + give
        self.fill[donor] -= gain
        self.fill[other] += gain
        self.enter(donor, insort)
        self.enter(other, insort)

    def move(self, donor: int, i: int) -> bool:
        """A piece of the donor to the bin that it fills best."""
        for k in range(bisect_left(self.rooms, (self.lengths[i], -1)), len(self.rooms)):
            other = self.rooms[k][1]
            if other != donor and self.fill[other] >= self.fill[donor]:
                self.step(donor, other, [i], [])
                return True
        return False

    def swap(self, donor: int, i: int) -> bool:
        """A piece of the donor for a shorter one, where it leaves least room."""
        n = self.lengths[i]
        for k in range(bisect_left(self.offers, (n, -1, -1)), len(self.offers)):
            _, other, j = self.offers[k]
            if other != donor and self.lengths[j] < n and self.fill[other] >= self.fill[donor]:
                self.step(donor, other, [i], [j])
                return True
        return False

    def swap_two(self, donor: int) -> bool:
        """One piece of the donor for two of another bin, or two for one: of each bin the pair that leaves least room."""
        ln = self.lengths
        by_length = lambda b: sorted(self.bins[b], key=lambda i: (ln[i], i))
        mine = by_length(donor)
        for room, other in reversed(self.rooms):
            if other == donor or self.fill[other] < self.fill[donor]:
                continue
            theirs = by_length(other)
            for i in mine:  # theirs must be shorter together, by the room at most
                a, z, best = 0, len(theirs) - 1, None
                while a < z:
                    both = ln[theirs[a]] + ln[theirs[z]]
                    if both < ln[i] - room:
                        a += 1
                        continue
                    if both < ln[i] and (best is None or both < best[0]):
                        best = both, [theirs[a], theirs[z]]
                    z -= 1
                if best:
                    self.step(donor, other, [i], best[1])
                    return True
            for j in theirs:  # mine must be longer together, by the room at most
                a, z, best = 0, len(mine) - 1, None
                while a < z:
                    both = ln[mine[a]] + ln[mine[z]]
                    if both > ln[j] + room:
                        z -= 1
                        continue
                    if both > ln[j] and (best is None or both > best[0]):
                        best = both, [mine[a], mine[z]]
                    a += 1
                if best:
                    self.step(donor, other, best[1], [j])
                    return True
        return False

    def run(self) -> list[list[int]]:
        least = least_bins(self.lengths, self.size)
        count = sum(map(bool, self.bins))
        stuck: set[int] = set()
        stepped = False
        while count > least:
            donor = next((b for _, b in reversed(self.rooms) if b not in stuck), None) if len(stuck) < self.patience else None
            if donor is None:
                if not stepped:
                    break
                stuck, stepped = set(), False
                continue
            pieces = sorted(self.bins[donor], key=lambda i: (-self.lengths[i], i))
            if any(self.move(donor, i) for i in pieces) or any(self.swap(donor, i) for i in pieces) or self.swap_two(donor):
                stepped = True
                count -= not self.bins[donor]
            else:
                stuck.add(donor)
        return [b for b in self.bins if b]


def search(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of pieces (indexes) by local search from next fit, and where that ends above the lower bound, from best fit: the fewer bins."""
    found = Search(next_fit(lengths, size), lengths, size).run()
    if len(found) > least_bins(lengths, size):
        found = min(found, Search(best_fit(lengths, size), lengths, size).run(), key=len)
    return found


PACKED = PIECES + ", sequence_id long, offset long"
_OPEN = PIECES + ", sequence_id long, offset long, open boolean"


def pack(pieces: DataFrame, size: int = 2048, group: int = 4096, rooms: int = 16) -> DataFrame:
    """Places of pieces: the columns of ``cut`` with sequence_id and offset.

    Pieces go to random groups of about ``group``; each is packed on its own by :func:`search`, so a task
    holds one group. Sequences that keep room for more than ``rooms`` tokens are opened again, and their pieces packed
    in a next pass with far fewer groups, until one group is left: all groups together waste about what one would. A long
    document's pieces and repeated rows spread over groups, so no key is hot. Ties are broken by the pieces' columns.
    Repeated rows are placed each. Empty input gives no rows; other columns are ignored.
    """
    names = [f.split()[0] for f in PIECES.split(", ")]

    def packer(at: int, last: bool):
        def run(key, pdf):
            # in a random order that does not depend on how rows came
            pdf = pdf.sort_values(["ids_crc32", "doc_id", "piece", "start", "length"], ignore_index=True)
            lengths = pdf["length"].tolist()
            seq, offset, again = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
            for s, b in enumerate(search(lengths, size)):
                place = 0
                for i in b:
                    seq[i], offset[i] = (at << 56) + (int(key[0]) << 24) + s, place
                    place += lengths[i]
                if not last and size - place > rooms:
                    again[b] = True
            give_back()
            return pdf[names].assign(sequence_id=seq, offset=offset, open=again)

        return run

    left, done, before = pieces.select(*names), [], None
    while True:
        groups = max(1, -(-left.count() // group))
        last = groups == 1 or (before is not None and groups > before // 2)  # the last pass opens nothing again
        # the row's number deals repeated rows to different groups
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        now = stash(dealt.groupBy("grp").applyInPandas(packer(len(done), last), _OPEN), "packed")
        done.append(now.where("NOT open").drop("open"))
        if last:
            break
        left, before = now.where("open").select(*names), groups
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stash(cut(table(spark, sf_dir, "documents")), "pieces"))
