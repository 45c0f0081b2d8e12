"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt by a hash of id and length into groups of about GROUP documents, whatever files they come from, and
each group is packed by itself, longest first. A piece goes to the open bin that it fills best. Where none can hold it,
the bin size is opened whose expected cost per word is least: what the words still to place would leave empty in it,
plus a fixed cost for each sequence. In the end every bin shrinks to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_groups, materialise, table
from .mixture import word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)
GROUP = 4000
#: What a sequence costs besides its positions, in positions.
OVERHEAD = 16


class Packer:
    def __init__(self, capacities=CAPACITIES, overhead: int = OVERHEAD):
        self.sizes, self.overhead = sorted(capacities), overhead

    def expected_waste(self, room: int, present: int, left: dict[int, int]) -> int:
        """Positions that stay empty if room is filled with the longest pieces left that fit, again and again."""
        taken: dict[int, int] = {}
        while room and (fits := present & ((1 << (room + 1)) - 1)):
            longest = fits.bit_length() - 1
            n = min(left[longest] - taken.get(longest, 0), room // longest)
            if not n:
                present &= ~(1 << longest)
                continue
            taken[longest] = taken.get(longest, 0) + n
            room -= n * longest
        return room

    def pack(self, lengths: list[int]) -> tuple[list[int], list[int], list[int]]:
        """(bin, offset) of each length, none over the largest size, and the final size of each bin."""
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        left: dict[int, int] = {}
        for n in lengths:
            left[n] = left.get(n, 0) + 1
        present = sum(1 << n for n in left if n)
        rooms: dict[int, list[int]] = {}  # open bins by the room they have
        open_rooms = 0
        size, used = [], []
        where, offset = [0] * len(lengths), [0] * len(lengths)
        for i in order:
            n = lengths[i]
            left[n] -= 1
            if not left[n]:
                present &= ~(1 << n)
            if fit := open_rooms >> n:
                room = n + (fit & -fit).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    open_rooms &= ~(1 << room)
            else:
                costs = [((self.expected_waste(c - n, present, left) + self.overhead) / c, c) for c in self.sizes if c >= n]
                room = min(costs)[1]
                b = len(size)
                size.append(room)
                used.append(0)
            where[i], offset[i] = b, used[b]
            used[b] += n
            if room := room - n:
                rooms.setdefault(room, []).append(b)
                open_rooms |= 1 << room
        return where, offset, [min(c for c in self.sizes if c >= u) for u in used]


def pack_documents(documents: DataFrame, n_words=None, id_col: str = "doc_id", capacities=CAPACITIES, group: int = GROUP) -> DataFrame:
    """One row per piece: id, piece, start_word, n_words, bin_id, bin_capacity, bin_offset.

    A document longer than the largest size is cut into pieces of that size and a rest; all its words are placed. A
    document without words (a null text too) has one row with n_words 0 and no bin. Rows that repeat an id are packed
    each by itself; a null id is kept. Other columns are left out; nothing comes of an empty table.
    """
    lengths = documents.select(F.col(id_col).alias("id"), F.coalesce(word_count() if n_words is None else n_words, F.lit(0)).cast("long").alias("n"))
    kind = dict(lengths.dtypes)["id"]
    # rows that are equal in id and length are numbered, so that they too are dealt over the groups
    lengths = materialise(lengths.groupBy("id", "n").agg(F.count("*").alias("k")).select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("k")))
    groups = -(-lengths.count() // group) or 1
    dealt = lengths.withColumn("g", F.pmod(F.xxhash64("id", "n", "k"), F.lit(groups)))
    most = max(capacities)

    def run(key, rows):
        ids, n = rows.column("id").to_pylist(), rows.column("n").to_numpy()
        pieces = np.maximum(1, -(-n // most))
        of = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(most, n[of] - piece * most)
        full = np.flatnonzero(size > 0)
        where, offset, sizes = Packer(capacities).pack(size[full].tolist())
        bins, caps, offs = np.full(len(of), -1, np.int64), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        bins[full] = (key[0] << 32) + np.array(where, np.int64)
        caps[full], offs[full] = np.array(sizes, np.int64)[where] if len(full) else [], offset
        empty = size == 0
        return {"id": [ids[i] for i in of], "piece": piece.astype(np.int32), "start_word": piece * most, "n_words": size, "bin_id": [None if e else b for b, e in zip(bins.tolist(), empty, strict=True)], "bin_capacity": caps.astype(np.int32), "bin_offset": offs.astype(np.int32)}

    out = map_groups(dealt, ["g"], run, f"id {kind}, piece int, start_word long, n_words long, bin_id long, bin_capacity int, bin_offset int", ["n", "id", "k"])
    return out.withColumnRenamed("id", id_col)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
