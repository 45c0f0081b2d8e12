"""Iterating on a matrix whose rows lie in the memory of one task or some: arrays over the entries, numbers cut by their
bits. Every task holds the whole vector and takes the same steps; of a product it makes its own rows and gathers the
others'. A row is summed in the order of its columns, so results don't depend on the number of tasks."""

from __future__ import annotations

import secrets
import socket
import time
from collections.abc import Callable, Iterator
from contextlib import ExitStack, suppress

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext

FIELDS = ("stage", "converged", "finite", "iterations", "total_ns", "prep_ns", "spmv_ns", "exchange_ns", "overhead_ns")


def cut(x: np.ndarray, width: int) -> np.ndarray:
    """x cut to width bytes; NaN and infinities as they are."""
    mask = np.uint64((2 ** (8 * width) - 1) << (64 - 8 * width))
    return np.where(np.isfinite(x), (x.view(np.uint64) & mask).view(np.float64), x)


def size_of(x: np.ndarray, p: int) -> float:
    return float(np.abs(x).sum()) if p == 1 else float(np.sqrt((x * x).sum()))


def alone(part: np.ndarray) -> np.ndarray:
    return part


def received(peer: socket.socket, size: int) -> bytearray:
    out, got = bytearray(size), 0
    while got < size:
        n = peer.recv_into(memoryview(out)[got:])
        if not n:
            raise ConnectionError("a task of the iteration has gone")
        got += n
    return out


def sent(peer: socket.socket, part: np.ndarray) -> None:
    peer.sendall(part.nbytes.to_bytes(8, "big"))
    peer.sendall(np.ascontiguousarray(part).view(np.uint8))


def read(peer: socket.socket) -> bytearray:
    return received(peer, int.from_bytes(received(peer, 8), "big"))


def connected(open_: ExitStack) -> list[socket.socket]:
    """The first task's connections to the others in their order, another task's one to the first. Spark's own gathering
    takes a second a call, so it only tells the others the first task's port, and the token that they must show."""
    context = BarrierTaskContext.get()
    hosts, me = [x.address.rsplit(":", 1)[0] for x in context.getTaskInfos()], context.partitionId()
    if me:
        token, port = context.allGather("")[0].split()
        peers = {0: open_.enter_context(socket.create_connection((hosts[0], int(port))))}
        peers[0].sendall(bytes.fromhex(token) + me.to_bytes(4, "big"))
    else:
        token = secrets.token_bytes(16)
        server = open_.enter_context(socket.create_server(("", 0), backlog=len(hosts)))
        context.allGather(f"{token.hex()} {server.getsockname()[1]}")
        peers = {}
        while len(peers) < len(hosts) - 1:
            peer = open_.enter_context(server.accept()[0])
            with suppress(OSError):  # whoever else calls has no token
                peer.settimeout(60)
                if secrets.compare_digest(received(peer, 16), token):
                    peers[int.from_bytes(received(peer, 4), "big")] = peer
                peer.settimeout(None)
    for peer in peers.values():
        peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        peer.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
    return [peers[k] for k in sorted(peers)]


def gatherer(open_: ExitStack) -> Callable[[np.ndarray], np.ndarray]:
    """What puts the arrays of all tasks of a barrier stage together, in the order of tasks."""
    peers, first = connected(open_), BarrierTaskContext.get().partitionId() == 0

    def together(part: np.ndarray) -> np.ndarray:
        if not first:
            sent(peers[0], part)
            return np.frombuffer(read(peers[0]), part.dtype)
        whole = np.concatenate([part, *(np.frombuffer(read(p), part.dtype) for p in peers)])
        for p in peers:
            sent(p, whole)
        return whole

    return together


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(i, x) of the rows with j = -1, (i, j, v) of the others. The columns grow in place by an eighth, so that a task
    holds little more than the 16 bytes of each entry."""
    kinds = (np.int32, np.int32, np.float64)
    entries, n, own = [np.zeros(0, kind) for kind in kinds], 0, [[np.zeros(0, kind)] for kind in kinds[::2]]
    for b in batches:
        got = [b.column(c).to_numpy().astype(kind) for c, kind in enumerate(kinds)]
        first = got[1] < 0
        for parts, column in zip(own, got[::2], strict=True):
            parts.append(column[first])
        end = n + int((~first).sum())
        for whole, column in zip(entries, got, strict=True):
            if end > len(whole):
                whole.resize(end + len(whole) // 8, refcheck=False)
            whole[n:end] = column[~first]
        n = end
    for whole in entries:
        whole.resize(n, refcheck=False)
    i, j, v = entries
    same = (i[1:] == i[:-1]) & (j[1:] == j[:-1])
    if same.any():  # at the same place by value
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))
        v[at] = v[at][np.lexsort((v[at], j[at], i[at]))]
    return [np.concatenate(parts) for parts in own], entries


class Matrix:
    """Some rows' entries. A product adds the first entries of all rows at the same time, then the second ones and so on,
    so that each row is summed in the order of its columns, and no addition waits for the one before it."""

    #: Entries that are put in order together, rows as a whole; entries that are multiplied at a time, about.
    HELD, MULTIPLIED = 1 << 19, 1 << 15
    #: Rows, at least, whose entries are added at the same time; what is left of fewer rows is added one by one.
    ABREAST = 256

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, together: Callable[[np.ndarray], np.ndarray]):
        """The entries in the order of i and j; j and v are taken over and put in the order of products."""
        new = np.concatenate([np.ones(min(len(i), 1), bool), i[1:] != i[:-1]])
        self.together, self.rows = together, together(i[new])
        self.j, self.v, self.n = j, v, n
        start = np.append(np.flatnonzero(new), len(i))
        edges = np.unique(np.append(np.searchsorted(start, np.arange(0, len(i), self.HELD)), len(start) - 1)).tolist()
        self.own_rows, self.pieces = len(start) - 1, [self.laid(first, start[first : end + 1]) for first, end in zip(edges[:-1], edges[1:])]

    def laid(self, first: int, start: np.ndarray) -> tuple:
        """Some rows' entries put in the order of a product: (the rows from the longest to the shortest; where entries to
        multiply begin and end, and how many rows have the first one of them, the next one and so on; where the entries
        left begin and end, and their numbers)."""
        size, low, high = np.diff(start), int(start[0]), int(start[-1])
        rows = np.argsort(-size, kind="stable")
        width = int(size[rows[self.ABREAST - 1]]) if len(rows) >= self.ABREAST else 0
        abreast = len(rows) - np.searchsorted(size[rows[::-1]], np.arange(width), "right")
        ends = np.cumsum(abreast)
        begin, order, at = start[rows] - low, np.empty(high - low, np.int64), 0
        for k, n in enumerate(abreast.tolist()):
            np.add(begin[:n], k, out=order[at : at + n])
            at += n
        left = size[rows] - width
        left = left[left > 0]
        if len(left):
            np.concatenate([np.arange(b + width, b + width + n) for b, n in zip(begin.tolist(), left.tolist())], out=order[at:])
        for whole in (self.j, self.v):
            whole[low:high] = whole[low:high].take(order)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, at, self.MULTIPLIED), "right"), width)).tolist()
        edges = (low + np.append(0, ends)).tolist()
        groups = [(edges[a], edges[b], abreast[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
        return first + rows, groups, low + at, high, left

    def own(self, x: np.ndarray) -> np.ndarray:
        """The product's numbers of the rows that this task has."""
        out = np.zeros(self.own_rows)
        for rows, groups, rest, high, left in self.pieces:
            sums = np.zeros(len(rows))
            for low, end, abreast in groups:
                products, at = x.take(self.j[low:end]), 0
                products *= self.v[low:end]
                for n in abreast:
                    sums[:n] += products[at : at + n]
                    at += n
            if m := len(left):
                every = np.arange(m)
                products = x.take(self.j[rest:high]) * self.v[rest:high]
                sums[:m] = np.bincount(np.concatenate([every, np.repeat(every, left)]), np.concatenate([sums[:m], products]), m)
            out[rows] = sums
        return out

    def all(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        out[self.rows] = self.together(own)
        return out


def next_vector(z: np.ndarray, stage) -> np.ndarray | None:
    """The vector that a product gives, null if its norm is zero and it is to be divided by it."""
    if stage.power:
        z = cut(z, stage.width)
        size = size_of(z, 2)
        return z / size if size else None
    z = cut(stage.damping * z + (1 - stage.damping) / len(z), stage.width)
    if stage.renormalize:
        size = size_of(z, 1)
        return cut(z / size, stage.width) if size else None
    return z


def run_stage(a: Matrix, x: np.ndarray, stage, budget: int, number: int) -> tuple[np.ndarray, dict]:
    """The last vector and the stage's metadata. A vector follows from the one before it alone. So one that was there
    before, steps ago, comes again and again and none of them converges: whole rounds are counted without being taken,
    and have no times."""
    began = time.monotonic_ns()
    run = dict(zip(FIELDS, (number, False, True, 0, 0, 0, [], [], []), strict=True))
    x = cut(x, stage.state_width)
    if stage.start_normalised:
        size = size_of(x, 2 if stage.power else 1)
        if not size:
            return x, run
        x = cut(x / size, stage.state_width)
    seen, at = x, 0
    run["prep_ns"] = time.monotonic_ns() - began
    while not run["converged"] and run["iterations"] < budget:
        t0 = time.monotonic_ns()
        own = a.own(x)
        t1 = time.monotonic_ns()
        z = a.all(own)
        t2 = time.monotonic_ns()
        new = next_vector(z, stage)
        if new is None:
            break
        apart = np.abs(new - x)
        difference = float((apart[::3] if stage.every_third else apart).sum())
        x = new
        run["iterations"] += 1
        run["finite"] = bool(np.isfinite(difference))
        run["converged"] = difference < stage.tolerance
        run["spmv_ns"].append(t1 - t0)
        run["exchange_ns"].append(t2 - t1)
        run["overhead_ns"].append(time.monotonic_ns() - t2)
        if not run["finite"]:
            break
        taken = run["iterations"]
        if taken < budget and not run["converged"]:
            if np.array_equal(x, seen):
                run["iterations"] += (budget - taken) // (taken - at) * (taken - at)
            elif taken & (taken - 1) == 0:
                seen, at = x, taken
    run["total_ns"] = time.monotonic_ns() - began
    return x, run


def task(stages: list, limit: int, n: int, several: bool = False):
    """For mapInArrow over entries (i, j, v) in the order of i and j, and the vector's numbers with j = -1; over one
    partition, or over several of a barrier stage that have whole rows each. The first task returns the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (at, start), (i, j, v) = gathered(batches)
        left, runs = limit, []
        with np.errstate(all="ignore"), ExitStack() as open_:
            together = gatherer(open_) if several else alone
            x = np.zeros(n)
            x[together(at)] = together(start)
            a = Matrix(i, j, v, n, together)
            del i
            for k, stage in enumerate(stages):
                x, found = run_stage(a, x, stage, left, k)
                left -= found["iterations"]
                runs.append(found)
                if not found["finite"]:
                    break
        if several and TaskContext.get().partitionId():
            return
        none = pa.nulls
        lists = pa.list_(pa.int64())
        kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), lists, lists, lists)
        names = ["i", "x", *FIELDS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(x), *(none(n, k) for k in kinds)], names=names)
        m = len(runs)
        yield pa.RecordBatch.from_arrays([none(m, pa.int64()), none(m, pa.float64()), *(pa.array([r[f] for r in runs], k) for f, k in zip(FIELDS, kinds, strict=True))], names=names)

    return run
