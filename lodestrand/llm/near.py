"""All near-equal pairs of texts: chunks cut at content-defined places, joined by rolling digest, checked by edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

_BASE, _GOLD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Longest chunk; bits of a chunk's place in a key; bits of the table of digest counts; width of the word signature.
CHUNK, PLACE_BITS, SLOT_BITS, SIGNATURE, WORD = 8, 18, 20, 1024, 4
LAST_PLACE = (1 << PLACE_BITS) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Texts(NamedTuple):
    """Texts joined to one array of code points; text i is codes[begin[i] : begin[i] + size[i]]."""

    codes: np.ndarray
    size: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array | pa.ChunkedArray) -> Texts:
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = "".join(texts.to_pylist())
        codes = np.frombuffer(joined.encode("latin-1"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(codes, size, np.concatenate([[0], np.cumsum(size)])[:-1])

    def digests(self, q: int) -> np.ndarray:
        """Rolling digest of the q characters from each place."""
        d = np.full(max(0, len(self.codes) - q + 1), q, np.uint64)
        for i in range(q):
            d *= _BASE
            d += self.codes[i : i + len(d)]
        return mixed(d)

    def places(self, which: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(number in `which`, start) of every run of q characters inside the texts `which`."""
        return spread(np.maximum(0, self.size[which] - q + 1))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(counts) entries its owner and its number within the owner."""
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Limits:
    """What an allowed share of edits means for texts of up to `longest` characters, as tables by length.

    `edits[n]`: edits allowed to a pair whose longer text has n characters. `most[n]`: edits that any partner of a text of
    n characters allows. A text is cut into most + 1 chunks of `chunk` characters: as edits reach `most` chunks at the
    outside, any partner holds one unchanged.
    """

    def __init__(self, share: float, longest: int):
        n = np.arange(int(longest / (1 - share)) + 3)
        self.edits = (share * n + 1e-9).astype(np.int64)
        self.upto = np.searchsorted(n - self.edits, n[: longest + 1], "right") - 1
        self.most = self.edits[self.upto]
        self.chunk = np.where(self.most > 0, np.minimum(CHUNK, n[: longest + 1] // (self.most + 1)), 0)

    def lengths(self) -> np.ndarray:
        return np.unique(self.chunk[self.chunk > 0])

    def asked(self, q: int) -> np.ndarray:
        """Whether a text of a length may meet one that is cut into chunks of q characters."""
        cut = np.concatenate([[0], np.cumsum(self.chunk == q)])
        n = np.arange(len(self.chunk))
        return cut[np.minimum(self.upto, len(n) - 1) + 1] > cut[n - self.edits[n]]


def choose_chunks(t: Texts, limits: Limits, counts: np.ndarray) -> list[np.ndarray]:
    """For each text the starts of its chunks, side by side, cut where the sum of `counts` of their digests is least."""
    starts = [np.zeros(0, np.int32)] * len(t.size)
    most, chunk = limits.most[t.size], limits.chunk[t.size]
    for q in np.unique(chunk[chunk > 0]):
        d = (t.digests(int(q)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        q, rows = int(q), np.flatnonzero(chunk == q)
        rows = rows[np.argsort(t.size[rows], kind="stable")]
        at = 0
        while at < len(rows):
            width, k = int(t.size[rows[min(at + 2047, len(rows) - 1)]]), int(most[rows[min(at + 2047, len(rows) - 1)]]) + 1
            some = rows[at : at + max(1, min(2048, 40_000_000 // (width * k)))]
            at += len(some)
            size, left = t.size[some], most[some] + 1
            if int(size[-1]) * k > 40_000_000:  # the table of one text would be too large: even cuts do as well
                for r, n, m in zip(some, size, left, strict=True):
                    starts[r] = (np.arange(m) * (n // m)).astype(np.int32)
                continue
            width, k = int(size[-1]), int(left.max())
            place = t.begin[some] + np.arange(width - q + 1)[:, None]
            cost = counts[d[np.minimum(place, len(d) - 1)]].astype(np.float32)
            best = np.full((width + 1, k + 1, len(some)), np.inf, np.float32)
            best[:, 0] = 0
            for end in range(q, width + 1):
                np.minimum(best[end - q, :-1] + cost[end - q], best[end - 1, 1:], out=best[end, 1:])
            end, every, taken = size.copy(), np.arange(len(some)), []
            while (live := left > 0).any():
                use = live & (best[end, left, every] < best[np.maximum(end - 1, 0), left, every])
                taken.append((every[use], (end - q)[use]))
                end, left = np.where(use, end - q, end - live), left - use
            owner, start = (np.concatenate(x) for x in zip(*taken, strict=True))
            order = np.argsort(owner, kind="stable")
            for r, s in zip(some, np.split(start[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(some)))[:-1]), strict=True):
                starts[r] = s
    return starts


class Routes:
    """Which task compares which digests: `ranges[b]` tasks for the texts of place bucket b, from `base[b]` on, by ranges
    of the digest. Digests held by more texts than a task should see are salted: their runs go to one of `salts` tasks,
    their chunks to all of these."""

    def __init__(self, postings: np.ndarray, counts: np.ndarray, size: int):
        self.ranges = np.where(postings > 0, -(-postings // size), 0).astype(np.int64)
        self.base = np.cumsum(self.ranges) - self.ranges
        self.tasks = max(1, int(self.ranges.sum()))
        self.salts = np.maximum(1, -(-counts.astype(np.int64) // size)).astype(np.int32)
        self.bucket = np.repeat(np.arange(len(postings)), self.ranges)

    def of(self, digest: np.ndarray, salt: np.ndarray, ranges: int) -> np.ndarray:
        return (mixed(digest + salt.astype(np.uint64) * _GOLD) >> np.uint64(33)).astype(np.int64) % ranges

    def run(self, digest: np.ndarray, ids: np.ndarray, ranges: int) -> np.ndarray:
        """The range of each run, from its digest and its text's id."""
        salts = self.salts[(digest >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        return self.of(digest, mixed(ids.astype(np.uint64)) % salts.astype(np.uint64), ranges)

    def chunk(self, digest: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the chunk, range): all ranges that runs equal to it may have gone to."""
        owner, salt = spread(self.salts[(digest >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
        return owner, self.of(digest[owner], salt, ranges)


def _bags(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters in 16 classes, as bytes of two words, and their sum."""
    kind = ((t.codes.astype(np.uint64) * _GOLD) >> np.uint64(60)).astype(np.int64)
    n = np.bincount(np.repeat(np.arange(len(t.size)) * 16, t.size) + kind, minlength=16 * len(t.size))
    n = np.minimum(n, 127).astype(np.uint8).reshape(-1, 16)
    return n.view(np.uint64), n.sum(1, dtype=np.int32)


def _word_bits(t: Texts) -> np.ndarray:
    """The set of WORD-character words, hashed to SIGNATURE bits."""
    out = np.zeros((len(t.size), SIGNATURE // 64), np.uint64)
    bit = (t.digests(WORD) >> np.uint64(54)).astype(np.int64)
    for lo in range(0, len(t.size), 8192):
        some = np.arange(lo, min(lo + 8192, len(t.size)))
        owner, start = t.places(some, WORD)
        there = np.zeros((len(some), SIGNATURE), bool)
        there[owner, bit[t.begin[some][owner] + start]] = True
        out[some] = np.packbits(there, axis=1, bitorder="little").view(np.uint64)
    return out


def _bag_miss(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Characters of bag x that y lacks: bytewise positive differences, summed."""
    high, ones = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)
    total = np.zeros(len(x), np.int32)
    for w in (0, 1):
        d = (x[:, w] | high) - y[:, w]
        not_less = d & high
        total += (((d & (not_less - (not_less >> np.uint64(7)))) * ones) >> np.uint64(56)).astype(np.int32)
    return total


def edit_distances(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Edit distance of the pairs a[i], b[j] where it is at most k, else -1. Pairs lie side by side in an array and a band
    of the distance table moves down all of them at once; pairs whose whole band is above k are dropped on the way."""
    found = np.full(len(i), -1, np.int64)
    small = max(int(x.codes.max(initial=0)) for x in (a, b)) < 254
    kind, ends = (np.uint8, (254, 255)) if small else (np.uint32, (0xFFFFFFFE, 0xFFFFFFFF))
    order = np.lexsort((b.size[j], k))
    at = 0
    while at < len(order):
        top = int(k[order[min(at + 8191, len(order) - 1)]])
        mine = order[at : at + max(1, min(8192, 4_000_000 // (2 * top + 1)))]
        at += len(mine)
        top = int(k[mine].max())
        mine = mine[np.argsort(b.size[j[mine]], kind="stable")]
        la, lb, kk = a.size[i[mine]], b.size[j[mine]], k[mine]
        n = int(lb[-1])

        def rows(t: Texts, which: np.ndarray, shift: int, height: int, end: int) -> np.ndarray:
            place = np.arange(-shift, height - shift)[:, None]
            c = t.codes.take(t.begin[which] + place, mode="clip").astype(kind)
            c[(place < 0) | (place >= t.size[which])] = end
            return c

        p, q = rows(a, i[mine], top, n + 2 * top + 1, ends[0]), rows(b, j[mine], 0, n, ends[1])
        cells = np.repeat(np.clip(np.arange(-top, top + 1), 0, None)[:, None], len(mine), 1)
        cells[:top] = top + 1
        cells = cells.astype(np.uint8 if top < 120 else np.int32)
        one = cells.dtype.type(1)
        for col in range(n):
            done = int(np.searchsorted(lb, col, "right"))
            if done:  # texts of this length have come to their end
                last = cells[la[:done] - lb[:done] + top, np.arange(done)].astype(np.int64)
                found[mine[:done]] = np.where(last <= kk[:done], last, -1)
                cells, p, q, la, lb, kk, mine = cells[:, done:], p[:, done:], q[:, done:], la[done:], lb[done:], kk[done:], mine[done:]
            if col % 16 == 15:
                live = cells.min(0) <= kk
                if live.sum() < 0.7 * len(live):
                    cells, p, q, la, lb, kk, mine = cells[:, live], p[:, live], q[:, live], la[live], lb[live], kk[live], mine[live]
            if not len(mine):
                break
            new = cells + (p[col : col + 2 * top + 1] != q[col])
            np.minimum(new[:-1], cells[1:] + one, out=new[:-1])
            if top <= 32:
                for c in range(1, 2 * top + 1):
                    np.minimum(new[c], new[c - 1] + one, out=new[c])
            else:
                step = 1
                while step <= 2 * top:
                    np.minimum(new[step:], (new[:-step] + cells.dtype.type(min(step, top + 1))), out=new[step:])
                    step *= 2
            np.minimum(new, cells.dtype.type(top + 1), out=new)
            cells = new
        if len(mine):
            last = cells[la - lb + top, np.arange(len(mine))].astype(np.int64)
            found[mine] = np.where(last <= kk, last, -1)
    return found


def _met(a: Texts, chunks: list[np.ndarray], b: Texts, limits: Limits, keep_run, keep_chunk, rows: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, allowed edits) of texts where a run of b equals a chunk of a, at places that allow the edits, and whose
    characters and words differ by no more than these edits can explain."""
    bag_a, bag_b = _bags(a), _bags(b)
    word_a, word_b = _word_bits(a), _word_bits(b)
    held = np.array([len(x) for x in chunks])
    every, start = np.repeat(np.arange(len(chunks)), held), np.concatenate([*chunks, np.zeros(0, np.int32)]).astype(np.int64)
    low = ~np.uint64(LAST_PLACE)
    place = lambda s: np.clip(s, 0, LAST_PLACE).astype(np.uint64)
    for q in limits.lengths():
        q = int(q)
        which = np.flatnonzero(limits.asked(q)[b.size])
        owner, run = b.places(which, q)
        owner = which[owner].astype(np.int32)
        digest = b.digests(q)[b.begin[owner] + run]
        if (some := keep_run(digest, owner)) is not None:
            digest, owner, run = digest[some], owner[some], run[some]
        key = (digest & low) | place(run)
        order = np.argsort(key)
        key, owner, run = key[order], owner[order], run[order].astype(np.int32)
        behind = b.size[owner].astype(np.int32) - run
        mine = limits.chunk[a.size[every]] == q
        text, at = every[mine], start[mine]
        digest = a.digests(q)[a.begin[text] + at] if len(text) else np.zeros(0, np.uint64)
        if (some := keep_chunk(digest)) is not None:
            text, at, digest = text[some], at[some], digest[some]
        most = limits.most[a.size[text]]
        first = (digest & low) | place(at - most)
        order = np.argsort(first)
        text, at, first, digest, most = text[order], at[order], first[order], digest[order], most[order]
        lo = np.searchsorted(key, first, "left")
        n = np.searchsorted(key, (digest & low) | place(at + most), "right") - lo
        some = n > 0
        text, at, lo, n = text[some].astype(np.int32), at[some].astype(np.int32), lo[some], n[some]
        size_a, size_b = a.size.astype(np.int32), b.size.astype(np.int32)
        edits = limits.edits.astype(np.int32)
        after, most = size_a[text] - at, limits.most[a.size[text]].astype(np.int32)
        # A chunk that meets more runs than `rows` is taken in parts.
        parts = -(-n // rows)
        if (parts > 1).any():
            part, i = spread(parts)
            text, at, after, most, lo, n = text[part], at[part], after[part], most[part], lo[part] + i * rows, np.minimum(rows, n[part] - i * rows)
        total = np.concatenate([[0], np.cumsum(n)])
        j = 0
        while j < len(n):
            end = max(j + 1, int(np.searchsorted(total, total[j] + rows, "right")) - 1)
            of = n[j:end]
            run_no = np.repeat((lo[j:end] - (total[j:end] - total[j])).astype(np.int32), of)
            run_no += np.arange(len(run_no), dtype=np.int32)
            # The shift of the run in front of it, and behind it, are edits of their own.
            shift = np.abs(run[run_no] - np.repeat(at[j:end], of))
            shift += np.abs(behind[run_no] - np.repeat(after[j:end], of))
            ok = np.flatnonzero(shift <= np.repeat(most[j:end], of))
            x, y = np.repeat(text[j:end], of)[ok], owner[run_no[ok]]
            k = edits[np.maximum(size_a[x], size_b[y])]
            ok = shift[ok] <= k
            x, y, k = x[ok], y[ok], k[ok]
            miss = _bag_miss(bag_a[0][x], bag_b[0][y])
            ok = (miss <= k) & (miss + bag_b[1][y] - bag_a[1][x] <= k)
            x, y, k = x[ok], y[ok], k[ok]
            wa, wb = word_a[x], word_b[y]
            ok = (np.bitwise_count(wa & ~wb).sum(1, dtype=np.int32) <= WORD * k) & (np.bitwise_count(wb & ~wa).sum(1, dtype=np.int32) <= WORD * k)
            if ok.any():
                yield x[ok], y[ok], k[ok]
            j = end


def near_records(records: DataFrame, workspace: Workspace, share: float = 0.1, sample: int = 50_000, postings: int = 1_500_000) -> DataFrame:
    """(id_a < id_b, distance) of all different texts of `records` (id, record) within an edit distance of `share` of the longer.

    A text is cut into one chunk more than any partner's allowed edits, at places that its content decides: of all ways to
    lay such chunks side by side the one whose digests are rarest, by counts of at most about `sample` texts. Edits reach at
    most as many chunks as there are edits, so a partner holds one chunk unchanged, shifted by no more than the edits.
    Chunks of one side are joined with the rolling digests of all runs of the other, at these places; what is left must
    agree in characters and words as far as the edits allow, and its edit distance is worked out. No pair depends on the
    counts, and no digest is too common to be joined.

    With the columns `train` and `other` (sets of up to 64 places, as bits) a pair is compared only where one side's `train`
    and the other side's `other` share a place, in tasks of their own for each place. A task gets a range of digests with about
    `postings` runs and chunks, whatever the size of a place, and digests that are held more often than that are salted. Null and
    empty texts match nothing. Work grows with the number of runs that meet a chunk, so with the square of a place's
    texts once all short chunks there can be have come up.
    """
    spark = records.sparkSession
    roles = [F.col(c) if c in records.columns else F.lit(1).cast("long").alias(c) for c in ("train", "other")]
    records = records.where("record <> ''").select("id", "record", *roles)
    size = records.agg(F.count("*"), F.max(F.length("record")), F.bit_or("train"), F.bit_or("other")).first()
    out = "id_a long, id_b long, distance int"
    if not size[0]:
        return spark.createDataFrame([], out)
    limits, every = Limits(share, size[1]), max(1, size[0] // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, runs = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(64, np.int64)
        for batch in batches:
            t = Texts.of(batch.column("record"))
            train, places = (np.unpackbits(batch.column(c).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for c in ("train", "other"))
            runs += np.where(limits.chunk[t.size] > 0, limits.most[t.size] + 1, 0) @ train.astype(np.int64)
            for q in limits.lengths():
                which = np.flatnonzero(limits.asked(q)[t.size] & places.any(1))
                owner, run = t.places(which, int(q))
                digest = t.digests(int(q))[t.begin[which][owner] + run]
                held += np.bincount((digest >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(held)).astype(np.int32)
                runs += np.maximum(0, t.size[which] - q + 1) @ places[which].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()]), pa.array([runs.tobytes()])], names=["held", "runs"])

    drawn = records.where((F.pmod("id", F.lit(every)) == 0) & ((F.col("train") != 0) | (F.col("other") != 0))).select("record", "train", "other").coalesce(4)
    held, runs = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(64, np.int64)
    for r in drawn.mapInArrow(count, "held binary, runs binary").toLocalIterator():
        held += np.frombuffer(r["held"], np.int32)
        runs += np.frombuffer(r["runs"], np.int64)
    there = [(size[2] & size[3]) >> b & 1 for b in range(64)]
    routes = Routes(np.where(there, np.maximum(runs * every, 1), 0), held * every, postings)
    shared = spark.sparkContext.broadcast((np.minimum(held, 2**31 - 1).astype(np.int32), routes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, routes = shared.value
        for batch in batches:
            t = Texts.of(batch.column("record"))
            ids = batch.column("id").to_numpy()
            chunks = choose_chunks(t, limits, counts)
            wide = [(b, int(r)) for b, r in enumerate(routes.ranges) if r > 1]
            rows = []
            for c, run in (("other", True), ("train", False)):
                which, bucket = np.nonzero(np.unpackbits(batch.column(c).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                narrow = routes.ranges[bucket] == 1
                rows.append((which[narrow], routes.base[bucket[narrow]], run))
                for b, ranges in wide:
                    mine = which[bucket == b]
                    for q in limits.lengths() if len(mine) else ():
                        if run:
                            those = mine[limits.asked(q)[t.size[mine]]]
                            owner, start = t.places(those, int(q))
                            to = routes.run(d := t.digests(int(q))[t.begin[those][owner] + start], ids[those[owner]], ranges) if len(owner) else owner
                        else:
                            those = mine[limits.chunk[t.size[mine]] == q]
                            held = np.array([len(chunks[x]) for x in those], np.int64)
                            owner = np.repeat(np.arange(len(those)), held)
                            d = t.digests(int(q))[t.begin[those][owner] + np.concatenate([chunks[x] for x in those])] if len(owner) else np.zeros(0, np.uint64)
                            i, to = routes.chunk(d, ranges)
                            owner = owner[i]
                        if len(owner):
                            pairs = np.unique(owner.astype(np.int64) * ranges + to)
                            rows.append((those[pairs // ranges], routes.base[b] + pairs % ranges, run))
            blob = pa.array([x.tobytes() for x in chunks], pa.binary())
            for which, part, run in rows:
                for lo in range(0, len(which), 10_000):
                    take = pa.array(which[lo : lo + 10_000])
                    cut = pa.nulls(len(take), pa.binary()) if run else blob.take(take)
                    cols = [pa.array(part[lo : lo + 10_000].astype(np.int32)), batch.column("id").take(take), batch.column("record").take(take), cut]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "id", "record", "chunks"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = shared.value[1]
        whole = pa.Table.from_batches([*batches]) if (batches := [x for x in batches if x.num_rows]) else None
        if whole is None:
            return
        part = whole.column("part")[0].as_py()
        ranges, mine = int(routes.ranges[routes.bucket[part]]), part - int(routes.base[routes.bucket[part]])
        cut = pc.is_valid(whole.column("chunks"))
        left, right = whole.filter(cut), whole.filter(pc.invert(cut))
        if not left.num_rows or not right.num_rows:
            return
        # A text may come for several lengths of chunks; once is enough.
        left, right = ((x.take(np.unique(x.column("id").to_numpy(), return_index=True)[1]) if ranges > 1 else x) for x in (left, right))
        id_a, id_b = left.column("id").to_numpy(), right.column("id").to_numpy()
        a, b = Texts.of(left.column("record")), Texts.of(right.column("record"))
        chunks = [np.frombuffer(x, np.int32) for x in left.column("chunks").to_pylist()]

        def keep_run(digest, owner):
            return None if ranges == 1 else routes.run(digest, id_b[owner], ranges) == mine

        def keep_chunk(digest):
            if ranges == 1:
                return None
            i, to = routes.chunk(digest, ranges)
            return np.unique(i[to == mine])

        def checked(parts):
            code = np.concatenate([x.astype(np.int64) * len(id_b) + y for x, y, _ in parts])
            code, first = np.unique(code, return_index=True)
            x, y, k = code // len(id_b), code % len(id_b), np.concatenate([k for *_, k in parts])[first]
            some = id_a[x] != id_b[y]
            x, y, k = x[some], y[some], k[some]
            d = edit_distances(a, b, x, y, k.astype(np.int64))
            some = d >= 0
            u, v = id_a[x[some]], id_b[y[some]]
            cols = [np.minimum(u, v), np.maximum(u, v), d[some].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id_a", "id_b", "distance"])

        waiting, n = [], 0
        for met in _met(a, chunks, b, limits, keep_run, keep_chunk):
            waiting.append(met)
            if (n := n + len(met[0])) > 1_000_000:
                yield checked(waiting)
                waiting, n = [], 0
        if waiting:
            yield checked(waiting)

    sent = records.where("train <> 0 OR other <> 0").mapInArrow(send, "part int, id long, record string, chunks binary")
    return sent.repartitionById(routes.tasks, F.col("part")).mapInArrow(compare, out).distinct()
