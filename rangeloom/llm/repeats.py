"""Suffix-array dedup of repeated substrings by bucket-pointer refinement.

What is asked: which `LENGTH`-byte strings of a document also start in a document with a smaller id. The suffixes that
matter are those starts, to a depth of LENGTH bytes; they are sorted in three steps, each a refinement of the last, and
only buckets that can still split or match go on:

1. Initial buckets. Every string of LENGTH bytes falls into the bucket of one q-gram inside it, the one with the least
   hash (the leftmost of equals), so equal strings share a bucket and neighbouring strings mostly do too: a run of them is
   one segment of text. A bucket met in a single document is a singleton: final, never looked at again.
2. Segments of the other buckets, with their texts, meet in the bucket's task; equal segments are one, with the smallest id.
   A bucket with one segment left is final. A bucket spread over more than HOT batches is refined before it is sent: its
   strings are bucketed by all of their bytes, so a passage in a third of all documents is dealt over the hash space.
3. Bucket-pointer refinement proper over what is left: suffixes are bucketed by eight bytes, then each bucket is sorted by
   the bucket pointers of the suffixes 8, 16 and 18 bytes on. Each pass reuses the pointers that the pass before has
   updated, so the depth goes 8, 16, 32, 50; suffixes alone in their bucket keep their pointer and leave.

See batches.py for how questions and answers travel. Memory: one batch of texts (4 MB, or the longest text) and one
bucket's segments a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import batches as B
from rangeloom.llm.common import table

LENGTH = 50
Q = 20
HOT = 1024
CHUNK = 1 << 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_WHO = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zero bytes follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.empty(len(raw) + 8 - 7, "<u8")
    for r in range(8):
        part = padded[r : r + (len(padded) - r) // 8 * 8].view("<u8")
        out[r::8] = part[: len(out[r::8])]
    return out[: len(raw)]


def _grams(raw: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on (q from 8 to 24)."""
    x = _loads(raw)
    n = len(raw) - q + 1
    out = x[:n] * _A
    if q > 16:
        out = (out ^ (out >> np.uint64(31))) + x[8 : 8 + n] * _C
    out = (out ^ (out >> np.uint64(31))) + x[q - 8 : q - 8 + n] * _B
    return _mix(out)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers.value[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers.value = tuple(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (np.uint64(_BASE), np.uint64(inverse)))
    return _powers.value


_powers.value = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each [start, end) of raw."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_WHO[raw] * up[: len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then the same for the next."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Batch:
    """The distinct texts of a batch, by ascending id, and the segments of their strings."""

    def __init__(self, ids: list[int], bodies: list[bytes], length: int, q: int):
        self.length, self.q = length, q
        rows = sorted(range(len(ids)), key=lambda i: ids[i])
        self.first: dict[bytes, int] = {}
        own, parts = [], []
        self.rows: list[tuple[int, int]] = []  # for each row: id, place of its text
        for i in rows:
            at = self.first.setdefault(bodies[i], len(parts))
            if at == len(parts):
                own.append(ids[i])
                parts.append(bodies[i])
            self.rows.append((ids[i], at))
        self.own = np.array(own, np.int64)
        self.copied = np.zeros(len(parts), bool)  # a text that documents with other ids hold too
        for ident, at in self.rows:
            if ident != own[at]:
                self.copied[at] = True
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        self.edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self._segments()

    def _segments(self) -> None:
        """lo, hi: the first and last start of each segment's strings; key: its q-gram's hash; doc: its text."""
        width, wide = self.length - self.q + 1, self.length
        los, his, keys = [], [], []
        n = len(self.raw)
        doc_of_start = None
        for c in range(0, max(0, n - wide + 1), CHUNK):
            part = self.raw[c : min(n, c + CHUNK + wide - 1)]
            grams = _grams(part, self.q)
            ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            span = 1
            least = ranked
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[: len(ranked) - width + 1], least[width - span :])
            anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each start c + i
            starts = np.arange(c, c + len(anchor))
            doc_of_start = np.searchsorted(self.edge, starts, "right") - 1
            valid = starts + wide <= self.edge[doc_of_start + 1]
            change = np.ones(len(anchor), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (doc_of_start[1:] != doc_of_start[:-1])
            first = np.flatnonzero(change)
            last = np.append(first[1:], len(anchor)) - 1
            good = valid[first]
            los.append(starts[first[good]])
            his.append(starts[last[good]])
            # Mixed again: the least hashes of many would all fall into the first buckets.
            keys.append(_mix(grams[anchor[first[good]]] * _C))
        none = np.zeros(0, np.int64)
        self.lo = np.concatenate(los) if los else none
        self.hi = np.concatenate(his) if his else none
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.edge, self.lo, "right") - 1

    def grams_asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct q-gram hashes, ascending; whether documents with different ids hold each; each segment's place among them."""
        keys, where = np.unique(self.key, return_inverse=True)
        ident = self.own[self.doc]
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, where, ident)
        np.maximum.at(high, where, ident)
        many = low != high
        many[where[self.copied[self.doc]]] = True
        return keys, many, where

    def contested(self, shared: np.ndarray, hot: np.ndarray, where: np.ndarray) -> None:
        """Keeps the segments of shared q-grams, cut into single strings where the q-gram is hot, and names equal ones."""
        keep = shared[where]
        lo, hi, key, doc, split = self.lo[keep], self.hi[keep], self.key[keep], self.doc[keep], hot[where[keep]]
        if split.any():
            n = hi[split] - lo[split] + 1
            single = _runs(lo[split], n)
            lo, hi = np.concatenate([lo[~split], single]), np.concatenate([hi[~split], single])
            doc = np.concatenate([doc[~split], np.repeat(doc[split], n)])
            key = np.concatenate([key[~split], np.zeros(len(single), np.uint64)])
            fresh = np.arange(len(key)) >= len(key) - len(single)
            order = np.argsort(lo, kind="stable")
            lo, hi, key, doc, fresh = lo[order], hi[order], key[order], doc[order], fresh[order]
        else:
            fresh = np.zeros(len(lo), bool)
        content = np.zeros(len(lo), np.uint64)
        for c in range(0, len(self.raw), CHUNK):
            a, b = np.searchsorted(lo, [c, c + CHUNK])
            if a < b:
                part = self.raw[c : c + CHUNK + 2 * self.length]
                content[a:b] = _span_hashes(part, lo[a:b] - c, hi[a:b] + self.length - c)
        key = np.where(fresh, content, key)
        # Equal segments of the batch are one; texts ascend by id, so the first has the smallest.
        _, first, self.entry_of = np.unique(_mix(content) ^ key * _A, return_index=True, return_inverse=True)
        order = np.argsort(key[first], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = first[order]
        self.entry_of = place[self.entry_of]
        self.c_lo, self.c_hi, self.c_doc = lo, hi, doc
        self.e_key, self.e_lo, self.e_hi, self.e_id = key[first], lo[first], hi[first], self.own[doc[first]]

    def entries(self, n: int) -> Iterator[tuple[int, bytes]]:
        """For each bucket: how many entries, their keys, ids, sizes and texts."""
        where = B.bucket_of(self.e_key, n)
        cuts = np.flatnonzero(np.diff(where)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]):
            if a < b:
                sizes = self.e_hi[a:b] - self.e_lo[a:b] + self.length
                at = _runs(self.e_lo[a:b], sizes)
                yield int(where[a]), np.int64(b - a).tobytes() + B.pack40(self.e_key[a:b]) + self.e_id[a:b].tobytes() + sizes.astype(np.uint8).tobytes() + self.raw[at].tobytes()

    def removed(self, bits: np.ndarray) -> list[tuple]:
        """(id, n_bytes, n_removed, n_spans, kept bytes) of each row; bits: for each entry's strings, met in a smaller id."""
        sizes = self.e_hi - self.e_lo + 1
        offset = np.cumsum(sizes) - sizes
        n = self.c_hi - self.c_lo + 1
        start = _runs(self.c_lo, n)
        found = bits[np.repeat(offset[self.entry_of] - self.c_lo, n) + start] if len(start) else np.zeros(0, bool)
        found = found | np.repeat(self.own[self.c_doc] != self.e_id[self.entry_of], n)
        start = start[found]
        edges = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + self.length, -1)
        gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
        out, seen = [], {}
        for ident, at in self.rows:
            a, b = int(self.edge[at]), int(self.edge[at + 1])
            if ident != self.own[at] and b - a >= self.length:
                out.append((ident, b - a, b - a, 1, b""))
                continue
            if at not in seen:
                lost = gone[a:b]
                seen[at] = (b - a, int(lost.sum()), int((lost & ~np.concatenate([[False], lost[:-1]])).sum()), self.raw[a:b][~lost].tobytes())
            out.append((ident, *seen[at]))
        return out


def refine(texts: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start in texts: the smallest id among starts of equal strings of `length` bytes, by bucket-pointer refinement.

    ids: the id of each start. length from 8 on.
    """
    n = len(texts)
    eight = _loads(texts)
    order = np.argsort(eight, kind="stable")
    ranked = eight[order]
    pointer = np.empty(n, np.int64)
    # A bucket's pointer is the place of its last suffix.
    last = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True)) if n else np.zeros(0, np.int64)
    pointer[order] = np.repeat(last, np.diff(np.concatenate([[-1], last])))
    depth = 8
    sizes = np.bincount(pointer, minlength=n)
    live = np.flatnonzero(sizes[pointer] > 1)
    while depth < length and len(live):
        step = min(depth, length - depth)
        live = live[live + step < n]
        if not len(live):
            break
        pair = pointer[live] * np.int64(n + 1) + pointer[live + step]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        ends = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True))
        counts = np.diff(np.concatenate([[-1], ends]))
        sub = live[order]
        # New pointers lie inside the old bucket: its last place, less what sorts after.
        old = pointer[sub]
        group_end = np.repeat(ends, counts)
        bucket_last = np.flatnonzero(np.append(old[1:] != old[:-1], True))
        after = np.repeat(bucket_last, np.diff(np.concatenate([[-1], bucket_last]))) - group_end
        pointer[sub] = old - after
        live = np.sort(sub[np.repeat(counts > 1, counts)])
        depth += step
    out = ids.copy()
    if depth >= length and len(live):
        where = np.searchsorted(live, starts)
        where[where == len(live)] = 0
        met = live[where] == starts
        p = pointer[starts[met]]
        groups, place = np.unique(p, return_inverse=True)
        least = np.full(len(groups), np.iinfo(np.int64).max)
        np.minimum.at(least, place, ids[met])
        out[met] = least[place]
    return out


def answer_entries(blobs: list[bytes], length: int = LENGTH) -> list[bytes]:
    """For each blob of Batch.entries, one bit for each string of each entry: a smaller id holds it."""
    keys, ids, sizes, texts, counts = [], [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        keys.append(B.unpack40(blob[8:], n))
        ids.append(np.frombuffer(blob, np.int64, n, 8 + 5 * n))
        sizes.append(np.frombuffer(blob, np.uint8, n, 8 + 13 * n).astype(np.int64))
        texts.append(np.frombuffer(blob, np.uint8, -1, 8 + 14 * n))
        counts.append(n)
    key, ident, size, text = map(np.concatenate, (keys, ids, sizes, texts))
    end = np.cumsum(size)
    start = end - size
    content = np.concatenate([_span_hashes(text[a:b], start[i:j] - a, end[i:j] - a) for i, j, a, b in _pieces(start, end)]) if len(start) else np.zeros(0, np.uint64)
    _, first, of = np.unique(content ^ key * _A, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, of, ident)
    rivals_key, rivals = np.unique(key[first], return_inverse=True)
    open_ = np.bincount(rivals, minlength=len(rivals_key))[rivals] > 1
    all_strings = size - length + 1
    seg_strings = all_strings[first]
    seg_at = np.cumsum(seg_strings) - seg_strings
    seg_bits = np.zeros(int(seg_strings.sum()), bool)
    # Strings of distinct segments in buckets that hold several: some whole buckets at a time.
    rest = np.flatnonzero(open_)
    rest = rest[np.argsort(rivals[rest], kind="stable")]
    filled = np.cumsum(size[first[rest]])
    i = 0
    while i < len(rest):
        j = int(np.searchsorted(filled, (filled[i - 1] if i else 0) + CHUNK // 2, "right"))
        j = min(len(rest), max(i + 1, j))
        j = int(np.searchsorted(rivals[rest], rivals[rest[j - 1]], "right"))
        seg = rest[i:j]
        at = first[seg]
        pick = _runs(start[at], size[at])
        base = np.cumsum(size[at]) - size[at]
        n_strings = seg_strings[seg]
        mine = np.repeat(least[seg], n_strings)
        seg_bits[_runs(seg_at[seg], n_strings)] = refine(text[pick], _runs(base, n_strings), mine, length) < mine
        i = j
    # Bits of distinct segments, then of entries.
    bits = seg_bits[_runs(seg_at[of], all_strings)] | np.repeat(ident > least[of], all_strings)
    out, a, i = [], 0, 0
    for n in counts:
        b = a + int(all_strings[i : i + n].sum())
        out.append(np.packbits(bits[a:b]).tobytes())
        a, i = b, i + n
    return out


def _pieces(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first, last + 1, text from, text to) of entries in pieces of about CHUNK bytes."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        yield i, j, int(start[i]), int(end[j - 1])
        i = j


def _open(docs: pa.Table, length: int, q: int) -> Batch:
    return Batch(docs["id"].to_pylist(), docs["body"].to_pylist(), length, q)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, hot: int = HOT, batch_bytes: int = B.BATCH_BYTES, digest: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row: kept are the bytes outside every string of `length` bytes that also
    starts in a document with a smaller id. With digest, kept_sha256 in place of kept.

    A null or empty text has no bytes and keeps none. Rows with the same id are one document: none of them takes from another.
    A null id is larger than any other. An empty table gives an empty table; other columns are not read. A kept text may
    no longer be valid UTF-8, as strings are bytes, so kept is binary.
    """
    spread, labels = B.batched(docs, id_col, text_col, batch_bytes)
    n = len(labels)
    grouped = spread.groupBy("batch")

    def ask(key: tuple, docs: pa.Table) -> pa.Table:
        keys, many, _ = _open(docs, length, q).grams_asked()
        where = B.bucket_of(keys, n)
        cuts = np.flatnonzero(np.diff(where)) + 1
        rows = [(labels[int(where[a])], int(key[0].as_py()), np.int64(b - a).tobytes() + B.pack40(keys[a:b]) + np.packbits(many[a:b]).tobytes()) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]) if a < b]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        blobs = asked["blob"].to_pylist()
        counts = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
        keys = np.concatenate([B.unpack40(b[8:], m) for b, m in zip(blobs, counts)])
        many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -1, 8 + 5 * m), count=m) for b, m in zip(blobs, counts)]).astype(bool)
        _, of = np.unique(keys, return_inverse=True)
        met = np.bincount(of)
        several = met > 1
        several[of[many]] = True
        out, a = [], 0
        for m in counts:
            mine = of[a : a + m]
            out.append(np.packbits(several[mine]).tobytes() + np.packbits(met[mine] > hot).tobytes())
            a += m
        return pa.table({"batch": asked["batch"], "kind": pa.array([1] * len(out), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})

    def contest(docs: pa.Table, replies: pa.Table) -> tuple[Batch, list[tuple[int, bytes]]]:
        batch = _open(docs, length, q)
        keys, _, where = batch.grams_asked()
        sizes = np.bincount(B.bucket_of(keys, n), minlength=n)
        starts = np.cumsum(sizes) - sizes
        shared, is_hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        place = {x: i for i, x in enumerate(labels)}
        rest = []
        for kind, bucket, blob in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["blob"].to_pylist()):
            b = place[bucket]
            if kind == 2:
                rest.append((b, blob))
                continue
            m, a = int(sizes[b]), int(starts[b])
            half = (m + 7) // 8
            raw = np.frombuffer(blob, np.uint8)
            shared[a : a + m] = np.unpackbits(raw[:half], count=m)
            is_hot[a : a + m] = np.unpackbits(raw[half:], count=m)
        batch.contested(shared, is_hot, where)
        return batch, rest

    def send(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        batch, _ = contest(docs, replies)
        rows = list(batch.entries(n)) if len(batch.e_key) else []
        return pa.table({"bucket": pa.array([labels[b] for b, _ in rows], pa.int32()), "batch": pa.array([key[0].as_py()] * len(rows), pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

    def sort(key: tuple, sent: pa.Table) -> pa.Table:
        out = answer_entries(sent["blob"].to_pylist(), length)
        return pa.table({"batch": sent["batch"], "kind": pa.array([2] * len(out), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})

    def finish(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        batch, rest = contest(docs, replies)
        strings = batch.e_hi - batch.e_lo + 1
        where = B.bucket_of(batch.e_key, n)
        bits = np.zeros(int(strings.sum()), bool)
        at = np.cumsum(strings) - strings
        for b, blob in rest:
            i, j = np.searchsorted(where, [b, b + 1])
            m = int(strings[i:j].sum())
            bits[at[i] : at[i] + m] = np.unpackbits(np.frombuffer(blob, np.uint8), count=m)
        rows = batch.removed(bits)
        kept = [hashlib.sha256(r[4]).hexdigest() for r in rows] if digest else [r[4] for r in rows]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        return pa.table(dict(zip(["id", "n_bytes", "n_removed", "n_spans"], cols)) | {"kept": pa.array(kept, pa.string() if digest else pa.binary())})

    asked = grouped.applyInArrow(ask, "bucket int, batch int, blob binary")
    first = asked.groupBy("bucket").applyInArrow(answer, "batch int, kind int, bucket int, blob binary")
    sent = grouped.cogroup(first.groupBy("batch")).applyInArrow(send, "bucket int, batch int, blob binary")
    second = sent.groupBy("bucket").applyInArrow(sort, "batch int, kind int, bucket int, blob binary")
    name = "kept_sha256" if digest else "kept"
    out = grouped.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(finish, f"id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.select(F.nullif("id", F.lit((1 << 63) - 1)).alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").alias(name))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
