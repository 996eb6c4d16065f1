"""Asking the whole corpus about content, batch by batch.

Texts are dealt into batches by their id's hash. A batch asks about many hashes at once: sorted, distinct, packed into one
blob a bucket of the hash space, so what is sent of a hash that a third of all texts hold is one entry a batch. A bucket's
task sees all entries of its hashes and answers each blob in its own order. Questions and answers are thus two shuffles of
packed rows; texts are shuffled once, and every later pass over the batches reuses that exchange.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import partitions

BATCH_BYTES = 4 << 20
#: Up to so many batches their labels are dealt evenly by a literal list; beyond, chance deals evenly enough.
EVEN_BATCHES = 4096


def _murmur_int(x: int, seed: int = 42) -> int:
    """Spark's hash of an int, which hash partitioning takes."""
    m = 0xFFFFFFFF
    k = (x * 0xCC9E2D51) & m
    k = ((k << 15) | (k >> 17)) & m
    h = seed ^ ((k * 0x1B873593) & m)
    h = ((((h << 13) | (h >> 19)) & m) * 5 + 0xE6546B64) & m
    h ^= 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & m
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def even_labels(n: int, each: int) -> list[int]:
    """n * each labels of which hash partitioning over n puts `each` into every partition."""
    free, out, x = {i: each for i in range(n)}, [], 0
    while free:
        at = _murmur_int(x) % n
        if at in free:
            out.append(x)
            free[at] -= 1
            if not free[at]:
                del free[at]
        x += 1
    return sorted(out)


def batched(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, list[int]]:
    """((batch, id, body) with body the text's bytes, the labels of the buckets). Batches and buckets grow with the bytes. Null ids come last, as the largest long."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))), F.lit(0))).first()[0]
    n = partitions(docs.sparkSession)
    each = max(1, round(int(size) / batch_bytes / n))
    labels = even_labels(n, each)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    place = F.pmod(F.xxhash64(ident), F.lit(len(labels))).cast("int")
    label = F.element_at(F.array(*map(F.lit, labels)), place + 1) if len(labels) <= EVEN_BATCHES else place
    return docs.select(label.alias("batch"), ident.alias("id"), body.alias("body")), even_labels(n, max(2, each))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket's place, by the high half of a 64-bit key: ascending with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pack40(keys: np.ndarray) -> bytes:
    """The low five bytes of each key: with the bucket, enough to tell keys apart."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8, 5 * n).reshape(n, 5)
    return out.view("<u8").ravel()
