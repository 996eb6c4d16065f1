"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last eight bytes cuts texts into chunks, so equal passages are cut alike wherever they stand. Each
distinct chunk is encoded once per task (a store of bounded size keeps the encodings; emptying it costs time, never
results). A cut may fall inside a word, so each join is repaired: the text between the nearest sure borders on both sides
is encoded again and replaces the tokens between them. A sure border is a blank between two visible ASCII characters: the
vocabulary's splitting pattern starts a new piece there whatever stands around it, so the tokens left and right of it
agree with those of the whole text, and the repair goes on outwards until it finds one. The result is the encoding of the
whole text, token for token.

The plan is one Arrow map over the scan: no shuffle, no state beyond the chunk store.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import table, text_or_empty, tokenizer_file

#: The published splitting pattern of byte-level vocabularies that ask for it (use_regex).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STORE_BYTES = 24 << 20
SURE = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def vocabulary_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(id by token, id by special token) of a byte-level BPE vocabulary file; a file of another kind is refused.

    In such files a byte is a printable character: itself where it is one, else the next of those from 256 on. Ids follow the
    merges, so a token's id is its rank.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"] or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or file["normalizer"] or model.get("ignore_merges"):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: ids don't follow the merges")
    return ranks, special


class ChunkEncoder:
    """Encodes texts chunk by chunk; `cut_bits` sets the mean chunk length (2**cut_bits bytes)."""

    def __init__(self, path: str, cut_bits: int = 9, store_bytes: int = STORE_BYTES):
        import tiktoken

        ranks, special = vocabulary_of(path)
        self.coder = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_ids = special
        self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.cut_bits, self.store_bytes = cut_bits, store_bytes
        self.store: dict[bytes, np.ndarray] = {}
        self.held = self.hits = self.misses = 0

    def _plain(self, piece: bytes) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(piece.decode("utf-8")), np.uint32)

    def cuts(self, data: bytes) -> list[int]:
        """Where chunks start, by the hash of the eight bytes before; never inside a character."""
        n = len(data)
        if n < 32:
            return []
        raw = np.frombuffer(data, np.uint8)
        last8 = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view("<u8").ravel()
        mixed = (last8 * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.cut_bits)
        at = np.flatnonzero(mixed == 0) + 8
        at = at[at < n]
        return at[(raw[at] & 0xC0) != 0x80].tolist()

    def _chunk(self, piece: bytes) -> np.ndarray:
        found = self.store.get(piece)
        if found is None:
            self.misses += 1
            found = self._plain(piece)
            self.held += len(piece) + 4 * len(found) + 200
            if self.held > self.store_bytes:
                self.store.clear()
                self.held = len(piece)
            self.store[piece] = found
        else:
            self.hits += 1
        return found

    def _segment(self, data: bytes) -> np.ndarray:
        bounds = [0, *self.cuts(data), len(data)]
        chunks = [self._chunk(data[a:b]) for a, b in zip(bounds, bounds[1:])]
        if len(chunks) == 1:
            return chunks[0]
        # [start, end) of each stretch to encode again; stretches that meet are one.
        torn: list[list[int]] = []
        for cut in bounds[1:-1]:
            if torn and cut < torn[-1][1]:
                continue
            if SURE.match(data, cut):
                continue
            left = self._border_before(data, cut, torn[-1][1] if torn else 0)
            found = SURE.search(data, cut)
            right = found.start() if found else len(data)
            if torn and left <= torn[-1][1]:
                torn[-1][1] = right
            else:
                torn.append([left, right])
        if not torn:
            return np.concatenate(chunks)
        ids = np.concatenate(chunks)
        ends = np.cumsum(self.width[ids])
        out, at = [], 0
        for left, right in torn:
            a = int(np.searchsorted(ends, left, "right"))
            b = int(np.searchsorted(ends, right, "left")) + 1
            assert (left == 0 or ends[a - 1] == left) and ends[b - 1] == right, "a sure border is not a token border"
            out += [ids[at:a], self._plain(data[left:right])]
            at = b
        out.append(ids[at:])
        return np.concatenate(out)

    @staticmethod
    def _border_before(data: bytes, cut: int, floor: int) -> int:
        """The last sure border before cut, or floor."""
        at = cut
        while True:
            at = data.rfind(b" ", floor, at)
            if at <= floor:
                return floor
            if SURE.match(data, at):
                return at

    def encode(self, text: str) -> np.ndarray:
        parts = self.special.split(text) if self.special else [text]
        out = [np.array([self.special_ids[x]], np.uint32) if k % 2 else self._segment(x.encode()) for k, x in enumerate(parts)]
        return np.concatenate(out) if len(out) > 1 else out[0]

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def _coder(path: str, cut_bits: int) -> ChunkEncoder:
    """One per worker process."""
    key = (path, cut_bits)
    if getattr(_coder, "key", None) != key:
        _coder.key, _coder.value = key, ChunkEncoder(path, cut_bits)
    return _coder.value


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", cut_bits: int = 9, digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids) for each row; with digest, (id, n_tokens, ids_sha256, decoded_sha256) after a decode.

    A null or empty text has no ids. Repeated rows are encoded alike, a null id is carried. A special token of the vocabulary in a
    text is its id. An empty table gives an empty table; other columns are not read. The longest text bounds a
    task's memory, at about ten times its bytes.
    """
    path = tokenizer_file(vocabulary)
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, cut_bits)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [coder.encode(x.as_py()) for x in part.column(1)]
                n = pa.array([len(x) for x in ids], pa.int64())
                if digest:
                    cols = [
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ]
                else:
                    cols = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                names = ["id", "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digest else ["ids"])
                yield pa.RecordBatch.from_arrays([part.column(0), n, *cols], names)

    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, text) from encode_texts' (id, n_tokens, ids); null ids decode to an empty text."""
    path = tokenizer_file(vocabulary)
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, 9)
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], np.uint32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
