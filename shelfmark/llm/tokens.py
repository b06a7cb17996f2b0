"""Token ids and token counts of whole texts with the public tokenizers, in Arrow functions.

A text is cut only where the tokenizer's own pre-tokenizer always cuts: between a character that is not white space and
ASCII white space after it. No alternative of a byte-level pattern reaches over such a place, and no added token contains
white space, so ids of the parts joined are ids of the whole. The parts of many texts are found and told apart by 64-bit
hashes at once; those that a worker has not met are encoded in batches of a bounded number of bytes, and what is kept of
them is bounded in bytes too.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, tidy, whole_text
from shelfmark.llm.hashing import CHUNK_BYTES, runs_by_bytes, spans_hashed

BYTE_BPE = "byte_bpe_50k.json"
#: What the pattern of byte-level tokenizers takes as white space: of one byte in UTF-8, and of more.
ONE_BYTE_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDE_SPACE_BYTES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SAFE_CUT = re.compile(rb"(?<![\t-\r ])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)[\t-\r ]")
_END = b"\xff"  # between texts; no UTF-8 has it

BATCH_BYTES = 1 << 18  # of parts that are encoded at once
KEEP_BYTES = 32 << 20  # of ids of parts that a worker has met


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


def direct_bpe(model: dict):
    """The merges of a byte-level file in tiktoken, which gives the same ids faster, and each id's length in bytes; None where the file is of another kind.

    That holds where nothing normalises, the usual pattern cuts words, and merged entries are numbered in merge order.
    """
    bpe, pre = model["model"], model.get("pre_tokenizer") or {}
    if model.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if bpe.get("type") != "BPE" or any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    import public_tokenizers
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"] for t in model["added_tokens"]}
    vocab, merges = bpe["vocab"], [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
    merged = [vocab["".join(m)] for m in merges]
    if len(vocab) - len(added & vocab.keys()) != 256 + len(merges) or merged != sorted(merged) or max((vocab[c] for c in byte), default=0) > min(merged, default=256):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        widths[i] = len(token)
    return tiktoken.Encoding("direct", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def safe_pieces(text: bytes, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Pieces of a text of about `most` bytes, cut where a part begins; without such a place a piece is longer."""
    at = 0
    while len(text) - at > most:
        cut = None
        for reach in (1 << 10, 1 << 14, most - 1):  # the last place before the limit
            for cut in SAFE_CUT.finditer(text, at + most - min(reach, most - 1), at + most):
                pass
            if cut:
                break
        cut = cut or SAFE_CUT.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@dataclass
class Parts:
    """Parts of texts: bytes from starts to before ends of `joined`, their hashes, and of each text the number of its first part, then of all."""

    joined: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    plain: np.ndarray  # begins with one-byte white space, and ends with something else


def parts_of(texts: list[bytes]) -> Parts:
    joined = _END.join(texts) + _END
    raw = np.frombuffer(joined, np.uint8)
    ends_at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    space = ONE_BYTE_SPACE[raw]
    begins = np.empty(len(raw), bool)
    begins[0] = True
    np.greater(space[1:], space[:-1], out=begins[1:])
    wide = np.fromiter((m.end() for m in WIDE_SPACE_BYTES.finditer(joined)), np.int64)
    begins[wide] = False  # white space goes on after wide white space
    begins[ends_at[:-1] + 1] = True
    begins[ends_at] = True
    marks = np.flatnonzero(begins)
    real = raw[marks] != 0xFF
    starts, ends = marks[real], np.r_[marks[1:], len(raw)][real]
    first = np.r_[np.searchsorted(starts, np.r_[0, ends_at[:-1] + 1]), len(starts)]
    plain = space[starts] & ~space[ends - 1]
    if len(wide):
        plain &= ~np.isin(ends, wide)
    return Parts(joined, starts, ends, spans_hashed(raw, starts, ends)[0], first, plain)


class JsonEncoder:
    """Ids by the tokenizers library, special strings in texts as by its default, nothing added."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.path, self.added = path, [t["content"] for t in model["added_tokens"]]
        direct = direct_bpe(model)
        self.direct, self.widths = direct if direct else (None, None)
        self._forget()

    @cached_property
    def tokenizer(self):
        """The library's own, which plain texts of byte-level files don't need."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def _forget(self) -> None:
        self.hashes, self.offsets, self.sizes, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encoded(self, parts: Parts, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The wanted parts in the order in which they were encoded, how many ids each has, and the ids; a batch of them is one call of the library."""
        special = np.zeros(len(wanted), bool)
        for a in self.added:
            if a.encode() in parts.joined:
                at = np.fromiter((m.start() for m in re.finditer(re.escape(a.encode()), parts.joined)), np.int64)
                special |= np.searchsorted(at, parts.starts[wanted]) < np.searchsorted(at, parts.ends[wanted])
        by_merges = ~special if self.direct is not None else np.zeros(len(wanted), bool)
        together = by_merges & parts.plain[wanted]
        order, sizes, flat = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for kind, group in enumerate((wanted[together], wanted[by_merges & ~together], wanted[~by_merges])):
            length = parts.ends[group] - parts.starts[group]
            batch = np.cumsum(length) // BATCH_BYTES
            for some in np.split(group, np.flatnonzero(np.diff(batch)) + 1) if len(group) else ():
                cut = [parts.joined[a:b] for a, b in zip(parts.starts[some].tolist(), parts.ends[some].tolist())]
                if kind == 0:  # the pattern cuts plain parts where they meet
                    ids = [self.direct.encode_to_numpy(b"".join(cut).decode())]
                    until = np.searchsorted(np.cumsum(self.widths[ids[0]]), np.cumsum(parts.ends[some] - parts.starts[some])) + 1
                    many = np.diff(until, prepend=0)
                elif kind == 1:
                    ids = [np.asarray(self.direct.encode_ordinary(p.decode()), np.uint32) for p in cut]
                    many = np.fromiter(map(len, ids), np.int64, len(ids))
                else:
                    ids = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([p.decode() for p in cut], add_special_tokens=False)]
                    many = np.fromiter(map(len, ids), np.int64, len(ids))
                order.append(some)
                sizes.append(many)
                flat += ids
        return np.concatenate(order), np.concatenate(sizes), np.concatenate(flat)

    def _numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each part of the texts its number among what is kept, and of each text the number of its first part, then of all."""
        parts = parts_of(texts)
        unique, at, back = np.unique(parts.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == unique[inside]
        if not known.all():
            if self.hashes.nbytes * 3 + self.flat.nbytes > KEEP_BYTES:  # what is not met here goes
                kept = place[known]
                sizes = self.sizes[kept]
                self.flat = self._gathered(kept)
                self.hashes, self.sizes, self.offsets = self.hashes[kept], sizes, np.cumsum(sizes) - sizes
            order, sizes, flat = self._encoded(parts, at[~known])
            hashes, offsets = parts.hashes[order], len(self.flat) + np.cumsum(sizes) - sizes
            by_hash = np.argsort(hashes)
            spot = np.searchsorted(self.hashes, hashes[by_hash])
            self.hashes, self.sizes, self.offsets = (np.insert(old, spot, new[by_hash]) for old, new in ((self.hashes, hashes), (self.sizes, sizes), (self.offsets, offsets)))
            self.flat = np.concatenate([self.flat, flat])
            place = np.searchsorted(self.hashes, unique)
        return place[back], parts.first

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of parts one after another."""
        sizes = self.sizes[numbers]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.offsets[numbers] - before, sizes) + np.arange(sizes.sum())]

    def _runs(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Pieces of texts in runs of about CHUNK_BYTES, each with its text's number."""
        pieces: list[tuple[int, bytes]] = []
        for i, t in enumerate(texts):
            pieces += [(i, t)] if len(t) <= CHUNK_BYTES else [(i, p) for p in safe_pieces(t)]
        for a, b in runs_by_bytes([p for _, p in pieces]):
            yield np.array([i for i, _ in pieces[a:b]]), [p for _, p in pieces[a:b]]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(texts), np.int64)
        for owner, run in self._runs(texts):
            numbers, first = self._numbered(run)
            total = np.r_[0, np.cumsum(self.sizes[numbers], dtype=np.int64)]
            np.add.at(out, owner, total[first[1:]] - total[first[:-1]])
        return out

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held: list[np.ndarray] = []
        at = 0
        for owner, run in self._runs(texts):
            numbers, first = self._numbered(run)
            flat = self._gathered(numbers)
            total = np.r_[0, np.cumsum(self.sizes[numbers], dtype=np.int64)]
            for i, a, b in zip(owner.tolist(), total[first[:-1]].tolist(), total[first[1:]].tolist()):
                if i != at:
                    yield np.concatenate(held)
                    held, at = [], i
                held.append(flat[a:b])
        if held:
            yield np.concatenate(held)

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """For each text its ids as parts of little-endian unsigned 32-bit numbers."""
        for ids in self.ids([t.encode() for t in texts]):
            yield [ids.astype("<u4").tobytes()]


class PieceEncoder:
    """Ids by the sentencepiece library; it normalises over white space, so texts are not cut."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for a, b in runs_by_bytes(texts, BATCH_BYTES):
            for ids in self.model.encode([t.decode() for t in texts[a:b]], num_threads=1):
                yield np.asarray(ids, np.uint32)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, self.ids(texts)), np.int64, len(texts))

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        for ids in self.ids([t.encode() for t in texts]):
            yield [ids.astype("<u4").tobytes()]


_ENCODERS: dict[str, JsonEncoder | PieceEncoder] = {}


def encoder(name: str) -> JsonEncoder | PieceEncoder:
    """One encoder for each tokenizer and worker."""
    path = tokenizer_path(name)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, tokenizer: str = BYTE_BPE, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs.

    Null and empty texts have 0 tokens; a text of any length is cut into safe pieces; repeated rows and null keys give a row
    each; other columns are not read, so their names may clash with the result's. An empty table gives no rows. Only
    lengths leave the Arrow function.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(encode.counts(texts), pa.int64())], names=[key, "n_bytes", "n_tokens"])

    counted = docs.select(F.col(key), whole_text(text).alias("_text")).mapInArrow(tidy(lengths, keep_tokens=True), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
