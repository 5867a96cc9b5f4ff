"""Token ids as flat binary shards.

A shard is three files: ``.bin`` (ids, unsigned 16 bit where the vocabulary
allows it, else 32), ``.idx`` (64-bit offsets, one more than there are
documents) and ``.ids`` (64-bit document ids, with a count of leading null ids
before them). Shards follow the order of ids; a shard's base is the sum of the
lengths of the shards before it, so readers address any document without
scanning. Each file is written under a name of its attempt and then renamed, so
a repeated task replaces its own output.

Cases: null text counts as empty (one end id); null ids come first; repeated
rows are written each; rows of equal id stand in order of a hash of the text.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts, scratch_dir, tidy

END = 2
#: MB of input in one shard.
SHARD_MB = 256
#: Slots of an encoder's memo (14 bytes each); at ``FULL`` words, or as many ids as slots times 4, it starts anew.
SLOTS = 1 << 20
FULL = SLOTS * 6 // 10
#: Characters of text whose words are looked up together, and of new words that the library encodes at once.
LOOK_UP, AT_ONCE = 1 << 19, 1 << 16
#: White space of the pre-tokenizer's pattern (Unicode White_Space).
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A whole run of Latin letters: nothing after it could still belong to it, or change it.
_LATIN = "[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f]++(?![\\xaa\\xb5\\xba\\u0180-\\U0010ffff])"
#: Pieces that the merges never cross: a run of letters, or what stands between two white spaces, with one
#: leading space where that belongs to it; or a run of white space.
_SPACED = re.compile(f" ?{_LATIN}| ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_PLAIN = re.compile(f"{_LATIN}|[^{_S}]+")


class Encoder:
    """A tokenizer with a memo of words: an open table of 64-bit hashes beside one pool of ids, of fixed size.

    ``spaced``: whether a word's leading space belongs to it (byte-level BPE);
    else white space yields no ids. Either way pre-tokenization never crosses
    the pieces, so encoding them one by one gives the ids of the whole text.
    The vocabulary's special tokens are pieces of their own: the library cuts
    them out before it looks at anything else.
    Words that are new are joined and encoded as one text, which is split again
    at the ids that only a word's start (or the mark between words) can have.
    """

    MARK = "~"

    def __init__(self, path: str, spaced: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaced = spaced
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError(f"{path}: special tokens that depend on what surrounds them")
        self.special = {t.content for t in added}
        self.between = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})").split if self.special else None
        self.words = (_SPACED if spaced else _PLAIN).findall
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        mark = self._ids(self.MARK)
        if spaced:
            self.starts[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        elif len(mark) == 1:
            self.starts[mark[0]] = True
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; those between two special tokens know nothing of what is beyond."""
        if not self.between:
            return self.words(text)
        parts_ = self.between(text)
        if len(parts_) == 1:
            return self.words(text)
        return [w for i, part in enumerate(parts_) for w in ([part] if i % 2 else self.words(part))]

    def _fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words that the memo lacks."""
        out: list[bytes] = []
        size, first = 0, 0
        for i, w in enumerate(words):
            size += len(w)
            if size >= AT_ONCE:
                out += self._encoded(words[first : i + 1])
                size, first = 0, i + 1
        return out + self._encoded(words[first:])

    def _encoded(self, words: list[str]) -> list[bytes]:
        if self.spaced:
            joins = [w for w in words if w[0] == " " and len(w) > 1 and w[1] not in " \t\n\r\x0b\x0c"]
            text, skip = "".join(joins), 0
        else:
            joins = [w for w in words if self.MARK not in w and w not in self.special]
            text, skip = "".join(f"{self.MARK} {w} " for w in joins), 1
        found: dict[str, bytes] = {}
        if len(joins) > 1:
            ids = np.array(self._ids(text), "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(joins):
                raw, ends = ids.tobytes(), np.append(at[1:], len(ids)).tolist()
                found = {w: raw[4 * (a + skip) : 4 * b] for w, a, b in zip(joins, at.tolist(), ends)}
        rest = [w for w in words if w not in found]
        if rest:
            found |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False))}
        return [found[w] for w in words]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free slot where its search ends."""
        at = keys & (SLOTS - 1)
        go = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != 0))
        while len(go):
            at[go] = (at[go] + 1) & (SLOTS - 1)
            k = self.keys[at[go]]
            go = go[(k != keys[go]) & (k != 0)]
        return at

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        """Put words that the memo lacks into it; the keys differ."""
        ids = self._fresh(words)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        start = self.used + np.cumsum(size) - size
        self._append(np.frombuffer(b"".join(ids), "<u4"))
        todo = np.arange(len(keys))
        while len(todo):
            at = self._slot(keys[todo])
            slots, one = np.unique(at, return_index=True)  # of keys that want one slot, the first has it
            own = todo[one]
            self.keys[slots], self.start[slots], self.size[slots] = keys[own], start[own], size[own]
            todo = np.delete(todo, one)
        self.known += len(keys)

    def _append(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(1 << 18, self.used // 2 + len(ids)), self.pool.dtype)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint32)
        self.pool = np.zeros(1 << 18, "<u2" if len(self.starts) <= 1 << 16 else "<u4")
        self.known = self.used = 0

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, without an end id."""
        pieces: list[str] = []
        ends: list[int] = []
        size = 0
        for text in texts:
            pieces += self.cut(text or "")
            ends.append(len(pieces))
            size += len(text or "")
            if size >= LOOK_UP:
                yield from self._joined(pieces, ends)
                pieces, ends, size = [], [], 0
        yield from self._joined(pieces, ends)

    def _joined(self, pieces: list[str], ends: list[int]) -> Iterator[bytes]:
        """The ids of each text, whose pieces end at ``ends``; pieces go through the memo in runs that it can hold."""
        runs = [self._looked_up(pieces[i : i + FULL // 2]) for i in range(0, len(pieces), FULL // 2)]
        ids = b"".join(x.tobytes() for x, _ in runs)
        stop = np.cumsum(np.concatenate([[0], *[n for _, n in runs]]))
        done = 0
        for e in stop[ends].tolist():
            yield ids[4 * done : 4 * e]
            done = e

    def _looked_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        keys = np.fromiter(map(hash, pieces), np.int64, len(pieces))
        keys[keys == 0] = 1
        at = self._slot(keys)
        new = np.flatnonzero(self.keys[at] == 0)
        if len(new):
            if self.known + len(new) > FULL or self.used > 4 * SLOTS:
                self.forget()
                new = np.arange(len(keys))
            fresh, first = np.unique(keys[new], return_index=True)
            self._learn([pieces[i] for i in new[first].tolist()], fresh)
            at = self._slot(keys)
        start, size = self.start[at].astype(np.int64), self.size[at].astype(np.int64)
        stop = np.cumsum(size)
        return self.pool[np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)].astype("<u4"), size


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each worker process."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def filesystem(uri: str):
    """The file system and path of a folder that all workers share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri) if uri.startswith("file:") else uri if "://" in uri else f"file://{uri}")


def write_shard(fsys, stem: str, rows: Iterable[tuple[int | None, bytes]], dtype: str) -> tuple[int, int]:
    """``rows``: id and ids as ``dtype`` of each document, written as they come; all three files appear whole or not at all.

    Returns the number of documents and of ids; without documents there are no files.
    """
    rows = iter(rows)
    head = next(rows, None)
    if head is None:
        return 0, 0
    temp, ids, sizes = f"{stem}.{uuid.uuid4().hex}.tmp", array("q"), array("q")
    nulls = 0
    with fsys.open_output_stream(f"{temp}.bin") as out:
        for i, blob in chain([head], rows):
            nulls += i is None
            ids.append(i or 0)
            sizes.append(len(blob) // np.dtype(dtype).itemsize)
            out.write(blob)
    offsets = np.zeros(len(sizes) + 1, "<u8")
    np.cumsum(np.frombuffer(sizes, np.int64), out=offsets[1:])
    for ext, chunks in {"idx": [offsets.tobytes()], "ids": [struct.pack("<Q", nulls), np.frombuffer(ids, np.int64).astype("<i8").tobytes()]}.items():
        with fsys.open_output_stream(f"{temp}.{ext}") as out:
            for c in chunks:
                out.write(c)
    for ext in ("bin", "idx", "ids"):
        fsys.move(f"{temp}.{ext}", f"{stem}.{ext}")
    return len(ids), int(offsets[-1])


def read_shard(fsys, stem: str, dtype: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc id, start within the shard, ids); mapped where the file system is local."""

    def view(ext: str) -> np.ndarray:
        name = f"{stem}.{ext}"
        buf = (pa.memory_map(name) if fsys.type_name == "local" else fsys.open_input_file(name)).read_buffer()
        return np.frombuffer(buf, np.uint8)

    raw, idx, head = view("bin"), view("idx").view("<u8"), view("ids")
    tokens, nulls, ids = raw.view(dtype), int(head[:8].view("<u8")[0]), head[8:].view("<i8")
    for k in range(len(ids)):
        a, b = int(idx[k]), int(idx[k + 1])
        yield (None if k < nulls else int(ids[k])), a, tokens[a:b]


def write(docs: DataFrame, vocab: str, folder: str, spaced: bool = True, wide: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as shards in ``folder``; returns (shard, n_docs, n_tokens), read back from nothing but counts.

    Rows are dealt in ranges of id and sorted inside each; a shard is encoded
    and written by one task, a document at a time.
    """
    dtype = "<u4" if wide else "<u2"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(parts(docs, SHARD_MB), "id", "h").sortWithinPartitions("id", "h")

    @tidy
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(vocab, spaced), TaskContext.get().partitionId()
        fsys, root = filesystem(folder)
        fsys.create_dir(root, recursive=True)
        end = np.array([END], "<u4").tobytes()

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for b in batches:
                for i, x in zip(b.column("id").to_pylist(), enc.encode(t.as_py() for t in b.column("t"))):
                    yield i, np.frombuffer(x + end, "<u4").astype(dtype).tobytes()

        docs_, n = write_shard(fsys, f"{root}/{shard:08d}", rows(), dtype)
        if docs_:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [docs_], "n_tokens": [n]})

    return rows.select("id", "t").mapInArrow(save, "shard long, n_docs long, n_tokens long")


def read(shards: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; ``shards``: (shard, base), base being the tokens before it."""
    dtype = "<u4" if wide else "<u2"

    @tidy
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fsys, root = filesystem(folder)
        for b in batches:
            for shard, base in zip(b["shard"], b["base"]):
                found = ((i, base + a, len(t), zlib.crc32(t.astype("<u4").tobytes())) for i, a, t in read_shard(fsys, f"{root}/{shard:08d}", dtype))
                while rows := list(islice(found, 10_000)):
                    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                    out["doc_id"] = out["doc_id"].astype("Int64")
                    yield out

    rows = shards.select("shard", "base").repartitionByRange(max(1, shards.count()), "shard")
    return rows.mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocab: str, folder: str | None = None, spaced: bool = True, wide: bool = False) -> tuple[DataFrame, str]:
    """Write, take prefix sums of the shards' lengths (a table of one row for each ``SHARD_MB`` of input), and read back."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    sizes = materialize(write(docs, vocab, folder, spaced, wide), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return read(shards, folder, wide), folder
