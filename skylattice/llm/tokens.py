"""Token ids in compressed files: a wavelet matrix per shard.

Documents are dealt to ranges of ascending doc_id; each task tokenises its range and writes shards of at most
``shard_tokens`` ids (a longer document has a shard of its own). A shard file holds one bit-plane per bit of the
largest id, from the highest: plane l stores bit l of all ids in the order in which the planes above have stably
partitioned them, zeros first, with the number of ones before each block of ``BLOCK`` bits. ``WaveletMatrix`` answers
access, rank, select, count and occurrence lookup from the file alone. Planes are packed bits in chunks of
``CHUNK_BYTES``, each under Zstandard by itself: a lookup unpacks a chunk or two of each plane, not the shard. Files are
named by range and number, written under another name and renamed, so that a repeated task replaces its own files.
A table of the shards, in order, gives each shard its first position in the corpus; reading goes through Spark's
binary files.

Texts are encoded as by a plain call of the tokenizers library: a special token's string in a text gives its id, unless
``special_as_text``. Null and empty texts give the end id alone. A very long text is one document of a shard of its own.
Equal ids are ordered by a hash of the text, and equal rows are encoded each. A null doc_id comes first; ids that aren't
integers are an error, since the files hold integers. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.llm.arrow import map_batches
from skylattice.storage import join_small, materialise, new_path, partitions_for

END_ID = 0
SHARD_TOKENS = 1 << 20
BLOCK = 4096
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 8 << 20
#: Words, and bytes of words and of their ids, that an encoder remembers.
KNOWN_WORDS, KNOWN_BYTES = 1 << 20, 32 << 20
#: Bytes of a plane that are packed together.
CHUNK_BYTES = 1 << 13
MAGIC = b"WVM2"
_HEAD = struct.Struct("<4sIQQ")
_AMBIGUOUS = re.compile(r"\s\s(?:\s|\Z)")
_encoders: dict[tuple, WordEncoder] = {}


class Rows:
    """Ids in rows of different sizes."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None):
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes) - sizes if starts is None else starts

    @classmethod
    def of(cls, parts: list[np.ndarray], kind: np.dtype) -> Rows:
        return cls(np.concatenate([np.zeros(0, kind), *parts]), np.array([len(x) for x in parts], np.int64))

    @classmethod
    def joined(cls, tables: list[Rows]) -> Rows:
        base = np.cumsum([0, *(len(t.flat) for t in tables)])
        return cls(np.concatenate([t.flat for t in tables]), np.concatenate([t.sizes for t in tables]), np.concatenate([t.starts + b for t, b in zip(tables, base)]))

    def gather(self, rows: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """The ids of the given rows, one after another; a step at a time, since the places take 8 bytes an id."""
        parts = [self.flat[:0]]
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            sizes = self.sizes[some]
            places = np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes)
            places += np.arange(len(places))
            parts.append(self.flat[places])
        return np.concatenate(parts)


class WordEncoder:
    """The tokenizers library, called once for each distinct word of a slice of texts that isn't remembered from slices
    before; when too many are, those of the slice replace them.

    A byte-level pre-tokenizer joins a space to what follows it and looks across white space only within a run of it. So
    a text can be encoded word by word, where words end before a space and before a line feed: the first kind gets its
    space, the second begins with its line feed. Runs of three, and of two at the end of a text, are cut otherwise: texts
    that have one are encoded as a whole, and so are texts that hold the string of a special token, unless these are
    ordinary text. Words of letters alone are one piece, which a second tokenizer with the same model takes as it is;
    marks after letters are a piece of their own."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # words are ordinary text; see _plain
        self.by_piece = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.by_piece.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # how a byte-level vocabulary writes the bytes: printable ones as themselves, the others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.space = space = self.letters[ord(" ")]
        self.letters[ord(" ")] = " "
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        self.spaced = np.zeros(1 << self.bits, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith(space)
        self.known, self.known_rows = pa.array([], pa.string()), Rows.of([], self.kind)

    def _ids(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> np.ndarray:
        """A whole text as the library encodes it."""
        self.tokenizer.encode_special_tokens = not self.special
        try:
            return self._ids(self.tokenizer, [text])[0]
        finally:
            self.tokenizer.encode_special_tokens = True

    def _words(self, tokenizer, text: str, n: int, skip: int = 0) -> Rows:
        """Rows of ids of n words in a text, each of which begins with a space; ``skip``: leave out so many first ids."""
        found = self._ids(tokenizer, [text])[0] if n else np.zeros(0, self.kind)
        starts = np.flatnonzero(self.spaced[found])
        if len(starts) != n:
            raise ValueError("words can't be told apart in this vocabulary")
        return Rows(found, np.diff(np.append(starts, len(found))) - skip, starts + skip)

    def _spelled(self, words: pa.Array) -> str:
        """Words as the vocabulary writes them, with spaces between."""
        return " ".join(words.to_pylist()).encode().decode("latin-1").translate(self.letters)

    def _distinct(self, words: pa.Array, odd: np.ndarray) -> Rows:
        """A row of ids for each distinct word."""
        mask = lambda m: m.to_numpy(zero_copy_only=False)
        line = ~odd & mask(pc.starts_with(words, "\n"))
        bare = pc.if_else(pa.array(line), pc.utf8_slice_codeunits(words, 1), words)
        core = pc.utf8_rtrim(bare, MARKS)
        letters = mask(pc.utf8_is_alpha(core)) & ~odd
        marked = letters & mask(pc.not_equal(core, bare))
        spaced, after = core.filter(pa.array(letters & ~line)).dictionary_encode(), core.filter(pa.array(letters & line)).dictionary_encode()
        ends = zip(bare.filter(pa.array(marked)).to_pylist(), pc.utf8_length(core.filter(pa.array(marked))).to_pylist())
        marks = pa.array([w[n:] for w, n in ends], pa.string()).dictionary_encode()
        others, strange = words.filter(pa.array(~letters & ~odd & ~line)), words.filter(pa.array(odd | line & ~letters))
        own = [x if x.startswith("\n") else " " + x for x in strange.to_pylist()]
        tables = [
            self._words(self.by_piece, self._pieces(spaced.dictionary), len(spaced.dictionary)),
            self._words(self.by_piece, self._apart(after.dictionary), len(after.dictionary), skip=1),
            self._words(self.tokenizer, " " + " ".join(others.to_pylist()), len(others)),
            Rows.of(self._ids(self.tokenizer, own), self.kind),
            Rows.of(self._ids(self.tokenizer, marks.dictionary.to_pylist()), self.kind),
            Rows.of(self._ids(self.tokenizer, ["\n"]), self.kind),
        ]
        base = np.cumsum([0, *(len(t.sizes) for t in tables)])
        first = np.zeros(len(words), np.int64)
        first[letters & ~line] = base[0] + spaced.indices.to_numpy()
        first[letters & line] = base[1] + after.indices.to_numpy()
        first[~letters & ~odd & ~line] = base[2] + np.arange(len(others))
        first[odd | line & ~letters] = base[3] + np.arange(len(strange))
        feed = letters & line
        n_parts = 1 + feed.astype(np.int64) + marked
        at = np.cumsum(n_parts) - n_parts
        parts = np.repeat(first, n_parts)
        parts[at[feed]] = base[5]
        parts[at[marked] + feed[marked] + 1] = base[4] + marks.indices.to_numpy()
        pieces = Rows.joined(tables)
        per_part = pieces.sizes[parts]
        return Rows(pieces.gather(parts), np.add.reduceat(per_part, at) if len(words) else per_part)

    def _remembered(self, words: pa.Array, odd: np.ndarray) -> Rows:
        """As ``_distinct``, which sees only words that aren't known."""
        known = self.known.cast(words.type)
        found = pc.index_in(words, value_set=known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        fresh = words.filter(pa.array(new))
        table = Rows.joined([self.known_rows, self._distinct(fresh, odd[new])])
        at = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[new] = len(known) + np.arange(len(fresh))
        rows = Rows(table.flat, table.sizes[at], table.starts[at])
        fits = lambda n, *parts: n <= KNOWN_WORDS and sum(x.nbytes for x in parts) <= KNOWN_BYTES
        if fits(len(known) + len(fresh), known, fresh, table.flat):
            self.known, self.known_rows = pa.concat_arrays([known, fresh]), table
        elif fits(len(words), words, table.flat[: rows.sizes.sum()]):
            self.known, self.known_rows = words, Rows(rows.gather(np.arange(len(words))), rows.sizes)
        return rows

    def _pieces(self, words: pa.Array) -> str:
        text = self._spelled(words)
        return (self.space + text.replace(" ", " " + self.space)) if len(words) else ""

    def _apart(self, words: pa.Array) -> str:
        """Each after a piece that is a space alone, by which they are told apart."""
        text = self._spelled(words)
        return f"{self.space} {text.replace(' ', f' {self.space} ')}" if len(words) else ""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of each."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        firsts = self._ids(self.tokenizer, lists.values.take(pa.array(bounds[:-1])).to_pylist())  # these follow no space
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        distinct, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        blank = lambda i: pc.utf8_is_space(pc.utf8_slice_codeunits(distinct, i, i + 1)).to_numpy(zero_copy_only=False)
        alone = pc.or_(pc.equal(distinct, ""), pc.equal(distinct, "\n")).to_numpy(zero_copy_only=False)
        odd = alone | blank(0) & (blank(1) | ~pc.starts_with(distinct, "\n").to_numpy(zero_copy_only=False))
        rows = self._remembered(distinct, odd)
        whole: dict[int, np.ndarray] = {}
        if odd.any():
            for i in np.unique(np.searchsorted(bounds, np.flatnonzero(odd[at]), "right") - 1).tolist():
                if _AMBIGUOUS.search(x := texts[i].as_py()):
                    whole[i] = self._plain(x)
        for token in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                whole[i] = self._plain(texts[i].as_py())
        rows = Rows.joined([rows, Rows.of([*firsts, *whole.values(), np.zeros(0, self.kind)], self.kind)])
        at[bounds[:-1]] = len(distinct) + np.arange(len(firsts))
        for k, i in enumerate(whole):
            at[bounds[i] : bounds[i + 1]] = len(rows.sizes) - 1  # nothing
            at[bounds[i]] = len(distinct) + len(firsts) + k
        ends = np.concatenate(([0], np.cumsum(rows.sizes[at])))
        return rows.gather(at), ends[bounds[1:]] - ends[bounds[:-1]]


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """One for each Python worker, kept between tasks."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def write_wavelet(ids: np.ndarray, doc_ids: list, n_tokens: list[int], bits: int) -> bytes:
    """A shard file: head, sizes of what follows, zeros and ranks of each plane, documents, and the planes in chunks."""
    pack = zstandard.ZstdCompressor(level=1).compress
    chunks, zeros, ranks, order = [], [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32, copy=True)
    for level in range(bits - 1, -1, -1):
        ones = (order & order.dtype.type(1 << level)).astype(bool)
        bits_of = np.packbits(ones, bitorder="little")
        padded = np.zeros(-(-len(ones) // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(bits_of)] = bits_of
        ranks.append(np.cumsum(np.append(0, np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64))))
        chunks += [pack(bits_of[i : i + CHUNK_BYTES].tobytes()) for i in range(0, len(bits_of), CHUNK_BYTES)]
        low, high = order.compress(~ones), order.compress(ones)
        zeros.append(len(low))
        order[: len(low)], order[len(low) :] = low, high
    null = np.array([x is None for x in doc_ids], np.uint8)
    docs = pack(null.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(n_tokens, "<i8").tobytes())
    parts = (np.array([len(docs), *map(len, chunks)], "<u4"), np.array(zeros, "<u8"), np.concatenate(ranks).astype("<u4"))
    return b"".join((_HEAD.pack(MAGIC, bits, len(ids), len(doc_ids)), *(x.tobytes() for x in parts), docs, *chunks))


class WaveletMatrix:
    """Rank and select on one shard file, given as bytes or as a memory map. Chunks are unpacked when they are needed,
    and the last ``keep`` of them are kept."""

    def __init__(self, data, keep: int = 64):
        magic, self.bits, self.n, self.n_docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.n_bytes = -(-self.n // 8)
        self.per_plane = -(-self.n_bytes // CHUNK_BYTES)
        n_ranks = -(-self.n // BLOCK) + 1
        at = _HEAD.size
        sizes = np.frombuffer(data, "<u4", 1 + self.bits * self.per_plane, at).astype(np.int64)
        at += 4 * len(sizes)
        self.zeros = np.frombuffer(data, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self.ranks = np.frombuffer(data, "<u4", self.bits * n_ranks, at).reshape(self.bits, n_ranks)
        at += 4 * self.bits * n_ranks
        self.ends = (at + np.concatenate(([0], np.cumsum(sizes)))).tolist()
        self.data, self.keep, self.unpacked = data, keep, {}
        self.unpack = zstandard.ZstdDecompressor().decompress
        self._docs: tuple[list, np.ndarray] | None = None

    def _documents(self) -> tuple[list, np.ndarray]:
        if self._docs is None:
            part = self.unpack(self.data[self.ends[0] : self.ends[1]])
            null = np.frombuffer(part, np.uint8, self.n_docs)
            ids, sizes = (np.frombuffer(part, "<i8", self.n_docs, self.n_docs + 8 * self.n_docs * i) for i in (0, 1))
            self._docs = [None if z else int(x) for z, x in zip(null, ids)], sizes
        return self._docs

    @property
    def doc_ids(self) -> list:
        return self._documents()[0]

    @property
    def n_tokens(self) -> np.ndarray:
        return self._documents()[1]

    def _chunk(self, plane: int, i: int) -> np.ndarray:
        k = 1 + plane * self.per_plane + i
        if k not in self.unpacked:
            while len(self.unpacked) >= self.keep:
                self.unpacked.pop(next(iter(self.unpacked)))
            self.unpacked[k] = np.frombuffer(self.unpack(self.data[self.ends[k] : self.ends[k + 1]]), np.uint8)
        return self.unpacked[k]

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of one block, which never crosses a chunk."""
        at = block * BLOCK // 8
        if at >= self.n_bytes:
            return np.zeros(0, np.uint8)
        part = self._chunk(plane, at // CHUNK_BYTES)[at % CHUNK_BYTES :][: BLOCK // 8]
        return np.unpackbits(part, bitorder="little")[: self.n - block * BLOCK]

    def _plane(self, plane: int) -> np.ndarray:
        """All bits of a plane."""
        first = 1 + plane * self.per_plane
        parts = [self.unpack(self.data[x:y]) for x, y in zip(self.ends[first : first + self.per_plane], self.ends[first + 1 :])]
        return np.unpackbits(np.frombuffer(b"".join(parts), np.uint8), bitorder="little", count=self.n)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        return int(self.ranks[plane, block]) + int(self._block(plane, block)[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = self._block(plane, i // BLOCK)[i % BLOCK]
            ones = self._rank1(plane, i)
            i = int(self.zeros[plane]) + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for plane in range(self.bits):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            if token >> (self.bits - 1 - plane) & 1:
                low, high = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token among the first i."""
        low, high = self._range(token, 0, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: bool, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(ranks[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._select_bit(plane, bool(bit), i - int(self.zeros[plane]) if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        """All positions of a token: one by one if they are few, else by a pass over each plane."""
        low, high = self._range(token, 0, self.n)
        if high - low <= 16:
            return [self.select(token, k) for k in range(high - low)]
        places = np.arange(low, high)
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            of_bit = np.flatnonzero(self._plane(plane) == bit)
            places = of_bit[places - int(self.zeros[plane]) if bit else places]
        return places.tolist()

    def decode(self) -> np.ndarray:
        """All ids in order: the stable partitions undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            ones = self._plane(plane).view(bool)
            above, z = np.empty(self.n, kind), int(self.zeros[plane])
            above[np.flatnonzero(~ones)] = out[:z]  # places are set faster than masks
            above[np.flatnonzero(ones)] = out[z:] | kind(1 << (self.bits - 1 - plane))
            out = above
        return out


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and its path there. Hadoop writes local folders with one slash or three."""
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)


def put_file(folder: str, name: str, data: bytes, attempt: int) -> None:
    """Write a file of a folder that all executors share, replacing an earlier try at once."""
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/.{name}.{attempt}.part") as out:
        out.write(data)
    fs.move(f"{path}/.{name}.{attempt}.part", f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, stored_order: bool = False, special_as_text: bool = False) -> DataFrame:
    """Write the shard files of doc_id and text to a folder; one row per shard, in order of (part, shard): its file and
    size. With ``stored_order``, ``docs`` are read from Parquet and keep the order of their files and rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model, part, shard = encoder(tokenizer, special_as_text), TaskContext.get().partitionId(), 0
        end = np.array([end_id], model.kind)
        held, n = [], 0

        def flush():
            nonlocal held, n, shard
            name, all_ids = f"part-{part:06d}-{shard:06d}.wvm", np.concatenate([x[1] for x in held])
            put_file(folder, name, write_wavelet(all_ids, [x[0] for x in held], [len(x[1]) for x in held], model.bits), TaskContext.get().taskAttemptId())
            row = pa.record_batch([[part], [shard], [name], [n], [len(held)]], schema=schema)
            held, n, shard = [], 0, shard + 1
            return row

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            slices = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE_BYTES
            starts = np.concatenate(([0], np.flatnonzero(np.diff(slices)) + 1, [len(keys)])).tolist()
            for low, high in zip(starts, starts[1:]):
                ids, sizes = model.encode(texts.slice(low, high - low))
                for key, own in zip(keys[low:high], np.split(ids, np.cumsum(sizes)[:-1])):
                    if held and n + len(own) + 1 > shard_tokens:
                        yield flush()
                    held.append((key, np.append(own, end)))
                    n += len(own) + 1
                pa.default_memory_pool().release_unused()  # the worker outlives the task
        if held:
            yield flush()

    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"doc_id is {kind}; the file format has integer ids")
    order = ["doc_id", F.xxhash64("text")]
    n = partitions_for(docs.select("doc_id", "text"))
    kept = docs.select("doc_id", "text")
    if stored_order:
        file, order = F.col("_metadata.file_name"), ["__part", "__file", "__row"]
        unnamed = F.raise_error(F.concat(F.lit("no number of a part in "), file)).cast("long")
        part = F.coalesce(F.nullif(F.regexp_extract(file, r"^part-(\d+)", 1), F.lit("")).cast("long"), unnamed)
        kept = docs.select("doc_id", "text", part.alias("__part"), file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    ranged = kept.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(ranged.mapInArrow(run, "part int, shard int, name string, n_tokens long, n_docs long"), "shards")


def read_shards(spark, folder: str, shards: DataFrame, f: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Documents of the shard files, from the files: doc_id, start, n_tokens and ids_crc32 (or ``f`` of the ids)."""
    digest = f or (lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))

    def run(batch):
        out = []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            matrix = WaveletMatrix(data.as_py())
            ids, ends = matrix.decode(), np.concatenate(([0], np.cumsum(matrix.n_tokens))).tolist()
            name = path.rsplit("/", 1)[-1]
            out += [(name, d, x, y - x, digest(ids[x:y])) for d, x, y in zip(matrix.doc_ids, ends, ends[1:])]
        return dict(zip(("name", "doc_id", "local", "n_tokens", "ids_crc32"), zip(*out))) if out else None

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    docs = map_batches(files, run, "name string, doc_id long, local long, n_tokens long, ids_crc32 long")
    firsts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each task
    within = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.select("part", "name", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("offset")).join(firsts, "part").select("name", (F.col("base") + F.col("offset")).alias("first"))
    return join_small(docs, materialise(starts, "shard-starts"), "name").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("shard"))


def encode_corpus(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the shards and read them back. The folder must be shared; by default a new one in the checkpoint folder."""
    folder = folder or new_path(docs.sparkSession, "wavelet")
    shards = write_shards(docs, folder, tokenizer, **options)
    if not shards.limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    return read_shards(docs.sparkSession, folder, shards)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_wavelet_tokens(spark, sf_dir):
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
