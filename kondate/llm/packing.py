"""Packing token sequences: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, give_back, worker_memory

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A letter before a mark (not an apostrophe), which the tokenizer always parts.
_MARK = r"([a-zà-öø-ÿ])([!-&(-/:-@\[-`{-~])"
#: A word of letters only, in lower case: one word to the tokenizer, too.
_LETTERS = re.compile("[a-zà-öø-ÿ]+")
#: Characters of text that are tokenized together; longer texts are taken in parts that end at white space.
PART_CHARS = 1 << 19


class WordIds:
    """Token ids of texts, found word by word with a memory of words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn. Words
    are remembered in two generations of at most `most` entries: when the young one is full it becomes the old one,
    from which what is still in use is taken over.
    """

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies spell as themselves
        others = (x for x in range(256) if x not in printed)
        self.spelled = {x: chr(x) for x in printed} | {x: chr(256 + i) for i, x in enumerate(others)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> None:
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            coded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.young.update((w, np.array(c.ids, "<u4").tobytes()) for w, c in zip(part, coded, strict=True))

    def _letters(self, words: list[str]) -> None:
        """Words of plain letters, which the tokenizer's other steps leave as they are, by its model alone."""
        tokenize, spelled = self.tokenizer.model.tokenize, self.spelled
        for word in words:
            found = tokenize(word if word.isascii() else "".join([spelled[b] for b in word.encode()]))
            self.young[word] = b"".join([t.id.to_bytes(4, "little") for t in found])

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit bytes."""
        known = list(map(self.young.get, words))
        missing = [i for i, k in enumerate(known) if k is None]
        if len(self.young) + len(missing) > self.most:
            self.old, self.young = self.young, {w: k for w, k in zip(words, known, strict=True) if k is not None}
        letters, others = [], []
        for word in (words[i] for i in missing):
            if (ids := self.old.get(word)) is not None:
                self.young[word] = ids
            else:
                (letters if _LETTERS.fullmatch(word) else others).append(word)
        self._letters(letters)
        self._each(others)
        for i in missing:
            known[i] = self.young[words[i]]
        return known

    @staticmethod
    def words(texts: pa.Array) -> pa.ListArray:
        """The words of each text, in lower case and apart from marks, so that fewer differ.

        Only A-Z changes case here; the tokenizer sees to the rest. Texts that may hold a special token stay as they are.
        """
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), _MARK, r"\1 \2")
        return pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, plain))

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the last one's end."""
        listed = self.words(pa.array(texts, pa.large_string()))
        bounds, flat = listed.offsets.to_numpy(), listed.flatten().dictionary_encode()
        known = self.learn(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), "i8", len(known)) // 4
        starts, at = np.cumsum(sizes) - sizes, flat.indices.to_numpy()
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])
        return np.frombuffer(b"".join(known), "<u4")[places], ends[bounds]

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        held: list[str] = []
        rows: list[int] = []  # whose part each held one is
        size = row = 0
        carried = b""
        for row, text in enumerate(texts):
            for part in parts_of(text, PART_CHARS):
                if size + len(part) > PART_CHARS and held:
                    *done, carried = self._joined(held, rows, row, carried)
                    yield from done
                    held, rows, size = [], [], 0
                held.append(part)
                rows.append(row)
                size += len(part)
        if held:
            yield from self._joined(held, rows, row, carried)

    def _joined(self, held: list[str], rows: list[int], last: int, carried: bytes) -> list[bytes]:
        """The ids of the held parts' texts up to text `last`, whose own are still to be continued."""
        ids, bounds = self.coded(held)
        out = [carried]
        for k, row in enumerate(rows):
            if k and row != rows[k - 1]:
                out.append(b"")
            out[-1] += ids[bounds[k] : bounds[k + 1]].tobytes()
        return out if rows[-1] == last else [*out, b""]


def parts_of(text: str, most: int) -> Iterator[str]:
    """A text in parts of about `most` characters that end at white space; short ones and words stay whole."""
    at = 0
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


_GAP = re.compile(r"[ \t-\r]")


def document_pieces(documents: DataFrame, size: int, end_id: int, path: str | None, known_words: int) -> DataFrame:
    """One row per piece: a document's ids and `end_id`, cut only if longer than `size`. Texts stay where they are."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = path or tokenizer_path()
        known = worker_memory(f"ids {found}", lambda: WordIds(found, known_words))
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, coded in zip(ids, known.ids(t.as_py() or "" for t in batch.column("text")), strict=True):
                coded += end
                for piece, at in enumerate(range(0, len(coded), 4 * size)):
                    part = coded[at : at + 4 * size]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class CapacityTree:
    """Segment tree over the capacities 0..size: which remaining capacities some open bin has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        at = left + self.leaves
        while at and not self.used[at]:
            self.used[at] = 1
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity >= need that an open bin has, or -1."""
        used, at = self.used, need + self.leaves
        if used[at]:
            return need
        while at > 1 and (at & 1 or not used[at + 1]):  # up, until a branch to the right holds something
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.leaves:
            at = 2 * at if used[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, left: int) -> int:
        bin_ = self.bins[left].pop()
        if not self.bins[left]:
            at = left + self.leaves
            self.used[at] = 0
            at >>= 1
            while at and not (self.used[2 * at] or self.used[2 * at + 1]):
                self.used[at] = 0
                at >>= 1
        return bin_


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the open bin that it fills most tightly."""
    tree, bins, offsets, opened = CapacityTree(size), np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8"), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        left = tree.tightest(need)
        if left < 0:
            bin_, left, opened = opened, size, opened + 1
        else:
            bin_ = tree.take(left)
        bins[i], offsets[i] = bin_, size - left
        if left > need:
            tree.put(left - need, bin_)
    return bins, offsets


def place(pieces: DataFrame, size: int, rows: int, group_rows: int = 16384) -> DataFrame:
    """Pieces with sequence_id and offset. Groups of about `group_rows` pieces are packed side by side.

    A group leaves at most a few sequences unfilled, some hundredths of a percent of its own; its size, and so a
    task's memory, doesn't grow with the input. Pieces as long as a sequence fill one each wherever they are.
    """
    groups = max(1, -(-rows // group_rows))

    def pack(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.drop_columns(["_group"]).sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")])
        bins, offsets = best_fit_decreasing(part["length"].to_numpy(), size)
        return part.append_column("sequence_id", pa.array(key[0].as_py() * (1 << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(pack, PLACED)


def pack_documents(documents: DataFrame, size: int = 4096, end_id: int = 1, path: str | None = None, group_rows: int = 16384, known_words: int = 100_000) -> DataFrame:
    """Every piece of every document, with its sequence and place.

    A null or empty text is one piece of the end id alone. Repeated rows are packed as often as they come. Texts of
    any length are tokenized whole. An empty table gives an empty result. Other columns are not read. known_words: what a
    worker remembers in each of two generations, some 20 MB, against time for tokenizing again.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    pieces = scratch.table(document_pieces(documents, size, end_id, path, known_words), "pieces")
    return place(pieces, size, pieces.count(), group_rows)


def sequences(documents: DataFrame, placed: DataFrame, size: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from documents with unique doc_id and their placement."""
    end = np.array([end_id], "<u4").tobytes()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = path or tokenizer_path()
        known = worker_memory(f"ids {found}", lambda: WordIds(found))
        for batch in batches:
            rows = [(d, p, c[at : at + 4 * size]) for d, c in zip(batch.column("doc_id").to_pylist(), (x + end for x in known.ids([t or "" for t in batch.column("text").to_pylist()])), strict=True) for p, at in enumerate(range(0, len(c), 4 * size))]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "piece", "ids"])

    def join(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        whole = b"".join(part.sort_by("offset")["ids"].to_pylist())
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([np.frombuffer(whole, "<u4").astype("i8")], pa.list_(pa.int64()))})

    coded = documents.select("doc_id", "text").mapInArrow(ids, "doc_id long, piece int, ids binary")
    return placed.select("doc_id", "piece", "sequence_id", "offset").join(coded, ["doc_id", "piece"]).groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<long>")
