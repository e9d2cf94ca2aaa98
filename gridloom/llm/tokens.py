"""Token ids of whole texts by cut pieces and a merge table, and their counts by cut pieces and a bounded memory of pieces counted before."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.transducer import Cutter, byte_alphabet, byte_bpe, char_classes, cut, marked

if TYPE_CHECKING:
    import tiktoken
    from tokenizers import Tokenizer

#: Pieces remembered per worker; the memory is emptied when full, so it stays bounded on any corpus.
REMEMBERED = 600_000
#: Characters cut at once; bounds a worker's memory however many rows a batch has.
CHARS_AT_ONCE = 500_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """Consecutive runs of texts of about `most` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def parts_of(batch: pa.RecordBatch, text: str, most: int = CHARS_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive parts of a batch whose texts (null: empty) have about `most` bytes, with those texts; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(before + sizes, before[at] + most, "right")))
        part = batch.slice(at, end - at)
        yield part, texts_of(part.column(text))
        at = end


#: Stands between pieces handed to the merge table, and for the mark that ends a word; texts that hold it themselves take the library's model.
NUL = "\0"


def ends_whole(spec: dict, library: Tokenizer) -> bool:
    """Whether every token that merges make is its own encoding, and merges are listed in the order of the ids that they make.

    Then merging whatever neighbours form the token of least id gives the library's ids: when a token's turn has come and two neighbours form it, no
    earlier merge crossed its ends, so they are what its own encoding had then, that is, the two sides of its merge.
    """
    from tokenizers import models

    model = spec["model"]
    suffix = model["end_of_word_suffix"] or ""
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab[x + y] for x, y in merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        return False
    inner = models.BPE(vocab, merges) if suffix else library.model
    for x, y in merges:
        ended = suffix and y.endswith(suffix)
        found = (library.model if ended else inner).tokenize((x + y).removesuffix(suffix) if ended else x + y)
        if [t.id for t in found] != [vocab[x + y]]:
            return False
    return True


class Encoder:
    """Ids of texts as the tokenizers library gives them, without added begin or end tokens.

    The split pattern runs as a transducer over the whole batch. tiktoken's merge loop, given the file's own table, makes the ids of the pieces; where
    ends_whole() doesn't hold for a table, or a text has NUL characters, the library's model is asked piece by piece.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.normal = spec["normalizer"] is not None
        if self.normal:
            kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
            assert kinds == ["NFC", "Replace", "Lowercase"], kinds
        self.classes = char_classes(self.library.pre_tokenizer.pre_tokenize_str)
        self.cutter = Cutter(joins_space=not self.normal, single_numbers=self.normal)
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.merger = self.merge_table(spec) if ends_whole(spec, self.library) else None

    def merge_table(self, spec: dict) -> tiktoken.Encoding:
        import tiktoken

        alphabet, suffix = byte_alphabet(), spec["model"]["end_of_word_suffix"] or ""
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                ended = suffix and token.endswith(suffix)
                ranks[bytes(alphabet[c] for c in (token.removesuffix(suffix) if ended else token)) + NUL.encode() * bool(ended)] = i
        pattern = "[^\\x00 ]+\\x00" if suffix else "[^\\x00]+"
        # Without a special string the library's search for them would stop at every character; this one can't occur between pieces.
        return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={NUL * 2: self.size})

    def piece(self, text: str) -> bytes:
        """Ids of one piece by the library's model."""
        mapped = text.encode().decode("latin-1").translate(self.stand_in)
        return np.array([t.id for t in self.model.tokenize(mapped)], self.dtype).tobytes()

    def parts(self, texts: list[str]) -> tuple[list[str], list[list[int | bytes]]]:
        """Texts split at special strings, which stand for their own ids wherever they occur: plain parts, and per text where they are."""
        pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        plain: list[str] = []
        layout: list[list[int | bytes]] = []
        for t in texts:
            row: list[int | bytes] = []
            found = pattern.split(t) if pattern and any(s in t for s in self.special) else [t]
            for x in found:
                if x in self.special:
                    row.append(np.array([self.special[x]], self.dtype).tobytes())
                elif x:
                    row.append(len(plain))
                    plain.append(self.normalize(x) if self.normal else x)
            layout.append(row)
        return plain, layout

    @staticmethod
    def normalize(text: str) -> str:
        """NFC and lower case per character; white space needs no replacement, since the split drops it."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as bytes of self.dtype."""
        out: list[bytes] = []
        for run in slices(texts):
            plain, layout = self.parts(run)
            whole = self.plain_ids(plain)
            out += [b"".join(whole[x] if isinstance(x, int) else x for x in row) for row in layout]
        return out

    def plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of normalised texts without special strings."""
        if not texts:
            return []
        if self.merger is None or any(NUL in t for t in texts):
            pieces, first = cut(self.cutter, self.classes, texts, blanks=not self.normal)
            at = first.tolist()
            return [b"".join(map(self.piece, pieces[a:b])) for a, b in zip(at, at[1:])]
        ids = self.merger.encode_to_numpy
        return [ids(t, disallowed_special=()).astype(self.dtype).tobytes() for t in marked(self.cutter, self.classes, texts, NUL, blanks=not self.normal)]


class Counter:
    """Token counts by the two transducers alone; no ids are made."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.counter, self.special = byte_bpe(path)
        self.classes = char_classes(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        self.cutter = Cutter(joins_space=True, single_numbers=False)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        out = []
        for run in slices(texts):
            extra = np.zeros(len(run), np.int64)
            plain, owner = [], []
            for i, t in enumerate(run):
                found = [t]
                for s in self.special:
                    if s in t:
                        split = [x.split(s) for x in found]
                        extra[i] += sum(len(x) - 1 for x in split)
                        found = [y for x in split for y in x]
                plain += found
                owner += [i] * len(found)
            pieces, first = cut(self.cutter, self.classes, plain)
            known, count = self.known, self.counter.count
            if len(known) > REMEMBERED:
                known.clear()
            for p in set(pieces).difference(known):
                known[p] = count(p.encode())
            got = list(map(known.__getitem__, pieces))
            sums = np.concatenate([[0], np.cumsum(np.array(got, np.int64))])
            per = sums[first[1:]] - sums[first[:-1]]
            out.append(extra + np.bincount(owner, per, len(run)).astype(np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit.

    Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count as the
    library's default has it, one token each; repeated rows are counted alike; other columns pass through
    untouched, and one that is named like an added column is refused; an empty table gives an empty result.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    if clash := [c for c in added if c in docs.columns and c != text]:
        raise ValueError(f"columns {clash} are already there")
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            for part, texts in parts_of(batch, text):
                n = machine.count(texts)
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, size, pa.array(n), pa.array(n > limit)], [*[f.name for f in kept], *added])

    return docs.mapInArrow(run, schema)
