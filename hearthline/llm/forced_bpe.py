"""BPE encoding with forced cuts: byte pairs that no vocabulary token holds inside can't be merged over.

The pair table comes from the vocabulary. White space is in no token, so every run of it is such a cut; the words
between are numbered by Arrow, some megabytes of text at a time, and each distinct one is looked up in a bounded cache. A word that isn't there is normalised and pre-tokenised, its
pre-tokens, unless they are in a cache of their own, are cut again at each pair that isn't in the table, and the fragments are encoded one by one, the last of a pre-token with the vocabulary's
end-of-word mark and the others without; the ids are concatenated. Words with special-token strings take the library's own path.

Null texts count as empty and have no ids. Very long texts are encoded whole; a task holds the ids of one. An empty table gives an empty result; rows that share an id are
encoded each; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # composed letters of Latin-1, which NFC leaves as they are
_PLAIN = re.compile(rf"[!-~{_LETTERS}]+")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: The normaliser and pre-tokeniser that, on words of _PLAIN, do what lower() and _PARTS do.
_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


class ForcedBpe:
    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        spec = steps["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        self.suffix = spec.get("end_of_word_suffix") or ""
        self.ending = BPE(spec["vocab"], merges, end_of_word_suffix=self.suffix) if self.suffix else BPE(spec["vocab"], merges)
        self.inner = BPE(spec["vocab"], merges)
        plain = (t[:-len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t for t in spec["vocab"])
        self.joined = {pair for t in plain for pair in zip(t, t[1:])}  # all else are certain cuts
        self.token = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.known = (steps["normalizer"], steps["pre_tokenizer"]) == _STEPS
        self.bytes = {c: self.whole.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100) if _PLAIN.fullmatch(chr(c))} if self.known else {}
        self.words: dict[str, tuple[str, str]] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.limit = limit

    def fragments(self, pretoken: str) -> list[str]:
        if self.joined.issuperset(zip(pretoken, pretoken[1:])):
            return [pretoken]
        cuts = [i for i, pair in enumerate(zip(pretoken, pretoken[1:]), 1) if pair not in self.joined]
        return [pretoken[a:b] for a, b in zip([0, *cuts], [*cuts, len(pretoken)])]

    def pretokens(self, word: str) -> list[str]:
        if self.known and _PLAIN.fullmatch(word):
            low = word.lower()
            return _PARTS.findall(low) if low.isascii() else [p.translate(self.bytes) for p in _PARTS.findall(low)]
        return [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(word))]

    def _pair(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])

    def _part(self, pretoken: str) -> tuple[str, str]:
        *inner, last = self.fragments(pretoken)
        pair = self._pair([t.id for fragment in inner for t in self.inner.tokenize(fragment)] + [t.id for t in self.ending.tokenize(last)])
        if len(self.parts) < self.limit and len(pretoken) < 40:
            self.parts[pretoken] = pair
        return pair

    def _word(self, word: str) -> tuple[str, str]:
        if "<|" in word:
            pair = self._pair(self.whole.encode(word, add_special_tokens=False).ids)
        else:
            get, make = self.parts.get, self._part
            pairs = [get(p) or make(p) for p in self.pretokens(word)]
            pair = pairs[0] if len(pairs) == 1 else (" ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs]))
        if len(self.words) < self.limit and len(word) < 40:
            self.words[word] = pair
        return pair

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each text its decimal ids joined by one space, and the decoded text."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        get, make = self.words.get, self._word
        pairs = [get(w) or make(w) for w in coded.dictionary.to_pylist()]
        index, ends = coded.indices.to_numpy(), words.offsets.to_numpy()
        has = np.array([bool(p[0]) for p in pairs], bool)[index]  # some words have no ids
        ends = np.concatenate([[0], np.cumsum(has)])[ends - ends[0]]
        held = pa.array(index[has])
        ids, decoded = (pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array([p[k] for p in pairs], pa.large_string()).take(held)), pa.scalar(" ", pa.large_string())) for k in (0, 1))
        return ids, decoded

    def encode(self, text: str) -> tuple[str, str]:
        ids, decoded = self.encode_all(pa.array([text]))
        return ids[0].as_py(), decoded[0].as_py()


def _few(texts: pa.Array, limit: int = 1 << 23) -> Iterator[tuple[int, pa.Array]]:
    """texts in runs of some megabytes, one text at least, each with its place."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1), len(texts)]
    return ((int(a), texts[a:b]) for a, b in zip(starts, starts[1:]) if b > a)


@functools.lru_cache(maxsize=2)
def forced_bpe(path: str) -> ForcedBpe:
    """One encoder for each Python worker."""
    return ForcedBpe(path)


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded: the real outputs of encoding and decoding."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = forced_bpe(path)
        for batch in batches:
            for at, texts in _few(batch.column(1)):
                ids, decoded = bpe.encode_all(texts)
                lists = [[int(i) for i in t.split()] for t in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:at + len(texts)], pa.array(lists, pa.list_(pa.int32())), decoded.cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the same outputs, so that ids needn't leave their task."""
    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = forced_bpe(path)
        for batch in batches:
            for at, texts in _few(batch.column(1)):
                ids, decoded = bpe.encode_all(texts)
                counts = pc.add(pc.count_substring(ids, " "), pc.greater(pc.binary_length(ids), 0).cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:at + len(texts)], counts.cast(pa.int64()), digests(ids), digests(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
