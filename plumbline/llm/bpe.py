"""Byte-pair encoding by forced boundaries, and decoding.

A merge can only ever build a vocabulary token.  So if two neighbouring bytes
occur side by side inside no token at all, no merge crosses them: the place
between them is a certain cut.  A word is split at its certain cuts, each
fragment is merged alone (and remembered, as fragments recur far more often
than words), and the ids are concatenated.  The result is what merging the
whole word gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BoundedCache, bytes_of, pick_columns, small_batches

END = "</w>"


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder over a tokenizer file with word ends (``</w>``) and byte-level symbols.

    The file's own normaliser and splitter are used for words beyond ASCII, so
    that Unicode tables agree with the library; its merge routine runs on one
    fragment at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or model.get("ignore_merges"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        lib = Tokenizer.from_file(path)
        self._normalizer, self._splitter = lib.normalizer, lib.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        #: Both merge by the same ranks; only the first takes the end of its fragment for the end of the word.
        self._ending, self._inner = BPE(self.vocab, merges, end_of_word_suffix=END), BPE(self.vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens: list[str | None] = [None] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self._chars = byte_characters()
        self.joined = self._joined_pairs()
        self._simple = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
        self._simple_pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
        self._letters = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
        self._fragments = BoundedCache(self._merge, 100_000, 64)
        self.words = BoundedCache(self._word, 600_000, 100)

    def _joined_pairs(self) -> set[str]:
        """Pairs of neighbouring symbols inside any token; a last symbol carries the word end."""
        joined: set[str] = set()
        for token in self.vocab:
            final = token.endswith(END) and token != END
            body = token[: -len(END)] if final else token
            pairs = [body[i - 1 : i + 1] for i in range(1, len(body))]
            if final and pairs:
                pairs[-1] += END
            joined.update(pairs)
        return joined

    def fragments(self, piece: str) -> list[str]:
        """The fragments between the certain cuts of a piece of byte characters; the last one ends in ``</w>``."""
        joined, last = self.joined, len(piece) - 1
        cuts = [i for i in range(1, last) if piece[i - 1 : i + 1] not in joined]
        if last and piece[last - 1 :] + END not in joined:
            cuts.append(last)
        piece += END
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, None])] if cuts else [piece]

    def _merge(self, fragment: str) -> list[int]:
        """Ids of one fragment merged alone; ``</w>`` at its end says that the word ends there."""
        if fragment.endswith(END) and fragment != END:
            return [t.id for t in self._ending.tokenize(fragment[: -len(END)])]
        return [t.id for t in self._inner.tokenize(fragment)]

    def _piece(self, piece: str) -> list[int]:
        fragments = self.fragments(piece)
        if len(fragments) == 1:  # a whole word: the cache of words has it
            return self._merge(fragments[0])
        cache = self._fragments
        return [i for f in fragments for i in cache[f]]

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without white space and special tokens."""
        if text.isascii() and text.isalpha():
            return self._piece(text.lower())
        if self._simple.fullmatch(text):
            # ASCII and composed Latin-1 letters: normal already, and each letter has one lower-case form there.
            pieces = self._simple_pieces.findall(text.lower())
            pieces = [p.encode().decode("latin-1").translate(self._chars) for p in pieces]
        else:
            pieces = [p for p, _ in self._splitter.pre_tokenize_str(self._normalizer.normalize_str(text))]
        return [i for p in pieces for i in self._piece(p)]

    def _word(self, word: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of one word."""
        if word[-1] in b".,;:!?" and len(word) > 1:
            # A sign behind letters is a piece of its own, and the letters recur with other signs.
            stem = word[:-1]
            if stem.isalpha() or stem[-1] >= 0x80 and self._letters.fullmatch(stem.decode("utf-8", "replace")):
                return self.words[stem] + self.words[word[-1:]]
        if word.isalpha():  # ASCII letters
            ids = self._piece(word.decode().lower())
            return pack(f"<{len(ids)}I", *ids)
        text = word.decode("utf-8", "replace")
        if self._letters.fullmatch(text):
            ids = self._piece(word.decode("latin-1").translate(self._chars))
        elif "<" not in text or not self._special:
            ids = self._plain(text)
        else:
            ids, at = [], 0
            for m in self._special.finditer(text):
                ids += self._plain(text[at : m.start()]) if m.start() > at else []
                ids.append(self.special[m[0]])
                at = m.end()
            if at < len(text):
                ids += self._plain(text[at:])
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty.

        Lower-casing A-Z first is what the normaliser does anyway, and fewer
        spellings reach the word cache; special tokens are matched before it,
        so a text that might hold one is left as it is.
        """
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, (text if b"<|" in text else text.lower()).split()))

    def decode(self, ids: bytes) -> str:
        """The tokens' own spellings with one space between them, as the file names no decoder."""
        tokens = self.tokens
        named = [tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i < len(tokens)]
        return " ".join(t for t in named if t is not None) if None in named else " ".join(named)


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder for each file and Python process."""
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: token ids of each whole text and the text they decode to.

    Null and empty texts give no ids and an empty decoded text.  Repeated rows
    each give their row.  Other columns are not read, so their names may clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in small_batches(batches, 1):
            ids = [bpe.encode(t) for t in bytes_of(batch.column(1))]
            arrays = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays, pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_column]
    return pick_columns(docs, id_column, text_column).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: as :func:`encode_documents`, but only digests leave the workers."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in small_batches(batches, 1):
            n, of_ids, of_text = [], [], []
            for text in bytes_of(batch.column(1)):
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                of_ids.append(sha256(ids).hexdigest())
                of_text.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_column]
    return pick_columns(docs, id_column, text_column).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(frame: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from arrays of ids; null arrays give null, unknown ids are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.asarray([i for i in x if i is not None and i >= 0], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(frame.dtypes)[id_column]
    return pick_columns(frame, id_column, ids_column).mapInArrow(run, f"doc_id {kind}, text string")
