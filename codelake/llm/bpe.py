"""BPE encoding and decoding with content-defined chunk reuse.

A gear hash rolls over a text's bytes and cuts it where the hash falls into a set of one in 2**CUT_BITS, so equal passages
give equal chunks wherever they stand. A worker encodes each distinct chunk once while its bounded cache holds it, and
within chunks each distinct word. A chunk's encoding covers the words that lie wholly in it; what a cut leaves of a word on
either side is the join: the pieces are put together, over as many chunks as the word spans, and encoded anew, which agrees
exactly with encoding the text in one go because this kind of tokenizer never merges over ASCII white space. The reuse is
per worker, not global: shuffling every chunk to its owner would cost more than encoding it again.

Defined cases: null or empty text: no tokens, empty results. Texts of any length are encoded whole. Rows are independent,
so repeated rows and ids give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE, id_and_text

CUT_BITS = 8
#: Chunks a worker's cache may hold.
CHUNKS = 1 << 15
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters are normalised here as the library does: no composition, one lower case each.
PLAIN = regex.compile("[!-~À-ÖØ-öø-ÿ]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    out, extra = [], 256
    for b in range(256):
        visible = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b) if visible else chr(extra))
        extra += not visible
    return out


def supported(config: dict) -> bool:
    """Whether the tokenizer lower-cases, drops white space and splits into pieces as PIECE does."""
    steps = [s["type"] for s in (config.get("normalizer") or {}).get("normalizers", [])]
    splits = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == PIECE and config.get("decoder") is None


class WordEncoder:
    """Token ids of single words (no ASCII white space inside), from the library's own model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if not supported(config):
            raise ValueError(f"{path}: only tokenizers that end pieces at white space and drop it are supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.marks = [t["content"] for t in config["added_tokens"]]
        self.pieces: dict[str, list[int]] = {}
        self.split = regex.compile(PIECE).findall
        self.letters = dict(enumerate(byte_letters()))
        names = self.library.get_vocab(with_added_tokens=True)
        self.names = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name.encode()

    def piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        body = text.rstrip(".,")
        if body.isalpha() and (body.isascii() or PLAIN.fullmatch(body)):  # most words: letters, then maybe one run of stops
            ids = self.piece(body.lower())
            return ids + self.piece(text[len(body) :]) if len(body) < len(text) else ids
        if not PLAIN.fullmatch(text) or any(m in text for m in self.marks):
            return self.library.encode(text, add_special_tokens=False).ids
        pieces = self.split(text.lower())
        if len(pieces) == 1:
            return self.piece(pieces[0])
        return [i for p in pieces for i in self.piece(p)]


class IdText(dict):
    """word -> its ids in decimal, joined by a space."""

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE // 2:
            self.clear()
        value = self[word] = b" ".join(b"%d" % i for i in self.encoder.word(word))
        return value


class ChunkEncoder:
    """Texts to (ids in decimal, decoded text), through chunks."""

    def __init__(self, path: str, seed: int = 5):
        self.encoder = WordEncoder(path)
        self.words = IdText(self.encoder)
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}
        self.gear = np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)
        self.names = {b"%d" % i: n for i, n in enumerate(self.encoder.names)}

    def cuts(self, data: bytes) -> list[int]:
        """Ends of chunks: where the hash of the last 32 bytes has CUT_BITS zeros in front."""
        h = self.gear[np.frombuffer(data, np.uint8)]
        for width in (1, 2, 4, 8, 16):
            if len(h) > width:
                h[width:] += h[:-width] << np.uint32(width)
        ends = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
        return ends if ends and ends[-1] == len(data) else [*ends, len(data)]

    def chunk(self, data: bytes) -> tuple[bytes, bytes, bytes] | None:
        """(what precedes the first white space, ids of the whole words, what follows the last); None without white space."""
        words = data.split()
        if len(words) < 2 and data.strip() == data:
            return None
        head = words.pop(0) if words and not data[:1].isspace() else b""
        tail = words.pop() if words and not data[-1:].isspace() else b""
        known = self.words
        parts = [known[w] for w in words]
        if b"" in parts:
            parts = list(filter(None, parts))
        return head, b" ".join(parts), tail

    def encode(self, data: bytes | None) -> bytes:
        if not data:
            return b""
        out, carry, at = [], b"", 0
        for end in self.cuts(data):
            piece, at = data[at:end], end
            try:
                found = self.chunks[piece]
            except KeyError:
                if len(self.chunks) >= CHUNKS:
                    self.chunks.clear()
                found = self.chunks[piece] = self.chunk(piece)
            if found is None:
                carry += piece
                continue
            head, inner, tail = found
            if word := carry + head:
                out.append(self.words[word])
            out.append(inner)
            carry = tail
        if carry:
            out.append(self.words[carry])
        return b" ".join(filter(None, out))

    def decode(self, ids: bytes) -> bytes:
        names = self.names
        return b" ".join([names[i] for i in ids.split()])


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), decoded (the library's decoding of them) for every row."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1).cast(pa.binary())
                ids = [coder.encode(texts[i].as_py()) for i in range(len(texts))]
                counts = [x.count(b" ") + 1 if x else 0 for x in ids]
                decoded = [coder.decode(x) for x in ids]
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()).cast(pa.string()), pa.array(decoded, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
