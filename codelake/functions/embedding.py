"""Embedders: a plug-in that maps texts to unit vectors, and a default one by feature hashing."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.functions import pandas_udf


class Embedder(Protocol):
    name: str
    dim: int

    def passages(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


#: Words whose signs a worker keeps.
KNOWN_WORDS = 1 << 16


class HashingEmbedder:
    """Words and their parts, each with signs of its own in all ``dim`` cells and weighed by 1 + log(count), scaled to unit length; needs no model files.

    With one cell a word, a word shares its cell and sign with every 512th other, and those of a large index push out the
    text that holds the word itself; over all cells, other words come near it by chance only, by about dim ** -0.5.
    """

    def __init__(self, dim: int = 256):
        self.name, self.dim, self._known = f"hashing-{dim}", dim, {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}}

    def _signs(self, word: str) -> np.ndarray:
        """1 or -1 for each cell, by the bits of the word's hashes; kept for the next texts."""
        if word not in self._known:
            if len(self._known) >= KNOWN_WORDS:
                self._known.clear()
            bits = b"".join(xxhash.xxh3_64_digest(word.encode(), seed=i) for i in range(-(-self.dim // 64)))
            self._known[word] = np.unpackbits(np.frombuffer(bits, np.uint8))[: self.dim].astype(np.int8) * 2 - 1
        return self._known[word]

    def passages(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word, n in Counter(w.lower() for w in re.findall(r"[A-Za-z][a-z0-9]*|[0-9]+|[^\x00-\x7f]+", text or "")).items():
                row += (1 + math.log(n)) * self._signs(word)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).astype(np.float32)

    def query(self, text: str) -> np.ndarray:
        return self.passages([text])[0]


# What some models want in front of a query, by a part of their names; those without it take queries as texts.
INSTRUCTION = "Given a natural language query, retrieve relevant code snippets and documentation"
PREFIXES = {"potion": "", "hashing": "", "qwen3": f"Instruct: {INSTRUCTION}\nQuery:", "": "Represent this sentence for searching relevant passages: "}
# A larger model that takes the place of the default one where there is a GPU.
DEFAULT_MODEL, GPU_MODEL = "BAAI/bge-small-en-v1.5", "BAAI/bge-large-en-v1.5"
# MB for a text of 512 tokens in large and small models, the share of free memory, texts in a batch.
LARGE_DIM, LARGE_MB, SMALL_MB, SHARE, MOST, WITHOUT_GPU = 1024, 32.0, 2.0, 0.4, 128, 64


def query_prefix(model: str) -> str:
    return next(p for k, p in PREFIXES.items() if k in model.lower())


def asked(query: Column, model: str) -> Column:
    """What is embedded of a query."""
    return F.concat(F.lit(query_prefix(model)), query)


def resolved(model: str, device: str = "auto", gpus: int = 0) -> tuple[str, str]:
    """(device, model): static models and hosts without GPUs (spark.executor.resource.gpu.amount) use the CPU."""
    static = not query_prefix(model)
    where = "cpu" if static or device == "cpu" or not gpus else "cuda"
    return where, GPU_MODEL if where == "cuda" and model == DEFAULT_MODEL else model


def batch_size(longest: Column, dim: Column, free_gb: float) -> Column:
    """Texts that a batch may have on a GPU: memory grows with the square of the longest one's tokens."""
    each = F.when(dim >= LARGE_DIM, LARGE_MB).otherwise(SMALL_MB) * F.greatest(F.lit(1.0), F.pow(longest / 512, F.lit(2.0)))
    return F.greatest(F.lit(1), F.least(F.lit(MOST), F.floor(free_gb * SHARE * 1024 / each))).cast("int")


def in_batches(run: Callable[[list[str]], np.ndarray], texts: list[str], most: int = WITHOUT_GPU) -> np.ndarray:
    """Vectors in the order of ``texts``. They go to ``run`` by length, ``most`` at a time; a batch that memory doesn't hold is halved, down to one text."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out: list[np.ndarray | None] = [None] * len(texts)
    todo = [order[i : i + most] for i in range(0, len(order), most)][::-1]
    while todo:
        batch = todo.pop()
        try:
            found = run([texts[i] for i in batch])
        except MemoryError:
            if len(batch) == 1:
                raise
            todo += [batch[len(batch) // 2 :], batch[: len(batch) // 2]]
            continue
        for i, v in zip(batch, found):
            out[i] = v
    return np.stack(out) if out else np.empty((0, 0), np.float32)


class OnnxEmbedder:
    """A transformer from files: a tokenizer's JSON and an ONNX model whose first output is pooled to its mean; loaded at the first use, on the worker that uses it."""

    def __init__(self, name: str, model_file: str, tokenizer_file: str, dim: int):
        self.name, self.files, self.dim, self._loaded = name, (model_file, tokenizer_file), dim, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}

    def _run(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:
            import onnxruntime
            import tokenizers

            tokenizer = tokenizers.Tokenizer.from_file(self.files[1])
            tokenizer.enable_padding()
            self._loaded = (onnxruntime.InferenceSession(self.files[0]), tokenizer)
        session, tokenizer = self._loaded
        coded = tokenizer.encode_batch(texts)
        mask = np.array([c.attention_mask for c in coded], np.int64)
        have = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        out = session.run(None, {i.name: have[i.name] for i in session.get_inputs()})[0]
        mean = (out * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        return (mean / np.where(size == 0, 1, size)).astype(np.float32)

    def passages(self, texts: list[str]) -> np.ndarray:
        return in_batches(self._run, texts)

    def query(self, text: str) -> np.ndarray:
        return self._run([query_prefix(self.name) + text])[0]


def loaded(name: str = "hashing-256", **files: str) -> Embedder:
    """An embedder by name: hashing-<dim>, or a model with its files (model_file, tokenizer_file, dim)."""
    if name.startswith("hashing-"):
        return HashingEmbedder(int(name.removeprefix("hashing-")))
    if missing := {"model_file", "tokenizer_file", "dim"} - set(files):
        raise ValueError(f"{name} needs {sorted(missing)}")
    return OnnxEmbedder(name, files["model_file"], files["tokenizer_file"], int(files["dim"]))


def embedded(text: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of a text column, by batches; the embedder is made once for each worker."""
    used = embedder or HashingEmbedder()

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(used.passages(texts.fillna("").tolist())))

    return F.when(text.isNotNull(), run(text))
