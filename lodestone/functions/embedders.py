"""Text to vectors: the hashing embedder, WordPiece, and pluggable HTTP and ONNX models."""

from __future__ import annotations

import json
import re
import unicodedata
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import InvalidConfig


class Embedder:
    """dimensions, an optional model id, and embed_many; column() runs it in Arrow batches on the executors."""

    model: str | None = None

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    def column(self, text: str | Column) -> Column:
        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(self.embed_many([t or "" for t in batch]))

        return embed(text)


def _mixed(units: np.ndarray, seed: int) -> int:
    h = seed
    for c in units.tolist():
        h = ((h ^ c) * 0x5BD1E995) & 0xFFFFFFFF
        h ^= h >> 13
    return h - (1 << 32) if h >= 1 << 31 else h


_ODD = re.compile("[\x1c-\x1f\x85\ufeff]")
_SPACE = re.compile("[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


class HashEmbedder(Embedder):
    """Deterministic vectors from character trigrams, bigrams and words; unit length, zeros for no words.

    Distinct tokens of a block of texts are hashed together, and texts sum their tokens' vectors.
    """

    PLANS = ((3, 42, 0.1), (2, 97, 0.05))
    #: Characters of a block of texts; longest token that is hashed with the others.
    BLOCK, LONG = 1 << 19, 64

    def __init__(self, dimensions: int = 64):
        super().__init__(dimensions)

    @staticmethod
    def tokens(text: str) -> list[str]:
        text = text.lower()
        return [t for t in _SPACE.split(text) if t] if _ODD.search(text) else text.split()

    def _vectors(self, tokens: list[str]) -> np.ndarray:
        """A row a token."""
        raw = [t.encode("utf-16-le", "surrogatepass") for t in tokens]
        size = np.array([len(r) // 2 for r in raw])
        units = np.frombuffer(b"".join(raw), np.uint16).astype(np.uint32)
        start = np.cumsum(size) - size
        token = np.repeat(np.arange(len(tokens)), size)
        left = np.repeat(start + size, size) - np.arange(len(units))  # units from here to the token's end
        at, weight = [], []

        def put(rows: np.ndarray, h: np.ndarray, x: float) -> None:
            signed = h.view(np.int32).astype(np.int64)
            at.append(rows * self.dimensions + np.abs(signed) % self.dimensions)
            weight.append(np.where(signed > 0, x, -x))

        def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
            h = (h ^ c) * np.uint32(0x5BD1E995)
            return h ^ (h >> np.uint32(13))

        for n, seed, x in self.PLANS:
            first = np.flatnonzero(left >= n)
            h = np.full(len(first), seed, np.uint32)
            for j in range(n):
                h = step(h, units[first + j])
            put(token[first], h, x)
        word = np.full(len(tokens), 7, np.uint32)
        for j in range(min(self.LONG, int(size.max(initial=0)))):
            on = np.flatnonzero(size > j)
            word[on] = step(word[on], units[start[on] + j])
        for i in np.flatnonzero(size > self.LONG).tolist():
            word[i] = np.uint32(_mixed(units[start[i] : start[i] + size[i]], 7) & 0xFFFFFFFF)
        signed = np.abs(word.view(np.int32).astype(np.int64))
        at.append(np.arange(len(tokens)) * self.dimensions + signed % self.dimensions)
        weight.append(np.full(len(tokens), 0.3))
        return np.bincount(np.concatenate(at), np.concatenate(weight), len(tokens) * self.dimensions).reshape(-1, self.dimensions)

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        out, block, size = [], [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= self.BLOCK:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[list[float]]:
        words = [self.tokens(t) for t in texts]
        place: dict[str, int] = {}
        index = np.array([place.setdefault(w, len(place)) for ws in words for w in ws], np.int64)
        out = np.zeros((len(texts), self.dimensions))
        if place:
            vectors = self._vectors(list(place))
            ends = np.cumsum([len(ws) for ws in words])
            for i, end in enumerate(ends.tolist()):
                out[i] = vectors[index[end - len(words[i]) : end]].sum(axis=0)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0).tolist()


class HttpEmbedder(Embedder):
    """OpenAI- and Ollama-shaped endpoints; `post` may be replaced, as in tests."""

    KNOWN = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384, "bge-m3": 1024}

    def __init__(self, url: str, model: str, dimensions: int | None = None, key: str | None = None, style: str = "openai", post: Callable[[str, dict, dict], dict] | None = None):
        if dimensions is None and model not in self.KNOWN:
            raise InvalidConfig(f"dimensions of {model} aren't known")
        super().__init__(dimensions or self.KNOWN[model])
        self.url, self.model, self.key, self.style, self.post = url.rstrip("/"), model, key, style, post or _post

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        if self.style == "ollama":
            return self.post(f"{self.url}/api/embed", {"model": self.model, "input": texts}, headers)["embeddings"]
        found = self.post(f"{self.url}/embeddings", {"model": self.model, "input": texts}, headers)["data"]
        return [x["embedding"] for x in sorted(found, key=lambda x: x["index"])]


def _post(url: str, body: dict, headers: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.load(answer)


class WordPiece:
    """BERT tokens: normalise, split, then the longest known pieces; unknown or overlong words are one [UNK]."""

    def __init__(self, vocab: list[str], lower: bool = True, longest_word: int = 100):
        self.ids = {t: i for i, t in enumerate(vocab)}
        self.lower, self.longest_word = lower, longest_word

    def words(self, text: str) -> list[str]:
        out = []
        for c in text:
            o, kind = ord(c), unicodedata.category(c)
            if o in (0, 0xFFFD) or (kind.startswith("C") and c not in "\t\n\r"):
                continue
            if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0x20000 <= o <= 0x2CEAF or 0xF900 <= o <= 0xFAFF or 0x2F800 <= o <= 0x2FA1F:
                out += [" ", c, " "]
            else:
                out.append(" " if c.isspace() else c)
        text = "".join(out)
        if self.lower:
            text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
        split = []
        for c in text:
            mark = 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c).startswith("P")
            split.append(f" {c} " if mark else c)
        return "".join(split).split()

    def pieces(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word):
            end = len(word)
            while end > at and ("##" if at else "") + word[at:end] not in self.ids:
                end -= 1
            if end == at or len(word) > self.longest_word:
                return [self.ids["[UNK]"]]
            out.append(self.ids[("##" if at else "") + word[at:end]])
            at = end
        return out

    def encode(self, text: str, most: int = 512) -> list[int]:
        body = [i for w in self.words(text) for i in self.pieces(w)][: max(0, most - 2)]
        return [self.ids["[CLS]"], *body, self.ids["[SEP]"]]

    def batch(self, texts: list[str], most: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids padded to the longest of the batch, and the mask."""
        rows = [self.encode(t, most) for t in texts]
        width = max(map(len, rows), default=0)
        ids, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            ids[i, : len(r)], mask[i, : len(r)] = r, 1
        return ids, mask


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over tokens, then unit length; zeros without tokens."""
    m = mask[..., None].astype(states.dtype)
    mean = (states * m).sum(1) / np.maximum(m.sum(1), 1)
    size = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.divide(mean, size, out=mean, where=size > 0)


class OnnxEmbedder(Embedder):
    """A sentence encoder from an ONNX file, loaded once a Python worker; batches of 32."""

    def __init__(self, path: str, tokenizer: WordPiece, dimensions: int, model: str | None = None, most: int = 512):
        super().__init__(dimensions)
        self.path, self.tokenizer, self.model, self.most, self._session = path, tokenizer, model, most, None

    def __getstate__(self):
        return self.__dict__ | {"_session": None}

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        if self._session is None:
            import onnxruntime  # noqa: PLC0415

            self._session = onnxruntime.InferenceSession(self.path)
        out = []
        for at in range(0, len(texts), 32):
            ids, mask = self.tokenizer.batch(texts[at : at + 32], self.most)
            names = {i.name for i in self._session.get_inputs()}
            feed = {k: v for k, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", np.zeros_like(ids))) if k in names}
            out += mean_pool(self._session.run(None, feed)[0], mask).tolist()
        return out
