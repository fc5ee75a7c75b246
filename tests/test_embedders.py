import math

import numpy as np
import pytest

from lodestone.functions.embedders import HashEmbedder, HttpEmbedder, WordPiece, mean_pool
from lodestone.types import InvalidConfig


def test_hash_embedder(spark):
    e = HashEmbedder()
    a, b, c = e.embed_many(["pets and animals", "pets and animals", ""])
    assert a == b and math.isclose(sum(x * x for x in a), 1) and not any(c)
    df = spark.createDataFrame([("pets and animals",), (None,)], "t string")
    assert df.select(e.column("t").alias("v")).collect()[0].v == a


def test_http_embedder():
    sent = []

    def post(url, body, headers):
        sent.append((url, body))
        return {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]} if "embeddings" in url else {"embeddings": [[3], [4]]}

    assert HttpEmbedder("http://h/v1/", "text-embedding-3-small", post=post).embed_many(["a", "b"]) == [[1], [2]]
    assert HttpEmbedder("http://h", "m", 1, style="ollama", post=post).embed_many(["a", "b"]) == [[3], [4]]
    assert sent[0][0] == "http://h/v1/embeddings" and sent[1][1] == {"model": "m", "input": ["a", "b"]}
    with pytest.raises(InvalidConfig):
        HttpEmbedder("http://h", "unknown")


def test_word_piece():
    t = WordPiece(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hello", ",", "world", "!", "play", "##ing", "cafe"])
    assert t.encode("Hello, World!") == [2, 4, 5, 6, 7, 3]
    assert t.encode("playing café zzz") == [2, 8, 9, 10, 1, 3]
    assert t.encode("hello " * 9, 5) == [2, 4, 4, 4, 3]
    ids, mask = t.batch(["hello", "hello world"])
    assert ids.shape == (2, 4) and mask.sum(1).tolist() == [3, 4]


def test_mean_pool():
    states = np.array([[[3.0, 0], [0, 9]], [[1, 1], [1, 1]]])
    assert mean_pool(states.copy(), np.array([[1, 0], [0, 0]])).tolist() == [[1, 0], [0, 0]]
