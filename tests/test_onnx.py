"""The model stage with a tiny model, whose file is put together here byte by byte."""

import struct

import pytest
from pyspark.sql import functions as F

from glossaflow.operators import taggers

pytest.importorskip("onnxruntime")


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(no, value):
    if isinstance(value, int):
        return varint(no << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(no << 3 | 2) + varint(len(value)) + value


def node(op, inputs, output, *attributes):
    return field(1, b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, op) + b"".join(field(5, a) for a in attributes))


def value(no, name, kind, dims):
    shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
    return field(no, field(1, name) + field(2, field(1, field(1, kind) + field(2, shape))))


def tensor(name, kind, dims, raw):
    return field(5, b"".join(field(1, d) for d in dims) + field(2, kind) + field(8, name) + field(9, raw))


def model():
    """logits[i, j, k] = ids[i, j] * mask[i, j] * k for 11 labels."""
    to_float = field(1, "to") + field(3, 1) + field(20, 2)
    graph = node("Cast", ["ids"], "x", to_float) + node("Mul", ["x", "mask"], "y") + node("Unsqueeze", ["y", "axes"], "z") + node("Mul", ["z", "w"], "logits") + field(2, "g")
    graph += tensor("axes", 7, [1], struct.pack("<q", 2)) + tensor("w", 1, [1, 1, 11], struct.pack("<11f", *range(11)))
    graph += value(11, "ids", 7, ["n", "l"]) + value(11, "mask", 1, ["n", "l"]) + value(12, "logits", 1, ["n", "l", 11])
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_model_folder(spark, tmp_path):
    """Weights, vocabulary and labels from one folder, written by the sinks, to entities."""
    import json

    from glossaflow.operators import analysis, models, tokens
    from glossaflow.sources import writers

    names = ["O", "I-SUBJECT", "B-SUBJECT", "B-PREDICATE", "B-X", *["O"] * 6]  # an order of the model's own
    folder = tmp_path / "model-a"
    folder.mkdir()
    (folder / "model.onnx").write_bytes(model())
    writers.metadata(spark, str(folder / "metadata.json"), "a", max_len=16)
    (folder / "config.json").write_text(json.dumps({"id2label": {str(i): n for i, n in enumerate(names)}}))
    words = ["[PAD]", *[f"u{i}" for i in range(99)], "[UNK]", "[CLS]", "[SEP]", "a", "b", "."]
    (folder / "vocab.txt").write_text("\n".join(words) + "\n")
    docs = spark.createDataFrame([(1, "a b. b a."), (2, "a z.")], "doc int, text string")
    found = models.Folder(spark, str(folder))
    assert found.max_len == 16 and found.labels[1] == "I-SUBJECT"
    rows = models.analyze(docs, ["doc"], found).orderBy("doc", "sent_no").collect()
    assert [(r["doc"], r["err"], len(r["tokens"])) for r in rows] == [(1, 0, 16), (1, 0, 16), (2, 1, 0)]

    class Same:
        def __call__(self, encoded):
            scored = taggers.OnnxTagger(model())(encoded)
            known = {"O": 0, "I-SUBJECT": 4, "B-SUBJECT": 3, "B-PREDICATE": 5}
            ids = F.array(*[F.lit(known.get(n, -1)) for n in names])
            return scored.withColumn("label_ids", F.transform("label_ids", lambda i: F.get(ids, i)))

    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token string, id long")
    want = analysis.analyze(docs, ["doc"], vocab, Same(), max_len=16).orderBy("doc", "sent_no").collect()
    assert rows == want and tokens.split_word("ab", set(words)) == ["[UNK]"]
    with pytest.raises(FileNotFoundError):
        models.Folder(spark, str(tmp_path / "none"))


def test_onnx_tagger(spark):
    rows = [(i, [i, 0, 3], [1, 1, 0]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc int, input_ids array<long>, attention_mask array<int>").repartition(3)
    out = taggers.OnnxTagger(model(), batch=8)(df)
    got = out.select("doc", F.transform("logits", taggers.argmax).alias("labels"), "logits").collect()
    assert len(got) == 20
    for r in got:
        assert r["labels"] == [10 if r["doc"] else 0, 0, 0]
        assert r["logits"][0][2] == 2.0 * r["doc"]
