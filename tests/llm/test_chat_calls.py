"""The tokenizer is given bounded stretches of a batch, however many rows the batch has."""
import pyarrow as pa

from tabaudit.llm import chat
from tabaudit.llm.queries import vocabulary


def test_stretches():
    assert list(chat.stretches([], 5)) == []
    assert list(chat.stretches([2, 3, 1, 9, 0, 5, 1], 5)) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]


def test_calls_are_bounded(monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    with open(path) as f:
        codec = chat.Codec(f.read())
    seen, plain = [], codec.encode
    monkeypatch.setattr(codec, "encode", lambda texts: seen.append(sum(map(len, texts))) or plain(texts))
    monkeypatch.setitem(chat._WORKER, path, codec)
    texts = [f"turn {i} says \\ and </turn> again. " * 50 for i in range(2_000)]
    turns = pa.record_batch([pa.array([i // 7 for i in range(2_000)]), pa.array(range(2_000)), pa.array(["user", "assistant"] * 1_000), pa.array(texts)], names=["conv_id", "turn", "role", "text"])
    out = pa.Table.from_batches(list(chat._encoder(lambda: "", path)(iter([turns]))))
    assert out["turn"].to_pylist() == list(range(2_000))
    assert sum(seen) > 3_000_000 and max(seen) < 2 * chat.CALL_CHARS  # escapes make texts longer
    ids = chat.np.frombuffer(out["ids"][1999].as_py(), "<u4").tolist()
    assert ids[ids.index(codec.text) + 1 : -1] == plain([chat.escape(texts[1999])])[0]
