"""What encoding costs a worker: calls of the library, and memory kept after the tasks that need it."""

import numpy as np
import pyarrow as pa
import pytest

from grainledger.llm import language_id, minhash, packing, substrings, token_ids
from grainledger.llm.token_ids import WordEncoder, tokenizer_path

FILES = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))


class _Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, texts, **given):
        self.strings += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **given)


@pytest.mark.parametrize("name, space", FILES)
def test_new_words_are_encoded_together(name, space):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(name))
    library.encode_special_tokens = True
    words = [f"{'Éa'[i % 2]}w{i}x-{i % 7}{'.' * (i % 3)}" for i in range(1000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 1000, 50)] + ["a\x1eb", "\x1e", "<|endoftext|> [PAD] a", "", "one"]
    e = WordEncoder(tokenizer_path(name), space)
    e.tokenizer = counting = _Counting(e.tokenizer)
    for _ in range(2):  # new, then known
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counting.strings < 100


@pytest.mark.parametrize("task", [
    lambda docs: list(language_id._batches(iter(docs.to_batches()))),
    lambda docs: list(minhash._text_rows(iter(docs.to_batches()))),
    lambda docs: substrings._ask_anchors(1, 13, 5)(docs),
])
def test_other_operators_let_an_encoder_go(task):
    token_ids.encoder(*FILES[1])
    assert token_ids._encoders
    task(pa.table({"doc_id": pa.array([1]), "text": ["a b"], "shard": pa.array([0], pa.int32())}))
    assert not token_ids._encoders


def test_one_encoder_is_kept():
    for given in FILES:
        kept = token_ids.encoder(*given)
        assert token_ids.encoder(*given) is kept and len(token_ids._encoders) == 1
    token_ids.let_go()


class _Task:
    """Stands for a DataFrame, and keeps the function that tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def _packed(monkeypatch, **given):
    """(texts in each call of the encoder, rows, times that memory was given back) for 3,000 short texts."""
    calls, back = [], []

    class Encoder:
        dtype = np.dtype("<u2")

        def encode_many(self, texts):
            calls.append(len(texts))
            return [np.arange(len(t), dtype="<u2").tobytes() for t in texts]

    monkeypatch.setattr(packing, "encoder", lambda *a: Encoder())
    monkeypatch.setattr(packing, "give_back", lambda: back.append(1))
    docs = pa.record_batch({"doc_id": pa.array(range(3000)), "text": ["ab cd"] * 3000})
    rows = [r for b in packing.pack(_Task(), **given).run(iter([docs])) for r in b.to_pylist()]
    return calls, rows, back


def test_packing_looks_words_of_many_texts_up_together(monkeypatch):
    calls, rows, back = _packed(monkeypatch)
    assert calls == [2048, 952] and len(back) == 1
    fewer, same, _ = _packed(monkeypatch, together=256)
    assert max(fewer) == 256 and same == rows
    monkeypatch.setattr(packing, "BYTES", 1000)  # long texts: fewer at once
    fewer, same, _ = _packed(monkeypatch)
    assert max(fewer) < 2048 and same == rows


@pytest.mark.parametrize("name, space", FILES)
def test_odd_spaces_lines_and_marks(name, space):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(name))
    library.encode_special_tokens = True
    texts = ["a  b", "a\n b", "a\t b", "a\r b", " a", "a ", "\n", "ab\ncd ab cd. cd, ab.", "cd.\nab cd.\ncd.", "é1 1é É. x\ny. x x\ny.", "I'm don't' it's.", "ab. ab, ab ab\nab.", "a  b", "ªb º ßs. 東京. ١٢"]
    e = WordEncoder(tokenizer_path(name), space, 20)
    for _ in range(2):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
