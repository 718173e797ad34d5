"""Words of many texts are looked up together, each once."""

import numpy as np
import pytest

from grainledger.llm.token_ids import WordEncoder, tokenizer_path


@pytest.mark.parametrize("name, space", (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)))
def test_repeated_words_of_texts_are_looked_up_once(name, space):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(name))
    library.encode_special_tokens = True
    texts = ["to be, or not to be\nto be. or  not", "", " ", "\n", "to be or\nnot, to.\nbe\n\nor", "é.́ x\tto", "it's be's to... .to", "字 to\n字 x"] * 30
    for remember in (0, 4, 500_000):
        e = WordEncoder(tokenizer_path(name), space, remember)
        asked = []
        for known in {id(k): k for k in (e.first, e.known)}.values():
            known.all = lambda units, many, f=known.all: asked.extend(units) or f(units, many)
        for _ in range(2):
            assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(asked) < 150
    assert e.encode_many([]) == []
