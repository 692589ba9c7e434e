"""The packing encoder: word by word only for tokenizers that allow it, whole texts for all others."""

import json

import numpy as np
import pyarrow as pa
import pytest

from cinnabar.llm import packing, queries

TEXTS = [*packing.PROBES, None, "A plain text, with  Marks\nand lines.", "end<|endoftext|>of text x"]


def whole(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t.encode(text or "", add_special_tokens=False).ids


def agree(path):
    encoder = packing.Encoder(path)
    assert [list(map(int, x)) for x in encoder.ids(pa.array(TEXTS))] == [whole(path, t) for t in TEXTS]
    return encoder.by_words


@pytest.fixture(scope="module")
def own():
    return queries.word_tokenizer()


def vocabulary(name):
    import public_tokenizers

    return str(public_tokenizers.path(name))


def test_word_vocabulary_goes_by_words_and_byte_vocabulary_whole(own):
    assert agree(own) and not agree(vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("change", [
    {"normalizer": None}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "StripAccents"}, {"type": "Lowercase"}]}},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    {"added_tokens": [{"id": 49406, "content": "plain text", "single_word": False, "lstrip": False, "rstrip": False, "normalized": True, "special": False}]},
])
def test_other_tokenizers_get_whole_texts(own, tmp_path, change):
    spec = json.load(open(own, encoding="utf-8")) | change
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    assert not agree(path)


def test_truncation_and_padding_of_the_file_dont_count(own, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(own)
    t.enable_truncation(4)
    t.enable_padding(length=16)
    t.save(str(tmp_path / "cut.json"))
    text = pa.array(["one two three four five six seven eight nine ten " * 3])
    assert np.array_equal(packing.Encoder(str(tmp_path / "cut.json")).ids(text)[0], packing.Encoder(own).ids(text)[0])


def test_pack_by_a_byte_vocabulary(spark):
    path = vocabulary("byte_bpe_50k.json")
    texts = ["One text.\n\n  Indented", "", None, "another " * 50]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, capacity=32).collect()
    assert {d: sum(r.length for r in out if r.doc_id == d) for d in range(4)} == {d: len(whole(path, t)) + 1 for d, t in enumerate(texts)}
